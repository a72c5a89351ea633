"""Records and reports written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import vocab as V
from tallyglass.operators.evaluate import as_cell
from tallyglass.sources import files
from tallyglass.sources.ocr import RESULT


def record_json(record: dict[str, Column]) -> Column:
    """A record's own fields as a JSON object of texts, empty for null."""
    return F.to_json(F.struct(*[as_cell(F.to_json(c) if k == "gps" else c).alias(k) for k, c in record.items()]))


def per_document_json(records: DataFrame) -> DataFrame:
    """(doc_id, name, json): what a download of each record holds."""
    return records.select("doc_id", F.concat("doc_id", F.lit("_result.json")).alias("name"), record_json({f: F.col(f) for f in V.FIELDS}).alias("json"))


def write_files(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each record's download as a file of its own, `<doc_id>_result.json`, indented, in a folder a task below path. All appear when the job commits; a
    job that fails leaves none. path is a URI or on a mount that all executors share."""
    per_document_json(records).select("name", "json").write.format(files.registered(records.sparkSession)).mode(mode).option("path", path).save()


def as_results(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """Records under the names that earlier results have (ocr.RESULT): metadata behind an underscore, the key as _sample; what records lack is null."""
    have = {**{f"_{c}": c for c in records.columns if c not in V.FIELDS}, **{f: f for f in V.FIELDS}, "_sample": key}
    return records.select(*[(F.col(have[f.name]) if have.get(f.name) in records.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT.fields])


def write_results(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records with their metadata as JSON lines that ocr.results reads, one part a task."""
    as_results(records).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The column `line` as text."""
    lines.select("line").write.mode(mode).text(path)
