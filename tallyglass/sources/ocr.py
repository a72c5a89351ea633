"""Recognised documents: JSON files, pasted JSON, answer tables, earlier results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions import vocab as V

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
WORD = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("boundingBox", T.StructType([T.StructField("vertices", T.ArrayType(VERTEX))])),
])
PAGE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("words", T.ArrayType(WORD)),
])
DOCUMENT = T.StructType([T.StructField("pages", T.ArrayType(PAGE))])
GPS = T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])
RECORD = T.StructType([T.StructField(f, T.IntegerType() if f in V.RANGES else GPS if f == "gps" else T.StringType()) for f in V.FIELDS])
RESULT = T.StructType([
    T.StructField("_sample", T.StringType()), *RECORD.fields, T.StructField("_field_confidences", T.MapType(T.StringType(), T.DoubleType())), T.StructField("_overall_confidence", T.DoubleType()),
    T.StructField("_issues", T.ArrayType(T.StringType())), T.StructField("_review_priority", T.StringType()), T.StructField("_needs_review", T.BooleanType()),
    T.StructField("_repaired", T.BooleanType()), T.StructField("_parser_method", T.StringType()), T.StructField("_parser_version", T.StringType()),
])
BROKEN = "_corrupt_record"


def documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(doc_id, page, broken) of each JSON file under path, or of one file: its first page, and its text if it isn't valid JSON. Ids are the
    files' names without .json. No schema is inferred, so files are read once."""
    return from_files(spark.read.option("pathGlobFilter", glob).text(path, wholetext=True))


def from_files(raw: DataFrame) -> DataFrame:
    """(doc_id, page, broken) of files read as whole texts, a batch or a stream."""
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return _read(raw.select(stem.alias("doc_id"), F.col("value").alias("json")), "json")


def _read(rows: DataFrame, column: str) -> DataFrame:
    schema = T.StructType([*DOCUMENT.fields, T.StructField(BROKEN, T.StringType())])
    parsed = rows.select("doc_id", F.from_json(F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}).alias("d"))
    return parsed.select("doc_id", F.get("d.pages", F.lit(0)).alias("page"), F.col(f"d.{BROKEN}").alias("broken"))


def valid(docs: DataFrame) -> DataFrame:
    return docs.where("broken IS NULL").drop("broken")


def broken(docs: DataFrame) -> DataFrame:
    return docs.where("broken IS NOT NULL").select("doc_id", "broken")


def pasted(rows: DataFrame, column: str = "json") -> DataFrame:
    """(doc_id, page, broken) of a column of JSON texts; ids are digests of the texts."""
    return _read(rows.select(F.sha2(column, 256).alias("doc_id"), column), column)


def mentions_boxes(json_text: Column, name: str = "boundingBox") -> Column:
    """Whether a valid JSON text has an object with this name at any depth, as a recursive search of it finds.

    A name is a string with a colon behind it. Once escapes other than Unicode ones are out of the way, every quote left opens or closes a string, so no text
    that merely quotes the name counts; a letter may stand as its escape. One pass over the text, however deep it is nested."""
    letters = "".join(f"(?:{re.escape(c)}|\\\\u(?i:{ord(c):04x}))" for c in name)
    return F.regexp_replace(json_text, r'\\[^u]', "_").rlike(rf'"{letters}"[\x20\t\n\r]*:')


def texts(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, page) of plain texts, as documents without boxes."""
    page = F.struct(F.col(text).alias("text"), *[F.lit(None).cast("double").alias(c) for c in ("width", "height", "confidence")], F.lit(None).cast(T.ArrayType(WORD)).alias("words"))
    return rows.select(F.col(doc_id).cast("string").alias("doc_id"), page.alias("page"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(sample, field, answer) of markdown answer tables: a section for each sample, the last cell of a row its answer, - none."""
    return answer_rows(spark.read.text(path, wholetext=True), "value")


def answer_rows(rows: DataFrame, column: str) -> DataFrame:
    section = rows.select(F.explode(F.split(column, r"\n---")).alias("section"))
    section = section.select(F.regexp_extract("section", r"## (sample_\d+(?:_\w+)?)\.json", 1).alias("sample"), "section").where("sample <> ''")
    line = section.select("sample", F.posexplode(F.split("section", r"\n")).alias("line_no", "line")).where(F.contains("line", F.lit("|")))
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(F.regexp_replace(c, "\r", "")))
    cells = F.when(F.get(cells, F.lit(0)) == "", F.slice(cells, F.lit(2), F.size(cells))).otherwise(cells)
    cells = F.when(F.try_element_at(cells, F.lit(-1)) == "", F.slice(cells, F.lit(1), F.size(cells) - 1)).otherwise(cells)
    table = line.withColumn("cells", cells).where(F.size("cells") >= 2)
    field, last = F.get("cells", F.lit(0)), F.nullif(F.try_element_at("cells", F.lit(-1)), F.lit("-"))
    answer = F.when(field.isin(*V.RANGES), F.replace(last, F.lit(","), F.lit(""))).otherwise(last)
    out = table.select("sample", field.alias("field"), answer.alias("answer"), "line_no").where("field <> '필드' AND NOT field RLIKE '^[- :]*$'")
    return out.groupBy("sample", "field").agg(F.max_by("answer", "line_no").alias("answer"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results under path: JSON lines, as sinks.write_results leaves them, with the columns of a record and its metadata; files are split among tasks."""
    return spark.read.schema(RESULT).json(path)


def result_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Earlier results of files that each hold one JSON array, indented or not; a file is one task's."""
    return spark.read.schema(RESULT).option("multiLine", True).json(path)


def result_rows(rows: DataFrame, column: str) -> DataFrame:
    """Earlier results of a column of JSON texts, each one result or an array of them; a text that doesn't parse gives none."""
    text = F.when(F.col(column).rlike(r"^\s*\["), F.col(column)).otherwise(F.concat(F.lit("["), column, F.lit("]")))
    return rows.select(F.explode(F.from_json(text, T.ArrayType(RESULT))).alias("r")).select("r.*")


def result_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, fields as texts) of the files of sinks.write_files."""
    fields = T.StructType([T.StructField(f, T.StringType()) for f in V.FIELDS])
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_result*.json").text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"_result( \(\d+\))?\.json$", "")
    return raw.select(stem.alias("doc_id"), F.from_json("value", fields).alias("r")).select("doc_id", "r.*")
