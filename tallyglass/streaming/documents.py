"""A folder of recognised documents as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyglass.operators import review
from tallyglass.plans.documents import Options, parsed
from tallyglass.sources import ocr


def files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(doc_id, page, broken) of JSON files as they arrive, `per_trigger` files at a time: ocr.valid of it are documents, ocr.broken of it are
    the texts that don't parse."""
    raw = spark.readStream.option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return ocr.from_files(raw)


def documents(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(doc_id, page) of the JSON files that parse, as they arrive."""
    return ocr.valid(files(spark, path, per_trigger))


def records(docs: DataFrame, options: Options | None = None) -> DataFrame:
    """Records of a stream of documents. Both routes are row by row, so no state is kept and append mode does."""
    return parsed(docs, options)


def write(records_: DataFrame, path: str, checkpoint: str):
    """Records to a Parquet folder, each once."""
    return records_.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summaries(records_: DataFrame) -> DataFrame:
    """review.summary of the records so far, one row that is updated. A document counts once, by its id, however often its file comes: ids are state,
    kept in the state store, as is one row of sums."""
    return review.summary(records_.dropDuplicates(["doc_id"]))


def write_summary(summary: DataFrame, path: str, checkpoint: str):
    """The latest summary as JSON lines at path, put there anew after each batch with new documents; a batch that is done again after a restart puts the same."""

    def put(batch: DataFrame, _: int) -> None:
        rows = batch.collect()  # one row, by construction
        if rows:
            batch.sparkSession.createDataFrame(rows, batch.schema).coalesce(1).write.mode("overwrite").json(path)

    return summary.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
