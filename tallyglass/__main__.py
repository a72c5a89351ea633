"""Documents under a path to records, as a job: spark-submit --py-files … tallyglass/__main__.py INPUT OUTPUT, or python -m tallyglass."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyglass.operators import review
from tallyglass.plans.documents import Options, parsed
from tallyglass.sources import ocr


def run(spark: SparkSession, source: str, target: str, kind: str = "json", as_of: str | None = None) -> dict:
    """Read JSON files, or the lines of text files, under source; write records to target/records and files that don't parse to target/broken, as
    Parquet; return the summary of the records written. A field that fails costs itself only, and is named in failed_fields."""
    if kind == "json":
        docs = ocr.documents(spark, source)
        ocr.broken(docs).write.mode("overwrite").parquet(f"{target}/broken")
        docs = ocr.valid(docs)
    else:
        lines = spark.read.text(source, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("text"))
        docs = ocr.texts(lines, "doc_id", "text")
    parsed(docs, Options(as_of=as_of, guard=True)).write.mode("overwrite").parquet(f"{target}/records")
    return review.summary(spark.read.parquet(f"{target}/records")).first().asDict()


def main(argv: list[str] | None = None) -> None:
    arguments = argparse.ArgumentParser(prog="tallyglass", description="Recognised tickets to scored records.")
    arguments.add_argument("input")
    arguments.add_argument("output")
    arguments.add_argument("--kind", choices=["json", "text"], default="json", help="JSON files with boxed words, or plain text files")
    arguments.add_argument("--as-of", help="the day that dates are judged on, as YYYY-MM-DD; today if none is given")
    a = arguments.parse_args(argv)
    spark = SparkSession.builder.appName("tallyglass").getOrCreate()
    for name, value in run(spark, a.input, a.output, a.kind, a.as_of).items():
        print(f"{name}: {value}")


if __name__ == "__main__":
    main()
