"""Review of scored records: buckets, summaries, duplicate values, recomputed weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import vocab as V


def bucket(priority: Column, repaired: Column) -> Column:
    """passed, auto_fixed, needs_review or failed; a LOW record that was not repaired has failed."""
    return (
        F.when(priority == "NONE", "passed").when((priority == "LOW") & F.coalesce(repaired, F.lit(False)), "auto_fixed")
        .when(priority.isin("MEDIUM", "HIGH"), "needs_review").otherwise("failed")
    )


def buckets(scored: DataFrame) -> DataFrame:
    """scored with a column bucket; a missing priority counts as CRITICAL."""
    return scored.withColumn("bucket", bucket(F.coalesce("review_priority", F.lit("CRITICAL")), F.col("repaired")))


def summary(scored: DataFrame) -> DataFrame:
    """One row: records, records of each priority, records to review and repaired, and the mean confidence."""
    rank = F.coalesce("review_priority", F.lit("CRITICAL"))
    each = [F.count_if(rank == name).alias(f"priority_{name.lower()}") for name, _ in V.PRIORITIES]
    mean = F.coalesce(F.bround(F.sum(F.coalesce("overall_confidence", F.lit(0.0))) / F.nullif(F.count("*"), F.lit(0)), 2), F.lit(0.0))
    return scored.agg(F.count("*").alias("total"), *each, F.count_if("needs_review").alias("needs_review_count"), F.count_if("repaired").alias("auto_repaired_count"), mean.alias("average_confidence"))


def band(confidence: Column) -> Column:
    """How a confidence is shown."""
    return F.when(confidence >= 90, "normal").when(confidence >= 70, "check").otherwise("review")


def field_values(record: dict[str, Column], names: list[str]) -> Column:
    """array<struct<ord, field, value>> of the fields that have a value, as trimmed text."""
    every = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("field"), F.trim(record[n].cast("string")).alias("value")) for i, n in enumerate(names)])
    return F.filter(every, lambda v: v["value"].isNotNull() & (v["value"] != "") & ~((v["value"] == "0") & v["field"].isin(*V.RANGES)))


def duplicates(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field_a, field_b, value) for each two fields of a record with the same value. Ten fields make 45 pairs at most, within a
    row."""
    values = field_values({n: F.col(n) for n in V.DUPLICATE_FIELDS}, V.DUPLICATE_FIELDS)
    rows = records.select(key, values.alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: (b["ord"] > a["ord"]) & (b["value"] == a["value"])), lambda b: F.struct(a["field"].alias("field_a"), b["field"].alias("field_b"), a["value"].alias("value")))))
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def reconciled(total: Column, tare: Column, net: Column) -> Column:
    """struct(calculated, difference, state) of weights as they were typed: thousands separators go, what is no number is missing."""
    typed = lambda c: F.trim(F.replace(c.cast("string"), F.lit(","), F.lit(""))).try_cast("int")
    calculated, given = typed(total) - typed(tare), typed(net)
    state = F.when(calculated.isNull(), "incomplete").when(given.isNull(), "net_missing").when(calculated == given, "match").otherwise("mismatch")
    return F.struct(calculated.alias("calculated"), F.when(calculated != given, given - calculated).alias("difference"), state.alias("state"))
