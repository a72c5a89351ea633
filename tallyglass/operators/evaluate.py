"""Results against answers, and rates over results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.functions import vocab as V
from tallyglass.functions.quality import present
from tallyglass.functions.textnorm import comparable


COMPARED = V.COMPARED_FIELDS


def _text(f: str) -> Column:
    return F.concat(F.col("gps.latitude").cast("string"), F.col("gps.longitude").cast("string")) if f == "gps" else F.col(f).cast("string")


def cells(records: DataFrame, key: str = "doc_id", fields: list[str] | None = None) -> DataFrame:
    """(key, field, value) of each record's fields as text; coordinates one after the other. A row's own expansion: no shuffle."""
    made = [F.struct(F.lit(f).alias("field"), _text(f).alias("value")) for f in fields or COMPARED]
    return records.select(key, F.explode(F.array(*made)).alias("c")).select(key, "c.field", "c.value")


def compared(results: DataFrame, answers: DataFrame) -> DataFrame:
    """(sample, field, value, answer, matched) for each field that both have; results (sample, field, value), answers
    (sample, field, answer). Spaces, punctuation and case don't count."""
    both = results.join(answers, ["sample", "field"])
    return both.withColumn("matched", comparable(F.col("value")) == comparable(F.col("answer")))


def match_rate(compared_: DataFrame) -> DataFrame:
    """One row: matches, fields, percent."""
    n, hits = F.count("*"), F.count_if("matched")
    return compared_.agg(hits.alias("matches"), n.alias("total"), F.coalesce(hits / F.nullif(n, F.lit(0)) * 100, F.lit(0.0)).alias("rate"))


def report(compared_: DataFrame) -> DataFrame:
    """Fixed-width lines of a comparison."""
    line = F.concat_ws(" | ", F.rpad("sample", 25, " "), F.rpad("field", 15, " "), F.rpad(F.coalesce("value", F.lit("None")), 20, " "), F.rpad(F.coalesce("answer", F.lit("None")), 20, " "), F.when(F.col("matched"), "ok").otherwise("differs"))
    return compared_.select("sample", "field", line.alias("line"))


def _sides(results: DataFrame, key: str, side: str, fields: list[str]) -> DataFrame:
    own = [_text(f).alias(f) for f in fields]
    return results.select(F.col(key).cast("string").alias("sample"), F.lit(side).alias("side"), F.struct(*own).alias("r"))


def regression(stored: DataFrame, fresh: DataFrame, answers: DataFrame | None = None, fields: list[str] | None = None, stored_key: str = "_sample", fresh_key: str = "doc_id") -> DataFrame:
    """(sample, field, stored, fresh, state, answer, stored_ok, fresh_ok) for each compared field of each sample that earlier results or fresh records have, or both.

    state: same, changed, gained (null before), lost (null now), or unstored and unmade where the sample stands on one side only; values are compared as they
    are, with spaces, punctuation and case. answer and whether either value meets it (as compared() judges) are null without an answer for the field. A sample that is null counts as one sample;
    of several rows of a sample on a side the one with the greatest values counts. Both sides meet in one aggregation to a maximum, combined before the
    shuffle, so a sample with many rows is no task's burden; empty tables are fine. Answers are gathered by sample and join before fields become rows, so that no row a field is shuffled."""
    fields = fields or COMPARED
    rows = _sides(stored, stored_key, "stored", fields).unionByName(_sides(fresh, fresh_key, "fresh", fields))
    one = rows.groupBy("sample").agg(*[F.max(F.when(F.col("side") == side, F.col("r"))).alias(side) for side in ("stored", "fresh")])
    if answers is None:
        one = one.withColumn("_said", F.lit(None).cast("array<struct<field:string,answer:string>>"))
    else:
        known = answers.where(F.col("sample").isNotNull() & F.col("field").isin(list(fields)))
        known = known.groupBy(F.col("sample").cast("string").alias("sample")).agg(F.collect_list(F.struct("field", "answer")).alias("_said"))
        one = one.join(known, "sample", "left")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"stored.{f}").alias("stored"), F.col(f"fresh.{f}").alias("fresh")) for f in fields])
    out = one.select("sample", "_said", F.col("stored").isNull().alias("_new"), F.col("fresh").isNull().alias("_gone"), F.explode(each).alias("c")).select("sample", "c.*", "_new", "_gone", "_said")
    state = F.when(F.col("_new"), "unstored").when(F.col("_gone"), "unmade").when(F.col("stored").eqNullSafe(F.col("fresh")), "same").when(F.col("stored").isNull(), "gained").when(F.col("fresh").isNull(), "lost").otherwise("changed")
    own = F.transform(F.filter("_said", lambda a: a["field"] == F.col("field")), lambda a: a["answer"])
    out = out.withColumn("state", state).withColumn("_own", own).drop("_said")
    out = out.withColumn("_asked", F.coalesce(F.size("_own") > 0, F.lit(False)))
    out = out.withColumn("answer", F.explode_outer("_own")).drop("_own")
    ok = lambda side, absent: F.when(F.col("_asked") & ~F.col(absent), comparable(F.col(side)) == comparable(F.col("answer")))
    return out.select("sample", "field", "stored", "fresh", "state", "answer", ok("stored", "_new").alias("stored_ok"), ok("fresh", "_gone").alias("fresh_ok"))


def regression_summary(rows: DataFrame) -> DataFrame:
    """(field, samples, same, changed, gained, lost, unstored, unmade, stored_rate, fresh_rate, fixed, broken) of regression()."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("same", "changed", "gained", "lost", "unstored", "unmade")]
    rate = lambda c: (F.count_if(c) / F.nullif(F.count(c), F.lit(0)) * 100)
    was, now = F.col("stored_ok"), F.col("fresh_ok")
    return rows.groupBy("field").agg(F.count("*").alias("samples"), *counts, rate("stored_ok").alias("stored_rate"), rate("fresh_ok").alias("fresh_rate"), F.count_if(~was & now).alias("fixed"), F.count_if(was & ~now).alias("broken"))


def extraction_rates(records: DataFrame) -> DataFrame:
    """(field, found, total, rate) for each field: zero, empty and null count as not found. One pass over the records."""
    truthy = lambda f: F.col(f).isNotNull() if f == "gps" else present(F.col(f)) if f in V.RANGES else F.coalesce(F.col(f), F.lit("")) != ""
    one = records.agg(F.count("*").alias("total"), *[F.count_if(truthy(f)).alias(f) for f in V.FIELDS])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("found")) for f in V.FIELDS]))
    return one.select("total", rows.alias("r")).select("r.field", "r.found", "total", (F.col("r.found") / F.nullif(F.col("total"), F.lit(0))).alias("rate"))


def equation_rate(records: DataFrame) -> DataFrame:
    """One row: complete triplets, those that balance, their share."""
    total, tare, net = (F.col(k) for k in V.RANGES)
    full = present(total) & present(tare) & present(net)
    ok = full & (F.abs(total - (tare + net)) <= V.EQUATION_TOLERANCE)
    return records.agg(F.count_if(full).alias("complete"), F.count_if(ok).alias("balanced")).withColumn("rate", F.col("balanced") / F.nullif(F.col("complete"), F.lit(0)))


def confidence_stats(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg("overall_confidence").alias("mean_confidence"), F.count_if("needs_review").alias("to_review"))


def as_cell(c: Column) -> Column:
    """A value as a table shows it: text, empty for null."""
    return F.coalesce(c.cast("string"), F.lit(""))
