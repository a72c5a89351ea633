"""Joins of the shared store: what is broadcast does not depend on Spark's estimates."""

from pyspark.sql import functions as F

from tallyglass.llm import store


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_a_side_of_exploded_rows_is_never_broadcast_by_its_estimate(spark):
    base = store.saved(spark.range(200).select(F.col("id").alias("fp")), "base")
    keyed = base.select("fp", F.explode(F.sequence(F.col("fp") * 64, F.col("fp") * 64 + 63)).alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n"))
    out = store.split_join(keyed, met, "key", ["fp"], 12_800)
    assert joins(out) == (1, 1)  # the flags of hot keys alone are broadcast
    assert out.count() == 12_800


def test_copies_of_a_side_too_large_to_broadcast_are_not_broadcast_either(spark, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_BYTES", 0)
    right = store.saved(spark.range(50).select(F.col("id").alias("key"), F.lit(1).alias("met")), "right")
    out = store.looked_up(spark.range(100).select(F.col("id").alias("key"), F.lit(0).alias("x")), right, "key", ["x"])
    assert joins(out) == (0, 1)
    assert out.where("met IS NOT NULL").count() == 50 and out.count() == 100
