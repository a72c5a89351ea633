"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.store import dropped, saved, split_join


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) edges of long ids -> (node, root) for each node on an edge, root being the smallest id reachable.

    Each round is two aggregations to a minimum (combined before the shuffle) and two joins, whose hubs are dealt to many tasks, and ends in a table in the
    shared folder. A round shortens every path by a constant factor, so chains take logarithmically many rounds. Self loops
    and repeated edges are fine; an edge with a null end is dropped; no edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = saved(e, "edges"), None
    total = e.count()
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = split_join(both, low, "u", ["v"], 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        kept = split_join(large, low, "u", ["v"], total)
        new = saved(kept.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(e)
        e, total = new, state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
