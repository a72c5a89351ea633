"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.store import saved, small

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating; the mix's words as a share of all words; times that a word may be taken.
WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Words and rows of a shard at most, roughly; words of a block at most, and blocks that the smallest target has at least.
SHARD_WORDS, SHARD_ROWS, BLOCK, BLOCKS = 1_000_000, 20_000, 2_048, 64
#: Shards of a source at most: they meet in one window, and a shard's rows in another.
SHARDS = 10_000
SEED = "mix"


def seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def number(digest: Column) -> Column:
    """The first 8 hex digits of a digest as a long."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """sources (source, size, n) with rank, weight, target. Sources by code point, null last, take `weights` in turn. A target
    stops at `repeats` times its source's size and the excess is shared again, which is the level at which filling by weight up to
    those bounds uses the whole budget. One row per source is all that meets in a window here."""
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long")
    s = sources.withColumn("rank", turn)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("cap", F.lit(float(repeats)) * F.col("size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.lit(share) * F.sum("size").over(every) - before) / after).withColumn("at", F.row_number().over(order))
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("at", "level"))
    s = s.withColumn("level", F.min(open_).over(every)["level"])
    return s.select("source", "size", "n", "rank", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def apportioned(rows: DataFrame, group: str, item: str) -> DataFrame:
    """rows (group, item, votes double, seats long per group) with `quota`: the Sainte-Lague share of the group's seats.

    Rounding each item's share of the seats gives all but m of them, |m| at most half the group's items; m highest quotients
    votes / (2k - 1) are added, or the lowest taken away. An item can win or lose at most 1.5 * items * votes / total + 1 of
    those, so a few candidates an item are exact. Ties go to the lesser item. No votes, no seats.
    """
    w = Window.partitionBy(group)
    r = rows.withColumn("total", F.sum("votes").over(w)).withColumn("items", F.count("*").over(w))
    r = r.withColumn("base", F.when(F.col("total") > 0, F.floor(F.col("votes") * F.col("seats") / F.col("total") + 0.5)).otherwise(0).cast("long"))
    r = r.withColumn("m", F.when(F.col("total") > 0, F.col("seats")).otherwise(0) - F.sum("base").over(w))
    near = F.when(F.col("total") > 0, F.ceil(F.lit(1.5) * F.col("items") * F.col("votes") / F.col("total"))).otherwise(0) + 2
    steps = F.when(F.col("m") > 0, F.sequence(F.lit(1).cast("long"), near.cast("long"))).when(F.col("m") < 0, F.sequence(-F.least(near.cast("long"), F.greatest("base", F.lit(1))) + 1, F.lit(0).cast("long")))
    c = r.where("m <> 0 AND votes > 0 AND (m > 0 OR base > 0)").select(group, item, "votes", "base", "m", F.explode(steps).alias("step"))
    c = c.withColumn("quotient", F.col("votes") / (2 * (F.col("base") + F.col("step")) - 1))
    up = F.when(F.col("m") > 0, -F.col("quotient")).otherwise(F.col("quotient"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(up, F.when(F.col("m") > 0, F.col(item)).otherwise(-F.col(item)), F.abs("step")))
    won = c.withColumn("place", place).where("place <= abs(m)").groupBy(group, item).agg(F.sum(F.signum("m")).cast("long").alias("change"))
    return r.join(won, [group, item], "left").select(*rows.columns, (F.col("base") + F.coalesce("change", F.lit(0))).alias("quota"))


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """(doc_id, size, source, source_size, target, shard_size, at, start, length, taken) for each row of docs.

    A source's documents are dealt to shards by a seeded digest of doc_id and laid end to end in seeded order. Equal-token blocks
    go to sources by highest quotients of the targets, a source's blocks to its shards likewise; a shard of quota q yields the q blocks
    from a seeded block on, going round at most `repeats` times. taken: the words of the document among them. Null
    text has size 0, null sources are one source, rows without a doc_id are dealt by their texts; rows alike in doc_id and size are
    interchangeable. A source is split into shards, so none is one task's work: neither the shards of a source (SHARDS at most, as small rows) nor a shard's rows
    (ids and sizes only; over 200 million of a source, one in SHARDS of them). Empty tables give no rows.
    """
    key = seeded(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    sizes = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("key")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    t = saved(source_targets(sources, weights, share, repeats), "targets")
    every = Window.partitionBy(F.lit(1))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.coalesce(least, F.lit(1.0)) / BLOCKS))).cast("long")
    t = t.withColumn("block", block).withColumn("shards", F.ceil(F.least(F.greatest(F.col("size") / SHARD_WORDS, F.col("n") / SHARD_ROWS), F.lit(float(SHARDS)))).cast("long"))
    t = t.withColumn("seats", F.floor(F.sum("target").over(every) / F.col("block") + 0.5).cast("long")).withColumn("all", F.lit(0))
    t = saved(apportioned(t.withColumnRenamed("target", "votes"), "all", "rank").withColumnRenamed("votes", "target"), "quotas")
    by_source = t.select(F.col("source").alias("of"), "rank", F.col("size").alias("source_size"), "target", "block", "shards", F.col("quota").alias("seats"))
    dealt = sizes.join(small(by_source), F.col("source").eqNullSafe(F.col("of")))
    dealt = dealt.withColumn("shard", number(F.col("key")) % F.col("shards")).drop("of")
    shards = dealt.groupBy("rank", "shard").agg(F.sum("size").cast("double").alias("votes"), F.first("seats").alias("seats"), F.first("block").alias("block"))
    shards = apportioned(shards, "rank", "shard").select("rank", "shard", F.col("votes").cast("long").alias("shard_size"), F.col("block").alias("b"), "quota")
    n_blocks = F.greatest(F.ceil(F.col("shard_size") / F.col("b")), F.lit(1)).cast("long")
    shards = shards.withColumn("start", F.col("b") * (number(seeded(F.col("rank"), F.col("shard"))) % n_blocks))
    shards = shards.withColumn("length", F.least(F.col("quota") * F.col("b"), F.lit(repeats) * F.col("shard_size")))
    laid = Window.partitionBy("rank", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("at", F.sum("size").over(laid) - F.col("size")).join(shards.drop("b", "quota"), ["rank", "shard"])
    taken = sum((F.greatest(hi - lo, F.lit(0)) for lo, hi in passes(repeats)), F.lit(0))
    return placed.select("doc_id", "size", "source", "source_size", "target", "shard_size", "at", "start", "length", taken.cast("long").alias("taken"))


def passes(repeats: int = REPEATS) -> list[tuple[Column, Column]]:
    """For each time round a shard, the words [from, to) of a document's own that are taken (none where to <= from)."""
    out = []
    for p in range(repeats + 1):
        zero = F.col("shard_size") * p + F.col("at")
        lo = F.greatest(zero, F.col("start")) - zero
        hi = F.least(zero + F.col("size"), F.col("start") + F.col("length")) - zero
        out.append((lo, hi))
    return out


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """docs with each row as often as the mix takes it: whole, but where a shard's run of blocks begins or ends inside it,
    the words taken with the white space between them. n_chars, if there is such a column, becomes the text's length. Rows that
    share doc_id, source and size are taken as one row's worth each, in some order. Other columns stay.
    """
    names = docs.columns
    plan = mixed(docs, weights, share, repeats)
    runs = F.array(*[F.when(hi > lo, F.struct(lo.alias("lo"), hi.alias("hi"))) for lo, hi in passes(repeats)])
    by = ["mix_id", "mix_source"]
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("mix_id"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("mix_source")]
    plan = saved(plan.select(*key, F.col("size").alias("mix_size"), F.array_compact(runs).alias("runs")), "plan")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *key, n_words(F.col("text")).alias("mix_size"))
    if not plan.groupBy(*by).count().where("count > 1").isEmpty():
        # Rows of one id and source are told apart by their size, then by their order; an id has few rows.
        by = [*by, "mix_size", "mix_at"]
        same = Window.partitionBy(by[:3])
        plan = plan.withColumn("mix_at", F.row_number().over(same.orderBy(F.to_json("runs"))))
        rows = rows.withColumn("mix_at", F.row_number().over(same.orderBy(F.xxhash64("row"))))
    out = rows.join(plan.where(F.size("runs") > 0).select(*by, "runs"), by).select("row", "mix_size", F.explode("runs").alias("run"))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), (F.col("run.lo") + 1).cast("int"), (F.col("run.hi") - F.col("run.lo")).cast("int")), "")
    out = out.withColumn("body", F.when(F.col("run.hi") - F.col("run.lo") == F.col("mix_size"), F.col("row.text")).otherwise(F.rtrim(cut)))
    columns = [F.col("body").alias(c) if c == "text" else F.length("body").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in names]
    return out.select(*columns)


SQL = rf"""
WITH z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS key, row_number() OVER () AS row FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS n FROM z GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") AS rank FROM s0),
s2 AS (SELECT *, [5.0, 2.0, 1.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * size AS cap FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / weight, rank) AS pos FROM s2),
lv AS (SELECT arg_min(level, pos) AS level FROM s3 WHERE level * weight <= cap),
s4 AS (SELECT source, size, n, rank, coalesce(least(cap, weight * lv.level), cap) AS target FROM s3, lv),
s5 AS (SELECT *, greatest(1, least({BLOCK}, floor(coalesce(min(target) FILTER (WHERE target > 0) OVER (), 1.0) / {BLOCKS})))::BIGINT AS block,
  ceil(least(greatest(size / {SHARD_WORDS}, n / {SHARD_ROWS}), {SHARDS}.0))::BIGINT AS shards, sum(target) OVER () AS total FROM s4),
s6 AS (SELECT *, floor(total / block + 0.5)::BIGINT AS seats, floor(target * floor(total / block + 0.5) / total + 0.5)::BIGINT AS base, count(*) OVER () AS items FROM s5),
s7 AS (SELECT *, (seats - sum(base) OVER ())::BIGINT AS m FROM s6),
c1 AS (SELECT rank, target, base, m, unnest(CASE WHEN m > 0 THEN range(1, ceil(1.5 * items * target / total)::BIGINT + 3) ELSE range(-least(ceil(1.5 * items * target / total)::BIGINT + 2, base) + 1, 1) END) AS step FROM s7 WHERE m <> 0 AND target > 0 AND (m > 0 OR base > 0)),
c2 AS (SELECT rank, m, row_number() OVER (ORDER BY CASE WHEN m > 0 THEN -1 ELSE 1 END * target / (2 * (base + step) - 1), CASE WHEN m > 0 THEN rank ELSE -rank END, abs(step)) AS place FROM c1),
s8 AS (SELECT s7.*, base + coalesce((SELECT sum(sign(c2.m)) FROM c2 WHERE c2.rank = s7.rank AND place <= abs(c2.m)), 0)::BIGINT AS quota FROM s7),
d AS (SELECT z.*, s8.rank, s8.size AS source_size, target, block, s8.quota AS seats, ('0x' || substr(key, 1, 8))::BIGINT % shards AS shard FROM z JOIN s8 ON z.source IS NOT DISTINCT FROM s8.source),
h1 AS (SELECT rank, shard, sum(size)::DOUBLE AS votes, any_value(seats) AS seats, any_value(block) AS b FROM d GROUP BY rank, shard),
h2 AS (SELECT *, sum(votes) OVER (PARTITION BY rank) AS total, count(*) OVER (PARTITION BY rank) AS items FROM h1),
h3 AS (SELECT *, CASE WHEN total > 0 THEN floor(votes * seats / total + 0.5) ELSE 0 END::BIGINT AS base FROM h2),
h4 AS (SELECT *, (CASE WHEN total > 0 THEN seats ELSE 0 END - sum(base) OVER (PARTITION BY rank))::BIGINT AS m FROM h3),
e1 AS (SELECT rank, shard, votes, base, m, unnest(CASE WHEN m > 0 THEN range(1, ceil(1.5 * items * votes / total)::BIGINT + 3) ELSE range(-least(ceil(1.5 * items * votes / total)::BIGINT + 2, base) + 1, 1) END) AS step FROM h4 WHERE m <> 0 AND votes > 0 AND (m > 0 OR base > 0)),
e2 AS (SELECT rank, shard, m, row_number() OVER (PARTITION BY rank ORDER BY CASE WHEN m > 0 THEN -1 ELSE 1 END * votes / (2 * (base + step) - 1), CASE WHEN m > 0 THEN shard ELSE -shard END, abs(step)) AS place FROM e1),
h5 AS (SELECT rank, shard, votes::BIGINT AS shard_size, b, base + coalesce((SELECT sum(sign(e2.m)) FROM e2 WHERE e2.rank = h4.rank AND e2.shard = h4.shard AND place <= abs(e2.m)), 0)::BIGINT AS quota FROM h4),
h6 AS (SELECT rank, shard, shard_size, b * (('0x' || substr(md5('{SEED}:' || rank || ':' || shard), 1, 8))::BIGINT % greatest(ceil(shard_size / b), 1)::BIGINT) AS start, least(quota * b, 2 * shard_size) AS length FROM h5),
p AS (SELECT d.*, (sum(size) OVER (PARTITION BY rank, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS pos FROM d)
SELECT doc_id, size, source_size, target, (
    greatest(least(pos + size, start + length) - greatest(pos, start), 0)
  + greatest(least(shard_size + pos + size, start + length) - greatest(shard_size + pos, start), 0)
  + greatest(least(2 * shard_size + pos + size, start + length) - greatest(2 * shard_size + pos, start), 0))::BIGINT AS taken
FROM p JOIN h6 USING (rank, shard)
"""
