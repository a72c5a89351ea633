"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the power of two below their number of shingles. A partition sets the size of its items' sketches, which are
their least shingle hashes: a document that holds the share t of an item's n shingles lacks n - ceil(t * n) of them at most, so one more
value than the partition's largest item may lack always meets such a document, however long it is. The containment threshold thus becomes, for each partition, a
sketch size, a bound on the values that its sketches hold, and the number of shingles that a document must have to be asked at all. Documents
are asked with their shingles, not with a sketch of their own (one of a 20,000-word document would not see a 15-word item). The search joins ids only; hits are
verified by exact containment, on the shingles themselves, each document's shingles being made once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.store import SALTS, dealt, fits, saved, small

WIDTH, CONTAINED = 5, 0.8
FOUND = "doc_id long, item_id long, n_shared int, n_shingles int, containment double"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, whatever stands between; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(w: Column, width: int) -> Column:
    return F.when(F.size(w) >= width, F.sequence(F.lit(1), F.size(w) - width + 1)).otherwise(F.array().cast("array<int>"))


def shingles(w: Column, width: int) -> Column:
    """The runs of `width` words, joined by a space; none if there are fewer words."""
    return F.transform(_starts(w, width), lambda i: F.array_join(F.slice(w, i, width), " "))


def hashes(w: Column, width: int) -> Column:
    """The distinct hash values of the runs of `width` words."""
    return F.array_distinct(F.transform(_starts(w, width), lambda i: F.xxhash64(F.slice(w, i, width))))


def _lacking(n: Column, contained: float) -> Column:
    """How many of n shingles a text that holds the share may lack."""
    return n - F.ceil(n * contained - 1e-9).cast("int")


def sketched(items: DataFrame, width: int = WIDTH, contained: float = CONTAINED) -> DataFrame:
    """(item_id, wide, part, n, parts, sketch) of items that have words: n distinct shingles, parts, of `wide` words (an item of fewer than `width` words is one
    shingle), the size partition, and the sketch that it asks for."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).select("item_id", "w", F.least(F.size("w"), F.lit(width)).alias("wide"))
    sizes = range(1, width + 1)
    parts = F.coalesce(*[F.when(F.col("wide") == k, F.array_distinct(shingles(F.col("w"), k))) for k in sizes])
    values = F.coalesce(*[F.when(F.col("wide") == k, hashes(F.col("w"), k)) for k in sizes])
    out = w.select("item_id", "wide", parts.alias("parts"), F.sort_array(values).alias("values")).withColumn("n", F.size("parts"))
    out = out.withColumn("part", F.floor(F.log2("n") + 1e-9).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("part") + 1).cast("int") - 1
    return out.select("item_id", "wide", "part", "n", "parts", F.slice("values", F.lit(1), _lacking(largest, contained) + 1).alias("sketch"))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) for each item of which a document holds the share `contained` of
    the shingles or more; one row for a pair of ids.

    Null and empty texts, and items without words, match nothing. Repeated rows and rows with the same id count
    together (the most shared counts); null ids are one id. Other columns are not read. Empty tables give no rows. A shingle that very many documents hold
    makes one small row for each of them and item, and no group of documents is ever gathered. The sketches are broadcast only if their bytes as shipped
    allow it; else they are copied to as many parts as documents are dealt to.
    """
    spark = docs.sparkSession
    kept = saved(sketched(items, width, contained), "items")
    # A row for each width and power of two at most.
    shape = kept.groupBy("wide", "part").agg(F.max(F.element_at("sketch", -1)).alias("most"), F.min(F.ceil(F.col("n") * contained - 1e-9)).alias("least")).orderBy("wide", "part").collect()
    if not shape:
        return spark.createDataFrame([], FOUND)
    wides = sorted({r["wide"] for r in shape})
    index = kept.select("wide", "part", F.explode("sketch").alias("value"), "item_id")
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    asked = F.flatten(F.array(*[_asked(hashes(F.col("w"), k), k, [r for r in shape if r["wide"] == k]) for k in wides]))
    asked = w.select("doc_id", F.explode(asked).alias("p")).select("doc_id", "p.wide", "p.value")
    if fits(index):
        pairs = asked.join(F.broadcast(index), ["wide", "value"])
    else:
        copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = asked.withColumn("salt", dealt(["doc_id", "value"])).join(copies.hint("merge"), ["wide", "value", "salt"])
    pairs = saved(pairs.select("doc_id", "item_id").distinct(), "pairs")
    return _verified(docs, kept, pairs, wides, contained)


def _asked(values: Column, wide: int, partitions: list) -> Column:
    """The hash values, of runs of `wide` words, that a sketch of a partition can hold whose items such a document may hold."""

    def of(values: Column) -> Column:
        bound = F.greatest(*[F.when(F.size(values) >= r["least"], F.lit(r["most"])) for r in partitions], F.lit(None).cast("long"))
        return F.transform(F.filter(values, lambda v: v <= bound), lambda v: F.struct(F.lit(wide).alias("wide"), v.alias("value")))

    return F.get(F.transform(F.array(values), of), F.lit(0))


def _of_width(runs: Column, wide: int) -> Column:
    return F.transform(runs, lambda g: F.struct(F.lit(wide).alias("wide"), g.alias("g")))


def _verified(docs: DataFrame, kept: DataFrame, pairs: DataFrame, wides: list[int], contained: float) -> DataFrame:
    """The pairs whose document holds enough of the item's shingles. Texts are read again for the documents of pairs only."""
    asked = docs.select("doc_id", "text").join(small(pairs.select(F.col("doc_id").alias("d")).distinct()), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    asked = asked.select("doc_id", F.xxhash64("text").alias("body"), words(F.col("text")).alias("w"))
    held = asked.select("doc_id", "body", F.explode(F.flatten(F.array(*[_of_width(shingles(F.col("w"), k), k) for k in wides]))).alias("s")).select("doc_id", "body", "s.wide", "s.g")
    parts = kept.select(F.col("item_id").alias("i"), F.xxhash64("parts").alias("item"), "wide", "n", F.explode("parts").alias("g"))
    known = parts.select("wide", "g").distinct()
    if fits(known):
        held = held.join(F.broadcast(known), ["wide", "g"], "left_semi")
    of = shared_shingles(held, _of_pairs(pairs, parts)).groupBy("doc_id", "body", "item_id", "item", "n").agg(F.count_distinct("g").cast("int").alias("shared"))
    found = of.where(F.col("shared") >= F.col("n") * contained - 1e-9).groupBy("doc_id", "item_id").agg(F.max("shared").alias("n_shared"), F.max("n").alias("n_shingles"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def _of_pairs(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(d, item_id, item, n, wide, g): each pair with its item's shingles. An item that very many documents are paired with is dealt to copies where items aren't broadcast."""
    same = F.col("item_id").eqNullSafe(F.col("i"))
    if fits(parts):
        joined = pairs.join(F.broadcast(parts), same)
    else:
        copies = parts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = pairs.withColumn("_salt", dealt(["doc_id", "item_id"])).join(copies.hint("merge"), same & (F.col("_salt") == F.col("_s")))
    return joined.select(F.col("doc_id").alias("d"), "item_id", "item", "n", "wide", "g")


def shared_shingles(held: DataFrame, of_pairs: DataFrame) -> DataFrame:
    """held (doc_id, body, wide, g) with the items that the document is paired with and that have the shingle: a row for each shingle that a pair shares and no other. The document is part
    of the key, so a shingle of very many documents is many keys."""
    right = of_pairs.select("d", "item_id", "item", "n", F.col("wide").alias("w"), F.col("g").alias("h"))
    return held.join(small(right), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("wide") == F.col("w")) & (F.col("g") == F.col("h"))).drop("d", "w", "h")


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, contained: float = CONTAINED) -> DataFrame:
    """docs without the rows that hold an item. A row with a null doc_id is judged with all others of its kind. Columns
    stay as they are, whatever their names."""
    bad = contaminated(docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), "text"), items, width, contained)
    bad = saved(bad.select(F.col("doc_id").alias("bad_doc")).distinct(), "bad")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("bad_doc"))
    return whole.join(bad, "bad_doc", "left_anti").select("row.*")


SQL = rf"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS row, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
ii AS (SELECT item_id, least(len(w), {WIDTH}) AS wide, w FROM iw WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, wide, array_to_string(w[i:i + wide - 1], ' ') AS g FROM (SELECT item_id, wide, w, unnest(range(1, len(w) - wide + 2)) AS i FROM ii)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
k AS (SELECT DISTINCT wide FROM ii),
dg AS (SELECT DISTINCT doc_id, row, wide, array_to_string(w[i:i + wide - 1], ' ') AS g FROM (SELECT doc_id, row, w, wide, unnest(range(1, len(w) - wide + 2)) AS i FROM dw, k WHERE len(w) >= wide)),
c AS (SELECT doc_id, row, item_id, count(*) AS shared FROM dg JOIN s USING (wide, g) GROUP BY ALL)
SELECT doc_id, item_id, max(shared)::INT AS n_shared, max(n)::INT AS n_shingles, max(shared) / max(n) AS containment
FROM c JOIN n USING (item_id) WHERE shared >= n * {CONTAINED} - 1e-9 GROUP BY doc_id, item_id
"""
