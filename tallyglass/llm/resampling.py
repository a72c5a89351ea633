"""Target-distribution importance resampling: hashed word runs, log ratios of target to corpus, Gumbel draws without replacement.

Long texts are cut into chunks first. A chunk owns the runs that start in it and carries the n-1 words that follow, so no run is lost or counted twice; chunks are
dealt anew, and their counts and sums are added up by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.store import dropped, pieces, saved

#: Longest runs of words that count, buckets that they are hashed to, bytes of text that a chunk owns.
N, BUCKETS, CHUNK = 2, 10_000, 1 << 16
#: Percent of the documents of so many words that are drawn, and the seed of the draw.
SHARE, LEAST_WORDS, SEED = 25, 20, 7
#: Bytes of words: digits, letters as lower case and all that isn't ASCII; others part words.
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
PARTS = "doc_id {kind}, sha string, part int, owned int, text string"


def chunks(text: bytes, n: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(words owned, words): a text's words in order, cut behind the word that passes `size` bytes, each chunk with the n-1 words that follow it."""
    words, at = b" ".join(text.translate(FOLD).split()), 0
    while at < len(words):
        end = words.find(b" ", at + size)
        end = to = len(words) if end < 0 else end
        for _ in range(n - 1):
            after = words.find(b" ", to + 1)
            to = len(words) if after < 0 else after
        yield words.count(b" ", at, end) + 1, words[at:to]
        at = end + 1


def buckets_of(text: bytes, owned: int | None, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words a text or a chunk owns, and the bucket of each run of 1 to n words that starts at one of them."""
    words = text.translate(FOLD).split()
    owned = len(words) if owned is None else owned
    found = [np.fromiter(map(crc32, words[:owned]), np.int64, owned)]
    for k in range(2, n + 1):
        part = words[: owned + k - 1]
        found.append(np.fromiter(map(crc32, map(b" ".join, zip(*(part[j:] for j in range(k))))), np.int64))
    return owned, np.concatenate(found) % buckets


def parts(docs: DataFrame, n: int = N, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) as (short, long): the rows of up to `size` bytes as they are, and a saved table of the others' chunks, dealt evenly."""
    docs = docs.select("doc_id", "text")
    long = F.octet_length("text") > size
    kind = PARTS.format(kind=docs.schema["doc_id"].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            for i, (text, sha) in enumerate(zip(b.column("text"), b.column("sha"))):
                made = list(chunks(text.as_buffer().to_pybytes(), n, size)) or [(0, b"")]
                ids = pa.repeat(b.column("doc_id")[i], len(made))
                yield pa.RecordBatch.from_arrays([ids, pa.repeat(sha, len(made)), pa.array(range(len(made)), pa.int32()), pa.array([o for o, _ in made], pa.int32()), pa.array([w.decode() for _, w in made])], names=["doc_id", "sha", "part", "owned", "text"])

    cut_up = docs.where(long).withColumn("sha", F.sha2("text", 256)).mapInArrow(cut, kind)
    spread = cut_up.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return docs.where(~long | F.col("text").isNull()).withColumn("owned", F.lit(None).cast("int")), saved(spread, "chunks")


def counted(both: tuple[DataFrame, DataFrame], n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many runs fall into each bucket, over all parts: summed within each task, then by bucket, so the driver gets a row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in pieces(batches, "text"):
            rows = zip(b.column("text"), b.column("owned").to_pylist())
            found = [buckets_of(t.as_buffer().to_pybytes(), o, n, buckets)[1] for t, o in rows if t.is_valid]
            if found:
                total += np.bincount(np.concatenate(found), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    every = both[0].select("text", "owned").unionByName(both[1].select("text", "owned"))
    out = np.zeros(buckets, np.int64)
    for r in every.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the corpus, one added to each count."""
    big, small = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * big / ((s + 1.0) * small))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weighed(both: tuple[DataFrame, DataFrame], gains: np.ndarray, n: int = N) -> DataFrame:
    """(doc_id, n_words, n_features, weight) a document; its chunks are summed, repeated rows of a long text stay."""
    kind = both[0].schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            found = [buckets_of(t.as_buffer().to_pybytes() if t.is_valid else b"", o, n, len(gains)) for t, o in zip(b.column("text"), b.column("owned").to_pylist())]
            sums = [[w for w, _ in found], [len(x) for _, x in found], [int(gains[x].sum()) for _, x in found]]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in b.schema.names if c not in ("text", "owned")] + [pa.array(s, pa.int64()) for s in sums], names=[c for c in b.schema.names if c not in ("text", "owned")] + ["n_words", "n_features", "gain"])

    sums = ["n_words", "n_features", "gain"]
    short = both[0].select("doc_id", "owned", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, gain long")
    long = both[1].mapInArrow(weigh, f"doc_id {kind}, sha string, part int, n_words long, n_features long, gain long")
    copies = F.sum((F.col("part") == 0).cast("int")).alias("copies")
    long = long.groupBy("doc_id", "sha").agg(copies, *[F.sum(c).alias(c) for c in sums])
    long = long.select("doc_id", *[F.expr(f"{c} div copies").alias(c) for c in sums], F.explode(F.sequence(F.lit(1), "copies"))).drop("col")
    every = short.unionByName(long)
    return every.select("doc_id", "n_words", "n_features", F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (gain - pmod(gain, n_features)) div n_features END").alias("weight"))


def ranked(rows: DataFrame, least_words: int = LEAST_WORDS, share: int = SHARE) -> DataFrame:
    """rows (doc_id, n_words, score ...) with rank: 1, 2, 3 ... for the `share` percent (rounded down) of the highest scores among those of `least_words` words or more,
    ties to the smaller doc_id, null ids last; null for all others. Rows are cut into ranges by score and id (and their place in the table, so rows
    alike don't share a task); the rows before a range are added to the place in it."""
    may = rows.where(F.col("n_words") >= least_words).withColumn("_tie", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_tie")]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(may.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "places")
    task = F.shiftright("_place", 33)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks_ = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    most = placed.count() * share // 100
    place = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    found = placed.withColumn("_task", task).join(F.broadcast(tasks_), "_task").withColumn("rank", F.when(place <= most, place))
    return found.select(*rows.columns, "rank").unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of docs (doc_id, text): a draw without replacement of `share` percent of the documents of
    `least_words` words or more, with chances as the texts of `target` (text) are likelier than the corpus.

    Null and empty texts have no features and weigh 0; a null doc_id draws as an empty one; rows of one doc_id draw alike and stand one after another. An empty corpus gives no rows; against an empty target every
    bucket's gain is the smoothed one. Extra columns aren't kept. Counts are of the whole corpus; only the gains, one number a bucket, reach the driver and the tasks."""
    both, wanted = parts(docs, n, size), parts(target.select(F.lit(0).alias("doc_id"), "text"), n, size)
    gains = gains_of(counted(both, n, buckets), counted(wanted, n, buckets))
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((drawn + 0.5) / 4294967296.0)))
    rows = saved(weighed(both, gains, n).withColumn("score", F.col("weight") + noise), "weights")
    dropped(both[1], wanted[1])
    return ranked(rows, least_words, share)
