"""Token ids packed into rows of fixed length: best-fit-decreasing over a segment tree of free capacities."""

from __future__ import annotations

import base64
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm.store import pieces

#: Vocabulary file (base64 of a token's bytes and its rank, a line each), read by the driver and sent to the workers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's public tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The id that ends a document and fills a row; ids of a row; ids that are packed at a time, which bounds a worker's memory.
END, LENGTH, WINDOW = 50_256, 2_048, 4_000_000

SCHEMA = "pack_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, resets array<int>, ids binary"


class Capacities:
    """How many bins have each free capacity from 0 to `most`, with the smallest capacity of at least n in O(log most)."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, capacity: int, bin_: int) -> None:
        self.bins.setdefault(capacity, []).append(bin_)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, capacity: int) -> int:
        i = capacity + self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return self.bins[capacity].pop()

    def at_least(self, n: int) -> int | None:
        """The smallest capacity >= n that a bin has."""
        i = n + self.size
        if self.count[i]:
            return n
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of at most `length`, as lists of indices into sizes. Larger sizes go first, earlier ones among equals; each goes to the
    bin it leaves the least room in, else to a new one. Every size must be from 1 to length."""
    free, bins = Capacities(length), []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        capacity = free.at_least(sizes[i])
        if capacity is None:
            bins.append([i])
            capacity, at = length, len(bins) - 1
        else:
            at = free.take(capacity)
            bins[at].append(i)
        free.add(capacity - sizes[i], at)
    return bins


_encoders: dict = {}


def encoder(vocabulary: bytes, pattern: str = PATTERN):
    """A function from text to ids, made once in each worker. Its ids' bytes, joined, are the text's UTF-8."""
    key = (hash(vocabulary), pattern)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return _encoders[key]


def _emit(items, length, end, dtype, numbers):
    """A batch of packed rows. items: (doc_id, piece, ids)."""
    rows = best_fit_decreasing([len(x[2]) for x in items], length)
    matrix = np.full((len(rows), length), end, dtype)
    docs, numbers_, ends, resets = [], [], [], []
    for r, row in enumerate(rows):
        cu = np.concatenate([[0], np.cumsum([len(items[i][2]) for i in row])]).astype(np.int32)
        matrix[r, : cu[-1]] = np.concatenate([items[i][2] for i in row])
        docs.append([items[i][0] for i in row])
        numbers_.append([items[i][1] for i in row])
        ends.append(cu)
        resets.append(cu if cu[-1] < length else cu[:-1])
    columns = [
        pa.array([next(numbers) for _ in rows], pa.int64()), pa.array([int(c[-1]) for c in ends], pa.int32()), pa.array(docs, pa.list_(pa.int64())),
        pa.array(numbers_, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array([m.tobytes() for m in matrix], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["pack_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "resets", "ids"])


def _pack_batches(batches, vocabulary, pattern, length, window, end, dtype):
    encode, base = encoder(vocabulary.value, pattern), TaskContext.get().partitionId() << 33
    numbers = iter(range(base, base + (1 << 33)))
    items, held = [], 0
    for b in pieces(batches, "text"):
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            ids = np.array([*encode(text.as_py() or ""), end], dtype)
            for piece, at in enumerate(range(0, len(ids), length)):
                items.append((doc_id, piece, ids[at : at + length]))
            held += len(ids)
            if held >= window:
                yield _emit(items, length, end, dtype, numbers)
                items, held = [], 0
    if items:
        yield _emit(items, length, end, dtype, numbers)


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, window: int = WINDOW, end: int = END, pattern: str = PATTERN) -> DataFrame:
    """Rows of `length` ids that hold each document's ids and an end mark, once.

    A document longer than a row is split into pieces, in order, of which all but the last fill a row's length. Segment k of a row is piece
    pieces[k] of document doc_ids[k], at ids[cu_seqlens[k]:cu_seqlens[k + 1]]; positions start at 0 again at each of
    `resets`, which has the fill's start too. ids: little-endian, 2 bytes an id up to 65,536 ids, else 4. Rows are filled within
    a partition, some millions of ids at a time, so nothing is shuffled, memory is bounded, and a lost task is redone alike. So which
    segments share a row depends on how the input is split into partitions; which segments there are, and their ids, does not: they are those
    of the vocabulary's public tokenizer for the whole text, however long.
    Null and empty texts are an end mark; repeated rows are packed as often; null doc_ids stay null; empty tables give no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    dtype = "<u2" if end < 1 << 16 else "<u4"
    run = partial(_pack_batches, vocabulary=sent, pattern=pattern, length=length, window=window, end=end, dtype=dtype)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def positions(resets: list[int], length: int) -> np.ndarray:
    """Each id's position in its segment."""
    starts = np.zeros(length, np.int64)
    starts[list(resets)] = list(resets)
    return np.arange(length) - np.maximum.accumulate(starts)


def write_matrices(rows: DataFrame, path: str) -> None:
    """Rows of `packed` as Parquet under path, in any store that Spark writes to."""
    rows.write.mode("overwrite").parquet(path)


def read_matrix(spark: SparkSession, path: str, pack_ids: list[int], dtype: str = "<u2") -> np.ndarray:
    """The rows with these ids as one matrix, in this order."""
    found = {r["pack_id"]: r["ids"] for r in spark.read.parquet(path).where(F.col("pack_id").isin(pack_ids)).select("pack_id", "ids").collect()}
    return np.stack([np.frombuffer(found[i], dtype) for i in pack_ids])
