"""Text quality by random Fourier features: ridge regression from partition sums, then isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.store import pieces, saved

#: Labelled rows that a fit uses at most, about; one in CALIBRATION of them calibrates instead of fitting the ridge.
MOST_ROWS, CALIBRATION = 40_000, 4
#: Random features, the kernel's width in standard deviations of a statistic, the ridge, the seed.
FEATURES, KERNEL_WIDTH, RIDGE, SEED = 256, 6.0, 1.0, 42
#: Parts that the training rows are dealt to, each of which yields one sum.
PARTS = 8
#: Rows whose features are made in one step; they take 2 MB.
STRIP = 1 << 10

STATISTICS = (
    "log_words mean_word_length sd_word_length longest_word distinct_share top_word_share repeated_next_share letters upper digits spaces other_ascii "
    "pipes exclamations stops capitalised_words log_lines words_per_line distinct_lines non_ascii symbol_ended"
).split()
_SYMBOLS = frozenset("!#$%&*+/<=>@[]^_`{|}~\\")


def statistics(text: str | None) -> list[float]:
    """One number for each of STATISTICS, over the whole text; all 0 for null and empty ones."""
    raw = (text or "").encode()
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    lower, upper, digits = count[97:123].sum(), count[65:91].sum(), count[48:58].sum()
    spaces = count[9:14].sum() + count[32]
    other = count[33:127].sum() - lower - upper - digits
    lead = count[192:].sum()
    chars = max(count[:128].sum() + lead, 1.0)
    lengths = np.fromiter(map(len, words), np.int64, n)
    kinds = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(n), float(lengths.mean()), float(lengths.std()), math.log(float(lengths.max())), len(kinds) / n ** 0.9, max(kinds.values()) / n, again / n,
        (lower + upper + lead) / chars, upper / max(upper + lower, 1.0), digits / chars, spaces / chars, other / chars,
        count[124] / n, count[33] / n, (count[46] + count[44]) / n, sum(w[0].isupper() for w in words) / n,
        math.log1p(len(lines)), math.log1p(n / len(lines)), len(set(lines)) / len(lines), lead / chars, sum(w[-1] in _SYMBOLS for w in words) / n,
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Rounded, as the last digits of a product depend on where in a batch a row stands."""
        parts = [design(x[at], self.mean, self.scale, self.frequencies, self.phases) @ self.weights for at in strips(len(x))]
        return np.round(np.concatenate([np.zeros(0), *parts]), 10)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.levels)


def strips(n: int) -> list[slice]:
    return [slice(at, at + STRIP) for at in range(0, n, STRIP)]


def design(x, mean, scale, frequencies, phases) -> np.ndarray:
    """A constant and the random Fourier features of the standardised statistics. The statistics themselves are not among them: a score is a
    function of the kernel alone."""
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / len(phases)) * np.cos(z @ frequencies + phases)])


def isotonic(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the non-decreasing curve through pooled adjacent violators, with one row of either label added, so
    that no level is quite 0 or 1. counts: how often each row counts. Rows of one score are one point, so the order of rows decides nothing."""
    counts = np.ones(len(scores)) if counts is None else counts
    scores, at = np.unique(scores, return_inverse=True)
    ones, counts = np.bincount(at, labels * counts, len(scores)), np.bincount(at, counts, len(scores))
    blocks: list[list[float]] = []
    for s, y, k in zip(scores, ones, counts, strict=True):
        blocks.append([y, k, s * k])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            for k in range(3):
                blocks[-1][k] += b[k]
    n = np.array([b[1] for b in blocks])
    centre = np.array([b[2] for b in blocks]) / n
    level = np.array([b[0] for b in blocks]) / n
    prior = (ones.sum() + 1) / (counts.sum() + 2)
    return centre, np.maximum.accumulate((level * n + prior) / (n + 1))


def _statistic_batches(batches, keep):
    for b in pieces(batches, "text"):
        x = [statistics(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])


def _moment_batches(batches):
    total = np.zeros((3, len(STATISTICS)))
    for b in batches:
        x = np.array(b.column("x").to_pylist()).reshape(-1, len(STATISTICS))
        k = b.column("k").to_numpy()[:, None]
        total += [np.full(len(STATISTICS), k.sum()), (k * x).sum(axis=0), (k * x * x).sum(axis=0)]
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()])], ["part", "sums"])


def _normal_batches(batches, mean, scale, frequencies, phases):
    size = 1 + len(phases)
    total = np.zeros((size, size + 1))
    for b in batches:
        x = np.array(b.column("x").to_pylist()).reshape(-1, len(mean))
        k, y = b.column("k").to_numpy()[:, None], b.column("y").to_numpy(zero_copy_only=False)[:, None]
        for at in strips(len(x)):
            z = design(x[at], mean, scale, frequencies, phases)
            total += (z * k[at]).T @ np.hstack([z, y[at]])
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()])], ["part", "sums"])


def _added(batches, shape):
    total, part = np.zeros(shape), -1
    for b in batches:
        for p, x in zip(b.column("part").to_pylist(), b.column("sums").to_pylist(), strict=True):
            total += np.frombuffer(x).reshape(shape)
            part = max(part, p)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])


def _summed(df: DataFrame, shape) -> np.ndarray:
    """The sum of the partitions' sums, in an order that reruns share. They are added on the executors to PARTS matrices at most,
    however many partitions there are, before they come to the driver. A shuffle stands between, so that a task has one Python worker and not two."""
    few = df.repartition(PARTS).sortWithinPartitions("part").mapInArrow(partial(_added, shape=shape), "part long, sums binary")
    rows = sorted(few.collect(), key=lambda r: r["part"])
    return sum((np.frombuffer(r["sums"]).reshape(shape) for r in rows), np.zeros(shape))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row of docs: the statistics of its text."""
    return docs.select("doc_id", "text").mapInArrow(partial(_statistic_batches, keep=["doc_id"]), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def sampled(rows: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows (any columns with doc_id) that a fit may learn from: not held out, and in a seeded sample by doc_id that leaves
    about `most_rows` of the labels. Decided on each row alone."""
    n = _usable(labels).count()
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most_rows / max(n, 1)))
    return rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & chosen)


def _usable(labels: DataFrame) -> DataFrame:
    return labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("double").alias("y"))


def fitted(rows: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model | None:
    """A model of labels (doc_id, quality; 1 is good) learnt from the statistics of rows (doc_id, x), which sampled() has bounded;
    what reaches the driver are sums, and the different calibration rows. Null labels and ids are left out; repeated ones
    count as often, as one row with its count `k`; ids that are repeated with different texts are thinned again to most_rows by digest. None if no row is labelled.
    """
    train = rows.join(_usable(labels), "doc_id").groupBy("doc_id", "x", "y").agg(F.count("*").alias("k"))
    train = saved(train.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(CALIBRATION))), "train")
    n = train.count()
    if not n:
        return None
    if n > 2 * most_rows:
        train = train.where(F.pmod(F.xxhash64("x", "y"), F.lit(1_000_000)) < int(1_000_000 * most_rows / n))
    train = train.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "y")
    sums = _summed(train.select("x", "k").mapInArrow(_moment_batches, "part long, sums binary"), (3, len(STATISTICS)))
    mean = sums[1] / np.maximum(sums[0], 1)
    scale = np.sqrt(np.maximum(sums[2] / np.maximum(sums[0], 1) - mean**2, 0)) + 1e-3
    random = np.random.default_rng(SEED)
    frequencies = random.standard_normal((len(STATISTICS), FEATURES)) / KERNEL_WIDTH
    phases = random.uniform(0, 2 * np.pi, FEATURES)
    size = 1 + FEATURES
    run = partial(_normal_batches, mean=mean, scale=scale, frequencies=frequencies, phases=phases)
    sums = _summed(train.where("h <> 0").select("x", "y", "k").mapInArrow(run, "part long, sums binary"), (size, size + 1))
    weights = np.linalg.solve(sums[:, :-1] + RIDGE * np.eye(size), sums[:, -1])
    model = Model(mean, scale, frequencies, phases, weights, np.zeros(1), np.zeros(1))
    rest = train.where("h = 0").select("doc_id", "x", "y", "k").collect()
    rest.sort(key=lambda r: (r["doc_id"], r["y"], r["x"]))
    y, k = np.array([r["y"] for r in rest]), np.array([r["k"] for r in rest])
    model.knots, model.levels = isotonic(model.raw(np.array([r["x"] for r in rest])), y, k) if len(rest) else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return model


def _score_batches(batches, model, keep):
    for b in batches:
        x = np.array(b.column("x").to_pylist()).reshape(-1, len(STATISTICS))
        score = np.clip(model.score(x), 0, 1) if model else np.ones(len(x))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score, pa.float64())], [*keep, "score"])


def scored(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text): the calibrated chance of label 1, from the whole
    text alone.

    Null and empty texts have statistics 0 and are scored like any other; repeated rows score alike; without any label
    every score is 1. An empty table gives no rows. Other columns are not read.
    """
    rows = saved(measured(docs), "statistics")
    model = fitted(sampled(rows, labels, most_rows), labels, most_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(partial(_score_batches, model=model, keep=["doc_id"]), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """docs without the rows whose text scores below 0.5. Columns stay as they are, whatever their names."""
    model = fitted(measured(sampled(docs, labels, most_rows)), labels, most_rows)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), F.col("text").alias("text"))
    schema = rows.select("row").schema

    def keep(batches):
        for b in pieces(batches, "text"):
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(STATISTICS))
            good = np.clip(model.score(x), 0, 1) >= 0.5 if model else np.ones(len(x), bool)
            yield b.select(["row"]).filter(pa.array(good))

    return rows.mapInArrow(keep, schema).select("row.*")
