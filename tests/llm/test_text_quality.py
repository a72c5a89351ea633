import zlib

import numpy as np

from tallyglass.llm import quality
from tallyglass.llm.store import table


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.scored(table(spark, d, "documents"), table(spark, d, "labels")).join(table(spark, d, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 80 and np.mean([r["predicted"] == r["quality"] for r in out]) >= 0.97


def test_held_out_labels_are_not_learnt(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.001"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.scored(docs, x).collect())) for x in (labels, turned))
    assert a == b


def test_isotonic_is_least_squares_monotone():
    random = np.random.default_rng(3)
    s = random.normal(size=300)
    y = (random.random(300) < 1 / (1 + np.exp(-3 * s))).astype(float)
    knots, levels = quality.isotonic(s, y)
    assert np.all(np.diff(knots) > 0) and np.all(np.diff(levels) >= -1e-9) and levels.min() > 0 and levels.max() < 1


def test_random_features_approximate_the_kernel():
    random = np.random.default_rng(0)
    n, width = 4000, quality.KERNEL_WIDTH
    frequencies = random.standard_normal((5, n)) / width
    phases = random.uniform(0, 2 * np.pi, n)
    x = random.normal(size=(2, 5)) * 3
    z = quality.design(x, 0.0, 1.0, frequencies, phases)[:, 1:]
    assert abs(z[0] @ z[1] - np.exp(-np.sum((x[0] - x[1]) ** 2) / (2 * width**2))) < 0.06


def test_partition_sums_are_the_whole_sum(spark):
    d = "/root/testdata/sf0.001"
    rows = quality.measured(table(spark, d, "documents"))
    a = quality.fitted(rows, table(spark, d, "labels"))
    b = quality.fitted(rows.repartition(9), table(spark, d, "labels"))
    assert np.allclose(a.weights, b.weights) and np.array_equal(a.levels, b.levels)


def test_scores_match_brute_force(spark):
    """All scores again without Spark: one matrix of all training rows, one solve, one calibration."""
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents").toPandas(), table(spark, d, "labels").toPandas()
    spot = {r["doc_id"]: r["h"] for r in table(spark, d, "documents").selectExpr("doc_id", f"pmod(xxhash64(doc_id, {quality.SEED}), {quality.CALIBRATION}) AS h").collect()}
    x = {i: np.array(quality.statistics(t)) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    known = [(i, y) for i, y in zip(labels.doc_id, labels.quality, strict=True) if zlib.crc32(str(i).encode()) % 3 != 1 and i in x and y == y]
    every = np.array([x[i] for i, _ in known])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    random = np.random.default_rng(quality.SEED)
    w = random.standard_normal((every.shape[1], quality.FEATURES)) / quality.KERNEL_WIDTH
    b = random.uniform(0, 2 * np.pi, quality.FEATURES)

    def features(rows):
        z = np.clip((rows - mean) / scale, -8, 8)
        return np.column_stack([np.ones(len(z)), np.sqrt(2 / quality.FEATURES) * np.cos(z @ w + b)])

    fit = [(x[i], y) for i, y in known if spot[i] != 0]
    z, y = features(np.array([r[0] for r in fit])), np.array([r[1] for r in fit])
    weights = np.linalg.lstsq(np.vstack([z, np.eye(z.shape[1]) * np.sqrt(quality.RIDGE)]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    rest = sorted((float((features(x[i][None]) @ weights)[0]), y) for i, y in known if spot[i] == 0)
    raw, y = np.array([r[0] for r in rest]), np.array([float(r[1]) for r in rest])
    # The isotonic curve as the greatest of least means.
    n = len(y)
    sums = np.concatenate([[0], np.cumsum(y)])
    means = np.array([[(sums[j + 1] - sums[i]) / (j + 1 - i) if j >= i else np.inf for j in range(n)] for i in range(n)])
    curve = np.array([max(means[i, k:].min() for i in range(k + 1)) for k in range(n)])
    prior, knots, levels = (y.sum() + 1) / (n + 2), [], []
    for value in sorted(set(np.round(curve, 12))):
        at = np.flatnonzero(np.round(curve, 12) == value)
        knots.append(raw[at].mean())
        levels.append((y[at].sum() + prior) / (len(at) + 1))
    levels = np.maximum.accumulate(levels)
    got = {r["doc_id"]: r["score"] for r in quality.scored(table(spark, d, "documents"), table(spark, d, "labels")).collect()}
    want = {i: float(np.interp((features(v[None]) @ weights)[0], knots, levels)) for i, v in x.items()}
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_the_random_features_decide(spark, monkeypatch):
    """Without the kernel's features nothing is left to tell texts apart."""
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    error = lambda: np.mean([(r["score"] - r["quality"]) ** 2 for r in quality.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()])
    whole = error()
    monkeypatch.setattr(quality, "design", lambda x, mean, scale, frequencies, phases: np.ones((len(x), 1 + len(phases))))
    model = quality.fitted(quality.measured(docs), labels)
    assert len(set(model.score(np.random.default_rng(1).normal(size=(50, len(quality.STATISTICS)))))) == 1
    monkeypatch.undo()
    assert whole < 0.02


def test_repeated_ids_and_labels_count_but_do_not_multiply(spark):
    docs = spark.createDataFrame([(i % 5, f"word {i % 10} " * 20) for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 5, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality.fitted(quality.measured(docs), labels, most_rows=3)
    assert model is not None and np.all(np.isfinite(model.weights))
    s, y, k = np.array([1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0]), np.array([3, 1, 2])
    a, b = quality.isotonic(s, y, k), quality.isotonic(np.repeat(s, k), np.repeat(y, k))
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])


def test_edge_cases(spark, clash, no_docs):
    labels = spark.createDataFrame([(1, 0), (2, 0), (6, 1), (9, None), (None, 1), (6, 1), (99, 1)], "doc_id long, quality int")
    rows = quality.scored(clash, labels).collect()
    assert len(rows) == clash.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.scored(clash, labels.limit(0)).collect()} == {1.0}
    assert quality.scored(no_docs, labels).count() == 0
    kept = quality.accepted(clash, labels.limit(0))
    assert kept.columns == clash.columns and kept.count() == clash.count()
    assert quality.accepted(no_docs, labels).count() == 0


def test_statistics_are_finite():
    for t in (None, "", " \n", "a", "!!!", "é" * 10, "a\n" * 5, "\x00", "x " * 50_000):
        x = quality.statistics(t)
        assert len(x) == len(quality.STATISTICS) and np.all(np.isfinite(x))


def test_order_of_rows_decides_nothing():
    import itertools

    import numpy as np

    scores, labels = np.array([0.5, 0.5, 0.9, 0.2, 0.5]), np.array([0, 1, 1, 1, 0])
    want = quality.isotonic(scores, labels)
    assert len(set(want[0])) == len(want[0])
    for p in map(list, itertools.permutations(range(5))):
        got = quality.isotonic(scores[p], labels[p])
        assert all((a == b).all() for a, b in zip(got, want))
    twice = quality.isotonic(np.array([0.2, 0.5, 0.5, 0.9]), np.array([1, 0, 1, 1]), np.array([1, 2, 1, 1]))
    assert all((a == b).all() for a, b in zip(twice, want))
