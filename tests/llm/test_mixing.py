import random
import re

import pytest
from pyspark.sql import functions as F

from tallyglass.llm import mixing


def size_of(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(sizes):
    """Filling by weight; what is above twice a source's size is shared again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
    while open_:
        w = sum(weight[n] for n in open_)
        full = {n for n in open_ if left * weight[n] / w >= 2 * sizes[n] - 1e-9}
        if not full:
            return out | {n: left * weight[n] / w for n in open_}
        for n in full:
            out[n] = 2.0 * sizes[n]
        left -= sum(out[n] for n in full)
        open_ -= full
    return out


def made(make_docs, seed, n=400):
    random.seed(seed)
    rows = []
    for i in range(n):
        s = random.choice(["hot"] * 10 + ["b", "c", "Zed", "é", "\U0001f600", None, "tiny"])
        rows.append((i, " ".join("w" for _ in range(random.choice([0, 1, 5, 80, 900]) if s != "tiny" else 1)), "en", s, 0))
    return make_docs(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_words_taken(make_docs, seed):
    docs = made(make_docs, seed)
    rows = mixing.mixed(docs).collect()
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == len(texts)
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = texts[r["doc_id"]]["source"]
        assert r["size"] == size_of(texts[r["doc_id"]]["text"]) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
    assert all(r["source_size"] == sizes[texts[r["doc_id"]]["source"]] for r in rows)
    want = targets(sizes)
    assert target == pytest.approx(want)
    block = max(1, min(mixing.BLOCK, int(min(t for t in want.values() if t > 0) / mixing.BLOCKS)))
    assert all(abs(taken[s] - want[s]) <= 2 * block + 1 for s in want)


def test_reruns_and_partitions_agree(make_docs):
    docs = made(make_docs, 9)
    rows = [sorted(map(tuple, mixing.mixed(d).collect()), key=str) for d in (docs, docs.repartition(7), docs.orderBy(F.desc("doc_id")))]
    assert rows[0] == rows[1] == rows[2]


def test_many_shards(make_docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1_500)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 20)
    docs = made(make_docs, 4)
    rows = mixing.mixed(docs).collect()
    by = {}
    for r in rows:
        t = by.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
    assert all(abs(a - b) <= 0.03 * b + 60 for a, b in by.values())
    assert all(r["taken"] <= 2 * r["size"] for r in rows)


def quotients(votes, seats):
    won = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = min(votes, key=lambda k: (-votes[k] / (2 * won[k] + 1), k))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(5))
def test_apportionment_is_by_highest_quotients(spark, seed):
    random.seed(seed)
    rows, want = [], {}
    for g in range(6):
        votes = {i: float(random.choice([0, 1, 7, 50, 1000, random.random() * 300])) for i in range(random.choice([1, 2, 9, 30]))}
        votes[0] = votes[0] or 1.0
        seats = random.choice([0, 1, 5, 33, 400])
        rows += [(g, i, v, seats) for i, v in votes.items()]
        for i, k in quotients(votes, seats).items():
            want[g, i] = k
    df = spark.createDataFrame(rows, "g int, i int, votes double, seats long")
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportioned(df, "g", "i").collect()}
    assert {g: sum(v for (h, _), v in got.items() if h == g) for g in range(6)} == {g: sum(v for (h, _), v in want.items() if h == g) for g in range(6)}
    assert got == want


def test_documents_of_the_mix(make_docs):
    docs = made(make_docs, 6).withColumn("row", F.lit(1)).withColumn("mix_id", F.lit("x")).withColumn("text", F.regexp_replace("text", "w w w", "w\n w\tw"))
    plan = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    took, texts = {}, {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        took[r["doc_id"]] = took.get(r["doc_id"], 0) + size_of(r["text"])
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert took == {k: v for k, v in plan.items() if v}


def test_edge_cases(clash, no_docs):
    rows = mixing.mixed(clash).collect()
    assert len(rows) == clash.count()
    total = sum(r["taken"] for r in rows)
    out = mixing.mixed_documents(clash)
    assert out.columns == clash.columns
    assert sum(size_of(r["text"]) for r in out.collect()) == total
    assert mixing.mixed(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0
    empty = clash.where("doc_id IN (1, 2)")
    assert [r["taken"] for r in mixing.mixed(empty).collect()] == [0, 0]
