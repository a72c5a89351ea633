import itertools
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyglass.llm import simhash, store
from tallyglass.llm.components import components


def brute_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def unsigned(x):
    return x % (1 << 64)


def test_fingerprints_match_brute_force(edge_docs):
    rows = simhash.fingerprints(edge_docs).collect()
    want = sorted((r["doc_id"] or -1, brute_fingerprint(r["text"])) for r in edge_docs.collect())
    assert sorted((r["doc_id"] or -1, unsigned(r["fp"])) for r in rows) == want


def test_chunks_do_not_change_fingerprints(monkeypatch):
    text = " ".join(f"w{i * i % 101}" for i in range(500)).encode()
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == want


def linked_by_brute_force(fps, distance):
    return [(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (unsigned(a) ^ unsigned(b)).bit_count() <= distance]


def test_links_connect_like_brute_force(spark):
    random.seed(5)
    values = set()
    for _ in range(40):
        x = random.getrandbits(64)
        for _ in range(random.choice([1, 2, 30])):
            values.add(x)
            for _ in range(random.choice([1, 2, 3])):
                x ^= 1 << random.randrange(64)
    values |= {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for distance, crowd in ((2, 16), (2, 2), (1, 2)):
        found = [(r["a"], r["b"]) for r in simhash.linked_fingerprints(df, distance, crowd).collect()]
        assert all(a < b for a, b in found)
        assert roots(signed, found) == roots(signed, linked_by_brute_force(signed, distance))


def test_components_are_smallest_reachable_ids(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(300)]
    edges = [*chain, *star, (5000, 5000), (7001, 7000), (7000, 7001), (1299, 1000)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert found == {n: r for n, r in roots(nodes, [e for e in edges if e[0] != e[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_edge_cases(clash):
    rows = simhash.near_duplicates(clash).collect()
    assert len(rows) == clash.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by_id[1] == by_id[2] == by_id[3] == {1}
    assert by_id[4] == by_id[8] == {4}
    assert by_id[6] == by_id[7] == {6}
    assert by_id[None] == {None}


def test_near_duplicates_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.deduplicated(no_docs).count() == 0


def jaccard(a, b, width=5):
    def runs(t):
        w = t.lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    a, b = runs(a), runs(b)
    return len(a & b) / len(a | b)


def test_deduplicated_matches_brute_force(make_docs):
    random.seed(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(40):
        base = [random.choice(vocabulary) for _ in range(random.choice([30, 120, 400]))]
        for _ in range(random.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(random.choice([0, 0, 1, 2])):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            rows.append((i, " ".join(copy), "en", "s", 0))
            i += 1
    random.shuffle(rows)
    texts = {r[0]: r[1] for r in rows}
    linked = [(a, b) for a, b in itertools.combinations(texts, 2) if abs(len(texts[a]) - len(texts[b])) < 400 and jaccard(texts[a], texts[b]) >= 0.8]
    want = set(roots(texts, linked).values())
    kept = [r["doc_id"] for r in simhash.deduplicated(make_docs(rows)).collect()]
    assert len(kept) == len(set(kept))
    missed = set(kept) - want
    assert not want - set(kept)
    assert len(missed) <= 0.02 * len(texts)


def test_deduplicated_edge_cases_keep_columns(clash):
    out = simhash.deduplicated(clash)
    assert out.columns == clash.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in out.select("doc_id").collect())
    assert ids == [(False, 1), (False, 4), (False, 5), (False, 6), (False, 9), (False, 10), (True, None)]


def test_crowded_keys_keep_their_links(make_docs):
    random.seed(2)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(150):
        copy = list(base)
        if i:
            copy[random.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(copy), "en", "s", 0))
    assert [r["doc_id"] for r in simhash.deduplicated(make_docs(rows)).collect()] == [0]


def kept_by_brute_force(texts):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.lower().split()) for i, t in texts.items())}
    alike = lambda a, b: min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)
    linked = [(a, b) for a, b in itertools.combinations(texts, 2) if alike(sets[a], sets[b])]
    return sorted(set(roots(texts, linked).values()))


def kept(make_docs, texts):
    return sorted(r["doc_id"] for r in simhash.deduplicated(make_docs([(i, t, "en", "s", 0) for i, t in texts.items()])).collect())


def test_appended_cut_and_replaced_copies_from_the_least_similarity_up(make_docs):
    random.seed(21)
    new = lambda n: [f"u{random.getrandbits(40)}" for _ in range(n)]
    texts = {}
    for size in (24, 104, 404, 1004):
        for share in (0.10, 0.15, 0.2, 0.24, 0.25, 0.26):
            for _ in range(4):
                base, block = new(size), int(share * (size - 4))
                at = random.randrange(size - block)
                changed = base[:at] + new(block // 2) + base[at + block // 2 :]
                for t in (base, base + new(block), changed):
                    texts[len(texts)] = " ".join(t)
                other = new(size)
                texts[len(texts)] = " ".join(other)
                texts[len(texts)] = " ".join(other[: len(other) - int(share * 0.8 * size)])
    least = {i: jaccard(texts[i], texts[i + 1]) for i in range(0, len(texts), 5)}
    assert sum(0.8 <= j < 0.82 for j in least.values()) >= 8
    assert kept(make_docs, texts) == kept_by_brute_force(texts)


def test_copies_of_one_original_that_only_it_connects(make_docs):
    random.seed(22)
    base = [f"o{i}" for i in range(200)]
    texts = {}
    for i in range(101):
        copy = list(base)
        for at in random.sample(range(10, 190), 3) if i != 57 else []:
            copy[at] = f"n{i}x{at}"
        texts[i] = " ".join(copy)
    assert kept_by_brute_force(texts) == [0]
    assert kept(make_docs, texts) == [0]


def test_long_appended_copies(make_docs):
    random.seed(23)
    texts = {}
    while len(texts) < 16:
        base = [f"w{random.getrandbits(40)}" for _ in range(404)]
        pair = " ".join(base), " ".join(base + [f"a{random.getrandbits(40)}" for _ in range(99)])
        if jaccard(*pair) >= 0.8:
            texts |= {len(texts): pair[0], len(texts) + 1: pair[1]}
    assert kept(make_docs, texts) == list(range(0, 16, 2))


def test_copies_with_repeated_lines(make_docs):
    random.seed(24)
    texts = {}
    for again in (2, 5, 10):
        for _ in range(5):
            base, line = ([f"r{random.getrandbits(40)}" for _ in range(n)] for n in (200, 10))
            texts[len(texts)] = " ".join(base + line)
            texts[len(texts)] = " ".join(base + line * again)
    assert all(jaccard(texts[i], texts[i + 1]) > 0.9 for i in range(0, len(texts), 2))
    assert kept(make_docs, texts) == list(range(0, len(texts), 2))


def test_fifteen_hundred_copies_edited_apart(make_docs):
    """Copies of one text with 2 to 4 words changed each: links run through many of them, and all are found."""
    random.seed(31)
    base = [f"c{i}" for i in range(200)]
    texts = {}
    for i in range(1500):
        copy = list(base)
        for at in random.sample(range(200), random.choice([2, 3, 4])):
            copy[at] = f"x{random.getrandbits(40)}"
        texts[i] = " ".join(copy)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts.values())]
    column = {g: k for k, g in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(column)), np.float32)
    for i, x in enumerate(sets):
        held[i, [column[g] for g in x]] = 1
    both, sizes = held @ held.T, held.sum(axis=1)
    a, b = np.nonzero(np.triu(both >= 0.8 * (sizes[:, None] + sizes[None] - both) - 1e-6, 1))
    want = sorted(set(roots(texts, zip(a.tolist(), b.tolist(), strict=True)).values()))
    assert 1 < len(want) < 700
    assert kept(make_docs, texts) == want


@pytest.fixture
def narrow(monkeypatch):
    """Few rows make a key hot, a value full and a block."""
    monkeypatch.setattr(store, "HOT_ROWS", 3)
    monkeypatch.setattr(store, "HOT_SHARE", 20)
    monkeypatch.setattr(store, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(simhash, "BLOCK", 5)


def test_hot_keys_and_many_blocks(make_docs, spark, narrow):
    random.seed(32)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for i in range(60):
        # A passage that all share, in texts that are otherwise different, alike in part, or nothing but the passage.
        texts[i] = " ".join(passage[: 55 + i % 5] + [f"q{i // (1 + i % 3)}x{k}" for k in range((0, 4, 12, 60)[i % 4])])
    texts |= {100 + i: "the same text for many rows here" for i in range(30)}
    assert kept(make_docs, texts) == kept_by_brute_force(texts)


def test_hot_fingerprints_and_hubs(make_docs, spark, narrow):
    rows = [(i, "one text of many rows", "en", "a", 0) for i in range(40)] + [(50 + i, None, "en", "a", 0) for i in range(20)] + [(100 + i, f"text {i} of its own {i * i}", "en", "a", 0) for i in range(20)]
    found = simhash.near_duplicates(make_docs(rows)).collect()
    assert len(found) == len(rows)
    fps = {r["doc_id"]: r["fp"] for r in found}
    firsts = {}
    for d in sorted(fps):
        firsts.setdefault(fps[d], d)
    of = roots(list(firsts), linked_by_brute_force(list(firsts), 2))
    least = {}
    for fp, first in firsts.items():
        least[of[fp]] = min(least.get(of[fp], first), first)
    assert {r["doc_id"]: r["component_id"] for r in found} == {d: least[of[fp]] for d, fp in fps.items()}
    edges = [(0, k) for k in range(1, 60)] + [(100 + k, 100 + (k * 7) % 30) for k in range(1, 30)] + [(200, 201)]
    edges = [e for e in edges if e[0] != e[1]]
    nodes = {x for e in edges for x in e}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots(nodes, edges)


def test_values_that_many_rows_share_are_counted_exactly(spark, monkeypatch):
    """Usual and rare values alike, with the hot ones broadcast or shuffled; no window holds more than HOT_ROWS rows of one."""
    monkeypatch.setattr(store, "HOT_ROWS", 6)
    prefixes = [(i, 9, [7] + [100 + i // 3] * (i < 30) + [1000 + i]) for i in range(60)]
    texts = spark.createDataFrame(prefixes, "key long, size int, prefix array<long>")
    held = {}
    for key, size, values in prefixes:
        for at, v in enumerate(values):
            held.setdefault(v, []).append((key, size, at))
    want = sorted((v, *row, len(rows)) for v, rows in held.items() if len(rows) > 1 for row in rows)
    assert max(map(len, held.values())) == 60
    for most in (store.BROADCAST_BYTES, -1):
        monkeypatch.setattr(store, "BROADCAST_BYTES", most)
        assert sorted(map(tuple, simhash.met_values(texts).select("k", "key", "size", "at", "met").collect())) == want
    assert simhash.met_values(texts.limit(0)).count() == 0


def shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in local for f in Path(d).rglob("shuffle_*.data")}


def test_a_tables_shuffle_files_go_with_its_write(spark):
    before, settings = shuffle_files(spark), {k: spark.conf.get(k) for k in (store.CLEANUP, store.BATCH)}
    grouped = spark.range(10_000).groupBy("id").count().repartition(3)
    table = store.saved(grouped, "grouped", 1 << 20)
    for _ in range(50):
        left = {f for f in shuffle_files(spark) - before if f.exists()}
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 10_000
    assert {k: spark.conf.get(k) for k in settings} == settings


def test_workers_get_batches_of_the_bytes_asked_for(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    texts = spark.range(2_000, numPartitions=1).select(F.repeat(F.lit("x"), 1_000).alias("t"))
    whole = [r["n"] for r in store.saved(texts.mapInArrow(rows, "n long"), "whole").collect()]
    cut = [r["n"] for r in store.saved(texts.mapInArrow(rows, "n long"), "cut", 100_000).collect()]
    assert whole == [2_000] and sum(cut) == 2_000 and max(cut) < 300


def test_blocks_are_looked_at_in_strips(monkeypatch):
    rng = np.random.default_rng(5)
    n = 400
    bits = np.full((n, 16), 7, np.uint64) ^ (rng.integers(0, 64, (n, 16)) * (rng.random((n, 16)) < 0.2)).astype(np.uint64)
    block = np.where(np.arange(n) < 150, 1, rng.integers(-1, 1, n)), rng.permutation(n), rng.integers(0, 50, n), rng.integers(90, 110, n), rng.integers(0, 12, n), bits
    found = []
    for strip in (1 << 30, 1 << 10, 1):
        monkeypatch.setattr(simhash, "STRIP", strip)
        found.append(sorted(zip(*map(np.ndarray.tolist, simhash._block_pairs(*block, 0.8)), strict=True)))
    assert 100 < len(found[0]) < 150 * 250
    assert found[0] == found[1] == found[2]


def test_copies_are_found_by_their_fingerprints(make_docs, spark, monkeypatch):
    """Near copies within 2 bits are linked by the fingerprints' index, with no search of the sets."""
    random.seed(41)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words) if i == 0 else " ".join(words + [f"tail{i}"]) for i in range(12)} | {100 + i: f"other text {i} of its own" for i in range(5)}
    fps = {i: simhash.fingerprint(t.encode(), 5) for i, t in texts.items()}
    near = roots(list(fps.values()), linked_by_brute_force(sorted(set(fps.values())), 2))
    want = sorted({min(j for j in texts if near[fps[j]] == near[fps[i]]) for i in texts})
    assert len(want) < len(texts) and want == kept_by_brute_force({i: texts[i] for i in texts if i in want or i < 100 and near[fps[i]] == near[fps[0]]})
    none = spark.createDataFrame([], "k long, key long, size int, at int, met long")
    monkeypatch.setattr(simhash, "met_values", lambda texts: none)
    assert kept(make_docs, texts) == want
