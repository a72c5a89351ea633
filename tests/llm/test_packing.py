import random

import numpy as np
import pytest

from tallyglass.llm import packing


def brute_best_fit(sizes, length):
    free, bins = [], []
    for i in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        fits = [f for f in free if f >= sizes[i]]
        if fits:
            want = min(fits)
            k = max(j for j in range(len(free)) if free[j] == want)
        else:
            free.append(length)
            bins.append([])
            k = len(free) - 1
        bins[k].append(i)
        free[k] -= sizes[i]
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_decreasing_leaves_as_much_room_as_brute_force(seed):
    random.seed(seed)
    length = random.choice([8, 64, 100])
    sizes = [random.randint(1, length) for _ in range(200)]
    got, want = packing.best_fit_decreasing(sizes, length), brute_best_fit(sizes, length)
    assert sorted(i for b in got for i in b) == list(range(200))
    assert all(sum(sizes[i] for i in b) <= length for b in got)
    assert sorted(sum(sizes[i] for i in b) for b in got) == sorted(sum(sizes[i] for i in b) for b in want)


def test_capacities_search():
    c = packing.Capacities(100)
    for i, n in enumerate((7, 30, 30, 99)):
        c.add(n, i)
    assert [c.at_least(n) for n in (1, 7, 8, 31, 99, 100)] == [7, 7, 30, 99, 99, None]
    assert c.take(30) == 2 and c.take(30) == 1
    assert c.at_least(8) == 99


def unpacked(rows):
    parts = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        for k, (d, p) in enumerate(zip(r["doc_ids"], r["pieces"], strict=True)):
            parts.setdefault(d, []).append((p, ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]]))
    return parts


def test_exact_round_trip(clash):
    length = 256
    rows = packing.packed(clash, length=length, window=3_000).collect()
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(packing.VOCABULARY, "rb"))}
    names = tiktoken.Encoding("test", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(len(r["ids"]) == 2 * length for r in rows)
    assert len({r["pack_id"] for r in rows}) == len(rows)
    parts = unpacked(rows)
    texts = {}
    for r in clash.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert set(parts) == set(texts)
    for d, pieces in parts.items():
        stream = np.concatenate([x for _, x in sorted(pieces, key=lambda p: p[0])]) if len(texts[d]) == 1 else np.concatenate([x for _, x in pieces])
        docs = [list(x) for x in np.split(stream, np.flatnonzero(stream == packing.END) + 1) if len(x)]
        assert sorted(names.decode_bytes([int(i) for i in x[:-1]]).decode() for x in docs) == sorted(texts[d])
    for r in rows:
        assert r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= length
        p = packing.positions(r["resets"], length)
        assert all(p[s] == 0 for s in r["resets"]) and p.max() < length
        assert np.array_equal(p[: r["n_tokens"]], np.concatenate([np.arange(b - a) for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:])]))


def test_matrices(spark, edge_docs, tmp_path):
    rows = packing.packed(edge_docs, length=128)
    packing.write_matrices(rows, str(tmp_path / "m"))
    ids = [r["pack_id"] for r in rows.collect()][:3]
    m = packing.read_matrix(spark, str(tmp_path / "m"), ids)
    assert m.shape == (len(ids), 128)


def test_nothing(no_docs):
    assert packing.packed(no_docs).count() == 0


LONG = ["ab" * 60_000, "".join(random.Random(5).choices("abcdefgh", k=120_000)), "\u65e5\u672c" * 70_000, "!" * 150_000, "7" * 110_000, " " * 130_000 + "x"]


def merged(piece, ranks):
    """The ids of one piece by the rule alone: the adjacent pair of the least rank merges, the first among equals."""
    import heapq

    parts, after, before = [piece[i : i + 1] for i in range(len(piece))], list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
    heap = [(ranks[parts[i] + parts[i + 1]], i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] is not None else None
        if j is None or j >= len(parts) or parts[i] != a or parts[j] != b:
            continue
        parts[i], parts[j], after[i] = a + b, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < len(parts) and parts[x] + parts[y] in ranks:
                heapq.heappush(heap, (ranks[parts[x] + parts[y]], x, parts[x], parts[y]))
    return [ranks[p] for p in parts if p is not None]


def test_long_runs_get_the_ids_of_the_rule():
    import base64

    import regex

    vocabulary = open(packing.VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines())}
    for text in LONG:
        assert packing.encoder(vocabulary)(text) == [i for piece in regex.findall(packing.PATTERN, text) for i in merged(piece.encode(), ranks)]


def test_segments_do_not_depend_on_partitions(spark, make_docs):
    docs = make_docs([(i, f"text {i} " * (i % 40 + 1)) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(LONG)])
    cut = lambda df: sorted((d, p, x.tobytes()) for d, v in unpacked(packing.packed(df, length=64).collect()).items() for p, x in v)
    assert cut(docs.coalesce(1)) == cut(docs.repartition(7))
