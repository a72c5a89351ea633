"""SimHash near-duplicate search over deletion-variant signatures.

A fingerprint of d segments is indexed under each segment with one bit left out. Fingerprints that differ in at most
2 * segments - 1 bits agree on some segment but for one bit, so they meet under that segment's key. Equal keys make
candidates, which are then verified. A key under which many fingerprints meet is never expanded into pairs:
`linked_fingerprints` resolves such fingerprints exactly through shared centres. `deduplicated` finds copies by the same index and
verifies them on their shingle sets; an exact search of the sets follows, for similar texts whose fingerprints differ in more bits.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm import store
from tallyglass.llm.components import components
from tallyglass.llm.store import dropped, looked_up, pieces, saved, small, split_join

SEED = 42
#: Words of a shingle and shingles hashed at a time; the latter bounds a worker's memory for any text length.
WIDTH, CHUNK = 3, 1 << 15
#: A key shared by more fingerprints than this is not expanded into pairs.
CROWD = 16
#: The same for values of shingle sets' prefixes, of which two rows share many; rows of fuller ones are compared in blocks.
FULL = 4


def shingle_hashes(text: bytes | None, width: int):
    """Chunks of the XXH64 values of a text's word shingles, repeats included. Lower-cases A-Z only; words are runs
    without ASCII white space; a text of fewer words is one shingle; a text without words has none; null is empty."""
    words = (text or b"").lower().split()
    if not words:
        return
    if len(words) <= width:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        return
    for at in range(0, len(words) - width + 1, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        runs = map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))
        yield np.array([xxhash.xxh64_intdigest(x, SEED) for x in runs], np.uint64)


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 without words. Signed, as a Spark long."""
    return majority(shingle_hashes(text, width))


def majority(chunks) -> int:
    """The fingerprint of chunks of hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in chunks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _fingerprint_batches(batches, width):
    for b in pieces(batches, "text"):
        fps = pa.array([fingerprint(t, width) for t in _texts(b)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), fps], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) for each row of docs (doc_id, text; other columns are not read). Repeated rows stay; null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_fingerprint_batches, width=width), "doc_id long, fp long")


def deletion_keys(fp: Column, segments: int = 2) -> Column:
    """For each segment of a 64-bit fingerprint and each bit of it: the place of the bit left out, which names the segment too, times 2^32, plus the
    rest of the segment."""
    size = 64 // segments
    keys = []
    for s in range(segments):
        part = F.shiftrightunsigned(fp, s * size).bitwiseAND(F.lit((1 << size) - 1))
        keys += [part.bitwiseAND(F.lit(((1 << size) - 1) & ~(1 << i))) + F.lit((s * size + i) << 32) for i in range(size)]
    return F.array(*keys)


def linked_fingerprints(fps: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b), a < b, that connect exactly those distinct fingerprints that a chain of differences of at most
    `distance` bits (1 or 2) connects. fps: a column fp, without repeats.

    Fingerprints that meet under a key shared by at most `crowd` of them are paired and verified. Those that meet under a
    fuller key go through centres: fingerprints differ by at most 2 bits just if they have a common value one bit from each
    at most, so all fingerprints around a centre are linked to its least one. A centre has 65 neighbours at most.
    """
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2")
    keyed = fps.select("fp", F.explode(deletion_keys(F.col("fp"))).alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(split_join(keyed, met.withColumn("met", F.col("n")), "key", ["fp"], 64 * fps.count()), "met")
    few = members.where(F.col("met") <= crowd).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    pair = F.explode(F.expr("flatten(transform(all, (a, i) -> transform(slice(all, i + 2, size(all)), b -> struct(a, b))))"))
    pairs = few.select(pair.alias("p")).select("p.a", "p.b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    around = F.array(*[F.struct(F.lit(i).alias("bit"), (F.col("fp").bitwiseAND(F.lit(~_mask(i))) if distance == 1 else F.col("fp").bitwiseXOR(F.lit(_mask(i)))).alias("at")) for i in range(64)])
    spots = F.explode(around if distance == 1 else F.concat(F.array(F.struct(F.lit(0).alias("bit"), F.col("fp").alias("at"))), around))
    centres = members.where(F.col("met") > crowd).select("fp").distinct().select("fp", spots.alias("c"))
    by = ["c.bit", "c.at"] if distance == 1 else ["c.at"]
    stars = centres.groupBy(*by).agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def _mask(i: int) -> int:
    return (1 << i) - (1 << 64 if i == 63 else 0)


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: component_id is the smallest doc_id reachable over links between
    fingerprints that differ in at most `distance` bits.

    Empty and null texts share fingerprint 0 and are linked like any other; equal texts link whatever their number, as only
    distinct fingerprints are searched. Null doc_ids stay and never name a component unless it has no other id. An empty
    table gives no rows. Columns other than doc_id and text are not read.
    """
    rows = saved(fingerprints(docs, width), "fingerprints").withColumn("spot", F.monotonically_increasing_id())
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")), "distinct")
    found = components(linked_fingerprints(fps.select("fp"), distance))
    joined = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    total = fps.agg(F.count("*").alias("fps"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    ids = split_join(joined, least, "root", ["fp"], total["fps"]).select("fp", "component_id", F.col("rows").alias("n"))
    return split_join(rows, ids, "fp", ["spot"], total["rows"]).select("doc_id", "fp", "component_id")


# ---- an exact search by Jaccard similarity of shingle sets ----

#: Bits of a text's parity map: bit b is the parity of the shingles whose hash ends in b, so maps differ in no more bits than sets differ in shingles.
PARITY = 1024
#: Sets with more shingles than this also have a wide map, of two to four bits a shingle, as a map fills up.
WIDE_FROM = 512
#: Texts looked at for usual shingles, and most of these that are kept. They order the search and never change its result.
LOOKED_AT, USUAL = 10_000, 200_000
#: Bytes of texts, sets or maps that a Python worker gets at a time.
BATCH_BYTES = 8 << 20
#: Rows of a block, about; blocks are compared with blocks, a pair of them in a task, so no task holds all rows of a key.
BLOCK = 1024
#: Pairs of a block that a worker looks at in one step; their maps take 2 MB.
STRIP = 1 << 14


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return distinct(shingle_hashes(text, width))


def distinct(chunks) -> np.ndarray:
    """Sorted distinct hashes of chunks."""
    return np.unique(np.concatenate([*chunks, np.zeros(0, np.uint64)]))


def parity(h: np.ndarray, bits: int = PARITY) -> np.ndarray:
    odd = (np.bincount((h % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def wide_parity(h: np.ndarray) -> bytes | None:
    return parity(h, 1 << (2 * len(h) - 1).bit_length()).tobytes() if len(h) > WIDE_FROM else None


def parity_distance(x: bytes, y: bytes) -> int:
    """Bits that two maps differ in, the longer one folded to the other's length: maps are powers of two long."""
    x, y = (np.frombuffer(m, np.uint64) for m in (x, y))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


class Usual:
    """Usual shingles, the most usual first, ready to be looked up."""

    def __init__(self, shingles: np.ndarray):
        self.rank = np.argsort(shingles)
        self.sorted = shingles[self.rank]
        self.shingles = shingles

    def ordered(self, h: np.ndarray) -> np.ndarray:
        """A set's values in an order that all sets share: unusual ones by value, then usual ones, the most usual last."""
        if not len(self.sorted):
            return h
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        known = self.sorted[at] == h
        return np.concatenate([h[~known], self.shingles[np.sort(self.rank[at[known]])[::-1]]])


def prefix(h: np.ndarray, usual: Usual, similarity: float) -> np.ndarray:
    """The first values of a set in the shared order, as many as its size less those it must share with any set of that similarity, plus
    one: such sets hold a value of each other's prefix. An empty set has the value 0."""
    if not len(h):
        return np.zeros(1, np.int64)
    return usual.ordered(h)[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1].view(np.int64)


MARKS = ["fp", "size", "bits", "wide", "prefix"]


def _marked_batches(batches, width, similarity, usual):
    usual = Usual(usual.value)
    for b in pieces(batches, "text"):
        fps, sizes, bits, wide, first = [], [], [], [], []
        for t in _texts(b):
            chunks = list(shingle_hashes(t, width))
            h = distinct(chunks)
            fps.append(majority(chunks))
            sizes.append(len(h))
            bits.append(parity(h))
            wide.append(wide_parity(h))
            first.append(prefix(h, usual, similarity))
        bits = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(bits)), PARITY // 64).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "none", "id")), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), bits, pa.array(wide, pa.binary()), pa.array(first, pa.list_(pa.int64()))], ["key", "none", "id", *MARKS])


def _value_batches(batches, width):
    for b in pieces(batches, "text"):
        for t in _texts(b):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, width).view(np.int64))], ["v"])


def usual_shingles(rows: DataFrame, width: int) -> np.ndarray:
    """Shingles that several of some 10,000 texts hold, the most usual first."""
    part = max(1, rows.count() // LOOKED_AT)
    values = rows.where(F.pmod(F.col("key"), F.lit(part)) == 0).select("text").distinct().mapInArrow(partial(_value_batches, width=width), "v long")
    counted = values.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "v").limit(USUAL)
    return counted.toArrow().column("v").to_numpy().view(np.uint64)


def _set_batches(batches, width):
    """Sorted distinct shingle hashes of each text, as bytes."""
    for b in pieces(batches, "text"):
        out = [shingle_set(t, width).tobytes() for t in _texts(b)]
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.binary())], ["key", "shingles"])


def _similar_batches(batches, similarity):
    for b in pieces(batches, "x", "y"):
        keep = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def with_both(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with x and y, the column of either end in `of` (key, column)."""
    one = of.select(F.col("key").alias("a"), F.col(column).alias("x"))
    other = of.select(F.col("key").alias("b"), F.col(column).alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y")


def _may_share(size_a, at_a, size_b, at_b, similarity):
    """Whether sets of these sizes can be similar if the value at these places is the first they share."""
    least = F.least if isinstance(size_a, Column) else np.minimum
    return least(size_a - at_a, size_b - at_b) >= (size_a + size_b) * (similarity / (1 + similarity)) - 1e-6


def _apart(size_a, size_b, similarity):
    """Most shingles that only one of two similar sets of these sizes holds."""
    return (size_a + size_b) * ((1 - similarity) / (1 + similarity)) + 1e-6


_ROW = ["probe", "key", "root", "size", "at", "bits"]


def _block_pairs(probe, key, root, size, at, bits, similarity):
    """Pairs of a probe (1) and a row (0, or -1 if it is of the main root), of different roots, whose sizes, places and parity maps allow the similarity.
    Probes are rows of other cells too; a pair of them is kept once."""
    p, r = np.flatnonzero(probe == 1), np.flatnonzero(probe != 1)
    step = max(1, STRIP // max(1, len(r)))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(p), step):
        q = p[lo : lo + step]
        fits = (root[q, None] != root[None, r]) & _may_share(size[q, None], at[q, None], size[None, r], at[None, r], similarity)
        fits &= (probe[None, r] < 0) | (key[q, None] < key[None, r])
        i, j = np.nonzero(fits)
        x, y = q[i], r[j]
        near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64) <= _apart(size[x], size[y], similarity)
        a.append(key[x[near]])
        b.append(key[y[near]])
    return np.concatenate(a), np.concatenate(b)


def _pair_batches(batches, similarity):
    """Rows come sorted by group; the last group of a batch waits for the next, as it may go on there."""

    def done(t: pa.Table):
        group, (probe, key, root, size, at) = t.column("grp").to_numpy(), (t.column(c).to_numpy().astype(np.int64) for c in _ROW[:-1])
        bits = t.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(key), -1)
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        found = [_block_pairs(*(c[i:j] for c in (probe, key, root, size, at, bits)), similarity) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column("grp").to_numpy()
        cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if group[0] != group[-1] else 0
        if cut or (held and held[-1].column("grp")[0].as_py() != group[0]):
            yield done(pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield done(pa.Table.from_batches(held))


def cross_pairs(rooted: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different roots that meet under a value and may be similar. rooted: (k, key, size, at, root).

    Under each value, all rows but those of its commonest root are compared with all rows. Both are dealt to blocks by digest and a task
    takes a block of either, so a value that very many rows share is the work of many tasks, and rows of one root, however many, are never compared with one another.
    """
    shares = rooted.groupBy("k", "root").agg(F.count("*").alias("n"))
    shape = shares.groupBy("k").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).where("top.n < all")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = shape.select("k", F.col("top.root").alias("main"), blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("top.n")).alias("others"), F.col("all").alias("n"))
    shape = saved(shape, "shape")
    total = shape.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    left = split_join(rooted.join(small(shape.select("k")), "k", "left_semi"), shape, "k", ["key"], total).join(texts.select("key", "bits"), "key")
    spot = lambda n: F.pmod(F.xxhash64("key", "k"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda probe, i, j: F.struct(probe.alias("probe"), i.alias("i"), j.alias("j"))
    other = F.col("root") != F.col("main")
    as_row = F.transform(upto(F.col("others")), lambda j: cell(F.when(other, 0).otherwise(-1), spot(F.col("blocks")), j))
    as_probe = F.when(other, F.transform(upto(F.col("blocks")), lambda i: cell(F.lit(1), i, spot(F.col("others"))))).otherwise(F.array().cast("array<struct<probe:int,i:int,j:int>>"))
    cells = left.withColumn("cell", F.explode(F.concat(as_row, as_probe)))
    cells = cells.select(F.xxhash64("k", "cell.i", "cell.j").alias("grp"), "cell.probe", "key", "root", "size", "at", "bits")
    cells = cells.repartition("grp").sortWithinPartitions("grp")
    return cells.mapInArrow(partial(_pair_batches, similarity=similarity), "a long, b long").distinct()


def _apart_batches(batches, similarity):
    for b in pieces(batches, "x", "y"):
        keep = []
        for n, m, x, y in zip(*(b.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
            keep.append(parity_distance(x, y) <= _apart(n, m, similarity))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def close_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) of different roots (where texts have them) whose parity maps allow the similarity."""
    rooted = "root" in texts.columns
    both = with_both(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts.select("key", F.struct("size", "bits", *["root"] * rooted).alias("m")), "m")
    both = both.where("x.root <> y.root") if rooted else both
    odd = F.aggregate(F.zip_with("x.bits", "y.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return both.where(odd <= _apart(F.col("x.size"), F.col("y.size"), similarity)).select("a", "b")


def wide_pairs(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of which one has no wide map, or whose wide maps allow the similarity, as a table: maps take a thirtieth of a set's bytes."""
    pairs = saved(pairs, "pairs")
    long_ = saved(texts.where("wide IS NOT NULL").select("key", F.struct("size", "wide").alias("m")), "long")
    ends = small(long_.select("key"))
    both = pairs.join(ends.withColumnRenamed("key", "a"), "a", "left_semi").join(ends.withColumnRenamed("key", "b"), "b", "left_semi").select("a", "b")
    maps = with_both(both, long_, "m").select("a", "b", F.col("x.size").alias("n"), F.col("y.size").alias("m"), F.col("x.wide").alias("x"), F.col("y.wide").alias("y"))
    compared = maps.mapInArrow(partial(_apart_batches, similarity=similarity), "a long, b long")
    out = saved(pairs.join(both, ["a", "b"], "left_anti").unionByName(compared), "close", BATCH_BYTES)
    dropped(pairs, long_)
    return out


def print_pairs(texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts (key, fp) that connect exactly those whose fingerprints a chain of differences of at most 2 bits connects: fingerprints
    are linked by linked_fingerprints, texts of one fingerprint through the least of them."""
    prints = saved(texts.groupBy("fp").agg(F.min("key").alias("head"), F.count("*").alias("n")), "prints")
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    alike = split_join(texts.select("fp", "key"), prints.where("n > 1"), "fp", ["key"], total).select(F.col("head").alias("a"), F.col("key").alias("b")).where("a <> b")
    links = saved(linked_fingerprints(prints.select("fp")), "printed")
    for end in ("a", "b"):
        links = links.join(prints.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head")), end)
    return links.select(F.col("a_head").alias("a"), F.col("b_head").alias("b")).unionByName(alike)


def met_values(texts: DataFrame) -> DataFrame:
    """(k, key, size, at, met) for each value k of a prefix that more than one row has, met being their number, as a table.

    Values are counted first, within tasks before the shuffle. Rows of a value of over HOT_ROWS get its count by a look-up, so they are never one task's; those of the others go
    through a window, which so holds HOT_ROWS rows of a value at most. No value is hot by a sample or by its rank."""
    keyed = texts.select("key", "size", F.posexplode("prefix").alias("at", "k")).select("k", "key", "size", "at")
    hot = saved(keyed.groupBy("k").agg(F.count("*").alias("met")).where(F.col("met") > store.HOT_ROWS), "hot")
    rows = looked_up(keyed, hot, "k", ["key"])
    rare = rows.where("met IS NULL").drop("met").withColumn("met", F.count("*").over(Window.partitionBy("k"))).where("met > 1")
    out = saved(rare.unionByName(rows.where("met IS NOT NULL")), "met")
    dropped(hot)
    return out


def linked_texts(texts: DataFrame, verified, similarity: float, full: int = FULL) -> DataFrame:
    """Links (a, b) between rows of texts (key, fp, size, bits, prefix) that connect exactly those that a chain of similar pairs connects.
    verified(pairs) gives a table of the similar ones of (a, b).

    Texts whose fingerprints are linked come first, and are verified. Similar texts may differ in more bits, so an exact search follows, of pairs that are in different components
    by then: similar sets share a value of their prefixes. Rows under a value that at most `full` share are paired. Under a fuller one, each is first paired with a head
    that a digest picks, which links most of a group of copies; then all pairs of rows that are still in different components are
    compared, by cross_pairs. So no pair is left out that could connect anything.
    """
    near = verified(close_pairs(print_pairs(texts), texts, similarity))
    found = saved(components(near), "found")
    apart = texts.join(small(found), texts["key"] == found["node"], "left").select("key", "size", "bits", F.coalesce("root", "key").alias("root"))
    met = met_values(texts)
    values = met.count()
    few = met.where(F.col("met") <= full).groupBy("k").agg(F.collect_list(F.struct("key", "size", "at")).alias("all"))
    pair = F.explode(F.expr("flatten(transform(all, (a, i) -> transform(slice(all, i + 2, size(all)), b -> struct(a, b))))"))
    few = few.select(pair.alias("p")).select("p.a", "p.b").where(_may_share(F.col("a.size"), F.col("a.at"), F.col("b.size"), F.col("b.at"), similarity)).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))
    crowded = met.where(F.col("met") > full)
    heads = crowded.groupBy("k").agg(F.min_by("key", F.xxhash64(F.col("k").bitwiseAND(F.lit(3)), "key")).alias("head"), F.count("*").alias("n"))
    stars = split_join(crowded.select("k", "key"), heads, "k", ["key"], values).select(F.col("head").alias("a"), F.col("key").alias("b"))
    links = near.unionByName(verified(close_pairs(few.unionByName(stars), apart, similarity)))
    dropped(found)
    found = saved(components(links), "found")
    rooted = crowded.join(small(found), crowded["key"] == found["node"], "left").select("k", "key", "size", "at", F.coalesce("root", "key").alias("root"))
    rooted = saved(rooted, "rooted")
    dropped(met)
    rest = verified(cross_pairs(rooted, texts, similarity))
    dropped(rooted, found)
    return links.unionByName(rest)


def deduplicated(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id.

    Equal texts (null counts as empty) share a group. Different texts are linked if the Jaccard similarity of their
    sets of `width`-word shingles is `similarity` or more: those whose fingerprints differ in 2 bits at most are found by the index of near_duplicates, the others by their
    prefixes; every such pair is a candidate or already connected, and the sets decide. Chains of links make
    a group. Rows alike in doc_id and text leave one. A null doc_id counts as larger than all others. Columns of docs are kept as they
    are, whatever their names. An empty table stays empty. Texts are known by a 64-bit digest of their SHA-256, shingles by 64 bits.
    """
    body = F.coalesce("text", F.lit(""))
    spark = docs.sparkSession
    named = [F.xxhash64(F.sha2(body, 256)).alias("key"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id")]
    rows = docs.select(*named, body.alias("text"))
    sent = spark.sparkContext.broadcast(usual_shingles(rows, width))
    marked = rows.mapInArrow(partial(_marked_batches, width=width, similarity=similarity, usual=sent), "key long, none boolean, id long, fp long, size int, bits array<long>, wide binary, prefix array<long>")
    texts = marked.groupBy("key").agg(F.min(F.struct("none", "id")).alias("first"), *[F.any_value(c).alias(c) for c in MARKS])
    texts = saved(texts.select("key", "first.none", "first.id", *MARKS), "texts", BATCH_BYTES)
    repeated = not rows.groupBy("key", "none", "id").count().where("count > 1").isEmpty()

    def verified(pairs: DataFrame) -> DataFrame:
        close = wide_pairs(pairs, texts, similarity)
        wanted = close.select(F.col("a").alias("key")).unionByName(close.select(F.col("b").alias("key"))).distinct()
        wanted = saved(texts.select("key", "none", "id").join(wanted, "key", "left_semi"), "wanted")
        sets = rows.join(small(wanted), ["key", "none", "id"], "left_semi").select("key", "text").mapInArrow(partial(_set_batches, width=width), "key long, shingles binary")
        sets = saved(sets.dropDuplicates(["key"]) if repeated else sets, "sets", BATCH_BYTES)
        links = saved(with_both(close, sets, "shingles").mapInArrow(partial(_similar_batches, similarity=similarity), "a long, b long"), "links", BATCH_BYTES)
        dropped(close, wanted, sets)
        return links

    found = components(linked_texts(texts, verified, similarity))
    grouped = texts.join(found, texts["key"] == found["node"], "left").select("key", "none", "id", F.coalesce("root", "key").alias("root"))
    best = grouped.groupBy("root").agg(F.min(F.struct("none", "id", "key")).alias("b")).select("b.key", "b.none", "b.id")
    best = small(saved(best, "best"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *named)
    kept = whole.join(best, ["key", "none", "id"], "left_semi")
    return (kept.dropDuplicates(["key", "none", "id"]) if repeated else kept).select("row.*")
