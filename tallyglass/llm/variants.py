"""Spelling variants: the vocabulary of a corpus joined with itself at an edit distance of one, by a trie and active-node sets.

The trie is cut into subtries of bounded size, each one task's work at a time: there, the nodes within the distance of a node follow from those of its parent. A pair whose
words part above the cuts has used up its one edit there, so the rest of both is equal, and an equality join finds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.store import dropped, fits, looked_up, saved

#: Letters of a run and the least length and occurrences of a word.
LETTERS, LEAST_LENGTH, LEAST_COUNT = "a-zÀ-ÿ", 7, 2
#: One run in so many, by its hash, loses a letter.
SLIPS = 31
#: A form occurs at least so many times as often as its variant.
TIMES = 10
#: Letters of the shortest and longest prefixes that the trie is cut at, and the words that a subtrie may have before it is cut further down.
CUT, DEEPEST, FULL = 3, 16, 1_000


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters in docs (doc_id, text), lower case for A-Z, one in SLIPS without one letter, as the crc32 of id and run says; words of LEAST_LENGTH letters and
    LEAST_COUNT occurrences or more. Counts are combined before the shuffle."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % SLIPS == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def trie_pairs(words: list[str], skip: int = 0) -> Iterator[tuple[int, int]]:
    """(i, j), both ways, for words at an edit distance of exactly one, all alike in their first `skip` letters.

    A node's active nodes, itself aside, are those at a distance of one. The child by letter c has: the node (c deleted), its other children (c replaced), the child's children
    (a letter inserted), and the children by c of the node's active nodes (c kept)."""
    below: list[dict[str, int]] = [{}]
    ends = [-1]
    for i, word in enumerate(words):
        at = 0
        for c in word[skip:]:
            to = below[at].get(c)
            if to is None:
                to = below[at][c] = len(below)
                below.append({})
                ends.append(-1)
            at = to
        ends[at] = i
    stack = [(0, set(below[0].values()))]
    while stack:
        node, active = stack.pop()
        if ends[node] >= 0:
            for v in active:
                if ends[v] >= 0:
                    yield ends[node], ends[v]
        for c, child in below[node].items():
            kept = {below[v][c] for v in active if c in below[v]}
            kept.update(below[node].values(), below[child].values())
            kept.add(node)
            kept.discard(child)
            stack.append((child, kept))


PAIR = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _subtries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each subtrie of rows (cut, word, n) sorted by cut; one subtrie is held at a time."""

    def pairs(cut: str | None, words: list[str], ns: list[int]) -> Iterator[pa.RecordBatch]:
        found = list(trie_pairs(words, len(cut or ""))) if len(words) > 1 else []
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in a]), pa.array([words[j] for j in b]), pa.array([ns[j] for j in b], pa.int64())], schema=PAIR)

    now, words, ns = None, [], []
    for batch in batches:
        for cut, word, n in zip(*(batch.column(c).to_pylist() for c in ("cut", "word", "n"))):
            if cut != now:
                yield from pairs(now, words, ns)
                now, words, ns = cut, [], []
            words.append(word)
            ns.append(n)
    yield from pairs(now, words, ns)


def cut_depths(words: DataFrame, full: int, deepest: int) -> DataFrame:
    """words with `depth`: letters of the shortest prefix of CUT or more that at most `full` words share; more than the word has where there is none
    up to `deepest`. Each level looks at the words of full prefixes only, by a table of a row for each `full` words at most."""
    out, size = words.withColumn("depth", F.lit(CUT)), F.char_length("word")
    for depth in range(CUT, deepest + 1):
        here = out.where((F.col("depth") == depth) & (size >= depth)).select(F.substring("word", 1, depth).alias("prefix"))
        many = saved(here.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > full).select("prefix", F.lit(True).alias("many")), "prefixes")
        if many.isEmpty():
            dropped(many)
            return out
        prefix = F.when((F.col("depth") == depth) & (size >= depth), F.substring("word", 1, depth))
        before = out
        out = saved(looked_up(out.withColumn("prefix", prefix), many, "prefix", ["word"]).withColumn("depth", F.when(F.col("many"), F.lit(depth + 1)).otherwise(F.col("depth"))).drop("prefix", "many"), "depths")
        dropped(many, before)
    return out.withColumn("depth", F.when(F.col("depth") > deepest, size + 1).otherwise(F.col("depth")))


def near_pairs(vocab: DataFrame, full: int = FULL, deepest: int = DEEPEST) -> DataFrame:
    """(word, near, near_n), each pair both ways, for words of vocab (word, n; each once) at an edit distance of exactly one.

    Two words part behind their common prefix. If that reaches their cut (which both then share), the subtrie's task finds them. Else they part at a letter k above the cut: taking letter k from the longer, or from
    both, leaves the same. A word gives two keys a letter above its cut; a key has a word for each letter of the alphabet and one more at most, and its pairs
    all count, so nothing is emitted in vain."""
    return _pairs(cut_depths(vocab.select("word", "n"), full, deepest))


def _pairs(cut: DataFrame) -> DataFrame:
    size = F.char_length("word")
    subtries = cut.where(size >= F.col("depth")).select(F.expr("left(word, depth)").alias("cut"), "word", "n")
    inside = subtries.repartition("cut").sortWithinPartitions("cut", "word").mapInArrow(_subtries, "word string, near string, near_n long")

    levels = cut.select("word", "n", F.explode(F.sequence(F.lit(0), F.least(F.col("depth") - 1, size))).alias("k"))
    less = F.struct(F.concat(F.expr("left(word, k)"), F.expr("substr(word, k + 2)")).alias("rest"), F.expr("substr(word, k + 1, 1)").alias("c"))
    whole = F.struct(F.col("word").alias("rest"), F.lit("").alias("c"))
    keys = levels.select("k", "n", F.explode(F.when(F.col("k") < size, F.array(less, whole)).otherwise(F.array(whole))).alias("key")).select("k", "key.rest", "key.c", "n")
    groups = keys.groupBy("k", "rest").agg(F.collect_list(F.struct("c", "n")).alias("all")).where(F.size("all") > 1)
    one = groups.select("k", "rest", "all", F.explode("all").alias("a"))
    two = one.select("k", "rest", "a", F.explode("all").alias("b")).where(F.col("a.c") != F.col("b.c"))
    after = F.expr("substr(rest, k + 1, 1)")  # a letter that is followed by itself parts the words further on
    two = two.where(((F.col("a.c") != "") | (F.col("b.c") != after)) & ((F.col("b.c") != "") | (F.col("a.c") != after)))
    word = lambda c: F.concat(F.expr("left(rest, k)"), F.col(c), F.expr("substr(rest, k + 1)"))
    return inside.unionByName(two.select(word("a.c").alias("word"), word("b.c").alias("near"), F.col("b.n").alias("near_n")))


def rooted(forms: DataFrame, most_rounds: int = 12) -> DataFrame:
    """(word, root) for forms (word, form; each word once): the last form that a chain of them leads to. Each round doubles the step; counts rise
    by TIMES along a chain, so chains are short."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most_rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if fits(on):
            on = F.broadcast(on)
        new = saved(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        moved = not new.where("moved").isEmpty()
        dropped(now)
        now = new
        if not moved:
            return now.drop("moved")
    raise RuntimeError("forms lead in a circle")


def grouped(vocab: DataFrame, times: int = TIMES, full: int = FULL, deepest: int = DEEPEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of vocab (word, n; each once): how many words are near, that of the largest n (the first in code-point
    order among equals) if it has `times` the word's own, and the last of the chain of forms (the word itself without one). No words give no rows; words of any length do."""
    cut = cut_depths(vocab.select("word", "n"), full, deepest)
    pairs = _pairs(cut)
    own = vocab.select("word", "n", F.lit(0).alias("near_1"), F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    every = own.unionByName(pairs.select("word", F.lit(None).cast("long").alias("n"), F.lit(1).alias("near_1"), "near", "near_n"))
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))))
    found = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("near_1").alias("n_near"), best.alias("best"))
    usual = -F.col("best.m") >= F.col("n") * times
    found = saved(found.select("word", F.when(usual, F.col("best.near")).alias("form"), "n", "n_near", F.when(usual, -F.col("best.m")).alias("form_n")), "forms")
    dropped(cut)
    roots = rooted(found.where("form IS NOT NULL"))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """grouped() over the vocabulary of docs (doc_id, text). Null texts have no words; a null doc_id counts as an empty one; repeated rows count again; extra columns don't
    matter. The table of words is written once, as a lost executor costs its own tasks only then."""
    words = saved(vocabulary(docs), "vocabulary")
    out = grouped(words)
    dropped(words)
    return out
