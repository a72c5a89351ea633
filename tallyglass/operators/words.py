"""Words with boxes: scan, cleaning, geometry, layout statistics, lines.

A document's words stay one array in its row, so nothing here shuffles; `exploded` gives them as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.functions import vocab as V
from tallyglass.functions.columns import bound, matches, median, stripped
from tallyglass.functions.textnorm import cleaned_words, nfc

WORD = "struct<i:int,text:string,x0:double,y0:double,x1:double,y1:double,confidence:double,cx:double,cy:double>"
MARK = "\u0001"


def placed(text: Column, x0: Column, y0: Column, x1: Column, y1: Column, confidence: Column, i: Column) -> Column:
    """A word of plain references, which cost less than binding them."""
    return F.struct(
        i.cast("int").alias("i"), text.alias("text"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
        confidence.alias("confidence"), ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"),
    )


word = bound(placed)


def numbered(words: Column) -> Column:
    """Words with i counted anew from 0."""
    return F.transform(words, lambda w, i: placed(w["text"], w["x0"], w["y0"], w["x1"], w["y1"], w["confidence"], i))


def boxed(page: Column, trim: bool = True) -> Column:
    """A page's words that have text and four corners or more, in their order, with the box around the corners. Without `trim` texts stay as they were scanned: Unicode's white space counts as text."""
    corners = lambda w: w["boundingBox"]["vertices"]
    kept = F.filter(F.coalesce(page["words"], F.array().cast(PAGE_WORDS)), lambda w: _with_text(w, trim) & (F.size(corners(w)) >= 4))

    def made(w: Column) -> Column:
        xs, ys = corners(w)["x"], corners(w)["y"]
        ends = {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}
        return F.struct((stripped(w["text"]) if trim else w["text"]).alias("text"), *[v.alias(k) for k, v in ends.items()], F.coalesce(w["confidence"], F.lit(0.0)).alias("confidence"))

    return numbered(F.transform(kept, made))


def _with_text(w: Column, trim: bool) -> Column:
    return F.coalesce(matches(w["text"], r"\S") if trim else w["text"] != "", F.lit(False))


PAGE_WORDS = "array<struct<text:string,confidence:double,boundingBox:struct<vertices:array<struct<x:double,y:double>>>>>"


def has_boxes(page: Column) -> Column:
    """Whether any word of the page has corners: the route a document takes."""
    return F.coalesce(F.exists(page["words"], lambda w: w["boundingBox"]["vertices"].isNotNull()), F.lit(False))


def cleaned(df: DataFrame, words: str = "words") -> DataFrame:
    """df with each document's words normalised, noise dropped, and i dense again. A document's words are normalised and mended in one text, and set apart after it."""
    df = df.withColumn("_nfc", nfc(F.array_join(F.col(words)["text"], MARK)))
    return df.withColumn(words, numbered(_fresh(F.col(words), F.split(cleaned_words(F.col("_nfc"), MARK), MARK)))).drop("_nfc")


@bound
def _fresh(words: Column, texts: Column) -> Column:
    box = ("x0", "y0", "x1", "y1", "confidence")
    fresh = F.transform(words, lambda w, i: F.struct(F.get(texts, i).alias("text"), *[w[k].alias(k) for k in box]))
    return F.filter(fresh, lambda w: (w["text"] != "") & ~w["text"].isin(*V.NOISE_WORDS))


def full_text(words: Column) -> Column:
    return F.array_join(words["text"], " ")


def page_words(df: DataFrame, page: str = "page", trim: bool = True) -> DataFrame:
    """(doc_id, word_idx, text, box, confidence, centre, width, height) of each word of a page that boxed() keeps: exploded() of it, but rows come first, and boxes are
    worked out on their flat columns, in generated code."""
    kept = F.filter(F.col(page)["words"], lambda w: _with_text(w, trim) & (F.size(w["boundingBox"]["vertices"]) >= 4))
    w = df.select("doc_id", F.posexplode(kept).alias("word_idx", "w"))
    corners = F.col("w")["boundingBox"]["vertices"]
    w = w.select("doc_id", "word_idx", (stripped(F.col("w")["text"]) if trim else F.col("w")["text"]).alias("text"), corners["x"].alias("xs"), corners["y"].alias("ys"), F.coalesce(F.col("w")["confidence"], F.lit(0.0)).alias("confidence"))
    w = w.select("doc_id", "word_idx", "text", F.array_min("xs").alias("x_min"), F.array_min("ys").alias("y_min"), F.array_max("xs").alias("x_max"), F.array_max("ys").alias("y_max"), "confidence")
    x0, y0, x1, y1 = (F.col(c) for c in ("x_min", "y_min", "x_max", "y_max"))
    return w.select("*", ((x0 + x1) / 2).alias("cx"), ((y0 + y1) / 2).alias("cy"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))


def exploded(df: DataFrame, words: str = "words") -> DataFrame:
    """(doc_id, word_idx, text, box, confidence, centre, width, height): a row a word."""
    w = df.select("doc_id", F.explode(words).alias("w"))
    return w.select("doc_id", F.col("w.i").alias("word_idx"), "w.text", *[F.col(f"w.{a}").alias(b) for a, b in (("x0", "x_min"), ("y0", "y_min"), ("x1", "x_max"), ("y1", "y_max"))], "w.confidence", "w.cx", "w.cy", (F.col("w.x1") - F.col("w.x0")).alias("width"), (F.col("w.y1") - F.col("w.y0")).alias("height"))


def collected(rows: DataFrame) -> DataFrame:
    """(doc_id, words) from rows (doc_id, word_idx, text, x_min, y_min, x_max, y_max, confidence): one shuffle."""
    one = word(F.col("text"), *[F.col(c).cast("double") for c in ("x_min", "y_min", "x_max", "y_max")], F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)), F.col("word_idx"))
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("words"))


def line_height(words: Column) -> Column:
    return F.coalesce(median(F.filter(F.transform(words, lambda w: w["y1"] - w["y0"]), lambda h: h > 0)), F.lit(V.LAYOUT_DEFAULT["line"]))


def half_line(height: Column) -> Column:
    """How far apart words of one line may stand, by the line height."""
    return F.greatest(height * 0.5, F.lit(30.0))


@bound
def layout(words: Column) -> Column:
    """Medians of letter width, line height and the space between words of a line, and the page's extent."""
    letter = median(F.transform(F.filter(words, lambda w: F.char_length(w["text"]) > 0), lambda w: (w["x1"] - w["x0"]) / F.char_length(w["text"])))
    height = line_height(words)
    inline = F.array_sort(F.transform(words, lambda w: F.struct(w["cy"].alias("cy"), w["cx"].alias("cx"), w["i"].alias("i"), w["x0"].alias("x0"), w["x1"].alias("x1"))))
    page = V.LAYOUT_DEFAULT["page"]
    return _layout(letter, height, inline, F.coalesce(F.array_max(F.transform(words, lambda w: w["x1"])), F.lit(page)), F.coalesce(F.array_max(F.transform(words, lambda w: w["y1"])), F.lit(page)))


@bound
def _layout(letter: Column, height: Column, inline: Column, width: Column, depth: Column) -> Column:
    pairs = F.arrays_zip(inline.alias("a"), F.slice(inline, F.lit(2), F.size(inline)).alias("b"))
    near = F.transform(F.filter(pairs, lambda p: F.abs(p["a"]["cy"] - p["b"]["cy"]) <= height), lambda p: p["b"]["x0"] - p["a"]["x1"])
    space = median(F.filter(near, lambda s: s > 0))
    return F.struct(
        F.coalesce(letter, F.lit(V.LAYOUT_DEFAULT["char"])).alias("avg_char_width"), height.alias("avg_line_height"),
        F.coalesce(space, F.lit(V.LAYOUT_DEFAULT["space"])).alias("avg_word_spacing"), width.alias("page_width"), depth.alias("page_height"),
    )


@bound
def thresholds(layout_: Column) -> Column:
    """Reach along a line, half a line, and the next lines, from a layout."""
    return F.struct(
        F.greatest(layout_["avg_char_width"] * 50, F.lit(300.0)).alias("x_reach"), half_line(layout_["avg_line_height"]).alias("same_line"),
        F.greatest(layout_["avg_line_height"] * 2.5, F.lit(100.0)).alias("next_line"),
    )


@bound
def lines_by_head(words: Column, same_line: Column) -> Column:
    """Lines as arrays of words from left to right: a word joins while it is near the line's first word in height."""
    ordered = F.array_sort(F.transform(words, lambda w: F.struct(w["cy"].alias("cy"), w["i"].alias("i"), w.alias("w"))))
    return _lines_of(ordered, same_line)


@bound
def _lines_of(ordered: Column, same_line: Column) -> Column:
    """Only the places where lines begin are gathered, so that a step copies no words."""
    start = F.struct(F.lit(None).cast("double").alias("head"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("k"))

    def step(s: Column, x: Column) -> Column:
        stays = F.struct(s["head"].alias("head"), s["starts"].alias("starts"), (s["k"] + 1).alias("k"))
        opens = F.struct(x["cy"].alias("head"), F.concat(s["starts"], F.array(s["k"])).alias("starts"), (s["k"] + 1).alias("k"))
        return F.when((F.size(s["starts"]) > 0) & (F.abs(x["cy"] - s["head"]) <= same_line), stays).otherwise(opens)

    return _cut_lines(ordered, F.aggregate(ordered, start, step, lambda s: s["starts"]))


@bound
def _cut_lines(ordered: Column, starts: Column) -> Column:
    by_x = lambda ws: F.transform(F.array_sort(F.transform(ws, lambda x, k: F.struct(x["w"]["cx"].alias("cx"), k.alias("k"), x["w"].alias("w")))), lambda s: s["w"])

    def line(ws: Column) -> Column:
        return F.struct(by_x(ws).alias("words"), (F.aggregate(ws, F.lit(0.0), lambda s, x: s + x["w"]["cy"]) / F.size(ws)).alias("y_avg"))

    ends = lambda n: F.coalesce(F.get(starts, n + 1), F.size(ordered))
    return F.transform(F.transform(starts, lambda s, n: F.slice(ordered, s + 1, ends(n) - s)), line)


def rendered_lines(rows: DataFrame) -> DataFrame:
    """rows (doc_id, word_idx, text, x, x_end, cy, height) with line_id: a line goes on while the next word down is less than
    0.3 of the word before's height away. Gaps and islands in one window over a document's words."""
    down = Window.partitionBy("doc_id").orderBy("cy", "word_idx")
    breaks = F.when(F.abs(F.col("cy") - F.lag("cy").over(down)) < F.lag("height").over(down) * V.LINE_FACTOR, 0).otherwise(1)
    return rows.withColumn("_new", breaks).withColumn("line_id", F.sum("_new").over(down)).drop("_new")


def rendered(rows: DataFrame) -> DataFrame:
    """(doc_id, rendered): the page as text, words set apart by as many spaces as 12 pixels fit between them."""
    lines = rendered_lines(rows)
    along = Window.partitionBy("doc_id", "line_id").orderBy("x", "cy", "word_idx")
    before = F.lag("x_end").over(along)
    gap = F.when(before.isNull(), F.col("x")).otherwise(F.when(F.col("x") - before > V.SPACE_PIXELS, F.col("x") - before).otherwise(0.0))
    spaced = lines.withColumn("piece", F.concat(F.repeat(F.lit(" "), F.greatest(F.floor(gap / V.SPACE_PIXELS), F.lit(0)).cast("int")), "text")).withColumn("place", F.row_number().over(along))
    text = F.expr("array_join(transform(array_sort(collect_list(struct(place, piece))), p -> p.piece), '')")
    lines = spaced.groupBy("doc_id", "line_id").agg(text.alias("line"))
    return lines.groupBy("doc_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(line_id, line))), l -> l.line), '\\n')").alias("rendered"))


def corner_words(df: DataFrame, page: Column) -> DataFrame:
    """(doc_id, word_idx, text, x, x_end, cy, height) by corners, as rendering takes them."""
    rows = df.select("doc_id", F.posexplode(page["words"]).alias("word_idx", "w")).where(F.size("w.boundingBox.vertices") >= 3)
    v = lambda k, c: F.get("w.boundingBox.vertices", F.lit(k))[c]
    return rows.select("doc_id", "word_idx", F.col("w.text").alias("text"), v(0, "x").alias("x"), v(1, "x").alias("x_end"), ((v(0, "y") + v(2, "y")) / 2).alias("cy"), (v(2, "y") - v(0, "y")).alias("height"))
