"""Site-relative line frequency: lines that recur on too large a part of a host's pages are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.store import looked_up, saved
from tallyglass.llm.urlfilter import host_of

#: A line is boilerplate if it stands on more than this share of a host's pages; hosts of fewer pages are left alone.
RATIO, LEAST_PAGES = 0.3, 4


def html_lines(html: Column) -> Column:
    """The trimmed, non-empty lines of a page: scripts, styles and comments go (to the page's end where they are not closed, so no end is looked for
    twice), block tags and breaks end a line, other tags go, white space becomes one space."""
    text = F.regexp_replace(html, r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)", "")
    text = F.regexp_replace(text, r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>", "\n")
    text = F.regexp_replace(text, r"<[^<>]*>", "")
    return text_lines(text)


def text_lines(text: Column) -> Column:
    """The trimmed, non-empty lines of a text; white space inside a line becomes one space. Null has none."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\n")
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return F.filter(lines, lambda x: x != "")


def without_boilerplate(rows: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """rows (id, host, lines: array<string>) with `kept` (lines that stay, in order) and `dropped` (how many went).

    A line goes if the host has `least_pages` rows or more and the line stands on more than `ratio` of them, however often
    on each. Null and empty hosts are one host each; null lines count as none and null elements stay; repeated rows count as pages of their
    own. A host's boilerplate has at most (mean lines of a page / ratio) lines, which bounds the list that is joined to
    its pages; counts are combined before each shuffle, so a host with most of the rows is no single task's work. An empty
    table gives no rows.
    """
    rows = rows.select("id", "host", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    site = F.coalesce(F.concat(F.lit("h"), "host"), F.lit("n"))
    marks = F.array_distinct(F.transform(F.filter("lines", lambda x: x.isNotNull()), lambda x: F.md5(x)))
    marked = saved(rows.select("id", "host", "lines", site.alias("site"), marks.alias("marks")), "lines")
    pages = marked.groupBy("site").agg(F.count("*").alias("pages"))
    counts = marked.select("site", F.explode("marks").alias("mark")).groupBy("site", "mark").agg(F.count("*").alias("n"))
    common = counts.where("n > 1" if least_pages > 1 else "true").join(pages, "site").where((F.col("pages") >= least_pages) & (F.col("n") > F.col("pages") * ratio))
    lists = saved(common.groupBy("site").agg(F.collect_list("mark").alias("common")), "common")
    joined = looked_up(marked.select("id", "host", "lines", "site"), lists, "site", ["id", "lines"])
    kept = F.when(F.col("common").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: x.isNull() | ~F.array_contains("common", F.md5(x))))
    return joined.select("id", "host", kept.alias("kept"), (F.size("lines") - F.size(kept)).cast("long").alias("dropped"))


def cleaned_pages(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, host, text, n_lines, n_dropped) for each row of pages (page_id, url, html): the page's lines less its
    site's boilerplate, one a line."""
    rows = pages.select(F.col("page_id").alias("id"), host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines"))
    out = without_boilerplate(rows, ratio, least_pages)
    return out.select(F.col("id").alias("page_id"), "host", F.array_join("kept", "\n").alias("text"), (F.size("kept") + F.col("dropped")).cast("long").alias("n_lines"), F.col("dropped").alias("n_dropped"))


SQL = rf"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS row,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', '', 'gis'),
      '</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^<>]*>', chr(10), 'gi'),
      '<[^<>]*>', '', 'g') AS text
  FROM pages),
l AS (SELECT row, host, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM p),
t AS (SELECT row, host, pos, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l),
n AS (SELECT host, line, count(DISTINCT row) AS n FROM t WHERE line <> '' GROUP BY host, line),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
common AS (SELECT n.host, n.line FROM n JOIN h USING (host) WHERE pages >= {LEAST_PAGES} AND n.n > pages * {RATIO}),
k AS (SELECT t.row, t.pos, t.line, common.line IS NOT NULL AS gone FROM t LEFT JOIN common USING (host, line) WHERE t.line <> ''),
g AS (SELECT row, string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped FROM k GROUP BY row)
SELECT p.page_id, p.host, coalesce(g.text, '') AS text, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped FROM p LEFT JOIN g USING (row)
"""
