"""URL rules by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyglass.llm.store import small

#: Hex digits of a digest that rules and URLs are first joined on.
SHORT = 8

#: (host, path, verdict) rules of the production query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: The verdict where no rule fits.
DEFAULT = "allow"


def _lower(t: Column) -> Column:
    """With A-Z, and no other letters, lower-cased."""
    return F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark, rules=RULES) -> DataFrame:
    """(rule_host, rule_path, rule_verdict). Rules fit their host and its subdomains where the path starts with theirs."""
    one = [F.struct(*[F.lit(v).cast("string").alias(c) for v, c in zip(r, ("rule_host", "rule_path", "rule_verdict"), strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*one)))


def judged(urls: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Each row of urls (page_id, url) with host, path, rule (host and path; null if none fits) and verdict.

    Expressions are the host's suffixes and the path's prefixes of the pairs of sizes (labels, characters) that rules have; only these can equal
    a rule. Short digests are joined, full ones confirmed, and the longest rule wins (ties: blocks before allows, then the least in order).
    Rules' hosts are compared with A-Z lower-cased; a null path is an empty one; rules without a host or verdict fit nothing. Null or malformed URLs fit no rule; an empty
    path starts with no rule's path but an empty one; repeated rows are judged each by itself; without rules all
    get the default. Other columns are not read. The pairs of sizes are one literal of two numbers each, which URLs' lengths bound.
    """
    rules = rules.select(_lower(F.col("rule_host")).alias("rule_host"), F.coalesce("rule_path", F.lit("")).alias("rule_path"), "rule_verdict").where("rule_host IS NOT NULL AND rule_verdict IS NOT NULL")
    rules = rules.select("*", F.concat("rule_host", "rule_path").alias("rule"), F.sha2(F.concat_ws("\x00", "rule_host", "rule_path"), 256).alias("digest"))
    sizes = rules.select(F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("characters")).distinct().orderBy("labels", "characters").collect()
    rows = urls.select("page_id", F.monotonically_increasing_id().alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not sizes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    rows = rows.withColumn("labels", F.split("host", r"\."))
    asked = F.from_json(F.lit(json.dumps([r.asDict() for r in sizes])), "array<struct<labels:int,characters:int>>")
    asked = F.filter(asked, lambda s: (F.size("labels") >= s["labels"]) & (F.length("path") >= s["characters"]))

    def expression(s: Column) -> Column:
        suffix = F.array_join(F.slice("labels", F.size("labels") - s["labels"] + 1, s["labels"]), ".")
        return F.sha2(F.concat_ws("\x00", suffix, F.substring("path", F.lit(1), s["characters"])), 256)

    asked = rows.select("page_id", "row", "host", "path", F.explode_outer(F.transform(asked, expression)).alias("asked"))
    asked = asked.withColumn("short", F.substring("asked", 1, SHORT))
    rules = small(rules.withColumn("short", F.substring("digest", 1, SHORT)))
    fits = asked.join(rules, "short", "left").withColumn("fits", F.coalesce(F.col("asked") == F.col("digest"), F.lit(False)))
    best = F.min(F.when(F.col("fits"), F.struct((-F.length("rule")).alias("n"), (F.col("rule_verdict") != "block").alias("mild"), F.col("rule"), F.col("rule_verdict"))))
    out = fits.groupBy("page_id", "row", "host", "path").agg(best.alias("best"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


SQL = """
WITH u AS (
  SELECT page_id, row_number() OVER () AS row,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
ranked AS (
  SELECT u.page_id, u.host, u.path, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
  FROM u LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM ranked WHERE place = 1
"""
