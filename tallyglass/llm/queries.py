"""The query of each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.llm import chat, decontam, extract, linededup, mixing, mpegts, packing, pii, quality, resampling, simhash, urlfilter, variants
from tallyglass.llm.store import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: 3-word shingles, links at 2 bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a transport stream: digests of what is read back from it."""
    return mpegts.probed(mpegts.stored(table(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, packed into rows of 2,048."""
    return packing.packed(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds 0.8 or more of a benchmark item's 5-word shingles, with the item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urlfilter.judged(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's lines without its site's boilerplate."""
    return linededup.cleaned_pages(table(spark, sf_dir, "pages"))


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract.extracted(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labels of rows that are not held out."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.formatted(rows.unionByName(more)))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight for the benchmark's texts, and its rank in a draw of a quarter of them."""
    found = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, usual form and root."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts by kind, spans and a digest of the base ones."""
    return pii.summarised(pii.personal_data(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mpegts": op2_mpegts,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_mixing": op6_mixing,
    "op7_line_dedup": op7_line_dedup,
    "op8_extraction": op8_extraction,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
    "op11_resampling": op11_resampling,
    "op12_variants": op12_variants,
    "op13_pii": op13_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": decontam.SQL,
    "op5_url_filter": urlfilter.SQL,
    "op6_mixing": mixing.SQL,
    "op7_line_dedup": linededup.SQL,
}
