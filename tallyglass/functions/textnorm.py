"""Normalisation of recognised text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyglass.functions import vocab as V
from tallyglass.functions.columns import bound, matches, replaced, rules, stripped, substituted


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def nfc(t: Column) -> Column:
    """Unicode normal form C: the one step that Spark has no function for. Arrow batches; normal text is returned as it is."""
    return F.pandas_udf(_composed, "string")(t)


def digit_like(t: Column) -> Column:
    """Letters that are read for digits, as those digits."""
    return F.translate(t, *V.DIGIT_LIKE)


def confusable_key(t: Column) -> Column:
    """A key that is equal for texts that differ in confusable characters only."""
    return F.translate(t, *V.CONFUSABLE)


def units_fixed(t: Column) -> Column:
    return replaced(t, V.UNIT_FIXES)


def hangul_fixed(t: Column) -> Column:
    return replaced(t, V.HANGUL_FIXES)


@bound
def number_fixpoint(t: Column, rounds: int = V.NUMBER_ROUNDS) -> Column:
    """The number rules again and again until nothing changes, `rounds` times at most. A text without what every rule needs is left as it is."""
    start = F.struct(t.alias("now"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        return F.when(s["done"], s).otherwise(_settling(s["now"], rules(s["now"], V.NUMBER_RULES)))

    ruled = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["now"])
    return F.when(matches(t, V.NUMBER_RULED), ruled).otherwise(t)


@bound
def _settling(now: Column, after: Column) -> Column:
    return F.struct(after.alias("now"), (after == now).alias("done"))


def _common(t: Column) -> Column:
    return _kilo_fixed(units_fixed(digit_like(t)))


@bound
def _kilo_fixed(t: Column) -> Column:
    return F.when(t.rlike("(?iu)k9"), substituted(t, r"\bk9\b", "kg", ignore_case=True)).otherwise(t)


def for_numbers(t: Column) -> Column:
    """NFC text as it is searched for numbers and dates. Letters that look like digits become digits everywhere."""
    return _common(number_fixpoint(_zero_fixed(_one_dot(t, "."))))


@bound
def _one_dot(t: Column, by: str) -> Column:
    return F.when(F.contains(t, F.lit("..")), substituted(t, r"\.{2,}", by)).otherwise(t)


@bound
def _zero_fixed(t: Column) -> Column:
    return F.when(F.contains(t, F.lit(",")), substituted(t, r"(\d),\s*[Oo](\d{2})", "$1,0$2")).otherwise(t)


def for_labels(t: Column) -> Column:
    """NFC text as it is searched for labels: spaced-out and misread labels made whole."""
    return _common(hangul_fixed(_labels_whole(substituted(_one_dot(t, ""), r"\s+", " "))))


@bound
def _labels_whole(t: Column) -> Column:
    """The label rules; none is tried on a text in which no rule matches anything but what it would put there."""
    return F.when(matches(t, "|".join(f"(?!{by}){p}" for p, by in V.LABEL_RULES)), rules(t, V.LABEL_RULES)).otherwise(t)


def general(t: Column) -> Column:
    return _common(t)


@bound
def cleaned_word(t: Column) -> Column:
    """A word of NFC text: trimmed, known misreadings mended, white space collapsed; null if it is noise or empty."""
    t = _mended(stripped(t))
    return F.when((t != "") & ~t.isin(*V.NOISE_WORDS), t)


def cleaned_words(t: Column, mark: str) -> Column:
    """Words of NFC text, set apart by a mark that is no white space, each as cleaned_word() has it, but for noise. No rule reaches across a mark."""
    return _mended(substituted(t, rf"(?<![^{mark}])\s+|\s+(?![^{mark}])"))


def _mended(t: Column) -> Column:
    return substituted(hangul_fixed(t), r"\s+", " ")


def hangul_joined(t: Column) -> Column:
    """Without white space between Hangul."""
    return substituted(t, r"(?<=[가-힣])\s+(?=[가-힣])")


@bound
def comparable(t: Column) -> Column:
    """A cell as it is compared with an answer: no spaces or punctuation, lower case; "None" for null and empty."""
    t = F.regexp_replace(F.lower(F.translate(t, " (),:.-", "")), "^supplier", "")
    return F.when(t.isNull() | t.isin("", "none"), "None").otherwise(t)
