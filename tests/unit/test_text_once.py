"""F2, F3, box_route, text_route: a text is searched once for a match, whose parts are read from the match; rules are tried only where one matches; results stay."""

import itertools

from pyspark.sql import functions as F

from tallyglass.functions import extract as X
from tallyglass.functions import textnorm as N
from tallyglass.functions import vocab as V
from tallyglass.functions.columns import all_found, found, rules
from tallyglass.functions.quality import assigned
from tallyglass.operators import weights

TEXTS = ["TEL 031-123-4567 010-222-3333", "0l0-12 02) 555-1234", "2026-02-03 26.1.5", "26. 1. 5", "23,4BO 2O26 5S", "GPS TEL 37.1", "번호: 10 전표 A-12345", "품면 : 고철", "상 호 품명 충 중 량", "a..b k9 K9 12,, O00", "총중량 품명 날짜 구분 상호", ""]


def test_a_text_is_searched_once_for_phones_and_slips(spark):
    plan = spark.range(1).select(F.lit("x").alias("text")).select(X.phone(F.col("text")).alias("p"), X.ticket_id(F.col("text"), F.col("text"), F.col("text")).alias("s"))
    tree = plan._jdf.queryExecution().analyzed().toString()
    assert tree.count("regexp_extract_all(") == 2


def test_parts_of_a_match_are_those_of_the_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    t = F.col("text")
    for p, groups in ((V.PHONE, 3), (V.TICKET, 2), (V.DATE_NUMERIC, 3)):
        for k in range(1, groups + 1):
            whole = all_found(t, p, k, ignore_case=p is V.TICKET)
            parts = F.transform(all_found(t, p, 0, ignore_case=p is V.TICKET), lambda m: F.coalesce(found(m, p, k, ignore_case=p is V.TICKET), F.lit("")))
            assert df.where(whole != parts).count() == 0


def test_rules_that_match_nothing_are_left_out_alone(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    t = F.col("text")
    assert df.where((rules(t, V.NUMBER_RULES) != t) & ~t.rlike("(?Ud)" + V.NUMBER_RULED)).count() == 0
    assert df.where(N._labels_whole(t) != rules(t, V.LABEL_RULES)).count() == 0


def test_falling_values_are_assigned_alike(spark):
    some = [100, 500, 520, 1000, 1040, 1500, 2000, 99000, 100000]
    rows = [c for c in itertools.product(sorted(some, reverse=True), repeat=3) if c[0] >= c[1] >= c[2]]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    args = [F.col(c) for c in "abc"]
    assert df.where(~weights._falling(*args).eqNullSafe(assigned(*args))).count() == 0
