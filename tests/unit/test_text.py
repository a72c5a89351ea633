import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyglass.functions import extract as X
from tallyglass.functions import textnorm as N
from tallyglass.functions.similarity import best_score, folded, label_rows, ratio


def values(spark, texts, *columns):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)]).orderBy("i").collect()
    return [r["c0"] if len(columns) == 1 else tuple(r)[1:] for r in rows]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratio_is_the_indel_ratio(spark):
    labels = ["차량번호", "품명", "gross weight", "a", "aab", "번호번호"]
    texts = ["", "차변번호", "차량", "grossweight", "aa", "baab", "번호", "xyz", "품 명"]
    for label in labels:
        got = values(spark, texts, ratio(F.col("t"), F.element_at(label_rows([label], fold=False), 1)))
        assert got == pytest.approx([200 * lcs(t, label) / (len(t) + len(label)) for t in texts])


def test_label_scores(spark):
    got = values(spark, ["계량 번호:", "Gros", "날자", "x", "차 량No"], best_score(folded(F.col("t")), F.lit(9), label_rows(["계량번호", "Gross", "날짜", "차량No"]), 60.0))
    assert got == [100.0, pytest.approx(800 / 9), None, None, 100.0]


def test_number_text(spark):
    texts = ["1O5", "25, O00 kg", "2O26..02..06", "1l5 I2B", "3,4BO k9", "total", "", None, "ID-NO 12"]
    assert values(spark, texts, N.for_numbers(F.col("t"))) == ["105", "25,000 kg", "2026.02.06", "115 128", "3,480 kg", "t0ta1", "", None, "10-N0 12"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="0123456789OolIBS,. kg", max_size=20), min_size=1, max_size=20))
def test_number_rules_settle(spark, texts):
    once = values(spark, texts, N.number_fixpoint(F.col("t")))
    assert values(spark, once, N.number_fixpoint(F.col("t"))) == once


def test_label_text(spark):
    texts = ["거 래 쳐 : a", "샹   호", "품 .. 면", "충 중 량 / 실 충 량", "차 번 호", "경 위 도", None]
    assert values(spark, texts, N.for_labels(F.col("t"))) == ["거래처 : a", "상호", "품명", "총중량 / 실중량", "차량번호", "GP5", None]


def test_words_are_cleaned_and_composed(spark):
    loose = unicodedata.normalize("NFD", "차량번호")
    assert values(spark, [loose, "　 a  b ", "unle", "  ", "샹 호", None], N.cleaned_word(N.nfc(F.col("t")))) == ["차량번호", "a b", None, None, "상호", None]


def test_dates(spark):
    texts = ["2026-Feb-2", "26.2.3", "2026, 02. 01", "2O26-O2-O3", "12.34.56", "2026..02..06", "none", None, "2026-Xyz-01 26/1/9"]
    assert values(spark, texts, X.date(F.col("t"), N.for_numbers(X.single_dots(F.col("t"))))) == ["2026-02-02", "2026-02-03", "2026-02-01", "2026-02-03", "2012-34-56", "2026-02-06", None, None, "2026-01-09"]


def test_plates(spark):
    texts = ["경기 12가3456", "12 가 3456", "9l구1234", "02-1234", "임시 12345", "서울123-456", "56바7B9O", "AB-1234", "no"]
    assert values(spark, texts, X.vehicle(F.col("t"), N.for_numbers(F.col("t")))) == ["경기12가3456", "12가3456", "91구1234", "02-1234", "임시12345", "서울123-456", "56바7890", None, None]
    assert values(spark, ["2024 8713", "-1234 5678-", "x"], X.bare_plate(F.col("t"))) == ["8713", None, None]
    assert values(spark, ["상80구8713", "차량 번호 98바1234"], X.plate_cleaned(F.col("t"))) == ["80구8713", "98바1234"]


def test_coordinates_and_phones(spark):
    got = values(spark, ["37.1234, 127.5678", "N37,12345 E127,54321", "127.12345 x 37.54321 y", "12.3456 88.1234", ""], X.gps(F.col("t")))
    assert [g and tuple(g) for g in got] == [(37.1234, 127.5678), (37.12345, 127.54321), (37.54321, 127.12345), None, None]
    assert values(spark, ["010-1234-5678 031)123-4567", "010.123.4567", "none"], X.phone(F.col("t"))) == ["031-123-4567", "010-123-4567", None]


def test_companies_and_issuers(spark):
    texts = ["상호 : 청정 그린 품명: 폐지", "대한 귀하", "(주)에코월드 TEL", "그린환경 (주)", "k9(주)", "a b c d e 귀하", "보관용 귀하", None]
    assert values(spark, texts, X.company(F.col("t"))) == ["청정그린", "대한", "(주)에코월드", "그린환경(주)", None, None, None, None]
    assert values(spark, ["(주)한국\n그린(주)", "(주)\n서울(주)", "no"], X.issuer(F.col("t"), F.lit("(주) 한국"))) == ["그린(주)", None, None]


def test_tickets(spark):
    def of(text, plate):
        t = F.lit(text)
        return X.ticket_id(t, N.for_numbers(t), F.lit(plate).cast("string"))

    got = values(spark, [""], of("계량번호: 26-0206-003", None), of("No. 8713", "8713"), of("번호 12가3456 일련번호: 0012", "12가3456"), of("2026-02-03 0012", None), of("2026-02-03 14:30", None), of("전 표 N0. 1", None))
    assert got == [("26-0206-003", None, "0012", "0012", None, None)]


def test_products_types_addresses(spark):
    texts = ["품명: 혼 합 폐 기 물 (1)", "제 품 : 플라스틱 PE\n", "품명 총중량", "품목 고철 구분"]
    assert values(spark, texts, X.product(F.col("t"))) == ["혼합폐기물", "플라스틱 PE", None, "고철"]
    assert values(spark, ["국판구분출", "폐지 입 고", "Plastic PE"], X.product_cleaned(F.col("t"))) == ["국판", "폐지", "Plastic PE"]
    assert values(spark, ["12:30", "2026-01-02", "1,200 kg", "a", "고철"], X.valid_product(F.col("t"))) == [False, False, False, False, True]
    assert values(spark, ["구분: 입 고", "출고", "입고 출고", None], X.kind(F.col("t"))) == ["입고", "출고", None, None]
    assert values(spark, ["주소 경기도 용인시 처인구 1 TEL 1", "서울 중구 을지로 2026-01", "부산시"], X.address(F.col("t"))) == ["경기도 용인시 처인구 1", "서울 중구 을지로", None]


def test_labels_behind_values(spark):
    assert values(spark, ["대한품명", "대한품랑", "품명", "태양건설", None], X.trailing_label_cut(F.col("t"))) == ["대한", "대한", "", "태양건설", None]
    assert values(spark, ["품 명:", "제품A", "제품AB"], X.label_noise(F.col("t"))) == [True, True, False]
