import json

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import labels, spatial, weights, words
from tallyglass.plans.documents import Options, parsed
from tallyglass.sources import ocr
from tallyglass.streaming import documents as stream

OPTIONS = Options(as_of="2025-01-01")


def box(x0, y0, x1, y1):
    return {"vertices": [{"x": x0, "y": y0}, {"x": x1, "y": y0}, {"x": x1, "y": y1}, {"x": x0, "y": y1}]}


def page(rows, **more):
    """rows: lines of (text, x0, x1)."""
    return {"pages": [{"words": [{"text": t, "confidence": 0.9, "boundingBox": box(a, 60 * k, b, 60 * k + 20)} for k, line in enumerate(rows) for t, a, b in line], **more}]}


ENGLISH = page([
    [("WEIGHT", 10, 90), ("TICKET", 100, 180)], [("Date", 10, 60), (":", 65, 70), ("2024-Mar-7", 80, 180)], [("Truck", 10, 70), ("No", 80, 110), ("CD-4321", 130, 230)],
    [("Gross", 10, 80), ("30,250", 100, 170), ("kg", 180, 200)], [("Tare", 10, 60), ("11,050", 100, 170), ("kg", 180, 200)], [("Net", 10, 50), ("19,200", 100, 170), ("kg", 180, 200)], [],
    [("Supplier", 10, 100), (":", 110, 115), ("Northern", 120, 210), ("Metals", 220, 290), ("Inc.", 300, 340)],
])
TONNES = page([
    [("차변번호", 10, 100), ("서울", 110, 150), ("88", 155, 180), ("다", 185, 200), ("4321", 205, 260)], [("날짜", 10, 60), ("24.03.07", 80, 170)],
    [("총중량", 10, 90), ("31.50", 110, 170), ("ton", 180, 210)], [("공차중량", 10, 95), ("12.20", 110, 170), ("t", 180, 190)], [("실중량", 10, 90), ("19.30", 110, 170)],
])
DOTS = page([
    [("ID-NO", 10, 80), ("24-0307-009", 90, 200)], [("상 호", 10, 60), (":", 65, 70), ("(주) 하..늘산업", 80, 200)], [("품 명", 10, 60), ("혼 합 고 철", 80, 180)], [("차량 번호", 10, 90), ("77바4321", 100, 190)],
    [("총 중 량", 10, 90), ("31, O00", 110, 190), ("k g", 200, 220)], [("공차 중량", 10, 90), ("12. 500", 110, 190), ("k9", 200, 220)], [("실 중 량", 10, 90), ("18,500", 110, 190), ("kg", 200, 220)], [("2024.03.07", 10, 120)],
])
NOISY = {"pages": [{"text": "계 량 표\n날짜: 2O24-O3-O7\n차량번호 77바4B21\n거 래 처 : 푸른자원 품명: 폐지\n총중량 31,4BO kg\n공차중량 12,250 kg\n실중량 19,230 kg\n구 분 : 입 고\nGPS 36.l2345, l27.54321\nTEL 042-123-4567\n(주)한빛환경", "words": [{"text": "계"}]}]}
EDGES = {"pages": [{"words": [{"text": ""}, {"text": "a"}, {"text": "b", "boundingBox": {"vertices": [{"x": 1, "y": 1}]}}, {"text": "only", "boundingBox": box(1, 1, 5, 5)}]}, {"words": [{"text": "77바4321", "boundingBox": box(0, 0, 9, 9)}]}]}


def write(folder, **docs):
    for name, d in docs.items():
        (folder / f"{name}.json").write_text(d if isinstance(d, str) else json.dumps(d, ensure_ascii=False, indent=2), encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    folder = write(tmp_path_factory.mktemp("docs"), english=ENGLISH, tonnes=TONNES, dots=DOTS, noisy=NOISY, edges=EDGES, none={"pages": []}, bare={}, blank={"pages": [{"text": ""}]}, broken='{"pages": [')
    docs = ocr.documents(spark, folder)
    assert [r["doc_id"] for r in ocr.broken(docs).collect()] == ["broken"]
    return {r["doc_id"]: r.asDict(recursive=True) for r in parsed(ocr.valid(docs), OPTIONS).collect()}


def some(record, *names):
    return tuple(record[n] for n in names)


def test_english_boxes(records):
    r = records["english"]
    assert some(r, "date", "vehicle_num", "total_weight", "tare_weight", "net_weight") == ("2024-03-07", "CD-4321", 30250, 11050, 19200)
    assert some(r, "company", "issuer", "parser_method") == (None, "Supplier : Northern Metals Inc.", None)


def test_tonnes_and_split_plates(records):
    assert some(records["tonnes"], "date", "vehicle_num", "total_weight", "tare_weight", "net_weight") == ("2024-03-07", "서울88다4321", 31500, 12200, 19300)


def test_dots_and_spaces(records):
    r = records["dots"]
    assert some(r, "date", "vehicle_num", "total_weight", "tare_weight", "net_weight") == ("2024-03-07", "77바4321", 31000, 12500, 18500)
    assert some(r, "company", "product", "ticket_id", "issuer") == ("(주)하늘산업", "혼합고철", "24-0307-009", None)


def test_noisy_text(records):
    r = records["noisy"]
    assert some(r, "date", "vehicle_num", "total_weight", "tare_weight", "net_weight") == ("2024-03-07", "77바4821", 31480, 19230, 12250)
    assert some(r, "company", "issuer", "product", "type", "phone") == ("푸른자원", "(주)한빛환경", "폐지", "입고", "042-123-4567")
    assert r["gps"] == {"latitude": 36.12345, "longitude": 127.54321} and r["parser_method"] == "text_fallback_heuristic"


def test_unusable_documents_are_empty_records(records):
    for name in ("none", "bare", "blank", "edges"):
        assert all(records[name][f] is None for f in ("date", "vehicle_num", "total_weight", "company", "issuer", "product"))
        assert records[name]["review_priority"] == "CRITICAL" and records[name]["parser_method"] is None
    assert len(records) == 8


def test_words_of_a_page(spark, tmp_path):
    docs = ocr.valid(ocr.documents(spark, write(tmp_path, edges=EDGES, dots=DOTS)))
    w = words.exploded(docs.select("doc_id", words.boxed(F.col("page")).alias("words"))).collect()
    assert [(r["word_idx"], r["text"]) for r in w if r["doc_id"] == "edges"] == [(0, "only")]
    assert [r["word_idx"] for r in w if r["doc_id"] == "dots"] == list(range(19))


def of(rows):
    return F.array(*[words.word(F.lit(t), *[F.lit(float(v)) for v in b], F.lit(0.5), F.lit(i)) for i, (t, *b) in enumerate(rows)])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_layout_of_no_words(spark):
    assert tuple(one(spark, words.layout(F.filter(of([("a", 0, 0, 1, 1)]), lambda w: w["i"] > 5)))) == (10.0, 20.0, 5.0, 1000.0, 1000.0)


def test_competing_triplets(spark):
    found = F.array(*[F.struct(F.lit(v).cast("bigint").alias("value"), F.lit(i).alias("i"), F.lit(float(i)).alias("cy")) for i, v in enumerate((8713, 1234, 5678, 12480, 7470, 5010))])
    assert tuple(one(spark, weights.by_equation(found))) == (12480, 7470, 5010)
    assert one(spark, weights.by_order(found)) is None


def test_candidates_take_units_from_near_words(spark):
    w = of([("99", 0, 0, 1, 1), ("12:30", 0, 0, 1, 1), ("24.50", 0, 0, 1, 1), ("ton", 0, 0, 1, 1), ("24.500", 0, 0, 1, 1), ("1,200kg", 0, 0, 1, 1)] + [("x", 0, 0, 1, 1)] * 11 + [("24.500", 0, 0, 1, 1), ("150", 0, 0, 1, 1)])
    got = [(c["i"], c["value"]) for c in one(spark, weights.candidates(w))]
    assert got == [(0, 99000), (1, 12000), (1, 30000), (2, 24500), (5, 1200), (18, 150)]


def test_labels_and_neighbours(spark):
    w = of([("차량", 0, 0, 40, 20), ("번호:", 50, 0, 90, 20), ("12가", 100, 2, 140, 22), ("3456", 145, 1, 200, 21), ("far", 900, 0, 950, 20), ("under", 0, 40, 50, 60)])
    df = spark.range(1).select(w.alias("w")).withColumn("runs", labels.field_runs(F.col("w"), "vehicle"))
    row = df.select("runs.vehicle", spatial.neighbours(labels.field_label(F.col("w"), F.col("runs"), "vehicle"), F.col("w"), 150.0).alias("near")).first()
    run, near = row["vehicle"], row["near"]
    assert (run["score"], run["i"], run["j"], run["text"]) == (100.0, 1, 0, "번호")
    assert [n["text"] for n in near][:2] == ["12가", "3456"] and "far" not in [n["text"] for n in near]


def test_line_around_an_anchor(spark):
    w = of([("(주)", 100, 0, 140, 20), ("한", 150, 0, 170, 20), ("빛", 180, 0, 200, 20), ("TEL", 210, 0, 240, 20), ("left", -200, 0, -150, 20), ("other", 100, 80, 150, 100)])
    assert one(spark, spatial.along_line(w, F.element_at(w, 2))) == "(주) 한빛"


def test_rendering(spark, tmp_path):
    docs = ocr.valid(ocr.documents(spark, write(tmp_path, d=page([[("a", 24, 36), ("b", 60, 70)], [("c", 0, 10), ("d", 5, 9)]]))))
    assert words.rendered(words.corner_words(docs, F.col("page"))).first()["rendered"] == "  a  b\ncd"


def test_stream_gives_the_same_records(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder, tonnes=TONNES, noisy=NOISY)
    q = stream.write(stream.records(stream.documents(spark, str(folder)), OPTIONS).select("doc_id", "date", "total_weight", "vehicle_num"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("noisy", "2024-03-07", 31480, "77바4821"), ("tonnes", "2024-03-07", 31500, "서울88다4321")]


def test_switches(spark, tmp_path):
    docs = ocr.valid(ocr.documents(spark, write(tmp_path, t=TONNES)))
    r = parsed(docs, Options(extract=False, score=False)).first()
    assert r["date"] is None and "review_priority" not in r.asDict()
