import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.functions import quality as Q
from tallyglass.functions import vocab as V
from tallyglass.operators import evaluate, review
from tallyglass.plans.documents import Options, scored
from tallyglass.sources import ocr, sinks

BASE = {"date": "2024-05-01", "vehicle_num": "12가3456", "total_weight": 12480, "tare_weight": 7470, "net_weight": 5010, "company": "대한산업"}
SCHEMA = T.StructType([T.StructField("doc_id", T.StringType()), *ocr.RECORD.fields])


def frame(spark, *changes):
    rows = []
    for i, c in enumerate(changes):
        r = BASE | c
        rows.append((str(i), *[r.get(f) for f in V.FIELDS]))
    return spark.createDataFrame(rows, SCHEMA)


def score(spark, *changes):
    return scored(frame(spark, *changes), Options(as_of="2025-01-01")).orderBy(F.col("doc_id").cast("int")).collect()


def test_scores(spark):
    cases = [
        ({}, 100.0, "NONE"), ({"vehicle_num": "8713"}, 96.88, "NONE"), ({"company": None}, 93.75, "NONE"), ({"company": None, "vehicle_num": "8713"}, 90.62, "NONE"),
        ({"date": None, "vehicle_num": "8713"}, 81.25, "LOW"), ({"company": None, "vehicle_num": "AB-1234"}, 87.5, "LOW"), ({"total_weight": 25000, "tare_weight": 11500, "net_weight": 13500}, 98.83, "NONE"),
        (dict.fromkeys(BASE), 0.0, "CRITICAL"), ({"date": "2024-02-30"}, 89.06, "HIGH"), ({"date": "2019-01-01"}, 95.31, "HIGH"), ({"vehicle_num": "2024"}, 92.19, "NONE"), ({"date": "2025-06-01"}, 96.88, "NONE"),
        ({"date": "5/1/24"}, 92.19, "NONE"),
    ]
    got = score(spark, *[c for c, _, _ in cases])
    assert [(r["overall_confidence"], r["review_priority"]) for r in got] == [(a, b) for _, a, b in cases]
    assert [r["needs_review"] for r in got] == [p not in ("NONE", "LOW") for _, _, p in cases]
    assert set(got[7]["field_confidences"]) == {"date", "vehicle_num", "company"}


def test_repairs_and_issues(spark):
    r = score(spark, {"net_weight": 6000}, {"total_weight": 900}, {"net_weight": 0})
    assert (r[0]["net_weight"], r[0]["repaired"], r[0]["issues"]) == (5010, True, ["방정식 불만족: 12480 ≠ 7470 + 6000 (오차: 990kg)"])
    assert r[1]["review_priority"] == "HIGH" and r[1]["issues"][0] == "총중량 범위 초과: 900kg" and "논리 오류: 공차중량 ≥ 총중량" in r[1]["issues"]
    assert (r[2]["repaired"], r[2]["net_weight"]) == (False, 0) and "net_weight" not in r[2]["field_confidences"]


@pytest.mark.parametrize(("value", "unit", "ok"), [(99, True, False), (100, False, True), (100_000, False, True), (100_001, True, False), (2024, False, False), (2024, True, False), (2050, False, False), (2050, True, True), (None, True, False)])
def test_weight_values(spark, value, unit, ok):
    assert spark.range(1).select(Q.valid_weight(F.lit(value).cast("int"), F.lit(unit))).first()[0] is ok


def test_orders_of_a_triplet(spark):
    rows = spark.createDataFrame([(12480, 7470, 5010), (5010, 12480, 7470), (7470, 5010, 12480), (1, 2, 3), (900, 600, 300), (None, 1, 2)], "a int, b int, c int")
    got = [r[0] and tuple(r[0]) for r in rows.select(Q.assigned(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [(12480, 7470, 5010), (12480, 5010, 7470), (12480, 7470, 5010), None, (900, 600, 300), None]


def test_buckets_and_summary(spark):
    s = scored(frame(spark, {}, {"net_weight": 6000, "company": None, "vehicle_num": "x"}, {"company": None, "vehicle_num": "x"}, {"date": "2019-01-01"}, dict.fromkeys(BASE)), Options(as_of="2025-01-01"))
    got = {r["doc_id"]: r["bucket"] for r in review.buckets(s).collect()}
    assert got == {"0": "passed", "1": "auto_fixed", "2": "failed", "3": "needs_review", "4": "failed"}
    one = review.summary(s).first()
    assert (one["total"], one["priority_none"], one["priority_low"], one["priority_high"], one["priority_critical"], one["auto_repaired_count"]) == (5, 1, 2, 1, 1, 1)
    empty = review.summary(s.limit(0)).first()
    assert (empty["total"], empty["average_confidence"], empty["priority_medium"]) == (0, 0.0, 0)


def test_duplicates_and_reconciliation(spark):
    df = frame(spark, {"ticket_id": " 12가3456"}, {"tare_weight": 5010})
    assert sorted(tuple(r) for r in review.duplicates(df).collect()) == [("0", "vehicle_num", "ticket_id", "12가3456"), ("1", "tare_weight", "net_weight", "5010")]
    rows = spark.createDataFrame([("12,480", "7470", "5010"), ("1", "x", "2"), ("10", "4", None), ("10", "4", "5")], "a string, b string, c string")
    assert [tuple(r[0]) for r in rows.select(review.reconciled(F.col("a"), F.col("b"), F.col("c"))).collect()] == [(5010, None, "match"), (None, None, "incomplete"), (6, None, "net_missing"), (6, -1, "mismatch")]


MD = "# x\n## sample_01.json\n| 필드 | 정답 |\n|---|---|\n| date | 2024.05.01 |\n| total_weight | 12,480 |\n| company | - |\n---\n## sample_02_noisy.json\r\n| gps | raw | 37.1, 127.2 |\n---\nnothing | here"


def test_answer_files(spark, tmp_path):
    (tmp_path / "answer.md").write_text(MD, encoding="utf-8")
    assert ocr.answers(spark, str(tmp_path / "answer.md")).count() == 4


def test_answers_and_match_rate(spark):
    a = ocr.answer_rows(spark.createDataFrame([(MD,)], "md string"), "md")
    assert sorted(tuple(r) for r in a.collect()) == [("sample_01", "company", None), ("sample_01", "date", "2024.05.01"), ("sample_01", "total_weight", "12480"), ("sample_02_noisy", "gps", "37.1, 127.2")]
    cells = evaluate.cells(frame(spark, {}).withColumn("sample", F.lit("sample_01")), "sample")
    c = evaluate.compared(cells, a)
    assert {r["field"]: r["matched"] for r in c.collect()} == {"date": True, "total_weight": True, "company": False}
    assert tuple(evaluate.match_rate(c).first()) == (2, 3, pytest.approx(200 / 3))
    assert tuple(evaluate.match_rate(c.limit(0)).first()) == (0, 0, 0.0)
    assert all(len(r["line"].split(" | ")) == 5 for r in evaluate.report(c).collect())


def test_rates(spark):
    df = frame(spark, {}, {"company": "", "net_weight": 0})
    got = {r["field"]: (r["found"], r["total"]) for r in evaluate.extraction_rates(df).collect()}
    assert got["company"] == (1, 2) and got["net_weight"] == (1, 2) and got["date"] == (2, 2) and got["gps"] == (0, 2)
    assert tuple(evaluate.equation_rate(df).first()) == (1, 1, 1.0)


def test_sinks(spark, tmp_path):
    df = frame(spark, {"gps": (37.1, 127.2)})
    r = sinks.per_document_json(df).first()
    assert r["name"] == "0_result.json" and r["json"].startswith('{"date":"2024-05-01"') and '\\"latitude\\":37.1' in r["json"] and '"phone":""' in r["json"]
    sinks.write_results(df, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    sinks.write_report(df.select(F.lit("a").alias("line")), str(tmp_path / "t"))
    assert [x["value"] for x in spark.read.text(str(tmp_path / "t")).collect()] == ["a"]
