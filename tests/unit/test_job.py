import json

from tallyglass import __main__ as job


def page(*texts):
    corners = lambda y, x: [{"x": x, "y": y}, {"x": x + 90, "y": y}, {"x": x + 90, "y": y + 20}, {"x": x, "y": y + 20}]
    return {"pages": [{"text": " ".join(texts), "words": [{"text": t, "confidence": 0.9, "boundingBox": {"vertices": corners(40.0 * (i // 2), 10.0 + 100 * (i % 2))}} for i, t in enumerate(texts)]}]}


def test_files_to_records_and_a_summary(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.json").write_text(json.dumps(page("날짜:", "2026-02-03", "차량번호:", "80구8713", "총중량:", "12480", "공차중량:", "7470", "실중량:", "5010")), encoding="utf-8")
    (source / "bad.json").write_text("{not json", encoding="utf-8")
    found = job.run(spark, str(source), str(tmp_path / "out"), as_of="2026-06-01")
    rows = spark.read.parquet(str(tmp_path / "out" / "records")).collect()
    assert [(r["doc_id"], r["date"], r["vehicle_num"], r["total_weight"], r["tare_weight"], r["net_weight"]) for r in rows] == [("one", "2026-02-03", "80구8713", 12480, 7470, 5010)]
    assert spark.read.parquet(str(tmp_path / "out" / "broken")).count() == 1 and found["total"] == 1


def test_texts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "t.txt").write_text("날짜: 2026-02-03\n차량번호: 80구8713\n", encoding="utf-8")
    job.run(spark, str(source), str(tmp_path / "out"), kind="text", as_of="2026-06-01")
    assert [r["date"] for r in spark.read.parquet(str(tmp_path / "out" / "records")).collect()] == ["2026-02-03"]
