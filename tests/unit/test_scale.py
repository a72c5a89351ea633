"""Steps that must not grow faster than their input: dealing of tables, scoring as compiled columns, labels scored once a chunk."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyglass.functions import quality as Q
from tallyglass.functions import textnorm
from tallyglass.functions import vocab as V
from tallyglass.operators import labels
from tallyglass.plans import adapters, catalog
from tallyglass.sources import ocr


def test_a_file_of_one_row_group_is_dealt_whatever_its_size(spark, tmp_path, monkeypatch):
    pq.write_table(pa.table({"doc_id": list(range(500)), "text": [f"word{i} " * 50 for i in range(500)]}), tmp_path / "documents.parquet", row_group_size=500)
    monkeypatch.setattr(adapters, "TASK_BYTES", 64, raising=False)
    monkeypatch.setattr(adapters, "SMALL", 0, raising=False)  # as a table is read that is larger than that
    rows = adapters.source(spark, str(tmp_path), "documents")
    full = rows.groupBy(F.spark_partition_id()).count().count()
    assert full > 4 * spark.sparkContext.defaultParallelism
    assert rows.count() == 500


def test_scoring_is_not_interpreted(spark):
    rows = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in ocr.RECORD.fields])
    out = Q.scored(rows, F.lit("2025-01-01").cast("date"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("lambdafunction") <= 5  # titles of three lists of issues, severe issues, confidences that are there
    assert set(out.columns) == {f.name for f in ocr.RECORD.fields} | {"field_confidences", "overall_confidence", "issues", "review_priority", "needs_review", "repaired"}


def test_best_labels_are_the_best_of_all_labels(spark):
    texts = [None, "", "a", "Date : 2024, Gros 12 Gross 13", "총 중량: 10 총중량 20 중량", "공차중량 공차 실중량 품명\n거래처 date DATE", "차량번호 차랑번호 x", "날짜 일시 날자 Dat Daet", "--- :: ,,"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    for least in (50.0, 70.0, 80.0):
        got = df.select("i", labels.best_text_labels(F.col("t"), least).alias("b"), labels.text_labels(F.col("t"), least).alias("every"))
        assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
        for r in got.collect():
            want = {}
            for m in r["every"] or []:
                if m["match_score"] > want.get(m["label_type"], ("", -1.0))[1]:
                    want[m["label_type"]] = (m["matched_text"], m["match_score"])
            assert {k: tuple(v) for k, v in r["b"].items()} == want, (least, texts[r["i"]])


def test_number_rules_leave_other_texts_alone_and_run_once_a_round(spark):
    t = F.col("t")
    df = spark.createDataFrame([("총중량 12480 kg, 5010",), (None,), ("",), ("1O2,BB 3l4 x,,y",), ("O",)], "t string")
    out = df.select(textnorm.number_fixpoint(t).alias("n"), textnorm.hangul_fixed(t).alias("h"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("(?Ud),BB") == 1  # each rule stands in the plan once
    assert [r["n"] for r in out.collect()] == ["총중량 12480 kg, 5010", None, "", "102,88 314 x,y", "O"]


def test_no_text_without_the_guards_letters_is_changed_by_a_rule():
    letters = re.compile(V.NUMBER_RULED)
    for pattern, _ in V.NUMBER_RULES:
        literal = re.sub(r"\\[ds]\*?|\[,\.\]|[()]", "", pattern)
        assert letters.search(literal), pattern


def test_rendering_shuffles_documents_and_not_their_words(spark):
    for name in ("layout_render", "line_islands"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1, name  # that which deals the documents
