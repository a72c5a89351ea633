import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=""):
        return spark.createDataFrame([(*r, *([None] * (5 - len(r)))) if len(r) < 5 else r for r in rows], DOCS + extra)

    return make


@pytest.fixture(scope="session")
def edge_docs(make_docs):
    """Nulls, empty and long texts, ties, repeated rows."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    return make_docs([
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "  \t\n", "en", None, 4), (4, "one", "en", "b", 3), (5, "one two", None, "b", 7),
        (6, long_text, "en", "a", len(long_text)), (7, long_text + " tail", "en", "a", len(long_text) + 5), (8, "one", "en", "b", 3), (8, "one", "en", "b", 3),
        (None, "some text without an id here", "en", "c", 28), (9, "x" * 5_000, "en", "c", 5_000), (10, "naïve café ☃ 日本語 \U0001f600 text", "fr", "c", 30),
    ])


@pytest.fixture(scope="session")
def clash(edge_docs):
    """Extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return edge_docs.withColumns({c: F.lit(1) for c in ("fp", "key", "row", "mix_id", "n", "a.b", "sha", "component_id", "size", "at", "x", "score")})


@pytest.fixture(scope="session")
def no_docs(make_docs, spark):
    return spark.createDataFrame([], DOCS)
