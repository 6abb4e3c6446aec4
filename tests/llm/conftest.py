import pytest

from tessera.llm._common import reach_workers


@pytest.fixture(autouse=True)
def workers(spark):
    reach_workers(spark)


@pytest.fixture
def docs(spark):
    """Rows as documents; more columns by keyword."""

    def make(rows, **more):
        kinds = "".join(f", `{k}` string" for k in more)
        full = [(i, t, "en", "s", len(t or ""), *more.values()) for i, t in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long{kinds}").repartition(3)

    return make


#: Names the operators use inside; documents may bring them too.
CLASHING = {"key": "k", "shard": "x", "id": "i", "doc": "d", "hi": "h", "words": "w", "start": "s", "__text": "t", "n_words": "n"}
