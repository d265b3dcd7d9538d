import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """(texts, langs) to a documents table; ids count from 0 unless given."""
    def make(texts, ids=None, langs=None):
        ids = ids or range(len(texts))
        langs = langs or ["en"] * len(texts)
        rows = [(i, t, g, "s", None if t is None else len(t)) for i, t, g in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, DOCS)
    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
