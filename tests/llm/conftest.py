import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text, lang, source) rows."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows],
            "doc_id long, text string, lang string, source string, n_chars int")

    return make
