import pytest


@pytest.fixture
def docs_of(spark):
    """Documents (doc_id, text, lang, source, n_chars and a clashing extra column) from (doc_id, text, source) rows."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, hash string")

    return make
