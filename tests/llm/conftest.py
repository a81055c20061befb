import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with clashing extra columns, from texts or (id, text) pairs."""
    def make(texts):
        rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, None, None, -1, "x") for i, t in rows],
                                     "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    return make
