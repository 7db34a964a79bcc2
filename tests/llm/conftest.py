import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, t string, n long, key string, kept boolean"


@pytest.fixture(scope="session")
def docs(spark):
    """A table of documents with columns whose names the operators use inside."""

    def make(rows):
        """Of (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(*r, *(() if len(r) > 2 else ("en", "a")), 0, "r", 1, "t", 2, "k", True) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
