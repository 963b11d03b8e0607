import pytest


@pytest.fixture
def documents(spark):
    """A documents table from ``(doc_id, text)`` pairs, with the other columns filled in."""
    def make(rows):
        full = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    return make
