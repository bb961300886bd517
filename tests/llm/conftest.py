import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, a clashing extra column."""
    rows = [(1, None, "en", None, None), (2, "", "en", "a", 0), (3, "one two", "en", "a", 7), (3, "one two", "en", "a", 7),
            (None, "password = hunter22 and more words here", None, "b", 1), (5, "word " * 60_000, "en", "b", 1),
            (6, "é😀 AKIA" + "A1" * 10 + " 0123456789abcdef01234567 x", "fr", "c", 1)]
    return spark.createDataFrame([(*r, 9.0) for r in rows], COLUMNS + ", kept double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)
