import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _size long, bucket string, slot string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, very long and repeated texts, ties, clashing extra columns."""
    words = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " \t\n ", "one", "a b c d e f g", "a b c d e f g", "A B c d e f g", words, "x " * 400, "é ß ü\x1cz", "l1 w\nl1 w\nl2 w\n\n\n", None]
    rows = [(i, t, None if i == 3 else "en", None if i % 4 == 0 else f"s{i % 3}", 0, 7, "b", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[4]], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
