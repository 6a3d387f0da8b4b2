import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCUMENT)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and long texts, repeated rows, white space of several kinds, signs outside the base plane."""
    return make_docs([
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "no id at all", "b"), (5, "same text here", "b"), (6, "same text here", "b"),
        (6, "same text here", "b"), (7, "wörter \U0001f600 und mehr " * 50, "c"), (8, "x" * 200_000, "c"), (9, "one", "d"), (10, "word " * 30_000, None),
    ])
