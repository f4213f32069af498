import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string, score double, h1 int, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and wordless texts, a very long one, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "one two three four five six seven", "en", "a"), (1, "one two three four five six seven", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \n\t!!! ", "en", "b"),
        (None, "one two three four five six seven", "de", "b"), (5, "ONE, two three four; five six seven", "fr", "a"), (6, "word", "en", "a"), (7, "long text about things " * 40_000, "en", "c"), (8, "émoji 😀 naïve \x00 zero", "fr", None),
        (None, None, None, None), (9, "two three four five six seven eight nine", "en", "a"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 0.5, 7, "k") for r in rows], DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
