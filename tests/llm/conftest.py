import pytest


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = "lorem ipsum dolor " * 4000
    rows = [(1, "the cat sat on the mat and then it slept all day long", "en"), (1, "the cat sat on the mat and then it slept all day long", "en"), (2, "", "en"), (3, None, None), (None, "a text without an id", "en"), (4, long, "la"), (5, "12 34 !!", None), (1, "another text under the first id", "en")]
    return spark.createDataFrame([(*r, "x", 7, "y", 1) for r in rows], "doc_id long, text string, lang string, source string, n int, th string, bucket int")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
