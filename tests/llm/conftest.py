import pytest

#: Rows with what operators must bear: nulls in any column, empty and blank texts, ties, repeats, a long text, clashing names.
ROWS = [
    (1, "a b c d e f g h", "en", "s", 15),
    (2, "a  b\tc d e\nf g h", "en", "s", 15),
    (2, "a  b\tc d e\nf g h", "en", "s", 15),
    (None, "a b c d e f g h", None, None, None),
    (3, None, "en", "s", None),
    (4, "", "fr", "s", 0),
    (5, " \n\t ", "fr", None, 4),
    (6, "A B C D E F G H i", "en", "s", 17),
    (7, "one two", "en", "s", 7),
    (8, "ONE two", "en", "s", 7),
    (9, "word " * 3000, "en", "s", 15000),
    (10, "ﬁ É ñ 日本 🙂 x", "xx", "s", 13),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def odd(docs):
    """The same with columns whose names operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("_uid", "n_words", "kept", "score", "token", "_doc", "_text", "digest")})


@pytest.fixture
def empty(docs):
    return docs.limit(0)
