import pytest

NASTY = [
    (1, "a b c d e f", "en", "s1"), (2, None, None, None), (None, "a b c d e f", "en", "s1"), (3, "", "de", "s1"), (4, "  \t\n ", "de", None), (5, "é" * 3000, "fr", "s2"), (6, "word " * 5000, "en", "s1"),
    (7, "same text here now", "en", "s3"), (7, "same text here now", "en", "s3"), (8, "same text here now", None, "s3"), (9, "A\x1cb ́c It's <|endoftext|> Straße ½²", "en", "s1"), (10, "1234 !!! ???", "en", ""), (11, "x\x85y\xa0z\x0bq", "en", "s1"),
]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls, empties, a long text, ties, repeated rows, and extra columns whose names operators might use."""
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in NASTY], "doc_id long, text string, lang string, source string, n_chars long")
    return df.selectExpr("*", "'x' as size", "1 as w", "2 as length", "3 as digest", "4 as _h", "5 as taken", "6 as n", "7 as rep", "8 as words", "9 as key")


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.filter("false")
