import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns whose names clash with the operators' own."""
    rows = [
        (1, "the cat sat on the mat and then the cat sat on the mat again today", "en", 5.0, "x"),
        (2, None, "en", 1.0, "x"),
        (3, "", "en", 1.0, None),
        (4, "   \n\t ", None, 1.0, "x"),
        (5, "!!! ??? 123", "en", 1.0, "x"),
        (6, "the cat sat on the mat and then the cat sat on the mat again today", "en", None, "x"),
        (6, "the cat sat on the mat and then the cat sat on the mat again today", "en", None, "x"),
        (None, "le chat est sur la table et il mange une souris avec du pain", "fr", 1.0, "x"),
        (None, None, None, None, None),
        (7, "wörter über süße straßen und häuser " * 3000, "de", 1.0, "x"),
        (8, "a" * 50000, "en", 1.0, "x"),
        (9, "<|endoftext|> it's 3 o'clock, isn't it?  don't 'll", "en", 1.0, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double, text__ string").repartition(3)


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, 0, None), (6, 1, 0), (6, 1, 1), (None, 1, 1), (99, 0, 0), (7, None, None)], "doc_id bigint, quality int, toxic int")
