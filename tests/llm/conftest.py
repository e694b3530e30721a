import pytest
from pyspark.sql import functions as F

EDGE = [
    (1, None, "en", "a", "x"),
    (2, "", "en", "a", "x"),
    (3, " \n\t ", None, None, None),
    (4, "one", "en", "a", "x"),
    (5, "one two three four", "de", "b", "x"),
    (5, "one two three four", "de", "b", "x"),
    (None, "no id here but some words to look at", "fr", None, None),
    (7, "word " * 40_000, "en", "c", "x"),
    (8, "x" * 300_000, "en", "c", "x"),
    (9, "\x00\x1f é ﬁ ▁ 😀 " * 20, "fr", "d", "x"),
    (10, "same text here " * 10, "es", "d", "x"),
    (11, "same text here " * 10, "es", "d", "x"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns of clashing names."""
    docs = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string, size string")
    return docs.withColumn("score", F.lit(1)).withColumn("n_words", F.lit("w")).repartition(3).cache()
