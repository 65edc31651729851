import pytest
from pyspark.sql import functions as F


def odd_documents(spark, ids=(1, 2, 3, 4, 5, 6, None)):
    """Nulls in every column, empty and long texts, repeated rows, and columns with the operators' own names."""
    long = "word of a long text " * 20_000
    rows = [(1, None, "en", "s1", 5), (2, "", None, "s1", None), (3, "  \n\t ", "en", None, 1), (4, "1 2 3 !?", "de", "s2", 2),
            (5, "same text here", "en", "s1", 3), (5, "same text here", "en", "s1", 3), (6, long, "fr", "s3", 4), (None, "no id", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "n_words", "epoch", "findings", "spans", "kept", "fingerprint", "component_id", "n_tokens", "lang_pred"):
        docs = docs.withColumn(name, F.lit("mine"))
    return docs


@pytest.fixture
def odd(spark):
    return odd_documents(spark)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
