import pytest
from pyspark.sql import functions as F

#: Columns whose names operators use for their own.
CLASHING = ("score", "part", "bin", "fp", "stats", "n_bytes", "n_removed", "lang_pred", "shard", "a", "n", "ids", "bits", "component_id", "predicted", "depth")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, an empty text, a very long one, repeated rows, and clashing column names."""
    word = "the quick brown fox jumps over a lazy dog and runs away "
    rows = [(0, "Hello there world of words", "en"), (1, None, None), (2, "", "en"), (3, word * 4000, "en"), (4, "bonjour le monde entier", "fr"), (4, "bonjour le monde entier", "fr"), (5, "12345 67890", None), (None, "no id has this text", "en"), (6, "x" * 5000, "de"), (7, "ein kleines Wort für die Welt", "de"), (8, "Hello there world of words", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (3, 0, 0), (4, 1, None), (4, 0, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
