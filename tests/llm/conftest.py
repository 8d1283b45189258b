import pytest
from pyspark.sql import types as T

LONG = "lorem ipsum dolor " * 60_000

#: doc_id, text, and columns whose names the operators use inside.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en"), (2, None, "en"), (3, "", None), (4, "   \n\t ", "de"),
    (5, "The quick brown fox jumps over the lazy dog.", "en"), (5, "The quick brown fox jumps over the lazy dog.", "en"),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund.", "de"), (None, None, None),
    (6, "Der schnelle braune Fuchs springt über den faulen Hund.", "de"), (7, LONG, "la"), (8, "!!! ??? 12 \x00 \x1c", "en"),
    (9, "漢字 かな 🙂 café é", "ja"), (10, "x" * 5000, "en"), (11, "a@b.co 10.0.0.1 +1 (017) 555-7713 4111 1111 1111 1111", "en"),
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
                      + [T.StructField(n, T.LongType()) for n in ("row", "key", "th", "t", "shard", "fp", "k", "c", "size", "component", "n_words", "part")])


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame([r + (7,) * (len(SCHEMA) - 3) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def pairs_of(df, *cols):
    """Collected rows as sortable tuples (null ids last)."""
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=repr)
