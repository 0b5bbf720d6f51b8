"""Rows and helpers that the tests of this folder share."""
import pytest
from pyspark.sql import types as T

#: Extra columns named like the operators' own, which none may trip over.
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("n_words", T.StringType()), T.StructField("kept", T.StringType()),
    T.StructField("component_id", T.StringType()), T.StructField("place", T.StringType()),
    T.StructField("votes", T.StringType()), T.StructField("n", T.StringType()), T.StructField("h", T.StringType()),
    T.StructField("pos", T.StringType()), T.StructField("length", T.StringType()), T.StructField("key", T.StringType()),
])


@pytest.fixture
def make_docs(spark):
    """documents from (doc_id, text[, lang]) rows, with extra columns."""
    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None, *["x"] * 9, None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)
    return make


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


HARD = [
    (1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (None, "no id, but words enough for a window of ten or more"),
    (5, "a b c d e f g h i j k\nline two here\n\n"), (5, "a b c d e f g h i j k\nline two here\n\n"), (6, "x" * 50_000),
    (7, "word " * 20_000), (8, "\U0001F600    İ ß Σς ½ ﬁ ́"), (9, "1234 5678 !!! ---"), (10, "\n" * 3000),
]
