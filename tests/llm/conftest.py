import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """documents with the given (doc_id, text[, lang]) rows."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows, and extra columns with clashing names."""
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b  c d e f"), (5, "word " * 60_000),
            (6, "漢字 🙂 ́x"), (7, "mail a.b@c.org or +1 (212) 555-0100 4111 1111 1111 1111 10.0.0.256 10.0.0.7")]
    d = make_docs(rows)
    return d.selectExpr("*", "1 AS TEXT", "'x' AS score", "2 AS row", "3 AS Doc_ID")


def empty(df):
    return df.where("1 = 0")
