import datetime as dt

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("score", T.DateType()),
])


@pytest.fixture
def docs_of(spark):
    """Documents with extra columns whose names clash with results'."""

    def make(rows, parts=3):
        full = [(i, t, lang[0] if lang else None, None, "x", dt.date(2024, 1, 1)) for i, t, *lang in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


#: Nulls, empties, ties, repeated rows and a very long text.
ODD = [(1, None), (2, ""), (3, "  \t\n "), (None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (5, "é ß 漢字 \x00 ▁"), (6, "word " * 30_000), (7, "x" * 50_000)]


@pytest.fixture
def odd():
    return list(ODD)
