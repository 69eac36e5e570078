from __future__ import annotations

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text[, lang]) rows, with an extra column and columns that clash."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("score", T.StringType()),
            T.StructField("n", T.StringType()),
        ]
    )

    def make(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or ""), "clash", None)
            for r in rows
        ]
        return spark.createDataFrame(full, schema).repartition(3)

    return make


ODD = [
    (1, None, None),
    (2, "", "en"),
    (3, " \n\t ", "en"),
    (None, "no id at all here today", "en"),
    (5, "the same row twice", "en"),
    (5, "the same row twice", "en"),
    (6, "x" * 300_000, "en"),
    (7, "long words " * 30_000, "en"),
    (8, "日本語 ñandú – “quoted”   tab\there", None),
    (9, "\x00\x1f\x7f   é", "en"),
]


@pytest.fixture(scope="session")
def odd(table):
    return table(ODD)


@pytest.fixture(scope="session")
def empty(table):
    return table([(1, "x")]).filter("doc_id < 0")
