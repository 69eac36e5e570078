"""Exact ranks by narrowing histograms, against sorting."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import selection


@pytest.mark.parametrize("kind", ["double", "long"])
def test_values_equal_sorted_ones(spark, monkeypatch, kind):
    monkeypatch.setattr(selection, "FEW", 5)
    monkeypatch.setattr(selection, "BINS", 4)
    rnd = random.Random(1)
    groups = {"hot": 900, "ties": 200, "one": 1, "wide": 60}
    rows = []
    for g, n in groups.items():
        for _ in range(n):
            v = 7 if g == "ties" and rnd.random() < 0.9 else rnd.choice([rnd.uniform(0, 3), rnd.uniform(0, 1e12)])
            rows.append((g, float(v) if kind == "double" else (1 << 59) + int(v)))
    frame = spark.createDataFrame(rows, f"g string, v {kind}").repartition(3)
    ranks = [(g, r) for g, n in groups.items() for r in {0, n // 2, n * 9 // 10, n - 1}]
    found = {(r["g"], r["r"]): r["v"] for r in selection.values_at(frame, spark.createDataFrame(ranks, "g string, r long")).collect()}
    ordered = {g: sorted(v for h, v in rows if h == g) for g in groups}
    assert found == {(g, r): ordered[g][r] for g, r in ranks}


def test_newest_rows(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 3)
    rnd = random.Random(2)
    rows = [(i * 7919 % 1009 + (1 << 58), rnd.choice([None, *range(12)])) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, s long").withColumn("ts", F.timestamp_seconds("s")).repartition(4)
    for n in (0, 1, 17, 130, 199, 200, 500):
        want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]), reverse=True)[:n]
        assert sorted(r["id"] for r in selection.newest(frame, n).collect()) == sorted(r[0] for r in want)


def test_newest_computes_its_rows_twice_at_most(spark):
    from palimpsest.operators.selection import newest

    calls = spark.sparkContext.accumulator(0)

    def number(x):
        calls.add(1)
        return x

    made = F.udf(number, "long")
    rows = spark.range(200).select(made("id").alias("id")).withColumn("ts", F.timestamp_seconds(F.col("id") % 50))
    assert newest(rows, 30).count() == 30
    assert 200 <= calls.value <= 1000
