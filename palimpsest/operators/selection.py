"""Exact ranks without sorting: brackets around the wanted value, narrowed by histograms.

A round counts the rows of every bracket in ``BINS`` ranges, with the smallest and largest value of
each, and goes on with the range that holds the wanted rank. Counts fold on the map side, so a
round shuffles ``BINS`` rows for each task and bracket, however many rows a group has. A bracket of
one value is done; one of at most ``FEW`` rows is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.session import materialize

BINS = 256
FEW = 1 << 16
BROADCAST_ROWS = 100_000  # brackets that go to every task; more are joined by key


def _bin(whole: bool) -> Column:
    if whole:
        width = "greatest(1, (hi - lo) div {0} + 1)".format(BINS)
        return F.expr(f"cast((v - lo) div {width} as int)")
    return F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS).cast("int"))


def values_at(rows: DataFrame, ranks: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(g, r, v): the value of rank ``r`` (from 0, ascending) among the rows (g, v) of each group.

    ``v`` is a long or a double without nulls; ``ranks`` (g, r) are below the groups' sizes. ``ends``
    (g, lo, hi, n) has the smallest and largest value and the size of each group, if known already.
    """
    whole = rows.schema["v"].dataType.typeName() == "long"
    if ends is None:
        ends = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    state = materialize(ranks.distinct().join(ends, "g").withColumn("below", F.lit(0).cast("long")))
    key = ["g", "lo", "hi"]

    def inside(brackets: DataFrame) -> DataFrame:
        asked = brackets.select(*key).distinct()  # of a checkpointed table
        if asked.count() <= BROADCAST_ROWS:
            asked = F.broadcast(asked)
        return rows.join(asked, "g").filter("v between lo and hi")

    while True:
        wide = state.filter((F.col("lo") < F.col("hi")) & (F.col("n") > FEW))
        if wide.isEmpty():
            break
        bins = (
            inside(wide)
            .groupBy(*key, _bin(whole).alias("bin"))
            .agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        )
        upto = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        summed = bins.withColumn("upto", F.sum("c").over(upto))
        r = F.col("r") - F.col("below")
        narrowed = (
            wide.join(summed, key)
            .filter((r < F.col("upto")) & (r >= F.col("upto") - F.col("c")))
            .select(
                "g", "r", F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("c").alias("n"),
                (F.col("below") + F.col("upto") - F.col("c")).alias("below"),
            )
        )
        rest = state.filter((F.col("lo") >= F.col("hi")) | (F.col("n") <= FEW))
        state = materialize(rest.unionByName(narrowed))
    one = state.filter("lo = hi").select("g", "r", F.col("lo").alias("v"))
    few = state.filter("lo < hi")
    order = Window.partitionBy(*key).orderBy("v")
    ranked = inside(few).withColumn("place", F.row_number().over(order) - 1)
    found = few.join(ranked, key).filter(F.col("r") - F.col("below") == F.col("place")).select("g", "r", "v")
    return one.unionByName(found)


def newest(rows: DataFrame, n: int, ts: str = "ts", id: str = "id") -> DataFrame:
    """The ``n`` rows with the largest (ts, id): a filter on a cut, no row is moved.

    Rows without a time come last, as they do in a descending order. The cut is found on a table of
    times and ids, so that what ``rows`` takes to compute is not done again in every pass.
    """
    at = F.coalesce(F.unix_micros(F.col(ts)), F.lit(-(1 << 62)))

    def cut(df: DataFrame, value: Column, wanted: int) -> int | None:
        """The value of the last of the ``wanted`` largest; none if all rows are wanted."""
        size = df.count()
        if size <= wanted:
            return None
        spark = df.sparkSession
        rank = spark.createDataFrame([(0, size - wanted)], "g int, r bigint")
        return values_at(df.select(F.lit(0).alias("g"), value.alias("v")), rank).first()["v"]

    if n <= 0:
        return rows.limit(0)
    number = F.col(id).cast("long")
    keys = materialize(rows.select(at.alias("at"), number.alias("number")))
    last = cut(keys, F.col("at"), n)
    if last is None:
        return rows
    more = keys.filter(F.col("at") > last).count()
    least = cut(keys.filter(F.col("at") == last), F.col("number"), n - more)
    return rows.filter((at > last) | ((at == last) & (F.lit(True) if least is None else number >= least)))
