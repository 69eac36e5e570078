"""Keeping work spread out when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.session import SMALL_INPUT_BYTES, estimated_bytes

ROWS_PER_TASK = 2_000_000


def heavy_keys(df: DataFrame, key: str, rows: int, force: bool = False) -> list[Row]:
    """Keys with more than ``rows`` rows, with their counts.

    One map-side-combined aggregate; the list has at most total/rows entries. Inputs too small
    to hold such a key are not scanned unless ``force``.
    """
    if not force and estimated_bytes(df) < SMALL_INPUT_BYTES:
        return []
    return df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > rows).collect()


def time_cuts(df: DataFrame, key: str, ts: str, heavy: list[Row], rows: int) -> DataFrame:
    """(key, cuts): time boundaries that cut every heavy key into slices of about ``rows`` rows.

    The boundaries are taken once and handed back as literals: slicing must be the same
    wherever it is evaluated. Equal timestamps always fall into the same slice.
    """
    spark = df.sparkSession
    parts = min(10_000, max(2, -(-max(r["n"] for r in heavy) // rows)))
    shares = [i / parts for i in range(1, parts)]
    found = (
        df.filter(F.col(key).isin([r[key] for r in heavy]))
        .groupBy(key)
        .agg(F.percentile_approx(F.unix_micros(ts), shares, 10 * parts).alias("cuts"))
        .collect()
    )
    kind = df.schema[key].dataType.simpleString()
    return spark.createDataFrame(
        [(r[key], sorted(set(r["cuts"]))) for r in found], f"{key} {kind}, cuts array<bigint>"
    )


def bucketed_rank(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str
) -> DataFrame:
    """1-based rank inside ``group`` without putting a whole group into one task.

    ``bucket`` must follow ``order``. Rows are ranked inside (group, bucket); the sizes of the
    earlier buckets are added from a small table of bucket counts.
    """
    group = list(group)
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*group, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        rows.join(offsets, [*group, "_bucket"])
        .withColumn(name, (F.col("_before") + F.row_number().over(inside)).cast("long"))
        .drop("_bucket", "_before")
    )


def bucketed_running_sum(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    value: str,
    name: str,
    newest_first: bool = False,
) -> DataFrame:
    """Inclusive running sum inside ``group``, computed bucket by bucket as in ``bucketed_rank``."""
    group = list(group)
    rows = df.withColumn("_bucket", bucket)
    direction = F.col("_bucket").desc() if newest_first else F.col("_bucket").asc()
    before = Window.partitionBy(*group).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*group, "_bucket")
        .agg(F.sum(value).alias("_v"))
        .withColumn("_before", F.coalesce(F.sum("_v").over(before), F.lit(0)))
        .drop("_v")
    )
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.join(offsets, [*group, "_bucket"])
        .withColumn(name, F.col("_before") + F.sum(value).over(inside))
        .drop("_bucket", "_before")
    )


def bucketed_islands(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    at: str,
    gap: int,
    name: str = "island",
) -> DataFrame:
    """Number runs of rows whose ``at`` values (long) are at most ``gap`` apart.

    ``bucket`` must follow ``at``. Buckets exchange only their largest value and their number
    of run starts.
    """
    group = list(group)
    rows = df.withColumn("_bucket", bucket)
    buckets = Window.partitionBy(*group).orderBy("_bucket")
    inside = Window.partitionBy(*group, "_bucket").orderBy(at)
    carried = (
        rows.groupBy(*group, "_bucket")
        .agg(F.max(at).alias("_top"))
        .withColumn("_carry", F.lag("_top").over(buckets))
        .drop("_top")
    )
    prev = F.coalesce(F.lag(at).over(inside), F.col("_carry"))
    flagged = (
        rows.join(carried, [*group, "_bucket"])
        .withColumn("_new", (prev.isNull() | (F.col(at) - prev > gap)).cast("long"))
        .drop("_carry")
    )
    starts = (
        flagged.groupBy(*group, "_bucket")
        .agg(F.sum("_new").alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(F.sum("_n").over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("_n")
    )
    return (
        flagged.join(starts, [*group, "_bucket"])
        .withColumn(name, F.col("_before") + F.sum("_new").over(inside))
        .drop("_bucket", "_before", "_new")
    )


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of every group with a 1-based rank.

    Spark cuts each map task's output to ``k`` rows per group before the shuffle. It does so up
    to a limit of 1000; larger ``k`` are cut per (group, slice) first.
    """
    group = list(group)
    total = Window.partitionBy(*group).orderBy(*order)
    if k > 1000:
        local = Window.partitionBy(*group, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", F.pmod(F.xxhash64(*_hashable(df)), F.lit(256)))
            .withColumn("_r", F.row_number().over(local))
            .filter(F.col("_r") <= k)
            .drop("_r", "_slice")
        )
    return df.withColumn(name, F.row_number().over(total)).filter(F.col(name) <= k)


def _hashable(df: DataFrame) -> list[Column]:
    return [F.col(f.name) for f in df.schema.fields if f.dataType.typeName() != "map"]


def folded_patches(patches: DataFrame, key: str = "uid", order: str | None = None) -> DataFrame:
    """One row per key with the last non-NULL value of each field.

    ``order`` names the column that tells which patch is later; without it the order of rows does.
    """
    fields = [c for c in patches.columns if c not in (key, order)]
    at = F.monotonically_increasing_id() if order is None else F.col(order)
    return (
        patches.withColumn("_order", at)
        .groupBy(key)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in fields])
    )
