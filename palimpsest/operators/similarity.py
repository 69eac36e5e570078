"""Exact set-similarity join and order-dependent suppression of near copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import jaccard
from palimpsest.session import materialize


BITMAP_WORDS = 4  # 64-bit words of the bitmap of a set
PAIRED = 24  # sets of up to so many tokens are joined by two prefix tokens at once


def _least(n: Column, threshold: float) -> Column:
    """Tokens that a set of ``n`` shares with any similar set, at least."""
    return F.ceil(n * threshold - 1e-9).cast("int")


def _two(n: Column, threshold: float) -> Column:
    return (n <= PAIRED) & (_least(n, threshold) >= 2)


def _prefixes(sets: DataFrame, ranks: DataFrame, threshold: float, key: str) -> DataFrame:
    """(key, n, bits, t, u): the rarest tokens of every set, some of which each similar set shares.

    One token ``t``, or two of them for sets that ``_two`` takes; ``bits`` is a bitmap of all tokens.
    """
    rows = sets.select(key, F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    word, bit = F.pmod(F.col("spot"), F.lit(BITMAP_WORDS)), F.pmod(F.shiftright("spot", 8), F.lit(64))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    ordered = (
        rows.join(ranks, "token")
        .groupBy(key, "n")
        .agg(
            F.sort_array(F.collect_list(F.struct("df", "t"))).alias("t"),
            F.array(
                *[F.coalesce(F.bit_or(F.when(word == w, one)), F.lit(0).cast("long")) for w in range(BITMAP_WORDS)]
            ).alias("bits"),
        )
        .withColumn("t", F.col("t.t"))
    )
    n, none = F.col("n"), F.lit(-1).cast("long")
    single = F.transform(
        F.slice("t", F.lit(1), n - _least(n, threshold) + 1), lambda x: F.struct(x.alias("t"), none.alias("u"))
    )
    longer = F.slice(F.col("t"), F.lit(1), n - _least(n, threshold) + 2)
    double = F.flatten(
        F.transform(
            longer,
            lambda x, i: F.transform(
                F.slice(longer, i + 2, F.size(longer)), lambda y: F.struct(x.alias("t"), y.alias("u"))
            ),
        )
    )
    nothing = F.slice(single, 1, 0)
    # partners that are not joined by two tokens have more than PAIRED, or next to none
    alone = ~_two(n, threshold) | (n >= PAIRED * threshold - 1e-9) | (n * threshold**2 <= 1 + 1e-9)
    keys = F.concat(F.when(alone, single).otherwise(nothing), F.when(_two(n, threshold), double).otherwise(nothing))
    return ordered.select(key, "n", "bits", F.inline(keys))


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id) of all sets (id, tokens) with a Jaccard similarity of ``threshold`` or more.

    Tokens are ordered by their number of sets, rare first; two similar sets share one of the
    first n - ceil(threshold n) + 1 tokens of both, and two of one token more if they share two at
    all; their sizes are within the threshold. Short sets are joined by two tokens, so that frequent
    ones are joined only for sets that hold little else. What meets must differ in no more bits of
    a bitmap than similar sets differ in tokens, before it is moved and compared. Equal sets of one
    side stand for one another: the smallest id of each is joined. Empty sets are like nothing.
    """

    def classes(side: DataFrame, name: str) -> DataFrame:
        sets = side.select("id", F.array_sort("tokens").alias("tokens")).filter(F.size("tokens") > 0)
        return sets.groupBy("tokens").agg(F.min("id").alias(name))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        return materialize(rows.withColumn(name, F.monotonically_increasing_id()))

    a, b = keyed(classes(left, "left_id"), "i"), keyed(classes(right, "right_id"), "j")
    every = a.select("tokens").unionByName(b.select("tokens"))
    counted = every.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    ranks = keyed(counted.withColumn("spot", F.xxhash64("token")), "t")
    n, m = F.col("n"), F.col("m")
    near = (n * threshold - 1e-9 <= m) & (m * threshold - 1e-9 <= n)
    shared = F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)
    differ = sum(
        (F.bit_count(F.get("bits", F.lit(w)).bitwiseXOR(F.get("others", F.lit(w)))) for w in range(BITMAP_WORDS)),
        F.lit(0),
    )
    once = (F.col("u") >= 0) | ~(_two(n, threshold) & _two(m, threshold))
    pairs = (
        _prefixes(a, ranks, threshold, "i")
        .join(_prefixes(b, ranks, threshold, "j").withColumnsRenamed({"n": "m", "bits": "others"}), ["t", "u"])
        .filter(near & once & (differ <= n + m - 2 * shared))
        .select("i", "j")
        .distinct()
    )
    return (
        pairs.join(a.withColumnRenamed("tokens", "_l"), "i")
        .join(b.withColumnRenamed("tokens", "_r"), "j")
        .filter(jaccard(F.col("_l"), F.col("_r")) >= threshold)
        .select("left_id", "right_id")
    )


def first_independent(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids of ``rows`` (id) that stay if they come one by one, smallest first, and each stays
    unless an earlier one beside it did. ``edges`` (a, b) has a < b.

    A row is settled once all earlier ones beside it are: it goes if one of them stays. The number
    of rounds is the longest chain of such dependencies, not the number of rows.
    """
    open_edges = materialize(edges.select("a", "b").distinct())
    gone = None
    while not open_edges.isEmpty():
        waiting = open_edges.select(F.col("b").alias("id")).distinct()
        # earlier ends that wait for nothing stay; what is beside them goes
        stays = open_edges.select(F.col("a").alias("id")).distinct().join(waiting, "id", "left_anti")
        lost = materialize(
            open_edges.join(stays, F.col("a") == F.col("id"), "left_semi").select(F.col("b").alias("id")).distinct()
        )
        gone = lost if gone is None else materialize(gone.unionByName(lost))
        open_edges = materialize(
            open_edges.join(lost, F.col("a") == F.col("id"), "left_anti").join(
                lost, F.col("b") == F.col("id"), "left_anti"
            )
            .join(stays, F.col("a") == F.col("id"), "left_anti")
        )
    return rows if gone is None else rows.join(gone, "id", "left_anti")
