"""Reading text by line with a position, and paths relative to a root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, suffix: str = "*.txt") -> DataFrame:
    """(path, block, pos, line): lines with the split they come from and their order in it.

    Files are read in splits; no file has to fit a row or a task.
    """
    reader = spark.read.option("pathGlobFilter", suffix).option("recursiveFileLookup", "true")
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.regexp_replace(F.col("value"), r"^\x{FEFF}|\r\z", "").alias("line"),
    )


def file_stem(path: Column) -> Column:
    """File name without suffix, percent escapes decoded."""
    name = F.try_element_at(F.split(path, "/"), F.lit(-1))
    return F.try_url_decode(F.replace(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit("+"), F.lit("%2B")))


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def relative_path(path: Column, root: str) -> Column:
    """Part of ``path`` below ``root``."""
    base = root.rstrip("/")
    tail = F.substr(path, F.locate(base, path) + len(base), F.lit(1 << 20))
    return F.regexp_replace(tail, "^/", "")


def estimate_rows(
    spark: SparkSession, path: str, pattern: str, suffix: str, limit_bytes: int = 256 << 20, row_bytes: int = 10_000
) -> DataFrame:
    """(path, estimate): lines matching ``pattern``; above ``limit_bytes`` size / ``row_bytes``.

    Large files are judged by their length alone; their lines are not read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", suffix)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    small = (
        spark.read.option("pathGlobFilter", suffix)
        .option("recursiveFileLookup", "true")
        .text(path)
        .filter(F.col("_metadata.file_size") <= limit_bytes)
        .filter(F.col("value").rlike(pattern))
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count("*").alias("n"))
    )
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.join(small, plain(F.col("path")) == plain(F.col("file")), "left").select(
        "path",
        F.when(
            F.col("length") > limit_bytes,
            F.greatest(F.lit(1), F.floor(F.col("length") / row_bytes)),
        )
        .otherwise(F.coalesce("n", F.lit(0)))
        .cast("long")
        .alias("estimate"),
    )
