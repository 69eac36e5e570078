"""Pushed message batches: {source, messages[]} as JSON, one batch per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.schema import CANONICAL, MESSAGE_BATCH, conform
from palimpsest.sources.registry import register_source


def batch_messages(batches: DataFrame) -> DataFrame:
    """Canonical messages with source_kind, source_label and source_locator."""
    rows = batches.select(
        F.col("source.kind").alias("source_kind"),
        F.col("source.label").alias("source_label"),
        F.coalesce("source.locator", F.lit("")).alias("source_locator"),
        F.posexplode("messages").alias("_pos", "m"),
    )
    flat = rows.select("source_kind", "source_label", "source_locator", "_pos", "m.*")
    return flat.withColumn("register", F.coalesce("register", F.lit("text"))).withColumn(
        "is_group", F.coalesce("is_group", F.lit(False))
    ).withColumn("seq", F.coalesce("seq", F.col("_pos").cast("long"))).drop("_pos")


@register_source("batches", kind="push", label="pushed batches")
def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return conform(batch_messages(spark.read.schema(MESSAGE_BATCH).json(path)), CANONICAL)


def with_push_id(batches: DataFrame) -> DataFrame:
    """Add ``push_id``, a hash of all a batch holds: a batch that is sent again has the same."""
    return batches.withColumn("push_id", F.sha2(F.to_json(F.struct("source", "messages")), 256))


def stream_batches(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """(source, messages, push_id) of newly arriving files, ``files`` at a time."""
    reader = spark.readStream.schema(MESSAGE_BATCH)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return with_push_id(reader.json(path))
