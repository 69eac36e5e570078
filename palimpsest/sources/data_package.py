"""Account data packages: one folder per channel with JSON or CSV messages, all mine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.dates import parse_iso
from palimpsest.functions.text import strip
from palimpsest.sources.registry import register_source

DM_TYPE = 1
ROWS = "ID string, Timestamp string, Contents string, Attachments string"
CHANNEL = "type int, name string, recipients array<string>"


def channel_id(folder: Column) -> Column:
    """``c123`` and ``123`` are the same channel."""
    return F.regexp_replace(folder, r"^c(?=\p{Nd}+$)", "")


def title_and_group(channels: DataFrame, index: DataFrame, meta: DataFrame) -> DataFrame:
    """(channel, title, is_group) for ``channels``; ``index``: channel, name; ``meta``: channel,
    type, name, recipients."""
    full = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    own = F.coalesce(
        full(F.col("m.name")), full(F.array_join(F.coalesce("m.recipients", F.array().cast("array<string>")), ", "))
    )
    rows = (
        channels.alias("c")
        .join(index.alias("i"), "channel", "left")
        .join(meta.alias("m"), "channel", "left")
    )
    title = F.coalesce(full(F.col("i.name")), own, F.concat(F.lit("channel "), F.col("channel")))
    return rows.select(
        "channel",
        title.alias("title"),
        F.coalesce(
            F.col("m.type") != DM_TYPE, ~F.lower(title).startswith("direct message")
        ).alias("is_group"),
    )


def package_messages(
    rows_json: DataFrame, rows_csv: DataFrame, index: DataFrame, meta: DataFrame, json_channels: DataFrame | None = None
) -> DataFrame:
    """Canonical messages; CSV rows count only for channels without a JSON file.

    ``rows_*``: channel, ID, Timestamp, Contents.
    """
    have = rows_json.select("channel").distinct() if json_channels is None else json_channels
    rows = rows_json.unionByName(rows_csv.join(have, "channel", "left_anti"), allowMissingColumns=True)
    named = title_and_group(rows.select("channel").distinct(), index, meta)
    text = strip(F.coalesce("Contents", F.lit("")))
    return (
        rows.withColumn("text", text)
        .withColumn("ts", parse_iso(F.col("Timestamp")))
        .filter((F.col("text") != "") & F.col("ts").isNotNull())
        .join(named, "channel")
        .select(
            F.col("channel").alias("conversation_external_id"),
            "text",
            "ts",
            F.lit(True).alias("is_me"),
            F.lit("text").alias("register"),
            F.when(F.coalesce("ID", F.lit("")) != "", F.col("ID")).alias("external_id"),
            F.col("title").alias("conversation_title"),
            "is_group",
            F.lit(None).cast("string").alias("sender_handle"),
            F.lit(None).cast("string").alias("sender_name"),
            F.lit(None).cast("map<string,string>").alias("meta"),
            F.coalesce(F.col("ID").try_cast("long"), F.lit(0)).alias("seq"),
        )
    )


@register_source("data_package", kind="discord", label="data package")
def read_data_package(spark: SparkSession, path: str) -> DataFrame:
    base = f"{path.rstrip('/')}/messages"
    folder = F.try_element_at(F.split("_metadata.file_path", "/"), F.lit(-2))
    named = lambda r, name: r.option("pathGlobFilter", name).option("recursiveFileLookup", "true")
    channel = channel_id(folder).alias("channel")
    rows_json = (
        named(spark.read, "messages.json").schema(ROWS).json(base, multiLine=True).select(channel, "*")
    )
    rows_csv = (
        named(spark.read, "messages.csv")
        .schema(ROWS)
        .csv(base, header=True, multiLine=True, quote='"', escape='"')
        .select(channel, "*")
    )
    # An empty or broken JSON file still hides the CSV.
    listed = (
        named(spark.read.format("binaryFile"), "messages.json")
        .load(base)
        .select(channel_id(F.try_element_at(F.split("path", "/"), F.lit(-2))).alias("channel"))
        .distinct()
    )
    index = (
        named(spark.read, "index.json")
        .text(base, wholetext=True)
        .select(F.explode(F.from_json("value", "map<string,string>")).alias("channel", "name"))
    )
    meta = (
        named(spark.read, "channel.json")
        .text(base, wholetext=True)
        .select(channel, F.from_json("value", CHANNEL).alias("c"))
        .select("channel", "c.*")
    )
    return package_messages(rows_json, rows_csv, index, meta, listed)
