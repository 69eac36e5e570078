"""Commit-log dumps: records end in 0x1E, fields (hash, ISO author date, body) in 0x1F."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.commits import clean_commit_message
from palimpsest.functions.dates import parse_iso
from palimpsest.functions.text import strip
from palimpsest.sources.registry import register_source


def parse_commits(records: DataFrame) -> DataFrame:
    """Canonical messages from (repo, value): unreadable records and non-human bodies drop out."""
    parts = F.split(F.regexp_replace("value", r"^\n+|\n+\z", ""), "\x1f", 3)
    name = F.try_element_at(F.split("repo", "/"), F.lit(-1))
    return (
        records.select("repo", parts.alias("p"))
        .filter(F.size("p") == 3)
        .select(
            "repo",
            strip(F.get("p", F.lit(0))).alias("sha"),
            parse_iso(F.get("p", F.lit(1))).alias("ts"),
            clean_commit_message(F.get("p", F.lit(2))).alias("text"),
        )
        .filter("ts is not null and text is not null")
        .select(
            F.col("repo").alias("conversation_external_id"),
            "text",
            "ts",
            F.lit(True).alias("is_me"),
            F.lit("doc").alias("register"),
            F.col("sha").alias("external_id"),
            name.alias("conversation_title"),
            F.lit(False).alias("is_group"),
            F.lit(None).cast("string").alias("sender_handle"),
            F.lit(None).cast("string").alias("sender_name"),
            F.lit(None).cast("map<string,string>").alias("meta"),
            F.lit(0).cast("long").alias("seq"),
        )
    )


@register_source("commit_log", kind="git", register="doc", label="git commits")
def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Dumps of one author's commits without merges; a repository is named by its file."""
    records = (
        spark.read.option("lineSep", "\x1e")
        .option("pathGlobFilter", "*.log")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.regexp_replace("_metadata.file_path", r"^file:/+|\.log$", "").alias("repo"), "value"
        )
    )
    return parse_commits(records)
