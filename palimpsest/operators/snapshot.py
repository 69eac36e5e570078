"""Writing a training snapshot: splits, manifest and content hash."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import to_iso
from palimpsest.operators.examples import (
    ExampleConfig,
    cap_per_conversation,
    dataset_stats,
    labelled_examples,
    shuffled,
)
from palimpsest.session import materialize

HASH_BUCKETS = 1024


def example_json() -> Column:
    """One example as a JSON line."""
    meta = F.struct(
        "conversation_id",
        "register",
        "lang",
        to_iso(F.col("ts")).alias("ts"),
        "n_context",
        "source",
    )
    return F.to_json(
        F.struct("messages", meta.alias("meta")), {"ignoreNullFields": "false"}
    )


def content_sha256(lines: DataFrame, column: str = "value") -> DataFrame:
    """Order-free hash of a set of lines.

    Line hashes are folded per fine bucket, buckets per coarse bucket, coarse buckets into one:
    no step holds more than a sliver of the lines. Equal lines are counted, not collected.
    """
    once = (
        lines.groupBy(F.sha2(F.col(column), 256).alias("h"))
        .agg(F.count("*").alias("c"))
        .withColumn("line", F.concat_ws(":", "h", "c"))
    )
    levels = [
        [F.substring("h", 1, 5).alias("a"), F.substring("h", 1, 2).alias("b")],
        ["b"],
        [],
    ]
    fold = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\n"), 256)
    out = once
    for keys in levels:
        out = out.groupBy(*keys).agg(fold(F.col("line")).alias("line"))
    return out.select(F.col("line").alias("sha256"))


def write_splits(examples: DataFrame, path: str, seed: int = 7) -> None:
    """train (seeded order), valid, and test (a copy of valid) as JSON lines."""
    train = shuffled(examples.filter(~F.col("is_holdout")), seed)
    valid = examples.filter("is_holdout").orderBy("conversation_id", "turn_no")
    for name, part in (("train", train), ("valid", valid), ("test", valid)):
        part.select(example_json().alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def read_examples(spark, path: str) -> DataFrame:
    """JSON lines of a split back as (messages, meta)."""
    schema = (
        "messages array<struct<role:string,content:string>>, meta struct<conversation_id:bigint,"
        "register:string,lang:string,ts:string,n_context:int,source:string>"
    )
    return spark.read.schema(schema).json(path)


def manifest(
    stats: DataFrame, sha: DataFrame, version: str, cfg: ExampleConfig = ExampleConfig()
) -> DataFrame:
    """One row describing a snapshot."""
    return (
        stats.withColumn("_one", F.lit(1))
        .join(sha.withColumn("_one", F.lit(1)), "_one")
        .select(
            F.lit(version).alias("version"),
            to_iso(F.current_timestamp()).alias("created_at"),
            F.lit(cfg.base_model).alias("base_model"),
            to_iso(F.col("data_cutoff")).alias("data_cutoff"),
            "n_examples",
            "n_holdout",
            "n_words",
            "by_register",
            "by_lang",
            "conversations",
            "skipped",
            F.col("sha256").alias("train_sha256"),
            F.lit(json.dumps(cfg.as_dict())).alias("config"),
        )
    )


def build_snapshot(
    messages: DataFrame,
    conversations: DataFrame,
    path: str,
    version: str,
    cfg: ExampleConfig = ExampleConfig(),
    cutoff: str | None = None,
) -> DataFrame:
    """Write the splits and the manifest of a version; returns the manifest row.

    Examples feed the cap, three splits, the statistics and the hash: they are checkpointed
    before and after the cap instead of being rebuilt for each.
    """
    labelled = materialize(labelled_examples(messages, conversations, cfg, cutoff))
    capped = materialize(cap_per_conversation(labelled, cfg.max_per_conversation))
    examples = capped.filter("skip_reason is null")
    write_splits(examples, f"{path}/{version}", cfg.seed)
    lines = examples.filter(~F.col("is_holdout")).select(example_json().alias("value"))
    row = materialize(manifest(dataset_stats(capped), content_sha256(lines), version, cfg))
    row.write.mode("overwrite").json(f"{path}/{version}/manifest")
    return row
