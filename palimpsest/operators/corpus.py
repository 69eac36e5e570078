"""Corpus statistics and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import month_key

FIRST_TRAIN_WORDS = 30_000


def _words_by(messages: DataFrame, *keys) -> DataFrame:
    return messages.filter("is_me").groupBy(*keys).agg(
        F.count("*").alias("messages"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words")
    )


def stats_headline(
    messages: DataFrame, conversations: DataFrame, memories: DataFrame, captures: DataFrame
) -> DataFrame:
    """One row of corpus totals; four single-row aggregates put side by side."""
    said = messages.agg(
        F.coalesce(F.sum(F.when(F.col("is_me"), F.col("word_count"))), F.lit(0)).alias("me_words"),
        F.count_if("is_me").alias("me_messages"),
        F.count_if(~F.col("is_me")).alias("other_messages"),
    )
    sides = [
        conversations.agg(F.count("*").alias("conversations")),
        memories.agg(F.count_if(~F.col("archived")).alias("memories")),
        captures.agg(
            F.count_if(F.col("status").isin("pending", "processing")).alias("captures_pending")
        ),
    ]
    out = said.withColumn("_one", F.lit(1))
    for side in sides:
        out = out.join(side.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one").withColumn(
        "ready_for_first_train", F.col("me_words") >= FIRST_TRAIN_WORDS
    )


def by_register(messages: DataFrame) -> DataFrame:
    return _words_by(messages, "register").orderBy(F.col("words").desc(), "register")


def by_lang(messages: DataFrame) -> DataFrame:
    return _words_by(messages, F.coalesce("lang", F.lit("unknown")).alias("lang")).select(
        "lang", "words"
    )


def by_month(messages: DataFrame) -> DataFrame:
    return (
        _words_by(messages, month_key(F.col("ts")).alias("month"))
        .select("month", "words")
        .orderBy("month")
    )


def _per_conversation(messages: DataFrame) -> DataFrame:
    """Message totals per conversation: the joins to dimensions then see small rows only."""
    return messages.groupBy("conversation_id").agg(
        F.count("*").alias("messages"),
        F.count_if("is_me").alias("me_messages"),
        F.coalesce(F.sum(F.when(F.col("is_me"), F.col("word_count"))), F.lit(0)).alias("me_words"),
    )


def by_source(sources: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """My messages and words per source that has any, most words first."""
    conv = conversations.select(F.col("id").alias("conversation_id"), "source_id")
    totals = (
        _per_conversation(messages.filter("is_me"))
        .join(conv, "conversation_id")
        .groupBy("source_id")
        .agg(F.sum("messages").alias("messages"), F.sum("me_words").alias("words"))
    )
    return (
        sources.join(totals, sources["id"] == totals["source_id"])
        .select("id", "kind", "label", "messages", "words")
        .orderBy(F.col("words").desc(), "id")
    )


def list_sources(sources: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Every source with its message totals, zero where it has none."""
    conv = conversations.select(F.col("id").alias("conversation_id"), "source_id")
    totals = (
        conv.join(_per_conversation(messages), "conversation_id")
        .groupBy(F.col("source_id").alias("id"))
        .agg(*[F.sum(c).alias(c) for c in ("messages", "me_messages", "me_words")])
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        sources.join(totals, "id", "left")
        .select(*sources.columns, zero("messages"), zero("me_messages"), zero("me_words"))
        .orderBy("id")
    )


def my_messages_by_source(
    sources: DataFrame, conversations: DataFrame, messages: DataFrame
) -> DataFrame:
    """My messages with the kind and label of their source."""
    dims = conversations.select(F.col("id").alias("conversation_id"), "source_id").join(
        sources.select(F.col("id").alias("source_id"), "kind", "label"), "source_id"
    )
    return messages.filter("is_me").join(dims, "conversation_id")


def newest(df: DataFrame, ts: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` newest rows (a top-n per task, then one merge)."""
    return df.orderBy(F.col(ts).desc(), *ties).limit(n)
