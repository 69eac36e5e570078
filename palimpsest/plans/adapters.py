"""The given tables as corpus tables.

``conversations`` become chats (one message per line), ``documents`` prose of mine, ``events``
captures and frames, ``embeddings`` vectors, ``benchmark`` queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.identity import handle_hash
from palimpsest.functions.text import guess_lang, word_count
from palimpsest.operators.scale import bucketed_rank
from palimpsest.schema import MEMORY_KINDS

BASE_S = 1_704_067_200  # 2024-01-01T00:00:00Z
DOC_CONV = 1_000_000_000
DOC_ID = 1_000_000_000_000
SALT = "salt"
SOURCE_KINDS = ["whatsapp", "email", "imessage"]
REGISTER_CYCLE = ["text", "email", "speech", "text"]
STATUS_OF_EVENT = {
    "view": "done",
    "click": "done",
    "purchase": "pending",
    "signup": "processing",
    "error": "discarded",
}


TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Text tables that come as fewer splits than there are cores are spread by
    key: a small file is one split, and text work is bound by CPU. Large inputs are left alone.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_KEYS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, TEXT_KEYS[name])
    return df


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, ln, line) of the chats without system turns and blank lines."""
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") != "system")
        .select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
        .withColumn("line", F.trim("line"))
        .filter(F.col("line") != "")
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ln, turn, conv = F.col("ln"), F.col("turn"), F.col("conv_id")
    day = (conv % 365) * 86_400
    second = turn * 7200 + F.floor(turn / 4) * 345_600 + ln * 60 + F.floor(ln / 6) * 1500
    mine = F.col("role") == "assistant"
    speaker = F.when(conv % 5 == 0, (conv + ln) % 3).otherwise(conv % 7)
    return chat_lines(spark, sf_dir).select(
        (conv * 1_000_000 + turn * 10_000 + ln).alias("id"),
        conv.alias("conversation_id"),
        F.when(~mine, speaker + 1).alias("contact_id"),
        mine.alias("is_me"),
        F.timestamp_seconds(F.lit(BASE_S) + day + second).alias("ts"),
        pick(REGISTER_CYCLE, conv % 4).alias("register"),
        guess_lang(F.col("line")).alias("lang"),
        F.col("line").alias("text"),
        word_count(F.col("line")).alias("word_count"),
        F.concat(F.lit("x"), conv, F.lit("-"), turn, F.lit("-"), ln).alias("external_id"),
        F.when(~mine, F.concat(F.lit("P"), speaker)).alias("sender_name"),
        F.when((conv % 11 == 0) & (turn == 1), '{"origin": "chat"}').alias("meta"),
    )


def chat_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return (
        table(spark, sf_dir, "conversations")
        .select("conv_id")
        .distinct()
        .select(
            conv.alias("id"),
            (conv % 3 + 1).alias("source_id"),
            F.concat(F.lit("chat-"), conv).alias("external_id"),
            F.when(conv % 2 == 0, F.concat(F.lit("Chat "), conv)).alias("title"),
            (conv % 5 == 0).alias("is_group"),
        )
    )


def turn_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation attributes in the form the example builder takes."""
    return chat_conversations(spark, sf_dir).select(
        F.col("id").alias("conversation_id"),
        "title",
        "is_group",
        pick(SOURCE_KINDS, F.col("source_id") - 1).alias("source_kind"),
    )


def doc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") + DOC_ID).alias("id"),
        (number + DOC_CONV).alias("conversation_id"),
        F.lit(None).cast("long").alias("contact_id"),
        F.lit(True).alias("is_me"),
        F.timestamp_seconds(F.lit(BASE_S) + F.col("doc_id") * 60).alias("ts"),
        F.lit("doc").alias("register"),
        guess_lang(F.col("text")).alias("lang"),
        "text",
        word_count(F.col("text")).alias("word_count"),
        F.concat(F.lit("d"), F.col("doc_id")).alias("external_id"),
        F.lit(None).cast("string").alias("sender_name"),
        F.lit(None).cast("string").alias("meta"),
    )


def doc_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    return (
        table(spark, sf_dir, "documents")
        .select("source")
        .distinct()
        .select(
            (number + DOC_CONV).alias("id"),
            F.lit(4).cast("long").alias("source_id"),
            F.col("source").alias("external_id"),
            F.col("source").alias("title"),
            F.lit(False).alias("is_group"),
        )
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_messages(spark, sf_dir).unionByName(doc_messages(spark, sf_dir))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_conversations(spark, sf_dir).unionByName(doc_conversations(spark, sf_dir))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in use, plus one per region that has no conversations yet."""
    used = (
        conversations(spark, sf_dir)
        .select(F.col("source_id").alias("id"))
        .distinct()
        .withColumn("kind", pick([*SOURCE_KINDS, "doc"], F.col("id") - 1))
        .withColumn("label", F.concat(F.lit("Source "), F.col("id")))
    )
    idle = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 10).cast("long").alias("id"),
        F.lit("import").alias("kind"),
        F.col("r_name").alias("label"),
    )
    return used.unionByName(idle).select(
        "id",
        "kind",
        "label",
        F.concat(F.lit("/data/"), F.col("id")).alias("locator"),
        F.lit("").alias("device_uid"),
        F.timestamp_seconds(F.lit(BASE_S)).alias("created_at"),
        F.lit(None).cast("timestamp").alias("last_import_at"),
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        chat_messages(spark, sf_dir)
        .filter("contact_id is not null")
        .groupBy(F.col("contact_id").alias("id"))
        .agg(F.min("sender_name").alias("name"))
    )
    return rows.select(
        "id",
        handle_hash(SALT, F.concat(F.lit("contact"), F.col("id"))).alias("handle_hash"),
        F.when(F.col("id") != 3, F.col("name")).alias("display_name"),
        F.lit(False).alias("is_me"),
    )


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory per user turn."""
    id = F.col("conv_id") * 100 + F.col("turn")
    at = lambda extra: F.timestamp_seconds(F.lit(BASE_S) + id * 60 + extra)
    return (
        table(spark, sf_dir, "conversations")
        .filter(F.col("role") == "user")
        .select(
            id.alias("id"),
            F.concat(F.lit("m"), id).alias("uid"),
            pick(list(MEMORY_KINDS), id % 7).alias("kind"),
            "text",
            F.lit("explicit").alias("source_kind"),
            F.concat(F.lit("c"), id % 1000).alias("source_ref"),
            (0.5 + (id % 5) / 10).alias("confidence"),
            at(0).alias("created_at"),
            at((id % 13) * 3600).alias("updated_at"),
            F.lit(None).cast("timestamp").alias("expires_at"),
            (id % 9 == 0).alias("archived"),
        )
    )


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    ts = F.col("ts").cast("timestamp")
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair])
    audio = kind.isin("view", "click", "error")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("c"), F.col("event_id")).alias("uid"),
        F.concat(F.lit("d"), F.col("user_id")).alias("device_uid"),
        "user_id",
        F.when(audio, "audio").otherwise("text").alias("kind"),
        F.when(kind.isin("click", "purchase"), "manual").otherwise("listener").alias("origin"),
        status[kind].alias("status"),
        ts.alias("client_ts"),
        (ts + F.expr("interval 5 minutes")).alias("received_at"),
        F.when(kind.isin("view", "click"), ts + F.expr("interval 10 minutes")).alias("processed_at"),
        F.concat(
            F.when(F.col("user_id") % 2 == 0, "Remember that ").otherwise("I saw "),
            kind,
            F.lit(" code "),
            F.get_json_object("props", "$.k"),
            F.lit(" for device "),
            F.col("user_id"),
        ).alias("text"),
        F.when(audio, F.concat(F.lit("audio/"), F.col("event_id"), F.lit(".wav"))).alias("audio_path"),
        (value / 4).alias("duration_s"),
        F.when(audio & (kind != "click"), F.col("user_id") % 3 == 0).alias("speaker_is_me"),
        F.when(audio & (F.col("user_id") % 4 != 0), F.round((value % 10) / 10, 3)).alias("speaker_score"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored frames: one device per user, numbered in time order."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("at"), "event_id", "value"
    )
    ranked = bucketed_rank(
        rows, ["device"], F.date_trunc("day", "at"), [F.col("at"), F.col("event_id")], "_r"
    )
    return ranked.select(
        "device",
        (F.col("_r") - 1).alias("frame_no"),
        F.timestamp_micros(F.lit(BASE_S * 1_000_000) + (F.col("_r") - 1) * 32_000).alias("ts"),
        F.least(F.lit(1.0), F.col("value") / 40).alias("prob"),
        (F.col("value") / 2 - 60).alias("level_db"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector with the number of the query."""
    asked = queries(spark, sf_dir).select("query_id")
    return vectors(spark, sf_dir).join(asked, F.col("id") == F.col("query_id")).select("query_id", "vec")
