"""Exported tables of phone and messenger stores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from palimpsest.functions.dates import device_time
from palimpsest.functions.identity import jid_to_handle
from palimpsest.functions.text import strip
from palimpsest.sources.registry import register_source

# Fixed values.
GROUP_STYLE = 43
URL_BALLOON = "com.apple.messages.URLBalloonProvider"
ARCHIVE_CLASS = b"NSString"
ARCHIVE_MARK = b"\x01\x94\x84\x01\x2b"
SESSION_GROUP = 1
SESSION_STATUS = 3
TEXT_MESSAGE = 0


def archive_text(blob: bytes | None) -> str | None:
    """Text of a rich-text archive: class name, type mark, length (1, 2 or 4 bytes), UTF-8."""
    blob = bytes(blob or b"")
    name = blob.find(ARCHIVE_CLASS)
    mark = blob.find(ARCHIVE_MARK, name) if name >= 0 else -1
    body = blob[mark + len(ARCHIVE_MARK) :] if mark >= 0 else b""
    if not body:
        return None
    wide = {0x81: 2, 0x82: 4}.get(body[0], 0)
    size = int.from_bytes(body[1 : 1 + wide], "little") if wide else body[0]
    raw = body[1 + wide : 1 + wide + size]
    return raw.decode("utf-8", errors="replace") or None


@pandas_udf(T.StringType())
def attributed_body_text(blobs: pd.Series) -> pd.Series:
    return blobs.map(archive_text)


def first_chat(joins: DataFrame) -> DataFrame:
    """(message_id, chat_id): the first chat of each message."""
    return joins.groupBy("message_id").agg(F.min("chat_id").alias("chat_id"))


def phone_chats(chat: DataFrame, handle: DataFrame, chat_handle_join: DataFrame) -> DataFrame:
    """(chat_id, external_id, title, is_group)."""
    people = (
        chat_handle_join.join(
            handle.select(F.col("ROWID").alias("handle_id"), F.col("id").alias("h")), "handle_id"
        )
        .groupBy("chat_id")
        .agg(F.count("*").alias("n"), F.min_by("h", "handle_id").alias("only"))
    )
    n = F.coalesce("n", F.lit(0))
    style = F.col("style") if "style" in chat.columns else F.lit(None).cast("int")
    named = F.when(F.coalesce("display_name", F.lit("")) != "", F.col("display_name"))
    return chat.join(people, chat["ROWID"] == people["chat_id"], "left").select(
        chat["ROWID"].alias("chat_id"),
        F.when(F.coalesce("guid", F.lit("")) != "", F.col("guid"))
        .otherwise(F.concat(F.lit("chat:"), chat["ROWID"].cast("string")))
        .alias("external_id"),
        F.coalesce(named, F.when(n == 1, F.col("only")).otherwise(F.col("chat_identifier"))).alias(
            "title"
        ),
        F.coalesce(style == GROUP_STYLE, n > 1).alias("is_group"),
    )


def phone_messages(
    message: DataFrame,
    handle: DataFrame,
    chat: DataFrame,
    chat_message_join: DataFrame,
    chat_handle_join: DataFrame,
) -> DataFrame:
    """Canonical messages of a phone message store; events, reactions and app cards are dropped."""
    rows = message
    for column in ("item_type", "associated_message_type"):
        if column in message.columns:
            rows = rows.filter(F.col(column) == 0)
    if "balloon_bundle_id" in message.columns:
        rows = rows.filter(F.coalesce("balloon_bundle_id", F.lit("")).isin("", URL_BALLOON))
    text = F.when(F.coalesce("text", F.lit("")) != "", F.col("text"))
    if "attributedBody" in message.columns:
        # The archive is decoded only where there is no plain text.
        text = F.coalesce(
            text, attributed_body_text(F.when(text.isNull(), F.col("attributedBody")))
        )
    people = handle.select(F.col("ROWID").alias("handle_id"), F.col("id").alias("handle"))
    chats = phone_chats(chat, handle, chat_handle_join)
    joined = (
        rows.withColumn("body", text)
        .filter(strip(F.coalesce("body", F.lit(""))) != "")
        .join(people, "handle_id", "left")
        .join(first_chat(chat_message_join).withColumnRenamed("message_id", "ROWID"), "ROWID", "left")
        .join(chats, "chat_id", "left")
    )
    lone = F.coalesce(F.concat(F.lit("handle:"), F.col("handle")), F.lit("unknown"))
    me = F.col("is_from_me").cast("int") == 1
    in_chat = F.col("external_id").isNotNull()
    return joined.select(
        F.coalesce("external_id", lone).alias("conversation_external_id"),
        F.col("body").alias("text"),
        device_time(F.col("date")).alias("ts"),
        me.alias("is_me"),
        F.lit("text").alias("register"),
        F.col("guid").alias("external_id"),
        F.when(in_chat, F.col("title")).otherwise(F.col("handle")).alias("conversation_title"),
        F.coalesce("is_group", F.lit(False)).alias("is_group"),
        F.when(~me, F.col("handle")).alias("sender_handle"),
        F.lit(None).cast("string").alias("sender_name"),
        F.lit(None).cast("map<string,string>").alias("meta"),
        F.col("ROWID").cast("long").alias("seq"),
    )


def messenger_messages(message: DataFrame, session: DataFrame, member: DataFrame) -> DataFrame:
    """Canonical messages of a messenger store: text messages outside status sessions."""
    group = F.col("ZSESSIONTYPE") == SESSION_GROUP
    jid, name = F.col("ZCONTACTJID"), F.col("ZPARTNERNAME")
    full = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    partner = F.when(~group, jid_to_handle(jid))
    sessions = session.filter(
        F.coalesce(F.col("ZSESSIONTYPE"), F.lit(0)) != SESSION_STATUS
    ).select(
        F.col("Z_PK").alias("ZCHATSESSION"),
        F.coalesce(full(jid), F.concat(F.lit("session:"), F.col("Z_PK").cast("string"))).alias("conv"),
        F.coalesce(full(name), partner, jid).alias("title"),
        F.coalesce(group, F.lit(False)).alias("is_group"),
        partner.alias("partner"),
        F.when(~group, name).alias("partner_name"),
    )
    members = member.select(
        F.col("Z_PK").alias("ZGROUPMEMBER"),
        F.coalesce(jid_to_handle(F.col("ZMEMBERJID")), F.col("ZMEMBERJID")).alias("m_handle"),
        F.col("ZCONTACTNAME").alias("m_name"),
        F.lit(True).alias("m"),
    )
    stanza = full(F.col("ZSTANZAID")) if "ZSTANZAID" in message.columns else F.lit(None)
    me = F.col("ZISFROMME").cast("int") == 1
    by_member = F.col("is_group") & F.coalesce("m", F.lit(False))
    return (
        message.filter((F.col("ZMESSAGETYPE") == TEXT_MESSAGE) & (F.coalesce("ZTEXT", F.lit("")) != ""))
        .join(sessions, "ZCHATSESSION")
        .join(members, "ZGROUPMEMBER", "left")
        .select(
            F.col("conv").alias("conversation_external_id"),
            F.col("ZTEXT").alias("text"),
            device_time(F.col("ZMESSAGEDATE")).alias("ts"),
            me.alias("is_me"),
            F.lit("text").alias("register"),
            F.coalesce(stanza, F.col("Z_PK").cast("string")).alias("external_id"),
            F.col("title").alias("conversation_title"),
            "is_group",
            F.when(
                ~me,
                F.when(by_member, F.col("m_handle")).otherwise(
                    F.coalesce("partner", jid_to_handle(F.col("ZFROMJID")))
                ),
            ).alias("sender_handle"),
            F.when(
                ~me, F.when(by_member, F.col("m_name")).otherwise(F.col("partner_name"))
            ).alias("sender_name"),
            F.lit(None).cast("map<string,string>").alias("meta"),
            F.col("Z_PK").cast("long").alias("seq"),
        )
    )


def _tables(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names]


@register_source("phone_store", kind="imessage", label="phone messages")
def read_phone_store(spark: SparkSession, path: str) -> DataFrame:
    """A folder with the store's tables exported as parquet."""
    return phone_messages(
        *_tables(spark, path, "message", "handle", "chat", "chat_message_join", "chat_handle_join")
    )


@register_source("messenger_store", kind="whatsapp", label="messenger")
def read_messenger_store(spark: SparkSession, path: str) -> DataFrame:
    """A folder with the tables message, session and member exported as parquet."""
    return messenger_messages(*_tables(spark, path, "message", "session", "member"))
