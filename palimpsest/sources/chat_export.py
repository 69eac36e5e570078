"""Chat exports: one text file per conversation, one or more lines per message."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.dates import build_datetime, date_fields
from palimpsest.functions.exports import (
    BRACKETED,
    DASHED,
    PHONE_SENDER,
    header,
    sender_and_body,
    title_from_name,
    without_marks,
)
from palimpsest.functions.identity import is_owner
from palimpsest.sources.files import estimate_rows, file_stem, parent_name, read_lines
from palimpsest.sources.hidden_text import read_hidden_lines
from palimpsest.sources.registry import register_source

HEADER_PATTERN = f"(?:{BRACKETED})|(?:{DASHED})"


def attach_continuations(lines: DataFrame) -> DataFrame:
    """Group lines into messages: (path, hblock, hno, block, pos, line, h).

    ``lines``: path, block, pos, line. Headers are counted inside (path, block); lines before
    the first header of a block belong to the last header of the blocks before it, which is
    looked up in a table of one row per block. A long file is thus many tasks.
    """
    rows = lines.withColumn("h", header(F.col("line")))
    in_block = Window.partitionBy("path", "block").orderBy("pos")
    counted = rows.withColumn("hno", F.sum(F.col("h").isNotNull().cast("long")).over(in_block))
    per_block = counted.groupBy("path", "block").agg(F.max("hno").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.col("n") > 0, F.struct(F.col("block").alias("b"), F.col("n").alias("n")))
    carry = per_block.select("path", "block", F.last(last, ignorenulls=True).over(earlier).alias("c"))
    own = F.col("hno") > 0
    return (
        counted.join(carry, ["path", "block"])
        .withColumn("hblock", F.when(own, F.col("block")).otherwise(F.col("c.b")))
        .withColumn("hno", F.when(own, F.col("hno")).otherwise(F.col("c.n")))
        .filter("hblock is not null")
        .drop("c")
    )


def detect_date_order(headers: DataFrame) -> DataFrame:
    """(path, order): field order voted by every date of a file. ``headers``: path, h."""
    f = date_fields(F.col("h.date"))
    votes = headers.select("path", f.alias("f")).groupBy("path").agg(
        F.bool_or(F.col("f.a") >= 100).alias("year_first"),
        F.bool_or((F.col("f.a") > 12) & (F.col("f.a") < 100)).alias("day_first"),
        F.bool_or(F.col("f.b") > 12).alias("month_first"),
        F.bool_or("f.dot").alias("dotted"),
    )
    return votes.select(
        "path",
        F.when(F.col("year_first"), "ymd")
        .when(F.col("day_first"), "dmy")
        .when(F.col("month_first"), "mdy")
        .when(F.col("dotted"), "dmy")
        .otherwise("mdy")
        .alias("order"),
    )


def participants(headers: DataFrame) -> DataFrame:
    """(path, participants): distinct senders in order of first appearance."""
    seen = (
        headers.filter("s is not null")
        .groupBy("path", F.col("s.sender").alias("sender"))
        .agg(F.min(F.struct("block", "pos")).alias("at"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "sender")))
    return seen.groupBy("path").agg(F.transform(ordered, lambda x: x["sender"]).alias("participants"))


def parse_export(
    lines: DataFrame,
    names: Sequence[str] = (),
    phones: Sequence[str] = (),
    tz: str = "UTC",
) -> DataFrame:
    """Canonical messages from export lines (path, block, pos, line).

    Files in which nobody is the owner are left out.
    """
    attached = attach_continuations(lines)
    heads = attached.filter("h is not null").select(
        "path", "block", "pos", "h", sender_and_body(F.col("h.rest")).alias("s")
    )

    def mine(sender: Column) -> Column:
        phone = F.when(sender.rlike(PHONE_SENDER), sender)
        return is_owner(phone, sender, names=names, phones=phones)

    stem = F.when(file_stem(F.col("path")) == "_chat", parent_name(F.col("path"))).otherwise(
        file_stem(F.col("path"))
    )
    files = (
        participants(heads)
        .withColumn("others", F.filter("participants", lambda p: ~mine(p)))
        .filter(F.size("others") < F.size("participants"))
        .join(detect_date_order(heads), "path")
        .select(
            "path",
            "order",
            stem.alias("name"),
            F.when(F.size("others") > 0, F.array_join("others", ", "))
            .otherwise(title_from_name(stem))
            .alias("title"),
            (F.size("others") > 1).alias("is_group"),
        )
    )
    item = F.struct("block", "pos", F.when(F.col("h").isNull(), without_marks(F.col("line"))).alias("t"))
    grouped = attached.groupBy("path", "hblock", "hno").agg(
        F.array_sort(F.collect_list(item)).alias("parts"),
        F.max(F.when(F.col("h").isNotNull(), F.struct("pos", "h"))).alias("head"),
    )
    more = F.transform(F.slice("parts", F.lit(2), F.size("parts")), lambda p: p["t"])
    messages = (
        grouped.select(
            "path",
            F.col("head.pos").alias("seq"),
            F.col("head.h").alias("h"),
            sender_and_body(F.col("head.h.rest")).alias("s"),
            more.alias("more"),
        )
        .filter("s is not null")
        .join(files, "path")
        .withColumn("ts", build_datetime(date_fields(F.col("h.date")), F.col("h.time"), F.col("order")))
        .filter("ts is not null")
    )
    sender = F.col("s.sender")
    phone = sender.rlike(PHONE_SENDER)
    return messages.withColumn("is_me", mine(sender)).select(
        F.col("name").alias("conversation_external_id"),
        F.array_join(F.concat(F.array("s.body"), F.col("more")), "\n").alias("text"),
        F.to_utc_timestamp("ts", tz).alias("ts"),
        "is_me",
        F.lit("text").alias("register"),
        F.lit(None).cast("string").alias("external_id"),
        F.col("title").alias("conversation_title"),
        "is_group",
        F.when(~F.col("is_me") & phone, sender).alias("sender_handle"),
        F.when(~F.col("is_me") & ~phone, sender).alias("sender_name"),
        F.lit(None).cast("map<string,string>").alias("meta"),
        "seq",
    )


@register_source("chat_export", kind="whatsapp", register="text", label="chat export")
def read_chat_export(
    spark: SparkSession, path: str, names: Sequence[str] = (), phones: Sequence[str] = (), tz: str = "UTC"
) -> DataFrame:
    if not [n for n in (*names, *phones) if n.strip()]:
        raise ValueError("say who you are: pass names or phones")
    lines = read_lines(spark, path).unionByName(read_hidden_lines(spark, path))
    return parse_export(lines, names, phones, tz)


def estimate_chat_export(spark: SparkSession, path: str) -> DataFrame:
    return estimate_rows(spark, path, HEADER_PATTERN, "*.txt", limit_bytes=1 << 62)
