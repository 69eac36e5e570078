"""Bursts of messages to turns, and the turns that precede a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import strip
from palimpsest.operators.scale import ROWS_PER_TASK, heavy_keys, time_cuts

BURST_GAP_S = 20 * 60
CONTEXT_MAX_AGE_S = 3 * 24 * 3600
CONTEXT_WINDOW = 8
TURNS_PER_BLOCK = 50_000

CONV = "conversation_id"
_MICROS = 1_000_000


def _prepared(messages: DataFrame) -> DataFrame:
    """Role, display line and the tags of the first message that shares a timestamp."""
    name = F.when(F.coalesce(F.col("sender_name"), F.lit("")) == "", "Them").otherwise(
        F.col("sender_name")
    )
    tie = [F.col(c) for c in ("seq", "id") if c in messages.columns]
    messages = messages.withColumn("_ord", F.struct(*tie) if len(tie) > 1 else tie[0])
    same_time = Window.partitionBy(*_part(messages), "ts").orderBy("_ord")
    return (
        messages.withColumn("_register", F.first("register").over(same_time))
        .withColumn("_lang", F.first("lang").over(same_time))
        .withColumn("_role", F.when(F.col("is_me"), "assistant").otherwise("user"))
        .withColumn("_name", name)
        .withColumn("_text", strip(F.col("text")))
        .filter(F.col("_text") != "")
        .withColumn(
            "_line",
            F.when(
                ~F.col("is_me") & F.coalesce(F.col("is_group"), F.lit(False)),
                F.concat(F.col("_name"), F.lit(": "), F.col("_text")),
            ).otherwise(F.col("_text")),
        )
        .withColumn("_at", F.unix_micros("ts"))
    )


def _part(df: DataFrame) -> list[str]:
    return [CONV, "_slice"] if "_slice" in df.columns else [CONV]


def _starts_turn(role: Column, at: Column, prev_role: Column, prev_at: Column, gap_s: int) -> Column:
    return (
        prev_role.isNull() | (prev_role != role) | (at - prev_at > gap_s * _MICROS)
    ).cast("long")


def _numbered(rows: DataFrame, gap_s: int) -> DataFrame:
    """Turn numbers with one window per conversation."""
    in_order = Window.partitionBy(CONV).orderBy("ts", "_ord")
    new = _starts_turn(
        F.col("_role"), F.col("_at"), F.lag("_role").over(in_order), F.lag("_at").over(in_order), gap_s
    )
    return rows.withColumn("_new", new).withColumn("turn_no", F.sum("_new").over(in_order))


def _numbered_in_slices(rows: DataFrame, gap_s: int) -> DataFrame:
    """Turn numbers when a conversation is cut into time slices.

    Slices exchange only their last message and their number of turn starts.
    """
    in_slice = Window.partitionBy(CONV, "_slice").orderBy("ts", "_ord")
    slices = Window.partitionBy(CONV).orderBy("_slice")
    last = rows.groupBy(CONV, "_slice").agg(
        F.max(F.struct("_at", "_ord", "_role")).alias("_last")
    )
    carried = last.select(
        CONV, "_slice", F.lag("_last").over(slices).alias("_carry")
    )
    new = _starts_turn(
        F.col("_role"),
        F.col("_at"),
        F.coalesce(F.lag("_role").over(in_slice), F.col("_carry._role")),
        F.coalesce(F.lag("_at").over(in_slice), F.col("_carry._at")),
        gap_s,
    )
    flagged = rows.join(carried, [CONV, "_slice"]).withColumn("_new", new).drop("_carry")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    starts = flagged.groupBy(CONV, "_slice").agg(F.sum("_new").alias("_starts"))
    offsets = starts.select(
        CONV, "_slice", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        flagged.join(offsets, [CONV, "_slice"])
        .withColumn("turn_no", F.sum("_new").over(in_slice) + F.col("_offset"))
        .drop("_offset")
    )


def _collapsed(rows: DataFrame, extra: list[str]) -> DataFrame:
    """One row per turn; a sliced conversation is joined up per slice first."""
    key = [*_part(rows), "turn_no"]
    order = F.struct("ts", "_ord")
    parts = rows.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("ts", "_ord", "_line", "_name"))).alias("_m"),
        F.first("_role").alias("role"),
        F.max("ts").alias("ts"),
        F.max_by("_register", order).alias("register"),
        F.max_by("_lang", order).alias("lang"),
        F.count("*").alias("n_messages"),
        *[F.first(c).alias(c) for c in extra],
    )
    parts = parts.withColumn("text", F.array_join(F.col("_m._line"), "\n")).withColumn(
        "names",
        F.when(F.col("role") == "user", F.array_distinct(F.col("_m._name"))).otherwise(
            F.array().cast("array<string>")
        ),
    ).drop("_m")
    if "_slice" not in rows.columns:
        return parts
    merged = parts.groupBy(CONV, "turn_no").agg(
        F.array_sort(F.collect_list(F.struct("_slice", "text", "names"))).alias("_p"),
        F.first("role").alias("role"),
        F.max("ts").alias("ts"),
        F.max_by("register", "_slice").alias("register"),
        F.max_by("lang", "_slice").alias("lang"),
        F.sum("n_messages").alias("n_messages"),
        *[F.first(c).alias(c) for c in extra],
    )
    return (
        merged.withColumn("text", F.array_join(F.col("_p.text"), "\n"))
        .withColumn("names", F.array_distinct(F.flatten(F.col("_p.names"))))
        .drop("_p")
    )


def build_turns(
    messages: DataFrame,
    conversations: DataFrame | None = None,
    gap_s: int = BURST_GAP_S,
    rows_per_task: int = ROWS_PER_TASK,
    force_split_check: bool = False,
) -> DataFrame:
    """Merge consecutive messages of one side into turns.

    ``messages``: conversation_id, id (and seq, the position in the source, where known), ts, is_me, text, register, lang, sender_name and, unless
    ``conversations`` brings it, is_group. A turn ends when the side changes or more than
    ``gap_s`` passes between messages. Its time is that of its last message; its register and
    language are those of the first message with that time. Columns of ``conversations`` are
    attached to every turn; ``all_mine`` tells whether nobody else wrote in the conversation.

    An ordinary conversation is shuffled once, by conversation_id, and everything up to the
    context window reuses that partitioning. Conversations above ``rows_per_task`` messages are
    cut into time slices that are processed in separate tasks.
    """
    heavy = heavy_keys(messages, CONV, rows_per_task, force_split_check)
    extra = [c for c in (conversations.columns if conversations is not None else []) if c != CONV]
    if conversations is None and "is_group" not in messages.columns:
        messages = messages.withColumn("is_group", F.lit(False))
    mine = Window.partitionBy(CONV)

    def ordinary(rows: DataFrame) -> DataFrame:
        if conversations is not None:
            rows = rows.join(conversations, CONV)
        turns = _collapsed(_numbered(_prepared(rows), gap_s), extra)
        return turns.withColumn("all_mine", F.min(F.col("role") == "assistant").over(mine))

    if not heavy:
        return ordinary(messages)
    cuts = time_cuts(messages, CONV, "ts", heavy, rows_per_task)
    # The heavy list is bounded by total rows / rows_per_task, so it may be broadcast.
    large = messages.join(F.broadcast(cuts), CONV)
    small = messages.join(F.broadcast(cuts.select(CONV)), CONV, "left_anti")
    if conversations is not None:
        of_large = conversations.join(F.broadcast(cuts.select(CONV)), CONV, "left_semi")
        large = large.join(F.broadcast(of_large), CONV)
    at = F.unix_micros("ts")
    large = large.withColumn("_slice", F.size(F.filter("cuts", lambda c: c <= at))).drop("cuts")
    owned = messages.join(F.broadcast(cuts.select(CONV)), CONV, "left_semi").groupBy(CONV).agg(
        F.min("is_me").alias("all_mine")
    )
    split = _collapsed(_numbered_in_slices(_prepared(large), gap_s), extra).join(
        F.broadcast(owned), CONV
    )
    return ordinary(small).unionByName(split)


def with_context(
    turns: DataFrame, window: int = CONTEXT_WINDOW, max_age_s: int = CONTEXT_MAX_AGE_S
) -> DataFrame:
    """Add ``context``: up to ``window`` preceding turns, those older than ``max_age_s`` dropped.

    Turns are framed in blocks with the last ``window`` turns of the previous block repeated,
    so a long conversation spreads over tasks; short ones stay in their partition.
    """
    block = F.floor(F.col("turn_no") / TURNS_PER_BLOCK)
    repeats = F.col("turn_no") % TURNS_PER_BLOCK >= TURNS_PER_BLOCK - window
    frame = Window.partitionBy(CONV, "_block").orderBy("turn_no").rowsBetween(-window, -1)
    item = F.struct("role", "text", "ts", "names")
    framed = (
        turns.withColumn("_home", block)
        .withColumn(
            "_block",
            F.explode(
                F.when(repeats, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
            ),
        )
        .withColumn("context", F.collect_list(item).over(frame))
        .filter(F.col("_block") == F.col("_home"))
        .drop("_block", "_home")
    )
    at = F.unix_micros("ts")
    return framed.withColumn(
        "context",
        F.filter("context", lambda t: at - F.unix_micros(t["ts"]) <= max_age_s * _MICROS),
    )


def fit_context(context: Column, budget: Column) -> Column:
    """Newest turns whose lengths (+16 each) fit ``budget``; the newest is always kept."""
    cost = F.transform(context, lambda t: F.length(t["text"]) + 16)

    def fits(i: Column) -> Column:
        rest = F.aggregate(
            F.slice(cost, i + 1, F.size(context)), F.lit(0), lambda acc, n: acc + n
        )
        return (i == F.size(context) - 1) | (rest <= budget)

    return F.filter(context, lambda t, i: fits(i))


def alternate(context: Column) -> Column:
    """Chat messages with strictly alternating roles: equal neighbours joined by a newline."""
    empty = F.array().cast("array<struct<role:string,content:string>>")

    def add(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(
            t["role"].alias("role"), F.concat_ws("\n", last["content"], t["text"]).alias("content")
        )
        fresh = F.struct(t["role"].alias("role"), t["text"].alias("content"))
        return F.when(
            F.coalesce(last["role"] == t["role"], F.lit(False)),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined)),
        ).otherwise(F.concat(acc, F.array(fresh)))

    return F.aggregate(context, empty, add)
