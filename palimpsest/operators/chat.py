"""Chat tables and retrieval-backed prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.prompts import chat_system_text
from palimpsest.operators.scale import top_per_group


def list_chats(chats: DataFrame, turns: DataFrame, limit: int = 50) -> DataFrame:
    """The newest chats with the text of their first turn."""
    first = turns.groupBy("chat_id").agg(F.min_by("text", "id").alias("first_text"))
    newest = chats.orderBy(F.col("updated_at").desc(), "id").limit(limit)
    return newest.join(first, newest["id"] == first["chat_id"], "left").drop("chat_id")


def chat_turns(chats: DataFrame, turns: DataFrame, chat_uid: str) -> DataFrame:
    chat = chats.filter(F.col("uid") == chat_uid).select(F.col("id").alias("chat_id"))
    return turns.join(chat, "chat_id").orderBy("id")


def history_for(turns: DataFrame, limit: int = 12) -> DataFrame:
    """The last ``limit`` user and assistant turns of every chat, oldest first."""
    spoken = turns.filter(F.col("role").isin("user", "assistant"))
    return (
        top_per_group(spoken, ["chat_id"], [F.col("id").desc()], limit, "age")
        .orderBy("chat_id", "id")
    )


def _texts(hits: DataFrame | None, name: str) -> DataFrame | None:
    if hits is None:
        return None
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return hits.groupBy("query_id").agg(F.transform(ordered, lambda h: h["text"]).alias(name))


def build_prompts(
    queries: DataFrame,
    memories: DataFrame | None,
    exemplars: DataFrame | None = None,
    history: DataFrame | None = None,
    name: str = "the user",
    mode: str = "assistant",
    register: str = "text",
    personal: bool = True,
    profile_text: str = "",
    now_iso: Column | None = None,
) -> DataFrame:
    """(query_id, messages): system text, history, then the query.

    ``memories`` and ``exemplars`` are search results (at most k rows per query); ``history``
    is (query_id, id, role, text). Exemplars are used in twin mode only.
    """
    none = F.array().cast("array<string>")
    rows = queries
    sides = [("_mem", memories), ("_ex", exemplars if mode == "twin" else None)]
    for column, hits in sides:
        if hits is None:
            rows = rows.withColumn(column, none)
        else:
            rows = rows.join(_texts(hits, column), "query_id", "left").withColumn(
                column, F.coalesce(column, none)
            )
    now_iso = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if now_iso is None else now_iso
    system = chat_system_text(
        name, mode, register, personal, F.lit(profile_text), F.col("_mem"), F.col("_ex"), now_iso
    )
    message = lambda role, content: F.struct(
        F.lit(role).alias("role"), content.alias("content")
    )
    before = F.array().cast("array<struct<role:string,content:string>>")
    if history is not None:
        said = F.array_sort(
            F.collect_list(F.struct("id", F.struct("role", F.col("text").alias("content")).alias("m")))
        )
        past = history.groupBy("query_id").agg(F.transform(said, lambda h: h["m"]).alias("_past"))
        rows = rows.join(past, "query_id", "left")
        before = F.coalesce(F.col("_past"), before)
    return rows.select(
        "query_id",
        F.concat(
            F.array(message("system", system)), before, F.array(message("user", F.col("text")))
        ).alias("messages"),
    )
