"""Keeping a table of text embeddings up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.vectors import Embedder

KEY = ["owner_kind", "owner_id", "model"]


def missing_vectors(
    rows: DataFrame, embeddings: DataFrame, owner_kind: str, model: str, limit: int | None = 500
) -> DataFrame:
    """Rows (id, text) without a vector for ``model``, newest first; all of them if no limit."""
    done = embeddings.filter(
        (F.col("owner_kind") == owner_kind) & (F.col("model") == model)
    ).select(F.col("owner_id").alias("id"))
    missing = rows.join(done, "id", "left_anti")
    return missing if limit is None else missing.orderBy(F.col("id").desc()).limit(limit)


def embed_rows(rows: DataFrame, embedder: Embedder, owner_kind: str) -> DataFrame:
    """Embedding rows for (id, text)."""
    return rows.select(
        F.lit(owner_kind).alias("owner_kind"),
        F.col("id").alias("owner_id"),
        F.lit(embedder.name).alias("model"),
        F.lit(embedder.dim).alias("dim"),
        embedder.column(F.col("text")).alias("vec"),
    )


def upsert_embeddings(store: DataFrame, new: DataFrame) -> DataFrame:
    """New vectors replace those with the same owner and model."""
    return store.join(new.select(*KEY), KEY, "left_anti").unionByName(new)


def backfill(
    messages: DataFrame,
    memories: DataFrame,
    embeddings: DataFrame,
    embedder: Embedder,
    limit: int | None = 500,
) -> DataFrame:
    """Vectors for my messages and for memories that have none yet."""
    mine = messages.filter("is_me").select("id", "text")
    parts = [("message", mine), ("memory", memories.select("id", "text"))]
    new = [
        embed_rows(missing_vectors(rows, embeddings, kind, embedder.name, limit), embedder, kind)
        for kind, rows in parts
    ]
    return new[0].unionByName(new[1])


def backfill_counts(new: DataFrame) -> DataFrame:
    return new.groupBy("owner_kind").agg(F.count("*").alias("embedded"))
