"""The memories table: listing, edits, rule and reply extraction, near-duplicate suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identity import hash_long
from palimpsest.functions.memory_rules import candidate, reply_items, rule_memory
from palimpsest.functions.text import comparison_tokens, jaccard, strip, word_count
from palimpsest.operators.scale import folded_patches
from palimpsest.operators.search import keyword_search
from palimpsest.operators.similarity import first_independent, similar_sets
from palimpsest.session import materialize

SIMILAR = 0.7
COMPARED_HITS = 5


def list_memories(
    memories: DataFrame,
    since=None,
    limit: int | None = 100,
    include_archived: bool = False,
    kind: str | None = None,
) -> DataFrame:
    """Newest memories, optionally changed after ``since``, of one kind, archived included."""
    rows = memories
    if since is not None:
        rows = rows.filter(F.col("updated_at") > F.lit(since).cast("timestamp"))
    if not include_archived:
        rows = rows.filter(~F.col("archived"))
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if limit is None:
        return rows
    return rows.orderBy(F.col("updated_at").desc(), "uid").limit(limit)


def memory_export(memories: DataFrame) -> DataFrame:
    """Every memory, archived ones too, each once."""
    return list_memories(memories, limit=None, include_archived=True)


def write_memory_export(memories: DataFrame, path: str) -> None:
    memory_export(memories).write.mode("overwrite").json(path)


def create_memories(memories: DataFrame, new: DataFrame, now) -> DataFrame:
    """Add memories whose uid is unknown; texts are trimmed, both stamps are ``now``.

    Of several rows with one uid the first in row order counts.
    """
    at = F.lit(now).cast("timestamp")
    first = (
        new.withColumn("_order", F.monotonically_increasing_id())
        .groupBy("uid")
        .agg(F.min_by(F.struct(*[c for c in new.columns if c != "uid"]), "_order").alias("_m"))
    )
    fresh = (
        first.join(memories.select("uid"), "uid", "left_anti")
        .select("uid", "_m.*")
        .withColumn("text", strip(F.col("text")))
        .withColumn("created_at", at)
        .withColumn("updated_at", at)
        .withColumn("archived", F.lit(False))
    )
    return memories.unionByName(fresh, allowMissingColumns=True)


def update_memories(memories: DataFrame, patches: DataFrame, now, order: str | None = None) -> DataFrame:
    """Non-NULL patch fields override; ``updated_at`` moves for every patched uid.

    Several patches of one uid apply one after the other (see ``folded_patches``).
    """
    patches = folded_patches(patches, order=order)
    fields = [c for c in patches.columns if c != "uid"]
    side = patches.select(
        "uid", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields]
    )
    return memories.join(side, "uid", "left").select(
        *[
            F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c)
            if c in fields
            else F.when(F.col("_hit"), F.lit(now).cast("timestamp")).otherwise(F.col(c)).alias(c)
            if c == "updated_at"
            else F.col(c)
            for c in memories.columns
        ]
    )


def delete_by_uid(df: DataFrame, uids: DataFrame) -> DataFrame:
    return df.join(uids.select("uid"), "uid", "left_anti")


def memory_ids_by_uid(memories: DataFrame, uids: DataFrame) -> DataFrame:
    return memories.select("uid", "id").join(uids.select("uid").distinct(), "uid", "left_semi")


def extract_memories(utterances: DataFrame) -> DataFrame:
    """Explicit requests to remember in (uid, text), at most one per utterance."""
    # A generator keeps the rule from being evaluated a second time inside a pushed-down filter.
    found = utterances.select(
        "uid", F.explode_outer(F.array(rule_memory(F.col("text")))).alias("m")
    ).filter("m is not null")
    return found.select(
        hash_long(F.lit("explicit"), F.col("uid")).cast("string").alias("uid"),
        F.col("m.kind").alias("kind"),
        F.col("m.text").alias("text"),
        F.lit("explicit").alias("source_kind"),
        F.col("uid").alias("source_ref"),
        F.col("m.confidence").alias("confidence"),
    )


def filter_candidates(replies: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Candidates from model replies (source_ref, source_text, reply).

    Sources of at least 4 words, the first 8 items, texts of at least 4 characters, enough
    confidence; unknown kinds become facts.
    """
    items = (
        replies.filter(word_count(F.col("source_text")) >= 4)
        .select("source_ref", F.posexplode_outer(reply_items(F.col("reply"))).alias("pos", "item"))
        .filter("item is not null")
        .select("source_ref", "pos", candidate(F.col("item")).alias("c"))
    )
    return items.select("source_ref", "pos", "c.*").filter(
        (F.length("text") >= 4) & (F.col("confidence") >= min_confidence)
    )


def drop_similar(candidates: DataFrame, memories: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Candidates (id, text) unlike every one of their 5 best keyword hits among live memories."""
    docs = memories.select("id", "text", (~F.col("archived")).alias("hit"))
    queries = candidates.select(F.col("id").alias("query_id"), "text")
    hits = keyword_search(docs, queries, COMPARED_HITS)
    near = (
        hits.join(memories.select("id", comparison_tokens(F.col("text")).alias("theirs")), "id")
        .join(queries.select("query_id", comparison_tokens(F.col("text")).alias("ours")), "query_id")
        .filter(jaccard(F.col("ours"), F.col("theirs")) >= threshold)
        .select(F.col("query_id").alias("id"))
        .distinct()
    )
    return candidates.join(near, "id", "left_anti")


def suppress_similar(candidates: DataFrame, memories: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Candidates (id, text) as if added one by one, smallest id first, each unless it is similar to
    a live memory or to a candidate added before it.

    Similar are texts whose distinct folded words have a Jaccard similarity of ``threshold`` or
    more; texts without words are like nothing. All pairs count, not only the best keyword hits.
    """
    words = comparison_tokens(F.col("text")).alias("tokens")
    sets = materialize(candidates.select("id", words))
    live = memories.filter(~F.col("archived")).select("id", words)
    known = similar_sets(sets, live, threshold).select(F.col("left_id").alias("id"))
    # of equal sets the first speaks for all; the others are like it
    own = F.when(F.size("tokens") > 0, F.to_json(F.array_sort("tokens"))).otherwise(F.to_json(F.array(F.struct("id"))))
    first = sets.groupBy(own.alias("_w")).agg(F.min("id").alias("id"), F.first("tokens").alias("tokens"))
    fresh = materialize(first.select("id", "tokens").join(known, "id", "left_anti"))
    edges = similar_sets(fresh, fresh, threshold).filter("left_id < right_id")
    kept = first_independent(fresh.select("id"), edges.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    return candidates.join(kept, "id", "left_semi")


def extract_from_replies(
    replies: DataFrame, memories: DataFrame, min_confidence: float = 0.5
) -> DataFrame:
    """New memories from a table of model replies, by (source_ref, position in the reply).

    A candidate similar to a live memory, or to one that an earlier candidate became, is left out.
    """
    found = filter_candidates(replies, min_confidence).withColumn("id", F.struct("source_ref", "pos"))
    uid = hash_long(F.lit("extracted"), F.col("source_ref"), F.col("pos").cast("string"))
    return suppress_similar(found, memories).select(
        uid.cast("string").alias("uid"),
        "kind",
        "text",
        F.lit("extracted").alias("source_kind"),
        "source_ref",
        "confidence",
    )
