"""Keyword, vector and fused search; embeddings; prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import vectors as vec
from palimpsest.operators import chat, embeddings, search
from palimpsest.operators.scale import top_per_group
from palimpsest.operators.voice import vector_sums
from palimpsest.plans import sql as q
from palimpsest.plans.adapters import (
    chat_messages,
    memories,
    queries,
    query_vectors,
    table,
    vectors,
)
from palimpsest.plans.registry import query


def bm25(docs: str, asked: str, k: int, name: str = "kw") -> dict[str, str]:
    """WITH entries: BM25 top k of ``docs`` (id, text, hit) for ``asked`` (query_id, text)."""
    return {
        f"{name}_tok": f"SELECT id, hit, t, len(t) AS dl FROM (SELECT id, hit, {q.tokens('text')} AS t FROM {docs})",
        f"{name}_size": f"SELECT count(*) AS n, avg(dl) AS avg_dl FROM {name}_tok",
        f"{name}_q": f"SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({q.tokens('text')}) AS term FROM {asked}) GROUP BY ALL",
        f"{name}_tf": f"SELECT id, hit, dl, term, count(*) AS tf FROM (SELECT id, hit, dl, unnest(t) AS term FROM {name}_tok) "
        f"WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL",
        f"{name}_idf": f"SELECT term, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) AS idf, avg_dl FROM "
        f"(SELECT term, count(*) AS df FROM {name}_tf GROUP BY term), {name}_size",
        f"{name}_score": f"SELECT query_id, id, sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score "
        f"FROM {name}_tf JOIN {name}_idf USING (term) JOIN {name}_q USING (term) WHERE hit GROUP BY ALL",
        name: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {name}_score) WHERE rank <= {k}",
    }


def nearest(vectors_: str, asked: str, k: int, name: str = "vs") -> dict[str, str]:
    """WITH entries: exact top k by dot product of ``vectors_`` (id, vec) for ``asked`` (query_id, vec)."""
    return {
        f"{name}_score": f"SELECT query_id, v.id, list_dot_product(a.vec, v.vec) AS score FROM {vectors_} v CROSS JOIN {asked} a",
        name: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {name}_score) WHERE rank <= {k}",
    }


_VEC = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"
_ASKED = "SELECT item_id AS query_id, text FROM benchmark"
_ASKED_VEC = "SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS vec FROM benchmark JOIN embeddings ON vec_id = item_id"
_DOCS = "SELECT doc_id AS id, text, coalesce(l.toxic, 0) = 0 AS hit FROM documents LEFT JOIN labels l USING (doc_id)"
_RRF = (
    "SELECT query_id, id, sum(1.0 / (60 + rank)) AS score FROM "
    "(SELECT query_id, id, rank FROM kw UNION ALL SELECT query_id, id, rank FROM vs) GROUP BY ALL"
)


def doc_memories(spark, sf):
    """Documents as memories; those labelled toxic are archived."""
    toxic = table(spark, sf, "labels").select("doc_id", "toxic")
    return (
        table(spark, sf, "documents")
        .join(toxic, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            "text",
            (F.coalesce("toxic", F.lit(0)) == 1).alias("archived"),
            F.timestamp_seconds(F.col("doc_id")).alias("updated_at"),
        )
    )


@query(
    "keyword_search",
    "WITH " + ", ".join(f"{n} AS ({s})" for n, s in {
        "docs": "SELECT doc_id AS id, text, true AS hit FROM documents", "asked": _ASKED, **bm25("docs", "asked", 10)
    }.items())
    + " SELECT query_id, id, round(score, 6) AS score, rank FROM kw",
)
def keyword_search(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = search.keyword_search(docs, queries(spark, sf), 10)
    return hits.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query(
    "message_search",
    q.with_tables(
        "chat_msg",
        docs="SELECT id, text, is_me AS hit FROM chat_msg",
        asked=_ASKED,
        **bm25("docs", "asked", 20),
    )
    + "SELECT query_id, id, round(score, 6) AS score, register FROM kw JOIN chat_msg USING (id)",
)
def message_search(spark, sf):
    hits = search.search_messages(chat_messages(spark, sf), queries(spark, sf))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "register")


@query(
    "query_terms",
    f"SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({q.tokens('text')}) AS term FROM benchmark) GROUP BY ALL",
)
def query_terms(spark, sf):
    return search.query_term_table(queries(spark, sf))


@query(
    "postings",
    f"SELECT conv_id AS id, term, count(*) AS tf FROM (SELECT conv_id, unnest({q.tokens('text')}) AS term FROM conversations) GROUP BY ALL",
)
def postings(spark, sf):
    docs = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "text")
    return search.postings(docs).select("id", "term", "tf")


@query(
    "vector_search",
    "WITH " + ", ".join(f"{n} AS ({s})" for n, s in {
        "v": _VEC, "a": _ASKED_VEC, **nearest("v", "a", 10)}.items())
    + " SELECT query_id, id, round(score, 6) AS score, rank FROM vs",
)
def vector_search(spark, sf):
    hits = search.vector_topk(vectors(spark, sf), query_vectors(spark, sf), 10)
    return hits.select(
        "query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


@query(
    "centroid_neighbours",
    f"""WITH v AS ({_VEC}), e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
      s AS (SELECT label, i, sum(x) AS x FROM e GROUP BY ALL),
      n AS (SELECT label, list(x ORDER BY i) AS s, sqrt(sum(x * x)) AS norm FROM s GROUP BY label),
      a AS (SELECT label AS query_id, list_transform(s, lambda x: x / norm) AS vec FROM n), """
    + ", ".join(f"{n} AS ({s})" for n, s in nearest("v", "a", 5).items())
    + " SELECT CAST(query_id AS BIGINT) AS query_id, id, round(score, 6) AS score FROM vs",
)
def centroid_neighbours(spark, sf):
    """The vectors closest to the unit centroid of every label."""
    rows = vectors(spark, sf)
    centres = vector_sums(rows, "label").select(
        F.col("label").cast("long").alias("query_id"), vec.unit(F.col("vec")).alias("vec")
    )
    hits = search.vector_topk(rows, centres, 5)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


@query(
    "rank_fusion",
    f"WITH docs AS ({_DOCS}), asked AS ({_ASKED}), v AS ({_VEC}), a AS ({_ASKED_VEC}), "
    + ", ".join(
        f"{n} AS ({s})" for n, s in {**bm25("docs", "asked", 16), **nearest("v", "a", 16), "rrf": _RRF}.items()
    )
    + " SELECT query_id, id, round(score, 9) AS score FROM rrf",
)
def rank_fusion(spark, sf):
    toxic_free = doc_memories(spark, sf).withColumn("hit", ~F.col("archived"))
    kw = search.rank_hits(
        search.keyword_search(toxic_free.select("id", "text", "hit"), queries(spark, sf), 16).drop("rank")
    )
    vs = search.rank_hits(
        search.vector_topk(vectors(spark, sf), query_vectors(spark, sf), 16).drop("rank")
    )
    return search.fuse(kw, vs).withColumn("score", F.round("score", 9))


_FUSED = {
    **bm25("docs", "asked", 16),
    **nearest("v", "a", 16),
    "rrf": _RRF,
    "top": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM rrf) WHERE rank <= 8",
}
_MEMORY_SQL = (
    f"WITH docs AS ({_DOCS}), asked AS ({_ASKED}), v AS ({_VEC}), a AS ({_ASKED_VEC}), "
    + ", ".join(f"{n} AS ({s})" for n, s in _FUSED.items())
)


def found_memories(spark, sf):
    return search.search_memories(
        doc_memories(spark, sf), vectors(spark, sf), queries(spark, sf), query_vectors(spark, sf)
    )


@query(
    "memory_search",
    _MEMORY_SQL
    + " SELECT query_id, id, round(t.score, 9) AS score, t.rank FROM top t JOIN docs USING (id) WHERE hit",
)
def memory_search(spark, sf):
    return found_memories(spark, sf).select(
        "query_id", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank")
    )


@query(
    "exemplar_search",
    q.with_tables(
        "chat_msg",
        docs="SELECT id, text, is_me AND register = 'text' AS hit FROM chat_msg",
        asked=_ASKED,
        ids="SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM chat_msg WHERE is_me",
        v="SELECT ids.id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings JOIN ids ON vec_id = n",
        a=_ASKED_VEC,
        **bm25("docs", "asked", 12),
        **nearest("v", "a", 12),
        rrf=_RRF,
        top="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM rrf) WHERE rank <= 6",
    )
    + "SELECT t.query_id, t.id, round(t.score, 9) AS score FROM top t JOIN chat_msg m USING (id) WHERE m.is_me AND m.word_count BETWEEN 3 AND 120",
)
def exemplar_search(spark, sf):
    """My messages with the vectors of the same position."""
    from palimpsest.operators.scale import bucketed_rank

    rows = chat_messages(spark, sf)
    mine = rows.filter("is_me").select("id").withColumn("g", F.lit(1))
    numbered = bucketed_rank(mine, ["g"], F.floor(F.col("id") / 10**9), [F.col("id")], "n")
    with_vec = numbered.join(
        vectors(spark, sf).select((F.col("id") + 1).alias("n"), "vec"), "n"
    ).select("id", "vec")
    hits = search.search_exemplars(
        rows, with_vec, queries(spark, sf), query_vectors(spark, sf), k=6, register="text"
    )
    return hits.select("query_id", "id", F.round("score", 9).alias("score"))


@query(
    "newest_memories",
    q.with_tables("mem")
    + "SELECT 0::BIGINT AS query_id, id, row_number() OVER (ORDER BY updated_at DESC, id DESC) AS rank FROM mem WHERE NOT archived ORDER BY updated_at DESC, id DESC LIMIT 8",
)
def newest_memories(spark, sf):
    """A blank query lists the newest memories."""
    blank = queries(spark, sf).agg(F.lit(0).cast("long").alias("query_id"), F.lit(" ").alias("text"))
    rows = search.search_memories(memories(spark, sf), None, blank)
    return rows.select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query(
    "chat_prompts",
    _MEMORY_SQL
    + """, m AS (SELECT t.query_id, string_agg('- ' || text, chr(10) ORDER BY t.rank) AS bullets FROM top t JOIN docs USING (id) WHERE hit GROUP BY ALL)
      SELECT b.query_id, md5('You are Sam''s private personal assistant running on their own hardware. Be concise and direct. '
        || 'Use the memories below when they are relevant and say when you do not know something.' || chr(10) || chr(10)
        || 'Current time: 2024-01-01T00:00:00.000Z' || chr(10) || chr(10) || '## About Sam' || chr(10) || 'Likes tea.'
        || coalesce(chr(10) || chr(10) || '## Memories' || chr(10) || m.bullets, '')) AS system_md5, md5(b.text) AS user_md5
      FROM asked b LEFT JOIN m USING (query_id)""",
)
def chat_prompts(spark, sf):
    rows = chat.build_prompts(
        queries(spark, sf),
        found_memories(spark, sf),
        name="Sam",
        profile_text="Likes tea.",
        now_iso=F.lit("2024-01-01T00:00:00.000Z"),
    )
    content = lambda i: F.try_element_at("messages", F.lit(i))["content"]
    return rows.select(
        "query_id", F.md5(content(1)).alias("system_md5"), F.md5(content(-1)).alias("user_md5")
    )


# --- vector functions -------------------------------------------------------------------


@query(
    "unit_vectors",
    "SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, "
    "round(CASE WHEN list_dot_product(e, e) > 0 THEN e[1] / sqrt(list_dot_product(e, e)) ELSE e[1] END, 6) AS first "
    "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
)
def unit_vectors(spark, sf):
    return vectors(spark, sf).select(
        F.col("id").alias("vec_id"),
        F.round(vec.l2_norm(F.col("vec")), 6).alias("norm"),
        F.round(F.get(vec.unit(F.col("vec")), F.lit(0)), 6).alias("first"),
    )


@query(
    "frame_levels",
    "SELECT vec_id, round(greatest(-100, 10 * log10(list_dot_product(e, e) / len(e))), 6) AS level_db "
    "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
)
def frame_levels(spark, sf):
    return vectors(spark, sf).select(
        F.col("id").alias("vec_id"), F.round(vec.frame_dbfs(F.col("vec")), 6).alias("level_db")
    )


@query("hash_embeddings")
def hash_embeddings(spark, sf):
    rows = chat_messages(spark, sf).select(
        "id", vec.hash_embedder(256).column(F.col("text")).alias("vec")
    )
    return rows.select("id", F.size("vec").alias("dim"), F.round(vec.l2_norm(F.col("vec")), 4).alias("norm"))


# --- embedding store --------------------------------------------------------------------


def store(spark, sf):
    """The vectors as an embedding store: owners are documents."""
    return table(spark, sf, "embeddings").select(
        F.when(F.col("label") % 2 == 0, "message").otherwise("memory").alias("owner_kind"),
        F.col("vec_id").alias("owner_id"),
        F.when(F.col("label") < 5, "hash-8").otherwise("old").alias("model"),
        F.size("embedding").alias("dim"),
        F.col("embedding").alias("vec"),
    )


@query(
    "missing_vectors",
    "SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id "
    "AND e.label % 2 = 0 AND e.label < 5) ORDER BY doc_id DESC LIMIT 500",
)
def missing_vectors(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return embeddings.missing_vectors(docs, store(spark, sf), "message", "hash-8").select("id")


@query(
    "embedding_backfill",
    """WITH s AS (SELECT vec_id, label % 2 = 0 AS msg FROM embeddings WHERE label < 5),
      a AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM s WHERE msg)),
      b AS (SELECT conv_id * 100 + turn AS id FROM conversations WHERE role = 'user' AND conv_id * 100 + turn NOT IN (SELECT vec_id FROM s WHERE NOT msg))
      SELECT 'message' AS owner_kind, count(*) AS embedded FROM a UNION ALL SELECT 'memory', count(*) FROM b""",
)
def embedding_backfill(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.lit(True).alias("is_me")
    )
    new = embeddings.backfill(
        docs, memories(spark, sf), store(spark, sf), vec.hash_embedder(8), limit=None
    )
    return embeddings.backfill_counts(new)


@query(
    "embedding_upsert",
    """WITH s AS (SELECT CASE WHEN label % 2 = 0 THEN 'message' ELSE 'memory' END AS owner_kind, vec_id AS owner_id,
        CASE WHEN label < 5 THEN 'hash-8' ELSE 'old' END AS model, 64 AS dim FROM embeddings),
      n AS (SELECT 'message' AS owner_kind, item_id AS owner_id, 'hash-8' AS model, 8 AS dim FROM benchmark)
      SELECT * FROM s ANTI JOIN n USING (owner_kind, owner_id, model) UNION ALL SELECT * FROM n""",
)
def embedding_upsert(spark, sf):
    rows = queries(spark, sf).select(F.col("query_id").alias("id"), "text")
    new = embeddings.embed_rows(rows, vec.hash_embedder(8), "message")
    return embeddings.upsert_embeddings(store(spark, sf), new).drop("vec")


# --- chats ------------------------------------------------------------------------------


def chats(spark, sf):
    return (
        table(spark, sf, "conversations")
        .groupBy(F.col("conv_id").alias("id"))
        .agg(F.max("turn").alias("turns"))
        .select(
            "id",
            F.concat(F.lit("chat-"), "id").alias("uid"),
            F.timestamp_seconds(F.col("id") * 7919 % 100_003).alias("updated_at"),
        )
    )


def spoken(spark, sf):
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("chat_id"), "role", "text"
    )


@query(
    "chat_list",
    """WITH c AS (SELECT DISTINCT conv_id AS id, conv_id * 7919 % 100003 AS u FROM conversations),
      n AS (SELECT * FROM c ORDER BY u DESC, id LIMIT 50)
      SELECT n.id, 'chat-' || n.id AS uid, (SELECT md5(arg_min(text, turn)) FROM conversations WHERE conv_id = n.id) AS first_md5 FROM n""",
)
def chat_list(spark, sf):
    rows = chat.list_chats(chats(spark, sf), spoken(spark, sf))
    return rows.select("id", "uid", F.md5("first_text").alias("first_md5"))


@query(
    "chat_turns",
    "SELECT conv_id * 100 + turn AS id, role, md5(text) AS text_md5 FROM conversations WHERE conv_id = 12",
)
def chat_turn_rows(spark, sf):
    rows = chat.chat_turns(chats(spark, sf), spoken(spark, sf), "chat-12")
    return rows.select("id", "role", F.md5("text").alias("text_md5"))


@query(
    "chat_history",
    """SELECT conv_id * 100 + turn AS id, conv_id AS chat_id FROM conversations WHERE role IN ('user', 'assistant')
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""",
)
def chat_history(spark, sf):
    return chat.history_for(spoken(spark, sf), 3).select("id", "chat_id")


@query(
    "top_events_per_user",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events
      QUALIFY rank <= 5""",
)
def top_events_per_user(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    top = top_per_group(rows, ["user_id"], [F.col("value").desc(), F.col("event_id")], 5)
    return top.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))
