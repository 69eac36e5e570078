"""Keyword (BM25), vector and fused search for a table of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import query_terms, search_tokens, strip
from palimpsest.functions.vectors import RRF_K, rrf_term
from palimpsest.operators.scale import top_per_group

# Okapi constants and the floor that keeps very common terms from scoring below zero.
BM25_K1 = 1.2
BM25_B = 0.75
MIN_IDF = 1e-6
QUERIES_PER_BLOCK = 1024
VECTORS_PER_BLOCK = 4096
QUERY_BYTES = 64 << 20  # of the query matrix that a worker holds
BROADCAST_CHARS = 32_000_000
TERM_SALTS = 32
PAIRS_PER_TASK = 1_000_000  # (document, query) scores that a task may have to sum


# explode_outer, not explode: Spark would test "size(tokens) > 0" in a filter of its own below the
# generator and tokenize every text twice for it.


def query_term_table(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): folded search tokens of every query."""
    tokens = F.flatten(F.transform(query_terms(F.col("text")), search_tokens))
    return (
        queries.select("query_id", F.explode_outer(tokens).alias("term"))
        .filter("term is not null")
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def postings(docs: DataFrame) -> DataFrame:
    """(id, term, tf, dl): term counts with the length of the document in tokens."""
    tokens = docs.select("id", search_tokens(F.col("text")).alias("tokens"))
    return (
        tokens.select("id", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term"))
        .filter("term is not null")
        .groupBy("id", "term")
        .agg(F.first("dl").alias("dl"), F.count("*").alias("tf"))
    )


def _broadcastable(queries: DataFrame) -> bool:
    """Whether the query terms provably fit a broadcast: a term needs at least two characters."""
    chars = queries.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    return chars <= BROADCAST_CHARS


def keyword_search(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """BM25 top ``k`` of ``docs`` (id, text) per query (query_id, text): any term may match.

    An optional boolean column ``hit`` says which documents may be returned; term statistics
    always come from all of them.

    Only tokens some query asks for are shuffled, by document. With a query table of checked
    size the weights are broadcast, scores are summed inside the document's partition, and each
    task keeps ``k`` documents per query: what travels does not grow with the number of
    (query, document) matches. Larger query tables go through a join salted by document.

    Documents are dealt to a number of tasks set by documents times queries, not by bytes: few bytes
    of tokens can match every query, and the scores of a task are held in its memory.
    """
    small = _broadcastable(queries)
    send = F.broadcast if small else (lambda df: df)
    terms = query_term_table(queries)
    asked = send(terms.select("term").distinct())
    hit = F.col("hit") if "hit" in docs.columns else F.lit(True)
    tokens = docs.select("id", hit.alias("hit"), search_tokens(F.col("text")).alias("tokens"))
    size = tokens.agg(F.count("*").alias("n_docs"), F.avg(F.size("tokens")).alias("avg_dl")).first()
    n_docs, avg_dl = F.lit(size["n_docs"]), F.lit(size["avg_dl"]).cast("double")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size["n_docs"] * queries.count() // PAIRS_PER_TASK))
    matched = (
        tokens.select("id", "hit", F.size("tokens").alias("dl"), F.explode_outer("tokens").alias("term"))
        .join(asked, "term", "left_semi")
        .repartition(tasks, "id")
        .groupBy("id", "term")
        .agg(F.first("dl").alias("dl"), F.first("hit").alias("hit"), F.count("*").alias("tf"))
    )
    # `used` keeps the columns of both readers of `matched` equal, so its shuffle is shared.
    df = (
        matched.groupBy("term")
        .agg(F.count("*").alias("df"), F.max(F.col("dl") + F.col("hit").cast("int") + F.col("tf")).alias("used"))
        .filter("used > 0")
    )
    idf = df.select(
        "term",
        F.greatest(F.lit(MIN_IDF), F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("idf"),
    )
    weights = terms.join(idf, "term")
    key = ["term"]
    if small:
        weights = F.broadcast(weights)
    else:
        key = ["term", "_salt"]
        matched = matched.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(TERM_SALTS)))
        weights = weights.withColumn(
            "_salt", F.explode(F.expr(f"sequence(0L, {TERM_SALTS - 1}L)"))
        )
    length = 1 - BM25_B + BM25_B * F.col("dl") / avg_dl
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * length)
    scored = matched.filter("hit").join(weights, key).groupBy("id", "query_id").agg(F.sum(part).alias("score"))
    return top_per_group(scored, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k).select(
        "query_id", "id", "score", "rank"
    )


# --- vectors ----------------------------------------------------------------------------


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ids and scores of the ``k`` best columns, by score to nine places, then id.

    ``ids`` is one row for all, or one for each.
    """
    if scores.shape[1] <= k:
        return np.broadcast_to(ids, scores.shape), scores
    rounded = np.round(scores, 9)
    edge = np.partition(rounded, -k, axis=1)[:, -k]
    row, column = np.nonzero(rounded >= edge[:, None])  # the k best and ties with the last of them
    own = np.broadcast_to(ids, scores.shape)[row, column]
    order = np.lexsort((own, -rounded[row, column], row))
    row, column, own = row[order], column[order], own[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = place < k
    shape = (len(scores), k)
    return own[keep].reshape(shape), scores[row[keep], column[keep]].reshape(shape)


def _scan(shipped, k: int):
    """Task function: the best ``k`` vectors of all its batches for every query."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shipped.value
        best: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            ids, vec = batch.column(0).to_numpy(), batch.column(1)
            flat = vec.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            off = vec.offsets.to_numpy().astype(np.int64)
            usable = np.flatnonzero((np.diff(off) == matrix.shape[1]) & vec.is_valid().to_numpy(zero_copy_only=False))
            for at in range(0, len(usable), VECTORS_PER_BLOCK):
                rows = usable[at : at + VECTORS_PER_BLOCK]
                vectors = flat[off[rows][:, None] + np.arange(matrix.shape[1])]
                for n, begin in enumerate(range(0, len(names), QUERIES_PER_BLOCK)):
                    found = _best(ids[rows], matrix[begin : begin + QUERIES_PER_BLOCK] @ vectors.T, k)
                    if n == len(best):
                        best.append(found)
                    else:
                        best[n] = _best(*(np.hstack(x) for x in zip(best[n], found)), k)
        for n, (own, scores) in enumerate(best):
            asked = names[n * QUERIES_PER_BLOCK : (n + 1) * QUERIES_PER_BLOCK]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked, own.shape[1])), pa.array(own.ravel()), pa.array(scores.ravel())],
                names=["query_id", "id", "score"],
            )

    return score


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top ``k`` of ``vectors`` (id, vec) per query (query_id, vec) by dot product.

    The queries go to every worker as a matrix; each task walks its vectors once, in blocks, and
    keeps ``k`` of them per query. So vectors are never shuffled, and what is shuffled is ``k`` rows
    for each query and task. Query tables above ``QUERY_BYTES`` are cut into parts, each with a pass
    of its own. Vectors that are null or of another length than the queries are not found. Ties go
    to the smaller id.
    """
    spark = vectors.sparkSession
    asked = queries.filter("vec is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    parts = max(1, -(-size["n"] * 8 * (size["dim"] or 1) // QUERY_BYTES))
    rows = vectors.select(F.col("id").cast("long").alias("id"), "vec")
    scored = None
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
        names, flat = own.column("query_id").to_numpy(), own.column("vec").combine_chunks()
        if not len(names):
            continue
        dim = size["dim"]
        matrix = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(names), dim)
        shipped = spark.sparkContext.broadcast((names, matrix))
        found = rows.mapInArrow(_scan(shipped, k), "query_id bigint, id bigint, score double")
        scored = found if scored is None else scored.unionByName(found)
    if scored is None:
        scored = spark.createDataFrame([], "query_id bigint, id bigint, score double")
    return top_per_group(scored, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k)


# --- fusion -----------------------------------------------------------------------------


def rank_hits(hits: DataFrame) -> DataFrame:
    """0-based rank of each hit in its list, by score then id."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("id"))
    return hits.withColumn("rank", F.row_number().over(w) - 1)


def union_rankings(*rankings: DataFrame) -> DataFrame:
    out = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        out = out.unionByName(r.select("query_id", "id", "rank"))
    return out


def fuse(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lists with 0-based ranks."""
    return (
        union_rankings(*rankings)
        .groupBy("query_id", "id")
        .agg(F.sum(rrf_term(F.col("rank"), k)).alias("score"))
    )


def fetch_ranked(fused: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the fused ids with score and rank; missing rows drop out."""
    return rows.join(fused, "id")


def _fused_top(docs: DataFrame, vectors, queries, k: int, query_vectors) -> DataFrame:
    lists = [keyword_search(docs, queries, 2 * k).withColumn("rank", F.col("rank") - 1)]
    if vectors is not None and query_vectors is not None:
        lists.append(
            vector_topk(vectors, query_vectors, 2 * k).withColumn("rank", F.col("rank") - 1)
        )
    return top_per_group(fuse(*lists), ["query_id"], [F.round("score", 12).desc(), F.col("id")], k)


def search_memories(
    memories: DataFrame,
    vectors: DataFrame | None,
    queries: DataFrame,
    query_vectors: DataFrame | None = None,
    k: int = 8,
) -> DataFrame:
    """Fused keyword and vector search over live memories (id, text, archived, updated_at).

    The vector list may name archived memories; they take a place in the fused top ``k`` and
    then drop out. A blank query gives the newest ``k``.
    """
    live = memories.filter(~F.col("archived"))
    asked = queries.filter(strip(F.col("text")) != "")
    docs = memories.select("id", "text", (~F.col("archived")).alias("hit"))
    top = _fused_top(docs, vectors, asked, k, query_vectors)
    found = fetch_ranked(top, live).select("query_id", "id", "text", "score", "rank")
    recent = (
        live.orderBy(F.col("updated_at").desc(), F.col("id").desc())
        .limit(k)
        .select("id", "text", "updated_at")
    )
    w = Window.orderBy(F.col("updated_at").desc(), F.col("id").desc())
    # At most k rows: the unpartitioned window is bounded.
    newest = recent.withColumn("rank", F.row_number().over(w)).withColumn("_one", F.lit(1))
    blank = queries.filter(strip(F.col("text")) == "").select("query_id", F.lit(1).alias("_one"))
    listed = blank.join(newest, "_one").select(
        "query_id", "id", "text", F.lit(None).cast("double").alias("score"), "rank"
    )
    return found.unionByName(listed)


def exemplar_rows(messages: DataFrame, register: str | None = None) -> DataFrame:
    """My messages of 3 to 120 words, optionally of one register."""
    rows = messages.filter(F.col("is_me") & F.col("word_count").between(3, 120))
    return rows.filter(F.col("register") == register) if register else rows


def search_exemplars(
    messages: DataFrame,
    vectors: DataFrame | None,
    queries: DataFrame,
    query_vectors: DataFrame | None = None,
    k: int = 6,
    register: str | None = None,
) -> DataFrame:
    """Fused search over my messages. ``register`` restricts the keyword list only; the word
    filter applies after fusion, so fewer than ``k`` rows may remain."""
    hit = F.col("is_me")
    if register:
        hit = hit & (F.col("register") == register)
    asked = queries.filter(strip(F.col("text")) != "")
    top = _fused_top(
        messages.select("id", "text", hit.alias("hit")), vectors, asked, k, query_vectors
    )
    return fetch_ranked(top, exemplar_rows(messages)).select(
        "query_id", "id", "text", "score", "rank"
    )


def search_messages(
    messages: DataFrame, queries: DataFrame, limit: int = 20, me_only: bool = True
) -> DataFrame:
    """BM25 over message text; with ``me_only`` only my messages can be hits."""
    hit = F.col("is_me") if me_only else F.lit(True)
    hits = keyword_search(messages.select("id", "text", hit.alias("hit")), queries, limit)
    return fetch_ranked(hits, messages)
