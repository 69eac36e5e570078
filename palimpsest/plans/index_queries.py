"""Searches over a stored keyword index."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import index as ix
from palimpsest.plans import sql as q
from palimpsest.plans.adapters import chat_messages, queries, table
from palimpsest.plans.registry import query
from palimpsest.plans.stream_queries import work_dir


def phrase_bm25(docs: str, asked: str, k: int) -> dict[str, str]:
    """WITH entries: BM25 top k with phrases of ``docs`` (id, text, hit) for ``asked`` (query_id, text)."""
    return {
        "tok": f"SELECT id, hit, t, len(t) AS dl FROM (SELECT id, hit, {q.tokens('text')} AS t FROM {docs})",
        "size": "SELECT count(*) AS n, avg(dl) AS avg_dl FROM tok",
        "unit": "SELECT query_id, array_to_string(u, ' ') AS unit, u, count(*) AS qtf FROM (SELECT query_id, "
        + q.tokens("term")
        + f" AS u FROM (SELECT query_id, unnest(string_split_regex(replace(text, '\"', ''), '\\s+')) AS term FROM {asked})) "
        "WHERE len(u) > 0 GROUP BY ALL",
        "one": "SELECT id, hit, dl, term AS unit, count(*) AS tf FROM (SELECT id, hit, dl, unnest(t) AS term FROM tok) "
        "WHERE term IN (SELECT unit FROM unit WHERE len(u) = 1) GROUP BY ALL",
        # phrases of two words, the only ones asked for here
        "many": "SELECT id, hit, dl, a || ' ' || b AS unit, count(*) AS tf FROM (SELECT id, hit, dl, "
        "unnest(t[1:len(t) - 1]) AS a, unnest(t[2:]) AS b FROM tok) "
        "WHERE a || ' ' || b IN (SELECT unit FROM unit WHERE len(u) = 2) GROUP BY ALL",
        "tf": "SELECT * FROM one UNION ALL SELECT * FROM many",
        "idf": "SELECT unit, greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) AS idf, avg_dl FROM "
        "(SELECT unit, count(*) AS df FROM tf GROUP BY unit), size",
        "score": "SELECT query_id, id, sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score "
        "FROM tf JOIN idf USING (unit) JOIN unit USING (unit) WHERE hit GROUP BY ALL",
        "kw": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank "
        f"FROM score) WHERE rank <= {k}",
    }


def _with(docs: str, asked: str, k: int) -> str:
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in {"docs": docs, "asked": asked, **phrase_bm25("docs", "asked", k)}.items())


# words of the query in twos, written together: phrases
_PAIRED = "SELECT item_id AS query_id, regexp_replace(text, '(\\S+) (\\S+)', '\\1-\\2', 'g') AS text FROM benchmark"
_SHOWN = " SELECT query_id, id, round(score, 6) AS score, rank FROM kw"


def _paired(spark, sf):
    return queries(spark, sf).withColumn("text", F.regexp_replace("text", r"(\S+) (\S+)", "$1-$2"))


def _shown(hits):
    return hits.select(
        "query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank")
    )


def _documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "doc_id")


@query(
    "indexed_search",
    _with("SELECT doc_id AS id, text, true AS hit FROM documents", "SELECT item_id AS query_id, text FROM benchmark", 10)
    + _SHOWN,
)
def indexed_search(spark, sf):
    """An index built in two loads that overlap, then searched."""
    docs = _documents(spark, sf)
    first = docs.filter("doc_id % 3 <> 0").select("id", "text")
    index = ix.build_index(first, work_dir(spark, "index"), 16)
    index = ix.add_documents(index, docs.select("id", "text"))
    return _shown(ix.keyword_search(index, queries(spark, sf), 10))


@query(
    "indexed_phrases",
    _with(
        "SELECT doc_id AS id, text, true AS hit FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0",
        _PAIRED,
        10,
    )
    + _SHOWN,
)
def indexed_phrases(spark, sf):
    """Phrases over an index from which the toxic documents were removed and which was compacted."""
    index = ix.build_index(_documents(spark, sf).select("id", "text"), work_dir(spark, "index"), 16)
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    index = ix.compact(ix.remove_documents(index, toxic), spark)
    return _shown(ix.keyword_search(index, _paired(spark, sf), 10))


@query(
    "indexed_message_search",
    q.with_tables(
        "chat_msg",
        docs="SELECT id, text, is_me AS hit FROM chat_msg",
        asked="SELECT item_id AS query_id, text FROM benchmark",
        **phrase_bm25("docs", "asked", 20),
    )
    + _SHOWN,
)
def indexed_message_search(spark, sf):
    """Messages of mine; those of others count in the statistics only."""
    rows = chat_messages(spark, sf).select("id", "text", F.col("is_me").alias("hit"))
    index = ix.build_index(rows, work_dir(spark, "index"), 16)
    return _shown(ix.keyword_search(index, queries(spark, sf), 20))
