"""Registered queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import (
    alignment,
    credentials,
    decontamination,
    language,
    licenses,
    ngram_join,
    personal_data,
    phrases,
    pieces,
    quality,
    token_store,
    toxicity,
    vector_join,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


ORACLES["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(
      list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  END AS s FROM w
),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
e AS (SELECT x, y FROM c UNION ALL SELECT y, x FROM c),
r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id
"""


@_query
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.store_folder(spark, "tokens")
    docs = _table(spark, sf_dir, "documents")
    token_store.write_store(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(spark, folder)


@_query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


@_query
def op5_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segment(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


@_query
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(_table(spark, sf_dir, "documents"))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    remainder = language.remainder(4)
    model = toxicity.learn(docs, labels.filter(remainder != 2))
    return toxicity.score(docs, model).withColumn("held_out", F.coalesce(remainder == 2, F.lit(False)))


@_query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_secrets(_table(spark, sf_dir, "documents"))


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


@_query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = language.remainder(3)
    model = language.learn(docs.filter(remainder != 1))
    return language.identify(docs, model).withColumn("held_out", F.coalesce(remainder == 1, F.lit(False)))


@_query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


ORACLES["op11_phrase_collocations"] = r"""
WITH p AS (
  SELECT lang, row_number() OVER () AS pid, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
),
w AS (SELECT lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, pid, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (
  SELECT lang, w AS x, lead(w, 1) OVER q AS y, lead(w, 2) OVER q AS z FROM t
  WINDOW q AS (PARTITION BY pid ORDER BY i)
),
f AS (
  SELECT lang, 1 AS k, x AS phrase, count(*) AS a FROM g GROUP BY lang, x
  UNION ALL
  SELECT lang, 2, x || ' ' || y, count(*) FROM g WHERE y IS NOT NULL GROUP BY lang, x, y
  UNION ALL
  SELECT lang, 3, x || ' ' || y || ' ' || z, count(*) FROM g WHERE z IS NOT NULL GROUP BY lang, x, y, z
),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS s FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, l.a AS l, r.a AS r,
    CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM c JOIN (VALUES (1), (2)) AS v(cut) ON cut < c.k
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.s[1:cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.s[cut + 1:], ' ')
),
best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
),
held AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, array_to_string(s[1:2], ' ') AS part, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(s[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL
),
kept AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, phrase) AS rank
  FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.part = b.phrase
  WHERE h.a IS NULL OR 100 * h.a < 50 * b.a
)
SELECT kept.lang, rank, phrase, a, l, r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN n ON n.lang = kept.lang WHERE rank <= 2000
"""


@_query
def op12_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


ORACLES["op12_embedding_near_duplicates"] = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
),
u AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
),
l AS (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(a, b) AS (SELECT r, r FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (
  SELECT reach.a, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c ON c.a = v.r LEFT JOIN n ON n.a = v.r
"""


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        _table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )
