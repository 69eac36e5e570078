"""The stored keyword index and set-similarity suppression, against plain Python."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import index as ix
from palimpsest.operators.memories import suppress_similar
from palimpsest.operators.similarity import first_independent, similar_sets

WORDS = [f"w{i}" for i in range(40)]


def plain_search(docs, queries, k):
    """BM25 with phrases; docs are (id, text, hit)."""
    tokens = {d: re.findall(r"\w+", (t or "").lower()) for d, t, _ in docs}
    hits = {d for d, _, h in docs if h}
    n, avg = len(tokens), sum(map(len, tokens.values())) / max(1, len(tokens))
    out = []
    for q, text in queries:
        scores = {}
        for term in text.split():
            unit = re.findall(r"\w+", term.lower())
            if not unit:
                continue
            tf = {
                d: sum(t[i : i + len(unit)] == unit for i in range(len(t) - len(unit) + 1)) for d, t in tokens.items()
            }
            df = sum(x > 0 for x in tf.values())
            for d, x in tf.items():
                if x and d in hits:
                    idf = max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))
                    scores[d] = scores.get(d, 0) + idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(tokens[d]) / avg))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, d, round(s, 6), r) for r, (d, s) in enumerate(best, 1)]
    return sorted(out)


def found(index, spark, queries, k):
    asked = spark.createDataFrame(queries, "query_id long, text string")
    rows = ix.keyword_search(index, asked, k).collect()
    return sorted((r["query_id"], r["id"], round(r["score"], 6), r["rank"]) for r in rows)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    weights = [1 / (i + 1) for i in range(40)]
    docs = [(i, " ".join(rnd.choices(WORDS, weights, k=rnd.randint(0, 60))), i % 5 > 0) for i in range(300)]
    docs += [(900, None, True), (901, "", True), (902, "W1 W1, w1!", True), (903, "w1 w1 w1", True)]
    queries = [(1, "w0 w1 w39"), (2, "w0-w1 w2"), (3, "w5 w5 w30"), (4, "  "), (5, "nowhere w38-w39"), (6, "w1-w1-w1 w7")]
    return docs, queries


def test_loads_removals_and_compaction(spark, tmp_path, corpus, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK", 4)
    monkeypatch.setattr(ix, "SLICE_DOCS", 100)
    docs, queries = corpus
    frame = spark.createDataFrame(docs, "id long, text string, hit boolean").withColumn("term", F.lit("clash"))
    index = ix.build_index(frame.filter("id < 200"), str(tmp_path / "x"), 4)
    index = ix.add_documents(index, frame.filter("id >= 100").unionByName(frame.filter("id = 903")))
    for k in (1, 3, 50):
        assert found(index, spark, queries, k) == plain_search(docs, queries, k)
    gone = [d for d, _, _ in docs if d % 7 == 0] + [5000]
    index = ix.remove_documents(index, spark.createDataFrame([(g,) for g in gone], "id long"))
    left = [d for d in docs if d[0] not in gone]
    assert found(index, spark, queries, 5) == plain_search(left, queries, 5)
    index = ix.compact(index, spark)
    assert len(index.segments(spark)) == 1
    assert found(index, spark, queries, 5) == plain_search(left, queries, 5)
    index = ix.add_documents(index, frame)  # the removed ones come back
    assert found(index, spark, queries, 5) == plain_search(docs, queries, 5)


def test_a_load_that_failed_is_not_seen(spark, tmp_path, corpus):
    docs, queries = corpus
    frame = spark.createDataFrame(docs, "id long, text string, hit boolean")
    index = ix.build_index(frame.filter("id < 100"), str(tmp_path / "x"), 4)
    # postings of a second load, without its manifest row
    rows = ix._blocks(index, ix._term_rows(frame.filter("id >= 100")), 100, 10.0)
    rows.write.partitionBy("bucket").parquet(f"{index.path}/postings/segment=1")
    assert found(index, spark, queries, 5) == plain_search([d for d in docs if d[0] < 100], queries, 5)
    index = ix.add_documents(index, frame)
    assert found(index, spark, queries, 5) == plain_search(docs, queries, 5)


def test_only_asked_buckets_are_read(spark, tmp_path, corpus):
    docs, _ = corpus
    index = ix.build_index(spark.createDataFrame(docs, "id long, text string, hit boolean"), str(tmp_path / "x"), 16)
    rows = index.postings(spark).filter(F.col("bucket").isin([3]))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_an_empty_index(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, text string")
    index = ix.build_index(empty, str(tmp_path / "x"))
    assert found(index, spark, [(1, "any words")], 3) == []


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_similar_sets_equal_brute_force(spark):
    rnd = random.Random(6)
    for threshold in (0.5, 0.7, 1.0):
        sets = [set(rnd.sample(WORDS[:14], rnd.randint(0, 9))) for _ in range(120)]
        left, right = list(enumerate(sets[:60])), list(enumerate(sets[60:]))
        frames = [spark.createDataFrame([(i, sorted(s)) for i, s in x], "id long, tokens array<string>") for x in (left, right)]
        rows = {tuple(r) for r in similar_sets(*frames, threshold).collect()}
        first = lambda x: {min(i for i, t in x if t == s) for _, s in x}
        want = {
            (i, j) for i, s in left for j, t in right
            if i in first(left) and j in first(right) and plain_jaccard(s, t) >= threshold
        }
        assert rows == want


def test_first_independent_is_greedy(spark):
    rnd = random.Random(8)
    for n, p in ((30, 0.1), (40, 0.3), (12, 0.0)):
        edges = [(a, b) for b in range(n) for a in range(b) if rnd.random() < p] + ([(k, k + 1) for k in range(n - 1)] if p == 0 else [])
        kept = []
        for k in range(n):
            if not any((a, k) in edges for a in kept):
                kept.append(k)
        rows = spark.range(n).select("id")
        frame = spark.createDataFrame(edges, "a long, b long")
        assert sorted(r["id"] for r in first_independent(rows, frame).collect()) == kept


def test_candidates_come_one_by_one(spark):
    texts = {
        1: "The cat sat on the mat today", 2: "the cat sat on the mat, today!", 3: "the cat sat on the mat",
        4: "dogs bark loudly at night", 5: "!!", 6: "??", 7: "dogs bark loudly at the night", 8: "an old memory of mine",
        9: "dogs bark at the night",
    }
    frame = spark.createDataFrame(list(texts.items()), "id long, text string")
    memories = spark.createDataFrame(
        [(1, "An old memory of mine.", False), (2, "dogs bark loudly at night", True)], "id long, text string, archived boolean"
    )
    words = {k: set(re.findall(r"\w+", t.lower())) for k, t in texts.items()}
    kept = []
    for k in sorted(texts):
        known = [set(re.findall(r"\w+", "an old memory of mine"))] + [words[x] for x in kept]
        if not any(plain_jaccard(words[k], w) >= 0.7 for w in known):
            kept.append(k)
    assert sorted(r["id"] for r in suppress_similar(frame, memories).collect()) == kept
    assert kept == [1, 4, 5, 6, 9]


def test_postings_are_dealt_once(spark):
    """Ranking, blocking and writing share one shuffle by bucket and slice."""
    rows = spark.createDataFrame(
        [(1, "a", 1, 1, True, [0])], "id long, term string, tf int, dl int, hit boolean, positions array<int>"
    )
    plan = ix._blocks(ix.KeywordIndex("nowhere", 4), rows, 1, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(bucket" in plan


def test_short_sets_of_frequent_tokens_meet_by_twos(spark):
    from palimpsest.operators import similarity

    rnd = random.Random(8)
    sets = [(k, sorted({f"w{min(int(rnd.expovariate(0.2)), 60)}" for _ in range(8)})) for k in range(400)]
    frame = spark.createDataFrame(sets, "i long, tokens array<string>")
    tokens = frame.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    ranks = tokens.withColumn("spot", F.xxhash64("token")).withColumn("t", F.row_number().over(Window.orderBy("token")).cast("long"))
    keys = similarity._prefixes(frame, ranks, 0.7, "i")
    met = {tuple(r) for r in keys.alias("a").join(keys.withColumnRenamed("i", "j"), ["t", "u"]).select("i", "j").collect()}
    alike = {(i, j) for i, a in sets for j, b in sets if len({*a} & {*b}) >= 0.7 * len({*a} | {*b})}
    assert alike <= met
    assert len(met) < 0.5 * len(sets) ** 2


def test_words_are_cut_as_in_sql(spark):
    """Texts are cut into words in Python where their characters allow it, with the same words (F3)."""
    texts = [
        "Plain words, and 3 numbers: x1 y_2", "Über ÜBER uber İstanbul ıŞık naïve—dash “quoted” co\u00adop", "", None,
        "²³ ½ ª º × ÷ ß Æ ǆ Ǆ ŉ", "Σοφός ΟΔΟΣ λόγος", "русский Текст й", "日本語 テキスト abc", "e\u0301 combining a\u0308", "… – € 5€ x",
        "tab\tnew\nline\x0b\x00nul", "💡 idea", "don't o'clock",
    ]
    docs = spark.createDataFrame([(k, t, k % 2 == 0) for k, t in enumerate(texts)], "id long, text string, hit boolean")
    want = {
        (r["id"], w, p)
        for r in docs.select("id", ix.search_tokens(F.col("text")).alias("t")).collect()
        for p, w in enumerate(r["t"] or [])
    }
    pieces = ix._postings(ix._term_rows(docs.coalesce(1)), 1).collect()
    got = {(i, r["term"], p) for r in pieces for i, places in zip(r["ids"], r["positions"], strict=True) for p in places}
    assert got == want
    assert dict(map(tuple, ix._sizes(docs).collect())) == {k: sum(1 for w in want if w[0] == k) for k in range(len(texts))}


def test_compacting_moves_blocks(spark, tmp_path, monkeypatch):
    """The rows that compacting deals and sorts are blocks; many removed documents give the same index."""
    docs = spark.range(600).selectExpr("id", "concat('same word', id % 7, ' x', id) AS text")
    index = ix.remove_documents(ix.build_index(docs, str(tmp_path / "x"), 4), spark.range(0, 600, 5))
    dealt, blocks = [], index.postings(spark).count()
    cut = ix._cut
    monkeypatch.setattr(ix, "_cut", lambda i, pieces, a, gone: dealt.append((pieces.count(), gone)) or cut(i, pieces, a, gone))
    ix.compact(index, spark)
    assert dealt[0][0] == blocks < 1800 and len(dealt[0][1][0]) == 120
    got = index.postings(spark).select("term", "block", "ids", "positions").collect()
    ids = {i for r in got for i in r["ids"]}
    assert ids == {k for k in range(600) if k % 5}
    other = ix.remove_documents(ix.build_index(docs, str(tmp_path / "y"), 4), spark.range(0, 600, 5))
    monkeypatch.setattr(ix, "SENT_IDS", 10)
    ix.compact(other, spark)
    assert dealt[-1][1] is None
    again = other.postings(spark).select("term", "block", "ids", "positions").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
