"""Batch scoring, one-pass vector search, and files that Spark's readers skip."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import search
from palimpsest.operators.scoring import _scored, _slices, extract_with_model, score_batches
from palimpsest.sources import read_source
from palimpsest.sources.hidden_text import read_hidden_lines


class Upper:
    """Fails on texts that hold ``bad``, and once in three calls otherwise."""

    def __init__(self):
        self.calls = 0

    def __call__(self, rows):
        self.calls += 1
        if rows["text"].str.contains("bad").any():
            raise RuntimeError("bad text")
        if self.calls % 3 == 1:
            raise OSError("try again")
        return pd.DataFrame({"upper": rows["text"].str.upper(), "n": range(len(rows))})


def test_rows_keep_their_results(spark):
    texts = [f"text {i}" if i % 17 else f"bad {i}" for i in range(200)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, rows string")
    found = score_batches(frame.repartition(3), "upper", Upper, ["text"], "upper string, n int", batch_bytes=300)
    rows = {r["id"]: r for r in found.collect()}
    assert len(rows) == 200
    for i, t in enumerate(texts):
        if "bad" in t:
            assert rows[i]["upper"] is None and rows[i]["error"] == "RuntimeError: bad text"
        else:
            assert rows[i]["upper"] == t.upper() and rows[i]["error"] is None
        assert rows[i]["rows"] == "x"
    assert max(r["n"] for r in rows.values() if r["n"] is not None) < 300 // 22
    with pytest.raises(ValueError, match="columns named"):
        score_batches(frame.withColumn("n", F.lit(1)), "upper", Upper, ["text"], "upper string, n int")


def test_slices_and_wrong_lengths():
    rows = pd.DataFrame({"text": list("abcde")})
    assert [len(x) for x in _slices(rows, [1, 1, 5, 1, 1], 2)] == [2, 1, 2]
    short = _scored(lambda r: r.iloc[1:], rows, ["text"], 0, 0)
    assert short["text"].isna().all() and short["error"].str.startswith("ValueError").all()


class Replies:
    def __call__(self, rows):
        reply = '{"memories": [{"text": "' + rows["source_text"] + '", "kind": "fact", "confidence": 0.9}]}'
        return pd.DataFrame({"reply": reply})


def test_memories_from_a_model(spark):
    said = [("r1", "my sister lives in Bergen now"), ("r2", "My sister lives in Bergen now!"), ("r3", "too short")]
    frame = spark.createDataFrame(said, "source_ref string, source_text string")
    memories = spark.createDataFrame([], "id long, text string, archived boolean")
    rows = extract_with_model(frame, memories, "replies", Replies).collect()
    assert [(r["source_ref"], r["text"]) for r in rows] == [("r1", "my sister lives in Bergen now")]


def test_vector_search_in_three_passes(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    vectors, queries = rnd.normal(size=(500, 384)), rnd.normal(size=(60, 384))
    vectors[100:110] = vectors[100]  # ties
    monkeypatch.setattr(search, "QUERY_BYTES", 20 * 384 * 8)
    monkeypatch.setattr(search, "QUERIES_PER_BLOCK", 16)
    monkeypatch.setattr(search, "VECTORS_PER_BLOCK", 64)
    left = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [1.0])], "id long, vec array<double>"
    ).repartition(4)
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vec array<double>")
    hits = search.vector_topk(left, right, 7)
    found = {(r["query_id"], r["rank"]): r["id"] for r in hits.collect()}
    scores = np.round(queries @ vectors.T, 9)
    for q in range(60):
        want = sorted(range(500), key=lambda i: (-scores[q, i], i))[:7]
        assert [found[q, r] for r in range(1, 8)] == want
    plan = hits._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(query_id") == 1
    assert search.vector_topk(left, right.filter("query_id < 0"), 3).count() == 0


def test_hidden_files_by_byte_range(spark, tmp_path):
    folder = tmp_path / "Chat with Ann"
    folder.mkdir()
    lines = [f"line {i} ünïcode" + "x" * (i % 9) for i in range(300)]
    (folder / "_chat.txt").write_bytes(("\ufeff" + "\r\n".join(lines)).encode())
    (folder / "_empty.txt").write_text("")
    (folder / "seen.txt").write_text("not this one")
    for size in (7, 100, 1 << 20):
        rows = read_hidden_lines(spark, str(tmp_path), size=size).orderBy("block", "pos").collect()
        assert [r["line"] for r in rows] == lines


@pytest.mark.parametrize(
    ("heads", "ts"),
    [
        (["[31.01.24, 9:05:00 PM] Sam: hello", "more", "[01.02.24, 10:00:00 AM] Ann: hi"], "2024-01-31 21:05:00"),
        (["1/31/24, 21:05 - Sam: hello", "more", "2/1/24, 10:00 - Ann: hi"], "2024-01-31 21:05:00"),
        (["2024-01-31, 21:05 - Sam: hello", "more", "2024-02-01, 10:00 - Ann: hi"], "2024-01-31 21:05:00"),
    ],
)
def test_exports_named_chat(spark, tmp_path, heads, ts):
    folder = tmp_path / "WhatsApp Chat - Ann"
    folder.mkdir()
    (folder / "_chat.txt").write_text("\n".join(heads) + "\n")
    _, frame = read_source(spark, "chat_export", str(tmp_path), names=["Sam"])
    rows = frame.orderBy("ts").collect()
    assert [r["text"] for r in rows] == ["hello\nmore", "hi"]
    assert str(rows[0]["ts"]) == ts and rows[0]["is_me"] and rows[1]["sender_name"] == "Ann"
    assert "Ann" in rows[0]["conversation_external_id"]
