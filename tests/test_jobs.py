from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import captures, evaluation, examples, ingest, memories, search, snapshot
from palimpsest.operators.captures import assemble_reference
from palimpsest.operators.segments import SegmentRules, segment_frames
from palimpsest.operators.turns import build_turns, with_context
from palimpsest.schema import CANONICAL
from palimpsest.streaming.captures import dedup_captures, write_available
from palimpsest.streaming.state import Gate, Segments

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


def canonical(spark, rows):
    base = dict.fromkeys(CANONICAL.names)
    full = [{**base, "register": "text", "is_group": False, "seq": i, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in CANONICAL.names) for r in full], CANONICAL)


BATCH = [
    dict(conversation_external_id="a", text="merhaba nasıl gidiyor bu sabah", ts=minutes(0), is_me=True),
    dict(conversation_external_id="a", text="what is it for you", ts=minutes(1), is_me=False, sender_handle="+1 555 000 1111", sender_name="Bo"),
    dict(conversation_external_id="a", text="what is it for you", ts=minutes(1), is_me=False, sender_handle="+1 555 000 1111", sender_name="Bo"),
    dict(conversation_external_id="b", text="<Media omitted>", ts=minutes(2), is_me=True),
    dict(conversation_external_id="b", text="this is all", ts=minutes(3), is_me=True, conversation_title="B"),
]


def test_ingest_twice_changes_nothing(spark):
    source = ingest.SourceRef("test", "Test", "/x")
    corpus, report = ingest.ingest_messages(ingest.Corpus.empty(spark), canonical(spark, BATCH), source, "salt")
    first = report.first()
    assert (first["received"], first["inserted"], first["duplicates"], first["skipped"]) == (5, 3, 1, 1)
    assert first["skipped_reasons"] == {"media_placeholder": 1} and first["conversations"] == 2
    corpus = corpus.checkpointed()
    again, report = ingest.ingest_messages(corpus, canonical(spark, BATCH), source, "salt")
    second = report.first()
    assert (second["inserted"], second["duplicates"], second["me_words"]) == (0, 4, 0)
    assert again.messages.count() == 3 and again.sources.count() == 1
    assert again.contacts.count() == 2 and again.conversations.filter("title = 'B'").count() == 1


def chat(spark, rows):
    cols = "conversation_id long, id long, ts timestamp, is_me boolean, text string, register string, lang string, sender_name string, is_group boolean"
    return spark.createDataFrame(rows, cols)


def random_chat(seed, n=400):
    rng, at, rows = random.Random(seed), 0, []
    for i in range(n):
        at += rng.choice([0, 1, 5, 20, 21, 300])
        rows.append((seed % 2, i, minutes(at), rng.random() < 0.5, f"m{i}", rng.choice(["text", "email"]), rng.choice(["en", None]), rng.choice(["A", "B", None]), seed % 2 == 0))
    return rows


def python_turns(rows):
    turns = []
    for conv, i, ts, me, text, reg, lang, name, group in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        name = name or "Them"
        line = f"{name}: {text}" if group and not me else text
        last = turns[-1] if turns else None
        if last and last[0] == conv and last[1] == me and ts - last[3] <= dt.timedelta(minutes=20):
            turns[-1] = (conv, me, last[2] + "\n" + line, ts)
        else:
            turns.append((conv, me, line, ts))
    return sorted((c, m, t) for c, m, t, _ in turns)


@pytest.mark.parametrize("split", [False, True])
def test_turns_whole_and_in_slices(spark, split):
    rows = random_chat(1) + [r for r in random_chat(2)]
    options = dict(rows_per_task=37, force_split_check=True) if split else {}
    turns = build_turns(chat(spark, rows), **options)
    got = sorted((r["conversation_id"], r["role"] == "assistant", r["text"]) for r in turns.collect())
    assert got == python_turns(rows)


def test_context_crosses_blocks(spark, monkeypatch):
    import palimpsest.operators.turns as module

    rows = [(1, i, minutes(30 * i), i % 2 == 1, f"m{i}", "text", "en", "A", False) for i in range(60)]
    turns = build_turns(chat(spark, rows))
    want = {r["turn_no"]: [c["text"] for c in r["context"]] for r in with_context(turns).collect()}
    monkeypatch.setattr(module, "TURNS_PER_BLOCK", 16)
    got = {r["turn_no"]: [c["text"] for c in r["context"]] for r in with_context(turns).collect()}
    assert got == want and want[60] == [f"m{i}" for i in range(51, 59)]


def test_snapshot_files(spark, tmp_path):
    rows = []
    for c in range(1, 31):
        rows += [(c, c * 10, minutes(c * 1440), False, "how are you today", "text", "en", "Bo", False)]
        rows += [(c, c * 10 + 1, minutes(c * 1440 + 1), True, f"fine thanks number {c}", "text", "en", None, False)]
    conv = spark.createDataFrame([(c, None, False, "imessage") for c in range(1, 31)], "conversation_id long, title string, is_group boolean, source_kind string")
    messages = chat(spark, rows).drop("is_group").withColumn("meta", F.lit(None).cast("string"))
    cfg = examples.ExampleConfig(name="Sam", holdout_fraction=0.2)
    rows = [snapshot.build_snapshot(messages, conv, str(tmp_path / str(i)), "v1", cfg).first() for i in (0, 1)]
    assert rows[0]["train_sha256"] == rows[1]["train_sha256"]
    assert rows[0]["n_examples"] + rows[0]["n_holdout"] == 30
    train = snapshot.read_examples(spark, str(tmp_path / "0/v1/train"))
    assert train.count() == rows[0]["n_examples"]
    first = train.first()
    assert [m["role"] for m in first["messages"]] == ["system", "user", "assistant"]
    valid, test = (sorted(r["value"] for r in spark.read.text(str(tmp_path / f"0/v1/{s}")).collect()) for s in ("valid", "test"))
    assert valid == test and len(valid) == rows[0]["n_holdout"]


def test_segments_equal_the_state_machine(spark):
    rules = SegmentRules(min_speech_s=0.064, silence_end_s=0.16, max_segment_s=0.5, pad_s=0.096)
    rng, rows = random.Random(3), []
    for device in ("a", "b", "c"):
        speaking = False
        for i in range(700):
            speaking = rng.random() < (0.9 if speaking else 0.12)
            rows.append((device, i, 0.9 if speaking else 0.1))
    frames = spark.createDataFrame(rows, "device string, frame_no long, prob double")
    got = sorted(tuple(r) for r in segment_frames(frames, rules).select("device", "first_frame", "n_frames", "speech_frames").collect())
    want, machine = [], Segments(rules)
    for device in ("a", "b", "c"):
        own = [(i, p) for d, i, p in rows if d == device]
        own.append((len(own), float("nan")))  # end of the stream
        for size in (1, 7, len(own)):
            state, found = machine.empty, []
            for k in range(0, len(own), size):
                part = own[max(0, k - 3) : k + size]  # the last frames come twice
                state, more = machine.advance(
                    state, np.array([i for i, _ in part]), np.array([p for _, p in part], dtype=float)
                )
                found += more
            assert sorted(found) == sorted((f, n, sp) for d, f, n, sp in got if d == device)
        want += [(device, *f) for f in found]
    assert got == sorted(want) and len(want) > 20


def test_vector_topk_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(search, "VECTORS_PER_BLOCK", 7)
    rng = np.random.default_rng(0)
    v, qs = rng.normal(size=(50, 8)), rng.normal(size=(10, 8))
    table = lambda m, name: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{name} long, vec array<float>")
    hits = search.vector_topk(table(v, "id"), table(qs, "query_id"), 4).collect()
    got = {(r["query_id"], r["rank"]): r["id"] for r in hits}
    order = np.argsort(-(qs @ v.T), axis=1)[:, :4]
    assert got == {(i, j + 1): int(order[i, j]) for i in range(10) for j in range(4)}


def test_large_query_table_gives_the_same_hits(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"common word{i % 5} term{i}") for i in range(40)], "id long, text string")
    asked = spark.createDataFrame([(1, "common word3"), (2, "term7 word2")], "query_id long, text string")
    want = sorted(map(tuple, search.keyword_search(docs, asked, 5).collect()))
    monkeypatch.setattr(search, "BROADCAST_CHARS", 0)
    assert sorted(map(tuple, search.keyword_search(docs, asked, 5).collect())) == want


def test_tasks_follow_documents_times_queries(spark, monkeypatch):
    """Few bytes of tokens that match every query are dealt to as many tasks as their scores need."""
    docs = spark.range(200).select("id", F.concat(F.lit("red green w"), "id").alias("text"))
    queries = spark.range(10).select(F.col("id").alias("query_id"), F.concat(F.lit("red w"), "id").alias("text"))
    monkeypatch.setattr(search, "PAIRS_PER_TASK", 50, raising=False)
    hits = search.keyword_search(docs, queries, 3)
    best = {(r["query_id"], r["id"]) for r in hits.collect() if r["rank"] == 1}
    assert best == {(n, n) for n in range(10)}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [id" in plan and "], 40" in plan


def test_latency_of_a_hot_name(spark):
    values = spark.range(60_000).select(F.lit("x").alias("name"), (F.col("id") * 7919 % 60_000).cast("double").alias("seconds"), F.lit(True).alias("ok"))
    row = evaluation.latency_summary(values).first()
    assert (row["n"], row["p50_s"], row["p90_s"], row["max_s"]) == (60_000, 29_999.5, 54_000.0, 59_999.0)


def test_reference_clip(spark):
    rows = [("a", "hello there friend.", 4.0, 0.9), ("b", "more words here", 5.0, 0.8), ("c", "too long now ok", 9.0, 0.7), ("d", "short bit here!", 2.0, 0.6)]
    cands = spark.createDataFrame(rows, "uid string, text string, duration_s double, order_score double")
    row = assemble_reference(cands).first()
    assert row["clips"] == ["a", "b", "d"]
    assert row["reference_text"] == "hello there friend. more words here. short bit here."


def test_discriminator_tells_fakes(spark):
    rng = random.Random(1)
    words = "the cat sat on my old mat and ran off".split()
    real = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)]
    fake = [(i, "As requested, here is a constant reply.") for i in range(12)]
    make = lambda rows: spark.createDataFrame(rows, "id long, text string")
    folds = evaluation.discriminate(evaluation.labelled_union(make(real), make(fake)), dim=1 << 12, max_iter=20)
    assert evaluation.discriminator_result(folds).first()["value"] >= 0.9
    with pytest.raises(ValueError):
        evaluation.discriminate(evaluation.labelled_union(make(real), make(fake[:2])))


def test_gate_spans_do_not_depend_on_micro_batches():
    rng = np.random.default_rng(3)
    gate = Gate(-50.0, hangover_ms=100, preroll_ms=64, max_ms=1000, min_ms=30)
    at = np.cumsum(rng.integers(20, 45, 600)).astype(np.int64)
    level = np.where(np.repeat(rng.random(60) < 0.5, 10), -30.0, -70.0)
    level[rng.integers(0, 600, 40)] = -30.0
    level[-1] = np.nan  # end of the stream
    want = []
    for size in (600, 1, 13):
        state, found = None, []
        for k in range(0, 600, size):
            state, more = gate.advance(state, at[k : k + size], level[k : k + size])
            found += more
        want = want or found
        assert found == want and len(found) > 10 and state[1] is None
    assert all(b - a <= 1000 + 64 + 45 for a, b in want)


def test_late_and_repeated_captures_come_out_once(spark, tmp_path):
    rows = [("a", minutes(0)), ("b", minutes(5)), ("a", minutes(0)), ("old", T0 - dt.timedelta(days=90)), ("b", minutes(5))]
    for k, row in enumerate(rows):  # one micro-batch each
        spark.createDataFrame([row], "uid string, client_ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("uid string, client_ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    write_available(dedup_captures(stream), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    assert sorted(r["uid"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "old"]


def test_two_patches_of_one_uid_fold_into_one_row(spark):
    rows = spark.createDataFrame([("a", "x", "p"), ("b", "y", "q")], "uid string, text string, status string")
    patches = spark.createDataFrame(
        [("a", "late", None, 2), ("a", "early", "done", 1), ("c", "none", None, 1)], "uid string, text string, status string, no int"
    )
    got = sorted(map(tuple, captures.update_captures(rows, patches, order="no").collect()))
    assert got == [("a", "late", "done"), ("b", "y", "q")]
    plain = memories.update_memories(rows.withColumn("updated_at", F.lit(None).cast("timestamp")), patches.drop("no"), "2025-01-01")
    assert sorted((r["uid"], r["status"], r["updated_at"] is None) for r in plain.collect()) == [("a", "done", False), ("b", "q", True)]


def test_the_first_of_repeated_new_memories_is_kept(spark):
    empty = spark.createDataFrame([], "uid string, text string")
    new = spark.createDataFrame([("a", " second letter "), ("a", "another"), ("b", "only")], "uid string, text string").coalesce(1)
    made = memories.create_memories(empty, new, "2025-01-01")
    assert sorted((r["uid"], r["text"]) for r in made.collect()) == [("a", "second letter"), ("b", "only")]


def test_sync_returns_every_change(spark):
    from palimpsest.operators.captures import sync

    stamp = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    uid = F.concat(F.lit("u"), "id").alias("uid")
    mem = spark.range(450).select(uid, stamp.alias("updated_at"), F.lit(True).alias("archived"))
    cap = spark.range(450).select(uid, stamp.alias("received_at"), F.lit(None).cast("timestamp").alias("processed_at"))
    assert [x.count() for x in sync(mem, cap, "2000-01-01 00:00:00")] == [450, 450]
    assert [x.count() for x in sync(mem, cap, "2000-01-01 00:00:00", limit=200)] == [200, 200]


def test_statistics_of_more_examples_than_the_sum_of_times_holds(spark):
    """The times of 10 000 examples, in microseconds, add up to more than a long."""
    rows = spark.range(0, 10_000, 1, 1).select(
        F.lit(None).cast("string").alias("skip_reason"), F.lit(False).alias("is_holdout"), F.lit(1).alias("n"),
        F.lit("text").alias("register"), F.lit("en").alias("lang"), (F.col("id") % 10).alias("conversation_id"),
        F.lit(3).alias("n_words"), F.timestamp_seconds(1_704_067_200 + F.col("id")).alias("ts"),
    )
    row = examples.dataset_stats(rows).first()
    assert (row["n_examples"], row["n_words"], row["conversations"]) == (10_000, 30_000, 10)
    assert row["data_cutoff"] == dt.datetime(2024, 1, 1) + dt.timedelta(seconds=9_999)
