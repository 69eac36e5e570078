"""Live turns, live retention and bucketed tables against what a batch gives."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.vectors import hash_embedder
from palimpsest.operators.embeddings import embed_rows
from palimpsest.streaming import captures as cs
from palimpsest.streaming.retention import Retention
from palimpsest.streaming.tables import BucketedTable
from palimpsest.streaming.turns import RevisedTurns


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Rows(Value):
    def get(self):
        return iter(self.held or [])

    put = Value.update


class Map:
    def __init__(self):
        self.held = {}

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key] = value

    def removeKey(self, key):
        del self.held[key]


class Handle:
    """State as a processor sees it, kept in memory."""

    def getValueState(self, name, schema):
        return Value()

    def getListState(self, name, schema):
        return Rows()

    def getMapState(self, name, key, value):
        return Map()


def run(processor, batches):
    processor.init(Handle())
    out = []
    for batch in batches:
        parts = [batch.iloc[: len(batch) // 2], batch.iloc[len(batch) // 2 :]]
        for part in processor.handleInputRows(("c",), iter(parts), None):
            out += part.to_dict("records")
    return out


def plain_turns(rows, gap):
    turns = []
    for at, number, me, text in sorted(rows):
        if not text.strip():
            continue
        if turns and turns[-1][1] == me and at - turns[-1][3] <= gap:
            turns[-1][2].append(text)
            turns[-1][3] = at
        else:
            turns.append([(at, number), me, [text], at])
    return [(k, "assistant" if me else "user", "\n".join(t)) for k, me, t, _ in turns]


def standing(out):
    last = {}
    for r in out:
        key = r["first_at"], r["first_id"]
        assert r["late"] or r["revision"] == last.get(key, {"revision": 0})["revision"] + 1
        last[key] = r
    return sorted((k, r["role"], r["text"]) for k, r in last.items() if not r["retracted"])


def message_frame(rows):
    frame = pd.DataFrame(rows, columns=["at", "id", "is_me", "text"])
    return frame.assign(is_group=False, sender_name="Ann")


@pytest.mark.parametrize("seed", range(8))
def test_turns_in_any_order_of_arrival(seed):
    rnd = random.Random(seed)
    rows, at = [], 0
    for k in range(60):
        at += rnd.choice([0, 1, 5, 12]) * 1_000_000
        rows.append((at, k, rnd.random() < 0.5, rnd.choice(["a", "b c", " ", "d"])))
    arrival = rows + rnd.sample(rows, 10)
    rnd.shuffle(arrival)
    batches = [message_frame(arrival[k::3]) for k in range(3)]
    out = run(RevisedTurns(gap_s=10), batches)
    assert standing(out) == plain_turns(rows, 10_000_000)


def test_late_message_splits_and_merges():
    first = [(0, 1, True, "one"), (5_000_000, 2, True, "two"), (40_000_000, 3, True, "four")]
    out = run(
        RevisedTurns(gap_s=20),
        [message_frame(first), message_frame([(2_000_000, 9, False, "hey")]), message_frame([(22_000_000, 4, True, "three")])],
    )
    assert [(r["first_id"], r["revision"], bool(r["retracted"])) for r in out] == [
        (1, 1, False), (3, 1, False),  # two turns
        (1, 2, False), (9, 1, False), (2, 1, False),  # the first one is split in three
        (2, 2, False), (3, 2, True),  # the last two become one
    ]
    assert standing(out)[-1] == ((5_000_000, 2), "assistant", "two\nthree\nfour")


def test_settled_turns_leave_the_state():
    processor = RevisedTurns(gap_s=10, keep_s=100)
    batches = [message_frame([(k * 60_000_000, k, True, f"m{k}")]) for k in range(50)]
    out = run(processor, [*batches, message_frame([(1_000_000, 99, True, "very late")])])
    assert len(processor.messages.held) <= 4 and len(processor.turns.held) <= 4
    assert len([r for r in out if not r["late"]]) == 50
    assert [(r["first_id"], r["text"]) for r in out if r["late"]] == [(99, "very late")]


@pytest.mark.parametrize("seed", range(8))
def test_retention_in_any_order_of_arrival(seed):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(40), k, rnd.choice([0, 3, 10, 25])) for k in range(80)]
    arrival = rows + rnd.sample(rows, 15)
    rnd.shuffle(arrival)
    batches = [pd.DataFrame(arrival[k::4], columns=["at", "uid", "size"]) for k in range(4)]
    processor = Retention(60)
    out = run(processor, batches)
    gone = {r["uid"] for r in out if r["evicted"]}
    total, want = 0, set()
    for _, uid, size in sorted(rows, reverse=True):
        total += size
        if total <= 60:
            want.add(uid)
    assert {r["uid"] for r in out if not r["evicted"]} - gone == want
    assert sum(s for _, _, s in processor.entries.get()) <= 60


def test_bucketed_table_through_retries_and_compaction(spark, tmp_path):
    table = BucketedTable(str(tmp_path / "t"), "id bigint, text string", "id", 4)
    rows = lambda ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id bigint, text string")
    for batch, ids in enumerate([range(0, 10), range(5, 15), range(12, 20)]):
        for _ in range(2):  # the second time is a retry
            table.write(table.unseen(rows(ids), batch), batch)
    held = lambda: sorted(tuple(r) for r in table.read(spark).select("id", "text").collect())
    want = [(i, f"t{i}") for i in range(20)]
    assert held() == want
    files = lambda: table.read(spark).select(F.input_file_name()).distinct().count()
    before = files()
    table.compact(spark, 2)
    assert held() == want and files() <= 4 < before
    table.write(table.unseen(rows(range(15, 25)), 3), 3)
    assert held() == [(i, f"t{i}") for i in range(25)]
    table.vacuum(spark)
    assert held() == [(i, f"t{i}") for i in range(25)]


def test_a_repeat_months_later_comes_out_once(spark, tmp_path):
    seen = BucketedTable(str(tmp_path / "seen"), "uid string", "uid", 4)
    got = []
    writer = cs.guarded(seen, lambda batch, number: got.extend(r["uid"] for r in batch.collect()))
    frame = lambda uids: spark.createDataFrame([(u, "x") for u in uids], "uid string, text string")
    for number, uids in enumerate([["a", "b", "a"], ["c"], ["a", "d"], ["b", "c", "e"]]):
        writer(frame(uids), number)
    assert sorted(got) == ["a", "b", "c", "d", "e"]


def test_embeddings_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 30, f"text number {i % 30}") for i in range(60)], "id bigint, text string")
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    table, embedder = cs.embedding_table(f"{tmp_path}/out", 4), hash_embedder(8)
    cs.run_available(stream, cs.embed_writer(table, embedder, compact_every=2), f"{tmp_path}/ckpt")
    found = {r["owner_id"]: r["vec"] for r in table.read(spark).collect()}
    want = {r["owner_id"]: r["vec"] for r in embed_rows(rows.distinct(), embedder, "message").collect()}
    assert found == want and table.read(spark).count() == 30
    assert table.read(spark).filter(F.col("dim") != 8).isEmpty()


def test_large_tables_arrive_in_more_files_and_as_many_batches(spark, tmp_path, monkeypatch):
    from palimpsest.plans import stream_queries as module

    monkeypatch.setattr(module, "ROWS_PER_FILE", 10, raising=False)
    batches = []
    for n, files in ((30, 4), (400, 40)):
        rows, home, sizes = spark.range(n), f"{tmp_path}/{n}", []
        stream = module.as_stream(spark, rows, f"{home}/in", rows.count())
        cs.run_available(stream, lambda batch, number: sizes.append(batch.count()), f"{home}/ckpt")
        parts = spark.read.parquet(f"{home}/in").groupBy(F.input_file_name()).count().collect()
        assert len(parts) == files and max(r["count"] for r in parts) <= 12
        assert sum(sizes) == n
        batches.append(len(sizes))
    assert batches == [2, 2]


def test_captures_are_stored_once(spark, tmp_path):
    """No batch leaves a second copy of its rows in the checkpoint folder (F4, F5)."""
    import os

    from palimpsest.plans.stream_queries import as_sent
    from palimpsest.session import checkpoint_dir

    def checkpointed():
        root = checkpoint_dir(spark).removeprefix("file:")
        return {d for d, _, _ in os.walk(root) if os.path.basename(d).startswith("rdd-")}

    before = checkpointed()
    n = 40
    rows = spark.range(n).selectExpr(
        "concat('c', id) AS uid", "concat('d', id % 3) AS device_uid", "'text' AS kind", "'manual' AS origin",
        "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS client_ts",
        "timestamp '2024-01-01 00:00:00' AS received_at", "concat('Remember that it is ', id) AS text",
        "cast(1.0 AS double) AS duration_s", "array(cast(id AS float)) AS speaker_vec",
    )
    sent = as_sent(spark, rows.unionByName(rows), f"{tmp_path}/in", 2 * n, per_batch=20)
    seen = BucketedTable(f"{tmp_path}/seen", "uid string", "uid", 4)
    tables = cs.CaptureTables(f"{tmp_path}/a")
    writer = cs.guarded(seen, lambda batch, number: tables.write(batch, "captures", number))
    cs.run_available(sent, writer, f"{tmp_path}/ckpt")
    stored = spark.read.parquet(f"{tmp_path}/a/captures")
    assert sorted(r["uid"] for r in stored.collect()) == sorted(f"c{k}" for k in range(n))
    assert stored.select("batch").distinct().count() > 1
    tables = cs.CaptureTables(f"{tmp_path}/b")
    cs.run_available(cs.dedup_captures(sent), cs.capture_writer(tables, "salt"), f"{tmp_path}/ckpt_b")
    assert sorted(r["uid"] for r in tables.read(spark, "captures", "uid string").collect()) == sorted(
        f"c{k}" for k in range(n)
    )
    assert tables.read(spark, "messages", "id long").count() == n
    assert checkpointed() == before


def test_the_same_one_of_repeated_rows_is_taken(spark):
    rows = [("a", k, [float(k)], {"k": k}) for k in range(30)] + [("b", 1, None, None), (None, 2, None, None), (None, 3, None, None)]
    frame = spark.createDataFrame(rows, "uid string, n int, v array<float>, m map<string, int>")
    one = {tuple(map(str, r)) for r in cs.one_per_key(frame.repartition(5), "uid").collect()}
    again = {tuple(map(str, r)) for r in cs.one_per_key(frame.repartition(2, "n"), "uid").collect()}
    assert one == again and len(one) == 3
    assert frame.columns == cs.one_per_key(frame, "uid").columns
