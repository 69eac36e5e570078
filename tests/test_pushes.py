"""Pushed batches through a stream equal one batch of all of them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from palimpsest.operators.ingest import MESSAGES_DDL, SourceRef, classify_batch, new_messages
from palimpsest.sources.batches import batch_messages, read_batches, stream_batches, with_push_id
from palimpsest.schema import MESSAGE_BATCH
from palimpsest.streaming.captures import run_available
from palimpsest.streaming.pushes import ingest_writer, message_table, push_ledger


def push(kind, conversation, texts):
    return json.dumps(
        {
            "source": {"kind": kind, "label": kind, "locator": kind + "://x"},
            "messages": [
                {"conversation_external_id": conversation, "text": t, "ts": f"2024-01-01T10:{i:02d}:00Z", "is_me": i % 2 == 0}
                for i, t in enumerate(texts)
            ],
        }
    )


def test_pushes_come_in_once(spark, tmp_path):
    pushes = [
        push("sms", "a", ["hello there", "how are you", ""]),
        push("sms", "a", ["hello there", "something new here"]),  # its first message is known
        push("mail", "a", ["hello there"]),  # another source's conversation
        push("sms", "b", ["one more", "https://x.org"]),
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    for n, line in enumerate(pushes + pushes[:2] + pushes[3:]):  # some are sent again
        (folder / f"{n}.json").write_text(line + "\n")
    table, ledger = message_table(str(tmp_path / "m"), 4), push_ledger(str(tmp_path / "l"), 4)
    stream = stream_batches(spark, str(folder), 2)
    run_available(stream, ingest_writer(table, ledger, "salt", compact_every=2), str(tmp_path / "c"))
    found = sorted((r["conversation_id"], r["content_hash"], r["text"]) for r in table.read(spark).collect())

    rows = batch_messages(spark.read.schema(MESSAGE_BATCH).json(str(folder)))
    want = []
    for kind in ("sms", "mail"):
        part = rows.filter(F.col("source_kind") == kind)
        made = new_messages(
            classify_batch(part, spark.createDataFrame([], MESSAGES_DDL), "salt", SourceRef(kind, kind, kind + "://x"))
        )
        want += [(r["conversation_id"], r["content_hash"], r["text"]) for r in made.collect()]
    assert found == sorted(want) and len(found) == 5
    assert ledger.read(spark).count() == 4
    assert read_batches(spark, str(folder)).count() == rows.count()
    ids = with_push_id(spark.read.schema(MESSAGE_BATCH).json(str(folder))).select("push_id").distinct()
    assert ids.count() == 4
