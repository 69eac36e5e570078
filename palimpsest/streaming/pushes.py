"""Continuous ingest of pushed message batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identity import hash_long
from palimpsest.operators.ingest import MESSAGES_DDL, SourceRef, classify_batch, new_messages, source_id
from palimpsest.session import materialize
from palimpsest.sources.batches import batch_messages
from palimpsest.streaming.captures import guarded
from palimpsest.streaming.tables import BucketedTable


def push_ledger(path: str, buckets: int = 64) -> BucketedTable:
    """The pushes that are done, by ``push_id``."""
    return BucketedTable(path, "push_id string", "push_id", buckets)


def message_table(path: str, buckets: int = 64) -> BucketedTable:
    return BucketedTable(path, MESSAGES_DDL, "conversation_id", buckets)


def ingest_writer(messages: BucketedTable, ledger: BucketedTable, salt: str, compact_every: int = 16):
    """A ``foreachBatch`` function that adds the new messages of pushes (source, messages, push_id).

    A push that is in the ledger does nothing; neither does a message that is stored under its
    conversation. A micro-batch reads the buckets of its own pushes and conversations. Messages are
    written before the ledger, both in folders of the micro-batch, so one that failed is repeated
    with the same result.
    """

    def add(pushes: DataFrame, batch_id: int) -> None:
        rows = materialize(batch_messages(pushes))
        source = SourceRef(F.col("source_kind"), F.col("source_label"), F.col("source_locator"))
        src = source_id(source.kind, source.locator, F.lit(""))
        own = hash_long(src.cast("string"), F.col("conversation_external_id"))
        asked = [r["b"] for r in rows.select(messages.bucket(own).alias("b")).distinct().collect()]  # bucket numbers
        stored = messages.read(rows.sparkSession, batch_id).filter(F.col("bucket").isin(asked))
        messages.write(new_messages(materialize(classify_batch(rows, stored, salt, source))), batch_id)
        if (batch_id + 1) % compact_every == 0:
            messages.compact(rows.sparkSession, batch_id)

    return guarded(ledger, add)
