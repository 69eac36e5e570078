"""Capture streams: idempotent arrival, routing into the corpus, memories and embeddings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.vectors import Embedder, hash_embedder
from palimpsest.operators.captures import as_messages, route_captures
from palimpsest.operators.embeddings import embed_rows
from palimpsest.operators.ingest import MESSAGES_DDL, SourceRef, classify_batch, new_messages
from palimpsest.operators.memories import extract_memories
from palimpsest.operators.voice import MIN_ENROLL_SAMPLES, enroll
from palimpsest.schema import PROFILE
from palimpsest.session import free_shuffles, materialize
from palimpsest.streaming.tables import BucketedTable

CAPTURE_SOURCE = SourceRef("capture", "Captures", "captures")


def dedup_captures(stream: DataFrame) -> DataFrame:
    """The first arrival of each uid, however late it comes or is repeated.

    There is no watermark: one uid per capture stays in the state store, dealt by uid. ``guarded``
    does without that state.
    """
    return stream.dropDuplicates(["uid"])


def guarded(seen: BucketedTable, writer):
    """A ``foreachBatch`` function that hands ``writer`` the rows whose uid no earlier batch had.

    ``seen`` keeps the uids; a batch reads the buckets of its own ones, so a repeat is found however
    late it comes and the stream itself holds no state. The uids are written last: a batch that
    failed before comes again as it was. The rows are moved once, by uid, and not stored besides: of
    rows with one uid the same is taken whenever they are read, so a writer may read them again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = seen.stored_keys(batch, batch_id)
        writer(one_per_key(batch, seen.key).join(stored, seen.key, "left_anti"), batch_id)
        seen.write(batch.select(seen.key).distinct().join(stored, seen.key, "left_anti"), batch_id)
        free_shuffles(batch.sparkSession)

    return write


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """One row of each value of ``key``, the same one in whatever order the rows are read."""
    rest = [c for c in rows.columns if c != key]
    if not rest:
        return rows.distinct()
    told = [f.name for f in rows.schema.fields if f.name != key and "map<" not in f.dataType.simpleString()]
    one = F.min_by(F.struct(*rest), F.xxhash64(*told) if told else F.lit(0))
    return rows.groupBy(key).agg(one.alias("_one")).select(*[F.col(c if c == key else f"_one.{c}") for c in rows.columns])


@dataclass(frozen=True)
class CaptureTables:
    """Append-only parquet tables under one path, one folder per micro-batch.

    A batch that is run again overwrites its own folders, so retries change nothing. In a file the
    captures of a device lie together, and files are packed with zstd: hashes, texts and vectors
    take most of the disk.
    """

    path: str

    def read(self, spark: SparkSession, table: str, schema, before: int | None = None) -> DataFrame:
        try:
            rows = spark.read.option("basePath", f"{self.path}/{table}").parquet(f"{self.path}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            if isinstance(schema, str):
                schema = T.StructType.fromDDL(schema)
            return spark.createDataFrame([], schema)
        if before is not None:
            rows = rows.filter(F.col("batch") < before)
        return rows.drop("batch")

    def write(self, rows: DataFrame, table: str, batch: int) -> None:
        if "device_uid" in rows.columns:
            rows = rows.sortWithinPartitions("device_uid")
        folder = f"{self.path}/{table}/batch={batch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(folder)

    def put(self, rows: DataFrame, table: str, batch: int) -> DataFrame:
        """Write the rows of a batch and give back what was written, for the tables made of it."""
        self.write(rows, table, batch)
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.path}/{table}/batch={batch}")


def bootstrap_profile(
    captures: DataFrame, profile: DataFrame, min_n: int = MIN_ENROLL_SAMPLES
) -> DataFrame:
    """Enrol manual clips with a transcript, oldest first, while there are fewer than ``min_n``.

    At most ``min_n`` rows are folded in.
    """
    have = (profile.agg(F.max("n_samples").alias("n")).first()["n"] or 0)
    if have >= min_n:
        return profile
    clips = (
        captures.filter(
            (F.col("kind") == "audio")
            & (F.col("origin") == "manual")
            & F.col("speaker_vec").isNotNull()
            & (F.coalesce("text", F.lit("")) != "")
        )
        .orderBy("received_at", "uid")
        .limit(min_n - have)
        .select(F.col("speaker_vec").alias("vec"))
    )
    if clips.isEmpty():
        return profile
    return enroll(clips, profile if have else None)


def capture_writer(
    tables: CaptureTables,
    salt: str,
    policy: str = "discard",
    embedder: Embedder | None = None,
):
    """A ``foreachBatch`` function: routes captures and writes captures, messages, memories,
    embeddings and the voice profile."""
    embedder = embedder or hash_embedder(384)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = tables.read(spark, "captures", "uid string, status string", batch_id).select("uid")
        profile = _latest_profile(tables.read(spark, "profile", _profile_schema(), batch_id))
        fresh = batch.dropDuplicates(["uid"]).join(seen, "uid", "left_anti")
        routed = tables.put(route_captures(fresh, profile, policy), "captures", batch_id)
        del fresh  # and its shuffle, the widest
        free_shuffles(spark)
        stored = tables.read(spark, "messages", MESSAGES_DDL, batch_id)
        classified = classify_batch(as_messages(routed), stored, salt, CAPTURE_SOURCE)
        messages = tables.put(new_messages(classified), "messages", batch_id)
        mine = routed.filter(F.col("route") == "corpus")
        tables.write(extract_memories(mine.select("uid", "text")), "memories", batch_id)
        tables.write(embed_rows(messages.select("id", "text"), embedder, "message"), "embeddings", batch_id)
        unsure = mine.filter(F.col("speaker_is_me").isNull())
        updated = bootstrap_profile(unsure, profile).withColumn("seq", F.lit(batch_id).cast("long"))
        tables.write(updated, "profile", batch_id)
        free_shuffles(spark)

    return write


def _profile_schema():
    return T.StructType([*PROFILE.fields, T.StructField("seq", T.LongType())])


def _latest_profile(history: DataFrame) -> DataFrame:
    """The profile after the newest batch."""
    return history.orderBy(F.col("seq").desc()).limit(1).drop("seq")


EMBEDDED = "owner_kind string, owner_id bigint, model string, dim int, vec array<float>"


def embedding_table(path: str, buckets: int = 64) -> BucketedTable:
    return BucketedTable(path, EMBEDDED, "owner_id", buckets)


def embed_writer(table: BucketedTable, embedder: Embedder, owner_kind: str = "message", compact_every: int = 16):
    """A ``foreachBatch`` function that embeds new rows (id, text) not embedded before.

    A batch reads the ids in the buckets of its own rows. Every ``compact_every`` batches the
    table is compacted, so the files of a bucket don't pile up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(["id"]).withColumnRenamed("id", "owner_id")
        fresh = table.unseen(rows, batch_id).withColumnRenamed("owner_id", "id")
        table.write(embed_rows(materialize(fresh), embedder, owner_kind), batch_id)
        if (batch_id + 1) % compact_every == 0:
            table.compact(batch.sparkSession, batch_id)

    return write


def run_available(stream: DataFrame, writer, checkpoint: str) -> None:
    """Process everything that has arrived with a ``foreachBatch`` writer, then stop."""
    query = (
        stream.writeStream.foreachBatch(writer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def write_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived into a parquet folder, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
