"""Streaming jobs run over the given tables with an available-now trigger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.dates import to_iso
from palimpsest.functions.vectors import hash_embedder
from palimpsest.operators.examples import training_rows
from palimpsest.plans import sql as q
from palimpsest.plans.adapters import SALT, captures, chat_messages, frames, turn_conversations, vectors
from palimpsest.plans.evaluation_queries import RULES
from palimpsest.plans.registry import ORACLES, query
from palimpsest.plans.training_queries import _TURN_SQL
from palimpsest.session import checkpoint_dir, free_shuffles
from palimpsest.streaming import captures as cs
from palimpsest.streaming import retention as rt
from palimpsest.streaming import state as st
from palimpsest.streaming import turns as tn
from palimpsest.streaming.tables import BucketedTable


ROWS_PER_FILE = 100_000  # of an arriving file
ROWS_PER_BATCH = 4_000_000  # of a micro-batch of captures, about


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_stream(
    spark: SparkSession, rows: DataFrame, path: str, n_rows: int, files: int = 4, by: str | None = None
) -> DataFrame:
    """Write a table of ``n_rows`` rows as arriving files and read them as a stream.

    Small tables come as ``files`` files, two of them per micro-batch. Where a file would hold more
    than ``ROWS_PER_FILE`` rows, all files are cut into as many as that takes, and a micro-batch
    reads all parts of two: a task has a bounded number of rows, the number of micro-batches stays.
    The rows are dealt to the files by a hash of ``by``, or in turn.
    """
    parts = max(1, -(-n_rows // (files * ROWS_PER_FILE)))
    number = files * parts
    dealt = rows.repartition(number) if by is None else rows.repartition(number, F.xxhash64(by, F.lit(3)))
    dealt.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * parts).parquet(path)


def _arrived(spark, sf):
    """Captures with voice vectors, every one sent twice, and their number."""
    vec = vectors(spark, sf).select(F.col("id").alias("user_id"), F.col("vec").alias("speaker_vec"))
    rows = captures(spark, sf).join(vec, "user_id", "left").select(
        "uid", "device_uid", "kind", "origin", "client_ts", "received_at", "text", "duration_s", "speaker_vec"
    )
    return rows.unionByName(rows), 2 * captures(spark, sf).count()


def as_sent(spark: SparkSession, rows: DataFrame, path: str, n_rows: int, per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    """Write ``n_rows`` rows as arriving files, from the tasks that have them, and read them as a stream.

    Rows with long vectors are not moved to be dealt. A file has at most ``ROWS_PER_FILE`` rows, a
    micro-batch about ``per_batch`` of them and at most half of the files, so what a batch moves
    and frees stays the same as the table grows.
    """
    rows.write.option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "zstd").parquet(path)
    batches = max(2, -(-n_rows // per_batch))
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


@query(
    "stream_capture_dedup",
    q.with_tables("cap") + f"SELECT uid, {q.iso('client_ts')} AS at FROM cap",
)
def stream_capture_dedup(spark, sf):
    """Captures that arrive twice come out once."""
    home = work_dir(spark, "dedup")
    rows, n_rows = _arrived(spark, sf)
    stream = as_sent(spark, rows, f"{home}/in", n_rows)
    free_shuffles(spark)
    seen = BucketedTable(f"{home}/seen", "uid string", "uid", 16)
    tables = cs.CaptureTables(f"{home}/tables")
    writer = cs.guarded(seen, lambda batch, number: tables.write(batch, "captures", number))
    cs.run_available(stream, writer, f"{home}/ckpt")
    return spark.read.parquet(f"{home}/tables/captures").select("uid", to_iso(F.col("client_ts")).alias("at"))


@query(
    "stream_capture_corpus",
    q.with_tables("cap")
    + "SELECT 'captures' AS tbl, count(*) AS n FROM cap UNION ALL "
    "SELECT 'memories', count(*) FROM cap WHERE kind = 'text' AND text LIKE 'Remember that %'",
)
def stream_capture_corpus(spark, sf):
    """Routing and writing in one streaming query. Audio of the few enrolled clips' neighbours
    varies with arrival order, so only what does not depend on it is counted."""
    home = work_dir(spark, "captures")
    rows, n_rows = _arrived(spark, sf)
    stream = as_sent(spark, rows, f"{home}/in", n_rows)
    free_shuffles(spark)
    tables = cs.CaptureTables(f"{home}/tables")
    cs.run_available(
        cs.dedup_captures(stream), cs.capture_writer(tables, SALT, embedder=hash_embedder(16)), f"{home}/ckpt"
    )
    seen = spark.read.parquet(f"{home}/tables/captures")
    texts = seen.filter("kind = 'text'").select(F.col("uid").alias("source_ref"))
    made = spark.read.parquet(f"{home}/tables/memories").join(texts, "source_ref", "left_semi")
    count = lambda name, df: df.agg(F.lit(name).alias("tbl"), F.count("*").alias("n"))
    return count("captures", seen).unionByName(count("memories", made))


@query(
    "stream_embeddings",
    "SELECT doc_id AS owner_id, 16 AS dim FROM documents",
)
def stream_embeddings(spark, sf):
    from palimpsest.plans.adapters import table

    home = work_dir(spark, "embed")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    stream = as_stream(spark, rows.unionByName(rows), f"{home}/in", 2 * rows.count())
    table_ = cs.embedding_table(f"{home}/embeddings", 16)
    cs.run_available(stream, cs.embed_writer(table_, hash_embedder(16), compact_every=2), f"{home}/ckpt")
    return table_.read(spark).select("owner_id", "dim")


@query(
    "stream_retention",
    """SELECT user_id AS device, event_id AS uid FROM events
      QUALIFY sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 40000""",
)
def stream_retention(spark, sf):
    """Entries arrive in any order over three micro-batches; what is kept equals the batch result."""
    from palimpsest.plans.adapters import table

    st.use_rocksdb(spark)
    home = work_dir(spark, "spool")
    entries = table(spark, sf, "events").select(
        F.col("user_id").alias("device"),
        F.col("event_id").alias("uid"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
    )
    stream = as_stream(spark, entries, f"{home}/in", entries.count(), 6, "uid")
    cs.write_available(rt.stream_retention(stream, 40_000), f"{home}/out", f"{home}/ckpt")
    return rt.kept_entries(spark.read.parquet(f"{home}/out")).select("device", "uid")


def _device_frames(spark, sf):
    rows = frames(spark, sf)
    return rows.withColumn("device", F.col("device").cast("string"))


@query(
    "stream_noise_floor",
    q.with_tables("frame", recursive=True)
    + """, w AS (SELECT *, min(level_db) OVER (PARTITION BY device ORDER BY frame_no ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS lowest FROM frame),
      m AS (SELECT device, frame_no, level_db, lowest AS floor_db FROM w WHERE frame_no = 0
        UNION ALL SELECT w.device, w.frame_no, w.level_db,
          m.floor_db + (w.lowest - m.floor_db) * (CASE WHEN w.lowest < m.floor_db THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END)
        FROM m JOIN w ON w.device = m.device AND w.frame_no = m.frame_no + 1)
      SELECT CAST(device AS VARCHAR) AS device, frame_no, round(floor_db, 6) AS floor_db,
        round(CASE WHEN level_db < -45 THEN 0 ELSE 1 / (1 + exp(-(level_db - floor_db - 12) / 3)) END, 6) AS prob FROM m""",
)
def stream_noise_floor(spark, sf):
    st.use_rocksdb(spark)
    home = work_dir(spark, "floor")
    rows = _device_frames(spark, sf).select("device", "frame_no", "ts", "level_db")
    rows.write.parquet(f"{home}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{home}/in")
    cs.write_available(st.speech_probability(stream), f"{home}/out", f"{home}/ckpt")
    return spark.read.parquet(f"{home}/out").select(
        "device", "frame_no", F.round("floor_db", 6).alias("floor_db"), F.round("prob", 6).alias("prob")
    )


@query(
    "stream_segments",
    f"SELECT CAST(device AS VARCHAR) AS device, first_frame, last_frame, n_frames FROM ({ORACLES['speech_segments']})",
)
def stream_segments(spark, sf):
    """Segments of the whole stream; a closing row per device lets out what is still open."""
    st.use_rocksdb(spark)
    home = work_dir(spark, "segments")
    rows = _device_frames(spark, sf).select("device", "frame_no", "ts", "prob")
    rows = rows.unionByName(
        rows.groupBy("device").agg(
            (F.max("frame_no") + 1).alias("frame_no"), F.max("ts").alias("ts"), F.lit(None).cast("double").alias("prob")
        )
    )
    rows.write.parquet(f"{home}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{home}/in")
    cs.write_available(st.stream_segments(stream, RULES), f"{home}/out", f"{home}/ckpt")
    return spark.read.parquet(f"{home}/out").select("device", "first_frame", "last_frame", "n_frames")


@query("stream_gate")
def stream_gate(spark, sf):
    st.use_rocksdb(spark)
    home = work_dir(spark, "gate")
    rows = _device_frames(spark, sf).select("device", "ts", "level_db")
    rows.write.parquet(f"{home}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{home}/in")
    gated = st.stream_gate(stream, -50.0, hangover_ms=100, preroll_ms=64, max_ms=1000, min_ms=30)
    cs.write_available(gated, f"{home}/out", f"{home}/ckpt")
    return spark.read.parquet(f"{home}/out")


@query("stream_turns", _TURN_SQL + "SELECT conversation_id, turn_no, role, md5(text) AS text_md5, n_messages FROM turn")
def stream_turns(spark, sf):
    """The live twin of turn building: messages arrive in any order over three micro-batches."""
    st.use_rocksdb(spark)
    home = work_dir(spark, "turns")
    rows = training_rows(chat_messages(spark, sf)).join(
        turn_conversations(spark, sf).select("conversation_id", "is_group"), "conversation_id"
    ).select("conversation_id", "id", "ts", "is_me", "is_group", "sender_name", "text")
    stream = as_stream(spark, rows, f"{home}/in", rows.count(), 6, "id")
    cs.write_available(tn.stream_turns(stream), f"{home}/out", f"{home}/ckpt")
    return tn.current_turns(spark.read.parquet(f"{home}/out")).select(
        "conversation_id", "turn_no", "role", F.md5("text").alias("text_md5"), "n_messages"
    )
