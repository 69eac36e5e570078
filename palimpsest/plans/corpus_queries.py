"""Loading, upserts, statistics and listings of the corpus tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.dates import to_iso
from palimpsest.operators import captures as cap_ops
from palimpsest.operators import corpus as stats
from palimpsest.operators import examples, ingest
from palimpsest.plans import sql as q
from palimpsest.plans.adapters import (
    BASE_S,
    SALT,
    captures,
    chat_conversations,
    chat_messages,
    contacts,
    conversations,
    memories,
    messages,
    sources,
    table,
)
from palimpsest.plans.registry import query
from palimpsest.session import materialize

_TOTALS = """CAST(coalesce(sum(CASE WHEN is_me THEN word_count END), 0) AS BIGINT)"""


@query(
    "corpus_headline",
    q.with_tables("msg", "conv", "mem", "cap")
    + f"""SELECT m.*, c.*, e.*, p.*, m.me_words >= 30000 AS ready_for_first_train FROM
      (SELECT {_TOTALS} AS me_words, count(*) FILTER (is_me) AS me_messages,
              count(*) FILTER (NOT is_me) AS other_messages FROM msg) m,
      (SELECT count(*) AS conversations FROM conv) c,
      (SELECT count(*) FILTER (NOT archived) AS memories FROM mem) e,
      (SELECT count(*) FILTER (status IN ('pending', 'processing')) AS captures_pending FROM cap) p""",
)
def corpus_headline(spark, sf):
    return stats.stats_headline(
        messages(spark, sf), conversations(spark, sf), memories(spark, sf), captures(spark, sf)
    )


@query(
    "words_by_register",
    q.with_tables("msg")
    + "SELECT register, count(*) AS messages, CAST(sum(word_count) AS BIGINT) AS words FROM msg WHERE is_me GROUP BY register",
)
def words_by_register(spark, sf):
    return stats.by_register(messages(spark, sf))


@query(
    "words_by_lang",
    q.with_tables("msg")
    + "SELECT coalesce(lang, 'unknown') AS lang, CAST(sum(word_count) AS BIGINT) AS words FROM msg WHERE is_me GROUP BY 1",
)
def words_by_lang(spark, sf):
    return stats.by_lang(messages(spark, sf))


@query(
    "words_by_month",
    q.with_tables("msg")
    + "SELECT strftime(ts, '%Y-%m') AS month, CAST(sum(word_count) AS BIGINT) AS words FROM msg WHERE is_me GROUP BY 1",
)
def words_by_month(spark, sf):
    return stats.by_month(messages(spark, sf))


@query(
    "words_by_source",
    q.with_tables("msg", "conv", "src")
    + """SELECT s.id, s.kind, s.label, count(*) AS messages, CAST(sum(m.word_count) AS BIGINT) AS words
      FROM src s JOIN conv c ON c.source_id = s.id JOIN msg m ON m.conversation_id = c.id AND m.is_me
      GROUP BY ALL""",
)
def words_by_source(spark, sf):
    return stats.by_source(sources(spark, sf), conversations(spark, sf), messages(spark, sf))


@query(
    "source_totals",
    q.with_tables("msg", "conv", "src")
    + f"""SELECT s.id, s.kind, s.label, s.locator, count(m.id) AS messages,
      count(*) FILTER (m.is_me) AS me_messages, {_TOTALS} AS me_words
      FROM src s LEFT JOIN conv c ON c.source_id = s.id LEFT JOIN msg m ON m.conversation_id = c.id
      GROUP BY ALL""",
)
def source_totals(spark, sf):
    rows = stats.list_sources(sources(spark, sf), conversations(spark, sf), messages(spark, sf))
    return rows.drop("device_uid", "created_at", "last_import_at")


@query(
    "my_messages_by_source",
    q.with_tables("msg", "conv", "src")
    + """SELECT m.id, s.kind, s.label, m.word_count FROM msg m JOIN conv c ON m.conversation_id = c.id
      JOIN src s ON s.id = c.source_id WHERE m.is_me""",
)
def my_messages_by_source(spark, sf):
    rows = stats.my_messages_by_source(sources(spark, sf), conversations(spark, sf), messages(spark, sf))
    return rows.select("id", "kind", "label", "word_count")


@query(
    "sender_names",
    q.with_tables("chat_msg", "contact")
    + """SELECT m.id, m.conversation_id, c.display_name AS sender_name FROM chat_msg m
      LEFT JOIN contact c ON c.id = m.contact_id""",
)
def sender_names(spark, sf):
    rows = examples.with_sender_names(
        chat_messages(spark, sf).drop("sender_name"), contacts(spark, sf)
    )
    return rows.select("id", "conversation_id", "sender_name")


@query(
    "conversations_with_mine",
    q.with_tables("msg", "conv", "src")
    + """SELECT c.id, c.title, c.is_group, s.kind AS source_kind, s.label AS source_label
      FROM conv c JOIN src s ON s.id = c.source_id
      WHERE EXISTS (SELECT 1 FROM msg m WHERE m.conversation_id = c.id AND m.is_me)""",
)
def conversations_with_mine(spark, sf):
    return examples.conversations_with_mine(
        conversations(spark, sf), sources(spark, sf), messages(spark, sf)
    )


@query(
    "source_deletion",
    q.with_tables("msg", "conv", "src")
    + """SELECT 'sources' AS tbl, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM src WHERE id <> 2
      UNION ALL SELECT 'conversations', count(*), CAST(sum(id) AS BIGINT) FROM conv WHERE source_id <> 2
      UNION ALL SELECT 'messages', count(*), CAST(sum(id) AS BIGINT) FROM msg
        WHERE conversation_id NOT IN (SELECT id FROM conv WHERE source_id = 2)""",
)
def source_deletion(spark, sf):
    left = ingest.delete_source(_corpus(spark, sf), 2)
    total = lambda name, df: df.agg(
        F.lit(name).alias("tbl"), F.count("*").alias("n"), F.sum("id").alias("ids")
    )
    return (
        total("sources", left.sources)
        .unionByName(total("conversations", left.conversations))
        .unionByName(total("messages", left.messages))
    )


def _corpus(spark, sf) -> ingest.Corpus:
    return ingest.Corpus(
        sources(spark, sf), contacts(spark, sf), conversations(spark, sf), messages(spark, sf)
    )


# --- loading ----------------------------------------------------------------------------

SOURCE = ingest.SourceRef("doc", "Documents", "/docs")


def document_batch(spark, sf, lang=None):
    """Documents, of one language if given, as canonical messages; time is per source, so exact
    copies collide."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    docs = table(spark, sf, "documents")
    return (docs if lang is None else docs.filter(F.col("lang") == lang)).select(
        F.col("source").alias("conversation_external_id"),
        "text",
        F.timestamp_seconds(F.lit(BASE_S) + number * 3600).alias("ts"),
        (F.col("lang") != "es").alias("is_me"),
        F.lit("doc").alias("register"),
        F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("external_id"),
        F.col("source").alias("conversation_title"),
        F.lit(False).alias("is_group"),
        F.when(F.col("lang") == "es", F.concat(F.col("source"), F.lit("@mail.example"))).alias(
            "sender_handle"
        ),
        F.when(F.col("lang") == "es", F.upper("source")).alias("sender_name"),
        F.lit(None).cast("map<string,string>").alias("meta"),
        F.col("doc_id").alias("seq"),
    )


_BATCH = f"""SELECT doc_id, source, lang <> 'es' AS is_me, lang, t,
    {q.reason("t")} AS reason, {q.words("t")} AS wc,
    sha256({q.iso(q.seconds("CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) * 3600"))} || chr(0) || t || chr(0)) AS ch
  FROM (SELECT *, {q.clean("text")} AS t FROM documents)"""
_CLASSES = """SELECT source, ch, min(doc_id) AS doc_id, count(*) AS n,
    bool_or(lang = 'en') AS known, arg_min(is_me, doc_id) AS is_me, arg_min(wc, doc_id) AS wc
  FROM b WHERE reason IS NULL GROUP BY source, ch"""


def _stored(spark, sf):
    """The messages table after the English documents were loaded."""
    empty = ingest.Corpus.empty(spark)
    first = document_batch(spark, sf, "en")
    return ingest.new_messages(ingest.classify_batch(first, empty.messages, SALT, SOURCE))


@query(
    "import_report",
    f"WITH b AS ({_BATCH}), c AS ({_CLASSES}), r AS (SELECT reason, count(*) AS n FROM b WHERE reason IS NOT NULL GROUP BY reason) "
    """SELECT (SELECT count(*) FROM b) AS received,
      (SELECT count(*) FROM c WHERE NOT known) AS inserted,
      CAST((SELECT sum(n) FROM c) - (SELECT count(*) FROM c WHERE NOT known) AS BIGINT) AS duplicates,
      (SELECT count(*) FROM b WHERE reason IS NOT NULL) AS skipped,
      coalesce((SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM r), '') AS skipped_reasons,
      CAST(coalesce((SELECT sum(wc) FROM c WHERE NOT known AND is_me), 0) AS BIGINT) AS me_words,
      (SELECT count(DISTINCT source) FROM c WHERE NOT known) AS conversations""",
)
def import_report(spark, sf):
    report = ingest.import_report(
        ingest.classify_batch(
            document_batch(spark, sf), _stored(spark, sf), SALT, SOURCE, fields=ingest.REPORT_FIELDS
        )
    )
    return report.withColumn("skipped_reasons", _map_text("skipped_reasons"))


def _map_text(column: str):
    return F.array_join(
        F.transform(
            F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        ),
        ",",
    )


@query(
    "ingested_messages",
    f"WITH b AS ({_BATCH}), c AS ({_CLASSES}) "
    f"""SELECT source, ch AS content_hash, 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS external_id, is_me, wc AS word_count,
      {q.hash_long(q.hash_long(q.hash_long("'doc'", "'/docs'", "''"), "source"), "ch")} AS id
      FROM c WHERE NOT known""",
)
def ingested_messages(spark, sf):
    classified = materialize(
        ingest.classify_batch(document_batch(spark, sf), _stored(spark, sf), SALT, SOURCE)
    )
    names = classified.filter("is_new").select(
        "conversation_id", "content_hash", F.col("conversation_external_id").alias("source")
    )
    rows = ingest.new_messages(classified).join(names, ["conversation_id", "content_hash"])
    return rows.select("source", "content_hash", "external_id", "is_me", "word_count", "id")


@query(
    "merged_reports",
    f"WITH b AS ({_BATCH}), c AS (SELECT lang, source, ch, count(*) AS n, arg_min(is_me, doc_id) AS is_me, arg_min(wc, doc_id) AS wc "
    "FROM b WHERE reason IS NULL GROUP BY lang, source, ch), "
    "r AS (SELECT reason, count(*) AS n FROM b WHERE reason IS NOT NULL GROUP BY reason) "
    """SELECT (SELECT count(*) FROM b) AS received, (SELECT count(*) FROM c) AS inserted,
      CAST((SELECT sum(n) - count(*) FROM c) AS BIGINT) AS duplicates,
      (SELECT count(*) FROM b WHERE reason IS NOT NULL) AS skipped,
      CAST((SELECT sum(wc) FROM c WHERE is_me) AS BIGINT) AS me_words,
      coalesce((SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM r), '') AS skipped_reasons,
      (SELECT count(DISTINCT source) FROM b) AS conversations""",
)
def merged_reports(spark, sf):
    """One report per language chunk, each against an empty corpus, merged."""
    empty = ingest.Corpus.empty(spark).messages
    reports = None
    for chunk, lang in enumerate(("en", "fr", "de", "es")):
        part = ingest.import_report(
            ingest.classify_batch(
                document_batch(spark, sf, lang), empty, SALT, SOURCE, fields=ingest.REPORT_FIELDS
            )
        ).withColumn("chunk", F.lit(chunk))
        reports = part if reports is None else reports.unionByName(part)
    merged = ingest.merge_reports(reports, document_batch(spark, sf))
    return merged.withColumn("skipped_reasons", _map_text("skipped_reasons"))


# --- upserts ----------------------------------------------------------------------------


@query(
    "source_upsert",
    q.with_tables("src")
    + f""", n AS (SELECT DISTINCT 'import' AS kind, n_name AS label, '/data/' || (n_regionkey + 12) AS locator FROM nation),
      i AS (SELECT kind, locator, max(label) AS label FROM n GROUP BY kind, locator)
      SELECT coalesce(s.id, {q.hash_long("i.kind", "i.locator", "''")}) AS id, coalesce(s.kind, i.kind) AS kind,
        coalesce(i.label, s.label) AS label, coalesce(s.locator, i.locator) AS locator
      FROM src s FULL JOIN i ON s.kind = i.kind AND s.locator = i.locator""",
)
def source_upsert(spark, sf):
    new = table(spark, sf, "nation").select(
        F.lit("import").alias("kind"),
        F.col("n_name").alias("label"),
        F.concat(F.lit("/data/"), F.col("n_regionkey") + 12).alias("locator"),
        F.lit("").alias("device_uid"),
        F.timestamp_seconds(F.lit(BASE_S)).alias("created_at"),
    )
    return ingest.upsert_sources(sources(spark, sf), new).select("id", "kind", "label", "locator")


@query(
    "contact_upsert",
    q.with_tables("contact")
    + f""", n AS (SELECT sha256('salt' || chr(0) || 'contact' || (c_nationkey + 1) || chr(0)) AS handle_hash,
          arg_min(c_name, c_custkey) AS name FROM customer GROUP BY c_nationkey)
      SELECT coalesce(c.id, {q.hash_long("n.handle_hash")}) AS id, coalesce(c.handle_hash, n.handle_hash) AS handle_hash,
        coalesce(c.display_name, n.name) AS display_name, false AS is_me
      FROM contact c FULL JOIN n ON c.handle_hash = n.handle_hash""",
)
def contact_upsert(spark, sf):
    from palimpsest.functions.identity import handle_hash

    new = table(spark, sf, "customer").select(
        handle_hash(SALT, F.concat(F.lit("contact"), F.col("c_nationkey") + 1)).alias("contact_key"),
        F.col("c_name").alias("display_name"),
        F.lit(False).alias("is_me"),
        F.col("c_custkey").alias("seq"),
    )
    return ingest.upsert_contacts(contacts(spark, sf), new)


@query(
    "conversation_upsert",
    q.with_tables("chat_conv")
    + """, n AS (SELECT o_custkey AS id, arg_min(o_orderpriority, o_orderkey) AS title FROM orders GROUP BY o_custkey)
      SELECT coalesce(c.id, n.id) AS id, coalesce(c.source_id, 9) AS source_id,
        coalesce(c.external_id, 'order-' || n.id) AS external_id, coalesce(n.title, c.title) AS title,
        coalesce(c.is_group, false) AS is_group
      FROM chat_conv c FULL JOIN n ON c.id = n.id""",
)
def conversation_upsert(spark, sf):
    new = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("conversation_id"),
        F.lit(9).cast("long").alias("source_id"),
        F.concat(F.lit("order-"), F.col("o_custkey")).alias("conversation_external_id"),
        F.col("o_orderpriority").alias("conversation_title"),
        F.lit(False).alias("is_group"),
        F.col("o_orderkey").alias("seq"),
    )
    return ingest.upsert_conversations(chat_conversations(spark, sf), new)


@query(
    "source_union",
    q.with_tables("chat_msg", "doc_msg")
    + """SELECT register, is_me, count(*) AS n, count(contact_id) AS with_contact FROM
      (SELECT register, is_me, contact_id FROM chat_msg UNION ALL SELECT register, is_me, NULL FROM doc_msg
       UNION ALL SELECT 'speech', true, NULL FROM events) GROUP BY ALL""",
)
def source_union(spark, sf):
    utterances = captures(spark, sf).select(
        "text", F.col("client_ts").alias("ts"), F.lit("speech").alias("register"), F.lit(True).alias("is_me")
    )
    from palimpsest.plans.adapters import doc_messages

    rows = ingest.union_sources(
        chat_messages(spark, sf), doc_messages(spark, sf).drop("contact_id"), utterances
    )
    return rows.groupBy("register", "is_me").agg(
        F.count("*").alias("n"), F.count("contact_id").alias("with_contact")
    )


# --- captures ---------------------------------------------------------------------------

_SINCE = "2024-01-20 00:00:00"


@query(
    "capture_list",
    q.with_tables("cap")
    + f"""SELECT uid, status, {q.iso("received_at")} AS received FROM cap
      WHERE coalesce(processed_at, received_at) > TIMESTAMP '{_SINCE}' AND status = 'done'
      ORDER BY received_at DESC, uid LIMIT 50""",
)
def capture_list(spark, sf):
    rows = cap_ops.list_captures(captures(spark, sf), since=_SINCE, status="done")
    return rows.select("uid", "status", to_iso(F.col("received_at")).alias("received"))


@query(
    "sync_since",
    q.with_tables("cap", "mem")
    + f"""SELECT * FROM (SELECT 'memory' AS what, uid FROM mem WHERE updated_at > TIMESTAMP '2024-01-03 00:00:00'
        ORDER BY updated_at DESC, uid LIMIT 200)
      UNION ALL SELECT * FROM (SELECT 'capture', uid FROM cap
        WHERE coalesce(processed_at, received_at) > TIMESTAMP '2024-01-03 00:00:00'
        ORDER BY received_at DESC, uid LIMIT 200)""",
)
def sync_since(spark, sf):
    mem, cap = cap_ops.sync(memories(spark, sf), captures(spark, sf), "2024-01-03 00:00:00", limit=200)
    return mem.select(F.lit("memory").alias("what"), "uid").unionByName(
        cap.select(F.lit("capture").alias("what"), "uid")
    )


@query(
    "capture_memories",
    q.with_tables("cap", "mem")
    + """SELECT c.uid, coalesce(string_agg(m.uid, ',' ORDER BY m.id), '') AS memory_uids FROM cap c
      LEFT JOIN mem m ON m.source_ref = c.uid AND NOT m.archived GROUP BY c.uid""",
)
def capture_memories(spark, sf):
    rows = cap_ops.capture_memories(captures(spark, sf), memories(spark, sf))
    return rows.select("uid", F.array_join("memory_uids", ",").alias("memory_uids"))


@query(
    "capture_message",
    q.with_tables("cap")
    + """SELECT c.uid, max(e.event_id + 1000 * e.user_id) AS message_id FROM cap c
      LEFT JOIN events e ON 'c' || (e.event_id - e.event_id % 3) = c.uid GROUP BY c.uid""",
)
def capture_message(spark, sf):
    stored = table(spark, sf, "events").select(
        (F.col("event_id") + 1000 * F.col("user_id")).alias("id"),
        F.concat(F.lit("c"), F.col("event_id") - F.col("event_id") % 3).alias("external_id"),
    )
    return cap_ops.capture_message(captures(spark, sf), stored).select("uid", "message_id")


@query(
    "capture_patch",
    q.with_tables("cap")
    + """SELECT c.uid, coalesce(CASE WHEN e.event_type = 'error' THEN 'failed' END, c.status) AS status,
        coalesce(CASE WHEN e.value > 50 THEN 'long' END, c.text) AS text
      FROM cap c JOIN events e ON e.event_id = c.id""",
)
def capture_patch(spark, sf):
    patches = table(spark, sf, "events").select(
        F.concat(F.lit("c"), F.col("event_id")).alias("uid"),
        F.when(F.col("event_type") == "error", "failed").alias("status"),
        F.when(F.col("value") > 50, "long").alias("text"),
    )
    return cap_ops.update_captures(captures(spark, sf), patches).select("uid", "status", "text")


@query(
    "capture_log_state",
    "SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value FROM events GROUP BY user_id",
)
def capture_log_state(spark, sf):
    log = table(spark, sf, "events").select("user_id", "ts", "event_type", "value")
    return cap_ops.latest_state(log, "user_id", "ts").select("user_id", "event_type", "value")


@query(
    "capture_deletion",
    "SELECT 'c' || event_id AS uid FROM events WHERE event_type <> 'error'",
)
def capture_deletion(spark, sf):
    from palimpsest.operators.memories import delete_by_uid

    rows = captures(spark, sf)
    return delete_by_uid(rows, rows.filter("status = 'discarded'")).select("uid")
