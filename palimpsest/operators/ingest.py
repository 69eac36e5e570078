"""Idempotent loading of canonical messages into the corpus tables, with a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.dates import to_iso
from palimpsest.functions.identity import contact_key, content_hash, hash_long
from palimpsest.functions.text import clean_text, guess_lang, low_signal_reason, word_count
from palimpsest.session import materialize

MESSAGE_COLUMNS = [
    "id",
    "conversation_id",
    "contact_id",
    "is_me",
    "ts",
    "register",
    "lang",
    "text",
    "word_count",
    "external_id",
    "content_hash",
    "meta",
    "seq",
]
REPORT_FIELDS = ("is_me", "word_count")  # what ``import_report`` reads of a message
SOURCES_DDL = (
    "id bigint, kind string, label string, locator string, device_uid string, "
    "created_at timestamp, last_import_at timestamp"
)
CONTACTS_DDL = "id bigint, handle_hash string, display_name string, is_me boolean"
CONVERSATIONS_DDL = (
    "id bigint, source_id bigint, external_id string, title string, is_group boolean"
)
MESSAGES_DDL = (
    "id bigint, conversation_id bigint, contact_id bigint, is_me boolean, ts timestamp, "
    "register string, lang string, text string, word_count int, external_id string, "
    "content_hash string, meta string, seq bigint"
)


@dataclass(frozen=True)
class Corpus:
    """The four corpus tables."""

    sources: DataFrame
    contacts: DataFrame
    conversations: DataFrame
    messages: DataFrame

    @staticmethod
    def empty(spark) -> Corpus:
        make = lambda ddl: spark.createDataFrame([], ddl)
        return Corpus(
            make(SOURCES_DDL), make(CONTACTS_DDL), make(CONVERSATIONS_DDL), make(MESSAGES_DDL)
        )

    def checkpointed(self) -> Corpus:
        return Corpus(*[materialize(t) for t in (
            self.sources, self.contacts, self.conversations, self.messages
        )])


@dataclass(frozen=True)
class SourceRef:
    kind: str
    label: str
    locator: str = ""


def source_id(kind: Column, locator: Column, device_uid: Column) -> Column:
    return hash_long(kind, locator, device_uid)


def low_signal_filter(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with a ``reason`` column: NULL where the text is worth keeping."""
    return df.withColumn("reason", low_signal_reason(F.col(text)))


def project_messages(raw: DataFrame, compose: bool = True) -> DataFrame:
    """Clean text, then reason, ISO time, content hash, word count and language.

    ``compose=False`` skips Unicode composition for inputs known to be composed.
    """
    cleaned = raw.withColumn("text", clean_text(F.col("text"), compose))
    text = F.col("text")
    return (
        low_signal_filter(cleaned)
        .withColumn("content_hash", content_hash(to_iso(F.col("ts")), text))
        .withColumn("word_count", word_count(text))
        .withColumn("lang", guess_lang(text))
    )


def classify_batch(
    batch: DataFrame,
    stored: DataFrame,
    salt: str,
    source: SourceRef,
    device_uid: str = "",
    keep_names: bool = True,
    compose: bool = True,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """One row per distinct accepted message (with ``n`` copies and ``is_new``) and one per
    skip reason. The parts of ``source`` are texts, or columns of a batch from several sources.
    ``fields`` names the columns of a message that are asked for, all if not given; what isn't
    asked for, such as texts where only a report is wanted, is not moved.

    Copies and skipped rows fold map-side, so neither a hot conversation nor a hot message
    crosses the network more than once per task. The stored keys are probed afterwards.
    """
    rows = project_messages(batch, compose)
    src = source_id(F.lit(source.kind), F.lit(source.locator), F.lit(device_uid))
    key, shown = contact_key(
        salt, F.col("sender_handle"), F.col("sender_name"), F.col("is_me"), keep_names
    )
    conv = hash_long(src.cast("string"), F.col("conversation_external_id"))
    meta = F.when(F.size(F.coalesce(F.col("meta"), F.create_map())) > 0, F.to_json("meta"))
    seq = F.coalesce(F.col("seq"), F.lit(0)) if "seq" in batch.columns else F.lit(0)
    made = {
        "conversation_external_id": F.col("conversation_external_id"),
        "conversation_title": F.col("conversation_title"),
        "is_group": F.coalesce(F.col("is_group"), F.lit(False)),
        "contact_key": key,
        "display_name": shown,
        **{c: F.col(c) for c in ("is_me", "ts", "register", "lang", "text", "word_count", "external_id")},
        "meta": meta,
        "seq": seq.cast("long"),
    }
    payload = F.struct(*[c.alias(name) for name, c in made.items() if fields is None or name in fields])
    kept = F.col("reason").isNull()
    # Keys that cannot be NULL: otherwise the join below would push an IS NOT NULL test, with the
    # whole cleaning and hashing inlined, under everything and run it twice.
    no_conv, no_text = F.lit(0).cast("long"), F.lit("")
    folded = (
        rows.groupBy(
            F.coalesce(F.when(kept, conv), no_conv).alias("conversation_id"),
            F.coalesce(F.when(kept, F.col("content_hash")), F.col("reason"), no_text).alias(
                "content_hash"
            ),
            "reason",
        )
        .agg(
            F.min_by(F.when(kept, payload), F.struct(seq, F.col("external_id"))).alias("_m"),
            F.count("*").alias("n"),
            # An aggregate, not the key: a filter on it stays above the aggregate.
            F.bool_and(kept).alias("_kept"),
            F.min(src).alias("source_id"),
        )
        .select("conversation_id", "content_hash", "reason", "n", "_kept", "_m.*", "source_id")
    )
    known = stored.select(
        F.coalesce("conversation_id", no_conv).alias("conversation_id"),
        F.coalesce("content_hash", no_text).alias("content_hash"),
        F.lit(True).alias("_known"),
    )
    return (
        folded.join(known, ["conversation_id", "content_hash"], "left")
        .withColumn("is_new", F.col("_kept") & F.col("_known").isNull())
        .drop("_known", "_kept")
    )


def new_messages(classified: DataFrame) -> DataFrame:
    """Rows to append to the messages table."""
    return classified.filter("is_new").select(
        hash_long(F.col("conversation_id").cast("string"), F.col("content_hash")).alias("id"),
        "conversation_id",
        F.when(F.col("contact_key").isNotNull(), hash_long(F.col("contact_key"))).alias("contact_id"),
        *MESSAGE_COLUMNS[3:],
    )


def import_report(classified: DataFrame) -> DataFrame:
    """received, inserted, duplicates, skipped (+ per reason), my words, touched conversations."""
    small = classified.groupBy("reason").agg(
        F.sum("n").alias("n"),
        F.count_if("is_new").alias("inserted"),
        F.sum(F.when(F.col("is_new") & F.col("is_me"), F.col("word_count"))).alias("me_words"),
        F.count_distinct(F.when(F.col("is_new"), F.col("conversation_id"))).alias("conversations"),
    )
    kept = F.col("reason").isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return small.agg(
        zero(F.sum("n")).alias("received"),
        zero(F.sum("inserted")).alias("inserted"),
        zero(F.sum(F.when(kept, F.col("n") - F.col("inserted")))).alias("duplicates"),
        zero(F.sum(F.when(~kept, F.col("n")))).alias("skipped"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(~kept, F.struct("reason", "n"))))
        ).alias("skipped_reasons"),
        zero(F.sum("me_words")).alias("me_words"),
        zero(F.sum("conversations")).alias("conversations"),
    )


def merge_reports(reports: DataFrame, streamed_conversations: DataFrame | None = None) -> DataFrame:
    """Sum chunk reports; reasons add up, notes are joined in ``chunk`` order.

    ``conversations`` is the number of distinct ``streamed_conversations`` when given, else the
    largest of the chunks.
    """
    totals = reports.agg(
        *[
            F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
            for c in ("received", "inserted", "duplicates", "skipped", "me_words")
        ],
        F.max("conversations").alias("conversations"),
    ).withColumn("_one", F.lit(1))
    reasons = (
        reports.select(F.explode("skipped_reasons").alias("reason", "n"))
        .groupBy("reason")
        .agg(F.sum("n").alias("n"))
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias(
                "skipped_reasons"
            )
        )
        .withColumn("_one", F.lit(1))
    )
    merged = totals.join(reasons, "_one")
    if "notes" in reports.columns:
        notes = reports.agg(
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("chunk", "notes"))), lambda r: r["notes"]
                )
            ).alias("notes")
        ).withColumn("_one", F.lit(1))
        merged = merged.join(notes, "_one")
    if streamed_conversations is not None:
        n = streamed_conversations.agg(
            F.count_distinct("conversation_external_id").alias("conversations")
        ).withColumn("_one", F.lit(1))
        merged = merged.drop("conversations").join(n, "_one")
    return merged.drop("_one")


# --- upserts ----------------------------------------------------------------------------


def upsert_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """Match on (kind, locator, device_uid): the label is updated, unknown rows are added.

    ``new``: kind, label, locator, device_uid, created_at.
    """
    key = ["kind", "locator", "device_uid"]
    incoming = new.groupBy(*key).agg(
        F.max("label").alias("_label"), F.max("created_at").alias("_at")
    )
    return (
        sources.join(incoming, key, "full_outer")
        .select(
            F.coalesce("id", source_id(F.col("kind"), F.col("locator"), F.col("device_uid"))).alias(
                "id"
            ),
            "kind",
            F.coalesce("_label", "label").alias("label"),
            "locator",
            "device_uid",
            F.coalesce("created_at", "_at").alias("created_at"),
            F.coalesce("_at", "last_import_at").alias("last_import_at"),
        )
    )


def upsert_contacts(contacts: DataFrame, new: DataFrame) -> DataFrame:
    """A display name is filled in only where there is none.

    ``new``: contact_key, display_name, is_me, seq; the first name seen wins.
    """
    named = F.coalesce(F.col("display_name"), F.lit("")) != ""
    incoming = (
        new.filter(F.col("contact_key").isNotNull())
        .groupBy(F.col("contact_key").alias("handle_hash"))
        .agg(
            F.min_by("display_name", F.when(named, F.col("seq"))).alias("_name"),
            F.max("is_me").alias("_me"),
        )
    )
    had = F.when(F.coalesce(F.col("display_name"), F.lit("")) != "", F.col("display_name"))
    return contacts.join(incoming, "handle_hash", "full_outer").select(
        F.coalesce("id", hash_long(F.col("handle_hash"))).alias("id"),
        "handle_hash",
        F.coalesce(had, F.col("_name")).alias("display_name"),
        F.coalesce("is_me", "_me").alias("is_me"),
    )


def upsert_conversations(conversations: DataFrame, new: DataFrame) -> DataFrame:
    """A new non-empty title replaces the old one; unknown conversations are added.

    ``new``: conversation_id, source_id, conversation_external_id, conversation_title,
    is_group, seq; the first row of a conversation speaks for the batch.
    """
    incoming = (
        new.groupBy(F.col("conversation_id").alias("id"))
        .agg(
            F.min_by(
                F.struct(
                    F.col("source_id").alias("s"),
                    F.col("conversation_external_id").alias("x"),
                    F.col("conversation_title").alias("t"),
                    F.col("is_group").alias("g"),
                ),
                F.col("seq"),
            ).alias("_n")
        )
    )
    title = F.when(F.coalesce(F.col("_n.t"), F.lit("")) != "", F.col("_n.t"))
    return conversations.join(incoming, "id", "full_outer").select(
        "id",
        F.coalesce("source_id", "_n.s").alias("source_id"),
        F.coalesce("external_id", "_n.x").alias("external_id"),
        F.coalesce(title, F.col("title")).alias("title"),
        F.coalesce("is_group", "_n.g").alias("is_group"),
    )


def ingest_messages(
    corpus: Corpus,
    batch: DataFrame,
    source: SourceRef,
    salt: str,
    device_uid: str = "",
    keep_names: bool = True,
    compose: bool = True,
) -> tuple[Corpus, DataFrame]:
    """Load a batch; loading it again changes nothing. Returns the new tables and the report.

    The classified batch feeds five results, so it is checkpointed once.
    """
    classified = materialize(
        classify_batch(batch, corpus.messages, salt, source, device_uid, keep_names, compose)
    )
    accepted = classified.filter("reason is null")
    spark = batch.sparkSession
    ref = spark.range(1).select(
        F.lit(source.kind).alias("kind"),
        F.lit(source.label).alias("label"),
        F.lit(source.locator).alias("locator"),
        F.lit(device_uid).alias("device_uid"),
        F.current_timestamp().alias("created_at"),
    )
    return (
        replace(
            corpus,
            sources=upsert_sources(corpus.sources, ref),
            contacts=upsert_contacts(corpus.contacts, accepted),
            conversations=upsert_conversations(corpus.conversations, accepted),
            messages=corpus.messages.unionByName(new_messages(classified)),
        ),
        import_report(classified),
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources as one batch; columns a source lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def delete_source(corpus: Corpus, source_id: int) -> Corpus:
    """Remove a source with its conversations and messages."""
    gone = corpus.conversations.filter(F.col("source_id") == source_id).select(
        F.col("id").alias("conversation_id")
    )
    return replace(
        corpus,
        sources=corpus.sources.filter(F.col("id") != source_id),
        conversations=corpus.conversations.filter(F.col("source_id") != source_id),
        messages=corpus.messages.join(gone, "conversation_id", "left_anti"),
    )
