"""Text, identity and date functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dates, identity, mail, text
from palimpsest.operators.scoring import score_batches
from palimpsest.plans import sql as q
from palimpsest.plans.adapters import SALT, captures, chat_lines, table
from palimpsest.plans.registry import query


@query(
    "clean_text",
    f"SELECT doc_id, md5(c) AS clean_md5, CAST(length(c) AS INTEGER) AS n_chars "
    f"FROM (SELECT doc_id, {q.clean('text')} AS c FROM documents)",
)
def clean_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("c"))
    return docs.select("doc_id", F.md5("c").alias("clean_md5"), F.length("c").alias("n_chars"))


@query(
    "text_signals",
    f"SELECT doc_id, {q.words('text')} AS words, {q.reason('text')} AS reason, {q.lang('text')} AS lang, "
    f"CAST(length({q.strip_urls('text')}) AS INTEGER) AS chars_without_urls FROM documents",
)
def text_signals(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        text.word_count(t).alias("words"),
        text.low_signal_reason(t).alias("reason"),
        text.guess_lang(t).alias("lang"),
        F.length(text.strip_urls(t)).alias("chars_without_urls"),
    )


@query(
    "line_signals",
    q.with_tables("chat_lines")
    + f"SELECT conv_id, turn, ln, {q.words('line')} AS words, {q.reason('line')} AS reason, "
    f"{q.lang('line')} AS lang FROM chat_lines",
)
def line_signals(spark, sf):
    t = F.col("line")
    return chat_lines(spark, sf).select(
        "conv_id",
        "turn",
        F.col("ln").cast("long").alias("ln"),
        text.word_count(t).alias("words"),
        text.low_signal_reason(t).alias("reason"),
        text.guess_lang(t).alias("lang"),
    )


@query(
    "burst_text",
    "SELECT conv_id, md5(string_agg(t, chr(10) ORDER BY turn)) AS burst_md5, count(*) AS n FROM "
    f"(SELECT conv_id, turn, {q.strip('text')} AS t FROM conversations) WHERE t <> '' GROUP BY conv_id",
)
def burst_text(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(ordered.alias("m"))
    return rows.select(
        "conv_id",
        F.md5(text.collapse_burst(F.col("m.text"))).alias("burst_md5"),
        F.size(F.filter("m", lambda m: text.strip(m["text"]) != "")).cast("long").alias("n"),
    )


@query(
    "search_tokens",
    f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 "
    f"FROM (SELECT doc_id, {q.tokens('text')} AS t FROM documents)",
)
def search_tokens(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.search_tokens(F.col("text")).alias("t"))
    return docs.select(
        "doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5")
    )


_HANDLES = """
  SELECT c_custkey, c_name,
    CASE c_custkey % 4 WHEN 0 THEN ' User' || c_custkey || '@Mail.example '
      WHEN 1 THEN '+90 (532) ' || (1000000 + c_custkey) WHEN 2 THEN '555-' || (1000000 + c_custkey)
      ELSE 'Nick' || c_custkey END AS handle,
    c_nationkey = 7 AS is_me
  FROM customer"""
_NORM = (
    "CASE WHEN contains(h, '@') THEN lower(h) "
    r"WHEN regexp_matches(h, '^\+?[\p{Nd}\s().-]{6,}$') THEN '+' || "
    r"(CASE WHEN length(regexp_replace(h, '[^\p{Nd}]', '', 'g')) = 10 THEN '1' ELSE '' END) || "
    r"regexp_replace(h, '[^\p{Nd}]', '', 'g') ELSE lower(h) END"
)


def _handles(spark, sf):
    key = F.col("c_custkey")
    number = (key + 1_000_000).cast("string")
    handle = (
        F.when(key % 4 == 0, F.concat(F.lit(" User"), key, F.lit("@Mail.example ")))
        .when(key % 4 == 1, F.concat(F.lit("+90 (532) "), number))
        .when(key % 4 == 2, F.concat(F.lit("555-"), number))
        .otherwise(F.concat(F.lit("Nick"), key))
    )
    return table(spark, sf, "customer").select(
        "c_custkey", "c_name", handle.alias("handle"), (F.col("c_nationkey") == 7).alias("is_me")
    )


@query(
    "handle_identity",
    f"WITH a AS ({_HANDLES}), b AS (SELECT *, {q.strip('handle')} AS h FROM a), "
    f"c AS (SELECT *, {_NORM} AS norm FROM b) SELECT c_custkey, norm, "
    "sha256('salt' || chr(0) || (CASE WHEN is_me THEN '__me__' ELSE norm END) || chr(0)) AS contact_key, "
    "CASE WHEN NOT is_me THEN c_name END AS shown, "
    "sha256('salt' || chr(0) || 'name' || chr(0) || lower(c_name) || chr(0)) AS name_key, "
    "norm IN ('user8@mail.example', '+15551000006') OR lower(c_name) = 'customer#000000003' AS mine FROM c",
)
def handle_identity(spark, sf):
    h, name = F.col("handle"), F.col("c_name")
    key, shown = identity.contact_key(SALT, h, name, F.col("is_me"))
    return _handles(spark, sf).select(
        "c_custkey",
        identity.normalize_handle(h).alias("norm"),
        key.alias("contact_key"),
        shown.alias("shown"),
        identity.name_hash(SALT, name).alias("name_key"),
        identity.is_owner(
            h,
            name,
            names=["  Customer#000000003"],
            emails=["USER8@mail.example"],
            phones=["(555) 100-0006"],
        ).alias("mine"),
    )


@query(
    "content_hashes",
    f"SELECT doc_id, {q.iso(q.seconds('doc_id * 60'))} AS iso, "
    f"sha256({q.iso(q.seconds('doc_id * 60'))} || chr(0) || text || chr(0)) AS content_hash FROM documents",
)
def content_hashes(spark, sf):
    ts = F.timestamp_seconds(F.lit(q.BASE_S) + F.col("doc_id") * 60)
    return table(spark, sf, "documents").select(
        "doc_id",
        dates.to_iso(ts).alias("iso"),
        identity.content_hash(dates.to_iso(ts), F.col("text")).alias("content_hash"),
    )


@query(
    "event_times",
    f"SELECT event_id, {q.iso('ts')} AS iso, strftime(ts, '%Y-%m') AS month, CAST(hour(ts) AS INTEGER) AS hour, "
    "epoch_us(ts) // 1000 AS parsed_ms, "
    "CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) AS from_device_us FROM events",
)
def event_times(spark, sf):
    ts = F.col("ts").cast("timestamp")
    seconds = F.unix_seconds(ts) - dates.DEVICE_EPOCH_S
    raw = F.when(F.col("event_id") % 2 == 0, seconds * 1_000_000_000).otherwise(seconds)
    iso = dates.to_iso(ts)
    return table(spark, sf, "events").select(
        "event_id",
        iso.alias("iso"),
        dates.month_key(ts).alias("month"),
        F.hour(ts).alias("hour"),
        F.unix_millis(dates.parse_iso(iso)).alias("parsed_ms"),
        F.unix_micros(dates.device_time(raw)).alias("from_device_us"),
    )


@query(
    "holdout_split",
    f"SELECT DISTINCT conv_id, {q.holdout('conv_id')} AS is_holdout, {q.holdout('conv_id', 0.3, 11)} AS wide FROM conversations",
)
def holdout_split(spark, sf):
    ids = table(spark, sf, "conversations").select("conv_id").distinct()
    return ids.select(
        "conv_id",
        identity.in_holdout(F.col("conv_id")).alias("is_holdout"),
        identity.in_holdout(F.col("conv_id"), 0.3, 11).alias("wide"),
    )


@query(
    "meta_origin",
    q.with_tables("chat_msg")
    + "SELECT id, json_extract_string(meta, '$.origin') AS origin FROM chat_msg",
)
def meta_origin(spark, sf):
    from palimpsest.operators.examples import message_origin
    from palimpsest.plans.adapters import chat_messages

    return chat_messages(spark, sf).select("id", message_origin(F.col("meta")).alias("origin"))


@query("html_to_text")
def html_to_text(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", text.clean_text(mail.html_to_text("html")).alias("t"))
    return pages.select("page_id", text.word_count(F.col("t")).alias("words"), F.md5("t").alias("text_md5"))


@query(
    "jaccard_pairs",
    "WITH a AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex("
    + q.casefold("text")
    + ", '[^\\p{L}\\p{N}_]+'), lambda w: w <> '')) AS t FROM conversations), "
    "b AS (SELECT conv_id, turn, t, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM a) "
    "SELECT conv_id, turn, round(CASE WHEN len(t) = 0 OR len(p) = 0 THEN 0.0 ELSE len(list_intersect(t, p)) / "
    "len(list_distinct(list_concat(t, p))) END, 9) AS similarity FROM b WHERE p IS NOT NULL",
)
def jaccard_pairs(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", text.comparison_tokens(F.col("text")).alias("t")
    )
    return (
        rows.withColumn("p", F.lag("t").over(w))
        .filter("p is not null")
        .select("conv_id", "turn", F.round(text.jaccard(F.col("t"), F.col("p")), 9).alias("similarity"))
    )


@query(
    "mailbox_classes",
    q.with_tables("cap")
    + """, p AS (SELECT uid, CASE user_id % 5 WHEN 0 THEN '/m/V10/acc/Sent Messages.mbox/x/1.emlx'
        WHEN 1 THEN '/m/V10/acc/INBOX.mbox/2.emlx' WHEN 2 THEN '/m/[Gmail].mbox/All Mail.mbox/3.emlx'
        WHEN 3 THEN '/m/Junk.mbox/4.emlx' ELSE '/m/Sentinel.mbox/Archive.mbox/5.emlx' END AS path FROM cap)
      SELECT uid, CASE WHEN path LIKE '%Sent%' THEN 'sent' WHEN path LIKE '%Junk%' THEN NULL ELSE 'context' END AS box,
        path LIKE '%Sent Messages%' OR path LIKE '%Sentinel%' AS sent_like FROM p""",
)
def mailbox_classes(spark, sf):
    paths = [
        "/m/V10/acc/Sent Messages.mbox/x/1.emlx",
        "/m/V10/acc/INBOX.mbox/2.emlx",
        "/m/[Gmail].mbox/All Mail.mbox/3.emlx",
        "/m/Junk.mbox/4.emlx",
        "/m/Sentinel.mbox/Archive.mbox/5.emlx",
    ]
    path = F.get(F.array(*[F.lit(p) for p in paths]), (F.col("user_id") % 5).cast("int"))
    folder = F.regexp_extract(path, r"/(S[^/]*)\.mbox", 1)
    return captures(spark, sf).select(
        "uid",
        mail.mailbox_class(path).alias("box"),
        mail.is_sent_folder(folder, F.array().cast("array<string>")).alias("sent_like"),
    )


class _Letters:
    """A stand-in for a model: counts a letter and names the text by its digest."""

    def __call__(self, rows):
        import hashlib

        import pandas as pd

        texts = rows["text"].fillna("")
        return pd.DataFrame(
            {"n_e": texts.str.count("e"), "digest": [hashlib.md5(t.encode()).hexdigest() for t in texts]}
        )


@query(
    "scored_documents",
    "SELECT doc_id, length(text) - length(replace(text, 'e', '')) AS n_e, md5(text) AS digest, true AS ok FROM documents",
)
def scored_documents(spark, sf):
    """Documents through the batch scorer, in batches of bounded bytes."""
    rows = table(spark, sf, "documents").select("doc_id", "text")
    made = score_batches(rows, "letters", _Letters, ["text"], "n_e bigint, digest string", batch_bytes=1 << 16)
    return made.select("doc_id", "n_e", "digest", F.col("error").isNull().alias("ok"))
