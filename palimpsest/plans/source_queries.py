"""Source parsers over inputs that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import mail as mail_rules
from palimpsest.functions.dates import to_iso
from palimpsest.plans import sql as q
from palimpsest.plans.adapters import BASE_S, chat_lines, table
from palimpsest.plans.registry import query
from palimpsest.plans.stream_queries import work_dir
from palimpsest.schema import MESSAGE_BATCH
from palimpsest.sources import batches, chat_export, commit_log, data_package, documents, mail, stores
from palimpsest.streaming.captures import CaptureTables, guarded, run_available
from palimpsest.streaming.pushes import push_ledger

# --- chat exports -----------------------------------------------------------------------

_DAY = "(conv_id % 27) + 1"


def export_lines(spark, sf):
    """Every chat as an export file: a notice, then one message per turn, further lines as
    continuations. Dates are day-first, dotted or slashed by file."""
    conv, turn = F.col("conv_id"), F.col("turn")
    who = F.when(F.col("role") == "assistant", "Sam Doe").otherwise(
        F.concat(F.lit("Friend "), conv % 7)
    )
    day = F.lpad((conv % 27 + 1).cast("string"), 2, "0")
    clock = F.concat(
        F.lpad((turn + 8).cast("string"), 2, "0"), F.lit(":"), F.lpad((conv % 60).cast("string"), 2, "0")
    )
    head = F.when(
        conv % 2 == 0, F.concat(F.lit("["), day, F.lit(".01.2024, "), clock, F.lit(":30] "), who, F.lit(": "))
    ).otherwise(F.concat(day, F.lit("/01/2024, "), clock, F.lit(" - "), who, F.lit(": ")))
    first = Window.partitionBy("conv_id", "turn").orderBy("ln")
    path = F.concat(F.lit("/x/WhatsApp Chat with "), conv, F.lit(".txt"))
    lines = chat_lines(spark, sf).withColumn("n", F.row_number().over(first)).select(
        path.alias("path"),
        (turn % 3).cast("long").alias("third"),
        turn.alias("block"),
        F.col("ln").cast("long").alias("pos"),
        F.when(F.col("n") == 1, F.concat(head, "line")).otherwise(F.col("line")).alias("line"),
    )
    notice = table(spark, sf, "conversations").select("conv_id").distinct().select(
        path.alias("path"),
        F.lit(0).cast("long").alias("third"),
        F.lit(-1).cast("long").alias("block"),
        F.lit(0).cast("long").alias("pos"),
        F.when(conv % 2 == 0, F.lit("[28.01.2024, 07:00:00] Sam Doe: ‎Messages and calls are end-to-end encrypted."))
        .otherwise(F.lit("28/01/2024, 07:00 - Messages and calls are end-to-end encrypted."))
        .alias("line"),
    )
    return lines.unionByName(notice).drop("third")


@query(
    "chat_export",
    q.with_tables("chat_lines")
    + """, t AS (SELECT conv_id, turn, any_value(role) AS role, string_agg(line, chr(10) ORDER BY ln) AS text FROM chat_lines GROUP BY ALL),
      o AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS mine, count(*) FILTER (role <> 'assistant') AS others FROM t GROUP BY 1)
      SELECT 'WhatsApp Chat with ' || conv_id AS conversation, md5(text) AS text_md5, role = 'assistant' AS is_me,
        strftime(make_timestamp(2024, 1, (conv_id % 27) + 1, turn + 8, conv_id % 60, CASE WHEN conv_id % 2 = 0 THEN 30.0 ELSE 0.0 END), '%Y-%m-%dT%H:%M:%S') AS ts,
        CASE WHEN others > 0 THEN 'Friend ' || conv_id % 7 ELSE CAST(conv_id AS VARCHAR) END AS title, false AS is_group,
        CASE WHEN role <> 'assistant' THEN 'Friend ' || conv_id % 7 END AS sender_name
      FROM t JOIN o USING (conv_id) WHERE mine > 0""",
)
def chat_exports(spark, sf):
    rows = chat_export.parse_export(export_lines(spark, sf), names=["sam doe"])
    return rows.select(
        F.col("conversation_external_id").alias("conversation"),
        F.md5("text").alias("text_md5"),
        "is_me",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"),
        F.col("conversation_title").alias("title"),
        "is_group",
        "sender_name",
    )


@query(
    "export_date_order",
    "SELECT DISTINCT '/x/WhatsApp Chat with ' || conv_id || '.txt' AS path, 'dmy' AS \"order\" FROM conversations",
)
def export_date_order(spark, sf):
    from palimpsest.functions.exports import header

    heads = export_lines(spark, sf).select("path", header(F.col("line")).alias("h")).filter("h is not null")
    return chat_export.detect_date_order(heads)


# --- data package -----------------------------------------------------------------------


@query(
    "data_package",
    f"""WITH m AS (SELECT o_custkey % 100 AS c, o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders),
      s AS (SELECT c, bool_or(o_orderstatus = 'P') AS has_json FROM m GROUP BY c)
      SELECT CAST(c AS VARCHAR) AS conversation, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS text, {q.iso("o_orderdate")} AS ts,
        CASE WHEN c % 3 = 0 THEN 'Direct Message with u' || c WHEN c % 3 = 1 THEN 'a' || c || ', b' ELSE 'channel ' || c END AS title,
        CASE WHEN c % 3 = 1 THEN true WHEN c % 3 = 0 THEN false ELSE true END AS is_group
      FROM m JOIN s USING (c) WHERE (o_orderstatus = 'P') = has_json""",
)
def package(spark, sf):
    channel = F.col("o_custkey") % 100
    rows = table(spark, sf, "orders").select(
        channel.cast("string").alias("channel"),
        F.col("o_orderkey").cast("string").alias("ID"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("+00:00")).alias("Timestamp"),
        F.concat(F.lit(" "), "o_orderpriority").alias("Contents"),
        "o_orderstatus",
    )
    channels = rows.select("channel").distinct()
    n = F.col("channel").cast("int")
    index = channels.select(
        "channel", F.when(n % 3 == 0, F.concat(F.lit("Direct Message with u"), "channel")).alias("name")
    )
    meta = channels.filter(n % 3 == 1).select(
        "channel",
        F.lit(3).alias("type"),
        F.lit(None).cast("string").alias("name"),
        F.array(F.concat(F.lit("a"), "channel"), F.lit("b")).alias("recipients"),
    )
    is_json = F.col("o_orderstatus") == "P"
    out = data_package.package_messages(
        rows.filter(is_json).drop("o_orderstatus"), rows.filter(~is_json).drop("o_orderstatus"), index, meta
    )
    return out.select(
        F.col("conversation_external_id").alias("conversation"),
        "external_id",
        "text",
        to_iso(F.col("ts")).alias("ts"),
        F.col("conversation_title").alias("title"),
        "is_group",
    )


# --- documents, commits -----------------------------------------------------------------


@query("document_chunks")
def document_chunks(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/d"), "doc_id", F.lit(".md")).alias("rel"),
        F.concat(F.lit("---\nid: "), "doc_id", F.lit("\n---\n"), "text").alias("text"),
        F.timestamp_seconds(F.lit(BASE_S) + F.col("doc_id")).alias("ts"),
    )
    rows = documents.document_messages(docs, "/notes", 200)
    return rows.select("external_id", "conversation_external_id", F.md5("text").alias("text_md5"))


@query(
    "short_document_messages",
    f"""SELECT source || '/d' || doc_id || '.md#0' AS external_id, '/notes/' || source AS conversation, source AS title,
      md5({q.strip("regexp_replace(text, '\\n{3,}', chr(10)||chr(10), 'g')")}) AS text_md5
      FROM documents WHERE NOT contains(text, '```') AND NOT contains(text, '~~~') AND NOT contains(text, chr(13)) AND {q.strip("text")} <> ''""",
)
def short_document_messages(spark, sf):
    plain = ~F.col("text").contains("```") & ~F.col("text").contains("~~~") & ~F.col("text").contains("\r")
    docs = table(spark, sf, "documents").filter(plain).select(
        F.concat("source", F.lit("/d"), "doc_id", F.lit(".md")).alias("rel"),
        "text",
        F.timestamp_seconds(F.lit(BASE_S) + F.col("doc_id")).alias("ts"),
    )
    rows = documents.document_messages(docs, "/notes", 1 << 30)
    return rows.select(
        "external_id",
        F.col("conversation_external_id").alias("conversation"),
        F.col("conversation_title").alias("title"),
        F.md5("text").alias("text_md5"),
    )


@query(
    "commit_log",
    f"""WITH c AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'wip' WHEN 'click' THEN 'Merge branch x'
        WHEN 'error' THEN 'fix error ' || event_id ELSE event_type || ' of ' || event_id END AS head, event_type FROM events)
      SELECT '/repos/r' || user_id AS conversation, 'h' || event_id AS external_id, head || chr(10) || chr(10) || 'body' AS text,
        {q.iso("date_trunc('second', ts)")} AS ts, 'r' || user_id AS title
      FROM c WHERE event_type NOT IN ('view', 'click', 'signup')""",
)
def commits(spark, sf):
    kind = F.col("event_type")
    head = (
        F.when(kind == "view", "wip")
        .when(kind == "click", "Merge branch x")
        .when(kind == "error", F.concat(F.lit("fix error "), "event_id"))
        .otherwise(F.concat(kind, F.lit(" of "), "event_id"))
    )
    trailer = F.when(kind == "signup", "Co-authored-by: dependabot[bot] <b@x>").otherwise("Signed-off-by: Sam <s@x>")
    records = table(spark, sf, "events").select(
        F.concat(F.lit("/repos/r"), "user_id").alias("repo"),
        F.concat(
            F.lit("\nh"), "event_id", F.lit("\x1f"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00\x1f"),
            head, F.lit("\n\nbody\n"), trailer, F.lit("\n"),
        ).alias("value"),
    )
    return commit_log.parse_commits(records).select(
        F.col("conversation_external_id").alias("conversation"),
        "external_id",
        "text",
        to_iso(F.col("ts")).alias("ts"),
        F.col("conversation_title").alias("title"),
    )


# --- mail -------------------------------------------------------------------------------


def raw_mail(spark, sf):
    """Every chat turn as a mail; pages as newsletters; a third of the threads have none of mine."""
    conv = F.col("conv_id")
    mine = (F.col("role") == "assistant") & (conv % 3 != 0)
    sender = F.when(mine, "Sam <Sam@Mail.example>").otherwise(
        F.concat(F.lit("Friend "), conv % 7, F.lit(" <f"), conv % 7, F.lit("@mail.example>"))
    )
    header = F.concat(
        F.lit("From: "), sender, F.lit("\nSubject: "),
        F.when(F.col("turn") > 0, "Re: ").otherwise(""), F.lit("Topic "), conv,
        F.lit("\nMessage-ID: <"), conv, F.lit("."), "turn", F.lit("@x>\nDate: Tue, 02 Jan 2024 "),
        F.lpad((F.col("turn") + 8).cast("string"), 2, "0"), F.lit(":00:00 +0300\n"),
        F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n"),
    )
    chats = table(spark, sf, "conversations").filter("role <> 'system'").select(
        F.lit("chats.mbox").alias("path"),
        (conv * 100 + F.col("turn")).alias("seq"),
        F.encode(
            F.concat(header, "text", F.lit("\n\nOn Mon, Friend\nwrote:\n> quoted\n> more")), "UTF-8"
        ).alias("data"),
    )
    news = table(spark, sf, "pages").select(
        F.lit("news.mbox").alias("path"),
        (F.col("page_id") + 10**9).alias("seq"),
        F.encode(
            F.concat(
                F.lit("From: News <newsletter@mail.example>\nSubject: Topic "), "page_id",
                F.lit("\nList-Id: <x>\nDate: Tue, 02 Jan 2024 09:00:00 +0000\nContent-Type: text/html; charset=utf-8\n\n"),
                "html",
            ),
            "UTF-8",
        ).alias("data"),
    )
    return chats.unionByName(news).select(
        "path", "seq", "data", F.lit(None).cast("string").alias("envelope"), F.lit(False).alias("in_sent")
    )


def owned_mail(spark, sf):
    return mail.mark_owner(mail.parse_headers(raw_mail(spark, sf)), [], ["sam@mail.example"])


_MAIL = f"""m AS (SELECT conv_id, turn, {q.clean("text")} AS text, role = 'assistant' AND conv_id % 3 <> 0 AS is_me FROM conversations WHERE role <> 'system'),
  w AS (SELECT DISTINCT conv_id FROM m WHERE is_me)"""


@query(
    "mail_messages",
    f"""WITH {_MAIL} SELECT 'subj:topic ' || conv_id AS conversation, '<' || conv_id || '.' || turn || '@x>' AS external_id, md5(text) AS text_md5, is_me,
      '2024-01-02T' || lpad(CAST(turn + 5 AS VARCHAR), 2, '0') || ':00:00.000Z' AS ts,
      CASE WHEN NOT is_me THEN 'f' || conv_id % 7 || '@mail.example' END AS sender_handle,
      (CASE WHEN turn > 0 THEN 'Re: ' ELSE '' END) || 'Topic ' || conv_id AS title
      FROM m JOIN w USING (conv_id) WHERE text <> '' AND {q.words("text")} <= 3000""",
)
def mail_messages(spark, sf):
    rows = mail.to_messages(mail.relevant_mail(owned_mail(spark, sf)))
    return rows.select(
        F.col("conversation_external_id").alias("conversation"),
        "external_id",
        F.md5("text").alias("text_md5"),
        "is_me",
        to_iso(F.col("ts")).alias("ts"),
        "sender_handle",
        F.col("conversation_title").alias("title"),
    )


@query(
    "mail_owner_flags",
    """SELECT seq, is_me, automated FROM (SELECT conv_id * 100 + turn AS seq, role = 'assistant' AND conv_id % 3 <> 0 AS is_me, false AS automated
      FROM conversations WHERE role <> 'system' UNION ALL SELECT page_id + 1000000000, false, true FROM pages)""",
)
def mail_owner_flags(spark, sf):
    return owned_mail(spark, sf).select("seq", "is_me", "automated")


@query(
    "mail_threads",
    "SELECT DISTINCT 'subj:topic ' || conv_id AS thread FROM conversations WHERE role = 'assistant' AND conv_id % 3 <> 0",
)
def mail_threads(spark, sf):
    return mail.me_threads(owned_mail(spark, sf))


@query(
    "mail_top_senders",
    """SELECT from_addr, count(*) AS n FROM (SELECT 'f' || conv_id % 7 || '@mail.example' AS from_addr FROM conversations
        WHERE role <> 'system' AND NOT (role = 'assistant' AND conv_id % 3 <> 0)
      UNION ALL SELECT 'newsletter@mail.example' FROM pages) GROUP BY 1 ORDER BY n DESC, from_addr LIMIT 5""",
)
def mail_top_senders(spark, sf):
    return mail.top_senders(owned_mail(spark, sf))


@query(
    "mail_skip_reasons",
    f"""WITH b AS (SELECT doc_id, {q.words("c")} AS w, c FROM (SELECT doc_id, {q.clean("text")} AS c FROM documents))
      SELECT r AS reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 50 = 0 THEN 'no_date' WHEN c = '' THEN 'empty' WHEN w > 3000 THEN 'too_long' END AS r FROM b)
      WHERE r IS NOT NULL GROUP BY 1""",
)
def mail_skip_reasons(spark, sf):
    from palimpsest.functions.text import clean_text

    ts = F.when(F.col("doc_id") % 50 != 0, F.timestamp_seconds(F.col("doc_id")))
    rows = table(spark, sf, "documents").select(ts.alias("ts"), clean_text(F.col("text")).alias("text"))
    return mail.skip_counts(
        rows.withColumn("reason", mail_rules.mail_skip_reason(F.col("ts"), F.col("text")))
    )


@query(
    "mail_since",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'",
)
def mail_since(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return mail.since_filter(rows, "2024-01-15 00:00:00").select("event_id")


@query(
    "mail_labels",
    """SELECT event_id, event_type = 'click' AS sent FROM events""",
)
def mail_label_overlap(spark, sf):
    raw = F.concat(F.lit("Inbox, "), F.when(F.col("event_type") == "click", " SENT ").otherwise("event_type"), F.lit(",,"))
    return table(spark, sf, "events").select(
        "event_id", mail_rules.has_sent_label(mail_rules.mail_labels(raw)).alias("sent")
    )


@query(
    "email_bodies",
    f"""SELECT doc_id, md5({q.clean("string_agg(line, chr(10) ORDER BY i)")}) AS body_md5 FROM
      (SELECT doc_id, unnest(string_split('Hello' || chr(10) || text, chr(10))) AS line, generate_subscripts(string_split('Hello' || chr(10) || text, chr(10)), 1) AS i
       FROM documents WHERE NOT contains(text, chr(13))) WHERE NOT regexp_matches(line, '^[{q.WS}]*>') GROUP BY doc_id""",
)
def email_bodies(spark, sf):
    rows = table(spark, sf, "documents").filter(~F.col("text").contains("\r")).select(
        "doc_id",
        mail_rules.clean_email_body(
            F.concat(F.lit("Hello\n"), "text", F.lit("\n\n\nOn Tue, A\nB wrote:\n> x\n-- \nsig"))
        ).alias("b"),
    )
    return rows.select("doc_id", F.md5("b").alias("body_md5"))


# --- stores -----------------------------------------------------------------------------


def _archive(text):
    """A rich-text archive holding ``text`` (4-byte length)."""
    body = F.encode(text, "UTF-8")
    n = F.octet_length(body)
    size = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n, s).bitwiseAND(255)), 2, "0")) for s in (0, 8, 16, 24)])
    return F.concat(F.lit(b"\x04\x0bNSString\x01\x94\x84\x01\x2b\x82"), size, body)


@query(
    "phone_store",
    f"""WITH c AS (SELECT o_custkey AS k, o_custkey % 2 = 0 AS grp FROM orders GROUP BY ALL)
      SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'handle:+1555' || o_custkey ELSE 'chat' || (o_custkey // 2) END AS conversation, 'g' || o_orderkey AS external_id,
        o_orderpriority AS text, {q.iso("o_orderdate")} AS ts, o_orderstatus = 'F' AS is_me,
        CASE WHEN o_orderkey % 10 = 0 THEN '+1555' || o_custkey ELSE 'Group ' || (o_custkey // 2) END AS title,
        o_orderkey % 10 <> 0 AS is_group, CASE WHEN o_orderstatus <> 'F' THEN '+1555' || o_custkey END AS sender_handle
      FROM orders WHERE o_orderpriority <> '5-LOW'""",
)
def phone_store(spark, sf):
    orders = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    low = F.col("o_orderpriority") == "5-LOW"
    message = orders.select(
        key.alias("ROWID"),
        F.concat(F.lit("g"), key).alias("guid"),
        F.when(key % 2 == 0, F.col("o_orderpriority")).alias("text"),
        F.when(key % 2 == 1, _archive(F.col("o_orderpriority"))).alias("attributedBody"),
        cust.alias("handle_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_from_me"),
        ((F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - 978_307_200) * 1_000_000_000).alias("date"),
        F.when(low & (key % 3 == 0), 1).otherwise(0).alias("item_type"),
        F.when(low & (key % 3 == 1), 2000).otherwise(0).alias("associated_message_type"),
        F.when(low & (key % 3 == 2), "com.example.Game").alias("balloon_bundle_id"),
    )
    people = orders.select(cust.alias("ROWID")).distinct()
    handle = people.select("ROWID", F.concat(F.lit("+1555"), "ROWID").alias("id"))
    chat = people.select(F.floor(F.col("ROWID") / 2).alias("ROWID")).distinct().select(
        "ROWID",
        F.concat(F.lit("chat"), "ROWID").alias("guid"),
        F.lit("c").alias("chat_identifier"),
        F.concat(F.lit("Group "), "ROWID").alias("display_name"),
        F.lit(43).alias("style"),
    )
    joins = orders.filter(key % 10 != 0).select(
        key.alias("message_id"),
        F.explode(F.array(F.floor(cust / 2), F.floor(cust / 2) + 1_000_000)).alias("chat_id"),
    )
    members = people.select(F.floor(F.col("ROWID") / 2).alias("chat_id"), F.col("ROWID").alias("handle_id"))
    rows = stores.phone_messages(message, handle, chat, joins, members)
    return rows.select(
        F.col("conversation_external_id").alias("conversation"),
        "external_id",
        "text",
        to_iso(F.col("ts")).alias("ts"),
        "is_me",
        F.col("conversation_title").alias("title"),
        "is_group",
        "sender_handle",
    )


@query(
    "messenger_store",
    f"""SELECT CASE c_custkey % 3 WHEN 1 THEN c_custkey || '-1@g.us' ELSE '90' || c_custkey || '@s.whatsapp.net' END AS conversation,
        CASE WHEN o_orderkey % 2 = 0 THEN 's' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS external_id,
        o_orderpriority AS text, {q.iso("o_orderdate")} AS ts, o_orderstatus = 'F' AS is_me, c_name AS title, c_custkey % 3 = 1 AS is_group,
        CASE WHEN o_orderstatus <> 'F' THEN CASE WHEN c_custkey % 3 = 1 THEN '+44' || n_nationkey ELSE '+90' || c_custkey END END AS sender_handle,
        CASE WHEN o_orderstatus <> 'F' THEN CASE WHEN c_custkey % 3 = 1 THEN n_name ELSE c_name END END AS sender_name
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
      WHERE o_orderpriority <> '5-LOW' AND c_mktsegment <> 'BUILDING'""",
)
def messenger_store(spark, sf):
    key = F.col("o_orderkey")
    nations = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    message = table(spark, sf, "orders").join(nations, "o_custkey").select(
        key.alias("Z_PK"),
        F.col("o_orderpriority").alias("ZTEXT"),
        (F.col("o_orderstatus") == "F").cast("int").alias("ZISFROMME"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - 978_307_200).alias("ZMESSAGEDATE"),
        F.col("o_custkey").alias("ZCHATSESSION"),
        F.lit("1@s.whatsapp.net").alias("ZFROMJID"),
        F.when(F.col("o_orderpriority") == "5-LOW", 6).otherwise(0).alias("ZMESSAGETYPE"),
        F.col("c_nationkey").cast("long").alias("ZGROUPMEMBER"),
        F.when(key % 2 == 0, F.concat(F.lit("s"), key)).alias("ZSTANZAID"),
    )
    cust = F.col("c_custkey")
    session = table(spark, sf, "customer").select(
        cust.alias("Z_PK"),
        F.when(cust % 3 == 1, F.concat(cust, F.lit("-1@g.us")))
        .otherwise(F.concat(F.lit("90"), cust, F.lit("@s.whatsapp.net")))
        .alias("ZCONTACTJID"),
        F.col("c_name").alias("ZPARTNERNAME"),
        F.when(F.col("c_mktsegment") == "BUILDING", 3).when(cust % 3 == 1, 1).otherwise(0).alias("ZSESSIONTYPE"),
    )
    member = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("Z_PK"),
        F.concat(F.lit("44"), "n_nationkey", F.lit("@s.whatsapp.net")).alias("ZMEMBERJID"),
        F.col("n_name").alias("ZCONTACTNAME"),
    )
    rows = stores.messenger_messages(message, session, member)
    return rows.select(
        F.col("conversation_external_id").alias("conversation"),
        "external_id",
        "text",
        to_iso(F.col("ts")).alias("ts"),
        "is_me",
        F.col("conversation_title").alias("title"),
        "is_group",
        "sender_handle",
        "sender_name",
    )


@query(
    "pushed_batches",
    "SELECT 'push' AS source_kind, CAST(conv_id AS VARCHAR) AS conversation, md5(text) AS text_md5, role = 'assistant' AS is_me, "
    "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations",
)
def pushed_batches(spark, sf):
    """One JSON batch per chat, each sent twice, through a stream with a ledger of pushes."""
    home = work_dir(spark, "pushes")
    item = F.struct(
        F.col("conv_id").cast("string").alias("conversation_external_id"),
        "text",
        F.timestamp_seconds("turn").alias("ts"),
        (F.col("role") == "assistant").alias("is_me"),
    )
    listed = F.array_sort(F.collect_list(F.struct("turn", item.alias("m"))))
    raw = table(spark, sf, "conversations").groupBy("conv_id").agg(listed.alias("l")).select(
        F.to_json(
            F.struct(
                F.struct(F.lit("push").alias("kind"), F.lit("Push").alias("label")).alias("source"),
                F.col("l.m").alias("messages"),
            )
        ).alias("value")
    )
    raw.unionByName(raw).repartition(6).write.text(f"{home}/in")
    tables = CaptureTables(f"{home}/tables")
    writer = guarded(
        push_ledger(f"{home}/ledger", 16),
        lambda pushes, number: tables.write(batches.batch_messages(pushes), "messages", number),
    )
    run_available(batches.stream_batches(spark, f"{home}/in", 2), writer, f"{home}/ckpt")
    rows = spark.read.parquet(f"{home}/tables/messages")
    return rows.select(
        "source_kind",
        F.col("conversation_external_id").alias("conversation"),
        F.md5("text").alias("text_md5"),
        "is_me",
        "seq",
    )
