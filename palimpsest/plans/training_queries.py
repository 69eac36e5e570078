"""Turns, examples, splits and snapshot statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.prompts import (
    LANG_NAMES,
    OPENERS,
    TRAIN_HINTS,
    render_context,
)
from palimpsest.functions.text import word_count
from palimpsest.operators import evaluation, examples, snapshot
from palimpsest.operators.turns import build_turns, fit_context, with_context
from palimpsest.plans import sql as q
from palimpsest.plans.adapters import (
    chat_messages,
    messages,
    table,
    turn_conversations,
)
from palimpsest.plans.registry import query
from palimpsest.session import materialize

CONFIG = examples.ExampleConfig(name="Sam", holdout_fraction=0.2)

# Turns of the chats, written with window functions over (conversation, time, id).
_TURNS = {
    "rows_": "SELECT * FROM chat_msg WHERE register IN ('text', 'email', 'speech', 'doc') "
    "AND coalesce(json_extract_string(meta, '$.origin'), '') <> 'chat'",
    "tagged": """SELECT m.*, c.is_group, c.title, c.source_id,
        CASE WHEN is_me THEN 'assistant' ELSE 'user' END AS role,
        first_value(register) OVER t AS r0, first_value(lang) OVER t AS l0,
        lag(is_me) OVER w AS p_me, lag(ts) OVER w AS p_ts
      FROM rows_ m JOIN chat_conv c ON c.id = m.conversation_id
      WINDOW w AS (PARTITION BY conversation_id ORDER BY ts, m.id),
        t AS (PARTITION BY conversation_id, ts ORDER BY m.id)""",
    "numbered": """SELECT *, sum(CASE WHEN p_me IS NULL OR p_me <> is_me OR ts - p_ts > INTERVAL 20 MINUTE
        THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ts, id) AS turn_no FROM tagged""",
    "turn": """SELECT conversation_id, CAST(turn_no AS BIGINT) AS turn_no, any_value(role) AS role, max(ts) AS ts,
        string_agg(CASE WHEN NOT is_me AND is_group THEN sender_name || ': ' ELSE '' END || text, chr(10) ORDER BY ts, id) AS text,
        arg_max(r0, (ts, id)) AS register, last(l0 ORDER BY ts, id) AS lang, count(*) AS n_messages,
        any_value(is_group) AS is_group, any_value(title) AS title, any_value(source_id) AS source_id
      FROM numbered GROUP BY conversation_id, turn_no""",
    # Names in first-seen order.
    "named": """SELECT conversation_id, turn_no, string_agg(sender_name, ',' ORDER BY seen) AS names FROM
        (SELECT conversation_id, turn_no, sender_name, min((ts, id)) AS seen FROM numbered WHERE NOT is_me GROUP BY ALL)
      GROUP BY ALL""",
}
_TURN_SQL = q.with_tables("chat_msg", "chat_conv", **_TURNS)


def turns(spark, sf):
    rows = examples.training_rows(chat_messages(spark, sf))
    return build_turns(rows, turn_conversations(spark, sf))


@query(
    "turns",
    _TURN_SQL
    + f"""SELECT t.conversation_id, t.turn_no, role, {q.iso("ts")} AS ts, md5(text) AS text_md5, register, lang, n_messages,
      coalesce(n.names, '') AS names FROM turn t LEFT JOIN named n USING (conversation_id, turn_no)""",
)
def turn_rows(spark, sf):
    from palimpsest.functions.dates import to_iso

    return turns(spark, sf).select(
        "conversation_id",
        "turn_no",
        "role",
        to_iso(F.col("ts")).alias("ts"),
        F.md5("text").alias("text_md5"),
        "register",
        "lang",
        "n_messages",
        F.array_join("names", ",").alias("names"),
    )


@query(
    "turn_summary",
    _TURN_SQL
    + f"""SELECT conversation_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS my_turns,
      CAST(sum({q.words("text")}) AS BIGINT) AS words, max(n_messages) AS longest_burst FROM turn GROUP BY conversation_id""",
)
def turn_summary(spark, sf):
    return turns(spark, sf).groupBy("conversation_id").agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("role") == "assistant").alias("my_turns"),
        F.sum(word_count(F.col("text"))).alias("words"),
        F.max("n_messages").alias("longest_burst"),
    )


@query(
    "document_turns",
    q.with_tables("doc_msg")
    + """, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 20 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n
        FROM doc_msg WHERE """
    + q.strip("text")
    + """ <> '' WINDOW w AS (PARTITION BY conversation_id ORDER BY ts, id)),
      g AS (SELECT *, sum(n) OVER (PARTITION BY conversation_id ORDER BY ts, id) AS t FROM f)
      SELECT conversation_id, CAST(t AS BIGINT) AS turn_no, count(*) AS n_messages,
        md5(string_agg("""
    + q.strip("text")
    + """, chr(10) ORDER BY ts, id)) AS text_md5 FROM g GROUP BY ALL""",
)
def document_turns(spark, sf):
    """Few, large conversations of one side only; split into time slices."""
    from palimpsest.plans.adapters import doc_messages

    split = build_turns(doc_messages(spark, sf), rows_per_task=20, force_split_check=True)
    return split.select("conversation_id", "turn_no", "n_messages", F.md5("text").alias("text_md5"))


_CONTEXT = {
    "framed": """SELECT a.conversation_id, a.turn_no, b.turn_no AS c_no, b.role AS c_role, b.text AS c_text,
        length(a.text) AS target_len, a.ts - b.ts <= INTERVAL 3 DAY AS fresh
      FROM turn a JOIN turn b ON a.conversation_id = b.conversation_id AND b.turn_no BETWEEN a.turn_no - 8 AND a.turn_no - 1
      WHERE a.role = 'assistant'""",
    "fitted": """SELECT *, sum(length(c_text) + 16) OVER (PARTITION BY conversation_id, turn_no ORDER BY c_no DESC) AS used,
        row_number() OVER (PARTITION BY conversation_id, turn_no ORDER BY c_no DESC) AS age FROM framed WHERE fresh""",
}


@query(
    "turn_context",
    q.with_tables("chat_msg", "chat_conv", **_TURNS, **_CONTEXT)
    + """SELECT t.conversation_id, t.turn_no, count(f.c_no) AS fresh,
      count(f.c_no) FILTER (f.age = 1 OR f.used <= 600 - f.target_len) AS fitting,
      coalesce(md5(string_agg(f.c_text, '|' ORDER BY f.c_no) FILTER (f.age = 1 OR f.used <= 600 - f.target_len)), md5('')) AS context_md5
      FROM turn t LEFT JOIN fitted f USING (conversation_id, turn_no) WHERE t.role = 'assistant' GROUP BY ALL""",
)
def turn_context(spark, sf):
    rows = with_context(turns(spark, sf)).filter("role = 'assistant'")
    fitted = rows.withColumn(
        "fit", fit_context(F.col("context"), F.lit(600) - F.length("text"))
    )
    return fitted.select(
        "conversation_id",
        "turn_no",
        F.size("context").cast("long").alias("fresh"),
        F.size("fit").cast("long").alias("fitting"),
        F.md5(F.array_join("fit.text", "|")).alias("context_md5"),
    )


# Examples: opener or alternating context, prompt texts, then first-in-order dedup.
def _map(column: str, table: dict[str, str], default: str = "NULL") -> str:
    cases = " ".join(f"WHEN {q.lit(k)} THEN {q.lit(v)}" for k, v in table.items())
    return f"CASE {column} {cases} ELSE {default} END"


_EXAMPLES = {
    **_TURNS,
    **_CONTEXT,
    "target": f"""SELECT t.*, {q.words("text")} AS wc,
        CASE WHEN {q.words("text")} < 2 THEN 'target_too_short' WHEN {q.words("text")} > 400 THEN 'target_too_long'
             WHEN {q.reason("text")} IS NOT NULL THEN 'low_signal' END AS skip_reason,
        CASE source_id WHEN 1 THEN 'whatsapp' WHEN 2 THEN 'email' ELSE 'imessage' END AS kind,
        NOT EXISTS (SELECT 1 FROM turn u WHERE u.conversation_id = t.conversation_id AND u.role = 'user') AS standalone
      FROM turn t WHERE role = 'assistant'""",
    "ctx": """SELECT conversation_id, turn_no, c_no, c_role, c_text FROM fitted
      WHERE age = 1 OR used <= 2048 * 4 - 600 - target_len""",
    "runs": """SELECT *, sum(s) OVER (PARTITION BY conversation_id, turn_no ORDER BY c_no) AS run FROM
        (SELECT *, CASE WHEN lag(c_role) OVER (PARTITION BY conversation_id, turn_no ORDER BY c_no) = c_role THEN 0 ELSE 1 END AS s FROM ctx)""",
    "chat": """SELECT conversation_id, turn_no, string_agg(role || '>' || body, '|' ORDER BY run) AS middle,
        last(role ORDER BY run) AS last_role, last(body ORDER BY run) AS last_body FROM
        (SELECT conversation_id, turn_no, run, any_value(c_role) AS role, string_agg(c_text, chr(10) ORDER BY c_no) AS body
         FROM runs GROUP BY ALL) GROUP BY ALL""",
    "prior": """SELECT conversation_id, turn_no, count(*) AS n_context, string_agg(c_text, chr(10) ORDER BY c_no) AS prior
      FROM ctx GROUP BY ALL""",
    "who": """SELECT c.conversation_id, c.turn_no, string_agg(n.names, ',' ORDER BY c.c_no) AS names
      FROM ctx c JOIN named n ON n.conversation_id = c.conversation_id AND n.turn_no = c.c_no GROUP BY ALL""",
    "joined": """SELECT t.*, coalesce(p.n_context, 0) AS n_context, p.prior, c.middle, c.last_role, c.last_body,
        replace(w.names, ',', ', ') AS names,
        t.standalone OR p.prior IS NULL OR c.last_role <> 'user' AS opener
      FROM target t LEFT JOIN prior p USING (conversation_id, turn_no) LEFT JOIN chat c USING (conversation_id, turn_no)
        LEFT JOIN who w USING (conversation_id, turn_no)""",
    "worded": f"""SELECT *, coalesce({_map("register", OPENERS)}, 'Write') || CASE WHEN coalesce(title, '') <> '' THEN ' for: ' || title ELSE '.' END AS ask,
        'You are Sam. Write exactly as Sam would: same voice, wording, length and habits.' || chr(10) ||
        'Register: ' || register || '. ' || {_map("register", TRAIN_HINTS, "''")} ||
        coalesce(chr(10) || 'Language: ' || {_map("lang", LANG_NAMES)} || ' (switch languages only if Sam would).', '') ||
        chr(10) || 'Setting: ' || CASE WHEN kind = 'email' THEN 'email thread' || coalesce(': ' || title, '')
          WHEN is_group THEN 'group chat' || coalesce(': ' || title, '')
          ELSE '1:1 ' || kind || ' conversation' || CASE WHEN NOT opener AND coalesce(names, '') <> '' THEN ' with ' || substr(names, 1, 80) ELSE '' END END AS sys
      FROM joined""",
    "built": """SELECT *, CASE WHEN opener THEN coalesce(prior || chr(10) || chr(10), '') || ask ELSE last_body END AS prompt FROM worded""",
    "ex": f"""SELECT *, 'system>' || sys || '|' || CASE WHEN opener THEN 'user>' || prompt ELSE middle END || '|assistant>' || text AS chat_text,
        row_number() OVER (PARTITION BY sha256(prompt || chr(0) || text) ORDER BY conversation_id, turn_no) AS copy,
        {q.holdout("conversation_id", 0.2)} AS is_holdout
      FROM built WHERE skip_reason IS NULL""",
}
_EXAMPLE_SQL = q.with_tables("chat_msg", "chat_conv", **_EXAMPLES)


def labelled(spark, sf):
    """Checkpointed: the cap, the statistics and the hash all read it."""
    return materialize(
        examples.labelled_examples(chat_messages(spark, sf), turn_conversations(spark, sf), CONFIG)
    )


def final_examples(spark, sf):
    return examples.build_examples(
        chat_messages(spark, sf), turn_conversations(spark, sf), CONFIG
    )


def _chat_text(m):
    return F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(">"), x["content"])), "|")


@query(
    "training_examples",
    _EXAMPLE_SQL
    + f"""SELECT conversation_id, turn_no, md5(chat_text) AS chat_md5, register, lang, {q.iso("ts")} AS ts,
      CAST(n_context AS INTEGER) AS n_context, kind AS source, wc AS n_words, is_holdout FROM ex WHERE copy = 1""",
)
def training_examples(spark, sf):
    from palimpsest.functions.dates import to_iso

    return final_examples(spark, sf).select(
        "conversation_id",
        "turn_no",
        F.md5(_chat_text(F.col("messages"))).alias("chat_md5"),
        "register",
        "lang",
        to_iso(F.col("ts")).alias("ts"),
        "n_context",
        "source",
        "n_words",
        "is_holdout",
    )


@query(
    "dataset_stats",
    _EXAMPLE_SQL
    + f""", k AS (SELECT * FROM ex WHERE copy = 1),
      s AS (SELECT skip_reason AS reason, count(*) AS n FROM built WHERE skip_reason IS NOT NULL GROUP BY 1
            UNION ALL SELECT 'duplicate', count(*) FROM ex WHERE copy > 1 HAVING count(*) > 0)
      SELECT count(*) FILTER (NOT is_holdout) AS n_examples, count(*) FILTER (is_holdout) AS n_holdout,
        CAST(sum(wc) FILTER (NOT is_holdout) AS BIGINT) AS n_words, {q.iso("max(ts)")} AS data_cutoff,
        count(DISTINCT conversation_id) AS conversations,
        (SELECT string_agg(register || '=' || n, ',' ORDER BY register) FROM (SELECT register, count(*) AS n FROM k WHERE NOT is_holdout GROUP BY 1)) AS by_register,
        (SELECT string_agg(l || '=' || n, ',' ORDER BY l) FROM (SELECT coalesce(lang, 'unknown') AS l, count(*) AS n FROM k WHERE NOT is_holdout GROUP BY 1)) AS by_lang,
        coalesce((SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM s), '') AS skipped FROM k""",
)
def dataset_stats(spark, sf):
    from palimpsest.functions.dates import to_iso

    capped = examples.cap_per_conversation(labelled(spark, sf), CONFIG.max_per_conversation)
    row = examples.dataset_stats(capped)
    for c in ("by_register", "by_lang", "skipped"):
        row = row.withColumn(
            c,
            F.array_join(
                F.transform(
                    F.map_entries(c),
                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
                ),
                ",",
            ),
        )
    return row.withColumn("data_cutoff", to_iso(F.col("data_cutoff")))


@query(
    "conversation_cap",
    _EXAMPLE_SQL
    + """SELECT conversation_id, turn_no, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_no) > 2 AS capped
      FROM ex WHERE copy = 1""",
)
def conversation_cap(spark, sf):
    rows = examples.cap_per_conversation(labelled(spark, sf), 2)
    capped = F.coalesce(F.col("skip_reason") == "conversation_cap", F.lit(False))
    return rows.filter("conversation_id is not null").select(
        "conversation_id", "turn_no", capped.alias("capped")
    )


@query(
    "preview_sample",
    _EXAMPLE_SQL
    + f"""SELECT conversation_id, turn_no, md5(sys) AS system_md5, md5(text) AS target_md5 FROM ex WHERE copy = 1 AND NOT is_holdout
      ORDER BY {q.seeded(7, "conversation_id", "turn_no")}, conversation_id, turn_no LIMIT 5""",
)
def preview_sample(spark, sf):
    rows = examples.preview(final_examples(spark, sf))
    return rows.select(
        "conversation_id", "turn_no", F.md5("system").alias("system_md5"), F.md5("target").alias("target_md5")
    )


@query(
    "shuffled_order",
    "SELECT doc_id, row_number() OVER (ORDER BY " + q.seeded(7, "doc_id", "doc_id") + ", doc_id) AS position FROM documents",
)
def shuffled_order(spark, sf):
    """Position of every row in the seeded order, without one global window."""
    from palimpsest.functions.identity import seeded_order
    from palimpsest.operators.scale import bucketed_rank

    rows = table(spark, sf, "documents").select(
        F.col("doc_id"), seeded_order(7, F.col("doc_id"), F.col("doc_id")).alias("o")
    )
    one = rows.withColumn("g", F.lit(1))
    ranked = bucketed_rank(
        one, ["g"], F.floor(F.col("o") / ((1 << 60) / 256)), [F.col("o"), F.col("doc_id")], "position"
    )
    return ranked.select("doc_id", "position")


@query(
    "snapshot_hash",
    """WITH l AS (SELECT sha256(text) AS h, count(*) AS c FROM documents GROUP BY 1),
      a AS (SELECT substr(h, 1, 5) AS a, sha256(string_agg(h || ':' || c, chr(10) ORDER BY h || ':' || c)) AS line FROM l GROUP BY 1),
      b AS (SELECT substr(a, 1, 2) AS b, sha256(string_agg(line, chr(10) ORDER BY line)) AS line FROM a GROUP BY 1)
      SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS sha256 FROM b""",
)
def snapshot_hash(spark, sf):
    return snapshot.content_sha256(table(spark, sf, "documents").select("text"), "text")


@query("example_lines")
def example_lines(spark, sf):
    """The JSON line of every example of the holdout split, by its hash."""
    rows = final_examples(spark, sf).filter("is_holdout")
    return rows.select("conversation_id", "turn_no", F.md5(snapshot.example_json()).alias("line_md5"))


@query("snapshot_manifest")
def snapshot_manifest(spark, sf):
    capped = examples.cap_per_conversation(labelled(spark, sf), CONFIG.max_per_conversation)
    kept = capped.filter("skip_reason is null and not is_holdout")
    sha = snapshot.content_sha256(kept.select(snapshot.example_json().alias("value")))
    row = snapshot.manifest(examples.dataset_stats(capped), sha, "v1", CONFIG)
    return row.select("version", "n_examples", "n_holdout", "n_words", "conversations", "train_sha256")


# --- blind pairs ------------------------------------------------------------------------

_PAIRS = {
    **_EXAMPLES,
    "cand": f"""SELECT *, {q.seeded(7, "conversation_id", "turn_no")} AS draw, reverse(text) AS reply FROM ex
      WHERE copy = 1 AND is_holdout AND n_context >= 1 AND wc BETWEEN 3 AND 80""",
    "pair": f"""SELECT {q.hash_long("'v1'", "conversation_id", "turn_no")}::VARCHAR AS uid, 'v1' AS version, text AS real_text,
        {q.strip("reply")} AS model_text, {q.seeded(8, "conversation_id", "turn_no")} % 2 = 0 AS real_first, draw AS id,
        conversation_id, turn_no
      FROM cand WHERE {q.strip("reply")} <> '' AND {q.strip("reply")} <> {q.strip("text")}
      ORDER BY draw, conversation_id, turn_no LIMIT 20""",
}
_PAIR_SQL = q.with_tables("chat_msg", "chat_conv", **_PAIRS)


def holdout_pairs(spark, sf):
    """Pairs against a stand-in model that answers with the reply backwards."""
    held = final_examples(spark, sf).filter("is_holdout")
    replies = held.select(
        "conversation_id",
        "turn_no",
        F.reverse(F.try_element_at("messages", F.lit(-1))["content"]).alias("reply"),
    )
    return evaluation.generate_pairs(held, replies, "v1", n=20)


@query(
    "blind_pairs",
    _PAIR_SQL + "SELECT uid, md5(real_text) AS real_md5, md5(model_text) AS model_md5, real_first FROM pair",
)
def blind_pairs(spark, sf):
    return holdout_pairs(spark, sf).select(
        "uid", F.md5("real_text").alias("real_md5"), F.md5("model_text").alias("model_md5"), "real_first"
    )


@query(
    "rendered_context",
    "SELECT conv_id, md5(string_agg(CASE role WHEN 'assistant' THEN 'Me: ' ELSE 'Them: ' END || text, chr(10) ORDER BY turn)) AS context_md5 "
    "FROM conversations WHERE role <> 'system' GROUP BY conv_id",
)
def rendered_context(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(ordered.alias("m"))
    return rows.select("conv_id", F.md5(render_context(F.col("m"))).alias("context_md5"))


@query(
    "training_rows",
    q.with_tables("msg")
    + """SELECT id, register FROM msg WHERE register IN ('text', 'doc') AND ts <= TIMESTAMP '2024-06-30 00:00:00'
      AND coalesce(json_extract_string(meta, '$.origin'), '') <> 'chat'""",
)
def training_rows(spark, sf):
    rows = examples.training_rows(messages(spark, sf), "2024-06-30 00:00:00", ("text", "doc"))
    return rows.select("id", "register")
