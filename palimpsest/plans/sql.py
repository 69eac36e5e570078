"""Building blocks for the reference SQL of the registered queries (DuckDB dialect)."""

from __future__ import annotations

from palimpsest.functions.text import (
    ENGLISH_WORDS,
    MEDIA_PLACEHOLDERS,
    TURKISH_LETTERS,
    TURKISH_WORDS,
)
from palimpsest.plans.adapters import BASE_S, DOC_CONV, DOC_ID

WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
URL = rf"(?i)https?://[^{WS}]+|www\.[^{WS}]+"
EMOJI_ONLY = (
    rf"^[{WS}\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{2B00}}-\x{{2BFF}}"
    r"\x{FE0F}\x{200D}\x{1F1E6}-\x{1F1FF}!?.,]+$"
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '[^{WS}]+')) AS INTEGER)"


def strip_urls(x: str) -> str:
    return strip(f"regexp_replace({x}, '{URL}', '', 'g')")


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


def reason(x: str) -> str:
    t = strip(x)
    bare = strip_urls(t)
    has = " OR ".join(f"contains(lower({t}), {lit(p)})" for p in MEDIA_PLACEHOLDERS)
    return (
        f"CASE WHEN {t} = '' THEN 'empty' "
        f"WHEN ({has}) AND {words(bare)} <= 4 THEN 'media_placeholder' "
        f"WHEN {bare} = '' THEN 'url_only' "
        f"WHEN regexp_matches({t}, '{EMOJI_ONLY}') THEN 'emoji_only' END"
    )


def clean(x: str) -> str:
    t = f"translate(nfc_normalize({x}), chr(8203)||chr(8204)||chr(8205)||chr(8288)||chr(65279)||chr(8206)||chr(8207)||chr(65532), '')"
    t = f"regexp_replace({t}, '\\r\\n?', chr(10), 'g')"
    t = f"regexp_replace({t}, '[ \\t\\x{{A0}}]+', ' ', 'g')"
    inner = r"[ \t\f\r\x0b\x1c-\x1f\x{85}\p{Z}]"
    t = f"regexp_replace({t}, '(?m)^{inner}+|{inner}+$', '', 'g')"
    t = f"regexp_replace({t}, '\\n{{3,}}', chr(10)||chr(10), 'g')"
    return strip(t)


def lang(x: str) -> str:
    w = f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+')"
    letters = f"(length({x}) - length(regexp_replace({x}, '[{TURKISH_LETTERS}]', '', 'g')))"
    tr = f"(len(list_filter({w}, lambda q: list_contains({listed(TURKISH_WORDS)}, q))) + {letters})"
    en = f"len(list_filter({w}, lambda q: list_contains({listed(ENGLISH_WORDS)}, q)))"
    return (
        f"CASE WHEN {tr} = 0 AND {en} = 0 THEN NULL WHEN {tr} > {en} THEN 'tr' "
        f"WHEN {en} > {tr} THEN 'en' WHEN {letters} > 0 THEN 'tr' ELSE 'en' END"
    )


def tokens(x: str) -> str:
    return (
        f"list_filter(string_split_regex(strip_accents(lower({x})), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda q: q <> '')"
    )


def casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def hash_long(*parts: str) -> str:
    joined = " || ".join(f"CAST({p} AS VARCHAR) || chr(0)" for p in parts)
    return f"CAST('0x' || substr(sha256({joined}), 1, 15) AS BIGINT)"


def seeded(seed: int, *keys: str) -> str:
    joined = " || ':' || ".join([lit(str(seed)), *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST('0x' || substr(sha256({joined}), 1, 15) AS BIGINT)"


def holdout(conv: str, fraction: float = 0.05, seed: int = 7) -> str:
    h = f"sha256('{seed}:' || CAST({conv} AS VARCHAR))"
    swapped = " || ".join(f"substr({h}, {at}, 2)" for at in (7, 5, 3, 1))
    return f"(CAST('0x' || {swapped} AS BIGINT) % 10000 < {int(fraction * 10000)})"


def seconds(expr: str) -> str:
    return f"make_timestamp(CAST(({BASE_S} + {expr}) * 1000000 AS BIGINT))"


# --- tables derived from the given ones, as WITH entries --------------------------------

TABLES = {
    "chat_lines": """
        SELECT conv_id, turn, role, ln, trim(line) AS line FROM (
          SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ln
          FROM conversations WHERE role <> 'system')
        WHERE trim(line) <> ''""",
    "chat_msg": f"""
        SELECT conv_id * 1000000 + turn * 10000 + ln AS id, conv_id AS conversation_id,
          CASE WHEN role <> 'assistant' THEN
            (CASE WHEN conv_id % 5 = 0 THEN (conv_id + ln) % 3 ELSE conv_id % 7 END) + 1 END AS contact_id,
          role = 'assistant' AS is_me,
          {seconds("(conv_id % 365) * 86400 + turn * 7200 + (turn // 4) * 345600 + ln * 60 + (ln // 6) * 1500")} AS ts,
          CASE conv_id % 4 WHEN 1 THEN 'email' WHEN 2 THEN 'speech' ELSE 'text' END AS register,
          {lang("line")} AS lang, line AS text, {words("line")} AS word_count,
          'x' || conv_id || '-' || turn || '-' || ln AS external_id,
          CASE WHEN role <> 'assistant' THEN 'P' ||
            (CASE WHEN conv_id % 5 = 0 THEN (conv_id + ln) % 3 ELSE conv_id % 7 END) END AS sender_name,
          CASE WHEN conv_id % 11 = 0 AND turn = 1 THEN '{{"origin": "chat"}}' END AS meta
        FROM chat_lines""",
    "chat_conv": """
        SELECT DISTINCT conv_id AS id, conv_id % 3 + 1 AS source_id, 'chat-' || conv_id AS external_id,
          CASE WHEN conv_id % 2 = 0 THEN 'Chat ' || conv_id END AS title, conv_id % 5 = 0 AS is_group
        FROM conversations""",
    "doc_msg": f"""
        SELECT doc_id + {DOC_ID} AS id,
          CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) + {DOC_CONV} AS conversation_id,
          CAST(NULL AS BIGINT) AS contact_id, true AS is_me, {seconds("doc_id * 60")} AS ts,
          'doc' AS register, {lang("text")} AS lang, text, {words("text")} AS word_count,
          'd' || doc_id AS external_id, CAST(NULL AS VARCHAR) AS sender_name,
          CAST(NULL AS VARCHAR) AS meta
        FROM documents""",
    "doc_conv": f"""
        SELECT DISTINCT CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) + {DOC_CONV} AS id,
          CAST(4 AS BIGINT) AS source_id, source AS external_id, source AS title, false AS is_group
        FROM documents""",
    "msg": "SELECT * FROM chat_msg UNION ALL SELECT * FROM doc_msg",
    "conv": "SELECT * FROM chat_conv UNION ALL SELECT * FROM doc_conv",
    "src": """
        SELECT id, CASE id WHEN 1 THEN 'whatsapp' WHEN 2 THEN 'email' WHEN 3 THEN 'imessage'
                   ELSE 'doc' END AS kind, 'Source ' || id AS label, '/data/' || id AS locator
        FROM (SELECT DISTINCT source_id AS id FROM conv)
        UNION ALL SELECT CAST(r_regionkey + 10 AS BIGINT), 'import', r_name, '/data/' || (r_regionkey + 10)
        FROM region""",
    "contact": f"""
        SELECT contact_id AS id, sha256('salt' || chr(0) || 'contact' || contact_id || chr(0)) AS handle_hash,
          CASE WHEN contact_id <> 3 THEN min(sender_name) END AS display_name
        FROM chat_msg WHERE contact_id IS NOT NULL GROUP BY contact_id""",
    "mem": f"""
        SELECT id, 'm' || id AS uid,
          (['note','fact','preference','todo','number','event','person'])[CAST(id % 7 AS INTEGER) + 1] AS kind,
          text, 'c' || (id % 1000) AS source_ref, 0.5 + (id % 5) / 10 AS confidence,
          {seconds("id * 60")} AS created_at, {seconds("id * 60 + (id % 13) * 3600")} AS updated_at,
          id % 9 = 0 AS archived
        FROM (SELECT conv_id * 100 + turn AS id, text FROM conversations WHERE role = 'user')""",
    "cap": """
        SELECT event_id AS id, 'c' || event_id AS uid, 'd' || user_id AS device_uid, user_id,
          CASE WHEN event_type IN ('view', 'click', 'error') THEN 'audio' ELSE 'text' END AS kind,
          CASE WHEN event_type IN ('click', 'purchase') THEN 'manual' ELSE 'listener' END AS origin,
          CASE event_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'done' WHEN 'purchase' THEN 'pending'
            WHEN 'signup' THEN 'processing' WHEN 'error' THEN 'discarded' END AS status,
          ts AS client_ts, ts + INTERVAL 5 MINUTE AS received_at,
          CASE WHEN event_type IN ('view', 'click') THEN ts + INTERVAL 10 MINUTE END AS processed_at,
          (CASE WHEN user_id % 2 = 0 THEN 'Remember that ' ELSE 'I saw ' END) || event_type || ' code ' ||
            json_extract_string(props, '$.k') || ' for device ' || user_id AS text,
          CASE WHEN event_type IN ('view', 'click', 'error') THEN 'audio/' || event_id || '.wav' END AS audio_path,
          value / 4 AS duration_s,
          CASE WHEN event_type IN ('view', 'error') THEN user_id % 3 = 0 END AS speaker_is_me,
          CASE WHEN event_type IN ('view', 'click', 'error') AND user_id % 4 <> 0
            THEN round((value % 10) / 10, 3) END AS speaker_score
        FROM events""",
    "frame": """
        SELECT user_id AS device, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no,
          least(1.0, value / 40) AS prob, value / 2 - 60 AS level_db
        FROM events""",
}
NEEDS = {
    "chat_msg": ["chat_lines"],
    "msg": ["chat_msg", "doc_msg"],
    "conv": ["chat_conv", "doc_conv"],
    "src": ["conv"],
    "contact": ["chat_msg"],
}


def with_tables(*names: str, recursive: bool = False, **extra: str) -> str:
    """A WITH clause holding ``names``, what they need, and ``extra`` entries in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    entries = [f"{n} AS ({TABLES[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(entries) + "\n"
