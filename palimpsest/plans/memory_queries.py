"""Memories, voice and clips, profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions.dates import to_iso
from palimpsest.functions.memory_rules import memory_kind
from palimpsest.functions.text import EMOJI_PATTERN, STYLE_STOP_WORDS
from palimpsest.operators import captures as cap_ops
from palimpsest.operators import memories as mem_ops
from palimpsest.operators import profile as style
from palimpsest.operators import voice
from palimpsest.plans import sql as q
from palimpsest.plans.adapters import (
    captures,
    chat_lines,
    chat_messages,
    memories,
    messages,
    queries,
    table,
    vectors,
)
from palimpsest.plans.registry import query
from palimpsest.plans.search_queries import bm25

# --- memories ---------------------------------------------------------------------------


@query(
    "memory_list",
    q.with_tables("mem")
    + f"""SELECT uid, kind, {q.iso("updated_at")} AS updated FROM mem WHERE NOT archived AND kind = 'fact'
      AND updated_at > TIMESTAMP '2024-01-02 00:00:00' ORDER BY updated_at DESC, uid LIMIT 100""",
)
def memory_list(spark, sf):
    rows = mem_ops.list_memories(memories(spark, sf), since="2024-01-02 00:00:00", kind="fact")
    return rows.select("uid", "kind", to_iso(F.col("updated_at")).alias("updated"))


@query(
    "memory_export",
    q.with_tables("mem") + "SELECT uid, archived, md5(text) AS text_md5 FROM mem ORDER BY updated_at DESC, uid LIMIT 100000",
)
def memory_export(spark, sf):
    return mem_ops.memory_export(memories(spark, sf)).select("uid", "archived", F.md5("text").alias("text_md5"))


@query(
    "memory_creation",
    q.with_tables("mem")
    + f""", n AS (SELECT 'm' || (item_id * 100) AS uid, {q.strip("text")} AS text FROM benchmark)
      SELECT uid, md5(text) AS text_md5, {q.iso("updated_at")} AS updated FROM mem
      UNION ALL SELECT uid, md5(text), '2025-01-01T00:00:00.000Z' FROM n WHERE uid NOT IN (SELECT uid FROM mem)""",
)
def memory_creation(spark, sf):
    new = queries(spark, sf).select(
        F.concat(F.lit("m"), F.col("query_id") * 100).alias("uid"),
        F.lit("note").alias("kind"),
        F.concat(F.lit("  "), "text").alias("text"),
    )
    rows = mem_ops.create_memories(memories(spark, sf), new, "2025-01-01 00:00:00")
    return rows.select("uid", F.md5("text").alias("text_md5"), to_iso(F.col("updated_at")).alias("updated"))


@query(
    "memory_patch",
    q.with_tables("mem")
    + f""", p AS (SELECT 'm' || (item_id * 100) AS uid, CASE WHEN item_id % 2 = 0 THEN text END AS text, CASE WHEN item_id % 3 = 0 THEN true END AS archived FROM benchmark)
      SELECT m.uid, md5(coalesce(p.text, m.text)) AS text_md5, coalesce(p.archived, m.archived) AS archived,
        CASE WHEN p.uid IS NOT NULL THEN '2025-01-01T00:00:00.000Z' ELSE {q.iso("updated_at")} END AS updated
      FROM mem m LEFT JOIN p ON p.uid = m.uid""",
)
def memory_patch(spark, sf):
    item = F.col("query_id")
    patches = queries(spark, sf).select(
        F.concat(F.lit("m"), item * 100).alias("uid"),
        F.when(item % 2 == 0, F.col("text")).alias("text"),
        F.when(item % 3 == 0, F.lit(True)).alias("archived"),
    )
    rows = mem_ops.update_memories(memories(spark, sf), patches, "2025-01-01 00:00:00")
    return rows.select(
        "uid", F.md5("text").alias("text_md5"), "archived", to_iso(F.col("updated_at")).alias("updated")
    )


@query(
    "memory_deletion",
    q.with_tables("mem") + "SELECT uid FROM mem WHERE uid NOT IN (SELECT 'm' || (item_id * 100) FROM benchmark)",
)
def memory_deletion(spark, sf):
    gone = queries(spark, sf).select(F.concat(F.lit("m"), F.col("query_id") * 100).alias("uid"))
    return mem_ops.delete_by_uid(memories(spark, sf), gone).select("uid")


@query(
    "memory_ids",
    q.with_tables("mem") + "SELECT uid, id FROM mem WHERE uid IN (SELECT 'm' || (item_id * 100) FROM benchmark)",
)
def memory_ids(spark, sf):
    asked = queries(spark, sf).select(F.concat(F.lit("m"), F.col("query_id") * 100).alias("uid"))
    return mem_ops.memory_ids_by_uid(memories(spark, sf), asked)


_KIND = (
    r"CASE WHEN regexp_matches(b, '(^|[^\p{L}\p{N}_.])(\+?\p{Nd}[\p{Nd}" + q.WS + r"().-]{2,}\p{Nd})($|[^\p{L}\p{N}_.])') THEN 'number' "
    r"WHEN regexp_matches(b, '(?i)(^|[^\p{L}\p{N}_])(today|tomorrow|tonight|monday|tuesday|wednesday|thursday|friday|saturday|sunday|next week"
    r"|bugün|yarın|pazartesi|salı|çarşamba|perşembe|cuma|cumartesi|pazar|at \d{1,2}(:\d{2})?\s*(am|pm)?)($|[^\p{L}\p{N}_])') THEN 'event' "
    r"WHEN regexp_matches(b, '(?i)(^|[^\p{L}\p{N}_])(to do|todo|i need to|i have to|i should|remind me to|yapmam lazım|yapmalıyım)($|[^\p{L}\p{N}_])') THEN 'todo' "
    "ELSE 'note' END"
)


@query(
    "memory_kinds",
    "SELECT item_id, " + _KIND.replace("(b,", "(text,") + " AS kind FROM benchmark",
)
def memory_kinds(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", memory_kind(F.col("text")).alias("kind"))


@query(
    "rule_memories",
    q.with_tables("cap")
    + f""", r AS (SELECT uid, substr(text, 15) AS b FROM cap WHERE text LIKE 'Remember that %')
      SELECT {q.hash_long("'explicit'", "uid")}::VARCHAR AS uid, {_KIND} AS kind, upper(substr(b, 1, 1)) || substr(b, 2) AS text,
        uid AS source_ref FROM r""",
)
def rule_memories(spark, sf):
    rows = mem_ops.extract_memories(captures(spark, sf).select("uid", "text"))
    return rows.select("uid", "kind", "text", "source_ref")


def model_replies(spark, sf):
    """A reply per chat turn, as a model might send it: prose around JSON, one odd entry."""
    letters = F.trim(F.regexp_replace("line", r"[^\p{L} ]", ""))
    rows = chat_lines(spark, sf).select("conv_id", "turn", "ln", letters.alias("t"))
    kind = F.when(F.col("ln") % 2 == 0, "preference").otherwise("gossip")
    item = F.concat(
        F.lit('{"text": "'), "t", F.lit('", "kind": "'), kind, F.lit('", "confidence": '),
        ((F.col("ln") % 4) / 4 + 0.25).cast("string"), F.lit("}"),
    )
    listed = F.array_sort(F.collect_list(F.struct("ln", item.alias("j"), "t")))
    grouped = rows.groupBy("conv_id", "turn").agg(listed.alias("x"))
    return grouped.select(
        F.concat(F.lit("r"), "conv_id", F.lit("-"), "turn").alias("source_ref"),
        F.array_join("x.t", " ").alias("source_text"),
        F.concat(
            F.lit('Here you go: {"memories": ['), F.array_join("x.j", ", "), F.lit("]} Anything else?")
        ).alias("reply"),
    )


_CANDIDATES = {
    "l": """SELECT conv_id, turn, ln, trim(regexp_replace(line, '[^\\p{L} ]', '', 'g')) AS t FROM chat_lines""",
    "s": f"""SELECT conv_id, turn, {q.words("string_agg(t, ' ' ORDER BY ln)")} AS wc FROM l GROUP BY ALL""",
    "n": "SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ln) - 1 AS pos FROM l",
}


@query(
    "reply_candidates",
    q.with_tables("chat_lines", **_CANDIDATES)
    + """SELECT 'r' || conv_id || '-' || turn AS source_ref, CAST(pos AS INTEGER) AS pos, t AS text,
        CASE WHEN ln % 2 = 0 THEN 'preference' ELSE 'fact' END AS kind, (ln % 4) / 4 + 0.25 AS confidence
      FROM n JOIN s USING (conv_id, turn) WHERE wc >= 4 AND pos < 8 AND length(t) >= 4 AND (ln % 4) / 4 + 0.25 >= 0.5""",
)
def reply_candidates(spark, sf):
    return mem_ops.filter_candidates(model_replies(spark, sf)).select(
        "source_ref", "pos", "text", "kind", "confidence"
    )


@query(
    "dissimilar_candidates",
    "WITH docs AS (SELECT doc_id AS id, text, true AS hit FROM documents), asked AS (SELECT item_id AS query_id, text FROM benchmark), "
    + ", ".join(f"{n} AS ({s})" for n, s in bm25("docs", "asked", 5).items())
    + ", w AS (SELECT 'd' AS s, doc_id AS id, "
    + "list_distinct(list_filter(string_split_regex(" + q.casefold("text") + ", '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS t FROM documents "
    + "UNION ALL SELECT 'q', item_id, list_distinct(list_filter(string_split_regex(" + q.casefold("text") + ", '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) FROM benchmark) "
    + """SELECT item_id AS id FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM kw
        JOIN w a ON a.s = 'q' AND a.id = query_id JOIN w b ON b.s = 'd' AND b.id = kw.id
        WHERE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.1)""",
)
def dissimilar_candidates(spark, sf):
    stored = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.lit(False).alias("archived")
    )
    asked = queries(spark, sf).withColumnRenamed("query_id", "id")
    return mem_ops.drop_similar(asked, stored, 0.1).select("id")


_WORDS = "list_distinct(list_filter(string_split_regex(" + q.casefold("text") + ", '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''))"


@query(
    "reply_memories",
    q.with_tables(
        "chat_lines",
        "mem",
        recursive=True,
        **_CANDIDATES,
        c=f"""SELECT *, row_number() OVER (ORDER BY ref, pos) AS i, {_WORDS} AS w FROM (
            SELECT 'r' || conv_id || '-' || turn AS ref, CAST(pos AS INTEGER) AS pos, t AS text,
              CASE WHEN ln % 2 = 0 THEN 'preference' ELSE 'fact' END AS kind
            FROM n JOIN s USING (conv_id, turn)
            WHERE wc >= 4 AND pos < 8 AND length(t) >= 4 AND (ln % 4) / 4 + 0.25 >= 0.5)""",
        m=f"SELECT id, {_WORDS} AS w FROM mem WHERE NOT archived",
        cw="SELECT i, len(w) AS n, unnest(w) AS x FROM c",
        mw="SELECT id, len(w) AS n, unnest(w) AS x FROM m",
        known="SELECT DISTINCT i FROM (SELECT i, id FROM cw JOIN mw USING (x) GROUP BY i, id, cw.n, mw.n "
        "HAVING count(*) / (cw.n + mw.n - count(*)) >= 0.7)",
        fresh="SELECT * FROM cw WHERE i NOT IN (SELECT i FROM known)",
        edge="SELECT a.i AS a, b.i AS b FROM fresh a JOIN fresh b ON a.x = b.x AND a.i < b.i GROUP BY a.i, b.i, a.n, b.n "
        "HAVING count(*) / (a.n + b.n - count(*)) >= 0.7",
        late="SELECT b AS i, list(a) AS earlier, row_number() OVER (ORDER BY b) AS j FROM edge GROUP BY b",
        walk="""SELECT CAST(0 AS BIGINT) AS j, CAST([] AS BIGINT[]) AS gone
          UNION ALL SELECT walk.j + 1, CASE WHEN len(list_filter(earlier, lambda e: NOT list_contains(gone, e))) = 0
            THEN gone ELSE list_append(gone, i) END FROM walk JOIN late ON late.j = walk.j + 1""",
        dropped="SELECT unnest(gone) AS i FROM (SELECT gone FROM walk ORDER BY j DESC LIMIT 1)",
    )
    + f"""SELECT {q.hash_long("'extracted'", "ref", "pos")}::VARCHAR AS uid, kind, ref AS source_ref, md5(text) AS text_md5
      FROM c WHERE i NOT IN (SELECT i FROM known) AND i NOT IN (SELECT i FROM dropped)""",
)
def reply_memories(spark, sf):
    """Candidates of a batch that holds near copies, of each other and of stored memories."""
    rows = mem_ops.extract_from_replies(
        model_replies(spark, sf).filter("source_ref is not null"), memories(spark, sf)
    )
    return rows.select("uid", "kind", "source_ref", F.md5("text").alias("text_md5"))


# --- clips ------------------------------------------------------------------------------


@query(
    "clip_candidates",
    q.with_tables("cap")
    + """SELECT uid, round(score, 6) AS score FROM (SELECT uid, coalesce(speaker_score, CASE WHEN origin = 'manual' THEN 0.9 ELSE 0.5 END) AS score, text
        FROM cap WHERE status = 'done' AND audio_path IS NOT NULL AND duration_s BETWEEN 1.5 AND 15
          AND (speaker_is_me OR (speaker_is_me IS NULL AND origin = 'manual'))
        ORDER BY coalesce(speaker_score, 0.5) DESC, duration_s DESC, uid LIMIT 200) """
    + f"WHERE {q.words('text')} >= 3",
)
def clip_candidates(spark, sf):
    return cap_ops.clip_candidates(captures(spark, sf)).select("uid", F.round("score", 6).alias("score"))


@query("reference_clip")
def reference_clip(spark, sf):
    row = cap_ops.assemble_reference(cap_ops.clip_candidates(captures(spark, sf)))
    return row.select(F.array_join("clips", ",").alias("clips"), "reference_text", "seconds")


_TTS = """cl AS (SELECT uid || '.wav' AS audio_file, replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '|', '/') AS text, duration_s
    FROM cap WHERE status = 'done' AND audio_path IS NOT NULL AND duration_s BETWEEN 1 AND 20
      AND (speaker_is_me OR (speaker_is_me IS NULL AND origin = 'manual')))"""


@query(
    "voice_clips",
    q.with_tables("cap") + f", {_TTS} SELECT audio_file, text FROM cl WHERE {q.words('text')} >= 2",
)
def voice_clips(spark, sf):
    return cap_ops.tts_clips(captures(spark, sf)).filter("kept").select("audio_file", "text")


@query(
    "voice_manifest",
    q.with_tables("cap")
    + f""", {_TTS} SELECT count(*) FILTER (k) AS clips, round(sum(duration_s) FILTER (k), 1) AS seconds,
      round(sum(duration_s) FILTER (k) / 3600, 2) AS hours, count(*) FILTER (NOT k) AS skipped,
      sum(duration_s) FILTER (k) >= 3600 AS ready_for_finetune FROM (SELECT *, {q.words("text")} >= 2 AS k FROM cl)""",
)
def voice_manifest(spark, sf):
    return cap_ops.tts_manifest(cap_ops.tts_clips(captures(spark, sf)))


# --- voice profile ----------------------------------------------------------------------

_SUMS = """e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, label FROM embeddings),
    s AS (SELECT i, sum(x) AS x FROM e WHERE label = 3 GROUP BY i),
    p AS (SELECT list(x / (SELECT sqrt(sum(x * x)) FROM s) ORDER BY i) AS centroid, (SELECT count(*) FROM embeddings WHERE label = 3) AS n FROM s)"""


def voice_profile(spark, sf):
    return voice.enroll(vectors(spark, sf).filter("label = 3").select("vec"))


@query(
    "voice_enrolment",
    f"""WITH {_SUMS}, t AS (SELECT i, sum(x) AS x FROM (SELECT i, x FROM e WHERE label = 4 UNION ALL
        SELECT generate_subscripts(centroid, 1), unnest(centroid) * n FROM p) GROUP BY i)
      SELECT n + (SELECT count(*) FROM embeddings WHERE label = 4) AS n_samples,
        (SELECT string_agg(printf('%.4f', x / (SELECT sqrt(sum(x * x)) FROM t) + 0.0), ',' ORDER BY i) FROM t WHERE i <= 4) AS head FROM p""",
)
def voice_enrolment(spark, sf):
    more = vectors(spark, sf).filter("label = 4").select("vec")
    row = voice.enroll(more, voice_profile(spark, sf))
    head = F.transform(F.slice("centroid", 1, 4), lambda x: F.format_string("%.4f", x))
    return row.select("n_samples", F.array_join(head, ",").alias("head"))


@query(
    "voice_status",
    "SELECT count(*) > 0 AS enrolled, count(*) AS n_samples, count(*) >= 3 AS ready, 3 AS min_samples FROM embeddings WHERE label = 3",
)
def voice_status(spark, sf):
    return voice.profile_status(voice_profile(spark, sf))


@query(
    "voice_verification",
    f"""WITH {_SUMS} SELECT vec_id AS id, round(greatest(-1, least(1, list_dot_product(CAST(embedding AS DOUBLE[]), centroid))), 6) AS score,
      list_dot_product(CAST(embedding AS DOUBLE[]), centroid) >= 0.55 AS is_me FROM embeddings, p""",
)
def voice_verification(spark, sf):
    rows = voice.verify(vectors(spark, sf), voice_profile(spark, sf), vec="vec")
    return rows.select("id", F.round("score", 6).alias("score"), "is_me")


@query(
    "voice_similarity",
    f"""WITH {_SUMS}, d AS (SELECT label, list_dot_product(CAST(embedding AS DOUBLE[]), centroid) AS s FROM embeddings, p)
      SELECT round(avg(s) FILTER (label <> 3), 6) AS cosine, count(*) FILTER (label <> 3) AS n, round(avg(s) FILTER (label = 3), 6) AS baseline_mean FROM d""",
)
def voice_similarity(spark, sf):
    v = vectors(spark, sf)
    row = voice.voice_similarity(
        v.filter("label <> 3"), v.filter("label = 3"), voice_profile(spark, sf)
    )
    return row.select(
        F.round("cosine", 6).alias("cosine"), "n", F.round("baseline_mean", 6).alias("baseline_mean")
    )


@query(
    "voice_sentences",
    q.with_tables("chat_msg")
    + f""", d AS (SELECT id, text, {q.seeded(7, "id")} AS o FROM chat_msg WHERE is_me AND register IN ('speech', 'text') ORDER BY o, id LIMIT 24)
      SELECT id, text FROM d WHERE {q.words("text")} BETWEEN 4 AND 25 ORDER BY o, id LIMIT 8""",
)
def voice_sentences(spark, sf):
    return voice.eval_sentences(chat_messages(spark, sf))


_ROUTED = """r AS (SELECT c.*, greatest(-1, least(1, list_dot_product(CAST(e.embedding AS DOUBLE[]), p.centroid))) AS score
    FROM cap c LEFT JOIN embeddings e ON e.vec_id = c.user_id, p)"""


def routed(spark, sf):
    vec = vectors(spark, sf).select(F.col("id").alias("user_id"), F.col("vec").alias("speaker_vec"))
    rows = captures(spark, sf).drop("speaker_is_me", "speaker_score").join(vec, "user_id", "left")
    return cap_ops.route_captures(rows, voice_profile(spark, sf), threshold=0.05)


@query(
    "capture_routing",
    q.with_tables("cap")
    + f""", {_SUMS}, {_ROUTED}
      SELECT uid, CASE WHEN kind = 'audio' AND score < 0.05 THEN 'discarded' ELSE 'corpus' END AS route,
        CASE WHEN kind = 'audio' AND score < 0.05 THEN 'other speaker' END AS error,
        CASE WHEN kind = 'audio' THEN 'speech' ELSE 'text' END AS register,
        CASE WHEN kind = 'audio' THEN score >= 0.05 ELSE true END AS speaker_is_me,
        CASE WHEN kind = 'audio' THEN round(score, 6) END AS speaker_score FROM r""",
)
def capture_routing(spark, sf):
    return routed(spark, sf).select(
        "uid", "route", "error", "register", "speaker_is_me", F.round("speaker_score", 6).alias("speaker_score")
    )


@query(
    "capture_messages",
    q.with_tables("cap")
    + f""", {_SUMS}, {_ROUTED}
      SELECT 'device:' || device_uid AS conversation_external_id, uid AS external_id, text, origin FROM r
      WHERE NOT (kind = 'audio' AND score < 0.05)""",
)
def capture_messages(spark, sf):
    return cap_ops.as_messages(routed(spark, sf)).select(
        "conversation_external_id", "external_id", "text", F.col("meta")["origin"].alias("origin")
    )


# --- profile ----------------------------------------------------------------------------

_NEWEST = "rows_ AS (SELECT * FROM msg WHERE is_me ORDER BY ts DESC, id DESC LIMIT 20000), txt AS (SELECT * FROM rows_ WHERE register = 'text')"
_EMOJI = EMOJI_PATTERN


@query(
    "style_stats",
    q.with_tables("msg")
    + f""", {_NEWEST}, a AS (SELECT text, {q.words("text")} AS w, regexp_extract(text, '\\p{{L}}') AS f,
        regexp_replace(text, '[{q.WS}]+$', '') AS bare FROM txt)
      SELECT count(*) AS n, (list_sort(list(w)))[count(*) // 2 + 1] AS median_words, round(avg(w), 1) AS mean_words,
        CAST(round_even(100 * count(*) FILTER (regexp_matches(f, '^\\p{{Ll}}')) / count(*), 0) AS INTEGER) AS lowercase_start_pct,
        CAST(round_even(100 * count(*) FILTER (right(bare, 1) IN ('.', '!', '?')) / count(*), 0) AS INTEGER) AS ends_with_punctuation_pct,
        CAST(round_even(100 * count(*) FILTER (regexp_matches(text, '{_EMOJI}')) / count(*), 0) AS INTEGER) AS emoji_pct,
        CAST(round_even(100 * count(*) FILTER (contains(text, chr(10))) / count(*), 0) AS INTEGER) AS multi_line_pct FROM a""",
)
def style_stats(spark, sf):
    return style.style_stats(style.style_rows(messages(spark, sf)))


_STOP = q.listed(STYLE_STOP_WORDS)


@query(
    "top_tokens",
    q.with_tables("msg")
    + f""", {_NEWEST}, t AS (SELECT unnest(regexp_extract_all({q.casefold("text")}, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}}')) AS w FROM txt),
      c AS (SELECT w, count(*) AS n FROM t WHERE NOT list_contains({_STOP}, w) GROUP BY w ORDER BY n DESC, w LIMIT 25),
      e AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_EMOJI}')) AS w FROM txt) GROUP BY w ORDER BY n DESC, w LIMIT 8)
      SELECT (SELECT string_agg(w, ' ' ORDER BY n DESC, w) FROM c) AS top_words, coalesce((SELECT string_agg(w, ' ' ORDER BY n DESC, w) FROM e), '') AS top_emojis""",
)
def top_tokens(spark, sf):
    row = style.top_tokens(style.style_rows(messages(spark, sf)))
    return row.select(
        F.array_join("top_words", " ").alias("top_words"), F.array_join("top_emojis", " ").alias("top_emojis")
    )


@query(
    "profile_mix",
    q.with_tables("msg")
    + f""", {_NEWEST}, l AS (SELECT coalesce(lang, 'unknown') AS k, count(*) AS c FROM rows_ GROUP BY 1),
      h AS (SELECT hour(ts) AS h, count(*) AS c FROM rows_ GROUP BY 1 ORDER BY c DESC, h LIMIT 3),
      r AS (SELECT register, count(*) AS c FROM rows_ GROUP BY 1)
      SELECT (SELECT string_agg(k || '=' || CAST(round_even(100 * c / (SELECT sum(c) FROM l), 0) AS INTEGER), ',' ORDER BY c DESC, k) FROM l) AS languages,
        (SELECT string_agg(h, ',' ORDER BY c DESC, h) FROM h) AS peak_hours,
        (SELECT string_agg(register || '=' || c, ',' ORDER BY register) FROM r) AS registers""",
)
def profile_mix(spark, sf):
    row = style.profile_mix(style.style_rows(messages(spark, sf)))
    pairs = lambda c: F.array_join(
        F.transform(
            F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        ),
        ",",
    )
    return row.select(
        pairs("languages").alias("languages"),
        F.array_join("peak_hours_utc", ",").alias("peak_hours"),
        pairs("registers").alias("registers"),
    )


@query(
    "sampled_messages",
    q.with_tables("msg")
    + f""", p AS (SELECT id, register, text FROM msg WHERE is_me AND word_count BETWEEN 4 AND 60 ORDER BY ts DESC, id DESC LIMIT 3000)
      SELECT id, '[' || register || '] ' || text AS line FROM p ORDER BY {q.seeded(7, "id")}, id LIMIT 60""",
)
def sampled_messages(spark, sf):
    return style.sample_messages(messages(spark, sf))


@query("profile_document")
def profile_document(spark, sf):
    return style.profile_document(
        messages(spark, sf), memories(spark, sf), "Sam", now_iso=F.lit("2024-01-01T00:00:00.000Z")
    )
