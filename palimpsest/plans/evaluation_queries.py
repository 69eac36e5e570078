"""Blind tests, classifier, fidelity, latency, retention and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import evaluation as ev
from palimpsest.operators import retention
from palimpsest.operators.segments import SegmentRules, segment_frames
from palimpsest.plans import sql as q
from palimpsest.plans.adapters import frames, table
from palimpsest.plans.registry import query

# Pairs from parts, guesses from line items, runs and results from orders.
_PAIR = """pair AS (SELECT p_partkey AS id, 'p' || p_partkey AS uid, 'v' || (p_size % 12 + 1) AS version,
    p_name AS context, p_brand AS real_text, p_type AS model_text, p_partkey % 2 = 0 AS real_first FROM part)"""
_GUESS = """guess AS (SELECT 'p' || l_partkey AS pair_uid, 'r' || (l_suppkey % 5) AS rater,
    l_linenumber % 2 = 0 AS guessed_real_is_first, (l_linenumber % 2 = 0) = (l_partkey % 2 = 0) AS correct
  FROM lineitem WHERE l_returnflag = 'R')"""
_RESULT = """result AS (SELECT o_orderkey AS id, 'v' || (o_custkey % 15 + 1) AS version,
    CASE o_orderstatus WHEN 'F' THEN 'blind_pairs' WHEN 'O' THEN 'discriminator' ELSE 'voice_similarity' END AS kind,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'guess_accuracy' ELSE 'generated' END
         WHEN o_orderstatus = 'O' THEN 'clf_accuracy' ELSE 'cosine' END AS metric,
    o_totalprice AS value, o_custkey AS n, '{"baseline_mean": ' || (o_orderkey % 100) || '}' AS details FROM orders)"""
_RUN = """run AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'draft' || s_suppkey ELSE 'v' || (s_suppkey % 12 + 4) END AS version,
    CASE WHEN s_nationkey % 3 = 0 THEN 'done' ELSE 'failed' END AS status, s_suppkey * 10 AS n_words FROM supplier
  QUALIFY row_number() OVER (PARTITION BY version ORDER BY s_suppkey) = 1)"""


def pairs(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        key.alias("id"),
        F.concat(F.lit("p"), key).alias("uid"),
        F.concat(F.lit("v"), F.col("p_size") % 12 + 1).alias("version"),
        F.col("p_name").alias("context"),
        F.col("p_brand").alias("real_text"),
        F.col("p_type").alias("model_text"),
        (key % 2 == 0).alias("real_first"),
    )


def guesses_in(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .filter("l_returnflag = 'R'")
        .select(
            F.concat(F.lit("p"), F.col("l_partkey")).alias("uid"),
            F.concat(F.lit(" r"), F.col("l_suppkey") % 5).alias("rater"),
            (F.col("l_linenumber") % 2 == 0).alias("guessed_first"),
        )
    )


def guesses(spark, sf):
    return ev.record_guesses(pairs(spark, sf), guesses_in(spark, sf))


def results(spark, sf):
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("id"),
        F.concat(F.lit("v"), F.col("o_custkey") % 15 + 1).alias("version"),
        F.when(status == "F", "blind_pairs")
        .when(status == "O", "discriminator")
        .otherwise("voice_similarity")
        .alias("kind"),
        F.when(status == "F", F.when(key % 2 == 0, "guess_accuracy").otherwise("generated"))
        .when(status == "O", "clf_accuracy")
        .otherwise("cosine")
        .alias("metric"),
        F.col("o_totalprice").alias("value"),
        F.col("o_custkey").alias("n"),
        F.concat(F.lit('{"baseline_mean": '), key % 100, F.lit("}")).alias("details"),
    )


def runs(spark, sf):
    key = F.col("s_suppkey")
    version = F.when(key % 10 == 0, F.concat(F.lit("draft"), key)).otherwise(
        F.concat(F.lit("v"), key % 12 + 4)
    )
    rows = table(spark, sf, "supplier").select(
        key.alias("id"),
        version.alias("version"),
        F.when(F.col("s_nationkey") % 3 == 0, "done").otherwise("failed").alias("status"),
        (key * 10).alias("n_words"),
        key.alias("n_examples"),
        F.timestamp_seconds(key).alias("finished_at"),
    )
    rest = [c for c in rows.columns if c != "version"]
    return rows.groupBy("version").agg(F.min_by(F.struct(*rest), "id").alias("r")).select("version", "r.*")


@query(
    "unrated_pairs",
    f"WITH {_PAIR}, {_GUESS} SELECT uid FROM pair WHERE version = 'v3' AND NOT EXISTS "
    "(SELECT 1 FROM guess WHERE pair_uid = uid AND rater = 'r1')",
)
def unrated_pairs(spark, sf):
    return ev.unrated(pairs(spark, sf), guesses(spark, sf), "v3", "r1").select("uid")


@query(
    "pairs_for_rater",
    f"""WITH {_PAIR}, {_GUESS} SELECT uid, context, CASE WHEN real_first THEN real_text ELSE model_text END AS first,
      CASE WHEN real_first THEN model_text ELSE real_text END AS second FROM pair WHERE version = 'v3'
      AND NOT EXISTS (SELECT 1 FROM guess WHERE pair_uid = uid AND rater = 'r1') ORDER BY id LIMIT 20""",
)
def pairs_for_rater(spark, sf):
    return ev.pairs_for_rater(pairs(spark, sf), guesses(spark, sf), "v3", "r1")


@query(
    "recorded_guesses",
    f"WITH {_PAIR}, {_GUESS} SELECT pair_uid, rater, guessed_real_is_first, correct FROM guess",
)
def recorded_guesses(spark, sf):
    return guesses(spark, sf)


_SUMMARY = f"""WITH {_PAIR}, {_GUESS},
    g AS (SELECT version, rater, count(*) AS n, count(*) FILTER (correct) AS c FROM guess JOIN pair ON uid = pair_uid GROUP BY ALL),
    v AS (SELECT version, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS correct,
            string_agg(rater || '=' || n || '/' || c, ',' ORDER BY rater) AS raters FROM g GROUP BY version),
    s AS (SELECT p.version, p.pairs, coalesce(v.n, 0) AS n, coalesce(v.correct, 0) AS correct, v.correct / v.n AS accuracy, v.raters
      FROM (SELECT version, count(*) AS pairs FROM pair GROUP BY 1) p LEFT JOIN v USING (version))"""


@query("blind_summary", _SUMMARY + " SELECT * FROM s")
def blind_summary(spark, sf):
    rows = ev.blind_summaries(pairs(spark, sf), guesses(spark, sf))
    one = lambda e: F.concat(
        e["key"], F.lit("="), e["value"]["n"].cast("string"), F.lit("/"), e["value"]["correct"].cast("string")
    )
    return rows.withColumn("raters", F.array_join(F.transform(F.map_entries("raters"), one), ","))


@query(
    "rater_scores",
    f"WITH {_PAIR}, {_GUESS} SELECT version, rater, count(*) AS n, count(*) FILTER (correct) AS correct, "
    "count(*) FILTER (correct) / count(*) AS accuracy FROM guess JOIN pair ON uid = pair_uid WHERE version = 'v5' GROUP BY ALL",
)
def rater_scores(spark, sf):
    return ev.rater_scores(pairs(spark, sf), guesses(spark, sf), "v5")


@query(
    "rater_score",
    f"WITH {_PAIR}, {_GUESS} SELECT count(*) AS n, count(*) FILTER (correct) AS correct, "
    "CASE WHEN count(*) > 0 THEN count(*) FILTER (correct) / count(*) END AS accuracy FROM guess JOIN pair ON uid = pair_uid WHERE version = 'v5' AND rater = 'r2'",
)
def rater_score(spark, sf):
    return ev.rater_score(pairs(spark, sf), guesses(spark, sf), "v5", "r2")


@query(
    "refreshed_metric",
    _SUMMARY
    + f""", {_RESULT}, n AS (SELECT version, 'blind_pairs' AS kind, 'guess_accuracy' AS metric, accuracy AS value, n FROM s WHERE version = 'v4' AND accuracy IS NOT NULL)
      SELECT version, kind, metric, value, n FROM result WHERE NOT (version = 'v4' AND kind = 'blind_pairs' AND metric = 'guess_accuracy' AND EXISTS (SELECT 1 FROM n))
      UNION ALL SELECT * FROM n""",
)
def refreshed_metric(spark, sf):
    rows = ev.refresh_blind_summary(results(spark, sf), pairs(spark, sf), guesses(spark, sf), "v4")
    return rows.select("version", "kind", "metric", "value", "n")


# --- classifier -------------------------------------------------------------------------


def labelled(spark, sf):
    """Documents of good quality against the others."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    side = lambda v: rows.filter(F.col("quality") == v).select(F.col("doc_id").alias("id"), "text")
    return ev.labelled_union(side(1), side(0))


@query(
    "balanced_classes",
    """WITH l AS (SELECT doc_id AS id, quality AS label FROM labels JOIN documents USING (doc_id)),
      n AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM l GROUP BY label))
      SELECT id, label FROM l QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= (SELECT n FROM n)""",
)
def balanced_classes(spark, sf):
    return ev.balanced(labelled(spark, sf)).select("id", "label")


@query(
    "classifier_folds",
    f"""WITH l AS (SELECT doc_id AS id, quality AS label FROM labels JOIN documents USING (doc_id))
      SELECT id, label, CAST(row_number() OVER (PARTITION BY label ORDER BY {q.seeded(7, "id", "label")}, id) % 5 AS INTEGER) AS fold FROM l""",
)
def classifier_folds(spark, sf):
    return ev.assign_folds(labelled(spark, sf)).select("id", "label", "fold")


@query(
    "text_features",
    """WITH t AS (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS f FROM documents),
      w AS (SELECT doc_id, f, regexp_extract_all(f, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]') AS w FROM t)
      SELECT doc_id, CAST(len(w) + greatest(0, len(w) - 1) + greatest(0, length(f)) + greatest(0, length(f) - 1) + greatest(0, length(f) - 2) + 1 AS INTEGER) AS n,
        md5(array_to_string(w, ' ')) AS words_md5, least(len(w) // 5, 20) AS bucket FROM w""",
)
def text_features(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", ev.text_features(F.col("text")).alias("f"))
    only = F.transform(F.filter("f", lambda x: x.startswith("w:")), lambda x: F.substring(x, 3, 1 << 30))
    return rows.select(
        "doc_id",
        F.size("f").alias("n"),
        F.md5(F.array_join(only, " ")).alias("words_md5"),
        F.replace(F.try_element_at("f", F.lit(-1)), F.lit("len:"), F.lit("")).cast("long").alias("bucket"),
    )


@query("discriminator")
def discriminator(spark, sf):
    return ev.discriminator_result(ev.discriminate(labelled(spark, sf), "v1", dim=1 << 14, max_iter=10))


# --- fidelity ---------------------------------------------------------------------------

_LATEST = "latest AS (SELECT * FROM result QUALIFY row_number() OVER (PARTITION BY version, kind, metric ORDER BY id DESC) = 1)"


@query(
    "latest_results",
    f"WITH {_RESULT}, {_LATEST} SELECT version, kind, metric, id, value, n FROM latest",
)
def latest_results(spark, sf):
    return ev.latest_results(results(spark, sf)).select("version", "kind", "metric", "id", "value", "n")


_WIDE = """wide AS (SELECT version, max(value) FILTER (metric = 'guess_accuracy') AS blind_accuracy, max(n) FILTER (metric = 'guess_accuracy') AS blind_n,
    max(value) FILTER (kind = 'discriminator') AS discriminator_accuracy, max(n) FILTER (kind = 'discriminator') AS discriminator_n,
    max(value) FILTER (kind = 'voice_similarity') AS voice_cosine,
    max(CAST(json_extract(details, '$.baseline_mean') AS DOUBLE)) FILTER (kind = 'voice_similarity') AS voice_baseline,
    max(CAST(trunc(value) AS BIGINT)) FILTER (metric = 'generated') AS pairs_generated FROM latest GROUP BY version)"""


@query(
    "fidelity",
    f"WITH {_RESULT}, {_LATEST}, {_RUN}, {_WIDE} SELECT version, run.status, run.n_words, blind_accuracy, blind_n, "
    "discriminator_accuracy, discriminator_n, voice_cosine, voice_baseline, pairs_generated FROM run FULL JOIN wide USING (version)",
)
def fidelity(spark, sf):
    return ev.fidelity(runs(spark, sf), results(spark, sf)).drop("trained_at", "n_examples")


@query(
    "version_order",
    f"""WITH {_RUN} SELECT version, CASE WHEN regexp_full_match(substr(version, 2), '\\d+') THEN CAST(substr(version, 2) AS BIGINT) ELSE 1000000000 END AS number FROM run""",
)
def version_order(spark, sf):
    rows = ev.order_versions(runs(spark, sf))
    return rows.select("version", ev.version_number(F.col("version")).alias("number"))


@query(
    "next_version",
    f"""WITH {_RUN} SELECT 'v' || (max(CASE WHEN version LIKE 'v%' THEN CAST(substr(version, 2) AS INTEGER) END) + 1) AS version FROM run""",
)
def next_version(spark, sf):
    return ev.next_version(runs(spark, sf))


@query(
    "latest_done_version",
    f"WITH {_RUN} SELECT arg_max(version, id) AS version FROM run WHERE status = 'done'",
)
def latest_done_version(spark, sf):
    return ev.latest_done(runs(spark, sf))


@query(
    "decoded_runs",
    "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS broken FROM events",
)
def decoded_runs(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.col("props").alias("config"), F.lit("{not json").alias("metrics")
    )
    decoded = ev.decode_run(rows)
    return decoded.select(
        "event_id", F.col("config")["k"].alias("k"), F.try_element_at("metrics", F.lit("k")).alias("broken")
    )


@query(
    "latency_summary",
    """WITH s AS (SELECT event_type AS name, value AS seconds FROM events),
      r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seconds) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM s)
      SELECT name, n, round(median(seconds), 3) AS p50_s, round(max(seconds) FILTER (i = least(n - 1, CAST(floor(0.9 * n) AS BIGINT))), 3) AS p90_s,
        round(min(seconds), 3) AS min_s, round(max(seconds), 3) AS max_s FROM r GROUP BY name, n""",
)
def latency_summary(spark, sf):
    samples = table(spark, sf, "events").select(
        F.col("event_type").alias("name"), F.col("value").alias("seconds"), F.lit(True).alias("ok")
    )
    return ev.latency_summary(samples)


@query(
    "price_latency",
    """WITH s AS (SELECT l_shipmode_ AS name, l_extendedprice AS seconds FROM (SELECT l_returnflag AS l_shipmode_, * FROM lineitem) WHERE l_linestatus = 'O'),
      r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seconds) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM s)
      SELECT name, n, round(median(seconds), 3) AS p50_s, round(max(seconds) FILTER (i = least(n - 1, CAST(floor(0.9 * n) AS BIGINT))), 3) AS p90_s,
        round(min(seconds), 3) AS min_s, round(max(seconds), 3) AS max_s FROM r GROUP BY name, n""",
)
def price_latency(spark, sf):
    """Few names with very many samples."""
    samples = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("name"),
        F.col("l_extendedprice").alias("seconds"),
        (F.col("l_linestatus") == "O").alias("ok"),
    )
    return ev.latency_summary(samples)


# --- retention and segments -------------------------------------------------------------


@query(
    "spool_retention",
    """SELECT user_id AS device, event_id, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 40000 AS kept FROM events""",
)
def spool_retention(spark, sf):
    entries = table(spark, sf, "events").select(
        F.col("user_id").alias("device"),
        F.col("event_id").alias("uid"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("long").alias("size"),
    )
    rows = retention.enforce_cap(entries, 40_000)
    return rows.select("device", F.col("uid").alias("event_id"), "kept")


# The state machine itself, frame by frame, as a recursion over frame numbers.
RULES = SegmentRules(
    threshold=0.5, min_speech_s=0.064, silence_end_s=0.128, max_segment_s=0.32, pad_s=0.064
)
_MACHINE = f"""
  f AS (SELECT device, frame_no, prob > {RULES.threshold} AS loud, max(frame_no) OVER (PARTITION BY device) AS final_no FROM frame),
  m AS (
    SELECT device, -1::BIGINT AS frame_no, false AS is_open, 0::BIGINT AS first, 0::BIGINT AS n, 0::BIGINT AS speech, 0::BIGINT AS quiet,
      NULL::BIGINT AS o_first, NULL::BIGINT AS o_n, NULL::BIGINT AS o_speech FROM (SELECT DISTINCT device FROM f)
    UNION ALL
    SELECT device, frame_no,
      CASE WHEN closing THEN false WHEN filled THEN true ELSE n1 > 0 END,
      CASE WHEN filled AND NOT closing THEN frame_no + 1 ELSE first1 END,
      CASE WHEN closing OR filled THEN 0 ELSE n1 END, CASE WHEN closing OR filled THEN 0 ELSE speech1 END, quiet1,
      CASE WHEN emits THEN first1 END, CASE WHEN emits THEN kept END, CASE WHEN emits THEN speech1 END
    FROM (SELECT *, (closing OR filled) AND kept > 0 AND speech1 >= {RULES.min_speech} AS emits FROM
      (SELECT *, CASE WHEN closing AND quiet1 > {RULES.pad} THEN greatest(0, n1 - (quiet1 - {RULES.pad})) ELSE n1 END AS kept FROM
        (SELECT *, was_open AND NOT loud AND quiet1 >= {RULES.silence} AS closing,
           (n1 > 0 OR was_open) AND n1 >= {RULES.longest} AS filled FROM
          (SELECT m.device, f.frame_no, m.is_open AS was_open, f.loud,
             CASE WHEN m.is_open THEN m.first WHEN f.loud THEN greatest(0, f.frame_no - {RULES.pad}) ELSE 0 END AS first1,
             CASE WHEN m.is_open THEN m.n + 1 WHEN f.loud THEN least(f.frame_no, {RULES.pad}) + 1 ELSE 0 END AS n1,
             CASE WHEN m.is_open THEN m.speech + f.loud::INT WHEN f.loud THEN 1 ELSE 0 END AS speech1,
             CASE WHEN f.loud THEN 0 WHEN m.is_open THEN m.quiet + 1 ELSE m.quiet END AS quiet1
           FROM m JOIN f ON f.device = m.device AND f.frame_no = m.frame_no + 1))))),
  flushed AS (SELECT device, first, CASE WHEN quiet > {RULES.pad} THEN greatest(0, n - (quiet - {RULES.pad})) ELSE n END AS n, speech
    FROM m JOIN (SELECT DISTINCT device, final_no FROM f) USING (device) WHERE frame_no = final_no AND is_open)"""


@query(
    "speech_segments",
    q.with_tables("frame", recursive=True)
    + f""", {_MACHINE}
      SELECT device, o_first AS first_frame, o_first + o_n - 1 AS last_frame, o_n AS n_frames, o_speech AS speech_frames FROM m WHERE o_first IS NOT NULL
      UNION ALL SELECT device, first, first + n - 1, n, speech FROM flushed WHERE n > 0 AND speech >= {RULES.min_speech}""",
)
def speech_segments(spark, sf):
    return segment_frames(frames(spark, sf), RULES)
