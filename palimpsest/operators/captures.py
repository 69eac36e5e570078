"""Captures from clients: routing, listing, patches, clip selection, voice data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import WS, clean_text, guess_lang, strip, word_count
from palimpsest.operators.scale import folded_patches
from palimpsest.operators.voice import verify

MAX_CLIP_CANDIDATES = 200
TARGET_SECONDS = (6.0, 12.0)
FINETUNE_SECONDS = 3600


def list_captures(captures: DataFrame, since=None, limit: int | None = 50, status=None) -> DataFrame:
    """Newest captures, optionally touched after ``since`` or with one status."""
    rows = captures
    if since is not None:
        touched = F.coalesce("processed_at", "received_at")
        rows = rows.filter(touched > F.lit(since).cast("timestamp"))
    if status:
        rows = rows.filter(F.col("status") == status)
    if limit is None:
        return rows
    return rows.orderBy(F.col("received_at").desc(), "uid").limit(limit)


def sync(memories: DataFrame, captures: DataFrame, since=None, limit: int | None = None):
    """(memories, captures) changed after the cursor; archived memories are included.

    All of them, unless ``limit`` asks for the newest ones only.
    """
    from palimpsest.operators.memories import list_memories

    return (
        list_memories(memories, since, limit, include_archived=True),
        list_captures(captures, since, limit),
    )


def create_captures(captures: DataFrame, new: DataFrame) -> DataFrame:
    """Append captures whose uid is unknown; a uid sent again is a no-op."""
    first = (
        new.groupBy("uid")
        .agg(
            F.min_by(
                F.struct(*[c for c in new.columns if c != "uid"]), F.col("received_at")
            ).alias("_c")
        )
        .select("uid", "_c.*")
    )
    fresh = first.join(captures.select("uid"), "uid", "left_anti")
    return fresh.withColumn("status", F.lit("pending"))


def update_captures(captures: DataFrame, patches: DataFrame, order: str | None = None) -> DataFrame:
    """Patch fields override where they are not NULL; later patches of a uid win over earlier ones."""
    patches = folded_patches(patches, order=order)
    fields = [c for c in patches.columns if c != "uid"]
    side = patches.select("uid", *[F.col(c).alias(f"_{c}") for c in fields])
    return captures.join(side, "uid", "left").select(
        *[
            F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c)
            for c in captures.columns
        ]
    )


def latest_state(log: DataFrame, key: str, at: str) -> DataFrame:
    """Latest row per key of an append log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_r")).select(key, "_r.*")


def capture_memories(captures: DataFrame, memories: DataFrame) -> DataFrame:
    """Captures with the uids of their live memories in id order."""
    made = (
        memories.filter(~F.col("archived") & F.col("source_ref").isNotNull())
        .groupBy(F.col("source_ref").alias("uid"))
        .agg(F.array_sort(F.collect_list(F.struct("id", F.col("uid").alias("m")))).alias("_m"))
        .select("uid", F.col("_m.m").alias("memory_uids"))
    )
    none = F.array().cast("array<string>")
    return captures.join(made, "uid", "left").withColumn(
        "memory_uids", F.coalesce("memory_uids", none)
    )


def capture_message(captures: DataFrame, messages: DataFrame) -> DataFrame:
    """Captures with the id of the newest message stored for them."""
    stored = (
        messages.filter(F.col("external_id").isNotNull())
        .groupBy(F.col("external_id").alias("uid"))
        .agg(F.max("id").alias("message_id"))
    )
    return captures.drop("message_id").join(stored, "uid", "left")


# --- routing ----------------------------------------------------------------------------


def route_captures(
    captures: DataFrame,
    profile: DataFrame,
    policy: str = "discard",
    threshold: float = 0.55,
    min_samples: int = 3,
    compose: bool = True,
) -> DataFrame:
    """Decide what becomes of each capture.

    Text is mine. Audio (``text`` holds the transcript, ``speaker_vec`` the voice vector) is
    checked against the one-row ``profile``; other speakers are discarded or, with policy
    ``context_only``, keep their transcript outside the corpus. Adds ``route``
    (corpus / context / discarded / none), status, error, register, speaker_is_me, speaker_score.
    """
    audio = F.col("kind") == "audio"
    cleaned = captures.withColumn("text", clean_text(F.col("text"), compose))
    judged = verify(cleaned, profile, threshold, min_samples)
    me = F.when(audio, F.col("is_me"))
    other = audio & F.coalesce(~F.col("is_me"), F.lit(False))
    reason = F.when(other & F.lit(policy == "discard"), "other speaker").when(
        audio & (F.col("text") == ""), "no speech"
    )
    out = (
        judged.withColumn("error", reason)
        .withColumn(
            "route",
            F.when(F.col("error").isNotNull(), "discarded")
            .when(other, "context")
            .when(F.col("text") == "", "none")
            .otherwise("corpus"),
        )
        .withColumn("status", F.when(F.col("error").isNotNull(), "discarded").otherwise("done"))
        .withColumn("register", F.when(audio, "speech").otherwise("text"))
        .withColumn("lang", guess_lang(F.col("text")))
        .withColumn(
            "speaker_is_me",
            F.when(F.col("error") == "no speech", F.lit(None).cast("boolean"))
            .when(audio, me)
            .otherwise(F.lit(True)),
        )
        .withColumn("speaker_score", F.when(audio, F.col("score")))
    )
    return out.drop("is_me", "score")


def as_messages(routed: DataFrame) -> DataFrame:
    """Canonical messages for captures routed to the corpus."""
    device = F.col("device_uid")
    return routed.filter(F.col("route") == "corpus").select(
        F.concat(F.lit("device:"), device).alias("conversation_external_id"),
        "text",
        F.col("client_ts").alias("ts"),
        F.lit(True).alias("is_me"),
        "register",
        F.col("uid").alias("external_id"),
        F.concat(F.lit("Captures from "), device).alias("conversation_title"),
        F.lit(False).alias("is_group"),
        F.lit(None).cast("string").alias("sender_handle"),
        F.lit(None).cast("string").alias("sender_name"),
        F.create_map(
            F.lit("capture"), F.col("uid"), F.lit("origin"), F.col("origin")
        ).alias("meta"),
        F.lit(0).cast("long").alias("seq"),
    )


# --- voice clips ------------------------------------------------------------------------


def _usable(min_s: float, max_s: float) -> Column:
    return (
        (F.col("status") == "done")
        & F.col("audio_path").isNotNull()
        & F.col("text").isNotNull()
        & F.col("duration_s").between(min_s, max_s)
        & (
            F.coalesce(F.col("speaker_is_me"), F.lit(False))
            | (F.col("speaker_is_me").isNull() & (F.col("origin") == "manual"))
        )
    )


def clip_candidates(
    captures: DataFrame, min_s: float = 1.5, max_s: float = 15.0, limit: int = MAX_CLIP_CANDIDATES
) -> DataFrame:
    """The ``limit`` best clips of my voice, then only those with at least 3 words."""
    score = F.coalesce(
        F.col("speaker_score"), F.when(F.col("origin") == "manual", 0.9).otherwise(0.5)
    )
    return (
        captures.filter(_usable(min_s, max_s))
        .orderBy(
            F.coalesce("speaker_score", F.lit(0.5)).desc(), F.col("duration_s").desc(), F.col("uid")
        )
        .limit(limit)
        .filter(word_count(F.col("text")) >= 3)
        .select(
            "uid",
            strip(F.col("text")).alias("text"),
            "duration_s",
            score.alias("score"),
            F.coalesce("speaker_score", F.lit(0.5)).alias("order_score"),
        )
    )


def assemble_reference(
    candidates: DataFrame, target: tuple[float, float] = TARGET_SECONDS, gap_s: float = 0.3
) -> DataFrame:
    """One row: the clips of a reference recording, greedily picked, and its transcript.

    At most 200 candidates reach the single-row fold.
    """
    ordered = F.transform(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.col("order_score")).alias("a"),
                    (-F.col("duration_s")).alias("b"),
                    "uid",
                    "text",
                )
            )
        ),
        lambda c: F.struct(c["uid"].alias("uid"), c["text"].alias("text"), (-c["b"]).alias("s")),
    )
    start = F.struct(
        F.array().cast("array<struct<uid:string,text:string,s:double>>").alias("chosen"),
        F.lit(0.0).alias("total"),
    )

    def step(acc: Column, c: Column) -> Column:
        full = acc["total"] >= target[1]
        overshoots = (acc["total"] >= target[0]) & (acc["total"] + c["s"] > target[1])
        return F.when(full | overshoots, acc).otherwise(
            F.struct(
                F.concat(acc["chosen"], F.array(c)).alias("chosen"),
                (acc["total"] + c["s"] + gap_s).alias("total"),
            )
        )

    picked = candidates.agg(ordered.alias("c")).select(
        F.aggregate("c", start, step, lambda acc: acc["chosen"]).alias("c")
    )
    return picked.filter(F.size("c") > 0).select(
        F.col("c.uid").alias("clips"),
        F.array_join(
            F.transform(
                F.col("c.text"), lambda t: F.concat(F.regexp_replace(t, r"[.!?]+\z", ""), F.lit("."))
            ),
            " ",
        ).alias("reference_text"),
        F.round(
            F.aggregate(F.col("c.s"), F.lit(0.0), lambda a, x: a + x) + gap_s * (F.size("c") - 1), 2
        ).alias("seconds"),
    )


def tts_clips(
    captures: DataFrame, min_s: float = 1.0, max_s: float = 20.0, min_words: int = 2
) -> DataFrame:
    """Clips for a voice data set; ``kept`` is false where the transcript is too short."""
    text = F.replace(
        strip(F.regexp_replace("text", rf"[{WS}]+", " ")), F.lit("|"), F.lit("/")
    )
    return captures.filter(_usable(min_s, max_s)).select(
        F.concat("uid", F.lit(".wav")).alias("audio_file"),
        text.alias("text"),
        "duration_s",
        (word_count(text) >= min_words).alias("kept"),
    )


def tts_manifest(clips: DataFrame) -> DataFrame:
    seconds = F.coalesce(F.sum(F.when(F.col("kept"), F.col("duration_s"))), F.lit(0.0))
    return clips.agg(
        F.count_if("kept").alias("clips"),
        F.round(seconds, 1).alias("seconds"),
        F.round(seconds / 3600, 2).alias("hours"),
        F.count_if(~F.col("kept")).alias("skipped"),
        (seconds >= FINETUNE_SECONDS).alias("ready_for_finetune"),
    )


def export_tts_dataset(captures: DataFrame, path: str, **limits) -> DataFrame:
    """Write pipe-separated ``audio_file|text`` metadata; returns the one-row manifest."""
    clips = tts_clips(captures, **limits)
    # Joined by hand: a CSV writer would quote texts that hold quotation marks.
    clips.filter("kept").select(F.concat_ws("|", "audio_file", "text").alias("value")).write.mode(
        "overwrite"
    ).text(f"{path}/metadata")
    manifest = tts_manifest(clips)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest
