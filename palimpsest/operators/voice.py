"""Voice profile: enrolment, verification, similarity of synthesised speech."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identity import seeded_order
from palimpsest.functions.text import word_count
from palimpsest.functions.vectors import clipped_score, unit

MIN_ENROLL_SAMPLES = 3
THRESHOLD = 0.55


def vector_sums(vectors: DataFrame, *group: str, vec: str = "vec") -> DataFrame:
    """(group.., vec, n): element-wise sums. Elements are summed map-side, dimension by
    dimension, so a hot group costs one partial row per dimension and task."""
    per_dim = (
        vectors.select(*group, F.posexplode(vec).alias("_i", "_x"))
        .groupBy(*group, "_i")
        .agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.count("*").alias("_n"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_s")))
    return per_dim.groupBy(*group).agg(
        F.transform(ordered, lambda x: x["_s"]).alias("vec"), F.max("_n").alias("n")
    )


def enroll(vectors: DataFrame, profile: DataFrame | None = None, name: str = "me") -> DataFrame:
    """Fold clip vectors into the running unit centroid: (name, centroid, n_samples)."""
    added = vector_sums(vectors)
    if profile is not None:
        known = profile.select(
            F.transform("centroid", lambda x: x * F.col("n_samples")).alias("vec"),
            F.col("n_samples").alias("n"),
        )
        both = added.unionByName(known)
        n = both.agg(F.sum("n").alias("n_samples")).withColumn("_one", F.lit(1))
        total = vector_sums(both).select("vec").withColumn("_one", F.lit(1))
        added = total.join(n, "_one").select("vec", F.col("n_samples").alias("n"))
    return added.select(
        F.lit(name).alias("name"), unit(F.col("vec")).alias("centroid"), F.col("n").alias("n_samples")
    )


def enroll_from_captures(captures: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Only push-to-talk audio is certain to be me."""
    mine = captures.filter(
        (F.col("kind") == "audio") & (F.col("origin") == "manual") & F.col("speaker_vec").isNotNull()
    )
    return enroll(mine.select(F.col("speaker_vec").alias("vec")), profile)


def profile_status(profile: DataFrame, min_n: int = MIN_ENROLL_SAMPLES) -> DataFrame:
    n = F.coalesce(F.max("n_samples"), F.lit(0))
    return profile.agg(
        (F.count("*") > 0).alias("enrolled"),
        n.alias("n_samples"),
        ((F.count("*") > 0) & (n >= min_n)).alias("ready"),
        F.lit(min_n).alias("min_samples"),
    )


def verify(
    clips: DataFrame,
    profile: DataFrame,
    threshold: float = THRESHOLD,
    min_n: int = MIN_ENROLL_SAMPLES,
    vec: str = "speaker_vec",
) -> DataFrame:
    """Add ``is_me`` and ``score`` against the one-row profile; both NULL until it is ready."""
    ready = (
        profile.filter(F.col("n_samples") >= min_n)
        .select(F.col("centroid").alias("_c"))
        .limit(1)
        .withColumn("_one", F.lit(1))
    )
    # One row by the limit above.
    judged = clips.withColumn("_one", F.lit(1)).join(F.broadcast(ready), "_one", "left")
    score = F.when(F.col("_c").isNotNull() & F.col(vec).isNotNull(), clipped_score(F.col(vec), F.col("_c")))
    return (
        judged.withColumn("score", score)
        .withColumn("is_me", F.col("score") >= threshold)
        .drop("_c", "_one")
    )


def eval_sentences(messages: DataFrame, n: int = 8, seed: int = 7) -> DataFrame:
    """Sentences to synthesise: 3n seeded draws of speech or text, the first n of 4-25 words."""
    order = seeded_order(seed, F.col("id"))
    drawn = (
        messages.filter(F.col("is_me") & F.col("register").isin("speech", "text"))
        .select("id", "text", order.alias("_o"))
        .orderBy("_o", "id")
        .limit(3 * n)
    )
    return (
        drawn.filter(word_count(F.col("text")).between(4, 25)).orderBy("_o", "id").limit(n).drop("_o")
    )


def similarity_means(scores: DataFrame) -> DataFrame:
    """(cosine, n, baseline_mean) from (score, is_real)."""
    return scores.agg(
        F.avg(F.when(~F.col("is_real"), F.col("score"))).alias("cosine"),
        F.count_if(~F.col("is_real")).alias("n"),
        F.avg(F.when(F.col("is_real"), F.col("score"))).alias("baseline_mean"),
    )


def voice_similarity(tts: DataFrame, real: DataFrame, profile: DataFrame) -> DataFrame:
    """Mean cosine of synthesised (vec) and real (vec) clips to the profile centroid."""
    both = tts.select("vec", F.lit(False).alias("is_real")).unionByName(
        real.select("vec", F.lit(True).alias("is_real"))
    )
    return similarity_means(verify(both, profile, min_n=1, vec="vec").select("score", "is_real"))
