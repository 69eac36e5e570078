"""Blind pairs, the real-versus-model classifier, fidelity by version, latency summaries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.identity import hash_long, seeded_order
from palimpsest.functions.prompts import render_context
from palimpsest.functions.text import WORD, WS, casefold, strip, word_count
from palimpsest.operators.scale import bucketed_rank
from palimpsest.operators.selection import values_at
from palimpsest.session import materialize

RATER_CHARS = 64
FEATURE_DIM = 1 << 18
RANK_BUCKETS = 1024


# --- blind pairs ------------------------------------------------------------------------


def pair_candidates(examples: DataFrame) -> DataFrame:
    """Examples with context whose target has 3 to 80 words."""
    target = F.try_element_at("messages", F.lit(-1))["content"]
    context = (
        F.coalesce(F.col("n_context"), F.lit(1)) if "n_context" in examples.columns else F.lit(1)
    )
    return examples.filter((context >= 1) & word_count(target).between(3, 80))


def pair_prompts(examples: DataFrame, seed: int = 7) -> DataFrame:
    """Candidates with a seeded order and the prompt a model has to answer."""
    key = seeded_order(seed, F.col("conversation_id"), F.col("turn_no"))
    return pair_candidates(examples).select(
        "conversation_id",
        "turn_no",
        key.alias("draw"),
        F.slice("messages", F.lit(1), F.size("messages") - 1).alias("prompt"),
        F.try_element_at("messages", F.lit(-1))["content"].alias("real_text"),
    )


def generate_pairs(
    examples: DataFrame, replies: DataFrame, version: str, n: int = 20, seed: int = 7
) -> DataFrame:
    """Pairs of a real reply and a model reply, in seeded order, with a seeded coin for sides.

    ``replies``: conversation_id, turn_no, reply. Empty or identical replies give no pair, so
    the first ``n`` are taken after that check.
    """
    made = (
        pair_prompts(examples, seed)
        .join(replies, ["conversation_id", "turn_no"])
        .withColumn("model_text", strip(F.col("reply")))
        .filter((F.col("model_text") != "") & (F.col("model_text") != strip(F.col("real_text"))))
        .orderBy("draw", "conversation_id", "turn_no")
        .limit(n)
    )
    coin = seeded_order(seed + 1, F.col("conversation_id"), F.col("turn_no")) % 2 == 0
    return made.select(
        hash_long(
            F.lit(version), F.col("conversation_id").cast("string"), F.col("turn_no").cast("string")
        ).cast("string").alias("uid"),
        F.lit(version).alias("version"),
        render_context(F.col("prompt")).alias("context"),
        "real_text",
        "model_text",
        coin.alias("real_first"),
        F.col("draw").alias("id"),
    )


def generation_result(pairs: DataFrame, version: str) -> DataFrame:
    """The metric row for a generation run."""
    return pairs.agg(
        F.lit(version).alias("version"),
        F.lit("blind_pairs").alias("kind"),
        F.lit("generated").alias("metric"),
        F.count("*").cast("double").alias("value"),
        F.count("*").alias("n"),
    )


def unrated(pairs: DataFrame, guesses: DataFrame, version: str, rater: str) -> DataFrame:
    seen = guesses.filter(F.col("rater") == rater).select(F.col("pair_uid").alias("uid"))
    return pairs.filter(F.col("version") == version).join(seen, "uid", "left_anti")


def pairs_for_rater(
    pairs: DataFrame, guesses: DataFrame, version: str, rater: str, limit: int = 20
) -> DataFrame:
    """Unrated pairs in order, sides swapped by ``real_first``."""
    real = F.col("real_first")
    return (
        unrated(pairs, guesses, version, rater)
        .orderBy("id")
        .limit(limit)
        .select(
            "uid",
            "context",
            F.when(real, F.col("real_text")).otherwise(F.col("model_text")).alias("first"),
            F.when(real, F.col("model_text")).otherwise(F.col("real_text")).alias("second"),
        )
    )


def write_pairs(pairs: DataFrame, guesses: DataFrame, version: str, path: str) -> None:
    """Offline rating payload as JSON rows."""
    pairs_for_rater(pairs, guesses, version, "__export__", 10_000).write.mode("overwrite").json(path)


def record_guesses(pairs: DataFrame, guesses_in: DataFrame) -> DataFrame:
    """Score guesses (uid, rater, guessed_first); unknown pairs drop out."""
    return guesses_in.join(pairs.select("uid", "real_first"), "uid").select(
        F.col("uid").alias("pair_uid"),
        F.substring(strip(F.col("rater")), 1, RATER_CHARS).alias("rater"),
        F.col("guessed_first").alias("guessed_real_is_first"),
        (F.col("real_first") == F.col("guessed_first")).alias("correct"),
    )


def guesses_for(
    pairs: DataFrame, guesses: DataFrame, version: str | None = None, rater: str | None = None
) -> DataFrame:
    """Guesses with the version of their pair."""
    rows = guesses.join(pairs.select(F.col("uid").alias("pair_uid"), "version"), "pair_uid")
    if version is not None:
        rows = rows.filter(F.col("version") == version)
    return rows.filter(F.col("rater") == rater) if rater is not None else rows


def _score() -> list[Column]:
    n, right = F.count("*"), F.count_if("correct")
    return [
        n.alias("n"),
        right.alias("correct"),
        F.when(n > 0, right / n).alias("accuracy"),
    ]


def blind_summaries(pairs: DataFrame, guesses: DataFrame) -> DataFrame:
    """Per version: pairs, guesses, correct, accuracy (NULL without guesses), raters map."""
    per_rater = (
        guesses_for(pairs, guesses)
        .groupBy("version", "rater")
        .agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    )
    judged = per_rater.groupBy("version").agg(
        F.sum("n").alias("n"),
        F.sum("c").alias("correct"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.struct("rater", F.struct("n", F.col("c").alias("correct")).alias("s"))
                )
            )
        ).alias("raters"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        pairs.groupBy("version")
        .agg(F.count("*").alias("pairs"))
        .join(judged, "version", "left")
        .select(
            "version",
            "pairs",
            zero("n"),
            zero("correct"),
            F.when(F.col("n") > 0, F.col("correct") / F.col("n")).alias("accuracy"),
            "raters",
        )
    )


def blind_summary(pairs: DataFrame, guesses: DataFrame, version: str) -> DataFrame:
    return blind_summaries(pairs.filter(F.col("version") == version), guesses)


def rater_scores(pairs: DataFrame, guesses: DataFrame, version: str) -> DataFrame:
    return guesses_for(pairs, guesses, version).groupBy("version", "rater").agg(*_score())


def rater_score(pairs: DataFrame, guesses: DataFrame, version: str, rater: str) -> DataFrame:
    return guesses_for(pairs, guesses, version, rater).agg(*_score())


def replace_metric(results: DataFrame, new: DataFrame) -> DataFrame:
    """Metric rows of ``new`` take the place of those with the same version, kind and metric."""
    key = ["version", "kind", "metric"]
    return results.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def refresh_blind_summary(
    results: DataFrame, pairs: DataFrame, guesses: DataFrame, version: str
) -> DataFrame:
    """Replace the accuracy row of a version that has guesses."""
    new = (
        blind_summary(pairs, guesses, version)
        .filter("accuracy is not null")
        .select(
            "version",
            F.lit("blind_pairs").alias("kind"),
            F.lit("guess_accuracy").alias("metric"),
            F.col("accuracy").alias("value"),
            "n",
            F.to_json(F.struct("raters")).alias("details"),
        )
    )
    return replace_metric(results, new)


# --- discriminator ----------------------------------------------------------------------


def labelled_union(real: DataFrame, model: DataFrame) -> DataFrame:
    """(id, text, label): 1 real, 0 model."""
    return real.select("id", "text", F.lit(1).alias("label")).unionByName(
        model.select("id", "text", F.lit(0).alias("label"))
    )


def balanced(labelled: DataFrame) -> DataFrame:
    """The first n rows of each label by id, n being the smaller side."""
    smaller = (
        labelled.groupBy("label")
        .agg(F.count("*").alias("n"))
        .agg(F.when(F.count("*") > 1, F.min("n")).otherwise(0).alias("_n"))
        .withColumn("_one", F.lit(1))
    )
    ends = labelled.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).withColumn("_one", F.lit(1))
    rows = (
        labelled.withColumn("_one", F.lit(1))
        .join(F.broadcast(smaller), "_one")
        .join(F.broadcast(ends), "_one")
    )
    width = F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo") + 1) / RANK_BUCKETS)
    bucket = F.floor((F.col("id") - F.col("lo")) / width)
    return (
        bucketed_rank(rows, ["label"], bucket, [F.col("id")], "_rank")
        .filter(F.col("_rank") <= F.col("_n"))
        .select("id", "text", "label")
    )


def text_features(text: Column) -> Column:
    """Word 1-2-grams, character 3-5-grams and a length bucket."""
    folded = casefold(text)
    words = F.regexp_extract_all(folded, F.lit(rf"[{WORD}_]+|[^{WORD}_{WS}]"), F.lit(0))
    padded = F.concat(F.lit(" "), folded, F.lit(" "))

    def char_grams(c: Column, n: int) -> Column:
        # one letter is taken at a time, what stands in front of it is looked at
        found = F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))
        return F.transform(found, lambda g: F.concat(F.lit(f"c{n}:"), g))

    def grams(x: Column) -> Column:
        w, c = x["w"], x["c"]
        firsts = F.slice(w, F.lit(1), F.greatest(F.lit(0), F.size(w) - 1))
        pairs = F.transform(
            firsts, lambda a, i: F.concat(F.lit("b:"), a, F.lit("_"), F.get(w, i + 1))
        )
        length = F.least(F.floor(F.size(w) / 5), F.lit(20)).cast("string")
        return F.concat(
            F.transform(w, lambda t: F.concat(F.lit("w:"), t)),
            pairs,
            *[char_grams(c, n) for n in (3, 4, 5)],
            F.array(F.concat(F.lit("len:"), length)),
        )

    # Bound once per row: inside a lambda a plain expression would run for every element.
    both = F.array(F.struct(words.alias("w"), padded.alias("c")))
    return F.get(F.transform(both, grams), F.lit(0))


def hashed_features(df: DataFrame, dim: int = FEATURE_DIM) -> DataFrame:
    """Add ``features``: hashed n-gram counts, L2-normalised sparse vectors."""
    tf = HashingTF(numFeatures=dim, inputCol="_grams", outputCol="_tf")
    norm = Normalizer(p=2.0, inputCol="_tf", outputCol="features")
    grams = df.withColumn("_grams", text_features(F.col("text")))
    return norm.transform(tf.transform(grams)).drop("_grams", "_tf")


def assign_folds(df: DataFrame, folds: int = 5, seed: int = 7) -> DataFrame:
    """Even folds per label: rank in hash order modulo ``folds``."""
    spread = df.withColumn("_h", seeded_order(seed, F.col("id"), F.col("label")))
    bucket = F.floor(F.col("_h") / ((1 << 60) / RANK_BUCKETS))
    ranked = bucketed_rank(spread, ["label"], bucket, [F.col("_h"), F.col("id")], "_rank")
    return ranked.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_rank", "_h")


def discriminate(
    labelled: DataFrame,
    version: str = "v1",
    min_samples: int = 10,
    folds: int = 5,
    dim: int = FEATURE_DIM,
    max_iter: int = 50,
) -> DataFrame:
    """Cross-validated accuracy of a logistic regression telling real from model texts.

    Returns (version, fold, accuracy, n); raises when there are too few samples.
    """
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if counts.get(0, 0) < min_samples:
        raise ValueError(f"{version}: need at least {min_samples} model replies")
    rows = hashed_features(assign_folds(balanced(labelled), folds), dim).select(
        "id", F.col("label").cast("double").alias("label"), "fold", "features"
    )
    # Used by every fold; recomputed from the source if an executor holding it is lost.
    rows = rows.persist()
    estimator = Pipeline(stages=[LogisticRegression(maxIter=max_iter, regParam=1e-3)])
    parts = []
    for fold in range(folds):
        model = estimator.fit(rows.filter(F.col("fold") != fold))
        scored = model.transform(rows.filter(F.col("fold") == fold))
        parts.append(
            scored.agg(
                F.lit(version).alias("version"),
                F.lit(fold).alias("fold"),
                F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
                F.count("*").alias("n"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def discriminator_result(per_fold: DataFrame) -> DataFrame:
    """The metric row: mean of fold accuracies."""
    return per_fold.groupBy("version").agg(
        F.lit("discriminator").alias("kind"),
        F.lit("clf_accuracy").alias("metric"),
        F.avg("accuracy").alias("value"),
        F.sum("n").alias("n"),
    )


# --- fidelity by version ----------------------------------------------------------------


def latest_results(results: DataFrame) -> DataFrame:
    """Newest row (highest id) per version, kind and metric."""
    key = ["version", "kind", "metric"]
    rest = [c for c in results.columns if c not in key]
    return results.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.col("id")).alias("_r")
    ).select(*key, "_r.*")


def baseline_mean(details: Column) -> Column:
    return F.get_json_object(details, "$.baseline_mean").try_cast("double")


def runs_with_results(runs: DataFrame, latest: DataFrame) -> DataFrame:
    """Runs and result metrics side by side; versions of either side are kept."""
    kind, metric = F.col("kind"), F.col("metric")
    blind = (kind == "blind_pairs") & (metric == "guess_accuracy")
    made = (kind == "blind_pairs") & (metric == "generated")
    pick = lambda cond, value: F.max_by(F.when(cond, value), F.when(cond, F.col("id")))
    disc, voice = kind == "discriminator", kind == "voice_similarity"
    wide = latest.groupBy("version").agg(
        pick(blind, F.col("value")).alias("blind_accuracy"),
        pick(blind, F.col("n")).alias("blind_n"),
        pick(disc, F.col("value")).alias("discriminator_accuracy"),
        pick(disc, F.col("n")).alias("discriminator_n"),
        pick(voice, F.col("value")).alias("voice_cosine"),
        pick(voice, baseline_mean(F.col("details"))).alias("voice_baseline"),
        pick(made, F.col("value").cast("long")).alias("pairs_generated"),
    )
    side = runs.select(
        "version", F.col("finished_at").alias("trained_at"), "status", "n_words", "n_examples"
    )
    return side.join(wide, "version", "full_outer")


def version_number(version: Column) -> Column:
    """The number of a ``v<digits>`` label, else a value after all of them."""
    digits = F.regexp_extract(version, r"(?s)^.(\d+)\z", 1)
    return F.when(digits != "", digits.try_cast("long")).otherwise(F.lit(10**9))


def order_versions(df: DataFrame) -> DataFrame:
    return df.orderBy(version_number(F.col("version")), "version")


def fidelity(runs: DataFrame, results: DataFrame) -> DataFrame:
    """One row per version with its training facts and newest metrics."""
    return order_versions(runs_with_results(runs, latest_results(results)))


def next_version(runs: DataFrame) -> DataFrame:
    n = F.regexp_extract("version", r"^v(\d+)\z", 1)
    top = F.max(F.when(n != "", n.cast("long")))
    return runs.agg(
        F.concat(F.lit("v"), (F.coalesce(top, F.lit(0)) + 1).cast("string")).alias("version")
    )


def latest_done(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.max_by("version", F.when(F.col("status") == "done", F.col("id"))).alias("version")
    )


def decode_run(runs: DataFrame) -> DataFrame:
    """config and metrics as string maps; unreadable JSON gives NULL."""
    as_map = lambda c: F.from_json(F.col(c), "map<string,string>")
    return runs.withColumn("config", as_map("config")).withColumn("metrics", as_map("metrics"))


# --- latency ----------------------------------------------------------------------------


def latency_summary(samples: DataFrame) -> DataFrame:
    """n, p50, p90, min, max seconds per name over ok samples, 3 decimals.

    p50 is the interpolated median, p90 the sorted value at int(0.9 n). The ranks are found by
    narrowing histograms (``values_at``), so a hot name never lands in one task.
    """
    ok = samples.filter("ok and seconds is not null").select(
        F.col("name").alias("g"), F.col("seconds").cast("double").alias("v")
    )
    size = materialize(
        ok.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    )
    n = F.col("n")
    ranks = {
        "a": F.floor((n - 1) / 2), "b": F.floor(n / 2), "p90": F.least(n - 1, F.floor(F.lit(0.9) * n)),
    }
    wanted = size.select("g", F.explode(F.array(*ranks.values())).alias("r")).distinct()
    ends = size.select("g", F.col("least").alias("lo"), F.col("most").alias("hi"), "n")
    found = size.join(values_at(ok, wanted, ends), "g")
    at = {k: F.max(F.when(F.col("r") == r, F.col("v"))).alias(k) for k, r in ranks.items()}
    return found.groupBy("g", "n", "least", "most").agg(*at.values()).select(
        F.col("g").alias("name"),
        "n",
        F.round((F.col("a") + F.col("b")) / 2, 3).alias("p50_s"),
        F.round("p90", 3).alias("p90_s"),
        F.round("least", 3).alias("min_s"),
        F.round("most", 3).alias("max_s"),
    )
