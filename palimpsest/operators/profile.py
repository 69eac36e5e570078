"""A style fingerprint of my messages and the profile document built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identity import seeded_order
from palimpsest.functions.text import (
    EMOJI_PATTERN,
    LETTERS,
    STYLE_STOP_WORDS,
    WS,
    casefold,
    word_count,
)
from palimpsest.operators.selection import newest

NEWEST = 20_000
TOP_WORDS = 25
TOP_EMOJI = 8


def style_rows(messages: DataFrame, n: int = NEWEST) -> DataFrame:
    """My newest ``n`` messages."""
    return newest(messages.filter("is_me").select("id", "text", "register", "lang", "ts"), n)


def _text_rows(rows: DataFrame) -> DataFrame:
    """Rows of register text, or all of them when there are none."""
    texts = rows.agg(F.max(F.col("register") == "text").alias("_texts")).withColumn("_one", F.lit(1))
    return (
        rows.withColumn("_one", F.lit(1))
        .join(F.broadcast(texts), "_one")
        .filter(~F.col("_texts") | (F.col("register") == "text"))
        .drop("_texts", "_one")
    )


def style_stats(rows: DataFrame) -> DataFrame:
    """One row: counts, lengths and habits of ``style_rows``.

    Percentages round half to even, as the usual integer rounding of a float does.
    """
    text = F.col("text")
    first = F.regexp_extract(text, r"(\p{L})", 1)
    share = lambda cond: F.bround(100 * F.count_if(cond) / F.count("*")).cast("int")
    bare = F.regexp_replace(text, rf"[{WS}]+\z", "")
    lengths = F.array_sort(F.collect_list(word_count(text)))
    return (
        _text_rows(rows)
        .agg(
            F.count("*").alias("n"),
            F.get(lengths, F.floor(F.count("*") / 2).cast("int")).alias("median_words"),
            F.round(F.avg(word_count(text)), 1).alias("mean_words"),
            share((first != "") & first.rlike(r"^\p{Ll}")).alias("lowercase_start_pct"),
            share(bare.rlike(r"[.!?]\z")).alias("ends_with_punctuation_pct"),
            share(text.rlike(EMOJI_PATTERN)).alias("emoji_pct"),
            share(text.contains("\n")).alias("multi_line_pct"),
        )
        .filter("n > 0")
    )


def _top(tokens: DataFrame, k: int, name: str) -> DataFrame:
    top = (
        tokens.filter("token is not null")
        .groupBy("token")
        .agg(F.count("*").alias("c"))
        .orderBy(F.col("c").desc(), "token")
        .limit(k)
    )
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), "token")))
    return top.agg(F.transform(ranked, lambda x: x["token"]).alias(name))


def top_tokens(rows: DataFrame, words: int = TOP_WORDS, emoji: int = TOP_EMOJI) -> DataFrame:
    """Most frequent words (stop words left out) and emoji; ties by token."""
    texts = _text_rows(rows)
    pattern = rf"[{LETTERS}]{{2,}}"
    word_rows = texts.select(
        F.explode_outer(F.regexp_extract_all(casefold(F.col("text")), F.lit(pattern), F.lit(0))).alias("token")
    ).filter(~F.col("token").isin(STYLE_STOP_WORDS))
    emoji_rows = texts.select(
        F.explode_outer(F.regexp_extract_all("text", F.lit(EMOJI_PATTERN), F.lit(0))).alias("token")
    )
    a = _top(word_rows, words, "top_words").withColumn("_one", F.lit(1))
    b = _top(emoji_rows, emoji, "top_emojis").withColumn("_one", F.lit(1))
    return a.join(b, "_one").drop("_one")


def profile_mix(rows: DataFrame) -> DataFrame:
    """One row: language shares in percent, the three busiest UTC hours, register counts."""
    langs = (
        rows.groupBy(F.coalesce("lang", F.lit("unknown")).alias("k"))
        .agg(F.count("*").alias("c"))
        .agg(
            F.sum("c").alias("n"),
            F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), "k"))).alias("l"),
        )
        .select(
            F.map_from_entries(
                F.transform(
                    "l",
                    lambda x: F.struct(x["k"], F.bround(-100 * x["o"] / F.col("n")).cast("int")),
                )
            ).alias("languages")
        )
        .withColumn("_one", F.lit(1))
    )
    hours = (
        rows.groupBy(F.hour("ts").alias("h"))
        .agg(F.count("*").alias("c"))
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("o"), "h"))).alias("l"))
        .select(F.slice(F.col("l.h"), 1, 3).alias("peak_hours_utc"))
        .withColumn("_one", F.lit(1))
    )
    registers = (
        rows.groupBy("register")
        .agg(F.count("*").alias("c"))
        .agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("register", "c")))).alias(
                "registers"
            )
        )
        .withColumn("_one", F.lit(1))
    )
    return langs.join(hours, "_one").join(registers, "_one").drop("_one")


def fingerprint(messages: DataFrame, n: int = NEWEST) -> DataFrame:
    """style_stats, top_tokens and profile_mix as one row."""
    rows = style_rows(messages, n)
    parts = [p(rows).withColumn("_one", F.lit(1)) for p in (style_stats, top_tokens, profile_mix)]
    return parts[0].join(parts[1], "_one").join(parts[2], "_one").drop("_one")


def fingerprint_markdown() -> Column:
    """The fingerprint row as a Markdown list."""
    c = F.col
    langs = F.array_join(
        F.transform(
            F.map_entries("languages"),
            lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string"), F.lit("%")),
        ),
        ", ",
    )
    mostly = F.when(
        F.size("top_emojis") > 0,
        F.concat(F.lit(" (mostly "), F.array_join("top_emojis", " "), F.lit(").")),
    ).otherwise(".")
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("- Typical text message: "), c("median_words").cast("string"),
            F.lit(" words (mean "), c("mean_words").cast("string"), F.lit(")."),
        ),
        F.concat(
            F.lit("- Starts lowercase "), c("lowercase_start_pct").cast("string"),
            F.lit("% of the time; ends with punctuation "),
            c("ends_with_punctuation_pct").cast("string"), F.lit("%."),
        ),
        F.concat(
            F.lit("- Uses emoji in "), c("emoji_pct").cast("string"), F.lit("% of messages"), mostly
        ),
        F.concat(F.lit("- Languages: "), langs, F.lit(".")),
        F.concat(
            F.lit("- Favourite words: "), F.array_join(F.slice("top_words", 1, 15), ", "), F.lit(".")
        ),
    )


def sample_messages(messages: DataFrame, k: int = 60, seed: int = 7) -> DataFrame:
    """``k`` seeded draws from my newest 3000 messages of 4 to 60 words."""
    mine = messages.filter(F.col("is_me") & F.col("word_count").between(4, 60))
    pool = newest(mine.select("id", "register", "text", "ts"), 3000)
    return (
        pool.orderBy(seeded_order(seed, F.col("id")), "id")
        .limit(k)
        .select("id", F.concat(F.lit("["), "register", F.lit("] "), "text").alias("line"))
    )


def profile_document(
    messages: DataFrame,
    memories: DataFrame,
    name: str = "me",
    narrative: str = "",
    now_iso: Column | None = None,
) -> DataFrame:
    """The profile as one Markdown document; ``narrative`` comes from a model, if any."""
    now_iso = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if now_iso is None else now_iso
    live = (
        memories.filter(~F.col("archived"))
        .select("updated_at")
        .orderBy(F.col("updated_at").desc())
        .limit(150)
        .agg(F.count("*").alias("m"))
        .withColumn("_one", F.lit(1))
    )
    rows = fingerprint(messages).withColumn("_one", F.lit(1))
    section = [F.lit("## Profile"), F.lit(narrative), F.lit("")] if narrative else []
    both = live.join(rows, "_one", "left")
    style = F.when(F.col("n").isNotNull(), fingerprint_markdown()).otherwise("_No messages yet._")
    return both.select(
        F.concat_ws(
            "\n",
            F.lit(f"# {name}"),
            F.lit(""),
            F.lit("## Style fingerprint"),
            style,
            F.lit(""),
            *section,
            F.concat(
                F.lit("_Regenerated "), now_iso, F.lit(" from "),
                F.coalesce("n", F.lit(0)).cast("string"), F.lit(" messages and "),
                F.col("m").cast("string"), F.lit(" memories._"),
            ),
        ).alias("document")
    )
