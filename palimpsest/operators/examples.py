"""Chat-formatted training examples with counted skip reasons and a leakage-safe holdout."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.identity import in_holdout, seeded_order
from palimpsest.functions.prompts import STANDALONE_KINDS, setting, standalone_instruction, system_prompt
from palimpsest.functions.text import low_signal_reason, word_count
from palimpsest.operators.scale import bucketed_rank
from palimpsest.operators.turns import CONV, alternate, build_turns, fit_context, with_context
from palimpsest.session import materialize

CHARS_PER_TOKEN = 4
PROMPT_RESERVE = 600
TURNS_PER_RANK_BLOCK = 10_000


@dataclass(frozen=True)
class ExampleConfig:
    name: str = "me"
    max_seq_len: int = 2048
    context_window: int = 8
    min_target_words: int = 2
    max_target_words: int = 400
    registers: tuple[str, ...] = ("text", "email", "speech", "doc")
    include_chat_turns: bool = False
    include_openers: bool = True
    max_per_conversation: int = 3000
    holdout_fraction: float = 0.05
    seed: int = 7
    base_model: str = ""
    extra: dict = field(default_factory=dict)

    def as_dict(self) -> dict:
        return asdict(self)


def message_origin(meta: Column) -> Column:
    """``origin`` of a JSON meta text; malformed JSON gives NULL."""
    return F.get_json_object(meta, "$.origin")


def training_rows(
    messages: DataFrame,
    cutoff: str | None = None,
    registers: tuple[str, ...] = ExampleConfig.registers,
    include_chat: bool = False,
) -> DataFrame:
    """Messages in the wanted registers, up to ``cutoff``, without chats with the assistant."""
    rows = messages.filter(F.col("register").isin(*registers))
    if cutoff:
        rows = rows.filter(F.col("ts") <= F.lit(cutoff).cast("timestamp"))
    if not include_chat and "meta" in messages.columns:
        origin = message_origin(F.col("meta"))
        rows = rows.filter(origin.isNull() | (origin != "chat"))
    return rows


def with_sender_names(messages: DataFrame, contacts: DataFrame) -> DataFrame:
    """Left join of display names; Spark broadcasts ``contacts`` when its size allows."""
    names = contacts.select(
        F.col("id").alias("contact_id"), F.col("display_name").alias("sender_name")
    )
    return messages.join(names, "contact_id", "left")


def conversations_with_mine(
    conversations: DataFrame, sources: DataFrame, messages: DataFrame
) -> DataFrame:
    """Conversations that hold at least one of my messages, with their source."""
    # Distinct first: the semi join then sees one row per conversation, however hot.
    mine = messages.filter("is_me").select(F.col(CONV).alias("id")).distinct()
    src = sources.select(
        F.col("id").alias("source_id"),
        F.col("kind").alias("source_kind"),
        F.col("label").alias("source_label"),
    )
    return (
        conversations.join(mine, "id", "left_semi")
        .join(src, "source_id")
        .select("id", "title", "is_group", "source_kind", "source_label")
    )


def target_reason(text: Column, min_words: int = 2, max_words: int = 400) -> Column:
    """Why a turn cannot be a target, or NULL."""
    words = word_count(text)
    return (
        F.when(words < min_words, "target_too_short")
        .when(words > max_words, "target_too_long")
        .when(low_signal_reason(text).isNotNull(), "low_signal")
    )


def assemble(turns: DataFrame, cfg: ExampleConfig = ExampleConfig()) -> DataFrame:
    """Chat messages for every turn of mine, with ``skip_reason`` where there is no example.

    Needs the columns of ``with_context(build_turns(..))`` plus title, is_group, source_kind
    and all_mine.
    """
    budget = F.lit(cfg.max_seq_len * CHARS_PER_TOKEN - PROMPT_RESERVE) - F.length("text")
    rows = (
        turns.filter(F.col("role") == "assistant")
        .withColumn(
            "skip_reason", target_reason(F.col("text"), cfg.min_target_words, cfg.max_target_words)
        )
        .withColumn("context", F.when(F.col("skip_reason").isNull(), fit_context(F.col("context"), budget)))
    )
    standalone = F.col("source_kind").isin(STANDALONE_KINDS) | F.col("all_mine")
    last_role = F.try_element_at(F.col("context"), F.lit(-1))["role"]
    opener = standalone | (F.size("context") == 0) | (last_role != "user")
    rows = rows.withColumn("_opener", opener)
    if not cfg.include_openers:
        rows = rows.withColumn(
            "skip_reason",
            F.coalesce(
                F.col("skip_reason"), F.when(F.col("_opener") & ~standalone, F.lit("no_context"))
            ),
        )
    ask = standalone_instruction(F.col("register"), F.col("title"))
    prior = F.array_join(F.col("context.text"), "\n")
    asked = F.when(F.size("context") > 0, F.concat(prior, F.lit("\n\n"), ask)).otherwise(ask)
    message = lambda role, content: F.struct(
        F.lit(role).alias("role"), content.alias("content")
    )
    names = F.when(F.col("_opener"), F.array().cast("array<string>")).otherwise(
        F.flatten(F.col("context.names"))
    )
    head = message(
        "system",
        system_prompt(
            cfg.name,
            F.col("register"),
            F.col("lang"),
            setting(F.col("source_kind"), F.col("title"), F.col("is_group"), names),
        ),
    )
    middle = F.when(F.col("_opener"), F.array(message("user", asked))).otherwise(
        alternate(F.col("context"))
    )
    return rows.withColumn("n_context", F.size("context")).withColumn(
        "messages",
        F.when(
            F.col("skip_reason").isNull(),
            F.concat(F.array(head), middle, F.array(message("assistant", F.col("text")))),
        ),
    )


def dedup_examples(rows: DataFrame) -> DataFrame:
    """Keep the first example in (conversation, turn) order for each (last user text, target).

    One aggregate with map-side combine, so copies collapse before the shuffle. Skipped rows
    fold into one row per reason. ``n`` is the number of rows folded together.
    """
    prompt = F.try_element_at(F.col("messages"), F.lit(-2))["content"]
    key = F.when(
        F.col("skip_reason").isNull(),
        F.sha2(F.concat(prompt, F.lit("\x00"), F.col("text")), 256),
    ).otherwise(F.concat(F.lit("skip:"), F.col("skip_reason")))
    payload = F.struct(
        CONV,
        "turn_no",
        "messages",
        "register",
        "lang",
        "ts",
        "n_context",
        F.col("source_kind").alias("source"),
        word_count(F.col("text")).alias("n_words"),
    )
    first = F.min_by(
        F.when(F.col("skip_reason").isNull(), payload), F.struct(CONV, "turn_no")
    )
    return (
        rows.groupBy(key.alias("example_key"))
        .agg(first.alias("_e"), F.first("skip_reason").alias("skip_reason"), F.count("*").alias("n"))
        .select("example_key", "skip_reason", "n", "_e.*")
    )


def cap_per_conversation(examples: DataFrame, cap: int = 3000) -> DataFrame:
    """Mark kept examples beyond ``cap`` per conversation, in turn order, as conversation_cap."""
    kept = examples.filter("skip_reason is null").select(CONV, "turn_no")
    crowded = kept.groupBy(CONV).agg(F.count("*").alias("_n")).filter(F.col("_n") > cap)
    ranked = bucketed_rank(
        kept.join(crowded.select(CONV), CONV, "left_semi"),
        [CONV],
        F.floor(F.col("turn_no") / TURNS_PER_RANK_BLOCK),
        [F.col("turn_no")],
        "_rank",
    )
    over = ranked.filter(F.col("_rank") > cap).select(CONV, "turn_no", F.lit(True).alias("_over"))
    return (
        examples.join(over, [CONV, "turn_no"], "left")
        .withColumn(
            "skip_reason",
            F.coalesce(F.col("skip_reason"), F.when(F.col("_over"), F.lit("conversation_cap"))),
        )
        .drop("_over")
    )


def labelled_examples(
    messages: DataFrame,
    conversations: DataFrame,
    cfg: ExampleConfig = ExampleConfig(),
    cutoff: str | None = None,
) -> DataFrame:
    """Deduplicated examples with holdout flag, plus one row per skip reason.

    ``conversations``: conversation_id, title, is_group, source_kind.
    """
    rows = training_rows(messages, cutoff, cfg.registers, cfg.include_chat_turns)
    turns = build_turns(rows, conversations)
    examples = dedup_examples(assemble(with_context(turns, cfg.context_window), cfg))
    return examples.withColumn(
        "is_holdout", in_holdout(F.col(CONV), cfg.holdout_fraction, cfg.seed)
    )


def build_examples(
    messages: DataFrame,
    conversations: DataFrame,
    cfg: ExampleConfig = ExampleConfig(),
    cutoff: str | None = None,
) -> DataFrame:
    """The final examples (train and holdout).

    The labelled rows are read twice by the cap, so they are checkpointed first.
    """
    rows = materialize(labelled_examples(messages, conversations, cfg, cutoff))
    return (
        cap_per_conversation(rows, cfg.max_per_conversation)
        .filter("skip_reason is null")
        .drop("skip_reason", "n", "example_key")
    )


def dataset_stats(examples: DataFrame) -> DataFrame:
    """One row of totals from capped, labelled examples (see ``labelled_examples``).

    Every row becomes a few (tag, key, value) entries which fold map-side; one final row is
    built from the folded entries. Copies folded into an example count as duplicates. Times are
    only compared: their sum would pass a long.
    """
    kept = F.col("skip_reason").isNull()
    capped = F.coalesce(F.col("skip_reason") == "conversation_cap", F.lit(False))
    train = kept & ~F.col("is_holdout")
    one = F.lit(1).cast("long")

    def entry(tag: str, key: Column, value: Column, condition: Column) -> Column:
        return F.when(
            condition,
            F.struct(F.lit(tag).alias("tag"), key.alias("key"), value.cast("long").alias("v")),
        )

    entries = F.array(
        entry("register", F.col("register"), one, train),
        entry("lang", F.coalesce("lang", F.lit("unknown")), one, train),
        entry("skip", F.col("skip_reason"), F.when(capped, one).otherwise(F.col("n")), ~kept),
        entry("skip", F.lit("duplicate"), F.col("n") - 1, (kept | capped) & (F.col("n") > 1)),
        entry("conversation", F.col(CONV).cast("string"), one, kept | capped),
        entry("n", F.when(train, "train").otherwise("holdout"), one, kept),
        entry("n", F.lit("words"), F.col("n_words"), train),
        entry("ts", F.lit("ts"), F.unix_micros("ts"), kept),
    )
    folded = (
        examples.select(F.explode_outer(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
        .filter("e is not null")
        .groupBy("e.tag", "e.key")
        .agg(F.sum(F.when(F.col("e.tag") != "ts", F.col("e.v"))).alias("total"), F.max("e.v").alias("top"))
    )

    def as_map(tag: str) -> Column:
        pairs = F.collect_list(F.when(F.col("tag") == tag, F.struct("key", "total")))
        return F.map_from_entries(F.array_sort(pairs))

    def number(key: str) -> Column:
        hit = (F.col("tag") == "n") & (F.col("key") == key)
        return F.coalesce(F.sum(F.when(hit, F.col("total"))), F.lit(0))

    return folded.agg(
        number("train").alias("n_examples"),
        number("holdout").alias("n_holdout"),
        number("words").alias("n_words"),
        F.timestamp_micros(F.max(F.when(F.col("tag") == "ts", F.col("top")))).alias("data_cutoff"),
        F.count_if(F.col("tag") == "conversation").alias("conversations"),
        as_map("register").alias("by_register"),
        as_map("lang").alias("by_lang"),
        as_map("skip").alias("skipped"),
    )


def shuffled(examples: DataFrame, seed: int = 7) -> DataFrame:
    """Seeded order by hash: a distributed range sort, stable across runs."""
    return examples.orderBy(seeded_order(seed, F.col(CONV), F.col("turn_no")), CONV, "turn_no")


def preview(examples: DataFrame, n: int = 5, seed: int = 7) -> DataFrame:
    """A seeded sample of ``n`` training examples, split into system, context and target."""
    order = seeded_order(seed, F.col(CONV), F.col("turn_no"))
    m = F.col("messages")
    return (
        examples.filter(~F.col("is_holdout"))
        .orderBy(order, CONV, "turn_no")
        .limit(n)
        .select(
            CONV,
            "turn_no",
            F.get(m, F.lit(0))["content"].alias("system"),
            F.slice(m, F.lit(2), F.size(m) - 2).alias("context"),
            F.try_element_at(m, F.lit(-1))["content"].alias("target"),
        )
    )
