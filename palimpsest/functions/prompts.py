"""Prompt texts for training examples and retrieval-backed chat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import strip

# --- fixed values -----------------------------------------------------------------------
TRAIN_HINTS = {
    "text": "Text messages: short, casual, punctuation and capitalisation as you actually type them.",
    "email": "Email: complete sentences, a greeting and sign-off where you would normally use them.",
    "speech": "Spoken words, transcribed: reply the way it would be said out loud.",
    "doc": "Written prose or notes: paragraphs, considered wording.",
}
CHAT_HINTS = {
    "text": "This is a text message conversation: short, casual, lowercase is fine, no sign-off.",
    "email": "This is an email: complete sentences, a greeting and a sign-off where natural.",
    "speech": "This is spoken conversation: reply the way it would be said out loud.",
    "doc": "This is written prose: paragraphs, considered wording.",
}
LANG_NAMES = {"en": "English", "tr": "Turkish"}
OPENERS = {
    "doc": "Write the next piece",
    "speech": "Say what you were going to say",
    "text": "Write the note",
    "email": "Write the email",
}
EMAIL_KINDS = ["email", "email_mbox", "email_emlx", "email_imap"]
STANDALONE_KINDS = ["git", "doc", "docs", "capture"]
# ----------------------------------------------------------------------------------------


def _lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, default)


def system_prompt(name: str, register: Column, lang: Column, setting: Column) -> Column:
    who = (
        f"You are {name}. Write exactly as {name} would: same voice, wording, length and habits."
    )
    hint = strip(
        F.concat(
            F.lit("Register: "), register, F.lit(". "), _lookup(TRAIN_HINTS, register, F.lit(""))
        )
    )
    spoken = _lookup(LANG_NAMES, F.coalesce(lang, F.lit("")))
    language = F.concat(
        F.lit("Language: "), spoken, F.lit(f" (switch languages only if {name} would).")
    )
    where = F.when(F.coalesce(setting, F.lit("")) != "", F.concat(F.lit("Setting: "), setting))
    return F.concat_ws("\n", F.lit(who), hint, language, where)


def standalone_instruction(register: Column, title: Column) -> Column:
    what = _lookup(OPENERS, register, F.lit("Write"))
    return F.when(
        F.coalesce(title, F.lit("")) != "", F.concat(what, F.lit(" for: "), title)
    ).otherwise(F.concat(what, F.lit(".")))


def setting(kind: Column, title: Column, is_group: Column, names: Column) -> Column:
    """Where a conversation takes place, in words."""
    titled = F.when(
        F.coalesce(title, F.lit("")) != "", F.concat(F.lit(": "), title)
    ).otherwise("")
    others = F.substring(
        F.array_join(F.filter(names, lambda n: n.isNotNull() & ~n.isin("", "Them")), ", "), 1, 80
    )
    with_others = F.when(others != "", F.concat(F.lit(" with "), others)).otherwise("")
    return (
        F.when(kind.isin(EMAIL_KINDS), F.concat(F.lit("email thread"), titled))
        .when(is_group, F.concat(F.lit("group chat"), titled))
        .otherwise(F.concat(F.lit("1:1 "), kind, F.lit(" conversation"), with_others))
    )


def render_context(messages: Column, me: str = "Me") -> Column:
    """``Me:`` / ``Them:`` lines of a chat, system messages left out."""
    return F.array_join(
        F.transform(
            F.filter(messages, lambda m: m["role"] != "system"),
            lambda m: F.concat(
                F.when(m["role"] == "assistant", F.lit(me)).otherwise("Them"),
                F.lit(": "),
                m["content"],
            ),
        ),
        "\n",
    )


def chat_system_text(
    name: str,
    mode: str,
    register: str,
    personal: bool,
    profile_text: Column,
    memories: Column,
    exemplars: Column,
    now_iso: Column,
) -> Column:
    """System text of a retrieval-backed chat; blank sections are left out."""
    if mode == "twin":
        intro = [
            F.lit(
                f"You are {name}. Reply exactly as {name} would, in {name}'s own voice, wording "
                f"and habits, in whatever language {name} would use here. Never mention being an "
                f"AI. Do not explain; just answer the way {name} answers."
            ),
            F.lit(CHAT_HINTS.get(register) or None).cast("string"),
        ]
        if not personal:
            intro.append(
                F.lit(
                    "You do not have fine-tuned weights for this person, so lean heavily on the "
                    "examples of their real messages below: match their length, punctuation, "
                    "slang and tone."
                )
            )
    else:
        intro = [
            F.lit(
                f"You are {name}'s private personal assistant running on their own hardware. "
                f"Be concise and direct. Use the memories below when they are relevant and say "
                f"when you do not know something."
            ),
            F.concat(F.lit("Current time: "), now_iso),
        ]

    def bullets(title: str, texts: Column) -> Column:
        listed = F.array_join(F.transform(texts, lambda t: F.concat(F.lit("- "), t)), "\n")
        return F.when(F.size(texts) > 0, F.concat(F.lit(title + "\n"), listed))

    about = F.when(
        F.coalesce(profile_text, F.lit("")) != "",
        F.concat(F.lit(f"## About {name}\n"), profile_text),
    )
    return F.concat_ws(
        "\n\n",
        *intro,
        about,
        bullets("## Memories", memories),
        bullets(f"## Examples of how {name} actually writes", exemplars),
    )
