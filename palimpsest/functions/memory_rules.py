"""Rules that turn an utterance or a model reply into short memories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import WS, strip
from palimpsest.schema import MEMORY_KINDS

# --- fixed values -----------------------------------------------------------------------
# \b and (?i) follow Unicode words with the flags (?iuU).
TRIGGERS = [
    r"\bremember\b(?:\s+(?:this|that|to))?[:,]?\s*",
    r"\bnote\b(?:\s+(?:this|that|to self))?[:,]?\s*",
    r"\bdon'?t forget\b(?:\s+(?:this|that|to))?[:,]?\s*",
    r"\bdo not forget\b(?:\s+(?:this|that|to))?[:,]?\s*",
    r"\breminder\b[:,]?\s*",
    r"\bhat[ıi]rla\b[:,]?\s*",
    r"\bnot al\b[:,]?\s*",
    r"\bunutma\b[:,]?\s*",
    r"\bbunu (?:not et|kaydet|hat[ıi]rla)\b[:,]?\s*",
]
TRIGGER = "|".join(f"(?:{t})" for t in TRIGGERS)
NUMBER = r"(?U)(?<![\w.])(?:\+?\d[\d\s().-]{2,}\d)(?![\w.])"
TODO = (
    r"(?iuU)\b(?:to do|todo|i need to|i have to|i should|remind me to|yapmam lazım|yapmalıyım)\b"
)
TIME = (
    r"(?iuU)\b(?:today|tomorrow|tonight|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    r"|next week|bugün|yarın|pazartesi|salı|çarşamba|perşembe|cuma|cumartesi|pazar"
    r"|at \d{1,2}(?::\d{2})?\s*(?:am|pm)?)\b"
)
# ----------------------------------------------------------------------------------------


def memory_kind(body: Column) -> Column:
    """number, then event, then to-do, else note."""
    return (
        F.when(body.rlike(NUMBER), "number")
        .when(body.rlike(TIME), "event")
        .when(body.rlike(TODO), "todo")
        .otherwise("note")
    )


def rule_memory(text: Column) -> Column:
    """struct(text, kind, confidence) for an explicit request to remember, else NULL."""
    flat = strip(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{WS}]+", " "))
    # Everything after the first trigger; the lazy prefix finds the leftmost match.
    after = F.regexp_extract(flat, rf"(?iuUs)^.*?(?:{TRIGGER})(.*)$", 1)
    body = F.regexp_replace(after, r"^[ ,.:;-]+|[ ,.:;-]+\z", "")
    body = F.when(F.length(body) < 2, flat).otherwise(body)
    body = F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, 2, 1 << 30))
    return F.when(
        flat.rlike(rf"(?iuU){TRIGGER}"),
        F.struct(body.alias("text"), memory_kind(body).alias("kind"), F.lit(1.0).alias("confidence")),
    )


_ITEMS = T.ArrayType(T.StringType())


def reply_json(reply: Column) -> Column:
    """The JSON object in a model reply, tolerating fences and chatter; NULL if there is none."""
    bare = strip(reply)
    fenced = F.regexp_replace(F.regexp_replace(bare, "^`+|`+\\z", ""), "^json", "")
    body = F.when(bare.startswith("```"), fenced).otherwise(bare)
    whole = F.when(F.try_parse_json(body).isNotNull(), strip(body))
    inner = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def reply_items(reply: Column) -> Column:
    """The first 8 raw entries of ``memories`` in a reply, as JSON texts."""
    listed = F.from_json(F.get_json_object(reply_json(reply), "$.memories"), _ITEMS)
    return F.slice(F.coalesce(listed, F.array().cast(_ITEMS)), 1, 8)


def candidate(item: Column) -> Column:
    """struct(text, kind, confidence) of one entry with defaults filled in."""
    kind = F.get_json_object(item, "$.kind")
    stated = F.get_json_object(item, "$.confidence").try_cast("double")
    return F.struct(
        strip(F.coalesce(F.get_json_object(item, "$.text"), F.lit(""))).alias("text"),
        F.when(kind.isin(*MEMORY_KINDS), kind).otherwise("fact").alias("kind"),
        F.coalesce(stated, F.lit(0.7)).alias("confidence"),
    )
