"""Text normalisation, word counting, low-signal filtering, language tagging, tokenizing.

All functions map Columns to a Column and stay inside the JVM, except canonical composition
(NFC), for which Spark has no function: only rows that can change are sent to Python.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Character classes equal to Python's str.isspace / \w / letters-without-digits, written out
# because Java's \s and \w are ASCII-only by default.
WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
LETTERS = r"\p{L}\p{Nl}\p{No}"
WORD = r"\p{L}\p{N}"

# --- fixed values -----------------------------------------------------------------------
MEDIA_PLACEHOLDERS = [
    "<media omitted>",
    "<medya dahil edilmedi>",
    "image omitted",
    "video omitted",
    "audio omitted",
    "sticker omitted",
    "gif omitted",
    "document omitted",
    "contact card omitted",
    "this message was deleted",
    "you deleted this message",
    "bu mesaj silindi",
    "missed voice call",
    "missed video call",
    "‎",
]
ZERO_WIDTH = "​‌‍⁠﻿‎‏￼"
URL_PATTERN = rf"(?i)https?://[^{WS}]+|www\.[^{WS}]+"
EMOJI_ONLY_PATTERN = (
    rf"^[{WS}\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{2B00}}-\x{{2BFF}}"
    r"\x{FE0F}\x{200D}\x{1F1E6}-\x{1F1FF}!?.,]+$"
)
EMOJI_PATTERN = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
TURKISH_LETTERS = "ğışİÇÖÜçöüĞŞ"
TURKISH_WORDS = (
    "ve bir bu için ama çok değil ne ben sen evet yok var mi mı mu mü da de ile gibi daha şey "
    "tamam iyi nasıl neden şimdi sonra biraz hadi abi canım olur yani işte kadar bende bana "
    "sana seni beni onu şu"
).split()
ENGLISH_WORDS = (
    "the and is you that it to of in for on with this have are was but not what just like yeah "
    "ok okay lol im i'm dont don't can will be so do me my your we they he she if or at from "
    "about got"
).split()
STYLE_STOP_WORDS = ENGLISH_WORDS + (
    "a an i its it's u ur ve bir bu ne ben sen de da ile ama çok için gibi daha var yok mi mı "
    "mu mü şey evet hayır tamam"
).split()
# ----------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _nfc_unstable_pattern() -> str:
    """A short class that covers every character whose presence means NFC might change a text.

    Derived by rule; close ranges are merged, so it also covers some stable characters.
    """
    composing_jamo = [(0x1161, 0x1175), (0x11A8, 0x11C2)]
    ranges: list[list[int]] = []
    for cp in range(0x300, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or unicodedata.category(chr(cp)).startswith("M"):
            continue
        stable = unicodedata.is_normalized("NFC", chr(cp))
        if stable and not any(lo <= cp <= hi for lo, hi in composing_jamo):
            continue
        if ranges and cp - ranges[-1][1] <= 0x80:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return r"[\p{M}" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges) + "]"


@pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column) -> Column:
    """Canonical composition. Rows that are already composed never leave the JVM."""
    beyond_latin = text.rlike(r"[^\x00-\x{2FF}]")
    return F.coalesce(_nfc(F.when(beyond_latin & text.rlike(_nfc_unstable_pattern()), text)), text)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used.

    Spark shares common subexpressions only where they are sure to be evaluated; branches and
    lambdas would compute them again.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+\z", "")


def casefold(text: Column) -> Column:
    """Lower case plus the full case foldings that occur in European text."""
    folded = F.translate(F.lower(text), "ſς", "sσ")
    for src, dst in (("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        folded = F.replace(folded, F.lit(src), F.lit(dst))
    return folded


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def clean_text(text: Column, compose: bool = True) -> Column:
    """Unicode and white-space normalisation that never changes wording.

    ``compose=False`` skips NFC for inputs known to be composed (keeps the plan in codegen).
    """
    t = F.coalesce(text, F.lit(""))
    if compose:
        t = nfc(t)
    t = unix_newlines(F.translate(t, ZERO_WIDTH, ""))
    t = F.regexp_replace(t, r"[ \t\xa0]+", " ")
    # (?d): only \n is a line end, so other separators are trimmed like spaces.
    inner = rf"[{WS}&&[^\n]]"
    t = F.regexp_replace(t, rf"(?md)^{inner}+|{inner}+$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters."""
    return F.regexp_count(text, F.lit(rf"[^{WS}]+")).cast("int")


def strip_urls(text: Column) -> Column:
    return strip(F.regexp_replace(text, URL_PATTERN, ""))


def low_signal_reason(text: Column) -> Column:
    """Why a text carries no signal (empty / media_placeholder / url_only / emoji_only) or NULL."""

    def judge(s: Column) -> Column:
        t, bare = s["t"], s["bare"]
        low = F.lower(t)
        holds_placeholder = F.lit(False)
        for marker in MEDIA_PLACEHOLDERS:
            holds_placeholder = holds_placeholder | low.contains(marker)
        return (
            F.when(t == "", "empty")
            .when((word_count(bare) <= 4) & holds_placeholder, "media_placeholder")
            .when(bare == "", "url_only")
            .when(t.rlike(EMOJI_ONLY_PATTERN), "emoji_only")
        )

    def full(t: Column) -> Column:
        return bind(F.struct(t.alias("t"), strip_urls(t).alias("bare")), judge)

    # Five leading words without an address leave more than four words: neither of the two
    # costly rules can apply, whatever follows. Most texts end here.
    plain_word = rf"(?![^{WS}]*?(?:https?://|www\.))[^{WS}]++[{WS}]+"
    wordy = rf"(?i)^(?:{plain_word}){{5}}[^{WS}]"
    return bind(
        strip(F.coalesce(text, F.lit(""))),
        lambda t: F.when(
            t.rlike(wordy), F.when(t.rlike(EMOJI_ONLY_PATTERN), F.lit("emoji_only"))
        ).otherwise(full(t)),
    )


def collapse_burst(texts: Column) -> Column:
    """Non-blank texts of an array, trimmed and joined by newlines."""
    return F.array_join(F.filter(F.transform(texts, strip), lambda t: t != ""), "\n")


def guess_lang(text: Column) -> Column:
    """``tr`` / ``en`` / NULL from stop-word hits and Turkish-only letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"[{LETTERS}]+"), F.lit(0))
    letters = F.length(text) - F.length(F.translate(text, TURKISH_LETTERS, ""))
    known = sorted({*TURKISH_WORDS, *ENGLISH_WORDS})
    # Few words are stop words: one pass finds them, two short ones tell the languages apart.
    hits = F.filter(words, lambda w: w.isin(known))
    scores = bind(
        hits,
        lambda h: F.struct(
            (F.size(F.filter(h, lambda w: w.isin(TURKISH_WORDS))) + letters).alias("tr"),
            F.size(F.filter(h, lambda w: w.isin(ENGLISH_WORDS))).alias("en"),
            letters.alias("letters"),
        ),
    )
    return bind(
        scores,
        lambda s: F.when((s["tr"] == 0) & (s["en"] == 0), F.lit(None))
        .when(s["tr"] > s["en"], "tr")
        .when(s["en"] > s["tr"], "en")
        .when(s["letters"] > 0, "tr")
        .otherwise("en"),
    )


# --- search tokens ----------------------------------------------------------------------


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Accented letters and the base letters they fold to (derived from decompositions)."""
    src, dst = [], []
    for cp in range(0xC0, 0x2000):
        base = unicodedata.normalize("NFD", chr(cp))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            if unicodedata.category(base[0]).startswith("L"):
                src.append(chr(cp))
                dst.append(base[0])
    return "".join(src), "".join(dst)


def fold_accents(text: Column) -> Column:
    src, dst = accent_table()
    return F.regexp_replace(F.translate(text, src, dst), r"\p{M}+", "")


def search_tokens(text: Column) -> Column:
    """Case- and accent-folded Unicode words, in order."""
    parts = F.split(fold_accents(F.lower(text)), rf"[^{WORD}]+")
    return F.filter(parts, lambda t: t != "")


def query_terms(text: Column) -> Column:
    """White-space separated query terms with quotes removed."""
    return F.filter(
        F.transform(F.split(text, rf"[{WS}]+"), lambda t: F.replace(t, F.lit('"'), F.lit(""))),
        lambda t: t != "",
    )


def comparison_tokens(text: Column) -> Column:
    """Distinct folded words used for near-duplicate comparison."""
    return F.array_distinct(
        F.filter(F.split(casefold(text), rf"[^{WORD}_]+"), lambda t: t != "")
    )


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token-set arrays; 0 when either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


# --- document prose ---------------------------------------------------------------------


def prose(text: Column) -> Column:
    """Document text without YAML front matter and fenced code."""
    t = unix_newlines(text)
    t = F.regexp_replace(t, r"(?s)\A---\n.*?\n---\n", "")
    t = F.regexp_replace(t, r"(?smd)^(```|~~~).*?^\1[^\n]*$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def chunk_paragraphs(text: Column, max_words: int = 1500) -> Column:
    """Whole text when short, else paragraphs packed greedily into chunks of ``max_words``."""
    empty = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.array().cast("array<string>").alias("open"),
        F.lit(0).alias("words"),
    )

    def add(acc: Column, para: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & (acc["words"] + para["n"] > max_words)
        joined = F.array(F.array_join(acc["open"], "\n\n"))
        return F.struct(
            F.when(full, F.concat(acc["done"], joined)).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(para["t"]))
            .otherwise(F.concat(acc["open"], F.array(para["t"])))
            .alias("open"),
            F.when(full, para["n"]).otherwise(acc["words"] + para["n"]).alias("words"),
        )

    paragraphs = F.filter(
        F.transform(
            F.split(text, rf"\n[{WS}]*\n"),
            lambda p: F.struct(strip(p).alias("t"), word_count(p).alias("n")),
        ),
        lambda p: p["t"] != "",
    )
    packed = F.aggregate(
        paragraphs,
        empty,
        add,
        lambda acc: F.when(
            F.size(acc["open"]) > 0,
            F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n\n"))),
        ).otherwise(acc["done"]),
    )
    nothing = F.array().cast("array<string>")
    return (
        F.when(strip(text) == "", nothing)
        .when(word_count(text) <= max_words, F.array(text))
        .otherwise(packed)
    )
