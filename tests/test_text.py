from __future__ import annotations

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import commits, exports, identity, mail, memory_rules, text, vectors


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("  Hello​  wo\u0308rld\r\n\r\n\r\n\r\nfoo\tbar  ", "Hello wörld\n\nfoo bar"),
        ("a \u2028\nb\u00a0\u00a0c", "a\nb c"),
        ("", ""),
        (None, ""),
        ("\ufeffx\ufffc", "x"),
    ],
)
def test_clean_text(spark, raw, want):
    assert one(spark, text.clean_text, raw) == want


def test_nfc_is_needed_nowhere_the_pattern_misses():
    class_ = text._nfc_unstable_pattern()
    ranges = [
        (int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", class_)
    ]
    for cp in range(0x110000):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF or unicodedata.category(ch).startswith("M"):
            continue
        if not unicodedata.is_normalized("NFC", ch):
            assert any(lo <= cp <= hi for lo, hi in ranges), hex(cp)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("", "empty"),
        ("<Media omitted>", "media_placeholder"),
        ("IMG 1 image omitted", "media_placeholder"),
        ("he said image omitted in the long text", None),
        ("image omitted https://a.b/c www.d.e/f http://g.h i j", "media_placeholder"),
        ("https://x.y/z www.a.b", "url_only"),
        ("😀 👍🏽!!", "emoji_only"),
        ("ok 😀", None),
        ("a b c d https://image.omitted e", None),
    ],
)
def test_low_signal(spark, raw, want):
    assert one(spark, text.low_signal_reason, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("bu çok güzel ama", "tr"),
        ("this is what you got", "en"),
        ("12 34", None),
        ("xyzzy", None),
        ("i ö", "tr"),
        ("bu the", "en"),
    ],
)
def test_guess_lang(spark, raw, want):
    assert one(spark, text.guess_lang, raw) == want


def test_handles(spark):
    norm = lambda v: one(spark, identity.normalize_handle, v)
    assert norm(" +1 (555) 123-4567 ") == "+15551234567"
    assert norm("5551234567") == "+15551234567"
    assert norm("A@B.c") == "a@b.c"
    assert norm("Bob") == "bob"
    want = hashlib.sha256(b"s\x00+15551234567\x00").hexdigest()
    assert one(spark, lambda c: identity.handle_hash("s", c), "555 123 4567") == want


def test_holdout_formula(spark):
    rows = spark.range(2000).select("id", identity.in_holdout(F.col("id"), 0.3, 7).alias("h")).collect()
    for r in rows:
        digest = hashlib.sha256(f"7:{r['id']}".encode()).digest()
        assert r["h"] == (int.from_bytes(digest[:4], "little") % 10_000 < 3000)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("hi\n\nOn Mon, Bob\nwrote:\n> x", "hi"),
        ("yo\n> q\nmore\n-- \nsig", "yo\nmore"),
        ("a\nFrom: x\nSent: y\nz", "a"),
        ("a\nFrom: x\nplain\nb", "a\nFrom: x\nplain\nb"),
        ("see [image: foo] this", "see this"),
        ("x\n____________\nfooter", "x"),
        ("Sent from my phone", ""),
    ],
)
def test_email_body(spark, raw, want):
    assert one(spark, mail.clean_email_body, raw) == want


def test_subject_key(spark):
    assert one(spark, mail.subject_key, "RE: Fwd[2]: Ynt:  Hello   World") == "hello world"


def test_html():
    html = "<head><title>t</title></head><p>Hi &amp; <b>x</b><br>y</p><blockquote><p>q</p></blockquote>"
    assert mail.visible_text(html).split() == ["Hi", "&", "x", "y"]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("fix parser\n\nSigned-off-by: x", "fix parser"),
        ("Merge branch a", None),
        ("wip", None),
        ("bump foo from 1 to 2", None),
        ("x\nCo-authored-by: dependabot <a>", None),
    ],
)
def test_commit_messages(spark, raw, want):
    assert one(spark, commits.clean_commit_message, raw) == want


@pytest.mark.parametrize(
    "raw, kind, body",
    [
        ("Remember that my locker code is 4521", "number", "My locker code is 4521"),
        ("don't forget to call mom tomorrow", "event", "Call mom tomorrow"),
        ("hatırla: süt al", "note", "Süt al"),
        ("reminder: i need to pay", "todo", "I need to pay"),
        ("just remember", "note", "Just remember"),
    ],
)
def test_rule_memories(spark, raw, kind, body):
    got = one(spark, memory_rules.rule_memory, raw)
    assert (got["kind"], got["text"]) == (kind, body)


def test_no_rule_memory(spark):
    assert one(spark, memory_rules.rule_memory, "nothing to see") is None


def test_reply_items(spark):
    fenced = '```json\n{"memories":[{"text":"Likes tea","kind":"x"}]}\n```'
    assert len(one(spark, memory_rules.reply_items, fenced)) == 1
    assert one(spark, memory_rules.reply_items, "nope") == []


def test_export_lines(spark):
    head = one(spark, exports.header, "[1/2/24, 3:45:12 PM] Ali: hey")
    assert (head["date"], head["time"], head["rest"]) == ("1/2/24", "3:45:12 PM", "Ali: hey")
    assert one(spark, exports.header, "13.02.2024 15:45 - Ali: hey")["rest"] == "Ali: hey"
    assert one(spark, exports.header, "just text") is None
    said = one(spark, exports.sender_and_body, "Ali: ‎image omitted")
    assert said["body"] == "<Media omitted>"
    assert one(spark, exports.sender_and_body, "Ali: ‎You joined") is None


def test_chunks(spark):
    doc = "---\na: 1\n---\none two\n\n```py\ncode\n```\n\nthree four five\n\nsix"
    prose = one(spark, text.prose, doc)
    assert "code" not in prose and prose.startswith("one two")
    chunks = one(spark, lambda c: text.chunk_paragraphs(text.prose(c), 4), doc)
    assert chunks == ["one two", "three four five\n\nsix"]


def test_hash_vectors():
    v = vectors.hash_vectors(["a b", "a b", ""], 16)
    assert (v[0] == v[1]).all() and abs((v[0] ** 2).sum() - 1) < 1e-6 and (v[2] == 0).all()
