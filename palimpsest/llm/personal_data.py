"""Personal data: base patterns, and terms that give a protected value away.

Base spans are e-mail addresses, IPv4 addresses, payment card numbers and phone numbers, as the
patterns below define them. Protected entities are every distinct base value and, since most values
stand in one document only, its class: the domain of an address, the network (first three parts)
of an IP, the issuer (six digits) of a card, the prefix (four digits) of a phone number.

Terms are words and pairs of neighbouring words. Corpus co-occurrence, in documents, says how
strongly a term discloses an entity: of N documents n_t hold the term, n_e the entity, and n_te
have the term beside it (within ``REACH`` words). With p the lower bound of n_te / n_t
(Wilson, ``Z`` deviations),

    disclosure(term, entity) = log2(p N / n_e) / log2(N / n_e),

the share of the entity's information content that the term tells for sure; few documents give a
low bound. A term is disclosing if this reaches ``THRESHOLD`` for some entity and the words on the
left and those on the right of the entity both differ between its documents, so that copies of a
passage, edited on one side or not at all, are no evidence. Disclosing terms are spans of kind
``term`` wherever they stand, in every document, unless they touch a base span; sanitising removes
them and generalises base spans to the name of their kind.

All counts are over all documents, repeated rows included. Words are compared by 64-bit hashes,
A-Z as a-z. A bitmap keeps other terms from leaving their task; false hits fall away in a join.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import (
    frame,
    gram_hashes,
    slices,
    strings,
    word_bounds,
    word_hashes,
)
from palimpsest.session import materialize

KINDS = ("email", "ip", "card", "phone")
NEAR = ("entity", "term", "left", "right")
REACH = 6  # words on either side of a base span
Z = 1.0  # deviations of the lower bound
THRESHOLD = 0.9
BITMAP_WORDS = 1 << 14, 1 << 20  # 64-bit words of the bitmap of terms, least and most
BROADCAST_TERMS = 1 << 20  # terms (16 bytes each) sent to all executors at most

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, str]  # start, end (exclusive), kind


def emails(text: str) -> list[tuple[int, int]]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[tuple[int, int]]:
    """Every four numbers of a dotted run in turn; a part over 255 drops its match."""
    found = []
    for run in _DOTTED.finditer(text):
        if text.count(".", *run.span()) < 3:
            continue
        at, parts = run.start(), run.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((at, end))
            at = end + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The four kinds, each leftmost and non-overlapping; failing matches are dropped."""
    spans = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    spans += [(a, b, "ip") for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((*m.span(), "card"))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            spans.append((*m.span(), "phone"))
    return sorted(spans, key=lambda s: (s[0], (*KINDS, "term").index(s[2])))


def span_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _hashed(value: str) -> int:
    """Signed 64-bit hash of a protected value or class."""
    digest = hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def protected(kind: str, value: str) -> tuple[str, str]:
    """Names of the two entities of a base value: itself and its class."""
    if kind == "email":
        group = value[value.index("@") + 1 :].lower()
    elif kind == "ip":
        group = value[: value.rindex(".")]
    else:
        group = re.sub("[^0-9]", "", value)[: 6 if kind == "card" else 4]
    return f"{kind}:{value}", f"{kind} class:{group}"


class Words:
    """Words of a text: places in code points, hashes, and which touch no base span."""

    def __init__(self, text: str, spans: list[Span]):
        data = text.encode("utf-8", "replace")
        raw = np.frombuffer(data, dtype=np.uint8)
        self.first, self.last = starts, ends = word_bounds(raw, np.array([0, len(raw)]))
        if len(data) != len(text):  # code points before every byte
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            self.first, self.last = points[starts], points[ends]
        self.hashes = word_hashes(raw, starts, ends)
        begin = np.array([x for x, _, _ in spans], dtype=np.int64)
        top = np.array([0, *accumulate((y for _, y, _ in spans), max)], dtype=np.int64)
        self.free = top[np.searchsorted(begin, self.last, "left")] <= self.first

    def terms(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of the free words and pairs of free words among words a to b."""
        one = a + np.flatnonzero(self.free[a:b])
        two = a + np.flatnonzero(self.free[a : b - 1] & self.free[a + 1 : b]) if b - a > 1 else one[:0]
        pairs = gram_hashes(self.hashes[a:b], 2)[two - a] if len(two) else self.hashes[:0]
        return (
            np.concatenate([self.hashes[one], pairs]).view(np.int64),
            np.concatenate([self.first[one], self.first[two]]),
            np.concatenate([self.last[one], self.last[two + 1]]),
        )


def _beside(text: str, spans: list[Span]) -> list[tuple[int, int, int, int]]:
    """(entity, term, left, right) of the terms within REACH of each base span, each pair once.

    ``left`` and ``right`` are hashes of the words on either side.
    """
    words, found = Words(text, spans), {}
    for x, y, kind in spans:
        a, b = int(np.searchsorted(words.last, x, "right")), int(np.searchsorted(words.first, y, "left"))
        low, high = max(0, a - REACH), min(len(words.first), b + REACH)
        sides = [hash(tuple(words.hashes[p:q].tolist())) for p, q in ((low, a), (b, high))]
        near = np.concatenate([words.terms(low, a)[0], words.terms(b, high)[0]]).tolist()
        for name in protected(kind, text[x:y]):
            entity = _hashed(name)
            for term in near:
                found.setdefault((entity, term), (entity, term, *sides))
    return list(found.values())


def base_pass(docs: DataFrame) -> DataFrame:
    """Base spans of every row, its protected entities, and the words beside them."""
    near = pa.list_(
        pa.struct([(n, pa.int64()) for n in NEAR])
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64())]
        + [(f"n_{k}", pa.int64()) for k in KINDS]
        + [("base_sha256", pa.string()), ("base", pa.string()), ("entities", pa.list_(pa.int64())), ("near", near)]
    )

    def fn(batches):
        for batch in batches:
            hashes = batch.column(2).to_pylist()
            at = 0
            for ids, texts in strings(iter([batch])):
                rows: dict[str, list] = {f.name: [] for f in schema}
                for text in texts:
                    spans = base_spans(text)
                    kinds = [s[2] for s in spans]
                    base = span_text(spans)
                    for k in KINDS:
                        rows[f"n_{k}"].append(kinds.count(k))
                    rows["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
                    rows["base"].append(base)
                    names = {n for a, b, k in spans for n in protected(k, text[a:b])}
                    rows["entities"].append([_hashed(n) for n in names])
                    near_terms = _beside(text, spans) if spans else []
                    rows["near"].append([dict(zip(NEAR, x, strict=True)) for x in near_terms])
                rows["doc_id"], rows["text_hash"] = ids, hashes[at : at + len(texts)]
                at += len(texts)
                yield frame(schema, **rows)

    texts = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash")
    )
    return texts.mapInArrow(
        fn,
        "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
        "base string, entities array<long>, "
        "near array<struct<entity: long, term: long, left: long, right: long>>",
    )


def _bitmap(wanted: DataFrame) -> np.ndarray:
    """Bits of the terms in ``wanted``; its size follows their number between fixed bounds."""
    least, most = BITMAP_WORDS
    size = min(most, max(least, 1 << (wanted.count() // 8).bit_length()))
    bits = (
        wanted.groupBy(F.pmod("term", F.lit(size)).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(shiftright(term, 32), 64) as int))")).alias("bits"))
        .collect()
    )
    table = np.zeros(size, dtype=np.int64)
    for row in bits:
        table[row["word"]] = row["bits"]
    return table


def _in_bitmap(table: np.ndarray, terms: np.ndarray) -> np.ndarray:
    return (table[terms % len(table)] >> ((terms >> 32) % 64)) & 1 == 1


def term_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(term, n_t): documents that hold each wanted term, over all documents.

    The bitmap lets some other terms through; they are dropped by the caller's join. A pair of
    words counts within one document only; words that touch a base span count here.
    """
    table = _bitmap(wanted)
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def fn(batches):
        for _, raw, off in slices(batches):
            starts, ends = word_bounds(raw, off)
            words = word_hashes(raw, starts, ends)
            doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))
            inner = doc[1:] == doc[:-1]
            hashed = np.concatenate([words, gram_hashes(words, 2)[inner] if len(words) > 1 else words[:0]]).view(np.int64)
            doc = np.concatenate([doc, doc[1:][inner]])
            held = _in_bitmap(table, hashed)
            hashed, doc = hashed[held], doc[held]
            order = np.lexsort((doc, hashed))
            hashed, doc = hashed[order], doc[order]
            fresh = np.ones(len(hashed), dtype=bool)
            fresh[1:] = (hashed[1:] != hashed[:-1]) | (doc[1:] != doc[:-1])
            terms, counts = np.unique(hashed[fresh], return_counts=True)
            yield frame(schema, term=terms, n=counts)

    texts = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string"))
    return texts.mapInArrow(fn, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def disclosing(docs: DataFrame, base: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(entity, term, n_te, n_t, n_e, disclosure) of the terms that give a protected value away.

    Documents are counted only for terms that could still reach the threshold: n_t is at least the
    number of documents that have the term beside any base value, and disclosure falls with n_t.
    """
    total = base.count()
    near = base.select(F.explode("near").alias("x")).select("x.*")
    pairs = (
        near.groupBy("entity", "term")
        .agg(
            F.count("*").alias("n_te"),
            (F.min("left") < F.max("left")).alias("lefts"),
            (F.min("right") < F.max("right")).alias("rights"),
        )
        .filter("lefts and rights")
        .select("entity", "term", "n_te")
    )
    beside = (
        base.select(F.explode(F.array_distinct(F.col("near.term"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_t"))
    )
    entities = base.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    strong = materialize(
        pairs.join(entities, "entity").join(beside, "term").filter(_share(total) >= threshold).drop("n_t")
    )
    counts = term_counts(docs, strong.select("term").distinct())
    return (
        strong.join(counts, "term")
        .withColumn("disclosure", _share(total))
        .filter(F.col("disclosure") >= threshold)
        .select("entity", "term", "n_te", "n_t", "n_e", "disclosure")
    )


def _share(total: int) -> Column:
    """disclosure(term, entity) from n_te, n_t and n_e; null for an entity in every document."""
    n, k, z = F.col("n_t").cast("double"), F.least("n_te", "n_t").cast("double"), Z * Z
    low = (k + z / 2 - Z * F.sqrt(k * (n - k) / n + z / 4)) / (n + z)
    content = F.log2(F.lit(total) / F.col("n_e"))
    return F.when(content > 0, F.log2(low * total / F.col("n_e")) / content)


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_hash, terms): places of the terms in ``terms`` in every distinct text that holds one."""
    wanted = materialize(terms.select("term").distinct())
    few = wanted.count() <= BROADCAST_TERMS
    table = _bitmap(wanted)
    schema = pa.schema([(n, pa.int64()) for n in ("text_hash", "term", "s", "e")])

    def fn(batches):
        for hashes, raw, off in slices(batches, id_name="text_hash"):
            starts, ends = word_bounds(raw, off)
            words = word_hashes(raw, starts, ends).view(np.int64)
            held = _in_bitmap(table, words)
            if len(words) > 1:
                held[:-1] |= _in_bitmap(table, gram_hashes(words.view(np.uint64), 2).view(np.int64))
            for i in np.unique(np.searchsorted(off, starts[held], "right") - 1):
                text = raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")
                found = Words(text, base_spans(text))
                term, s, e = found.terms(0, len(found.first))
                hit = _in_bitmap(table, term)
                yield frame(
                    schema, text_hash=[hashes[int(i)].as_py()] * int(hit.sum()), term=term[hit], s=s[hit], e=e[hit]
                )

    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    hits = texts.mapInArrow(fn, "text_hash long, term long, s long, e long")
    return (
        hits.join(F.broadcast(wanted) if few else wanted, "term")
        .select("text_hash", "s", "e").distinct()
        .groupBy("text_hash")
        .agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("terms"))
    )


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs``.

    Offsets count code points, ends are exclusive; spans holds base and ``term`` spans by start,
    then kind; term spans may overlap each other. A null text is empty and has no spans. Repeated
    rows are reported each. Other columns are not read.
    """
    base = materialize(base_pass(docs))
    terms = term_spans(docs, disclosing(docs, base, threshold))
    parsed = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(
            F.split(x, ":")[1].cast("long").alias("s"),
            F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).alias("k"),
            x.alias("text"),
        ),
    )
    added = F.transform(
        F.coalesce("terms", F.array().cast("array<struct<s: long, e: long>>")),
        lambda x: F.struct(
            x.s.alias("s"),
            F.lit(len(KINDS) + 1).cast("long").alias("k"),
            F.concat_ws(":", F.lit("term"), x.s, x.e).alias("text"),
        ),
    )
    spans = F.array_join(F.transform(F.sort_array(F.concat(parsed, added)), lambda x: x.text), ",")
    return base.join(terms, "text_hash", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans")
    )


def sanitise(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with base spans generalised to their kind and disclosing words removed.

    Texts without spans stay as they are; a null text stays null. If the table has n_chars, it is
    the length of the new text. All columns and rows stay.
    """
    base = materialize(base_pass(docs))
    terms = term_spans(docs, disclosing(docs, base, threshold))
    named = docs.withColumn("_hash", F.xxhash64("text")).join(
        terms.select(F.col("text_hash").alias("_hash"), F.col("terms").alias("_terms")), "_hash", "left"
    )

    @F.pandas_udf("string")
    def rewritten(texts, terms):
        return texts.combine(terms, _rewrite)

    flat = F.when(F.col("_terms").isNotNull(), F.array_join(F.transform("_terms", lambda x: F.concat_ws(":", x.s, x.e)), ","))
    named = named.withColumn("text", rewritten(F.col("text").cast("string"), F.coalesce(flat, F.lit(""))))
    if "n_chars" in docs.columns:
        named = named.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return named.select(*docs.columns)


def _rewrite(text: str | None, terms: str) -> str | None:
    if text is None:
        return None
    spans = base_spans(text)
    spans += [(*map(int, x.split(":")), "term") for x in terms.split(",") if x]
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], "" if kind == "term" else f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text
