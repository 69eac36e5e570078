"""Quality rules: Jensen-Shannon distance of a document to the histograms of its languages.

A profile has two histograms: character classes of the words (lower and upper case letters,
digits, and the punctuation families below) and common words (each of the most frequent words of a
language, and all others). References are sums over all documents of a language; documents that
fail the base rules do not enter them. A document is compared with every language and keeps the
best. It is rejected when it exceeds the threshold of every language. Short documents have noisy
histograms: below a full length a threshold grows as the distance of seeded draws from the language
itself does. A language with too few words for a reference leaves its documents unjudged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.arrays import frame, gram_hashes, slices, word_bounds, word_hashes
from palimpsest.session import materialize

CLASSES = 9
MIN_WORDS = 20  # below it a document fails
FULL_CLASS_CHARS = 200  # below it the threshold of the character classes grows
FULL_COMMON_WORDS = 200  # below it the threshold of the common words grows
MIN_REFERENCE_WORDS = 2000  # words of a language that has a reference, whatever the table's size
DRAWS = 400  # seeded draws per length
DRAWN_SHARE = 0.99  # of the draws that a threshold allows for
MAX_CLASS_DISTANCE = 0.34
MAX_COMMON_DISTANCE = 0.36
COMMON_WORDS = 64  # words with a count of their own in each language
WORD_CELLS = 1 << 14  # cells into which words are hashed to find the common ones
WINDOW = 8

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 3 if chr(_c) in ".,;:" else 4 if chr(_c) in "!?" else 5 if _SYMBOLS[_c] else 6
_CLASS[0xC0:] = 7  # first byte of any character beyond ASCII
_CLASS[0:33] = 8
_CLASS[127] = 8

_COUNT_FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
]


def repeated_words(hashed: np.ndarray, window: int = WINDOW) -> int:
    """Words inside ``window``-word runs that occur twice or more."""
    grams = gram_hashes(hashed, window)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    delta = np.zeros(len(hashed) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + window, -1)
    return int(np.count_nonzero(np.cumsum(delta[:-1]) > 0))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]
    return len(lines) - len(set(lines))


def measured(batches: Iterator[pa.RecordBatch]):
    """Per slice: ids, base counts per document, class histogram, and word cells per document."""
    for ids, raw, off in slices(batches):
        starts, ends = word_bounds(raw, off)
        hashed, exact = word_hashes(raw, starts, ends), word_hashes(raw, starts, ends, fold=False)
        edges = np.searchsorted(starts, off)
        # characters begin at every byte that is no continuation byte
        inside = np.zeros(len(raw) + 1, dtype=np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        first = ((raw & 0xC0) != 0x80) & (np.cumsum(inside[:-1]) > 0)
        chars = np.concatenate([[0], np.cumsum(first)])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[raw])])
        doc_of = np.repeat(np.arange(len(ids)), np.diff(off))
        classes = np.bincount(
            doc_of[first] * CLASSES + _CLASS[raw[first]], minlength=len(ids) * CLASSES
        ).reshape(len(ids), CLASSES)
        data = raw.tobytes()
        counts = {
            "n_words": np.diff(edges),
            "word_chars": chars[off[1:]] - chars[off[:-1]],
            "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
            "n_dup_lines": np.array(
                [repeated_lines(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.int64
            ),
            "n_repeat_words": np.array(
                [repeated_words(exact[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], np.int64
            ),
        }
        n = counts["n_words"]
        counts["base_failed"] = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > 30 * n)
        cells = (hashed >> np.uint64(64 - WORD_CELLS.bit_length() + 1)).astype(np.int64)
        yield ids, counts, classes, cells, edges


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of ``p`` to the histogram ``q``."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.where(total > 0, total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Language -> class histogram, cells of its common words, their histogram (others last).

    Every document with a language that passes the base rules is counted. The driver receives
    CLASSES + COMMON_WORDS + 1 sums per language; a language under MIN_REFERENCE_WORDS has none.
    """
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int64()), ("n", pa.int64())])

    def fn(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = iter(batch.column(2).to_pylist())
            for ids, counts, classes, cells, edges in measured(iter([batch])):
                for k in range(len(ids)):
                    lang = next(langs)
                    if lang is None or counts["base_failed"][k]:
                        continue
                    own = sums.setdefault(lang, np.zeros(CLASSES + WORD_CELLS, dtype=np.int64))
                    own[:CLASSES] += classes[k]
                    np.add.at(own, CLASSES + cells[edges[k] : edges[k + 1]], 1)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield frame(schema, lang=[lang] * len(at), kind=at, n=own[at])

    rows = (
        docs.select(
            F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
        )
        .mapInArrow(fn, "lang string, kind long, n long")
        .groupBy("lang", "kind")
        .agg(F.sum("n").alias("n"))
    )
    rows = materialize(rows)
    word = F.col("kind") >= CLASSES
    totals = {
        r["lang"]: r["n"]
        for r in rows.filter(word).groupBy("lang").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_REFERENCE_WORDS).collect()
    }
    turn = F.row_number().over(Window.partitionBy("lang", word).orderBy(F.desc("n"), "kind"))
    made = {lang: (np.zeros(CLASSES), [], []) for lang in totals}
    # a language has at most CLASSES + WORD_CELLS rows
    for r in rows.withColumn("turn", turn).filter(~word | (F.col("turn") <= COMMON_WORDS)).orderBy("lang", "turn").toLocalIterator():
        if r["lang"] in made:
            classes, common, counts = made[r["lang"]]
            if r["kind"] < CLASSES:
                classes[r["kind"]] = r["n"]
            else:
                common.append(r["kind"] - CLASSES)
                counts.append(r["n"])
    return {
        lang: (classes / classes.sum(), np.array(common), np.append(counts, totals[lang] - sum(counts)) / totals[lang])
        for lang, (classes, common, counts) in made.items()
    }


def thresholds(histogram: np.ndarray, full: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, thresholds): ``most`` from ``full`` on, below it more by what draws from
    ``histogram`` are farther from it than at ``full``; squared distances add up."""
    lengths = np.unique(np.geomspace(MIN_WORDS, full, 12).astype(int))
    rnd = np.random.default_rng(full)
    drawn = [
        np.quantile(divergence(rnd.multinomial(n, histogram, DRAWS).astype(float), histogram) ** 2, DRAWN_SHARE)
        for n in lengths
    ]
    return lengths, np.sqrt(most**2 + np.maximum(0, np.array(drawn) - drawn[-1]))


def quality(docs: DataFrame) -> DataFrame:
    """Base counts, distances and the verdict of every row of ``docs``.

    Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, common_distance (null below MIN_WORDS words, where the own language or every one
    lacks a reference). A null text has no words and fails. Repeated rows are judged each. Reads
    doc_id, text and lang; lang says which reference a document feeds, null feeds none.
    """
    known = references(docs)
    bounds = {
        lang: (
            thresholds(reference, FULL_CLASS_CHARS, MAX_CLASS_DISTANCE),
            thresholds(histogram, FULL_COMMON_WORDS, MAX_COMMON_DISTANCE),
        )
        for lang, (reference, _, histogram) in known.items()
    }
    schema = pa.schema(
        [("doc_id", pa.int64()), *_COUNT_FIELDS, ("kept", pa.bool_()),
         ("class_distance", pa.float64()), ("common_distance", pa.float64())]
    )

    def fn(batches):
        for batch in batches:
            langs, at = batch.column(2).to_pylist(), 0
            for ids, counts, classes, cells, edges in measured(iter([batch])):
                n = len(ids)
                own, at = langs[at : at + n], at + n
                near, fits = np.full((2, n), np.inf), np.zeros((2, n), dtype=bool)
                doc_of = np.repeat(np.arange(n), np.diff(edges))
                for lang, (reference, common, histogram) in known.items():
                    place = np.full(WORD_CELLS, len(common))
                    place[common] = np.arange(len(common))
                    words = np.bincount(
                        doc_of * (len(common) + 1) + place[cells], minlength=n * (len(common) + 1)
                    ).reshape(n, -1)
                    for k, (held, wanted, size) in enumerate(
                        [(classes, reference, classes.sum(axis=1)), (words, histogram, counts["n_words"])]
                    ):
                        far = divergence(held.astype(float), wanted)
                        near[k] = np.minimum(near[k], far)
                        fits[k] |= far <= np.interp(size, *bounds[lang][k])
                unknown = np.array([x is not None and x not in known for x in own], dtype=bool)
                near[:, unknown | (counts["n_words"] < MIN_WORDS)] = np.inf
                judged = np.isfinite(near)
                yield frame(
                    schema,
                    doc_id=ids,
                    **counts,
                    kept=~counts["base_failed"] & ~(judged & ~fits).any(axis=0),
                    class_distance=pa.array(near[0], mask=~judged[0]),
                    common_distance=pa.array(near[1], mask=~judged[1]),
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(
        fn,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, kept boolean, class_distance double, "
        "common_distance double",
    )
