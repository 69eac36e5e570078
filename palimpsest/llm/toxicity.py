"""Toxicity: noisy-channel restoration of obfuscated words, then a linear score.

A word with signs or digits among its letters, or with a letter three times in a row, opens a
lattice: a sign may stand for the letters it looks like, a separator for nothing, a repeated letter
for one or two. Viterbi decoding picks the likeliest spelling under a letter trigram model whose
counts come from all documents. Other words have one spelling. Words with separators inside are
read parted and joined. A run of three or more tokens of one or two letters or signs, two of them
single, is a lattice of its own: each space is a word's end or nothing; all readings that are
close to the likeliest count.

Features of a document are its restored words and their beginnings, present or absent. Those
that tell toxic from other learning rows best are selected and weighed by logistic regression. The
classifier is fitted on a bounded sample of the learning rows (``SAMPLE_ROWS``).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import (
    UnitTable,
    frame,
    kept,
    over_texts,
    slices,
    word_bounds,
)
from palimpsest.session import materialize

SAMPLE_ROWS = 20_000  # labelled rows the classifier is fitted on, at most
FEATURE_CELLS = 1 << 18
SELECTED = 4096  # features with a weight, at most
MIN_TOXIC = 3  # toxic rows of a feature
RIDGE = 0.05
CUTOFF = 0.3
CACHED_WORDS = 1_000_000  # a worker forgets its words beyond that
SYMBOLS = 28  # 0: no letter, 1-26: a-z, 27: other letters

# Letters that a sign stands for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
}
SEPARATORS = ".-_*~'`^#,/:"
READ_SIGN = -0.5  # log-probabilities of the channel
DROP_SIGN = -8.0
DROP_SEPARATOR = -0.2
DROP_SECOND = -0.7
KEEP_SECOND = -0.7
DROP_SPACE = -0.7
KEEP_SPACE = -0.7
CLOSE = 6.0  # log-probability by which a reading of a spaced run may be behind
READINGS = 4  # of a spaced run, kept in each state

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[0xC3:] = 27
_SHORT = np.zeros(256, dtype=bool)  # bytes of tokens that may be parts of a spaced word
_SHORT[0x80:] = True
_SHORT[[c for c in range(128) if chr(c).isalnum() or chr(c) in SEPARATORS or chr(c) in LOOKS_LIKE]] = True
_TRIMMED = np.zeros(256, dtype=bool)  # signs around a token
_TRIMMED[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$_"]] = True
_APART = re.compile(f"[{re.escape(SEPARATORS)}]+")
_EDGE = re.compile(r"^[^\w@$]+|(?:[^\w@$]|([@$])\1)+$")
_NOISY = re.compile(r"[^\W\d_][^\w]*[\d@$!|+(.\-_*~'`^#,/:]|[\d@$!|+(][^\W\d_]|([^\W\d_])\1\1")


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Letter trigram counts of all documents; the driver receives at most SYMBOLS^3 numbers."""
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def fn(batches):
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for _, raw, off in slices(batches):
            kept = (raw & 0xC0) != 0x80
            s = np.concatenate([[0, 0], _SYMBOL[raw[kept]], [0]])
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield frame(schema, cell=at, n=total[at])

    rows = over_texts(docs, fn, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3)
    for row in rows.collect():
        counts[row["cell"]] = row["n"]
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def trigram_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of a letter after two others; unseen ones get a share of half a count."""
    return np.log((counts + 0.5) / (counts.sum(axis=2, keepdims=True) + 0.5 * SYMBOLS))


def readings(word: str, k: int) -> list[tuple[str, float]]:
    """What the k-th character may stand for, with the channel's log-probability."""
    c = word[k]
    if c.isalpha():
        if word[k - 1 : k] != c:
            return [(c, 0.0)]
        if word[k - 2 : k] == 2 * c:  # of three and more at most two stay
            return [("", 0.0)]
        return [("", DROP_SECOND), (c, KEEP_SECOND)] if word[k + 1 : k + 2] == c else [(c, 0.0)]
    found = [(letter, READ_SIGN) for letter in LOOKS_LIKE.get(c, "")]
    if found and word[k - 1 : k].isalpha() and word[k + 1 : k + 2].isalpha():
        return found  # between letters a sign is one itself
    return found + [("", DROP_SEPARATOR if c in SEPARATORS or not found else DROP_SIGN)]


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest spelling of a lower-cased noisy word."""
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for k in range(len(word)):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for letter, channel in readings(word, k):
                if letter:
                    c = code(letter)
                    key, total, way = (b, c), score + channel + model[a, b, c], (letter, path)
                else:
                    key, total, way = (a, b), score + channel, path
                if key not in after or total > after[key][0]:
                    after[key] = (total, way)
        states = after
    _, path = max(((s + model[a, b, 0], p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
    letters = []
    while path is not None:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters))


def spaced(run: str, model: np.ndarray) -> list[str]:
    """Words of the likeliest readings of a lower-cased run of short tokens, from three letters up."""
    code = lambda c: 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
    dense = run.replace(" ", "")
    states: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {(0, 0): [(0.0, None)]}
    k = 0
    for c in run:
        if c == " ":
            choices = [("", DROP_SPACE), (" ", KEEP_SPACE)]
        else:
            choices, k = readings(dense, k), k + 1
        after: dict[tuple[int, int], list[tuple[float, tuple | None]]] = {}
        for (a, b), kept in states.items():
            for letter, channel in choices:
                if letter == " " and b == 0:  # two ends of words are one
                    continue
                gain = channel + (model[a, b, code(letter)] if letter else 0.0)
                key = (b, code(letter)) if letter else (a, b)
                after.setdefault(key, []).extend(
                    (score + gain, (letter, path) if letter else path) for score, path in kept
                )
        states = {key: sorted(found, key=lambda x: -x[0])[:READINGS] for key, found in after.items()}
    ended = [(score + (model[a, b, 0] if b else 0.0), path) for (a, b), kept in states.items() for score, path in kept]
    best = max(score for score, _ in ended)
    words = set()
    for score, path in ended:
        if score >= best - CLOSE:
            letters = []
            while path is not None:
                letters.append(path[0])
                path = path[1]
            words.update(w for w in "".join(reversed(letters)).split(" ") if len(w) >= 3)
    return sorted(words)


def spelled(word: str, model: np.ndarray) -> list[str]:
    """Lower-cased words without the signs around them, restored where they are noisy.

    Parts between separators are words and so are all of them together; where no part has three
    letters, only the whole is.
    """
    parts = [_EDGE.sub("", p) for p in _APART.split(word.lower())]
    if len(parts) > 1 and max(map(len, parts)) < 3:
        parts = [_EDGE.sub("", word.lower())]
    elif len(parts) > 1:
        parts.append(_EDGE.sub("", _APART.sub("", word.lower())))
    return [restore(p, model) if _NOISY.search(p) else p for p in parts]


def features(words: list[str]) -> list[int]:
    """Feature cells of restored words: themselves and their beginnings."""
    names = {"=" + w for w in words if w} | {w[:n] for w in words for n in (4, 5, 6, 7, 8) if len(w) >= n}
    return [_cell(n) for n in sorted(names)]


def _cell(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % FEATURE_CELLS


def short_runs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray):
    """(first token, tokens without signs around them, joined by spaces) of the runs to be read."""
    s, e = starts.copy(), ends.copy()
    near = np.flatnonzero(ends - starts <= 16)
    for _ in range(3):
        e[near] -= (e[near] - s[near] > 1) & _TRIMMED[raw[e[near] - 1]]
        s[near] += (e[near] - s[near] > 1) & _TRIMMED[raw[s[near]]]
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    other = np.concatenate([[0], np.cumsum(~_SHORT[raw])])
    n = chars[e] - chars[s]
    short = (n >= 1) & (n <= 2) & (other[e] == other[s])
    first = short.copy()
    first[1:] &= ~short[:-1] | (doc[1:] != doc[:-1])
    runs = np.flatnonzero(first)
    if not len(runs):
        return
    held = np.flatnonzero(short)
    cut = np.searchsorted(held, runs)
    count = np.diff(np.append(cut, len(held)))
    single = np.add.reduceat((n[held] == 1).astype(np.int64), cut)
    letter = np.add.reduceat((_SYMBOL[raw[s[held]]] > 0).astype(np.int64), cut)
    data = raw.tobytes()
    for k in np.flatnonzero((count >= 3) & (single >= 2) & (letter >= 1)):
        a = int(runs[k])
        yield a, b" ".join(data[s[t] : e[t]] for t in range(a, a + int(count[k])))


class Reader:
    """Feature cells of documents, word by word; distinct words are restored once."""

    def __init__(self, model: np.ndarray, place: np.ndarray | None):
        self.model, self.place = model, place
        self.units = UnitTable(np.dtype("<i4"), CACHED_WORDS)

    def make(self, words: list[bytes]) -> list[np.ndarray]:
        out = []
        for word in words:
            text = word.decode("utf-8", "replace")
            read = spaced(text.lower(), self.model) if " " in text else spelled(text, self.model)
            cells = np.array(features(read), dtype="<i4")
            if self.place is not None:  # only selected cells, by their rank
                cells = self.place[cells]
                cells = cells[cells >= 0]
            out.append(cells)
        return out

    def documents(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Distinct cells of each document."""
        starts, ends = word_bounds(raw, off)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(starts, off)))
        if not len(starts):
            return [np.empty(0, np.int32)] * (len(off) - 1)
        # runs of short tokens become further words behind the text
        extra, at = [raw], len(raw)
        more_s, more_e, more_d = [], [], []
        for a, pieces in short_runs(raw, starts, ends, doc):
            extra.append(np.frombuffer(pieces, dtype=np.uint8))
            more_s.append(at)
            more_e.append(at + len(pieces))
            more_d.append(doc[a])
            at += len(pieces)
        raw = np.concatenate(extra)
        starts = np.concatenate([starts, np.array(more_s, np.int64)])
        ends = np.concatenate([ends, np.array(more_e, np.int64)])
        doc = np.concatenate([doc, np.array(more_d, np.int64)])
        rows = self.units.rows(raw, starts, ends, self.make)
        cells, _ = self.units.gather(rows)
        pairs = np.unique(np.repeat(doc, self.units.count[rows]) * FEATURE_CELLS + cells)
        marks = np.searchsorted(pairs, np.arange(len(off)) * FEATURE_CELLS)
        return [(pairs[a:b] % FEATURE_CELLS).astype(np.int32) for a, b in zip(marks[:-1], marks[1:], strict=True)]


def reader_of(model: np.ndarray, place: np.ndarray | None) -> Reader:
    """The worker's reader for a model; it keeps its words from task to task."""
    key = hashlib.sha256(model.tobytes() + (b"" if place is None else place.tobytes())).digest()
    return kept("reader" + key.hex(), None, lambda: Reader(model, place))


@dataclass
class Model:
    letters: np.ndarray  # trigram log-probabilities
    cells: np.ndarray  # selected feature cells
    weights: np.ndarray
    bias: float

    def place(self) -> np.ndarray:
        place = np.full(FEATURE_CELLS, -1, dtype=np.int32)
        place[self.cells] = np.arange(len(self.cells))
        return place


def select(counts: np.ndarray, totals: np.ndarray, limit: int) -> np.ndarray:
    """Cells with the largest likelihood-ratio statistic among those that point to toxic rows."""
    toxic, other = counts[:, 1], counts[:, 0]
    n1, n0 = max(totals[1], 1), max(totals[0], 1)
    seen = toxic + other
    expected = seen * n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(toxic > 0, toxic * np.log(toxic / expected), 0) + np.where(
            other > 0, other * np.log(other / (seen - expected)), 0
        )
    gain[(toxic < MIN_TOXIC) | (toxic <= 2 * expected)] = -1
    best = np.argsort(-gain, kind="stable")[:limit]
    return np.sort(best[gain[best] > 4])


def regress(rows: list[np.ndarray], labels: np.ndarray, size: int, ridge: float) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on present features, by adaptive gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cells = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
    # each coordinate has a step of its own
    w, b = np.zeros(size), math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    second_w, second_b = np.zeros(size), 0.0
    for _ in range(400):
        z = np.bincount(at, weights=w[cells], minlength=len(rows)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad_w = np.bincount(cells, weights=error[at], minlength=size) + ridge * w
        second_w += grad_w**2
        second_b += error.sum() ** 2
        w -= 0.5 * grad_w / np.sqrt(second_w + 1e-8)
        b -= 0.5 * error.sum() / math.sqrt(second_b + 1e-8)
    return w, b


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on at most ``sample_rows`` labelled rows, those with the smallest id hash.

    ``labels`` has doc_id and toxic (0 or 1); rows where either is null teach nothing, the first
    of repeated ones (by toxic) counts. The letter model counts all of ``docs``. None if no row or
    only one class is left.
    """
    letters = trigram_model(letter_counts(docs))
    picked = (
        labels.filter("doc_id is not null and toxic in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    sample = materialize(
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .join(F.broadcast(picked), "doc_id")
        .repartition(12, F.xxhash64("doc_id"))
        .select("toxic", "text")
    )
    schema = pa.schema([("cell", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])

    def counted(batches):
        reader, total = reader_of(letters, None), np.zeros((FEATURE_CELLS + 1, 2), dtype=np.int64)
        for toxic, raw, off in slices(batches, "toxic"):
            for y, cells in zip(toxic.to_pylist(), reader.documents(raw, off), strict=True):
                total[cells, y] += 1
                total[FEATURE_CELLS, y] += 1
        at = np.flatnonzero(total.any(axis=1))
        yield frame(schema, cell=at, n0=total[at, 0], n1=total[at, 1])

    counts = np.zeros((FEATURE_CELLS + 1, 2))
    sums = (
        sample.mapInArrow(counted, "cell long, n0 long, n1 long")
        .groupBy("cell")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .filter((F.col("n1") >= MIN_TOXIC) | (F.col("cell") == FEATURE_CELLS))
    )
    found = sums.toArrow()  # at most FEATURE_CELLS rows
    counts[found.column("cell").to_numpy()] = np.column_stack([found.column(c).to_numpy() for c in ("n0", "n1")])
    totals = counts[FEATURE_CELLS]
    if not totals.all():
        return None
    model = Model(letters, select(counts[:-1], totals, SELECTED), np.empty(0), 0.0)
    place = model.place()
    kind = pa.schema([("toxic", pa.int64()), ("cells", pa.list_(pa.int32()))])

    def designed(batches):
        reader = reader_of(letters, place)
        for toxic, raw, off in slices(batches, "toxic"):
            yield frame(kind, toxic=toxic.cast(pa.int64()), cells=reader.documents(raw, off))

    rows = sample.mapInArrow(designed, "toxic long, cells array<int>").toArrow().combine_chunks()
    x = [r.values.to_numpy() for r in rows.column("cells")]
    y = rows.column("toxic").to_numpy().astype(float)
    model.weights, model.bias = regress(x, y, len(model.cells), RIDGE)
    return model


def score(docs: DataFrame, model: Model | None, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``, from whole texts.

    Null and empty texts get the score of a text without features. Without a model every score is
    0. Repeated rows are scored each. Only doc_id and text are read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    place = model.place() if model else None

    def fn(batches):
        reader = reader_of(model.letters, place) if model else None
        for ids, raw, off in slices(batches):
            if reader:
                z = [model.bias + model.weights[c].sum() for c in reader.documents(raw, off)]
                s = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
            else:
                s = np.zeros(len(ids))
            yield frame(schema, doc_id=ids, score=s, predicted=(s >= cutoff).astype(np.int32))

    return over_texts(docs, fn, "doc_id long, score double, predicted int", keeps=True)


def clean_documents(docs: DataFrame, model: Model | None, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without the documents whose score reaches ``cutoff``; all columns stay."""
    toxic = (
        score(docs, model, cutoff)
        .filter("predicted = 1 and doc_id is not null")
        .select(F.col("doc_id").alias("_toxic"))
        .distinct()
    )
    return docs.join(toxic, docs["doc_id"] == F.col("_toxic"), "left_anti")
