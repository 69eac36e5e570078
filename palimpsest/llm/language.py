"""Language identification with a string kernel, Nystroem landmarks and ridge regression.

The kernel counts the character n-grams (n = 1, 2, 3) that occur in both texts, however often,
and is normalised to 1 for a text with itself. Kernel values against landmark texts, a number
of each language, give Nystroem features; one ridge regression per language separates it from the rest. The
model is fitted on a bounded sample of the learning rows; scoring multiplies batches of presence
vectors of whole texts with the landmark matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.arrays import frame, over_texts, slices

SYMBOLS = 48  # 0: no letter, 1-26: a-z, 27-47: other letters, by code point
TRIGRAM_CELLS = 1 << 15
FEATURES = SYMBOLS + SYMBOLS**2 + TRIGRAM_CELLS
ROWS_PER_LANGUAGE = 400  # learning rows of each language, at most
LANDMARKS = 16  # of each language
RIDGE = 0.01
SHARPNESS = 6.0  # of the softmax that turns margins into a score
BATCH = 64  # documents per matrix product

_TABLE: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """One symbol per code point."""
    if not _TABLE:
        table = np.zeros(0x110000, dtype=np.int32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = ord(chr(c).lower()[0])
                table[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
        _TABLE.append(table)
    return _TABLE[0][np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]


def present(text: str) -> np.ndarray:
    """Indexes of the n-grams of ``text``, with repeats."""
    s = symbols(text)
    pairs = s[:-1] * SYMBOLS + s[1:]
    triples = (pairs[:-1] * SYMBOLS + s[2:]).astype(np.uint32) * np.uint32(2654435761)
    cells = (triples >> np.uint32(17)).astype(np.int64)
    return np.concatenate([s, pairs + SYMBOLS, cells + (SYMBOLS + SYMBOLS**2)])


def vectors(texts: list[str]) -> np.ndarray:
    """Presence vectors, one row per text."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for k, text in enumerate(texts):
        out[k, present(text)] = 1
    return out


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised common-n-gram counts between rows of ``x`` and of ``y``."""
    size = np.outer(np.sqrt(x.sum(axis=1)), np.sqrt(y.sum(axis=1)))
    return (x @ y.T) / np.maximum(size, 1)


def near(x: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Kernel between rows of ``x`` and packed landmarks, some landmarks at a time."""
    blocks = (np.unpackbits(packed[a : a + BATCH], axis=1, count=FEATURES) for a in range(0, len(packed), BATCH))
    return np.concatenate([kernel(x, b.astype(np.float32)) for b in blocks], axis=1)


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # presence vectors, eight n-grams a byte
    weights: np.ndarray  # landmarks x languages, the Nystroem map included

    @classmethod
    def fit(cls, texts: list[str], langs: list[str], landmarks: int, ridge: float) -> Model:
        names = sorted(set(langs))
        # landmarks take turns over the languages
        turn: dict[str, int] = {}
        rank = [turn.update({g: turn.get(g, 0) + 1}) or turn[g] for g in langs]
        order = sorted(range(len(texts)), key=lambda i: (rank[i], langs[i]))
        chosen = order[: landmarks * len(names)]
        blocks = [chosen[a : a + BATCH] for a in range(0, len(chosen), BATCH)]
        marks = np.concatenate([np.packbits(vectors([texts[i] for i in b]) > 0, axis=1) for b in blocks])
        between = np.concatenate([near(vectors([texts[i] for i in b]), marks) for b in blocks])
        values, basis = np.linalg.eigh(between.astype(float))
        root = basis @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ basis.T
        # sums over batches, as large as the landmarks and languages only
        left = ridge * np.eye(len(marks) + 1)
        right = np.zeros((len(marks) + 1, len(names)))
        for a in range(0, len(texts), BATCH):
            phi = near(vectors(texts[a : a + BATCH]), marks).astype(float) @ root
            design = np.column_stack([phi, np.ones(len(phi))])
            target = np.where(np.array(langs[a : a + BATCH])[:, None] == np.array(names)[None, :], 1.0, -1.0)
            left += design.T @ design
            right += design.T @ target
        solved = np.linalg.solve(left, right)
        weights = np.vstack([root @ solved[:-1], solved[-1:]])
        return cls(names, marks, weights)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        k = near(vectors(texts), self.landmarks)
        margins = np.column_stack([k, np.ones(len(k))]) @ self.weights
        soft = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
        soft /= soft.sum(axis=1, keepdims=True)
        best = soft.argmax(axis=1)
        return [self.languages[b] for b in best], soft[np.arange(len(best)), best]


def learn(
    rows: DataFrame, per_language: int = ROWS_PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE
) -> Model | None:
    """Fit on at most ``per_language`` rows of each language, those with the smallest id hash.

    ``rows`` has doc_id, text and lang. Rows without id, language or letters teach nothing; None
    without any row left. Every language is learned, with ``landmarks`` landmark texts at most.
    """
    usable = rows.filter("doc_id is not null and lang is not null and text is not null")
    # slices first, so that a frequent language does not meet in one task as a whole
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    early = F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))
    picked = (
        usable.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(64)).alias("slice"))
        .withColumn("early", early)
        .filter(F.col("early") <= per_language)
        .withColumn("turn", turn)
        .filter(F.col("turn") <= per_language)
        .select("doc_id", "lang", "turn")
    )
    # at most per_language ids of each language
    sample = (
        usable.select("doc_id", "text", "lang")
        .join(F.broadcast(picked), ["doc_id", "lang"])
        .orderBy("turn", "lang", "doc_id")
        .select("text", "lang")
        .toLocalIterator()
    )
    found = [(r["text"], r["lang"]) for r in sample]
    found = [x for x in found if symbols(x[0]).any()]
    return Model.fit(*map(list, zip(*found, strict=True)), landmarks, ridge) if found else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``.

    ``und`` with score 0 for a null text, a text without letters, or without a model. Whole texts
    are scored; only doc_id and text are read; repeated rows are scored each.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def fn(batches: Iterator[pa.RecordBatch]):
        for ids, raw, off in slices(batches):
            data = raw.tobytes()
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            held = [k for k, t in enumerate(texts) if model and symbols(t).any()]
            for a in range(0, len(held), BATCH):
                part = held[a : a + BATCH]
                best, sure = model.predict([texts[k] for k in part])
                for k, name, s in zip(part, best, sure, strict=True):
                    names[k], scores[k] = name, s
            yield frame(schema, doc_id=ids, lang_pred=names, score=scores)

    return over_texts(docs, fn, "doc_id long, lang_pred string, score double")


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
