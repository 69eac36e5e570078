"""Vector arithmetic on array columns, rank fusion and the hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

RRF_K = 60
SILENCE_DBFS = -100.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """L2-normalised vector; the zero vector is returned unchanged."""
    return F.get(
        F.transform(
            F.array(F.struct(v.alias("v"), l2_norm(v).alias("n"))),
            lambda s: F.transform(
                s["v"],
                lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(x.cast("double")),
            ),
        ),
        F.lit(0),
    )


def clipped_score(v: Column, centroid: Column) -> Column:
    """Cosine of unit vectors, clipped to [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(v, centroid)))


def rrf_term(rank: Column, k: int = RRF_K) -> Column:
    """Reciprocal-rank contribution of a 0-based rank."""
    return F.lit(1.0) / (rank + (k + 1))


def frame_dbfs(frame: Column, floor: float = SILENCE_DBFS) -> Column:
    """RMS level of a sample array in dBFS, never below ``floor``."""
    mean_square = dot(frame, frame) / F.size(frame)
    return F.when((F.size(frame) == 0) | (mean_square <= 0), F.lit(floor)).otherwise(
        F.greatest(F.lit(floor), 10.0 * F.log10(mean_square))
    )


# --- embedders --------------------------------------------------------------------------

_WORD_RUN = re.compile(r"[^\W_]+", re.UNICODE)


def _signed_slot(feature: str, dim: int) -> tuple[int, float]:
    digest = hashlib.blake2b(feature.encode("utf-8"), digest_size=8).digest()
    return int.from_bytes(digest[:4], "little") % dim, 1.0 if digest[4] & 1 else -1.0


def hash_vectors(texts: Iterable[str], dim: int) -> np.ndarray:
    """Signed hashing of word unigrams and bigrams, L2-normalised, one row per text."""
    texts = list(texts)
    slots: dict[str, tuple[int, float]] = {}
    out = np.zeros((len(texts), dim), dtype=np.float32)
    for row, text in enumerate(texts):
        words = [w.casefold() for w in _WORD_RUN.findall(text or "")]
        for feature in (*words, *map("_".join, zip(words, words[1:]))):
            slot = slots.get(feature)
            if slot is None:
                slot = slots[feature] = _signed_slot(feature, dim)
            out[row, slot[0]] += slot[1]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1.0, norms)


class Embedder:
    """A named text-to-vector function used as an Arrow UDF.

    ``embed`` takes a list of texts and returns a (n, dim) array; it runs inside tasks.
    """

    def __init__(self, name: str, dim: int, embed: Callable[[list[str]], np.ndarray]):
        self.name, self.dim, self.embed = name, dim, embed

    def column(self, text: Column) -> Column:
        embed = self.embed

        @pandas_udf(T.ArrayType(T.FloatType()))
        def vectors(texts: pd.Series) -> pd.Series:
            return pd.Series(list(np.asarray(embed(texts.fillna("").tolist()), dtype=np.float32)))

        return vectors(text)


class _HashEmbed:
    def __init__(self, dim: int):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        return hash_vectors(texts, self.dim)


def hash_embedder(dim: int = 256) -> Embedder:
    return Embedder(f"hash-{dim}", dim, _HashEmbed(dim))
