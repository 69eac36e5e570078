"""Scoring of rows by a model that is loaded once per worker, in batches of bounded size."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.memories import extract_from_replies

BATCH_BYTES = 1 << 20
Score = Callable[[pd.DataFrame], pd.DataFrame]

_LOADED: dict[str, Score] = {}


def _instance(name: str, load: Callable[[], Score]) -> Score:
    """The worker's instance of a scorer; another one makes room for it."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = load()
    return _LOADED[name]


def _slices(rows: pd.DataFrame, sizes: Sequence[int], limit: int) -> Iterator[pd.DataFrame]:
    """Runs of rows of at most ``limit`` bytes, one row at least."""
    begin = total = 0
    for at, size in enumerate(sizes):
        if at > begin and total + size > limit:
            yield rows.iloc[begin:at]
            begin, total = at, 0
        total += size
    if begin < len(rows):
        yield rows.iloc[begin:]


def _scored(score: Score, rows: pd.DataFrame, names: list[str], retries: int, wait_s: float) -> pd.DataFrame:
    """Results of the rows in their order; what fails again and again is halved down to its rows."""
    error = ""
    for attempt in range(retries + 1):
        try:
            made = score(rows.reset_index(drop=True))
            if len(made) != len(rows):
                raise ValueError(f"{len(made)} results for {len(rows)} rows")
            return made[names].reset_index(drop=True).assign(error=None)
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            if attempt < retries and wait_s:
                time.sleep(wait_s * 2**attempt)
    if len(rows) > 1:
        half = len(rows) // 2
        parts = [_scored(score, part, names, retries, wait_s) for part in (rows.iloc[:half], rows.iloc[half:])]
        return pd.concat(parts, ignore_index=True)
    return pd.DataFrame({**{n: [None] for n in names}, "error": [error]})


def score_batches(
    df: DataFrame,
    name: str,
    load: Callable[[], Score],
    inputs: Sequence[str],
    schema: str,
    batch_bytes: int = BATCH_BYTES,
    retries: int = 2,
    wait_s: float = 0.0,
) -> DataFrame:
    """``df`` with the columns of ``schema`` that a model gives for ``inputs``, and ``error``.

    ``load`` makes the scorer, once per worker for each ``name``; it takes a pandas frame of the
    inputs and gives one row of results for each, in order. A call gets rows of at most
    ``batch_bytes`` of text, or one row. A call that raises is tried again, then cut in halves, so
    that one bad row doesn't take others along: only that row has null results and an ``error``.
    Other columns of ``df`` pass through, whatever their names are; they are not given to the model.
    """
    results = T.StructType.fromDDL(schema)
    clash = {f.name for f in results} | {"error"}
    if clash & set(df.columns):
        raise ValueError(f"columns named as results: {sorted(clash & set(df.columns))}")
    out = T.StructType([*df.schema.fields, *results.fields, T.StructField("error", T.StringType())])
    inputs, names = list(inputs), results.fieldNames()
    texts = [f.name for f in df.schema.fields if f.name in inputs and isinstance(f.dataType, T.StringType)]
    fixed = 16 * len(inputs)

    def fn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _instance(name, load)
        for part in parts:
            sizes = [fixed] * len(part)
            for c in texts:
                sizes = [n + len(t.encode()) if isinstance(t, str) else n for n, t in zip(sizes, part[c])]
            for rows in _slices(part, sizes, batch_bytes):
                made = _scored(score, rows[inputs], names, retries, wait_s)
                yield pd.concat([rows.reset_index(drop=True), made], axis=1)[out.fieldNames()]

    return df.mapInPandas(fn, out)


def extract_with_model(
    utterances: DataFrame, memories: DataFrame, name: str, load: Callable[[], Score], **options
) -> DataFrame:
    """New memories from utterances (source_ref, source_text) by a model that gives ``reply``.

    The model gets ``source_text``; utterances whose call fails give nothing.
    """
    replies = score_batches(
        utterances.select("source_ref", "source_text"), name, load, ["source_text"], "reply string", **options
    )
    return extract_from_replies(replies.filter(F.col("error").isNull()).drop("error"), memories)
