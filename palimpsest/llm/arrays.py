"""Word hashes of whole Arrow text columns, computed on the UTF-8 bytes with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit; A-Z count as
a-z when ``fold`` is set. Word boundaries and hashes are the same in every batch and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20  # text handled at once
BATCH_BYTES = 4 << 20  # text that a task hands to its Python worker at once
CACHE_BYTES = 32 << 20  # of a table of remembered stretches
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for at least ``n`` positions."""
    size = max(SLICE_BYTES, 1 << max(0, n - 1).bit_length())
    if size not in _POWERS:
        made = []
        for base in (_BASE, _UNBASE):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            made.append(np.cumprod(factors, dtype=np.uint64))
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; words never cross the document offsets ``off``."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~_SEPARATOR[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[off] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_hashes(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True
) -> np.ndarray:
    """One 64-bit hash per word: a polynomial over its bytes, finalised with its length."""
    table = _FOLDED if fold else _BYTE
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        to = int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right"))
        to = max(to, at + 1)
        base, top = int(starts[at]), int(ends[to - 1])
        up, down = _powers(top - base)
        total = np.zeros(top - base + 1, dtype=np.uint64)
        np.cumsum(table[raw[base:top]] * up[: top - base], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; the result has ``len(words) - n + 1`` entries."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.full(count, n, dtype=np.uint64)
    for i in range(n):
        total += words[i : i + count] * _STEP[i]
    return mix(total)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys as differences, and counts, byte plane by byte plane."""
    steps = keys.copy()
    steps[1:] = keys[1:] - keys[:-1]
    planes = [x.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel() for x in (steps, counts)]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(2, 8, -1)
    steps, counts = (np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.uint64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts."""
    every, amount = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, amount = every[order], amount[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
    return every[first], np.add.reduceat(amount, first) if len(first) else amount


class UnitTable:
    """Remembers, for stretches of text, an id array each; distinct stretches are made once.

    Stretches are told apart by their 64-bit hash. A table that holds more than ``bound`` of them,
    or more than ``CACHE_BYTES`` bytes, forgets all before the next call.
    """

    def __init__(self, dtype: np.dtype, bound: int):
        self.dtype, self.bound = np.dtype(dtype), bound
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)  # ascending; the others go with them
        self.start = np.empty(0, np.int64)
        self.count = np.empty(0, np.int32)
        self.flat = np.empty(0, self.dtype)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.start, self.count, self.flat))

    def rows(
        self,
        raw: np.ndarray,
        starts: np.ndarray,
        ends: np.ndarray,
        make: Callable[[list[bytes]], list[np.ndarray]],
    ) -> np.ndarray:
        """A row of ``start`` and ``count`` per stretch; ``make`` gets the new ones.

        Rows hold until the next call.
        """
        if len(self.keys) > self.bound or self.nbytes() > CACHE_BYTES:
            self.clear()
        hashed = word_hashes(raw, starts, ends, fold=False)
        distinct, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        old = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == distinct[inside]
        new = np.flatnonzero(~old)
        if len(new):
            made = make([raw[starts[k] : ends[k]].tobytes() for k in first[new]])
            counts = np.array([len(m) for m in made], dtype=np.int32)
            begin = len(self.flat) + np.cumsum(counts, dtype=np.int64) - counts
            place = at[new]  # both the old keys and the new ones ascend
            self.keys = np.insert(self.keys, place, distinct[new])
            self.start = np.insert(self.start, place, begin)
            self.count = np.insert(self.count, place, counts)
            self.flat = np.concatenate([self.flat, *made], dtype=self.dtype, casting="unsafe")
            at = np.searchsorted(self.keys, distinct)
        return at[inverse.ravel()]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id arrays of ``rows`` one after another, and the end of each."""
        counts = self.count[rows].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[rows] - (ends - counts), counts)
        return self.flat[at], ends


_KEPT: dict[tuple, object] = {}


def kept(kind: str, key: object, make: Callable[[], object]) -> object:
    """What ``make`` made for this key, kept in the worker until an operator of another kind asks."""
    if any(other != kind for other, _ in _KEPT):
        _KEPT.clear()
    if (kind, key) not in _KEPT:
        _KEPT[kind, key] = make()
    return _KEPT[kind, key]


def forget() -> None:
    """Give back what operators before this one keep in the worker."""
    if _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()


def slices(
    batches: Iterator[pa.RecordBatch],
    id_name: str = "doc_id",
    text_name: str = "text",
    size: int = SLICE_BYTES,
) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of whole documents, about ``size`` bytes of text at a time."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_name))
        raw, off = text_buffers(batch.column(batch.schema.get_field_index(text_name)))
        at = 0
        while at < len(ids):
            to = int(np.searchsorted(off, off[at] + size, "right")) - 1
            to = min(len(ids), max(to, at + 1))
            yield ids[at:to], raw[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of whole documents in bounded groups; a null text is empty."""
    for ids, raw, off in slices(batches):
        data = raw.tobytes()
        yield (
            ids.to_pylist(),
            [data[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)],
        )


def over_texts(docs: DataFrame, fn: Callable, schema: str, keeps: bool = False) -> DataFrame:
    """Run ``fn`` over Arrow batches of (doc_id, text); other columns are not read.

    Without ``keeps`` the worker first forgets the tables that other operators ``kept`` there.
    Batches of whole rows are bounded in bytes (``BATCH_BYTES``), as texts are long: a batch stands in the
    executor and in its worker at once.
    """

    def alone(batches):
        forget()
        yield from fn(batches)

    bounded_batches(docs)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        fn if keeps else alone, schema
    )


def bounded_batches(docs: DataFrame) -> None:
    """Bound the session's Arrow batches in bytes, unless the user has set a bound."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))


def frame(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of the given schema from lists or numpy arrays."""
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )
