"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors u, v have a cosine of at least c if |u - v|^2 <= 2 - 2 c. The vectors are rotated and
split into a few blocks of dimensions; every block gets a share of that squared distance in
proportion to its dimensions. By the pigeonhole principle a similar pair keeps to the share in at
least one block.

1. ``profiles``: vectors with equal components and label are one class; only classes are compared.
2. ``block_rows``: every block is range-joined by a grid over its first coordinates, cells twice as
   wide as the range. A class goes to its own cell and to the later ones that its range touches, as
   a sketch of one byte a dimension.
3. ``candidate_links``: in a cell, pairs within the block's share and within the whole squared
   distance, each widened by the error of the sketches, become candidates. Only links that join
   two groups leave a cell, so a dense group gives as many rows as it has members.
4. ``exact_links``: the vectors of a connected group of candidates meet, and all pairs among them
   are compared in double precision, as matrix products in bounded parts. Partners are counted
   there; rows leave by class, never by pair.
5. Exact links become components by repeated minimum labels.

Cells and groups above a bound are cut into parts of which every two meet. Two classes share their
64-bit hash with probability 2^-64.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import frame, mix
from palimpsest.llm.ngram_join import components
from palimpsest.llm.trie import Forest
from palimpsest.session import materialize

COSINE = 0.98
BLOCKS = 4
CUT_ROWS = 1 << 15  # rows of a label for which one coordinate of a block is cut
MOST_CUTS = 3
PART_ROWS = 1 << 16  # rows of a cell in one part
GROUP_ROWS = 1 << 13  # vectors of a group of candidates in one part
CHUNK = 1024  # rows of one side of a matrix product
SLACK = 1e-5  # rounding of sketches in single precision

_PROFILE = pa.schema([("vec_id", pa.int64()), ("labelh", pa.int64()), ("sig", pa.int64())])
_CELL = pa.schema(
    [("cell", pa.int64()), ("block", pa.int32()), ("home", pa.bool_()), ("sig", pa.int64()),
     ("scale", pa.float32()), ("sketch", pa.binary())]
)
_VECTOR = pa.schema([("sig", pa.int64()), ("vector", pa.binary())])


@functools.cache
def rotation(d: int) -> np.ndarray:
    """The same orthogonal matrix in every task."""
    return np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]


def spans(d: int) -> list[np.ndarray]:
    return np.array_split(np.arange(d), min(BLOCKS, d))


def reach(cosine: float) -> float:
    """Largest distance of two unit vectors with that cosine or more."""
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, class hashes, vectors as doubles) of the vectors that can link, by dimension.

    Left out are null vectors, those without a label, with a null or non-finite component, and
    zero vectors.
    """
    column = batch.column(batch.schema.get_field_index("embedding"))
    labels = batch.column(batch.schema.get_field_index("labelh"))
    values = column.values.cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)  # a null component is nan
    off = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    usable = ~column.is_null().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(size[usable]):
        if d == 0:
            continue
        rows = np.flatnonzero(usable & (size == d))
        made = flat[off[rows][:, None] + np.arange(d)] + 0.0  # no negative zero
        good = np.isfinite(made).all(axis=1) & (made != 0).any(axis=1)
        rows, made = rows[good], made[good]
        if not len(rows):
            continue
        label = labels.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        place = mix(np.arange(1, d + 1, dtype=np.uint64))
        hashed = mix(made.view(np.uint64) ^ place).sum(axis=1, dtype=np.uint64)
        yield rows, mix(hashed ^ mix(label + np.uint64(d))), made


def unit(made: np.ndarray) -> np.ndarray:
    made = made / np.abs(made).max(axis=1, keepdims=True)
    return made / np.sqrt((made * made).sum(axis=1, keepdims=True))


def profiles(rows: DataFrame) -> DataFrame:
    """(vec_id, labelh, sig); sig is null for vectors that link with nothing."""

    def fn(batches):
        for batch in batches:
            sig = np.zeros(batch.num_rows, dtype=np.int64)
            none = np.ones(batch.num_rows, dtype=bool)
            for at, hashed, _ in vectors(batch):
                sig[at], none[at] = hashed.view(np.int64), False
            ids = batch.column(batch.schema.get_field_index("vec_id"))
            label = batch.column(batch.schema.get_field_index("labelh"))
            yield pa.RecordBatch.from_arrays([ids, label, pa.array(sig, mask=none)], schema=_PROFILE)

    return rows.mapInArrow(fn, "vec_id long, labelh long, sig long")


def block_rows(rows: DataFrame, cosine: float, cuts: int) -> DataFrame:
    """(cell, block, home, sig, scale, sketch): every class in the cells of its blocks."""
    whole = reach(cosine)

    def fn(batches):
        for batch in batches:
            for at, hashed, made in vectors(batch):
                first = np.unique(hashed, return_index=True)[1]
                hashed, d = hashed[first], made.shape[1]
                turned = unit(made[first]) @ rotation(d)
                scale = np.abs(turned).max(axis=1) / 127
                sketch = np.rint(turned / scale[:, None]).astype(np.int8)
                labels = batch.column(batch.schema.get_field_index("labelh")).take(pa.array(at[first]))
                label = labels.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for b, span in enumerate(spans(d)):
                    near = whole * math.sqrt(len(span) / d) + 1e-9
                    own = turned[:, span[:cuts]]
                    home, low, high = (np.floor(x / (2 * near)).astype(np.int64) for x in (own, own - near, own + near))
                    seed = mix(label ^ mix(np.full(len(label), d * BLOCKS + b, dtype=np.uint64)))
                    for corner in range(1 << own.shape[1]):
                        up = np.array([corner >> j & 1 for j in range(own.shape[1])], dtype=bool)
                        cell = np.where(up, high, low)
                        differ = cell != home
                        lead = np.argmax(differ, axis=1)
                        later = (cell > home)[np.arange(len(cell)), lead]
                        alone = ~differ.any(axis=1)
                        # a side on which low and high are one cell counts once
                        keep = np.flatnonzero((~up | (low != high)).all(axis=1) & (alone | later))
                        if not len(keep):
                            continue
                        key = seed[keep]
                        for j in range(own.shape[1]):
                            key = mix(key + cell[keep, j].view(np.uint64) + np.uint64(1))
                        yield frame(
                            _CELL, cell=key.view(np.int64), block=np.full(len(keep), b), home=alone[keep],
                            sig=hashed[keep].view(np.int64), scale=scale[keep].astype(np.float32),
                            sketch=[sketch[k].tobytes() for k in keep],
                        )

    return rows.mapInArrow(fn, "cell long, block int, home boolean, sig long, scale float, sketch binary")


def _parted(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Deal the rows of a key to parts of about ``limit`` rows and every two parts to (i, j)."""
    large = rows.groupBy(key).count().filter(F.col("count") > limit)
    large = materialize(large.select(key, F.ceil(F.col("count") / F.lit(limit)).cast("int").alias("parts")))
    zero = F.lit(0)
    if large.isEmpty():
        return rows.withColumns({"i": zero, "j": zero, "part": zero})
    parts = F.coalesce("parts", F.lit(1))
    part = F.pmod(F.xxhash64("sig", F.lit(7)), parts).cast("int")
    dealt = rows.join(large, key, "left").withColumns(
        {"part": part, "other": F.explode(F.sequence(zero, parts - 1))}
    )
    return dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop(
        "parts", "other"
    )


def _chunks(n: int) -> list[slice]:
    return [slice(a, min(n, a + CHUNK)) for a in range(0, n, CHUNK)]


def _sides(part: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two parts; the same rows twice within one part."""
    if i == j:
        every = np.arange(len(part))
        return every, every
    return np.flatnonzero(part == i), np.flatnonzero(part == j)


def _joined(forest: Forest, x: np.ndarray, y: np.ndarray, similar: np.ndarray) -> list[tuple[int, int]]:
    """Unite the similar pairs of rows ``x`` and ``y``; the pairs that joined two groups."""
    links = []
    while True:
        rx, ry = (np.array([forest.root(k) for k in z.tolist()]) for z in (x, y))
        similar &= rx[:, None] != ry[None, :]
        found = np.flatnonzero(similar.any(axis=0))
        if not len(found):
            return links
        for k, row in zip(found.tolist(), similar[:, found].argmax(axis=0).tolist(), strict=True):
            a, b = int(x[row]), int(y[k])
            if forest.root(a) != forest.root(b):
                forest.union(a, b)
                links.append((a, b))


def _close(a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Pairs whose distance is at most the limit, in single precision and with slack."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return square <= limit * limit + SLACK


def candidate_links(cells: DataFrame, cosine: float) -> DataFrame:
    """Links (a, b) that connect the candidates of each cell."""
    whole = reach(cosine)

    def fn(table: pa.Table) -> pa.Table:
        sigs = table.column("sig").to_numpy()
        out = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
        if len(sigs) < 2:
            return pa.table(out)
        raw = table.column("sketch").to_pylist()
        scale = table.column("scale").to_numpy()[:, None]
        sketch = np.frombuffer(b"".join(raw), dtype=np.int8).reshape(len(raw), -1)
        d, block = sketch.shape[1], table.column("block")[0].as_py()
        span = spans(d)[block]
        home, part = table.column("home").to_numpy(), table.column("part").to_numpy()
        forest, links = Forest(len(sigs)), []
        error = scale[:, 0] / 2  # of a dimension, at most
        near = whole * math.sqrt(len(span) / d)
        x, y = _sides(part, table.column("i")[0].as_py(), table.column("j")[0].as_py())
        for s in _chunks(len(x)):
            for t in _chunks(len(y)):
                if x is y and t.start < s.start:
                    continue
                p, q = x[s], y[t]
                if not (home[p].any() or home[q].any()):
                    continue
                a, b = (sketch[z][:, span].astype(np.float32) * scale[z] for z in (p, q))
                off = (error[p][:, None] + error[q][None, :])
                similar = _close(a, b, near + off * math.sqrt(len(span)))
                similar &= (home[p][:, None] | home[q][None, :]) & (sigs[p][:, None] != sigs[q][None, :])
                rows, columns = np.flatnonzero(similar.any(axis=1)), np.flatnonzero(similar.any(axis=0))
                if not len(rows):
                    continue
                p, q = p[rows], q[columns]
                a, b = (sketch[z].astype(np.float32) * scale[z] for z in (p, q))
                off = off[np.ix_(rows, columns)]
                links += _joined(
                    forest, p, q, similar[np.ix_(rows, columns)] & _close(a, b, whole + off * math.sqrt(d))
                )
        out = {k: pa.array(sigs[[m[n] for m in links]] if links else [], pa.int64()) for n, k in enumerate("ab")}
        return pa.table(out)

    return (
        _parted(cells, "cell", PART_ROWS)
        .groupBy("cell", "i", "j")
        .applyInArrow(fn, "a long, b long")
    )


def class_vectors(rows: DataFrame) -> DataFrame:
    """(sig, vector): components of every class as little-endian numbers of the column's width."""
    width = "<f4" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def fn(batches):
        for batch in batches:
            for _, hashed, made in vectors(batch):
                first = np.unique(hashed, return_index=True)[1]
                yield frame(
                    _VECTOR, sig=hashed[first].view(np.int64), vector=[v.tobytes() for v in made[first].astype(width)]
                )

    return rows.mapInArrow(fn, "sig long, vector binary")


def exact_links(groups: DataFrame, cosine: float, width: str) -> DataFrame:
    """(sig, links, lead) of each part of a group: partners by weight, and one class of its component.

    ``groups`` has (comp, sig, weight, vector).
    """

    def fn(table: pa.Table) -> pa.Table:
        sigs, weight = table.column("sig").to_numpy(), table.column("weight").to_numpy()
        part = table.column("part").to_numpy()
        made = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=width)
        made = made.reshape(len(sigs), -1).astype(np.float64)
        made /= np.abs(made).max(axis=1, keepdims=True)
        norm = np.sqrt((made * made).sum(axis=1))
        count, forest = np.zeros(len(sigs), dtype=np.int64), Forest(len(sigs))
        x, y = _sides(part, table.column("i")[0].as_py(), table.column("j")[0].as_py())
        for s in _chunks(len(x)):
            for t in _chunks(len(y)):
                if x is y and t.start < s.start:
                    continue
                p, q = x[s], y[t]
                similar = made[p] @ made[q].T / (norm[p][:, None] * norm[q][None, :]) >= cosine
                if x is y and t.start == s.start:
                    np.fill_diagonal(similar, False)
                    count[p] += similar @ weight[q]
                else:
                    count[p] += similar @ weight[q]
                    count[q] += weight[p] @ similar
                _joined(forest, p, q, similar)
        lead = sigs[[forest.root(k) for k in range(len(sigs))]]
        return pa.table({"sig": sigs, "links": count, "lead": lead})

    return (
        _parted(groups, "comp", GROUP_ROWS)
        .groupBy("comp", "i", "j")
        .applyInArrow(fn, "sig long, links long, lead long")
    )


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows`` (vec_id, embedding, label).

    Vectors of equal, non-null labels and dimensions link at a cosine of at least ``cosine``, in
    double precision. n_links counts the other rows linked directly, equal vectors included;
    component_id is the smallest vec_id reachable by links, kept is true where that is the row's
    own. Vectors that are null, empty, zero or hold null or non-finite components have no links and
    are their own component. Repeated rows are returned as often as they come; a null vec_id is
    a component_id only if no member has one. Other columns are not read.
    """
    chosen = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("labelh"),
        "embedding",
    )
    width = "<f4" if chosen.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    found = materialize(profiles(chosen))
    most = found.filter("sig is not null").groupBy("labelh").count().agg(F.max("count")).first()[0] or 0
    cuts = 1 + min(MOST_CUTS - 1, max(0, math.ceil(math.log(max(1, most) / CUT_ROWS, 4))))
    plain = chosen.select("labelh", "embedding")
    near = materialize(candidate_links(block_rows(plain, cosine, cuts), cosine))
    classes = (
        found.filter("sig is not null").groupBy("sig").agg(F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    )
    classes = materialize(classes)
    members = components(near).join(classes.select("sig", "weight"), "sig")
    groups = members.join(class_vectors(plain), "sig").dropDuplicates(["sig"])
    links = materialize(exact_links(groups, cosine, width))
    comps = components(links.filter("sig <> lead").select(F.col("sig").alias("a"), F.col("lead").alias("b")))
    placed = (
        classes.join(links.groupBy("sig").agg(F.sum("links").alias("links")), "sig", "left")
        .join(comps, "sig", "left")
        .withColumn("comp", F.coalesce("comp", "sig"))
    )
    lowest = placed.groupBy("comp").agg(F.min("low").alias("first"))
    settled = placed.join(lowest, "comp").select(
        "sig", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "first"
    )
    component = F.coalesce("first", "vec_id")
    return found.join(settled, "sig", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
