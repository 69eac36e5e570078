"""N-gram Jaccard join: near-duplicate documents by one global order, prefixes and tries.

A document's set holds its distinct n-word shingles as 64-bit hashes (words are lower-cased A-Z).
The job, whose shuffles carry shingle hashes and never texts:

1. ``profiles``: set size and set hash of every document, and a fixed-size count sketch of all
   shingles. Documents with equal set hashes form one class; only classes are compared.
2. ``candidates``: in the order (sketch level, hash) similar sets share k shingles among their first
   n - ceil(t n) + k. Rows (shingle, class) are dealt by shingle; k is a twelfth of the size, and
   classes with fewer shared shingles than any similar set would give them fall away.
3. ``ordered_sets``: the shingles of the remaining classes are counted exactly and get one global
   order, by the level of their number of classes, then by hash. Shingles of one class alone count
   in the size of a set only. A class with fewer than ceil(t n) shared shingles falls away: documents
   that share a passage and have enough text of their own end here.
4. First round: every class meets one centre, the class it has most prefix shingles in common with
   among the first ones of their lists. This connects large groups of near copies.
5. Second round: lists (the classes of one prefix shingle) that are connected by now fall away.
   Classes that meet in the others, at once or through others, are a family and become blocks: the
   largest component of a family and the classes outside of it are cut into parts of bounded size,
   and each part of the one meets each part of the others. Where that takes more rows, a family is
   dealt by its lists instead (equal lists count once), and a list by its next shingle, as similar
   sets share two or more.
6. Each block is a trie of sets in the global order, most frequent shingles first, and is joined by
   traversal (``trie.similar``). Links become components by repeated minimum labels.

Only links that join different components are emitted; every pair at or above the threshold is
connected. Two shingles collide with probability 2^-57, set hashes with 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import frame, gram_hashes, mix, over_texts, slices, word_bounds, word_hashes
from palimpsest.llm.trie import Forest, similar
from palimpsest.session import materialize

SKETCH_CELLS = 1 << 20  # counters of the shingle sketch, whatever the input
SKETCH_BLOCK = 1 << 14  # counters in one row on their way to the sum
SKETCH_ROWS = 1 << 19  # shingles counted at once
FILTER_WORDS = 1 << 18  # 64-bit words of the candidate bitmap, whatever the input
BLOCK_SETS = 256  # sets of one side of a block
LONGER = 12  # the first prefixes are longer than needed by this part of a set
HOT = np.uint64(1)  # bit of a token whose count stands out
TOP_LEVEL = 31  # of hot shingles in the global order; levels stand in the bits from 58 on

_PROFILE = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("part", pa.int64()),
     ("cells", pa.binary())]
)
_ENTRY = pa.schema([("token", pa.int64()), ("sig", pa.int64())])
_PACK = pa.schema([("part", pa.int64()), ("rows", pa.binary())])
PACK_ROWS = 250_000  # rows of a part, about, which a task sorts at once
WAITING_ROWS = 1 << 18  # rows a task holds before it packs them
_SET = pa.schema([("sig", pa.int64()), ("keys", pa.binary())])


def document_sets(
    batches: Iterator[pa.RecordBatch], words: int
) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sorted distinct shingle hashes) of whole documents, some at a time."""
    for ids, raw, off in slices(batches):
        starts, ends = word_bounds(raw, off)
        hashed = word_hashes(raw, starts, ends)
        grams = gram_hashes(hashed, words)
        edge = np.searchsorted(starts, off)
        sets = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a >= words:
                sets.append(np.unique(grams[a : b - words + 1]))
            else:  # the whole sequence is one shingle; nothing for no words
                sets.append(gram_hashes(hashed[a:b], int(b - a)) if b > a else grams[:0])
        yield ids.to_pylist(), sets


def set_hash(grams: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    both = mix(np.array([np.add.reduce(mix(grams)), len(grams)], dtype=np.uint64))
    return int(mix(both[:1] ^ (both[1:] << np.uint64(1))).view(np.int64)[0])


def _cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - SKETCH_CELLS.bit_length() + 1)).astype(np.int64)


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, n, sig) per document and, per task, rows (part, cells) of the sketch."""

    def fn(batches):
        sketch = np.zeros(SKETCH_CELLS, dtype=np.uint32)
        waiting: list[np.ndarray] = []

        def count() -> None:
            np.add(sketch, np.bincount(_cells(np.concatenate(waiting)), minlength=SKETCH_CELLS), out=sketch, casting="unsafe")
            waiting.clear()

        for ids, sets in document_sets(batches, words):
            waiting.extend(sets)
            if sum(map(len, waiting)) > SKETCH_ROWS:
                count()
            yield frame(
                _PROFILE,
                doc_id=ids,
                n=[len(s) for s in sets],
                sig=[set_hash(s) if len(s) else None for s in sets],
                part=[None] * len(sets),
                cells=[None] * len(sets),
            )
        if waiting:
            count()
        held = [k for k in range(SKETCH_CELLS // SKETCH_BLOCK) if sketch[_span(k)].any()]
        packer = zstandard.ZstdCompressor(level=1)
        none = [None] * len(held)
        yield frame(
            _PROFILE, doc_id=none, n=none, sig=none, part=held,
            cells=[packer.compress(sketch[_span(k)].tobytes()) for k in held],
        )

    return over_texts(docs, fn, "doc_id long, n long, sig long, part long, cells binary")


def _span(k: int) -> slice:
    return slice(k * SKETCH_BLOCK, (k + 1) * SKETCH_BLOCK)


def gather_sketch(rows: DataFrame) -> np.ndarray:
    """Sum the tasks' counters; the driver receives SKETCH_CELLS numbers."""

    def fn(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(zstandard.decompress(cells), dtype=np.uint32).astype(np.uint64)
                total[part] = total[part] + own if part in total else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()),
             pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["part", "cells"],
        )

    parts = (
        rows.filter(F.col("part").isNotNull())
        .select("part", "cells")
        .repartition(SKETCH_CELLS // SKETCH_BLOCK, "part")
        .mapInArrow(fn, "part long, cells binary")
    )
    sketch = np.zeros(SKETCH_CELLS, dtype=np.uint64)
    for row in parts.collect():
        sketch[_span(row["part"])] = np.frombuffer(row["cells"], dtype=np.uint64)
    return sketch


def sketch_levels(sketch: np.ndarray) -> np.ndarray:
    """A byte per cell: how far its count stands above the mean (0: within its spread), and HOT.

    HOT is the lowest bit; a shingle of a cell without it has at most 2 * mean + 1000 classes.
    """
    mean = float(sketch.mean())
    usual = mean + 4 * mean**0.5 + 8
    level = np.floor(np.log2(np.maximum(sketch / usual, 0.5))).astype(np.int64) + 1
    return (np.minimum(level, 100) * 2 + (sketch > 2 * mean + 1000)).astype(np.uint8)


class Packer:
    """Rows of two numbers, packed by part: what is shuffled is a few long rows for each part.

    A row goes to the part its first number tells; if that is ``HOT``, to the one both tell, unless
    rows of one first number stay ``whole``.
    """

    def __init__(self, parts: int, whole: bool = False):
        self.parts, self.whole, self.waiting, self.n = parts, whole, [], 0

    def add(self, first: np.ndarray, second: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.waiting.append((first, second))
        self.n += len(first)
        if self.n > WAITING_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        first, second = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.n = [], 0
        told = mix(first.view(np.uint64))
        if not self.whole:
            hot = first & 1 == 1
            told[hot] = mix(told[hot] ^ mix(second[hot].view(np.uint64)))
        part = (told % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first, second, part = first[order], second[order], part[order]
        at = _starts(part)
        ends = np.r_[at[1:], len(part)]
        blobs = [first[a:b].tobytes() + second[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
        yield frame(_PACK, part=part[at], rows=blobs)


def dealt(packs: DataFrame) -> DataFrame:
    """What ``Packer`` gave, the packs of a part together."""
    return packs.repartition("part").sortWithinPartitions("part")


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each part, without repeats, by both numbers."""
    for table in whole_runs(batches):
        part = table.column(0).to_numpy()
        blobs = [np.frombuffer(x.as_buffer(), dtype=np.int64).reshape(2, -1) for x in table.column(1)]
        at = _starts(part)
        for a, b in zip(at, np.r_[at[1:], len(part)], strict=True):
            first, second = np.concatenate(blobs[a:b], axis=1)
            order = np.lexsort((second, first))
            first, second = first[order], second[order]
            fresh = _starts(first, second)
            yield first[fresh], second[fresh]


def prefix_entries(
    docs: DataFrame, levels: np.ndarray, words: int, num: int, den: int, parts: int = 1
) -> DataFrame:
    """Packs of (token, sig): the first shingles of every set by (level, hash); equal sets once per task.

    The lowest bit of a token tells whether its count stands out (``HOT``), the others are its hash.
    """

    def fn(batches):
        seen: set[int] = set()
        packer = Packer(parts)
        for _, sets in document_sets(batches, words):
            for grams in sets:
                if not len(grams) or (sig := set_hash(grams)) in seen:
                    continue
                seen.add(sig)
                level = levels[_cells(grams)]
                need = -(-num * len(grams) // den)
                more = max(1, len(grams) // LONGER)
                order = np.argsort(level, kind="stable")[: len(grams) - need + more]
                token = grams[order] & ~HOT | (level[order] & 1)
                yield from packer.add(token.view(np.int64), np.full(len(order), sig, dtype=np.int64))
        yield from packer.rest()

    return over_texts(docs, fn, "part long, rows binary")


def prefix_rows(shared: DataFrame, parts: int) -> DataFrame:
    """Packs of the rows (token, sig) of a table."""

    def fn(batches):
        packer = Packer(parts)
        for batch in batches:
            yield from packer.add(*(c.to_numpy() for c in batch.columns))
        yield from packer.rest()

    return shared.mapInArrow(fn, "part long, rows binary")


def shared_prefixes(entries: DataFrame) -> DataFrame:
    """Distinct (token, sig, centre) of the tokens that more than one class holds, from packs.

    ``centre`` is one of the smallest classes of the token in its part, which holds all its classes,
    or a share of them if the token is dealt by class.
    """

    def fn(batches):
        for token, sig in unpacked(batches):
            out, _ = _shared(np.column_stack([token, sig]), last=True)
            if len(out):
                at = _starts(out[:, 0])
                lead = np.repeat(out[at, 1], np.diff(np.r_[at, len(out)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(lead)], ["token", "sig", "centre"]
                )

    return dealt(entries).mapInArrow(fn, "token long, sig long, centre long")


def _shared(rows: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of tokens with several classes, and the last one or two rows if more may follow.

    Of the last token the first and the last row stay behind: they tell a later batch that the
    token is shared and which class it had last.
    """
    if not len(rows):
        return rows, rows
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    rows = rows[fresh]
    turn = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    sizes = np.diff(np.r_[turn, len(rows)])
    held = (np.repeat(sizes, sizes) > 1) | (rows[:, 0] & 1 == 1)
    if last:
        return rows[held], rows[:0]
    tail = rows[turn[-1] :]
    if len(tail) > 2:  # what lies between is settled
        held[turn[-1]] = held[-1] = False
        return rows[held], tail[[0, -1]]
    return rows[: turn[-1]][held[: turn[-1]]], tail


def candidates(shared: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """(sig): the classes that share as many prefix shingles as any similar set would give them.

    Prefixes are n - need + k long with k = max(1, n // LONGER), so the first min(k, k') common
    shingles of a similar pair lie in both; the other set has need = ceil(t n) shingles at least.
    """
    need = F.ceil(F.col("n") * num / den)
    return (
        shared.groupBy("sig")
        .agg(F.count("*").alias("common"))
        .join(sizes, "sig")
        .filter(F.col("common") >= F.greatest(F.lit(1), F.floor(need / LONGER)))
        .select("sig")
    )


def candidate_bits(rows: DataFrame, wanted: DataFrame) -> np.ndarray:
    """A fixed-size bitmap of one document of each class in ``wanted``."""
    key = F.coalesce("doc_id", "sig")
    first = rows.join(wanted, "sig").groupBy("sig").agg(F.min(key).alias("key"))
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(key, 18), 64) as int))")
    bits = first.groupBy(F.pmod("key", F.lit(FILTER_WORDS)).alias("word")).agg(F.bit_or(bit).alias("bits"))
    table = np.zeros(FILTER_WORDS, dtype=np.int64)
    found = bits.toArrow()  # as arrays: rows of Python objects would take many times as much of the driver
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def set_entries(docs: DataFrame, table: np.ndarray, levels: np.ndarray, words: int, parts: int = 1) -> DataFrame:
    """Packs of (token, sig): all shingles of the documents in the bitmap, tokens as in ``prefix_entries``.

    The bitmap may let other documents through; they are compared as well and change no result.
    """

    def fn(batches):
        packer = Packer(parts)
        for ids, sets in document_sets(batches, words):
            for own_id, grams in zip(ids, sets, strict=True):
                if not len(grams):
                    continue
                sig = set_hash(grams)
                key = sig if own_id is None else own_id
                if int(table[key % FILTER_WORDS]) >> ((key >> 18) % 64) & 1:
                    token = grams & ~HOT | (levels[_cells(grams)] & 1)
                    yield from packer.add(token.view(np.int64), np.full(len(grams), sig, dtype=np.int64))
        yield from packer.rest()

    return over_texts(docs, fn, "part long, rows binary")


def whole_runs(batches: Iterator[pa.RecordBatch], columns: int = 1) -> Iterator[pa.Table]:
    """Tables in which all rows with equal first ``columns`` stand together; rows come sorted."""
    waiting: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in range(columns)]
        turn = np.zeros(batch.num_rows, dtype=bool)
        turn[0] = last is not None and tuple(k[0] for k in keys) != last
        for k in keys:
            turn[1:] |= k[1:] != k[:-1]
        at = np.flatnonzero(turn)
        if len(at):
            cut = int(at[-1])
            whole = [*waiting, batch.slice(0, cut)]
            if sum(w.num_rows for w in whole):
                yield pa.Table.from_batches(whole)
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
        last = tuple(k[-1] for k in keys)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """First row of every run of equal keys."""
    turn = np.ones(len(keys[0]), dtype=bool)
    turn[1:] = False
    for k in keys:
        turn[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(turn)


def ordered_sets(entries: DataFrame, parts: int = 1) -> DataFrame:
    """(sig, keys) from packs: the shared shingles of every class as ascending keys of the global order.

    A key is the level of the shingle's number of classes (its binary logarithm; hot shingles have
    the highest) above 57 bits of its hash; its lowest bit is ``HOT``.
    """

    def keyed(batches):
        for token, sig in unpacked(batches):
            at = _starts(token)
            sizes = np.diff(np.r_[at, len(token)])
            hot = token[at] & 1 == 1
            level = np.where(hot, TOP_LEVEL, np.minimum(np.log2(sizes).astype(np.int64), TOP_LEVEL - 1))
            hashed = (token[at].view(np.uint64) >> np.uint64(7)) << np.uint64(1)
            key = (level.astype(np.uint64) << np.uint64(58)) | hashed | hot.astype(np.uint64)
            held = np.repeat((sizes > 1) | hot, sizes)
            packer = Packer(parts, whole=True)
            yield from packer.add(sig[held], np.repeat(key.view(np.int64), sizes)[held])
            yield from packer.rest()

    def listed(batches):
        for sig, key in unpacked(batches):
            at = _starts(sig)
            ends = np.r_[at[1:], len(sig)]
            yield frame(_SET, sig=sig[at], keys=[key[a:b].tobytes() for a, b in zip(at, ends, strict=True)])

    pack = "part long, rows binary"
    return dealt(dealt(entries).mapInArrow(keyed, pack)).mapInArrow(listed, "sig long, keys binary")


def key_prefixes(sets: DataFrame, num: int, den: int, more: int = 0) -> DataFrame:
    """(token, sig) of the keys in the prefix of every set, ``more`` keys longer if asked for."""

    def fn(batches):
        for batch in batches:
            tokens, sigs = [], []
            for sig, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.frombuffer(blob, dtype=np.int64)
                own = keys[: len(keys) + num * n // -den + 1 + more]
                tokens.append(own)
                sigs.append(np.full(len(own), sig, dtype=np.int64))
            if tokens:
                yield frame(_ENTRY, token=np.concatenate(tokens), sig=np.concatenate(sigs))

    return sets.select("sig", "n", "keys").mapInArrow(fn, "token long, sig long")


def block_links(blocks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between the components of each block of (bucket, next, part, sig, comp).

    What a block connects comes out as a star around its smallest component, so that labels need
    few rounds, whatever chains the sets of a block make.
    """

    def fn(batches):
        for table in whole_runs(batches, columns=3):
            names = ["bucket", "next", "part", "sig", "n", "comp"]
            *where, sig, n, comp = (table.column(c).to_numpy() for c in names)
            blobs = table.column("keys")
            at = _starts(*where)
            left, right = [], []
            for a, b in zip(at, np.r_[at[1:], len(sig)], strict=True):
                if (comp[a:b] == comp[a]).all():
                    continue
                keys = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in blobs[a:b]]
                labels, own = np.unique(comp[a:b], return_inverse=True)
                forest = Forest(len(labels))
                for x, y in similar(keys, comp[a:b].tolist(), num, den, n[a:b]):
                    forest.union(int(own[x]), int(own[y]))
                roots = np.array([forest.root(k) for k in range(len(labels))])
                moved = np.flatnonzero(roots != np.arange(len(labels)))
                left.extend(labels[roots[moved]])
                right.extend(labels[moved])
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"]
            )

    return (
        blocks.join(sets, "sig")
        .select("bucket", "next", "part", "sig", "n", "comp", "keys")
        .repartition("bucket", "next", "part")
        .sortWithinPartitions("bucket", "next", "part", "n", "sig")
        .mapInArrow(fn, "a long, b long")
    )


def _part(parts: Column) -> Column:
    """The block of a class among the ``parts`` of its list."""
    return F.pmod(F.xxhash64("sig", F.lit(7)), parts).cast("int")


def first_round(shared: DataFrame, limit: int = BLOCK_SETS) -> DataFrame:
    """Blocks of each centre with the classes that have most prefix shingles in common with it."""
    pairs = (
        shared.filter(F.col("centre") != F.col("sig"))
        .groupBy("sig", "centre")
        .agg(F.count("*").alias("common"))
        .groupBy("sig")
        .agg(F.min(F.struct(-F.col("common"), "centre")).alias("best"))
        .select(F.col("best.centre").alias("bucket"), "sig")
    )
    pairs = materialize(pairs)
    parts = pairs.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(limit)).alias("parts"))
    sized = pairs.join(parts, "bucket").select("bucket", _part(F.col("parts")).alias("part"), "sig")
    centres = sized.select("bucket", "part").distinct().select("bucket", "part", F.col("bucket").alias("sig"))
    return sized.unionByName(centres).select(
        "bucket", F.lit(0).cast("long").alias("next"), "part", "sig", F.col("sig").alias("comp")
    )


def _lists(held: DataFrame) -> DataFrame:
    """One row for every distinct list of classes that is not connected: its name and its base.

    ``held`` has (token, next, sig, comp). ``base`` is the largest component, ``others`` the number
    of classes outside of it, ``low`` one of the classes, ``reach`` the sum of that column if given.
    """
    reach = F.col("reach") if "reach" in held.columns else F.lit(0)
    by_comp = held.groupBy("token", "next", "comp").agg(
        F.count("*").alias("n"),
        F.min("sig").alias("low"),
        F.sum(reach).alias("reach"),
        F.bit_xor(F.xxhash64("sig")).alias("x"),
        F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y"),
    )
    return (
        by_comp.groupBy("token", "next")
        .agg(
            F.count("*").alias("comps"),
            F.sum("n").alias("n"),
            F.max(F.struct("n", "comp")).alias("top"),
            F.min("low").alias("low"),
            F.sum("reach").alias("reach"),
            F.bit_xor("x").alias("x"),
            F.bit_xor("y").alias("y"),
        )
        .filter("comps > 1")
        .groupBy("n", "x", "y")
        .agg(F.min(F.struct("token", "next", "top", "low", "reach")).alias("one"))
        .select(
            "one.token", "one.next", "n", F.col("one.top.comp").alias("base"),
            (F.col("n") - F.col("one.top.n")).alias("others"), "one.low", "one.reach",
        )
    )


def second_round(
    shared: DataFrame, comps: DataFrame, sets: DataFrame, num: int, den: int, limit: int = BLOCK_SETS
) -> DataFrame:
    """Blocks of all classes that may be similar to a class they are not connected with.

    Lists that are connected hold no such pair. The others make families of classes that meet.
    Where more than ``limit`` classes of a family are outside its largest component and the blocks
    of its lists have fewer rows than those of the whole, its lists are taken one by one. In the
    same way a list is dealt by the next shingle its classes have in common, if that takes fewer
    rows: of a similar pair the first two common shingles lie in prefixes that are one longer.
    """
    none, comp = F.lit(0).cast("long").alias("next"), F.coalesce("comp", "sig").alias("comp")
    held = materialize(shared.join(comps, "sig", "left").select("token", none, "sig", comp))
    open_lists = (
        held.groupBy("token")
        .agg(F.min("sig").alias("low"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        .filter("lo < hi")
        .select("token", "low")
    )
    held = materialize(held.join(open_lists, "token"))
    meeting = components(held.select(F.col("low").alias("a"), F.col("sig").alias("b")))
    family = (
        held.select("sig", "comp")
        .distinct()
        .join(meeting.withColumnRenamed("comp", "token"), "sig")
        .select("token", none, "sig", "comp")
    )
    family = materialize(family)
    families = materialize(_lists(family))
    narrow = F.col("others") <= limit
    wide = families.filter(~narrow)
    if wide.isEmpty():
        return _blocks(family, families, limit)
    reach = F.octet_length("keys") / 8 - F.ceil(F.col("n") * num / den) + 2
    longest = sets.select("sig", F.greatest(F.lit(1), reach).cast("long").alias("reach"))
    placed = family.join(wide, ["token", "next"]).select("sig", F.col("token").alias("family"))
    held = materialize(held.drop("low").join(placed.select("sig"), "sig").join(longest, "sig"))
    rows = _block_rows(limit)
    lists = (
        _lists(held)
        .join(placed.withColumnRenamed("sig", "low"), "low")
        .withColumn("deal", ~narrow & (F.col("reach") < rows))
        .withColumn("cost", F.when(F.col("deal"), F.col("reach")).otherwise(rows))
    )
    lists = materialize(lists)
    costs = lists.groupBy(F.col("family").alias("token")).agg(F.sum("cost").alias("cost"))
    split = materialize(wide.join(costs, "token").filter(F.col("cost") < rows).select("token"))
    blocks = _blocks(family, families.join(split, "token", "left_anti"), limit)
    if split.isEmpty():
        return blocks
    lists = lists.join(split.withColumnRenamed("token", "family"), "family", "left_semi")
    blocks = blocks.unionByName(_blocks(held, lists.filter(~F.col("deal")), limit))
    large = lists.filter("deal").select("token")
    if large.isEmpty():
        return blocks
    longer = key_prefixes(sets, num, den, more=1).select(F.col("token").alias("later"), "sig")
    deeper = materialize(
        held.join(large, "token")
        .join(longer, "sig")
        .filter(F.col("later") > F.col("token"))
        .select("token", F.col("later").alias("next"), "sig", "comp")
    )
    return blocks.unionByName(_blocks(deeper, _lists(deeper), limit))


def _parts(limit: int) -> tuple[Column, Column]:
    """Into how many parts the base of a list and its other classes are cut."""
    others = F.col("others")
    cut = lambda rows: F.greatest(F.lit(1), F.ceil(rows / F.lit(limit))).cast("int")
    return cut(F.col("n") - others), cut(others)


def _block_rows(limit: int) -> Column:
    """Number of rows that ``_blocks`` makes of a list."""
    own, beside = _parts(limit)
    others = F.col("others")
    return (F.col("n") - others) * beside + others * (own + beside - 1)


def _blocks(held: DataFrame, lists: DataFrame, limit: int) -> DataFrame:
    """(bucket, next, part, sig, comp): each part of a list's base with each part of the other
    classes, and the parts of the others by twos; no block has more than two parts."""
    own, beside = _parts(limit)
    rows = held.join(lists.select("token", "next", "n", "base", "others"), ["token", "next"])
    here = _part(beside)
    with_base = F.transform(F.sequence(F.lit(0), own - 1), lambda i: i * beside + here)
    apart = F.filter(F.sequence(F.lit(0), beside - 1), lambda k: k != here)
    by_twos = F.transform(
        apart, lambda k: own * beside + F.least(k, here) * beside + F.greatest(k, here)
    )
    spread = F.when(
        F.col("comp") == F.col("base"),
        F.transform(F.sequence(F.lit(0), beside - 1), lambda j: _part(own) * beside + j),
    ).otherwise(F.concat(with_base, by_twos))
    return rows.select(F.col("token").alias("bucket"), "next", F.explode(spread).alias("part"), "sig", "comp")


def components(links: DataFrame) -> DataFrame:
    """(sig, comp): the smallest node each node reaches, by minimum labels and pointer jumps."""
    edges = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = materialize(
        edges.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "sig")
    )
    while True:
        beside = (
            edges.join(labels, F.col("b") == F.col("sig"))
            .groupBy("a")
            .agg(F.min("comp").alias("low"))
        )
        lower = labels.join(beside, F.col("sig") == F.col("a")).select(
            "sig", "comp", F.least("comp", "low").alias("low")
        )
        jump = labels.select(F.col("sig").alias("low"), F.col("comp").alias("root"))
        step = materialize(
            lower.join(jump, "low", "left").select(
                "sig",
                F.least("low", F.coalesce("root", "low")).alias("comp"),
                (F.least("low", F.coalesce("root", "low")) < F.col("comp")).alias("moved"),
            )
        )
        labels = step.select("sig", "comp")
        if step.filter("moved").isEmpty():
            return labels


def jaccard_components(
    docs: DataFrame, words: int = 5, num: int = 75, den: int = 100, block: int = BLOCK_SETS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    Two documents link when den * intersection >= num * union of their shingle sets;
    component_id is the smallest doc_id reachable by links. Null or wordless texts have no
    shingles, link with nothing and are their own component. Rows with equal sets are linked;
    repeated rows are returned as often as they come. A null doc_id is never a component_id
    unless no member has an id. Columns other than doc_id and text are not read.
    """
    rows = materialize(profiles(docs, words))
    levels = sketch_levels(gather_sketch(rows))
    rows = rows.filter(F.col("part").isNull()).select("doc_id", "n", "sig")
    sizes = rows.filter("sig is not null").groupBy("sig").agg(F.first("n").alias("n"))
    # shingles of all sets, and the prefixes that are a third of them
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // (3 * PACK_ROWS)))
    found = shared_prefixes(prefix_entries(docs, levels, words, num, den, parts))
    table = candidate_bits(rows, candidates(found, sizes, num, den))
    sets = materialize(
        ordered_sets(set_entries(docs, table, levels, words, parts), parts)
        .join(sizes, "sig")
        .filter(F.octet_length("keys") / 8 >= F.ceil(F.col("n") * num / den))
        .select("sig", "n", "keys")
    )
    shared = materialize(shared_prefixes(prefix_rows(key_prefixes(sets, num, den), parts)))
    first = materialize(block_links(first_round(shared, block), sets, num, den))
    comps = components(first)
    blocks = second_round(shared, comps, sets, num, den, block)
    second = materialize(block_links(blocks, sets, num, den))
    # the second round links components of the first, so its labels stand above theirs
    above = components(second).select(F.col("sig").alias("comp"), F.col("comp").alias("top"))
    placed = (
        rows.join(comps, "sig", "left")
        .withColumn("comp", F.coalesce("comp", "sig"))
        .join(above, "comp", "left")
        .withColumn("comp", F.coalesce("top", "comp"))
    )
    lowest = placed.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("low"))
    return placed.join(lowest, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id")
    )


def one_per_component(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id; all columns stay."""
    losers = (
        jaccard_components(docs, **options)
        .filter(F.col("component_id") < F.col("doc_id"))
        .select(F.col("doc_id").alias("_loser"))
        .distinct()
    )
    return docs.join(losers, docs["doc_id"] == F.col("_loser"), "left_anti")
