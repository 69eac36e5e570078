"""Phrase collocation mining by dynamic itemset counting.

Documents are dealt to ``shards`` by a hash of their id and the shards are scanned in a cycle.
Words are counted from the first scan on. After each scan the phrases that have reached the
threshold so far are found; a phrase of two or three words is counted from the scan after the one
in which both of its subphrases (all but the last word, all but the first) had reached it, for one
full cycle, so that every document is counted once for it. Lengths are interleaved: one scan counts
words that began with it, pairs that began later and triples that began later still.

A phrase is a 64-bit hash of its language and words. What has reached the threshold is told to the
scans by a map of a fixed number of cells with the step of their first phrase; phrases that share a
cell begin early and are counted in vain, which costs time and changes no count. Counts travel as
sorted blocks, one for each task and range of hashes, and never leave the executors. Two phrases
of a corpus with n distinct ones share a hash with a probability of n^2 / 2^65.

Beside its count a phrase has the tag, one byte of the id's hash, of some document that holds it. A
last scan reads the words of the phrases at the threshold out of the documents with their tag.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import frame, gram_hashes, mix, pack, slices, unpack, word_hashes
from palimpsest.operators.scale import top_per_group
from palimpsest.session import estimated_bytes, materialize

SHARDS = 2
THRESHOLD = 10
LONGEST = 3
TOP = 2000
NEVER = 255  # step or tag of a cell that holds no phrase
ANY = 254  # tag of a cell with phrases of several tags
FLUSH = 1 << 21  # counted phrases after which a task lets them go
BUCKET_BYTES = 16 << 20  # input bytes for each range of hashes, about

_BREAK = np.zeros(256, dtype=bool)  # ends a piece
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_GAP = _BREAK.copy()  # ends a word
_GAP[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BLOCK = pa.schema([("k", pa.int32()), ("began", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
_STATE = pa.schema([*_BLOCK, ("bits", pa.binary()), ("tags", pa.binary())])
_TOTAL = pa.schema([("key", pa.int64()), ("k", pa.int32()), ("n", pa.int64())])
_NAME = pa.schema(
    [("key", pa.int64()), ("k", pa.int32()), ("langh", pa.int64()), ("phrase", pa.string()),
     ("l1", pa.int64()), ("r1", pa.int64()), ("l2", pa.int64()), ("r2", pa.int64())]
)


class Words:
    """The words of some documents, with the keys of all phrases that lie within a piece.

    ``heads`` has the language hash of every document with its tag in the lowest byte.
    """

    def __init__(self, heads: np.ndarray, raw: np.ndarray, off: np.ndarray):
        self.raw = raw = _LOWER[raw]
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[off] = True
        inside = ~_GAP[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(off, self.starts, "right") - 1
        heads = heads[self.doc] if len(self.doc) else np.empty(0, np.int64)
        self.langs, self.tags = heads & ~np.int64(255), (heads & 255).view(np.uint64)
        piece = np.cumsum(_BREAK[raw])[self.starts] if len(raw) else self.starts
        hashed = word_hashes(raw, self.starts, self.ends, fold=False)
        keys = mix(hashed ^ mix(self.langs.view(np.uint64)))
        same = (piece[1:] == piece[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.keys, self.whole = {1: keys}, {1: np.ones(len(keys), dtype=bool)}
        for k in range(2, LONGEST + 1):
            self.keys[k] = gram_hashes(keys, k)
            before = self.whole[k - 1]
            self.whole[k] = before[:-1] & before[1:] if k > 2 else same
            self.whole[k] = self.whole[k][: len(self.keys[k])]


def cells_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Cell (or range) of every key among 2^bits: ranges of the keys in ascending order."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def tagged(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As ``summed`` for values of count * 256 + tag; of the tags of a key one stays."""
    every, amount = np.concatenate(keys), np.concatenate(values)
    order = np.argsort(every, kind="stable")
    every, amount = every[order], amount[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
    if not len(first):
        return every, amount
    low = amount & np.uint64(255)
    return every[first], np.add.reduceat(amount - low, first) + low[first]


def active(
    words: Words, k: int, levels: dict[int, np.ndarray], step: int, shards: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(step they began in, keys, tags) of the phrases of ``k`` words to be counted in this step.

    There is one key for each occurrence. ``k`` = 0 stands for the language of a word.
    """
    if k < 2:
        if step < shards:
            yield 0, words.keys[1] if k else words.langs.view(np.uint64), words.tags
        return
    level = levels[k - 1]
    began = level[cells_of(words.keys[k - 1], level.size.bit_length() - 1)].astype(np.int64)
    began = np.maximum(began[:-1], began[1:])[: len(words.keys[k])] + 1
    began[~words.whole[k]] = NEVER
    for first in range(max(0, step - shards + 1), step + 1):
        at = np.flatnonzero(began == first)
        yield first, words.keys[k][at], words.tags[at]


def _levels(shipped) -> dict[int, np.ndarray]:
    return {k: np.frombuffer(zstandard.decompress(b), dtype=np.uint8) for k, b in shipped.value.items()}


def scan(docs: DataFrame, shipped, step: int, shards: int, bucket_bits: int) -> DataFrame:
    """Counts (k, began, bucket, blob) of the phrases that are active in this step, over its shard."""
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards))

    def fn(batches: Iterator[pa.RecordBatch]):
        levels = _levels(shipped)
        held: dict[tuple[int, int], list] = {}

        def flush(k: int, began: int):
            keys, values = tagged(*zip(*held.pop((k, began)), strict=True))
            bucket = cells_of(keys, bucket_bits)
            marks = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else []
            for a, b in zip(marks, [*marks[1:], len(keys)], strict=True):
                blob = pack(keys[a:b], values[a:b])
                yield frame(_BLOCK, k=[k], began=[began], bucket=[int(bucket[a])], blob=[blob])

        for heads, raw, off in slices(batches, id_name="head"):
            words = Words(heads.to_numpy(), raw, off)
            for k in range(LONGEST + 1):
                if k > 1 and k - 1 not in levels:
                    break
                for began, every, tags in active(words, k, levels, step, shards):
                    keys, first, counts = np.unique(every, return_index=True, return_counts=True)
                    if len(keys):
                        own = held.setdefault((k, began), [])
                        own.append((keys, counts.astype(np.uint64) * np.uint64(256) + tags[first]))
                        if sum(len(x) for x, _ in own) > FLUSH:
                            yield from flush(k, began)
        for k, began in list(held):
            yield from flush(k, began)

    return (
        docs.filter(shard == step % shards)
        .select("head", "text")
        .mapInArrow(fn, "k int, began int, bucket int, blob binary")
    )


def merged(
    blocks: DataFrame, threshold: int, bucket_bits: int, cell_bits: int, complete: int
) -> DataFrame:
    """One row (k, began, bucket, blob, bits, tags) for each range: counts, cells at the threshold.

    Of phrases that began by the step ``complete`` the cycle is over: only those at the threshold
    are kept, and language totals, and the tags of their cells are told.
    """

    def done(k: int, began: int, bucket: int, held: list):
        packer = zstandard.ZstdCompressor(level=1)
        keys, values = tagged(*zip(*held, strict=True))
        low = bucket << (cell_bits - bucket_bits)
        width = 1 << (cell_bits - bucket_bits)
        enough = values >= np.uint64(threshold << 8)
        reached, tags = np.zeros(width, dtype=bool), b""
        cells = cells_of(keys[enough], cell_bits) - low
        reached[cells] = True
        if began <= complete and k:
            keys, values = keys[enough], values[enough]
            own, least, most = (values & np.uint64(255)).astype(np.uint8), np.full(width, ANY, "u1"), np.zeros(width, "u1")
            np.minimum.at(least, cells, own)
            np.maximum.at(most, cells, own)
            tags = packer.compress(np.where(least == most, least, ANY)[reached].astype("u1").tobytes())
        return frame(
            _STATE, k=[k], began=[began], bucket=[bucket], blob=[pack(keys, values)],
            bits=[packer.compress(np.packbits(reached).tobytes())], tags=[tags],
        )

    def fn(batches: Iterator[pa.RecordBatch]):
        at, held, size = None, [], 0
        for batch in batches:
            for k, began, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and at != (k, began, bucket):
                    yield done(*at, held)
                    held, size = [], 0
                at = k, began, bucket
                held.append(unpack(blob))
                size += len(held[-1][0])
                if size > FLUSH:
                    held = [tagged(*zip(*held, strict=True))]
                    size = len(held[0][0]) // 2
        if at is not None:
            yield done(*at, held)

    return (
        blocks.select("k", "began", "bucket", "blob")
        .repartition(F.xxhash64("k", "began", "bucket"))
        .sortWithinPartitions("k", "began", "bucket")
        .mapInArrow(fn, "k int, began int, bucket int, blob binary, bits binary, tags binary")
    )


def raise_levels(
    levels: dict[int, np.ndarray], tags: dict[int, np.ndarray], state: DataFrame, step: int, bucket_bits: int
) -> None:
    """Note ``step`` in the cells that have reached the threshold for the first time, and tags."""
    for row in state.filter("k > 0").select("k", "bucket", "bits", "tags").collect():
        k = row["k"]
        width = levels[k].size >> bucket_bits
        own = slice(row["bucket"] * width, (row["bucket"] + 1) * width)
        bits = np.unpackbits(np.frombuffer(zstandard.decompress(row["bits"]), dtype=np.uint8), count=width)
        part = levels[k][own]
        part[(bits == 1) & (part == NEVER)] = step
        if row["tags"] and k in tags:
            new, part = np.frombuffer(zstandard.decompress(row["tags"]), dtype=np.uint8), tags[k][own]
            at = np.flatnonzero(bits)
            old = part[at]
            part[at] = np.where((old == NEVER) | (old == new), new, ANY)


def totals(state: DataFrame, threshold: int) -> DataFrame:
    """(key, k, n) of the phrases at or above the threshold."""

    def fn(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, values = unpack(blob)
                counts = values >> np.uint64(8)
                keep = counts >= (threshold if k else 0)
                keys = keys[keep]
                yield frame(
                    _TOTAL, key=keys.view(np.int64), k=np.full(len(keys), k), n=counts[keep].astype(np.int64)
                )

    return state.select("k", "blob").mapInArrow(fn, "key long, k int, n long")


def named(docs: DataFrame, shipped) -> DataFrame:
    """Phrases of two and more words whose cell has the document's tag, once for each task.

    With the keys of the parts of their cuts. ``shipped`` has the tags of the cells.
    """

    def fn(batches: Iterator[pa.RecordBatch]):
        tags = _levels(shipped)
        seen = {k: np.empty(0, np.uint64) for k in tags}
        for heads, raw, off in slices(batches, id_name="head"):
            words = Words(heads.to_numpy(), raw, off)
            data = words.raw.tobytes()
            for k in range(2, LONGEST + 1):
                wanted, own = tags[k], words.keys[k]
                at = np.flatnonzero(words.whole[k])
                told = wanted[cells_of(own[at], wanted.size.bit_length() - 1)]
                at = at[(told == words.tags[at]) | (told == ANY)]
                keys, first = np.unique(own[at], return_index=True)
                place = np.minimum(np.searchsorted(seen[k], keys), max(0, len(seen[k]) - 1))
                new = seen[k][place] != keys if len(seen[k]) else np.ones(len(keys), dtype=bool)
                keys, at = keys[new], at[first[new]]
                if not len(keys):
                    continue
                seen[k] = np.sort(np.concatenate([seen[k], keys]))
                one, rest, most = words.keys[1], words.keys[k - 1], len(keys)
                signed = lambda x: x.view(np.int64)
                text = [b" ".join(data[words.starts[i] : words.ends[i + k - 1]].split()).decode() for i in at]
                yield frame(
                    _NAME, key=signed(keys), k=np.full(most, k), langh=words.langs[at], phrase=text,
                    l1=signed(one[at]), r1=signed(rest[at + 1]),
                    l2=signed(rest[at]) if k > 2 else [None] * most,
                    r2=signed(one[at + k - 1]) if k > 2 else [None] * most,
                )

    schema = "key long, k int, langh long, phrase string, l1 long, r1 long, l2 long, r2 long"
    return docs.select("head", "text").mapInArrow(fn, schema)


def lang_hash(lang: Column) -> Column:
    """Hash of a language, null as ``und``, whose lowest byte is free."""
    return F.shiftleft(F.shiftright(F.xxhash64(F.coalesce(lang.cast("string"), F.lit("und"))), 8), 8)


def _log2(x: float, low: int, high: int) -> int:
    return min(high, max(low, int(x).bit_length()))


def phrase_counts(docs: DataFrame, shards: int, threshold: int) -> tuple[DataFrame, dict[int, np.ndarray], DataFrame]:
    """(key, k, n) at the threshold, the tags of their cells, and the prepared documents."""
    spark = docs.sparkSession
    size = estimated_bytes(docs)
    bucket_bits = _log2(size / BUCKET_BYTES, 6, 16)
    cell_bits = _log2(size / 16, 20, 26)
    prepared = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (lang_hash(F.col("lang")) + F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(ANY))).alias("head"),
        F.col("text").cast("string").alias("text"),
    )
    levels = {k: np.full(1 << cell_bits, NEVER, dtype=np.uint8) for k in range(1, LONGEST + 1)}
    tags = {k: level.copy() for k, level in levels.items() if k > 1}
    packer = zstandard.ZstdCompressor(level=1)
    waiting, counted = None, []  # counts of phrases whose cycle goes on, and of all others

    def ship(ks) -> object:
        return spark.sparkContext.broadcast({k: packer.compress(levels[k].tobytes()) for k in ks})

    longest = []
    for step in range(LONGEST * shards):
        found = materialize(scan(prepared, ship(range(1, min(LONGEST, step + 1))), step, shards, bucket_bits))
        longest.append(found.filter(F.col("k") == LONGEST))
        if step >= (LONGEST - 1) * shards:  # only the longest are left, which are needed at the end
            continue
        shorter, complete = found.filter(F.col("k") < LONGEST), step - shards + 1
        blocks = shorter if waiting is None else shorter.unionByName(waiting)
        state = materialize(merged(blocks, threshold, bucket_bits, cell_bits, complete))
        raise_levels(levels, tags, state, step, bucket_bits)
        counted.append(state.filter(F.col("began") <= complete))
        waiting = state.filter(F.col("began") > complete).select(*_BLOCK.names)
    blocks = functools.reduce(DataFrame.unionByName, longest)
    state = materialize(merged(blocks, threshold, bucket_bits, cell_bits, LONGEST * shards))
    raise_levels(levels, tags, state, LONGEST * shards, bucket_bits)
    rows = functools.reduce(DataFrame.unionByName, counted, state)
    return materialize(totals(rows, threshold)), tags, prepared


def collocations(
    docs: DataFrame, top: int = TOP, threshold: int = THRESHOLD, shards: int = SHARDS
) -> DataFrame:
    """The ``top`` phrases of two or three words of every language.

    (lang, rank, phrase, a, l, r, n, score): occurrences of the phrase, of the parts of its
    lowest-scoring cut, of all words of the language, and floor(1000000 a a / (l r)). Words are
    lower-cased (A-Z), pieces end at ``.,;:!?`` and line ends. Phrases below the threshold are no
    candidates; a candidate falls away if a longer candidate holds it in half of its occurrences
    or more. Null texts are empty, a null language is ``und``, repeated rows count as often as
    they come, null ids too; other columns are not read.
    """
    every, tags, prepared = phrase_counts(docs, shards, threshold)
    packer = zstandard.ZstdCompressor(level=1)
    shipped = docs.sparkSession.sparkContext.broadcast(
        {k: packer.compress(tags[k].tobytes()) for k in tags}
    )
    langs = (
        docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
        .distinct()
        .withColumn("langh", lang_hash(F.col("lang")))
    )
    words = every.filter("k = 0").select(F.col("key").alias("langh"), "n")
    every = every.filter("k > 0")
    names = named(prepared, shipped).dropDuplicates(["key"])
    phrases = materialize(names.join(every.select("key", F.col("n").alias("a")), "key"))
    cuts = phrases.select(
        "key",
        "a",
        F.explode(
            F.expr(
                "filter(array(struct(1 AS cut, l1 AS lk, r1 AS rk), struct(2 AS cut, l2 AS lk, r2 AS rk)), "
                "x -> x.lk IS NOT NULL)"
            )
        ).alias("c"),
    ).select("key", "a", "c.*")
    exact = "cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000BD div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    best = (
        cuts.join(every.select(F.col("key").alias("lk"), F.col("n").alias("l")), "lk")
        .join(every.select(F.col("key").alias("rk"), F.col("n").alias("r")), "rk")
        .withColumn("score", F.expr(exact))
        .groupBy("key")
        .agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    )
    longer = phrases.filter(F.col("k") > 2)
    around = (
        longer.select(F.col("l2").alias("key"), "a")
        .unionByName(longer.select(F.col("r1").alias("key"), "a"))
        .groupBy("key")
        .agg(F.max("a").alias("around"))
    )
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    found = (
        phrases.select("key", "langh", "phrase", "a")
        .join(best.select("key", "best.*"), "key")
        .join(around, "key", "left")
        .filter("around is null or 100 * around < 50 * a")
    )
    ranked = top_per_group(found, ["langh"], order, top).withColumn("rank", F.col("rank").cast("long"))
    return (
        ranked.join(words, "langh")
        .join(langs, "langh")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
    )
