"""Token-id store: documents compressed one by one with a shared zstandard dictionary.

A store is a table of shards, (part, shard, ids, blob) with the number of ids, beside a one-row table of the dictionary. A blob
is self-contained but for the dictionary:

    magic "TIDS", version u16, id width u16, dictionary hash u64, documents u64,
    then per document: doc_id i64, flags u8 (bit 0: doc_id is null), end offset of its frame u64,
    ids u64, then the frames.

Numbers are little-endian. Each frame is one zstandard frame holding one document's ids, so a short
document is read by slicing its frame. Shards follow each other in ascending (part, shard), and
their documents in ascending doc_id, null first.

Encoding cuts a text where the pre-tokeniser of the byte-level vocabulary always starts anew: at
white space behind a visible ASCII character or Latin letter, and at ASCII punctuation behind a
letter. The stretches encode alone as they do in the text, so each distinct one is encoded once
and remembered, per worker and up to a bounded number.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.arrays import SLICE_BYTES, UnitTable, frame, kept, over_texts, slices
from palimpsest.session import checkpoint_dir

END_ID = 2
SHARD_BYTES = 1 << 20  # compressed bytes after which a shard is closed
DICTIONARY_BYTES = 64 << 10
DICTIONARY_ROWS = 2000  # documents the dictionary is trained on, at most
DICTIONARY_IDS = 2000  # ids of each that the trainer sees, at most
CACHED_UNITS = 2_000_000  # a worker forgets its stretches beyond that
LEVEL = 3
_HEAD = struct.Struct("<4sHHQQ")
_ENTRY = struct.Struct("<qBQQ")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: visible Latin-1 characters stand for themselves, others for U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[33:127] = True
_PUNCTUATION = _VISIBLE & ~_LETTER
_PUNCTUATION[48:58] = False
# one stretch of these is one word of the pre-tokeniser
_ONE_WORD = re.compile(" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-/:-@[-`{-~]+)")


class Encoder:
    """Ids of whole texts with one vocabulary file of the tokenizers library.

    The strings of special tokens in a text become their ids, as the library does it, or ordinary
    text if ``plain`` is set.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        added = [] if plain else self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.encode() for t in added]
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        self.units = UnitTable(self.dtype, CACHED_UNITS)

    def make(self, units: list[bytes]) -> list[np.ndarray]:
        """Encode stretches; those of one word skip the pre-tokeniser."""
        out: list[np.ndarray | None] = [None] * len(units)
        rest = []
        for k, unit in enumerate(units):
            if _ONE_WORD.fullmatch(unit.decode()):
                tokens = self.model.tokenize(unit.decode("latin-1").translate(self.letters))
                out[k] = np.array([t.id for t in tokens], dtype=self.dtype)
            else:
                rest.append(k)
        made = self.tokenizer.encode_batch_fast([units[k].decode() for k in rest], add_special_tokens=False)
        for k, m in zip(rest, made, strict=True):
            out[k] = np.array(m.ids, dtype=self.dtype)
        return out

    def encode(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of the documents between the offsets."""
        if not len(raw):
            return [np.empty(0, self.dtype)] * (len(off) - 1)
        latin = np.zeros(len(raw), dtype=bool)  # last byte of U+00C0-U+00FF but for two signs
        latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        letter = _LETTER[raw] | latin
        cut = np.zeros(len(raw), dtype=bool)
        cut[1:] = (_SPACE[raw[1:]] & (_VISIBLE[raw[:-1]] | latin[:-1])) | (
            _PUNCTUATION[raw[1:]] & letter[:-1]
        )
        cut[off[:-1][off[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        ids, done = self.units.gather(self.units.rows(raw, starts, ends, self.make))
        marks = np.concatenate([[0], done])[np.searchsorted(starts, off)]
        out = [ids[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]
        data = raw.tobytes() if self.special else b""
        if any(s in data for s in self.special):  # such a text is encoded in one piece
            for k, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True)):
                if any(s in data[a:b] for s in self.special):
                    made = self.tokenizer.encode(data[a:b].decode(), add_special_tokens=False)
                    out[k] = np.array(made.ids, dtype=self.dtype)
        return out


def encoder(path: str, plain: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; it keeps its stretches from task to task."""
    return kept("encoder", (path, plain), lambda: Encoder(path, plain))


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int):
    """(doc_id, ids as bytes) of whole documents, the end id included."""
    coder = encoder(path)
    end = np.array([end_id], dtype=coder.dtype).tobytes()
    for ids, raw, off in slices(batches, size=4 * SLICE_BYTES):
        for doc_id, made in zip(ids.to_pylist(), coder.encode(raw, off), strict=True):
            yield doc_id, made.tobytes() + end


def train_dictionary(docs: DataFrame, path: str, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary from the ids of the documents with the smallest id hashes.

    DICTIONARY_ROWS and DICTIONARY_IDS bound what is trained on; every document is compressed with
    the result. Too little to train on gives an empty dictionary.
    """
    picked = (
        docs.select("doc_id")
        .filter("doc_id is not null")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(DICTIONARY_ROWS)
        .distinct()
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def fn(batches):
        width = encoder(path).dtype.itemsize
        for doc_id, made in encoded(batches, path, end_id):
            yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "ids": [made[: DICTIONARY_IDS * width]]})

    rows = over_texts(sample, fn, "doc_id long, ids binary", keeps=True).collect()
    samples = [bytes(r["ids"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["ids"]))]
    if len(samples) < 8 or sum(map(len, samples)) < 8 * DICTIONARY_BYTES // 10:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # the trainer refuses samples that hold nothing in common
        return b""


def dictionary_hash(dictionary: bytes) -> int:
    return int.from_bytes(hashlib.sha256(dictionary).digest()[:8], "little")


def pack(docs: list[tuple[int | None, int, bytes]], width: int, dictionary: bytes) -> bytes:
    """A shard blob of (doc_id, number of ids, frame) rows."""
    head = [_HEAD.pack(b"TIDS", 1, width, dictionary_hash(dictionary), len(docs))]
    end = 0
    for doc_id, n, data in docs:
        end += len(data)
        head.append(_ENTRY.pack(doc_id or 0, doc_id is None, end, n))
    return b"".join(head + [d for _, _, d in docs])


class Shard:
    """A blob whose documents are decompressed one at a time."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, version, self.width, named, self.count = _HEAD.unpack_from(blob)
        if magic != b"TIDS" or version != 1:
            raise ValueError("not a token-id shard")
        if named != dictionary_hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.blob = blob
        self.base = _HEAD.size + self.count * _ENTRY.size
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.reader = zstandard.ZstdDecompressor(dict_data=given)

    def entry(self, k: int) -> tuple[int | None, int, int, int]:
        """(doc_id, first byte, last byte, number of ids) of the k-th document."""
        doc_id, null, end, n = _ENTRY.unpack_from(self.blob, _HEAD.size + k * _ENTRY.size)
        start = _ENTRY.unpack_from(self.blob, _HEAD.size + (k - 1) * _ENTRY.size)[2] if k else 0
        return None if null else doc_id, self.base + start, self.base + end, n

    def ids(self, k: int) -> np.ndarray:
        _, a, b, n = self.entry(k)
        data = self.reader.decompress(self.blob[a:b], max_output_size=n * self.width)
        return np.frombuffer(data, dtype=f"<u{self.width}")


def write_store(
    docs: DataFrame, folder: str, path: str, end_id: int = END_ID, dictionary: bytes | None = None
) -> None:
    """Encode ``docs`` with the vocabulary file ``path`` and write the store to ``folder``.

    Documents are dealt into ranges of (doc_id, hash of the text), so neither a repeated id nor a
    long text makes a range that can't be split. A null text is empty. Other columns are not read.
    """
    spark = docs.sparkSession
    if dictionary is None:
        dictionary = train_dictionary(docs, path, end_id)

    def fn(batches):
        schema = pa.schema(
            [("part", pa.int64()), ("shard", pa.int64()), ("ids", pa.int64()), ("blob", pa.binary())]
        )
        part, shard, size, held = TaskContext.get().partitionId(), 0, 0, []
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=given)
        width = encoder(path).dtype.itemsize

        def closed():
            blob = pack(held, width, dictionary)
            return frame(schema, part=[part], shard=[shard], ids=[sum(h[1] for h in held)], blob=[blob])

        for doc_id, ids in encoded(batches, path, end_id):
            data = press.compress(ids)
            held.append((doc_id, len(ids) // width, data))
            size += len(data)
            if size >= SHARD_BYTES:
                yield closed()
                shard, size, held = shard + 1, 0, []
        if held:
            yield closed()

    texts = docs.select("doc_id", "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = texts.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    stored = over_texts(dealt, fn, "part long, shard long, ids long, blob binary", keeps=True)
    stored.write.mode("overwrite").parquet(f"{folder}/shards")
    one = spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary")
    one.write.mode("overwrite").parquet(f"{folder}/dictionary")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a store, decoded from its shards.

    start counts the ids of all documents before it. Only totals per part meet in one place, and
    their number is that of the tasks that wrote the store.
    """
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    schema = pa.schema(
        [("part", pa.int64()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("inside", pa.int64()),
         ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    )

    def fn(batches):
        for batch in batches:
            for part, shard, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                opened, inside = Shard(blob, dictionary), 0
                rows: dict[str, list] = {f.name: [] for f in schema}
                for k in range(opened.count):
                    ids = opened.ids(k)
                    values = (part, shard, opened.entry(k)[0], inside, len(ids), zlib.crc32(ids.astype("<u4")))
                    for name, value in zip(rows, values, strict=True):
                        rows[name].append(value)
                    inside += len(ids)
                yield frame(schema, **rows)

    shards = spark.read.parquet(f"{folder}/shards")
    totals = shards.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()
    starts = accumulate((r["ids"] for r in totals), initial=0)
    parts = spark.createDataFrame(
        [(r["part"], s) for r, s in zip(totals, starts, strict=False)], "part long, first long"
    )
    earlier = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    table = (
        shards.select("part", "shard", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
        .join(parts, "part")
        .select("part", "shard", (F.col("before") + F.col("first")).alias("before"))
    )
    rows = shards.select("part", "shard", "blob").mapInArrow(
        fn, "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    return rows.join(table, ["part", "shard"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def store_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
