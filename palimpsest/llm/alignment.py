"""Cross-tokenizer alignment by diagonal run skipping.

A text with a space in front is encoded by a byte-level vocabulary (A) and, with the space that it
adds itself, by a piece vocabulary (B). Each encoding has the byte offsets at which its tokens end.
Offsets where both end cut the tokens into groups. While tokens pair off one to one, the end arrays
agree at a constant shift of their indices; ``aligned`` compares slices of doubling length at the
current shift and jumps over such stretches, then halves. An irregular group is resolved by stepping
on whichever side ends earlier, after which the shift is renewed.

The last tokens of a group are linked: their byte ranges end together. How often an id pair is
linked is counted over all documents. One of two linked tokens ends in the bytes of the other, so
there are no more distinct pairs than the tokens of both vocabularies have bytes (twice that for
characters with a byte piece of their own): the table of counts has a bound that the vocabularies
set, whatever the corpus, and goes to every worker.

Encoding cuts a text into stretches that encode alone as they do within it; distinct ones are
encoded once per worker, up to a bounded number of bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import UnitTable, frame, kept, over_texts, pack, slices, summed, unpack
from palimpsest.llm.token_store import Encoder, byte_letters
from palimpsest.session import materialize

MARK = "▁"
CACHED_UNITS = 600_000
FLUSH = 1 << 20  # distinct id pairs after which a task lets them go

_DOC = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()),
     ("pair", pa.int64()), ("count", pa.int64())]
)
_RESULT = pa.schema([*list(_DOC)[:5], ("n_best", pa.int64()), ("count_sum", pa.int64()), _DOC.field("groups_sha256")])
_GROUP = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
     ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))]
)


class Pieces:
    """Ids of whole texts with one model file of the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.parted = True  # no piece has a mark behind another character
        for k in range(self.model.vocab_size()):
            piece = self.model.id_to_piece(k)
            if self.model.is_byte(k):
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.bytes.append(piece.replace(MARK, " ").encode())
                self.parted &= MARK not in piece.lstrip(MARK)
        self.units = UnitTable(np.dtype("<i4"), CACHED_UNITS)

    def make(self, units: list[bytes]) -> list[np.ndarray]:
        # the model puts back the space that every stretch begins with
        made = self.model.encode([u[1:].decode() for u in units], num_threads=1)
        space = [self.model.piece_to_id(MARK)]  # not put back where nothing follows
        return [np.array(m if len(u) > 1 else space, dtype="<i4") for u, m in zip(units, made, strict=True)]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of the documents between the offsets, each of which begins with a space."""
        cut = np.zeros(len(raw), dtype=bool)
        if self.parted:
            cut[1:] = (raw[1:] == 32) & (raw[:-1] != 32)
        cut[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(cut)
        rows = self.units.rows(raw, starts, np.append(starts[1:], len(raw)), self.make)
        ids, done = self.units.gather(rows)
        marks = np.concatenate([[0], done])[np.searchsorted(starts, off)]
        return [ids[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]


@dataclass
class Spelling:
    """The bytes of every id of a vocabulary."""

    size: np.ndarray
    first: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, spelled: list[bytes]) -> Spelling:
        size = np.array([len(s) for s in spelled], dtype=np.int64)
        return cls(size, np.cumsum(size) - size, np.frombuffer(b"".join(spelled), dtype=np.uint8))

    def text(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.arange(total) + np.repeat(self.first[ids] - (end - size), size)]


class Aligner:
    """Both vocabularies of a worker."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a, plain=True), Pieces(path_b)
        back = {c: b for b, c in byte_letters().items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            spelled[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.spelled_a, self.spelled_b = Spelling.of(spelled), Spelling.of(self.b.bytes)
        self.width = len(self.b.bytes)
        most = max(len(spelled), self.width)
        self.length = np.array([len(str(k)) for k in range(most)], dtype=np.int64)
        self.digits = np.zeros((most, int(self.length.max()) + 1), dtype=np.uint8)
        for k in range(most):
            self.digits[k, : self.length[k]] = np.frombuffer(str(k).encode(), dtype=np.uint8)

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every document in both vocabularies; none where the bytes don't come back."""
        full = np.flatnonzero(np.diff(off) > 0)
        raw = np.insert(raw, off[:-1][full], 32)
        shift = np.zeros(len(off), dtype=np.int64)
        shift[full + 1] = 1
        off = off + np.cumsum(shift)
        none = np.empty(0, np.int32)
        a, b = [none] * (len(off) - 1), [none] * (len(off) - 1)
        if len(raw):
            made_a, made_b = self.a.encode(raw, off), self.b.encode(raw, off)
            for k in full:
                text = raw[off[k] : off[k + 1]]
                same = all(
                    np.array_equal(s.text(m), text)
                    for s, m in ((self.spelled_a, made_a[k]), (self.spelled_b, made_b[k]))
                )
                if same:
                    a[k], b[k] = made_a[k], made_b[k]
        return a, b

    def written(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Groups as ``a1,a2|b1;a3|b2;`` one after another, and the end of each group's text."""
        before_i, before_j = np.r_[0, i[:-1]], np.r_[0, j[:-1]]
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.repeat(before_j, i - before_i)] = a
        order[np.arange(len(b)) + np.repeat(i, j - before_j)] = b
        sign = np.full(len(order), ord(","), dtype=np.uint8)
        sign[i - 1 + before_j] = ord("|")
        sign[j - 1 + i] = ord(";")
        cells, length = self.digits[order], self.length[order]
        cells[np.arange(len(order)), length] = sign
        return cells[cells != 0].tobytes(), np.cumsum(length + 1)[i + j - 1]


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's vocabularies; they keep their stretches from task to task."""
    return kept("aligner", (path_a, path_b), lambda: Aligner(path_a, path_b))


def aligned(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens up to the end of every group.

    Both arrays ascend and have the same last value.
    """
    x, y = ends_a.tolist(), ends_b.tolist()
    i = j = 0
    # runs of groups: token counts at the end of the first group, and the number of groups
    first_i, first_j, groups = [], [], []
    while i < len(x):
        width, begin = 1, i
        while x[i : i + width] == y[j : j + width] and i < len(x):
            i, j, width = i + width, j + width, width * 2
        i, j = min(i, len(x)), min(j, len(y))
        while width > 1:
            width //= 2
            if i + width <= len(x) and x[i : i + width] == y[j : j + width]:
                i, j = i + width, j + width
        if i > begin:
            first_i.append(begin + 1)
            first_j.append(j - (i - begin) + 1)
            groups.append(i - begin)
        if i >= len(x):
            break
        p, q = x[i], y[j]
        while p != q:
            if p < q:
                i += 1
                p = x[i]
            else:
                j += 1
                q = y[j]
        i, j = i + 1, j + 1
        first_i.append(i)
        first_j.append(j)
        groups.append(1)
    count = np.array(groups, dtype=np.int64)
    within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    out_i, out_j = (np.repeat(np.array(z, dtype=np.int64), count) + within for z in (first_i, first_j))
    return out_i, out_j


def _concatenated(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(p) for p in parts])
    return np.concatenate(parts).astype(np.int64), ends


def aligned_documents(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str):
    """(ids, aligner, a, b, i, j, ends): documents with their tokens and group ends, some at a time.

    a and b are the ids of all of them, i and j token counts at the ends of groups, ends the number
    of A tokens, B tokens and groups up to the end of each document.
    """
    tool = aligner(path_a, path_b)
    for ids, raw, off in slices(batches):
        made_a, made_b = tool.encode(raw, off)
        a, end_a = _concatenated(made_a)
        b, end_b = _concatenated(made_b)
        i, j = aligned(np.cumsum(tool.spelled_a.size[a]), np.cumsum(tool.spelled_b.size[b]))
        yield ids, tool, a, b, i, j, (end_a, end_b, np.searchsorted(i, end_a, "right"))


def documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document its counts, the digest of its groups and its linked id pairs; and pair counts.

    Rows with a pair count the links of that pair in a part of a task; the others are documents.
    """

    def pairs(held: list) -> pa.RecordBatch:
        keys, counts = summed(*zip(*held, strict=True))
        none = [None] * len(keys)
        rest = {f.name: none for f in list(_DOC)[:-2]}
        return frame(_DOC, **rest, pair=keys.astype(np.int64), count=counts.astype(np.int64))

    def fn(batches):
        held, size = [], 0
        for ids, tool, a, b, i, j, (end_a, end_b, end_g) in aligned_documents(batches, path_a, path_b):
            texts, marks = tool.written(a, b, i, j) if len(i) else (b"", i)
            keys = (a[i - 1] * tool.width + b[j - 1]).astype(np.uint64)
            distinct, counts = np.unique(keys, return_counts=True)
            held.append((distinct, counts.astype(np.uint64)))
            size += len(distinct)
            if size > FLUSH:
                yield pairs(held)
                held, size = [], 0
            at, sha, links = 0, [], []
            for k in range(len(ids)):
                to = int(end_g[k])
                if to == at:
                    sha.append("")
                    links.append(None)
                    continue
                text = texts[int(marks[at - 1]) if at else 0 : int(marks[to - 1]) - 1]
                sha.append(hashlib.sha256(text).hexdigest())
                links.append(pack(*np.unique(keys[at:to], return_counts=True)))
                at = to
            n_groups = np.diff(end_g, prepend=0)
            none = [None] * len(ids)
            yield frame(
                _DOC, doc_id=ids, n_a=np.diff(end_a, prepend=0), n_b=np.diff(end_b, prepend=0),
                n_groups=n_groups, n_links=n_groups, groups_sha256=sha, links=links, pair=none, count=none,
            )
        if held:
            yield pairs(held)

    schema = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "links binary, pair long, count long"
    )
    return over_texts(docs, fn, schema, keeps=True)


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(a, b, count) of the id pairs that are linked, over all documents."""
    return (
        found.filter("pair is not null")
        .groupBy("pair")
        .agg(F.sum("count").alias("count"))
        .select(
            F.expr(f"cast(pair div {width} as int)").alias("a"),
            F.expr(f"cast(pair % {width} as int)").alias("b"),
            "count",
        )
    )


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Groups and links of every document, and how its links stand among those of the corpus.

    (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): n_best counts the
    links whose id pair is the most frequent one of its B id, ties included; count_sum adds up the
    counts of the links' pairs; groups_sha256 is over ``a1,a2|b1;a3|b2``. A text that is null or
    empty, or whose bytes one of the vocabularies doesn't give back, has zeros and an empty
    digest. Special tokens in a text are plain text. Repeated rows count and are returned as often
    as they come; other columns are not read.
    """
    found = materialize(documents(docs, path_a, path_b))
    width = len(Pieces(path_b).bytes)
    rows = pair_counts(found, width).toArrow()
    a, b, n = (rows.column(c).combine_chunks().to_numpy().astype(np.int64) for c in ("a", "b", "count"))
    most = np.zeros(width, dtype=np.int64)
    np.maximum.at(most, b, n)
    order = np.argsort(a * width + b)
    table = ((a * width + b)[order].astype(np.uint64), n[order], (n == most[b])[order])
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    def fn(batches):
        keys, count, best = shipped.value
        for batch in batches:
            n_best, total = [], []
            for blob in batch.column(batch.schema.get_field_index("links")).to_pylist():
                if blob is None:
                    n_best.append(0)
                    total.append(0)
                    continue
                own, times = unpack(blob)
                at, times = np.searchsorted(keys, own), times.astype(np.int64)
                n_best.append(int(times[best[at]].sum()))
                total.append(int((times * count[at]).sum()))
            plain = {c: batch.column(batch.schema.get_field_index(c)) for c in _RESULT.names[:5]}
            yield frame(
                _RESULT, **plain, n_best=n_best, count_sum=total,
                groups_sha256=batch.column(batch.schema.get_field_index("groups_sha256")),
            )

    schema = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string"
    )
    return found.filter("pair is null").drop("pair", "count").mapInArrow(fn, schema)


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, start, end, a_ids, b_ids) of every group; byte offsets, the added space included."""

    def fn(batches):
        for ids, tool, a, b, i, j, (end_a, end_b, end_g) in aligned_documents(batches, path_a, path_b):
            doc = np.searchsorted(end_g, np.arange(len(i)), "right")
            ends = np.cumsum(tool.spelled_a.size[a])[i - 1] if len(i) else i
            begin = np.concatenate([[0], ends])[np.concatenate([[0], end_g[:-1]])[doc]] if len(i) else i
            yield frame(
                _GROUP, doc_id=ids.take(pa.array(doc)), start=np.r_[0, ends[:-1]][: len(i)] - begin,
                end=ends - begin,
                a_ids=[a[p:q].tolist() for p, q in zip(np.r_[0, i[:-1]], i, strict=False)],
                b_ids=[b[p:q].tolist() for p, q in zip(np.r_[0, j[:-1]], j, strict=False)],
            )

    spelled = "doc_id long, start long, end long, a_ids array<int>, b_ids array<int>"
    return over_texts(docs, fn, spelled, keeps=True)
