"""SentencePiece encoding and decoding with N-best segmentation.

A text becomes a lattice of vocabulary pieces; a segmentation's score is the sum of its pieces'
scores. A forward Viterbi pass gives the best score up to every position; they are exact
heuristics for a backward A-star search that returns the N best segmentations in order.

A lattice falls apart where no piece of the vocabulary joins the two sides (between character
classes that never meet inside a piece), so the N best of a text follow
from the N best of its stretches. Distinct stretches are searched once per worker, up to a bounded
number that is remembered.

Spaces become word-start marks and one mark is put in front, as the model files ask for. A
character without a piece is written as byte pieces at the score of the worst piece minus 10.
Decoding gives the text
back, byte for byte, but for a literal word-start mark, which becomes a space.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush, nsmallest
from math import inf
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.arrays import SLICE_BYTES, UnitTable, frame, kept, over_texts, slices

NBEST = 3
CACHED_UNITS = 600_000  # a worker forgets its stretches beyond that
CACHED_WAYS = 5_000  # the same for the ids of all N segmentations of a stretch
MARK = "▁"

# byte classes: 0 other (never cut beside it), 1 space, 2 letter, 3 digit, 4 ASCII sign, 5 control
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[33:127] = 4
_CLASS[48:58] = 3
_CLASS[65:91] = _CLASS[97:123] = 2
_CLASS[0:32] = 5
_CLASS[127] = 5
_CLASS[32] = 1


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """Class of every byte; U+00C0-U+00FF count as letters."""
    out = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    out[lead] = out[lead + 1] = 2
    return out


class Lattice:
    """The pieces of one model file, and searches over them."""

    def __init__(self, path: str, n: int):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size, self.n = model.vocab_size(), n
        # a beginning of a piece that is none itself has no ids
        self.pieces: dict[str, tuple[tuple[int, ...] | None, float]] = {}
        self.bytes = [0] * 256
        spelled: list[bytes] = []
        joined = np.zeros((6, 6), dtype=bool)
        joined[0, :] = joined[:, 0] = True
        for k in range(size):
            piece, score = model.id_to_piece(k), model.get_score(k)
            if model.is_byte(k):
                self.bytes[int(piece[1:-1], 16)] = k
                spelled.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(k) or model.is_unknown(k):
                spelled.append(b"")
            else:
                spelled.append(piece.replace(MARK, " ").encode())
                self.pieces[piece] = ((k,), score)
                classes = byte_classes(np.frombuffer(spelled[-1], dtype=np.uint8))
                joined[classes[:-1], classes[1:]] = True
        self.joined = joined
        # reserved pieces, far below the others, don't set the mark for unknown characters
        self.unknown = min(s for _, s in self.pieces.values() if s > -1e8) - 10
        for piece in list(self.pieces):
            for k in range(1, len(piece)):
                self.pieces.setdefault(piece[:k], (None, 0.0))
        self.size = np.array([len(s) for s in spelled], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.spelled = np.frombuffer(b"".join(spelled), dtype=np.uint8)
        self.units = UnitTable(np.dtype("<i4"), CACHED_UNITS)
        self.ways: dict[bytes, list[np.ndarray]] = {}

    def search(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best (score, ids) of a stretch in which spaces are word-start marks."""
        end, get = len(text), self.pieces.get
        best = [0.0] + [-inf] * end
        into: list[list] = [[] for _ in range(end + 1)]  # (minus score reached, from, ids)
        for i in range(end):
            here = best[i]
            j = i + 1
            found = get(text[i:j])
            if found is None or found[0] is None:
                ids = tuple([self.bytes[b] for b in text[i].encode()])
                into[j].append((-(here + self.unknown), i, ids))
                best[j] = max(best[j], here + self.unknown)
            while found is not None:
                ids, gain = found
                if ids is not None:
                    reached = here + gain
                    into[j].append((-reached, i, ids))
                    if reached > best[j]:
                        best[j] = reached
                if j == end:
                    break
                j += 1
                found = get(text[i:j])
        # an entry is a way into a position: its rank there, what lies behind, and its total score;
        # the best total of a way is known, so entries leave the heap in final order
        # of equally good ones the nearest to the start goes first, then the newest
        out, count = [], -1
        heap = [(-best[end], end, 0, 0, 0.0, None)] if end else []
        while heap and len(out) < self.n:
            cost, at, _, rank, done, path = heappop(heap)
            arcs = into[at]
            if rank == 0 and len(arcs) > 1:
                arcs.sort()
            lost, i, ids = arcs[rank]
            if rank + 1 < len(arcs):
                heappush(heap, (arcs[rank + 1][0] - done, at, count, rank + 1, done, path))
                count -= 1
            if i == 0:
                made = list(ids)
                while path is not None:
                    made.extend(path[0])
                    path = path[1]
                out.append((-cost, made))
            else:
                heappush(heap, (cost, i, count, 0, done - lost - best[i], (ids, path)))
                count -= 1
        return out

    def make(self, units: list[bytes]) -> list[np.ndarray]:
        """Records: score, number of others, length and ids, then the loss of each other one.

        Scores and losses are the bits of 64-bit floats, two numbers each.
        """
        out = []
        for unit in units:
            found = self.search(unit.decode().replace(" ", MARK))
            score, ids = found[0]
            lost = [max(0.0, score - s) for s, _ in found[1:]]
            packed = struct.pack(f"<d{2 + len(ids)}i{len(lost)}d", score, len(lost), len(ids), *ids, *lost)
            out.append(np.frombuffer(packed, dtype="<i4"))
        return out

    def encode(self, raw: np.ndarray, off: np.ndarray):
        """Per document: ids, best score and the losses of the other N - 1 best segmentations."""
        return [(ids, score, losses) for ids, score, losses, _ in self.segmentations(raw, off)]

    def segmentations(self, raw: np.ndarray, off: np.ndarray):
        """Per document: ids, score, and the losses and ids of the other N - 1 best, best first."""
        # a mark in front of every document that holds something
        full = np.flatnonzero(np.diff(off) > 0)
        raw = np.insert(raw, off[:-1][full], 32)
        shift = np.zeros(len(off), dtype=np.int64)
        shift[full + 1] = 1
        off = off + np.cumsum(shift)
        if not len(raw):
            return [(np.empty(0, np.int64), 0.0, [], [])] * (len(off) - 1)
        classes = byte_classes(raw)
        cut = np.zeros(len(raw), dtype=bool)
        cut[1:] = ~self.joined[classes[:-1], classes[1:]]
        cut[off[:-1][off[:-1] < len(raw)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(raw))
        table = self.units
        rows = table.rows(raw, starts, ends, self.make)
        at = table.start[rows]
        scores, length = self._floats(at), table.flat[at + 3].astype(np.int64)
        last = len(table.flat) - 2
        loss = np.where(table.flat[at + 2] > 0, self._floats(np.minimum(at + 4 + length, last)), np.inf)
        done = np.cumsum(length)
        index = np.arange(int(done[-1])) + np.repeat(at + 4 - (done - length), length)
        ids = table.flat[index].astype(np.int64)
        edge = np.searchsorted(starts, off)
        marks = np.concatenate([[0], done])
        out = []
        for k in range(len(off) - 1):
            a, b = edge[k], edge[k + 1]
            own, others = ids[marks[a] : marks[b]], self._others(at[a:b], loss[a:b])
            ways = []
            for _, changed in others:
                parts, here = [], marks[a]
                for unit, rank in sorted(changed):
                    u = a + unit
                    parts += [ids[here : marks[u]], self.way(raw[starts[u] : ends[u]].tobytes(), rank)]
                    here = marks[u + 1]
                ways.append(np.concatenate([*parts, ids[here : marks[b]]]))
            out.append((own, float(scores[a:b].sum()), [lost for lost, _ in others], ways))
        return out

    def way(self, unit: bytes, rank: int) -> np.ndarray:
        """The ids of one of the N best segmentations of a stretch; short stretches are remembered."""
        if unit not in self.ways:
            found = self.search(unit.decode().replace(" ", MARK))
            made = [np.array(ids, dtype=np.int64) for _, ids in found]
            if len(unit) > 64:
                return made[rank]
            if len(self.ways) >= CACHED_WAYS:
                self.ways.clear()
            self.ways[unit] = made
        return self.ways[unit][rank]

    def _floats(self, at: np.ndarray) -> np.ndarray:
        """The 64-bit floats that stand at ``at`` of the table."""
        return self.units.flat[at[:, None] + np.arange(2)].view("<f8").ravel()

    def _others(self, at: np.ndarray, loss: np.ndarray) -> list[tuple[float, tuple]]:
        """Smallest losses of whole-text segmentations, each with its (stretch, rank) that differ.

        Only the N - 1 cheapest stretches count.
        """
        want = self.n - 1
        cheap = np.argpartition(loss, want - 1)[:want] if len(loss) > want else np.arange(len(loss))
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for k in cheap.tolist():
            flat, p = self.units.flat, int(at[k])
            q = p + 4 + int(flat[p + 3])
            lost = flat[q : q + 2 * int(flat[p + 2])].view("<f8").tolist()
            more = [(s + c, (*way, (k, r))) for s, way in sums for r, c in enumerate(lost, 1)]
            sums = nsmallest(self.n, [*sums, *more], key=itemgetter(0))
        return sums[1:]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of an id sequence, without the mark that encoding put in front."""
        size = self.size[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        index = np.arange(total) + np.repeat(self.first[ids] - (end - size), size)
        return self.spelled[index].tobytes()[1:]

    def gives_back(self, ways: list[np.ndarray], text: bytes) -> bool:
        """Whether each of the id sequences decodes to the text."""
        joined = b" ".join([text] * len(ways)) if text else b""
        return self.decode(np.concatenate(ways)) == joined


def lattice(path: str, n: int) -> Lattice:
    """The worker's lattice for a model file; it keeps its stretches from task to task."""
    return kept("lattice", (path, n), lambda: Lattice(path, n))


def segment(docs: DataFrame, path: str, n: int = NBEST, with_ids: bool = False) -> DataFrame:
    """N-best segmentation of whole texts, and the text that the ids decode to.

    (doc_id, n_pieces, ids_crc32, nbest_scores, lossless, nbest_crc32) and, if asked for, ids,
    nbest_ids and text. n_pieces, ids_crc32 and ids are of the best segmentation; a crc32 is over ids
    as little-endian unsigned 32-bit integers. nbest_scores, nbest_crc32 and nbest_ids have up to N
    segmentations, best first. text is what the best ids decode to; lossless says that all N decode
    to the given text. A null or empty text has one segmentation, without pieces and with score 0, and is
    lossless. Repeated rows are segmented each; other columns are not read.
    """
    fields = [
        ("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()),
        ("nbest_scores", pa.list_(pa.float64())), ("lossless", pa.bool_()),
        ("nbest_crc32", pa.list_(pa.int64())),
    ]
    ids = [("ids", pa.list_(pa.int32())), ("nbest_ids", pa.list_(pa.list_(pa.int32()))), ("text", pa.string())]
    schema = pa.schema(fields + ids * with_ids)

    def fn(batches: Iterator[pa.RecordBatch]):
        search = lattice(path, n)
        mark = MARK.encode()
        for ids, raw, off in slices(batches, size=SLICE_BYTES // 2):
            made = search.segmentations(raw, off)
            data = raw.tobytes()
            texts = [data[a:b].replace(mark, b" ") for a, b in zip(off[:-1], off[1:], strict=True)]
            ways = [[m[0], *m[3]] for m in made]
            crcs = [[zlib.crc32(w.astype("<u4")) for w in own] for own in ways]
            columns = {
                "doc_id": ids,
                "n_pieces": [len(m[0]) for m in made],
                "ids_crc32": [c[0] for c in crcs],
                "nbest_scores": [[m[1], *(m[1] - x for x in m[2])] for m in made],
                "lossless": [search.gives_back(w, t) for w, t in zip(ways, texts, strict=True)],
                "nbest_crc32": crcs,
            }
            if with_ids:
                columns["ids"] = [m[0].astype(np.int32) for m in made]
                columns["nbest_ids"] = [[w.astype(np.int32) for w in own] for own in ways]
                columns["text"] = [search.decode(m[0]).decode("utf-8", "replace") for m in made]
            yield frame(schema, **columns)

    spelled = (
        "doc_id long, n_pieces long, ids_crc32 long, nbest_scores array<double>, lossless boolean, "
        "nbest_crc32 array<long>"
    )
    spelled += ", ids array<int>, nbest_ids array<array<int>>, text string" * with_ids
    return over_texts(docs, fn, spelled, keeps=True)
