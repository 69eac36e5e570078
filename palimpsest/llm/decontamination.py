"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Words (lower-cased A-Z) are the symbols. A document leaks an item when some stretch of it is within
floor(max_rate * words of the item) word edits of the item.

* An item is cut into m pieces of at most PIECE_WORDS words, as agreeing steps of a walk get rarer
  with length. A stretch within k edits of the item holds a piece within k // m edits.
* Windows are as long as a piece. A stretch within k edits keeps one of k + 1 parts of the piece
  word for word (pigeonhole), so windows are laid only where a run of q piece words occurs, at the
  offset the run has in the piece; no leak is passed over by that.
* The CGK embedding walks a window with an index that advances by a random bit of (walk, step,
  symbol) and reports the symbol under it. Few edits give few differing steps.
* Every walk samples a few steps; equal samples put a window and a piece into one bucket. Walks
  are repeated as often as ``walks_for`` finds necessary for the piece's length, so that a piece at
  the bound meets at least once with the target recall.
* Pairs that meet are verified by the exact edit distance between the whole item and the best
  stretch around the window.

Items travel to every task in blocks of bounded size; the documents are read once per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.arrays import frame, gram_hashes, mix, over_texts, slices, word_bounds, word_hashes

ITEM_BLOCK_BYTES = 32 << 20  # item text that is sent to the tasks at once
RECALL = 0.995  # of pieces at the bound
SAMPLES = 3
PIECE_WORDS = 40
TRIALS = 400  # seeded pairs the number of walks is found with
MOST_WALKS = 1024
EMBEDDED_CELLS = 6 << 20  # walks x rows x steps at once
RUN_WORDS = 3
MAX_RATE = 0.25
_LEAK = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int64()),
     ("first_word", pa.int64())]
)


def embed(windows: np.ndarray, walks: int, steps: int, seed: int = 11) -> np.ndarray:
    """CGK embeddings of equally long symbol rows: walks x rows x steps.

    Past its end a row reports 0.
    """
    rows, width = windows.shape
    padded = np.zeros((rows, width + 1), dtype=np.uint64)
    padded[:, :width] = windows
    salt = mix(np.arange(1, walks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed))
    at = np.zeros((walks, rows), dtype=np.int64)
    every = np.arange(rows)[None, :]
    out = np.empty((walks, rows, steps), dtype=np.uint64)
    for step in range(steps):
        seen = padded[every, at]
        out[:, :, step] = seen
        bit = mix((seen ^ salt[:, None]) + np.uint64((step + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        at = np.minimum(at + (bit >> np.uint64(63)).astype(np.int64), width)
    return out


def bucket_keys(windows: np.ndarray, walks: int, samples: int, seed: int = 11) -> np.ndarray:
    """walks x rows: a key from the walk and its ``samples`` sampled steps."""
    width = windows.shape[1]
    depth = max(1, 3 * width // 2)  # most walks are still inside the row
    steps = np.random.default_rng(seed + width).integers(0, depth, (walks, samples))
    embedded = embed(windows, walks, depth, seed)
    keys = np.zeros(embedded.shape[:2], dtype=np.uint64) + np.arange(walks, dtype=np.uint64)[:, None]
    for k in range(samples):
        picked = np.take_along_axis(embedded, steps[:, k][:, None, None], axis=2)[:, :, 0]
        keys = mix(keys * np.uint64(31) + picked + np.uint64(k + 1))
    return keys


def run_words(words: int, edits: int) -> int:
    """Length of the runs that a stretch within ``edits`` of a piece must share with it."""
    return min(RUN_WORDS, words // (edits + 1))


def chunk_rows(words: int, walks: int) -> int:
    return max(1, EMBEDDED_CELLS // (walks * max(1, 3 * words // 2)))


def _trials(words: int, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Seeded pieces and the windows laid on a copy with ``edits`` replaced, added or lost words."""
    rnd = np.random.default_rng([words, edits])
    q = run_words(words, edits)
    for _ in range(TRIALS):
        piece = rnd.integers(1, 1 << 63, words).astype(np.uint64)
        text = list(range(words))  # places in the piece; -1: another word
        for _ in range(edits):
            at, kind = int(rnd.integers(max(1, len(text)))), int(rnd.integers(3))
            text[at : at + 1] = [[-1], [], [*text[at : at + 1], -1]][kind]
        text = np.array([-1] * words + text + [-1] * 2 * words)
        other = rnd.integers(1, 1 << 63, len(text)).astype(np.uint64)
        symbols = np.where(text < 0, other, piece[text])
        runs = [t for t in np.flatnonzero(text >= 0) if (np.diff(text[t : t + q]) == 1).all() and text[t + q - 1] >= 0]
        starts = sorted({int(t - text[t]) for t in runs if t >= text[t]})
        yield piece, np.array([symbols[a : a + words] for a in starts], dtype=np.uint64).reshape(-1, words)


@lru_cache(maxsize=None)
def walks_for(words: int, edits: int, samples: int, recall: float) -> int:
    """Walks, in eights, after which ``recall`` of the trial pieces with ``edits`` edits were met."""
    drawn = list(_trials(words, edits))
    pieces = np.array([piece for piece, _ in drawn])
    rows = np.concatenate([laid for _, laid in drawn])
    of = np.repeat(np.arange(len(drawn)), [len(laid) for _, laid in drawn])
    wanted = max(1, int(np.ceil(recall * len(drawn))))
    walks = 32
    while walks <= MOST_WALKS:
        first = np.full(len(drawn), walks)
        size = chunk_rows(words, walks)
        keys = np.concatenate(
            [bucket_keys(pieces[a : a + size], walks, samples) for a in range(0, len(pieces), size)], axis=1
        )
        for a in range(0, len(rows), size):
            met = bucket_keys(rows[a : a + size], walks, samples) == keys[:, of[a : a + size]]
            np.minimum.at(first, of[a : a + size], np.where(met.any(axis=0), met.argmax(axis=0), walks))
        last = int(np.sort(first)[wanted - 1])
        if last < walks:
            return -(-(last + 1) // 8) * 8
        walks *= 2
    raise ValueError(f"no {MOST_WALKS} walks find {recall} of {words} words with {edits} edits")


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, start): the smallest edit distance of ``item`` to any stretch of ``text``.

    Of equally good stretches the one that ends first counts, and of those the longest.
    """
    cost = np.zeros(len(text) + 1, dtype=np.int64)
    start = np.arange(len(text) + 1)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        change = cost[:-1] + (text != word)
        drop = cost[1:] + 1
        best = np.concatenate([[i], np.minimum(change, drop)])
        origin = np.concatenate([[0], np.where(change <= drop, start[:-1], start[1:])])
        # an inserted word costs one more than the cell before it: a running minimum
        slack = best - steps
        low = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == low, steps, -1))
        cost, start = low + steps, origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end])


@dataclass
class Items:
    """Benchmark items, the pieces they are cut into, the pieces' runs of words and LSH buckets."""

    ids: list[int]
    words: list[np.ndarray]
    limits: list[int]
    pieces: list[tuple[int, int]]  # item, offset in it
    lengths: np.ndarray  # words of each piece
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> hashes, piece, offset
    buckets: dict[int, dict[int, list[int]]]  # piece length -> bucket key -> pieces
    keys: dict[int, np.ndarray]  # piece length -> sorted bucket keys
    walks: dict[int, int]  # piece length -> walks
    samples: int

    @classmethod
    def build(cls, rows: list[tuple[int, str]], max_rate: float, recall: float, samples: int) -> Items:
        ids, words, limits, pieces, runs, buckets = [], [], [], [], {}, {}
        for item_id, text in rows:
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            own = word_hashes(raw, *word_bounds(raw, np.array([0, len(raw)])))
            if len(own):
                ids.append(item_id)
                words.append(own)
                limits.append(int(max_rate * len(own)))
        cut, edits_of = [], {}  # the most edits that pieces of a length are looked for with
        for k, own in enumerate(words):
            parts = -(-len(own) // PIECE_WORDS)
            edges = [len(own) * i // parts for i in range(parts + 1)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                edits = limits[k] // parts
                for offset, run in enumerate(gram_hashes(own[a:b], run_words(b - a, edits))):
                    runs.setdefault(run_words(b - a, edits), []).append((int(run), len(pieces), offset))
                pieces.append((k, a))
                cut.append(own[a:b])
                edits_of[b - a] = max(edits, edits_of.get(b - a, 0))
        walks = {n: walks_for(n, edits, samples, recall) for n, edits in edits_of.items()}
        for p, own in enumerate(cut):
            keys = bucket_keys(own[None, :], walks[len(own)], samples)[:, 0]
            table = buckets.setdefault(len(own), {})
            for key in set(keys.tolist()):
                table.setdefault(key, []).append(p)
        packed = {}
        for q, found in runs.items():
            found.sort()
            packed[q] = (
                np.array([f[0] for f in found], dtype=np.uint64),
                np.array([f[1] for f in found]),
                np.array([f[2] for f in found]),
            )
        known = {n: np.array(sorted(table), dtype=np.uint64) for n, table in buckets.items()}
        lengths = np.array([len(own) for own in cut])
        return cls(ids, words, limits, pieces, lengths, packed, buckets, known, walks, samples)

    def windows(self, hashed: np.ndarray, doc_of: np.ndarray) -> dict[int, np.ndarray]:
        """Window length -> distinct window starts (they may lie outside the document)."""
        found: dict[int, list[np.ndarray]] = {}
        for q, (values, piece, offset) in self.runs.items():
            grams = gram_hashes(hashed, q)
            if not len(grams):
                continue
            low = np.searchsorted(values, grams)
            hit = np.flatnonzero(values[np.minimum(low, len(values) - 1)] == grams)
            hit = hit[doc_of[hit] == doc_of[hit + q - 1]]
            low = low[hit]
            many = np.searchsorted(values, grams[hit], "right") - low
            at = np.repeat(hit, many)
            entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            starts, width = at - offset[entry], self.lengths[piece[entry]]
            for n in np.unique(width):
                # the document is told apart by the position of the run itself
                found.setdefault(int(n), []).append(
                    np.column_stack([doc_of[at[width == n]], starts[width == n]])
                )
        return {n: np.unique(np.concatenate(v), axis=0) for n, v in found.items()}

    def candidates(self, hashed: np.ndarray, doc_of: np.ndarray, edges: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """(doc, item) -> where the item would start, for every window that meets one of its pieces."""
        out: dict[tuple[int, int], set[int]] = {}
        for n, rows in self.windows(hashed, doc_of).items():
            table, size = self.buckets[n], chunk_rows(n, self.walks[n])
            for a in range(0, len(rows), size):
                part = rows[a : a + size]
                at = part[:, 1][:, None] + np.arange(n)[None, :]
                inside = (at >= edges[part[:, 0]][:, None]) & (at < edges[part[:, 0] + 1][:, None])
                symbols = np.where(inside, hashed[np.clip(at, 0, len(hashed) - 1)], np.uint64(0))
                keys = bucket_keys(symbols, self.walks[n], self.samples)
                found = np.searchsorted(self.keys[n], keys)
                equal = self.keys[n][np.minimum(found, len(self.keys[n]) - 1)] == keys
                met = {(int(r), p) for walk, r in np.argwhere(equal) for p in table[int(keys[walk, r])]}
                for r, p in met:
                    k, offset = self.pieces[p]
                    out.setdefault((int(part[r, 0]), k), set()).add(int(part[r, 1]) - offset)
        return out


def spans(places: set[int], gap: int) -> list[tuple[int, int]]:
    """(first, last) of the stretches of ``places`` in which neighbours are at most ``gap`` apart."""
    found: list[tuple[int, int]] = []
    for place in sorted(places):
        if found and place - found[-1][1] <= gap:
            found[-1] = (found[-1][0], place)
        else:
            found.append((place, place))
    return found


def leaks(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    for ids, raw, off in slices(batches):
        starts, ends = word_bounds(raw, off)
        if not len(starts):
            continue
        hashed = word_hashes(raw, starts, ends)
        edges = np.searchsorted(starts, off)
        doc_of = np.repeat(np.arange(len(ids)), np.diff(edges))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for (doc, k), places in items.candidates(hashed, doc_of, edges).items():
            item, limit = items.words[k], items.limits[k]
            for low, high in spans(places, limit):
                a = max(int(edges[doc]), low - limit)
                b = min(int(edges[doc + 1]), high + len(item) + limit)
                # an item word that stands nowhere in the text takes an edit
                if np.count_nonzero(~np.isin(item, hashed[a:b])) > limit:
                    continue
                edits, first = best_stretch(item, hashed[a:b])
                if edits <= limit:
                    own = (edits, a + first - int(edges[doc]))
                    best[doc, k] = min(best.get((doc, k), own), own)
        if best:
            names = ids.to_pylist()
            yield frame(
                _LEAK,
                doc_id=[names[d] for d, _ in best],
                item_id=[items.ids[k] for _, k in best],
                n_words=[len(items.words[k]) for _, k in best],
                edits=[e for e, _ in best.values()],
                first_word=[f for _, f in best.values()],
            )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    max_rate: float = MAX_RATE,
    recall: float = RECALL,
    samples: int = SAMPLES,
) -> DataFrame:
    """(doc_id, item_id, n_words, edits, first_word) for every item that a document leaks.

    One row per document row and item, for its best stretch. Null or wordless texts and items
    leak nothing; repeated document rows are reported each; repeated items once per item row.
    Other columns are not read. ``recall`` is the share of leaks at the bound that must be met.
    """

    def scan(rows: list[tuple[int, str]]) -> DataFrame:
        items = Items.build(rows, max_rate, recall, samples)
        return over_texts(
            docs,
            lambda batches: leaks(batches, items),
            "doc_id long, item_id long, n_words long, edits long, first_word long",
        )

    found, block, size = None, [], 0
    wanted = benchmark.filter("text is not null").select(
        F.col("item_id").cast("long"), F.col("text").cast("string")
    )
    for row in wanted.toLocalIterator():
        if size > ITEM_BLOCK_BYTES:
            found = scan(block) if found is None else found.unionByName(scan(block))
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    return scan(block) if found is None else found.unionByName(scan(block))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that leak an item; all columns stay."""
    leaked = (
        find_leaks(docs, benchmark, **options)
        .filter("doc_id is not null")
        .select(F.col("doc_id").alias("_leaked"))
        .distinct()
    )
    return docs.join(leaked, docs["doc_id"] == F.col("_leaked"), "left_anti")
