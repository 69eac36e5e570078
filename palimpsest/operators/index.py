"""A stored inverted index and BM25 search over it; no text is read at search time.

Postings lie under ``postings/segment=S/bucket=B``, a bucket for each hash range of terms, in blocks
of at most ``BLOCK`` documents, best first. A block has the largest term count and the shortest
length in it, which bound every score it can give whatever the average length is later. Documents
are dealt to slices, so a term that every document holds is built and read by many tasks.

A load adds a segment. ``manifest`` names the segments that count; its row is written last, so a
load that fails leaves nothing behind that a search would see, and one that is run again replaces
its own files. Removed documents are listed and taken out at search until ``compact`` rewrites the
index.

A search reads the buckets of the asked terms. The best blocks of each term give a score that the
k-th hit has at least; blocks that cannot lift a document to it are left out, which changes no hit.
A query term that is written together but falls into several words (``well-known``) is a phrase:
it matches where its words follow each other, and counts as one term.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions.text import accent_table, query_terms, search_tokens
from palimpsest.operators.scale import top_per_group
from palimpsest.operators.search import BM25_B, BM25_K1, MIN_IDF
from palimpsest.session import materialize

BLOCK = 256
BUCKETS = 64
SLICE_DOCS = 250_000  # documents of a slice, about
BATCH_BYTES = 8 << 20  # of an Arrow batch
SENT_IDS = 500_000  # removed documents that go to every task
SENT_WORDS = 200_000  # query words that go to every task; more are joined by key

_POSTINGS = (
    "term string, slice int, block bigint, n int, max_tf int, min_dl int, ids array<bigint>, "
    "tfs array<int>, dls array<int>, hits array<boolean>, positions array<array<int>>, "
    "segment int, bucket int"
)
_BLOCKS = _POSTINGS.replace(" segment int,", "")
_PIECES = (
    "slice int, term string, segment int, ids array<bigint>, tfs array<int>, dls array<int>, "
    "hits array<boolean>, positions array<array<int>>"
)
_BLOCK_NAMES = [c.split()[0] for c in _BLOCKS.split(", ")]
_DOCS = "id bigint, dl int, segment int"
_REMOVED = "id bigint, segment int"
_MANIFEST = "n_docs bigint, n_tokens bigint, covers int, segment int"
_KEY = ["segment", "slice", "block", "term"]


@dataclass(frozen=True)
class KeywordIndex:
    """An index folder; ``buckets`` must stay what it was when the first segment was written."""

    path: str
    buckets: int = BUCKETS

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def segments(self, spark: SparkSession) -> list:
        """Manifest rows of the segments that count: those not covered by a compacted one."""
        rows = self._read(spark, "manifest", _MANIFEST).collect()  # one row for each load
        oldest = max((r["covers"] for r in rows), default=0)
        return [r for r in rows if r["segment"] >= oldest]

    def _live(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        numbers = [r["segment"] for r in self.segments(spark)]
        return self._read(spark, name, schema).filter(F.col("segment").isin(numbers))

    def postings(self, spark: SparkSession) -> DataFrame:
        return self._live(spark, "postings", _POSTINGS)

    def removed(self, spark: SparkSession) -> DataFrame:
        return self._live(spark, "removed", _REMOVED)

    def documents(self, spark: SparkSession) -> DataFrame:
        """(id, dl, segment) of the documents that are in the index."""
        rows = self._live(spark, "docs", _DOCS)
        return _without(rows, self.removed(spark))

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")


def _without(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows (id, segment, ...) not removed by a later segment.

    Few removed documents go to the tasks that have the rows, which then aren't moved by document.
    """
    gone = removed.groupBy(F.col("id").alias("_id")).agg(F.max("segment").alias("_until"))
    if removed.limit(SENT_IDS + 1).count() <= SENT_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_until")), "left_anti")


def _impact(tf, dl, average):
    length = 1 - BM25_B + BM25_B * dl / average
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * length)


def _in_arrow(rows: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over Arrow batches, bounded in bytes unless the session has a bound: rows may be long."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return rows.mapInArrow(fn, schema)


# Texts of these characters are cut into words in Python, as ``search_tokens`` does; others by it.
_OTHERS = r"[^\x00-\u024F]"
_INSIDE = np.zeros(256, dtype=bool)  # bytes of words, and those that need a closer look
_INSIDE[128:] = True
_INSIDE[[c for c in range(128) if chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _folded(word: str, table: dict) -> list[str]:
    """The words that ``search_tokens`` makes of a stretch of common characters."""
    word = word.lower().translate(table)
    if word.isalnum():
        return [word]
    kind = lambda c: unicodedata.category(c)[0]
    return "".join(c if kind(c) in "LN" else " " for c in word if kind(c) != "M").split()


def _words(texts: pa.Array, others: pa.Array, table: dict) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(number of words of each text, codes of the words one after another, vocabulary).

    ``others`` has the words of the texts that are null.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    off = off - off[0]
    inside = _INSIDE[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[off] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    kept = np.flatnonzero(inside)
    starts = np.flatnonzero(begins)
    at = np.searchsorted(kept, starts)
    offsets = pa.py_buffer(np.r_[at, len(kept)].astype(np.int64))
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, offsets, pa.py_buffer(_LOWER[raw[kept]])])
    doc = np.searchsorted(off, starts, "right") - 1
    size = pc.fill_null(pc.list_value_length(others), 0).to_numpy()
    if size.any():  # no text has words of both
        found = pa.concat_arrays([found, others.flatten().cast(pa.large_string())])
        doc = np.concatenate([doc, np.repeat(np.arange(len(size)), size)])
        order = np.argsort(doc, kind="stable")
        found, doc = found.take(pa.array(order)), doc[order]
    found = found.dictionary_encode()
    entry, distinct = found.indices.to_numpy(), found.dictionary
    # a stretch that isn't ASCII may be any number of words; those of ``others`` stay as they are
    noted = np.flatnonzero(~pc.string_is_ascii(distinct).to_numpy(zero_copy_only=False))
    made = [_folded(w, table) if max(w) <= "\u024f" else [w] for w in distinct.take(pa.array(noted)).to_pylist()]
    count = np.ones(len(distinct), dtype=np.int64)
    count[noted] = [len(m) for m in made]
    plain = np.ones(len(distinct), dtype=bool)
    plain[noted] = False
    every = pa.concat_arrays(
        [distinct.filter(pa.array(plain)), pa.array([w for m in made for w in m], pa.large_string())]
    ).dictionary_encode()
    # where the words of a stretch begin in ``every``: the plain ones first, then the others
    first = np.empty(len(distinct), dtype=np.int64)
    first[plain] = np.arange(plain.sum())
    first[noted] = plain.sum() + np.cumsum(count[noted]) - count[noted]
    reps = count[entry]
    within = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    codes = every.indices.to_numpy()[np.repeat(first[entry], reps) + within]
    dl = np.bincount(np.repeat(doc, reps), minlength=len(texts))
    return dl, codes.astype(np.int64), every.dictionary.cast(pa.string())


def _texts(docs: DataFrame) -> DataFrame:
    """(id, hit, text, tokens): the tokens of a text that has other characters stand in its place."""
    hit = F.col("hit") if "hit" in docs.columns else F.lit(True)
    common = F.coalesce(~F.col("text").rlike(_OTHERS), F.lit(True))
    return docs.select(
        F.col("id").cast("long").alias("id"),
        hit.alias("hit"),
        F.when(common, F.col("text")).alias("text"),
        F.when(~common, search_tokens(F.col("text"))).alias("tokens"),
    )


def _sizes(docs: DataFrame) -> DataFrame:
    """(id, dl) of documents."""
    table = _accents()

    def fn(batches):
        for batch in batches:
            dl, _, _ = _words(batch.column(1), batch.column(2), table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dl, pa.int32())], ["id", "dl"])

    return _in_arrow(_texts(docs).select("id", "text", "tokens"), fn, "id bigint, dl int")


def _accents() -> dict:
    return str.maketrans(*accent_table())


def _term_rows(docs: DataFrame) -> DataFrame:
    """(id, hit, text, tokens) of documents (id, text[, hit]); dealt by id."""
    return _texts(docs.repartition("id"))


def _postings(rows: DataFrame, slices: int) -> DataFrame:
    """Pieces of postings (slice, term, segment, ids, tfs, dls, hits, positions) of what ``_term_rows`` gives.

    A piece has the documents of one Arrow batch, so what is dealt and sorted is far less than a row
    for each word of a document.
    """
    table = _accents()

    def fn(batches):
        for batch in batches:
            dl, code, words = _words(batch.column(3), batch.column(4), table)
            doc = np.repeat(np.arange(len(dl)), dl)
            pos = np.arange(len(doc)) - np.repeat(np.cumsum(dl) - dl, dl)
            key = (batch.column(0).to_numpy()[doc].astype(np.int64) * max(1, len(words)) + code) * max(1, len(dl)) + doc
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = _begin(key)  # a document of a term
            own, term = doc[order[at]], key[at] // max(1, len(dl))
            lead = _begin(term)
            cut = pa.array(np.r_[lead, len(at)].astype(np.int32))
            tf = np.diff(np.r_[at, len(key)])
            where = pa.ListArray.from_arrays(pa.array(np.r_[at, len(key)].astype(np.int32)), pa.array(pos[order], pa.int32()))
            lists = [batch.column(1).take(pa.array(own)), pa.array(tf, pa.int32()), pa.array(dl[own], pa.int32()),
                     batch.column(2).take(pa.array(own)), where]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(term[lead] // max(1, len(words)), pa.int32()),
                    words.take(pa.array(term[lead] % max(1, len(words)))),
                    pa.array(np.zeros(len(lead), np.int32)),
                    *(pa.ListArray.from_arrays(cut, values) for values in lists),
                ],
                ["slice", "term", "segment", "ids", "tfs", "dls", "hits", "positions"],
            )

    part = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice")
    return _in_arrow(rows.select(part, "id", "hit", "text", "tokens"), fn, _PIECES)


def _begin(key: np.ndarray) -> np.ndarray:
    """First row of every run of equal keys."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)


def _blocks(index: KeywordIndex, rows: DataFrame, n_docs: int, average: float) -> DataFrame:
    """Blocks of what ``_term_rows`` gives, or of rows (id, term, tf, dl, hit, positions).

    They are dealt by (bucket, slice), sorted, cut and written there.
    """
    slices = max(1, -(-n_docs // SLICE_DOCS))
    if "tokens" in rows.columns:
        return _cut(index, _postings(rows, slices), average, None)
    part = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")
    return _cut(index, _single(rows.withColumns({"slice": part, "segment": F.lit(0)})), average, None)


def _single(rows: DataFrame) -> DataFrame:
    """Pieces of postings of one document each."""
    one = [F.array(c).alias(name) for c, name in (("id", "ids"), ("tf", "tfs"), ("dl", "dls"), ("hit", "hits"))]
    return rows.select("slice", "term", "segment", *one, F.array("positions").alias("positions"))


def _cut(index: KeywordIndex, pieces: DataFrame, average: float, gone: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Blocks, best first, of pieces of postings without the documents ``gone``: (ids, ascending, and
    the segments that removed them)."""
    average = max(average, 1.0)

    def blocked(batches):
        for table in _whole(batches, 3):
            lists = [table.column(c) for c in range(4, 9)]
            turn = np.repeat(np.cumsum(_turns(table, 3)), pc.list_value_length(lists[0]).to_numpy())
            row = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists[0]).to_numpy())
            ids, tf, dl, hit, where = (values.flatten() for values in lists)
            number, count, length = ids.to_numpy(), tf.to_numpy(), dl.to_numpy()
            order = np.lexsort((number, -_impact(count, length, average), turn))
            if gone is not None and len(gone[0]):
                place = np.minimum(np.searchsorted(gone[0], number), len(gone[0]) - 1)
                segment = table.column(3).to_numpy()[row]
                held = (gone[0][place] != number) | (segment >= gone[1][place])
                order = order[held[order]]
            if not len(order):
                continue
            start = _begin(turn[order])
            rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
            at = np.flatnonzero(rank % BLOCK == 0)
            first, offsets = pa.array(row[order[at]]), pa.array(np.r_[at, len(order)].astype(np.int32))
            order_ = pa.array(order)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column(2).take(first), table.column(1).take(first), pa.array(rank[at] // BLOCK),
                    pa.array(np.diff(np.r_[at, len(order)]), pa.int32()),
                    pa.array(np.maximum.reduceat(count[order], at), pa.int32()),
                    pa.array(np.minimum.reduceat(length[order], at), pa.int32()),
                    *(pa.ListArray.from_arrays(offsets, v.take(order_)) for v in (ids, tf, dl, hit, where)),
                    table.column(0).take(first),
                ],
                _BLOCK_NAMES,
            )

    dealt = (
        pieces.withColumn("bucket", index.bucket(F.col("term")))
        .repartition("bucket", "slice")
        .sortWithinPartitions("bucket", "slice", "term")
        .select("bucket", "slice", "term", "segment", "ids", "tfs", "dls", "hits", "positions")
    )
    return _in_arrow(dealt, blocked, _BLOCKS)


def _turns(table: pa.RecordBatch, columns: int) -> np.ndarray:
    """Whether a row's first ``columns`` differ from those of the row before."""
    turn = np.zeros(table.num_rows, dtype=bool)
    for c in range(columns):
        col = table.column(c)
        turn[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    return turn


def _whole(batches, columns: int):
    """Batches in which all rows with equal first ``columns`` stand together; rows come sorted."""
    waiting: list[pa.RecordBatch] = []
    last = None

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        turn = _turns(batch, columns)
        turn[0] = last is not None and last != [batch.column(c)[0].as_py() for c in range(columns)]
        at = np.flatnonzero(turn)
        if len(at):
            cut = int(at[-1])
            if cut:
                waiting.append(batch.slice(0, cut))
            yield whole()
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
        last = [batch.column(c)[batch.num_rows - 1].as_py() for c in range(columns)]
    if waiting:
        yield whole()


def _write(
    index: KeywordIndex, segment: int, docs: DataFrame, blocks: Callable | None, removed: DataFrame | None,
    covers: int = 0, less: tuple[int, int] = (0, 0),
) -> KeywordIndex:
    """Write a segment of documents (id, dl) and the blocks made for their number and average length;
    the manifest row comes last."""
    spark = docs.sparkSession
    at = lambda name: f"{index.path}/{name}/segment={segment}"
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    docs.write.mode("overwrite").parquet(at("docs"))
    if blocks is not None:
        made = blocks(size["n"], size["t"] / max(1, size["n"]))
        made.write.mode("overwrite").partitionBy("bucket").parquet(at("postings"))
    if removed is not None:
        removed.select("id").write.mode("overwrite").parquet(at("removed"))
    row = [(size["n"] - less[0], size["t"] - less[1], covers)]
    manifest = spark.createDataFrame(row, "n_docs bigint, n_tokens bigint, covers int").coalesce(1)
    manifest.write.mode("overwrite").parquet(at("manifest"))
    return index


def _next(index: KeywordIndex, spark: SparkSession) -> int:
    return max((r["segment"] for r in index.segments(spark)), default=-1) + 1


def add_documents(index: KeywordIndex, docs: DataFrame) -> KeywordIndex:
    """Add the documents (id, text[, hit]) whose id the index doesn't hold; known ones stay as they are.

    ``hit`` says whether a document may be returned (all may without it). Of rows with one id the
    one with the smallest text counts; rows without id are left out; a null text has no words.
    """
    spark = docs.sparkSession
    hit = F.col("hit") if "hit" in docs.columns else F.lit(True)
    once = (
        docs.filter("id is not null")
        .select(F.col("id").cast("long").alias("id"), F.struct(F.coalesce("text", F.lit("")).alias("text"), hit.alias("hit")).alias("_d"))
        .groupBy("id")
        .agg(F.min("_d").alias("_d"))
        .select("id", "_d.*")
    )
    fresh = materialize(once.join(index.documents(spark).select("id"), "id", "left_anti"))
    sizes = materialize(_sizes(fresh))
    return _write(index, _next(index, spark), sizes, lambda n, a: _blocks(index, _term_rows(fresh), n, a), None)


def build_index(docs: DataFrame, path: str, buckets: int = BUCKETS) -> KeywordIndex:
    """A new index under ``path``, which must hold none."""
    return add_documents(KeywordIndex(path, buckets), docs)


def remove_documents(index: KeywordIndex, ids: DataFrame) -> KeywordIndex:
    """Take documents (id) out of the index; ids that it doesn't hold change nothing.

    A document that comes back with ``add_documents`` afterwards is indexed anew.
    """
    spark = ids.sparkSession
    gone = materialize(index.documents(spark).join(ids.select("id").distinct(), "id", "left_semi"))
    less = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
    nothing = spark.createDataFrame([], "id bigint, dl int")
    return _write(index, _next(index, spark), nothing, None, gone, less=(less["n"], less["t"]))


def _entries(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each posting of blocks: ``keep``, id, tf, dl, hit and positions if kept."""
    zipped = F.explode(F.arrays_zip("ids", "tfs", "dls", "hits")).alias("e")
    return rows.select(*keep, zipped).select(
        *keep, F.col("e.ids").alias("id"), F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl"), F.col("e.hits").alias("hit")
    )


def _placed(rows: DataFrame, *keep: str) -> DataFrame:
    """As ``_entries``, with the positions."""
    kinds = {"segment": "segment int", "slice": "slice int", "term": "term string"}

    def fn(batches):
        for batch in batches:
            lists = batch.columns[len(keep) :]
            row = pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists[0]).to_numpy()))
            own = [c.take(row) for c in batch.columns[: len(keep)]]
            yield pa.RecordBatch.from_arrays([*own, *(c.flatten() for c in lists)], names)

    names = [*keep, "id", "tf", "dl", "hit", "positions"]
    schema = ", ".join([*(kinds[c] for c in keep), "id bigint, tf int, dl int, hit boolean, positions array<int>"])
    return _in_arrow(rows.select(*keep, "ids", "tfs", "dls", "hits", "positions"), fn, schema)


def compact(index: KeywordIndex, spark: SparkSession) -> KeywordIndex:
    """Rewrite all that is live as one segment, from the postings; earlier ones no longer count."""
    number = _next(index, spark)
    docs = materialize(index.documents(spark).select("id", "dl"))
    pieces, removed, gone = index.postings(spark), index.removed(spark), None
    if removed.limit(SENT_IDS + 1).count() <= SENT_IDS:
        until = removed.groupBy("id").agg(F.max("segment").alias("s")).toArrow().sort_by("id")
        gone = until.column("id").to_numpy(), until.column("s").to_numpy()
    else:
        pieces = _single(_without(_placed(pieces, "segment", "slice", "term"), removed))
    return _write(index, number, docs, lambda n, a: _cut(index, pieces, a, gone), None, covers=number)


def query_units(queries: DataFrame) -> DataFrame:
    """(query_id, unit, words, qtf): terms of every query, those of several words as phrases."""
    words = F.filter(F.transform(query_terms(F.col("text")), search_tokens), lambda w: F.size(w) > 0)
    return (
        queries.select("query_id", F.explode_outer(words).alias("words"))
        .filter("words is not null")
        .groupBy("query_id", "words")
        .agg(F.count("*").alias("qtf"))
        .withColumn("unit", F.array_join("words", " "))
    )


def _phrase_rows(placed: DataFrame, phrases: DataFrame, send) -> DataFrame:
    """(unit, id, tf, dl, hit) of the documents in which the words of a phrase follow each other.

    The postings of the asked words go by document, once whatever the number of phrases; there,
    each pair of neighbouring words is a step of the phrases that hold it.
    """
    m = F.size("words")
    pairs = F.arrays_zip(F.slice("words", F.lit(1), m - 1).alias("a"), F.slice("words", F.lit(2), m - 1).alias("b"))
    steps = phrases.select("unit", m.alias("m"), F.posexplode(pairs).alias("step", "w")).select(
        "unit", "m", "step", F.col("w.a").alias("term"), F.col("w.b").alias("after")
    )
    asked = phrases.select(F.explode("words").alias("term")).distinct()
    few = steps.select("term", "after").distinct().limit(SENT_WORDS + 1).collect()
    wanted = {(r["term"], r["after"]) for r in few} if len(few) <= SENT_WORDS else None

    def beside(batches):
        for table in _whole(batches, 1):
            # rows are (id, dl, hit, term, positions), all of a document in one table
            term, held = table.column(3).dictionary_encode(), table.column(4)
            row = np.repeat(np.arange(len(held)), pc.list_value_length(held).to_numpy())
            pos, ids = held.flatten().to_numpy(), table.column(0).to_numpy()
            order = np.lexsort((pos, ids[row]))
            row, pos = row[order], pos[order]
            code = term.indices.to_numpy()[row]
            met = (ids[row[1:]] == ids[row[:-1]]) & (pos[1:] == pos[:-1] + 1)
            if wanted is not None:
                number = {t: k for k, t in enumerate(term.dictionary.to_pylist())}
                size = max(1, len(number))
                pairs = [number[a] * size + number[b] for a, b in wanted if a in number and b in number]
                met &= np.isin(code[:-1].astype(np.int64) * size + code[1:], pairs)
            at = np.flatnonzero(met)
            first = pa.array(row[at])
            own = [table.column(c).take(first) for c in (0, 1, 2)]
            words = [term.dictionary.take(pa.array(code[k])) for k in (at, at + 1)]
            yield pa.RecordBatch.from_arrays(
                [*own, words[0], words[1], pa.array(pos[at], pa.int32())],
                ["id", "dl", "hit", "term", "after", "pos"],
            )

    held = (
        placed.join(send(asked), "term", "left_semi")
        .select("id", "dl", "hit", "term", "positions")
        .repartition("id")
        .sortWithinPartitions("id")
    )
    neighbours = _in_arrow(held, beside, "id bigint, dl int, hit boolean, term string, after string, pos int")
    return (
        neighbours.join(send(steps), ["term", "after"])
        .groupBy("id", "unit", "m", (F.col("pos") - F.col("step")).alias("start"))
        .agg(F.count("*").alias("n"), F.first("dl").alias("dl"), F.first("hit").alias("hit"))
        .filter("n = m - 1")
        .groupBy("id", "unit")
        .agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"), F.first("hit").alias("hit"))
        .select("unit", "id", "tf", "dl", "hit")
    )


def keyword_search(index: KeywordIndex, queries: DataFrame, k: int = 20) -> DataFrame:
    """BM25 top ``k`` (query_id, id, score, rank) per query (query_id, text): any term may match.

    Ties go to the smaller id. Documents that may not be returned count in the statistics.
    """
    spark = queries.sparkSession
    size = index.segments(spark)
    n_docs, n_tokens = sum(r["n_docs"] for r in size), sum(r["n_tokens"] for r in size)
    average = F.lit(n_tokens / n_docs if n_docs and n_tokens else 1.0)
    units = materialize(query_units(queries))
    words = units.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    send = F.broadcast if words <= SENT_WORDS else (lambda rows: rows)
    terms = units.select(F.explode("words").alias("term")).distinct().withColumn("_b", index.bucket(F.col("term")))
    asked = [r["_b"] for r in terms.select("_b").distinct().collect()]  # bucket numbers
    blocks = index.postings(spark).filter(F.col("bucket").isin(asked)).join(send(terms.select("term")), "term", "left_semi")
    removed = index.removed(spark)
    whole = removed.isEmpty()

    def live(rows: DataFrame) -> DataFrame:
        return rows if whole else _without(rows, removed)

    def weighed(df: Column) -> Column:
        return F.greatest(F.lit(MIN_IDF), F.log((n_docs - df + 0.5) / (df + 0.5)))

    # phrases: their few postings are scored at once
    long = units.filter(F.size("words") > 1)
    phrases = materialize(
        _phrase_rows(live(_placed(blocks, "segment", "term")), long.select("unit", "words").distinct(), send)
    )
    df = phrases.groupBy("unit").agg(F.count("*").alias("df"))
    weight = (F.col("qtf") * weighed(F.col("df"))).alias("w")
    phrase_weights = long.join(df, "unit").select("query_id", F.col("unit").alias("term"), weight)
    phrase_rows = phrases.filter("hit").select("id", F.col("unit").alias("term"), "tf", "dl")
    phrase_most = (
        phrase_rows.groupBy("term")
        .agg(F.max(_impact(F.col("tf"), F.col("dl"), average)).alias("top"))
        .join(phrase_weights, "term")
        .select("query_id", (F.col("w") * F.col("top")).alias("most"))
    )

    # single words: block bounds first
    if whole:
        df = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    else:
        df = live(_entries(blocks, "segment", "term")).groupBy("term").agg(F.count("*").alias("df"))
    wanted = units.filter(F.size("words") == 1).select("query_id", F.col("unit").alias("term"), "qtf")
    weights = materialize(wanted.join(df, "term").select("query_id", "term", weight))
    every_weight = materialize(weights.unionByName(phrase_weights))
    bounds = materialize(
        blocks.select(*_KEY, _impact(F.col("max_tf"), F.col("min_dl"), average).alias("top"))
        .join(send(weights), "term")
        .select("query_id", *_KEY, (F.col("w") * F.col("top")).alias("bound"))
    )
    most = bounds.groupBy("query_id", "term").agg(F.max("bound").alias("most"))
    parts = most.select("query_id", "most").unionByName(phrase_most)
    total = parts.groupBy("query_id").agg(F.sum("most").alias("total"))

    def summed(chosen: DataFrame) -> DataFrame:
        """Scores (query_id, id) from the blocks that some query chose, for all queries with their terms.

        What travels is one row for each posting, by document, not one for each posting and query.
        Parts that a query did not choose lift no document to its hits and change none of them.
        """
        rows = blocks.join(chosen.select(*_KEY).distinct(), _KEY, "left_semi")
        rows = live(_entries(rows, "segment", "term")).filter("hit").select("id", "term", "tf", "dl")
        part = F.col("w") * _impact(F.col("tf"), F.col("dl"), average)
        return (
            rows.unionByName(phrase_rows)
            .repartition("id")
            .join(send(every_weight), "term")
            .groupBy("id", "query_id")
            .agg(F.sum(part).alias("score"))
        )

    few = 1 + k // BLOCK
    first = top_per_group(bounds, ["query_id", "term"], [F.col("bound").desc(), *map(F.col, _KEY)], few)
    seeds = top_per_group(summed(first), ["query_id"], [F.col("score").desc(), F.col("id")], k)
    least = seeds.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    kept = (
        bounds.join(most, ["query_id", "term"])
        .join(total, "query_id")
        .join(least, "query_id", "left")
        .filter("least is null or bound + total - most >= least - 1e-9")
    )
    return top_per_group(summed(kept), ["query_id"], [F.round("score", 9).desc(), F.col("id")], k).select(
        "query_id", "id", "score", "rank"
    )
