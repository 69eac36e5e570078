"""Token store, pieces, toxicity, languages, pipeline."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import arrays as A
from palimpsest.llm import language as G
from palimpsest.llm import pieces as S
from palimpsest.llm import token_store as B
from palimpsest.llm import toxicity as T
from palimpsest.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_store(rows):
    coder = Tokenizer.from_file(BPE)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(coder.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_store_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op2_token_store"](spark, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, found)) == plain_store(rows)


def test_store_of_odd_rows(spark, odd, empty):
    folder = B.store_folder(spark, "odd")
    B.write_store(odd, folder, BPE)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    found = sorted((tuple(r) for r in B.read_store(spark, folder).collect()), key=key)
    assert found == plain_store([(r["doc_id"], r["text"]) for r in odd.collect()])
    folder = B.store_folder(spark, "none")
    B.write_store(empty, folder, BPE)
    assert B.read_store(spark, folder).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZé×ß'sre 1²_.,!\n\t  \x1f日é<|", max_size=40))
def test_stretches_encode_as_whole_texts(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    made = B.encoder(BPE).encode(raw, np.array([0, len(raw)]))[0]
    assert made.tolist() == B.encoder(BPE).tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_texts_are_those_of_the_library():
    texts = ["a<|endoftext|>b", "<|endoftext|>", "no <|endoftext| one", "two  <|endoftext|> <|endoftext|>x's"]
    off = np.cumsum([0, *(len(t) for t in texts)])
    made = B.encoder(BPE).encode(np.frombuffer("".join(texts).encode(), dtype=np.uint8), off)
    coder = Tokenizer.from_file(BPE)
    assert [m.tolist() for m in made] == [coder.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [7, 8, 299_999, 300_000])
def test_runs_of_one_letter_are_searched_in_time(n):
    found = S.lattice(PIECES, 3).search("x" * n)
    assert len(found) == 3 and found[0][0] >= found[1][0] >= found[2][0]
    if n < 10:
        every = all_scores(S.lattice(PIECES, 3), "x" * n)
        assert [round(s, 6) for s, _ in found] == [round(s, 6) for s in sorted(every, reverse=True)[:3]]


def all_scores(lattice, text):
    if not text:
        return [0.0]
    out = []
    for k in range(1, len(text) + 1):
        ids, score = lattice.pieces.get(text[:k], (None, 0.0))
        if ids is not None:
            out += [score + rest for rest in all_scores(lattice, text[k:])]
    return out


def test_scores_that_are_no_whole_numbers():
    lattice = S.Lattice(PIECES, 3)
    lattice.pieces = {p: (ids, score + 0.25 if ids else score) for p, (ids, score) in lattice.pieces.items()}
    raw = np.frombuffer(b"xyx", dtype=np.uint8)
    ((ids, score, losses),) = lattice.encode(raw, np.array([0, 3]))
    every = sorted(all_scores(lattice, "▁xyx"), reverse=True)
    assert score == pytest.approx(every[0]) and [score - x for x in losses] == pytest.approx(every[1:3])


def test_shard_reads_one_document_and_checks_its_dictionary():
    import zstandard

    rows = [(None, 3, np.array([1, 2, 3], "<u2")), (7, 2, np.array([9, 8], "<u2"))]
    frames = [(d, n, zstandard.ZstdCompressor().compress(i.tobytes())) for d, n, i in rows]
    shard = B.Shard(B.pack(frames, 2, b""), b"")
    assert shard.ids(1).tolist() == [9, 8] and shard.entry(0)[0] is None
    with pytest.raises(ValueError):
        B.Shard(B.pack(frames, 2, b"x"), b"")


def brute_segmentations(lattice, text, n):
    out = []

    def go(i, ids, score):
        if i == len(text):
            out.append((score, ids))
            return
        for j in range(i + 1, len(text) + 1):
            found = lattice.pieces.get(text[i:j])
            if found and found[0] is not None:
                go(j, ids + list(found[0]), score + found[1])
            elif j == i + 1:
                go(j, ids + [lattice.bytes[b] for b in text[i].encode()], score + lattice.unknown)

    go(0, [], 0.0)
    return sorted(out, key=lambda x: -x[0])[:n]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="▁theraniñ.日\nab1", min_size=1, max_size=10))
def test_search_equals_brute_force(text):
    lattice = S.lattice(PIECES, 4)
    wanted = brute_segmentations(lattice, text, 4)
    found = lattice.search(text)
    assert [s for s, _ in found] == [s for s, _ in wanted]
    assert sorted(map(tuple, (i for _, i in found)))[0:1] != [] and len({tuple(i) for _, i in found}) == len(found)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="thera. ñ\n1", max_size=8))
def test_texts_of_several_stretches(text):
    lattice = S.lattice(PIECES, 4)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    ids, score, losses = lattice.encode(raw, np.array([0, len(raw)]))[0]
    if text:
        wanted = brute_segmentations(lattice, "▁" + text.replace(" ", "▁"), 4)
        assert [score, *(score - x for x in losses)] == [s for s, _ in wanted]
        assert lattice.decode(ids) == text.encode()
    else:
        assert (len(ids), score, losses) == (0, 0, [])


def test_pieces_of_odd_rows(odd, empty):
    found = S.segment(odd, PIECES, with_ids=True).collect()
    assert len(found) == odd.count() and all(r["lossless"] for r in found)
    assert all(r["n_pieces"] == len(r["ids"]) for r in found)
    assert S.segment(empty, PIECES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="thera. ñ\n1", max_size=8), min_size=1, max_size=3))
def test_all_n_segmentations_of_whole_texts(texts):
    lattice = S.lattice(PIECES, 4)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    found = lattice.segmentations(np.frombuffer("".join(texts).encode(), dtype=np.uint8), off)
    for text, (ids, score, losses, others) in zip(texts, found, strict=True):
        ways = [ids, *others]
        assert len({tuple(w.tolist()) for w in ways}) == len(ways) == 1 + len(losses)
        assert lattice.gives_back(ways, text.encode())
        if text:
            every = brute_segmentations(lattice, "▁" + text.replace(" ", "▁"), 10**6)
            scores = {tuple(i): s for s, i in every}
            assert [scores[tuple(w.tolist())] for w in ways] == [score, *(score - x for x in losses)]
            assert len(ways) == min(4, len(every))


def test_segmentations_that_do_not_give_the_text_back_are_told():
    lattice = S.lattice(PIECES, 3)
    raw = np.frombuffer(b"some text", dtype=np.uint8)
    ((ids, _, _, others),) = lattice.segmentations(raw, np.array([0, 9]))
    assert lattice.gives_back([ids, *others], b"some text")
    assert not lattice.gives_back([ids, others[0][:-1], others[1]], b"some text")


def test_nbest_rows_hold_every_segmentation(table):
    docs = table([(1, "the small house. 12\tß"), (2, None), (3, "a▁b " + "x" * 100)])
    rows = {r["doc_id"]: r for r in S.segment(docs, PIECES, with_ids=True).collect()}
    for r in rows.values():
        assert len(r["nbest_ids"]) == len(r["nbest_scores"]) == len(r["nbest_crc32"]) and r["lossless"]
        assert r["nbest_ids"][0] == r["ids"] and r["nbest_crc32"][0] == r["ids_crc32"]
        assert r["nbest_crc32"] == [zlib.crc32(np.array(i, "<u4").tobytes()) for i in r["nbest_ids"]]
    assert [rows[k]["text"] for k in (1, 2, 3)] == ["the small house. 12\tß", "", "a b " + "x" * 100]
    assert [len(rows[k]["nbest_ids"]) for k in (1, 2, 3)] == [3, 1, 3]


def test_operators_that_keep_nothing_forget_what_others_kept(spark, odd):
    def kept(batches):
        held = len(A._KEPT)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([held] * batch.num_rows)], ["held"])

    S.segment(odd, PIECES).count()
    S.segment(odd, PIECES).agg(F.sum("n_pieces")).collect()
    assert {r["held"] for r in A.over_texts(odd, kept, "held long").collect()} == {0}


def test_batches_of_texts_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["size", "n"])

    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 10_000).alias("text"))
    found = A.over_texts(docs.coalesce(1), sizes, "size long, n long").collect()
    assert sum(r["n"] for r in found) == 400 and max(r["size"] for r in found) < A.BATCH_BYTES + 200_000


def test_remembered_stretches_keep_their_arrays():
    table = A.UnitTable(np.dtype("<i4"), 10_000)
    rnd = random.Random(5)
    for _ in range(30):
        words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(50)]
        ends = np.cumsum([len(w) for w in words])
        raw = np.frombuffer("".join(words).encode(), dtype=np.uint8)
        rows = table.rows(raw, ends - [len(w) for w in words], ends, lambda u: [np.frombuffer(x, "u1") for x in u])
        flat, done = table.gather(rows)
        assert flat.tolist() == raw.tolist() and done.tolist() == ends.tolist()


def test_pieces_of_the_smoke_data(spark):
    assert QUERIES["op5_nbest_pieces"](spark, SF).filter("lossless").count() == 200


@pytest.fixture(scope="module")
def letters(spark):
    return T.trigram_model(T.letter_counts(spark.read.parquet(f"{SF}/documents.parquet")))


@pytest.mark.parametrize(
    ("word", "wanted"),
    [("l0ser", "loser"), ("m.o.r.o.n", "moron"), ("tr@sh", "trash"), ("$tupid", "stupid"), ("stuuuupid", "stupid"),
     ("clown!!", "clown"), ("w0rthl3ss", "worthless"), ("plain", "plain"), ("id1ot", "idiot")],
)
def test_restored_spellings(letters, word, wanted):
    assert T.spelled(word, letters) == [wanted]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("you are a l o s e r", "loser"), ("i d 1 o t", "idiot"), ("you s c u m. go", "scum"), ("mor-on", "moron"),
     ("stu.pid", "stupid"), ("lo*ser", "loser"), ("l. 0 - s e r!", "loser"), ("so m o ro n", "moron")],
)
def test_spaces_and_separators_are_read(letters, text, wanted):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    cells = T.Reader(letters, None).documents(raw, np.array([0, len(raw)]))[0]
    assert T._cell("=" + wanted) in cells.tolist()


def test_letter_counts(table):
    texts = ["ab Ba", "", None, "éa"]
    counts = T.letter_counts(table(list(enumerate(texts))))
    assert counts[0, 1, 2] == 1 and counts[0, 2, 1] == 1 and counts[0, 27, 1] == 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op7_toxicity"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right >= 0.9 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert found.count() == 1000


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model = T.learn(odd, labels)
    assert T.score(odd, model).count() == odd.count()
    assert T.learn(empty, labels.limit(0)) is None
    assert T.score(odd, None).filter("score = 0").count() == odd.count()
    assert T.clean_documents(odd, None).count() == odd.count()


def test_obfuscated_words_are_caught(spark, table):
    rnd = random.Random(3)
    plain = "the house river cloud with small over green".split()
    rows = [(k, " ".join(rnd.choice(plain) for _ in range(40)) + (" moron loser" if k % 5 == 0 else "")) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k, _ in rows], "doc_id long, toxic int")
    model = T.learn(table(rows), labels)
    odd = [(1, "the m0r0n house"), (2, "the l o s e r cloud"), (3, "green looooser river"), (4, "the river house")]
    assert {r["doc_id"]: r["predicted"] for r in T.score(table(odd), model).collect()} == {1: 1, 2: 1, 3: 1, 4: 0}


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op10_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = found.join(docs, "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_kernel_equals_sets():
    texts = ["abc abc", "the cat", "", "ñandú!"]
    sets = [set(G.present(t).tolist()) if t else set() for t in texts]
    found = G.kernel(G.vectors(texts), G.vectors(texts))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert found[i, j] == pytest.approx(len(a & b) / max(1, (len(a) * len(b)) ** 0.5), abs=1e-5)


def test_more_languages_than_landmarks(table):
    rnd = random.Random(6)
    rows = []
    for g in range(70):
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        rows += [(10 * g + k, " ".join(rnd.choice(words) for _ in range(40)), f"l{g:02}") for k in range(6)]
    docs = table(rows)
    model = G.learn(docs)
    found = {r["doc_id"]: r["lang_pred"] for r in G.identify(docs, model).collect()}
    assert len(model.languages) == 70 and all(found[k] == lang for k, _, lang in rows)


def test_languages_of_odd_rows(odd, empty):
    model = G.learn(odd)
    found = {r["doc_id"]: r for r in G.identify(odd, model).collect()}
    assert len(found) == 9 and found[1]["lang_pred"] == "und" and found[3]["score"] == 0
    assert G.learn(empty) is None and G.identify(empty, None).count() == 0
    assert G.identify(odd, None).filter("lang_pred = 'und'").count() == odd.count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.columns
    n = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == before
        docs = docs.cache()
        n.append(docs.count())
    assert n[0] > n[1] > n[2] >= n[3] == n[4]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n[4] and last.filter("not lossless").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == n[4]
