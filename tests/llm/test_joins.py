"""N-gram join, decontamination: against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import decontamination as D
from palimpsest.llm import ngram_join as J
from palimpsest.llm import trie

WORDS = [f"w{i}" for i in range(60)]


def shingles(text, n=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    low = {}
    for k, row in enumerate(rows):
        ids = [r[0] for r, x in zip(rows, label) if x == label[k] and r[0] is not None]
        low[k] = min(ids) if ids else None
    return sorted(
        ((r[0], len(sets[k]), low[k] if low[k] is not None else r[0]) for k, r in enumerate(rows)), key=str
    )


def edited(rnd, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = rnd.choice(WORDS) + "e"
    return words


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    rows, k = [], 0
    passage = [rnd.choice(WORDS) for _ in range(60)]
    for _ in range(12):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.randint(1, 8)):
            rows.append((k * 7 % 1009, " ".join(edited(rnd, base, rnd.randint(0, 4)))))
            k += 1
    for _ in range(15):  # passages that many documents share
        rows.append((k * 7 % 1009, " ".join(passage + [rnd.choice(WORDS) for _ in range(rnd.randint(0, 40))])))
        k += 1
    rows += [(2000, rows[0][1].upper()), (2001, rows[0][1]), (2001, rows[0][1])]
    return rows


@pytest.mark.parametrize("block", [1, 4])  # 1: lists are dealt by their next shingle
def test_components_equal_brute_force(table, corpus, block):
    found = J.jaccard_components(table(corpus), block=block).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_components(corpus)


def test_components_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = J.jaccard_components(odd).collect()
    assert sorted((tuple(r) for r in found), key=str) == brute_components(rows)
    assert J.jaccard_components(empty).count() == 0


def test_one_document_of_each_group_stays(table, corpus):
    kept = J.one_per_component(table(corpus))
    ids = {c for _, _, c in brute_components(corpus)}
    assert {r["doc_id"] for r in kept.collect()} == ids
    assert kept.columns == table(corpus).columns


def test_hot_tokens_and_large_groups(table):
    rnd = random.Random(9)
    base = [rnd.choice(WORDS) for _ in range(80)]
    rows = [(k, " ".join(edited(rnd, base, 1))) for k in range(250)] + [(900, "a b c d e f")]
    found = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(table(rows), block=32).collect()}
    assert found == {r[0]: c for r, c in zip(sorted(rows), [x[2] for x in sorted(brute_components(rows), key=lambda x: x[0])])}


def test_a_block_links_its_components_as_a_star(spark):
    """Sets of a chain, each like its neighbours only, are one step from the smallest label."""
    sets = [np.arange(40 + 4 * k, 80 + 4 * k, dtype=np.int64) for k in range(12)]
    labels = [7, 3, 11, 5, 2, 9, 12, 1, 8, 4, 10, 6]
    held = spark.createDataFrame(
        [(s, 40, bytearray(keys.tobytes())) for s, keys in zip(labels, sets)], "sig long, n long, keys binary"
    )
    blocks = spark.createDataFrame([(1, 0, 0, s, s) for s in labels], "bucket long, next long, part int, sig long, comp long")
    found = sorted((r["a"], r["b"]) for r in J.block_links(blocks, held, 75, 100).collect())
    assert found == [(1, s) for s in range(2, 13)]


def test_trie_links_equal_pairs():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        sets = []
        for _ in range(25):
            if sets and rnd.random() < 0.6:
                own = set(sets[rnd.integers(len(sets))].tolist())
                own ^= set(rnd.integers(0, 60, rnd.integers(0, 5)).tolist())
            else:
                own = set(rnd.integers(0, 60, rnd.integers(1, 30)).tolist())
            sets.append(np.array(sorted(own or {1}), dtype=np.uint64))
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
        forest = trie.Forest(len(sets))
        for a, b in trie.similar(sets, list(range(len(sets)))):
            forest.union(a, b)
        roots = [forest.root(i) for i in range(len(sets))]
        assert [[a == b for b in roots] for a in roots] == [[a == b for b in label] for a in label]


def test_shared_rows_across_batches():
    rnd = np.random.default_rng(1)
    token, sig = rnd.integers(0, 40, 300), rnd.integers(0, 4, 300)
    token = 2 * token + (token % 13 == 0)  # the lowest bit marks tokens that stand out
    rows = np.column_stack([token, sig]).astype(np.int64)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    whole, _ = J._shared(rows, True)
    for size in (1, 2, 3, 7):
        rest, out = rows[:0], []
        for a in range(0, len(rows), size):
            made, rest = J._shared(np.concatenate([rest, rows[a : a + size]]), False)
            out.append(made)
        out.append(J._shared(rest, True)[0])
        assert np.array_equal(np.unique(np.concatenate(out), axis=0), whole)


def words_of(text):
    return [w.lower() for w in (text or "").split()]


def brute_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, row[0] = row[0], i
        for j in range(1, len(text) + 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (w != text[j - 1]))
    return min(row)


def test_leaks_against_brute_force(spark, table):
    rnd = random.Random(2)
    items = [(k, " ".join(rnd.choice(WORDS) + str(k) for _ in range(rnd.randint(8, 50)))) for k in range(25)]
    rows = []
    for k in range(200):
        w = words_of(rnd.choice(items)[1])
        for _ in range(rnd.randint(0, len(w) // 3)):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice([[], [rnd.choice(WORDS)], [w[at], rnd.choice(WORDS)]])
        around = [[rnd.choice(WORDS) for _ in range(rnd.randint(0, 40))] for _ in range(2)]
        rows.append((k, " ".join(around[0] + w + around[1])))
    found = {
        (r["doc_id"], r["item_id"]): r["edits"]
        for r in D.find_leaks(table(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    }
    wanted = {}
    for k, text in rows:
        for i, item in items:
            edits = brute_edits(words_of(item), words_of(text))
            if edits <= len(words_of(item)) // 4:
                wanted[k, i] = edits
    assert set(found) <= set(wanted)
    assert len(found) >= 0.95 * len(wanted)
    assert all(found[p] >= wanted[p] for p in found)
    exact = {p for p, e in wanted.items() if e == 0}
    assert exact <= set(found) and all(found[p] == 0 for p in exact)


@pytest.mark.parametrize("length", [60, 120, 300, 600])
def test_long_items_are_found_at_the_bound(length):
    rnd = random.Random(length)
    items = [(k, [f"v{k}x{rnd.randrange(3000)}" for _ in range(length)]) for k in range(10)]
    rows, wanted = [], set()
    for n in range(40):
        k, w = n % 10, list(items[n % 10][1])
        for _ in range(length // 4):
            at = rnd.randrange(len(w))
            w[at : at + 1] = rnd.choice([[], ["other"], [w[at], "other"]])
        text = [f"a{rnd.randrange(99)}" for _ in range(60)] + w + [f"b{rnd.randrange(99)}" for _ in range(60)]
        rows.append((n, " ".join(text)))
        if brute_edits(items[k][1], text) <= length // 4:
            wanted.add((n, k))
    built = D.Items.build([(k, " ".join(w)) for k, w in items], D.MAX_RATE, D.RECALL, D.SAMPLES)
    batch = pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    found = {(r["doc_id"], r["item_id"]) for out in D.leaks(iter([batch]), built) for r in out.to_pylist()}
    assert len(wanted) == 40 and found <= wanted
    assert len(found) >= 39


def test_best_stretch_equals_dynamic_programme():
    rnd = random.Random(4)
    for _ in range(200):
        item = [rnd.randrange(4) for _ in range(rnd.randint(1, 9))]
        text = [rnd.randrange(4) for _ in range(rnd.randint(0, 12))]
        edits, start = D.best_stretch(np.array(item, np.uint64), np.array(text, np.uint64))
        assert edits == brute_edits(item, text)
        assert 0 <= start <= len(text)


def test_leaks_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (None, "same row"), (3, "the same row twice"), (3, "the same row twice")],
        "item_id long, text string",
    )
    found = sorted((r["doc_id"], r["item_id"] or 0) for r in D.find_leaks(odd, items).collect())
    assert found == [(5, 0)] * 2 + [(5, 3)] * 4
    assert D.find_leaks(empty, items).count() == 0
    assert D.find_leaks(odd, items.limit(0)).count() == 0
    kept = D.clean_documents(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2


def test_candidate_pairs_come_once(spark):
    """Classes that meet in several lists, and in several blocks of one list."""
    rnd = np.random.default_rng(3)
    held = {s: set(rnd.choice(12, 6, replace=False).tolist()) for s in range(1, 10)}
    rows = [(t, s) for s, tokens in held.items() for t in tokens]
    shared = spark.createDataFrame(rows, "token long, sig long")
    sizes = spark.createDataFrame([(s, 20) for s in held], "sig long, n long")
    comps = spark.createDataFrame([(1, 1), (2, 1)], "sig long, comp long")
    want = {
        (a, b)
        for a in held
        for b in held
        if a < b and (a, b) != (1, 2) and len(held[a] & held[b]) >= J.least_shared(20, 20, 75, 100)
    }
    assert want
    for limit in (2, 256):
        blocks = J.second_round(shared, comps, limit)
        found = [(r["centre"], r["sig"]) for r in J.passing(shared, sizes, blocks, 75, 100).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_wide_families_meet_in_bounded_blocks(spark):
    """Many near copies that the first round left apart: parts of them meet, each pair somewhere."""
    rnd = np.random.default_rng(5)
    keys = {s: np.sort(rnd.choice(24, 20, replace=False)).astype(np.int64) for s in range(1, 121)}
    sets = spark.createDataFrame([(s, 20, k.tobytes()) for s, k in keys.items()], "sig long, n long, keys binary")
    shared = spark.createDataFrame([(int(t), s) for s, k in keys.items() for t in k[:6]], "token long, sig long")
    comps = spark.createDataFrame([(s, 1) for s in range(1, 31)], "sig long, comp long")
    rows = J.second_round(shared, comps, sets, 75, 100, 8).collect()
    blocks = {}
    for r in rows:
        blocks.setdefault((r["bucket"], r["next"], r["part"]), set()).add(r["sig"])
    assert max(map(len, blocks.values())) <= 40
    met = {(a, b) for held in blocks.values() for a in held for b in held}
    similar = {
        (a, b) for a in keys for b in keys
        if a < b and b > 30 and 100 * len(np.intersect1d(keys[a], keys[b])) >= 75 * len(np.union1d(keys[a], keys[b]))
    }
    assert similar and similar <= met


def test_shingles_are_dealt_in_packs(spark):
    """What op1 shuffles and sorts is a few packs for each part, not a row for each shingle (F2)."""
    rnd = np.random.default_rng(5)
    first, second = rnd.integers(-(2**62), 2**62, 5000), rnd.integers(0, 9, 5000)
    rows = list(zip(first.tolist() * 2, second.tolist() * 2, strict=True))
    packs = J.prefix_rows(spark.createDataFrame(rows, "token long, sig long").coalesce(1), 7)
    assert packs.count() <= 7
    got = [x for f, s in J.unpacked(iter(J.dealt(packs).toArrow().to_batches())) for x in zip(f.tolist(), s.tolist(), strict=True)]
    assert sorted(got) == sorted(set(rows))
    # classes of a usual token stay together, those of one that stands out are dealt
    for bit, parts in ((0, 1), (1, 7)):
        token = np.full(500, 2 * 12345 + bit)
        made = [b for p in [J.Packer(7)] for b in (*p.add(token, np.arange(500)), *p.rest())]
        assert len({x for b in made for x in b.column(0).to_pylist()}) == parts


def test_the_bitmap_comes_as_arrays(spark, monkeypatch):
    """The driver gets the candidate bitmap without a Python object for each word (F1)."""
    frames = type(spark.range(1))
    rows = spark.range(3000).selectExpr("id AS doc_id", "id + 10 AS sig")

    def refused(self):
        raise AssertionError("collected as rows")

    want = J.candidate_bits(rows, rows.select("sig"))
    monkeypatch.setattr(frames, "collect", refused)
    got = J.candidate_bits(rows, rows.select("sig"))
    assert (got == want).all() and (got != 0).sum() == 3000
