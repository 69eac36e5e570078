"""Phrases, embedding near-duplicates, token alignment: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from palimpsest.llm import alignment as A
from palimpsest.llm import phrases as P
from palimpsest.llm import vector_join as V

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")


def brute_phrases(rows, top, threshold):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= threshold}
        made = []
        for p, a in found.items():
            held = [x for q, x in found.items() if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * x >= 50 * a for x in held):
                continue
            cuts = [(1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            made.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, text, left, right) in enumerate(sorted(made)[:top], 1):
            out.append((lang, rank, text.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shards", [1, 2, 3])
def test_phrases_equal_brute_force(table, shards):
    rnd = random.Random(shards)
    words = ["New", "york", "city", "hall", "éa", "red", "Wine", "of", "the", "a"]
    rows = []
    for k in range(400):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))
        if rnd.random() < 0.5:
            text += rnd.choice([" new  york\tcity, ", "; Red Wine\n", ". ", "! the the the the "])
        rows.append((k if k % 9 else None, text, rnd.choice(["en", "en", "de", None, "und"])))
    rows += rows[:30]
    found = P.collocations(table(rows), top=20, threshold=8, shards=shards).collect()
    assert sorted(tuple(r) for r in found) == brute_phrases(rows, 20, 8)


def test_phrases_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert sorted(tuple(r) for r in P.collocations(odd).collect()) == brute_phrases(rows, 2000, 10)
    assert P.collocations(empty).count() == 0


def test_counts_survive_packing():
    rnd = np.random.default_rng(1)
    keys = np.unique(rnd.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    counts = rnd.integers(1, 2**40, len(keys), dtype=np.uint64)
    back = P.unpack(P.pack(keys, counts))
    assert (back[0] == keys).all() and (back[1] == counts).all()


VECTOR = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("sig", T.StringType()),
        T.StructField("part", T.StringType()),
    ]
)


def brute_vectors(rows, cosine=0.98):
    n = len(rows)
    links = [set() for _ in range(n)]
    for i, (_, e, label) in enumerate(rows):
        for j in range(i):
            other = rows[j][1]
            if label is None or rows[j][2] != label or not e or not other or len(e) != len(other):
                continue
            if any(x is None or not np.isfinite(x) for x in [*e, *other]):
                continue
            a, b = np.float32(e).astype(float), np.float32(other).astype(float)
            if a.any() and b.any() and a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        low = min(ids) if ids else None
        out.append((row[0], len(links[i]), low, row[0] == low))
    return sorted(out, key=str)


def noisy(rnd, centre, spread):
    return [float(np.float32(x)) for x in centre + rnd.normal(0, spread, len(centre))]


@pytest.fixture(scope="module")
def vector_rows():
    rnd = np.random.default_rng(3)
    rows, k = [], 0
    for d, spread in ((64, 0.012), (64, 0.02), (16, 0.03), (3, 0.05), (2, 0.05)):
        for _ in range(6):
            centre = rnd.normal(size=d)
            centre /= np.linalg.norm(centre)
            for _ in range(rnd.integers(1, 14)):
                rows.append((k * 37 % 4001, noisy(rnd, centre * rnd.uniform(0.1, 9), spread), int(rnd.integers(0, 2))))
                k += 1
    rows += [rows[0], rows[0], (5000, rows[0][1], rows[0][2]), (5001, rows[0][1], None), (None, rows[3][1], rows[3][2])]
    rows += [
        (6000, None, 1), (6001, [], 1), (6002, [0.0] * 64, 1), (6003, [1.0, None], 1),
        (6004, [float("nan"), 1.0], 1), (6005, [float("inf"), 1.0], 1), (6006, [0.0, -0.0], 1),
    ]
    return rows


def test_vectors_equal_brute_force(spark, vector_rows):
    frame = spark.createDataFrame([(*r, "x", "y") for r in vector_rows], VECTOR).repartition(3)
    found = sorted((tuple(r) for r in V.near_duplicates(frame).collect()), key=str)
    assert found == brute_vectors(vector_rows)
    assert any(r[1] for r in found)
    assert V.near_duplicates(frame.filter("vec_id < 0")).count() == 0


def test_vectors_in_parts_and_cuts(spark, vector_rows, monkeypatch):
    for name, value in (("PART_ROWS", 5), ("GROUP_ROWS", 4), ("CHUNK", 3), ("CUT_ROWS", 2)):
        monkeypatch.setattr(V, name, value)
    frame = spark.createDataFrame([(*r, "x", "y") for r in vector_rows], VECTOR).repartition(3)
    assert sorted((tuple(r) for r in V.near_duplicates(frame).collect()), key=str) == brute_vectors(vector_rows)


class Library:
    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}

    def tokens(self, text):
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        spelled_a = [bytes(self.back[c] for c in self.a.id_to_token(k)) for k in a]
        spelled_b = [
            bytes([int(self.b.id_to_piece(k)[1:-1], 16)]) if self.b.is_byte(k)
            else self.b.id_to_piece(k).replace("▁", " ").encode()
            for k in b
        ]
        same = b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode()
        return (a, spelled_a, b, spelled_b) if same else None


def brute_alignment(rows):
    library, out, count = Library(), [], Counter()
    for doc_id, text in rows:
        made = library.tokens(text) if text else None
        if made is None:
            out.append((doc_id, 0, 0, [], ""))
            continue
        a, spelled_a, b, spelled_b = made
        ends_a, ends_b = np.cumsum([len(s) for s in spelled_a]), np.cumsum([len(s) for s in spelled_b])
        at_a, at_b = {e: k for k, e in enumerate(ends_a.tolist())}, {e: k for k, e in enumerate(ends_b.tolist())}
        links, parts, i, j = [], [], 0, 0
        for end in sorted(at_a.keys() & at_b.keys()):
            p, q = at_a[end], at_b[end]
            parts.append(",".join(map(str, a[i : p + 1])) + "|" + ",".join(map(str, b[j : q + 1])))
            links.append((a[p], b[q]))
            i, j = p + 1, q + 1
        count.update(links)
        out.append((doc_id, len(a), len(b), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return sorted(
        (
            (d, n_a, n_b, len(links), len(links), sum(count[x] == most[x[1]] for x in links),
             sum(count[x] for x in links), sha)
            for d, n_a, n_b, links, sha in out
        ),
        key=str,
    )


def test_alignment_equals_brute_force(table):
    rnd = random.Random(11)
    parts = ["hello", "World", " ", "  ", "\n", "naïve", "日本", "<|endoftext|>", "<s>", "<0x0A>", "▁", "''", "don't",
             "123", "4567", "...", "\t", "Straße", "xqzj", "🙂", " ", "unbelievably", "ing"]
    rows = [(k, "".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 40)))) for k in range(150)]
    rows += [(k + 500, " ".join(rnd.choice(parts[:9] + parts[11:]) for _ in range(60))) for k in range(40)]
    found = sorted((tuple(r) for r in A.align(table(rows), PATH_A, PATH_B).collect()), key=str)
    assert found == brute_alignment(rows)
    assert sum(r[3] > 0 for r in found) > 40


def test_alignment_of_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted((tuple(r) for r in A.align(odd, PATH_A, PATH_B).collect()), key=str) == brute_alignment(rows)
    assert A.align(empty, PATH_A, PATH_B).count() == 0


def test_groups_cover_the_text(table):
    text = "An unbelievably naïve walk, 1234 xqzj"
    rows = A.groups(table([(1, text), (2, None), (3, "two words")]), PATH_A, PATH_B).orderBy("doc_id", "start").collect()
    own = [r for r in rows if r["doc_id"] == 1]
    assert own[0]["start"] == 0 and own[-1]["end"] == len((" " + text).encode())
    assert all(x["end"] == y["start"] for x, y in zip(own, own[1:]))
    assert [k for r in own for k in r["b_ids"]] == Library().b.encode(text)
    assert {r["doc_id"] for r in rows} == {1, 3}


def test_aligned_runs():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randint(1, 80)
        x = sorted({rnd.randint(1, n) for _ in range(rnd.randint(0, n))} | {n})
        y = sorted((set(x) if rnd.random() < 0.5 else set()) | {rnd.randint(1, n) for _ in range(rnd.randint(0, n // 4))} | {n})
        i, j = A.aligned(np.array(x), np.array(y))
        both = sorted(set(x) & set(y))
        assert [x[k - 1] for k in i] == both and [y[k - 1] for k in j] == both
