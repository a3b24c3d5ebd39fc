"""Periodic runs, vector codes and the Jaccard join, against brute force."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from spanlab.llm import parity_join, periodic_runs, vector_codes
from spanlab.llm.common import read_table
from tests.llm.fixtures import documents, empty
from tests.llm.test_corpus_operators import brute_components

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    """Every period in turn: the stretches whose words equal those q further on."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q - s), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    first = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *first, digest("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), digest(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    random.seed(11)
    for _ in range(400):
        texts = []
        for _ in range(random.randint(1, 4)):
            n, k = random.randint(0, 70), random.randint(1, 4)
            w = [bytes([97 + random.randrange(k)]) for _ in range(n)]
            if n > 8 and random.random() < 0.7:
                a, p = random.randrange(n), random.randint(1, n // 5 + 1)
                w = [w[a + (i - a) % p] if i >= a and a + (i - a) % p < n else w[i] for i in range(n)]
            texts.append(w)
        assert periodic_runs.runs_of_texts(texts) == [brute_runs(w) for w in texts]


def test_suffix_array():
    random.seed(3)
    for _ in range(60):
        ids = [0] + [random.randint(1, 3) for _ in range(random.randint(1, 60))] + [9]
        order, rank, lcp = periodic_runs.suffix_array(np.array(ids))
        assert order.tolist() == sorted(range(len(ids)), key=lambda i: ids[i:]) and [rank[i] for i in order] == list(range(len(ids)))
        common = lambda a, b: next(k for k in range(len(ids)) if ids[a + k] != ids[b + k])
        assert lcp[1:].tolist() == [common(a, b) for a, b in zip(order[:-1], order[1:])]


def test_runs_of_long_periodic_texts_are_quick():
    assert periodic_runs.runs_of_texts([[b"x"] * 100_000, [b"a", b"b"] * 50_000]) == [[(0, 100_000, 1)], [(0, 100_000, 2)]]


def test_period_that_is_a_multiple_and_neighbours():
    w = "a b a b a b a b c a a a a a a b b b b b b".encode().split()
    assert periodic_runs.runs_of_texts([w]) == [[(0, 8, 2), (9, 6, 1), (15, 6, 1)]]
    assert periodic_runs.collapsed(w, [(0, 8, 2), (9, 6, 1), (15, 6, 1)]) == b"a b c a b".split()


def test_periodic_query(spark):
    got = sorted(tuple(r) for r in periodic_runs.op11_periodic_runs(spark, SF).collect())
    assert got == sorted(brute_row(r["doc_id"], r["text"]) for r in read_table(spark, SF, "documents").collect())
    assert any(r[1] for r in got)


def test_periodic_awkward_rows(spark):
    docs = documents(spark)
    key = lambda r: (r[0] is not None, *r)
    got = sorted((tuple(r)[:8] for r in periodic_runs.periodic_runs(docs, plant=True).collect()), key=lambda r: repr(key(r)))
    assert got == sorted((brute_row(r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: repr(key(r)))
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0
    spans = {r["doc_id"]: r["runs"] for r in periodic_runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in spans[16]] == [(0, 240, 8)] and spans[5] == []


def brute_codes(rows, rounds=4, entries=256):
    """(vec_id, label, components) against every entry, in Python integers."""
    width = len(rows[0][2]) // 4
    part = lambda v, k: v[k * width : (k + 1) * width]
    start = sorted(rows)[:entries]
    books = [[part(v, k) for _, _, v in start] for k in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), i) for i, y in enumerate(book))
    for _ in range(rounds):
        for k in range(4):
            held = {}
            for _, _, v in rows:
                held.setdefault(near(part(v, k), books[k])[1], []).append(part(v, k))
            books[k] = [tuple(sum(c) // len(held[i]) for c in zip(*held[i])) if i in held else y for i, y in enumerate(books[k])]
    out = []
    for i, label, v in rows:
        best = [near(part(v, k), books[k]) for k in range(4)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    return out, books


def test_codes_against_brute_force(spark):
    random.seed(5)
    rows = [(i, random.choice([None, 1, 2]), [random.choice([-1.0, 0.25, 0.5, random.uniform(-2, 2)]) for _ in range(8)]) for i in range(300)]
    rows += [(7, 1, [0.5] * 8), (7, 1, [0.5] * 8), (999, 3, [float("inf")] * 8), (998, 3, None), (997, 3, [None] + [0.0] * 7), (996, 3, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    codes, books = vector_codes.vector_codes(df)
    whole = [(i, lab, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, lab, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want, want_books = brute_codes(sorted(whole, key=lambda r: (r[0], r[2])))
    assert sorted(map(repr, map(tuple, codes.collect()))) == sorted(map(repr, want)) and books.tolist() == [[list(y) for y in b] for b in want_books]
    told = {r["label"]: r["label_error"] for r in vector_codes.label_errors(codes).collect()}
    assert told == {lab: sum(r[3] for r in want if r[1] == lab) for lab in (None, 1, 2)}


def test_codes_awkward_rows(spark):
    kind = "vec_id long, label string, embedding array<double>, code string, error string, components int"
    rows = [(None, None, [0.1] * 6, "c", "e", 1), (1, "", [0.3] * 6, "c", "e", 1), (2, "x", [1e30] + [0.0] * 5, "c", "e", 1), (3, None, [1.0] * 4, "c", "e", 1), (4, "y", [], "c", "e", 1), (1, "", [0.3] * 6, "c", "e", 1)]
    codes, books = vector_codes.vector_codes(spark.createDataFrame(rows, kind))
    got = vector_codes.label_errors(codes).collect()
    assert len(got) == 6 and {r["vec_id"] for r in got if r["code"] is None} == {3, 4} and books.shape == (4, 3, 2)
    assert {r["label_error"] for r in got if r["vec_id"] == 1} == {0}
    for none in (spark.createDataFrame([], kind), spark.createDataFrame([(None, None, None, "", "", 0)], kind)):
        assert vector_codes.vector_codes(none)[0].count() == 0
    alone = vector_codes.label_errors(vector_codes.vector_codes(spark.createDataFrame(rows[:1], kind))[0]).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in alone] == [(None, None, None, None)]


def test_pivots_prune_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(2)
    centers = rng.integers(-5000, 5000, (64, 6))
    x = centers[rng.integers(0, 64, 3000)] + rng.integers(-40, 40, (3000, 6))
    book = np.concatenate([centers, centers[::-1]])
    pivots = vector_codes.choose_pivots(book)
    who, best, tried = vector_codes.nearest(x, np.sqrt(vector_codes.distances(x, pivots)), book, np.sqrt(vector_codes.distances(book, pivots)))
    exact = vector_codes.distances(x, book)
    assert (who == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all() and tried < 0.2 * exact.size


@pytest.mark.parametrize("merged", [4, 32])
def test_join_of_edited_texts(spark, merged, monkeypatch):
    """Texts of 3 to 600 words in groups around the threshold, with lists beyond the merged length."""
    monkeypatch.setattr(parity_join, "MERGED", merged)
    random.seed(merged)
    rows = []
    for n in (3, 5, 6, 8, 9, 10, 13, 16, 20, 33, 36, 64, 69, 130, 260, 600):
        base = [f"w{random.randrange(10**6)}" for _ in range(n)]
        for _ in range(14):
            w = list(base)
            for _ in range(random.randint(0, max(1, n // 20))):
                kind = random.random()
                w[random.randrange(len(w))] = f"z{random.randrange(99)}" if kind < 0.5 else w[0]
                w = w[:-1] if kind > 0.8 else w + [f"y{random.randrange(9)}"] if kind > 0.6 else w
            rows.append((len(rows), " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 80) and len({c for _, c in got.values()}) < len(rows) - 40


def test_join_awkward_rows(spark):
    docs = documents(spark)
    got = parity_join.jaccard_components(docs).collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None], 80)
    assert len(got) == docs.count() and all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None] and parity_join.jaccard_components(empty(spark)).count() == 0


def test_sketch_bounds_and_blocks(spark):
    """Hamming distance never passes the symmetric difference, and linked sets meet in a posted block."""
    rng = np.random.default_rng(8)
    rows = []
    for n in (4, 9, 31, 32, 63, 64, 127, 128, 255, 500, 1023, 1024, 5000):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.0, 0.05, 0.1, 0.2):
            fresh = rng.integers(0, 2**63, int(share * n), dtype=np.uint64)
            a, b = np.unique(base), np.unique(np.concatenate([base[len(fresh) // 2 :], fresh]))
            both = len(np.intersect1d(a, b))
            rows.append((parity_join.folded(a).tolist(), parity_join.folded(b).tolist(), len(a) + len(b) - 2 * both))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert set(parity_join.keys(a, 80).tolist()) & set(parity_join.keys(b, 80).tolist())
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, apart int")
    assert df.where(parity_join.hamming("a", "b") > df["apart"]).count() == 0 and df.where(parity_join.hamming("a", "b") < 0.5 * df["apart"]).count() == 0


def test_enough_blocks_in_use():
    """A set of any size has more blocks in use than its bound, so a whole prefix is posted."""
    rng = np.random.default_rng(9)
    for n in [*range(4, 300), 511, 512, 1000, 1023, 2047, 4095, 20_000]:
        found = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        band = len(found).bit_length() - 1
        t = parity_join.most_apart(n, 100 * n // 80, 80)
        assert len(parity_join.block_keys(found, band, t)) == t + 1
