"""Spelling variants and whitening against brute force, with the odd cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from wheelmark.llm import spelling, whitening

LOW = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_in_a_trie():
    rnd = random.Random(3)
    words = sorted({bytes(rnd.choice(b"abc\xe9") for _ in range(rnd.randint(0, 6))) for _ in range(600)})
    shard = spelling.Shard(spelling.trie(words, np.arange(len(words))))
    for w in [*words, b"abcabcz", b"zzz"]:
        assert sorted(shard.near(w)) == [i for i, x in enumerate(words) if near(w, x)]
    assert [shard.word(i).encode("latin-1") for i in range(len(words))] == words
    long = b"x" * 50_000
    shard = spelling.Shard(spelling.trie([b"foo", long, long + b"a"], np.arange(3)))
    assert shard.near(long) == [2] and shard.near(b"foo") == [] and spelling.Shard(spelling.trie([], np.arange(0))).near(b"a") == []


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    base = ["straße", "wonderful", "colour", "color", "naïveté", "abcdef", "abcdeg", "aaaaaa", "aaaaaaa", "×××÷÷÷", "longword" * 9]
    out = []
    for i in range(300):
        words = [w if rnd.random() > 0.15 else w[: (k := rnd.randrange(len(w)))] + rnd.choice("abé") + w[k + rnd.randint(0, 1) :] for w in rnd.choices(base, k=30)]
        out.append((rnd.choice([i, i, None]), " ".join(x.upper() if rnd.random() < 0.1 else x for x in words) + rnd.choice(["", "-tail", "1colour2"])))
    return [*out, (7, None), (8, ""), (9, "ab cd"), (10, out[0][1]), (10, out[0][1]), (11, "y" * 30_000)]


@pytest.mark.parametrize("shard_words, block", [(50_000, 32 << 20), (7, 900)])
def test_spelling(spark, texts, monkeypatch, shard_words, block):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(spelling, "BLOCK_BYTES", block)
    monkeypatch.setattr(spelling, "HELD_WORDS", 40)
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in texts], "doc_id long, text string, word string, n int").repartition(3)
    counts = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 5 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    want = {}
    for w in n:
        found = [x for x in n if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 5 * n[w] else None
        want[w] = (form, n[w], len(found), n[form] if form else None)
    roots = {}
    for w in n:
        at = w
        while want[at][0]:
            at = want[at][0]
        roots[w] = at
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in spelling.variants(spelling.count_words(docs, damage=5)).collect()}
    assert got == {w: (*want[w], roots[w]) for w in n} and sum(v[0] is not None for v in want.values()) > 5
    assert spelling.variants(spelling.count_words(docs.limit(0))).isEmpty()


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(9)], "word string, form string")
    assert {r.root for r in spelling.roots(forms, 5**10, 5).collect()} == {"w9"}


def test_limbs_and_digits_are_exact():
    rng = random.Random(1)
    for bits in (10, 30, 61, 100):
        y = np.array([[rng.randrange(-(2**bits) + 1, 2**bits) for _ in range(5)] for _ in range(50)], object)
        given = y.astype(np.int64) if bits < 62 else y
        assert (whitening.gram(iter([given[:20], given[20:]]), 5, bits) == y.T @ y).all()
        values = (y.T @ y).ravel()
        parts = whitening.digits(values, -(-(2 * bits + 8) // 32))
        assert [sum(int(p[i]) << (32 * k) for k, p in enumerate(parts)) for i in range(25)] == values.tolist()


def brute(rows):
    kept = [(i, [int(min(max(np.floor(256 * np.float64(c)), -(2.0**63)), 2.0**63 - 1024)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    return kept, sorted({tuple(x) for _, x in kept})


@pytest.mark.parametrize("offset, rows_in_a_product", [(0.0, 1 << 13), (1e7, 3)])
def test_whitening(spark, monkeypatch, offset, rows_in_a_product):
    monkeypatch.setattr(whitening, "ROWS", rows_in_a_product)
    monkeypatch.setattr(whitening, "ADDED", 2)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 6)) * [3, 1, 0.5, 0.2, 0.1, 0] + offset
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(5, rows[0][1]), (None, rows[1][1]), (70, None), (71, []), (72, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (73, [float("nan")] * 6), (74, [float("inf")] * 6), (75, [1.0, 2.0])]
    rows += [(100 + k, rows[2][1]) for k in range(40)]  # a vector that many rows share
    vectors = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, x double").repartition(4)
    kept, distinct = brute([r for r in rows if r[1] and len(r[1]) == 6])
    u, n = np.array(distinct, object), len(distinct)
    sums = u.sum(axis=0)
    y = (u * n - sums).astype(np.float64)
    values, components = np.linalg.eigh(y.T @ y / n**3)
    got = whitening.whiten(vectors).collect()
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    want = Counter((i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))) for i, x in kept)
    for k in range(1, 5):
        own = [r for r in got if r.component == k]
        assert Counter((r.vec_id, r.deviation) for r in own) == want
        assert own[0].explained == pytest.approx(values[-k] / values.sum(), rel=1e-9)
        by_id = {(i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))): (np.array(x, object) * n - sums).astype(float) / n @ components[:, -k] / np.sqrt(values[-k]) for i, x in kept}
        sign = np.sign(sum(by_id[r.vec_id, r.deviation] * r.whitened for r in own))
        assert all(r.whitened == pytest.approx(sign * by_id[r.vec_id, r.deviation], abs=1e-6) for r in own)


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<float>"
    make = lambda *v: spark.createDataFrame([(k, list(x)) for k, x in enumerate(v)], kind)
    assert whitening.whiten(make().limit(0)).isEmpty() and whitening.whiten(make((1.0, 2.0), (1.0, 2.0))).isEmpty()
    got = whitening.whiten(make((1.0, 2.0), (-3e38, 2.0), (1.0, 3.0))).collect()
    assert {r.component for r in got} == {1} and any(r.deviation is None for r in got) and got[0].identity_error < 1e-9


def test_near_ties_of_eigenvalues_are_told_apart():
    products = np.array([[10**18 + 3, 0, 1], [0, 10**18, 2], [1, 2, 10**18 - 7]], object)
    vectors, values = whitening.components(products, 1, 3)
    exact = (products - 10**18 * np.eye(3, dtype=object).astype(int)).astype(float)
    want = np.linalg.eigh(exact)[1][:, ::-1]
    assert np.allclose(np.abs((want * vectors).sum(axis=0)), 1, atol=1e-9) or values[0] == pytest.approx(1e18)
