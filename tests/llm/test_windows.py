"""Windows go to the compressor as one buffer, and only where what they save counts."""

from __future__ import annotations

import random

import numpy as np

from wheelmark.llm import toxicity


def test_windows_go_to_the_compressor_once_and_as_one_buffer(monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 9))) for _ in range(400)]
    make = lambda n: " ".join(rnd.choices(words, k=n)).encode()
    ordinary, toxic = make(3000), b"zyxwvu qwertz uvxyzk " * 20 + b"kzrtwq plmxzv " * 20
    rows = [b"", b"short", make(3), make(400) + b" zyxwvu qwertz uvxyzk " + make(50), make(2000), b"kzrtwq plmxzv kzrtwq plmx"]
    data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    scorer = toxicity.Scorer(ordinary, toxic)
    starts, ends, before = toxicity.windows(offsets)
    text = data.tobytes()
    one = lambda c, a, b: len(c.compress(toxicity.BEFORE + text[a:b] + toxicity.BEHIND))
    plain = np.array([one(scorer.light[0], a, b) - one(scorer.light[1], a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    assert (scorer.savings(text, starts, ends) == plain).all()
    deep = scorer.deep(data, text, starts, ends)
    assert (deep != 0).any()
    seen = []
    lengths = toxicity._lengths
    monkeypatch.setattr(toxicity, "_lengths", lambda c, x: seen.append((type(x), len(x))) or lengths(c, x))
    got = toxicity.counted(data, offsets, ordinary, toxic)
    row = np.repeat(np.arange(len(rows)), np.diff(before))
    want = [[(row == r).sum(), *[((row == r) & (deep >= k)).sum() for k in toxicity.SAVINGS], ((row == r) & (deep == 0) & (plain >= toxicity.PLAIN)).sum()] for r in range(len(rows))]
    assert got.tolist() == np.array(want).tolist()
    assert sum(n for _, n in seen) == 2 * (deep == 0).sum() and any(k is not list for k, _ in seen)
