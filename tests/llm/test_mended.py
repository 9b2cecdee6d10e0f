"""Faults that were mended: time on long tokens, bytes of caches, clashing names."""

import random
import re
import time

from wheelmark.llm import bpe, secret_scan


def test_word_shapes_in_linear_time():
    slow = re.compile(r"[-_/]*([A-Za-z]+[0-9]{0,4}[-_/]*)+")  # what the shape says; short strings only
    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice(["a", "E", "7", "12345", "-", "_", "/", "=", "+"]) for _ in range(rnd.randint(1, 7)))
        own = not secret_scan.NO_GROUPS.search(text) and any(c.isalpha() for c in text)
        assert own == bool(slow.fullmatch(text)), text
    began = time.time()
    for text in ("a" * 10_000 + "=", "aB" * 5_000 + "12345", "max_connections_" * 500 + "=2", "ab1-" * 3000 + "+"):
        secret_scan.spoken(text)
    assert time.time() - began < 0.1


def test_secrets_of_long_tokens(spark):
    rows = [(1, "x" * 40 + "="), (2, "maximum_connections_per_host=2 " * 50), (3, "YWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo9PQ=="), (4, "k" * 200_000 + "12345")]
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 4 and time.time() - began < 30 and got[1].n_entropy == 0 and got[3].n_entropy == 1


def test_cache_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    codec = bpe.Codec({bytes([b]): b for b in range(256)})
    rnd = random.Random(4)
    for turn in range(30):
        texts = [" ".join("".join(rnd.choices("abcdef", k=n)) for n in (3, 5, 900, 4)) for _ in range(8)]
        want = [" ".join(str(b) for b in t.encode()) for t in texts]
        assert [x.strip() for x in codec.encode(texts)] == want
        assert all(len(p) <= bpe.CACHE_CHARS for p in [*codec.young, *codec.old]) and len(codec.young) <= 50 and len(codec.old) <= 50, turn


def test_pipeline_with_clashing_columns_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    prose = lambda n: " ".join(rnd.choice("river stone green the walked slowly home under trees".split()) + str(rnd.randint(0, 40)) for _ in range(n))
    texts = [prose(60) for _ in range(8)]
    extra = ["row_key_0", "ROW_KEY_1", "_row_key_1", "row_key_4", "kept", "_text_hash_1", "doc_id_gone", "score", "with blank", "n_words", "id"]
    rows = [(i, t, "en", "s", 1, *[k * 10 + i for k in range(len(extra))]) for i, t in [*enumerate(texts), (90, texts[0]), (91, "")]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in extra)
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "some benchmark item of no importance to anybody at all here now")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for size in (corpus_pipeline.ROW_BYTES, 1 << 40):
        before, corpus_pipeline.ROW_BYTES = corpus_pipeline.ROW_BYTES, size
        try:
            left = docs
            for _, stage in corpus_pipeline.STAGES[:-1]:
                left = stage(spark, left, sf)
                assert left.columns == docs.columns
            got = {tuple(r) for r in left.collect()}
        finally:
            corpus_pipeline.ROW_BYTES = before
        assert got == {r for r in rows if r[0] != 0}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).isEmpty()


def test_every_window_is_compressed_with_both_dictionaries(spark):
    """The score of each document against one that goes over its windows one by one, on text and on noise."""
    import numpy as np
    import zstandard

    from wheelmark.llm import toxicity

    rnd = random.Random(8)
    letters, bad = "abcdefghijklmnop", ["grubbul", "snarkle", "vilefen"]
    docs, labels = [], []
    for i in range(240):
        words = ["".join(rnd.choices(letters, k=rnd.randint(3, 7))) for _ in range(40)]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(4):
                words.insert(rnd.randrange(30), rnd.choice(bad))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    labels += [(1, 1), (1, 0), (500, 1), (None, 1), (2, None), (3, 7)]  # contradictory, unknown and unusable labels
    docs += [(300, None), (301, ""), (302, "x"), (303, docs[4][1]), (303, docs[4][1]), (304, docs[0][1].upper())]
    table = spark.createDataFrame([(i, t, "clash", 0.5) for i, t in docs], "doc_id long, text string, toxic string, score double")
    model = toxicity.fit(toxicity.training_rows(table, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert model.toxic
    make = lambda x, level, shared: toxicity._compressor(x, level, shared)
    ends = (model.ordinary + toxicity.BEFORE, model.ordinary + model.toxic + toxicity.BEFORE)
    light, deep = [make(x, toxicity.LIGHT, True) for x in ends], [make(x, toxicity.LEVEL, False) for x in ends]
    pieces = lambda x: {x[k : k + 6] for k in range(len(x) - 5)}
    telling = pieces(model.toxic) - pieces(model.ordinary)

    def row(text):
        raw = (text or "").encode().lower()
        counts = [0] * toxicity.COUNTS
        starts = range(0, max(len(raw) - toxicity.WIDTH, 0) + toxicity.STRIDE, toxicity.STRIDE) if raw else []
        for a in starts:
            if a and a >= len(raw) - toxicity.WIDTH + toxicity.STRIDE:
                break
            w = raw[a : a + toxicity.WIDTH]
            saved = lambda pair: len(pair[0].compress(toxicity.BEFORE + w + toxicity.BEHIND)) - len(pair[1].compress(toxicity.BEFORE + w + toxicity.BEHIND))  # noqa: B023, E731
            counts[0] += 1
            strong = saved(deep) if pieces(w) & telling else 0
            for k, least in enumerate(toxicity.SAVINGS):
                counts[1 + k] += strong >= least
            counts[-1] += strong == 0 and saved(light) >= toxicity.PLAIN
        return counts

    want = toxicity.logistic(toxicity.inputs(np.array([row(t) for _, t in docs])), model.weights)
    got: dict = {}
    for r in toxicity.score(table, model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    for (i, _), score in zip(docs, want, strict=True):
        assert min(abs(x - score) for x in got[i]) < 1e-9
    assert got[303][0] == got[303][1] and toxicity.score(table.limit(0), model).isEmpty()
    # noise and binary: the same lengths by one call as one by one
    own = toxicity.Scorer(model.ordinary, model.toxic)
    text = bytes(rnd.randrange(256) for _ in range(4000)) + model.toxic[:300] + model.ordinary[-300:]
    at = np.array([rnd.randrange(len(text) - 24) for _ in range(1500)])
    assert own.savings(text, at, at + 24).tolist() == [len(light[0].compress(toxicity.BEFORE + text[a : a + 24] + toxicity.BEHIND)) - len(light[1].compress(toxicity.BEFORE + text[a : a + 24] + toxicity.BEHIND)) for a in at.tolist()]
    assert zstandard.__version__


def test_grids_of_near_duplicates_lose_no_link(spark, monkeypatch):
    """Groups with one large component and others beside it, in blocks of every size: the same components as brute force."""
    from wheelmark.llm import minhash

    monkeypatch.setattr(minhash, "SMALL_BLOCK", 2)
    monkeypatch.setattr(minhash, "MANY_BLOCKS", 3)
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(40)]
    texts = []
    for group in range(3):
        own = [f"g{group}{w}" for w in base]
        for _ in range(14):
            words = list(own)
            for at in rnd.sample(range(40), rnd.choice([1, 1, 2, 3])):
                words[at] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = list(enumerate(texts))
    sets = [{tuple(t.split()[k : k + 4]) for k in range(37)} for t in texts]
    part = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                if 100 * len(x & y) >= 80 * len(x | y):
                    part[i] = part[j] = min(part[i], part[j])
    table = spark.createDataFrame(docs, "doc_id long, text string")
    # Two bands of two rows give groups whose members the first class does not join: the grids have to find those links.
    full = minhash.near_duplicates(table, size=4, least=0.8)
    assert {r.doc_id: r.component_id for r in full.collect()} == dict(enumerate(part)) and len(set(part)) > 5
    stars = spark.createDataFrame([(0, j) for j in range(1, 14)], "a long, b long")
    marked = [(i, sorted(hash(g) & (2**63 - 1) for g in s)) for i, s in enumerate(sets)]
    nodes = spark.createDataFrame([(i, b"".join(v.to_bytes(8, "little") for v in sorted(set(x)))) for i, x in marked], "node long, set binary")
    want = {(i, j) for i in range(1, 14) for j in range(i + 1, 14) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    for big in ([], [3, 5, 6, 7, 9, 11]):  # nothing found yet, or one large component already
        found = spark.createDataFrame([(k, 3) for k in big] or [(99, 99)], "id long, component long")
        for block in (1, 3, 600):
            links = {(r.a, r.b) for r in minhash._leftover(stars, nodes, found, 0.8, block).collect()}
            root = {k: 3 if k in big else k for k in range(1, 14)}
            for edges in (links, want):
                own = dict(root)
                for _ in range(14):
                    for x, y in edges:
                        low = min(own[x], own[y])
                        own = {k: low if v in (own[x], own[y]) else v for k, v in own.items()}
                if edges is links:
                    got = own
            assert got == own and links <= want, block


def test_grams_of_few_documents_are_picked_before_they_are_sorted(monkeypatch):
    """Codes of no interest are ruled out first; what is left is each document's own, once."""
    import numpy as np
    import pyarrow as pa

    from wheelmark.llm import toxicity

    texts = ["some vile words here, vile words", "some words", "", "vile words and more words", "n\u00e4r vile"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    every = list(toxicity.grams_by_document([batch]))
    wanted = np.unique(np.concatenate(every))[::3]
    sizes = []
    real = toxicity.mixed
    monkeypatch.setattr(toxicity, "mixed", lambda x: sizes.append(len(x)) or real(x))
    own = list(toxicity.grams_by_document([batch], wanted))
    assert [sorted(x) for x in own] == [sorted(x[np.isin(x, wanted)]) for x in every] and min(sizes) < 40
    codes = np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64)
    some = np.sort(codes[::7])
    assert toxicity.among(codes, some).tolist() == np.flatnonzero(np.isin(codes, some)).tolist()
    assert toxicity.among(codes, some[:0]).tolist() == []
