"""Each operator against a brute-force version on a small table with all the odd cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

LOW = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG_LINE = "The same line of more than forty characters, Again"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = ["alpha", "Beta", "gämma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mü"]
    text = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 30)) for _ in range(n))
    base = text(120)
    near = base.split()
    near[60] = "changed"
    out = [(1, base), (2, base.upper()), (3, " ".join(near)), (4, None), (5, ""), (6, "  \n "), (7, "one two"), (8, "One  TWO"), (9, text(3000)), (9, text(5)), (10, base), (10, base)]
    out += [(20 + i, f"{text(20)}\n  {LONG_LINE if i % 2 else LONG_LINE.lower()} \n{text(5)}") for i in range(7)]
    out += [(None, base), (None, None), (40, "ab" * 5000 + " token: 'abcdef12' AKIA" + "Q7" * 10 + " " + "0a1b2c3d" * 4), (41, "key = d8Fk29xQz0Lm4Rt7Wv1Y api_key=short secret=\"0123456789abcdef01234567\"")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, id string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_decontaminate(spark, docs, rows, empty):
    from wheelmark.llm.decontam import clean, decontaminate

    items = [(1, " ".join(rows[0][1].split()[30:50])), (1, " ".join(rows[0][1].split()[30:50])), (2, "one TWO"), (3, None), (4, "?!"), (None, rows[9][1]), (5, "absent " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = {}
    for item, t in items:
        w = WORD.findall((t or "").translate(LOW))
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(item)
    expected = Counter()
    for _, t in rows:
        w, hit, found = WORD.findall((t or "").translate(LOW)), set(), set()
        for i in range(len(w)):
            for k in {len(x) for x in wins}:
                if own := wins.get(tuple(w[i : i + k])) if i + k <= len(w) else None:
                    hit |= set(range(i, i + k))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        expected[len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)] += 1
    for size in (16 << 20, 40):  # in one block and in several
        got = decontaminate(docs, bench, block_bytes=size)
        assert Counter(tuple(r)[1:6] for r in got.collect()) == expected
    for size in (40, 10**6):  # in several rounds
        assert Counter(tuple(r)[1:6] for r in decontaminate(docs, bench, block_bytes=40, round_bytes=size).collect()) == expected
    w = rows[0][1].split()
    short = decontaminate(docs, spark.createDataFrame([(7, "absent words " + " ".join(w[10:17]) + " more absent words and others too")], "item_id long, text string")).where("doc_id = 1").first()
    assert (short.n_hit, short.longest_words, short.longest_at, short.longest_item) == (0, 7, 10, "7")
    best = decontaminate(docs, bench).where("doc_id = 1").first()
    assert (best.longest_words, best.longest_at, best.longest_item) == (20, 30, "1")
    assert clean(docs, got).where("doc_id = 1").isEmpty()
    assert decontaminate(empty, bench).isEmpty() and not decontaminate(docs, bench.limit(0)).where("contaminated").count()


def test_suffix_arrays_against_sorting_and_brute_force():
    """Full depth, an item of 20,000 words within bounded memory, and words that polynomials would take for equal."""
    import tracemalloc

    from wheelmark.llm import decontam as d
    from wheelmark.llm.shared import ALNUM, token_hashes, tokens

    rnd = np.random.default_rng(2)
    for _ in range(30):
        words = rnd.integers(0, rnd.integers(2, 6), rnd.integers(1, 300)).astype(np.int32)
        tail = lambda p: tuple(words[p : p + (np.flatnonzero(np.append(words[p:], 0) == 0)[0])])  # noqa: B023, E731
        order = d.suffix_order(words).tolist()
        assert sorted(order) == np.flatnonzero(words > 0).tolist() and [tail(p) for p in order] == sorted(tail(p) for p in order)
    long = " ".join(f"w{i}" for i in rnd.integers(0, 400, 20_000))
    block = d.build_block([("a", long), ("b", "short item of words")], 10)
    text = ("x y " + long + " z " + " ".join(long.split()[5:4000])).encode() * 2
    data = np.frombuffer(text, np.uint8)
    starts, ends, rows = tokens(data, np.array([0, len(data)]), ALNUM)
    tracemalloc.start()
    found = d.search(d.ranks_of(data, starts, ends, token_hashes(data, starts, ends), block), rows, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and found.longest.max() == 20_000 and set(found.pairs[:, 1].tolist()) == {0}
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a  # Thue-Morse words
    data = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    starts, ends, _ = tokens(data, np.array([0, len(data)]), ALNUM)
    assert len(set(token_hashes(data, starts, ends).tolist())) == 2


@pytest.mark.parametrize("size", [32, 1])
def test_exact_dedup(docs, rows, empty, size):
    from wheelmark.llm.exact_dedup import LsmIndex, exact_dedup

    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOW), []).append(i)
    expected = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), i == keep, sha(t)] += 1
    assert Counter(map(tuple, exact_dedup(docs, digest_bytes=size).collect())) == expected
    if size == 32:  # several insertions; runs that are merged and runs that are not
        index = LsmIndex(docs.sparkSession, "largest").insert(docs.where("doc_id < 10")).compact().insert(docs.where("doc_id >= 10"))
        texts = {(t or "").translate(LOW) for i, t in rows if i is not None}
        keeps = {t: max(i for i, u in rows if i is not None and (u or "").translate(LOW) == t) for t in texts}
        asked = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate([*[t for _, t in rows], "never seen"])], "doc_id long, text string")
        for _ in range(2):
            assert {r.doc_id: r.known_id for r in index.known(asked).collect()} == {i: keeps.get((t or "").translate(LOW)) for i, t in enumerate([*[t for _, t in rows], "never seen"])}
            index.compact()
    assert exact_dedup(empty).isEmpty()


@pytest.mark.parametrize("most", [1 << 26, 0])
def test_line_dedup(docs, rows, empty, most):
    from wheelmark.llm.line_dedup import line_dedup

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(i)
    keeps = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= 5}
    expected = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in keeps or keeps[key(x)] == i]
        expected[i, len(lines), len(lines) - len(left), sha("\n".join(left))] += 1
    got = line_dedup(docs, most_bytes=most, texts=False)
    assert Counter(map(tuple, got.collect())) == expected
    assert line_dedup(empty, most_bytes=most).isEmpty()


def test_line_index_against_brute_force_over_many_changes(spark):
    from wheelmark.llm.line_dedup import LineIndex, key_hash, line_dedup, line_key

    rnd = random.Random(3)
    lines = [f"line number {i:03d} that has more than forty characters in it" for i in range(400)]
    docs = {i: "\n".join(rnd.sample(lines, 60)) for i in range(40)}
    table = lambda ids: spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string")
    index, held = LineIndex(spark), []
    index.insert(table(range(12)))
    held += range(12)
    # more keys turn common than a new filter has room for; then they go again
    for add, ids in ((True, range(12, 40)), (False, range(0, 30)), (True, range(5, 9)), (False, range(30, 36))):
        (index.insert if add else index.delete)(table(ids))
        held = held + list(ids) if add else [i for i in held if i not in ids]
        of = {}
        for i in held:
            for x in docs[i].split("\n"):
                of.setdefault(key_hash(line_key(x.encode())), []).append(i)
        assert {bytes(r.key): (r.docs, r.id) for r in index.references().collect()} == {k: (len(v), max(v)) for k, v in of.items()}
        common = [k for k, v in of.items() if len(v) >= 5]
        assert not common or index.passing()(common).all()
        rare = [key_hash(line_key(x.encode())) for x in lines if key_hash(line_key(x.encode())) not in common]
        assert not rare or index.passing()(rare).mean() < 0.1
    with pytest.raises(ValueError):
        index.delete(table([0]))
    got = {r.doc_id: r.kept_text for r in line_dedup(table(held), index=index).collect()}
    of = {}
    for i in held:
        for x in docs[i].split("\n"):
            of.setdefault(x, []).append(i)
    assert got == {i: "\n".join(x for x in docs[i].split("\n") if len(of[x]) < 5 or max(of[x]) == i) for i in held}


def test_cuckoo_filter():
    from wheelmark.llm.line_dedup import CuckooFilter

    keys = np.random.default_rng(1).integers(0, 2**63, (3000, 2)).astype(np.uint64)
    filter_ = CuckooFilter.load(CuckooFilter.of(keys[:2000]).dump())
    assert filter_.contains(keys[:2000]).all() and filter_.contains(keys[2000:]).mean() < 0.01
    assert all(filter_.delete(k) for k in keys[:1000])
    assert filter_.contains(keys[1000:2000]).all() and filter_.contains(keys[:1000]).mean() < 0.05


def test_secrets(spark, docs, rows, empty):
    rnd = random.Random(9)
    from wheelmark.llm.secret_scan import THRESHOLDS, char_class, entropy_spans, secrets, spoken, window_entropies

    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    expected = Counter()
    for i, t in rows:
        t = t or ""
        own = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        expected[i, *[sum(x[1] == k for x in own) for k in range(3)], sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(own)))] += 1
    got = secrets(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == expected
    assert any(r.n_entropy and "entropy:6:26" in r.spans for r in got if r.doc_id == 41)
    assert secrets(empty).isEmpty()
    text = "d8Fk29xQz0Lm4Rt7Wv1Yaaab"
    plain = [-sum(c / 20 * np.log2(c / 20) for c in Counter(text[i : i + 20]).values()) for i in range(5)]
    assert np.allclose(list(window_entropies(text, 20)), plain)
    assert entropy_spans("a" * 40, 20, {"hex": 3.0, "alnum": 3.7, "mixed": 3.9}) == []
    # random keys of letters or digits alone are found; what could be spoken isn't
    found = 0
    for _ in range(300):
        letters = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(31))
        found += spoken(letters)
    assert found <= 3
    assert not spoken("4026083977531332402612345") and not spoken("d8Fk29xQz0Lm4Rt7Wv1Y")
    assert all(map(spoken, ("internationalisation", "usr/share/doc/reader2", "someVeryLongMethodName", "a_fairly_long_snake_name", "International-Organisation")))
    # every span by brute force: the longest runs of characters under windows of enough entropy
    words = ["".join(rnd.choice(a) for _ in range(rnd.randint(20, 60))) for a in ("0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKL23456789", "ab", "abcXYZ019+/=") for _ in range(25)]
    texts = [" é ".join(rnd.sample(words, 5)) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets(table, allowed=(), allowed_shapes=()).collect():
        t, want = texts[r.doc_id], []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            if spoken(m[0]):
                continue
            under = set()
            for i in range(len(m[0]) - 19):
                bits = -sum(c / 20 * np.log2(c / 20) for c in Counter(m[0][i : i + 20]).values())
                if bits >= THRESHOLDS[char_class(m[0])] - 1e-9:
                    under |= set(range(i, i + 20))
            for i in sorted(under):
                if i - 1 not in under:
                    end = i
                    while end in under:
                        end += 1
                    want.append(f"entropy:{m.start() + i}:{m.start() + end}")
        assert [x for x in r.spans.split(",") if x.startswith("entropy")] == want


def test_warc_round_trip(spark):
    from wheelmark.llm import warc

    nasty = "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\nfiledesc://y 0 0 0 9\n"
    pages = spark.createDataFrame([(1, "http://a b/", nasty), (2, None, "same é"), (5, "u", "same é"), (3, "u", None), (4, "u", ""), (None, "u", "same é"), (7, "u", "z" * 300_000), (2, None, "same é")], "page_id long, url string, html string")
    got = warc.pages_as_warc(pages, archive_bytes=1000).collect()
    body = {1: nasty, 2: "same é", 5: "same é", None: "same é", 3: "", 4: "", 7: "z" * 300_000}
    first = {"same é": 2, "": 3, nasty: 1, "z" * 300_000: 7}
    expected = Counter()
    for i in [1, 2, 5, 3, 4, None, 7, 2]:
        b = body[i].encode()
        revisit = i != first[body[i]]
        expected[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first[body[i]] if revisit else None] += 1
    assert Counter(tuple(r)[:5] for r in got) == expected and all(r.intact for r in got)
    assert warc.pages_as_warc(pages.limit(0)).isEmpty()
    path = warc.shared_dir(spark, "test")
    warc.write_warc(warc.with_revisits(warc.convert(warc.pages_to_arc(pages, archive_bytes=1000))), path, 1000)
    back = warc.read_warcs(spark, path).collect()
    assert Counter(r.record_type for r in back) == {"response": 5, "revisit": 3, "warcinfo": sum(r.record_type == "warcinfo" for r in back)} and any(r.record_type == "warcinfo" for r in back)
    assert all(r.intact and (r.payload is None or r.record_type == "warcinfo" or bytes(r.payload).decode() == body[int(r.page_id)]) for r in back)
    for raw in warc.read_archives(spark, path).collect():  # members one by one, as other readers take them
        data, n = bytes(raw.archive), 0
        while data:
            one = zlib.decompressobj(31)
            n += one.decompress(data).startswith(b"WARC/1.1")
            data = one.unused_data
        assert n >= 1
    for version in (1, 2):
        data = warc.version_block(version, "n", "20200101000000") + warc.arc_record(version, "http://u/", "1.2.3.4", "20200101000000", 200, b"HTTP/1.0 200 OK\r\n\r\nhi\n", "n", 0)
        about, record = warc.read_arc(data)
        assert about["Version"] == str(version)
        assert [len(list(warc.read_arc(warc.unpacked(x)))) for x in (data, zlib.compress(data, wbits=31), warc.member(data[:60]) + warc.member(data[60:]) + warc.NOTHING)] == [2, 2, 2]
        assert record["URL"] == "http://u/" and record["block"].endswith(b"hi\n") and set(warc.FIELDS[version]) < set(record)
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-5]))


@pytest.fixture(scope="module")
def ranks(spark):
    from wheelmark.llm.bpe import read_ranks
    from wheelmark.llm.queries import vocabulary

    return read_ranks(spark, vocabulary())


def test_bpe_is_what_tiktoken_gives(spark, docs, rows, ranks, empty):
    import public_tokenizers
    import tiktoken

    from wheelmark.llm import bpe, token_counts

    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(5)
    alphabet = list(" '  \n\t　abstrevlmd'019-_!?éñ漢字²Ⅷ́😀\r\x1c")
    odd = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(3000)] + ["aaaa" * 5000, "it's we'll 's'st 'res", "<|endoftext|>"]
    own = bpe.Codec(ranks)
    assert [list(map(int, x.split())) for x in own.encode(odd)] == [tik.encode_ordinary(x) for x in odd]
    coded = bpe.encode(docs, ranks)
    expected = Counter()
    for i, t in rows:
        ids = tik.encode_ordinary(t or "")
        expected[i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded.collect()) == expected
    assert {(r.doc_id, r.text) for r in bpe.decode(coded, ranks).collect()} == {(i, t or "") for i, t in rows}
    assert bpe.encode(empty, ranks).isEmpty()
    lengths = sorted(len(tik.encode_ordinary(t or "")) for _, t in rows)
    hist = token_counts.histogram(token_counts.lengths(docs, ranks))
    for r in hist.collect():
        m = r.n_tokens
        assert tuple(r) == (m, lengths.count(m), sum(n < m for n in lengths), sum(n for n in lengths if n < m), sum(n >= m for n in lengths), sum(n for n in lengths if n >= m), sum(min(n, m) for n in lengths), sum(n <= m for n in lengths) / len(lengths))
    assert {r.n_tokens for r in hist.collect()} == set(lengths)
    limits = spark.createDataFrame([(0,), (7,), (130,), (10**6,)], "context_limit long")
    assert {tuple(r) for r in token_counts.truncated_totals(hist, limits).collect()} == {(c, len(lengths), sum(lengths), sum(min(n, c) for n in lengths), sum(n > c for n in lengths), sum(max(n - c, 0) for n in lengths)) for c in (0, 7, 130, 10**6)}
    assert token_counts.quantile(hist, 0.5).first()[0] == lengths[(len(lengths) + 1) // 2 - 1]


def test_near_duplicates(spark, docs, rows, empty):
    from wheelmark.llm.minhash import near_duplicates

    def shingles(t, size):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [shingles(t, 4) for _, t in rows]
    part = list(range(len(rows)))
    for _ in rows:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    part[a] = part[b] = min(part[a], part[b])
    least = {p: min((rows[k][0] for k in range(len(rows)) if part[k] == p and rows[k][0] is not None), default=None) for p in part}
    expected = Counter((i, len(sets[k]), least[part[k]], i == least[part[k]]) for k, (i, _) in enumerate(rows))
    # null ids, and rows that share an id, with the same text or another one, are among them
    for block in (4, 600):
        assert Counter(map(tuple, near_duplicates(docs, size=4, block=block).collect())) == expected
    assert near_duplicates(empty).isEmpty()


def test_components_of_a_long_chain(spark):
    from wheelmark.llm.minhash import components

    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {i: 1 for i in range(1, 41)} | {90: 90, 95: 90, 100: 90}


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "river", "of", "light", "moves", "over", "quiet", "stone", "and", "field"]) + rnd.choice(["", "s", "ing"]) for _ in range(n))


def test_quality_keeps_good_and_drops_junk(spark, empty):
    from wheelmark.llm.quality import kth_largest, resample

    rnd = random.Random(2)
    good = [(i, prose(rnd, 80)) for i in range(160)]
    junk = [(1000 + i, " ".join(w + "!!" for w in prose(rnd, 60).upper().split()) if i % 2 else " ".join([rnd.choice(["buy", "win"])] * 60)) for i in range(40)]
    docs = spark.createDataFrame([*good, *junk, (5000, None), (5001, ""), (None, prose(rnd, 50))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:80]] + [(i, 0) for i, _ in junk[:20]] + [(None, 1), (7, None)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in resample(docs, labels).collect()}
    assert sum(kept[i] for i, _ in good) >= 157 and sum(kept[i] for i, _ in junk) <= 1 and kept[5000] and kept[5001]
    assert all(r.kept for r in resample(docs, labels.where("quality = 1")).collect())
    assert sum(r.kept for r in resample(docs, labels, k=50).where("n_ngrams > 0").collect()) == 50
    assert resample(empty, labels).isEmpty()
    values = [rnd.gauss(0, 5) for _ in range(500)] + [3.25] * 20
    table = spark.createDataFrame([(v,) for v in values], "x double")
    assert all(kth_largest(table, "x", k, near=10) == sorted(values, reverse=True)[k - 1] for k in (1, 7, 100, 519, 520))


def test_draws_by_weight(spark):
    """Rates of inclusion over many seeds against a draw without replacement, one after the other, by weight."""
    from wheelmark.llm import quality

    weights, k, seeds = np.array([0.0, 0.5, 1.0, 1.5, 2.5, -1.0]), 3, 6000
    keys = np.array([[quality.gumbel(s, i) for i in range(len(weights))] for s in range(seeds)])
    rates = np.bincount(np.argsort(-(keys + weights), axis=1)[:, :k].ravel(), minlength=len(weights)) / seeds
    rnd = np.random.default_rng(1)
    drawn = [rnd.choice(len(weights), k, replace=False, p=np.exp(weights) / np.exp(weights).sum()) for _ in range(seeds)]
    assert np.abs(rates - np.bincount(np.concatenate(drawn), minlength=len(weights)) / seeds).max() < 0.03
    # the operator draws by that noise and the plain log weights
    words = random.Random(7)
    docs = [(i, prose(words, words.randint(1, 12))) for i in range(80)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    for seed in (1, 2):
        got = quality.resample(table, labels, k=25, seed=seed).collect()
        best = sorted(got, key=lambda r: -(r.log_weight + quality.gumbel(seed, r.doc_id)))[:25]
        assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in best}
    report = {r.label: (r.n, r.n_kept) for r in quality.draw_report(quality.resample(table, labels, k=25), labels).collect()}
    assert sum(n for n, _ in report.values()) == 80 and sum(n for _, n in report.values()) == 25 and report[1][0] == 40


def test_toxicity_on_rows_it_did_not_learn_from(spark, empty):
    from wheelmark.llm import toxicity

    rnd = random.Random(4)
    docs, labels = [], []
    for i in range(500):
        words, toxic = prose(rnd, 60).split(), int(i % 5 == 0)
        for _ in range(4 * toxic):
            words.insert(rnd.randrange(60), rnd.choice(["grubnak", "vortle", "snazgul", "plimfex"]))
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    table = spark.createDataFrame([*docs, (9000, None), (9001, ""), (None, "vortle grubnak snazgul " * 5)], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (9000, None)], "doc_id long, toxic int")
    scored = toxicity.score(table, toxicity.fit(toxicity.training_rows(table, marks))).collect()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    truth = dict(labels)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    none = toxicity.fit(toxicity.training_rows(table, marks.where("toxic = 0")))
    assert len({r.score for r in toxicity.score(table, none).collect()}) == 1
    assert toxicity.score(empty, none).isEmpty()


@pytest.mark.parametrize("kind", ["suffix", "phrase", "run"])
def test_toxicity_behind_the_first_bytes_and_across_words(spark, kind):
    from wheelmark.llm import toxicity

    rnd = random.Random(8)
    letters = [chr(c) for c in range(0x4E00, 0x4E80)]
    docs, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        words = prose(rnd, 50).split()
        for _ in range(5):
            # both classes have the same first 6 bytes, the same words, or one unbroken run
            own = {"suffix": ["container", "containgrub"], "phrase": ["green pale up dogs", "pale dogs up green"], "run": ["".join(rnd.choices(letters, k=5) + ["\u5001\u5002\u5003"] + rnd.choices(letters, k=4)), "".join(rnd.choices(letters, k=5) + ["\u5003\u5001\u5002"] + rnd.choices(letters, k=4))]}[kind][toxic]
            words.insert(rnd.randrange(20), own)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    table, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [r for r in toxicity.score(table, toxicity.fit(toxicity.training_rows(table, marks))).collect() if r.held_out]
    assert sum(r.predicted == dict(labels)[r.doc_id] for r in held) >= 0.97 * len(held)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Ids that repeat (with the same text and with others), null ids and null texts; the quality stage keeps all of them."""
    import corpus_pipeline

    rnd = random.Random(6)
    base = [prose(rnd, 90) for _ in range(12)]
    item = "unique benchmark sentence with exactly twelve words in it for this test"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(9, base[1] + " and another end"), (9, prose(rnd, 30)), (3, base[3]), (20, base[2].upper()), (20, prose(rnd, 50)), (21, prose(rnd, 20) + " " + item), (21, prose(rnd, 25)), (None, base[4]), (None, prose(rnd, 33)), (None, None), (30, ""), (31, None), (32, base[5] + " tail")]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    left = [(i, (t or "").translate(LOW)) for i, t in rows]
    big = lambda i: -1 if i is None else i
    left = [(i, t) for i, t in left if big(i) == max(big(j) for j, u in left if u == t)]

    def grams(t):
        w = t.split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [grams(t) for _, t in left]
    part = list(range(len(left)))
    for _ in left:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and 100 * len(x & y) >= 80 * len(x | y):
                    part[a] = part[b] = min(part[a], part[b])
    small = lambda i: float("inf") if i is None else i
    left = [(i, t) for k, (i, t) in enumerate(left) if small(i) == min(small(left[j][0]) for j in range(len(left)) if part[j] == part[k])]
    left = [(i, t) for i, t in left if item not in t]
    got = Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect())
    texts = {sha(t or ""): (t or "").translate(LOW) for _, t in rows}
    assert Counter((i, texts[h]) for i, h in got.elements()) == Counter(left)
    # beyond a broadcast's size the same rows go
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, corpus_pipeline.ROW_BYTES = corpus_pipeline.ROW_BYTES, 1 << 40
    try:
        far = Counter((r.doc_id, r.text) for r in corpus_pipeline.without_copies(spark, docs, sf).collect())
    finally:
        corpus_pipeline.ROW_BYTES = before
    assert far == Counter((r.doc_id, r.text) for r in corpus_pipeline.without_copies(spark, docs, sf).collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    base = [(i, prose(rnd, 90)) for i in range(60)]
    item = "unique benchmark sentence with exactly twelve words in it for this test"
    rows = [*base, (100, base[0][1].title()), (101, base[1][1] + " tail"), (102, prose(rnd, 40) + " " + item + " " + prose(rnd, 40)), *[(200 + i, "!! ".join(prose(rnd, 40).upper().split())) for i in range(15)], (300, None)]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(40)] + [(200 + i, 0) for i in range(8)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}
    # junk, the smaller of two copies, the larger of two near copies and the contaminated document go
    assert got == {i for i in range(60) if i != 0} | {100, 300}


def test_joins_beyond_a_broadcast(spark, monkeypatch):
    """Hot keys, rare facts and filters that are too small for their keys give what a plain join gives."""
    from wheelmark.llm import shared, warc

    rows = spark.createDataFrame([(k, i) for k in range(40) for i in range(3 if k else 900)] + [(None, 1)], "k long, i long").repartition(5)
    facts = rows.where("k % 3 = 0").groupBy("k").count().selectExpr("k", "count AS n", "named_struct('a', k, 'b', 'x') AS s")
    plain = sorted(map(repr, rows.join(facts, "k", "left").select("k", "i", "n", "s").collect()))
    assert sorted(map(repr, shared.join_hot(rows, facts, "k", "n").select("k", "i", "n", "s").collect())) == plain
    pages = spark.createDataFrame([(i, "u", "same" if i % 3 else f"page {i}") for i in range(30)], "page_id long, url string, html string")
    fields = ("page_id", "record_type", "refers_to")
    near = sorted(map(repr, warc.pages_as_warc(pages).select(*fields).collect()))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 64)
    assert sorted(map(repr, shared.join_rare(rows, facts, "k", "n", 40).select("k", "i", "n", "s").collect())) == plain
    assert sorted(map(repr, warc.pages_as_warc(pages).select(*fields).collect())) == near
    test = shared.filter_over(spark.range(5000).selectExpr("xxhash64(id) AS h"))
    assert test(np.array([r.h for r in spark.range(5000).selectExpr("xxhash64(id) AS h").collect()], np.int64)).all()
