"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte pieces. The neighbouring pairs that may merge wait in buckets, one per merge
rank; a bitmap of three levels of 64-bit words tells which buckets are filled, so that find-first-set on three words
gives the lowest rank. A bucket yields its leftmost position; an entry whose pair has changed since is stale and is
skipped. A pre-token of n bytes takes O(n log n) whatever its length.

Cases: null and empty texts have no tokens (the hash of no ids is that of the empty string); all other texts, ties and
repeated rows are encoded each by itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wheelmark.llm.shared import chunks, field, picked, utf8

#: Entries of each of the two generations of a Python worker's cache, and the longest pre-token (in characters) there.
CACHE_ENTRIES, CACHE_CHARS = 100_000, 64
#: Pre-tokens above so many bytes have a queue of their own; so many of the others share one.
LONG_BYTES, MERGED_TOGETHER = 64, 60_000
#: Text bytes whose pre-tokens are looked up together.
BATCH_BYTES = 2 << 20
#: A vocabulary above this size is refused: it is broadcast.
MOST_RANKS = 2_000_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The merge ranks of a .tiktoken file: a base64 token and its rank in each line."""
    local = path if "://" in path else f"file://{path}"
    lines = spark.read.text(local).limit(MOST_RANKS + 1).collect()
    if len(lines) > MOST_RANKS:
        raise ValueError(f"more than {MOST_RANKS} ranks in {path}")
    return {base64.b64decode(token): int(rank) for token, rank in (x.value.split() for x in lines if x.value.strip())}


class RankQueue:
    """Buckets of positions by rank (below 64 ** 3) under a bitmap of three levels; empty again after each pre-token.

    A bucket is one position, or a heap of several. ``low`` has a bit for each rank, ``mid`` one for each word of
    ``low`` and ``top`` one for each word of ``mid``.
    """

    __slots__ = ("buckets", "low", "mid", "ranks")

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.buckets: dict[int, int | list[int]] = {}
        self.low = [0] * 4096
        self.mid = [0] * 64

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        get = self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wait: list[int | None] = [get(piece[i : i + 2]) for i in range(n - 1)]  # the rank that the pair beginning here has now
        wait.append(None)
        buckets, low, mid, top = self.buckets, self.low, self.mid, 0
        fresh = [(rank, i) for i, rank in enumerate(wait) if rank is not None]
        while True:
            for rank, i in fresh:  # push
                if rank in buckets:
                    held = buckets[rank]
                    if type(held) is int:
                        buckets[rank] = [held, i] if held < i else [i, held]
                    else:
                        heapq.heappush(held, i)
                else:
                    buckets[rank] = i
                    word = rank >> 6
                    low[word] |= 1 << (rank & 63)
                    mid[word >> 6] |= 1 << (word & 63)
                    top |= 1 << (word >> 6)
            while top:  # pop until an entry is not stale
                group = (top & -top).bit_length() - 1
                m = mid[group]
                word = (group << 6) + (m & -m).bit_length() - 1
                w = low[word]
                rank = (word << 6) + (w & -w).bit_length() - 1
                held = buckets[rank]
                if type(held) is int:
                    i = held
                else:
                    i = heapq.heappop(held)
                if type(held) is int or not held:
                    del buckets[rank]
                    w &= w - 1
                    low[word] = w
                    if not w:
                        m &= m - 1
                        mid[group] = m
                        if not m:
                            top &= top - 1
                if wait[i] == rank:
                    break
            else:
                break
            j = after[i]
            joined = parts[i] + parts[j]
            parts[i], parts[j], wait[j] = joined, None, None
            after[i] = k = after[j]
            fresh = []
            if k < n:
                before[k] = i
                wait[i] = rank = get(joined + parts[k])
                if rank is not None:
                    fresh.append((rank, i))
            else:
                wait[i] = None
            if (h := before[i]) >= 0:
                wait[h] = rank = get(parts[h] + joined)
                if rank is not None:
                    fresh.append((rank, h))
        ranks = self.ranks
        return [ranks[x] for x in parts if x is not None]


class SharedQueue:
    """The same queue over many short pre-tokens at a time, whose linked lists lie one behind the other.

    Pre-tokens do not touch each other, so a bucket's positions are merged together as NumPy arrays, the leftmost of
    each pre-token first; the others wait in the bucket while find-first-set goes to any lower rank that came up.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = [(ranks[t[:i]] << 18 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pair_rank = dict(pairs)
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] + [1 << 62], np.int64)
        self.values = np.array([r for _, r in pairs] + [-1], np.int64)
        of = self.lookup(np.repeat(self.single, 256), np.tile(self.single, 256))
        self.first = of.astype(np.int32)
        self.low, self.mid, self.top, self.buckets = [0] * 4096, [0] * 64, 0, {}

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 18 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def _push(self, rank: int, entry) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(entry)
            return
        self.buckets[rank] = [entry]
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def _push_all(self, ranks: np.ndarray, at: np.ndarray) -> None:
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begin = [0, *cut.tolist()]
        for a, b, rank in zip(begin, [*begin[1:], len(at)], ranks[begin].tolist(), strict=True):
            self._push(rank, at[a:b] if b - a > 1 else int(at[a]))

    def _pop(self) -> tuple[int, list]:
        group = (self.top & -self.top).bit_length() - 1
        m = self.mid[group]
        word = (group << 6) + (m & -m).bit_length() - 1
        w = self.low[word]
        rank = (word << 6) + (w & -w).bit_length() - 1
        self.low[word] = w = w & (w - 1)
        if not w:
            self.mid[group] = m = m & (m - 1)
            if not m:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each of the pre-tokens, none of them empty."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        sizes = np.array([len(x) for x in pieces], np.int64)
        ends = np.cumsum(sizes)
        ids = self.single[data]
        of = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        wait = np.full(n, -1, np.int64)
        wait[:-1] = self.first[data[:-1].astype(np.int32) * 256 + data[1:]]
        wait[ends - 1] = -1
        at = np.flatnonzero(wait >= 0)
        self._push_all(wait[at], at)
        pair_rank = self.pair_rank.get
        while self.top:
            rank, held = self._pop()
            if len(held) <= 8 and all(type(x) is int for x in held):
                held = [i for i in sorted(set(held)) if wait[i] == rank]
                done = -1
                for i in held:
                    if of[i] == done:
                        self._push(rank, i)
                        continue
                    done = of[i]
                    j = after[i]
                    k, h = int(after[j]), int(before[i])
                    ids[i], wait[j], after[i], before[j] = rank, -1, k, -2
                    new = -1
                    if k >= 0:
                        before[k] = i
                        new = pair_rank(rank << 18 | int(ids[k]), -1)
                        if new >= 0:
                            self._push(new, i)
                    wait[i] = new
                    if h >= 0:
                        wait[h] = new = pair_rank(int(ids[h]) << 18 | rank, -1)
                        if new >= 0:
                            self._push(new, h)
                continue
            at = np.unique(np.concatenate([np.atleast_1d(x) for x in held])) if len(held) > 1 else held[0]
            at = at[wait[at] == rank]  # the others are stale
            if not len(at):
                continue
            leftmost = np.append(True, of[at[1:]] != of[at[:-1]])
            if not leftmost.all():
                self._push(rank, at[~leftmost])
                at = at[leftmost]
            j = after[at]
            k, h = after[j], before[at]
            ids[at], wait[j], wait[at], before[j] = rank, -1, -1, -2
            after[at] = k
            right, left = k >= 0, h >= 0
            i, k, h = at[right], k[right], h[left]
            before[k] = i
            new = self.lookup(np.concatenate([ids[i], ids[h]]), np.concatenate([ids[k], ids[at[left]]]))
            where = np.concatenate([i, h])
            wait[where] = new
            found = new >= 0
            self._push_all(new[found], where[found])
        kept = np.flatnonzero(before != -2)  # the others have merged into one before them
        cuts = np.searchsorted(kept, ends).tolist()
        flat = ids[kept].tolist()
        return [flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def _kinds() -> np.ndarray:
    """Code point to class: 0 white space, 1 letter, 2 number, 3 other."""
    out = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            out[c] = 1
        elif first == "N":
            out[c] = 2
    #: The code points with the property White_Space.
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = 0
    return out


def pre_tokens(points: np.ndarray, kinds: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where the matches of public_tokenizers.PATTERN begin in ``points``; ``breaks``: where texts begin, and the end.

    The pattern gives a run of letters, of numbers or of other marks, each with one blank before it; a run of white
    space but for its last character, where something follows; that character by itself unless it is such a blank;
    and the seven English contractions where an apostrophe stands alone after something other than a blank.
    """
    n = len(points)
    kind = kinds[points]
    edge = np.zeros(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[breaks] = True
    space = kind == 0
    last = np.flatnonzero(space & np.append(edge[1:], True)[:n])  # the last of each white-space run
    inner = last[~np.isin(last + 1, breaks)]  # those with something after them in the text
    edge[inner] = True
    blank = inner[points[inner] == 32]
    edge[blank + 1] = False
    tick = np.flatnonzero(points == 39)
    if len(tick):
        tick = tick[edge[tick] & edge[tick + 1] & ~np.isin(tick + 1, breaks)]
        for i in tick.tolist():
            two = "".join(map(chr, points[i + 1 : i + 3].tolist()))
            if two[:1] in ("s", "t", "m", "d"):
                size = 2
            elif two in ("re", "ve", "ll") and not edge[i + 2]:
                size = 3
            else:
                continue
            edge[i + 1] = False
            edge[i + size] = True
    return np.flatnonzero(edge)


class Codec:
    """Encodes texts of one vocabulary; pre-tokens met lately are kept in two generations of a bounded cache."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.one, self.many = RankQueue(ranks), SharedQueue(ranks)
        self.whole = {b: f"{i} " for b, i in ranks.items()}
        self.bytes_of = {str(i): b for b, i in ranks.items()}
        self.kinds = _kinds()
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def _learn(self, pieces: set[str]) -> dict[str, str]:
        """What each of these pre-tokens encodes to."""
        out, short = {}, []
        for p in pieces:
            if (known := self.old.get(p)) is not None:
                out[p] = known
                continue
            raw = p.encode()
            if (known := self.whole.get(raw)) is not None:
                out[p] = known
            elif len(raw) > LONG_BYTES:
                out[p] = " ".join(map(str, self.one.merged(raw))) + " "
            else:
                short.append(p)
        for a in range(0, len(short), MERGED_TOGETHER):
            part = short[a : a + MERGED_TOGETHER]
            for p, ids in zip(part, self.many.merged([x.encode() for x in part]), strict=True):
                out[p] = " ".join(map(str, ids)) + " "
        return out

    def encode(self, texts: list[str]) -> list[str]:
        """For each text, its ids in decimal, each followed by a blank."""
        cut: list[list[str]] = []
        for part in pieces_of(texts):
            cut += self._cut(part)
        new: set[str] = set()
        for x in cut:
            new.update(x)
        new.difference_update(self.young)
        known = self._learn(new)
        # What is kept is bounded in entries and in characters of each: long pre-tokens serve this call alone.
        kept = {p: x for p, x in known.items() if len(p) <= CACHE_CHARS}
        fits = len(self.young) + len(kept) <= CACHE_ENTRIES
        if fits:
            self.young |= kept
        if fits and len(kept) == len(known):
            get = self.young.__getitem__
            return ["".join(map(get, x)) for x in cut]
        young = self.young
        out = ["".join([known.get(p) or young[p] for p in x]) for x in cut]
        if not fits:
            self.old, self.young = young, kept if len(kept) <= CACHE_ENTRIES else {}
        return out

    def _cut(self, texts: list[str]) -> list[list[str]]:
        joined = "".join(texts)
        if not joined:
            return [[] for _ in texts]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        at = pre_tokens(np.frombuffer(joined.encode("utf-32-le"), np.uint32), self.kinds, ends)
        rows = np.searchsorted(at, ends).tolist()
        at = at.tolist()
        return [[joined[x:y] for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)] for a, b in zip(rows, rows[1:], strict=False)]

    def rest(self) -> None:
        """Lets the cache go: a Python worker may serve other stages next."""
        self.young, self.old = {}, {}

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split()))


_CODECS: dict[str, Codec] = {}


def codec(name: str, ranks) -> Codec:
    """One codec for each vocabulary and Python worker; ``ranks``: a broadcast."""
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(ranks.value)
    return _CODECS[name]


def shipped(spark: SparkSession, ranks: dict[bytes, int]):
    """A name for the vocabulary and the broadcast of it."""
    if len(ranks) > MOST_RANKS or max(ranks.values(), default=0) >= 64**3:
        raise ValueError("too large a vocabulary")
    name = hashlib.sha256(repr(sorted(ranks.items(), key=lambda x: x[1])).encode()).hexdigest()
    return name, spark.sparkContext.broadcast(ranks)


def pieces_of(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in lists of about ``most`` characters."""
    part, size = [], 0
    for x in texts:
        part.append(x)
        size += len(x)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def batches_of_texts(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of a batch, in pieces of bounded size."""
    _, offsets = utf8(batch["text"])
    for a, b in chunks(offsets, BATCH_BYTES):
        part = batch.slice(a, b - a)
        yield part["id"].to_pylist(), [x or "" for x in part["text"].to_pylist()]


def encode(docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """``id``, ``token_ids`` (array of int; left out unless ``ids``), ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    name, shipped_ranks = shipped(docs.sparkSession, ranks)
    rows = picked(docs, id=id_col, text=text_col)
    out = f"id {field(rows, 'id')}, {'token_ids array<int>, ' if ids else ''}n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, shipped_ranks)
        for batch in batches:
            for keys, texts in batches_of_texts(batch):
                coded = own.encode(texts)
                columns = [
                    pa.array(keys, batch.schema.field("id").type),
                    *([pa.array([np.fromstring(x, np.int32, sep=" ") if x else np.zeros(0, np.int32) for x in coded], pa.list_(pa.int32()))] if ids else []),
                    pa.array([x.count(" ") for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x[:-1].encode()).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in coded], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *(["token_ids"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"])
        own.rest()

    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def decode(coded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``id`` and ``text``: the bytes of the ids, read as UTF-8; ids that do not form UTF-8 give null."""
    name, shipped_ranks = shipped(coded.sparkSession, ranks)
    rows = picked(coded, id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, shipped_ranks)
        for batch in batches:
            texts = []
            for x in batch["ids"].to_pylist():
                try:
                    texts.append(None if x is None else own.decode(" ".join(map(str, x))).decode())
                except UnicodeDecodeError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {field(rows, 'id')}, text string").withColumnRenamed("id", id_col)
