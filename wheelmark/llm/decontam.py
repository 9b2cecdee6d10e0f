"""Benchmark decontamination with suffix arrays of the training text.

Each task takes its documents in shards of bounded size, turns the words that the benchmark has too into ranks and sorts
all their suffixes, to full depth, by prefix doubling of what is still tied. Every suffix of every benchmark item is found
by binary search in each shard. Its neighbours there give its longest verbatim match; where that has the window's length,
two more searches give all places of the window. The same places, read the other way round, give each document's longest
match and where it is, matches shorter than a window too. Words are compared by hash and then by their bytes.

Cases: null and empty texts have no words and no hits; items without words have no windows; items of fewer words than
``window`` are one window; items with a null item_id mark words but are not listed; repeated items count once; repeated
or tied documents are judged each by itself; an empty benchmark hits nothing, an empty table gives no rows; other
columns are ignored.

The benchmark is broadcast in blocks of ``block_bytes`` of text, ROUND_BYTES of it at a time; a larger one takes several
rounds over the documents, whose results are merged by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelmark.llm.shared import ALNUM, field, picked, pieces, same_tokens, text_key, token_hashes, tokens, utf8, written

BLOCK_BYTES = 4 << 20
#: Text bytes of the benchmark that are broadcast at a time.
ROUND_BYTES = 32 << 20
#: Text bytes in a shard (a longer document is a shard by itself).
SHARD_BYTES = 4 << 20
#: Benchmark suffixes that are searched together, and words that a comparison looks at together.
TOGETHER, CELLS = 1 << 16, 1 << 21


class Block(NamedTuple):
    """Benchmark items as suffixes of word ranks; 0 follows each item."""

    vocabulary: np.ndarray  # sorted word hashes; a word's rank is its place and 1
    data: np.ndarray  # the items' bytes
    spelt: np.ndarray  # by rank - 1: where the word stands in data (start, end)
    maybe: np.ndarray  # by a hash's first 20 bits, whether any word has them
    words: np.ndarray
    item: np.ndarray  # of each position in words
    names: list[str | None]  # of each item
    suffixes: np.ndarray  # positions of all suffixes, in the order of their words
    window: np.ndarray  # of each position in words: the words of the window that begins there, or 0


def build_block(items: list[tuple[str | None, str]], window: int) -> Block | None:
    data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
    starts, ends, rows = tokens(data, offsets, ALNUM)
    if not len(starts):
        return None
    hashes = token_hashes(data, starts, ends)
    vocabulary, first = np.unique(hashes, return_index=True)
    maybe = np.zeros(1 << 20, bool)
    maybe[(vocabulary >> np.uint64(44)).astype(np.int64)] = True
    sizes = np.diff(rows)
    names = [n for (n, _), size in zip(items, sizes.tolist(), strict=True) if size]
    sizes = sizes[sizes > 0]
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.zeros(begin[-1], np.int32)
    inside = np.ones(len(words), bool)
    inside[begin[1:] - 1] = False
    words[inside] = np.searchsorted(vocabulary, hashes) + 1
    item = np.repeat(np.arange(len(sizes)), sizes + 1)
    left = begin[item + 1] - 1 - np.arange(len(words))  # words from a position to its item's end
    whole = np.minimum(sizes, window)[item]
    return Block(vocabulary, data, np.stack([starts[first], ends[first]], axis=1), maybe, words, item, names, suffix_order(words), np.where(left >= whole, whole, 0))


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Positions of all words but 0, in the order of what follows up to the next 0; three words first, then twice as many
    in each round, among those that are tied so far."""
    n = len(words)
    at = np.flatnonzero(words > 0)
    if not len(at):
        return at
    ends = np.append(np.flatnonzero(words == 0), n)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    bits = 21
    if int(words.max()) < 1 << bits:
        padded, k = np.concatenate([words.astype(np.int64), [0, 0]]), 3
        second = padded[at + 1]
        key = (padded[at] << 2 * bits) | (second << bits) | np.where(second > 0, padded[at + 2], 0)
    else:
        key, k = words[at].astype(np.int64), 1
    by = np.argsort(key, kind="stable")
    order, key = at[by], key[by]
    rank = np.zeros(n + 1, np.int64)
    slots = np.arange(len(order))
    head = np.append(True, key[1:] != key[:-1])
    while True:
        # A tied group has the rank of its first slot.
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))] + 1
        tied = ~(head & np.append(head[1:], True))
        slots = slots[tied]
        slots = slots[left[order[slots]] >= k]  # the others have ended: they are equal
        if not len(slots):
            return order
        own = order[slots]
        one, two = rank[own], rank[np.minimum(own + k, n)]
        by = np.lexsort((two, one))
        order[slots], one, two = own[by], one[by], two[by]
        head = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
        k *= 2


def common_words(words: np.ndarray, at: np.ndarray, other: np.ndarray, place: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """How many words from ``at`` in ``words`` and from ``place`` in ``other`` are equal before either's 0 (``most`` at most).

    A few words are looked at for each pair, then more for those that are still equal: CELLS at a time.
    """
    out = np.zeros(len(at), np.int64)
    live, k, width = np.arange(len(at)), 0, 2
    while len(live):
        width = max(1, min(width, CELLS // len(live)))
        steps = k + np.arange(width)
        a = words[np.minimum(at[live, None] + steps, len(words) - 1)]
        same = (a == other[np.minimum(place[live, None] + steps, len(other) - 1)]) & (a > 0)
        many = np.where(same.all(axis=1), width, same.argmin(axis=1))
        out[live] += many
        k += width
        live = live[many == width]
        if most is not None:
            live = live[most[live] > k]
        width *= 4
    return out if most is None else np.minimum(out, most)


def bound(array: np.ndarray, words: np.ndarray, other: np.ndarray, place: np.ndarray, most: np.ndarray | None = None, above: bool = False) -> np.ndarray:
    """For each place of ``other``, how many suffixes in ``array`` are below it (or, ``above``, not above it); with
    ``most``, by so many words."""
    low, high = np.zeros(len(place), np.int64), np.full(len(place), len(array), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        at, to = array[mid], place[open_]
        limit = None if most is None else most[open_]
        n = common_words(words, at, other, to, limit)
        a, b = words[np.minimum(at + n, len(words) - 1)], other[np.minimum(to + n, len(other) - 1)]
        equal = (a == b) if limit is None else (a == b) | (n == limit)
        right = (equal | (a < b)) if above else (~equal & (a < b))
        low[open_] = np.where(right, mid + 1, low[open_])
        high[open_] = np.where(right, high[open_], mid)
    return low


class Hits(NamedTuple):
    position: np.ndarray  # word positions in the shard where a window occurs
    size: np.ndarray  # its words
    pairs: np.ndarray  # (row, item) that belong together
    at: np.ndarray  # word positions in the shard with a match of any length
    longest: np.ndarray  # words of the longest match from there
    suffix: np.ndarray  # the benchmark position it begins at


def ranks_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, block: Block) -> np.ndarray:
    """A shard's words as the block's ranks; 0 where the block has no such word."""
    ranks = np.zeros(len(hashes), np.int32)
    likely = np.flatnonzero(block.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(block.vocabulary, hashes[likely]), len(block.vocabulary) - 1)
    known = block.vocabulary[place] == hashes[likely]
    likely, place = likely[known], place[known]
    same = same_tokens(data, starts[likely], ends[likely], block.data, block.spelt[place, 0], block.spelt[place, 1])
    ranks[likely[same]] = place[same] + 1
    return ranks


def search(ranks: np.ndarray, rows: np.ndarray, block: Block) -> Hits | None:
    """Where the block's suffixes occur among a shard's words; ``rows``: words before each document."""
    n = len(ranks)
    # Runs of known words inside a document, each followed by a 0.
    edge = np.ones(n + 1, bool)
    edge[1:n] = (ranks[1:] > 0) != (ranks[:-1] > 0)
    edge[rows] = True
    cut = np.flatnonzero(edge)
    begin, size = cut[:-1], np.diff(cut)
    good = ranks[begin] > 0
    begin, size = begin[good], size[good]
    if not len(begin):
        return None
    to = np.concatenate([[0], np.cumsum(size + 1)])
    source = np.repeat(begin - to[:-1], size + 1) + np.arange(to[-1])
    words = ranks[np.minimum(source, n - 1)]
    words[to[1:] - 1] = 0
    array = suffix_order(words)
    # Suffixes whose first word the shard has; the others match nothing.
    there = np.zeros(len(block.vocabulary) + 1, bool)
    there[words] = True
    suffixes = block.suffixes[there[block.words[block.suffixes]]]
    parts = [suffixes[i : i + TOGETHER] for i in range(0, len(suffixes), TOGETHER)]
    below = np.concatenate([bound(array, words, block.words, x) for x in parts])
    best = np.zeros(len(suffixes), np.int64)
    for side in (-1, 0):
        at = array[np.clip(below + side, 0, len(array) - 1)]
        best = np.maximum(best, np.concatenate([common_words(block.words, x, words, at[i * TOGETHER : i * TOGETHER + len(x)]) for i, x in enumerate(parts)]))
    # Windows that occur, each different one once (the first in the order of suffixes), with all places and items.
    need = block.window[suffixes]
    own = np.flatnonzero((need > 0) & (best >= need))
    position, sizes, pairs = [], [], []
    if len(own):
        low = bound(array, words, block.words, suffixes[own], need[own])
        high = bound(array, words, block.words, suffixes[own], need[own], above=True)
        name = np.stack([low, need[own]], axis=1)  # equal windows have the same places and length
        head, which = np.unique(name, axis=0, return_index=True, return_inverse=True)[1:]
        held = np.unique(np.stack([which.ravel(), block.item[suffixes[own]]], axis=1), axis=0)
        cut = np.searchsorted(held[:, 0], np.arange(len(head) + 1))
        many = (high - low)[head]
        window = np.repeat(np.arange(len(head)), many)
        found = array[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[head], many)]
        position, sizes = source[found], need[own][head][window]
        met = np.unique(np.stack([np.searchsorted(rows, position, "right") - 1, window], axis=1), axis=0)
        count = np.diff(cut)[met[:, 1]]
        items = held[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(cut[met[:, 1]], count), 1]
        pairs = np.unique(np.stack([np.repeat(met[:, 0], count), items], axis=1), axis=0)
    # A place's longest match is with one of its neighbours among the benchmark's suffixes.
    near = np.searchsorted(below, np.arange(len(array)), "right")
    longest, suffix = np.zeros(len(array), np.int64), np.zeros(len(array), np.int64)
    for side in (-1, 0):
        other = suffixes[np.clip(near + side, 0, len(suffixes) - 1)]
        length = common_words(words, array, block.words, other)
        better = length > longest
        longest[better], suffix[better] = length[better], other[better]
    return Hits(np.asarray(position, np.int64), np.asarray(sizes, np.int64), np.asarray(pairs, np.int64).reshape(-1, 2), source[array], longest, suffix)


def _rounds(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int, round_bytes: int) -> Iterator[list]:
    """Broadcasts of the benchmark's blocks, a round at a time; one block is in the driver's memory at a time."""
    rows = written(picked(benchmark, item=item_col, text=text_col).where("text is not null").withColumn("item", F.col("item").cast("string")).distinct(), "benchmark")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    held, empty = [], True
    for k in range(n):
        own = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        block = build_block([(x.item, x.text) for x in own.collect()], window)
        if block is not None:
            held.append(rows.sparkSession.sparkContext.broadcast(block))
        if held and len(held) * block_bytes >= round_bytes:
            yield held
            held, empty = [], False
    if held or empty:
        yield held


FOUND = "n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>, longest_words bigint, longest_at bigint, longest_item string"


def scan(rows: DataFrame, blocks: list) -> DataFrame:
    """What the blocks (broadcasts) hit in each of ``rows`` (text and others, which are kept)."""
    others = [c for c in rows.columns if c != "text"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = [x.split()[0] for x in FOUND.replace("start: bigint, end", "").split(", ")]

    def shard(data: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = len(batch)
        starts, ends, before = tokens(data, offsets, ALNUM)
        hashes = token_hashes(data, starts, ends)
        deltas = np.zeros(len(hashes) + 1, np.int64)
        items: dict[int, set[str]] = {}
        longest = [(0, None, None)] * n
        for b in blocks:
            block = b.value
            if not len(hashes) or (found := search(ranks_of(data, starts, ends, hashes, block), before, block)) is None:
                continue
            np.add.at(deltas, found.position, 1)
            np.add.at(deltas, found.position + found.size, -1)
            for row, item in found.pairs.tolist():
                items.setdefault(row, set()).add(block.names[item])
            row = np.searchsorted(before, found.at, "right") - 1
            order = np.lexsort((found.at, -found.longest, row))
            head = order[np.append(True, row[order][1:] != row[order][:-1])]
            for r, size, at, suffix in zip(row[head].tolist(), found.longest[head].tolist(), found.at[head].tolist(), found.suffix[head].tolist(), strict=True):
                if size > longest[r][0]:
                    longest[r] = (size, at - int(before[r]), block.names[block.item[suffix]])
        hit = np.concatenate([[False], np.cumsum(deltas[:-1]) > 0, [False]])
        spans: list[list[dict]] = [[] for _ in range(n)]
        # A document's edge ends a span.
        cut = np.zeros(len(hit), bool)
        cut[before + 1] = True
        begin = np.flatnonzero(hit[1:] & (~hit[:-1] | cut[1:]))
        if len(begin):
            end = np.flatnonzero(hit[:-1] & (~hit[1:] | cut[1:]))
            row = np.searchsorted(before, begin, "right") - 1
            for r, a, b in zip(row.tolist(), (begin - before[row]).tolist(), (end - before[row]).tolist(), strict=True):
                spans[r].append({"start": a, "end": b})
        columns = [
            pa.array(np.diff(before), pa.int64()),
            pa.array(spans, span),
            pa.array([sorted(x for x in items.get(i, ()) if x is not None) for i in range(n)], pa.list_(pa.string())),
            pa.array([x[0] for x in longest], pa.int64()),
            pa.array([x[1] for x in longest], pa.int64()),
            pa.array([x[2] for x in longest], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*(batch[c] for c in others), *columns], names=[*others, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, batch in pieces(batches, most=SHARD_BYTES):
            yield shard(data, offsets, batch)

    return rows.mapInArrow(run, ", ".join([*(f"{c} {field(rows, c)}" for c in others), FOUND]))


#: Spans of several rounds as one: sorted, and joined where they touch.
JOINED = """aggregate(array_sort(flatten(collected)), CAST(array() AS array<struct<start: bigint, end: bigint>>), (a, x) -> CASE WHEN size(a) > 0 AND element_at(a, -1).end >= x.start
  THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end)))) ELSE concat(a, array(x)) END)"""


def _merged(found: DataFrame, more: DataFrame) -> DataFrame:
    """Two rounds as one, by id and text: rows that have both in common have the same hits."""
    names = {c: f"{c}_2" for c in ("spans", "items", "longest_words", "longest_at", "longest_item")}
    # Only documents that the second round hit or matches longer travel; a copy is enough for all rows of an id and text.
    own = more.where("longest_words > 0").select(F.col("id").alias("id_2"), F.col("key").alias("key_2"), *[F.col(c).alias(x) for c, x in names.items()]).dropDuplicates(["id_2", "key_2"])
    both = found.join(own, F.col("id").eqNullSafe(F.col("id_2")) & (F.col("key") == F.col("key_2")), "left").withColumn("collected", F.array("spans", F.coalesce("spans_2", F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)"))))
    longer = F.coalesce(F.col("longest_words_2") > F.col("longest_words"), F.lit(False))
    best = {c: F.when(longer, F.col(names[c])).otherwise(F.col(c)) for c in ("longest_words", "longest_at", "longest_item")}
    return both.select(*[F.expr(JOINED).alias(c) if c == "spans" else F.array_sort(F.array_union("items", F.coalesce("items_2", F.expr("CAST(array() AS array<string>)")))).alias(c) if c == "items" else best[c].alias(c) if c in best else F.col(c) for c in found.columns])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, round_bytes: int = ROUND_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id``, n_words, n_hit, n_items, items_sha256, contaminated, spans (start and end, in words, of what was hit), items,

    longest_words, longest_at (in words), longest_item: the longest verbatim match of a benchmark suffix, of any length;
    and the columns named in ``carry``."""
    held = {f"c{i}": c for i, c in enumerate(carry)}
    rows = picked(docs, id=id_col, text=text_col, **held)
    keyed = rows.withColumn("key", text_key())
    found = None
    for blocks in _rounds(benchmark, item_col, item_text_col, window, block_bytes, round_bytes):
        one = scan(rows if found is None and len(blocks) * block_bytes < round_bytes else keyed, blocks)
        found = one if found is None else _merged(written(found, "found"), written(one, "round"))
    hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"]), F.lit(0))
    return found.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        "spans", "items", "longest_words", "longest_at", "longest_item", *[F.col(c).alias(name) for c, name in held.items()],
    )


def clean(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the contaminated ones, where ids are unique."""
    return docs.join(found.where("contaminated").select(id_col).distinct(), id_col, "left_anti").select(*docs.columns)
