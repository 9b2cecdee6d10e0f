"""Spelling variants: words at distance one, found by Levenshtein automata over compact tries.

A word is a maximal run of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case. Words with at least
``least_length`` code points and ``least_count`` occurrences over all texts are the vocabulary. Two of them are near if
they differ by one inserted, deleted or replaced code point.

Cases: a null text has no words; a null id counts as empty text (it matters for ``damage`` only); repeated rows count
again; ties between forms go to the smallest word in code-point order; a run of any length is one word; other columns
play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelmark.llm.shared import ASCII_LOWER_STR, picked, written

LETTERS = "A-Za-zÀ-ÿ"
#: Entries of a task's own counts before they are given away.
HELD_WORDS = 200_000
#: Words of a trie shard, words of a task that searches, and bytes of the shards that are broadcast at a time.
SHARD_WORDS, TASK_WORDS, BLOCK_BYTES = 50_000, 4_000, 32 << 20


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, damage: int | None = None) -> DataFrame:
    """The vocabulary: word, n. With ``damage`` m a run whose CRC-32 of ``<id>:<run>`` m divides loses the code point
    at that number modulo the run's length, which plants misspellings that can be told again.
    """
    rows = picked(docs, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")  # shorter runs have no word of this length, whole or damaged

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for rows in batches:
            for doc, text in zip(rows["id"], rows["text"], strict=True):
                found = Counter(runs.findall(text.as_py().translate(ASCII_LOWER_STR)))
                if damage:
                    head = zlib.crc32(f"{doc.as_py()}:".encode())
                    for run in [r for r in found if zlib.crc32(r.encode(), head) % damage == 0]:
                        at, n = zlib.crc32(run.encode(), head) % len(run), found.pop(run)
                        if len(run) > least_length:
                            held[run[:at] + run[at + 1 :]] += n
                for run, n in found.items():
                    held[run] += n
                if len(held) >= HELD_WORDS:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- tries --------------------------------------------------------------------------------------------------------


def trie(words: list[bytes], counts: np.ndarray) -> dict[str, bytes]:
    """A trie of sorted distinct words (a byte a letter) in level order: each node's letter, first child and word.

    Children of node k are first[k] to first[k + 1]; end[k] is the word that ends there, or -1.
    """
    data = np.frombuffer(b"".join(words), np.uint8)
    lens = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(lens)])
    live, node = np.arange(len(words)), np.zeros(len(words), np.int64)
    labels, parents, ends = [np.zeros(1, np.uint8)], [], []
    total, depth = 1, 0
    empty = np.flatnonzero(lens == 0)
    ends.append(np.stack([np.zeros(len(empty), np.int64), empty]))
    while True:
        going = lens[live] > depth
        live, node = live[going], node[going]
        if not len(live):
            break
        if len(live) == 1:  # a tail of one word
            rest = int(lens[live[0]]) - depth
            labels.append(data[starts[live[0]] + depth : starts[live[0] + 1]])
            parents.append(np.concatenate([node, total + np.arange(rest - 1)]))
            total += rest
            ends.append(np.array([[total - 1], [live[0]]]))
            break
        letter = data[starts[live] + depth]
        new = np.ones(len(live), bool)
        new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
        labels.append(letter[new])
        parents.append(node[new])
        node = total + np.cumsum(new) - 1
        total += int(new.sum())
        depth += 1
        done = lens[live] == depth
        ends.append(np.stack([node[done], live[done]]))
    children = np.bincount(np.concatenate(parents), minlength=total) if parents else np.zeros(total, np.int64)
    end = np.full(total, -1, np.int32)
    at, word = np.concatenate(ends, axis=1)
    end[at] = word
    return {
        "label": np.concatenate(labels).tobytes(),
        "first": (1 + np.concatenate([[0], np.cumsum(children)])).astype(np.int32).tobytes(),
        "end": end.tobytes(),
        "text": data.tobytes(),
        "start": starts.astype(np.int32).tobytes(),
        "n": np.asarray(counts, np.int64).tobytes(),
    }


class Shard:
    """A trie to search in."""

    def __init__(self, parts: dict[str, bytes]):
        self.label, self.text = parts["label"], parts["text"]
        self.first, self.end, self.start, self.n = (memoryview(parts[k]).cast(t) for k, t in (("first", "i"), ("end", "i"), ("start", "i"), ("n", "q")))

    def near(self, word: bytes) -> list[int]:
        """The shard's words at distance one from ``word``: its automaton and the trie, depth first.

        At depth d the automaton is in state 0 (the first d letters of ``word``), or has spent its edit and waits for
        the letter d - 1 (one was inserted), d (one was replaced) or d + 1 (one was deleted): flags 1, 2 and 4.
        """
        label, first, end, size, out = self.label, self.first, self.end, len(word), []
        stack = [(0, 0, 8 | (4 if size else 0))]  # node, depth, flags; 8: nothing spent
        while stack:
            k, d, flags = stack.pop()
            if (flags & 2 and d == size or flags & 1 and d == size + 1 or flags & 4 and d + 1 == size) and not (flags & 8 and d == size) and end[k] >= 0:
                out.append(end[k])
            a, b = first[k], first[k + 1]
            if a == b:
                continue
            if flags & 8:
                here = word[d] if d < size else -1
                following = word[d + 1] if flags & 4 and d + 1 < size else -1
                for child in range(a, b):
                    letter = label[child]
                    if letter == here:
                        stack.append((child, d + 1, 11 | (4 if d + 1 < size else 0)))
                    else:
                        stack.append((child, d + 1, (3 if d < size else 1) | (4 if letter == following else 0)))
                continue
            # Only letters that one of the flags waits for lead on.
            waits: dict[int, int] = {}
            if flags & 1 and d <= size:
                waits[word[d - 1]] = 1
            if flags & 2 and d < size:
                waits[word[d]] = waits.get(word[d], 0) | 2
            if flags & 4 and d + 1 < size:
                waits[word[d + 1]] = waits.get(word[d + 1], 0) | 4
            for letter, flag in waits.items():
                child = label.find(letter, a, b)
                if child >= 0:
                    stack.append((child, d + 1, flag))
        return out

    def word(self, k: int) -> str:
        return self.text[self.start[k] : self.start[k + 1]].decode("latin-1")


_PARTS = ("label", "first", "end", "text", "start", "n")


def shards(vocabulary: DataFrame, n_words: int) -> DataFrame:
    """Tries over ranges of the sorted vocabulary, SHARD_WORDS words each at most: id, bytes and the trie's parts."""
    ranged = vocabulary.repartitionByRange(max(1, -(-n_words // SHARD_WORDS)), "word").sortWithinPartitions("word")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []
        counts: list[int] = []

        def shard(n: int) -> pa.RecordBatch:
            parts = trie(words[:n], np.array(counts[:n], np.int64))
            del words[:n], counts[:n]
            return pa.RecordBatch.from_pydict({"bytes": pa.array([sum(map(len, parts.values()))], pa.int64())} | {k: pa.array([parts[k]], pa.binary()) for k in _PARTS})

        for batch in batches:
            words += [w.encode("latin-1") for w in batch["word"].to_pylist()]
            counts += batch["n"].to_pylist()
            while len(words) >= SHARD_WORDS:
                yield shard(SHARD_WORDS)
        if words:
            yield shard(len(words))

    built = ranged.mapInArrow(build, "bytes long, " + ", ".join(f"{k} binary" for k in _PARTS))
    return written(built.withColumn("id", F.monotonically_increasing_id()), "spelling-shards")


def blocks(sizes: list[tuple[int, int]], most: int) -> Iterator[list[int]]:
    """Ids of shards in blocks of ``most`` bytes, or of one shard."""
    held, size = [], 0
    for shard, n in sizes:
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append(shard)
        size += n
    if held:
        yield held


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """word, n_near, and its near word of the largest n (``best``, ``best_n``), for words that have any.

    ``vocabulary`` (word, n) is read several times: give a written table. The shards go out one block of BLOCK_BYTES
    after the other; each block meets all words, every word's results are reduced in the task to one row a block.
    """
    spark, n_words = vocabulary.sparkSession, vocabulary.count()
    tries = shards(vocabulary, n_words)
    words = vocabulary.select("word").repartition(max(1, -(-n_words // TASK_WORDS)))
    found = None
    for block in blocks([tuple(r) for r in tries.select("id", "bytes").orderBy("id").collect()], BLOCK_BYTES):
        sent = spark.sparkContext.broadcast([{k: bytes(r[k]) for k in _PARTS} for r in tries.where(F.col("id").isin(block)).collect()])

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = [Shard(parts) for parts in sent.value]
            for batch in batches:
                out = []
                for word in batch["word"].to_pylist():
                    own, count, best = word.encode("latin-1"), 0, None
                    for shard in held:
                        near = shard.near(own)
                        count += len(near)
                        for k in near:
                            if best is None or shard.n[k] >= best[1]:
                                this = (shard.word(k), shard.n[k])
                                if best is None or this[1] > best[1] or this[0] < best[0]:
                                    best = this
                    if best:
                        out.append((word, count, *best))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n_near", "best", "best_n"])

        part = written(words.mapInArrow(search, "word string, n_near long, best string, best_n long"), "spelling-near")
        sent.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "word string, n_near long, best string, best_n long")
    first = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", F.col("first.word").alias("best"), (-F.col("first.least")).alias("best_n"))


def roots(forms: DataFrame, largest: int, times: int) -> DataFrame:
    """word, root: forms followed to the last. Each form has at least ``times`` its word's n and none has more than
    ``largest``, so that a chain's length has a bound; each round doubles the steps that are taken at once.
    """
    steps = max(1, math.ceil(math.log(max(largest, 2), times)))
    out = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(steps))):
        further = out.select(F.col("word").alias("root"), F.col("root").alias("further"))
        out = written(out.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")
    return out


def variants(vocabulary: DataFrame, times: int = 5) -> DataFrame:
    """For each word of ``vocabulary`` (word, n): its form (the near word of the largest n, if that is ``times`` its own
    n or more), the root that its forms lead to (itself without one), n, n_near and form_n.
    """
    vocabulary = written(vocabulary.select("word", "n"), "spelling-words")
    largest = vocabulary.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    good = F.col("best_n") >= times * F.col("n")
    joined = vocabulary.join(neighbours(vocabulary), "word", "left")
    rows = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "spelling-forms")
    ended = roots(rows.where("form is not null"), largest, times)
    return rows.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
