"""Quality by importance resampling.

Two generative models over hashed n-grams (words and runs of marks, single and in pairs) are counted: of all documents,
and of the target, documents labelled good. A document's log weight is the sum of its n-grams' log ratios of the two.
Documents are drawn without replacement by Gumbel top-k: each one's key is its log weight plus Gumbel noise (from a hash
of id and seed), and the k largest keys stay; a document's chance is thus in proportion to its weight among those that
are left. ``k`` is a parameter. Where it is not given it is the number of documents whose log weight reaches the level
that best tells labelled good from labelled bad documents, over labelled documents that the target was not counted on.

A pair of equal tokens is one n-gram whatever the token is (a back-reference), which is what repeated words share.

Cases: null, empty and blank texts have no n-grams: they are not drawn from and stay; without labelled bad documents and
without ``k`` all stay; equal keys at the k-th place stay together, so repeated rows share their fate; rows that share an
id have the same noise, a row without an id has it from its text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelmark.llm.shared import WORD_OR_MARK, field, mixed, picked, pieces, token_hashes, tokens, written

#: Buckets of hashed n-grams (two to this power), and pseudo-counts that draw a bucket's ratio to 1.
BITS, PRIOR = 16, 20.0
#: Labelled rows that the target and the level are fitted on, at most; one in LEVEL_SHARE of them is for the level.
FIT_ROWS, LEVEL_SHARE = 100_000, 4
SEED = 17
_SAME = np.uint64(0x5A5A5A5A12345678)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of single tokens and of pairs (the last of a row is void: -1), and rows' offsets."""
    starts, ends, rows = tokens(data, offsets, WORD_OR_MARK)
    one = token_hashes(data, starts, ends)
    two = np.full(len(one), -1, np.int64)
    if len(one) > 1:
        a, b = one[:-1], one[1:]
        pair = mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)
        pair[a == b] = mixed(_SAME + np.zeros(1, np.uint64))[0]
        two[:-1] = (pair >> np.uint64(64 - BITS)).astype(np.int64)
        last = rows[1:] - 1
        two[last[last >= 0]] = -1
    return (one >> np.uint64(64 - BITS)).astype(np.int64), two, rows


def label_sample(labels: DataFrame, id_col: str, label_col: str, fit_rows: int) -> DataFrame:
    """id, good (0 or 1) and for_level of at most ``fit_rows`` labelled documents, chosen by a hash of the id."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("good")).where("id is not null and good in (0, 1)")
    own = own.groupBy("id").agg(F.min("good").cast("int").alias("good")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    return own.withColumn("for_level", F.pmod(F.xxhash64(F.lit("level"), "id"), F.lit(LEVEL_SHARE)) == 0)


def fit(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratio of each bucket. All documents are counted; ``sample`` names the target among them."""
    # The sample has FIT_ROWS rows at most, so it may be broadcast.
    named = sample.select("id", ((F.col("good") == 1) & ~F.col("for_level")).alias("target"))
    rows = picked(docs, id=id_col, text=text_col).join(F.broadcast(named), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for data, offsets, batch in pieces(batches):
            one, two, at = ngrams(data, offsets)
            mine = np.repeat(batch["target"].to_numpy(zero_copy_only=False), np.diff(at))
            for x in (one, two):
                every += np.bincount(x[x >= 0], minlength=size)
                target += np.bincount(x[mine & (x >= 0)], minlength=size)
        met = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(every[met]), pa.array(target[met])], names=["bucket", "every", "target"])

    sums = rows.mapInArrow(count, "bucket bigint, every bigint, target bigint").groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("target").alias("target"))
    every, target = np.zeros(size), np.zeros(size)
    for r in sums.collect():  # one row for each bucket at most
        every[r.bucket], target[r.bucket] = r.every, r.target
    share = target.sum() / max(every.sum(), 1)
    if not share:
        return np.zeros(size)
    return np.log((target + PRIOR * share) / (every + PRIOR)) - np.log(share)


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of each row's values (``rows``: values before each row); what stands before a row has no part in its sum."""
    out = np.zeros(len(rows) - 1)
    full = np.flatnonzero(rows[1:] > rows[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, rows[:-1][full])
    return out


def gumbel(seed: int, key) -> float:
    """Standard Gumbel noise that depends on seed and key alone."""
    raw = hashlib.blake2b(f"{seed} {key}".encode(), digest_size=8).digest()
    return float(-np.log(-np.log(((int.from_bytes(raw, "little") >> 12) + 0.5) / 2**52)))


def score(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_ngrams, log_weight, gumbel, and the columns named in ``carry`` as c0, c1 and so on."""
    held = {f"c{i}": c for i, c in enumerate(carry)}
    rows = picked(docs, id=id_col, text=text_col, **held)
    shipped = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.append(shipped.value, 0.0)  # -1, the void n-gram, weighs nothing
        for data, offsets, batch in pieces(batches):
            one, two, at = ngrams(data, offsets)
            pairs = np.concatenate([[0], np.cumsum(two >= 0)])
            noise = [gumbel(seed, batch["text"][k].as_py() if i is None else i) for k, i in enumerate(batch["id"].to_pylist())]
            columns = [batch["id"], pa.array(np.diff(at) + pairs[at[1:]] - pairs[at[:-1]], pa.int64()), pa.array(row_sums(table[one] + table[two], at)), pa.array(noise, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch[c] for c in held)], names=["id", "n_ngrams", "log_weight", "gumbel", *held])

    return rows.mapInArrow(run, f"id {field(rows, 'id')}, n_ngrams bigint, log_weight double, gumbel double" + "".join(f", {c} {field(rows, c)}" for c in held))


def level(scored: DataFrame, sample: DataFrame) -> float | None:
    """The log weight that best tells good from bad labelled documents (fewest errors, each class as a whole).

    Good documents that the target was counted on have no part in it. Of rows that share an id the lightest counts.
    """
    own = sample.where("for_level or good = 0")
    seen = scored.where("n_ngrams > 0").join(F.broadcast(own), "id").groupBy("id").agg(F.min("log_weight").alias("weight"), F.min("good").alias("good")).collect()
    weights, good = np.array([r.weight for r in seen]), np.array([r.good for r in seen], int)
    if not len(seen) or good.all() or not good.any():
        return None
    order = np.argsort(weights, kind="stable")
    weights, good = weights[order], good[order]
    bad_below = np.concatenate([[0], np.cumsum(good == 0)]) / (good == 0).sum()
    good_below = np.concatenate([[0], np.cumsum(good == 1)]) / good.sum()
    gain = bad_below - good_below
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edges = np.concatenate([[weights[0] - 1e-6], (weights[1:] + weights[:-1]) / 2, [weights[-1] + 1e-6]])
    return float(edges[best].mean())


def kth_largest(rows: DataFrame, key: str, k: int, near: int = 2000) -> float:
    """The k-th largest of ``key``: counts by 4096 intervals, again inside the interval that has it, then a few rows."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        width = (high - low) / 4096
        slot = F.least(F.floor((F.col(key) - low) / width), F.lit(4095)).cast("int")
        inside = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        found = sorted(((r.slot, r.n, r.low, r.high) for r in inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()), reverse=True)
        for _, n, first, last in found:
            if above + n >= k:
                low, high = first, last
                break
            above += n
        if low < high and n <= near:
            own = sorted((r[0] for r in rows.where((F.col(key) >= low) & (F.col(key) <= high)).select(key).collect()), reverse=True)
            return own[k - above - 1]
    return low


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, fit_rows: int = FIT_ROWS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id``, n_ngrams, log_weight, sample_key (log weight plus noise), kept, and the columns named in ``carry``."""
    sample = written(label_sample(labels, id_col, label_col, fit_rows), "labels")
    scored = written(score(docs, fit(docs, sample, id_col, text_col), id_col, text_col, seed, carry), "scores")
    keyed = scored.withColumn("sample_key", F.col("log_weight") + F.col("gumbel"))
    textual = keyed.where("n_ngrams > 0")
    kept = F.lit(True)
    if k is None and (at := level(scored, sample)) is not None:
        k = textual.where(F.col("log_weight") >= at).count()
    if k is not None:
        n = textual.count()
        least = kth_largest(textual, "sample_key", min(k, n)) if n and k > 0 else float("inf")
        kept = (F.col("n_ngrams") == 0) | (F.col("sample_key") >= least)
    return keyed.select(F.col("id").alias(id_col), "n_ngrams", "log_weight", "sample_key", kept.alias("kept"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])


def draw_report(drawn: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """What the draw keeps of each label (null: not labelled): label, n, n_kept, mean_log_weight."""
    own = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("label"))
    return drawn.join(own, id_col, "left").groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("bigint")).alias("n_kept"), F.avg("log_weight").alias("mean_log_weight"))
