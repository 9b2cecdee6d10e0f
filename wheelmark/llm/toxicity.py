"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary documents, one on excerpts of toxic documents. Windows
of a fixed width slide over the whole text in lower case (A-Z), across word ends and through long runs, at a stride below
the width, so that every run of up to WIDTH - STRIDE + 1 bytes stands whole in a window. Every window is compressed twice,
with the ordinary dictionary alone and with the toxic one behind it; the difference of the two lengths is what the toxic
dictionary saves. Windows that hold a telling piece, GRAM bytes which only the toxic dictionary has, are compressed again
at a high level. A window is a hit if it holds a telling piece and saves at least so many bytes there, at two thresholds,
or if it holds none and saves PLAIN bytes at least (a phrase of ordinary words, for one). A document's score is a logistic
function of the number and share of its hits of each kind, calibrated on training documents that neither dictionary has
seen.

Toxic documents are mostly ordinary text. The toxic dictionary's samples are therefore the excerpts that tell them apart:
the longest runs of bytes that are covered by byte n-grams which far more toxic than ordinary documents have (by
likelihood ratio). Zstandard's trainer makes the dictionary of them. The toxic dictionary is used as the ordinary one's
continuation, because what an ordinary passage costs must be the same on both sides of the comparison.

Cases: null and empty texts have no windows and get the score of a document without any saving; a text shorter than a
window is one window; rows without a usable label are never learnt from; where a document is labelled more than once
the highest label counts; where there is nothing to tell toxic documents by, or no ordinary or no toxic training rows,
every score is the base rate; ties and repeated rows get equal scores; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelmark.llm.shared import LOWERED, UPPER, chunks, field, lanes, mixed, picked, pieces, token_hashes, written

#: Bytes of a window, and from one window's start to the next one's.
WIDTH, STRIDE = 24, 8
#: Zstandard begins no match in an input's last 8 bytes and keeps the smallest inputs raw: each window stands between these.
BEFORE, BEHIND = b"0123456789ABCDEF", b"QRSTUVWX"
#: Lengths of the n-grams that excerpts are made of.
SIZES = (5, 7, 9, 11)
#: An n-gram tells if toxic documents have it so many times as often as ordinary ones, at this log-likelihood ratio, and if
#: it is in so many and in such a share of them: the share makes it the same at every size.
LEAST_LIFT, LEAST_RATIO, LEAST_DOCS, LEAST_SHARE = 12.0, 10.0, 3, 0.015
#: Labelled training rows that are fitted on, at most; one in so many of them calibrates instead of training dictionaries.
FIT_ROWS, CALIBRATE = 20_000, 3
#: Training samples, at most: ordinary windows (of WIDTH bytes), and excerpts by number.
ORDINARY_WINDOWS, EXCERPTS = 150_000, 100_000
#: Bytes of the two dictionaries, at most.
ORDINARY_BYTES, TOXIC_BYTES = 112_640, 16_384
#: What the trainer (COVER) is told: lengths of segments and of what it counts.
ORDINARY_SEGMENT, TOXIC_SEGMENT, COUNTED = 30, 16, 6
#: Levels for windows with a telling piece and for all, and the bytes of a telling piece.
LEVEL, LIGHT, GRAM = 19, 3, 6
#: Text bytes of a task that counts n-grams, about, and hashes that it holds before it adds them up.
TASK_BYTES, TASK_CODES = 4 << 20, 8_000_000
#: Bytes that a window must save to count as a hit, and as a plain one.
SAVINGS = (1, 4)
#: Bytes that a window without a telling piece must save.
PLAIN = 6
#: Deep results that a worker keeps, and windows that are compressed in one call (whose results fit a small buffer).
CACHE_ENTRIES, TOGETHER = 500_000, 2048


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the rows' windows, and the number of windows before each row (and in all)."""
    lens = np.diff(offsets)
    n = np.where(lens > 0, np.maximum(-(-(lens - WIDTH) // STRIDE), 0) + 1, 0)
    rows = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(lens)), n)
    starts = offsets[row] + STRIDE * (np.arange(rows[-1]) - rows[row])
    return starts, np.minimum(starts + WIDTH, offsets[row + 1]), rows


def grams(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """The ``size`` bytes (up to 8) from each place on, as an integer."""
    n = max(len(data) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return out


def slot(codes: np.ndarray) -> np.ndarray:
    """22 bits of a hash of the integers."""
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)


# --- scoring ----------------------------------------------------------------------------------------------------


class Scorer:
    """What the toxic dictionary saves: ``savings`` of every window at LIGHT, ``deep`` of those with a telling piece at
    LEVEL (windows met lately are kept)."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        contents = (ordinary + BEFORE, ordinary + toxic + BEFORE)
        self.light = [_compressor(x, LIGHT, True) for x in contents]
        self.ordinary, self.toxic = (_compressor(x, LEVEL, False) for x in contents)
        of = lambda x: np.unique(grams(np.frombuffer(x, np.uint8)))
        self.own = np.setdiff1d(of(toxic), of(ordinary))
        self.slots = np.zeros(1 << 22, bool)
        self.slots[slot(self.own)] = True
        self.cache: dict[bytes, int] = {}

    def savings(self, text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bytes saved on each window, whatever it holds."""
        out = np.zeros(len(starts), np.int64)
        eight = lanes(np.frombuffer(text, np.uint8))
        full = ends - starts == WIDTH
        short = np.flatnonzero(~full)
        if len(short):
            out[short] = self._saved([BEFORE + text[a:b] + BEHIND for a, b in zip(starts[short].tolist(), ends[short].tolist(), strict=True)])
        whole = np.flatnonzero(full)
        for first in range(0, len(whole), TOGETHER):
            part = whole[first : first + TOGETHER]
            out[part] = self._saved(_framed(eight[starts[part][:, None] + np.arange(0, WIDTH, 8)]))
        return out

    def _saved(self, inputs) -> np.ndarray:
        first, second = (_lengths(c, inputs) for c in self.light)
        return first - second

    def deep(self, data: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bytes saved on windows with a telling piece (GRAM bytes that only the toxic dictionary has); 0 for others."""
        codes, out = grams(data), np.zeros(len(starts), np.int64)
        met = np.flatnonzero(self.slots[slot(codes)])
        met = met[np.isin(codes[met], self.own)]
        some = np.flatnonzero(np.searchsorted(met, ends - (GRAM - 1)) > np.searchsorted(met, starts))
        for i, a, b in zip(some.tolist(), starts[some].tolist(), ends[some].tolist(), strict=True):
            window = text[a:b]
            saved = self.cache.get(window)
            if saved is None:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                whole = BEFORE + window + BEHIND
                saved = self.cache[window] = len(self.ordinary.compress(whole)) - len(self.toxic.compress(whole))
            out[i] = saved
        return out


def _compressor(content: bytes, level: int, shared: bool) -> zstandard.ZstdCompressor:
    """``shared``: the dictionary's tables are made once, for inputs of any size; else they suit each input."""
    dictionary = zstandard.ZstdCompressionDict(content)
    if shared:
        dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=dictionary, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)


def _framed(window: np.ndarray):
    """Whole windows (of eight bytes each, side by side) between BEFORE and BEHIND, as ``_lengths`` takes them."""
    size = len(BEFORE) + WIDTH + len(BEHIND)
    rows = np.empty((len(window), size), np.uint8)
    rows[:, : len(BEFORE)], rows[:, -len(BEHIND) :] = np.frombuffer(BEFORE, np.uint8), np.frombuffer(BEHIND, np.uint8)
    rows[:, len(BEFORE) : len(BEFORE) + WIDTH] = np.ascontiguousarray(window).view(np.uint8)
    if not hasattr(zstandard, "BufferWithSegments"):
        return [row.tobytes() for row in rows]
    at = np.stack([np.arange(len(rows)) * size, np.full(len(rows), size)], axis=1).astype(np.uint64)
    return zstandard.BufferWithSegments(rows.tobytes(), at.tobytes())


def _lengths(compressor: zstandard.ZstdCompressor, inputs) -> np.ndarray:
    """Compressed lengths of many short inputs (bytes, or segments of a buffer), by one call where the library has it."""
    if hasattr(compressor, "multi_compress_to_buffer"):
        return np.fromiter(map(len, compressor.multi_compress_to_buffer(inputs)), np.int64, len(inputs))
    return np.fromiter((len(compressor.compress(x)) for x in inputs), np.int64, len(inputs))


_SCORERS: dict[tuple[bytes, bytes], Scorer] = {}


def counted(data: np.ndarray, offsets: np.ndarray, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """For each row: its windows, how many of them hold a telling piece and save at least each of SAVINGS, and how many of
    the others save PLAIN bytes at least."""
    if (ordinary, toxic) not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[ordinary, toxic] = Scorer(ordinary, toxic)
    own, low = _SCORERS[ordinary, toxic], LOWERED[data]
    text = low.tobytes()
    starts, ends, rows = windows(offsets)
    # What saves something at the high level is no plain hit, whatever it saves at the low one.
    saved, every = own.deep(low, text, starts, ends), np.zeros(len(starts), np.int64)
    rest = np.flatnonzero(saved == 0)
    every[rest] = own.savings(text, starts[rest], ends[rest])
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in (*(saved >= k for k in SAVINGS), (saved == 0) & (every >= PLAIN))]
    return np.stack([np.diff(rows), *(s[rows[1:]] - s[rows[:-1]] for s in sums)], axis=1)


#: Columns of ``counted``.
COUNTS = 2 + len(SAVINGS)


def inputs(table: np.ndarray) -> np.ndarray:
    """What the logistic function takes of ``counted``: share and number of hits, on log scales, of each kind, and 1."""
    n = np.maximum(table[:, 0], 1)
    return np.stack([f for h in table[:, 1:].T for f in (np.log(h / n + 2e-3), np.log1p(h))] + [np.ones(len(table))], axis=1)


def logistic(x: np.ndarray, weights) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.asarray(weights), -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = logistic(x, w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


# --- training ---------------------------------------------------------------------------------------------------


def held_out(column: str = "id"):
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic and calibrates of at most ``fit_rows`` labelled rows outside the held-out ones, chosen by a hash
    of the id; equal texts are one row with the highest label."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where("id is not null and toxic in (0, 1)").where(~held_out())
    own = own.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    # The sample has ``fit_rows`` rows at most, so it may be broadcast.
    found = picked(docs, id=id_col, text=text_col).join(F.broadcast(own), "id")
    # Copies are learnt from once, so that a text with many of them tells no more than another; all are on one side.
    low = F.translate("text", UPPER.decode(), UPPER.lower().decode())
    found = found.groupBy(low.alias("text")).agg(F.max("toxic").alias("toxic"))
    side = F.pmod(F.xxhash64(F.substring("text", 1, 100)), F.lit(CALIBRATE)) == 0
    return found.select("text", "toxic", F.coalesce(side, F.lit(False)).alias("calibrates"))


def gram_codes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (the size's number in the last bits), places and rows of all n-grams of ``size`` bytes."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = mixed(grams(data, min(size, 8))[:n] + np.uint64(size))
    if size > 8:
        codes = mixed(codes ^ grams(data, size - 8)[8 : 8 + n])
    codes = codes & ~np.uint64(7) | np.uint64(SIZES.index(size))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    at = np.flatnonzero(np.arange(n) + size <= offsets[row + 1])
    return codes[at], at, row[at]


def among(codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the codes that are in ``wanted`` (sorted). A table of 22 of their bits rules most out."""
    top = np.zeros(1 << 22, bool)
    top[wanted >> np.uint64(42)] = True
    at = np.flatnonzero(top[codes >> np.uint64(42)])
    found = np.minimum(np.searchsorted(wanted, codes[at]), max(len(wanted) - 1, 0))
    return at[wanted[found] == codes[at]] if len(wanted) else at[:0]


def grams_by_document(batches: Iterator[pa.RecordBatch], wanted: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """For each piece of the text and each of SIZES, the n-grams' hashes (those in ``wanted``, if it is given), each once for
    each document that has it."""
    for data, offsets, _ in pieces(batches):
        for size in SIZES:
            codes, _, row = gram_codes(LOWERED[data], offsets, size)
            if wanted is not None:
                at = among(codes, wanted)
                codes, row = codes[at], row[at]
            yield codes[np.unique(codes ^ mixed(row.astype(np.uint64) + np.uint64(1)), return_index=True)[1]]


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes, and the sums of their counts."""
    own, which = np.unique(np.concatenate(codes), return_inverse=True)
    return own, np.bincount(which, np.concatenate(counts), len(own)).astype(np.int64)


def telling_grams(rows: DataFrame, n_toxic: int, n_ordinary: int) -> np.ndarray:
    """Hashes of the n-grams that far more toxic than ordinary documents have.

    N-grams are counted by document, over the training rows alone: those of toxic documents first, then of these the ones
    that could still tell in ordinary documents. A task adds up all its documents before anything is shuffled.
    """
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    part = lambda toxic: rows.where(F.col("toxic") == toxic).select("text").coalesce(max(1, (sizes.get(toxic) or 0) // TASK_BYTES))

    def in_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for own in grams_by_document(batches):
            codes.append(own)
            counts.append(np.ones(len(own), np.int64))
            held += len(own)
            if held > TASK_CODES:
                merged = summed(codes, counts)
                codes, counts, held = [merged[0]], [merged[1]], 0
        own, t = summed(codes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(t)], names=["code", "t"])

    def likelihood(k, n, p):  # of k among n at the rate p, as a logarithm
        return k * np.log(np.maximum(p, 1e-12)) + (n - k) * np.log(np.maximum(1 - p, 1e-12))

    def ratio(t, o):
        both = (t + o) / (n_toxic + n_ordinary)
        return likelihood(t, n_toxic, t / n_toxic) + likelihood(o, n_ordinary, o / n_ordinary) - likelihood(t, n_toxic, both) - likelihood(o, n_ordinary, both)

    least = next((t for t in range(max(LEAST_DOCS, math.ceil(LEAST_SHARE * n_toxic)), n_toxic + 1) if ratio(t, 0) > LEAST_RATIO), n_toxic + 1)
    found = part(1).mapInArrow(in_toxic, "code bigint, t bigint").groupBy("code").agg(F.sum("t").alias("t")).where(F.col("t") >= least).toArrow()
    codes, t = found["code"].to_numpy().view(np.uint64), found["t"].to_numpy()
    order = np.argsort(codes)
    codes, t = codes[order], t[order]
    if not len(codes):
        return codes
    sent = rows.sparkSession.sparkContext.broadcast(codes)

    def in_ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        o = np.zeros(len(wanted), np.int64)
        for own in grams_by_document(batches, wanted):
            o += np.bincount(np.searchsorted(wanted, own), minlength=len(wanted))
        met = np.flatnonzero(o)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(o[met])], names=["place", "o"])

    found = part(0).mapInArrow(in_ordinary, "place bigint, o bigint").groupBy("place").agg(F.sum("o").alias("o")).toArrow()
    o = np.zeros(len(codes), np.int64)
    o[found["place"].to_numpy()] = found["o"].to_numpy()
    return codes[(t / n_toxic > LEAST_LIFT * o / n_ordinary) & (ratio(t, o) > LEAST_RATIO)]


def covered(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Starts and ends of the longest runs that n-grams in ``wanted`` cover; a run does not go from one row into the next."""
    depth = np.zeros(len(data) + 1, np.int64)
    for size in SIZES:
        codes, at, _ = gram_codes(data, offsets, size)
        at = at[among(codes, wanted)]
        depth += np.bincount(at, minlength=len(depth)) - np.bincount(at + size, minlength=len(depth))
    inside = np.cumsum(depth[:-1]) > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    cut = np.flatnonzero(edge)
    return np.stack([cut[:-1], cut[1:]], axis=1)[inside[cut[:-1]]] if len(data) else np.zeros((0, 2), np.int64)


def samples(rows: DataFrame, wanted: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Windows of ordinary documents and excerpts of toxic ones: ORDINARY_WINDOWS and EXCERPTS at most, by a hash of each.

    Windows are many times the text, so that a task leaves out at once those beyond the share that is wanted.
    """
    total = rows.where("toxic = 0").select(F.sum(F.octet_length("text"))).first()[0] or 0
    below = np.uint64(min(1.0, 1.2 * ORDINARY_WINDOWS * STRIDE / max(total, 1)) * (2**64 - 2048))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, batch in pieces(batches):
            low, text = LOWERED[data], LOWERED[data].tobytes()
            toxic = batch["toxic"].to_numpy(zero_copy_only=False) == 1
            own = low[np.repeat(toxic, np.diff(offsets))]
            spans = covered(own, np.concatenate([[0], np.cumsum(np.diff(offsets)[toxic])]), wanted)
            own = own.tobytes()
            starts, ends, before = windows(offsets)
            plain = ~np.repeat(toxic, np.diff(before))
            starts, ends = starts[plain], ends[plain]
            some = token_hashes(data, starts, ends) < below
            found = [own[a:b] for a, b in spans.tolist()] + [text[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)) < len(spans)), pa.array(found, pa.binary())], names=["toxic", "body"])

    cuts = written(rows.mapInArrow(cut, "toxic boolean, body binary"), "samples")

    def some(toxic: bool, most: int) -> list[bytes]:
        return [bytes(r.body) for r in cuts.where(F.col("toxic") == toxic).select("body").orderBy(F.xxhash64("body"), "body").limit(most).collect()]

    return some(False, ORDINARY_WINDOWS), some(True, EXCERPTS)


def fit(rows: DataFrame) -> Model:
    """Trains both dictionaries and the calibration on ``rows`` (text, toxic, calibrates)."""
    rows = written(rows, "training")  # FIT_ROWS at most
    totals = {(r.toxic, r.calibrates): r["count"] for r in rows.groupBy("toxic", "calibrates").count().collect()}
    n_toxic, n_ordinary = totals.get((1, False), 0), totals.get((0, False), 0)
    every = [sum(n for (t, _), n in totals.items() if t == k) for k in (0, 1)]
    rate = math.log((every[1] + 0.5) / (every[0] + 0.5))
    nothing = Model(b"", b"", (*[0.0] * 2 * (COUNTS - 1), rate))
    if not n_toxic or not n_ordinary:
        return nothing
    train = rows.where("not calibrates")
    wanted = telling_grams(train, n_toxic, n_ordinary)
    plain, excerpts = samples(train, wanted)
    if not len(wanted) or not (ordinary := trained(plain, ORDINARY_BYTES, ORDINARY_SEGMENT)) or not (toxic := trained(excerpts, TOXIC_BYTES, TOXIC_SEGMENT)):
        return nothing

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array(counted(data, offsets, ordinary, toxic).tolist(), pa.list_(pa.int64()))], names=["toxic", "counts"])

    seen = rows.where("calibrates").mapInArrow(count, "toxic int, counts array<bigint>").collect()  # FIT_ROWS at most
    y = np.array([r.toxic for r in seen], float)
    if not y.size or y.all() or not y.any():
        return nothing
    table = np.array([r.counts for r in seen], np.int64).reshape(-1, COUNTS)
    return Model(ordinary, toxic, tuple(float(x) for x in fitted(inputs(table), y)))


def trained(found: list[bytes], size: int, segment: int) -> bytes:
    """Zstandard's dictionary of the samples; empty where they are too few for its trainer."""
    if sum(map(len, found)) < 8 * segment or len(found) < 8:
        return b""
    try:
        return zstandard.train_dictionary(size, found, k=segment, d=COUNTED).as_bytes()
    except zstandard.ZstdError:
        return b""


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id``, held_out, score, predicted, n_windows, n_hits (windows that save anything)."""
    rows = picked(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data, offsets, batch in pieces(batches):
            table = counted(data, offsets, model.ordinary, model.toxic) if model.toxic else np.zeros((len(batch), COUNTS), np.int64)
            scores = logistic(inputs(table), model.weights)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(scores, pa.float64()), pa.array(table[:, 0], pa.int64()), pa.array(table[:, 1], pa.int64())], names=["id", "score", "n_windows", "n_hits"])

    scored = rows.mapInArrow(run, f"id {field(rows, 'id')}, score double, n_windows bigint, n_hits bigint")
    return scored.select(F.col("id").alias(id_col), held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows", "n_hits")
