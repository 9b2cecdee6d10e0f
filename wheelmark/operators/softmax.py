"""A distribution over each flight's samples: a softmax of scores, trained by cross-entropy against soft labels.

Every flight with a label counts. Rows hold one flight each: its samples' channels and labels as arrays, so that the
normaliser never leaves a row; what a sample's surroundings are is worked out from them in each pass, some flights at a
time. A step is one aggregation: tasks work out, for several candidate weights of each ensemble member at once, the loss and its
gradient over their flights; Spark adds them up, and the driver, which holds weights alone, takes the best candidate and
finds the next direction (limited-memory BFGS). Only a candidate with a smaller loss is taken, so that the loss falls
with each step. Members differ by how often each flight counts: Poisson weights by a seeded hash of its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Samples whose surroundings a task holds at once, unless one flight has more.
BLOCK = 1 << 14
#: Shares of the step that are tried at once, steps that the direction remembers, and the ridge on weights.
STEPS, MEMORY, RIDGE = (1.0, 0.3, 0.05), 8, 1e-3
#: Cumulated probabilities of a Poisson number with mean 1.
POISSON = (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317)


@dataclass(frozen=True)
class Inputs:
    """What the scorer reads of a sample: each channel at offsets in the flight's order, standardised, and its square."""

    channels: tuple[tuple[str, tuple[int, ...]], ...]
    means: tuple[float, ...] = ()
    widths: tuple[float, ...] = ()

    @property
    def size(self) -> int:
        return 2 * sum(len(offsets) for _, offsets in self.channels)

    def shifted(self, batch: pa.RecordBatch, sizes: np.ndarray) -> np.ndarray:
        """(channels at their offsets) x samples, NaN for null: beyond a flight's ends, and for null, the sample's own value."""
        ends = np.cumsum(sizes)
        first, last, at = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes), np.arange(ends[-1])
        inside = {k: (at + k >= first) & (at + k < last) for k in {k for _, offsets in self.channels for k in offsets}}
        out = np.empty((self.size // 2, len(at)))
        for row, (name, k) in zip(out, [(c, k) for c, offsets in self.channels for k in offsets], strict=True):
            own = batch[name].flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            row[:] = own
            if k:
                beside = np.roll(own, -k)
                np.copyto(row, beside, where=inside[k] & ~np.isnan(beside))
        return out

    def measured(self, flights: DataFrame) -> Inputs:
        """With the mean and the width of each channel at each offset over all samples."""
        half = self.size // 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, half))
            for batch, sizes in blocks(batches):
                x = self.shifted(batch, sizes)
                known = ~np.isnan(x)
                n = known.sum(axis=1)
                mean = np.where(known, x, 0.0).sum(axis=1) / np.maximum(n, 1)
                total = joined(total, np.stack([n, mean, (np.where(known, x - mean[:, None], 0.0) ** 2).sum(axis=1)]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in total], names=["n", "mean", "squares"])

        found, total = flights.mapInArrow(run, "n double, mean double, squares double").collect(), np.zeros((3, half))
        for k in range(0, len(found), half):
            total = joined(total, np.array(found[k : k + half]).T)
        widths = np.sqrt(total[2] / np.maximum(total[0], 1))
        return Inputs(self.channels, tuple(total[1].tolist()), tuple(np.where(widths > 1e-9, widths, 1.0).tolist()))

    def vectors(self, batch: pa.RecordBatch, sizes: np.ndarray) -> np.ndarray:
        """samples x size: standardised values (null: 0, beyond four widths held there) and their squares."""
        z = self.shifted(batch, sizes)
        z -= np.array(self.means)[:, None]
        z /= np.array(self.widths)[:, None]
        np.nan_to_num(np.clip(z, -4.0, 4.0, out=z), copy=False, nan=0.0)
        return np.concatenate([z, z * z]).T


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts, means and sums of squares around them (rows) of two sets as those of both."""
    n = np.maximum(a[0] + b[0], 1)
    off = b[1] - a[1]
    return np.stack([a[0] + b[0], a[1] + off * b[0] / n, a[2] + b[2] + off * off * a[0] * b[0] / n])


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batches' flights with samples, BLOCK samples at a time (one flight at least), and how many samples each has."""
    for batch in batches:
        ends = np.cumsum(np.asarray(batch["t"].value_lengths().fill_null(0)))
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, before + BLOCK, "right")), at + 1)
            sizes = np.diff(ends[at:to], prepend=before)
            part, at = batch.slice(at, to - at), to
            if not sizes.all():
                part, sizes = part.filter(pa.array(sizes > 0)), sizes[sizes > 0]
            if len(sizes):
                yield part, sizes


def by_flight(rows: DataFrame, inputs: Inputs) -> DataFrame:
    """flight_id, t and the channels, each an array: one row for each flight, samples in order."""
    names = [c for c, _ in inputs.channels]
    samples = rows.select("flight_id", F.struct("i", "t", *[F.col(c).cast("double").alias(c) for c in names]).alias("s"))
    return samples.groupBy("flight_id").agg(F.array_sort(F.collect_list("s")).alias("s")).select("flight_id", *[F.col(f"s.{c}").alias(c) for c in ("t", *names)])


def soft_labels(flights: DataFrame, truth: DataFrame, sigma_s: float) -> DataFrame:
    """Adds y: a normal curve around the true time (flight_id, t_true), normalised over the flight's samples."""
    # A row for each flight is too much to be broadcast, however small Spark takes it to be.
    rows = flights.join(truth.where("t_true IS NOT NULL").hint("merge"), "flight_id")
    # The nearest sample's exponent is taken off first, so that one sample always counts.
    rows = rows.withColumn("e", F.expr(f"transform(t, u -> pow((u - t_true) / {float(sigma_s)}, 2) / 2e0)")).withColumn("e", F.expr("transform(e, v -> exp(array_min(e) - v))"))
    return rows.withColumn("y", F.expr("transform(e, v -> v / aggregate(e, 0e0, (a, b) -> a + b))")).drop("e", "t_true")


def softmax(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores (samples x models) to probabilities within each flight."""
    top = np.repeat(np.maximum.reduceat(scores, starts, axis=0), sizes, axis=0)
    e = np.exp(scores - top)
    return e / np.repeat(np.add.reduceat(e, starts, axis=0), sizes, axis=0)


def losses(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each model (row of ``weights``): the cross-entropy summed over flights, each ``counts`` (flights x models)
    times, and its gradient."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    p = softmax(x @ weights.T, starts, sizes)
    often = np.repeat(counts, sizes, axis=0)
    return -(often * y[:, None] * np.log(np.maximum(p, 1e-300))).sum(axis=0), ((p - y[:, None]) * often).T @ x


def often(seed: int):
    """How often a flight counts for a member: 0, 1, 2, ... with Poisson probabilities, from a hash of its id."""
    u = F.pmod(F.xxhash64(F.lit(int(seed)), "flight_id"), F.lit(1_000_003)) / 1_000_003.0
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return out.cast("double")


def evaluated(rows: DataFrame, inputs: Inputs, weights: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Losses, gradients and total counts of all models in one aggregation over ``rows`` (t, the channels, y, often)."""
    models, size = len(weights), inputs.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((models, size + 2))
        for batch, sizes in blocks(batches):
            y = batch["y"].flatten().to_numpy(zero_copy_only=False)
            counts = batch["often"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)[:, member]
            loss, gradient = losses(inputs.vectors(batch, sizes), y, sizes, weights, counts)
            total += np.column_stack([loss, counts.sum(axis=0), gradient])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "v"])

    found = rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros(models * (size + 2))
    total[found["k"].to_numpy()] = found["v"].to_numpy()
    total = total.reshape(models, size + 2)
    return total[:, 0], total[:, 2:], total[:, 1]


def direction(gradient: np.ndarray, history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The BFGS direction from the last steps and changes of the gradient."""
    q, past = gradient.copy(), []
    for s, g in reversed(history):
        a = (s @ q) / (s @ g)
        past.append(a)
        q -= a * g
    if history:
        s, g = history[-1]
        q *= (s @ g) / (g @ g)
    for (s, g), a in zip(history, reversed(past), strict=True):
        q += (a - (g @ q) / (s @ g)) * s
    return -q


def fit(rows: DataFrame, inputs: Inputs, seeds: tuple[int, ...], steps: int = 40, ridge: float = RIDGE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Weights of each member, and its losses step by step. ``rows`` (``by_flight`` with ``soft_labels``) are read once a
    step, all of them."""
    rows = rows.withColumn("often", F.array(*[often(s) for s in seeds])).drop("flight_id")
    members, size = len(seeds), inputs.size
    at = np.stack([np.random.default_rng(s).normal(0, 0.01, size) for s in seeds])
    loss, gradient, n = evaluated(rows, inputs, at, np.arange(members))
    n = np.maximum(n, 1)
    with_ridge = lambda w, x, g, m: (x / n[m] + ridge / 2 * (w * w).sum(axis=1), g / n[m][:, None] + ridge * w)
    loss, gradient = with_ridge(at, loss, gradient, np.arange(members))
    history: list[list] = [[] for _ in seeds]
    seen, live = [loss.copy()], np.ones(members, bool)
    for _ in range(steps):
        which = np.flatnonzero(live)
        if not len(which):
            break
        ways = {m: direction(gradient[m], history[m]) for m in which}
        if not any(history):  # the first step has no scale yet
            ways = {m: w / max(np.linalg.norm(w), 1e-12) for m, w in ways.items()}
        tried = np.concatenate([[at[m] + s * ways[m] for s in STEPS] for m in which])
        member = np.repeat(which, len(STEPS))
        found = with_ridge(tried, *evaluated(rows, inputs, tried, member)[:2], member)
        for k, m in enumerate(which):
            own = slice(k * len(STEPS), (k + 1) * len(STEPS))
            best = k * len(STEPS) + int(np.argmin(found[0][own]))
            if found[0][best] >= loss[m] - 1e-10:
                live[m] = False
                continue
            step, change = tried[best] - at[m], found[1][best] - gradient[m]
            if step @ change > 1e-12:
                history[m] = [*history[m], (step, change)][-MEMORY:]
            at[m], loss[m], gradient[m] = tried[best], found[0][best], found[1][best]
        seen.append(loss.copy())
    return at, seen


def predict(flights: DataFrame, inputs: Inputs, weights: np.ndarray) -> DataFrame:
    """flight_id, n (samples), t_td (the mean of the members' mean distribution) and sigma_t (that distribution's width,
    and the spread between the members' means)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sizes in blocks(batches):
            starts = np.cumsum(sizes) - sizes
            t = batch["t"].flatten().to_numpy(zero_copy_only=False)
            u = t - np.repeat(t[starts], sizes)
            p = softmax(inputs.vectors(batch, sizes) @ weights.T, starts, sizes)
            mean = np.add.reduceat(p * u[:, None], starts, axis=0)
            var = np.add.reduceat(p * (u[:, None] - np.repeat(mean, sizes, axis=0)) ** 2, starts, axis=0)
            yield pa.RecordBatch.from_arrays([batch["flight_id"], pa.array(sizes, pa.int32()), pa.array(t[starts] + mean.mean(axis=1)), pa.array(np.sqrt(var.mean(axis=1) + 2 * mean.var(axis=1)))], names=["flight_id", "n", "t_td", "sigma_t"])

    return flights.mapInArrow(run, f"flight_id {flights.schema['flight_id'].dataType.simpleString()}, n int, t_td double, sigma_t double")
