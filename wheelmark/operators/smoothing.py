"""Smoothed speed, deceleration and jerk with their variances: local polynomials of any order, and a Gaussian process.

``local`` fits a polynomial around each sample by weighted least squares. Its normal equations are factored in plain
column expressions, so that value, slope and curvature come with their variances and without a UDF; a sample's row holds
its window only. ``process`` solves one kernel system for each stretch of a flight and reads mean, first and second
derivative off it through the kernel's derivatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wheelmark.functions.exprs import KT_TO_MPS, Steps, with_steps
from wheelmark.functions.flights import BLOCK, in_flights, numbers

#: Length scales beyond which a sample has no weight, the order of kernel-weighted polynomials, samples that a reliable
#: window needs.
SUPPORT, GP_ORDER, LEAST_IN_WINDOW = 3.0, 2, 5
#: Samples of a stretch that is solved at once, and length scales of neighbours on either side of it that take part.
STRETCH, HALO = 200, 6.0
COLUMNS = ("flight_id", "i", "t", "value", "decel", "jerk", "value_var", "decel_var", "jerk_var", "n", "weight")


def _samples(velocities: DataFrame, knees: DataFrame | None) -> DataFrame:
    """flight_id, i, t, v (m/s) and side of the knee, of samples with time and speed."""
    rows = velocities.where("gs_kt IS NOT NULL AND t IS NOT NULL").selectExpr("flight_id", "row_number() OVER (PARTITION BY flight_id ORDER BY t, seq) - 1 AS i", "t", f"gs_kt * {KT_TO_MPS} AS v")
    if knees is None:
        return rows.withColumn("side", F.lit(0))
    rows = rows.join(knees.select("flight_id", F.col("t_knee").alias("knee")), "flight_id", "left")
    return rows.withColumn("side", F.coalesce((F.col("t") >= F.col("knee")).cast("int"), F.lit(0))).drop("knee")


def factored(order: int) -> Steps:
    """LDL' of the normal matrix of powers 0 to ``order`` (sums m0, m1, ... of weighted powers, r0, r1, ... with values).

    Gives coefficients c0.., diagonals of the inverse q0.. up to the second power. A fit with the effective order ``eff``
    below ``order`` has unit rows for the powers beyond, whose coefficients are 0.
    """
    k = order + 1
    entry = lambda i, j: f"m{i + j}" if max(i, j) < 2 else f"CASE WHEN eff >= {max(i, j)} THEN m{i + j} ELSE {1.0 if i == j else 0.0}e0 END".replace(".0e0", "e0")
    steps: Steps = []
    for j in range(k):
        steps.append((f"d{j}", " - ".join([f"({entry(j, j)})", *[f"l{j}{p} * l{j}{p} * d{p}" for p in range(j)]])))
        for i in range(j + 1, k):
            steps.append((f"l{i}{j}", f"({' - '.join([f'({entry(i, j)})', *[f'l{i}{p} * l{j}{p} * d{p}' for p in range(j)]])}) / nullif(d{j}, 0e0)"))
    # The inverse of L, row by row: g_ij = -sum(l_ip g_pj).
    for i in range(k):
        for j in range(i):
            steps.append((f"g{i}{j}", f"-({' + '.join([f'l{i}{j}', *[f'l{i}{p} * g{p}{j}' for p in range(j + 1, i)]])})"))
        right = lambda j: f"r{j}" if j < 2 else f"CASE WHEN eff >= {j} THEN r{j} ELSE 0e0 END"
        steps.append((f"z{i}", f"({' + '.join([f'({right(i)})', *[f'g{i}{j} * ({right(j)})' for j in range(i)]])}) / nullif(d{i}, 0e0)"))
    for j in range(k):
        steps.append((f"c{j}", " + ".join([f"z{j}", *[f"g{i}{j} * z{i}" for i in range(j + 1, k)]])))
    for j in range(min(k, 3)):
        steps.append((f"q{j}", " + ".join([f"1e0 / nullif(d{j}, 0e0)", *[f"g{i}{j} * g{i}{j} / nullif(d{i}, 0e0)" for i in range(j + 1, k)]])))
    return steps


def local(velocities: DataFrame, method: str = "savgol", window: int = 7, order: int = 3, length_s: float = 8.0, noise: float = 0.5, knees: DataFrame | None = None) -> DataFrame:
    """COLUMNS for each sample with a speed: the fit at its time. ``savgol``: equal weights on the nearest ``window``
    samples (the earlier of equally near ones). ``gp``: quadratic with normal weights of width ``length_s`` on samples
    within SUPPORT widths, and a variance of the slope of ``noise`` over the weights at least. With ``knees`` (flight_id,
    t_knee) a window stays on its side of the knee. The order falls to what a small window can hold; without two samples
    there is no slope; jerk is 0 without variance where there is no curvature.
    """
    if method not in ("savgol", "gp") or order < 1:
        raise ValueError(f"{method!r}, order {order}: savgol or gp, and an order of 1 at least")
    order = GP_ORDER if method == "gp" else order
    over, reach = "PARTITION BY flight_id, side ORDER BY t", SUPPORT * length_s + 1e-6  # a microsecond for what rounding does
    frame = f"{over}, i ROWS BETWEEN {window - 1} PRECEDING AND {window - 1} FOLLOWING" if method == "savgol" else f"{over} RANGE BETWEEN {reach}D PRECEDING AND {reach}D FOLLOWING"
    rows = _samples(velocities, knees).selectExpr("flight_id", "i", "t", "v", f"collect_list(named_struct('t', t, 'i', i, 'v', v)) OVER ({frame}) AS near")
    near = "transform(near, x -> named_struct('d', abs(x.t - t), 'i', x.i, 'u', x.t - t, 'y', x.v - v))"
    if method == "savgol":
        near = f"slice(array_sort({near}), 1, {window})"
    rows = rows.withColumn("near", F.expr(near)).withColumn("h", F.expr("greatest(array_max(transform(near, x -> x.d)), 1e-9)" if method == "savgol" else f"{float(length_s)}"))
    weight = "1e0" if method == "savgol" else f"exp(-pow(x.u / {float(length_s)}, 2) / 2e0)"
    rows = rows.withColumn("near", F.expr(f"transform(near, x -> named_struct('u', x.u / h, 'y', x.y, 'w', {weight}))"))
    # All sums of a window in one pass over it.
    names = [f"m{k}" for k in range(2 * order + 1)] + [f"r{k}" for k in range(order + 1)] + ["yy"]
    powers = [f"x.w * pow(x.u, {k})" for k in range(2 * order + 1)] + [f"x.w * pow(x.u, {k}) * x.y" for k in range(order + 1)] + ["x.w * x.y * x.y"]
    zero = ", ".join(f"'{c}', 0e0" for c in names)
    add = ", ".join(f"'{c}', a.{c} + {p}" for c, p in zip(names, powers, strict=True))
    sums = f"aggregate(near, named_struct({zero}), (a, x) -> named_struct({add}))"
    rows = rows.selectExpr("flight_id", "i", "t", "v", "h", "size(near) AS n", f"least({order}, size(near) - 1) AS eff", f"{sums} AS s").select("flight_id", "i", "t", "v", "h", "n", "eff", "s.*")
    steps = factored(order)
    kept = [f"c{k}" for k in range(order + 1)] + [f"q{k}" for k in range(min(order + 1, 3))]
    rows = with_steps(rows, steps, keep=tuple(kept))
    left = " - ".join(["yy", *[f"c{k} * r{k}" if k < 2 else f"CASE WHEN eff >= {k} THEN c{k} * r{k} ELSE 0e0 END" for k in range(order + 1)]])
    rows = rows.withColumn("s2", F.expr(f"greatest({left}, 0e0) / (m0 / n * greatest(n - eff - 1, 1))"))
    slope_var = "s2 * q1 / (h * h)" if method == "savgol" else f"greatest(s2 * q1 / (h * h), {float(noise)} / greatest(m0, 1e-9))"
    curved = order >= 2
    jerk = "CASE WHEN eff >= 2 THEN 2e0 * c2 / (h * h) WHEN eff = 1 THEN 0e0 END" if curved else "CASE WHEN eff = 1 THEN 0e0 END"
    jerk_var = "CASE WHEN eff >= 2 THEN 4e0 * s2 * q2 / pow(h, 4) END" if curved else "CAST(NULL AS DOUBLE)"
    return rows.selectExpr("flight_id", "i", "t", "v + c0 AS value", "CASE WHEN eff >= 1 THEN c1 / h END AS decel", f"{jerk} AS jerk", "s2 * q0 AS value_var", f"CASE WHEN eff >= 1 THEN {slope_var} END AS decel_var", f"{jerk_var} AS jerk_var", "CAST(n AS INT) AS n", "m0 AS weight")


def solved(t: np.ndarray, v: np.ndarray, at: np.ndarray, length: float, noise: float) -> tuple[np.ndarray, ...]:
    """Mean, first and second derivative of the process at times ``at``, and their variances; rows are stretches of equal
    size, solved together.

    Squared-exponential kernel around a line through the samples; the signal's variance is that of what the line leaves,
    less the noise, and a tenth of it at least.
    """
    n = t.shape[1]
    mid, mean = t.mean(axis=1, keepdims=True), v.mean(axis=1, keepdims=True)
    u, w = t - mid, at - mid
    uu = (u * u).sum(axis=1, keepdims=True)
    slope = np.where(uu > 0, (u * (v - mean)).sum(axis=1, keepdims=True) / np.where(uu > 0, uu, 1.0), 0.0)
    rest = v - mean - slope * u
    power = np.maximum(np.maximum((rest * rest).sum(axis=1) / n - noise, 0.1 * noise), 1e-12)[:, None, None]
    kernel = power * np.exp(-(((u[:, :, None] - u[:, None, :]) / length) ** 2) / 2)
    low = np.linalg.cholesky(kernel + noise * np.eye(n))
    inverse = np.linalg.solve(low, np.broadcast_to(np.eye(n), low.shape))
    alpha = np.swapaxes(inverse, 1, 2) @ (inverse @ rest[:, :, None])
    d = w[:, :, None] - u[:, None, :]
    k0 = power * np.exp(-((d / length) ** 2) / 2)
    k1, k2 = -d / length**2 * k0, (d**2 / length**4 - 1 / length**2) * k0
    prior = (power, power / length**2, 3 * power / length**4)
    var = [np.maximum(p[:, :, 0] - ((k @ np.swapaxes(inverse, 1, 2)) ** 2).sum(axis=2), 0.0) for p, k in zip(prior, (k0, k1, k2), strict=True)]
    mean_at = [(k @ alpha)[:, :, 0] for k in (k0, k1, k2)]
    return mean + slope * w + mean_at[0], slope + mean_at[1], mean_at[2], *var


def process(velocities: DataFrame, length_s: float = 8.0, noise: float = 0.5, knees: DataFrame | None = None) -> DataFrame:
    """COLUMNS from a Gaussian process over each side of each flight (weight: 0; n: samples that took part).

    A side of more than STRETCH samples is solved stretch by stretch, each with its neighbours within HALO length scales,
    so that no system grows with a flight. Stretches of equal size in a batch of flights are solved together.
    """
    rows = _samples(velocities, knees)

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        t, v, side = numbers(batch, "t"), numbers(batch, "v"), numbers(batch, "side")
        starts = np.union1d(starts, np.flatnonzero(side[1:] != side[:-1]) + 1)
        sizes = np.diff(np.append(starts, len(t)))
        first = np.concatenate([np.arange(a, a + n, STRETCH) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        last = np.minimum(first + STRETCH, np.append(first[1:], len(t)))
        low, high = first.copy(), last.copy()
        for k in np.flatnonzero(np.repeat(sizes, -(-sizes // STRETCH)) > STRETCH).tolist():  # only these have neighbours
            p = np.searchsorted(starts, first[k], "right") - 1
            own = t[starts[p] : starts[p] + sizes[p]]
            low[k] = starts[p] + np.searchsorted(own, t[first[k]] - HALO * length_s)
            high[k] = starts[p] + np.searchsorted(own, t[last[k] - 1] + HALO * length_s, "right")
        found = np.full((7, len(t)), np.nan)
        found[6] = np.repeat(high - low, last - first)
        found[0] = v
        shapes = (high - low) * (STRETCH + 1) + (last - first)
        for shape in np.unique(shapes[high - low >= 2]).tolist():
            same = np.flatnonzero(shapes == shape)
            n = int(high[same[0]] - low[same[0]])
            for some in np.array_split(same, -(-len(same) * n * n // BLOCK)):
                if len(some):
                    at = first[some, None] + np.arange(last[some[0]] - first[some[0]])
                    x = low[some, None] + np.arange(n)
                    for row, values in enumerate(solved(t[x], v[x], t[at], length_s, noise)):
                        found[row, at] = values
        made = [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in found[:6]]
        return pa.RecordBatch.from_arrays([batch["flight_id"], batch["i"], batch["t"], *made, pa.array(found[6].astype(np.int32)), pa.array(np.zeros(len(t)))], names=list(COLUMNS))

    return in_flights(rows, [F.col("side"), F.col("t"), F.col("i")], run, "flight_id string, i int, t double, value double, decel double, jerk double, value_var double, decel_var double, jerk_var double, n int, weight double")


def smoothed_derivatives(velocities: DataFrame, method: str = "savgol", window: int = 7, order: int = 3, length_s: float = 8.0, noise: float = 0.5, knees: DataFrame | None = None) -> DataFrame:
    """``savgol`` and ``gp`` (a local quadratic with normal weights): see ``local``; ``process``: a Gaussian process."""
    if method == "process":
        return process(velocities, length_s, noise, knees)
    return local(velocities, method, window, order, length_s, noise, knees)


def reliability(smoothed: DataFrame) -> DataFrame:
    """flight_id, window_samples (their median), min_in_window, reliable: samples and windows of LEAST_IN_WINDOW at least."""
    rows = smoothed.groupBy("flight_id").agg(F.expr("CAST(floor(percentile(n, 0.5)) AS INT)").alias("window_samples"), F.min("n").alias("min_in_window"), F.count("*").alias("n"))
    return rows.select("flight_id", "window_samples", "min_in_window", (F.least("n", "min_in_window") >= LEAST_IN_WINDOW).alias("reliable"))
