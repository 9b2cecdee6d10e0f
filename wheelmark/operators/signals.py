"""Segmented regression and local polynomial derivatives of ground speed."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelmark.functions.exprs import KT_TO_MPS
from wheelmark.functions.flights import alike, in_flights, numbers

#: Smallest samples on either side of a knot, and bounds of the knot grid.
SIDE, MOST_KNOTS, LEAST_KNOTS, KNOTS_PER_SAMPLE = 2, 400, 60, 12


#: What a sample's row brings to the search of its knots.
KNOT_INPUTS = ("i0", "i1", "j", "u", "low", "step", "n", "m", "s1", "s2", "sv", "suv", "tuu", "tuv", "tvv")


def best_knots(rows: pd.DataFrame) -> pd.DataFrame:
    """For each sample's row the knot from i0 to i1 with the least squared residuals, the first of equal ones: rss (to 6
    digits), i, exact; null where none is usable. All knots of a batch are one array.

    Of the hinge h = (u - k)+ beside [1, u], where u and v are centred, c is what h has in common with what a line leaves of
    v, and d what a line leaves of h; c / d is the change of slope.
    """
    x = {c: rows[c].to_numpy(float) for c in KNOT_INPUTS}
    many = (x["i1"] - x["i0"]).astype(np.int64) + 1
    row = np.repeat(np.arange(len(rows)), many)
    i = np.arange(len(row)) - np.repeat(np.cumsum(many) - many - x["i0"].astype(np.int64), many)
    j, u, low, step, n, m, s1, s2, sv, suv, tuu, tuv, tvv = (x[c][row] for c in KNOT_INPUTS[2:])
    k = low + i * step
    suh = s2 - k * s1
    with np.errstate(all="ignore"):
        c = suv - k * sv - tuv / tuu * suh
        d = s2 - 2.0 * k * s1 + m * k * k - (s1 - m * k) ** 2 / n - suh * suh / tuu
        exact = np.maximum(tvv - tuv * tuv / tuu - c * c / d, 0.0)
    usable = np.flatnonzero((j + (k > u) >= SIDE) & (d != 0))
    out = pd.DataFrame({"rss": np.nan, "i": pd.array([None] * len(rows), "Int64"), "exact": np.nan})
    if len(usable):
        row, i, exact = row[usable], i[usable], exact[usable]
        rss = np.floor(exact * 1e6 + 0.5) / 1e6
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.repeat(np.fmin.reduceat(rss, first), np.diff(np.append(first, len(row))))
        best = np.flatnonzero((rss == least) | np.isnan(least))
        best = best[np.concatenate([[True], row[best[1:]] != row[best[:-1]]])]
        out.loc[row[best], "rss"], out.loc[row[best], "exact"] = rss[best], exact[best]
        out.loc[row[best], "i"] = i[best]
    return out


def knee(velocities: DataFrame) -> DataFrame:
    """The two-segment fit of each flight's speed with the least squared residuals over a grid of knots.

    flight_id, n, t_knee, slope_before, slope_after, slope_drop, v_knee (m/s), rms. Between two samples the residuals
    depend on the knot in closed form, through sums over the samples behind it: each sample takes the best of the knots up
    to the next one (``best_knots``, over whole batches of flights), and the flight the best of its samples.
    """
    known = velocities.where("gs_kt IS NOT NULL AND t IS NOT NULL").select("flight_id", F.struct("t", "seq", F.expr(f"gs_kt * {KT_TO_MPS}").alias("v")).alias("s"))
    held = known.groupBy("flight_id").agg(F.sort_array(F.collect_list("s")).alias("s")).where("size(s) >= 4")
    fits = F.arrow_udf(_knees, "n int, t_knee double, slope_before double, slope_after double, slope_drop double, v_knee double, rms double")
    return held.select("flight_id", fits("s.t", "s.v").alias("f")).where("f IS NOT NULL").select("flight_id", "f.*")


def _knees(t: pa.Array, v: pa.Array) -> pa.Array:
    """The fit of each flight's sorted samples, null where no knot is usable."""
    sizes, flat = t.value_lengths().to_numpy(zero_copy_only=False), [x.flatten().to_numpy(zero_copy_only=False) for x in (t, v)]
    fields = ("n", "t_knee", "slope_before", "slope_after", "slope_drop", "v_knee", "rms")
    out = np.full((len(fields), len(sizes)), np.nan)
    for flights, at in alike(np.cumsum(sizes) - sizes, sizes):
        out[:, flights] = _knees_of(*[x[at] for x in flat])
    none = np.isnan(out[0])
    return pa.StructArray.from_arrays([pa.array(np.where(none, 0, out[0]).astype(np.int32)), *map(pa.array, out[1:])], names=fields, mask=pa.array(none))


def _knees_of(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """n, t_knee, slopes before and after, their drop, speed at the knee and rms of flights of equal size; NaN for none."""
    m, n = t.shape
    total = lambda x: np.cumsum(x, axis=1)[:, -1]
    tm, vm = total(t) / n, total(v) / n
    u, v = t - tm[:, None], v - vm[:, None]
    behind = lambda x: np.cumsum(x[:, :0:-1], axis=1)[:, ::-1]  # of the samples after each but the last
    own = {"s1": behind(u), "s2": behind(u * u), "sv": behind(v), "suv": behind(u * v), "m": np.broadcast_to(np.arange(n - 1, 0, -1.0), (m, n - 1)), "j": np.broadcast_to(np.arange(n - 1.0), (m, n - 1)), "u": u[:, :-1]}
    knots = min(MOST_KNOTS, max(LEAST_KNOTS, KNOTS_PER_SAMPLE * n))
    low, step = u[:, 1], (u[:, -2] - u[:, 1]) / (knots - 1)
    each = {"low": low, "step": step, "n": np.full(m, float(n)), "tuu": total(u * u), "tuv": total(u * v), "tvv": total(v * v)}
    own |= {c: np.broadcast_to(x[:, None], (m, n - 1)) for c, x in each.items()}
    with np.errstate(all="ignore"):
        own["i0"] = np.maximum(np.ceil((u[:, :-1] - low[:, None]) / step[:, None]), 0.0)
        own["i1"] = np.minimum(np.ceil((u[:, 1:] - low[:, None]) / step[:, None]) - 1, knots - 1.0)
    usable = (own["step"] > 0) & (own["tuu"] > 0) & (own["i1"] >= own["i0"]) & (n - 1 - own["j"] >= SIDE)
    out = np.full((7, m), np.nan)
    flight = np.nonzero(usable)[0]
    if not len(flight):
        return out
    rows = pd.DataFrame({c: x[usable] for c, x in own.items()})
    rows = rows.join(best_knots(rows))
    rows["flight"] = flight
    best = rows[rows["i"].notna()].sort_values(["flight", "rss", "i"], kind="stable").drop_duplicates("flight")
    at = best["flight"].to_numpy()
    x = {c: best[c].to_numpy(float) for c in (*KNOT_INPUTS, "i", "exact")}
    k = x["low"] + x["i"] * x["step"]
    suh = x["s2"] - k * x["s1"]
    with np.errstate(all="ignore"):
        d = x["s2"] - 2.0 * k * x["s1"] + x["m"] * k * k - (x["s1"] - x["m"] * k) ** 2 / n - suh * suh / x["tuu"]
        b2 = (x["suv"] - k * x["sv"] - x["tuv"] / x["tuu"] * suh) / d
        b1 = (x["tuv"] - b2 * suh) / x["tuu"]
        b0 = -b2 * (x["s1"] - x["m"] * k) / n
        out[:, at] = np.full(len(at), n), tm[at] + k, b1, b1 + b2, -b2, vm[at] + b0 + b1 * k, np.sqrt(x["exact"] / n)
    return out


def three_segments(velocities: DataFrame) -> DataFrame:
    """The three-segment fit: flight_id, n, t_knee (the knot with the larger fall of slope), t_first, t_second, rms.

    A pair of knots leaves two equations once a line has been taken off its hinges, and all pairs of a flight are solved
    in closed form. Flights come in whole batches.
    """

    def fit(u: np.ndarray, v: np.ndarray) -> tuple | None:
        n = len(u)
        if n < 6:
            return None
        knots = np.linspace(u[1], u[-2], min(60, max(20, 4 * n)))
        before, until = (u < knots[:, None]).sum(axis=1), (u <= knots[:, None]).sum(axis=1)
        inside = (before >= SIDE) & (n - until >= SIDE)
        knots, before, until = knots[inside], before[inside], until[inside]
        i, j = np.triu_indices(len(knots), 1)
        ok = until[i] + SIDE <= before[j]
        i, j = i[ok], j[ok]
        if not len(i):
            return None
        line, level = np.stack([np.ones(n), u - u.mean()]), v - v.mean()
        hinges = np.maximum(u[None, :] - knots[:, None], 0)
        off = lambda x: x - x.mean(axis=-1, keepdims=True) - (x @ line[1])[..., None] / (line[1] @ line[1]) * line[1]
        rest, own = off(level), off(hinges)
        products, right = own @ own.T, own @ rest
        a, b, c = products[i, i], products[j, j], products[i, j]
        det = a * b - c * c
        with np.errstate(all="ignore"):
            left = float(rest @ rest) - (right[i] ** 2 * b - 2 * right[i] * right[j] * c + right[j] ** 2 * a) / det
        best = int(np.argmin(np.where(det > 1e-12 * a * b, np.round(left, 9), np.inf)))
        basis = np.concatenate([line, hinges[[i[best], j[best]]]])
        beta = np.linalg.pinv(basis @ basis.T, hermitian=True) @ (basis @ level)
        first, second = knots[i[best]], knots[j[best]]
        return n, first if -beta[2] >= -beta[3] else second, first, second, float(np.sqrt(((level - beta @ basis) ** 2).sum() / n))

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        t, v = numbers(batch, "t"), numbers(batch, "v")
        ends = np.append(starts[1:], len(t))
        fits = [(a, f) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if (f := fit(t[a:b] - t[a], v[a:b]))]
        at = np.array([a for a, _ in fits], np.int64)
        n, *knots, rms = np.array([f for _, f in fits], float).reshape(-1, 5).T
        return pa.RecordBatch.from_arrays([batch["flight_id"].take(pa.array(at)), pa.array(n.astype(np.int32)), *[pa.array(t[at] + k) for k in knots], pa.array(rms)], names=["flight_id", "n", "t_knee", "t_first", "t_second", "rms"])

    known = velocities.where("gs_kt IS NOT NULL AND t IS NOT NULL").selectExpr("flight_id", "t", "seq", f"gs_kt * {KT_TO_MPS} AS v")
    return in_flights(known, [F.col("t"), F.col("seq")], run, "flight_id string, n int, t_knee double, t_first double, t_second double, rms double")


def _local(t: np.ndarray, v: np.ndarray, part: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """At each sample (in order) the quadratic through the nearest ``window`` ones of its part: slope, second coefficient,
    number of samples, and the determinant, 0 where there is none."""
    here = np.arange(len(t))[:, None]
    # The nearest are neighbours in the order of time: a sample's candidates are those within window - 1 places.
    place = here + np.arange(1 - window, window)
    at = np.clip(place, 0, len(t) - 1)
    inside = (place == at) & (part[at] == part[:, None])
    near = np.argsort(np.where(inside, np.abs(t[at] - t[:, None]), np.inf), axis=1, kind="stable")[:, :window]
    at, w = np.take_along_axis(at, near, axis=1), np.take_along_axis(inside, near, axis=1).astype(float)
    u, y = (t[at] - t[:, None]) * w, v[at] * w
    n, s1, s2, s3, s4, v0, v1, v2 = (x.sum(axis=1) for x in (w, u, u**2, u**3, u**4, y, u * y, u**2 * y))
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    with np.errstate(all="ignore"):
        b1 = (n * (v1 * s4 - s3 * v2) - v0 * (s1 * s4 - s3 * s2) + s2 * (s1 * v2 - v1 * s2)) / det
        b2 = (n * (s2 * v2 - v1 * s3) - s1 * (s1 * v2 - v1 * s2) + v0 * (s1 * s3 - s2 * s2)) / det
    return b1, b2, n, det


#: Samples whose quadratics are fitted at a time.
FITTED = 1 << 14


def derivative_arrays(velocities: DataFrame, window: int = 5, knees: DataFrame | None = None) -> DataFrame:
    """flight_id and ``d``: what ``derivatives`` gives, as one array of structs a flight, in order of i."""
    known = velocities.where("gs_kt IS NOT NULL AND t IS NOT NULL").select("flight_id", F.struct("t", "seq", F.expr(f"gs_kt * {KT_TO_MPS}").alias("v")).alias("s"))
    held = known.groupBy("flight_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    held = held.withColumn("knee", F.lit(None).cast("double")) if knees is None else held.join(knees.select("flight_id", F.col("t_knee").alias("knee")), "flight_id", "left")

    @F.arrow_udf("array<struct<i: int, t: double, decel: double, jerk: double, n: int>>")
    def fit(t: pa.Array, v: pa.Array, knee: pa.Array) -> pa.Array:
        sizes = t.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        t, v = (x.flatten().to_numpy(zero_copy_only=False) for x in (t, v))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        behind = t >= knee.cast(pa.float64()).to_numpy(zero_copy_only=False)[owner]
        part, found, first = owner * 2 + behind, [], 0
        while first < len(sizes):
            last = max(int(np.searchsorted(ends, ends[first] - sizes[first] + FITTED, "right")), first + 1)
            own = slice(int(ends[first] - sizes[first]), int(ends[last - 1]))
            found.append(_local(t[own], v[own], part[own], window))
            first = last
        b1, b2, n, det = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0)] * 4
        some = np.flatnonzero(det != 0)
        many = np.bincount(owner[some], minlength=len(sizes))
        place = np.arange(len(t)) - (ends - sizes)[owner]
        rows = pa.StructArray.from_arrays([pa.array(place[some].astype(np.int32)), pa.array(t[some]), pa.array(b1[some]), pa.array(2.0 * b2[some]), pa.array(n[some].astype(np.int32))], names=["i", "t", "decel", "jerk", "n"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), rows)

    return held.select("flight_id", fit("s.t", "s.v", "knee").alias("d"))


def derivatives(velocities: DataFrame, window: int = 5, knees: DataFrame | None = None) -> DataFrame:
    """flight_id, i, t, decel (dv/dt, m/s2), jerk, n: from a quadratic through the nearest ``window`` samples.

    Nearest in time, the earlier on ties; with ``knees`` (flight_id, t_knee), only those on the same side of the knee.
    """
    over = Window.partitionBy("flight_id").orderBy("t", "seq")
    known = velocities.where("gs_kt IS NOT NULL AND t IS NOT NULL").withColumn("i", F.row_number().over(over) - 1).selectExpr("flight_id", "i", "t", f"gs_kt * {KT_TO_MPS} AS v")
    side = F.lit(0)
    if knees is not None:
        known = known.join(knees.select("flight_id", F.col("t_knee").alias("knee")), "flight_id", "left")
        side = F.coalesce((F.col("t") >= F.col("knee")).cast("int"), F.lit(0))
    known = known.select("flight_id", "i", "t", "v", side.alias("side"))

    def fit(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        t, v, side = numbers(batch, "t"), numbers(batch, "v"), numbers(batch, "side")
        new = np.zeros(len(t), np.int64)
        new[starts] = 1
        new[1:] |= side[1:] != side[:-1]
        b1, b2, n, det = _local(t, v, np.cumsum(new), window)
        some = pa.array(np.flatnonzero(det != 0))
        own = [pa.array(b1), pa.array(2.0 * b2), pa.array(n.astype(np.int32))]
        return pa.RecordBatch.from_arrays([x.take(some) for x in [*[batch[c] for c in ("flight_id", "i", "t")], *own]], names=["flight_id", "i", "t", "decel", "jerk", "n"])

    return in_flights(known, [F.col("i")], fit, "flight_id string, i int, t double, decel double, jerk double, n int")


def rms_discrepancy(smoothed: DataFrame, reference: DataFrame) -> DataFrame:
    """flight_id, rms: of the difference of two decelerations (flight_id, i, decel), over samples that both have."""
    both = smoothed.select("flight_id", "i", "decel").join(reference.select("flight_id", "i", F.col("decel").alias("other")), ["flight_id", "i"])
    return both.groupBy("flight_id").agg(F.sqrt(F.avg(F.pow(F.col("decel") - F.col("other"), 2))).alias("rms"))
