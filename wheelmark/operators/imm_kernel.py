"""The sequential part of the filter estimator: steps in time, each for all flights of a batch with as many times."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from wheelmark.functions.flights import alike, numbers

#: Noise of the measurements and of the motion, and the chain's probabilities.
SIGMA_V, SIGMA_H, Q_LONG, Q_VERT = 2.0, 8.0, 0.2, 0.5
STAY_AIR, STAY_GROUND, START_GROUND = 0.9, 0.99, 0.02
MIN_SPEEDS, MIN_HEIGHTS = 4, 3


def filtered(times: np.ndarray, flight: np.ndarray, at: np.ndarray, z: np.ndarray, noise: float, psd: float) -> np.ndarray:
    """Rate at each of ``times`` (flights x times) by a filter of constant rate; measurement z[i] belongs to times[flight[i], at[i]].

    Measurements are in order by flight and time; a filter starts from its flight's first one.
    """
    many, width = times.shape
    code, r = flight * width + at, noise**2
    new = np.concatenate([[True], code[1:] != code[:-1]])
    rank = np.arange(len(code)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    order = np.lexsort((rank, at))
    cuts = np.flatnonzero((np.diff(at[order]) != 0) | (np.diff(rank[order]) != 0)) + 1
    held: dict[int, list[np.ndarray]] = {}
    for rows in np.split(order, cuts):
        held.setdefault(int(at[rows[0]]), []).append(rows)
    x, rate = z[np.searchsorted(flight, np.arange(many))].copy(), np.zeros(many)
    p00, p01, p11 = np.full(many, r), np.zeros(many), np.full(many, 4.0)
    out = np.empty(times.shape)
    for i in range(width):
        if i:
            dt = times[:, i] - times[:, i - 1]
            x = x + dt * rate
            m01 = p01 + dt * p11
            p00, p01, p11 = p00 + dt * p01 + m01 * dt + psd * (dt**3 / 3), m01 + psd * (dt**2 / 2), p11 + psd * dt
        for rows in held.get(i, ()):
            f = flight[rows]
            total = p00[f] + r
            g0, g1, miss = p00[f] / total, p01[f] / total, z[rows] - x[f]
            x[f], rate[f] = x[f] + g0 * miss, rate[f] + g1 * miss
            a, b, c, d = p00[f] - g0 * p00[f], p01[f] - g0 * p01[f], p01[f] - g1 * p00[f], p11[f] - g1 * p01[f]
            p00[f], p01[f], p11[f] = a, (b + c) / 2, d
        out[:, i] = rate
    return out


def on_ground(decel: np.ndarray, climb: np.ndarray | None) -> np.ndarray:
    """The smoothed probability of the ground state at each time (flights x times)."""
    low, high = np.percentile(decel, [20, 90], axis=1)
    near, mid = high - low < 0.5, (low + high) / 2
    low, high = np.where(near, mid - 0.25, low)[:, None], np.where(near, mid + 0.25, high)[:, None]
    spread = np.maximum(0.6 * (high - low), 0.25)
    fit = -0.5 * np.stack([((decel - low) / spread) ** 2, ((decel - high) / spread) ** 2], axis=2)
    if climb is not None:
        down = np.minimum(np.percentile(climb, 20, axis=1), -0.8)[:, None]
        spread = np.maximum(0.6 * np.abs(down), 0.4)
        fit -= 0.5 * np.stack([((climb - down) / spread) ** 2, (climb / spread) ** 2], axis=2)
    emit = np.exp(fit - fit.max(axis=2, keepdims=True))
    step = np.array([[STAY_AIR, 1 - STAY_AIR], [1 - STAY_GROUND, STAY_GROUND]])
    ahead, both = np.empty_like(emit), np.empty(decel.shape)
    now = np.array([[1 - START_GROUND, START_GROUND]])
    for i in range(emit.shape[1]):
        now = (now if i == 0 else now @ step) * emit[:, i]
        now = now / np.maximum(now.sum(axis=1, keepdims=True), 1e-300)
        ahead[:, i] = now
    back = np.ones((len(emit), 2))
    for i in range(emit.shape[1] - 1, -1, -1):
        own = ahead[:, i] * back
        both[:, i] = own[:, 1] / np.maximum(own.sum(axis=1), 1e-300)
        back = (emit[:, i] * back) @ step.T
        back = back / np.maximum(back.sum(axis=1, keepdims=True), 1e-300)
    return both


def estimate(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """flight_id, t_td, sigma_t, reason of whole flights whose events (t, kind, z) are in order."""
    t, z, fast = numbers(batch, "t"), numbers(batch, "z"), numbers(batch, "kind") == 0
    sizes = np.diff(np.append(starts, len(t)))
    flight = np.repeat(np.arange(len(starts)), sizes)
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (flight[1:] != flight[:-1])])
    at = np.cumsum(new) - 1
    first = at[starts]  # a flight's first time, among all times
    at, unique, times = at - first[flight], np.diff(np.append(first, new.sum())), t[new]
    speeds, heights = np.bincount(flight[fast], minlength=len(starts)), np.bincount(flight[~fast], minlength=len(starts))
    t_td, sigma, reason = np.full(len(starts), np.nan), np.full(len(starts), np.nan), np.full(len(starts), None, object)
    reason[speeds < MIN_SPEEDS] = "insufficient_samples"
    for tall in (False, True):
        some = np.flatnonzero((speeds >= MIN_SPEEDS) & ((heights >= MIN_HEIGHTS) == tall))
        for chosen, rows in alike(first[some], unique[some], lambda n: 4 * n):
            chosen, own = some[chosen], times[rows]
            place = np.full(len(starts), -1)
            place[chosen] = np.arange(len(chosen))
            mine = place[flight] >= 0
            rate = lambda k, noise, psd: filtered(own, place[flight[k]], at[k], z[k], noise, psd)  # noqa: B023, E731
            p = on_ground(-rate(mine & fast, SIGMA_V, Q_LONG), rate(mine & ~fast, SIGMA_H, Q_VERT) if tall else None)
            up = (p[:, :-1] < 0.5) & (p[:, 1:] >= 0.5)
            found = up.any(axis=1)
            reason[chosen[~found]] = "no_ground_roll"
            if not found.any():
                continue
            f, i = np.flatnonzero(found), up[found].argmax(axis=1)
            slope = (p[f, i + 1] - p[f, i]) / (own[f, i + 1] - own[f, i])
            t_td[chosen[f]] = own[f, i] + (0.5 - p[f, i]) / slope
            sigma[chosen[f]] = np.maximum(np.hypot(0.1 / np.maximum(np.abs(slope), 1e-3), 0.5 * np.median(np.diff(own[f], axis=1), axis=1)), 0.25)
    none = np.isnan(t_td)
    return pa.RecordBatch.from_arrays([batch["flight_id"].take(pa.array(starts)), pa.array(t_td, mask=none), pa.array(sigma, mask=none), pa.array(reason, pa.string())], names=["flight_id", "t_td", "sigma_t", "reason"])
