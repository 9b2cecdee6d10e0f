"""Dedup, kinematic gates, sufficiency and runway checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wheelmark.functions.exprs import GRAVITY, KT_TO_MPS, shortest_arc
from wheelmark.functions.flights import in_flights, numbers, starts_of
from wheelmark.functions.tables import kept
from wheelmark.operators.timebase import order


@dataclass(frozen=True)
class Gates:
    """Limits of the quality gates."""

    max_gap_s: float = 15.0
    min_in_window: int = 3
    half_width_s: float = 30.0
    max_excluded: float = 0.5
    longitudinal_g: float = 1.0
    lateral_g: float = 0.5
    turn_deg_s: float = 6.0
    duplicate_s: float = 0.1


def _last_received(flight: np.ndarray, t: np.ndarray, seq: np.ndarray, tolerance_s: float) -> np.ndarray:
    """Of samples in order (flights one after the other), the places of those that ``dedup`` keeps."""
    with np.errstate(all="ignore"):
        close = (flight[1:] == flight[:-1]) & (t[1:] - t[:-1] <= tolerance_s)
    new = np.concatenate([[True], ~close])[: len(t)]
    # A sample further than the tolerance from the one before it is so from the cluster's first, too: only chains are walked.
    anchor = -1
    for i in (np.flatnonzero(close) + 1).tolist():
        if new[i - 1]:
            anchor = i - 1
        if t[i] - t[anchor] > tolerance_s:
            new[i], anchor = True, i
    first = np.flatnonzero(new)
    if len(first) == len(t):
        return first
    cluster = np.cumsum(new) - 1
    order = np.lexsort((seq, cluster))
    return np.sort(order[np.append(first[1:], len(t)) - 1])


def _owners(batch: pa.RecordBatch, starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))


def _deduplicated(batch: pa.RecordBatch, starts: np.ndarray, tolerance_s: float) -> pa.RecordBatch:
    some = _last_received(_owners(batch, starts), numbers(batch, "t"), batch["seq"].fill_null(-1).to_numpy(zero_copy_only=False), tolerance_s)
    return batch if len(some) == batch.num_rows else batch.take(pa.array(some))


def _kinds(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def _in_time() -> list[Column]:
    return [F.col("t").asc_nulls_last(), F.col("seq").asc_nulls_last()]


def dedup(samples: DataFrame, tolerance_s: float = 0.1) -> DataFrame:
    """Keeps the last received (greatest seq) of each cluster of times.

    A cluster holds what lies within ``tolerance_s`` of its first time, so a chain of close times can make several. Flights
    come in whole Arrow batches.
    """
    columns = samples.columns
    return in_flights(samples, _in_time(), lambda batch, starts: _deduplicated(batch, starts, tolerance_s).select(columns), _kinds(samples))


_V0, _V1 = f"(prev_gs * {KT_TO_MPS})", f"(gs_kt * {KT_TO_MPS})"
_TURN = f"(abs({shortest_arc('prev_track', 'track')}) / dt)"


def violation(gates: Gates = Gates()) -> str:
    """The gate that a step from (prev_gs, prev_track) to (gs_kt, track) in ``dt`` violates, as an expression."""
    return (
        f"CASE WHEN dt IS NULL OR dt <= 0e0 OR prev_gs IS NULL OR gs_kt IS NULL THEN NULL WHEN abs({_V1} - {_V0}) / dt > {gates.longitudinal_g} * {GRAVITY} THEN 'longitudinal'"
        f" WHEN {_V1} * radians({_TURN}) > {gates.lateral_g} * {GRAVITY} THEN 'lateral' WHEN {_TURN} > {gates.turn_deg_s} THEN 'turn_rate' END"
    )


def gate_pass(velocities: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """One pass: adds ``gate``, the gate that the step from the sample before violates, or null."""
    steps = velocities.withColumns({"dt": F.col("t") - F.lag("t").over(order()), "prev_gs": F.lag("gs_kt").over(order()), "prev_track": F.lag("track").over(order())})
    return steps.withColumn("gate", F.expr(violation(gates))).drop("dt", "prev_gs", "prev_track")


GATES = np.array([None, "longitudinal", "lateral", "turn_rate"], object)


def _survivors(flight: np.ndarray, t: np.ndarray, v: np.ndarray, track: np.ndarray, gates: Gates) -> np.ndarray:
    """The gate that excluded each sample (0: none), of flights one after the other: all violating steps of a pass go at
    once, until a pass finds none. A step is within a flight, so that flights pass side by side."""
    out = np.zeros(len(t), np.int64)
    g = 9.80665
    live = np.arange(len(t))
    while len(live) > 1:
        a, b = live[:-1], live[1:]
        dt = t[b] - t[a]
        with np.errstate(all="ignore"):
            pull = np.abs(v[b] - v[a]) / dt
            turn = np.abs((track[b] - track[a] + 180) % 360 - 180) / dt
            ok = (dt > 0) & (flight[a] == flight[b])
            bad = np.select([ok & (pull > gates.longitudinal_g * g), ok & ~np.isnan(pull) & (v[b] * np.radians(turn) > gates.lateral_g * g), ok & ~np.isnan(pull) & (turn > gates.turn_deg_s)], [1, 2, 3], 0)
        if not bad.any():
            break
        out[b] = np.where(bad > 0, bad, out[b])
        # Flights without a violation have come to their end.
        going = np.zeros(flight[-1] + 1, bool)
        going[flight[b[bad > 0]]] = True
        left = np.concatenate([live[:1], b[bad == 0]])
        live = left[going[flight[left]]]
    return out


def kinematic_gates(velocities: DataFrame, gates: Gates = Gates(), deduplicate: bool = False) -> DataFrame:
    """Passes to the fixpoint: adds ``gate``, null for samples that survive; ``deduplicate``: ``dedup`` goes before, at once.

    The passes of one flight depend on each other and end after as many as it needs; they run for batches of whole flights.
    """

    columns = velocities.columns

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        if deduplicate:
            batch = _deduplicated(batch, starts, gates.duplicate_s)
            starts = starts_of(batch["flight_id"])
        found = _survivors(_owners(batch, starts), numbers(batch, "t"), numbers(batch, "gs_kt") * (1852 / 3600), numbers(batch, "track"), gates)
        return pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(GATES[found], pa.string())], names=[*columns, "gate"])

    return in_flights(velocities, _in_time(), run, f"{_kinds(velocities)}, gate string")


def sufficiency(gated: DataFrame, windows: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """flight_id, reason_code, n_valid, excluded_fraction, max_gap_s; ``gated`` has ``gate``, ``windows`` t_lo, center, t_hi."""
    valid = gated.where("gate IS NULL").withColumn("next_t", F.lead("t").over(order()))
    rows = windows.where("center IS NOT NULL").select("flight_id", "t_lo", "center", "t_hi")
    inside = valid.join(rows, "flight_id").groupBy("flight_id").agg(
        F.count_if(F.expr("t BETWEEN t_lo AND t_hi")).alias("n_valid"),
        F.max(F.expr("CASE WHEN center BETWEEN t AND next_t THEN next_t - t END")).alias("max_gap_s"),
    )
    gone = gated.where("gate IS NOT NULL").join(rows, "flight_id").groupBy("flight_id").agg(F.count_if(F.expr("t BETWEEN t_lo AND t_hi")).alias("n_gone"))
    present = gated.groupBy("flight_id").agg(F.max(F.col("gs_kt").isNotNull()).alias("present"))
    out = rows.join(inside, "flight_id", "left").join(gone, "flight_id", "left").join(present, "flight_id", "left").selectExpr("flight_id", "coalesce(n_valid, 0) AS n_valid", "coalesce(n_gone, 0) AS n_gone", "coalesce(max_gap_s, 0e0) AS max_gap_s", "coalesce(present, false) AS present")
    out = out.withColumn("excluded_fraction", F.expr("CASE WHEN n_valid + n_gone > 0 THEN n_gone * 1e0 / (n_valid + n_gone) ELSE 0e0 END"))
    reason = F.expr(f"CASE WHEN NOT present THEN 'no_groundspeed_data' WHEN max_gap_s > {gates.max_gap_s} THEN 'gap_spans_touchdown' WHEN excluded_fraction > {gates.max_excluded} THEN 'excessive_exclusions' WHEN n_valid < {gates.min_in_window} THEN 'insufficient_samples' END")
    return out.select("flight_id", reason.alias("reason_code"), "n_valid", "excluded_fraction", "max_gap_s")


def run_qa(positions: DataFrame, velocities: DataFrame, gates: Gates = Gates()) -> tuple[DataFrame, DataFrame]:
    """Cleaned positions and gated velocities (with ``gate``).

    Each stream is deduplicated by itself; where a flight's streams are co-timed (all times as received are equal), a
    position at the time of an excluded velocity goes too.
    """
    pos, gated = dedup(positions, gates.duplicate_s), kept(kinematic_gates(velocities, gates, deduplicate=True), "gated")
    times = lambda df, name: df.groupBy("flight_id").agg(F.array_sort(F.collect_list("t")).alias(name))
    same = times(positions, "a").join(times(velocities, "b"), "flight_id").where("a = b").select("flight_id")
    out = gated.where("gate IS NOT NULL").join(same, "flight_id", "left_semi").select("flight_id", "t")
    return pos.join(out, ["flight_id", "t"], "left_anti").select(*positions.columns), gated


#: The first field of a runway reference that is out of its range.
RUNWAY_FAULT = """CASE WHEN thr_lat IS NULL OR abs(thr_lat) > 9e1 THEN 'threshold_lat' WHEN thr_lon IS NULL OR abs(thr_lon) > 18e1 THEN 'threshold_lon'
  WHEN heading IS NULL OR heading < 0e0 OR heading > 36e1 THEN 'heading_deg' WHEN elevation IS NULL OR elevation < -5e2 OR elevation > 1e4 THEN 'elevation_m'
  WHEN length_m IS NULL OR length_m <= 0e0 OR length_m > 6e3 THEN 'length_m' WHEN width_m IS NULL OR width_m <= 0e0 OR width_m > 1e2 THEN 'width_m' END"""


def validate_runways(runways: DataFrame) -> DataFrame:
    return runways.withColumn("invalid_field", F.expr(RUNWAY_FAULT))


def position_gates(along: str, lateral: str, length: str, width: str, margin_m: float) -> list[tuple[str, str]]:
    """out_of_bounds, wrong_runway and their reason codes, as steps."""
    return [
        ("out_of_bounds", f"({along} < 0e0 OR {along} > {length})"),
        ("suspected_wrong_runway", f"abs({lateral}) > {width} / 2e0 + {margin_m}"),
        ("position_reasons", "concat_ws(',', CASE WHEN out_of_bounds THEN 'out_of_bounds_position' END, CASE WHEN suspected_wrong_runway THEN 'suspected_wrong_runway' END)"),
    ]


def diagnostics(positions: DataFrame, velocities: DataFrame, gated: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """What the gates did to each flight, from the streams as received and the gated velocities that ``run_qa`` made:

    flight_id, n_duplicates_removed (of both streams), n_excluded, counts_by_gate (map), excluded_times (sorted),
    vertical_rate_unavailable (no velocity sample has one). One pass over each stream, joined by flight.
    """
    n = lambda df, name: df.groupBy("flight_id").agg(F.count("*").alias(name))
    gone = gated.where("gate IS NOT NULL")
    by_gate = gone.groupBy("flight_id", "gate").agg(F.count("*").alias("n")).groupBy("flight_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gate", "n")))).alias("counts_by_gate"))
    times = gone.groupBy("flight_id").agg(F.count("*").alias("n_excluded"), F.array_sort(F.collect_list("t")).alias("excluded_times"))
    rows = velocities.groupBy("flight_id").agg(F.count("*").alias("v0"), F.max(F.col("vr_fpm").isNotNull()).alias("rated"))
    for more in (n(positions, "p0"), n(gated, "v1"), n(dedup(positions, gates.duplicate_s), "p1"), by_gate, times):
        rows = rows.join(more, "flight_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return rows.select("flight_id", (zero("p0") - zero("p1") + zero("v0") - zero("v1")).alias("n_duplicates_removed"), zero("n_excluded").alias("n_excluded"), F.coalesce("counts_by_gate", F.expr("CAST(map() AS map<string, bigint>)")).alias("counts_by_gate"), F.coalesce("excluded_times", F.expr("CAST(array() AS array<double>)")).alias("excluded_times"), (~F.coalesce("rated", F.lit(False))).alias("vertical_rate_unavailable"))


#: Which estimators a feed's capability rules out.
GATED = {"flare_crossing": "has_geometric_altitude", "imm_rts": "has_geometric_altitude"}


#: Other names of feeds.
ALIASES = {"flightradar24": "fr24"}


def feed_capability(flights: DataFrame, capabilities: DataFrame, override: dict[str, bool] | None = None) -> DataFrame:
    """flight_id, has_geometric_altitude, samples_independent: of each flight's feed, by its name or another one of it.

    A feed that is not listed can do all; ``override`` decides for all flights. Capabilities are a handful of rows.
    """
    if override is not None:
        return flights.select("flight_id", F.lit(override["has_geometric_altitude"]).alias("has_geometric_altitude"), F.lit(override["samples_are_raw"]).alias("samples_independent"))
    names = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    rows = flights.select("flight_id", F.coalesce(names[F.col("source")], F.col("source")).alias("source")).join(capabilities, "source", "left")
    return rows.select("flight_id", F.coalesce("has_geometric_altitude", F.lit(True)).alias("has_geometric_altitude"), F.coalesce("samples_are_raw", F.lit(True)).alias("samples_independent"))


def gate_estimators(flights: DataFrame, capabilities: DataFrame, estimators: list[str], override: dict[str, bool] | None = None) -> DataFrame:
    """flight_id, estimator, eligible, excluded_reason: each flight's feed against the list of estimators (in one row's array)."""
    rows = feed_capability(flights, capabilities, override).select("flight_id", F.col("has_geometric_altitude").alias("geo"), F.explode(F.array(*map(F.lit, estimators))).alias("estimator"))
    out = F.col("estimator").isin(*GATED) & ~F.col("geo")
    return rows.select("flight_id", "estimator", (~out).alias("eligible"), F.when(out, "geometric_alt_unavailable").alias("excluded_reason"))
