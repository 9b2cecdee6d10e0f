"""Combining estimates, calibrated intervals and the touchdown record."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelmark.functions.exprs import FT_TO_M, KT_TO_MPS, with_steps
from wheelmark.functions.geodesy import projected
from wheelmark.operators.classify import with_threshold
from wheelmark.operators.quality import position_gates
from wheelmark.operators.timebase import order, position_at, velocity_at

Z90 = NormalDist().inv_cdf(0.95)
#: Physics methods whose estimate anchors the record, in order of preference.
ANCHORS = ("decel_knee", "flare_crossing", "imm_rts")


def gaussian_multiplier(coverage: float) -> float:
    if not 0 < coverage < 1:
        raise ValueError(f"coverage: {coverage}")
    return NormalDist().inv_cdf((1 + coverage) / 2)


def combine(estimates: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """flight_id, t_td, sigma_t, n: the inverse-variance mean of what is eligible and did not fail."""
    rows = estimates.where("confidence != 'failed' AND t_td IS NOT NULL AND sigma_t > 0")
    if eligible is not None:
        rows = rows.join(eligible.where("eligible").select("flight_id", F.col("estimator").alias("method")), ["flight_id", "method"], "left_semi")
    w = 1 / (F.col("sigma_t") * F.col("sigma_t"))
    return rows.groupBy("flight_id").agg((F.sum(F.col("t_td") * w) / F.sum(w)).alias("t_td"), F.sqrt(1 / F.sum(w)).alias("sigma_t"), F.count("*").alias("n"))


#: Why an estimate does not take part, in order.
EXCLUSION = """CASE WHEN method = 'on_ground_flag' THEN 'on_ground_flag_zero_weight' WHEN confidence = 'failed' THEN concat('failed(', coalesce(reason_code, ''), ')')
  WHEN t_td IS NULL THEN 'non_finite_t_td' WHEN sigma_t IS NULL OR sigma_t <= 0 THEN 'non_positive_sigma_t' WHEN sigma_t > {limit} THEN 'sigma_t_above_threshold' END"""


def fuse(estimates: DataFrame, stacking: DataFrame | None = None, limit_s: float = 5.0, disagreement_s: float = 3.0, wide_s: float = 8.0) -> DataFrame:
    """flight_id, t_td, sigma_t, ci_low, ci_high, confidence, reason_code, n, between_s, contributing, excluded.

    ``stacking`` (method, weight): learned coefficients; a method without one has its inverse variance, and where the
    coefficients of a flight add up to nothing all have. The variance has a part within and one between estimates.
    """
    rows = estimates.withColumn("why", F.expr(EXCLUSION.format(limit=limit_s))).withColumn("inv", F.expr("CASE WHEN why IS NULL THEN 1e0 / (sigma_t * sigma_t) END"))
    if stacking is None:
        rows = rows.withColumn("w", F.col("inv"))
    else:
        rows = rows.join(stacking.select("method", "weight"), "method", "left").withColumn("w", F.expr("CASE WHEN why IS NULL THEN coalesce(weight, inv) END"))
        rows = rows.withColumn("w", F.when(F.sum("w").over(Window.partitionBy("flight_id")) > 0, F.col("w")).otherwise(F.col("inv")))
    every = Window.partitionBy("flight_id")
    rows = rows.withColumn("w", F.col("w") / F.sum("w").over(every)).withColumn("mean", F.sum(F.col("w") * F.col("t_td")).over(every))
    out = rows.groupBy("flight_id").agg(
        F.first("mean").alias("t_td"),
        F.sum(F.expr("w * w * sigma_t * sigma_t")).alias("within"),
        F.sum(F.expr("w * (t_td - mean) * (t_td - mean)")).alias("between"),
        F.count_if(F.col("why").isNull()).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("why").isNull(), F.col("method")))).alias("used"),
        F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.concat_ws(": ", "method", "why")))).alias("left_out"),
    )
    out = out.withColumns({"sigma_t": F.sqrt(F.col("within") + F.col("between")), "between_s": F.sqrt("between")})
    out = out.withColumn("reason_code", F.expr(f"CASE WHEN n = 0 THEN 'all_estimators_failed' WHEN n >= 2 AND between_s > {disagreement_s} THEN 'estimator_disagreement' WHEN {2 * Z90} * sigma_t > {wide_s} THEN 'wide_ci' END"))
    return out.select(
        "flight_id", "t_td", "sigma_t", (F.col("t_td") - Z90 * F.col("sigma_t")).alias("ci_low"), (F.col("t_td") + Z90 * F.col("sigma_t")).alias("ci_high"),
        F.expr("CASE WHEN n = 0 THEN 'no-estimate' WHEN reason_code IS NULL THEN 'normal' ELSE 'low-confidence' END").alias("confidence"),
        "reason_code", "n", "between_s", F.concat_ws(",", "used").alias("contributing"), F.concat_ws(",", "left_out").alias("excluded"),
    )


def conformal_multiplier(scores: DataFrame, coverage: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """n and multiplier: the ceil((n + 1) * coverage)-th smallest of ``score`` (at most the largest), by group.

    The rank comes from counts of distinct values, so that no task sorts all scores.
    """
    by = by or []
    counts = scores.where("score IS NOT NULL").groupBy(*by, "score").agg(F.count("*").alias("c"))
    slots = counts.withColumn("slot", F.floor(F.log2(F.col("score") + 1e-12) * 64))
    per = slots.groupBy(*by, "slot").agg(F.sum("c").alias("in_slot"))
    every = Window.partitionBy(*by)
    per = per.withColumns({"n": F.sum("in_slot").over(every), "before": F.coalesce(F.sum("in_slot").over(every.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    per = per.withColumn("rank", F.least(F.ceil((F.col("n") + 1) * F.lit(coverage) - 1e-9), F.col("n"))).where("before < rank AND rank <= before + in_slot")
    inside = slots.join(per, [*by, "slot"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*by, "slot").orderBy("score")))
    return inside.where("upto >= rank").groupBy(*by).agg(F.first("n").alias("n"), F.min("score").alias("multiplier"))


# --- lever arms -------------------------------------------------------------------------------------------------

CORRECTION = "offset_m * cos(radians(pitch_deg)) + height_m * sin(radians(pitch_deg))"


def lever_arms(flights: DataFrame, arms: DataFrame) -> DataFrame:
    """flight_id, shift_m, pitch_deg, arm, missing, widening_m: by type, else its class's median, else the median of all.

    ``arms``: aircraft_type, aircraft_class, height_m, offset_m, pitch_deg (a small dimension); flights may have
    ``aircraft_class``.
    """
    own = arms.withColumn("shift", F.expr(CORRECTION))
    half = lambda c: F.expr(f"percentile({c}, 0.5)")
    medians = [half("height_m").alias("height_m"), half("offset_m").alias("offset_m"), half("pitch_deg").alias("pitch_deg"), F.when(F.count("*") > 1, F.max("shift") - F.min("shift")).otherwise(0.0).alias("spread"), F.count("*").alias("n")]
    by_class = own.groupBy("aircraft_class").agg(*medians)
    overall = own.agg(*medians)
    rows = flights.select("flight_id", "aircraft_type", F.col("aircraft_class") if "aircraft_class" in flights.columns else F.lit(None).cast("string").alias("aircraft_class"))
    rows = rows.join(own.select("aircraft_type", F.struct("height_m", "offset_m", "pitch_deg").alias("own")), "aircraft_type", "left")
    rows = rows.join(by_class.select("aircraft_class", F.struct("height_m", "offset_m", "pitch_deg").alias("cls"), F.when(F.col("n") > 1, F.col("spread")).alias("cls_spread")), "aircraft_class", "left")
    # One row.
    rows = rows.join(F.broadcast(overall.select(F.struct("height_m", "offset_m", "pitch_deg").alias("med"), F.col("spread").alias("all_spread"))), F.lit(True))
    rows = rows.withColumn("a", F.coalesce("own", "cls", "med")).select("*", "a.*")
    return rows.select("flight_id", F.expr(CORRECTION).alias("shift_m"), "height_m", "pitch_deg", F.expr("CASE WHEN own IS NOT NULL THEN 'type' WHEN cls IS NOT NULL THEN 'class' ELSE 'median' END").alias("arm"), F.col("own").isNull().alias("missing"), F.expr("CASE WHEN own IS NOT NULL THEN 0e0 ELSE coalesce(cls_spread, all_spread) END").alias("widening_m"))


# --- mapping and intervals --------------------------------------------------------------------------------------


def project(rows: DataFrame, flights: DataFrame, lat: str = "lat", lon: str = "lon", keep: tuple[str, ...] = ("p_along", "p_lateral")) -> DataFrame:
    """Adds metres along and across the flight's runway.

    There is a runway row for each flight, which Spark takes for far smaller than it is (from its compressed columns) and
    would send through the driver: it is dealt out by flight instead, as the samples are.
    """
    runway = flights.select("flight_id", "thr_lat", "thr_lon", "heading")
    found = rows.join(runway.hint("merge"), "flight_id").withColumn("p_", projected("thr_lat", "thr_lon", "heading", lat, lon))
    return found.withColumns({name: F.col(f"p_.{name.removeprefix('p_')}") for name in keep}).drop("thr_lat", "thr_lon", "heading", "p_")


def map_touchdown(flights: DataFrame, positions: DataFrame, velocities: DataFrame, times: DataFrame, arms: DataFrame, speed_kt: tuple[float, float] = (50.0, 220.0), gap_s: float = 10.0, margin_m: float = 50 * 0.3048) -> DataFrame:
    """Where and how fast each flight was at t_td: ``times`` has flight_id, t_td, sigma_t."""
    at = times.where("t_td IS NOT NULL").select("flight_id", F.col("t_td").alias("q"), "sigma_t")
    rows = velocity_at(velocities, position_at(positions, velocities, at, few=True), few=True)
    near = velocities.join(at.select("flight_id", "q"), "flight_id").groupBy("flight_id").agg(F.max(F.abs(F.col("t") - F.col("q")) <= gap_s).alias("velocity_present"))
    rows = project(rows, flights).join(near, "flight_id", "left").join(arms.select("flight_id", "shift_m", "missing"), "flight_id", "left").join(flights.select("flight_id", "length_m", "width_m"), "flight_id")
    low, high = speed_kt
    steps = [
        ("along_m", "p_along - coalesce(shift_m, 0e0)"),
        ("gs_mps", f"gs_kt * {KT_TO_MPS}"),
        ("sigma_v", "coalesce(abs(slope_mps2) * abs(sigma_t), 0e0)"),
        *position_gates("along_m", "p_lateral", "length_m", "width_m", margin_m),
        ("speed_ok", f"coalesce(gs_kt BETWEEN {low} AND {high}, false)"),
        ("speed_reason", "CASE WHEN NOT coalesce(velocity_present, false) THEN 'degraded_interpolation' WHEN NOT speed_ok THEN 'implausible_speed' END"),
    ]
    rows = with_steps(rows, steps, drop=False)
    return rows.select("flight_id", F.col("q").alias("t_td"), "sigma_t", "along_m", F.col("p_lateral").alias("lateral_m"), F.col("p_along").alias("antenna_along_m"), "gs_mps", "sigma_v", "degraded", "out_of_bounds", "suspected_wrong_runway", "position_reasons", "speed_reason", "missing")


def widening(positions: DataFrame, times: DataFrame, transitions: DataFrame, half_s: float = 30.0, gap_s: float = 10.0, cadence_s: float = 5.0, after_s: float = 15.0, least_after: int = 2, factor: float = 1.5) -> DataFrame:
    """flight_id, gap_factor, starved, starvation_factor: gaps near t_td, and too few fixes after the transition."""
    steps = positions.where("t IS NOT NULL").withColumn("next_t", F.lead("t").over(order())).join(times.select("flight_id", "t_td"), "flight_id").join(transitions.select("flight_id", "on_ground_t"), "flight_id", "left")
    gap = F.expr(f"CASE WHEN next_t >= t_td - {half_s} AND t <= t_td + {half_s} AND next_t - t > {gap_s} THEN (next_t - t) / {cadence_s} END")
    rows = steps.groupBy("flight_id").agg(F.max(gap).alias("gap"), F.first("on_ground_t").alias("on_ground_t"), F.count_if(F.expr(f"lat IS NOT NULL AND t > on_ground_t AND t <= on_ground_t + {after_s}")).alias("after"))
    starved = F.expr(f"on_ground_t IS NOT NULL AND after < {least_after}")
    return rows.select("flight_id", F.greatest(F.coalesce("gap", F.lit(1.0)), F.lit(1.0)).alias("gap_factor"), starved.alias("starved"), F.when(starved, factor).otherwise(1.0).alias("starvation_factor"))


M_TO_FT = f"(1e0 / {FT_TO_M})"


def quantify(fused: DataFrame, mapped: DataFrame, widened: DataFrame, time_multiplier: float = Z90, distance_multiplier: float = Z90, cadence_s: float = 5.0, lever_factor: float = 1.5, multipliers: DataFrame | None = None) -> DataFrame:
    """Intervals of time and distance, widened for gaps, starvation and defaulted lever arms; the first reason stays.

    ``multipliers`` (flight_id, time_multiplier, distance_multiplier): what was fitted, instead of the fixed ones.
    """
    rows = fused.where("confidence != 'no-estimate'").select("flight_id", "t_td", "sigma_t", "confidence", "reason_code").join(mapped.drop("t_td", "sigma_t"), "flight_id").join(widened, "flight_id", "left")
    if multipliers is None:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("time_multiplier", "distance_multiplier")})
    else:
        rows = rows.join(multipliers.select("flight_id", "time_multiplier", "distance_multiplier"), "flight_id", "left")
    steps = [
        ("reliable", "sigma_t > 0e0 AND abs(coalesce(gs_mps, 0e0)) > 0e0"),
        ("sigma_used", f"CASE WHEN sigma_t > 0e0 THEN sigma_t ELSE {cadence_s} END"),
        ("widen", "coalesce(gap_factor, 1e0) * coalesce(starvation_factor, 1e0)"),
        ("time_scale_s", "sigma_used * widen"),
        ("time_half", f"coalesce(time_multiplier, {time_multiplier}) * time_scale_s"),
        ("dist_sigma", f"CASE WHEN abs(coalesce(gs_mps, 0e0)) > 0e0 THEN abs(gs_mps) * sigma_used ELSE {cadence_s} END"),
        ("distance_scale_m", f"dist_sigma * widen * CASE WHEN missing THEN {lever_factor} ELSE 1e0 END"),
        ("dist_half", f"coalesce(distance_multiplier, {distance_multiplier}) * distance_scale_m"),
        ("why", "coalesce(reason_code, CASE WHEN missing THEN 'missing_lever_arm' END, CASE WHEN starved THEN 'no_ground_roll' END, CASE WHEN NOT reliable THEN 'wide_ci' END)"),
        ("confidence2", "CASE WHEN missing OR coalesce(starved, false) OR NOT reliable THEN 'low-confidence' ELSE confidence END"),
        ("distance_ft", f"along_m * {M_TO_FT}"),
        ("time_low", "t_td - time_half"),
        ("time_high", "t_td + time_half"),
        ("distance_low_ft", f"distance_ft - dist_half * {M_TO_FT}"),
        ("distance_high_ft", f"distance_ft + dist_half * {M_TO_FT}"),
    ]
    rows = with_steps(rows.drop("distance_ft"), steps, drop=False)
    return rows.withColumns({"confidence": F.col("confidence2"), "reason_code": F.col("why")}).drop("confidence2", "why", "dist_sigma", "sigma_used", "widen", "time_half", "dist_half", "time_multiplier", "distance_multiplier")


def touchdown_results(flights: DataFrame, fused: DataFrame, quantified: DataFrame, estimates: DataFrame, arms: DataFrame, classes: DataFrame, provenance: dict[str, str] | None = None, speed_kt: tuple[float, float] = (50.0, 220.0), resolution_kt: float = 0.1) -> DataFrame:
    """The output record of each flight: null numbers and a reason where there is no estimate."""
    order = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(ANCHORS))
    anchor = estimates.where(F.col("method").isin(*ANCHORS)).groupBy("flight_id").agg(F.min_by(F.struct("t_td", "method"), F.expr(f"CASE method {order} END")).alias("anchor"))
    own = quantified.select("flight_id", "t_td", "distance_ft", "lateral_m", "gs_mps", "sigma_v", "time_low", "time_high", "distance_low_ft", "distance_high_ft", "confidence", "reason_code", "out_of_bounds", "suspected_wrong_runway", "position_reasons", "speed_reason")
    rest = fused.select("flight_id", F.col("confidence").alias("fused_confidence"), F.col("reason_code").alias("fused_reason"), "contributing", "excluded")
    rows = with_threshold(flights).select("flight_id", "aircraft_type", "source", "datum", "datum_used").join(rest, "flight_id", "left").join(own, "flight_id", "left").join(anchor, "flight_id", "left").join(arms.select("flight_id", "arm", "missing", "pitch_deg"), "flight_id", "left").join(classes.select("flight_id", "trajectory_type"), "flight_id", "left")
    low, high = speed_kt
    step = lambda x: f"bround(({x}) / {resolution_kt}) * {resolution_kt}"
    kt = f"(gs_mps / {KT_TO_MPS})"
    half = f"({Z90} * sigma_v / {KT_TO_MPS})"
    down = "(out_of_bounds OR suspected_wrong_runway OR speed_reason IS NOT NULL)"
    first = "coalesce(reason_code, CASE WHEN out_of_bounds THEN 'out_of_bounds_position' END, CASE WHEN suspected_wrong_runway THEN 'suspected_wrong_runway' END, speed_reason)"
    some = "coalesce(fused_confidence, 'no-estimate') != 'no-estimate'"
    versions = {"data_version": "unknown", "code_commit": "unknown", "config_hash": "unknown", "model_artifact_hash": ""} | (provenance or {})
    return rows.selectExpr(
        "flight_id", "aircraft_type", "source AS ads_b_source", "t_td AS touchdown_time", "distance_ft AS along_runway_distance_ft", f"lateral_m * {M_TO_FT} AS lateral_offset_ft",
        f"{step(f'least(greatest({kt}, {low}), {high})')} AS groundspeed_at_touchdown_kt", "time_low AS time_ci_90_lower", "time_high AS time_ci_90_upper", "distance_low_ft AS distance_ci_90_lower_ft", "distance_high_ft AS distance_ci_90_upper_ft",
        f"{step(f'{kt} - {half}')} AS speed_ci_90_lower_kt", f"{step(f'{kt} + {half}')} AS speed_ci_90_upper_kt", "trajectory_type",
        f"CASE WHEN NOT {some} THEN 'no-estimate' WHEN {down} THEN 'low-confidence' ELSE confidence END AS confidence", f"CASE WHEN NOT {some} THEN coalesce(fused_reason, 'all_estimators_failed') ELSE {first} END AS reason_code",
        "coalesce(contributing, '') AS contributing_estimators", "coalesce(excluded, '') AS excluded_estimators", "anchor.t_td AS physics_anchor_t_td", "anchor.method AS physics_anchor_method", "arm AS lever_arm_used", "missing AS lever_arm_missing",
        "pitch_deg AS assumed_touchdown_pitch_deg", "source != 'fr24' AS geometric_altitude_available", "datum AS runway_elevation_datum", "coalesce(suspected_wrong_runway, false) AS suspected_wrong_runway", "coalesce(out_of_bounds, false) AS out_of_bounds",
        *[f"'{v}' AS {k}" for k, v in versions.items()],
    )


def room_to_improve(observed_ft: float | None, floor_ft: float | None, baseline_ft: float | None) -> dict:
    """Headroom over the cadence floor (never below 0) and gain over the baseline; None where a number is missing."""
    ok = lambda *x: all(v is not None and math.isfinite(v) for v in x)
    return {
        "headroom_ft": max(observed_ft - floor_ft, 0.0) if ok(observed_ft, floor_ft) else None,
        "ratio_to_floor": observed_ft / floor_ft if ok(observed_ft, floor_ft) and floor_ft > 0 else None,
        "improvement_pct": (baseline_ft - observed_ft) / baseline_ft * 100 if ok(observed_ft, baseline_ft) and baseline_ft > 0 else None,
        "at_floor": bool(ok(observed_ft, floor_ft) and observed_ft <= floor_ft),
    }
