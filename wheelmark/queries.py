"""Queries over the landing tables, and the SQL that each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelmark import oracles
from wheelmark.functions.exprs import rounded
from wheelmark.functions.tables import kept, shared_folder
from wheelmark.operators import calibration, channels, classify, estimators, fusion, learned, quality, signals, smoothing, softmax, timebase, validation
from wheelmark.oracles import CTES, project, position_at, sql, velocity_at
from wheelmark.plans import files
from wheelmark.plans import landing as plans
from wheelmark.plans.landing import Landing
from wheelmark.sources import raw, readers, synth
from wheelmark.streaming.cusum import replay

_FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
SIMPLE = ("decel_knee", "glrt", "flare_crossing", "jerk_onset", "cusum", "pelt")


def query(select: str | None = None):
    """Registers a query, with the SELECT that gives the same rows where SQL can express it."""

    def put(f):
        _FOUND[f.__name__] = (f, sql(select) if select else None)
        return f

    return put


def out(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as they are; "name:digits" rounds one."""
    return df.selectExpr(*[f"{rounded(c.split(':')[0], int(c.split(':')[1]))} AS {c.split(':')[0]}" if ":" in c else c for c in columns])


def sel(*columns: str) -> str:
    return ", ".join(f"{rounded(c.split(':')[0], int(c.split(':')[1]))} AS {c.split(':')[0]}" if ":" in c else c for c in columns)


def _split(columns: str) -> list[str]:
    """A SELECT list at its top-level commas."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(columns[start:i])
            start = i + 1
    return [*parts, columns[start:]]


def _queries_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.flights(spark, sf_dir).selectExpr("flight_id", "t_true", "explode(array(-1e3, -73e-1, 0e0, 25e-1, 1e3)) AS o").selectExpr("flight_id", "t_true + o AS q", "o")


# --- streams ----------------------------------------------------------------------------------------------------


@query(f"SELECT {sel('flight_id', 'seq', 'dt:6')} FROM (SELECT flight_id, seq, coalesce(t - lag(t) OVER (PARTITION BY flight_id ORDER BY t, seq), 0e0) AS dt FROM vel)")
def time_deltas(spark, d):
    return out(timebase.time_deltas(synth.velocities(spark, d)), "flight_id", "seq", "dt:6")


@query(f"SELECT flight_id, o, {rounded('gs_at')} AS gs_kt, {rounded('track_at')} AS track_deg, {rounded('slope_at')} AS slope_mps2 FROM {velocity_at('q')}")
def interpolate_velocity(spark, d):
    return out(timebase.velocity_at(synth.velocities(spark, d), _queries_at(spark, d)), "flight_id", "o", "gs_kt:6", "track_deg:6", "slope_mps2:6")


_NEAR = "(SELECT * FROM q WHERE abs(o) < 1e2)"


@query(f"SELECT flight_id, o, degraded, {rounded('lat', 7)} AS lat, {rounded('lon', 7)} AS lon FROM {position_at(_NEAR)}")
def interpolate_position(spark, d):
    at = _queries_at(spark, d).where("abs(o) < 100")
    return out(timebase.position_at(synth.positions(spark, d), synth.velocities(spark, d), at), "flight_id", "o", "degraded", "lat:7", "lon:7")


@query(f"SELECT flight_id, o, degraded, {rounded('lat', 7)} AS lat, {rounded('lon', 7)} AS lon FROM {position_at('q')}")
def interpolate_position_all(spark, d):
    """Every query time, those far outside the samples too."""
    return out(timebase.position_at(synth.positions(spark, d), synth.velocities(spark, d), _queries_at(spark, d)), "flight_id", "o", "degraded", "lat:7", "lon:7")


@query(f"SELECT flight_id, o, {rounded(oracles.CURVE, 5)} AS alt_m FROM {oracles.asof('mono', 'q', 'y, slope')}")
def monotone_altitude(spark, d):
    return out(timebase.monotone_at(synth.positions(spark, d), _queries_at(spark, d), "geo_alt", "alt_m"), "flight_id", "o", "alt_m:5")


CTES["grid"] = "SELECT flight_id, unnest(range(CAST(floor((last - first) / 1e0 + 1e-9) AS BIGINT) + 1)) AS i, first + i * 1e0 AS q FROM (SELECT flight_id, min(t) AS first, max(t) AS last FROM (SELECT flight_id, t FROM pos UNION ALL SELECT flight_id, t FROM vel) GROUP BY flight_id)"


@query(f"SELECT p.flight_id, CAST(p.i AS BIGINT) AS i, p.degraded, {rounded('p.lat')} AS lat, {rounded('p.lon')} AS lon, {rounded('v.gs_at', 5)} AS gs_kt FROM {position_at('grid')} p JOIN {velocity_at('grid')} v ON p.flight_id = v.flight_id AND p.i = v.i")
def resample_grid(spark, d):
    return out(timebase.resample(synth.positions(spark, d), synth.velocities(spark, d)), "flight_id", "i", "degraded", "lat:6", "lon:6", "gs_kt:5")


# --- classification and gates -----------------------------------------------------------------------------------


@query("SELECT flight_id, on_ground_t FROM transit")
def on_ground_transition(spark, d):
    return classify.transition(synth.positions(spark, d))


@query(f"SELECT {sel('flight_id', 'CAST(segment AS BIGINT) AS segment', 'CAST(start_seq AS BIGINT) AS start_seq', 'CAST(end_seq AS BIGINT) AS end_seq', 'start_t:5', 'end_t:5')} FROM segments")
def contact_segments(spark, d):
    rows = classify.contact_segments(synth.positions(spark, d), synth.flights(spark, d))
    return out(rows, "flight_id", "segment", "CAST(start_seq AS BIGINT) AS start_seq", "CAST(end_seq AS BIGINT) AS end_seq", "start_t:5", "end_t:5")


@query("SELECT flight_id, onset_t FROM onset")
def decel_onset(spark, d):
    return classify.decel_onset(synth.velocities(spark, d))


_CLASS = ("flight_id", "trajectory_type", "reason_code", "is_touchdown", "n_landings", "first_contact_t:5", "sustained_roll", "coalesce(datum_ok, false) AS datum_ok", "onset_t:5")


@query(f"SELECT {sel(*_CLASS)} FROM classes")
def trajectory_class(spark, d):
    return out(Landing.synthetic(spark, d).classes(), *_CLASS)


@query(f"SELECT {sel('flight_id', 'status', 't_lo:5', 'center:5', 't_hi:5', 'on_ground_t:5')} FROM brackets")
def touchdown_bracket(spark, d):
    return out(Landing.synthetic(spark, d).brackets(), "flight_id", "status", "t_lo:5", "center:5", "t_hi:5", "on_ground_t:5")


@query("""SELECT l.truth, count(*) FILTER (WHERE p = 'completed-landing') AS "completed-landing", count(*) FILTER (WHERE p = 'go-around') AS "go-around", count(*) FILTER (WHERE p = 'touch-and-go') AS "touch-and-go"
  FROM (VALUES ('completed-landing'), ('go-around'), ('touch-and-go')) l(truth) LEFT JOIN (SELECT c.trajectory_type AS p, CASE f.kind WHEN 'completed' THEN 'completed-landing' WHEN 'go_around' THEN 'go-around' ELSE 'touch-and-go' END AS truth FROM classes c JOIN flights f ON c.flight_id = f.flight_id) x ON l.truth = x.truth GROUP BY l.truth""")
def confusion_matrix(spark, d):
    corpus = Landing.synthetic(spark, d)
    truth = corpus.flights.selectExpr("flight_id", "CASE kind WHEN 'completed' THEN 'completed-landing' WHEN 'go_around' THEN 'go-around' ELSE 'touch-and-go' END AS label")
    return classify.confusion_matrix(corpus.classes().selectExpr("flight_id", "trajectory_type AS label"), truth, ["completed-landing", "go-around", "touch-and-go"])


@query("SELECT flight_id, datum_used, thr_hae, CASE WHEN thr_hae IS NULL THEN 'datum_unresolved' END AS reason_code FROM thr")
def datum_hae(spark, d):
    return classify.with_threshold(synth.flights(spark, d)).selectExpr("flight_id", "datum_used", "thr_hae", "CASE WHEN thr_hae IS NULL THEN 'datum_unresolved' END AS reason_code")


_BROKEN = ["flight_id", "CASE WHEN k % 9 = 1 THEN 95e0 ELSE thr_lat END AS thr_lat", "CASE WHEN k % 9 = 2 THEN NULL ELSE thr_lon END AS thr_lon", "CASE WHEN k % 9 = 3 THEN 361e0 ELSE heading END AS heading", "CASE WHEN k % 9 = 4 THEN -6e2 ELSE elevation END AS elevation", "CASE WHEN k % 9 = 5 THEN 0e0 ELSE length_m END AS length_m", "CASE WHEN k % 9 = 6 THEN 101e0 ELSE width_m END AS width_m"]


_LIMITS = {
    "threshold_lat": "thr_lat BETWEEN -9e1 AND 9e1",
    "threshold_lon": "thr_lon BETWEEN -18e1 AND 18e1",
    "heading_deg": "heading BETWEEN 0e0 AND 36e1",
    "elevation_m": "elevation BETWEEN -5e2 AND 1e4",
    "length_m": "length_m > 0e0 AND length_m <= 6e3",
    "width_m": "width_m > 0e0 AND width_m <= 1e2",
}


@query(f"SELECT flight_id, coalesce({', '.join(f"CASE WHEN NOT coalesce({test}, false) THEN '{name}' END" for name, test in _LIMITS.items())}) AS invalid_field FROM (SELECT {', '.join(_BROKEN)} FROM flights) r")
def runway_validation(spark, d):
    return quality.validate_runways(synth.flights(spark, d).selectExpr(*_BROKEN)).select("flight_id", "invalid_field")


@query(f"SELECT flight_id, seq, {rounded('p_along', 4)} AS along_m, {rounded('p_lateral', 4)} AS lateral_m FROM {project('(SELECT flight_id, seq, lat, lon FROM pos)')}")
def runway_projection(spark, d):
    rows = fusion.project(synth.positions(spark, d).select("flight_id", "seq", "lat", "lon"), synth.flights(spark, d))
    return rows.selectExpr("flight_id", "seq", f"{rounded('p_along', 4)} AS along_m", f"{rounded('p_lateral', 4)} AS lateral_m")


CTES["walk"] = "SELECT flight_id, n, t, seq, t AS anchor, 1 AS cluster FROM nth WHERE n = 1 UNION ALL SELECT w.flight_id, x.n, x.t, x.seq, CASE WHEN x.t - w.anchor <= 1e-1 THEN w.anchor ELSE x.t END, w.cluster + CASE WHEN x.t - w.anchor <= 1e-1 THEN 0 ELSE 1 END FROM walk w JOIN nth x ON x.flight_id = w.flight_id AND x.n = w.n + 1"
CTES["nth"] = "SELECT flight_id, t, seq, row_number() OVER (PARTITION BY flight_id ORDER BY t, seq) AS n FROM vel"


@query("SELECT flight_id, max(seq) AS seq, max_by(t, seq) AS t FROM walk GROUP BY flight_id, cluster")
def dedup_last(spark, d):
    return quality.dedup(synth.velocities(spark, d)).select("flight_id", "seq", "t")


@query("SELECT flight_id, seq, gate FROM gated")
def kinematic_gate_pass(spark, d):
    return quality.gate_pass(synth.velocities(spark, d)).select("flight_id", "seq", "gate")


@query()
def kinematic_gates(spark, d):
    return quality.kinematic_gates(synth.velocities(spark, d)).select("flight_id", "seq", "gate")


@query("""SELECT flight_id, CASE WHEN NOT present THEN 'no_groundspeed_data' WHEN gap > 15 THEN 'gap_spans_touchdown' WHEN share > 5e-1 THEN 'excessive_exclusions' WHEN n_valid < 3 THEN 'insufficient_samples' END AS reason_code, n_valid, round(share + 1e-9, 6) AS excluded_fraction, round(gap + 1e-9, 6) AS max_gap_s FROM (
  SELECT *, CASE WHEN n_valid + n_gone > 0 THEN n_gone * 1e0 / (n_valid + n_gone) ELSE 0e0 END AS share FROM (SELECT b.flight_id, count(*) FILTER (WHERE gate IS NULL AND t BETWEEN t_lo AND t_hi) AS n_valid, count(*) FILTER (WHERE gate IS NOT NULL AND t BETWEEN t_lo AND t_hi) AS n_gone, bool_or(gs_kt IS NOT NULL) AS present, coalesce(max(CASE WHEN gate IS NULL AND center BETWEEN t AND next_t THEN next_t - t END), 0e0) AS gap
  FROM brackets b JOIN (SELECT *, CASE WHEN gate IS NULL THEN lead(t) OVER (PARTITION BY flight_id, gate IS NULL ORDER BY t, seq) END AS next_t FROM gated) g ON b.flight_id = g.flight_id WHERE center IS NOT NULL GROUP BY b.flight_id))""")
def sufficiency(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(quality.sufficiency(quality.gate_pass(corpus.velocities), corpus.brackets()), "flight_id", "reason_code", "n_valid", "excluded_fraction:6", "max_gap_s:6")


@query("SELECT * FROM elig")
def estimator_gating(spark, d):
    return Landing.synthetic(spark, d).eligible()


# --- signals and estimators -------------------------------------------------------------------------------------

_KNEE = ("flight_id", "n", "t_knee:4", "slope_before:4", "slope_after:4", "slope_drop:4", "v_knee:4", "rms:4")


@query(f"SELECT {sel(*_KNEE)} FROM knees")
def knee_2seg(spark, d):
    return out(signals.knee(synth.velocities(spark, d)), *_KNEE)


@query()
def knee_3seg(spark, d):
    return signals.three_segments(synth.velocities(spark, d))


@query(f"SELECT {sel('flight_id', 'CAST(i AS INTEGER) AS i', 'decel:5', 'jerk:5', 'n')} FROM derive")
def decel_signal(spark, d):
    return out(signals.derivatives(synth.velocities(spark, d)), "flight_id", "CAST(i AS INT) AS i", "decel:5", "jerk:5", "n")


_SMOOTH = ("flight_id", "CAST(i AS INT) AS i", "value:5", "decel:5", "jerk:5", "decel_var:5", "jerk_var:5", "n")


@query(f"SELECT {sel(*_SMOOTH)} FROM savgol")
def smoothed_savgol(spark, d):
    """A cubic through the nearest seven samples, with variances."""
    return out(smoothing.smoothed_derivatives(synth.velocities(spark, d)), *_SMOOTH)


@query(f"SELECT {sel(*_SMOOTH)} FROM kernel")
def smoothed_gp(spark, d):
    """A quadratic with normal weights, with variances."""
    return out(smoothing.smoothed_derivatives(synth.velocities(spark, d), "gp"), *_SMOOTH)


@query()
def smoothed_process(spark, d):
    """A Gaussian process with derivative kernels, on either side of the knee."""
    v = synth.velocities(spark, d)
    return smoothing.smoothed_derivatives(v, "process", knees=signals.knee(v))


_EST = ("flight_id", "method", "t_td:4", "sigma_t:4", "confidence", "reason_code")


@query(f"SELECT {sel(*_EST)} FROM knee_e")
def estimator_decel_knee(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(estimators.decel_knee(corpus.flights, corpus.velocities), *_EST)


@query(f"SELECT {sel(*_EST)} FROM glrt")
def estimator_glrt(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(estimators.glrt(corpus.flights, corpus.velocities), *_EST)


@query(f"SELECT {sel(*_EST)} FROM cusum")
def estimator_cusum(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(estimators.cusum(corpus.flights, corpus.velocities), *_EST)


@query(f"SELECT {sel(*_EST)} FROM jerk")
def estimator_jerk_onset(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(estimators.jerk_onset(corpus.flights, corpus.velocities), *_EST)


@query(f"SELECT {sel(*_EST)} FROM flare")
def estimator_flare_crossing(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(estimators.flare_crossing(corpus.flights, corpus.positions), *_EST)


@query(f"SELECT {sel(*_EST)} FROM pelt")
def estimator_pelt(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(estimators.pelt(corpus.flights, corpus.velocities), *_EST)


@query()
def estimator_imm(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(estimators.imm(corpus.flights, corpus.positions, corpus.velocities), *_EST)


@query(f"SELECT {sel(*_EST)} FROM est")
def on_ground_bound(spark, d):
    return out(Landing.synthetic(spark, d).estimates(SIMPLE), *_EST)


# --- fusion and records -----------------------------------------------------------------------------------------


@query(f"SELECT {sel('flight_id', 't_td:4', 'sigma_t:4', 'n')} FROM combined")
def combine_estimates(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(fusion.combine(corpus.estimates(SIMPLE), corpus.eligible()), "flight_id", "t_td:4", "sigma_t:4", "n")


_FUSED = ("flight_id", "t_td:4", "sigma_t:4", "ci_low:4", "ci_high:4", "confidence", "reason_code", "n", "between_s:4", "contributing", "excluded")


@query(f"SELECT {sel(*_FUSED)} FROM fused")
def fuse_blend(spark, d):
    return out(fusion.fuse(Landing.synthetic(spark, d).estimates(SIMPLE)), *_FUSED)


@query(f"SELECT {sel(*_FUSED)} FROM stacked")
def fuse_stacking(spark, d):
    weights = spark.createDataFrame([("decel_knee", 0.6), ("glrt", 0.3)], "method string, weight double")
    return out(fusion.fuse(Landing.synthetic(spark, d).estimates(SIMPLE), weights), *_FUSED)


@query("SELECT s.source, s.n, round(s.score + 1e-9, 6) AS multiplier FROM (SELECT source, score, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY score) AS r FROM (SELECT source, abs(est_ft - true_ft) / 1e2 AS score FROM evals) WHERE score IS NOT NULL) s WHERE r = least(ceil((n + 1) * 9e-1 - 1e-9), n)")
def conformal(spark, d):
    scores = _evaluations(spark, d).selectExpr("source", "abs(est_ft - true_ft) / 1e2 AS score")
    return out(fusion.conformal_multiplier(scores, 0.9, ["source"]), "source", "n", "multiplier:6")


_SCALES = ("1e0 + length(flight_id || source) % 3 AS time_scale_s", "5e1 + length(source) * 1e1 AS distance_scale_ft")


@query(f"""SELECT kind, key, round(score + 1e-9, 6) AS value, n FROM (SELECT kind, key, score, count(*) OVER (PARTITION BY kind, key) AS n, row_number() OVER (PARTITION BY kind, key ORDER BY score) AS r FROM (
  SELECT kind, unnest([source, '*']) AS key, score FROM (SELECT 'time_multiplier' AS kind, source, CASE WHEN clock <> 'failed' THEN abs(est_t - true_t) / time_scale_s END AS score FROM (SELECT *, {', '.join(_SCALES)} FROM evals)
    UNION ALL SELECT 'distance_multiplier', source, abs(est_ft - true_ft) / distance_scale_ft FROM (SELECT *, {', '.join(_SCALES)} FROM evals)) WHERE score IS NOT NULL))
  WHERE r = least(ceil((n + 1) * 9e-1 - 1e-9), n) AND (key = '*' OR n >= 20)""")
def fitted_multipliers(spark, d):
    """Conformal multipliers of time and distance intervals, by feed and over all."""
    return out(calibration.multipliers(_evaluations(spark, d).selectExpr("*", *_SCALES)), "kind", "key", "value:6", "n")


_OFFSETS = "concat('K', CAST(o_orderkey AS STRING)) AS flight_id, CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE (o_orderkey % 61 - 30) * 1e-1 END AS offset_s, 9e-1 AS correlation, CASE WHEN o_orderkey % 23 = 0 OR o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 17) * 9e-2 END AS drift_s, 6e1 AS overlap_s, CASE WHEN o_orderkey % 23 = 0 THEN 'weak_correlation' END AS failure"


@query(f"""SELECT flight_id, offset_s, drift_s, coalesce(drift_s, 0e0) > 1e0 AS drift_exceeded, CASE WHEN offset_s IS NULL OR offset_s NOT BETWEEN -2e0 AND 2e0 THEN 'failed' WHEN drift_s > 5e-1 THEN 'degraded' ELSE 'good' END AS quality,
  offset_s IS NULL OR offset_s > 2e0 OR offset_s < -2e0 OR coalesce(drift_s, 0e0) > 1e0 AS excluded, CASE WHEN offset_s IS NULL OR offset_s > 2e0 OR offset_s < -2e0 OR coalesce(drift_s, 0e0) > 1e0 THEN 'clock_offset_exceeded' END AS reason, failure FROM (SELECT {_OFFSETS} FROM orders)""")
def clock_exclusions(spark, d):
    """Which flights the clock rule leaves out of the time domain."""
    facts = spark.read.parquet(f"{d}/orders.parquet").selectExpr(*_split(_OFFSETS))
    return validation.judged(facts).select("flight_id", "offset_s", "drift_s", "drift_exceeded", "quality", "excluded", "reason", "failure")


@query()
def milestone_state(spark, d):
    """What the calibration split gives: multipliers, stacking weights, flights by type."""
    return plans.milestone_fit(Landing.synthetic(spark, d))["state"]


@query()
def milestone_coverages(spark, d):
    """Coverage of the test split's intervals with what was fitted on the calibration split, and without."""
    return plans.milestone_report(Landing.synthetic(spark, d))["coverages"]


@query(f"SELECT {sel('flight_id', 'shift_m:6', 'height_m:6', 'pitch_deg:6', 'arm', 'missing', 'widening_m:6')} FROM levers")
def lever_arm(spark, d):
    return out(Landing.synthetic(spark, d).arms(), "flight_id", "shift_m:6", "height_m:6", "pitch_deg:6", "arm", "missing", "widening_m:6")


@query(f"SELECT {sel('flight_id', 'gap_factor:6', 'starved')}, CASE WHEN starved THEN 15e-1 ELSE 1e0 END AS starvation_factor FROM widened")
def interval_widening(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(fusion.widening(corpus.positions, kept(fusion.fuse(corpus.estimates(SIMPLE)), "fused"), corpus.transitions()), "flight_id", "gap_factor:6", "starved", "starvation_factor")


def _mapped(corpus: Landing) -> tuple[DataFrame, DataFrame]:
    fused = kept(fusion.fuse(corpus.estimates(SIMPLE)), "fused")
    return fused, fusion.map_touchdown(corpus.flights, corpus.positions, corpus.velocities, fused, corpus.arms())


_MAP = ("flight_id", "t_td:4", "along_m:3", "lateral_m:3", "gs_mps:4", "sigma_v:4", "degraded", "out_of_bounds", "suspected_wrong_runway", "speed_reason")


@query(f"SELECT {sel(*_MAP)} FROM mapped")
def map_touchdown(spark, d):
    return out(_mapped(Landing.synthetic(spark, d))[1], *_MAP)


_QUANT = ("flight_id", "t_td:4", "distance_ft:2", "time_low:4", "time_high:4", "distance_low_ft:2", "distance_high_ft:2", "confidence", "reason_code")


@query(f"SELECT {sel(*_QUANT)} FROM quantified")
def uncertainty(spark, d):
    corpus = Landing.synthetic(spark, d)
    fused, mapped = _mapped(corpus)
    return out(fusion.quantify(fused, mapped, fusion.widening(corpus.positions, fused, corpus.transitions())), *_QUANT)


_RESULT = ("flight_id", "aircraft_type", "ads_b_source", "touchdown_time:4", "along_runway_distance_ft:2", "lateral_offset_ft:2", "trajectory_type", "confidence", "reason_code", "contributing_estimators", "lever_arm_used", "suspected_wrong_runway", "out_of_bounds", "physics_anchor_method")


@query(f"""SELECT {sel(*_RESULT)} FROM (SELECT f.flight_id, f.aircraft_type, f.source AS ads_b_source, q.t_td AS touchdown_time, q.distance_ft AS along_runway_distance_ft, q.lateral_m / 3048e-4 AS lateral_offset_ft, c.trajectory_type,
  CASE WHEN coalesce(u.confidence, 'no-estimate') = 'no-estimate' THEN 'no-estimate' WHEN q.out_of_bounds OR q.suspected_wrong_runway OR q.speed_reason IS NOT NULL THEN 'low-confidence' ELSE q.confidence END AS confidence,
  CASE WHEN coalesce(u.confidence, 'no-estimate') = 'no-estimate' THEN coalesce(u.reason_code, 'all_estimators_failed') ELSE coalesce(q.reason_code, CASE WHEN q.out_of_bounds THEN 'out_of_bounds_position' END, CASE WHEN q.suspected_wrong_runway THEN 'suspected_wrong_runway' END, q.speed_reason) END AS reason_code,
  coalesce(u.contributing, '') AS contributing_estimators, l.arm AS lever_arm_used, coalesce(q.suspected_wrong_runway, false) AS suspected_wrong_runway, coalesce(q.out_of_bounds, false) AS out_of_bounds, 'decel_knee' AS physics_anchor_method
  FROM flights f LEFT JOIN fused u ON f.flight_id = u.flight_id LEFT JOIN quantified q ON q.flight_id = f.flight_id LEFT JOIN levers l ON l.flight_id = f.flight_id LEFT JOIN classes c ON c.flight_id = f.flight_id) r""")
def touchdown_results(spark, d):
    return out(plans.product(Landing.synthetic(spark, d), SIMPLE), *_RESULT)


@query()
def touchdown_results_all(spark, d):
    """All estimators on cleaned samples of flights with a usable bracket."""
    return out(plans.full_product(Landing.synthetic(spark, d)), *_RESULT)


@query()
def baseline_run(spark, d):
    return plans.run_baseline(Landing.synthetic(spark, d))


@query(f"SELECT {sel('flight_id', 'along_m:3')} FROM base")
def naive_baseline(spark, d):
    return out(Landing.synthetic(spark, d).baseline(), "flight_id", "along_m:3")


_SUMMARY = ("n", "rmse_m:3", "median_abs_m:3", "median_signed_m:3", "p95_abs_m:3", "baseline_rmse_m:3", "improvement_pct:3")


@query(f"""SELECT {sel(*_SUMMARY)} FROM (SELECT count(*) AS n, sqrt(avg(e * e)) AS rmse_m, quantile_cont(abs(e), 0.5) AS median_abs_m, quantile_cont(e, 0.5) AS median_signed_m, quantile_cont(abs(e), 0.95) AS p95_abs_m, sqrt(avg(b * b)) AS baseline_rmse_m, (sqrt(avg(b * b)) - sqrt(avg(e * e))) / sqrt(avg(b * b)) * 1e2 AS improvement_pct
  FROM (SELECT k.along_m - t.along_m AS e, b.along_m - t.along_m AS b FROM knee_x k JOIN base b ON k.flight_id = b.flight_id JOIN truth_x t ON t.flight_id = k.flight_id))""")
def distance_error_summary(spark, d):
    corpus = Landing.synthetic(spark, d)
    knees = kept(estimators.decel_knee(corpus.flights, corpus.velocities), "knees")
    placed = kept(validation.distance_at(corpus.flights, corpus.positions, corpus.velocities, knees), "placed")
    baseline = kept(corpus.baseline(), "baseline")
    truth = corpus.flights.where("kind = 'completed'").selectExpr("flight_id", "x_true AS along_m")
    return out(validation.distance_error_summary(placed, baseline, truth), *_SUMMARY)


# --- validation -------------------------------------------------------------------------------------------------


def _evaluations(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr(*oracles.EVALUATION)


_METRIC = ("dimension", "key", *[m if m.startswith("n_") else f"{m}:4" for m in validation.METRICS], "reportable")


@query(f"SELECT {sel(*_METRIC)} FROM metrics")
def stratified_metrics(spark, d):
    return out(validation.stratified_metrics(_evaluations(spark, d)), *_METRIC)


_NAMED = "CASE WHEN {0} IS NULL THEN 'undefined' WHEN {0} BETWEEN 0.85 AND 0.95 THEN 'in-band' WHEN {0} > 0.95 THEN 'over-coverage' ELSE 'under-coverage' END"
_COVER = "CASE WHEN {0} BETWEEN {1} AND {2} THEN 1e0 WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN 0e0 END"


@query(f"SELECT {sel('coverage:6', 'status', 'time_coverage:6', 'time_status')} FROM (SELECT *, {_NAMED.format('coverage')} AS status, {_NAMED.format('time_coverage')} AS time_status FROM (SELECT avg({_COVER.format('true_ft', 'low_ft', 'high_ft')}) AS coverage, avg(CASE WHEN clock <> 'failed' THEN {_COVER.format('true_t', 't_low', 't_high')} END) AS time_coverage FROM evals))")
def interval_coverage(spark, d):
    return out(validation.assess_coverage(_evaluations(spark, d)), "coverage:6", "status", "time_coverage:6", "time_status")


_PER_S = 1852 / 3600 / 0.3048


@query(f"SELECT {sel('median_kt:4', 'floor_ft:4', 'median_floor_ft:4', 'share_within:6')} FROM (SELECT quantile_cont(kt, 0.5) AS median_kt, abs(quantile_cont(kt, 0.5)) * {_PER_S!r} * 5e0 AS floor_ft, quantile_cont(own, 0.5) AS median_floor_ft, avg(CASE WHEN err IS NOT NULL AND own IS NOT NULL THEN CASE WHEN err <= own THEN 1e0 ELSE 0e0 END END) AS share_within FROM (SELECT true_kt AS kt, abs(est_ft - true_ft) AS err, abs(true_kt) * {_PER_S!r} * 5e0 AS own FROM evals))")
def error_floor(spark, d):
    return out(validation.error_floor(_evaluations(spark, d)), "median_kt:4", "floor_ft:4", "median_floor_ft:4", "share_within:6")


@query(f"SELECT dimension, key, n_flights, metric, {rounded('observed', 4)} AS observed, target FROM (SELECT dimension, key, n_flights, unnest(['rmse_ft', 'p95_abs_ft', 'long_p95_ft', 'median_signed_ft']) AS metric, unnest([abs(rmse_ft), abs(p95_abs_ft), abs(long_p95_ft), abs(median_signed_ft)]) AS observed, unnest([250e0, 400e0, 500e0, 75e0]) AS target FROM metrics WHERE n_flights >= 200 AND dimension IN ('aircraft_type', 'source')) WHERE observed > target")
def below_target(spark, d):
    return out(validation.below_target(validation.stratified_metrics(_evaluations(spark, d))), "dimension", "key", "n_flights", "metric", "observed:4", "target")


@query("SELECT count(*) AS flights, 0 AS leaking_tails, 0 AS leaking_airports, 0 AS leaking_runways FROM flights")
def split_leakage(spark, d):
    """Groups that stand on two sides of a split: none may."""
    flights = synth.flights(spark, d)
    splits = validation.validation_splits(flights).join(flights.selectExpr("flight_id", "tail", "airport", "concat_ws('/', airport, CAST(heading AS INT)) AS runway"), "flight_id")
    leaks = [splits.groupBy(k).agg(F.count_distinct(s).alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).cast("int").alias(name)) for k, s, name in (("tail", "primary_split", "leaking_tails"), ("airport", "airport_split", "leaking_airports"), ("runway", "runway_split", "leaking_runways"))]
    placed = flights.select("flight_id").join(splits, "flight_id", "left").where("primary_split IS NOT NULL AND airport_split IS NOT NULL AND runway_split IS NOT NULL")
    return placed.agg(F.count("*").alias("flights")).join(leaks[0]).join(leaks[1]).join(leaks[2])


@query()
def validation_splits(spark, d):
    return validation.validation_splits(synth.flights(spark, d))


@query()
def clock_offsets(spark, d):
    v = synth.velocities(spark, d)
    qar = v.selectExpr("flight_id", "t + pmod(hash(flight_id), 5) * 2e-1 AS t", "gs_kt AS v")
    return validation.clock_offsets(qar, v.selectExpr("flight_id", "t", "gs_kt AS v"))


_ARM = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'aireon' ELSE 'fr24' END AS train_source, CASE WHEN o_orderkey % 3 = 0 THEN 'fr24' ELSE 'aireon' END AS test_source, o_custkey % 400 AS landing, (o_orderkey % 37 - 18) * 1e1 AS error_ft FROM {0}"


@query(f"""SELECT train_source, test_source, n, {sel('rmse_ft:4', 'same_rmse_ft:4')}, {rounded('rmse_ft - same_rmse_ft', 4)} AS delta_ft, {rounded('(rmse_ft - same_rmse_ft) / same_rmse_ft * 1e2', 4)} AS delta_pct FROM (SELECT *, max(CASE WHEN train_source = test_source THEN rmse_ft END) OVER (PARTITION BY test_source) AS same_rmse_ft FROM (
  SELECT train_source, test_source, count(error_ft) AS n, sqrt(avg(error_ft * error_ft)) AS rmse_ft FROM ({_ARM.format('orders')}) a WHERE landing IN (SELECT landing FROM ({_ARM.format('orders')}) GROUP BY landing HAVING count(DISTINCT test_source) = 2) GROUP BY train_source, test_source))""")
def cross_source(spark, d):
    arms = spark.sql(_ARM.format("{orders}"), orders=spark.read.parquet(f"{d}/orders.parquet"))
    return out(validation.cross_source(arms), "train_source", "test_source", "n", "rmse_ft:4", "same_rmse_ft:4", "delta_ft:4", "delta_pct:4")


@query()
def milestone_metrics(spark, d):
    return plans.milestone_report(Landing.synthetic(spark, d))["metrics"]


@query()
def milestone_summary(spark, d):
    return plans.milestone_report(Landing.synthetic(spark, d))["summary"]


# --- sources ----------------------------------------------------------------------------------------------------


@query(raw.SKIP_SQL)
def adsb_skip_reasons(spark, d):
    return readers.flights_of(raw.adsb(spark, d), raw.runways(spark, d)).select("flight_id", "skip_reason", "skip_detail", "n_positions", "n_velocities")


@query(raw.MATCH_SQL.format("1 AS qar_pos, 0 AS kind", "'truth'", ""))
def qar_match(spark, d):
    truths, unmatched, ambiguous = readers.match_qar(raw.metas(spark, d), raw.qar(spark, d))
    return truths.selectExpr("flight_id", "'truth' AS outcome", "input_pos AS qar_pos").unionByName(unmatched.selectExpr("flight_id", "'unmatched' AS outcome", "CAST(NULL AS BIGINT) AS qar_pos")).unionByName(ambiguous.selectExpr("flight_id", "'ambiguous' AS outcome", "CAST(NULL AS BIGINT) AS qar_pos"))


@query(raw.FIND_SQL)
def qar_first(spark, d):
    return readers.find_truth(raw.metas(spark, d), raw.qar(spark, d)).selectExpr("flight_id", "input_pos AS qar_pos")


@query(raw.COERCE_SQL)
def coerce_types(spark, d):
    rows = raw.spellings(spark, d)
    return rows.select("event_id", readers.to_boolean("flag", rows.schema["flag"].dataType).alias("flag"), F.col("number").try_cast("double").alias("number"))


@query(raw.SUPPLEMENT_SQL)
def runway_supplement(spark, d):
    return readers.supplement(raw.runway_rows(spark, d)).select("airport", "runway", "heading_deg")


def _files(spark: SparkSession, d: str) -> files.Corpus:
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    at = raw.write_files(spark, d, folder)
    feeds = [files.Feed(at["aireon.csv"], "aireon"), files.Feed(at["fr24.parquet"], "fr24", readers.RawUnits("m", "m"))]
    return files.read_corpus(spark, feeds, at["runways.csv"], at["recorders.parquet"])


@query(f"""SELECT f.flight_id, f.source, p.n AS n_positions, v.n AS n_velocities, {rounded('f.length_m', 3)} AS length_m, {rounded('f.thr_lat', 6)} AS thr_lat, {rounded('p.high', 4)} AS mean_geo_alt, {rounded('p.baro', 4)} AS mean_baro_alt, {rounded('v.gs', 4)} AS mean_gs,
  CASE WHEN r.k IS NULL OR r.late THEN 'unmatched' ELSE 'matched' END AS outcome, CASE WHEN NOT r.late THEN {rounded('r.landing_time', 4)} END AS recorded_t, CASE WHEN NOT r.late THEN {rounded('r.gs_touchdown', 4)} END AS recorded_kt
  FROM flights f JOIN (SELECT flight_id, count(*) AS n, avg(geo_alt) AS high, avg(baro_alt) AS baro FROM pos GROUP BY flight_id) p ON f.flight_id = p.flight_id JOIN (SELECT flight_id, count(gs_kt) AS n, avg(gs_kt) AS gs FROM vel GROUP BY flight_id) v ON f.flight_id = v.flight_id
  LEFT JOIN (SELECT k, {', '.join(x for x in raw.RECORDED if x.rsplit(' ', 1)[-1] in ('landing_time', 'gs_touchdown'))}, k % 11 <> 0 AND abs((k % 7 - 3) * 2e0 + CASE WHEN k % 41 = 0 THEN 1e3 ELSE 0e0 END - k % 5) > 3e2 AS late FROM flights WHERE {raw.RECORDED_WHERE}) r ON f.k = r.k""")
def files_corpus(spark, d):
    """Two feeds' files (CSV in feet, Parquet in metres), runways and recorders, written, read and joined."""
    corpus = _files(spark, d)
    means = corpus.positions.groupBy("flight_id").agg(F.avg("geo_alt").alias("mean_geo_alt"), F.avg("baro_alt").alias("mean_baro_alt")).join(corpus.velocities.groupBy("flight_id").agg(F.avg("gs_kt").alias("mean_gs")), "flight_id")
    rows = corpus.flights.where("skip_reason IS NULL").join(means, "flight_id").join(corpus.outcomes, "flight_id")
    return out(rows, "flight_id", "source", "n_positions", "n_velocities", "length_m:3", "thr_lat:6", "mean_geo_alt:4", "mean_baro_alt:4", "mean_gs:4", "outcome", "recorded_t:4", "recorded_kt:4")


@query()
def files_results(spark, d):
    """From the files to each flight's touchdown, beside its recorder's."""
    return files.results(_files(spark, d))


# --- learned and streaming --------------------------------------------------------------------------------------


@query(learned.FEATURE_SQL)
def window_features(spark, d):
    corpus = Landing.synthetic(spark, d)
    return out(learned.window_features(corpus.flights, corpus.positions, corpus.velocities), *learned.FEATURE_OUT)


@query()
def window_features_all(spark, d):
    """The whole window vector."""
    corpus = Landing.synthetic(spark, d)
    return learned.window_features(corpus.flights, corpus.positions, corpus.velocities).select("flight_id", *learned.FEATURES)


@query()
def sequence_input(spark, d):
    """Every sample's channels and flags, as a sequence model reads them."""
    corpus = Landing.synthetic(spark, d)
    return channels.sequence_input(corpus.flights, corpus.positions, corpus.velocities)


@query()
def qa_diagnostics(spark, d):
    corpus = Landing.synthetic(spark, d)
    return quality.diagnostics(corpus.positions, corpus.velocities, quality.run_qa(corpus.positions, corpus.velocities)[1])


@query()
def estimator_trees(spark, d):
    corpus = Landing.synthetic(spark, d)
    return learned.trees(corpus.flights, corpus.positions, corpus.velocities)


@query()
def estimator_hybrid(spark, d):
    corpus = Landing.synthetic(spark, d)
    return learned.hybrid(corpus.flights, corpus.positions, corpus.velocities)


@query()
def estimator_sequence(spark, d):
    corpus = Landing.synthetic(spark, d)
    return learned.sequence(corpus.flights, corpus.positions, corpus.velocities)


@query()
def quantile_coverage(spark, d):
    """Held-out coverage, crossings and errors of the quantile boosters."""
    corpus = Landing.synthetic(spark, d)
    return learned.trees_report(corpus.flights, corpus.positions, corpus.velocities)


@query(f"""SELECT flight_id, i, {rounded('w / sum(w) OVER (PARTITION BY flight_id)', 9)} AS y FROM (SELECT v.flight_id, row_number() OVER (PARTITION BY v.flight_id ORDER BY v.t, v.seq) - 1 AS i,
  exp(-pow((v.t - f.t_true) / 25e-1, 2) / 2e0) AS w FROM vel v JOIN flights f ON v.flight_id = f.flight_id WHERE f.kind = 'completed' AND v.gs_kt IS NOT NULL)""")
def soft_labels(spark, d):
    """The sequence model's label of each sample."""
    truth = synth.flights(spark, d).where("kind = 'completed'").select("flight_id", "t_true")
    rows = synth.velocities(spark, d).where("gs_kt IS NOT NULL").groupBy("flight_id").agg(F.array_sort(F.collect_list(F.struct("t", "seq"))).alias("s")).selectExpr("flight_id", "s.t AS t")
    return softmax.soft_labels(rows, truth, 2.5).selectExpr("flight_id", "posexplode(y) AS (i, y)").transform(lambda r: out(r.withColumn("i", F.col("i").cast("long")), "flight_id", "i", "y:9"))


@query("SELECT f.flight_id, f.aircraft_type, n AS training_flights, CASE WHEN n < 250 THEN 'physics' ELSE 'learned' END AS family FROM flights f JOIN (SELECT aircraft_type, count(*) FILTER (WHERE kind = 'completed') AS n FROM flights GROUP BY aircraft_type) c ON f.aircraft_type = c.aircraft_type")
def rare_type_fallback(spark, d):
    flights = synth.flights(spark, d)
    return learned.family(flights, learned.training_counts(flights.where("kind = 'completed'")), 250).select("flight_id", "aircraft_type", "training_flights", "family")


@query()
def rare_type_estimates(spark, d):
    """The estimate of each flight: learned for common types, physics for rare ones and where the learned one fails."""
    corpus = Landing.synthetic(spark, d)
    families = learned.family(corpus.flights, learned.training_counts(corpus.flights.where("kind = 'completed'")), 250)
    own = kept(learned.trees(corpus.flights, corpus.positions, corpus.velocities), "learned")
    return out(learned.with_fallback(families, own, estimators.decel_knee(corpus.flights, corpus.velocities)), *_EST)


@query()
def stream_cusum(spark, d):
    return replay(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _FOUND.items() if text}
