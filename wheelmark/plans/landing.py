"""The operators put together: from two streams to a touchdown record, for all flights in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wheelmark.functions.tables import kept
from wheelmark.operators import calibration, classify, estimators, fusion, quality, validation
from wheelmark.settings import Settings
from wheelmark.sources import synth

#: What runs by default, by name.
ESTIMATORS = {
    "decel_knee": lambda f, p, v: estimators.decel_knee(f, v),
    "flare_crossing": lambda f, p, v: estimators.flare_crossing(f, p),
    "imm_rts": lambda f, p, v: estimators.imm(f, p, v),
    "cusum": lambda f, p, v, a=None: estimators.cusum(f, v, arrays=a),
    "glrt": lambda f, p, v, a=None: estimators.glrt(f, v, arrays=a),
    "pelt": lambda f, p, v, a=None: estimators.pelt(f, v, arrays=a),
    "jerk_onset": lambda f, p, v, a=None: estimators.jerk_onset(f, v, arrays=a),
}
#: Those that look for a change of the deceleration: they start from the same arrays.
CHANGES = {"cusum", "glrt", "pelt", "jerk_onset"}
#: What each feed delivers.
CAPABILITIES = [("aireon", True, True), ("fr24", False, False)]
#: A small dimension of antenna offsets: type, class, height and offset of the antenna from the main gear, pitch.
LEVER_ARMS = [("B738", "narrowbody", 2.7, 12.0, 3.5), ("A320", "narrowbody", 2.9, 11.0, 4.0), ("B77W", "widebody", 4.8, 25.0, 3.0), ("A333", "widebody", 4.4, 23.0, 4.5)]


def capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPABILITIES, "source string, has_geometric_altitude boolean, samples_are_raw boolean")


def lever_arm_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVER_ARMS, "aircraft_type string, aircraft_class string, height_m double, offset_m double, pitch_deg double")


def estimated(flights: DataFrame, positions: DataFrame, velocities: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """The rows of all ``methods``; what several of them start from is made once."""
    arrays = estimators.changes(velocities) if len(CHANGES & set(methods)) > 1 else None
    return reduce(DataFrame.unionByName, [ESTIMATORS[m](flights, positions, velocities, *([arrays] if m in CHANGES else [])) for m in methods])


class Landing:
    """One corpus: flights and their two streams, and what is derived from them, each made once."""

    def __init__(self, flights: DataFrame, positions: DataFrame, velocities: DataFrame, recorder: DataFrame | None = None, recorded: DataFrame | None = None) -> None:
        """``recorder``: flight_id, t, v, the recorder's speed on its clock; ``recorded``: flight_id, true_t, the touchdown
        on that clock. Without them true times are on the feed's clock."""
        self.spark, self.flights, self.positions, self.velocities = flights.sparkSession, flights, positions, velocities
        self.recorder, self.recorded = recorder, recorded

    @classmethod
    def synthetic(cls, spark: SparkSession, sf_dir: str) -> Landing:
        return cls(synth.flights(spark, sf_dir), synth.positions(spark, sf_dir), synth.velocities(spark, sf_dir), synth.recorder(spark, sf_dir), synth.recorded_times(spark, sf_dir))

    def part(self, ids: DataFrame) -> Landing:
        """The flights in ``ids`` (flight_id) alone."""
        some = lambda df: df if df is None else df.join(ids, "flight_id", "left_semi")
        return Landing(*map(some, (self.flights, self.positions, self.velocities, self.recorder, self.recorded)))

    def classes(self) -> DataFrame:
        return classify.classify(self.flights, self.positions, self.velocities)

    def transitions(self) -> DataFrame:
        return classify.transition(self.positions)

    def brackets(self) -> DataFrame:
        return classify.coarse_bracket(self.classes(), self.transitions())

    def estimates(self, methods: tuple[str, ...] = tuple(ESTIMATORS)) -> DataFrame:
        rows = estimated(self.flights, self.positions, self.velocities, methods)
        return kept(estimators.clamp_to_ground(rows, self.transitions()), "estimates")

    def eligible(self, methods: tuple[str, ...] = tuple(ESTIMATORS)) -> DataFrame:
        return quality.gate_estimators(self.flights, capabilities(self.spark), list(methods))

    def arms(self) -> DataFrame:
        return fusion.lever_arms(self.flights, lever_arm_table(self.spark))

    def baseline(self) -> DataFrame:
        return validation.naive_baseline(self.flights, self.positions)


def run_baseline(landing: Landing, methods: tuple[str, ...] = tuple(ESTIMATORS), settings: Settings | None = None) -> DataFrame:
    """Bracket, gates and dedup, estimators on what is left, their mean and its place; the baseline beside it.

    flight_id, status, trajectory_type, qa_reason, t_td, sigma_t, n_estimates, along_m, baseline_m. Classification and
    baseline use the raw samples, estimators the cleaned ones; estimators run even where the gates object.
    """
    classes, brackets = landing.classes(), landing.brackets()
    gates = gates_of(settings or Settings())
    pos, gated = quality.run_qa(landing.positions, landing.velocities, gates)
    pos, gated, brackets, classes = kept(pos, "positions"), kept(gated, "velocities"), kept(brackets, "brackets"), kept(classes, "classes")
    touching = brackets.where("status = 'ok'").select("flight_id")
    # Only flights with a touchdown reach the estimators: the filter stands before their windows.
    flights = landing.flights.join(touching, "flight_id", "left_semi")
    clean = Landing(flights, pos.join(touching, "flight_id", "left_semi"), gated.where("gate IS NULL").drop("gate").join(touching, "flight_id", "left_semi"))
    rows = estimated(clean.flights, clean.positions, clean.velocities, methods)
    rows = kept(estimators.clamp_to_ground(rows, landing.transitions()), "estimates")
    combined = kept(fusion.combine(rows, landing.eligible(methods)), "combined")
    placed = kept(validation.distance_at(flights, clean.positions, clean.velocities, combined, landing.arms()), "placed")
    qa = quality.sufficiency(gated, brackets, gates)
    out = brackets.select("flight_id", "status").join(classes.select("flight_id", "trajectory_type"), "flight_id")
    out = out.join(qa.select("flight_id", F.col("reason_code").alias("qa_reason")), "flight_id", "left").join(combined.withColumnRenamed("n", "n_estimates"), "flight_id", "left")
    return out.join(placed, "flight_id", "left").join(kept(landing.baseline(), "baseline").withColumnRenamed("along_m", "baseline_m"), "flight_id", "left")


def product(landing: Landing, methods: tuple[str, ...] = tuple(ESTIMATORS), stacking: DataFrame | None = None, provenance: dict[str, str] | None = None) -> DataFrame:
    """Estimates, fusion, mapping, intervals and the output record of every flight."""
    estimates = landing.estimates(methods)
    touching = landing.classes()
    fused = kept(fusion.fuse(estimates, stacking), "fused")
    arms = landing.arms()
    mapped = kept(fusion.map_touchdown(landing.flights, landing.positions, landing.velocities, fused, arms), "mapped")
    widened = fusion.widening(landing.positions, fused, landing.transitions())
    return fusion.touchdown_results(landing.flights, fused, fusion.quantify(fused, mapped, widened), estimates, arms, touching, provenance)


#: Names of the gates' limits in the settings.
GATE_SETTINGS = {
    "max_gap_s": "max_gap_spanning_td_s", "min_in_window": "min_samples_in_window", "half_width_s": "window_half_width_s", "max_excluded": "max_excluded_fraction",
    "longitudinal_g": "max_longitudinal_accel_g", "lateral_g": "max_lateral_accel_g", "turn_deg_s": "max_turn_rate_deg_s", "duplicate_s": "duplicate_timestamp_tolerance_s",
}


def gates_of(settings: Settings) -> quality.Gates:
    own = settings.quality_gates
    return quality.Gates(**{ours: getattr(own, name) for ours, name in GATE_SETTINGS.items()})


def _estimated(landing: Landing, methods: tuple[str, ...], settings: Settings) -> dict[str, DataFrame | Landing]:
    """The part of ``full_run`` that no state has a part in: clean (the cleaned samples of flights with a usable bracket),
    classes, transitions and estimates."""
    classes, transitions = kept(landing.classes(), "classes"), kept(landing.transitions(), "transitions")
    touching = kept(classify.coarse_bracket(classes, transitions).where("status = 'ok'").select("flight_id"), "touching")
    pos, gated = quality.run_qa(landing.positions, landing.velocities, gates_of(settings))
    part = lambda df: df.join(touching, "flight_id", "left_semi")
    clean = Landing(part(landing.flights), kept(part(pos), "positions"), kept(part(gated).where("gate IS NULL").drop("gate"), "velocities"))
    rows = estimated(clean.flights, clean.positions, clean.velocities, methods)
    able = landing.eligible(methods).where("eligible").selectExpr("flight_id", "estimator AS method")
    estimates = kept(estimators.clamp_to_ground(rows, transitions).join(able, ["flight_id", "method"], "left_semi"), "estimates")
    return {"clean": clean, "classes": classes, "transitions": transitions, "estimates": estimates}


def full_run(landing: Landing, methods: tuple[str, ...] | None = None, provenance: dict[str, str] | None = None, settings: Settings | None = None, state: DataFrame | None = None, before: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """``estimates``, ``quantified`` and ``results`` (the output record of every flight) by the whole job: gates and dedup,
    brackets, and each feed's eligible estimators.

    ``settings`` decide on gates and estimators (``methods`` goes before), and their hash is in each record. ``state`` (see
    ``calibration``): multipliers and stacking weights that were fitted on other flights.

    Only flights with a usable bracket reach the estimators; the others' records have no estimate. Classification,
    brackets and transitions use the raw samples, estimators and mapping the cleaned ones.

    ``before``: what a run of the same flights, methods and settings gave; its estimates and what they are made from do not
    depend on the state and are taken as they are.
    """
    settings = settings or Settings()
    methods = methods or tuple(m for m in settings.estimators.enabled if m in ESTIMATORS)
    provenance = {"config_hash": settings.hash()} | (provenance or {})
    made = _estimated(landing, methods, settings) if before is None else before
    clean, classes, transitions, estimates = (made[k] for k in ("clean", "classes", "transitions", "estimates"))
    own, band = settings.fusion, settings.uncertainty
    fused = kept(fusion.fuse(estimates, None if state is None else calibration.stacking(state), own.max_sigma_s, own.disagreement_s, own.wide_interval_s), "fused")
    arms = landing.arms()
    mapped = kept(fusion.map_touchdown(clean.flights, clean.positions, clean.velocities, fused, arms, (own.min_speed_kt, own.max_speed_kt), own.velocity_gap_s, own.wrong_runway_margin_m), "mapped")
    widened = fusion.widening(clean.positions, fused, transitions, band.gap_half_window_s, band.gap_threshold_s, band.nominal_cadence_s, band.after_transition_s, band.min_samples_after_transition, band.starvation_factor)
    z = fusion.gaussian_multiplier(band.coverage_target)
    fitted = None if state is None else calibration.by_flight(clean.flights, state, band.coverage_target)
    quantified = kept(fusion.quantify(fused, mapped, widened, z, z, band.nominal_cadence_s, band.missing_lever_arm_factor, fitted), "quantified")
    results = fusion.touchdown_results(landing.flights, fused, quantified, estimates, arms, classes, provenance, (own.min_speed_kt, own.max_speed_kt), settings.output.speed_resolution_kt)
    return made | {"quantified": quantified, "results": results}


def full_product(landing: Landing, methods: tuple[str, ...] | None = None, provenance: dict[str, str] | None = None, settings: Settings | None = None, state: DataFrame | None = None) -> DataFrame:
    """The output record of every flight (see ``full_run``)."""
    return full_run(landing, methods, provenance, settings, state)["results"]


def offsets_of(landing: Landing, settings: Settings) -> DataFrame | None:
    """Clock offsets of the flights' recorders; None without recorders."""
    if landing.recorder is None:
        return None
    own, feed = settings.validation, landing.velocities.where("gs_kt IS NOT NULL").selectExpr("flight_id", "t", "gs_kt AS v")
    return kept(validation.clock_offsets(landing.recorder, feed, own.clock_resample_dt_s, own.clock_max_lag_search_s, own.clock_min_overlap_s, own.clock_min_peak_correlation, own.clock_offset_max_s, own.clock_drift_max_s, own.clock_drift_segments), "offsets")


def evaluations(landing: Landing, run: dict[str, DataFrame], settings: Settings | None = None, offsets: DataFrame | None = None) -> DataFrame:
    """What validation takes: results beside the truth, in feet, seconds and knots, and the scales of the intervals.

    With a recorder its times are moved onto the feed's clock by the offsets; flights that the offsets exclude have the
    clock ``failed`` and stay out of the time domain.
    """
    kt = 1852 / 3600
    truth = landing.flights.where("kind = 'completed'").selectExpr("flight_id", "airport", "x_true / 0.3048e0 AS true_ft", "t_true AS true_t", f"v_td / {kt} AS true_kt", "'good' AS clock")
    if landing.recorder is not None:
        offsets = offsets_of(landing, settings or Settings()) if offsets is None else offsets
        moved = validation.apply_offsets(landing.recorded, offsets).select("flight_id", "true_t", F.when(F.col("excluded"), "failed").otherwise(F.col("clock")).alias("clock"))
        truth = truth.drop("true_t", "clock").join(moved, "flight_id", "left").withColumn("clock", F.coalesce("clock", F.lit("failed")))
    own = run["results"].selectExpr("flight_id", "aircraft_type", "ads_b_source AS source", "along_runway_distance_ft AS est_ft", "distance_ci_90_lower_ft AS low_ft", "distance_ci_90_upper_ft AS high_ft", "touchdown_time AS est_t", "time_ci_90_lower AS t_low", "time_ci_90_upper AS t_high", "groundspeed_at_touchdown_kt AS est_kt")
    scales = run["quantified"].selectExpr("flight_id", "time_scale_s", "distance_scale_m / 0.3048e0 AS distance_scale_ft")
    return truth.join(own, "flight_id").join(scales, "flight_id", "left")


def fit_state(landing: Landing, methods: tuple[str, ...] | None = None, settings: Settings | None = None) -> DataFrame:
    """The state (see ``calibration``) that these flights give: multipliers by feed, stacking weights, flights by type.

    Weights are fitted first, and multipliers on what the weights give, as they will be used together.
    """
    settings = settings or Settings()
    offsets = offsets_of(landing, settings)
    plain = full_run(landing, methods, settings=settings)
    truth = evaluations(landing, plain, settings, offsets).where("clock != 'failed'").select("flight_id", "true_t")
    weights = calibration.stacking_weights(plain["estimates"], truth, settings.fusion.max_sigma_s)
    evals = kept(evaluations(landing, full_run(landing, methods, settings=settings, state=weights, before=plain), settings, offsets), "calibration")
    return kept(weights.unionByName(calibration.multipliers(evals, settings.uncertainty.coverage_target)).unionByName(calibration.class_counts(landing.flights)), "state")


def milestone_fit(landing: Landing, methods: tuple[str, ...] | None = None, slice_: str = "test", seed: int | None = None, settings: Settings | None = None, calibrate: bool = True) -> dict[str, DataFrame]:
    """``splits``, ``ids`` (the slice's flights), ``calibrated_on`` and ``state`` of ``milestone_report``: nothing is
    computed for the slice."""
    settings = settings or Settings()
    own = settings.validation
    column = {"held_out_airport": "airport_split", "held_out_runway": "runway_split"}.get(slice_, "primary_split")
    seed = settings.pipeline.master_random_seed if seed is None else seed
    splits = kept(validation.validation_splits(landing.flights, seed, own.train_fraction, own.calibration_fraction, own.test_fraction), "splits")
    ids = splits.where(F.col(column) == slice_).select("flight_id")
    apart = splits.where((F.col("primary_split") == "calibration") & (F.col(column) != slice_)).select("flight_id")
    state = fit_state(landing.part(apart), methods, settings) if calibrate else landing.spark.createDataFrame([], calibration.STATE)
    return {"splits": splits, "ids": ids, "calibrated_on": apart, "state": state}


def milestone_report(landing: Landing, methods: tuple[str, ...] | None = None, slice_: str = "test", seed: int | None = None, settings: Settings | None = None, calibrate: bool = True) -> dict[str, DataFrame]:
    """Splits, the fitted state, the slice's results, metrics by stratum, coverages, clock offsets, error floor, flags and
    summary, each a DataFrame.

    The slice is taken before anything is computed for it. Multipliers and weights come from the calibration split, less
    the slice's flights (``calibrate``), and are applied to the slice.
    """
    settings = settings or Settings()
    own = settings.validation
    made = milestone_fit(landing, methods, slice_, seed, settings, calibrate)
    splits, ids, apart, state = (made[k] for k in ("splits", "ids", "calibrated_on", "state"))
    some = landing.part(ids)
    run = full_run(some, methods, settings=settings, state=state)
    offsets = offsets_of(some, settings)
    evals = kept(evaluations(some, run, settings, offsets), "evaluations")
    metrics = kept(validation.stratified_metrics(evals, own.min_stratum_size), "metrics")
    out = {
        "splits": splits, "state": state, "calibrated_on": apart, "evaluations": evals, "metrics": metrics, "coverage": validation.assess_coverage(evals), "coverages": calibration.coverages(evals, some.flights, state, settings.uncertainty.coverage_target),
        "floor": validation.error_floor(evals, own.nominal_cadence_s), "below_target": validation.below_target(metrics, own.below_target_min_flights),
    }
    if offsets is not None:
        out["offsets"], out["offset_distribution"] = offsets, validation.offset_distribution(offsets)
    truth = some.flights.where("kind = 'completed'").selectExpr("flight_id", "x_true AS true_m")
    error = (F.col("along_m") - F.col("true_m")) / validation.FT
    baseline = some.baseline().join(truth, "flight_id").agg(F.sqrt(F.avg(error * error)).alias("baseline_rmse_ft"))
    return out | {"summary": summary(out, baseline)}


def summary(report: dict[str, DataFrame], baseline: DataFrame) -> DataFrame:
    """The report's headlines as rows: section, name, value (numbers) and text (words); null where nothing is known.

    Each part is one row, so that they come together in the driver.
    """
    overall, coverage, floor = report["metrics"].where("dimension = 'overall'").first(), report["coverage"].first(), report["floor"].first()
    rmse = baseline.first()["baseline_rmse_ft"]
    observed = overall["rmse_ft"] if overall else None
    room = fusion.room_to_improve(observed, floor["floor_ft"], rmse)
    parts = {"overall": overall.asDict() if overall else {}, "coverage": coverage.asDict(), "floor": floor.asDict(), "baseline": {"rmse_ft": rmse}, "room": room, "flags": {"below_target": report["below_target"].count()}}
    parts["intervals"] = {f"{r.kind}_{r.interval}": r.coverage for r in report["coverages"].collect()}
    if "offsets" in report:
        excluded = report["offsets"].agg(F.count("*").alias("flights"), F.count_if("excluded").alias("excluded")).first().asDict()
        parts["clock"] = report["offset_distribution"].first().asDict() | excluded
    number = lambda v: float(v) if isinstance(v, int | float) else None
    rows = [(section, name, number(v), None if v is None or number(v) is not None else str(v)) for section, part in parts.items() for name, v in part.items()]
    return report["metrics"].sparkSession.createDataFrame(rows, "section string, name string, value double, text string")
