"""What is fitted on one slice and applied to another; clocks; settings that change results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wheelmark.operators import calibration, fusion, validation
from wheelmark.plans import landing as plans
from wheelmark.settings import Settings

SMALL = "/root/testdata/sf0.001"


def evals(spark, n, sources=("aireon", "fr24"), seed=1):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        s = sources[i % len(sources)]
        scale = 1.0 + i % 3
        rows.append((f"f{i}", s, 10.0 + float(rnd.normal(0, scale * (2 if s == "fr24" else 1))), 10.0, scale, float(rnd.normal(0, 30)), 0.0, 30.0, "failed" if i % 11 == 0 else "good"))
    return spark.createDataFrame(rows, "flight_id string, source string, est_t double, true_t double, time_scale_s double, est_ft double, true_ft double, distance_scale_ft double, clock string")


def test_multipliers_and_coverage(spark):
    fit, test = evals(spark, 900), evals(spark, 900, seed=2)
    state = calibration.multipliers(fit, 0.9)
    got = {(r.kind, r.key): (r.value, r.n) for r in state.collect()}
    rows = fit.toPandas()
    for key, part in [("*", rows), *rows.groupby("source")]:
        part = part[part.clock != "failed"]
        scores = np.sort(np.abs(part.est_t - part.true_t) / part.time_scale_s)
        assert got["time_multiplier", key] == (pytest.approx(scores[min(int(np.ceil((len(scores) + 1) * 0.9)), len(scores)) - 1]), len(scores))
    assert got["time_multiplier", "fr24"][0] > 1.5 * got["time_multiplier", "aireon"][0]
    cover = {(r.kind, r.interval): r.coverage for r in calibration.coverages(test, test.select("flight_id", "source"), state).collect()}
    assert abs(cover["time", "fitted"] - 0.9) < 0.03 and abs(cover["distance", "fitted"] - 0.9) < 0.04 and cover["time", "normal"] < 0.85


def test_feeds_without_scores_take_what_all_have(spark):
    state = calibration.multipliers(evals(spark, 60, ("aireon",) * 10 + ("fr24",)))
    flights = spark.createDataFrame([("a", "aireon"), ("b", "fr24"), ("c", None), ("d", "new")], "flight_id string, source string")
    got = {r.flight_id: (r.time_multiplier, r.distance_multiplier) for r in calibration.by_flight(flights, state).collect()}
    assert got["b"] == got["c"] == got["d"] and len(got) == 4
    empty = calibration.by_flight(flights, state.limit(0)).collect()
    assert all(r.time_multiplier == pytest.approx(fusion.Z90) for r in empty)


def test_stacking_weights(spark):
    rnd = np.random.default_rng(4)
    n, common = 800, rnd.normal(0, 0.2, 800)
    errors = {"good": common + rnd.normal(0, 0.3, n), "noisy": common + rnd.normal(0, 1.5, n), "biased": common + 2.0 + rnd.normal(0, 0.3, n)}
    rows = [(f"f{i}", m, float(e[i]), 1.0, "normal", None) for m, e in errors.items() for i in range(n)] + [("f0", "broken", None, None, "failed", "x")]
    estimates = spark.createDataFrame(rows, "flight_id string, method string, t_td double, sigma_t double, confidence string, reason_code string")
    truth = spark.createDataFrame([(f"f{i}", 0.0) for i in range(n)], "flight_id string, true_t double")
    state = calibration.stacking_weights(estimates, truth)
    got = {r.key: r.value for r in state.collect()}
    assert sum(got.values()) == pytest.approx(1) and min(got.values()) >= 0 and got["good"] > 0.8 and "broken" not in got
    mean = sum(got[m] * e for m, e in errors.items())
    assert (mean**2).mean() <= min((e**2).mean() for e in errors.values()) + 1e-9
    assert calibration.stacking_weights(estimates.limit(0), truth).isEmpty()


def test_least_on_simplex_against_a_grid():
    rnd = np.random.default_rng(6)
    for _ in range(30):
        a = rnd.normal(size=(3, 5))
        p = a @ a.T
        w = calibration.least_on_simplex(p)
        grid = [np.array([i, j, 40 - i - j]) / 40 for i in range(41) for j in range(41 - i)]
        assert w.min() >= 0 and w.sum() == pytest.approx(1) and w @ p @ w <= min(g @ p @ g for g in grid) + 1e-6


def test_state_is_a_table(spark, tmp_path):
    state = calibration.class_counts(spark.createDataFrame([("a", "B738"), ("b", "B738"), ("c", None)], "flight_id string, aircraft_type string"))
    calibration.save(state, f"{tmp_path}/state")
    assert calibration.load(spark, f"{tmp_path}/state").collect() == state.collect() == [("training_flights", "B738", 2.0, 2)]


@pytest.fixture(scope="module")
def report(spark):
    return plans.milestone_report(plans.Landing.synthetic(spark, SMALL), ("decel_knee", "glrt"))


def test_report_is_fitted_on_other_flights(report):
    used, tested = {r.flight_id for r in report["calibrated_on"].collect()}, {r.flight_id for r in report["evaluations"].collect()}
    splits = {r.flight_id: r.primary_split for r in report["splits"].collect()}
    assert used and tested and not used & tested and {splits[f] for f in used} == {"calibration"} and {splits[f] for f in tested} == {"test"}
    assert {"time_multiplier", "distance_multiplier", "stacking", "training_flights"} == {r.kind for r in report["state"].collect()}
    assert {(r.kind, r.interval) for r in report["coverages"].collect()} == {(k, i) for k in ("time", "distance") for i in ("fitted", "normal")}


def test_clocks_are_aligned_and_bad_ones_left_out(spark, report):
    """Small offsets are found and taken off; flights with a far clock or a short recording have no part in time metrics."""
    truth = plans.Landing.synthetic(spark, SMALL).flights.select("flight_id", "k", "t_true")
    rows = report["evaluations"].join(truth, "flight_id").collect()
    far = [r for r in rows if r.k % 31 == 0 or r.k % 37 == 0]
    assert all(r.clock == "failed" for r in far)
    near = [r for r in rows if r.k % 31 and r.k % 37 and r.clock != "failed"]
    assert len(near) > 0.6 * len(rows) and np.median([abs(r.true_t - r.t_true) for r in near]) < 0.3
    section = {r.name: r.value for r in report["summary"].where("section = 'clock'").collect()}
    assert section["excluded"] >= len(far) and section["n"] <= section["flights"]
    overall = report["metrics"].where("dimension = 'overall'").first()
    used = [(r.est_t - r.true_t) ** 2 for r in rows if r.clock != "failed" and r.est_t is not None]
    assert overall.time_rmse_s == pytest.approx(np.sqrt(np.mean(used)))


def test_intervals_follow_the_state(spark):
    """A multiplier twice as large makes an interval twice as wide, for its feed alone."""
    corpus = plans.Landing.synthetic(spark, SMALL)
    state = spark.createDataFrame([("time_multiplier", "aireon", 2 * fusion.Z90, 9)], calibration.STATE)
    width = lambda state: {r.flight_id: (r.w, r.ads_b_source) for r in plans.full_product(corpus, ("decel_knee",), state=state).selectExpr("flight_id", "ads_b_source", "time_ci_90_upper - time_ci_90_lower AS w").where("w IS NOT NULL").collect()}
    plain, fitted = width(None), width(state)
    assert len(plain) > 50 and all(fitted[f][0] == pytest.approx(w * (2 if s == "aireon" else 1)) for f, (w, s) in plain.items())


def test_settings_change_results(spark):
    corpus = plans.Landing.synthetic(spark, SMALL)
    few = corpus.part(corpus.flights.where("k <= 60").select("flight_id"))
    run = lambda given: plans.full_product(few, ("decel_knee", "glrt"), {"config_hash": "x"}, Settings.of(given)).toPandas().set_index("flight_id").sort_index()
    plain = run({})
    changed = lambda given: {c for c in plain.columns if not run_of[given][c].equals(plain[c])}
    run_of = {
        "fusion": run({"fusion": {"max_sigma_s": 2.2, "disagreement_s": 0.01, "wide_interval_s": 1.0, "max_speed_kt": 120.0}}),
        "uncertainty": run({"uncertainty": {"coverage_target": 0.5, "gap_threshold_s": 1.0, "after_transition_s": 0.1}}),
        "output": run({"output": {"speed_resolution_kt": 1.0}}),
    }
    assert {"confidence", "reason_code", "groundspeed_at_touchdown_kt"} <= changed("fusion")
    assert {"time_ci_90_lower", "distance_ci_90_upper_ft"} <= changed("uncertainty") and "touchdown_time" not in changed("uncertainty")
    assert changed("output") == {"groundspeed_at_touchdown_kt", "speed_ci_90_lower_kt", "speed_ci_90_upper_kt"}


def test_clock_rule(spark):
    facts = spark.createDataFrame([("a", 1.0, 0.9, 0.1, 50.0, None), ("b", 3.0, 0.9, 0.1, 50.0, None), ("c", 1.0, 0.9, 0.7, 50.0, None), ("d", 1.0, 0.9, 1.5, 50.0, None), ("e", None, 0.1, None, 50.0, "weak_correlation"), ("f", -0.5, 0.9, None, 50.0, None)], "flight_id string, offset_s double, correlation double, drift_s double, overlap_s double, failure string")
    got = {r.flight_id: (r.quality, r.excluded, r.drift_exceeded) for r in validation.judged(facts).collect()}
    assert got == {"a": ("good", False, False), "b": ("failed", True, False), "c": ("degraded", False, False), "d": ("degraded", True, True), "e": ("failed", True, False), "f": ("good", False, False)}
    assert validation.judged(facts).where(F.col("excluded") != F.col("reason").isNotNull()).isEmpty()


def test_calibration_estimates_its_flights_once_and_no_others(spark, monkeypatch):
    seen = []
    real = plans._estimated
    monkeypatch.setattr(plans, "_estimated", lambda *a: seen.append(a) or real(*a))
    made = plans.milestone_fit(plans.Landing.synthetic(spark, SMALL), ("decel_knee", "glrt"))
    assert len(seen) == 1 and made["state"].where("kind = 'stacking'").count() == 2
    assert made["ids"].join(made["calibrated_on"], "flight_id").count() == 0
