"""Formulas against published or independently worked values, and operators against small models of their own."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wheelmark.functions.exprs import direct_steps, projection_steps, with_steps
from wheelmark.operators import channels, estimators, quality, signals, timebase, validation
from wheelmark.plans.landing import Landing, full_product, gates_of, milestone_report, run_baseline
from wheelmark.settings import SettingError, Settings
from wheelmark.sources import readers

SMALL = "/root/testdata/sf0.001"
KT = 1852 / 3600


def dms(d, m, s):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


def test_geodesic_against_a_published_line(spark):
    """Flinders Peak to Buninyong, the worked example of the Australian geodetic manual (GRS80): 54,972.271 m."""
    lat, lon, azimuth = dms(-37, 57, 3.72030), dms(144, 25, 29.52440), dms(306, 52, 5.37)
    there = with_steps(spark.createDataFrame([(lat, lon, azimuth, 54972.271)], "lat double, lon double, hdg double, d double"), direct_steps("lat", "lon", "hdg", "d"), keep=("d_lat", "d_lon")).first()
    assert there.d_lat == pytest.approx(dms(-37, 39, 10.15610), abs=3e-7) and there.d_lon == pytest.approx(dms(143, 55, 35.38390), abs=3e-7)
    rows = spark.createDataFrame([(lat, lon, azimuth, dms(-37, 39, 10.15610), dms(143, 55, 35.38390))], "lat double, lon double, hdg double, a double, b double")
    back = with_steps(rows, projection_steps("lat", "lon", "hdg", "a", "b"), keep=("p_along", "p_lateral")).first()
    assert back.p_along == pytest.approx(54972.271, abs=0.05) and abs(back.p_lateral) < 0.05


def test_monotone_curve_against_values_worked_by_hand(spark):
    """x = 0 1 2 4, y = 0 1 4 5: slopes 0, 3/2, 27/29, 0 by the harmonic means; at 1.5 the curve is 2.5 + 3/16 - 27/232."""
    samples = spark.createDataFrame([("A", i, float(t), float(y)) for i, (t, y) in enumerate(((0, 0), (1, 1), (2, 4), (4, 5)))], "flight_id string, seq int, t double, geo_alt double")
    asked = spark.createDataFrame([("A", 0.0), ("A", 1.5), ("A", 2.0), ("A", 3.0)], "flight_id string, q double")
    got = {r.q: r.alt for r in timebase.monotone_at(samples, asked, "geo_alt", "alt").collect()}
    # at 3: (4 + 5) / 2 + 2 * (27 / 29 - 0) / 8
    assert got[0.0] == 0 and got[2.0] == 4 and got[1.5] == pytest.approx(2.5 + 3 / 16 - 27 / 232) and got[3.0] == pytest.approx(4.5 + 2 * 27 / 29 / 8)


def test_knee_against_least_squares(spark):
    rnd = np.random.default_rng(4)
    rows, best = [], {}
    for f in range(6):
        t = np.sort(rnd.uniform(0, 90, 18))
        v = 70 - 0.15 * t - 1.3 * np.maximum(t - rnd.uniform(30, 60), 0) + rnd.normal(0, 0.4, 18)
        rows += [(f"F{f}", i, float(a), float(b / KT)) for i, (a, b) in enumerate(zip(t, v, strict=True))]
        found = []
        for i, k in enumerate(np.linspace(t[1], t[-2], min(400, max(60, 12 * 18)))):
            if (t < k).sum() >= 2 and (t > k).sum() >= 2:
                x = np.stack([np.ones(18), t, np.maximum(t - k, 0)], axis=1)
                beta = np.linalg.lstsq(x, v, rcond=None)[0]
                found.append((float(((v - x @ beta) ** 2).sum()), i, k, beta))
        best[f"F{f}"] = min(found)
    got = signals.knee(spark.createDataFrame(rows, "flight_id string, seq int, t double, gs_kt double")).collect()
    assert len(got) == 6
    for r in got:
        rss, _, k, beta = best[r.flight_id]
        assert (r.t_knee, r.slope_before, r.slope_drop, r.rms) == pytest.approx((k, beta[1], -beta[2], math.sqrt(rss / 18)), abs=1e-6)


def test_three_segments_against_least_squares(spark):
    rnd = np.random.default_rng(6)
    rows, best = [], {}
    for f in range(4):
        t = np.sort(rnd.uniform(0, 90, 16))
        v = 70 - 0.2 * t - 1.1 * np.maximum(t - 35, 0) + 0.9 * np.maximum(t - 65, 0) + rnd.normal(0, 0.3, 16)
        rows += [(f"F{f}", i, float(a), float(b / KT)) for i, (a, b) in enumerate(zip(t, v, strict=True))]
        u, found = t - t[0], []
        knots = [k for k in np.linspace(u[1], u[-2], 60) if (u < k).sum() >= 2 and (u > k).sum() >= 2]
        for i, a in enumerate(knots):
            for b in knots[i + 1 :]:
                if ((u > a) & (u < b)).sum() >= 2:
                    x = np.stack([np.ones(16), u, np.maximum(u - a, 0), np.maximum(u - b, 0)], axis=1)
                    found.append((float(((v - x @ np.linalg.lstsq(x, v, rcond=None)[0]) ** 2).sum()), t[0] + a, t[0] + b))
        best[f"F{f}"] = min(found)
    got = signals.three_segments(spark.createDataFrame(rows, "flight_id string, seq int, t double, gs_kt double")).collect()
    assert len(got) == 4
    for r in got:
        rss, a, b = best[r.flight_id]
        assert (r.t_first, r.t_second, r.rms) == pytest.approx((a, b, math.sqrt(rss / 16)), abs=1e-5)


def test_lags_against_one_by_one():
    rnd = np.random.default_rng(5)
    for _ in range(20):
        n = int(rnd.integers(10, 60))
        a, b = rnd.normal(size=n).cumsum(), rnd.normal(size=n).cumsum()
        for k, score in zip(*validation.lag_scores(a, b, n - 1), strict=True):
            x, y = (a[k:], b[: n - k]) if k >= 0 else (a[: n + k], b[-k:])
            assert len(x) >= max(3, n // 2) and score == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert validation.best_lag(np.ones(30), a[:30], 0.1, 1.0) == (None, 0.0)


@pytest.mark.parametrize("n, fractions, expected", [(10, [0.7, 0.15, 0.15], [7, 2, 1]), (3, [0.7, 0.15, 0.15], [2, 1, 0]), (0, [0.5, 0.5], [0, 0]), (5, [0, 0, 0], [5, 0, 0]), (7, [1, 1, 1], [3, 2, 2])])
def test_partition_counts(n, fractions, expected):
    assert validation.partition_counts(n, fractions) == expected


def test_clock_offsets_and_their_reasons(spark):
    t = np.arange(0, 120, 1.0)
    speed = lambda x: 60 - 20 * np.tanh((x - 60) / 8)
    rnd = np.random.default_rng(1)
    series = {
        "good": (speed(t), speed(t - 1.2)),
        "far": (speed(t), speed(t - 4.0)),
        "flat": (np.full(120, 50.0), speed(t)),
        "weak": (speed(t), 55 + rnd.normal(0, 3, 120)),
        "short": (speed(t[:10]), speed(t[:10])),
    }
    make = lambda k: spark.createDataFrame([(f, float(x), float(v)) for f, pair in series.items() for x, v in zip(t, pair[k], strict=False)], "flight_id string, t double, v double")
    got = {r.flight_id: r for r in validation.clock_offsets(make(0), make(1), max_drift=100.0).collect()}
    assert abs(abs(got["good"].offset_s) - 1.2) < 0.1 and got["good"].quality == "good" and not got["good"].excluded and got["good"].reason is None
    assert got["far"].quality == "failed" and got["far"].excluded and abs(abs(got["far"].offset_s) - 4) < 0.1
    assert {f: got[f].failure for f in ("flat", "weak", "short")} == {"flat": "degenerate_series", "weak": "weak_correlation", "short": "insufficient_overlap"}
    assert all(got[f].reason == "clock_offset_exceeded" and got[f].offset_s is None for f in ("flat", "weak", "short")) and got["weak"].correlation < 0.5
    assert {r.flight_id for r in validation.flagged_offsets(spark.createDataFrame(list(got.values()), validation.OFFSET_FIELDS)).collect()} == set(got) - {"good"}
    drifting = validation.clock_offsets(make(0), make(1), max_drift=0.0).where("flight_id = 'good'").first()
    assert drifting.drift_s == 0 or drifting.reason == "clock_offset_exceeded" and drifting.quality == "degraded"
    truth = spark.createDataFrame([(f, 100.0) for f in series], "flight_id string, true_t double")
    moved = {r.flight_id: (r.true_t, r.clock) for r in validation.apply_offsets(truth, spark.createDataFrame(list(got.values()), validation.OFFSET_FIELDS)).collect()}
    assert moved["good"] == (100 - got["good"].offset_s, "good") and moved["far"] == (100 - got["far"].offset_s, "failed") and moved["weak"] == (100.0, "failed")


def test_quantiles_by_rank(spark, monkeypatch):
    from wheelmark.operators import quantiles as q

    monkeypatch.setattr(q, "ACCURACY", 200)
    monkeypatch.setattr(q, "MARGIN", 0.02)
    rnd = np.random.default_rng(8)
    values = {"large": rnd.normal(0, 50, 6000), "ties": rnd.integers(0, 4, 3000).astype(float), "small": rnd.normal(0, 1, 7), "one": np.array([3.5]), "none": np.array([])}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("none", None), ("large", None)]
    table = spark.createDataFrame(rows, "k string, x double").withColumn("size", F.abs("x")).repartition(5)
    wanted = {"low": ("x", 0.25), "mid": ("x", 0.5), "top": ("x", 0.99), "p95": ("size", 0.95), "least": ("x", 0.0), "most": ("x", 1.0)}
    for r in q.quantiles(table, ["k"], wanted).collect():
        for name, (column, at) in wanted.items():
            v = values[r.k] if column == "x" else np.abs(values[r.k])
            assert r[name] == pytest.approx(np.quantile(v, at)) if len(v) else r[name] is None
    kinds = "flight_id string, aircraft_type string, source string, airport string, est_ft double, true_ft double, low_ft double, high_ft double, est_t double, true_t double, clock string, est_kt double, true_kt double"
    evals = spark.createDataFrame([(str(i), None if i % 7 == 0 else f"T{i % 3}", "aireon", f"A{i % 11}", None if i % 13 == 0 else float(x), 0.0, -50.0, 50.0, 1.0, 1.5, "good", 130.0, float(100 + i % 90)) for i, x in enumerate(rnd.normal(0, 80, 900))], kinds)
    got = validation.stratified_metrics(evals).toPandas().set_index(["dimension", "key"])
    own = evals.toPandas()
    own["e"] = own.est_ft - own.true_ft
    for (dimension, key), part in [(("overall", "all"), own), *[(("airport", k), g) for k, g in own.groupby("airport")], *[(("aircraft_type", k or "all"), g) for k, g in own.fillna({"aircraft_type": ""}).groupby("aircraft_type")]]:
        e, r = part.e.dropna(), got.loc[(dimension, key)]
        want = [e.abs().median(), e.median(), np.quantile(e.abs(), 0.95), np.quantile(e.abs(), 0.99), np.quantile(e[e > 0], 0.95), np.quantile(e, 0.25), np.quantile(e, 0.75)]
        assert [r[c] for c in validation.QUANTILES] == pytest.approx(want) and r.n_flights == len(part) and r.n_estimates == len(e)
    part = lambda c: evals.select("flight_id", F.col(c).alias("along_m"))
    one = validation.distance_error_summary(part("est_ft"), part("est_kt"), part("true_kt")).first()
    e = (own.est_ft - own.true_kt).dropna()
    assert (one.n, one.median_abs_m, one.median_signed_m, one.p95_abs_m) == pytest.approx((len(e), e.abs().median(), e.median(), np.quantile(e.abs(), 0.95)))
    floor = validation.error_floor(evals, 2.0).first()
    assert floor.median_kt == pytest.approx(own.true_kt.median()) and floor.median_floor_ft == pytest.approx(own.true_kt.median() * 1852 / 3600 / 0.3048 * 2)
    offsets = spark.createDataFrame([(float(x),) for x in rnd.normal(0, 2, 500)] + [(None,)], "offset_s double")
    x = offsets.toPandas().offset_s.dropna()
    spread = validation.offset_distribution(offsets).first()
    assert (spread.n, spread.median_s, spread.sd_s, spread.p95_abs_s) == pytest.approx((500, x.median(), x.std(ddof=0), np.quantile(x.abs(), 0.95)))
    assert tuple(validation.offset_distribution(offsets.limit(0)).first()) == (0, None, None, None)


@pytest.mark.parametrize("fits", [40, 700])
def test_brackets_narrow_until_they_fit(spark, monkeypatch, fits):
    """However the values lie: a window never ranks more than FITS of them, and the quantiles stay exact."""
    from wheelmark.operators import quantiles as q

    monkeypatch.setattr(q, "ACCURACY", 300)
    monkeypatch.setattr(q, "MARGIN", 0.2)
    monkeypatch.setattr(q, "FITS", fits)
    monkeypatch.setattr(q, "PARTS", 8)
    rnd = np.random.default_rng(3)
    values = {"even": rnd.random(9000), "tail": rnd.standard_cauchy(9000) ** 3, "ties": np.concatenate([np.full(6000, 2.5), rnd.random(3000) * 5]), "steps": np.floor(rnd.random(9000) * 900)}
    table = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "k string, x double").repartition(5)
    wanted = {f"q{p}": ("x", p / 100) for p in (0, 1, 25, 50, 66, 95, 100)}
    for r in q.quantiles(table, ["k"], wanted).collect():
        for name, (_, p) in wanted.items():
            assert r[name] == pytest.approx(np.quantile(values[r.k], p)), (r.k, name)
    wide = q._bracketed(table, ["k"], wanted)
    largest = lambda met: met.where("y IS NOT NULL").groupBy("k", "name").count().agg(F.max("count")).first()[0]
    assert largest(wide) > fits >= largest(q.narrowed(wide, ["k"]))


def test_class_priors(spark):
    rows = [(i * 4.0, (60 if i <= 8 else 60 - 2.5 * 4 * (i - 8)) / KT) for i in range(13)]
    v = spark.createDataFrame([(f, i, t, x) for f in "ABC" for i, (t, x) in enumerate(rows)], "flight_id string, seq int, t double, gs_kt double")
    flights = spark.createDataFrame([("A", "regional"), ("B", "unheard of"), ("C", None)], "flight_id string, aircraft_class string")
    assert {r.flight_id: r.confidence for r in estimators.decel_knee(flights, v).collect()} == {"A": "normal", "B": "normal", "C": "normal"}
    fast = v.withColumn("gs_kt", v.gs_kt + 25 / KT)
    assert {r.flight_id: r.confidence for r in estimators.decel_knee(flights, fast).collect()} == {"A": "low-confidence", "B": "normal", "C": "normal"}


def test_streams_are_checked(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "flight_id string, message_type string, seq int, timestamp double")
    good = make(("A", "position", 0, 1.0), ("A", "velocity", 1, 2.0))
    pos, vel = readers.split_messages(good, strict=True, single=True)
    assert pos.count() == vel.count() == 1
    for bad, single in ((good.limit(0), False), (make(("A", "odd", 0, 1.0)), False), (make(("A", "position", 0, 1.0), ("B", "position", 0, 1.0)), True)):
        with pytest.raises(ValueError):
            readers.split_messages(bad, strict=True, single=single)
    readers.split_messages(make(("A", "position", 0, 1.0), ("B", "position", 0, 1.0)), strict=True)


def test_feeds_by_other_names_and_by_override(spark):
    flights = spark.createDataFrame([("A", "aireon"), ("B", "flightradar24"), ("C", "unheard of")], "flight_id string, source string")
    table = spark.createDataFrame([("aireon", True, True), ("fr24", False, False)], "source string, has_geometric_altitude boolean, samples_are_raw boolean")
    assert {tuple(r) for r in quality.feed_capability(flights, table).collect()} == {("A", True, True), ("B", False, False), ("C", True, True)}
    assert {r.samples_independent for r in quality.feed_capability(flights, table, {"has_geometric_altitude": True, "samples_are_raw": False}).collect()} == {False}
    assert {(r.flight_id, r.eligible) for r in quality.gate_estimators(flights, table, ["imm_rts"]).collect()} == {("A", True), ("B", False), ("C", True)}


def test_settings():
    own = Settings.of({"quality_gates": {"max_turn_rate_deg_s": 5}, "validation": {"train_fraction": 0.8, "calibration_fraction": 0.1, "test_fraction": 0.1}})
    assert own.quality_gates.max_turn_rate_deg_s == 5.0 and gates_of(own).turn_deg_s == 5.0 and gates_of(own).lateral_g == 0.5
    assert own.hash() != Settings().hash() == Settings.of({}).hash() and len(own.hash()) == 64
    for bad in ({"odd": {}}, {"pipeline": {"ads_b_source": "other"}}, {"quality_gates": {"max_excluded_fraction": 2}}, {"quality_gates": {"min_samples_in_window": "3"}}, {"validation": {"train_fraction": 0.9}}, {"estimators": {"enabled": "glrt"}}, {"pipeline": 3}):
        with pytest.raises(SettingError):
            Settings.of(bad)


def test_diagnostics_and_co_timed_streams(spark):
    v = spark.createDataFrame([("A", i, t, s, 90.0, None) for i, (t, s) in enumerate(((0.0, 100.0), (0.05, 100.0), (1.0, 200.0), (2.0, 100.0), (3.0, 99.0)))], "flight_id string, seq int, t double, gs_kt double, track double, vr_fpm double")
    p = spark.createDataFrame([("A", i, t, 0.0, 0.0) for i, t in enumerate((0.0, 0.05, 1.0, 2.0, 3.0))], "flight_id string, seq int, t double, lat double, lon double")
    pos, gated = quality.run_qa(p, v)
    r = quality.diagnostics(p, v, gated).first()
    assert (r.n_duplicates_removed, r.n_excluded, r.counts_by_gate, r.excluded_times, r.vertical_rate_unavailable) == (2, 2, {"longitudinal": 2}, [1.0, 2.0], True)
    assert sorted(x.t for x in pos.collect()) == [0.05, 3.0]


def test_sequence_channels_against_numpy(spark):
    corpus = Landing.synthetic(spark, SMALL)
    rows = channels.sequence_input(corpus.flights, corpus.positions, corpus.velocities).toPandas()
    assert len(rows) and not rows.duplicated(["flight_id", "i"]).any()
    placed = channels.position_channels(corpus.flights, corpus.positions).toPandas()
    for f in random.Random(1).sample(sorted(rows.flight_id.unique()), 8):
        own, src = rows[rows.flight_id == f].sort_values("i"), placed[placed.flight_id == f].sort_values(["t", "seq"])
        for c, flag in (("along_m", "has_along"), ("height_m", "has_height")):
            ok = src[c].notna()
            if ok.sum() < 2:
                assert own[c].isna().all() and (own[flag] == 0).all()
            else:
                assert np.allclose(own[c], np.interp(own.t, src.t[ok], src[c][ok])) and (own[flag] == 1).all()
        assert np.allclose(own.dt.iloc[1:], np.diff(own.t)) or corpus.velocities.where(f"flight_id = '{f}' AND gs_kt IS NULL").count() >= 0


def test_whole_job_on_the_smallest_table(spark):
    """Every estimator against the truth of the synthetic landings; go-arounds get no estimate; the hash is in the record."""
    corpus = Landing.synthetic(spark, SMALL)
    truth = corpus.flights.select("flight_id", "kind", "t_true").toPandas().set_index("flight_id")
    one = estimators.imm(corpus.flights, corpus.positions, corpus.velocities).toPandas().set_index("flight_id")
    done = one[(truth.kind.reindex(one.index) == "completed") & one.t_td.notna()]
    assert len(done) >= 0.5 * (truth.kind == "completed").sum() and (done.t_td - truth.t_true.reindex(done.index)).abs().median() < 6
    run = run_baseline(corpus).toPandas().set_index("flight_id")
    assert set(run.index) == set(truth.index) and run[run.status != "ok"].t_td.isna().all()
    some = run[(truth.kind.reindex(run.index) == "completed") & run.t_td.notna()]
    assert len(some) > 0.7 * (truth.kind == "completed").sum() and (some.t_td - truth.t_true.reindex(some.index)).abs().median() < 4
    records = full_product(corpus).toPandas().set_index("flight_id")
    assert set(records.index) == set(truth.index) and set(records.config_hash) == {Settings().hash()}
    away = truth[truth.kind == "go_around"].index
    assert (records.confidence.reindex(away) == "no-estimate").all()


def test_streaming_detector_against_a_loop(spark):
    from wheelmark.streaming.cusum import replay

    got = {r.series: (r.arm, r.n) for r in replay(spark, SMALL).collect()}
    want = {}
    for user, rows in pd.read_parquet(f"{SMALL}/events.parquet").groupby("user_id"):
        n, mean, m2, hi, lo = 0, 0.0, 0.0, 0.0, 0.0
        for x in rows.sort_values("ts", kind="stable").value:
            if pd.isna(x):
                continue
            if n >= 8 and m2 > 0:
                z = (x - mean) / math.sqrt(m2 / n)
                hi, lo = max(0, hi + z - 0.5), min(0, lo + z + 0.5)
                if hi > 5 or lo < -5:
                    want[user] = ("hi" if hi > 5 else "lo", n)
                    break
            n += 1
            delta = x - mean
            mean += delta / n
            m2 += delta * (x - mean)
    assert got == want


def test_summary_rows(spark):
    rows = {(r.section, r.name): (r.value, r.text) for r in milestone_report(Landing.synthetic(spark, SMALL), ("decel_knee", "glrt"))["summary"].collect()}
    assert ("overall", "rmse_ft") in rows and ("coverage", "status") in rows and rows["flags", "below_target"][0] >= 0
    rmse, floor = rows["overall", "rmse_ft"][0], rows["floor", "floor_ft"][0]
    assert rows["room", "headroom_ft"][0] == pytest.approx(max(rmse - floor, 0)) and rows["room", "ratio_to_floor"][0] == pytest.approx(rmse / floor)


def _all_cuts(x, penalty, min_seg):
    """Every earlier sample as the last change."""
    f, last = [-penalty, *[None] * len(x)], [0] * (len(x) + 1)
    for e in range(min_seg, len(x) + 1):
        found = [(round(f[s] + float(((x[s:e] - x[s:e].mean()) ** 2).sum()) + penalty, 10), s) for s in range(e - min_seg + 1) if f[s] is not None]
        f[e], last[e] = min(found)
    cuts, at = [], last[-1]
    while at > 0:
        cuts.append(at)
        at = last[at]
    return cuts[::-1]


@pytest.mark.parametrize("min_seg", [1, 2, 5])
def test_pruned_cuts_are_the_best(min_seg):
    from wheelmark.operators.estimators import optimal_cuts

    rng = np.random.default_rng(min_seg)
    for trial in range(60):
        n = int(rng.integers(2, 70))
        x = np.repeat(rng.normal(0, 3, n), rng.integers(1, 9, n))[:n] + rng.normal(0, rng.choice([0.1, 1.0]), n)
        if trial % 5 == 0:
            x = np.round(x)  # ties
        penalty = float(rng.choice([0.5, 3.0, 20.0]))
        assert optimal_cuts(x, penalty, min_seg) == (_all_cuts(x, penalty, min_seg) if n >= 2 * min_seg else []), trial
    assert optimal_cuts(np.ones(40), 1.0) == []


def test_pruned_cuts_take_linear_time():
    import time

    from wheelmark.operators.estimators import optimal_cuts

    rng, took = np.random.default_rng(1), {}
    for n in (2_500, 10_000):
        x = rng.normal(size=n)
        began = time.process_time()
        assert optimal_cuts(x, 3 * math.log(n)) == []
        took[n] = time.process_time() - began
    assert took[10_000] < 8 * took[2_500] and took[10_000] < 5
