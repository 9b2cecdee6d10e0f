"""Known answers and small models of the landing operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wheelmark.functions.exprs import direct_steps, projection_steps, with_steps
from wheelmark.operators import classify, estimators, fusion, quality, signals, timebase, validation
from wheelmark.sources import readers


def velocities(spark, rows):
    return spark.createDataFrame([("A", i, float(t), None if v is None else float(v), 90.0, 0.0) for i, (t, v) in enumerate(rows)], "flight_id string, seq int, t double, gs_kt double, track double, vr_fpm double")


def test_projection_round_trip(spark):
    rows = spark.createDataFrame([(40.0, -73.0, 43.9, d) for d in (0.0, 10.0, 800.0, 3000.0, -50.0)], "lat double, lon double, hdg double, d double")
    there = with_steps(rows, direct_steps("lat", "lon", "hdg", "d"), keep=("d_lat", "d_lon"))
    back = with_steps(there, projection_steps("lat", "lon", "hdg", "d_lat", "d_lon"), keep=("p_along", "p_lateral")).collect()
    assert all(abs(r.p_along - r.d) < 0.1 and abs(r.p_lateral) < 0.1 for r in back)


def test_dedup_anchors_on_the_first_time(spark):
    kept = quality.dedup(velocities(spark, [(0.0, 1), (0.08, 2), (0.16, 3)])).orderBy("t").collect()
    assert [r.t for r in kept] == [0.08, 0.16]


def test_gates_drop_a_spike_and_what_follows_it(spark):
    rows = quality.kinematic_gates(velocities(spark, [(0, 100), (1, 200), (2, 100), (3, 99)])).orderBy("t").collect()
    assert [r.gate for r in rows] == [None, "longitudinal", "longitudinal", None]


def test_bracket_clamps_and_keeps_null_neighbours(spark):
    samples = velocities(spark, [(0, 10), (1, None), (2, 30)])
    asked = spark.createDataFrame([("A", -1.0), ("A", 0.5), ("A", 2.0), ("A", 5.0)], "flight_id string, q double")
    found = {r.q: r.gs_kt for r in timebase.velocity_at(samples, asked).collect()}
    assert found == {-1.0: 10.0, 0.5: None, 2.0: None, 5.0: 30.0}


def test_track_goes_the_short_way(spark):
    rows = spark.createDataFrame([("A", 0, 0.0, 1.0, 350.0), ("A", 1, 2.0, 1.0, 10.0)], "flight_id string, seq int, t double, gs_kt double, track double")
    asked = spark.createDataFrame([("A", 1.5)], "flight_id string, q double")
    assert timebase.velocity_at(rows, asked).first().track_deg == pytest.approx(5.0)


def test_knee_is_found_on_two_lines(spark):
    rows = [(t, (70 - 0.2 * t if t <= 40 else 62 - 1.5 * (t - 40)) * 3600 / 1852) for t in np.arange(0, 80, 4.0)]
    fit = signals.knee(velocities(spark, rows)).first()
    assert abs(fit.t_knee - 40) < 0.4 and abs(fit.slope_after + 1.5) < 0.02


def test_change_points_against_small_models(spark):
    rnd = random.Random(3)
    flights = spark.createDataFrame([("A",)], "flight_id string")
    for _ in range(3):
        v, rows = 75.0, []
        for i in range(20):
            v -= (0.2 if i < 11 else 1.6) * 4 + rnd.uniform(-0.05, 0.05)
            rows.append((i * 4.0, v * 3600 / 1852))
        df = velocities(spark, rows)
        x = np.array([r.x for r in estimators.signal(df).orderBy("i").collect()])
        n, var = len(x), max(float(np.var(np.diff(x)) / 2), 1e-4)
        best = max(range(2, n - 1), key=lambda k: k * (n - k) / n * (x[:k].mean() - x[k:].mean()) ** 2)
        got = estimators.glrt(flights, df).first()
        assert abs(got.t_td - best * 4.0) < 8.0
        # PELT: the optimum by trying all segmentations with a recursion of its own
        penalty = 2 * var * math.log(n)
        cost = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
        f, cut = {0: -penalty}, {}
        for e in range(2, n + 1):
            options = [(f[s] + cost(s, e) + penalty, s) for s in f if e - s >= 2]
            if options:
                f[e], cut[e] = min(options)
        cuts, e = [], n
        while e > 0:
            e = cut[e]
            cuts.insert(0, e)
        cuts = [c for c in cuts if c]
        edges = [0, *cuts, n]
        drop = max(range(len(cuts)), key=lambda j: x[edges[j] : edges[j + 1]].mean() - x[edges[j + 1] : edges[j + 2]].mean())
        pelt = estimators.pelt(flights, df).first()
        assert abs(pelt.t_td - edges[drop + 1] * 4.0) < 10.0
        assert abs(estimators.cusum(flights, df).first().t_td - 44) < 16


def test_fusion_adds_the_spread_between_estimates(spark):
    rows = spark.createDataFrame([("A", "decel_knee", 10.0, 1.0, "normal", None), ("A", "glrt", 14.0, 1.0, "normal", None), ("A", "cusum", 99.0, 9.0, "normal", None), ("B", "glrt", None, None, "failed", "x")], "flight_id string, method string, t_td double, sigma_t double, confidence string, reason_code string")
    got = {r.flight_id: r for r in fusion.fuse(rows).collect()}
    assert got["A"].t_td == pytest.approx(12) and got["A"].sigma_t == pytest.approx(math.sqrt(0.5 + 4)) and got["A"].contributing == "decel_knee,glrt"
    assert got["B"].confidence == "no-estimate" and got["B"].reason_code == "all_estimators_failed"


def test_conformal_is_an_order_statistic(spark):
    scores = [random.Random(1).random() for _ in range(37)]
    got = fusion.conformal_multiplier(spark.createDataFrame([(s,) for s in scores], "score double")).first()
    assert got.multiplier == sorted(scores)[math.ceil(38 * 0.9) - 1]


def test_clamp_and_transition(spark):
    pos = spark.createDataFrame([("A", i, float(i), i in (0, 3, 4)) for i in range(5)], "flight_id string, seq int, t double, on_ground boolean")
    edge = classify.transition(pos)
    assert edge.first().on_ground_t == 3.0
    est = spark.createDataFrame([("A", "m", 4.0, 1.0, "normal", None)], "flight_id string, method string, t_td double, sigma_t double, confidence string, reason_code string")
    got = estimators.clamp_to_ground(est, edge).first()
    assert got.t_td == pytest.approx(2.999) and got.sigma_t == pytest.approx(math.hypot(1, 1.001))


def test_partition_counts_and_splits(spark):
    assert validation.partition_counts(10, [0.7, 0.15, 0.15]) == [7, 2, 1]
    rows = spark.createDataFrame([(f"f{i}", f"t{i % 11}", f"a{i % 5}", float(i % 3)) for i in range(60)], "flight_id string, tail string, airport string, heading double")
    splits = validation.validation_splits(rows)
    again = validation.validation_splits(rows)
    assert sorted(splits.collect()) == sorted(again.collect()) and splits.count() == 60
    assert splits.join(rows, "flight_id").groupBy("tail").agg(F.count_distinct("primary_split").alias("n")).where("n > 1").isEmpty()


def test_splits_keep_every_flight(spark):
    """Flights without a tail, an airport or a runway have places too, and are one group each."""
    cells = [(f"f{i}", None if i % 4 == 0 else f"t{i % 7}", None if i % 5 == 0 else f"a{i % 3}", None if i % 6 == 0 else float(i % 2)) for i in range(60)]
    rows = spark.createDataFrame(cells, "flight_id string, tail string, airport string, heading double")
    got = {r.flight_id: r for r in validation.validation_splits(rows).collect()}
    assert len(got) == 60 and all(None not in tuple(r) for r in got.values())
    for column, missing in (("primary_split", lambda c: c[1] is None), ("airport_split", lambda c: c[2] is None), ("runway_split", lambda c: c[2] is None or c[3] is None)):
        assert len({got[c[0]][column] for c in cells if missing(c)}) == 1
    assert validation.validation_splits(rows.limit(0)).isEmpty()


@pytest.mark.parametrize("buckets", [1, 4, 1 << 16])
def test_splits_are_exact_and_the_same_way_at_every_size(spark, monkeypatch, buckets):
    monkeypatch.setattr(validation, "DRIVER_KEYS", 50, raising=False)
    rows = spark.range(997).selectExpr("concat('f', id) AS flight_id", "concat('t', id) AS tail")
    seed = np.random.SeedSequence(5)
    cut = lambda **kw: {r.flight_id: r.split for r in validation.grouped_split(rows, "tail", ["a", "b", "c"], [0.7, 0.15, 0.15], seed, **kw).collect()}
    got = cut(buckets=buckets)
    assert [list(got.values()).count(x) for x in "abc"] == validation.partition_counts(997, [0.7, 0.15, 0.15])
    assert got == cut()


def test_clock_offset_is_recovered(spark):
    t = np.arange(0, 120, 1.0)
    speed = lambda x: 60 - 20 * np.tanh((x - 60) / 8)
    a = spark.createDataFrame([("A", float(x), float(speed(x))) for x in t], "flight_id string, t double, v double")
    b = spark.createDataFrame([("A", float(x), float(speed(x - 1.2))) for x in t], "flight_id string, t double, v double")
    got = validation.clock_offsets(a, b).first()
    assert abs(abs(got.offset_s) - 1.2) < 0.15 and got.quality in ("good", "degraded")


def test_reading_is_tolerant(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    spark.createDataFrame([("yes", "1.5"), (" F ", "x"), ("?", "")], "flag string, n string").write.option("header", True).csv(path)
    rows = readers.load(spark, path)
    got = rows.select(readers.to_boolean("flag", rows.schema["flag"].dataType).alias("b"), F.col("n").try_cast("double").alias("n")).collect()
    assert {(r.b, r.n) for r in got} == {(True, 1.5), (False, None), (None, None)}
    with pytest.raises(readers.RawFileError):
        readers.load(spark, "x.xls")
    with pytest.raises(readers.RawFileError):
        readers.require(rows, readers.ADSB_SCHEMA, "rows")


def test_the_full_product_cleans_gates_and_brackets(spark):
    from wheelmark.plans import landing as plans
    from wheelmark.sources import synth

    d = "/root/testdata/sf0.001"
    flights = synth.flights(spark, d).where("k < 40").persist()
    own = lambda df: df.join(flights.select("flight_id"), "flight_id", "left_semi")
    corpus = plans.Landing(flights, own(synth.positions(spark, d)), own(synth.velocities(spark, d)))
    bracketed = {r.flight_id for r in corpus.brackets().where("status = 'ok'").collect()}
    rows = plans.full_product(corpus).select("flight_id", "touchdown_time", "contributing_estimators", "ads_b_source").collect()
    assert len(rows) == flights.count() > len(bracketed) > 0
    assert all(r.touchdown_time is None for r in rows if r.flight_id not in bracketed)
    assert any(r.touchdown_time is not None for r in rows)
    assert not any({"flare_crossing", "imm_rts"} & set(r.contributing_estimators.split(",")) for r in rows if r.ads_b_source == "fr24")


def test_all_query_times_have_a_place_and_all_features_a_column(spark):
    from wheelmark import queries as q
    from wheelmark.operators import learned

    d, own = "/root/testdata/sf0.001", q.queries()
    assert {"touchdown_results_all", "rare_type_estimates"} <= set(own)
    rows = own["interpolate_position_all"](spark, d)
    assert {r.o for r in rows.select("o").distinct().collect()} == {-1e3, -7.3, 0.0, 2.5, 1e3}
    assert own["window_features_all"](spark, d).columns == ["flight_id", *learned.FEATURES]
