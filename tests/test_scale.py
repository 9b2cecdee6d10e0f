"""What keeps the work of large tables spread over tasks, and in whole batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wheelmark.functions import geodesy
from wheelmark.functions.exprs import direct_steps, projection_steps, with_steps
from wheelmark.operators import fusion, signals
from wheelmark.sources import synth

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flights_are_spread_before_they_become_samples(spark):
    for made in (synth.positions, synth.velocities, synth.recorder):
        rows = made(spark, SF)
        assert rows.rdd.getNumPartitions() == 4
        assert rows.groupBy("flight_id", F.spark_partition_id().alias("p")).count().groupBy("flight_id").count().where("count > 1").isEmpty()
    # What groups samples by flight has the one exchange of the flights below.
    assert plan(synth.velocities(spark, SF).groupBy("flight_id").agg(F.max("t"))).count("Exchange") == 1


def test_more_flights_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(synth, "FLIGHTS_PER_TASK", 10)
    n = synth.flights(spark, SF).count()
    assert synth.positions(spark, SF).rdd.getNumPartitions() == max(4, -(-n // 10))


def test_knots_are_searched_in_whole_batches(spark):
    assert "ArrowEvalPython" in plan(signals.knee(synth.velocities(spark, SF)))
    row = {"i0": 0, "i1": 9, "j": 3, "u": -1.0, "low": -2.0, "step": 0.5, "n": 10, "m": 6, "s1": 12.0, "s2": 40.0, "sv": -9.0, "suv": -30.0, "tuu": 90.0, "tuv": -60.0, "tvv": 70.0}
    bare = row | {"j": 0}  # one sample at most before each knot
    flat = row | {"sv": 0.0, "suv": 0.0, "tuv": 0.0, "tvv": 0.0}  # all knots are equally good
    found = signals.best_knots(pd.DataFrame([row, bare, flat]))
    def rss(i):
        k = row["low"] + i * row["step"]
        x = np.array([row["s2"] - k * row["s1"], row["suv"] - k * row["sv"]])
        d = row["s2"] - 2 * k * row["s1"] + row["m"] * k * k - (row["s1"] - row["m"] * k) ** 2 / row["n"] - x[0] ** 2 / row["tuu"]
        return max(row["tvv"] - row["tuv"] ** 2 / row["tuu"] - (x[1] - row["tuv"] / row["tuu"] * x[0]) ** 2 / d, 0.0)
    best = min(range(10), key=lambda i: (round(rss(i), 6), i))
    assert found.i[0] == best and found.exact[0] == pytest.approx(rss(best))
    assert pd.isna(found.i[1])
    assert found.i[2] == 0 and found.rss[2] == 0


def test_geodesics_in_batches_are_those_of_the_expressions(spark):
    rows = spark.createDataFrame([(10.0, 20.0, 30.0, 10.01, 20.02, 500.0), (-37.9, 144.4, 306.0, -37.6, 143.9, -54972.271), (51.0, 0.0, 90.0, 51.0, 0.0, 0.0), (51.0, 0.0, None, 51.0, None, None)], "a double, b double, h double, lat double, lon double, d double")
    both = with_steps(with_steps(rows, projection_steps("a", "b", "h", "lat", "lon"), keep=("p_along", "p_lateral")), direct_steps("a", "b", "h", "d"), keep=("d_lat", "d_lon"))
    both = both.withColumns({"x": geodesy.projected("a", "b", "h", "lat", "lon"), "y": geodesy.reckoned("a", "b", "h", "d")})
    for r in both.collect():
        old, new = (r.p_along, r.p_lateral, r.d_lat, r.d_lon), (r.x.along, r.x.lateral, r.y.lat, r.y.lon)
        assert [v is None for v in old] == [v is None for v in new]
        assert [v for v in new if v is not None] == pytest.approx([v for v in old if v is not None], rel=1e-11, abs=1e-7)
    assert "ArrowEvalPython" in plan(fusion.project(synth.positions(spark, SF).select("flight_id", "lat", "lon"), synth.flights(spark, SF)))


def test_flights_cut_by_batches_stay_whole(spark):
    import pyarrow as pa

    from wheelmark.functions.flights import in_flights, numbers

    def run(batch, starts):
        ends = [*starts[1:].tolist(), batch.num_rows]
        t = numbers(batch, "t")
        return pa.RecordBatch.from_arrays([batch["flight_id"].take(pa.array(starts)), pa.array([b - a for a, b in zip(starts.tolist(), ends)], pa.int64()), pa.array([bool((np.diff(t[a:b]) > 0).all()) for a, b in zip(starts.tolist(), ends)])], names=["flight_id", "n", "up"])

    rows = spark.range(400).selectExpr("CASE WHEN id < 100 THEN 'a' WHEN id < 103 THEN NULL WHEN id = 103 THEN '' ELSE concat('f', id % 7) END AS flight_id", "CAST(400 - id AS DOUBLE) AS t").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        found = sorted(((str(r.flight_id), r.n, r.up) for r in in_flights(rows, [F.col("t")], run, "flight_id string, n long, up boolean").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counts = {f"f{k}": sum(i % 7 == k for i in range(104, 400)) for k in range(7)}
    assert sorted(f"{f} {n}" for f, n, _ in found) == sorted(f"{f} {n}" for f, n in ({"a": 100, "None": 3, "": 1} | counts).items())
    assert all(up for *_, up in found)


@pytest.mark.parametrize("name", ["kinematic_gates", "knee_3seg", "smoothed_process", "clock_offsets", "estimator_imm"])
def test_no_group_has_a_call_of_its_own(spark, name):
    import __spark_entry__ as entry

    text = plan(entry.queries()[name](spark, SF))
    assert "MapInArrow" in text and "FlatMapGroups" not in text and "FlatMapCoGroups" not in text


def test_local_sums_are_taken_in_batches(spark):
    v = synth.velocities(spark, SF)
    assert "MapInArrow" in plan(signals.derivatives(v))
    rows = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 1.0, 3.0), ("a", 2, 1.5, 9.0), ("a", 3, 5.0, 2.0), ("b", 0, 0.0, 5.0), ("b", 1, 2.0, 1.0), ("b", 2, 4.0, 5.0)], "flight_id string, seq int, t double, gs_kt double")
    found = {(r.flight_id, r.i): r for r in signals.derivatives(rows, 3).collect()}
    assert {k: r.n for k, r in found.items()} == {(f, i): 3 for f, m in (("a", 4), ("b", 3)) for i in range(m)}
    assert found["b", 1].jerk == pytest.approx(2 * 1852 / 3600) and found["b", 1].decel == pytest.approx(0)
    three = np.polyfit(np.array([0.0, 1.0, 1.5]) - 1.0, np.array([0.0, 3.0, 9.0]) * 1852 / 3600, 2)
    assert (found["a", 1].jerk, found["a", 1].decel) == pytest.approx((2 * three[0], three[1]))


def test_skip_cascade_makes_no_row_for_each_column(spark):
    from wheelmark.sources import raw, readers

    made = plan(readers.flights_of(raw.adsb(spark, SF), raw.runways(spark, SF)))
    assert "Expand" not in made
    assert raw.adsb(spark, SF).rdd.getNumPartitions() == 4  # one file, and several tasks
    rows = raw.adsb(spark, SF).where("flight_id = 'F00000001'").drop("landing_latitude", "lda_day").selectExpr("*", "CASE WHEN input_pos % 10 = 0 THEN NULL WHEN input_pos % 10 = 1 THEN -0e0 ELSE 0e0 END AS landing_latitude", "CAST(input_pos % 10 AS DOUBLE) AS lda_day")
    found = readers.flights_of(rows, raw.runways(spark, SF)).first()
    assert (found.skip_reason, found.skip_detail) == ("inconsistent_per_flight_constant", "lda_day")


def test_what_change_points_start_from_is_made_once(spark, monkeypatch):
    from wheelmark.operators import estimators
    from wheelmark.plans.landing import Landing

    made = []
    own = estimators.signal
    monkeypatch.setattr(estimators, "signal", lambda v: made.append(v) or own(v))
    rows = Landing.synthetic(spark, SF).estimates(("glrt", "cusum", "pelt", "jerk_onset"))
    assert len(made) == 1 and rows.count() == 4 * synth.flights(spark, SF).count()


def test_changes_of_flights_side_by_side_are_those_of_each(monkeypatch):
    from wheelmark.operators import estimators

    random = np.random.default_rng(3)
    for n in (4, 5, 21, 60):
        x = random.normal(size=(30, n)) + np.where(np.arange(n) > n // 2, 3.0, 0.0) * random.integers(0, 2, (30, 1))
        penalty = random.uniform(0.5, 6.0, 30)
        last = estimators.last_changes(x, penalty)
        for f in range(30):
            cuts, at = [], last[f, n]
            while at > 0:
                cuts.append(int(at))
                at = last[f, at]
            assert cuts[::-1] == estimators.optimal_cuts(x[f], float(penalty[f]))


def test_few_queries_look_through_their_flights_samples(spark):
    from wheelmark.operators import timebase

    assert "Window" not in plan(timebase.position_at(synth.positions(spark, SF), synth.velocities(spark, SF), synth.flights(spark, SF).selectExpr("flight_id", "t_true AS q"), few=True))
    samples = spark.createDataFrame([("a", 0, 1.0, 5.0), ("a", 1, 2.0, None), ("a", 2, 2.0, 7.0), ("a", 3, None, 9.0), ("b", 0, None, 1.0), ("d", 0, 4.0, 1.0)], "flight_id string, seq int, t double, y double")
    at = spark.createDataFrame([(f, q, i) for f in "abcd" for i, q in enumerate((None, 0.5, 1.0, 1.5, 2.0, 2.5, 4.0))], "flight_id string, q double, k int")
    rows = lambda few: sorted(map(repr, timebase.bracket(samples, at, ["y"], few=few).collect()))
    assert rows(True) == rows(False) and len(rows(True)) == 28


def test_runways_are_not_sent_through_the_driver(spark):
    # Small by Spark's estimate; there is one for each flight all the same.
    text = plan(fusion.project(synth.positions(spark, SF), synth.flights(spark, SF)))
    assert "Broadcast" not in text and text.count("REPARTITION_BY_NUM") == 1 and "SortMergeJoin" in text
    rows = spark.createDataFrame([("a", 50.0, 8.0), ("a", None, 8.0), ("b", 50.0, 8.001), ("c", 1.0, 1.0), (None, 1.0, 1.0)], "flight_id string, lat double, lon double")
    runways = spark.createDataFrame([("a", 50.0, 8.0, 90.0), ("b", 50.0, 8.0, 90.0), ("d", 0.0, 0.0, 0.0), (None, 1.0, 1.0, 0.0)], "flight_id string, thr_lat double, thr_lon double, heading double")
    found = sorted((r.flight_id, r.lat is None, None if r.p_along is None else round(r.p_along, 1)) for r in fusion.project(rows, runways).collect())
    assert [x[:2] for x in found] == [("a", False), ("a", True), ("b", False)] and found[0][2] == 0.0 and found[1][2] is None and found[2][2] == pytest.approx(71.7, abs=0.1)
