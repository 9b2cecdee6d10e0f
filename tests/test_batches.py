"""What was measured to cost most on larger tables: passes over samples that stay passes over flights."""

from __future__ import annotations

import numpy as np
import pytest

from wheelmark.functions.tables import shared_folder
from wheelmark.operators import classify, estimators, quality, signals
from wheelmark.sources import synth

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_classes_and_change_points_have_no_window_over_samples(spark):
    f, p, v = synth.flights(spark, SF), synth.positions(spark, SF), synth.velocities(spark, SF)
    for rows in (classify.classify(f, p, v), classify.contact_segments(p, f), estimators.glrt(f, v)):
        assert "Window" not in plan(rows)


def test_contacts_of_odd_flights(spark):
    """Unknown heights and flags, two runs with a climb between them, a flight without contact and one without a datum."""
    flights = spark.createDataFrame([(k, "HAE" if k != "d" else "?", 10.0, None) for k in "abcd"], "flight_id string, datum string, elevation double, undulation double")
    up = {"a": [None, 40.0, 14.0, 12.0, 90.0, 12.0, 11.0], "b": [60.0, 50.0, 30.0], "d": [25.0, 10.0, 10.0]}
    flags = {"a": [None, False, None, False, False, True, True], "b": [False, None, False], "d": [False, False, True]}
    rows = [(k, i, float(i), up[k][i], flags[k][i]) for k in up for i in range(len(up[k]))]
    positions = spark.createDataFrame(rows, "flight_id string, seq int, t double, geo_alt double, on_ground boolean")
    velocities = spark.createDataFrame([("a", 0, 0.0, 140.0), ("a", 1, 1.0, None), ("a", 2, 2.0, 100.0), ("b", 0, 0.0, 5.0)], "flight_id string, seq int, t double, gs_kt double")
    runs = {(r.flight_id, r.segment): (r.start_seq, r.end_seq, r.start_t, r.end_t) for r in classify.contact_segments(positions, flights).collect()}
    assert runs["a", 1] == (2, 3, pytest.approx(1 + 25 / 26), 3.0) and runs["a", 2] == (5, 6, pytest.approx(4 + 75 / 78), 6.0)
    assert runs["d", 1] == (1, 2, pytest.approx(10 / 15), 2.0) and len(runs) == 3
    got = {r.flight_id: r for r in classify.classify(flights, positions, velocities).collect()}
    assert (got["a"].trajectory_type, got["a"].n_landings, got["a"].onset_t) == ("touch-and-go", 2, 0.0)
    assert (got["b"].trajectory_type, got["b"].n_landings, got["b"].first_contact_t, got["b"].onset_t) == ("go-around", 0, None, None)
    assert (got["c"].trajectory_type, got["c"].datum_ok) == ("go-around", False)
    assert (got["d"].trajectory_type, got["d"].datum_ok) == ("completed-landing", False)


def test_gates_are_passed_once(spark):
    """What is made of the gated samples reads them from a table."""
    pos, gated = quality.run_qa(synth.positions(spark, SF), synth.velocities(spark, SF))
    assert "MapInArrow" not in plan(gated) and shared_folder(spark) in gated.inputFiles()[0]
    two = quality.kinematic_gates(quality.dedup(synth.velocities(spark, SF)))
    assert sorted(map(repr, gated.collect())) == sorted(map(repr, two.collect()))


def test_whole_flights_are_sorted_once(spark):
    text = plan(signals.derivatives(synth.velocities(spark, SF)))
    assert text.count("Sort [") == 2  # by time for the sample's number, and by that number


def test_arrays_and_rows_have_the_same_derivatives(spark):
    v = synth.velocities(spark, SF)
    knees = signals.knee(v)
    for k in (None, knees):
        rows = {(r.flight_id, r.i): (r.t, r.decel, r.jerk, r.n) for r in signals.derivatives(v, 5, k).collect()}
        held = {(r.flight_id, x.i): (x.t, x.decel, x.jerk, x.n) for r in signals.derivative_arrays(v, 5, k).collect() for x in r.d}
        assert rows.keys() == held.keys()
        np.testing.assert_array_equal(np.array([rows[x] for x in rows]), np.array([held[x] for x in rows]))
