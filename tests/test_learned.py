"""Quantile boosters against one that goes over the rows, the softmax's gradients, and both on held-out flights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wheelmark.operators import boosting, learned, softmax
from wheelmark.operators.fusion import room_to_improve


def rows_of(n, seed=3):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.normal(size=n), rng.integers(0, 6, n)
    y = np.where(a > 0.3, 2.0, -1.0) + (c % 3) * 1.5 + (0.3 + (b > 0)) * rng.normal(size=n)
    a[::7] = np.nan
    return a, b, c.astype(float), y


def frame(spark, a, b, c, y):
    clean = lambda x: None if np.isnan(x) else float(x)
    return spark.createDataFrame([tuple(map(clean, r)) for r in zip(a, b, c, y, strict=True)], "a double, b double, c double, y double").repartition(3)


def brute(x, y, model, depth, rate, least, trees):
    """The same boosters, row by row and side by side."""
    bins = np.array([[0 if np.isnan(v) else (1 + int(np.sum(e < v)) if f not in model.categorical else (1 + list(e).index(v) if v in e else len(e) + 1)) for f, (v, e) in enumerate(zip(r, model.edges, strict=True))] for r in x])
    out = np.tile(model.start, (len(y), 1))

    def grow(rows, level, q, p):
        best = None
        g = lambda r: sum(q if y[i] >= p[i] else q - 1 for i in r)
        if level < depth and rows:
            for f in range(x.shape[1]):
                present = sorted({bins[i, f] for i in rows})
                if f in model.categorical:
                    mean = {k: g([i for i in rows if bins[i, f] == k]) / sum(bins[i, f] == k for i in rows) for k in present}
                    orders = [sorted(present, key=lambda k: (round(mean[k], 12), k))]
                else:
                    orders = [range(boosting.BINS), range(1, boosting.BINS)]
                for order in orders:
                    order = list(order)
                    for cut in range(1, len(order)):
                        side = set(order[:cut])
                        l, r = [i for i in rows if bins[i, f] in side], [i for i in rows if bins[i, f] not in side]
                        if min(len(l), len(r)) >= least:
                            gain = g(l) ** 2 / len(l) + g(r) ** 2 / len(r) - g(rows) ** 2 / len(rows)
                            if gain > (best[0] if best else 1e-9) + 1e-9:
                                best = (gain, l, r)
        if best:
            return grow(best[1], level + 1, q, p) + grow(best[2], level + 1, q, p)
        return [(rows, float(np.quantile([y[i] - p[i] for i in rows], q)))]

    for _ in range(trees):
        for k, q in enumerate(model.quantiles):
            for rows, value in grow(list(range(len(y))), 0, q, out[:, k].copy()):
                out[rows, k] += rate * value
    return out


def test_boosters_against_brute_force(spark):
    a, b, c, y = rows_of(200)
    rows = frame(spark, a, b, c, y)
    model = boosting.fit(rows, ["a", "b", "c"], "y", ["c"], trees=3, depth=2, rate=0.3, least=5, n_bins=12)
    before, boosting.BINS = boosting.BINS, 12
    try:
        want = brute(np.column_stack([a, b, c]), y, model, 2, 0.3, 5, 3)
    finally:
        boosting.BINS = before
    got = {(r.y): r.raw for r in boosting.predict(rows, model, ["y"]).collect()}
    assert np.allclose([got[v] for v in y], want)


def test_state_is_rewritten_without_a_change(spark, monkeypatch):
    rows = frame(spark, *rows_of(150))
    fit = lambda: boosting.fit(rows, ["a", "b", "c"], "y", ["c"], trees=5, depth=2)
    whole = boosting.predict(rows, fit(), ["y"]).orderBy("y").collect()
    monkeypatch.setattr(boosting, "REFRESH", 2)
    assert boosting.predict(rows, fit(), ["y"]).orderBy("y").collect() == whole


def test_quantiles_of_unseen_rows(spark):
    model = boosting.fit(frame(spark, *rows_of(3000)), ["a", "b", "c"], "y", ["c"], trees=40, depth=3, rate=0.2, least=20)
    found = boosting.ordered(boosting.predict(frame(spark, *rows_of(2000, seed=8)), model, ["y"]))
    r = found.agg(F.avg(F.col("y").between(F.col("ends")[0], F.col("ends")[2]).cast("int")).alias("inside"), F.avg((F.col("y") <= F.col("ends")[1]).cast("int")).alias("half"), F.avg(F.col("crossed").cast("int")).alias("crossed")).first()
    assert 0.85 <= r.inside <= 0.95 and abs(r.half - 0.5) < 0.05 and r.crossed < 0.1


def test_crossed_quantiles_are_told(spark):
    rows = spark.createDataFrame([(1, [1.0, 3.0, 2.0]), (2, [1.0, 2.0, 3.0])], "k int, raw array<double>")
    assert [(r.ends, r.crossed) for r in boosting.ordered(rows).orderBy("k").collect()] == [([1.0, 2.0, 3.0], True), ([1.0, 2.0, 3.0], False)]


def test_too_few_rows_and_odd_values(spark):
    a, b, c, y = rows_of(30)
    b[:] = 1.0  # one value only
    c[:5] = np.nan
    model = boosting.fit(frame(spark, a, b, c, y), ["a", "b", "c"], "y", ["c"], trees=2, least=40)
    assert all((t.feature < 0).all() for trees in model.trees for t in trees)
    unseen = frame(spark, np.array([np.nan, 9.0]), np.array([np.nan, -9.0]), np.array([77.0, np.nan]), np.array([0.0, 1.0]))
    assert boosting.predict(unseen, model, ["y"]).count() == 2


def test_gradient_of_the_softmax():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 5, 1])
    x, w = rng.normal(size=(9, 4)), rng.normal(size=(2, 4))
    y = np.concatenate([v / v.sum() for v in (rng.random(k) for k in sizes)])
    counts = rng.integers(0, 3, (3, 2)).astype(float)
    loss, gradient = softmax.losses(x, y, sizes, w, counts)
    for m in range(2):
        for k in range(4):
            step = np.zeros_like(w)
            step[m, k] = 1e-6
            high, low = softmax.losses(x, y, sizes, w + step, counts)[0][m], softmax.losses(x, y, sizes, w - step, counts)[0][m]
            assert gradient[m, k] == pytest.approx((high - low) / 2e-6, abs=1e-5)
    starts = np.array([0, 3, 8])
    assert np.allclose(np.add.reduceat(softmax.softmax(x @ w.T, starts, sizes), starts, axis=0), 1) and (loss >= 0).all()


def test_sequence_model_learns(spark):
    """Made-up flights whose deceleration rises at the true time: the loss falls each step, members differ, times are right."""
    rng = np.random.default_rng(5)
    flights, rows = [], []
    for k in range(160):
        t0 = float(rng.uniform(30, 50))
        flights.append((f"f{k}", "completed" if k % 9 else "go_around", 100.0 + t0))
        for i in range(20):
            t = 4.0 * i
            decel = (-2.0 if t > t0 else -0.1) + 0.1 * rng.normal()
            rows.append((f"f{k}", i, 100.0 + t, 70 - 0.5 * t, float(decel), 0.0, 4.0, None, 0.0, t - 40 + rng.normal(), 3, 0))
    table = spark.createDataFrame(rows, "flight_id string, i int, t double, gs_mps double, decel double, jerk double, dt double, height_m double, has_height double, rel_t double, type_code int, source_code int").repartition(4)
    truth = spark.createDataFrame(flights, "flight_id string, kind string, t_true double")
    found, seen = learned.sequence_model(truth, table, label_sigma_s=2.0, seeds=(1, 2, 3), steps=25)
    steps = np.array(seen)
    assert len(seen) > 5 and (np.diff(steps, axis=0) <= 0).all() and steps[-1].max() < 0.7 * steps[0].min() and len(np.unique(np.round(steps[-1], 6))) == 3
    held = found.join(truth.where("kind = 'completed'"), "flight_id").where(learned._held_out()).selectExpr("abs(t_td - t_true) AS e", "sigma_t").collect()
    assert len(held) > 15 and np.mean([r.e for r in held]) < 1.5 and all(0 < r.sigma_t < 15 for r in held)
    assert learned.sequence_model(truth, table.limit(0))[0].isEmpty()


def test_soft_labels_far_from_every_sample(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 9.0])], "flight_id string, t array<double>")
    truth = spark.createDataFrame([("a", 1e6), ("b", None)], "flight_id string, t_true double")
    y = softmax.soft_labels(rows, truth, 1.0).first().y
    assert y[2] == pytest.approx(1.0) and sum(y) == pytest.approx(1.0)


def test_headroom_is_not_negative():
    assert room_to_improve(90.0, 100.0, 200.0)["headroom_ft"] == 0.0 and room_to_improve(130.0, 100.0, 200.0)["headroom_ft"] == 30.0


def test_quantiles_of_shares_are_exact_and_passes_do_not_shuffle(spark):
    rng = np.random.default_rng(5)
    sets = [rng.normal(size=3000), rng.integers(0, 4, 2000) * 1.0, np.array([]), np.array([2.5]), np.repeat(1.0, 700)]
    parts = [[np.sort(x[k::3]) for x in sets] for k in range(3)]
    fetched = []

    def told(ask):
        found = [ask(p) for p in parts]
        fetched.append(sum(len(p[0][-1]) for p in found))
        return found

    for share in (0.05, 0.5, 0.95, 0.0, 1.0):
        want = [np.percentile(x, share * 100) if len(x) else 0.0 for x in sets]
        assert np.allclose(boosting.ranked([share] * len(sets), told), want, rtol=0, atol=1e-12)
    assert max(fetched) < 300  # of 3000
    rows = frame(spark, *rows_of(400))
    boosting.fit(rows, ["a", "b", "c"], "y", ["c"], trees=1, depth=2)  # what binning needs is compiled
    tracker, group = spark.sparkContext.statusTracker(), "boosting-passes"
    spark.sparkContext.setJobGroup(group, group)
    try:
        boosting.fit(rows, ["a", "b", "c"], "y", ["c"], trees=6, depth=2)
        stages = [len(info.stageIds) for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j))]
    finally:
        spark.sparkContext.setJobGroup("", "")
    # Two passes for a tree's levels and two for its leaves, each a job of one stage.
    assert sum(n == 1 for n in stages) >= 24 and sum(n > 1 for n in stages) < 12


def test_edges_are_exact_and_shares_change_nothing(spark, monkeypatch):
    a, b, c, y = rows_of(900)
    a[1::50], a[2::50] = -0.0, -1e300
    fit = lambda parts: boosting.fit(frame(spark, a, b, c, y).repartition(parts), ["a", "b", "c"], "y", ["c"], trees=3, depth=3)
    model = fit(1)
    for x, edge in zip((a, b), model.edges[:2], strict=True):
        known = np.sort(x[~np.isnan(x)])
        assert edge.tolist() == np.unique(known[(len(known) - 1) * np.arange(1, boosting.BINS - 1) // (boosting.BINS - 1)]).tolist()
    assert model.start == pytest.approx([np.quantile(y, q) for q in model.quantiles], abs=1e-12)
    monkeypatch.setattr(boosting, "SHARE", 100)
    monkeypatch.setattr(boosting, "LEAST_SHARE", 100)
    other = fit(7)
    assert all(np.array_equal(x, z) for x, z in zip(model.edges, other.edges, strict=True)) and model.start == other.start
    for one, two in zip(model.trees, other.trees, strict=True):
        assert all(np.array_equal(s.feature, t.feature) and np.array_equal(s.left, t.left) and np.array_equal(s.value, t.value) for s, t in zip(one, two, strict=True))
    assert [e.tolist() for e in boosting.fit(frame(spark, a, b, c, y).limit(0), ["a", "b", "c"], "y", ["c"], trees=1).edges] == [[], [], []]


def test_models_are_fitted_on_every_flight(spark, monkeypatch):
    """More flights than the sample had that models were once fitted on."""
    seen = {}
    flights = spark.range(0, 64_000, 1, 4).selectExpr("concat('f', id) AS flight_id", "'completed' AS kind", "CAST(id % 7 AS DOUBLE) AS t_true")
    want = flights.where(~learned._held_out()).count()
    assert 50_000 < want < 64_000
    own = boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda rows, *a, **k: seen.update(trees=rows.count()) or own(rows.limit(50), *a, **k | {"trees": 1}))
    features = flights.selectExpr("flight_id", "t_true AS target", *[f"CAST(pmod(xxhash64(flight_id), 11) AS DOUBLE) AS {c}" for c in learned.FEATURES])
    assert learned.boosted(features, "target").count() == 64_000 and seen["trees"] == want


def test_sequence_model_is_fitted_on_every_flight(spark, monkeypatch):
    seen = {}
    flights = spark.range(0, 64_000, 1, 4).selectExpr("concat('f', id) AS flight_id", "'completed' AS kind", "50e0 AS t_true")
    want = flights.where(~learned._held_out()).count()
    assert 50_000 < want
    monkeypatch.setattr(softmax, "fit", lambda rows, inputs, *a, **k: (np.zeros((1, inputs.size)), [seen.update(n=rows.count())]))
    names = [c for c, _ in learned.SEQUENCE_INPUTS.channels]
    rows = flights.selectExpr("flight_id", "explode(sequence(0, 1)) AS i").selectExpr("flight_id", "i", "50e0 + i AS t", *[f"CAST(i AS DOUBLE) AS {c}" for c in names])
    assert learned.sequence_model(flights, rows)[0].count() == 64_000 and seen["n"] == want


def test_surroundings_of_samples(spark, monkeypatch):
    """Against windows over the samples, with nulls, flights of one sample, and flights that a block cuts between."""
    from pyspark.sql import Window

    rng = np.random.default_rng(4)
    made = [(f"f{f}", i, 10.0 * i, None if rng.random() < 0.2 else float(rng.normal(70, 9)), None if f == 3 else float(i % 3)) for f, n in enumerate((1, 5, 9, 4, 2)) for i in range(n)]
    rows = spark.createDataFrame(made, "flight_id string, i int, t double, a double, b double").repartition(3)
    inputs = softmax.Inputs((("a", (-3, -1, 0, 2)), ("b", (0, 1))))
    flights = softmax.by_flight(rows, inputs)
    order = Window.partitionBy("flight_id").orderBy("i")
    beside = [F.col(c) if not k else F.coalesce((F.lag if k < 0 else F.lead)(c, abs(k)).over(order), F.col(c)) for c, offsets in inputs.channels for k in offsets]
    want = {(r.flight_id, r.i): np.array(r.x, float) for r in rows.select("flight_id", "i", F.array(*beside).alias("x")).collect()}
    every = np.array(list(want.values()))
    means, widths = np.nanmean(every, axis=0), np.nanstd(every, axis=0)
    told = []
    for size in (1 << 14, 6):
        monkeypatch.setattr(softmax, "BLOCK", size)
        found = inputs.measured(flights)
        assert found.means == pytest.approx(means) and found.widths == pytest.approx(widths)
        parts = list(softmax.blocks(flights.toArrow().to_batches()))
        assert size > 6 or len(parts) > 2
        for batch, sizes in parts:
            x, at = found.vectors(batch, sizes), 0
            for f, n in zip(batch["flight_id"].to_pylist(), sizes.tolist(), strict=True):
                z = np.nan_to_num(np.clip((np.array([want[f, i] for i in range(n)]) - means) / widths, -4, 4))
                assert np.allclose(x[at : at + n], np.column_stack([z, z * z]))
                at += n
        labelled = softmax.soft_labels(flights, rows.groupBy("flight_id").agg(F.max("t").alias("t_true")), 5.0).withColumn("often", F.array(F.lit(1.0), F.lit(2.0))).drop("flight_id")
        told.append(softmax.evaluated(labelled, found, np.linspace(-1, 1, 2 * found.size).reshape(2, -1), np.arange(2)))
    assert all(np.allclose(x, y) for x, y in zip(*told, strict=True)) and told[0][2].tolist() == [5.0, 10.0]
    empty = inputs.measured(flights.limit(0))
    assert empty.means == (0.0,) * 6 and empty.widths == (1.0,) * 6
