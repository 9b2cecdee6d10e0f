"""Window features and the learned estimators: boosted trees, their residual form, and a small sequence model.

Trees are quantile boosters (see ``boosting``): the median and the outer quantiles, each by its own pinball loss. The
sequence model scores each sample by its surroundings and is normalised over the flight (see ``softmax``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelmark.functions.exprs import rounded
from wheelmark.functions.tables import kept
from wheelmark.operators import boosting, signals, softmax
from wheelmark.operators.classify import heights
from wheelmark.operators.fusion import gaussian_multiplier, project

#: Columns of the window vector, in order; types and feeds are codes.
FEATURES = (
    "knee_rel", "slope_before", "slope_after", "slope_drop", "slope_ratio", "fit_rms", "knee_speed", "gs_near", "gs_max", "gs_min", "gs_range", "decel_min", "decel_max", "decel_min_rel", "jerk_min", "jerk_max", "jerk_peak_rel",
    "descent_rate", "height_near", "along_near", "along_abs_min", "ground_rel", "velocity_dt", "position_dt", "n_velocity", "n_position", "n_geometric", "has_geometric", "type_code", "source_code",
)
VOCABULARY = 512
FEATURE_OUT = ("flight_id", "gs_max:4", "gs_min:4", "gs_range:4", "velocity_dt:4", "position_dt:4", "n_velocity", "n_position", "n_geometric", "has_geometric", "type_code", "source_code")


def type_code(column: str) -> str:
    """FNV-1a over the bytes of the trimmed upper-case name, modulo VOCABULARY, in whole numbers below 2 ** 53."""
    # 16777619 = 2**24 + 403: the product modulo 2**32 from parts that do not overflow.
    step = "pmod((h ^ b) * 403 + shiftleft((h ^ b) & 255, 24), 4294967296)"
    raw = f"transform(filter(split(hex(encode(upper(trim({column})), 'UTF-8')), '(?<=\\\\G..)'), x -> x != ''), x -> CAST(conv(x, 16, 10) AS BIGINT))"
    return f"CAST(pmod(aggregate({raw}, CAST(2166136261 AS BIGINT), (h, b) -> {step}), {VOCABULARY}) AS INT)"


def source_code(column: str) -> str:
    return f"CASE {column} WHEN 'aireon' THEN 0 WHEN 'fr24' THEN 1 WHEN 'flightradar24' THEN 1 ELSE 2 END"


def window_features(flights: DataFrame, positions: DataFrame, velocities: DataFrame) -> DataFrame:
    """flight_id, reference (the knee, or the first time without one) and the window vector of each flight."""
    knees = signals.knee(velocities)
    order = Window.partitionBy("flight_id").orderBy("t", "seq")
    vel = velocities.withColumn("step", F.col("t") - F.lag("t").over(order)).join(knees.select("flight_id", F.col("t_knee").alias("ref")), "flight_id", "left")
    near = lambda v, r="ref": F.min_by(v, F.when(F.col(v).isNotNull(), F.struct(F.abs(F.col("t") - F.col(r)), "t")))
    by_v = vel.groupBy("flight_id").agg(F.min(F.when(F.col("gs_kt").isNotNull(), F.col("t"))).alias("t0"), near("gs_kt").alias("gs_near"), F.max("gs_kt").alias("gs_max"), F.min("gs_kt").alias("gs_min"), F.expr("percentile(step, 0.5)").alias("velocity_dt"), F.count("*").alias("n_velocity"))
    high = project(heights(positions, flights), flights, keep=("p_along",)).withColumn("true_h", F.when(F.col("datum_ok"), F.col("height"))).withColumn("step", F.col("t") - F.lag("t").over(order)).join(knees.select("flight_id", F.col("t_knee").alias("ref")), "flight_id", "left")
    pre = F.when((F.col("t") <= F.col("ref")) & F.col("true_h").isNotNull(), F.col("t"))
    by_p = high.groupBy("flight_id").agg(
        near("true_h").alias("height_near"), near("p_along").alias("along_near"), F.min(F.abs("p_along")).alias("along_abs_min"), F.expr("percentile(step, 0.5)").alias("position_dt"), F.count("*").alias("n_position"), F.count("geo_alt").alias("n_geometric"),
        (-(F.max_by("true_h", pre) - F.min_by("true_h", pre)) / F.nullif(F.max(pre) - F.min(pre), F.lit(0.0))).alias("descent_rate"),
    )
    smooth = signals.derivatives(velocities, 5, knees)
    by_d = smooth.groupBy("flight_id").agg(F.min("decel").alias("decel_min"), F.max("decel").alias("decel_max"), F.min_by("t", F.struct("decel", "t")).alias("t_dmin"), F.min("jerk").alias("jerk_min"), F.max("jerk").alias("jerk_max"), F.max_by("t", F.struct(F.abs("jerk"), -F.col("t"))).alias("t_jmax"))
    from wheelmark.operators.classify import transition

    rows = flights.select("flight_id", "aircraft_type", "source")
    for part in (knees, by_v, by_p, by_d, transition(positions)):
        rows = rows.join(part.drop("n"), "flight_id", "left")
    rows = rows.withColumn("reference", F.coalesce("t_knee", "t0"))
    return rows.selectExpr(
        "flight_id", "reference", "t_knee - t0 AS knee_rel", "slope_before", "slope_after", "slope_drop", "CASE WHEN abs(slope_before) > 1e-9 THEN abs(slope_after) / abs(slope_before) END AS slope_ratio", "rms AS fit_rms", "v_knee AS knee_speed",
        "gs_near", "gs_max", "gs_min", "gs_max - gs_min AS gs_range", "decel_min", "decel_max", "t_dmin - reference AS decel_min_rel", "jerk_min", "jerk_max", "t_jmax - reference AS jerk_peak_rel", "descent_rate", "height_near", "along_near", "along_abs_min",
        "on_ground_t - reference AS ground_rel", "velocity_dt", "position_dt", "n_velocity", "n_position", "n_geometric", "CAST(n_geometric > 0 AS INT) AS has_geometric", f"{type_code('aircraft_type')} AS type_code", f"{source_code('source')} AS source_code",
    )


def _fnv(text: str) -> int:
    h = 2166136261
    for b in text.strip().upper().encode():
        h = (h ^ b) * 16777619 % 2**32
    return h % VOCABULARY


_CODES = " ".join(f"WHEN '{t}' THEN {_fnv(t)}" for t in ("B738", "B77W", "A320", "E190", "A333", "ZZZZ"))
FEATURE_SQL = f"""SELECT f.flight_id, {rounded('v.hi', 4)} AS gs_max, {rounded('v.lo', 4)} AS gs_min, {rounded('v.hi - v.lo', 4)} AS gs_range, {rounded('v.dt', 4)} AS velocity_dt, {rounded('p.dt', 4)} AS position_dt, v.n AS n_velocity, p.n AS n_position, p.g AS n_geometric, CASE WHEN p.g > 0 THEN 1 ELSE 0 END AS has_geometric, CASE f.aircraft_type {_CODES} END AS type_code, CASE f.source WHEN 'aireon' THEN 0 ELSE 1 END AS source_code
  FROM flights f JOIN (SELECT flight_id, max(gs_kt) AS hi, min(gs_kt) AS lo, count(*) AS n, quantile_cont(s, 0.5) AS dt FROM (SELECT *, t - lag(t) OVER (PARTITION BY flight_id ORDER BY t, seq) AS s FROM vel) GROUP BY flight_id) v ON f.flight_id = v.flight_id
  JOIN (SELECT flight_id, count(*) AS n, count(geo_alt) AS g, quantile_cont(s, 0.5) AS dt FROM (SELECT *, t - lag(t) OVER (PARTITION BY flight_id ORDER BY t, seq) AS s FROM pos) GROUP BY flight_id) p ON f.flight_id = p.flight_id"""

OUT = ("flight_id", "method", "t_td", "sigma_t", "confidence", "reason_code")
#: Flights that a model is fitted on, at least.
LEAST_ROWS = 5


def _held_out(column: str = "flight_id"):
    return F.pmod(F.xxhash64(column), F.lit(5)) == 0


CATEGORIES = ["type_code", "source_code"]


def boosted(features: DataFrame, target: str, **options) -> DataFrame | None:
    """``features`` with ``ends`` (the 0.05, 0.5 and 0.95 quantiles of ``target``, in order) and ``crossed``: three
    boosters, fitted on all flights that have a target and are not held out; None where they are too few.
    """
    rows = kept(features, "features")
    train = rows.where(F.col(target).isNotNull() & ~_held_out())
    if train.count() < LEAST_ROWS:
        return None
    model = boosting.fit(train, list(FEATURES), target, CATEGORIES, **{"trees": 60, "least": 10} | options)
    return boosting.ordered(boosting.predict(rows, model, [c for c in rows.columns if c not in FEATURES]))


def _boosted(features: DataFrame, target: str, method: str, anchor: str) -> DataFrame:
    """Times by quantile boosters on ``target`` (seconds from ``anchor``); crossed quantiles give low confidence."""
    found = boosted(features, target)
    if found is None:
        return features.select("flight_id", F.lit(method).alias("method"), F.lit(None).cast("double").alias("t_td"), F.lit(None).cast("double").alias("sigma_t"), F.lit("failed").alias("confidence"), F.lit("insufficient_samples").alias("reason_code"))
    width = F.col("ends")[2] - F.col("ends")[0]
    t_td = F.col(anchor) + F.col("ends")[1]
    return found.select(
        "flight_id", F.lit(method).alias("method"), t_td.alias("t_td"), F.when(t_td.isNotNull(), F.greatest(width / (2 * gaussian_multiplier(0.9)), F.lit(0.25))).alias("sigma_t"),
        F.when(t_td.isNull(), "failed").when(F.col("crossed"), "low-confidence").otherwise("normal").alias("confidence"), F.when(t_td.isNull(), "insufficient_samples").when(F.col("crossed"), "wide_ci").alias("reason_code"),
    )


def trees_report(flights: DataFrame, positions: DataFrame, velocities: DataFrame) -> DataFrame:
    """One row over the held-out flights with a true time: n, coverage (truth between the outer quantiles), crossed, mae_s,
    and mae_knee_s of the knee on the same flights."""
    found = boosted(_targets(flights, positions, velocities), "target")
    if found is None:
        return flights.sparkSession.createDataFrame([], "n long, coverage double, crossed long, mae_s double, mae_knee_s double")
    held = found.where(_held_out() & F.col("target").isNotNull())
    inside = F.col("target").between(F.col("ends")[0], F.col("ends")[2])
    return held.agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.sum(F.col("crossed").cast("long")).alias("crossed"), F.avg(F.abs(F.col("target") - F.col("ends")[1])).alias("mae_s"), F.avg(F.abs("target")).alias("mae_knee_s"))


def _targets(flights: DataFrame, positions: DataFrame, velocities: DataFrame) -> DataFrame:
    """Window features beside target: the true time (t_true of completed landings), in seconds from the reference."""
    truth = flights.where("kind = 'completed'").select("flight_id", "t_true")
    return window_features(flights, positions, velocities).join(truth, "flight_id", "left").withColumn("target", F.col("t_true") - F.col("reference"))


def trees(flights: DataFrame, positions: DataFrame, velocities: DataFrame) -> DataFrame:
    """Trained on flights whose true time is known, applied to all."""
    return _boosted(_targets(flights, positions, velocities), "target", "lightgbm", "reference")


def hybrid(flights: DataFrame, positions: DataFrame, velocities: DataFrame) -> DataFrame:
    """The knee as anchor, and trees for what it misses; without an anchor the estimate fails for its reason."""
    from wheelmark.operators.estimators import decel_knee

    truth = flights.where("kind = 'completed'").select("flight_id", "t_true")
    anchors = decel_knee(flights, velocities).select("flight_id", F.col("t_td").alias("anchor"), F.col("confidence").alias("anchor_confidence"), F.col("reason_code").alias("anchor_reason"))
    rows = window_features(flights, positions, velocities).join(anchors, "flight_id").join(truth, "flight_id", "left").withColumn("target", F.col("t_true") - F.col("anchor"))
    found = _boosted(rows, "target", "hybrid_residual", "anchor").join(anchors, "flight_id")
    failed, weak = F.col("anchor").isNull(), F.col("anchor_confidence") == "low-confidence"
    return found.select("flight_id", "method", F.when(~failed, F.col("t_td")).alias("t_td"), F.when(~failed, F.col("sigma_t")).alias("sigma_t"), F.when(failed, "failed").when(weak, "low-confidence").otherwise(F.col("confidence")).alias("confidence"), F.when(failed | weak, F.col("anchor_reason")).otherwise(F.col("reason_code")).alias("reason_code"))


#: What the sequence model reads of a sample, and where around it; seeds of its members.
SEQUENCE_INPUTS = softmax.Inputs((("decel", (-4, -2, -1, 0, 1, 2, 4)), ("jerk", (-2, -1, 0, 1, 2)), ("gs_mps", (0, 2)), ("height_m", (-2, -1, 0, 1, 2)), ("has_height", (0,)), ("rel_t", (0,)), ("dt", (0,)), ("type_code", (0,)), ("source_code", (0,))))
MEMBERS = (11, 12, 13, 14, 15)


def sequence_model(flights: DataFrame, rows: DataFrame, label_sigma_s: float = 2.5, seeds: tuple[int, ...] = MEMBERS, steps: int = 40) -> tuple[DataFrame, list]:
    """Distributions over the samples of ``rows`` (see ``channels.sequence_input``): softmax.predict's rows for all their
    flights, and the members' losses. Fitted on all flights with a true time that aren't held out.
    """
    truth = flights.where("kind = 'completed'").select("flight_id", "t_true")
    every = kept(softmax.by_flight(rows, SEQUENCE_INPUTS), "sequence_flights")
    inputs = SEQUENCE_INPUTS.measured(every)
    train = kept(softmax.soft_labels(every.where(~_held_out()), truth, label_sigma_s), "sequence_training")
    if train.count() < LEAST_ROWS:
        return softmax.predict(every, inputs, np.zeros((1, inputs.size))).where("false"), []
    weights, seen = softmax.fit(train, inputs, seeds, steps)
    return softmax.predict(every, inputs, weights), seen


def sequence(flights: DataFrame, positions: DataFrame, velocities: DataFrame, label_sigma_s: float = 2.5) -> DataFrame:
    """The mean of a distribution over the flight's samples (``sequence_model``), and its width and members' spread."""
    from wheelmark.operators.channels import sequence_input

    found, _ = sequence_model(flights, sequence_input(flights, positions, velocities), label_sigma_s)
    out = flights.select("flight_id").join(found, "flight_id", "left")
    return out.select("flight_id", F.lit("sequence_model").alias("method"), "t_td", F.when(F.col("t_td").isNotNull(), F.greatest("sigma_t", F.lit(0.25))).alias("sigma_t"), F.when(F.col("t_td").isNull(), "failed").otherwise("normal").alias("confidence"), F.when(F.col("t_td").isNull(), "insufficient_samples").alias("reason_code"))


def training_counts(truths: DataFrame) -> DataFrame:
    return truths.groupBy("aircraft_type").agg(F.count("*").alias("training_flights"))


def family(flights: DataFrame, counts: DataFrame, least: int = 50) -> DataFrame:
    """Adds training_flights and family: types with fewer than ``least`` training flights have physics only."""
    rows = flights.join(counts, "aircraft_type", "left").withColumn("training_flights", F.coalesce("training_flights", F.lit(0)))
    return rows.withColumn("family", F.when(F.col("training_flights") < least, "physics").otherwise("learned"))


def with_fallback(families: DataFrame, learned: DataFrame, physics: DataFrame) -> DataFrame:
    """The learned estimate of a common type if usable, else the physics one, else a failure; rare types have physics or nothing."""
    ok = lambda a: F.col(f"{a}.t_td").isNotNull() & (F.col(f"{a}.confidence") != "failed")
    rows = families.alias("f").join(learned.alias("l"), "flight_id", "left").join(physics.alias("p"), "flight_id", "left")
    use = F.when((F.col("f.family") == "learned") & ok("l"), "l").when(ok("p"), "p")
    pick = lambda c: F.when(use == "l", F.col(f"l.{c}")).when(use == "p", F.col(f"p.{c}"))
    return rows.select("flight_id", pick("method").alias("method"), pick("t_td").alias("t_td"), pick("sigma_t").alias("sigma_t"), F.coalesce(pick("confidence"), F.lit("failed")).alias("confidence"), F.when(use.isNull(), "all_estimators_failed").otherwise(pick("reason_code")).alias("reason_code"))
