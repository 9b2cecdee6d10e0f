"""Per-sample channels of both streams, and the sequence that a learned model reads: all on the flight's partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelmark.functions.exprs import KT_TO_MPS
from wheelmark.functions.tables import kept
from wheelmark.operators import signals
from wheelmark.operators.classify import heights
from wheelmark.operators.fusion import project
from wheelmark.operators.learned import source_code, type_code
from wheelmark.operators.timebase import bracket, time_deltas

#: Samples with a speed that a sequence needs.
LEAST_SAMPLES = 4
#: Columns of a sequence's rows: eight numbers and two flags.
SEQUENCE = ("gs_mps", "decel", "jerk", "derivative_rms", "dt", "along_m", "height_m", "rel_t", "has_along", "has_height")


def velocity_channels(velocities: DataFrame, knees: DataFrame, window: int = 5) -> DataFrame:
    """flight_id, i, t, gs_mps, decel, jerk, derivative_rms, dt: smoothed on either side of the knee by itself.

    derivative_rms is what the smoothed deceleration leaves of the speed's steps, over the flight.
    """
    smooth = signals.derivatives(velocities, window, knees).select("flight_id", "i", "decel", "jerk")
    up = Window.partitionBy("flight_id").orderBy("t", "seq")
    known = time_deltas(velocities.where("gs_kt IS NOT NULL AND t IS NOT NULL")).withColumn("i", F.row_number().over(up) - 1)
    rows = known.selectExpr("flight_id", "i", "t", f"gs_kt * {KT_TO_MPS} AS gs_mps", "dt").join(smooth, ["flight_id", "i"], "left")
    step = (F.col("gs_mps") - F.lag("gs_mps").over(Window.partitionBy("flight_id").orderBy("i"))) / F.when(F.col("dt") > 0, F.col("dt"))
    left = F.sqrt(F.avg(F.pow(F.col("step") - F.col("decel"), 2)).over(Window.partitionBy("flight_id")))
    return rows.withColumn("step", step).withColumn("derivative_rms", left).select("flight_id", "i", "t", "gs_mps", "decel", "jerk", "derivative_rms", "dt")


def position_channels(flights: DataFrame, positions: DataFrame) -> DataFrame:
    """flight_id, seq, t, along_m, lateral_m, height_m (null without a resolved datum), dt."""
    placed = project(time_deltas(positions).select("flight_id", "seq", "t", "lat", "lon", "dt"), flights).selectExpr("flight_id", "seq", "t", "p_along AS along_m", "p_lateral AS lateral_m", "dt")
    high = heights(positions, flights).selectExpr("flight_id", "seq", "CASE WHEN datum_ok THEN height END AS height_m")
    return placed.join(high, ["flight_id", "seq"], "left").select("flight_id", "seq", "t", "along_m", "lateral_m", "height_m", "dt")


def onto(times: DataFrame, samples: DataFrame, value: str) -> DataFrame:
    """flight_id, i and ``value`` at each t of ``times``: linear between the samples that have it, held beyond both ends;
    null for flights with fewer than two of them."""
    some = samples.where(f"{value} IS NOT NULL AND t IS NOT NULL").select("flight_id", "seq", "t", value)
    some = some.withColumn("n", F.count("*").over(Window.partitionBy("flight_id"))).where("n >= 2").drop("n")
    rows = bracket(some, times.select("flight_id", F.col("t").alias("q"), "i"), [value])
    return rows.select("flight_id", "i", (F.col(f"prev.{value}") + F.col("frac") * (F.col(f"next.{value}") - F.col(f"prev.{value}"))).alias(value))


def sequence_input(flights: DataFrame, positions: DataFrame, velocities: DataFrame) -> DataFrame:
    """flight_id, i, t, SEQUENCE, type_code, source_code: one row for each sample with a speed.

    Flights with fewer than LEAST_SAMPLES of them give none. Times are relative to the knee, or to their mean where
    there is no knee; a channel that a flight does not have is null and its flag 0.
    """
    knees = kept(signals.knee(velocities).select("flight_id", "t_knee"), "knees")
    own = kept(velocity_channels(velocities, knees), "velocity_channels")
    placed = kept(position_channels(flights, positions), "position_channels")
    every = Window.partitionBy("flight_id")
    rows = own.withColumns({"n": F.count("*").over(every), "mean_t": F.avg("t").over(every)}).where(f"n >= {LEAST_SAMPLES}").join(knees, "flight_id", "left")
    for value in ("along_m", "height_m"):
        rows = rows.join(onto(own, placed, value), ["flight_id", "i"], "left")
    rows = rows.withColumns({"rel_t": F.col("t") - F.coalesce("t_knee", "mean_t"), "has_along": F.col("along_m").isNotNull().cast("double"), "has_height": F.col("height_m").isNotNull().cast("double")})
    codes = flights.select("flight_id", F.expr(type_code("aircraft_type")).alias("type_code"), F.expr(source_code("source")).alias("source_code"))
    return rows.join(codes, "flight_id").select("flight_id", "i", "t", *SEQUENCE, "type_code", "source_code")
