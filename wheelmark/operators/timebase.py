"""As-of brackets, interpolation, monotone cubic curves and resampling, over long tables keyed by flight.

Every operator partitions by ``flight_id`` only, so that a chain of them needs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wheelmark.functions.exprs import KT_TO_MPS, floor_mod, shortest_arc
from wheelmark.functions.geodesy import reckoned


def order():
    """A flight's samples in the order of time."""
    return Window.partitionBy("flight_id").orderBy("t", "seq")


def time_deltas(samples: DataFrame) -> DataFrame:
    """Adds ``dt``: the time since the flight's sample before, 0 for the first."""
    return samples.withColumn("dt", F.coalesce(F.col("t") - F.lag("t").over(order()), F.lit(0.0)))


def bracket(samples: DataFrame, queries: DataFrame, values: list[str], at: str = "q", few: bool = False) -> DataFrame:
    """For each query (flight_id, q, ...): ``prev`` and ``next`` structs of the samples around q, and ``frac``.

    prev is the last sample before q and next the first not before it; beyond either end both are the end sample and
    frac is 0. Null values stay in the structs: a null neighbour makes what is interpolated null.

    ``few``: a flight has a handful of queries at most. Its samples are then one row, which each query looks through;
    otherwise samples and queries are put in order together. Either way the result is the same.
    """
    rest = [c for c in queries.columns if c not in ("flight_id", at)]
    fields = ["t", "seq", *values]
    if few:
        return _between(queries.join(in_order(samples, fields, "_all"), "flight_id", "left"), "_all", at).drop("_all")
    left = samples.select("flight_id", F.col("t").alias("_at"), F.lit(1).alias("_kind"), F.struct(*fields).alias("_s"), F.lit(None).cast(queries.select(F.struct(at, *rest)).schema[0].dataType).alias("_q"))
    right = queries.select("flight_id", F.col(at).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_s"].dataType).alias("_s"), F.struct(at, *rest).alias("_q"))
    over = Window.partitionBy("flight_id").orderBy("_at", "_kind", F.col("_s.seq"))
    both = left.unionByName(right)
    prev = F.last("_s", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    next_ = F.first("_s", ignorenulls=True).over(over.rowsBetween(0, Window.unboundedFollowing))
    found = both.select("flight_id", "_kind", "_q", prev.alias("_p"), next_.alias("_n")).where("_kind = 0")
    found = found.select("flight_id", "_q.*", F.coalesce("_p", "_n").alias("prev"), F.coalesce("_n", "_p").alias("next"))
    return _with_share(found, at)


def in_order(samples: DataFrame, fields: list[str], name: str) -> DataFrame:
    """flight_id and the flight's samples as an array of structs, in the order of the fields."""
    return samples.groupBy("flight_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def _between(rows: DataFrame, samples: str, at: str) -> DataFrame:
    """``bracket`` where a query's row has its flight's samples in order."""
    behind = F.size(F.filter(samples, lambda x: F.coalesce(x.t < F.col(at), x.t.isNull() & F.col(at).isNotNull())))
    rows = rows.withColumn("_behind", F.when(F.col(samples).isNotNull(), behind))
    prev, next_ = F.get(samples, F.col("_behind") - 1), F.get(samples, F.col("_behind"))
    return _with_share(rows.withColumns({"prev": F.coalesce(prev, next_), "next": F.coalesce(next_, prev)}).drop("_behind"), at)


def _with_share(found: DataFrame, at: str) -> DataFrame:
    span = F.col("next.t") - F.col("prev.t")
    return found.withColumn("frac", F.when(span != 0, (F.col(at) - F.col("prev.t")) / span).otherwise(F.lit(0.0)))


def velocity_at(velocities: DataFrame, queries: DataFrame, few: bool = False) -> DataFrame:
    """Adds ``gs_kt`` (linear) and ``track_deg`` (along the shorter arc, in [0, 360)) at each query time."""
    found = bracket(velocities, queries, ["gs_kt", "track"], few=few)
    turn = shortest_arc("prev.track", "next.track")
    return found.withColumns(
        {
            "gs_kt": F.expr("prev.gs_kt + frac * (next.gs_kt - prev.gs_kt)"),
            "track_deg": F.expr(floor_mod(f"prev.track + frac * {turn}", "36e1")),
            "slope_mps2": F.expr(f"CASE WHEN next.t > prev.t THEN coalesce((next.gs_kt - prev.gs_kt) * {KT_TO_MPS} / (next.t - prev.t), 0e0) ELSE 0e0 END"),
        }
    ).drop("prev", "next", "frac")


def nearest_fix(positions: DataFrame, queries: DataFrame, few: bool = False) -> DataFrame:
    """Adds ``fix`` (t, lat, lon): the sample nearest to q, the earlier one on ties."""
    found = bracket(positions, queries, ["lat", "lon"], few=few)
    return found.withColumn("fix", F.expr("CASE WHEN q - prev.t <= next.t - q OR q > next.t THEN prev ELSE next END")).drop("prev", "next", "frac")


def linear_position(positions: DataFrame, queries: DataFrame, few: bool = False) -> DataFrame:
    """Adds ``lin_lat`` and ``lin_lon`` between the two valid fixes around q, or beyond the first or last two."""
    valid = positions.where("lat IS NOT NULL AND lon IS NOT NULL")
    own = in_order(valid, ["t", "seq", "lat", "lon"], "_valid")
    edges = {"head": F.slice("_valid", 1, 2), "tail": F.expr("slice(_valid, greatest(size(_valid) - 1, 1), 2)")}
    if few:
        found = _between(queries.join(own, "flight_id", "left"), "_valid", "q").withColumns(edges).drop("_valid")
    else:
        found = bracket(valid, queries, ["lat", "lon"]).join(own.withColumns(edges).drop("_valid"), "flight_id", "left")
    pair = F.expr("CASE WHEN prev.seq != next.seq THEN array(prev, next) WHEN q <= prev.t THEN head ELSE tail END")
    found = found.withColumn("pair", pair).withColumn("w", F.expr("CASE WHEN pair[size(pair) - 1].t != pair[0].t THEN (q - pair[0].t) / (pair[size(pair) - 1].t - pair[0].t) ELSE 0e0 END"))
    return found.withColumns({"lin_lat": F.expr("pair[0].lat + w * (pair[size(pair) - 1].lat - pair[0].lat)"), "lin_lon": F.expr("pair[0].lon + w * (pair[size(pair) - 1].lon - pair[0].lon)")}).drop("prev", "next", "frac", "head", "tail", "pair", "w")


def position_at(positions: DataFrame, velocities: DataFrame, queries: DataFrame, method: str = "kinematic", few: bool = False) -> DataFrame:
    """Adds ``lat``, ``lon`` and ``degraded`` at each query time (``few``: see ``bracket``).

    kinematic: dead reckoning from the nearest fix, at the speed and track in the middle of the time between; where
    they are unknown, linear and degraded. linear: between fixes.
    """
    if method not in ("kinematic", "linear"):
        raise ValueError(f"method: {method}")
    straight = linear_position(positions, queries, few)
    if method == "linear":
        return straight.withColumn("degraded", F.lit(False)).withColumnsRenamed({"lin_lat": "lat", "lin_lon": "lon"})
    fixed = nearest_fix(positions, straight, few).withColumnRenamed("q", "q0").withColumn("q", F.expr("(q0 + fix.t) / 2e0"))
    moved = velocity_at(velocities, fixed, few).withColumn("run", F.expr(f"(q0 - fix.t) * gs_kt * {KT_TO_MPS}"))
    moved = moved.withColumns({"fix_lat": F.col("fix.lat"), "fix_lon": F.col("fix.lon")})
    moved = moved.withColumn("there", reckoned("fix_lat", "fix_lon", "track_deg", "run")).withColumns({"d_lat": F.col("there.lat"), "d_lon": F.col("there.lon")}).drop("there")
    degraded = F.expr("q0 != fix.t AND (gs_kt IS NULL OR track_deg IS NULL)")
    at_fix = F.expr("q0 = fix.t")
    out = moved.withColumns({"degraded": degraded})
    out = out.withColumns(
        {
            "lat": F.when(at_fix, F.col("fix_lat")).when(F.col("degraded"), F.col("lin_lat")).otherwise(F.col("d_lat")),
            "lon": F.when(at_fix, F.col("fix_lon")).when(F.col("degraded"), F.col("lin_lon")).otherwise(F.col("d_lon")),
        }
    )
    return out.withColumn("q", F.col("q0")).drop("q0", "fix", "fix_lat", "fix_lon", "gs_kt", "track_deg", "slope_mps2", "run", "d_lat", "d_lon", "lin_lat", "lin_lon")


#: The slope at an end node: three-point, limited to keep the curve's shape. h, m: widths and secants, nearest first.
def _end_slope(h0: str, h1: str, m0: str, m1: str) -> str:
    e = f"(((2e0 * {h0} + {h1}) * {m0} - {h0} * {m1}) / ({h0} + {h1}))"
    return f"CASE WHEN {m1} IS NULL THEN {m0} WHEN sign({e}) != sign({m0}) THEN 0e0 WHEN sign({m0}) != sign({m1}) AND abs({e}) > 3e0 * abs({m0}) THEN 3e0 * {m0} ELSE {e} END"


INNER_SLOPE = "CASE WHEN m_prev * m_next <= 0e0 THEN 0e0 ELSE (3e0 * (h_prev + h_next)) / ((2e0 * h_next + h_prev) / m_prev + (h_next + 2e0 * h_prev) / m_next) END"
PCHIP_SLOPE = f"CASE WHEN h_prev IS NULL AND h_next IS NULL THEN 0e0 WHEN h_prev IS NULL THEN {_end_slope('h_next', 'h_next2', 'm_next', 'm_next2')} WHEN h_next IS NULL THEN {_end_slope('h_prev', 'h_prev2', 'm_prev', 'm_prev2')} ELSE {INNER_SLOPE} END"


def monotone_nodes(samples: DataFrame, value: str) -> DataFrame:
    """flight_id, t, seq, y and ``slope`` (weighted harmonic mean of the secants, 0 at turning points)."""
    nodes = samples.where(F.col(value).isNotNull()).select("flight_id", "t", "seq", F.col(value).alias("y"))
    nodes = nodes.withColumns({"h_next": F.lead("t").over(order()) - F.col("t"), "m_next": (F.lead("y").over(order()) - F.col("y")) / (F.lead("t").over(order()) - F.col("t"))})
    nodes = nodes.withColumns({"h_prev": F.lag("h_next").over(order()), "m_prev": F.lag("m_next").over(order()), "h_prev2": F.lag("h_next", 2).over(order()), "m_prev2": F.lag("m_next", 2).over(order()), "h_next2": F.lead("h_next").over(order()), "m_next2": F.lead("m_next").over(order())})
    return nodes.select("flight_id", "t", "seq", "y", F.expr(PCHIP_SLOPE).alias("slope"))


HERMITE = "prev.y * (2e0 * pow(frac, 3) - 3e0 * pow(frac, 2) + 1e0) + prev.slope * (next.t - prev.t) * (pow(frac, 3) - 2e0 * pow(frac, 2) + frac) + next.y * (3e0 * pow(frac, 2) - 2e0 * pow(frac, 3)) + next.slope * (next.t - prev.t) * (pow(frac, 3) - pow(frac, 2))"


def monotone_at(samples: DataFrame, queries: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``name``: a monotone cubic through the known values; constant beyond the ends, null without any."""
    found = bracket(monotone_nodes(samples, value), queries, ["y", "slope"])
    return found.withColumn(name, F.expr(f"CASE WHEN prev.seq = next.seq THEN prev.y ELSE {HERMITE} END")).drop("prev", "next", "frac")


def grid(positions: DataFrame, velocities: DataFrame, step_s: float = 1.0) -> DataFrame:
    """flight_id, i, q: from the first sample of either stream to the last one, every ``step_s`` seconds."""
    ends = positions.select("flight_id", "t").unionByName(velocities.select("flight_id", "t")).groupBy("flight_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    n = F.floor((F.col("last") - F.col("first")) / step_s + 1e-9)
    return ends.select("flight_id", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("i")).select("flight_id", "i", (F.col("first") + F.col("i") * step_s).alias("q"))


def resample(positions: DataFrame, velocities: DataFrame, step_s: float = 1.0, method: str = "kinematic") -> DataFrame:
    """Both streams on the grid: flight_id, i, q, lat, lon, degraded, gs_kt, track_deg, slope_mps2, alt_m."""
    points = grid(positions, velocities, step_s)
    return monotone_at(positions, velocity_at(velocities, position_at(positions, velocities, points, method)), "geo_alt", "alt_m")
