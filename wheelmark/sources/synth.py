"""Deterministic landings from the driver's customers, with the defects that the operators must handle.

One landing for each customer, 21 samples in each of two streams whose times differ (feed aireon) or agree (fr24). The
expressions hold in either SQL dialect; ``SQL`` has the same tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST, LAST = -12, 8

FLIGHT = [
    "c_custkey AS k",
    "concat('F', lpad(CAST(c_custkey AS STRING), 8, '0')) AS flight_id",
    "CAST(c_nationkey AS BIGINT) AS nk",
    "CASE WHEN c_custkey % 13 = 0 THEN 'go_around' WHEN c_custkey % 17 = 0 THEN 'touch_and_go' ELSE 'completed' END AS kind",
    "CASE WHEN c_custkey % 4 = 0 THEN 'fr24' ELSE 'aireon' END AS source",
    "CASE c_custkey % 6 WHEN 0 THEN 'B738' WHEN 1 THEN 'B77W' WHEN 2 THEN 'A320' WHEN 3 THEN 'E190' WHEN 4 THEN 'A333' ELSE 'ZZZZ' END AS aircraft_type",
    "concat('N', CAST(c_custkey % 97 AS STRING)) AS tail",
    "concat('A', CAST(c_nationkey AS STRING)) AS airport",
    "CAST((c_nationkey * 37) % 360 AS DOUBLE) AS heading",
    "-4e1 + c_nationkey * 3e0 AS thr_lat",
    "-12e1 + c_nationkey * 9e0 AS thr_lon",
    "1e1 * c_nationkey AS elevation",
    "CASE WHEN c_nationkey % 2 = 0 THEN 'HAE' WHEN c_nationkey % 7 = 3 THEN 'msl ' ELSE 'MSL' END AS datum",
    "CASE WHEN c_nationkey % 7 = 6 THEN NULL ELSE -3e1 + c_nationkey END AS undulation",
    "25e2 + (c_nationkey % 10) * 1e2 AS length_m",
    "45e0 + (c_nationkey % 3) * 5e0 AS width_m",
    "4e0 + (c_custkey % 5) * 2e-1 AS dt",
    "(c_custkey % 4) * 9e-1 AS phase",
    "6e1 + c_custkey % 11 AS v_td",
    "1e-1 + (c_custkey % 7) * 5e-2 AS approach_dec",
    "9e-1 + (c_custkey % 9) * 6e-2 AS roll_dec",
    "1e3 + (c_custkey % 50) * 1e1 AS t_true",
    "3e2 + (c_custkey % 10) * 2e1 AS x_true",
]

_U = "(f.phase + i * f.dt)"
_UV = f"({_U} + CASE WHEN f.source = 'aireon' THEN 4e-1 ELSE 0e0 END)"
_H = f"""CASE f.kind WHEN 'go_around' THEN 25e0 + 35e-1 * abs({_U})
  WHEN 'touch_and_go' THEN CASE WHEN i < 0 THEN 35e-1 * f.dt * (-i) WHEN i <= 1 THEN 0e0 ELSE 3e1 * (i - 1) END
  ELSE CASE WHEN {_U} <= -6e0 THEN 1524e-2 + 35e-1 * (-6e0 - {_U}) WHEN {_U} <= 0e0 THEN 1524e-2 * pow(-{_U} / 6e0, 2) ELSE 0e0 END END"""


def _speed(u: str) -> str:
    return f"greatest(CASE WHEN {u} <= 0e0 THEN f.v_td - f.approach_dec * {u} ELSE f.v_td - f.roll_dec * {u} END, 1e0)"


_S = f"(f.x_true + CASE WHEN {_U} <= 0e0 THEN f.v_td * {_U} - f.approach_dec * {_U} * {_U} / 2e0 ELSE f.v_td * {_U} - f.roll_dec * {_U} * {_U} / 2e0 END)"
#: Every 19th landing repeats a position and a velocity time within a tenth of a second.
_AGAIN = "CASE WHEN f.k % 19 = 0 AND i = 3 THEN -f.dt + 5e-2 ELSE 0e0 END"

POSITION = [
    "f.flight_id AS flight_id",
    "i + 12 AS seq",
    f"f.t_true + {_U} + {_AGAIN} AS t",
    f"f.thr_lat + {_S} * cos(radians(f.heading)) / 111132954e-3 AS lat",
    f"f.thr_lon + {_S} * sin(radians(f.heading)) / (111319491e-3 * cos(radians(f.thr_lat))) AS lon",
    f"CASE WHEN f.source = 'fr24' THEN NULL ELSE {_H} + f.elevation + CASE WHEN f.nk % 2 = 0 THEN 0e0 ELSE coalesce(f.undulation, 0e0) END END AS geo_alt",
    f"{_H} + f.elevation AS baro_alt",
    f"CASE f.kind WHEN 'go_around' THEN false WHEN 'touch_and_go' THEN i IN (0, 1) ELSE {_U} >= 2e0 * f.dt + (f.k % 3) * f.dt / 2e0 END AS on_ground",
]
VELOCITY = [
    "f.flight_id AS flight_id",
    "i + 12 AS seq",
    f"f.t_true + {_UV} + {_AGAIN} AS t",
    f"CASE WHEN f.k % 29 = 0 AND i = -8 THEN NULL ELSE {_speed(_UV)} * 3600e0 / 1852e0 + CASE WHEN f.k % 23 = 0 AND i = -5 THEN 12e1 ELSE 0e0 END END AS gs_kt",
    "CASE WHEN f.k % 31 = 0 AND i = 4 THEN NULL ELSE f.heading END AS track",
    f"CASE WHEN {_UV} < 0e0 THEN -689e0 ELSE 0e0 END AS vr_fpm",
]


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*FLIGHT)


#: Flights of a partition, at most on average.
FLIGHTS_PER_TASK = 20_000


def spread(rows: DataFrame) -> DataFrame:
    """Flights partitioned by flight_id before they are made into samples: a small file is one task's, and each flight
    becomes dozens of rows. The samples keep the partitioning, so that what groups them by flight shuffles nothing."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // FLIGHTS_PER_TASK)), "flight_id")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(flights(spark, sf_dir))


def _samples(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    rows = _spread(spark, sf_dir).alias("f").selectExpr("f.*", f"explode(sequence({FIRST}, {LAST})) AS i").alias("f")
    return rows.selectExpr(*columns)


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir, POSITION)


def velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir, VELOCITY)


#: Seconds that the recorder's clock is ahead of the feed's: small ones, and too large a one for every 31st landing.
CLOCK = "CASE WHEN k % 31 = 0 THEN 4e0 ELSE (k % 9 - 4) * 3e-1 END"


def recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flight_id, t, v: the recorder's speed, on its own clock; every 37th recorder has the end of the landing only."""
    rows = _spread(spark, sf_dir).alias("f").selectExpr("f.*", f"explode(transform(sequence({2 * FIRST}, {2 * LAST}), j -> j / 2e0)) AS i").alias("f")
    return rows.where("k % 37 != 0 OR i > 6").selectExpr("flight_id", f"f.t_true + {_U} + {CLOCK} AS t", f"{_speed(_U)} * 3600e0 / 1852e0 AS v")


def recorded_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flight_id and true_t, the touchdown's time on the recorder's clock, of completed landings."""
    return flights(spark, sf_dir).where("kind = 'completed'").selectExpr("flight_id", f"t_true + {CLOCK} AS true_t")


def _sql(columns: list[str]) -> str:
    return f"SELECT {', '.join(columns)} FROM (SELECT *, unnest(generate_series({FIRST}, {LAST})) AS i FROM flights) f"


SQL = {
    "flights": f"SELECT {', '.join(FLIGHT)} FROM customer",
    "pos": _sql(POSITION),
    "vel": _sql(VELOCITY),
}
