"""Scalar formulas as SQL expression text: one definition for column expressions and for the SQL that checks them.

A formula is a list of (name, expression) steps, each of which may use the names before it. ``with_steps`` adds them to
a DataFrame one by one, so that no generated method grows too large; ``sql_steps`` nests them in a subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = list[tuple[str, str]]

#: Exact unit factors, standard gravity, and the WGS-84 ellipsoid.
KT_TO_MPS = "(1852e0 / 3600e0)"
FT_TO_M = "3048e-4"
GRAVITY = "980665e-5"
WGS84_A, WGS84_F = "6378137e0", "(1e0 / 298257223563e-9)"
WGS84_B = f"({WGS84_A} * (1e0 - {WGS84_F}))"


def with_steps(df: DataFrame, steps: Steps, drop: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    before = set(df.columns)
    for name, text in steps:
        df = df.withColumn(name, F.expr(text))
    return df.drop(*[n for n, _ in steps if n not in keep and n not in before]) if drop else df


def sql_steps(source: str, steps: Steps) -> str:
    """A subquery over ``source`` with the steps as further columns."""
    for name, text in steps:
        source = f"(SELECT *, {text} AS {name} FROM {source})"
    return source


def floor_mod(x: str, m: str) -> str:
    """The remainder with the divisor's sign, as ``pmod`` gives it, in both dialects."""
    return f"(({x}) - ({m}) * floor(({x}) / ({m})))"


def shortest_arc(a: str, b: str) -> str:
    return f"({floor_mod(f'({b}) - ({a}) + 18e1', '36e1')} - 18e1)"


def rounded(x: str, digits: int = 6) -> str:
    return f"round(({x}) + 1e-9, {digits})"


def inverse_steps(lat1: str, lon1: str, lat2: str, lon2: str, p: str = "g_", rounds: int = 6) -> Steps:
    """Vincenty's inverse problem, ``rounds`` iterations: distance ``{p}dist`` (m) and azimuth ``{p}az`` (degrees) at 1."""
    f, a, b = WGS84_F, WGS84_A, WGS84_B
    steps: Steps = [
        (f"{p}u1", f"atan((1e0 - {f}) * tan(radians({lat1})))"),
        (f"{p}u2", f"atan((1e0 - {f}) * tan(radians({lat2})))"),
        (f"{p}l", f"radians({lon2} - ({lon1}))"),
        (f"{p}lam0", f"{p}l"),
    ]
    for i in range(rounds):
        q = f"{p}{i}_"
        steps += [
            (f"{q}ss", f"sqrt(pow(cos({p}u2) * sin({p}lam{i}), 2) + pow(cos({p}u1) * sin({p}u2) - sin({p}u1) * cos({p}u2) * cos({p}lam{i}), 2))"),
            (f"{q}cs", f"sin({p}u1) * sin({p}u2) + cos({p}u1) * cos({p}u2) * cos({p}lam{i})"),
            (f"{q}sg", f"atan2({q}ss, {q}cs)"),
            (f"{q}sa", f"CASE WHEN {q}ss < 1e-15 THEN 0e0 ELSE cos({p}u1) * cos({p}u2) * sin({p}lam{i}) / {q}ss END"),
            (f"{q}c2", f"1e0 - {q}sa * {q}sa"),
            (f"{q}cm", f"CASE WHEN {q}c2 < 1e-15 THEN 0e0 ELSE {q}cs - 2e0 * sin({p}u1) * sin({p}u2) / {q}c2 END"),
            (f"{q}C", f"{f} / 16e0 * {q}c2 * (4e0 + {f} * (4e0 - 3e0 * {q}c2))"),
            (f"{p}lam{i + 1}", f"{p}l + (1e0 - {q}C) * {f} * {q}sa * ({q}sg + {q}C * {q}ss * ({q}cm + {q}C * {q}cs * (2e0 * {q}cm * {q}cm - 1e0)))"),
        ]
    q = f"{p}{rounds - 1}_"
    return [
        *steps,
        (f"{p}uu", f"{q}c2 * (pow({a}, 2) - pow({b}, 2)) / pow({b}, 2)"),
        (f"{p}A", f"1e0 + {p}uu / 16384e0 * (4096e0 + {p}uu * (-768e0 + {p}uu * (320e0 - 175e0 * {p}uu)))"),
        (f"{p}B", f"{p}uu / 1024e0 * (256e0 + {p}uu * (-128e0 + {p}uu * (74e0 - 47e0 * {p}uu)))"),
        (f"{p}ds", f"{p}B * {q}ss * ({q}cm + {p}B / 4e0 * ({q}cs * (-1e0 + 2e0 * {q}cm * {q}cm) - {p}B / 6e0 * {q}cm * (-3e0 + 4e0 * {q}ss * {q}ss) * (-3e0 + 4e0 * {q}cm * {q}cm)))"),
        (f"{p}dist", f"{b} * {p}A * ({q}sg - {p}ds)"),
        (f"{p}az", f"CASE WHEN {q}ss < 1e-15 THEN 0e0 ELSE degrees(atan2(cos({p}u2) * sin({p}lam{rounds}), cos({p}u1) * sin({p}u2) - sin({p}u1) * cos({p}u2) * cos({p}lam{rounds}))) END"),
    ]


def direct_steps(lat: str, lon: str, az: str, dist: str, p: str = "d_", rounds: int = 3) -> Steps:
    """Vincenty's direct problem: ``{p}lat``, ``{p}lon`` at ``dist`` m (a negative one goes backwards) along ``az``."""
    f, a, b = WGS84_F, WGS84_A, WGS84_B
    steps: Steps = [
        (f"{p}al", f"radians({az})"),
        (f"{p}u1", f"atan((1e0 - {f}) * tan(radians({lat})))"),
        (f"{p}s1", f"atan2(tan({p}u1), cos({p}al))"),
        (f"{p}sa", f"cos({p}u1) * sin({p}al)"),
        (f"{p}c2", f"1e0 - {p}sa * {p}sa"),
        (f"{p}uu", f"{p}c2 * (pow({a}, 2) - pow({b}, 2)) / pow({b}, 2)"),
        (f"{p}A", f"1e0 + {p}uu / 16384e0 * (4096e0 + {p}uu * (-768e0 + {p}uu * (320e0 - 175e0 * {p}uu)))"),
        (f"{p}B", f"{p}uu / 1024e0 * (256e0 + {p}uu * (-128e0 + {p}uu * (74e0 - 47e0 * {p}uu)))"),
        (f"{p}sg0", f"({dist}) / ({b} * {p}A)"),
    ]
    for i in range(rounds):
        steps += [
            (f"{p}m{i}", f"cos(2e0 * {p}s1 + {p}sg{i})"),
            (f"{p}sg{i + 1}", f"{p}sg0 + {p}B * sin({p}sg{i}) * ({p}m{i} + {p}B / 4e0 * (cos({p}sg{i}) * (-1e0 + 2e0 * {p}m{i} * {p}m{i}) - {p}B / 6e0 * {p}m{i} * (-3e0 + 4e0 * pow(sin({p}sg{i}), 2)) * (-3e0 + 4e0 * {p}m{i} * {p}m{i})))"),
        ]
    s = f"{p}sg{rounds}"
    return [
        *steps,
        (f"{p}mm", f"cos(2e0 * {p}s1 + {s})"),
        (f"{p}t", f"sin({p}u1) * sin({s}) - cos({p}u1) * cos({s}) * cos({p}al)"),
        (f"{p}lat", f"degrees(atan2(sin({p}u1) * cos({s}) + cos({p}u1) * sin({s}) * cos({p}al), (1e0 - {f}) * sqrt({p}sa * {p}sa + {p}t * {p}t)))"),
        (f"{p}la", f"atan2(sin({s}) * sin({p}al), cos({p}u1) * cos({s}) - sin({p}u1) * sin({s}) * cos({p}al))"),
        (f"{p}C", f"{f} / 16e0 * {p}c2 * (4e0 + {f} * (4e0 - 3e0 * {p}c2))"),
        (f"{p}lon", f"({lon}) + degrees({p}la - (1e0 - {p}C) * {f} * {p}sa * ({s} + {p}C * sin({s}) * ({p}mm + {p}C * cos({s}) * (-1e0 + 2e0 * {p}mm * {p}mm))))"),
    ]


def projection_steps(thr_lat: str, thr_lon: str, heading: str, lat: str, lon: str, p: str = "p_") -> Steps:
    """Metres along the runway and to its right: ``{p}along``, ``{p}lateral``; null where the point is unknown."""
    return [
        *inverse_steps(thr_lat, thr_lon, lat, lon, p),
        (f"{p}along", f"{p}dist * cos(radians({p}az - ({heading})))"),
        (f"{p}lateral", f"{p}dist * sin(radians({p}az - ({heading})))"),
    ]
