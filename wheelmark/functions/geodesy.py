"""The geodesic formulas of ``exprs`` over whole Arrow batches.

As column expressions their dozens of steps make one generated method that is too long for the JVM to compile, so that
every row is interpreted. The expression text stays for SQL, which thereby checks these.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1.0 / 298.257223563
B = A * (1.0 - FLAT)


def inverse(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Vincenty's inverse problem: distance (m) and azimuth at the first point (degrees)."""
    u1, u2 = (np.arctan((1.0 - FLAT) * np.tan(np.radians(x))) for x in (lat1, lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lon = lam = np.radians(lon2 - lon1)
    for _ in range(rounds):
        sl, cl = np.sin(lam), np.cos(lam)
        ss, cs = np.sqrt((c2 * sl) ** 2 + (c1 * s2 - s1 * c2 * cl) ** 2), s1 * s2 + c1 * c2 * cl
        sg = np.arctan2(ss, cs)
        sa = np.where(ss < 1e-15, 0.0, c1 * c2 * sl / ss)
        cc = 1.0 - sa * sa
        cm = np.where(cc < 1e-15, 0.0, cs - 2.0 * s1 * s2 / cc)
        k = FLAT / 16.0 * cc * (4.0 + FLAT * (4.0 - 3.0 * cc))
        lam = lon + (1.0 - k) * FLAT * sa * (sg + k * ss * (cm + k * cs * (2.0 * cm * cm - 1.0)))
    uu = cc * (A**2 - B**2) / B**2
    big_a = 1.0 + uu / 16384.0 * (4096.0 + uu * (-768.0 + uu * (320.0 - 175.0 * uu)))
    big_b = uu / 1024.0 * (256.0 + uu * (-128.0 + uu * (74.0 - 47.0 * uu)))
    ds = big_b * ss * (cm + big_b / 4.0 * (cs * (-1.0 + 2.0 * cm * cm) - big_b / 6.0 * cm * (-3.0 + 4.0 * ss * ss) * (-3.0 + 4.0 * cm * cm)))
    az = np.degrees(np.arctan2(c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)))
    return B * big_a * (sg - ds), np.where(ss < 1e-15, 0.0, az)


def direct(lat: np.ndarray, lon: np.ndarray, az: np.ndarray, dist: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Vincenty's direct problem: the point at ``dist`` m (a negative one goes backwards) along ``az``."""
    al, u = np.radians(az), np.arctan((1.0 - FLAT) * np.tan(np.radians(lat)))
    sin_al, cos_al, su, cu = np.sin(al), np.cos(al), np.sin(u), np.cos(u)
    s1, sa = np.arctan2(np.tan(u), cos_al), cu * sin_al
    cc = 1.0 - sa * sa
    uu = cc * (A**2 - B**2) / B**2
    big_a = 1.0 + uu / 16384.0 * (4096.0 + uu * (-768.0 + uu * (320.0 - 175.0 * uu)))
    big_b = uu / 1024.0 * (256.0 + uu * (-128.0 + uu * (74.0 - 47.0 * uu)))
    s = s0 = dist / (B * big_a)
    for _ in range(rounds):
        m = np.cos(2.0 * s1 + s)
        s = s0 + big_b * np.sin(s) * (m + big_b / 4.0 * (np.cos(s) * (-1.0 + 2.0 * m * m) - big_b / 6.0 * m * (-3.0 + 4.0 * np.sin(s) ** 2) * (-3.0 + 4.0 * m * m)))
    m, ss, cs = np.cos(2.0 * s1 + s), np.sin(s), np.cos(s)
    t = su * ss - cu * cs * cos_al
    to_lat = np.degrees(np.arctan2(su * cs + cu * ss * cos_al, (1.0 - FLAT) * np.sqrt(sa * sa + t * t)))
    la = np.arctan2(ss * sin_al, cu * cs - su * ss * cos_al)
    k = FLAT / 16.0 * cc * (4.0 + FLAT * (4.0 - 3.0 * cc))
    return to_lat, lon + np.degrees(la - (1.0 - k) * FLAT * sa * (s + k * ss * (m + k * cs * (-1.0 + 2.0 * m * m))))


def _column(formula: Callable[..., tuple[np.ndarray, ...]], names: tuple[str, ...], *inputs: str) -> Column:
    """A struct of ``names``; null where any input is."""

    def run(*arrays: pa.Array) -> pa.Array:
        gone = np.logical_or.reduce([a.is_null().to_numpy(zero_copy_only=False) for a in arrays])
        with np.errstate(all="ignore"):
            found = formula(*[a.to_numpy(zero_copy_only=False) for a in arrays])
        return pa.StructArray.from_arrays([pa.array(x, pa.float64(), mask=gone) for x in found], names=list(names))

    return F.arrow_udf(run, ", ".join(f"{n} double" for n in names))(*[F.expr(f"CAST({x} AS DOUBLE)") for x in inputs])


def projected(thr_lat: str, thr_lon: str, heading: str, lat: str, lon: str) -> Column:
    """along, lateral: metres along the runway and to its right (``exprs.projection_steps``)."""

    def formula(lat1, lon1, course, lat2, lon2):
        dist, az = inverse(lat1, lon1, lat2, lon2)
        off = np.radians(az - course)
        return dist * np.cos(off), dist * np.sin(off)

    return _column(formula, ("along", "lateral"), thr_lat, thr_lon, heading, lat, lon)


def reckoned(lat: str, lon: str, az: str, dist: str) -> Column:
    """lat, lon: the point at ``dist`` along ``az`` (``exprs.direct_steps``)."""
    return _column(direct, ("lat", "lon"), lat, lon, az, dist)
