"""SQL that the landing queries must agree with: common table expressions, put together by name."""

from __future__ import annotations

import re

from wheelmark.functions.exprs import KT_TO_MPS, direct_steps, floor_mod, projection_steps, rounded, shortest_arc, sql_steps
from wheelmark.operators import classify, estimators, validation
from wheelmark.operators.fusion import EXCLUSION, M_TO_FT, Z90
from wheelmark.sources import synth

R = rounded
CTES: dict[str, str] = dict(synth.SQL)
CTES["q"] = "SELECT flight_id, t_true + o AS q, o FROM flights, (VALUES (-1e3), (-73e-1), (0e0), (25e-1), (1e3)) v(o)"


def asof(samples: str, queries: str, fields: str) -> str:
    """prev_* and next_* of each query by two as-of joins, clamped at the ends, and frac."""
    names = ["t", "seq", *fields.split(", ")]
    prev = ", ".join(f"CASE WHEN a.t IS NULL THEN b.{x} ELSE a.{x} END AS prev_{x}, CASE WHEN b.t IS NULL THEN a.{x} ELSE b.{x} END AS next_{x}" for x in names)
    return f"(SELECT *, CASE WHEN next_t <> prev_t THEN (q - prev_t) / (next_t - prev_t) ELSE 0e0 END AS frac FROM (SELECT q.*, {prev} FROM {queries} q ASOF LEFT JOIN {samples} a ON q.flight_id = a.flight_id AND q.q > a.t ASOF LEFT JOIN {samples} b ON q.flight_id = b.flight_id AND q.q <= b.t))"


def velocity_at(queries: str) -> str:
    turn = shortest_arc("prev_track", "next_track")
    return f"(SELECT *, prev_gs_kt + frac * (next_gs_kt - prev_gs_kt) AS gs_at, {floor_mod(f'prev_track + frac * {turn}', '36e1')} AS track_at, CASE WHEN next_t > prev_t THEN coalesce((next_gs_kt - prev_gs_kt) * {KT_TO_MPS} / (next_t - prev_t), 0e0) ELSE 0e0 END AS slope_at FROM {asof('vel', queries, 'gs_kt, track')})"


def position_at(queries: str) -> str:
    """Dead reckoning; the synthetic tracks and speeds that are null fall back to straight lines."""
    near = f"(SELECT q.* EXCLUDE (prev_t, prev_seq, prev_lat, prev_lon, next_t, next_seq, next_lat, next_lon, frac), CASE WHEN q - prev_t <= next_t - q OR q > next_t THEN prev_t ELSE next_t END AS fix_t, CASE WHEN q - prev_t <= next_t - q OR q > next_t THEN prev_lat ELSE next_lat END AS fix_lat, CASE WHEN q - prev_t <= next_t - q OR q > next_t THEN prev_lon ELSE next_lon END AS fix_lon, prev_lat + w * (next_lat - prev_lat) AS lin_lat, prev_lon + w * (next_lon - prev_lon) AS lin_lon FROM (SELECT *, CASE WHEN next_t <> prev_t THEN (q - prev_t) / (next_t - prev_t) ELSE 0e0 END AS w FROM {asof('pos', queries, 'lat, lon')}) q)"
    mid = f"(SELECT * EXCLUDE (q), q AS q0, (q + fix_t) / 2e0 AS q FROM {near})"
    moved = f"(SELECT * EXCLUDE (prev_t, prev_seq, prev_gs_kt, prev_track, next_t, next_seq, next_gs_kt, next_track, frac), (q0 - fix_t) * gs_at * {KT_TO_MPS} AS run FROM {velocity_at(mid)})"
    there = sql_steps(moved, direct_steps("fix_lat", "fix_lon", "track_at", "run"))
    return f"(SELECT * EXCLUDE (q, gs_at, track_at, slope_at), q0 AS q, q0 <> fix_t AND (gs_at IS NULL OR track_at IS NULL) AS degraded, CASE WHEN q0 = fix_t THEN fix_lat WHEN gs_at IS NULL OR track_at IS NULL THEN lin_lat ELSE d_lat END AS lat, CASE WHEN q0 = fix_t THEN fix_lon WHEN gs_at IS NULL OR track_at IS NULL THEN lin_lon ELSE d_lon END AS lon FROM {there})"


def project(rows: str) -> str:
    return sql_steps(f"(SELECT r.*, f.thr_lat, f.thr_lon, f.heading FROM {rows} r JOIN flights f ON r.flight_id = f.flight_id)", projection_steps("thr_lat", "thr_lon", "heading", "lat", "lon"))


def _sigma(fit: str, step: str = "cadence") -> str:
    """A fit's term and half a cadence, squared and added; a quarter second at least."""
    return f"sqrt(greatest(pow({fit}, 2) + pow({step}, 2) / 4e0, 625e-4))"


_W = "PARTITION BY flight_id ORDER BY t, seq"


def _edge(near: str, far: str) -> str:
    """A one-sided three-point slope (near, far: the two intervals' names), as the method limits it."""
    three = f"(m_{near} + (m_{near} - m_{far}) * h_{near} / (h_{near} + h_{far}))"
    return f"""CASE WHEN m_{far} IS NULL THEN m_{near} WHEN {three} * m_{near} <= 0e0 THEN 0e0
      WHEN m_{near} * m_{far} <= 0e0 AND abs({three}) > abs(3e0 * m_{near}) THEN 3e0 * m_{near} ELSE {three} END"""


#: Interval lengths h and secants m: of the interval before a node (back), before that (back2), behind it (on), behind that (on2).
CTES["secants"] = f"""SELECT flight_id, t, seq, geo_alt AS y, t - lag(t) OVER w AS h_back, (geo_alt - lag(geo_alt) OVER w) / (t - lag(t) OVER w) AS m_back, lead(t) OVER w - t AS h_on, (lead(geo_alt) OVER w - geo_alt) / (lead(t) OVER w - t) AS m_on
  FROM pos WHERE geo_alt IS NOT NULL WINDOW w AS ({_W})"""
CTES["mono"] = f"""SELECT flight_id, t, seq, y, CASE WHEN h_back IS NULL AND h_on IS NULL THEN 0e0 WHEN h_back IS NULL THEN {_edge('on', 'on2')} WHEN h_on IS NULL THEN {_edge('back', 'back2')}
    WHEN sign(m_back) <> sign(m_on) OR m_back = 0e0 THEN 0e0 ELSE 3e0 * (h_back + h_on) * m_back * m_on / ((h_back + 2e0 * h_on) * m_on + (2e0 * h_back + h_on) * m_back) END AS slope
  FROM (SELECT *, lag(h_back) OVER w AS h_back2, lag(m_back) OVER w AS m_back2, lead(h_on) OVER w AS h_on2, lead(m_on) OVER w AS m_on2 FROM secants WINDOW w AS ({_W}))"""
#: The cubic between two nodes, by powers of the time since the first.
CURVE = """CASE WHEN prev_seq = next_seq THEN prev_y ELSE prev_y + (q - prev_t) * (prev_slope + (q - prev_t) * ((3e0 * (next_y - prev_y) / (next_t - prev_t) - 2e0 * prev_slope - next_slope) / (next_t - prev_t)
  + (q - prev_t) * (prev_slope + next_slope - 2e0 * (next_y - prev_y) / (next_t - prev_t)) / pow(next_t - prev_t, 2))) END"""
CTES["thr"] = f"SELECT flight_id, {classify.DATUM} AS datum_used, {classify.THRESHOLD_HAE} AS thr_hae FROM flights"
CTES["high"] = f"SELECT p.*, geo_alt - coalesce(thr_hae, min(geo_alt) OVER (PARTITION BY p.flight_id)) AS height, thr_hae IS NOT NULL AND max(geo_alt) OVER (PARTITION BY p.flight_id) IS NOT NULL AS datum_ok, max(geo_alt) OVER (PARTITION BY p.flight_id) IS NOT NULL AS has_height, row_number() OVER (PARTITION BY p.flight_id ORDER BY t, seq) - 1 AS rank FROM pos p JOIN thr ON p.flight_id = thr.flight_id"
CTES["segments"] = f"""SELECT flight_id, segment, min(rank) AS start_seq, max(rank) AS end_seq, min_by(start_t, rank) AS start_t, max(t) AS end_t FROM (
  SELECT *, sum(turn) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS segment, CASE WHEN prev_h > 5e0 AND height <= 5e0 THEN prev_t + least(greatest((prev_h - 5e0) / (prev_h - height), 0e0), 1e0) * (t - prev_t) ELSE t END AS start_t FROM (
    SELECT *, CASE WHEN contact AND NOT coalesce(lag(contact) OVER ({_W}), false) THEN 1 ELSE 0 END AS turn, lag(t) OVER ({_W}) AS prev_t, lag(height) OVER ({_W}) AS prev_h FROM (SELECT *, on_ground OR coalesce(height, 1e300) <= 5e0 AS contact FROM high)))
  WHERE contact GROUP BY flight_id, segment"""
CTES["transit"] = f"SELECT flight_id, min(CASE WHEN on_ground AND NOT before THEN t END) AS on_ground_t FROM (SELECT *, lag(on_ground) OVER ({_W}) AS before FROM pos) GROUP BY flight_id"
CTES["onset"] = f"""SELECT p.flight_id, p.t AS onset_t FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY v DESC, rank) AS n FROM (SELECT *, gs_kt * {KT_TO_MPS} AS v, row_number() OVER ({_W}) AS rank FROM vel) WHERE v IS NOT NULL) p
  WHERE n = 1 AND p.v - (SELECT min(x.gs_kt * {KT_TO_MPS}) FROM (SELECT *, row_number() OVER ({_W}) AS rank FROM vel) x WHERE x.flight_id = p.flight_id AND x.rank > p.rank) >= 25e-1"""
CTES["classes"] = """SELECT *, CASE trajectory_type WHEN 'go-around' THEN 'go_around' WHEN 'touch-and-go' THEN 'touch_and_go' END AS reason_code, trajectory_type <> 'go-around' AS is_touchdown FROM (
  SELECT flight_id, first_contact_t, sustained_roll, datum_ok, onset_t, n_landings, CASE WHEN first_seq IS NULL THEN 'go-around' WHEN ends AND NOT climbed THEN 'completed-landing' WHEN climbed THEN 'touch-and-go' ELSE 'completed-landing' END AS trajectory_type FROM (
    SELECT f.flight_id, s.first_seq, s.first_contact_t, o.onset_t, h.datum_ok, coalesce(s.last_seq = h.end_rank, false) AS ends, coalesce(s.last_seq = h.end_rank AND s.last_roll >= 8e0, false) AS sustained_roll,
      CASE WHEN s.first_seq IS NULL THEN false WHEN h.has_height THEN coalesce(h.top > 6e1, false) ELSE NOT coalesce(s.last_seq = h.end_rank, false) END AS climbed,
      CAST(CASE WHEN s.first_seq IS NULL THEN 0 ELSE 1 + (SELECT count(*) FROM (SELECT *, lead(start_seq) OVER (PARTITION BY flight_id ORDER BY start_seq) AS nxt FROM segments) g WHERE g.flight_id = f.flight_id AND g.nxt IS NOT NULL AND (SELECT max(height) FROM high x WHERE x.flight_id = g.flight_id AND x.rank BETWEEN g.end_seq AND g.nxt) > 6e1) END AS INTEGER) AS n_landings
    FROM flights f LEFT JOIN (SELECT flight_id, min_by(start_t, start_seq) AS first_contact_t, min(start_seq) AS first_seq, max(end_seq) AS last_seq, max_by(end_t - start_t, start_seq) AS last_roll FROM segments GROUP BY flight_id) s ON f.flight_id = s.flight_id
    LEFT JOIN (SELECT x.flight_id, max(rank) AS end_rank, bool_or(has_height) AS has_height, bool_or(datum_ok) AS datum_ok, max(CASE WHEN rank >= (SELECT min(start_seq) FROM segments g WHERE g.flight_id = x.flight_id) THEN height END) AS top FROM high x GROUP BY x.flight_id) h ON f.flight_id = h.flight_id
    LEFT JOIN onset o ON f.flight_id = o.flight_id))"""
CTES["brackets"] = """SELECT flight_id, CASE WHEN center IS NULL THEN 'no-touchdown' ELSE 'ok' END AS status, center - 3e1 AS t_lo, center, CASE WHEN center IS NOT NULL THEN CASE WHEN on_ground_t > center - 3e1 THEN on_ground_t ELSE center + 3e1 END END AS t_hi, on_ground_t FROM (
  SELECT flight_id, on_ground_t, CASE WHEN anchor IS NULL THEN NULL ELSE least(anchor, coalesce(on_ground_t, anchor)) END AS center FROM (
    SELECT c.flight_id, t.on_ground_t, CASE WHEN is_touchdown THEN CASE WHEN datum_ok AND first_contact_t IS NOT NULL THEN first_contact_t ELSE coalesce(onset_t, first_contact_t, t.on_ground_t) END END AS anchor FROM classes c LEFT JOIN transit t ON c.flight_id = t.flight_id))"""
CTES["gated"] = f"""SELECT * EXCLUDE (dt, gain, turn), CASE WHEN gain / dt > 980665e-5 THEN 'longitudinal' WHEN gs_kt * 1852e0 / 3600e0 * radians(turn / dt) > 980665e-5 / 2e0 THEN 'lateral' WHEN turn > 6e0 * dt THEN 'turn_rate' END AS gate FROM (
  SELECT *, CASE WHEN t > lag(t) OVER ({_W}) AND gs_kt + lag(gs_kt) OVER ({_W}) IS NOT NULL THEN t - lag(t) OVER ({_W}) END AS dt, abs(gs_kt - lag(gs_kt) OVER ({_W})) * 1852e0 / 3600e0 AS gain,
    least(abs(track - lag(track) OVER ({_W})), 36e1 - abs(track - lag(track) OVER ({_W}))) AS turn FROM vel)"""
_MED = "quantile_cont({0}, 0.5)"
CTES["vcad"] = f"SELECT flight_id, coalesce({_MED.format('step')}, 0e0) AS cadence FROM (SELECT flight_id, t - lag(t) OVER ({_W}) AS step FROM vel) GROUP BY flight_id"
#: Every knot against every sample: no running sums, residuals summed outright.
CTES["fits"] = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY round(rss, 6), i) AS pick FROM (
  SELECT flight_id, i, k, n, tm, vm, b0, b1, b2, (SELECT sum(pow(s.v - f.b0 - f.b1 * s.u - f.b2 * greatest(s.u - f.k, 0e0), 2)) FROM known s WHERE s.flight_id = f.flight_id) AS rss FROM (
    SELECT *, (rv * (a22 * a33 - a23 * a23) - a12 * (ruv * a33 - a23 * rhv) + a13 * (ruv * a23 - a22 * rhv)) / nullif(det, 0e0) AS b0, (n * (ruv * a33 - a23 * rhv) - rv * (a12 * a33 - a23 * a13) + a13 * (a12 * rhv - ruv * a13)) / nullif(det, 0e0) AS b1,
      (n * (a22 * rhv - ruv * a23) - a12 * (a12 * rhv - ruv * a13) + rv * (a12 * a23 - a22 * a13)) / nullif(det, 0e0) AS b2 FROM (
      SELECT *, n * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM (
        SELECT c.flight_id, c.i, c.k, c.n, c.tm, c.vm, sum(u) AS a12, sum(greatest(u - k, 0e0)) AS a13, sum(u * u) AS a22, sum(u * greatest(u - k, 0e0)) AS a23, sum(pow(greatest(u - k, 0e0), 2)) AS a33, sum(v) AS rv, sum(u * v) AS ruv, sum(v * greatest(u - k, 0e0)) AS rhv,
          count(*) FILTER (WHERE u < k) AS below, count(*) FILTER (WHERE u > k) AS above
        FROM (SELECT *, low + i * (high - low) / (m - 1) AS k FROM (SELECT *, unnest(range(m)) AS i FROM (SELECT flight_id, count(*) AS n, any_value(tm) AS tm, any_value(vm) AS vm, max(CASE WHEN j = 1 THEN u END) AS low, max(CASE WHEN j = total - 2 THEN u END) AS high, least(400, greatest(60, 12 * count(*))) AS m FROM known GROUP BY flight_id HAVING count(*) >= 4))) c
        JOIN known s ON c.flight_id = s.flight_id GROUP BY ALL) WHERE below >= 2 AND above >= 2)) f WHERE b0 IS NOT NULL)) WHERE pick = 1"""
CTES["known"] = f"SELECT flight_id, seq, t - avg(t) OVER (PARTITION BY flight_id) AS u, v0 - avg(v0) OVER (PARTITION BY flight_id) AS v, avg(t) OVER (PARTITION BY flight_id) AS tm, avg(v0) OVER (PARTITION BY flight_id) AS vm, row_number() OVER ({_W}) - 1 AS j, count(*) OVER (PARTITION BY flight_id) AS total FROM (SELECT *, gs_kt * {KT_TO_MPS} AS v0 FROM vel WHERE gs_kt IS NOT NULL)"
CTES["knees"] = "SELECT flight_id, CAST(n AS INTEGER) AS n, tm + k AS t_knee, b1 AS slope_before, b1 + b2 AS slope_after, -b2 AS slope_drop, vm + b0 + b1 * k AS v_knee, sqrt(rss / n) AS rms FROM fits"
CTES["derive"] = f"""SELECT flight_id, i, t, (n * (v1 * s4 - s3 * v2) - v0 * (s1 * s4 - s3 * s2) + s2 * (s1 * v2 - v1 * s2)) / nullif(det, 0e0) AS decel, 2e0 * (n * (s2 * v2 - v1 * s3) - s1 * (s1 * v2 - v1 * s2) + v0 * (s1 * s3 - s2 * s2)) / nullif(det, 0e0) AS jerk, CAST(n AS INTEGER) AS n FROM (
  SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM (
    SELECT flight_id, i, t, count(*) AS n, sum(u) AS s1, sum(u * u) AS s2, sum(pow(u, 3)) AS s3, sum(pow(u, 4)) AS s4, sum(v) AS v0, sum(u * v) AS v1, sum(u * u * v) AS v2 FROM (
      SELECT a.flight_id, a.i, a.t, b.t - a.t AS u, b.v, row_number() OVER (PARTITION BY a.flight_id, a.i ORDER BY abs(b.t - a.t), b.i) AS pick FROM ix a JOIN ix b ON a.flight_id = b.flight_id) WHERE pick <= 5 GROUP BY flight_id, i, t)) WHERE det <> 0e0"""
CTES["ix"] = f"SELECT flight_id, t, gs_kt * {KT_TO_MPS} AS v, row_number() OVER ({_W}) - 1 AS i FROM vel WHERE gs_kt IS NOT NULL"
CTES["sig"] = "SELECT *, decel AS x, row_number() OVER (PARTITION BY flight_id ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY flight_id) AS m FROM derive QUALIFY count(*) OVER (PARTITION BY flight_id) >= 6"
CTES["scad"] = f"SELECT flight_id, {_MED.format('step')} AS cadence, var_pop(dx) / 2e0 AS var FROM (SELECT flight_id, t - lag(t) OVER (PARTITION BY flight_id ORDER BY j) AS step, x - lag(x) OVER (PARTITION BY flight_id ORDER BY j) AS dx FROM sig) GROUP BY flight_id"


def located(changes: str, method: str, reason: str) -> str:
    """From (flight_id, c, mean_before, mean_after): the crossing of the middle level nearest the change, and sigma."""
    return f"""SELECT f.flight_id, '{method}' AS method, t_td, sigma_t, CASE WHEN t_td IS NULL THEN 'failed' ELSE 'normal' END AS confidence, CASE WHEN t_td IS NULL THEN '{reason}' END AS reason_code FROM flights f LEFT JOIN (
      SELECT c.flight_id, CASE WHEN x.t0 IS NULL OR mean_before = mean_after THEN (a.t + b.t) / 2e0 ELSE x.t0 + least(greatest((level - x.x0) / nullif(x.x1 - x.x0, 0e0), 0e0), 1e0) * (x.t1 - x.t0) END AS t_td,
        {_sigma('d.cadence * s.spread / greatest(abs(mean_after - mean_before), 5e-2)', 'd.cadence')} AS sigma_t
      FROM (SELECT *, (mean_before + mean_after) / 2e0 AS level FROM ({changes})) c JOIN scad d ON c.flight_id = d.flight_id JOIN sig a ON a.flight_id = c.flight_id AND a.j = c.c - 1 JOIN sig b ON b.flight_id = c.flight_id AND b.j = c.c
      JOIN (SELECT g.flight_id, sqrt(avg(pow(g.x - CASE WHEN g.j < k.c THEN k.ma ELSE k.mb END, 2))) AS spread FROM sig g JOIN (SELECT h.flight_id, h.c, avg(s.x) FILTER (WHERE s.j < h.c) AS ma, avg(s.x) FILTER (WHERE s.j >= h.c) AS mb FROM ({changes}) h JOIN sig s ON h.flight_id = s.flight_id GROUP BY h.flight_id, h.c) k ON g.flight_id = k.flight_id GROUP BY g.flight_id) s ON s.flight_id = c.flight_id
      LEFT JOIN (SELECT * FROM (SELECT h.flight_id, y.t AS t0, y.x AS x0, y.tn AS t1, y.xn AS x1, row_number() OVER (PARTITION BY h.flight_id ORDER BY abs(y.j - (h.c - 1)), y.j) AS pick FROM ({changes}) h JOIN (SELECT *, lead(x) OVER (PARTITION BY flight_id ORDER BY j) AS xn, lead(t) OVER (PARTITION BY flight_id ORDER BY j) AS tn FROM sig) y ON h.flight_id = y.flight_id WHERE sign(y.x - (h.mean_before + h.mean_after) / 2e0) * sign(y.xn - (h.mean_before + h.mean_after) / 2e0) < 0e0) WHERE pick = 1) x ON x.flight_id = c.flight_id) r ON f.flight_id = r.flight_id"""


CTES["glrt_c"] = """SELECT flight_id, c, mean_before, mean_after FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY round(stat, 9) DESC, c) AS pick FROM (
  SELECT k.flight_id, k.j AS c, avg(s.x) FILTER (WHERE s.j < k.j) AS mean_before, avg(s.x) FILTER (WHERE s.j >= k.j) AS mean_after, k.j * (k.m - k.j) * 1e0 / k.m * pow(avg(s.x) FILTER (WHERE s.j < k.j) - avg(s.x) FILTER (WHERE s.j >= k.j), 2) / greatest(any_value(d.var), 1e-4) AS stat
  FROM sig k JOIN sig s ON k.flight_id = s.flight_id JOIN scad d ON d.flight_id = k.flight_id WHERE k.j BETWEEN 2 AND k.m - 2 GROUP BY k.flight_id, k.j, k.m)) WHERE pick = 1"""
CTES["glrt"] = located("SELECT * FROM glrt_c", "glrt", "insufficient_samples")
#: The two sums as the recursion that defines them.
CTES["cusum_walk"] = """SELECT flight_id, j, z, 0e0 AS hi, 0e0 AS lo, 0 AS rh, 0 AS rl, -1 AS c FROM zs WHERE j = 0 UNION ALL
  SELECT z.flight_id, z.j, z.z, n.hi, n.lo, n.rh, n.rl, CASE WHEN n.lo < -5e0 THEN n.rl + 1 WHEN n.hi > 5e0 THEN n.rh + 1 ELSE -1 END FROM cusum_walk w JOIN zs z ON z.flight_id = w.flight_id AND z.j = w.j + 1,
  LATERAL (SELECT greatest(0e0, w.hi + z.z - 5e-1) AS hi, least(0e0, w.lo + z.z + 5e-1) AS lo, CAST(CASE WHEN greatest(0e0, w.hi + z.z - 5e-1) = 0e0 THEN z.j ELSE w.rh END AS INTEGER) AS rh, CAST(CASE WHEN least(0e0, w.lo + z.z + 5e-1) = 0e0 THEN z.j ELSE w.rl END AS INTEGER) AS rl) n WHERE w.c < 0"""
CTES["zs"] = "SELECT s.flight_id, s.j, (s.x - avg(s.x) OVER (PARTITION BY s.flight_id)) / greatest(sqrt(d.var), 1e-3) AS z FROM sig s JOIN scad d ON s.flight_id = d.flight_id"
CTES["cusum_c"] = "SELECT w.flight_id, w.c, avg(s.x) FILTER (WHERE s.j < w.c) AS mean_before, avg(s.x) FILTER (WHERE s.j >= w.c) AS mean_after FROM (SELECT k.flight_id, least(greatest(k.c, 1), any_value(g.m) - 1) AS c FROM cusum_walk k JOIN sig g ON k.flight_id = g.flight_id WHERE k.c >= 0 GROUP BY k.flight_id, k.c) w JOIN sig s ON s.flight_id = w.flight_id GROUP BY w.flight_id, w.c"
CTES["cusum"] = located("SELECT * FROM cusum_c", "cusum", "no_ground_roll")
#: Every earlier sample is tried as the last change, costs summed outright; then the changes are followed back.
CTES["pelt_x"] = "SELECT s.flight_id, list(s.x ORDER BY s.j) AS xs, any_value(s.m) AS n, 2e0 * greatest(any_value(d.var), 1e-4) * ln(greatest(any_value(s.m), 2)) AS pen FROM sig s JOIN scad d ON s.flight_id = d.flight_id GROUP BY s.flight_id"
CTES["pelt_walk"] = """SELECT flight_id, 0 AS e, [-pen] AS f, [CAST(0 AS BIGINT)] AS back FROM pelt_x UNION ALL
  SELECT flight_id, e, list_append(f, best.f) AS f, list_append(back, coalesce(best.s, 0)) AS back FROM (SELECT w.flight_id, w.e + 1 AS e, w.f, w.back,
    list_sort(list_transform(list_filter(range(0, w.e), lambda s: w.f[s + 1] IS NOT NULL), lambda s: {'f': round(w.f[s + 1] + list_var_pop(x.xs[s + 1 : w.e + 1]) * (w.e + 1 - s) + x.pen, 12), 's': s}))[1] AS best
  FROM pelt_walk w JOIN pelt_x x ON w.flight_id = x.flight_id WHERE w.e < x.n)"""
CTES["pelt_back"] = """SELECT w.flight_id, w.e AS place, w.back FROM pelt_walk w JOIN pelt_x x ON w.flight_id = x.flight_id AND w.e = x.n UNION ALL SELECT flight_id, back[place + 1] AS place, back FROM pelt_back WHERE place > 0"""
CTES["pelt_means"] = """SELECT b.flight_id, b.place AS c, list_avg(x.xs[b.prev + 1 : b.place]) AS mean_before, list_avg(x.xs[b.place + 1 : b.nxt]) AS mean_after FROM (
  SELECT flight_id, place, lag(place) OVER (PARTITION BY flight_id ORDER BY place) AS prev, lead(place) OVER (PARTITION BY flight_id ORDER BY place) AS nxt FROM pelt_back) b JOIN pelt_x x ON b.flight_id = x.flight_id WHERE b.prev IS NOT NULL AND b.nxt IS NOT NULL"""
CTES["pelt_one"] = """SELECT flight_id, c, list_avg(xs[1 : c]) AS mean_before, list_avg(xs[c + 1 : n]) AS mean_after FROM (SELECT *, unnest(range(2, n - 1)) AS c FROM pelt_x) WHERE flight_id NOT IN (SELECT flight_id FROM pelt_means)
  QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY round(c * (n - c) * 1e0 / n * pow(list_avg(xs[1 : c]) - list_avg(xs[c + 1 : n]), 2), 9) DESC, c) = 1"""
CTES["pelt_c"] = "SELECT * FROM pelt_means QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY round(mean_before - mean_after, 9) DESC, c) = 1 UNION ALL SELECT * FROM pelt_one"
CTES["pelt"] = located("SELECT * FROM pelt_c", "pelt", "insufficient_samples")


def orthogonal(name: str, order: int, window: str, weight: str, keep: str, slope_var: str) -> str:
    """A local polynomial's value, slope and curvature by orthogonal polynomials of the window (three-term recurrence): no
    normal equations. ``window``: which samples b are near a sample a; ``keep``: a filter on what is near."""
    over = "PARTITION BY flight_id, i"
    rows = f"(SELECT *, {weight} AS w FROM (SELECT a.flight_id, a.i, a.t, a.v AS here, b.t - a.t AS u, b.v, row_number() OVER (PARTITION BY a.flight_id, a.i ORDER BY abs(b.t - a.t), b.i) AS pick FROM ix a JOIN ix b ON a.flight_id = b.flight_id {window}) WHERE {keep})"
    rows = f"(SELECT *, 1e0 AS p0, 0e0 AS pm, count(*) OVER ({over}) AS n, sum(w) OVER ({over}) AS n0 FROM {rows})"
    for k in range(order):
        before = f"p{k - 1}" if k else "pm"
        share = f"n{k} / n{k - 1}" if k else "0e0"
        rows = f"(SELECT *, (u - a{k}) * p{k} - ({share}) * {before} AS p{k + 1} FROM (SELECT *, sum(w * u * p{k} * p{k}) OVER ({over}) / n{k} AS a{k} FROM {rows}))"
        rows = f"(SELECT *, sum(w * p{k + 1} * p{k + 1}) OVER ({over}) AS n{k + 1} FROM {rows})"
    # A window of few samples takes as many powers as it can hold.
    has = lambda k: f"n > {k}"
    rows = f"(SELECT *, {', '.join(f'CASE WHEN {has(k)} THEN sum(w * v * p{k}) OVER ({over}) / n{k} ELSE 0e0 END AS c{k}' for k in range(order + 1))} FROM {rows})"
    rows = f"(SELECT *, v - ({' + '.join(f'CASE WHEN {has(k)} THEN c{k} * p{k} ELSE 0e0 END' for k in range(order + 1))}) AS rest FROM {rows})"
    one = f"(SELECT flight_id, i, any_value(t) AS t, any_value(here) AS here, count(*) AS n, sum(w) AS weight, sum(w * rest * rest) AS rss, {', '.join(f'any_value(c{k}) AS c{k}, any_value(n{k}) AS n{k}' for k in range(order + 1))}, {', '.join(f'any_value(a{k}) AS a{k}' for k in range(order))} FROM {rows} GROUP BY flight_id, i)"
    # Values and derivatives of the polynomials at the sample itself, where u = 0.
    at = ["1e0 AS v0, 0e0 AS s0, 0e0 AS q0"]
    for k in range(order):
        share = f"n{k} / n{k - 1}" if k else "0e0"
        prev = (lambda c: f"{c}{k - 1}") if k else (lambda c: "0e0")
        at.append(f"-a{k} * v{k} - ({share}) * {prev('v')} AS v{k + 1}, v{k} - a{k} * s{k} - ({share}) * {prev('s')} AS s{k + 1}, 2e0 * s{k} - a{k} * q{k} - ({share}) * {prev('q')} AS q{k + 1}")
    for step in at:
        one = f"(SELECT *, {step} FROM {one})"
    total = lambda c, square: " + ".join(f"CASE WHEN {has(k)} THEN " + (f"{c}{k} * {c}{k} / n{k}" if square else f"c{k} * {c}{k}") + " ELSE 0e0 END" for k in range(order + 1))
    one = f"(SELECT *, rss / (weight / n * greatest(n - least({order}, n - 1) - 1, 1)) AS spread FROM {one})"
    CTES[name] = f"""SELECT flight_id, i, {total('v', False)} AS value, CASE WHEN n > 1 THEN {total('s', False)} END AS decel, CASE WHEN n > 2 THEN {total('q', False)} WHEN n = 2 THEN 0e0 END AS jerk, CAST(n AS INTEGER) AS n,
      CASE WHEN n > 1 THEN {slope_var.format(f'spread * ({total("s", True)})')} END AS decel_var, CASE WHEN n > 2 THEN spread * ({total('q', True)}) END AS jerk_var FROM {one}"""
    return name


orthogonal("savgol", 3, "", "1e0", "pick <= 7", "{0}")
orthogonal("kernel", 2, "AND abs(b.t - a.t) <= 24000001e-6", "exp(-u * u / 128e0)", "true", "greatest({0}, 5e-1 / weight)")
CTES["jerk"] = f"""SELECT f.flight_id, 'jerk_onset' AS method, t_td, sigma_t, CASE WHEN t_td IS NULL THEN 'failed' ELSE 'low-confidence' END AS confidence, CASE WHEN t_td IS NULL AND NOT EXISTS (SELECT 1 FROM sig s WHERE s.flight_id = f.flight_id) THEN 'insufficient_samples' ELSE 'no_ground_roll' END AS reason_code FROM flights f LEFT JOIN (
  SELECT p.flight_id, CASE WHEN q.j IS NULL THEN p.t ELSE q.t0 + least(greatest((p.level - q.j0) / nullif(q.jerk - q.j0, 0e0), 0e0), 1e0) * (q.t - q.t0) END AS t_td, {_sigma('d.cadence * p.scatter / greatest(abs(p.jerk), 5e-2)', 'd.cadence')} AS sigma_t FROM (
    SELECT p.*, (SELECT CASE WHEN count(*) FILTER (WHERE s.j < coalesce(p.q, p.j) - 1 OR s.j > p.j + 1) <= 1 THEN stddev_pop(s.jerk) ELSE stddev_pop(s.jerk) FILTER (WHERE s.j < coalesce(p.q, p.j) - 1 OR s.j > p.j + 1) END FROM sig s WHERE s.flight_id = p.flight_id) AS scatter FROM (
      SELECT p.flight_id, p.j, p.t, p.jerk, p.jerk * 5e-1 AS level, (SELECT max(e.j) FROM edges e WHERE e.flight_id = p.flight_id AND e.j <= p.j AND e.jerk <= p.jerk * 5e-1 AND e.j0 > p.jerk * 5e-1) AS q FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY round(jerk, 9), j) AS pick FROM sig) p WHERE pick = 1 AND abs(jerk) >= 1e-3 AND j > 0) p) p
  LEFT JOIN edges q ON q.flight_id = p.flight_id AND q.j = p.q JOIN scad d ON d.flight_id = p.flight_id) r ON f.flight_id = r.flight_id"""
CTES["edges"] = "SELECT flight_id, j, t, jerk, lag(jerk) OVER (PARTITION BY flight_id ORDER BY j) AS j0, lag(t) OVER (PARTITION BY flight_id ORDER BY j) AS t0 FROM sig"
_SUMS = ", ".join(f"sum({text}) AS {name}" for name, text in estimators.MOMENTS.items())
CTES["region"] = f"SELECT flight_id, t, seq, height AS h, t - min(t) OVER (PARTITION BY flight_id) AS u, min(t) OVER (PARTITION BY flight_id) AS t0 FROM high WHERE geo_alt IS NOT NULL AND datum_ok AND height BETWEEN 0e0 AND {estimators.UPPER_M}"
_QUAD = sql_steps(f"(SELECT flight_id, {_SUMS} FROM region GROUP BY flight_id)", estimators.QUADRATIC)
CTES["flare"] = f"""SELECT f.flight_id, 'flare_crossing' AS method, r.t_td, r.sigma_t, CASE WHEN r.t_td IS NULL THEN 'failed' ELSE 'normal' END AS confidence,
  CASE WHEN r.t_td IS NOT NULL THEN NULL WHEN NOT coalesce((SELECT bool_or(geo_alt IS NOT NULL) FROM pos p WHERE p.flight_id = f.flight_id), false) THEN 'geometric_alt_unavailable' WHEN (SELECT thr_hae FROM thr WHERE thr.flight_id = f.flight_id) IS NULL THEN 'datum_unresolved' ELSE 'insufficient_flare' END AS reason_code
  FROM flights f LEFT JOIN (SELECT flight_id, t0 + root AS t_td, {_sigma('rms / greatest(abs(2e0 * c2 * root + c1), 3e-1)')} AS sigma_t FROM {sql_steps('''(SELECT q.flight_id, q.n, q.c2, q.c1, q.c0 - CASE WHEN b.n_high >= 2 AND abs(b.bias) > 4572e-3 THEN b.bias ELSE 0e0 END AS c0, b.u_end, b.t0, b.rms, g.region_dt, c.cadence FROM quad q JOIN bias b ON q.flight_id = b.flight_id JOIN gaps g ON g.flight_id = q.flight_id JOIN gcad c ON c.flight_id = q.flight_id)''', estimators.ROOTS)} WHERE n >= 3 AND root >= -3e0 * region_dt AND root <= u_end + 3e0 * region_dt) r ON f.flight_id = r.flight_id"""
CTES["quad"] = f"SELECT flight_id, n, c0, c1, c2 FROM {_QUAD}"
CTES["bias"] = f"SELECT r.flight_id, count(*) FILTER (WHERE h >= {estimators.ONSET_M}) AS n_high, quantile_cont(h - c0 - c1 * u - c2 * u * u, 0.5) FILTER (WHERE h >= {estimators.ONSET_M}) AS bias, sqrt(avg(pow(h - c0 - c1 * u - c2 * u * u, 2))) AS rms, max(u) AS u_end, any_value(t0) AS t0 FROM region r JOIN quad q ON r.flight_id = q.flight_id GROUP BY r.flight_id"
CTES["gaps"] = f"SELECT flight_id, coalesce({_MED.format('gap')}, 0e0) AS region_dt FROM (SELECT flight_id, t - lag(t) OVER ({_W}) AS gap FROM region) GROUP BY flight_id"
CTES["gcad"] = f"SELECT flight_id, coalesce({_MED.format('step')}, 0e0) AS cadence FROM (SELECT flight_id, t - lag(t) OVER ({_W}) AS step FROM pos WHERE geo_alt IS NOT NULL) GROUP BY flight_id"
CTES["knee_e"] = f"""SELECT f.flight_id, 'decel_knee' AS method, t_knee AS t_td, {_sigma('rms / greatest(abs(slope_drop), 5e-2)')} AS sigma_t, CASE WHEN t_knee IS NULL THEN 'failed' WHEN v_knee BETWEEN 25 AND 95 AND abs(slope_after) BETWEEN 6e-1 AND 45e-1 THEN 'normal' ELSE 'low-confidence' END AS confidence,
  CASE WHEN t_knee IS NULL THEN 'insufficient_samples' WHEN v_knee BETWEEN 25 AND 95 AND abs(slope_after) BETWEEN 6e-1 AND 45e-1 THEN NULL ELSE 'estimator_disagreement' END AS reason_code FROM flights f LEFT JOIN knees k ON f.flight_id = k.flight_id LEFT JOIN vcad d ON f.flight_id = d.flight_id"""
CTES["raw_est"] = "SELECT * FROM knee_e UNION ALL SELECT * FROM glrt UNION ALL SELECT * FROM flare UNION ALL SELECT * FROM jerk UNION ALL SELECT * FROM cusum UNION ALL SELECT * FROM pelt"
CTES["est"] = "SELECT flight_id, method, t_td - moved AS t_td, sqrt(pow(sigma_t, 2) + pow(moved, 2)) AS sigma_t, confidence, reason_code FROM (SELECT e.*, CASE WHEN t_td >= on_ground_t THEN t_td - (on_ground_t - 1e-3) ELSE 0e0 END AS moved FROM raw_est e LEFT JOIN transit t ON e.flight_id = t.flight_id)"
CTES["elig"] = "SELECT flight_id, m AS estimator, NOT (m IN ('flare_crossing', 'imm_rts') AND source = 'fr24') AS eligible, CASE WHEN m IN ('flare_crossing', 'imm_rts') AND source = 'fr24' THEN 'geometric_alt_unavailable' END AS excluded_reason FROM flights, (VALUES ('decel_knee'), ('flare_crossing'), ('imm_rts'), ('glrt'), ('jerk_onset'), ('cusum'), ('pelt')) v(m)"
CTES["combined"] = "SELECT e.flight_id, sum(t_td / (sigma_t * sigma_t)) / sum(1e0 / (sigma_t * sigma_t)) AS t_td, sqrt(1e0 / sum(1e0 / (sigma_t * sigma_t))) AS sigma_t, count(*) AS n FROM est e JOIN elig g ON e.flight_id = g.flight_id AND e.method = g.estimator AND g.eligible WHERE confidence <> 'failed' AND t_td IS NOT NULL AND sigma_t > 0 GROUP BY e.flight_id"


def fused(weight: str) -> str:
    return f"""SELECT flight_id, t_td, sigma_t, t_td - {Z90} * sigma_t AS ci_low, t_td + {Z90} * sigma_t AS ci_high, CASE WHEN n = 0 THEN 'no-estimate' WHEN reason_code IS NULL THEN 'normal' ELSE 'low-confidence' END AS confidence, reason_code, n, between_s, contributing, excluded FROM (
      SELECT *, CASE WHEN n = 0 THEN 'all_estimators_failed' WHEN n >= 2 AND between_s > 3e0 THEN 'estimator_disagreement' WHEN {2 * Z90} * sigma_t > 8e0 THEN 'wide_ci' END AS reason_code FROM (
        SELECT flight_id, any_value(mean) AS t_td, sqrt(sum(w * w * sigma_t * sigma_t) + sum(w * pow(t_td - mean, 2))) AS sigma_t, sqrt(sum(w * pow(t_td - mean, 2))) AS between_s, count(*) FILTER (WHERE why IS NULL) AS n,
          coalesce(string_agg(method, ',' ORDER BY method) FILTER (WHERE why IS NULL), '') AS contributing, coalesce(string_agg(concat(method, ': ', why), ',' ORDER BY method) FILTER (WHERE why IS NOT NULL), '') AS excluded FROM (
          SELECT *, sum(w * t_td) OVER (PARTITION BY flight_id) AS mean FROM (SELECT *, r / sum(r) OVER (PARTITION BY flight_id) AS w FROM (SELECT *, CASE WHEN why IS NULL THEN {weight} END AS r FROM (SELECT *, {EXCLUSION.format(limit='5.0')} AS why FROM est)))) GROUP BY flight_id))"""


CTES["fused"] = fused("1e0 / (sigma_t * sigma_t)")
CTES["stacked"] = fused("CASE method WHEN 'decel_knee' THEN 6e-1 WHEN 'glrt' THEN 3e-1 ELSE 1e0 / (sigma_t * sigma_t) END")
CTES["arms"] = "SELECT * FROM (VALUES ('B738', 'narrowbody', 27e-1, 12e0, 35e-1), ('A320', 'narrowbody', 29e-1, 11e0, 4e0), ('B77W', 'widebody', 48e-1, 25e0, 3e0), ('A333', 'widebody', 44e-1, 23e0, 45e-1)) v(aircraft_type, aircraft_class, height_m, offset_m, pitch_deg)"
_SHIFT = "offset_m * cos(radians(pitch_deg)) + height_m * sin(radians(pitch_deg))"
CTES["levers"] = f"""SELECT flight_id, {_SHIFT} AS shift_m, height_m, pitch_deg, arm, arm <> 'type' AS missing, CASE WHEN arm = 'type' THEN 0e0 ELSE (SELECT max({_SHIFT}) - min({_SHIFT}) FROM arms) END AS widening_m FROM (
  SELECT f.flight_id, coalesce(a.height_m, m.height_m) AS height_m, coalesce(a.offset_m, m.offset_m) AS offset_m, coalesce(a.pitch_deg, m.pitch_deg) AS pitch_deg, CASE WHEN a.aircraft_type IS NULL THEN 'median' ELSE 'type' END AS arm
  FROM flights f LEFT JOIN arms a ON f.aircraft_type = a.aircraft_type, (SELECT quantile_cont(height_m, 0.5) AS height_m, quantile_cont(offset_m, 0.5) AS offset_m, quantile_cont(pitch_deg, 0.5) AS pitch_deg FROM arms) m)"""
_MAPPED = project(position_at("(SELECT flight_id, t_td AS q, sigma_t FROM fused WHERE t_td IS NOT NULL)"))
_MARGIN = 50 * 0.3048
CTES["speeds"] = f"SELECT flight_id, gs_at, slope_at FROM {velocity_at('(SELECT flight_id, t_td AS q FROM fused WHERE t_td IS NOT NULL)')}"
CTES["mapped"] = f"""SELECT *, along_m < 0e0 OR along_m > length_m AS out_of_bounds, abs(lateral_m) > width_m / 2e0 + {_MARGIN} AS suspected_wrong_runway, CASE WHEN NOT coalesce(present, false) THEN 'degraded_interpolation' WHEN NOT coalesce(gs_at BETWEEN 50 AND 220, false) THEN 'implausible_speed' END AS speed_reason FROM (
  SELECT m.flight_id, m.q AS t_td, m.sigma_t, m.p_along - coalesce(l.shift_m, 0e0) AS along_m, m.p_lateral AS lateral_m, s.gs_at, s.gs_at * {KT_TO_MPS} AS gs_mps, coalesce(abs(s.slope_at) * abs(m.sigma_t), 0e0) AS sigma_v, m.degraded, l.missing, f.length_m, f.width_m, (SELECT bool_or(abs(v.t - m.q) <= 1e1) FROM vel v WHERE v.flight_id = m.flight_id) AS present
  FROM {_MAPPED} m JOIN speeds s ON m.flight_id = s.flight_id LEFT JOIN levers l ON m.flight_id = l.flight_id JOIN flights f ON f.flight_id = m.flight_id)"""
CTES["widened"] = f"""SELECT u.flight_id, greatest(coalesce(max(CASE WHEN next_t >= u.t_td - 3e1 AND t <= u.t_td + 3e1 AND next_t - t > 1e1 THEN (next_t - t) / 5e0 END), 1e0), 1e0) AS gap_factor, any_value(on_ground_t) IS NOT NULL AND count(*) FILTER (WHERE lat IS NOT NULL AND t > on_ground_t AND t <= on_ground_t + 15e0) < 2 AS starved
  FROM fused u JOIN (SELECT *, lead(t) OVER ({_W}) AS next_t FROM pos) p ON u.flight_id = p.flight_id LEFT JOIN transit g ON g.flight_id = u.flight_id GROUP BY u.flight_id"""
CTES["quantified"] = f"""SELECT *, t_td - time_half AS time_low, t_td + time_half AS time_high, distance_ft - dist_half * {M_TO_FT} AS distance_low_ft, distance_ft + dist_half * {M_TO_FT} AS distance_high_ft FROM (
  SELECT u.flight_id, m.along_m * {M_TO_FT} AS distance_ft, m.lateral_m, m.gs_mps, m.gs_at, m.sigma_v, m.out_of_bounds, m.suspected_wrong_runway, m.speed_reason, u.t_td, {Z90} * u.sigma_t * w.gap_factor * CASE WHEN w.starved THEN 15e-1 ELSE 1e0 END AS time_half, {Z90} * abs(m.gs_mps) * u.sigma_t * w.gap_factor * CASE WHEN w.starved THEN 15e-1 ELSE 1e0 END * CASE WHEN m.missing THEN 15e-1 ELSE 1e0 END AS dist_half,
    CASE WHEN m.missing OR w.starved THEN 'low-confidence' ELSE u.confidence END AS confidence, coalesce(u.reason_code, CASE WHEN m.missing THEN 'missing_lever_arm' END, CASE WHEN w.starved THEN 'no_ground_roll' END) AS reason_code FROM fused u JOIN mapped m ON u.flight_id = m.flight_id LEFT JOIN widened w ON w.flight_id = u.flight_id WHERE u.confidence <> 'no-estimate')"""
CTES["base"] = f"SELECT flight_id, p_along AS along_m FROM {project('(SELECT flight_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY t, seq) AS pick FROM pos WHERE on_ground) WHERE pick = 1)')}"
CTES["knee_x"] = f"SELECT flight_id, p_along AS along_m FROM {project(position_at('(SELECT flight_id, t_td AS q FROM knee_e WHERE t_td IS NOT NULL)'))}"
CTES["truth_x"] = "SELECT flight_id, x_true AS along_m FROM flights WHERE kind = 'completed'"
#: Evaluations made from orders and their lines: enough rows for strata, with gaps in every column.
EVALUATION = [
    "CAST(o_orderkey AS STRING) AS flight_id",
    "concat('T', CAST(o_orderkey % 7 AS STRING)) AS aircraft_type",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'fr24' ELSE 'aireon' END AS source",
    "concat('A', CAST(o_custkey % 23 AS STRING)) AS airport",
    "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 1e3 + o_totalprice % 2e3 END AS true_ft",
    "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 1e3 + o_totalprice % 2e3 + (o_custkey % 101 - 45) * 9e0 END AS est_ft",
    "1e3 + o_totalprice % 2e3 + (o_custkey % 101 - 45) * 9e0 - 35e1 AS low_ft",
    "1e3 + o_totalprice % 2e3 + (o_custkey % 101 - 45) * 9e0 + 35e1 AS high_ft",
    "CAST(o_orderkey AS DOUBLE) AS true_t",
    "o_orderkey + (o_custkey % 13 - 6) * 5e-1 AS est_t",
    "o_orderkey + (o_custkey % 13 - 6) * 5e-1 - 25e-1 AS t_low",
    "o_orderkey + (o_custkey % 13 - 6) * 5e-1 + 25e-1 AS t_high",
    "CASE WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'good' END AS clock",
    "CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 11e1 + o_totalprice % 6e1 END AS true_kt",
    "11e1 + o_totalprice % 6e1 + (o_custkey % 9 - 4) AS est_kt",
]
CTES["evals"] = f"SELECT {', '.join(EVALUATION)} FROM orders"


#: e is the error in feet (estimate less truth); null where either is missing.
_METRICS = """count(*) AS n_flights, count(e) AS n_estimates, sqrt(sum(e * e) / count(e)) AS rmse_ft, median(abs(e)) AS median_abs_ft, median(e) AS median_signed_ft, quantile_cont(abs(e), 0.95) AS p95_abs_ft, quantile_cont(abs(e), 0.99) AS p99_abs_ft,
  quantile_cont(e, 0.95) FILTER (WHERE e > 0) AS long_p95_ft, quantile_cont(e, 0.25) AS iqr_low_ft, quantile_cont(e, 0.75) AS iqr_high_ft, count(*) FILTER (WHERE e IS NOT NULL AND low_ft <= true_ft AND true_ft <= high_ft) * 1e0 / nullif(count(e), 0) AS coverage,
  sqrt(avg(pow(est_t - true_t, 2)) FILTER (WHERE clock <> 'failed')) AS time_rmse_s, sqrt(avg(pow(est_kt - true_kt, 2))) AS speed_rmse_kt"""
CTES["metrics"] = f"SELECT CASE WHEN grouping(aircraft_type) = 0 THEN 'aircraft_type' WHEN grouping(source) = 0 THEN 'source' WHEN grouping(airport) = 0 THEN 'airport' WHEN grouping(band) = 0 THEN 'band' ELSE 'overall' END AS dimension, coalesce(aircraft_type, source, airport, band, 'all') AS key, {_METRICS}, count(*) >= 30 AS reportable FROM (SELECT *, est_ft - true_ft AS e, {validation.band_label('true_kt')} AS band FROM evals) GROUP BY GROUPING SETS ((aircraft_type), (source), (airport), (band), ())"


RECURSIVE = ("cusum_walk", "walk", "pelt_walk", "pelt_back")


def sql(select: str) -> str:
    """``select`` behind the common table expressions that it needs, each after those that it needs itself."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"(?<![\w.'])(?:FROM|JOIN|,)\s+(\w+)", text):
            if name in CTES and name not in order:
                if name not in trail:
                    trail.append(name)
                    need(CTES[name])
                    trail.remove(name)
                    if name not in order:
                        order.append(name)

    trail: list[str] = []
    need(select)
    return f"WITH RECURSIVE {', '.join(f'{n} AS {"" if n in RECURSIVE else "MATERIALIZED "}({CTES[n]})' for n in order)} {select}" if order else select
