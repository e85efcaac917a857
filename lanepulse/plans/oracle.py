"""The registered queries as plain SQL over the sample tables, for DuckDB.

Written for clarity and by brute force where the Spark side is clever: dense
grids, all pairs, plain reachability.
"""

from __future__ import annotations

import re
from math import cos, pi

from lanepulse.functions.names import GENERIC_WORDS

_KX = f"'{111.0 * cos(-34.9 * pi / 180)!r}'::DOUBLE"
_KY = "111::DOUBLE"
_GENERIC = ", ".join(f"'{w}'" for w in GENERIC_WORDS)
_STREETS = "('Street 1', 'Street 2', 'Street 4')"


def _num(text: str) -> str:
    return f"'{text}'::DOUBLE"


def _key(name: str) -> str:
    words = (
        f"list_filter(string_split_regex(lower(strip_accents({name})), '[^a-z0-9]+'), "
        "lambda t: t <> '')"
    )
    telling = f"list_filter({words}, lambda t: t NOT IN ({_GENERIC}))"
    return f"CASE WHEN len({telling}) > 0 THEN {telling} ELSE {words} END"


def _mean(total: str, n: str) -> str:
    return f"CAST({total} AS DOUBLE) / nullif({n}, 0)"


def _clip(value: str, low: str = "0", high: str = "1") -> str:
    return f"CASE WHEN ({value}) IS NOT NULL THEN greatest(least({value}, {high}), {low}) END"


def _label(bucket: str) -> str:
    return (
        f"lpad(CAST({bucket} // 2 AS VARCHAR), 2, '0') || ':' || "
        f"lpad(CAST({bucket} % 2 * 30 AS VARCHAR), 2, '0')"
    )


# --- shared tables, each a query over earlier ones ---

_TABLES: dict[str, str] = {}

_TABLES["feed"] = """
SELECT user_id AS detector_id, CAST(event_id % 2 + 1 AS INTEGER) AS lane,
       CAST(ts AS DATE) AS date,
       CAST((hour(ts) * 60 + minute(ts)) // 30 AS INTEGER) AS bucket,
       CAST(dayofweek(ts) AS INTEGER) AS dow,
       'Street ' || (sn % 12) AS street,
       'Street ' || ((sn + 1) % 12) AS from_street,
       'Street ' || ((sn + 2) % 12) AS to_street,
       CASE WHEN event_id % 97 = 0 THEN NULL
            WHEN sn % 10 = 7 THEN CAST(-3489 AS DOUBLE) / 100
            ELSE CAST(-3492 + sn % 13 AS DOUBLE) / 100 END AS lat,
       CASE WHEN sn % 10 = 7 THEN CAST(-5622 AS DOUBLE) / 100
            ELSE CAST(-5628 + sn % 24 AS DOUBLE) / 100 END AS lon,
       CASE WHEN event_id % 13 = 0 THEN NULL
            WHEN event_id % 401 = 0 THEN 300
            WHEN sn % 20 = 3 THEN event_id % 2
            WHEN user_id % 9 = 4 AND event_id % 2 = 1 THEN 0
            WHEN event_id % 11 = 0 THEN 0
            WHEN sn % 20 = 5 AND hour(ts) BETWEEN 7 AND 21 THEN 1 + event_id % 2
            WHEN sn % 20 = 8 THEN 4 + event_id % 5
            ELSE CAST(floor(value) AS BIGINT) % 60 + 1 END AS speed
FROM (SELECT *, CAST(floor(user_id / 2) AS INTEGER) AS sn FROM events)"""

_TABLES["good"] = "SELECT * FROM feed WHERE lat IS NOT NULL"

_TABLES["site"] = """
SELECT row_number() OVER (ORDER BY lat, lon, street, from_street, to_street) AS site_id, *
FROM (SELECT lat, lon, street, from_street, to_street FROM good GROUP BY ALL)"""


def _keyed(period: str) -> dict[str, str]:
    """Tables judged per lane or site; with a period expression, per period as well."""
    per = "period," if period else ""
    return {
        "placed": f"""
SELECT site_id, {f"{period} AS period," if period else ""} good.* FROM good
JOIN site USING (lat, lon, street, from_street, to_street)""",
        "claims": f"""
SELECT {f"{period} AS period," if period else ""} lat, lon, count(DISTINCT street) AS streets_at_coord
FROM good GROUP BY ALL""",
        "lane_state": f"""
SELECT {per} site_id, detector_id, lane, n_moving, mean_speed,
       n_moving = 0 OR mean_speed < 3 AS is_dead
FROM (SELECT {per} site_id, detector_id, lane, count(*) FILTER (speed > 0) AS n_moving,
             avg(speed) FILTER (speed > 0) AS mean_speed
      FROM placed WHERE speed <= 120 GROUP BY {per} site_id, detector_id, lane)""",
        "kept": f"""
SELECT placed.* FROM placed
SEMI JOIN (SELECT * FROM lane_state WHERE NOT is_dead) alive
  USING ({per} site_id, detector_id, lane)
WHERE speed <= 120""",
        "fact": f"""
SELECT {per} site_id, detector_id, lane, date, bucket, dow,
       CAST(sum(CASE WHEN speed > 0 THEN speed END) AS DOUBLE) AS speed_sum,
       count(CASE WHEN speed > 0 THEN 1 END) AS n_moving,
       count(CASE WHEN speed = 0 THEN 1 END) AS n_zero
FROM kept GROUP BY {per} site_id, detector_id, lane, date, bucket, dow""",
        "rhythm": f"""
SELECT {per} site_id,
       avg(CASE WHEN bucket BETWEEN 14 AND 43 THEN speed END) AS day_speed,
       avg(CASE WHEN bucket BETWEEN 4 AND 11 THEN speed END) AS night_speed
FROM kept WHERE dow BETWEEN 1 AND 5 AND speed > 0 GROUP BY {per} site_id""",
        "freeflow": f"""
SELECT {per} site_id, quantile_cont(speed, 0.85) AS free_flow_speed
FROM kept WHERE speed > 0 GROUP BY {per} site_id""",
        "figures": f"""
SELECT {per} site_id, count(DISTINCT detector_id) AS n_detectors,
       count(DISTINCT lane) AS n_lanes, count(speed) AS n_readings,
       count(CASE WHEN speed = 0 THEN 1 END) AS n_zero,
       avg(CASE WHEN speed > 0 THEN speed END) AS mean_speed
FROM kept GROUP BY {per} site_id""",
        "detector": f"""
SELECT {per} site_id, lat, lon, street, from_street, to_street,
       coalesce(n_detectors, 0) AS n_detectors, coalesce(n_lanes, 0) AS n_lanes,
       coalesce(n_readings, 0) AS n_readings, coalesce(n_zero, 0) AS n_zero,
       mean_speed, free_flow_speed, n_missing, streets_at_coord, day_speed, night_speed,
       n_dead_lanes
FROM site
JOIN (SELECT {per} site_id, count(*) FILTER (is_dead) AS n_dead_lanes
      FROM lane_state GROUP BY {per} site_id) USING (site_id)
JOIN (SELECT {per} site_id, count(*) FILTER (speed IS NULL) AS n_missing
      FROM placed GROUP BY {per} site_id) USING ({per} site_id)
JOIN claims USING ({per} lat, lon)
LEFT JOIN figures USING ({per} site_id)
LEFT JOIN freeflow USING ({per} site_id)
LEFT JOIN rhythm USING ({per} site_id)""",
    }


_TABLES.update(_keyed(""))
_WEEKLY = _keyed("strftime(date_trunc('week', date), '%Y-%m-%d')")
_MONTHLY = _keyed("strftime(date, '%Y-%m')")

# Loads as the registered queries make them: a site is numbered when its first readings arrive.
_LOADED = {
    "site": """
SELECT row_number() OVER (ORDER BY load, lat, lon, street, from_street, to_street) AS site_id,
       lat, lon, street, from_street, to_street
FROM (SELECT lat, lon, street, from_street, to_street,
             min(CASE WHEN date < DATE '2024-01-08' THEN 3 WHEN date < DATE '2024-01-22' THEN 1
                      WHEN date < DATE '2024-01-29' THEN 2 ELSE 4 END) AS load
      FROM feed WHERE lat IS NOT NULL GROUP BY ALL)""",
}
_TWO_WEEKS = {
    "good": """
SELECT * FROM feed
WHERE lat IS NOT NULL AND strftime(date_trunc('week', date), '%Y-%m-%d') IN ('2024-01-08', '2024-01-22')""",
}

def _renamed(tables: dict[str, str], prefix: str) -> dict[str, str]:
    """The same tables under other names, so that both can be used at once."""
    names = re.compile(rf"\b({'|'.join(tables)})\b")
    return {prefix + k: names.sub(lambda m: prefix + m[0], sql) for k, sql in tables.items()}


_TABLES.update(_renamed(_WEEKLY, "w_"))
_VARIANTS = {
    "sites_over_loads": _LOADED,
    "detectors_from_weeks": _LOADED,
    "measurements_from_weeks": _LOADED,
    "detectors_from_two_weeks": {**_LOADED, **_TWO_WEEKS},
    "detectors_per_stored_week": {**_WEEKLY, **_LOADED},
}


# Sites whose weekday readings are all zero still have a row, without means.
_TABLES["day_night_all"] = """
SELECT site_id, day_speed, night_speed
FROM (SELECT DISTINCT site_id FROM kept WHERE dow BETWEEN 1 AND 5)
LEFT JOIN rhythm USING (site_id)"""


def _flagged(table: str) -> str:
    return f"""
SELECT * RENAME (n_zero AS n_zero_total, n_readings AS n_readings_total,
                 n_missing AS n_missing_total),
       is_live AND NOT is_stalled AS is_usable
FROM (SELECT *, coalesce(mean_speed >= 3, false) AS is_live,
             coalesce(free_flow_speed >= 10, false) AS has_reference,
             coalesce(day_speed < 3 AND night_speed > 3 * day_speed, false) AS is_stalled,
             streets_at_coord <= 2 AS has_location
      FROM {table})"""


_TABLES["flagged"] = _flagged("detector")
_TABLES["w_flagged"] = _flagged("w_detector")


def _slice(
    where: str, *, zeros: bool = False, floor: int = 3, sites: str, by: str = "", weekly: bool = False
) -> str:
    w = "w_" if weekly else ""
    by = "period," if weekly else by
    n = "sum(n_moving + n_zero)" if zeros else "sum(n_moving)"
    lost = "1 - speed / free_flow_speed"
    return f"""
SELECT *, CASE WHEN has_reference THEN {_clip(lost)} END AS congestion,
       speed - mean_speed AS vs_typical,
       street || ': ' || from_street || ' → ' || to_street AS tramo
FROM (SELECT {by} site_id, coalesce(sum(speed_sum), 0) AS speed_sum, CAST({n} AS BIGINT) AS samples,
             CAST(sum(n_zero) AS BIGINT) AS n_zero, CAST(sum(n_moving) AS BIGINT) AS n_moving,
             {_mean('coalesce(sum(speed_sum), 0)', n)} AS speed
      FROM {'w_fact' if w else 'scoped' if by else 'fact'} WHERE {where} GROUP BY {by} site_id HAVING {n} >= {floor})
JOIN (SELECT * FROM {w}flagged WHERE {sites}) USING ({"period," if w else ""} site_id)"""


_WEEK = "dow BETWEEN 1 AND 5"
_MAPPED = "is_usable AND has_location"

_TABLES["scoped"] = """
SELECT 'weekday' AS scope, * FROM fact WHERE dow BETWEEN 1 AND 5
UNION ALL SELECT 'weekend', * FROM fact WHERE dow IN (0, 6)
UNION ALL SELECT 'all', * FROM fact"""
_TABLES["week_slice"] = _slice(_WEEK, sites=_MAPPED)
_TABLES["evening"] = _slice(f"{_WEEK} AND bucket = 35", floor=1, sites=_MAPPED)
_TABLES["w_slice"] = _slice(_WEEK, sites=_MAPPED, weekly=True)
_TABLES["w_evening"] = _slice(f"{_WEEK} AND bucket = 35", floor=1, sites=_MAPPED, weekly=True)
_TABLES["every_slice"] = _slice("true", sites=_MAPPED, by="scope, bucket,")
_TABLES["every_slice_1"] = _slice("true", floor=1, sites=_MAPPED, by="scope, bucket,")


def _profile(
    where: str, *, n: str = "sum(n_moving)", street: str = "", weekly: bool = False
) -> str:
    w, key = ("w_", "period, site_id") if weekly else ("", "site_id")
    street = ("period," if weekly else "") + street
    return f"""
SELECT *, {_label('bucket')} AS time, bucket * 30 / 60::DOUBLE AS hour
FROM (SELECT {street} bucket, coalesce(sum(speed_sum), 0) AS speed_sum,
             CAST({n} AS BIGINT) AS samples,
             {_mean('coalesce(sum(speed_sum), 0)', n)} AS speed
      FROM {w}fact JOIN {w}flagged USING ({key}) WHERE is_usable AND {where}
      GROUP BY {street} bucket)"""


_TABLES["week_profile"] = _profile(_WEEK)
_TABLES["named_profile"] = _profile(f"{_WEEK} AND street IN {_STREETS}", street="street,")

_TABLES["w_profile"] = _profile(_WEEK, weekly=True)
_TABLES["w_named_profile"] = _profile(
    f"{_WEEK} AND street IN {_STREETS}", street="street,", weekly=True)

# --- surface by dense grid ---


def _axes(points: str, by: str = "") -> str:
    group = f"GROUP BY {by.rstrip(', ')}" if by else ""
    step, cut = _num("0.2"), _num("1.2")

    def axis(a: str) -> str:
        first = f"(min({a}) - {cut})"
        return (
            f"{first} AS {a}0, ({first} + {step}) - {first} AS d{a}, "
            f"CAST(ceil((max({a}) + {cut} + {step} - {first}) / {step}) AS BIGINT) AS n{a}"
        )

    return f"SELECT {by} {axis('x')}, {axis('y')} FROM {points} {group}"


def _dense(points: str, axes: str, by: str = "") -> str:
    away = f"sqrt(({_num('0')} + gx - x) * (gx - x) + (gy - y) * (gy - y))"
    weight = f"exp(-power(d / {_num('0.5')}, 2))"
    match = f"JOIN {points} USING ({by.rstrip(', ')})" if by else f"CROSS JOIN {points}"
    return f"""
SELECT {by} i, j, sum(w * v) / nullif(sum(w), 0) AS value, sum(w) AS support
FROM (SELECT *, CASE WHEN d <= {_num('1.2')} THEN {weight} ELSE 0 END AS w
      FROM (SELECT *, {away} AS d
            FROM (SELECT {by} i, j, x0 + i * dx AS gx, y0 + j * dy AS gy
                  FROM (SELECT *, unnest(range(ny)) AS j
                        FROM (SELECT *, unnest(range(nx)) AS i FROM {axes})))
            {match}))
GROUP BY {by} i, j"""


def _points(table: str, column: str, by: str = "") -> str:
    return (
        f"SELECT {by} lon * {_KX} AS x, lat * {_KY} AS y, CAST({column} AS DOUBLE) AS v "
        f"FROM {table} WHERE {column} IS NOT NULL"
    )


_TABLES["jam_points"] = _points("week_slice", "congestion")
_TABLES["jam_axes"] = _axes("jam_points")
_TABLES["jam_grid"] = _dense("jam_points", "jam_axes")
_TABLES["speed_points"] = _points("week_slice", "speed")
_TABLES["speed_axes"] = _axes("speed_points")
_TABLES["speed_grid"] = _dense("speed_points", "speed_axes")
_TABLES["w_points"] = _points("w_slice", "speed", "period,")
_TABLES["w_axes"] = _axes("w_points", "period,")
_TABLES["w_grid"] = _dense("w_points", "w_axes", "period,")
_TABLES["frame_points"] = _points("every_slice_1", "speed", "scope, bucket,")
_TABLES["frame_axes"] = _axes("frame_points", "scope, bucket,")
_TABLES["frame_grid"] = _dense("frame_points", "frame_axes", "scope, bucket,")

# --- roads by plain reachability ---

_D, _HALF, _SHIFT = _num("0.003"), _num("0.0015"), _num("0.0003")

_TABLES["spot"] = """
SELECT row_number() OVER (ORDER BY lat, lon, street, from_street) - 1 AS i,
       CAST(split_part(street, ' ', 2) AS INTEGER) AS n, *
FROM (SELECT DISTINCT lat, lon, street, from_street FROM site
      WHERE NOT (lat = CAST(-3489 AS DOUBLE) / 100 AND lon = CAST(-5622 AS DOUBLE) / 100))"""

_OWN = """(CASE WHEN n % 2 = 0 THEN 'Avenida ' ELSE 'Av. ' END)
       || CASE WHEN n % 4 = 2 THEN replace(street, 'Street', 'Streeet') ELSE street END"""

_TABLES["way"] = f"""
SELECT i * 3 AS way_id, {_OWN} AS name,
       [{{'lon': lon - {_D}, 'lat': lat}}, {{'lon': lon, 'lat': lat}},
        {{'lon': lon + {_D}, 'lat': lat + {_HALF}}}] AS coords
FROM spot WHERE i % 9 <> 5
UNION ALL
SELECT i * 3 + 1, {_OWN},
       [{{'lon': lon - {_D}, 'lat': lat + {_SHIFT}}},
        {{'lon': lon + {_D}, 'lat': lat + {_HALF} + {_SHIFT}}}]
FROM spot WHERE i % 9 <> 5 AND n % 3 = 0
UNION ALL
SELECT i * 3 + 2, 'Calle ' || from_street,
       [{{'lon': lon, 'lat': lat - {_D}}}, {{'lon': lon, 'lat': lat + {_D}}}]
FROM spot"""

_TABLES["named_way"] = f"SELECT way_id, name, {_key('name')} AS key FROM way"

_TABLES["cell"] = f"""
SELECT DISTINCT way_id, key, CAST(floor(c.lon * {_KX} / {_num('0.1')}) AS BIGINT) AS cx,
       CAST(floor(c.lat * {_KY} / {_num('0.1')}) AS BIGINT) AS cy
FROM (SELECT way_id, unnest(coords) AS c FROM way) JOIN named_way USING (way_id)"""

_TABLES["link"] = """
SELECT DISTINCT a.way_id AS u, b.way_id AS v
FROM cell a JOIN cell b ON a.key = b.key AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1"""

_TABLES["reach"] = """
SELECT u AS start, v AS node FROM link
UNION
SELECT start, v FROM reach JOIN link ON node = u"""

_TABLES["member"] = """
SELECT way_id, key, name, label
FROM named_way JOIN (SELECT start AS way_id, min(node) AS label FROM reach GROUP BY 1)
  USING (way_id)"""

_TABLES["corridor"] = """
SELECT row_number() OVER (ORDER BY key, label) - 1 AS corridor_id, label, key,
       arg_min(name, {'n': -n, 'name': name}) AS name
FROM (SELECT key, label, name, count(*) AS n FROM member GROUP BY 1, 2, 3)
GROUP BY key, label"""

_TABLES["way_corridor"] = """
SELECT way_id, corridor_id, corridor.name, array_to_string(corridor.key, ' ') AS key
FROM member JOIN corridor USING (label)"""

_TABLES["segment"] = f"""
SELECT way_id, CAST(segment AS INTEGER) AS segment, a, b,
       greatest(1, CAST(ceil(
           sqrt(power(b.lon * {_KX} - a.lon * {_KX}, 2)
                + power(b.lat * {_KY} - a.lat * {_KY}, 2)) / {_num('0.06')}) AS BIGINT)) AS steps
FROM (SELECT way_id, segment, coords[segment] AS a, coords[segment + 1] AS b
      FROM (SELECT *, unnest(range(1, len(coords))) AS segment FROM way))"""

_TABLES["chunk"] = """
SELECT corridor_id, name, key, way_id, segment, piece, lon0, lat0, lon1, lat1,
       (lon0 + lon1) / 2 AS mid_lon, (lat0 + lat1) / 2 AS mid_lat
FROM (SELECT *, a.lon + (b.lon - a.lon) * (piece / steps) AS lon0,
             a.lat + (b.lat - a.lat) * (piece / steps) AS lat0,
             a.lon + (b.lon - a.lon) * ((piece + 1) / steps) AS lon1,
             a.lat + (b.lat - a.lat) * ((piece + 1) / steps) AS lat1
      FROM (SELECT *, unnest(range(steps)) AS piece FROM segment))
JOIN way_corridor USING (way_id)"""

# --- matching by all pairs ---

_TABLES["approach"] = f"""
SELECT lat, lon, corridor_id, name, min(sqrt(power(rx - t * dx, 2) + power(ry - t * dy, 2)))
           AS distance
FROM (SELECT *, greatest(0, least(1, (rx * dx + ry * dy)
                 / CASE WHEN dx * dx + dy * dy > 0 THEN dx * dx + dy * dy ELSE 1e-12 END)) AS t
      FROM (SELECT lat, lon, corridor_id, name,
                   lon1 * {_KX} - lon0 * {_KX} AS dx, lat1 * {_KY} - lat0 * {_KY} AS dy,
                   lon * {_KX} - lon0 * {_KX} AS rx, lat * {_KY} - lat0 * {_KY} AS ry
            FROM (SELECT DISTINCT lat, lon FROM flagged) CROSS JOIN chunk))
GROUP BY 1, 2, 3, 4 HAVING distance <= {_num('0.12')}"""

_TABLES["name_pair"] = f"""
SELECT street, name, {_key('street')} AS wanted, {_key('name')} AS offered
FROM (SELECT DISTINCT street, name FROM flagged JOIN approach USING (lat, lon))"""

_TABLES["token_pair"] = """
SELECT DISTINCT a, unnest(offered) AS b
FROM (SELECT unnest(wanted) AS a, offered FROM name_pair)"""

# Longest common block of the open range of each token pair, earliest in the
# first and then in the second token; what lies left and right of it stays open.
_TABLES["block"] = """
SELECT a, b, 0 AS alo, CAST(len(a) AS INTEGER) AS ahi, 0 AS blo, CAST(len(b) AS INTEGER) AS bhi,
       0 AS k
FROM token_pair
UNION ALL
SELECT a, b, CASE WHEN side = 0 THEN alo ELSE i + n END, CASE WHEN side = 0 THEN i ELSE ahi END,
       CASE WHEN side = 0 THEN blo ELSE j + n END, CASE WHEN side = 0 THEN j ELSE bhi END,
       CASE WHEN side = 0 THEN n ELSE 0 END
FROM (SELECT *, row_number() OVER (PARTITION BY a, b, alo, blo ORDER BY n DESC, i, j) AS r
      FROM (SELECT a, b, alo, ahi, blo, bhi, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
                   CAST(n AS INTEGER) AS n
            FROM block, unnest(range(alo, ahi)) ri(i), unnest(range(blo, bhi)) rj(j),
                 unnest(range(1, least(ahi - i, bhi - j) + 1)) rn(n)
            WHERE i >= alo AND i + n <= ahi AND j >= blo AND j + n <= bhi
              AND a[i + 1 : i + n] = b[j + 1 : j + n]))
CROSS JOIN (VALUES (0), (1)) sides(side)
WHERE r = 1"""

_TABLES["token_score"] = """
SELECT a, b, CASE WHEN a = b THEN 10
                  WHEN len(a) = 1 AND starts_with(b, a) THEN 7
                  WHEN len(a) >= 5 AND 2.0 * sum(k) / (len(a) + len(b)) >= 0.85 THEN 9
                  ELSE 0 END AS tenths
FROM block GROUP BY a, b"""

_TABLES["scored"] = """
SELECT street, name, CAST(sum(best) AS DOUBLE) / (count(*) * 10) AS score
FROM (SELECT street, name, pos, max(tenths) AS best
      FROM (SELECT street, name, pos, wanted[pos] AS a, unnest(offered) AS b
            FROM (SELECT *, unnest(range(1, len(wanted) + 1)) AS pos FROM name_pair))
      JOIN token_score USING (a, b) GROUP BY 1, 2, 3)
GROUP BY 1, 2"""

_TABLES["matched"] = """
SELECT site_id, arg_min(corridor_id, {'s': -score, 'd': distance, 'c': corridor_id})
           FILTER (score >= 0.6) AS corridor_id
FROM flagged LEFT JOIN approach USING (lat, lon) LEFT JOIN scored USING (street, name)
WHERE has_location GROUP BY 1"""

_TABLES["matched_usable"] = """
SELECT site_id, corridor_id FROM matched SEMI JOIN (FROM flagged WHERE is_usable)
  USING (site_id)"""

# --- street field by all pairs within a corridor ---


def _reached(reach: str) -> str:
    return f"""
SELECT chunk.*, site_id, speed AS v, d,
       CASE WHEN d <= {_num(reach)} THEN exp(-power(d / {_num('0.4')}, 2)) ELSE 0 END AS w
FROM chunk LEFT JOIN (
  SELECT way_id, segment, piece, site_id, speed,
         sqrt(power(mid_lon * {_KX} - lon * {_KX}, 2) + power(mid_lat * {_KY} - lat * {_KY}, 2))
             AS d
  FROM week_slice JOIN matched USING (site_id) JOIN chunk USING (corridor_id))
USING (way_id, segment, piece)"""


_TABLES["reached_far"] = _reached("1.0")
_TABLES["reached_near"] = _reached("0.25")

_FIELD = "corridor_id, way_id, segment, piece"

_TABLES["w_reached"] = f"""
SELECT chunk.*, period, site_id, speed AS v, d,
       CASE WHEN d <= {_num('1.0')} THEN exp(-power(d / {_num('0.4')}, 2)) ELSE 0 END AS w
FROM chunk CROSS JOIN (SELECT DISTINCT period FROM w_slice) LEFT JOIN (
  SELECT period, way_id, segment, piece, site_id, speed,
         sqrt(power(mid_lon * {_KX} - lon * {_KX}, 2) + power(mid_lat * {_KY} - lat * {_KY}, 2))
             AS d
  FROM w_slice JOIN matched USING (site_id) JOIN chunk USING (corridor_id))
USING (period, way_id, segment, piece)"""


def _closest(table: str) -> str:
    return f"""
SELECT {_FIELD}, CASE WHEN w > 0 THEN v END AS value, coalesce(w, 0) AS support
FROM {table}
QUALIFY row_number() OVER (PARTITION BY way_id, segment, piece ORDER BY d, site_id) = 1"""


_TABLES["blend"] = f"""
SELECT {_FIELD}, sum(w * v) / nullif(sum(w), 0) AS value, coalesce(sum(w), 0) AS support
FROM reached_far GROUP BY ALL"""


# --- the queries ---

_WEEK_OF = "strftime(date_trunc('week', date), '%Y-%m-%d')"


def _report(by: str = "") -> str:
    return f"""
SELECT *, n_missing / n_rows AS share_missing, n_implausible / n_rows AS share_implausible,
       n_negative / n_rows AS share_negative, n_zero / n_rows AS share_zero,
       n_moving / n_rows AS share_moving
FROM (SELECT {by} count(*) AS n_rows, count(*) FILTER (speed IS NULL) AS n_missing,
             count(*) FILTER (speed > 120) AS n_implausible, count(*) FILTER (speed < 0) AS n_negative,
             count(*) FILTER (speed = 0) AS n_zero, count(*) FILTER (speed > 0 AND speed <= 120) AS n_moving,
             count(*) FILTER (concat(street, from_street, to_street) IS NULL) AS n_unjoinable
      FROM good {'GROUP BY ALL' if by else ''})"""


def _alpha(support: str, low: str, high: str, reference: str, gamma: str) -> str:
    raised = f"{high} * power(greatest({support}, 0) / {reference}, {gamma})"
    return f"greatest(least({raised}, {high}), {low})"


_JAM_ALPHA = f"CASE WHEN value IS NULL THEN 0 ELSE {_alpha('support', '0.1', '0.85', '8', '0.7')} END"
_LOW, _HIGH = "min(samples) OVER ()", "max(samples) OVER ()"


_EXPORT = """street, from_street, to_street, lat, lon, speed, congestion, vs_typical, samples,
       n_lanes"""


def _headline(w: str) -> str:
    """Of the whole input, or with `w` of each week."""
    slice_, profile, group = (f"{w}evening", f"{w}profile", "GROUP BY period") if w else ("evening", "week_profile", "")
    per, same = ("period,", "WHERE p.period = e.period") if w else ("", "")
    return f"""
SELECT {per} sum(speed_sum) / sum(samples) AS mean_speed, count(*) AS n_reporting,
       min(speed) AS slowest_speed, arg_min(street, {{'s': speed, 'i': site_id}}) AS slowest_street,
       sum(n_zero) / greatest(sum(n_zero) + sum(n_moving), 1) AS zero_share,
       (SELECT sum(speed_sum) / sum(samples) FROM {profile} p {same}) AS all_day_mean,
       (SELECT count(*) FROM {w}flagged p {same}) AS n_sites,
       sum(speed_sum) / sum(samples)
           - (SELECT sum(speed_sum) / sum(samples) FROM {profile} p {same}) AS delta
FROM {slice_} e WHERE congestion IS NOT NULL {group}"""


def _pivot(profile: str, per: str = "") -> str:
    return f"""
SELECT {per} time, max(CASE WHEN street = 'Street 1' THEN r END) AS "Street 1",
       max(CASE WHEN street = 'Street 2' THEN r END) AS "Street 2",
       max(CASE WHEN street = 'Street 4' THEN r END) AS "Street 4"
FROM (SELECT {per} time, street, round_even(speed * 10, 0) / 10 AS r FROM {profile})
GROUP BY {per} time"""


def _claimed() -> str:
    return """
SELECT chunk.* REPLACE (new_id AS corridor_id)
FROM chunk JOIN (
  SELECT corridor_id, row_number() OVER (ORDER BY corridor_id) - 1 AS new_id
  FROM (SELECT DISTINCT corridor_id FROM matched_usable WHERE corridor_id IS NOT NULL))
USING (corridor_id)"""


def _counters(table: str, per: str = "") -> str:
    return f"""
SELECT {per} count(*) AS n_sites, count(*) FILTER (NOT is_live) AS n_flatlined,
       count(*) FILTER (is_usable AND NOT has_reference) AS n_without_reference,
       count(*) FILTER (is_usable AND NOT has_location) AS n_without_location,
       count(*) FILTER (is_stalled) AS n_stalled, CAST(sum(n_dead_lanes) AS BIGINT) AS n_dead_lanes,
       count(*) FILTER (is_usable AND n_dead_lanes > 0) AS n_sites_with_dead_lanes
FROM {table} {f"GROUP BY {per.rstrip(',')}" if per else ""}"""


_BODIES: dict[str, str] = {
    "reading_classes": """
SELECT CASE WHEN speed IS NULL THEN 'missing' WHEN speed > 120 THEN 'implausible'
            WHEN speed > 0 THEN 'moving' WHEN speed = 0 THEN 'zero' ELSE 'negative' END
           AS reading_class, count(*) AS n
FROM good GROUP BY 1""",
    "load_report": _report(),
    "load_report_per_stored_week": _report(f"{_WEEK_OF} AS period,"),
    "csv_load_report": _report(),
    "sites": "SELECT * FROM site",
    "coord_streets": "SELECT * FROM claims",
    "lane_health": "SELECT * FROM lane_state",
    "dead_lane_report": """
SELECT (SELECT count(*) FILTER (is_dead) FROM lane_state) AS n_dead_lanes,
       (SELECT count(*) FROM lane_state) AS n_lanes,
       count(*) FILTER (speed = 0) AS dead_zero_readings,
       count(*) FILTER (speed > 0 AND speed <= 120) AS dead_moving_readings
FROM placed SEMI JOIN (SELECT * FROM lane_state WHERE is_dead) USING (site_id, detector_id, lane)""",
    "measurements": "SELECT * FROM fact",
    "csv_mixed_headers": "SELECT * FROM fact",
    "measurements_from_csv": "SELECT * FROM fact",
    "detectors_from_csv": "SELECT * FROM detector",
    "measurements_by_month": "SELECT * FROM fact",
    "day_night": "SELECT * FROM day_night_all",
    "free_flow": "SELECT * FROM freeflow",
    "detectors": "SELECT * FROM detector",
    "detectors_by_week": "SELECT * FROM detector",
    "sites_over_loads": "SELECT * FROM site",
    "detectors_from_weeks": "SELECT * FROM detector",
    "detectors_from_two_weeks": "SELECT * FROM detector",
    "detectors_per_stored_week": "SELECT * FROM detector",
    "measurements_from_weeks": "SELECT * FROM fact",
    "site_flags": """
SELECT site_id, is_live, has_reference, is_stalled, is_usable, has_location FROM flagged""",
    "quality_counters": _counters("flagged"),
    "quality_counters_by_week": _counters("w_flagged", "period,"),
    "slice_by_week": "SELECT * FROM w_slice",
    "slice_headline_by_week": _headline("w_"),
    "street_pivot_by_week": _pivot("w_named_profile", "period,"),
    "profile_extremes_by_week": """
SELECT period, min(speed) AS low_speed, arg_min(time, {'s': speed, 'b': bucket}) AS low_time,
       max(speed) AS high_speed, arg_max(time, {'s': speed, 'b': -bucket}) AS high_time
FROM w_profile WHERE speed IS NOT NULL GROUP BY period""",
    "slowest_3_by_week": """
SELECT period, tramo, speed, congestion * 100 AS congestion_pct, samples FROM w_slice
QUALIFY row_number() OVER (PARTITION BY period ORDER BY speed, site_id) <= 3""",
    "surface_by_week": """
SELECT period, count(*) AS n_supported, sum(value) AS value_sum, sum(support) AS support_sum
FROM w_grid WHERE support > 0 GROUP BY 1""",
    "field_nearest_by_week": f"""
SELECT period, {_FIELD}, CASE WHEN w > 0 THEN v END AS value, coalesce(w, 0) AS support
FROM w_reached
QUALIFY row_number() OVER (PARTITION BY period, way_id, segment, piece ORDER BY d, site_id) = 1""",
    "placeholder_count": "SELECT count(*) FILTER (streets_at_coord > 2) AS n_placeholder FROM detector",
    "site_key_check": """
SELECT count(*) AS n_rows, count(DISTINCT site_id) AS n_keys,
       count(*) - count(DISTINCT site_id) AS n_repeated FROM detector""",
    "slice_weekday_1730": "SELECT * FROM evening",
    "slice_weekend": _slice("dow IN (0, 6)", sites=_MAPPED),
    "slice_all_day_zeros": _slice("true", zeros=True, floor=20, sites="true"),
    "slice_every_bucket": """
SELECT scope, bucket, site_id, samples, speed, congestion FROM every_slice""",
    "congestion_view": """
SELECT site_id, congestion FROM week_slice WHERE congestion IS NOT NULL""",
    "metric_gaps": """
SELECT count(*) AS n_sites, count(*) FILTER (congestion IS NULL) AS n_without_metric FROM week_slice""",
    "metric_domain": """
SELECT CAST(min(samples) AS DOUBLE) AS low, CAST(max(samples) AS DOUBLE) AS high
FROM week_slice""",
    "metric_positions": f"""
SELECT site_id, {_clip('congestion / 0.9::DOUBLE')} AS congestion_at,
       {_clip('1 - (speed - 5) / 45')} AS speed_at,
       {_clip('(vs_typical / 12 + 1) / 2')} AS vs_typical_at,
       (samples - {_LOW}) / ({_HIGH} - {_LOW}) AS volume_at
FROM week_slice""",
    "city_profile": "SELECT * FROM week_profile",
    "city_profile_zeros": _profile("true", n="sum(n_moving + n_zero)"),
    "street_profile": "SELECT * FROM named_profile",
    "street_pivot": _pivot("named_profile"),
    "slice_headline": _headline(""),
    "profile_extremes": """
SELECT min(speed) AS low_speed, arg_min(time, {'s': speed, 'b': bucket}) AS low_time,
       max(speed) AS high_speed, arg_max(time, {'s': speed, 'b': -bucket}) AS high_time
FROM week_profile WHERE speed IS NOT NULL""",
    "slowest_1": """
SELECT tramo, speed, congestion * 100 AS congestion_pct, samples
FROM week_slice ORDER BY speed, site_id LIMIT 1""",
    "slowest_12": """
SELECT tramo, speed, congestion * 100 AS congestion_pct, samples
FROM week_slice ORDER BY speed, site_id LIMIT 12""",
    "slice_export": f"SELECT {_EXPORT} FROM week_slice",
    "slice_export_file": f"SELECT {_EXPORT} FROM week_slice",
    "dates": "SELECT DISTINCT date FROM fact",
    "street_names": "SELECT DISTINCT street FROM flagged",
    "surface_cells": "SELECT * FROM jam_grid WHERE support > 0",
    "surface_grid": "SELECT * FROM jam_grid",
    "surface_bounds": f"""
SELECT (x0 - 0.1::DOUBLE) / {_KX} AS west, (y0 - 0.1::DOUBLE) / {_KY} AS south,
       (x0 + (nx - 1) * dx + 0.1::DOUBLE) / {_KX} AS east,
       (y0 + (ny - 1) * dy + 0.1::DOUBLE) / {_KY} AS north, nx, ny
FROM jam_axes""",
    "surface_supported": "SELECT count(*) FILTER (support > 0) AS n_supported FROM speed_grid",
    "surface_every_bucket": """
SELECT scope, bucket, count(*) AS n_supported, sum(value) AS value_sum,
       sum(support) AS support_sum
FROM frame_grid WHERE support > 0 GROUP BY 1, 2""",
    "surface_opacity": f"""
SELECT i, j, {_clip('value / 0.9::DOUBLE')} AS position, {_JAM_ALPHA} AS alpha,
       least({_JAM_ALPHA} * 1.15, 1) AS alpha_alone
FROM jam_grid""",
    "ways_from_json": """
SELECT row_number() OVER (ORDER BY way_id) - 1 AS way_id, name,
       CAST(len(coords) AS INTEGER) AS n_points, coords[1].lon AS lon0, coords[1].lat AS lat0
FROM way""",
    "corridors": "SELECT * FROM way_corridor",
    "road_chunks": "SELECT * FROM chunk",
    "near_roads": """
SELECT approach.* FROM approach
SEMI JOIN (FROM flagged WHERE has_location) USING (lat, lon)""",
    "name_scores": "SELECT * FROM scored",
    "site_corridor": "SELECT * FROM matched",
    "unmatched_names": """
SELECT street, count(*) AS n FROM matched_usable JOIN flagged USING (site_id)
WHERE corridor_id IS NULL GROUP BY 1""",
    "unmatched_in_slice": """
SELECT count(*) AS n_sites, count(*) FILTER (corridor_id IS NULL) AS n_unmatched
FROM week_slice LEFT JOIN matched USING (site_id)""",
    "matching_summary": """
SELECT (SELECT count(*) FROM way) AS n_ways, (SELECT count(*) FROM chunk) AS n_chunks,
       (SELECT count(*) FROM corridor) AS n_corridors, count(corridor_id) AS n_matched,
       count(*) AS n_mappable, count(DISTINCT corridor_id) AS n_claimed
FROM matched_usable""",
    "claimed_chunks": _claimed(),
    # Documents are numbered anew, in their order.
    "network_from_json": f"""
SELECT c.* REPLACE (no AS way_id) FROM ({_claimed()}) c
JOIN (SELECT way_id, row_number() OVER (ORDER BY way_id) - 1 AS no FROM way) USING (way_id)""",
    "field_blend": "SELECT * FROM blend",
    "field_nearest": _closest("reached_far"),
    "field_stub": _closest("reached_near"),
    "field_opacity": f"""
SELECT way_id, segment, piece, {_clip('1 - (value - 5) / 45')} AS position,
       {_alpha('support', '0.15', '0.95', '1.2::DOUBLE', '0.6')} AS alpha
FROM blend WHERE support > 0""",
}

_REPORT_DOUBLES = "share_missing share_implausible share_negative share_zero share_moving"
_SITE_DOUBLES = "lat lon mean_speed free_flow_speed day_speed night_speed"
_SLICE_DOUBLES = f"speed_sum speed {_SITE_DOUBLES} congestion vs_typical"
_CHUNK_DOUBLES = "lon0 lat0 lon1 lat1 mid_lon mid_lat"

# Double columns per query, rounded before comparison as on the Spark side.
_DOUBLES: dict[str, str] = {
    "load_report": _REPORT_DOUBLES,
    "csv_load_report": _REPORT_DOUBLES,
    "sites": "lat lon",
    "coord_streets": "lat lon",
    "lane_health": "mean_speed",
    "measurements": "speed_sum",
    "csv_mixed_headers": "speed_sum",
    "measurements_from_csv": "speed_sum",
    "detectors_from_csv": _SITE_DOUBLES,
    "measurements_by_month": "speed_sum",
    "day_night": "day_speed night_speed",
    "free_flow": "free_flow_speed",
    "detectors": _SITE_DOUBLES,
    "detectors_by_week": _SITE_DOUBLES,
    "load_report_per_stored_week": _REPORT_DOUBLES,
    "sites_over_loads": "lat lon",
    "detectors_from_weeks": _SITE_DOUBLES,
    "detectors_from_two_weeks": _SITE_DOUBLES,
    "detectors_per_stored_week": _SITE_DOUBLES,
    "measurements_from_weeks": "speed_sum",
    "slice_weekday_1730": _SLICE_DOUBLES,
    "slice_weekend": _SLICE_DOUBLES,
    "slice_all_day_zeros": _SLICE_DOUBLES,
    "slice_every_bucket": "speed congestion",
    "congestion_view": "congestion",
    "metric_domain": "low high",
    "metric_positions": "congestion_at speed_at vs_typical_at volume_at",
    "city_profile": "speed_sum speed hour",
    "city_profile_zeros": "speed_sum speed hour",
    "street_profile": "speed_sum speed hour",
    "slice_by_week": _SLICE_DOUBLES,
    "slice_headline_by_week": "mean_speed slowest_speed zero_share all_day_mean delta",
    "profile_extremes_by_week": "low_speed high_speed",
    "slowest_3_by_week": "speed congestion_pct",
    "surface_by_week": "value_sum support_sum",
    "field_nearest_by_week": "value support",
    "slice_headline": "mean_speed slowest_speed zero_share all_day_mean delta",
    "profile_extremes": "low_speed high_speed",
    "slowest_1": "speed congestion_pct",
    "slowest_12": "speed congestion_pct",
    "slice_export": "lat lon speed congestion vs_typical",
    "slice_export_file": "lat lon speed congestion vs_typical",
    "network_from_json": _CHUNK_DOUBLES,
    "surface_cells": "value support",
    "surface_grid": "value support",
    "surface_bounds": "west south east north",
    "surface_every_bucket": "value_sum support_sum",
    "surface_opacity": "position alpha alpha_alone",
    "ways_from_json": "lon0 lat0",
    "road_chunks": _CHUNK_DOUBLES,
    "near_roads": "lat lon distance",
    "name_scores": "score",
    "claimed_chunks": _CHUNK_DOUBLES,
    "field_blend": "value support",
    "field_nearest": "value support",
    "field_stub": "value support",
    "field_opacity": "position alpha",
}


def _needed(body: str, tables: dict[str, str]) -> list[str]:
    """Shared tables a body refers to, directly or not, in dependency order."""
    found: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in tables and word not in found and word not in path:
                path.append(word)
                visit(tables[word])
                path.remove(word)
                if word not in found:
                    found.append(word)

    path: list[str] = []
    visit(body)
    return found


def _with(name: str, body: str) -> str:
    tables = dict(_TABLES)
    if name.endswith("_by_week"):
        tables.update(_WEEKLY)
    elif name.endswith("_by_month"):
        tables.update(_MONTHLY)
    tables.update(_VARIANTS.get(name, {}))
    parts = []
    for table in _needed(body, tables):
        recursive = re.search(rf"\b{table}\b", tables[table])
        parts.append(f"{table} AS {'' if recursive else 'MATERIALIZED '}({tables[table]}\n)")
    rounded = ", ".join(f"round({c}, 6) + 0 AS {c}" for c in _DOUBLES.get(name, "").split())
    columns = f"* REPLACE ({rounded})" if rounded else "*"
    return f"WITH RECURSIVE {', '.join(parts)}\nSELECT {columns} FROM ({body}\n)"


def oracle_sql() -> dict[str, str]:
    return {name: _with(name, body) for name, body in _BODIES.items()}
