"""Registry of queries and the SQL pieces that their twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL twin if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: The points view: the same expressions as operators.points.points.
POINTS = """points AS (
  SELECT event_id, user_id AS "user", ts, 55.36::DOUBLE + (k // 10) * 0.0002::DOUBLE AS lat, 10.38::DOUBLE + (k % 10) * 0.0003::DOUBLE AS lon, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
BY_USER = 'PARTITION BY "user" ORDER BY ts, event_id'


def sql_haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - {a})))"


def sql_seconds(a: str, b: str) -> str:
    return f"(abs(epoch_us({b}) - epoch_us({a})) / 1000000.0::DOUBLE)"


#: points with dx, dt against the row before.
STEPS = f"""{POINTS}, steps AS (
  SELECT *, coalesce({sql_haversine('plat', 'plon', 'lat', 'lon')}, 0) AS dx, coalesce({sql_seconds('pts', 'ts')}, 0) AS dt
  FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ts) OVER w AS pts FROM points WINDOW w AS ({BY_USER})))"""


#: WGS84 and UTM, as the Column forms have them.
_A, _F = 6378137.0, 1 / 298.257223563
_E2 = _F * (2 - _F)
_EP2 = _E2 / (1 - _E2)
_E1 = (1 - (1 - _E2) ** 0.5) / (1 + (1 - _E2) ** 0.5)


def sql_utm(source: str, lat: str = "lat", lon: str = "lon", zone: str | None = None) -> str:
    """A subquery: the rows of source with east and north."""
    zone = zone or f"floor(({lon} + 180) / 6) + 1"
    return f"""(SELECT * EXCLUDE (u_p, u_t, u_c, u_a, u_n, u_m),
  0.9996::DOUBLE * u_n * u_a * (1 + u_a * u_a / 6 * (1 - u_t + u_c) + pow(u_a, 4) / 120 * (5 - 18 * u_t + u_t * u_t + 72 * u_c - 58 * {_EP2!r}::DOUBLE)) + 500000 AS east,
  0.9996::DOUBLE * (u_m + u_n * tan(u_p) * u_a * u_a / 2 * (1 + u_a * u_a / 12 * (5 - u_t + 9 * u_c + 4 * u_c * u_c) + pow(u_a, 4) / 360 * (61 - 58 * u_t + u_t * u_t + 600 * u_c - 330 * {_EP2!r}::DOUBLE))) AS north
FROM (SELECT *, radians({lat}) AS u_p, pow(tan(radians({lat})), 2) AS u_t, {_EP2!r}::DOUBLE * pow(cos(radians({lat})), 2) AS u_c, radians({lon} - (({zone}) * 6 - 183)) * cos(radians({lat})) AS u_a,
    {_A!r}::DOUBLE / sqrt(1 - {_E2!r}::DOUBLE * pow(sin(radians({lat})), 2)) AS u_n,
    {_A!r}::DOUBLE * ({1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256!r}::DOUBLE * radians({lat}) - {3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024!r}::DOUBLE * sin(2 * radians({lat})) + {15 * _E2**2 / 256 + 45 * _E2**3 / 1024!r}::DOUBLE * sin(4 * radians({lat})) - {35 * _E2**3 / 3072!r}::DOUBLE * sin(6 * radians({lat}))) AS u_m
  FROM {source}))"""


def sql_from_utm(source: str, east: str, north: str, zone: str) -> str:
    """A subquery: the rows of source with back_lat and back_lon of northern UTM coordinates."""
    return f"""(SELECT * EXCLUDE (v_p, v_n, v_r, v_t, v_c, v_d),
  degrees(v_p - v_n * tan(v_p) / v_r * v_d * v_d * (0.5 - v_d * v_d / 24 * (5 + 3 * v_t + 10 * v_c - 4 * v_c * v_c - 9 * {_EP2!r}::DOUBLE) + pow(v_d, 4) / 720 * (61 + 90 * v_t + 298 * v_c + 45 * v_t * v_t - 252 * {_EP2!r}::DOUBLE - 3 * v_c * v_c))) AS back_lat,
  degrees(v_d * (1 - v_d * v_d / 6 * (1 + 2 * v_t + v_c) + pow(v_d, 4) / 120 * (5 - 2 * v_c + 28 * v_t - 3 * v_c * v_c + 8 * {_EP2!r}::DOUBLE + 24 * v_t * v_t)) / cos(v_p)) + (({zone}) * 6 - 183) AS back_lon
FROM (SELECT *, {_A!r}::DOUBLE / sqrt(1 - {_E2!r}::DOUBLE * pow(sin(v_p), 2)) AS v_n, {_A!r}::DOUBLE * (1 - {_E2!r}::DOUBLE) / pow(1 - {_E2!r}::DOUBLE * pow(sin(v_p), 2), 1.5) AS v_r, pow(tan(v_p), 2) AS v_t, {_EP2!r}::DOUBLE * pow(cos(v_p), 2) AS v_c,
    ({east} - 500000) / ({_A!r}::DOUBLE / sqrt(1 - {_E2!r}::DOUBLE * pow(sin(v_p), 2)) * 0.9996::DOUBLE) AS v_d
  FROM (SELECT * EXCLUDE (v_mu), v_mu + {3 * _E1 / 2 - 27 * _E1**3 / 32!r}::DOUBLE * sin(2 * v_mu) + {21 * _E1**2 / 16 - 55 * _E1**4 / 32!r}::DOUBLE * sin(4 * v_mu) + {151 * _E1**3 / 96!r}::DOUBLE * sin(6 * v_mu) + {1097 * _E1**4 / 512!r}::DOUBLE * sin(8 * v_mu) AS v_p
    FROM (SELECT *, {north} / 0.9996::DOUBLE / ({_A!r}::DOUBLE * {1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256!r}::DOUBLE) AS v_mu FROM {source}))))"""


def sql_spacing(level: int) -> str:
    """A CTE `spacing(spacing)`: metres from the centre of the meridian's cell to the one north of it."""
    side = 1 << level
    x, y = int((180 - 0.001545) / 360 * side), int((51.477928 + 90) / 180 * side)
    lat = lambda row: f"({row} + 0.5::DOUBLE) / {side} * 180 - 90"
    rows = f"(SELECT k, {lat(f'({y} + k)')} AS lat, ({x} + 0.5::DOUBLE) / {side} * 360 - 180 AS lon FROM (VALUES (0), (1)) AS c(k))"
    return f"spacing AS (SELECT sqrt(pow(max(east) - min(east), 2) + pow(max(north) - min(north), 2)) AS spacing FROM {sql_utm(rows)})"
