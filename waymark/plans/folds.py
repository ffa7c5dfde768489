"""SQL twins of the ordered folds: recursive queries that go through each session a row at a time, all sessions side by side."""

from __future__ import annotations

from waymark.plans.base import BY_USER, POINTS, sql_haversine


def sql_sessions(gap: float) -> str:
    """points numbered within sessions: gaps in time longer than `gap` seconds part them."""
    return f"""{POINTS}, gaps AS (SELECT *, coalesce(t - lag(t) OVER ({BY_USER}) > {gap}, false) AS apart FROM (SELECT *, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM points)),
sessions AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS session FROM gaps),
steps AS (SELECT "user", session, event_id, lat, lon, t, row_number() OVER (PARTITION BY "user", session ORDER BY t, event_id) AS i FROM sessions)"""


def _point(lat: str, lon: str, t: str, w: str = "0", dx: str = "0", dt: str = "0", speed: str = "0", acc: str = "0", m: str = "[]") -> str:
    values = {"lat": lat, "lon": lon, "t": t, "w": w, "dx": dx, "dt": dt, "speed": speed, "acc": acc}
    return "{" + ", ".join(f"'{k}': CAST({v} AS DOUBLE)" for k, v in values.items()) + f", 'm': CAST({m} AS STRUCT(lat DOUBLE, lon DOUBLE, t DOUBLE)[])}}"


def sql_compress(merging: float, separation: float, separation_time: float, acceleration: float, radius: float) -> str:
    """The point machine: (user, session, traj, ord, p) with p a struct of lat, lon, t, w, dx, dt, speed, acc and members m."""
    fresh = _point("lat", "lon", "t")
    parts = lambda x: f"CASE WHEN len({x}.m) > 0 THEN {x}.m ELSE [{{'lat': {x}.lat, 'lon': {x}.lon, 't': {x}.t}}] END"
    middle = lambda m, c: f"list_aggregate(list_transform({m}, lambda x: x.{c}), 'median')"
    kind = "STRUCT(lat DOUBLE, lon DOUBLE, t DOUBLE, w DOUBLE, dx DOUBLE, dt DOUBLE, speed DOUBLE, acc DOUBLE, m STRUCT(lat DOUBLE, lon DOUBLE, t DOUBLE)[])"
    return f"""{sql_sessions(separation_time)},
r AS (
  SELECT "user", session, i, {fresh} AS head, CAST([] AS STRUCT(lat DOUBLE, lon DOUBLE, t DOUBLE)[]) AS merged, CAST([] AS {kind}[]) AS track, 0 AS traj, CAST(NULL AS {kind}[]) AS done FROM steps WHERE i = 1
  UNION ALL
  SELECT "user", session, i,
    CASE act WHEN 'split' THEN {fresh}
      WHEN 'merge' THEN {_point('nlat', 'nlon', 't', 't - grown[1].t', 'ndx', 'ndt', 'CASE WHEN ndt > 0 THEN ndx / ndt ELSE 0 END', 'CASE WHEN ndt > 0 THEN (ndx / ndt - below.speed) / ndt ELSE 0 END', 'grown')}
      ELSE {_point('lat', 'lon', 't', '0', 'dx', 'dt', 'speed', 'acc')} END,
    CASE WHEN act = 'merge' THEN grown ELSE [] END,
    CASE act WHEN 'split' THEN [] WHEN 'merge' THEN base ELSE CASE WHEN abs(acc) <= {acceleration} THEN list_append(settled, {_point('lat', 'lon', 't', '0', 'dx', 'dt', 'speed', 'acc')}) ELSE settled END END,
    CASE WHEN act = 'split' THEN traj + 1 ELSE traj END,
    CASE WHEN act = 'split' THEN settled END
  FROM (SELECT *, {middle('grown', 'lat')} AS nlat, {middle('grown', 'lon')} AS nlon,
      coalesce({sql_haversine('below.lat', 'below.lon', middle('grown', 'lat'), middle('grown', 'lon'))}, 0) AS ndx, coalesce(abs(t - below.t), 0) AS ndt
    FROM (SELECT *, base[len(base)] AS below, list_append(seed, {{'lat': lat, 'lon': lon, 't': t}}) AS grown,
        CASE WHEN dt > {separation_time} OR dx > {separation} THEN 'split' WHEN dx <= {merging} AND {sql_haversine(middle('tried', 'lat'), middle('tried', 'lon'), 'lat', 'lon')} < {radius} THEN 'merge' ELSE 'extend' END AS act
      FROM (SELECT *, CASE WHEN dt > 0 THEN (speed - head.speed) / dt ELSE 0 END AS acc, list_append({parts('head')}, {{'lat': lat, 'lon': lon, 't': t}}) AS tried,
          CASE WHEN len(merged) > 0 OR len(track) = 0 THEN list_append(track, head) ELSE track END AS settled,
          CASE WHEN len(merged) > 0 THEN track ELSE track[1:len(track) - 1] END AS base,
          CASE WHEN len(merged) > 0 THEN merged WHEN len(track) > 0 THEN {parts('track[len(track)]')} ELSE {parts('head')} END AS seed
        FROM (SELECT *, CASE WHEN dt > 0 THEN dx / dt ELSE 0 END AS speed
          FROM (SELECT r."user", r.session, s.i, s.lat, s.lon, s.t, r.head, r.merged, r.track, r.traj, {sql_haversine('r.head.lat', 'r.head.lon', 's.lat', 's.lon')} AS dx, abs(s.t - r.head.t) AS dt
            FROM r JOIN steps s ON s."user" = r."user" AND s.session = r.session AND s.i = r.i + 1)))))),
finished AS (
  SELECT "user", session, traj - 1 AS traj, done FROM r WHERE done IS NOT NULL
  UNION ALL
  SELECT "user", session, traj, CASE WHEN len(merged) > 0 OR len(track) = 0 THEN list_append(track, head) ELSE track END FROM r WHERE (r."user", r.session, r.i) IN (SELECT ("user", session, max(i)) FROM steps GROUP BY "user", session)),
compressed AS (SELECT "user", session, traj, unnest(range(len(done))) AS ord, unnest(done) AS p FROM finished)"""


def sql_filtered(min_time: float, acceleration: float = 2.5, merge: float = 10.0) -> str:
    """The older filter: (user, track, ord, ts, lat, lon, n), runs of near points as their means."""
    here = "[{'lat': lat, 'lon': lon, 't': t}]"
    mean = lambda c: f"list_avg(list_transform(held, lambda h: h.{c}))"
    degree = "(1000 * 10000.8::DOUBLE / 90)"
    return f"""{POINTS}, flat AS (SELECT *, coalesce(sqrt(pow((lat - plat) * {degree} * cos(radians((plat + lat) / 2)), 2) + pow((lon - plon) * {degree}, 2)), 0) AS dx, coalesce(t - pt, 0) AS dt
  FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(t) OVER w AS pt FROM (SELECT *, epoch_us(ts) / 1000000.0::DOUBLE AS t FROM points) WINDOW w AS ({BY_USER}))),
fast AS (SELECT *, CASE WHEN dt <> 0 THEN dx / dt ELSE 0 END AS velocity FROM flat),
kept AS (SELECT * FROM (SELECT *, CASE WHEN dt <> 0 THEN (velocity - coalesce(lag(velocity) OVER ({BY_USER}), 0)) / dt ELSE 0 END AS change FROM fast) WHERE abs(change) <= {acceleration}),
parted AS (SELECT *, CAST(sum(CASE WHEN dt > {min_time} THEN 1 ELSE 0 END) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS track FROM kept),
numbered AS (SELECT "user", track, lat, lon, t, row_number() OVER (PARTITION BY "user", track ORDER BY t, event_id) AS i FROM parted),
f AS (
  SELECT "user", track, i, CAST({here} AS STRUCT(lat DOUBLE, lon DOUBLE, t DOUBLE)[]) AS held, CAST(0 AS BIGINT) AS ord, CAST(NULL AS STRUCT(lat DOUBLE, lon DOUBLE, t DOUBLE)[]) AS done FROM numbered WHERE i = 1
  UNION ALL
  SELECT "user", track, i, CASE WHEN near THEN list_concat(held, {here}) ELSE {here} END, CASE WHEN near THEN ord ELSE ord + 1 END, CASE WHEN near THEN NULL ELSE held END
  FROM (SELECT *, abs(lat - {mean('lat')}) * 111120 + abs(lon - {mean('lon')}) * 111120 * cos(radians({mean('lat')})) <= {merge} AS near
    FROM (SELECT s."user", s.track, s.i, s.lat, s.lon, s.t, f.held, f.ord FROM f JOIN numbered s ON s."user" = f."user" AND s.track = f.track AND s.i = f.i + 1))),
runs AS (SELECT "user", track, ord - 1 AS ord, done AS held FROM f WHERE done IS NOT NULL
  UNION ALL SELECT "user", track, ord, held FROM f WHERE (f."user", f.track, f.i) IN (SELECT ("user", track, max(i)) FROM numbered GROUP BY "user", track)),
filtered AS (SELECT "user", track, ord, held[len(held)].t AS ts, {mean('lat')} AS lat, {mean('lon')} AS lon, len(held) AS n FROM runs)"""


def sql_kalman(source: str, noise: float, drift: float) -> str:
    """smoothed: each coordinate by a filter of place and speed; both have one covariance (a, b; b, d), so scalars do."""
    q, r = f"{drift!r}::DOUBLE", f"{noise!r}::DOUBLE"
    return f"""k AS (
  SELECT "user", track, ord, ts, lat, lon, CAST(0 AS DOUBLE) AS v_lat, CAST(0 AS DOUBLE) AS v_lon, {r} AS a, CAST(0 AS DOUBLE) AS b, {r} AS d FROM {source} WHERE ord = 0
  UNION ALL
  SELECT "user", track, ord, ts, x_lat + a1 / (a1 + {r}) * (lat - x_lat), x_lon + a1 / (a1 + {r}) * (lon - x_lon), v_lat + b1 / (a1 + {r}) * (lat - x_lat), v_lon + b1 / (a1 + {r}) * (lon - x_lon),
    (1 - a1 / (a1 + {r})) * a1, (1 - a1 / (a1 + {r})) * b1, d1 - b1 / (a1 + {r}) * b1
  FROM (SELECT s.*, k.lat + k.v_lat * (s.ts - k.ts) AS x_lat, k.lon + k.v_lon * (s.ts - k.ts) AS x_lon, k.v_lat, k.v_lon, k.a + 2 * k.b * (s.ts - k.ts) + k.d * pow(s.ts - k.ts, 2) + {q} AS a1, k.b + k.d * (s.ts - k.ts) AS b1, k.d + {q} AS d1
    FROM k JOIN {source} s ON s."user" = k."user" AND s.track = k.track AND s.ord = k.ord + 1)),
smoothed AS (SELECT "user", track, ord, ts, lat, lon FROM k)"""


def sql_late_kalman(source: str, noise: float, place: float, speed: float, spread: float, unit: float, scale: float) -> str:
    """late_smoothed: the same filter begun at zero, each step predicted with the time of the step before."""
    n, f = f"{noise!r}::DOUBLE", f"({unit!r}::DOUBLE * wait)"
    update = f"""x_lat + a1 / (a1 + {n}) * (z_lat - x_lat) AS lat, x_lon + a1 / (a1 + {n}) * (z_lon - x_lon) AS lon, v_lat + b1 / (a1 + {n}) * (z_lat - x_lat) AS v_lat, v_lon + b1 / (a1 + {n}) * (z_lon - x_lon) AS v_lon,
    (1 - a1 / (a1 + {n})) * a1 AS a, (1 - a1 / (a1 + {n})) * b1 AS b, d1 - b1 / (a1 + {n}) * b1 AS d, step AS wait"""
    predict = f"lat + {f} * v_lat AS x_lat, lon + {f} * v_lon AS x_lon, v_lat, v_lon, a + 2 * {f} * b + {f} * {f} * d + {place!r}::DOUBLE AS a1, b + {f} * d AS b1, d + {speed!r}::DOUBLE AS d1"
    zero = f"0::DOUBLE AS lat, 0::DOUBLE AS lon, 0::DOUBLE AS v_lat, 0::DOUBLE AS v_lon, {spread!r}::DOUBLE AS a, 0::DOUBLE AS b, {spread!r}::DOUBLE AS d, 1::DOUBLE AS wait"
    return f"""k2 AS (
  SELECT "user", track, ord, ts, {update} FROM (SELECT *, {predict} FROM (SELECT f."user", f.track, f.ord, f.ts, f.lat * {scale} AS z_lat, f.lon * {scale} AS z_lon, 0::DOUBLE AS step, z.* FROM {source} f, (SELECT {zero}) z WHERE f.ord = 0) AS q("user", track, ord, ts, z_lat, z_lon, step, lat, lon, v_lat, v_lon, a, b, d, wait)) AS p("user", track, ord, ts, z_lat, z_lon, step, l1, l2, l3, l4, l5, l6, l7, l8, x_lat, x_lon, v_lat, v_lon, a1, b1, d1)
  UNION ALL
  SELECT "user", track, ord, ts, {update} FROM (SELECT "user", track, ord, ts, z_lat, z_lon, step, {predict} FROM (SELECT s."user", s.track, s.ord, s.ts, s.lat * {scale} AS z_lat, s.lon * {scale} AS z_lon, s.ts - k2.ts AS step, k2.lat, k2.lon, v_lat, v_lon, a, b, d, wait FROM k2 JOIN {source} s ON s."user" = k2."user" AND s.track = k2.track AND s.ord = k2.ord + 1))),
late_smoothed AS (SELECT "user", track, ord, ts, lat / {scale} AS lat, lon / {scale} AS lon FROM k2)"""
