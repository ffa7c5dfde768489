"""Metrics, segments and windows over the points of each user."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geo import METRES_A_DEGREE, destination, distance, from_utm, polar, to_utm
from waymark.functions.scalars import cyclic_time, unix_seconds
from waymark.operators.corridor import corridor_onset, flag_onset, pairwise
from waymark.operators.legacy import triples
from waymark.operators.motion import by_time, first_run, gap_segments, measure_segments, motion, motion_flat
from waymark.operators.points import points, read
from waymark.operators.percentiles import exact_percentiles
from waymark.operators.scans import Scan, hot_motion, scanned
from waymark.plans.base import BY_USER, POINTS, STEPS, query, sql_haversine, sql_seconds, sql_utm

GAP = 43_200
FAR = 150

SPEEDS = f"""{STEPS}, speeds AS (
  SELECT *, CASE WHEN dt > 0 THEN dx / dt ELSE 0 END AS speed FROM steps)"""


@query(f"""WITH {SPEEDS}
SELECT event_id, round(dx, 3) AS dx, dt, round(speed, 6) AS speed,
  round(CASE WHEN dt > 0 THEN (speed - coalesce(lag(speed) OVER w, 0)) / dt ELSE 0 END * 1000, 6) AS acceleration_mm
FROM speeds WINDOW w AS ({BY_USER})""")
def motion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = motion(points(spark, sf_dir))
    return m.select("event_id", F.round("dx", 3).alias("dx"), "dt", F.round("speed", 6).alias("speed"), F.round(F.col("acceleration") * 1000, 6).alias("acceleration_mm"))


_FLAT = f"(lat - plat) * {METRES_A_DEGREE!r}::DOUBLE * cos(radians((plat + lat) / 2))", f"(lon - plon) * {METRES_A_DEGREE!r}::DOUBLE"
_BEARING = "degrees(atan2(sin(radians(lon - plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon - plon)))) + 360"


@query(f"""WITH {STEPS}, flat AS (
  SELECT event_id, plat, {_FLAT[0]} AS north, {_FLAT[1]} AS east, {_BEARING} AS way, dt FROM steps)
SELECT event_id, round(coalesce(sqrt(north * north + east * east), 0), 3) AS dx_euclidean, round(coalesce(abs(north) + abs(east), 0), 3) AS dx_manhattan,
  round(coalesce(CASE WHEN way >= 360 THEN way - 360 ELSE way END, 0), 4) AS bearing,
  round(CASE WHEN dt <> 0 THEN coalesce(sqrt(north * north + east * east), 0) / dt ELSE 0 END, 6) AS velocity FROM flat""")
def simple_metrics_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = motion_flat(points(spark, sf_dir))
    return m.select("event_id", F.round("dx_euclidean", 3).alias("dx_euclidean"), F.round("dx_manhattan", 3).alias("dx_manhattan"), F.round("bearing", 4).alias("bearing"), F.round("velocity", 6).alias("velocity"))


def _segment_sql(condition: str) -> str:
    return f"""WITH {STEPS}, seg AS (
  SELECT *, sum(CASE WHEN {condition} THEN 1 ELSE 0 END) OVER (PARTITION BY "user" ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM steps)
SELECT "user", CAST(segment AS BIGINT) AS segment, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts, round(sum(dx), 2) AS length FROM seg GROUP BY ALL"""


def _segments(spark: SparkSession, sf_dir: str, gap) -> DataFrame:
    seg = gap_segments(motion(points(spark, sf_dir)), gap)
    out = seg.groupBy("user", "segment").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("start_ts"), F.max("ts").cast("timestamp_ntz").alias("end_ts"), F.round(F.sum("dx"), 2).alias("length"))
    return out.withColumn("segment", F.col("segment").cast("long"))


@query(_segment_sql(f"dt > {GAP}"))
def temporal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, F.col("dt") > GAP)


@query(_segment_sql(f"dx > {FAR}"))
def spatial_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, F.col("dx") > FAR)


@query(f"""WITH {STEPS}, seg AS (
  SELECT *, sum(CASE WHEN dt > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY "user" ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM steps)
SELECT "user", CAST(segment AS BIGINT) AS segment, count(*) AS n_points, round(sum(CASE WHEN dt > {GAP} THEN 0 ELSE dx END), 2) AS length,
  date_diff('microseconds', min(ts), max(ts)) / 1000000.0::DOUBLE AS duration, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event
FROM seg GROUP BY ALL""")
def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = gap_segments(motion(points(spark, sf_dir)), F.col("dt") > GAP)
    at = F.struct("ts", "event_id")
    out = seg.groupBy("user", "segment").agg(F.count("*").alias("n_points"), F.round(F.sum(F.when(F.col("dt") > GAP, 0.0).otherwise(F.col("dx"))), 2).alias("length"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("duration"), F.min_by("event_id", at).alias("first_event"), F.max_by("event_id", at).alias("last_event"))
    return out.withColumn("segment", F.col("segment").cast("long"))


@query(f"""WITH {STEPS}
SELECT "user", round(avg(dx) FILTER (WHERE dt > 0) + 3 * stddev_pop(dx) FILTER (WHERE dt > 0), 3) AS separation, CASE WHEN count(*) > 1 THEN round(sum(dx) / count(*), 3) END AS rate
FROM steps GROUP BY ALL""")
def separation_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.operators.ibdd import estimates

    return estimates(points(spark, sf_dir)).select("user", F.round("separation", 3).alias("separation"), F.round("rate", 3).alias("rate"))


@query(f"""WITH {POINTS}, utm AS (SELECT *, 3 AS k FROM points)
SELECT count(*) AS n, CAST(count(DISTINCT lat) AS BIGINT) AS lats, round(min(lat) - 0.001, 6) AS south, round(max(lat) + 0.001, 6) AS north, round(min(lon) - 0.001, 6) AS west, round(max(lon) + 0.001, 6) AS east FROM utm""")
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda f, c, m: F.round(f(c) + m, 6)
    return points(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("lat").alias("lats"), edge(F.min, "lat", -0.001).alias("south"), edge(F.max, "lat", 0.001).alias("north"), edge(F.min, "lon", -0.001).alias("west"), edge(F.max, "lon", 0.001).alias("east"))


@query("""SELECT event_type, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS middle,
  list_transform(quantile_cont(value, [x / 100.0::DOUBLE for x in range(1, 100)]), lambda x: round(x, 6)) AS percentiles FROM events GROUP BY event_type""")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    events = read(spark, sf_dir, "events").select("event_type", "value")
    of = events.groupBy("event_type").agg(F.count("*").alias("n"), r(F.min("value")).alias("least"), r(F.max("value")).alias("most"), r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("std"))
    each = exact_percentiles(events, "value", [p / 100 for p in range(1, 100)], ["event_type"])
    # Ninety-nine rows for each type.
    listed = each.groupBy("event_type").agg(F.max(F.when(F.col("share") == 0.5, r("value"))).alias("middle"), F.array_sort(F.collect_list(F.struct("share", r("value").alias("value")))).alias("v"))
    return of.join(listed, "event_type").select(*of.columns, "middle", F.transform("v", lambda v: v["value"]).alias("percentiles"))


@query(f"""WITH {STEPS}
SELECT event_id, sum(CAST(round(dt * 1000000) AS BIGINT) + 60000000) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING)::BIGINT / 1000000.0::DOUBLE AS clock FROM steps""")
def cumulative_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = by_time().rowsBetween(W.unboundedPreceding, W.currentRow)
    return motion(points(spark, sf_dir)).select("event_id", (F.sum(F.round(F.col("dt") * 1e6).cast("long") + 60_000_000).over(run) / 1e6).alias("clock"))


@query(f"""WITH {POINTS} SELECT * FROM (SELECT "user", event_id, lag(event_id, 2) OVER w AS "start", lag(event_id, 1) OVER w AS middle, event_id AS "end" FROM points WINDOW w AS ({BY_USER})) WHERE "start" IS NOT NULL""")
def sliding_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(points(spark, sf_dir))


@query(f"""WITH {POINTS} SELECT * FROM (SELECT "user", event_id AS "first", lead(event_id) OVER ({BY_USER}) AS "second" FROM points) WHERE "second" IS NOT NULL""")
def pairwise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise(points(spark, sf_dir), "event_id", "user", ["ts", "event_id"])


@query(f"""WITH {STEPS}, f AS (SELECT "user", ts, event_id, dx > {FAR} AS far, row_number() OVER ({BY_USER}) - 1 AS i FROM steps),
r AS (SELECT *, i - row_number() OVER ({BY_USER}) AS run FROM f WHERE far)
SELECT "user", min(s) AS start FROM (SELECT "user", min(i) AS s, count(*) AS n FROM r GROUP BY "user", run) WHERE n >= 3 GROUP BY "user" """)
def first_far_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = motion(points(spark, sf_dir))
    return first_run(m, F.col("dx") > FAR, 3, ["user"], ["ts", "event_id"]).withColumn("start", F.col("start").cast("long"))


#: The points with a third of all users as one.
HOT = f"""{POINTS}, hot AS (SELECT * REPLACE (CASE WHEN "user" % 3 = 0 THEN 0 ELSE "user" END AS "user") FROM points),
steps AS (SELECT *, coalesce({sql_haversine('plat', 'plon', 'lat', 'lon')}, 0) AS dx, coalesce({sql_seconds('pts', 'ts')}, 0) AS dt FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ts) OVER w AS pts FROM hot WINDOW w AS ({BY_USER})))"""


@query(f"""WITH {HOT}
SELECT event_id, "user", round(dx, 3) AS dx, dt, CAST(sum(CASE WHEN dt > {GAP} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment, round(min(value) OVER w, 6) AS least, last(CASE WHEN dx > {FAR} THEN event_id END IGNORE NULLS) OVER w AS leap,
  sum(CAST(round(dt * 1000000) AS BIGINT)) OVER w::BIGINT / 1000000.0::DOUBLE AS clock FROM steps WINDOW w AS ({BY_USER} ROWS UNBOUNDED PRECEDING)""")
def hot_user_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, segments, running least values, last leaps and clocks where one user has a third of all points; its track is scanned in blocks."""
    one = points(spark, sf_dir).withColumn("user", F.when(F.col("user") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user")))
    m = hot_motion(one, block_rows=256)
    of = Scan(sums={"segment": F.when(F.col("dt") > GAP, 1).otherwise(0), "clock": F.round(F.col("dt") * 1e6).cast("long")}, least={"least": F.col("value")}, last={"leap": F.when(F.col("dx") > FAR, F.col("event_id"))})
    found = scanned(m, of, "user")
    return found.select("event_id", "user", F.round("dx", 3).alias("dx"), "dt", F.col("segment").cast("long").alias("segment"), F.round("least", 6).alias("least"), "leap", (F.col("clock") / 1e6).alias("clock"))


def _straying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points, but every seventh user leaves the grid for a way of their own in the middle of the month."""
    away = (F.col("user") % 7 == 0) & (F.dayofmonth("ts") >= 15)
    return points(spark, sf_dir).withColumn("lon", F.when(away, F.col("lon") + 0.01 + F.col("user") * 0.0005).otherwise(F.col("lon")))


#: A point is inside if it is within 7.5 m of a segment of another user, in plane coordinates; three outside in a row are the onset.
CORRIDOR = f"""{POINTS}, astray AS (SELECT * REPLACE (CASE WHEN "user" % 7 = 0 AND day(ts) >= 15 THEN lon + 0.01::DOUBLE + "user" * 0.0005::DOUBLE ELSE lon END AS lon) FROM points),
plane AS (SELECT "user", event_id, ts, east AS x, north AS y FROM {sql_utm('astray')}),
ways AS (SELECT DISTINCT * FROM (SELECT "user" AS u, x AS ax, y AS ay, lead(x) OVER ({BY_USER}) AS b1, lead(y) OVER ({BY_USER}) AS b2 FROM plane) WHERE b1 IS NOT NULL),
places AS (SELECT DISTINCT "user", x, y FROM plane),
inside AS (SELECT DISTINCT p."user", p.x, p.y FROM places p JOIN ways w ON u <> "user" AND x BETWEEN least(ax, b1) - 8 AND greatest(ax, b1) + 8 AND y BETWEEN least(ay, b2) - 8 AND greatest(ay, b2) + 8
  AND 7.5 >= CASE WHEN ax = b1 AND ay = b2 THEN sqrt(pow(x - ax, 2) + pow(y - ay, 2)) ELSE sqrt(pow(x - ax - (b1 - ax) * least(1, greatest(0, ((x - ax) * (b1 - ax) + (y - ay) * (b2 - ay)) / (pow(b1 - ax, 2) + pow(b2 - ay, 2)))), 2) + pow(y - ay - (b2 - ay) * least(1, greatest(0, ((x - ax) * (b1 - ax) + (y - ay) * (b2 - ay)) / (pow(b1 - ax, 2) + pow(b2 - ay, 2)))), 2)) END),
f AS (SELECT "user", ts, event_id, i.x IS NULL AS outside, row_number() OVER ({BY_USER}) - 1 AS i FROM plane LEFT JOIN inside i USING ("user", x, y)),
r AS (SELECT *, i - row_number() OVER ({BY_USER}) AS run FROM f WHERE outside),
onsets AS (SELECT "user", min(s) AS start FROM (SELECT "user", min(i) AS s, count(*) AS n FROM r GROUP BY "user", run) WHERE n >= 3 GROUP BY "user")"""


@query(f"WITH {CORRIDOR} SELECT * FROM onsets")
def corridor_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corridor_onset(_straying(spark, sf_dir)).withColumn("start", F.col("start").cast("long"))


@query(f"""WITH {CORRIDOR} SELECT event_id, i = coalesce(start, -1) AS onset, coalesce(i >= start, false) AS anomalous FROM f LEFT JOIN onsets USING ("user")""")
def onset_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_onset(_straying(spark, sf_dir), corridor_onset(_straying(spark, sf_dir))).select("event_id", "onset", "anomalous")


@query(f"""WITH {POINTS}, d AS (SELECT event_id, lat, lon, lat + value / 1000 AS lat2, lon + value / 2000 AS lon2 FROM points)
SELECT event_id, round(CASE WHEN abs(lat2 - lat) > 0.2 OR abs(lon2 - lon) > 0.2 THEN {sql_haversine('lat', 'lon', 'lat2', 'lon2')} ELSE sqrt(pow((lat2 - lat) * {METRES_A_DEGREE!r}::DOUBLE, 2) + pow((lon2 - lon) * {METRES_A_DEGREE!r}::DOUBLE * cos(radians((lat + lat2) / 2)), 2)) END, 3) AS dx,
  round({sql_haversine('lat', 'lon', 'lat2', 'lon2')}, 3) AS exact FROM d""")
def distance_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    ends = (F.col("lat"), F.col("lon"), F.col("lat") + F.col("value") / 1000, F.col("lon") + F.col("value") / 2000)
    return p.select("event_id", F.round(distance(*ends), 3).alias("dx"), F.round(distance(*ends, exact=True), 3).alias("exact"))


#: Steps by the older flat measures.
FLAT = f"""{STEPS}, flat AS (SELECT *, coalesce(sqrt(pow({_FLAT[0]}, 2) + pow({_FLAT[1]}, 2)), 0) AS euclidean, coalesce(abs({_FLAT[0]}) + abs({_FLAT[1]}), 0) AS manhattan FROM steps)"""


@query(f"""WITH {FLAT} SELECT "user", round(sum(euclidean), 2) AS dx_euclidean, round(sum(manhattan), 2) AS dx_manhattan, count(*) AS n FROM flat GROUP BY "user" """)
def track_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = motion_flat(points(spark, sf_dir))
    return m.groupBy("user").agg(F.round(F.sum("dx_euclidean"), 2).alias("dx_euclidean"), F.round(F.sum("dx_manhattan"), 2).alias("dx_manhattan"), F.count("*").alias("n"))


@query(f"""WITH {FLAT}, s AS (SELECT "user", event_id, sum(CASE WHEN euclidean > {FAR} THEN 1 ELSE 0 END) OVER w AS euclidean, sum(CASE WHEN manhattan > {FAR} THEN 1 ELSE 0 END) OVER w AS manhattan FROM flat WINDOW w AS ({BY_USER} ROWS UNBOUNDED PRECEDING))
SELECT event_id, CAST(euclidean AS BIGINT) AS euclidean, CAST(manhattan AS BIGINT) AS manhattan, CAST(0 AS BIGINT) AS other FROM s""")
def segments_by_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = motion_flat(points(spark, sf_dir))
    for name in ("euclidean", "manhattan", "other"):
        rows = measure_segments(rows, FAR, f"dx_{name}").withColumnRenamed("segment", name)
    return rows.select("event_id", *[F.col(c).cast("long").alias(c) for c in ("euclidean", "manhattan", "other")])


@query(f"""WITH {POINTS}, way AS (SELECT event_id, lat, lon, radians(value % 360) AS way, radians(lat) AS a, 250.0::DOUBLE / 6371000.0::DOUBLE AS d FROM points),
dest AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(way)) AS b FROM way)
SELECT event_id, round(degrees(b), 8) AS to_lat, round(lon + degrees(atan2(sin(way) * sin(d) * cos(a), cos(d) - sin(a) * sin(b))), 8) AS to_lon,
  round(sqrt(lat * lat + lon * lon), 6) AS r, round(atan2(lat, lon), 8) AS theta FROM dest""")
def bearing_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    lat, lon = destination(F.col("lat"), F.col("lon"), F.radians(F.col("value") % 360), 250.0)
    r, theta = polar(F.col("lat"), F.col("lon"))
    return p.select("event_id", F.round(lat, 8).alias("to_lat"), F.round(lon, 8).alias("to_lon"), F.round(r, 6).alias("r"), F.round(theta, 8).alias("theta"))


_E2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)
_EP2 = _E2 / (1 - _E2)


@query(f"""WITH {POINTS}, z AS (SELECT event_id, lat, lon, radians(lat) AS p, floor((lon + 180) / 6) + 1 AS zone FROM points),
q AS (SELECT *, tan(p) * tan(p) AS t, {_EP2!r}::DOUBLE * cos(p) * cos(p) AS c, radians(lon - (zone * 6 - 183)) * cos(p) AS a, 6378137.0::DOUBLE / sqrt(1 - {_E2!r}::DOUBLE * sin(p) * sin(p)) AS n,
  6378137.0::DOUBLE * ({1 - _E2 / 4 - 3 * _E2**2 / 64 - 5 * _E2**3 / 256!r}::DOUBLE * p - {3 * _E2 / 8 + 3 * _E2**2 / 32 + 45 * _E2**3 / 1024!r}::DOUBLE * sin(2 * p) + {15 * _E2**2 / 256 + 45 * _E2**3 / 1024!r}::DOUBLE * sin(4 * p) - {35 * _E2**3 / 3072!r}::DOUBLE * sin(6 * p)) AS m FROM z)
SELECT event_id, CAST(zone AS INTEGER) AS zone,
  round(0.9996::DOUBLE * n * a * (1 + a * a / 6 * (1 - t + c) + pow(a, 4) / 120 * (5 - 18 * t + t * t + 72 * c - 58 * {_EP2!r}::DOUBLE)) + 500000, 3) AS east,
  round(0.9996::DOUBLE * (m + n * tan(p) * a * a / 2 * (1 + a * a / 12 * (5 - t + 9 * c + 4 * c * c) + pow(a, 4) / 360 * (61 - 58 * t + t * t + 600 * c - 330 * {_EP2!r}::DOUBLE))), 3) AS north,
  round(lat, 7) AS back_lat, round(lon, 7) AS back_lon FROM q""")
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from waymark.functions.geo import utm_zone

    p = points(spark, sf_dir)
    zone = utm_zone(F.col("lon"))
    east, north = to_utm(F.col("lat"), F.col("lon"))
    p = p.select("event_id", zone.alias("zone"), east.alias("e"), north.alias("n"))
    lat, lon = from_utm(F.col("e"), F.col("n"), F.col("zone"))
    return p.select("event_id", "zone", F.round("e", 3).alias("east"), F.round("n", 3).alias("north"), F.round(lat, 7).alias("back_lat"), F.round(lon, 7).alias("back_lon"))


@query(f"""SELECT event_id, epoch_us(ts) / 1000000.0::DOUBLE AS seconds, round(sin(2 * pi() * (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 86400), 9) AS day_sin,
  round(cos(2 * pi() * (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 86400), 9) AS day_cos FROM events""")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    sin, cos = cyclic_time(F.col("ts"))
    return e.select("event_id", unix_seconds(F.col("ts")).alias("seconds"), F.round(sin, 9).alias("day_sin"), F.round(cos, 9).alias("day_cos"))


