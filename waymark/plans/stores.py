"""Sources, stores and table views: what is written comes back as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.scalars import item_at, pop_left, pop_right, push_right, set_at
from waymark.operators.compress import compress
from waymark.operators.filters import delete_selected, first_groups, numbered, select_rows
from waymark.operators.legacy import overlapping_vertices
from waymark.operators.motion import by_time
from waymark.operators.points import points, read
from waymark.operators.stays import breakpoints
from waymark.operators.tokens import support_set
from waymark.plans.base import BY_USER, POINTS, query
from waymark.plans.spatial import BREAKS, DIAMONDS, HEADERS, SCALED, STAY_SECONDS, _labelled, nation_fences
from waymark.plans.tokens import DAYS, _days
from waymark.sources.batches import read_batches
from waymark.sources.codecs import ingest, point_json, read_point
from waymark.sources.gpx import gpx_points, write_gpx
from waymark.sources.routes import read_routes, save_routes
from waymark.sources.tables import clear, closed, load, newest_first, replace, save, scratch, trajectory_headers

NTZ = "timestamp_ntz"
#: Points of a nested JSON batch.
BATCH_POINTS = 50_000


@query(f"""WITH {POINTS} SELECT ts, round(lat, 9) AS lat, round(lon, 9) AS lon, count(*) AS n FROM (SELECT date_trunc('millisecond', ts) AS ts, lat, lon FROM points) GROUP BY ALL""")
def gpx_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points as track points in XML files, and those files scanned."""
    path = scratch(spark, "gpx")
    write_gpx(points(spark, sf_dir).withColumn("ts", F.date_trunc("millisecond", "ts")), path)
    found = gpx_points(spark, path)
    return found.groupBy(F.col("ts").cast(NTZ).alias("ts"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon")).agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS} SELECT 'u' || "user" AS uid, "user" % 10 = 0 AS anomalous, date_trunc('millisecond', ts) AS ts, round(lat, 9) AS latitude, round(lon, 9) AS longitude, row_number() OVER ({BY_USER}) = 3 AS anom_start FROM points""")
def batch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled trajectories as nested JSON batches (a frame a user within a frame a batch of about BATCH_POINTS points, a file a batch), read back."""
    p = points(spark, sf_dir)
    many = max(4, -(-p.count() // BATCH_POINTS))
    p = p.withColumn("i", F.row_number().over(by_time()))
    row = F.struct("ts", "event_id", (F.unix_millis("ts")).alias("ms"), F.to_json(F.array(*[F.to_json(F.struct(F.col(c).alias("v"))) for c in ("lat", "lon")])).alias("x"), "lat", "lon", (F.col("i") == 3).alias("s"))
    each = p.groupBy("user").agg(F.array_sort(F.collect_list(row)).alias("r"))
    uid = F.concat(F.lit("u"), F.col("user"))
    text = lambda c: F.to_json(F.transform("r", c))
    data = F.concat(F.lit("["), F.array_join(F.transform("r", lambda r: F.concat(F.lit("["), r["lat"].cast("string"), F.lit(","), r["lon"].cast("string"), F.lit(',"'), uid, F.lit('",'), r["s"].cast("string"), F.lit("]"))), ","), F.lit("]"))
    frame = F.concat(F.lit('{"columns":["latitude","longitude","uid","anom_start"],"index":'), text(lambda r: r["ms"]), F.lit(',"data":'), data, F.lit("}"))
    quoted = lambda c: F.to_json(F.array(c))
    inner = F.concat(F.lit("["), F.expr("substring(q, 2, length(q) - 2)"), F.lit(","), F.lit('"'), uid, F.lit('",'), (F.col("user") % 10 == 0).cast("string"), F.lit("]"))
    rows = each.withColumn("q", quoted(frame)).select(F.pmod("user", F.lit(many)).alias("batch"), inner.alias("row"), "user")
    outer = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("user", "row"))).alias("r"))
    joined = F.array_join(F.transform("r", lambda r: r["row"]), ",")
    index = F.to_json(F.sequence(F.lit(0), F.size("r") - 1))
    document = outer.select("batch", F.to_json(F.array(F.concat(F.lit('{"columns":["df","uid","anomalous"],"index":'), index, F.lit(',"data":['), joined, F.lit("]}")))).alias("value"))
    path = scratch(spark, "batches")
    document.write.partitionBy("batch").text(path)  # one row a batch, so a file holds one document
    found = read_batches(spark, path)
    return found.select("uid", "anomalous", F.col("ts").cast(NTZ).alias("ts"), F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"), "anom_start")


@query(f"""WITH {POINTS} SELECT event_id, lat AS latitude, ts AS external_timestamp, value AS weight, CAST("user" AS VARCHAR) AS "user", 2 AS members, lon AS last_longitude, value * 2 AS magnitude, CAST(NULL AS DOUBLE) AS accuracy FROM points""")
def point_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with members and a sensor reading as documents, and back; fields left out are null."""
    member = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("ts").alias("external_timestamp"))
    magnet = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"), (F.col("value") * 2).alias("magnitude"), F.col("ts").alias("internal_timestamp"))
    fields = {"latitude": F.col("lat"), "longitude": F.col("lon"), "external_timestamp": F.col("ts"), "weight": F.col("value"), "user": F.col("user").cast("string"), "datapoints": F.array(member, member), "magnetometer_data": magnet}
    back = points(spark, sf_dir).select("event_id", point_json(fields).alias("d")).select("event_id", read_point(F.col("d")).alias("p"))
    return back.select("event_id", "p.latitude", F.col("p.external_timestamp").cast(NTZ).alias("external_timestamp"), "p.weight", "p.user", F.size("p.datapoints").alias("members"), F.element_at("p.datapoints", -1)["longitude"].alias("last_longitude"), "p.magnetometer_data.magnitude", "p.accuracy")


@query(f"""WITH {POINTS} SELECT CAST(7 AS BIGINT) AS "user", ts, lat, lon FROM points""")
def ingested_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = points(spark, sf_dir).select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("ts").alias("external_timestamp"))
    return ingest(raw, 7).withColumn("ts", F.col("ts").cast(NTZ))


@query(f"""WITH {POINTS} SELECT event_id, ts, lat, lon FROM points WHERE "user" = 3""")
def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points appended to a table by user in files of bounded size, and one user's read back from the folder that holds it alone."""
    path = scratch(spark, "points")
    save(points(spark, sf_dir), path, ["user"], rows_a_file=5000)
    return load(spark, path, user=3).select("event_id", F.col("ts").cast(NTZ).alias("ts"), "lat", "lon")


@query(f"""WITH {BREAKS} SELECT "user", start_ts, scan_ts, last_ts FROM breaks""")
def breakpoint_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed breakpoints only are stored, open ones at the end are not."""
    path = scratch(spark, "breakpoints")
    save(closed(breakpoints(_labelled(spark, sf_dir), STAY_SECONDS, tail=True)), path, ["user"])
    return load(spark, path).select(F.col("user").cast("long").alias("user"), *[F.col(c).cast(NTZ).alias(c) for c in ("start_ts", "scan_ts", "last_ts")])


@query(f"""WITH {DAYS} SELECT "user", seq, CASE WHEN "user" % 3 = 0 THEN 2 ELSE 1 END * count(*) AS freq FROM days WHERE "user" NOT IN (1, 2) GROUP BY "user", seq""")
def support_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support sets by user: added, two users' cleared, every third user's replaced."""
    path = scratch(spark, "support")
    support = support_set(_days(spark, sf_dir), "user")
    save(support, path, ["user"])
    clear(spark, path, "user", [1, 2])
    replace(support.where("user % 3 = 0").withColumn("freq", F.col("freq") * 2), path, ["user"])
    return load(spark, path).select(F.col("user").cast("long").alias("user"), "seq", "freq")


@query(f"""WITH {HEADERS} SELECT traj_id, start_ts, n_points, row_number() OVER (ORDER BY start_ts DESC, traj_id) AS rank FROM headers WHERE "user" = 4""")
def newest_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "headers")
    save(trajectory_headers(compress(points(spark, sf_dir), SCALED)), path, ["user"])
    found = newest_first(load(spark, path, user=4), 4)
    # One user's headers: the order that the reader gives, as a number.
    return found.select("traj_id", "start_ts", "n_points", F.row_number().over(W.partitionBy("user").orderBy(F.col("start_ts").desc(), "traj_id")).cast("long").alias("rank"))


@query("""SELECT event_type AS params, count(*) AS n, round(avg(value), 6) AS score FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type""")
def result_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in a table partitioned by parameters; two of the partitions are read."""
    path = scratch(spark, "results")
    save(read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("params")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("score")), path, ["params"])
    return load(spark, path).where(F.col("params").isin("click", "view")).select("params", "n", "score")


@query(f"""WITH {DIAMONDS} SELECT label, round(x, 6) AS mid_lon, round(y, 6) AS mid_lat, 4 AS corners FROM fences WHERE label IN ('NATION_3', 'NATION_7')""")
def fence_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences of all nations with their rings in a table by label, and two of them back."""
    path = scratch(spark, "fences")
    save(nation_fences(spark, sf_dir), path, ["label"])
    found = load(spark, path).where(F.col("label").isin("NATION_3", "NATION_7"))
    return found.select("label", F.round((F.col("min_x") + F.col("max_x")) / 2, 6).alias("mid_lon"), F.round((F.col("min_y") + F.col("max_y")) / 2, 6).alias("mid_lat"), F.size("ring").alias("corners"))


@query("""WITH q AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS items FROM events GROUP BY user_id), n AS (SELECT *, list_append(items, CAST(-1 AS BIGINT)) AS pushed FROM q)
SELECT user_id, items[1] AS lpop, items[len(items)] AS rpop, items[2:] AS rest, pushed[len(pushed)] AS last, items[2] AS second, CAST(len(pushed) AS INTEGER) AS llen, list_concat([CAST(0 AS BIGINT)], items[2:]) AS lset, contains(items, 5) AS has_five FROM n""")
def queue_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Push, pop, length, set and membership of each user's queue of events."""
    q = read(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda r: r["event_id"]).alias("items"))
    items = F.col("items")
    pushed = push_right(items, F.lit(-1).cast("long"))
    return q.select("user_id", pop_left(items)[0].alias("lpop"), pop_right(items)[0].alias("rpop"), pop_left(items)[1].alias("rest"), item_at(pushed, F.lit(-1)).alias("last"), item_at(items, F.lit(1)).alias("second"), F.size(pushed).alias("llen"), set_at(items, F.lit(0), F.lit(0).cast("long")).alias("lset"), F.array_contains(items, 5).alias("has_five"))


@query(f"""WITH {POINTS}, n AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY "user", CAST(ts AS DATE) ORDER BY ts, event_id) AS number FROM points)
SELECT "user", day, number, header, CASE header WHEN 'lat' THEN lat WHEN 'lon' THEN lon ELSE value END AS cell FROM n, (VALUES ('lat'), ('lon'), ('value')) AS h(header)""")
def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments (a user's day) as tables: numbered rows, a header and a cell for each field."""
    p = points(spark, sf_dir).withColumn("day", F.to_date("ts"))
    p = p.withColumn("number", F.row_number().over(W.partitionBy("user", "day").orderBy("ts", "event_id")).cast("long"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("header"), F.col(c).alias("cell")) for c in ("lat", "lon", "value")]))
    return p.select("user", "day", "number", cells.alias("c")).select("user", "day", "number", "c.header", "c.cell")


@query("""SELECT c_custkey, c_acctbal < 0 OR c_custkey = 5 AS selected FROM customer WHERE NOT (c_acctbal < -500 AND c_mktsegment = 'BUILDING')""")
def row_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row selected, all matching rows selected, and the selected ones that match deleted."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    rows = select_rows(select_rows(rows, F.col("c_acctbal") < 0), F.col("c_custkey") == 5)
    return delete_selected(rows, (F.col("c_acctbal") < -500) & (F.col("c_mktsegment") == "BUILDING")).select("c_custkey", "selected")


@query(f"""WITH {POINTS}, f AS (SELECT "user" FROM points GROUP BY "user" ORDER BY min(ts), min(event_id), "user" LIMIT 20) SELECT event_id FROM points WHERE "user" IN (SELECT "user" FROM f)""")
def first_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_groups(points(spark, sf_dir), 20, "user", ["ts", "event_id"]).select("event_id")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY lower(c_mktsegment), c_custkey) AS place FROM customer""")
def collated_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in the order of a text column without regard to case, equal ones in order of their key."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment"))
    return numbered(rows, [F.collate("segment", "UNICODE_CI"), F.col("c_custkey")]).select("c_custkey", "place")


@query(f"""WITH {POINTS}, h AS (SELECT "user", date_trunc('hour', ts) AS ts, event_id FROM points) SELECT a.event_id AS a, b.event_id AS b FROM h a JOIN h b ON a."user" = b."user" AND a.ts = b.ts""")
def many_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one user and time multiply in a join on both."""
    h = points(spark, sf_dir).select("user", F.date_trunc("hour", "ts").alias("ts"), "event_id")
    return h.withColumnRenamed("event_id", "a").join(h.withColumnRenamed("event_id", "b"), ["user", "ts"]).select("a", "b")


@query(f"""WITH {HEADERS}, pairs AS (SELECT *, lag(traj_id) OVER w AS b, lag(n_points) OVER w AS n FROM headers WINDOW w AS (PARTITION BY "user" ORDER BY start_ts, traj_id)) SELECT traj_id, coalesce(traj_id = b AND n_points = n, false) AS same, true AS itself FROM pairs""")
def trajectory_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring trajectories are never the same, each is the same as itself."""
    from waymark.operators.equality import same_trajectory

    w = W.partitionBy("user").orderBy("start_ts", "traj_id")
    h = trajectory_headers(compress(points(spark, sf_dir), SCALED)).withColumn("t", F.struct("traj_id", "n_points"))
    h = h.withColumn("b", F.lag("t").over(w))
    return h.select("traj_id", F.coalesce(same_trajectory(F.col("t"), F.col("b")) & F.col("b").isNotNull(), F.lit(False)).alias("same"), same_trajectory(F.col("t"), F.col("t")).alias("itself"))


#: Triples of a user's places, and routes that go along the row of the first place, then along the column of the last.
ROUTED = f"""{POINTS}, placed AS (SELECT "user", event_id, ts, CAST(round((lat - 55.36) / 0.0002) AS BIGINT) AS r, CAST(round((lon - 10.38) / 0.0003) AS BIGINT) AS q FROM points),
triples AS (SELECT * FROM (SELECT event_id AS id, lag(r, 2) OVER w AS ar, lag(q, 2) OVER w AS aq, lag(r) OVER w AS br, lag(q) OVER w AS bq, r AS cr, q AS cq FROM placed WINDOW w AS (PARTITION BY "user" ORDER BY ts, event_id)) WHERE ar IS NOT NULL),
steps AS (SELECT *, abs(bq - aq) + abs(br - ar) AS n, 2 * abs(br - ar) + 3 * abs(bq - aq) AS s, 2 * abs(cr - ar) + 3 * abs(cq - aq) AS l FROM triples),
vertices AS (SELECT *, CASE WHEN ord <= abs(bq - aq) THEN ar ELSE ar + sign(br - ar) * (ord - abs(bq - aq)) END AS vr, CASE WHEN ord <= abs(bq - aq) THEN aq + sign(bq - aq) * ord ELSE bq END AS vq FROM (SELECT *, unnest(range(0, n + 1)) AS ord FROM steps WHERE l > 0 AND abs(l - s) <= 2.5::DOUBLE * l))"""


@query(f"""WITH {ROUTED} SELECT id, ord, round(10.38 + vq * 0.0003::DOUBLE, 4) AS x, round(55.36 + vr * 0.0002::DOUBLE, 4) AS y FROM vertices WHERE (vr = ar AND vq BETWEEN least(aq, cq) AND greatest(aq, cq)) OR (vq = cq AND vr BETWEEN least(ar, cr) AND greatest(ar, cr))""")
def route_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every three places a user passes, what the route to the second shares with the route to the third; routes come from a store of encoded lines."""
    row, column = F.round((F.col("lat") - 55.36) / 0.0002).cast("long"), F.round((F.col("lon") - 10.38) / 0.0003).cast("long")
    w = by_time()
    place = points(spark, sf_dir).select("user", "event_id", "ts", (row * 10 + column).alias("p"))
    triples = place.select(F.col("event_id").alias("id"), F.lag("p", 2).over(w).alias("a"), F.lag("p").over(w).alias("b"), F.col("p").alias("c")).where("a is not null")
    pairs = triples.select("a", F.explode(F.array("b", "c")).alias("d")).select(F.col("a").alias("src"), F.col("d").alias("dst")).distinct()
    r, q = (lambda c: F.floor(F.col(c) / 10)), (lambda c: F.col(c) % 10)
    dr, dq = r("dst") - r("src"), q("dst") - q("src")
    at = lambda i, x, y: F.struct((55.36 + y(i) * 0.0002).alias("lat"), (10.38 + x(i) * 0.0003).alias("lon"))
    x = lambda i: q("src") + F.signum(dq) * F.least(i, F.abs(dq))
    y = lambda i: r("src") + F.signum(dr) * F.greatest(i - F.abs(dq), F.lit(0))
    routes = pairs.select("src", "dst", (2 * F.abs(dr) + 3 * F.abs(dq)).cast("double").alias("length"), F.transform(F.sequence(F.lit(0).cast("long"), F.abs(dr) + F.abs(dq)), lambda i: at(i, x, y)).alias("points"))
    path = scratch(spark, "routes")
    save_routes(routes, path)
    found = overlapping_vertices(triples, read_routes(spark, path), 1e-5, 2.5)
    return found.select("id", F.col("ord").cast("long").alias("ord"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
