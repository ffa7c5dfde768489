"""Token sequences, support, similarity scores, detectors and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.cells import ALPHABETS, encode
from waymark.functions.geo import near_path, path_length, point_along, to_utm
from waymark.functions.sequences import common_subsequence, contains_run, drop_repeats, interpolated
from waymark.operators.closed import closed_patterns as all_closed_patterns
from waymark.operators.closed import extract_support
from waymark.operators.evaluate import sweep
from waymark.operators.ibdd import IbddParams, fit, leave_one_out
from waymark.operators.ibdd import evaluate as ibdd_evaluate
from waymark.operators.patterns import PatternParams, batch_rates, evaluate
from waymark.operators.patterns import detect as pattern_detector
from waymark.operators.patterns import fit as pattern_fit
from waymark.operators.points import points
from waymark.operators.tokens import anomaly, cell_centres, lines, sequences, support_fraction, support_set, token_rows, window_scores, window_tokens
from waymark.plans.base import BY_USER, POINTS, STEPS, query, sql_from_utm, sql_spacing, sql_utm
from waymark.plans.spatial import _hilbert_sql
from waymark.sources.tables import staged

LEVEL = 20
PERIOD = "1440T"

#: Cells of the points, repeats dropped. The grid has 100 places, so each is encoded once.
TOKENS = f"""{POINTS}, cells AS (SELECT lat, lon, {_hilbert_sql('lat', 'lon', LEVEL)} AS geohash FROM (SELECT DISTINCT lat, lon FROM points)),
celled AS (SELECT * FROM points JOIN cells USING (lat, lon)),
tokens AS (SELECT * FROM (SELECT *, lag(geohash) OVER ({BY_USER}) AS before FROM celled) WHERE before IS NULL OR before <> geohash)"""


def _rows(spark: SparkSession, sf_dir: str, interpolate: bool = False) -> DataFrame:
    return token_rows(points(spark, sf_dir), LEVEL, interpolate=interpolate)


@query(f"""WITH {TOKENS} SELECT "user", list(geohash ORDER BY ts, event_id) AS seq FROM tokens GROUP BY "user" """)
def token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(_rows(spark, sf_dir))


#: Cells of equally spaced places of the straight UTM line between neighbours, each pair of places once.
STEPPED = f"""{TOKENS}, {sql_spacing(LEVEL)},
gone AS (SELECT *, lag(lat) OVER ({BY_USER}) AS a, lag(lon) OVER ({BY_USER}) AS o FROM tokens),
ways AS (SELECT *, row_number() OVER () AS k, floor((o + 180) / 6) + 1 AS zone FROM (SELECT DISTINCT a, o, lat, lon, before, geohash FROM gone WHERE a IS NOT NULL)),
first_ends AS (SELECT * EXCLUDE (east, north), east AS e1, north AS n1 FROM {sql_utm('ways', 'a', 'o', 'zone')}),
both_ends AS (SELECT * EXCLUDE (east, north), east AS e2, north AS n2 FROM {sql_utm('first_ends', 'lat', 'lon', 'zone')}),
counted AS (SELECT *, greatest(2, CAST(floor(sqrt(pow(e2 - e1, 2) + pow(n2 - n1, 2)) / spacing) AS INTEGER) + 1) AS m FROM both_ends, spacing),
placed AS (SELECT k, i, before, geohash, e1 + (e2 - e1) * (i / (m - 1)::DOUBLE) AS e, n1 + (n2 - n1) * (i / (m - 1)::DOUBLE) AS n, zone FROM (SELECT *, unnest(range(m)) AS i FROM counted)),
named AS (SELECT k, i, before, geohash, {_hilbert_sql('back_lat', 'back_lon', LEVEL)} AS cell FROM {sql_from_utm('placed', 'e', 'n', 'zone')}),
inner_cells AS (SELECT k, list(cell ORDER BY i) AS between FROM (SELECT *, lag(cell) OVER (PARTITION BY k ORDER BY i) AS last FROM named) WHERE cell IS DISTINCT FROM last AND cell <> before AND cell <> geohash GROUP BY k),
passed AS (SELECT a, o, lat, lon, coalesce(between, []) AS between FROM ways LEFT JOIN inner_cells USING (k)),
stepped AS (SELECT g.*, coalesce(between, []) AS between FROM gone g LEFT JOIN passed p ON g.a = p.a AND g.o = p.o AND g.lat = p.lat AND g.lon = p.lon)"""


@query(f"""WITH {STEPPED} SELECT "user", flatten(list(list_append(between, geohash) ORDER BY ts, event_id)) AS seq FROM stepped GROUP BY "user" """)
def interpolated_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(_rows(spark, sf_dir, interpolate=True))


@query(f"""WITH {STEPPED} SELECT "user", flatten(list(list_append(between, geohash) ORDER BY ts, event_id)) AS seq, count(*) AS n FROM stepped GROUP BY "user" """)
def sequence_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sequences with the cells between neighbours put in, from the cells and the lists between them."""
    rows = _rows(spark, sf_dir, interpolate=True)
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "geohash", "between")))
    each = rows.groupBy("user").agg(ordered.alias("r"), F.count("*").alias("n"))
    cells, between = F.transform("r", lambda r: r["geohash"]), F.transform(F.slice("r", F.lit(2), F.size("r") - 1), lambda r: r["between"])
    return each.select("user", interpolated(cells, between).alias("seq"), "n")


#: Short sequences: the cells of a user's day.
DAYS = f"""{TOKENS}, days AS (SELECT "user", CAST(ts AS DATE) AS day, list(geohash ORDER BY ts, event_id) AS seq FROM tokens GROUP BY ALL)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("day", F.to_date("ts"))
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "geohash")))
    return rows.groupBy("user", "day").agg(ordered["geohash"].alias("seq"))


@query(f"""WITH {DAYS} SELECT seq, count(*) AS freq FROM days GROUP BY seq""")
def support_set_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return support_set(_days(spark, sf_dir))


#: Patterns of two sequences or more of a user; closed: no longer one holds it in as many. A sequence counts for its longest closed pattern.
_HELD = lambda a, b: f"list_reduce(list_prepend({{'k': 0, 't': ''}}, list_transform({b}, lambda t: {{'k': 0, 't': t}})), lambda x, y: {{'k': CASE WHEN x.k < len({a}) AND {a}[x.k + 1] = y.t THEN x.k + 1 ELSE x.k END, 't': y.t}}).k = len({a})"
CLOSED = f"""RECURSIVE {DAYS},
grown AS (
  SELECT "user", day, seq, i AS last, [seq[i]] AS pattern FROM (SELECT *, unnest(range(1, len(seq) + 1)) AS i FROM days)
  UNION
  SELECT "user", day, seq, i, list_append(pattern, seq[i]) FROM (SELECT *, unnest(range(last + 1, len(seq) + 1)) AS i FROM grown)),
frequent AS (SELECT "user", pattern, count(DISTINCT day) AS n FROM grown GROUP BY ALL HAVING count(DISTINCT day) >= 2),
closed AS (SELECT * FROM frequent p WHERE NOT EXISTS (SELECT 1 FROM frequent q WHERE q."user" = p."user" AND q.n = p.n AND len(q.pattern) > len(p.pattern) AND {_HELD('p.pattern', 'q.pattern')})),
best AS (SELECT "user", day, pattern, row_number() OVER (PARTITION BY "user", day ORDER BY len(pattern) DESC, pattern) AS rank FROM (SELECT DISTINCT g."user", g.day, g.pattern FROM grown g JOIN closed c ON c."user" = g."user" AND c.pattern = g.pattern))"""


@query(f"""WITH {CLOSED} SELECT "user", count(*) AS freq, pattern AS seq FROM best WHERE rank = 1 GROUP BY "user", pattern""")
def closed_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_support(_days(spark, sf_dir), "user", 2)


@query(f"""WITH {CLOSED} SELECT "user", n AS freq, pattern AS seq FROM closed""")
def all_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every closed pattern of a user's days that two of them hold."""
    return all_closed_patterns(_days(spark, sf_dir), "user", 2)


@query(f"""WITH {TOKENS} SELECT event_id, list(geohash) OVER w AS sequence FROM tokens WINDOW w AS (PARTITION BY "user" ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW)""")
def window_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_tokens(_rows(spark, sf_dir), PERIOD).select("event_id", "sequence")


#: Length of the longest common subsequence of the lists s and p, a row of the table for each token of s.
_LCS = """list_reduce(list_prepend({'row': list_transform(range(0, len(p) + 1), lambda x: 0), 't': ''}, list_transform(s, lambda t: {'row': list_transform(range(0, 0), lambda x: 0), 't': t})),
  lambda a, b: {'row': list_reduce(list_prepend([0], list_transform(range(1, len(p) + 1), lambda j: [CAST(j AS INTEGER)])), lambda done, j: list_append(done, CASE WHEN p[j[1]] = b.t THEN a.row[j[1]] + 1 ELSE greatest(a.row[j[1] + 1], done[len(done)]) END)), 't': b.t}).row[len(p) + 1]"""


#: Windows of the rows of odd days against the sequences of the user's even days.
SCORED = f"""{DAYS}, rows AS (SELECT event_id, "user", ts, list(geohash) OVER w AS sequence FROM tokens WINDOW w AS (PARTITION BY "user" ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW)),
odd AS (SELECT * FROM rows WHERE day(ts) % 2 = 1), support AS (SELECT DISTINCT "user", seq AS p FROM days WHERE day(day) % 2 = 0),
met AS (SELECT "user", sequence AS s, p FROM (SELECT DISTINCT "user", sequence FROM odd) JOIN support USING ("user")),
best AS (SELECT "user", s, max(({_LCS}) / len(s)::DOUBLE) AS similarity FROM met GROUP BY ALL),
scored AS (SELECT event_id, odd."user", ts, coalesce(similarity, 0) AS similarity FROM odd LEFT JOIN best ON best."user" = odd."user" AND best.s = odd.sequence)"""


@query(f"""WITH {SCORED} SELECT event_id, round(similarity, 9) AS similarity, round(low, 9) AS anomaly_score, low > 0.5 AS anomaly FROM (SELECT *, 1 - min(similarity) OVER ({BY_USER} ROWS UNBOUNDED PRECEDING) AS low FROM scored)""")
def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = support_set(_days(spark, sf_dir).where(F.dayofmonth("day") % 2 == 0), "user").withColumnRenamed("seq", "pattern")
    scored = anomaly(window_scores(_rows(spark, sf_dir), support, PERIOD, "user", wanted=F.dayofmonth("ts") % 2 == 1), 0.5)
    return scored.select("event_id", F.round("similarity", 9).alias("similarity"), F.round("anomaly_score", 9).alias("anomaly_score"), "anomaly")


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's day is a trajectory, a user's days are a batch."""
    p = points(spark, sf_dir)
    return p.withColumns({"uid": F.concat_ws("|", "user", F.to_date("ts")), "batch": F.col("user"), "role": F.dayofmonth("ts") % 2})


def _trip_sql(level: int, name: str) -> str:
    """Rows of trajectories with repeated cells dropped, their windows, and their whole sequences, at a level."""
    return f"""{name}_cells AS (SELECT lat, lon, {_hilbert_sql('lat', 'lon', level)} AS c FROM (SELECT DISTINCT lat, lon FROM points)),
{name}_rows AS (SELECT * FROM (SELECT *, lag(c) OVER (PARTITION BY uid ORDER BY ts, event_id) AS last FROM (SELECT p.*, "user" || '|' || CAST(ts AS DATE) AS uid FROM points p) JOIN {name}_cells USING (lat, lon)) WHERE last IS NULL OR last <> c),
{name}_win AS (SELECT event_id, "user", uid, ts, list(c) OVER (PARTITION BY uid ORDER BY ts RANGE BETWEEN INTERVAL '17999.999999 seconds' PRECEDING AND CURRENT ROW) AS s FROM {name}_rows),
{name}_seqs AS (SELECT uid, any_value("user") AS "user", list(c ORDER BY ts, event_id) AS p FROM {name}_rows GROUP BY uid)"""


@query(f"""WITH {POINTS}, {_trip_sql(LEVEL, 't')},
support AS (SELECT DISTINCT "user", p FROM t_seqs WHERE CAST(right(uid, 2) AS INTEGER) % 2 = 0), odd AS (SELECT * FROM t_win WHERE day(ts) % 2 = 1),
best AS (SELECT "user", s, max(({_LCS}) / len(s)::DOUBLE) AS similarity FROM (SELECT DISTINCT "user", s FROM odd) JOIN support USING ("user") GROUP BY ALL),
scored AS (SELECT event_id, uid, ts, coalesce(similarity, 0) AS similarity FROM odd LEFT JOIN best ON best."user" = odd."user" AND best.s = odd.s)
SELECT event_id, uid, round(similarity, 9) AS similarity, round(low, 9) AS anomaly_score, low > 0.4 AS anomaly FROM (SELECT *, 1 - min(similarity) OVER (PARTITION BY uid ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS low FROM scored)""")
def pattern_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the even days, all trajectories of the odd days scored."""
    t, params = _trajectories(spark, sf_dir), PatternParams(LEVEL, 0.4, "300T", interpolate=False)
    found = pattern_detector(t.where("role = 1"), pattern_fit(t.where("role = 0"), params, "batch"), params, "batch")
    return found.select("event_id", "uid", F.round("similarity", 9).alias("similarity"), F.round("anomaly_score", 9).alias("anomaly_score"), "anomaly")


LEVELS, THRESHOLDS = (18, 19, 20), (0.2, 0.4, 0.6)


def _loo_sql(level: int) -> str:
    n = f"l{level}"
    return f"""{_trip_sql(level, n)},
{n}_count AS (SELECT "user", p, count(*) AS freq FROM {n}_seqs GROUP BY ALL),
{n}_need AS (SELECT DISTINCT w."user", w.s, q.p AS own FROM {n}_win w JOIN {n}_seqs q USING (uid)),
{n}_pair AS (SELECT d."user", s, own, p FROM {n}_need d JOIN {n}_count c ON c."user" = d."user" AND (freq > 1 OR p <> own)),
{n}_lcs AS (SELECT s, p, ({_LCS}) AS k FROM (SELECT DISTINCT s, p FROM {n}_pair)),
{n}_best AS (SELECT "user", s, own, max(k / len(s)::DOUBLE) AS similarity FROM {n}_pair JOIN {n}_lcs USING (s, p) GROUP BY ALL),
{n}_low AS (SELECT w.uid, w.ts, 1 - min(coalesce(b.similarity, 0)) OVER (PARTITION BY w.uid ORDER BY w.ts, w.event_id ROWS UNBOUNDED PRECEDING) AS low FROM {n}_win w JOIN {n}_seqs q USING (uid) LEFT JOIN {n}_best b ON b."user" = w."user" AND b.s = w.s AND b.own = q.p),
{n} AS (SELECT {level} AS precision, uid, ts, low FROM {n}_low)"""


LOO = f"""{POINTS}, {', '.join(_loo_sql(level) for level in LEVELS)},
truth AS (SELECT "user" || '|' || CAST(ts AS DATE) AS uid, any_value("user") AS batch, any_value(day(ts)) % 5 = 0 AS anomalous, min(ts) AS onset FROM points GROUP BY 1),
lows AS ({' UNION ALL '.join(f'SELECT * FROM l{level}' for level in LEVELS)}),
params AS (SELECT * FROM (VALUES {', '.join(f'({level})' for level in LEVELS)}) AS a(precision), (VALUES {', '.join(f'({t}::DOUBLE)' for t in THRESHOLDS)}) AS b(threshold)),
hit AS (SELECT precision, threshold, uid, min(ts) AS first_ts FROM lows JOIN params USING (precision) WHERE low > threshold GROUP BY ALL),
outcomes AS (SELECT p.precision, p.threshold, batch, uid, anomalous, first_ts IS NOT NULL AS outcome, CASE WHEN first_ts >= onset THEN (epoch_us(first_ts) - epoch_us(onset)) / 1000000.0::DOUBLE END AS delay FROM (SELECT * FROM truth, params) p LEFT JOIN hit h USING (precision, threshold, uid)),
confusion AS (SELECT precision, threshold, batch, count(*) FILTER (WHERE anomalous AND outcome) AS tp, count(*) FILTER (WHERE anomalous AND NOT outcome) AS fn, count(*) FILTER (WHERE NOT anomalous AND outcome) AS fp, count(*) FILTER (WHERE NOT anomalous AND NOT outcome) AS tn, median(delay) AS delay FROM outcomes GROUP BY ALL),
rated AS (SELECT *, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 ELSE 0 END AS auc, CASE WHEN tp + fp > 0 AND tn + fn > 0 THEN (tp / (tp + fp)::DOUBLE + tn / (tn + fn)::DOUBLE) / 2 ELSE 0 END AS auc_swapped FROM confusion)"""


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trajectories(spark, sf_dir)
    truth = t.groupBy("uid").agg((F.first(F.dayofmonth("ts")) % 5 == 0).alias("anomalous"), F.min("ts").alias("onset"))
    return evaluate(t, truth, list(LEVELS), list(THRESHOLDS), "300T", interpolate=False)


@query(f"""WITH {LOO} SELECT precision, threshold, batch, uid, anomalous, outcome, delay FROM outcomes""")
def detection_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir)


@query(f"""WITH {LOO} SELECT precision, threshold, batch, tp, fn, fp, tn, round(auc, 9) AS auc, round(auc_swapped, 9) AS auc_swapped, round(delay, 3) AS delay FROM rated""")
def loo_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out over every trajectory, three levels by three thresholds: rates of each batch."""
    r = batch_rates(_outcomes(spark, sf_dir))
    return r.select("precision", "threshold", "batch", "tp", "fn", "fp", "tn", F.round("auc", 9).alias("auc"), F.round("auc_swapped", 9).alias("auc_swapped"), F.round("delay", 3).alias("delay"))


@query(f"""WITH {LOO} SELECT precision, threshold, round(median(auc), 9) AS median_auc, round(median(delay), 3) AS median_delay FROM rated GROUP BY ALL""")
def sweep_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sweep(batch_rates(_outcomes(spark, sf_dir)), "precision", "threshold")
    return r.select("precision", "threshold", F.round("median_auc", 9).alias("median_auc"), F.round("median_delay", 3).alias("median_delay"))


@query(f"""WITH {DAYS}, f AS (SELECT "user", arg_min(seq, day) AS p FROM days GROUP BY "user"), d AS (SELECT "user", day, seq AS s, p FROM days JOIN f USING ("user"))
SELECT "user", day, CAST(({_LCS}) AS INTEGER) AS score FROM d""")
def alignment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    first = days.groupBy("user").agg(F.min_by("seq", "day").alias("p"))
    return days.join(first, "user").select("user", "day", common_subsequence(F.col("seq"), F.col("p")).alias("score"))


@query(f"""WITH {DAYS}, runs AS (SELECT DISTINCT seq[1:2] AS run FROM days WHERE len(seq) >= 2), u AS (SELECT "user", list(geohash ORDER BY ts, event_id) AS seq FROM tokens GROUP BY "user")
SELECT array_to_string(run, '-') AS run_id, round(avg(CASE WHEN contains('-' || array_to_string(seq, '-') || '-', '-' || array_to_string(run, '-') || '-') THEN 1.0::DOUBLE ELSE 0 END), 9) AS support FROM runs, u GROUP BY ALL""")
def support_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _days(spark, sf_dir).where("size(seq) >= 2").select(F.slice("seq", 1, 2).alias("run")).distinct()
    runs = runs.select(F.array_join("run", "-").alias("run_id"), "run")
    return support_fraction(sequences(_rows(spark, sf_dir)), runs).select("run_id", F.round("support", 9).alias("support"))


@query(f"""WITH {DAYS}, raw AS (SELECT "user", CAST(ts AS DATE) AS day, list(geohash ORDER BY ts, event_id) AS seq FROM celled GROUP BY ALL), f AS (SELECT "user", arg_min(seq, day) AS p FROM days GROUP BY "user")
SELECT "user", day, len(list_filter(range(1, len(seq) + 1), lambda i: i = 1 OR seq[i] <> seq[i - 1])) AS n, contains('-' || array_to_string(seq, '-') || '-', '-' || array_to_string(p[1:2], '-') || '-') AS has_start FROM raw JOIN f USING ("user")""")
def sequence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day: cells without repeats, and whether the first two cells of the user's first day come in a row."""
    celled = points(spark, sf_dir).withColumn("geohash", encode(F.col("lat"), F.col("lon"), LEVEL)).withColumn("day", F.to_date("ts"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "geohash")))
    raw = celled.groupBy("user", "day").agg(F.transform(ordered, lambda r: r["geohash"]).alias("seq"))
    first = _days(spark, sf_dir).groupBy("user").agg(F.min_by("seq", "day").alias("p"))
    return raw.join(first, "user").select("user", "day", F.size(drop_repeats(F.col("seq"))).cast("long").alias("n"), contains_run(F.col("seq"), F.slice("p", 1, 2)).alias("has_start"))


#: UTM lines through the cells of a day.
LINES = f"""{DAYS}, cut AS (SELECT "user", day, seq, unnest(range(1, len(seq) + 1)) AS i FROM days WHERE len(seq) >= 2),
centres AS (SELECT geohash, (floor((any_value(lon) + 180) / 360 * {1 << LEVEL}) + 0.5) / {1 << LEVEL} * 360 - 180 AS lon, (floor((any_value(lat) + 90) / 180 * {1 << LEVEL}) + 0.5) / {1 << LEVEL} * 180 - 90 AS lat FROM celled GROUP BY geohash),
plane AS (SELECT geohash, east, north FROM {sql_utm('centres')}),
line AS (SELECT "user", day, i, east, north, lead(east) OVER w AS e2, lead(north) OVER w AS n2, sqrt(pow(lead(east) OVER w - east, 2) + pow(lead(north) OVER w - north, 2)) AS d FROM cut JOIN plane ON geohash = seq[i] WINDOW w AS (PARTITION BY "user", day ORDER BY i)),
summed AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY "user", day ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM line WHERE d IS NOT NULL),
whole AS (SELECT "user", day, sum(d) AS length FROM summed GROUP BY ALL),
half AS (SELECT "user", day, east + (e2 - east) * (length / 2 - before) / d AS x, north + (n2 - north) * (length / 2 - before) / d AS y, row_number() OVER (PARTITION BY "user", day ORDER BY i) AS r FROM summed JOIN whole USING ("user", day) WHERE before + d >= length / 2),
fits AS (SELECT "user", day, min(sqrt(pow(px - east - t * (e2 - east), 2) + pow(py - north - t * (n2 - north), 2))) <= 40 AS near FROM (SELECT s.*, px, py, least(1, greatest(0, ((px - east) * (e2 - east) + (py - north) * (n2 - north)) / (d * d))) AS t FROM summed s, (SELECT avg(east) AS px, avg(north) AS py FROM plane) c) GROUP BY ALL)"""


@query(f"""WITH {LINES} SELECT "user", day, count(*) + 1 AS n, round(sum(d), 3) AS length, round(any_value(h.x), 3) AS half_x, round(any_value(h.y), 3) AS half_y, any_value(near) AS near_middle FROM summed JOIN half h USING ("user", day) JOIN fits USING ("user", day) WHERE h.r = 1 GROUP BY "user", day""")
def sequence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's sequence as a line: its length, the place half way, and whether it passes within 40 m of the middle of all cells."""
    rows = staged(_rows(spark, sf_dir).select("user", F.to_date("ts").alias("day"), "ts", "event_id", "geohash"), "token-rows")
    centres = staged(cell_centres(rows), "centres")
    x, y = to_utm(F.col("lat"), F.col("lon"))
    middle = centres.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    days = lines(rows, centres, ["user", "day"]).join(F.broadcast(middle)).withColumn("length", path_length(F.col("line"))).withColumn("half", point_along(F.col("line"), F.col("length") / 2))
    near = near_path(F.col("mx"), F.col("my"), F.col("line"), 40.0)
    return days.select("user", "day", F.size("line").cast("long").alias("n"), F.round("length", 3).alias("length"), F.round("half.x", 3).alias("half_x"), F.round("half.y", 3).alias("half_y"), near.alias("near_middle"))


#: Runs of points in one cell, without noise and cells barely touched: what closes a run is the next cell.
IBDD = f"""RECURSIVE {STEPS}, {sql_spacing(LEVEL)},
measured AS (SELECT "user", CASE WHEN coalesce(avg(dx) FILTER (WHERE dt > 0) + 3 * stddev_pop(dx) FILTER (WHERE dt > 0), 0) = 0 THEN 'inf'::DOUBLE ELSE avg(dx) FILTER (WHERE dt > 0) + 3 * stddev_pop(dx) FILTER (WHERE dt > 0) END AS separation, greatest(CASE WHEN count(*) > 1 THEN sum(dx) / count(*) ELSE 0 END, 1e-9::DOUBLE) AS rate FROM steps GROUP BY "user"),
cells AS (SELECT lat, lon, {_hilbert_sql('lat', 'lon', LEVEL)} AS c FROM (SELECT DISTINCT lat, lon FROM points)),
q AS (SELECT "user", c, east AS x, north AS y, separation, rate, spacing, row_number() OVER ({BY_USER}) AS i FROM {sql_utm('points')} JOIN cells USING (lat, lon) JOIN measured USING ("user"), spacing),
m AS (
  SELECT "user", i, CAST(NULL AS STRUCT(c VARCHAR, x DOUBLE, y DOUBLE, way DOUBLE, n INTEGER)) AS past, {{'c': c, 'x': x, 'y': y, 'way': 0::DOUBLE, 'n': 1}} AS now, CAST(NULL AS VARCHAR) AS token FROM q WHERE i = 1
  UNION ALL
  SELECT "user", i, CASE WHEN act = 'same' THEN past WHEN act = 'bounce' THEN NULL WHEN act = 'drop' THEN past ELSE now END,
    CASE act WHEN 'same' THEN {{'c': c, 'x': x, 'y': y, 'way': now.way + step, 'n': now.n + 1}} WHEN 'bounce' THEN {{'c': c, 'x': x, 'y': y, 'way': past.way + sqrt(pow(past.x - x, 2) + pow(past.y - y, 2)), 'n': past.n + 1}} ELSE {{'c': c, 'x': x, 'y': y, 'way': 0::DOUBLE, 'n': 1}} END,
    CASE WHEN act = 'next' THEN now.c END
  FROM (SELECT *, CASE WHEN now.c = c THEN 'same' WHEN step >= separation OR (now.way <= spacing / 3 AND now.n <= spacing / (5 * rate)) THEN CASE WHEN past.c = c THEN 'bounce' ELSE 'drop' END ELSE 'next' END AS act
    FROM (SELECT m."user", q.i, q.c, q.x, q.y, q.separation, q.rate, q.spacing, m.past, m.now, sqrt(pow(m.now.x - q.x, 2) + pow(m.now.y - q.y, 2)) AS step FROM m JOIN q ON q."user" = m."user" AND q.i = m.i + 1))),
tokens AS (SELECT "user", i, token FROM m WHERE token IS NOT NULL UNION ALL SELECT "user", i + 1, now.c FROM m WHERE (m."user", m.i) IN (SELECT ("user", max(i)) FROM q GROUP BY "user"))"""


@query(f"""WITH {IBDD} SELECT "user", list(token ORDER BY i) AS seq FROM tokens GROUP BY "user" """)
def ibdd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit(points(spark, sf_dir), IbddParams(precision=LEVEL))


THETAS = (0.05, 0.1, 0.2)


def _ibdd_loo_sql(levels: tuple[int, ...], thetas: tuple[float, ...], batch: str) -> str:
    """Leave-one-out of the comparison detector over all users of a batch: labels(precision, theta, uid, event_id) of the points with label 1.

    Two folds, a row a step for all users side by side: cells given out (under own estimates for what is learned, under the others' for what is
    tested), then runs of at most three cells against the owners of equal runs."""
    spacing = ", ".join(f"spacing{level} AS (WITH {sql_spacing(level)} SELECT spacing FROM spacing)" for level in levels)
    cells = " UNION ALL ".join(f"SELECT {level} AS precision, lat, lon, {_hilbert_sql('lat', 'lon', level)} AS c, spacing FROM (SELECT DISTINCT lat, lon FROM points), spacing{level}" for level in levels)
    limit = lambda v: f"CASE WHEN coalesce({v}, 0) > 0 THEN {v} ELSE 'inf'::DOUBLE END"
    spread = lambda n, s, q: f"({s} / {n} + 3 * sqrt(greatest({q} / {n} - ({s} / {n}) * ({s} / {n}), 0)))"
    kept = "list_filter(coalesce(g.owners, []), lambda o: o <> n.uid AND (n.working IS NULL OR list_contains(n.working, o)))"
    return f"""RECURSIVE {STEPS}, {spacing},
cells AS MATERIALIZED ({cells}),
sums AS (SELECT "user" AS uid, {batch} AS batch, count(*) FILTER (WHERE dt > 0) AS n, coalesce(sum(dx) FILTER (WHERE dt > 0), 0) AS s, coalesce(sum(dx * dx) FILTER (WHERE dt > 0), 0) AS q, CASE WHEN count(*) > 1 THEN sum(dx) / count(*) END AS rate FROM steps GROUP BY ALL),
total AS (SELECT batch, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(rate) AS rate, count(rate) AS rates, count(*) AS members FROM sums GROUP BY batch),
folds AS MATERIALIZED (
  SELECT uid, batch, members, 0 AS fold, {limit(spread('a.n', 'a.s', 'a.q'))} AS separation, CASE WHEN a.rate > 0 THEN a.rate ELSE 1e-9::DOUBLE END AS rate FROM sums a JOIN total b USING (batch)
  UNION ALL SELECT uid, batch, members, 1, {limit(spread('(b.n - a.n)', '(b.s - a.s)', '(b.q - a.q)'))}, CASE WHEN b.rates > (a.rate IS NOT NULL)::INTEGER AND (b.rate - coalesce(a.rate, 0)) > 0 THEN (b.rate - coalesce(a.rate, 0)) / (b.rates - (a.rate IS NOT NULL)::INTEGER) ELSE 1e-9::DOUBLE END FROM sums a JOIN total b USING (batch)),
q AS MATERIALIZED (SELECT fold, precision, uid, batch, event_id, c, east AS x, north AS y, separation, rate, spacing, row_number() OVER (PARTITION BY fold, precision, uid ORDER BY ts, event_id) AS i FROM {sql_utm('points')} JOIN cells USING (lat, lon) JOIN folds ON uid = "user"),
m AS (
  SELECT fold, precision, uid, i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS STRUCT(c VARCHAR, x DOUBLE, y DOUBLE, way DOUBLE, n INTEGER)) AS past, {{'c': c, 'x': x, 'y': y, 'way': 0::DOUBLE, 'n': 1}} AS now, CAST(NULL AS VARCHAR) AS token FROM q WHERE i = 1
  UNION ALL
  SELECT fold, precision, uid, i, event_id, CASE WHEN act = 'same' THEN past WHEN act = 'bounce' THEN NULL WHEN act = 'drop' THEN past ELSE now END,
    CASE act WHEN 'same' THEN {{'c': c, 'x': x, 'y': y, 'way': now.way + step, 'n': now.n + 1}} WHEN 'bounce' THEN {{'c': c, 'x': x, 'y': y, 'way': past.way + sqrt(pow(past.x - x, 2) + pow(past.y - y, 2)), 'n': past.n + 1}} ELSE {{'c': c, 'x': x, 'y': y, 'way': 0::DOUBLE, 'n': 1}} END,
    CASE WHEN act = 'next' THEN now.c END
  FROM (SELECT *, CASE WHEN now.c = c THEN 'same' WHEN step >= separation OR (now.way <= spacing / 3 AND now.n <= spacing / (5 * rate)) THEN CASE WHEN past.c = c THEN 'bounce' ELSE 'drop' END ELSE 'next' END AS act
    FROM (SELECT m.fold, m.precision, m.uid, q.i, q.event_id, q.c, q.x, q.y, q.separation, q.rate, q.spacing, m.past, m.now, sqrt(pow(m.now.x - q.x, 2) + pow(m.now.y - q.y, 2)) AS step FROM m JOIN q ON q.fold = m.fold AND q.precision = m.precision AND q.uid = m.uid AND q.i = m.i + 1))),
learned AS (SELECT precision, uid, i, token FROM m WHERE fold = 0 AND token IS NOT NULL UNION ALL SELECT precision, uid, i + 1, now.c FROM m WHERE fold = 0 AND (m.precision, m.uid, m.i) IN (SELECT (precision, uid, max(i)) FROM q GROUP BY precision, uid)),
behind AS (SELECT precision, uid, token AS a, lag(token) OVER w AS b, lag(token, 2) OVER w AS c FROM learned WINDOW w AS (PARTITION BY precision, uid ORDER BY i)),
grams AS MATERIALIZED (SELECT precision, batch, run, list(DISTINCT uid) AS owners FROM (
  SELECT precision, uid, unnest(list_filter([a, b || '-' || a, c || '-' || b || '-' || a], lambda r: r IS NOT NULL)) AS run FROM behind) JOIN (SELECT uid, batch FROM sums) USING (uid) GROUP BY ALL),
given AS MATERIALIZED (SELECT precision, uid, batch, members, event_id, token, row_number() OVER (PARTITION BY precision, uid ORDER BY i) AS j FROM m JOIN (SELECT uid, batch, members FROM folds WHERE fold = 1) USING (uid) WHERE m.fold = 1 AND token IS NOT NULL),
d AS (
  SELECT precision, theta, uid, 0::BIGINT AS j, CAST([] AS VARCHAR[]) AS run, CAST(NULL AS BIGINT[]) AS working, 0 AS rd, 0 AS rl, 0 AS label, CAST(NULL AS BIGINT) AS event_id FROM (SELECT DISTINCT precision, uid FROM given), (VALUES {', '.join(f'({t}::DOUBLE)' for t in thetas)}) AS t(theta)
  UNION ALL
  SELECT precision, theta, uid, j, run, working, CASE WHEN full_ THEN 0 ELSE rd END, CASE WHEN full_ THEN 0 ELSE rl END, full_::INTEGER, event_id FROM (
    SELECT *, rd >= 3 OR rl >= 3 AS full_ FROM (
      SELECT precision, theta, uid, j, event_id, CASE WHEN NOT low THEN run WHEN loop_ THEN run[2:3] ELSE [] END AS run, CASE WHEN low THEN NULL ELSE kept END AS working, rd + (low AND NOT loop_)::INTEGER AS rd, rl + (low AND loop_)::INTEGER AS rl FROM (
        SELECT *, CASE WHEN held > 0 THEN len(kept) / held::DOUBLE ELSE 0 END < theta AS low, len(run) = 3 AND run[1] = run[3] AS loop_ FROM (
          SELECT n.precision, n.theta, n.uid, n.j, n.event_id, n.run, n.rd, n.rl, CASE WHEN n.working IS NULL THEN n.members - 1 ELSE len(n.working) END AS held, {kept} AS kept FROM (
            SELECT d.precision, d.theta, d.uid, s.j, s.event_id, s.batch, s.members, list_append(d.run, s.token)[greatest(1, len(d.run) - 1):len(d.run) + 1] AS run, d.working, d.rd, d.rl FROM d JOIN given s ON s.precision = d.precision AND s.uid = d.uid AND s.j = d.j + 1) n
          LEFT JOIN grams g ON g.precision = n.precision AND g.batch = n.batch AND g.run = array_to_string(n.run, '-')))))),
labels AS (SELECT precision, theta, uid, event_id FROM d WHERE label = 1)"""


@query(f"""WITH {_ibdd_loo_sql((LEVEL,), (0.1,), '0')} SELECT "user", p.event_id, CAST(l.event_id IS NOT NULL AS INTEGER) AS label FROM points p LEFT JOIN labels l USING (event_id)""")
def ibdd_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's points against the sequences of all other users."""
    p = points(spark, sf_dir)
    found = leave_one_out(p.withColumns({"uid": F.col("user"), "batch": F.lit(0)}), IbddParams(), [LEVEL], [0.1])
    hits = found.select(F.explode("event_ids").alias("event_id"), F.lit(1).alias("label"))
    return p.select("user", "event_id").join(hits, "event_id", "left").select("user", "event_id", F.coalesce("label", F.lit(0)).alias("label"))


#: A batch is the users of one nation (a user is the customer with that key), a trajectory a user's points. Every third user counts as anomalous from the fifth day of the own track on.
IBDD_LOO = f"""{_ibdd_loo_sql(LEVELS, THETAS, '(SELECT any_value(c_nationkey) FROM customer WHERE c_custkey = steps."user")')},
truth AS (SELECT "user" AS uid, any_value("user") % 3 = 0 AS anomalous, min(ts) + INTERVAL '5 days' AS onset FROM points GROUP BY 1),
params AS (SELECT * FROM (VALUES {', '.join(f'({level})' for level in LEVELS)}) AS a(precision), (VALUES {', '.join(f'({t}::DOUBLE)' for t in THETAS)}) AS b(threshold)),
hit AS (SELECT precision, theta AS threshold, uid, min(ts) AS first_ts FROM labels JOIN points USING (event_id) GROUP BY ALL),
timed AS (SELECT precision, threshold, batch, uid, anomalous, first_ts, (epoch_us(first_ts) - epoch_us(onset)) / 1000000.0::DOUBLE AS late FROM truth CROSS JOIN params JOIN (SELECT uid, batch FROM sums) USING (uid) LEFT JOIN hit USING (precision, threshold, uid)),
outcomes AS (SELECT precision, threshold, batch, uid, anomalous, first_ts IS NOT NULL AND NOT coalesce(anomalous AND late < 0, false) AS outcome, CASE WHEN anomalous AND late >= 0 THEN late END AS delay FROM timed),
confusion AS (SELECT precision, threshold, batch, count(*) FILTER (WHERE anomalous AND outcome) AS tp, count(*) FILTER (WHERE anomalous AND NOT outcome) AS fn, count(*) FILTER (WHERE NOT anomalous AND outcome) AS fp, count(*) FILTER (WHERE NOT anomalous AND NOT outcome) AS tn, median(delay) AS delay FROM outcomes GROUP BY ALL),
rated AS (SELECT *, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 ELSE 0 END AS auc, CASE WHEN tp + fp > 0 AND tn + fn > 0 THEN (tp / (tp + fp)::DOUBLE + tn / (tn + fn)::DOUBLE) / 2 ELSE 0 END AS auc_swapped FROM confusion)"""


def _ibdd_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user"), F.col("c_nationkey").alias("batch"))
    p = points(spark, sf_dir).join(nations, "user", "left").withColumn("uid", F.col("user"))
    truth = p.groupBy("uid").agg((F.first("user") % 3 == 0).alias("anomalous"), (F.min("ts") + F.expr("INTERVAL 5 DAYS")).alias("onset"))
    return ibdd_evaluate(p, truth, IbddParams(), list(LEVELS), list(THETAS))


@query(f"""WITH {IBDD_LOO} SELECT precision, threshold, batch, uid, anomalous, outcome, round(delay, 3) AS delay FROM outcomes""")
def ibdd_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out of the comparison detector: every user of every nation, three levels by three thetas."""
    return _ibdd_outcomes(spark, sf_dir).select("precision", "threshold", "batch", "uid", "anomalous", "outcome", F.round("delay", 3).alias("delay"))


@query(f"""WITH {IBDD_LOO} SELECT precision, threshold, batch, tp, fn, fp, tn, round(auc, 9) AS auc, round(auc_swapped, 9) AS auc_swapped, round(delay, 3) AS delay FROM rated""")
def ibdd_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = batch_rates(_ibdd_outcomes(spark, sf_dir))
    return r.select("precision", "threshold", "batch", "tp", "fn", "fp", "tn", F.round("auc", 9).alias("auc"), F.round("auc_swapped", 9).alias("auc_swapped"), F.round("delay", 3).alias("delay"))


@query(f"""WITH {IBDD_LOO} SELECT precision, threshold, round(median(auc), 9) AS median_auc, round(median(delay), 3) AS median_delay FROM rated GROUP BY ALL""")
def ibdd_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over the nations for each level and theta; sweep() also has the median fit and detect times, which no SQL can repeat."""
    r = sweep(batch_rates(_ibdd_outcomes(spark, sf_dir)), "precision", "threshold")
    return r.select("precision", "threshold", F.round("median_auc", 9).alias("median_auc"), F.round("median_delay", 3).alias("median_delay"))


@query(f"""WITH {TOKENS} SELECT "user", count(*) AS n_rows, count(DISTINCT geohash) AS n_cells FROM tokens GROUP BY "user" """)
def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy("user").agg(F.count("*").alias("n_rows"), F.countDistinct("geohash").alias("n_cells"))


def _digits_sql(code: str, chars: int, each: int, alphabet: str) -> str:
    """A base-4 code as characters of `each` digits."""
    value = " + ".join(f"{4 ** (each - 1 - d)} * CAST(substr({code}, i * {each} + {d + 1}, 1) AS INTEGER)" for d in range(each))
    return f"array_to_string(list_transform(range({chars}), lambda i: substr('{alphabet}', CAST(1 + {value} AS INTEGER), 1)), '')"


@query(f"""WITH {POINTS}, codes AS (SELECT lat, lon, {_hilbert_sql('lat', 'lon', 20)} AS c, {_hilbert_sql('lat', 'lon', 18)} AS d FROM (SELECT DISTINCT lat, lon FROM points))
SELECT lat, lon, c AS base_4, {_digits_sql('c', 10, 2, ALPHABETS[4])} AS base_16, {_digits_sql('d', 6, 3, ALPHABETS[6])} AS base_64 FROM codes""")
def cells_in_alphabets(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = points(spark, sf_dir).select("lat", "lon").distinct()
    return places.select("lat", "lon", *[encode(F.col("lat"), F.col("lon"), p, b).alias(f"base_{1 << b}") for p, b in ((20, 2), (10, 4), (6, 6))])
