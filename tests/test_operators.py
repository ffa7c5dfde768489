"""Trajectory operators on small inputs: golden example, models, batch against stream."""

import datetime as dt
import itertools
import json
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import alignment, geo
from waymark.operators import closed, compress, corridor, evaluate, fences, filters, ibdd, joins, legacy, motion, patterns, percentiles, scans, simulate, stays, tokens
from waymark.sources import batches, codecs, gpx, tables

T0 = dt.datetime(2024, 1, 1)
GOLDEN = [(55.0, 0), (55.0001, 10), (55.0002, 20), (55.002, 60), (55.0022, 90), (55.004, 130), (55.0041, 1000), (55.006, 1060), (55.008, 1061)]


def frame(spark, rows, user=1):
    """rows of (lat, lon, seconds)."""
    return spark.createDataFrame([(i, user, T0 + dt.timedelta(seconds=t), float(lat), float(lon)) for i, (lat, lon, t) in enumerate(rows)], "event_id long, user long, ts timestamp, lat double, lon double")


def test_golden_compression(spark):
    points = frame(spark, [(lat, 10.0, t) for lat, t in GOLDEN])
    got = compress.compress(points, compress.StreamParams(compat_speed=True)).orderBy("session", "traj", "ord").collect()
    start = T0.replace(tzinfo=dt.timezone.utc).timestamp()
    rows = [(round(r.lat, 6), r.ts - start, r.weight, round(r.dx, 1), r.dt, max(1, len(r.members))) for r in got]
    assert rows == [(55.0001, 20, 20, 0, 0, 3), (55.0021, 90, 30, 222.4, 70, 2), (55.004, 130, 0, 211.3, 40, 1), (55.0041, 1000, 0, 0, 0, 1), (55.006, 1060, 0, 211.3, 60, 1)]


def walk(seed, n=300):
    rng, t, lat, out = random.Random(seed), 0.0, 55.0, []
    for _ in range(n):
        t += rng.choice([5, 20, 40, 400])
        lat += rng.choice([0, 0.00005, 0.0005, 0.006])
        out.append((lat, 10.0, t))
    return out


def test_sessions_do_not_change_the_fold(spark):
    params = compress.StreamParams()
    for seed in range(3):
        rows = walk(seed)
        machine, want = compress.Machine(params), []
        start = T0.replace(tzinfo=dt.timezone.utc).timestamp()
        for p in rows:
            if done := machine.push(p[0], p[1], start + p[2]):
                want.append(done)
        want.append(machine.finish())
        got = compress.compress(frame(spark, rows), params).orderBy("session", "traj", "ord").collect()
        assert [(r.lat, r.ts, r.weight) for r in got] == [(p.lat, p.t, p.weight) for track in want for p in track]


def test_parameters():
    with pytest.raises(ValueError):
        compress.StreamParams(max_radius=-1)
    with pytest.raises(TypeError):
        compress.StreamParams(max_radius="wide")
    for wrong in ({"theta": 2}, {"separation": 0}, {"rate": -1}, {"max_rd": 0}):
        with pytest.raises(ValueError):
            ibdd.IbddParams(**wrong)
    for wrong in ({"threshold": 0}, {"threshold": 1.5}, {"window": "10 minutes"}, {"precision": 99}):
        with pytest.raises(ValueError):
            patterns.PatternParams(**wrong)


def stream_of(spark, tmp_path, df, build, name):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_stream_equals_batch_breakpoints(spark, tmp_path):
    from waymark.streaming.keyed import breakpoint_stream

    rng = random.Random(4)
    rows = [(i, i % 3, T0 + dt.timedelta(seconds=60 * i), rng.choice(["a", None, None, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, user long, ts timestamp, label string")
    want = {(r.user, r.start_ts.timestamp(), r.scan_ts.timestamp(), r.last_ts.timestamp()) for r in stays.breakpoints(df, 900).collect()}
    got = stream_of(spark, tmp_path, df, lambda s: breakpoint_stream(s, 900), "breaks")
    assert {(r.user, r.start_ts, r.scan_ts, r.last_ts) for r in got} == want and want


def test_stream_equals_batch_compression(spark, tmp_path):
    from waymark.streaming.keyed import compress_stream

    rows = walk(7, 120) + [(56.0, 10.0, 10**6)]
    batch = compress.compress(frame(spark, rows)).orderBy("ts").collect()[:-1]
    got = sorted(stream_of(spark, tmp_path, frame(spark, rows), compress_stream, "tracks"), key=lambda r: r.ts)
    got = [r for r in got if r.lat < 56]
    assert [(r.ts, r.lat) for r in got] == [(r.ts, r.lat) for r in batch]


def test_stream_scores(spark, tmp_path):
    from waymark.streaming.keyed import score_stream

    rows = [(i, 1, T0 + dt.timedelta(seconds=i), 1 - i / 10) for i in range(8)]
    df = spark.createDataFrame(rows, "event_id long, user long, ts timestamp, similarity double")
    want = {(r.event_id, round(r.anomaly_score, 9), r.anomaly) for r in tokens.anomaly(df, 0.4).collect()}
    assert {(r.event_id, round(r.anomaly_score, 9), r.anomaly) for r in stream_of(spark, tmp_path, df, lambda s: score_stream(s, 0.4), "scores")} == want


def test_trailing_window_is_left_open(spark):
    rows = frame(spark, [(55, 10, 0), (55, 10, 150), (55, 10, 180)]).withColumns({"geohash": F.col("event_id").cast("string"), "between": F.array().cast("array<string>")})
    got = {r.event_id: r.sequence for r in tokens.window_tokens(rows, "2.5T").collect()}
    assert got == {0: ["0"], 1: ["1"], 2: ["1", "2"]}


def test_support(spark):
    seqs = spark.createDataFrame([(list("1234"),), (list("12345"),), (list("2345"),)], "seq array<string>")
    runs = spark.createDataFrame([("a", list("123")), ("b", list("234"))], "run_id string, run array<string>")
    got = {r.run_id: r.support for r in tokens.support_fraction(seqs, runs).collect()}
    assert got == {"a": pytest.approx(2 / 3), "b": 1.0}


def held(a, b):
    rest = iter(b)
    return all(x in rest for x in a)


def plain_closed(seqs, least):
    every = {c for s in seqs for n in range(1, len(s) + 1) for c in itertools.combinations(s, n)}
    often = {p: n for p in every if (n := sum(held(p, s) for s in seqs)) >= least}
    return {(n, p) for p, n in often.items() if not any(m == n and len(q) > len(p) and held(p, q) for q, m in often.items())}


@pytest.mark.parametrize("deal_tokens", [4096, 5])
def test_closed_patterns_equal_brute_force(spark, deal_tokens):
    rng = random.Random(2)
    groups = {g: [[rng.choice("abcd") for _ in range(rng.randint(1, 8))] for _ in range(5)] for g in range(8)}
    groups[8] = [list("abc"), list("abd"), list("ab")]
    table = spark.createDataFrame([(g, s) for g, seqs in groups.items() for s in seqs], "user long, seq array<string>")
    for least in (1, 2, 3):
        want = {g: plain_closed(seqs, least) for g, seqs in groups.items()}
        got = closed.closed_patterns(table, "user", least, deal_tokens).collect()
        assert sorted((r.user, r.freq, tuple(r.seq)) for r in got) == sorted((g, n, p) for g, found in want.items() for n, p in found)
        best = [(g, min((-len(p), p) for _, p in want[g] if held(p, s))[1]) for g, seqs in groups.items() for s in seqs if any(held(p, s) for _, p in want[g])]
        covered = closed.covering_patterns(table, "user", least, deal_tokens).collect()
        assert {(r.user, tuple(r.seq)): r.freq for r in covered} == Counter(best)


def test_long_equal_sequences_are_mined_at_once(spark):
    rng = random.Random(3)
    for alphabet in (3, 50, 1000):
        seq = [rng.randrange(alphabet) for _ in range(1000)]
        began = time.perf_counter()
        found = list(closed.mine([seq, list(seq)], 2, sorted(set(seq))))
        assert found == [(seq, [0, 1])] and time.perf_counter() - began < 1


def test_no_frequent_pattern_is_an_error(spark):
    table = spark.createDataFrame([(1, ["a"]), (1, ["b"])], "user long, seq array<string>")
    with pytest.raises(ValueError):
        closed.extract_support(table, "user", 2)
    with pytest.raises(ValueError):
        closed.extract_support(table, "user", 3)
    assert closed.extract_support(table, "user", 1).count() == 2


def test_louvain_finds_two_cliques():
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 0.1)]
    of = stays.communities(edges)
    assert len({of[i] for i in range(5)}) == 1 and len({of[i] for i in range(10, 15)}) == 1 and of[0] != of[10]


def test_hull_and_clusters(spark):
    assert set(stays.convex_hull([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1)])) == {(0, 0), (2, 0), (2, 2), (0, 2)}
    rows = [(1, i, 55 + i * 1e-5, 10.0, 5.0) for i in range(4)] + [(1, 9, 56.0, 10.0, 5.0)]
    df = spark.createDataFrame(rows, "user long, id long, lat double, lon double, weight double")
    got = {r.id: r.cluster for r in stays.stay_clusters(df, 50).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}
    assert stays.stay_clusters(df, 50, singletons=False).count() == 4
    assert {r.id: r.cluster for r in stays.stay_clusters(df, 50, grouping=stays.connected).collect()} == got
    with pytest.raises(ValueError):
        stays.stay_clusters(df, 50, least=-1)
    assert stays.geofences(stays.stay_clusters(df, 50), 28.0).count() == 2


@pytest.mark.parametrize(("bins", "direct"), [(4096, 0), (64, 0), (4096, 1 << 17)])
def test_exact_percentiles_by_refining_histograms(spark, bins, direct):
    """Many groups, ties, one value, huge and tiny values; with 64 bins a round it takes more rounds."""
    rng = random.Random(7)
    groups = {"even": [rng.random() for _ in range(101)], "ties": [rng.choice([1.0, 2.0, 2.5]) for _ in range(60)], "one": [7.5], "two": [-1.0, 3.0], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-30, 300) for _ in range(50)], None: [5.0, 5.0], "same": [4.0] * 30, "ends": [-1.7e308, 0.0, 5e-324, 1.7e308]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    table = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {(r.g, r.share): r.value for r in percentiles.exact_percentiles(table, "v", shares, ["g"], bins, direct).collect()}
    want = {}
    for g, vs in groups.items():
        vs = sorted(vs)
        for s in shares:
            at = (len(vs) - 1) * s
            lo, hi = vs[math.floor(at)], vs[math.ceil(at)]
            want[g, s] = lo if lo == hi else (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi
    assert got == want
    assert percentiles.exact_percentiles(table, "v", [0.5], [], bins, direct).count() == 1 and percentiles.exact_percentiles(table.limit(0), "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        percentiles.exact_percentiles(table, "v", [50])


def test_radius_pairs_against_all(spark):
    rng = random.Random(1)
    rows = [(i, 55 + rng.random() * 0.01, 10 + rng.random() * 0.01) for i in range(150)]
    got = {(r.src, r.dst) for r in joins.radius_pairs(spark.createDataFrame(rows, "id long, lat double, lon double"), 60).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and compress.great_circle(*a[1:], *b[1:]) <= 60}
    assert got == want and want


@pytest.mark.parametrize("blocks", [4096, 16])
def test_radius_pairs_on_the_seam_the_poles_and_in_hot_cells(spark, blocks):
    """As brute force finds them; with blocks of 16 rows the cell with a third of all places is dealt over pairs of blocks."""
    rng = random.Random(4)
    far = [(i, rng.uniform(-0.0008, 0.0008), (180 + rng.uniform(-0.0008, 0.0008) + 180) % 360 - 180) for i in range(60)]
    far += [(100 + i, pole * (90 - rng.random() * 0.0008), rng.uniform(-180, 180)) for i in range(40) for pole in (1, -1) if (pole == 1) == (i % 2 == 0)]
    far += [(200 + i, 55 + rng.random() * 0.0002, 10 + rng.random() * 0.0002) for i in range(60)]
    far += [(300, 90.0, 0.0), (301, 90.0, 77.0), (302, -90.0, 0.0), (303, 0.0, 180.0), (304, 0.0, -180.0)]
    places = spark.createDataFrame(far, "id long, lat double, lon double")
    got = sorted((r.src, r.dst) for r in joins.radius_pairs(places, 60, block_rows=blocks).collect())
    want = sorted((a[0], b[0]) for a in far for b in far if a[0] < b[0] and compress.great_circle(*a[1:], *b[1:]) <= 60)
    assert got == want and (300, 301) in got and (303, 304) in got and sum(a >= 200 and b < 300 for a, b in got) > 1000


def test_radius_join_of_wide_and_of_no_distance(spark):
    rows = [(1, 10.0, 20.0), (2, 10.0, 20.0), (3, -10.0, -160.0), (4, 40.0, 100.0)]
    a = spark.createDataFrame(rows, "a_id long, a_lat double, a_lon double").withColumn("a_user", F.col("a_id") % 2)
    b = spark.createDataFrame(rows, "b_id long, b_lat double, b_lon double").withColumn("b_user", F.col("b_id") % 2)
    assert joins.radius_join(a, b, 30_000_000).count() == 16 and joins.radius_join(a, b, 30_000_000, by="user").count() == 8
    assert sorted((r.a_id, r.b_id) for r in joins.radius_join(a, b, 0).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 4)]


def test_filters(spark):
    p = frame(spark, [(55, 10, 0)])
    with pytest.raises(ValueError):
        filters.bounding_box(p, 1, 1, 2, 3)
    with pytest.raises(KeyError):
        filters.bounding_box(p.drop("lat"), 1, 2, 2, 3)
    with pytest.raises(ValueError):
        joins.append_checked(p, p, ["event_id"])
    with pytest.raises(KeyError):
        codecs.ingest(p, 1)
    assert filters.page(spark.range(10), 50, 4, [F.col("id")]).count() == 2
    noise = filters.is_noise(F.lit(55.0), F.lit(10.0), F.lit(55.01), F.lit(10.0), 500.0)
    assert spark.range(1).select(noise, filters.is_critical(F.lit(10.0), F.lit(1), 76.0, 1.0)).first() == (True, True)


def test_corridor(spark):
    a = frame(spark, [(55 + i * 1e-4, 10.0, i) for i in range(20)], 1)
    b = frame(spark, [(55 + i * 1e-4, 10.0 + (0.001 if i >= 12 else 0), i) for i in range(20)], 2).withColumn("event_id", F.col("event_id") + 100)
    got = {r.user: r.start for r in corridor.corridor_onset(a.unionByName(b)).collect()}
    assert got == {1: 13, 2: 12} or got == {1: 12, 2: 12}


def test_evaluation(spark):
    rows = spark.createDataFrame([(True, True)] * 3 + [(True, False)] + [(False, False)] * 4, "anomalous boolean, outcome boolean")
    r = evaluate.rates(rows).first()
    assert r.auc == pytest.approx((3 / 4 + 1) / 2) and r.auc_swapped == pytest.approx((1 + 4 / 5) / 2)
    every, some = (spark.createDataFrame([(k,) for k in ks], "uid string") for ks in ("uvw", "uv"))
    assert {(r.uid, r.test) for r in evaluate.train_test(some, every, spark.createDataFrame([("v",)], "uid string")).collect()} == {("u", False), ("v", True)}
    with pytest.raises(ValueError):
        evaluate.train_test(every, some, some)
    t = spark.createDataFrame([("u", True, T0), ("v", False, T0)], "uid string, anomalous boolean, onset timestamp")
    d = spark.createDataFrame([("u", T0 + dt.timedelta(seconds=30), True), ("u", T0, False)], "uid string, ts timestamp, anomaly boolean")
    assert {(r.uid, r.outcome, r.delay) for r in evaluate.delays(d, t).collect()} == {("u", True, 30.0), ("v", False, None)}


def test_detector_flags_deviation(spark):
    track = [(55 + i * 0.001, 10.0, i * 60) for i in range(12)]
    off = [(55 + i * 0.001, 10.0 + 0.002 * max(0, i - 4), i * 60) for i in range(12)]
    known = ibdd.fit(frame(spark, track, 2), ibdd.IbddParams()).withColumn("user", F.lit(2).cast("long")).select("user", "seq")
    same = ibdd.detect(frame(spark, track, 2), known, ibdd.IbddParams())
    far = ibdd.detect(frame(spark, off, 2), known, ibdd.IbddParams())
    assert same.agg(F.sum("label")).first()[0] == 0 and far.agg(F.sum("label")).first()[0] >= 1


def test_all_windows_at_once_equal_single_tables():
    rng = random.Random(9)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for n, letters in ((1, "a"), (7, "ab"), (25, "abc"), (40, "abcdefgh")):
        seq = [rng.choice(letters) for _ in range(n)]
        patterns = [[rng.choice(letters + "z") for _ in range(rng.randint(1, 12))] for _ in range(5)]
        spans = [(a, b) for a in range(n) for b in range(a + 1, n + 1)]
        starts, ends = (np.array(c) for c in zip(*spans))
        for some in (patterns[:1], patterns):
            assert alignment.best_lengths(seq, some, starts, ends).tolist() == [max(common(seq[a:b], p) for p in some) for a, b in spans]
    assert alignment.best_lengths(["a"], [], np.array([0]), np.array([1])).tolist() == [0]
    assert alignment.best_lengths(["a"], [[]], np.array([0]), np.array([1])).tolist() == [0]


@pytest.mark.parametrize("pack", [64, 2])
def test_window_scores_equal_scored_windows(spark, pack):
    """The same as scoring each window's own tokens, with patterns in one pack or several."""
    rng = random.Random(12)
    rows = [(100 * u + i, u, T0 + dt.timedelta(minutes=rng.choice([0, 1, 4]) + 3 * i), 55 + rng.randrange(4) * 0.001, 10.0) for u in range(4) for i in range(30)]
    points = spark.createDataFrame(rows, "event_id long, user long, ts timestamp, lat double, lon double")
    table = tokens.token_rows(points, 18, interpolate=False)
    seqs = tokens.sequences(table).withColumn("user", F.pmod(F.col("user") + 1, F.lit(3)))
    support = tokens.support_set(seqs, "user").withColumnRenamed("seq", "pattern")
    support = support.unionByName(support.withColumn("pattern", F.slice("pattern", 2, 5))).unionByName(support.withColumn("pattern", F.reverse("pattern")))
    want = {(r.event_id, round(r.similarity, 9)) for r in tokens.similarity(tokens.window_tokens(table, "12T"), support, "user").collect()}
    got = tokens.window_scores(table, support, "12T", "user", pack=pack)
    assert {(r.event_id, round(r.similarity, 9)) for r in got.collect()} == want and any(s == 0 for _, s in want) and any(0 < s for _, s in want)
    some = tokens.window_scores(table, support, "12T", "user", wanted=F.col("event_id") % 2 == 0).collect()
    assert {(r.event_id, round(r.similarity, 9)) for r in some} == {(e, s) for e, s in want if e % 2 == 0}


def test_detector_loops_and_deviations():
    """A run of three whose last cell is the first again is a loop and keeps two cells; any other unsupported run begins anew."""

    def labels(seqs, tokens, **params):
        d = ibdd.Detector(ibdd.IbddParams(**params), ibdd.Postings.of([list(s) for s in seqs]), 10.0, 1.0, 1.0)
        return [d.take(t) for t in tokens], d

    assert labels(["abcd"], "abqbrqz")[0] == [0, 0, 0, 0, 0, 1, 0]
    got, d = labels(["abc"] * 3, "abababa", max_rl=2)
    # a b a: unsupported, a loop, (b, a) stays; b a b: the second loop.
    assert got == [0, 0, 0, 1, 0, 1, 0] and d.tail == ["b", "a"] and d.rl == 1
    assert labels(["abc"] * 3, "abababa", max_rl=2, compat_loops=True)[0] == [0, 0, 0, 0, 0, 0, 1]
    assert labels(["abcx", "bcd"], "abcd", theta=0.6)[0] == [0, 0, 0, 0]
    assert labels(["abcde"] * 2, "abcde", last_three=False)[0] == [0] * 5


def test_postings_follow_runs_and_leave_one_out():
    index = ibdd.Postings.of([list("1234"), list("12345"), list("2345"), list("1212")])
    run = index.then(index.then(index.at("1"), "2"), "3")
    assert sorted(set((run >> 32).tolist())) == [0, 1] and len(index) == 4
    left = index.without(1)
    assert len(left) == 3 and (left.then(left.then(left.at("1"), "2"), "3") >> 32).tolist() == [0] and len(index.at("9")) == 0
    assert ((ibdd.Postings.of([list("1212")]).then(ibdd.Postings.of([list("1212")]).at("1"), "2")) & 0xFFFFFFFF).tolist() == [1, 3]


def test_comparison_detector_leaves_one_out(spark):
    """Each trajectory against all others of its batch, in one part or many, and detections before the onset count as none."""
    t0 = dt.datetime(2024, 1, 1)
    path = lambda bend: [(55 + i * 0.001, 10.0 + 0.002 * max(0, i - bend)) for i in range(14)]
    rows = [(100 * u + i, f"t{u}", u // 5, t0 + dt.timedelta(seconds=60 * i), lat, lon) for u in range(10) for i, (lat, lon) in enumerate(path(4 if u in (2, 7) else 99))]
    points = spark.createDataFrame(rows, "event_id long, uid string, batch int, ts timestamp, lat double, lon double")
    truth = spark.createDataFrame([(f"t{u}", u in (2, 7), t0 + dt.timedelta(seconds=60 * (3 if u == 2 else 13))) for u in range(10)], "uid string, anomalous boolean, onset timestamp")
    seen, params = [], ibdd.IbddParams(separation=400.0, rate=20.0)
    for size in (50_000, 20):
        found = ibdd.leave_one_out(points, params, [18, 19], [0.1, 0.5], part_points=size)
        seen.append(sorted((r.uid, r.precision, r.theta, tuple(r.event_ids)) for r in found.collect()))
        assert all(r.fit_time > 0 and r.detect_time > 0 for r in found.collect())
    assert seen[0] == seen[1] and len(seen[0]) == 40 and {u for u, _, _, e in seen[0] if e} == {"t2", "t7"}
    out = ibdd.evaluate(points, truth, params, [18], [0.1]).collect()
    by = {r.uid: r for r in out}
    assert by["t2"].outcome and by["t2"].delay > 0 and not by["t7"].outcome and by["t7"].delay is None and not by["t0"].outcome
    swept = evaluate.sweep(patterns.batch_rates(ibdd.evaluate(points, truth, params, [18], [0.1, 0.5])), "precision", "threshold").collect()
    assert len(swept) == 2 and all(r.median_fit_time > 0 and r.median_detect_time > 0 for r in swept)
    # With estimates of the others: parts of any size agree.
    a, b = ([sorted(map(repr, ((r.uid, r.event_ids) for r in ibdd.leave_one_out(points, ibdd.IbddParams(), [18], [0.1], part_points=n).collect())))] for n in (50_000, 20))
    assert a == b
    estimated = {r.uid: (r.separation, r.rate) for r in ibdd.fold_estimates(points.where("uid in ('t0', 't1', 't2')").withColumn("batch", F.lit(0))).collect()}
    steps = {r.uid: (r.separation, r.rate) for r in ibdd.estimates(points.where("uid in ('t1', 't2')").withColumn("user", F.lit(0)), "uid").collect()}
    assert estimated["t0"][1] == pytest.approx((steps["t1"][1] + steps["t2"][1]) / 2)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_fences_through_covers_equal_ring_tests(spark, broadcast_bytes):
    """Small, wide and overlapping rings, one across the seam, one that is no ring; points on both sides and in no fence."""
    rng = random.Random(8)

    def star(x, y, size, n=9):
        return [(x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * k / n), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]

    rings = [star(10.5, 50.2, 0.01), star(10, 50, 5.0), star(11, 51, 4.0), star(179.5, -20, 3.0), star(-179.9, 40, 2.0), [(0, 0), (1, 1)], [(-60, -30), (-50, -30), (-50, -20), (-60, -20)]]
    table = [(k, f"f{k}", [{"x": float(x), "y": float(y)} for x, y in r], *(float(f(v)) for v in (list(zip(*r))) for f in (min, max))) for k, r in enumerate(rings)]
    fences_of = spark.createDataFrame(table, "ord long, label string, ring array<struct<x:double,y:double>>, min_x double, max_x double, min_y double, max_y double")
    places = [(rng.uniform(*xs), rng.uniform(*ys)) for xs, ys in (((4, 16), (44, 56)), ((10.48, 10.52), (50.18, 50.22)), ((-180, 180), (-90, 90)), ((176, 180), (-24, -16)), ((-180, -176), (-24, 44)), ((-61, -49), (-31, -19))) for _ in range(120)]
    points = spark.createDataFrame([(i, lat, lon) for i, (lon, lat) in enumerate(places)], "event_id long, lat double, lon double").unionByName(spark.createDataFrame([(9999, None, None)], "event_id long, lat double, lon double"))

    def inside(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1

    want = {i: next((f"f{k}" for k, r in enumerate(rings) if len(r) > 2 and any(inside(r, lon + turn, lat) for turn in (-360, 0, 360))), None) for i, (lon, lat) in enumerate(places)}
    got = {r.event_id: r.label for r in fences.label_by_fence(points, fences_of, broadcast_bytes=broadcast_bytes).collect()}
    assert got == want | {9999: None} and len(set(want.values())) == 7
    cells = Counter(r.ord for r in fences.covers(fences_of).collect())
    assert max(cells.values()) <= fences.CELLS and cells[5] == 0 and min(cells[k] for k in (1, 2, 6)) > 10


def test_covers_have_inner_cells_inside():
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (5.0, 4.0), (0.0, 10.0)]
    found = fences.cover(ring, 200)
    assert 100 < len(found) <= 200 and any(i for *_, i in found)
    area = sum((360 / 2**z) ** 2 for z, _, _, i in found if i)
    assert 0.75 * 70 < area < 70 < sum((360 / 2**z) ** 2 for z, *_ in found)


def modularity(edges, of):
    total, inside, degree = 0, Counter(), Counter()
    for a, b, w in edges:
        total += 2 * w
        degree[of[a]] += w
        degree[of[b]] += w
        inside[of[a]] += 2 * w * (of[a] == of[b])
    return sum(inside[c] / total - (degree[c] / total) ** 2 for c in degree)


def test_merged_communities_are_as_good_as_local_moves(spark):
    """Cliques, a ring of cliques, planted groups, a path and a star, all in one run; the same whatever the order of the edges."""
    rng = random.Random(5)
    clique = lambda base, n: [(a, b, 10) for a in range(base, base + n) for b in range(a + 1, base + n)]
    graphs = {
        1: clique(0, 5) + clique(10, 5) + [(4, 10, 1)],
        2: [e for k in range(6) for e in clique(10 * k, 5)] + [(10 * k + 4, 10 * ((k + 1) % 6), 3) for k in range(6)],
        3: [(a, b, 5) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.8 if a // 10 == b // 10 else 0.03)],
        4: [(0, k, 2) for k in range(1, 9)],
        5: [(1, 2, 0), (2, 3, 0)],
    }
    rows = [(g, a, b, w) if rng.random() < 0.5 else (g, b, a, w) for g, edges in graphs.items() for a, b, w in edges] + [(1, 7, 7, 3)]
    runs = []
    for _ in range(2):
        rng.shuffle(rows)
        found = stays.merged_communities(spark.createDataFrame(rows, "user long, src long, dst long, weight long"), "user").collect()
        runs.append(sorted((r.user, r.node, r.community) for r in found))
    assert runs[0] == runs[1]
    for g, edges in graphs.items():
        of = {n: c for u, n, c in runs[0] if u == g}
        assert set(of) == {n for a, b, _ in edges for n in (a, b)} and all(of[c] == c and c <= n for n, c in of.items())
        if g in (1, 2, 3, 4):
            local = stays.communities([(a, b, float(w)) for a, b, w in edges])
            assert modularity(edges, of) >= modularity(edges, local) - 1e-9, g
    assert len({c for u, _, c in runs[0] if u == 1}) == 2 and {c for u, n, c in runs[0] if u == 5} == {1, 2, 3}


def test_simulation_and_batches(spark, tmp_path):
    places = [(55.36 + i * 0.002, 10.38 + i * 0.001) for i in range(7)]
    assert simulate.trajectory([simulate.WayPoint(*places[0], 60), simulate.WayPoint(*places[1])], 3) == simulate.trajectory([simulate.WayPoint(*places[0], 60), simulate.WayPoint(*places[1])], 3)
    with pytest.raises(ValueError):
        simulate.trajectory([simulate.WayPoint(1, 1)], 1)
    with pytest.raises(ValueError):
        simulate.WayPoint(1, 1, -1)
    picked = simulate.restless(300, 4, 1)
    assert all(a != b for a, b in zip(picked, picked[1:], strict=False)) and set(picked) == {0, 1, 2, 3} and simulate.restless(3, 2, 5) in ([0, 1, 0], [1, 0, 1])
    with pytest.raises(ValueError):
        simulate.restless(3, 1, 5)
    (tmp_path / "b.json").write_text(simulate.batch([3, 4], places))
    got = batches.read_batches(spark, str(tmp_path / "b.json"))
    assert {r.uid for r in got.select("uid").distinct().collect()} == {"t3", "t4"} and got.where("ts is null or latitude is null").count() == 0
    assert got.where("anomalous").select("uid").distinct().count() == sum(k % 3 != 0 for k in (3, 4))
    made = simulate.simulated(spark, 3, places, gap=600.0).collect()
    span = {u: (min(r.ts for r in made if r.uid == u), max(r.ts for r in made if r.uid == u)) for u in range(3)}
    assert all((span[u + 1][0] - span[u][1]).total_seconds() >= 600 for u in (0, 1))
    # Onsets follow from the track: none on the regular one, one on a loop, on a detour where it leaves the direct way.
    flags = {u: [r.ord for r in made if r.uid == u and r.anom_start] for u in range(3)}
    assert flags[0] == [] and len(flags[1]) == 1 and len(flags[2]) <= 1
    straight, detour = [(55.0 + k * 1e-4, 10.0, 5.0) for k in range(40)], [(55.0 + k * 1e-4, 10.0 + (0.002 if k >= 17 else 0), 5.0) for k in range(40)]
    assert simulate.onset(straight, [(55.0, 10.0), (55.004, 10.0)]) is None and simulate.onset(detour, [(55.0, 10.0), (55.004, 10.0)]) == 17
    assert sum(dt for *_, dt in simulate.stop(random.Random(1), simulate.WayPoint(55, 10, 300))) <= 300
    profiles = [simulate.Profile("home", (simulate.WayPoint(*places[0], 60), simulate.WayPoint(*places[1])), 2), simulate.Profile("lost", (simulate.WayPoint(*places[2]), simulate.WayPoint(*places[3], 60)), 1, True)]
    got = simulate.from_profiles(spark, profiles).groupBy("profile", "anomalous").agg(F.countDistinct("uid").alias("n")).collect()
    assert {tuple(r) for r in got} == {("home", False, 2), ("lost", True, 1)}
    json.loads(simulate.batch([1], places))


def test_gpx_round_trip(spark, tmp_path):
    p = frame(spark, [(55.0, 10.0, 0), (55.1, 10.1, 30)])
    gpx.write_gpx(p, str(tmp_path / "x"))
    got = gpx.gpx_points(spark, str(tmp_path / "x")).collect()
    assert [(r.lat, r.lon) for r in got] == [(55.0, 10.0), (55.1, 10.1)] and got[1].ts == T0 + dt.timedelta(seconds=30)


def test_codecs_and_tables(spark, tmp_path):
    p = frame(spark, [(55.0, 10.0, 0), (55.1, 10.1, 30)])
    doc = p.select(codecs.point_json({"latitude": F.col("lat"), "longitude": F.col("lon"), "external_timestamp": F.col("ts"), "weight": F.lit(2.0)}).alias("d"))
    back = doc.select(codecs.read_point(F.col("d")).alias("p")).select("p.latitude", "p.external_timestamp", "p.magnetometer_data").collect()
    assert [tuple(r) for r in back] == [(55.0, T0, None), (55.1, T0 + dt.timedelta(seconds=30), None)]
    heads = tables.trajectory_headers(compress.compress(p))
    tables.save(heads, str(tmp_path / "t"), ["user"])
    tables.replace(heads, str(tmp_path / "t"), ["user"])
    assert tables.load(spark, str(tmp_path / "t"), user=1).count() == heads.count() == tables.newest_first(heads, 1).count()


def test_older_smoothing_is_the_four_state_filter(spark):
    """The scalars of the older filter against its matrices."""
    import numpy as np

    rng = random.Random(3)
    rows = [(1, 0, k, float(k * k), 55 + k * 1e-4 + rng.gauss(0, 1e-4), 10 - k * 2e-4) for k in range(12)]
    got = legacy.kalman(spark.createDataFrame(rows, "user long, track int, ord int, ts double, lat double, lon double"), legacy.OLDER).orderBy("ord").collect()
    x, p, q, wait = np.zeros(4), np.eye(4) * 1e12, np.diag([1e-6, 1e-6, 1.0, 1.0]), 1.0
    seen = np.eye(2, 4)
    for k, r in enumerate(rows):
        move = np.eye(4)
        move[0, 2] = move[1, 3] = 0.001 * wait
        x, p = move @ x, move @ p @ move.T + q
        gain = p @ seen.T @ np.linalg.inv(seen @ p @ seen.T + np.eye(2) * 1e-5)
        x, p = x + gain @ (np.array(r[4:6]) * 1000 - seen @ x), (np.eye(4) - gain @ seen) @ p
        wait = r[3] - rows[k - 1][3] if k else 0.0
        assert (got[k].lat, got[k].lon) == (pytest.approx(x[0] / 1000, abs=1e-7), pytest.approx(x[1] / 1000, abs=1e-7))


def test_kalman_smooths_and_restarts(spark):
    rng = random.Random(2)
    rows = [(1, k // 20, k, float(k), 55 + k * 1e-4 + rng.gauss(0, 1e-4), 10.0) for k in range(40)]
    df = spark.createDataFrame(rows, "user long, track int, ord int, ts double, lat double, lon double")
    got = {r.ord: r.lat for r in legacy.kalman(df).collect()}
    assert got[0] == rows[0][4] and got[20] == rows[20][4] and len(got) == 40


def test_map_matching(spark):
    triples = spark.createDataFrame([(1, "a", "b", "c")], "id long, a string, b string, c string")
    routes = [("a", "b", k, float(k), 0.0 if k < 3 else 1.0, 4.0) for k in range(4)] + [("a", "c", k, float(k), 0.0, 6.0) for k in range(6)]
    got = legacy.overlapping_vertices(triples, spark.createDataFrame(routes, "src string, dst string, ord int, x double, y double, length double"), 1e-5)
    assert sorted(r.ord for r in got.collect()) == [0, 1, 2]


def test_motion_zero_dt(spark):
    got = motion.motion(frame(spark, [(55, 10, 0), (55.1, 10, 0)])).orderBy("event_id").collect()
    assert got[1].dt == 0 and got[1].speed == 0 and got[1].dx > 11_000


@pytest.mark.parametrize("block_rows", [1 << 16, 40])
def test_blocked_scans_equal_whole_ones(spark, block_rows):
    """One user with half of all rows, ties in time across borders, nulls; blocks hold no more than a share."""
    rng = random.Random(4)
    rows = [(i, 0 if rng.random() < 0.5 else rng.randrange(1, 9), T0 + dt.timedelta(seconds=rng.choice([0, 5, 5, 60]) + 7 * (i // 3)), 55 + rng.random() * 0.01, 10 + rng.random() * 0.01, None if rng.random() < 0.3 else rng.randrange(100)) for i in range(900)]
    points = spark.createDataFrame(rows, "event_id long, user long, ts timestamp, lat double, lon double, value int")
    found = scans.hot_motion(points, block_rows=block_rows)
    want = {r.event_id: (round(r.dx, 6), r.dt, round(r.speed, 6), round(r.acceleration, 6)) for r in motion.motion(points).collect()}
    got = found.collect()
    assert {r.event_id: (round(r.dx, 6), r.dt, round(r.speed, 6), round(r.acceleration, 6)) for r in got} == want
    sizes = Counter((r.user, r._block) for r in got if r._block is not None)
    assert (len(sizes) > 8 and max(sizes.values()) < 120) if block_rows == 40 else not sizes
    run = motion.by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = points.select("event_id", F.sum("value").over(run).alias("s"), F.min("value").over(run).alias("m"), F.last("value", True).over(run).alias("l"), F.lag("value").over(motion.by_time()).alias("p"))
    each = scans.scanned(scans.blocked(points, "user", block_rows=block_rows), scans.Scan({"p": "value"}, {"s": F.col("value")}, {"m": F.col("value")}, {"l": F.col("value")}), "user")
    assert sorted(map(repr, ((r.event_id, r.s, r.m, r.l, r.p) for r in each.collect()))) == sorted(map(repr, ((r.event_id, r.s, r.m, r.l, r.p) for r in plain.collect())))


def test_polylines_of_tracks_and_the_known_line(spark):
    rows = spark.createDataFrame([([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)],), ([],), ([(0.0, 0.0), (-0.00001, 179.99999), (0.0, -180.0)],)], "p array<struct<lat:double,lon:double>>")
    got = rows.select("p", geo.polyline_encoded(F.col("p"), 1e-5).alias("line"), geo.polyline_points(geo.polyline_encoded(F.col("p"), 1e-5), 1e-5).alias("back")).collect()
    assert got[0].line == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and got[1].line == ""
    for r in got:
        assert [(round(b.lat, 5), round(b.lon, 5)) for b in r.back] == [(p.lat, p.lon) for p in r.p]


def test_places_in_a_whole_order(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.choice(["b", "A", "a", "C", None])) for i in range(500)], "k long, s string").repartition(7)
    got = sorted((r.place, r.s, r.k) for r in filters.numbered(rows, [F.collate("s", "UNICODE_CI"), F.col("k")]).collect())
    assert [p for p, *_ in got] == list(range(1, 501))
    assert [(s, k) for _, s, k in got] == sorted(((s, k) for _, s, k in got), key=lambda r: (r[0] is not None, (r[0] or "").lower(), r[1]))


def test_an_empty_queue_and_a_trajectory_without_a_user_are_errors(spark):
    none = frame(spark, [(55, 10, 0)]).limit(0)
    with pytest.raises(ValueError):
        compress.compress_queue(none)
    assert compress.compress_queue(frame(spark, [(55, 10, 0)])).count() == 1
    homeless = frame(spark, [(55, 10, 0)]).withColumn("user", F.lit(None).cast("long"))
    with pytest.raises(Exception, match="needs a user"):
        codecs.trajectory_json(homeless).collect()


def test_device_motion_and_magnetometer_come_back(spark):
    at = F.lit(T0).cast("timestamp")
    motion_ = F.struct(F.lit(0.5).alias("x"), F.lit(-1.0).alias("y"), F.lit(9.8).alias("z"), at.alias("external_timestamp"))
    magnet = F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(2.0).alias("z"), F.lit(3.0).alias("magnitude"), at.alias("internal_timestamp"))
    made = spark.range(2).select("id", codecs.point_json({"latitude": F.lit(55.0), "longitude": F.lit(10.0), "device_motion_data": F.when(F.col("id") == 0, motion_), "magnetometer_data": F.when(F.col("id") == 1, magnet)}).alias("d"))
    got = {r.id: r.p for r in made.select("id", codecs.read_point(F.col("d")).alias("p")).collect()}
    assert tuple(got[0].device_motion_data) == (0.5, -1.0, 9.8, T0) and got[0].magnetometer_data is None
    assert tuple(got[1].magnetometer_data) == (1.0, 2.0, 2.0, 3.0, T0) and got[1].device_motion_data is None


def test_counts_of_runs_say_what_the_detector_says():
    """Labels from owner counts and intersections equal those of the detector on whole postings; no owners are asked for where counts say all."""
    rng = random.Random(11)
    asked = 0
    for case in range(60):
        cells = "abcdefgh"[: rng.randint(2, 8)]
        seqs = [[rng.choice(cells) for _ in range(rng.randint(1, 40))] for _ in range(rng.randint(2, 30))]
        holders = {}
        for k, seq in enumerate(seqs):
            for n in (1, 2, 3):
                for run in set(ibdd._ending(seq, n)) - {""}:
                    holders.setdefault(run, []).append(k)
        for own, theta in itertools.product(range(2), (0.0, 0.05, 0.2, 0.7)):
            params = ibdd.IbddParams(theta=theta, compat_loops=case % 5 == 0)
            tokens = [rng.choice(cells) for _ in range(30)]
            counts = [[len([h for h in holders.get(r, []) if h != own]) for r in ibdd._ending(tokens, n)] for n in (1, 2, 3)]
            owners = ibdd.Owners({r: np.array(h, np.int64) for r, h in holders.items()})
            d = ibdd.Detector(params, ibdd.Postings.of(seqs).without(own), 10.0, 1.0, 1.0)
            assert ibdd.marked(tokens, counts, len(seqs), own, owners, params) == [j for j, t in enumerate(tokens) if d.take(t)]
            asked += owners.number
    assert asked > 100
    many = [[len(tokens) * 1000] * len(tokens), [10] * len(tokens), [0] * len(tokens)]
    owners = ibdd.Owners({})
    ibdd.marked(tokens, many, 100_000, 0, owners, ibdd.IbddParams())
    assert owners.number == 0


def test_stored_tables_by_many_values(spark, tmp_path):
    """Folders do not grow with the values; values that share a folder are cleared and replaced one by one."""
    path = str(tmp_path / "t")
    rows = spark.range(3000).selectExpr("id % 1000 AS user", "id AS n").repartition(6)
    tables.save(rows, path, ["user"], rows_a_file=50)
    files = list((tmp_path / "t").glob("*/*.parquet"))
    assert len({f.parent for f in files}) <= tables.BUCKETS and len(files) <= 2 * tables.BUCKETS
    assert sorted(r.n for r in tables.load(spark, path, user=7).collect()) == [7, 1007, 2007] and tables.load(spark, path).columns == ["user", "n"]
    tables.clear(spark, path, "user", [1, 2])
    tables.replace(spark.createDataFrame([(3, -1), (5000, -2)], "user long, n long"), path, ["user"])
    left = sorted(tuple(r) for r in tables.load(spark, path).collect())
    assert left == sorted([(3, -1), (5000, -2), *((i % 1000, i) for i in range(3000) if i % 1000 not in (1, 2, 3))])


def test_batches_longer_than_a_json_string(spark, tmp_path):
    """A frame with more characters than a parser takes by default is read whole."""
    n = 550_000
    inner = json.dumps({"columns": ["latitude", "longitude", "uid", "anom_start"], "index": list(range(n)), "data": [[55.36, 10.38, "u1", False]] * n})
    outer = json.dumps({"columns": ["df", "uid", "anomalous"], "index": [0], "data": [[inner, "u1", True]]})
    assert len(outer) > 20_000_000
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "0.json").write_text(json.dumps([outer]))
    assert batches.read_batches(spark, str(tmp_path / "b")).count() == n


def test_ways_are_walked_once(spark, monkeypatch):
    """Cells between neighbours come from a table of distinct ways, not from every row."""
    seen = []
    monkeypatch.setattr(tokens, "staged", lambda rows, name: seen.append((name, rows.count())) or rows)
    track = frame(spark, [(55.0 + 0.01 * (i % 2), 10.0, 10 * i) for i in range(200)])
    rows = tokens.token_rows(track, 18, interpolate=True)
    assert seen == [("ways", 2)]
    found = rows.orderBy("ts").collect()
    assert [r.between for r in found[:1]] == [[]] and len({tuple(r.between) for r in found[1:]}) == 2 and found[1].between == found[2].between[::-1] != []


def test_fold_sizes_are_those_of_the_pairs(spark):
    for users in ([4, 7, 9, 4, None], [5], [3, 8]):
        uids = spark.createDataFrame([(u,) for u in users], "uid long")
        want = evaluate.folds(uids).groupBy("test").agg(F.count("*").alias("n"), F.min("train").alias("least"))
        assert sorted(map(tuple, evaluate.fold_sizes(uids).collect())) == sorted(map(tuple, want.collect()))


def test_short_sequences_are_aligned_side_by_side(monkeypatch):
    """Many sequences with their own ranges of patterns at a time give what each gives by itself; only long ones are walked by themselves."""
    rng = random.Random(4)
    lists = lambda xs: alignment.Lists(np.array([t for x in xs for t in x], np.int64), np.concatenate([[0], np.cumsum([len(x) for x in xs], dtype=np.int64)]))
    walk, walked = alignment.window_table, []
    monkeypatch.setattr(alignment, "window_table", lambda s, p: walked.append(len(s)) or walk(s, p))
    monkeypatch.setattr(alignment, "BLOCK", 500)
    seqs = [[rng.randrange(5) for _ in range(n)] for n in (0, 1, 2, 3, 3, 5, 9, 40, alignment.SHORT + 6)]
    patterns = [[rng.randrange(6) for _ in range(rng.randrange(13))] for _ in range(20)] + seqs[:8]
    spans = [[tuple(sorted(rng.sample(range(len(s) + 1), 2))) for _ in range(5)] if s else [] for s in seqs]
    firsts, counts = np.array([20, 0, 20, 20, 0, 15, 20, 3, 1]), np.array([8, 28, 8, 4, 0, 13, 8, 25, 19])
    once = np.array([rng.random() < 0.5 for _ in patterns])
    for only in (None, once):
        got = alignment.batch_lengths(lists(seqs), lists(patterns), lists([[a for a, _ in w] for w in spans]), np.array([b for w in spans for _, b in w]), firsts, counts, only)
        assert set(walked) == {alignment.SHORT + 6}
        want = []
        for s, f, c, w in zip(seqs, firsts, counts, spans, strict=True):
            mine = [p for p, o in zip(patterns[f : f + c], once[f : f + c], strict=True) if not (only is not None and o and p == s)]
            want += alignment.best_lengths(s, mine, *(np.array(x) for x in zip(*w, strict=True))).tolist() if w else []
        assert got.tolist() == want
        walked.clear()


def test_points_are_encoded_once_for_all_levels(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, i % 3, T0 + dt.timedelta(minutes=i), rng.uniform(54.9, 55.1) if i % 7 else 90.0, rng.choice([-180.0, 180.0, 10.0, 10.0003])) for i in range(120)]
    points = spark.createDataFrame(rows, "event_id long, user long, ts timestamp, lat double, lon double")
    each = {(p, r.event_id, r.geohash) for p in (0, 7, 12, 20) for r in tokens.token_rows(points, p, interpolate=False).collect()}
    encode, asked = tokens.encode, []
    monkeypatch.setattr(tokens, "encode", lambda *a: asked.append(a) or encode(*a))
    got = tokens.token_rows(points, [7, 20, 0, 12], interpolate=False)
    assert {(r.precision, r.event_id, r.geohash) for r in got.collect()} == each and len(asked) == 1


def test_lines_through_cells_that_are_decoded_once(spark, monkeypatch):
    """Lines of several trajectories, across a zone's border in the zone of the first cell; one cell alone is no line."""
    decode, asked = tokens.decode, []
    monkeypatch.setattr(tokens, "decode", lambda *a: asked.append(a) or decode(*a))
    rows = [(u, i, T0 + dt.timedelta(minutes=-i if u == 2 else i), 55.0 + 0.01 * (i % 3), 11.98 + 0.01 * i) for u in (1, 2) for i in range(5)] + [(3, 9, T0, 55.0, 11.98)]
    points = spark.createDataFrame(rows, "user long, event_id long, ts timestamp, lat double, lon double")
    table = tokens.token_rows(points, 18, interpolate=False)
    got = {r.user: [(p.x, p.y) for p in r.line] for r in tokens.lines(table, tokens.cell_centres(table)).collect()}
    at = {(r.user, r.event_id): r for r in table.withColumn("at", decode(F.col("geohash"))).collect()}
    assert set(got) == {1, 2} and len(asked) == 1
    for user, order in ((1, range(5)), (2, range(4, -1, -1))):
        centres = [at[user, i]["at"] for i in order]
        want = spark.createDataFrame([(k, c.lat, c.lon) for k, c in enumerate(centres)], "k int, lat double, lon double")
        zone = int((centres[0].lon + 180) // 6) + 1
        want = want.select("k", *geo.to_utm(F.col("lat"), F.col("lon"), zone)).orderBy("k").collect()
        assert got[user] == [pytest.approx((r[1], r[2])) for r in want]


@pytest.mark.parametrize("deal_tokens", [4096, 3])
def test_many_small_groups_are_mined_in_batches(spark, deal_tokens):
    """Groups whose tokens have different orders and that share some; none of them is a pandas group of its own."""
    rng = random.Random(8)
    groups = {f"g{g}": [[f"{rng.choice('abc')}{g % 5}" for _ in range(rng.randint(0, 5))] for _ in range(4)] for g in range(60)}
    table = spark.createDataFrame([(g, s) for g, seqs in groups.items() for s in seqs], "user string, seq array<string>")
    want = {(g, n, tuple(p)) for g, seqs in groups.items() for n, p in plain_closed(seqs, 2)}
    got = closed.closed_patterns(table, "user", 2, deal_tokens)
    assert {(r.user, r.freq, tuple(r.seq)) for r in got.collect()} == want
    covered = closed.covering_patterns(table, "user", 2, deal_tokens)
    best = Counter((g, min((-len(p), tuple(p)) for h, _, p in want if h == g and held(p, s))[1]) for g, seqs in groups.items() for s in seqs if any(h == g and held(p, s) for h, _, p in want))
    assert {(r.user, tuple(r.seq)): r.freq for r in covered.collect()} == best
    assert not any("FlatMapGroupsInPandas" in t._jdf.queryExecution().executedPlan().toString() for t in (got, covered))
