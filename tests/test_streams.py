"""Streams in several batches against their batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators import ibdd, stays, tokens
from waymark.operators.compress import StreamParams, compress
from waymark.sources.tables import into_documents, into_table
from waymark.streaming import chained, keyed

T0 = dt.datetime(2024, 1, 1)
POINTS = "event_id long, user long, ts timestamp, lat double, lon double"


def track(seed, n=60):
    rng, rows = random.Random(seed), []
    for user in (1, 2):
        lat, lon, t = 55.0, 10.0, 0
        for k in range(n):
            t += rng.choice([20, 60, 200])
            lat, lon = lat + rng.choice([0, 0, 0.0009, 0.003]), lon + rng.choice([0, 0.0008])
            rows.append((user * 1000 + k, user, T0 + dt.timedelta(seconds=t), lat, lon))
    return rows


def in_batches(spark, tmp_path, rows, schema, build, name, parts=3):
    """The rows as so many files, one file a batch."""
    source = str(tmp_path / f"{name}-in")
    size = -(-len(rows) // parts)
    for k in range(parts):
        # Files are read in order of their times.
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return spark.table(name).collect()


def by_time(rows):
    return sorted(rows, key=lambda r: (r[2], r[0]))


def test_cells_and_window_scores(spark, tmp_path):
    rows = by_time(track(3))
    frame = spark.createDataFrame(rows, POINTS)
    batch = tokens.token_rows(frame, 19)
    got = in_batches(spark, tmp_path, rows, POINTS, lambda s: keyed.cell_stream(s, 19), "cells")
    want = {(r.event_id, r.geohash, tuple(r.between)) for r in batch.collect()}
    assert {(r.event_id, r.geohash, tuple(r.between)) for r in got} == want and any(b for *_, b in want)

    known = tokens.sequences(tokens.token_rows(spark.createDataFrame(track(4), POINTS), 19)).select("user", F.col("seq").alias("pattern"), F.lit(1).alias("freq"))
    windows = tokens.window_tokens(batch, "10T")
    want = {(r.event_id, round(r.similarity, 9), round(r.anomaly_score, 9), r.anomaly) for r in tokens.anomaly(tokens.similarity(windows, known, "user"), 0.5).collect()}
    made = [(r.event_id, r.user, r.t, r.geohash, r.between) for r in sorted(got, key=lambda r: (r.t, r.event_id))]
    schema = "event_id long, user long, t double, geohash string, between array<string>"
    scored = in_batches(spark, tmp_path, made, schema, lambda s: keyed.window_score_stream(s, known, "10T", 0.5), "window_scores")
    assert {(r.event_id, round(r.similarity, 9), round(r.anomaly_score, 9), r.anomaly) for r in scored} == want
    with pytest.raises(ValueError):
        keyed.window_score_stream(frame, known, "10T", 0.5, most_bytes=10)


def test_repeated_times_are_refused(spark, tmp_path):
    rows = [(1, 1, T0, 55.0, 10.0), (2, 1, T0 + dt.timedelta(seconds=5), 55.1, 10.0), (3, 1, T0 + dt.timedelta(seconds=5), 55.2, 10.0), (4, 1, T0 + dt.timedelta(seconds=9), 55.3, 10.0)]
    got = in_batches(spark, tmp_path, rows, POINTS, lambda s: keyed.cell_stream(s, 19, interpolate=False), "refused", 2)
    # The second batch begins at the time of the last row.
    assert sorted(r.event_id for r in got) == [1, 2]


def test_detector(spark, tmp_path):
    params = ibdd.IbddParams(precision=19, separation=400.0, rate=20.0)
    known = [list(r.seq) for r in ibdd.fit(spark.createDataFrame(track(5), POINTS), params).collect()]
    rows = by_time(track(6) + [(3000 + k, 3, T0 + dt.timedelta(seconds=40 * k), 55.0 - 0.001 * k, 10.0) for k in range(40)])
    frame = spark.createDataFrame(rows, POINTS)
    supports = spark.createDataFrame([(user, s) for user in (1, 2, 3) for s in known], "user long, seq array<string>")
    want = {(r.event_id, r.label) for r in ibdd.detect(frame, supports, params).collect()}
    got = in_batches(spark, tmp_path, rows, POINTS, lambda s: keyed.detector_stream(s, known, params), "detector")
    assert {(r.event_id, r.label) for r in got} == want and {label for _, label in want} == {0, 1}
    with pytest.raises(ValueError):
        keyed.detector_stream(frame, known, ibdd.IbddParams())


def test_queue_commands(spark, tmp_path):
    said = [("a", "rpush", "x"), ("a", "rpush", "y"), ("b", "set", "1"), ("a", "llen", None), ("a", "rpush", "z"), ("a", "lrange", "-2 -1"), ("b", "get", None), ("a", "lpop", None), ("a", "rpop", None), ("a", "lrange", "0 5"), ("b", "delete", None), ("b", "get", None), ("a", "lpop", None), ("a", "lpop", None)]
    rows = [(k, i, c, arg) for i, (k, c, arg) in enumerate(said)]
    got = in_batches(spark, tmp_path, rows, "key string, seq long, command string, arg string", lambda s: keyed.queue_stream(s), "queue", 4)
    assert [r.answer for r in sorted(got, key=lambda r: r.seq)] == ["1", "2", None, "2", "3", "y,z", "1", "x", "z", "y", None, None, "y", None]


def test_values_expire(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "key string, seq long, command string, arg string"
    made = []
    for k, command in enumerate((("set", "1"), ("get", None))):
        spark.createDataFrame([("a", k, *command)], schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        q = keyed.queue_stream(stream, 0.001).writeStream.foreachBatch(lambda rows, _: made.extend(rows.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert [r.answer for r in sorted(made, key=lambda r: r.seq)] == [None, None]


def test_sinks_replace_a_batch_that_runs_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "user long, v string")
    sink, documents = into_table(str(tmp_path / "t"), ["user"]), into_documents(str(tmp_path / "d"))
    for number in (0, 0, 1):
        sink(rows, number)
        documents(rows, number)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert spark.read.text(str(tmp_path / "d")).where("value = '{\"user\":1,\"v\":\"a\"}'").count() == 2


def later(user, seconds, event_id=90_000):
    """A point of another user that moves event time on."""
    return (event_id, user, T0 + dt.timedelta(seconds=seconds), 10.0, 10.0)


def test_points_to_scores_in_one_stream(spark, tmp_path):
    """Two stateful stages in one query: forwarded points and markers, cells, scores; as the batch forms give them trajectory by trajectory."""
    rows = by_time(track(11, 40))
    far = [(5000 + k, 1, rows[-1][2] + dt.timedelta(seconds=2000 + 60 * k), 55.5 + 0.001 * k, 10.0) for k in range(8)]
    rows = by_time(rows + far)
    params, whole = StreamParams(separation_time=150), spark.createDataFrame(rows, POINTS)
    done = compress(whole, params)
    batch = done.select(F.concat_ws("|", "user", "session", "traj").alias("uid"), "user", F.col("ord").cast("long").alias("event_id"), F.timestamp_seconds("ts").alias("ts"), "lat", "lon")
    table = tokens.token_rows(batch, 18, "uid", interpolate=False)
    known = tokens.sequences(table, ["uid", "user"]).where("size(seq) > 2").select("user", F.slice("seq", 1, 3).alias("pattern"), F.lit(1).alias("freq")).distinct()
    scored = tokens.anomaly(tokens.window_scores(table, known, "10T", "user", "uid"), 0.5, "uid").collect()
    want = {(r.user, r.ts, r.geohash, round(r.similarity, 9), round(r.anomaly_score, 9), r.anomaly) for r in scored}
    assert len({r.uid for r in scored}) > 4 and any(r.anomaly for r in scored)
    # The last file moves event time on, so that silence ends what is open.
    quiet = [later(9, 10**6), later(9, 2 * 10**6, 90_001), later(9, 3 * 10**6, 90_002)]
    got = in_batches(spark, tmp_path, rows + quiet, POINTS, lambda s: chained.scored_trajectories(chained.forward_stream(s, params, "1 minute"), known, 18, "10T", 0.5), "chain", 5)
    assert {(r.user, r.ts, r.geohash, round(r.similarity, 9), round(r.anomaly_score, 9), r.anomaly) for r in got if r.user != 9} == want


def test_forwarded_points_markers_and_control_rows(spark, tmp_path):
    rows = by_time(track(12, 40))
    params = StreamParams(separation_time=150)
    done = compress(spark.createDataFrame(rows, POINTS), params).collect()
    want = sorted((r.user, round(r.ts, 3), round(r.lat, 9), round(r.weight, 3)) for r in done)
    quiet = [later(9, 10**6), later(9, 2 * 10**6, 90_001)]
    build = lambda s: chained.forward_stream(s, params, "1 minute")
    got = [r for r in in_batches(spark, tmp_path, rows + quiet, POINTS, build, "forward", 6) if r.user != 9]
    seconds = lambda r: r.ts.timestamp()
    assert sorted((r.user, round(seconds(r), 3), round(r.lat, 9), round(r.weight, 3)) for r in got if not r.ended) == want
    ends = [(r.user, r.traj, r.ord) for r in got if r.ended]
    each = {(r.user, r.traj): r.ord + 1 for r in sorted((r for r in got if not r.ended), key=lambda r: r.ord)}
    assert {(u, t): n for u, t, n in ends} == each and len(ends) == len(set(ends))
    # A row without a place forgets what is open: nothing of the first ten points of user 1 comes out but what was handed on before.
    cut = [r for r in rows if r[1] == 1][:10]
    clear = (80_000, 1, cut[-1][2] + dt.timedelta(seconds=1), None, None)
    after = [(81_000 + k, 1, cut[-1][2] + dt.timedelta(seconds=60 * (k + 1)), 56 + 0.002 * k, 10.0) for k in range(5)]
    got = in_batches(spark, tmp_path, [*cut, clear, *after, *quiet], POINTS, build, "cleared", 2)
    own = [r for r in got if r.user == 1]
    assert {r.traj for r in own if r.lat is not None and r.lat >= 56} == {max(r.traj for r in own)} and sum(r.lat is not None and r.lat >= 56 for r in own) == 5


def test_late_points_and_stays_that_silence_ends(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    schema = "event_id long, user long, ts timestamp, label string"
    rows = [(1, 1, at(0), "home"), (2, 1, at(100), "home"), (3, 1, at(900), None), (4, 2, at(950), "work"), (5, 1, at(1000), "work"), (6, 2, at(1000), "work")]
    late = [(7, 1, at(5), "home")]
    quiet = [(8, 9, at(50_000), None), (9, 9, at(60_000), None), (10, 9, at(70_000), None)]
    got = in_batches(spark, tmp_path, rows + quiet[:1] + late + quiet[1:], schema, lambda s: chained.timed_breakpoints(s, 600, "10 seconds"), "stays", 5)
    base = T0.replace(tzinfo=dt.timezone.utc).timestamp()
    seen = sorted((r.user, r.start_ts - base, r.scan_ts - base, None if r.last_ts is None or r.last_ts != r.last_ts else r.last_ts - base) for r in got)
    whole = stays.breakpoints(spark.createDataFrame(rows, schema), 600, tail=True).collect()
    second = lambda v: None if v is None else v.replace(tzinfo=dt.timezone.utc).timestamp() - base
    assert seen == sorted((r.user, second(r.start_ts), second(r.scan_ts), second(r.last_ts)) for r in whole) and len(seen) == 3


def test_state_is_a_table_that_survives_a_restart(spark, tmp_path):
    """The frames that a user's windows wait in are read back by batch, change with the next run, and are gone after a control row."""
    params, source, check = StreamParams(), str(tmp_path / "in"), str(tmp_path / "check")
    known = spark.createDataFrame([(1, ["x"])], "user long, pattern array<string>")
    lines = [[(k + 10 * b, 1, T0 + dt.timedelta(seconds=60 * (k + 10 * b)), 55 + 0.002 * (k + 10 * b), 10.0) for k in range(10)] for b in range(2)]
    lines.append([(99, 1, T0 + dt.timedelta(seconds=1300), None, None)])
    sizes = []
    for rows in lines:
        spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(POINTS).parquet(source)
        made = chained.scored_trajectories(chained.forward_stream(stream, params, "1 hour"), known, 18, "5T", 0.5)
        q = made.writeStream.format("noop").option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        frame = chained.state_rows(spark, check, "window", operator=0).collect()
        machine = chained.state_rows(spark, check, "machine", operator=1).collect()
        sizes.append((len(frame), machine[0].traj, round(machine[0].last)))
        assert {r.user for r in frame} <= {1} and [r.user for r in machine] == [1]
    base = round(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    assert sizes[0][0] > 1 and sizes[0][1:] == (0, base + 540) and sizes[1][1:] == (0, base + 1140) and sizes[2][0] == 0 and sizes[2][1] == 1
    # As it was after the first batch.
    early = chained.state_rows(spark, check, "machine", operator=1, batch=0).collect()
    assert [round(r.last) for r in early] == [base + 540]
