"""Points to scores in one stream: stateful stages that hand event time on, with a marker after each trajectory, and state read back as a table."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from waymark.functions.cells import encode
from waymark.functions.scalars import period_micros, unix_seconds
from waymark.operators.compress import Machine, StreamParams
from waymark.streaming.keyed import common_length

FORWARDED = "user long, traj long, ord int, ts timestamp, lat double, lon double, weight double, ended boolean"
SCORED = "user long, traj long, ord int, ts timestamp, geohash string, similarity double, anomaly_score double, anomaly boolean"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    out["ts"] = pd.to_datetime(out.ts, unit="s")
    return out.astype({"ord": "int32"})


class ForwardProcessor(StatefulProcessor):
    """The point machine of a user that hands points on as soon as nothing can change them, and a marker where a trajectory ends: because of a gap
    or a leap, because event time has passed the last point by the separation time, or because a control row (no place) clears the user, which
    forgets what is open."""

    def __init__(self, params: StreamParams):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "data binary, traj long, given int, last double")

    def _load(self) -> tuple[Machine, int, int, float]:
        if not self.state.exists():
            return Machine(self.params), 0, 0, 0.0
        data, traj, given, last = self.state.get()
        return pickle.loads(data), traj, given, last

    @staticmethod
    def _given(user: int, traj: int, given: int, points: list) -> list[tuple]:
        return [(user, traj, k, p.t, p.lat, p.lon, p.weight, False) for k, p in enumerate(points[given:], given)]

    def _end(self, user: int, traj: int, given: int, done: list | None, at: float) -> list[tuple]:
        rows = self._given(user, traj, given, done or [])
        return [*rows, (user, traj, len(done or []), max([at, *(r[3] for r in rows)]), None, None, None, True)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        user = int(key[0])
        machine, traj, given, last = self._load()
        out: list[tuple] = []
        every = pd.concat(list(rows)).sort_values(["t", "event_id"])
        for lat, lon, t in zip(every.lat, every.lon, every.t, strict=True):
            if lat is None or lat != lat:
                if machine.head is not None:
                    out += self._end(user, traj, given, None, t)
                    traj += 1
                machine, given = Machine(self.params), 0
                continue
            if done := machine.push(lat, lon, t):
                out += self._end(user, traj, given, done, last)
                traj, given = traj + 1, 0
            last = t
            settled = machine.track if machine.merged else machine.track[:-1]
            out += self._given(user, traj, given, settled)
            given = max(given, len(settled))
        self.state.update((pickle.dumps(machine), traj, given, float(last)))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if machine.head is not None:
            self.handle.registerTimer(int((last + self.params.separation_time) * 1000) + 1)
        yield _frame(out, FORWARDED)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, traj, given, last = self._load()
        out: list[tuple] = []
        if machine.head is not None:
            # The time of the marker is not before the watermark that set off the timer.
            out = self._end(int(key[0]), traj, given, machine.finish(), last)
            self.state.update((pickle.dumps(Machine(self.params)), traj + 1, 0, last))
        yield _frame(out, FORWARDED)

    def close(self) -> None:
        pass


def forward_stream(points: DataFrame, params: StreamParams = StreamParams(), late: str = "1 hour") -> DataFrame:
    """A stream of points(user, event_id, ts, lat, lon) as the points of compressed trajectories, each handed on once, and after each
    trajectory a row with `ended`. Points later than `late` are dropped; a row without a place clears its user."""
    timed = points.withWatermark("ts", late).select("user", "event_id", "ts", "lat", "lon", unix_seconds(F.col("ts")).alias("t"))
    return timed.groupBy("user").transformWithStateInPandas(ForwardProcessor(params), FORWARDED, "append", "eventtime")


class TrajectoryScoreProcessor(StatefulProcessor):
    """Scores a user's forwarded points in trailing windows of cells; the marker at a trajectory's end begins a new window and a new least score."""

    def __init__(self, seconds: float, threshold: float, supports: dict[int, list[list[str]]]):
        self.seconds, self.threshold, self.supports = seconds, threshold, supports

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("window", "t double, cell string")
        self.state = handle.getValueState("least", "least double, cell string, traj long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        user = int(key[0])
        least, cell, open_ = self.state.get() if self.state.exists() else (float("inf"), None, -1)
        window = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        out: list[tuple] = []
        every = pd.concat(list(rows)).sort_values(["traj", "ord"])
        for traj, number, t, c, ended in zip(every.traj, every.ord, every.t, every.geohash, every.ended, strict=True):
            if ended or traj != open_:
                least, cell, window, open_ = float("inf"), None, [], traj
            if ended or c == cell:
                continue
            window = [(w, x) for w, x in window if w > t - self.seconds] + [(t, c)]
            cells = [x for _, x in window]
            score = max((common_length(cells, p) for p in self.supports.get(user, ())), default=0) / len(cells)
            least, cell = min(least, score), c
            out.append((user, traj, number, t, c, score, 1 - least, 1 - least > self.threshold))
        self.state.update((least, cell, int(open_)))
        if window:
            self.rows.put(window)
        else:
            self.rows.clear()
        yield _frame(out, SCORED)

    def close(self) -> None:
        pass


def scored_trajectories(forwarded: DataFrame, support: DataFrame, precision: int, period: str, threshold: float, most_bytes: int = 8 << 20) -> DataFrame:
    """Forwarded points with the scores of their trajectory so far, against support(user, pattern). The supports go to every task, so their size is checked: above
    most_bytes ValueError."""
    size = support.agg(F.coalesce(F.sum(F.aggregate("pattern", F.lit(0).cast("long"), lambda n, t: n + F.length(t))), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"supports of {size} bytes are too large to send to every task")
    known: dict[int, list[list[str]]] = {}
    for r in support.select("user", "pattern").collect():
        known.setdefault(r.user, []).append(list(r.pattern))
    celled = forwarded.select("user", "traj", "ord", "ts", unix_seconds(F.col("ts")).alias("t"), F.when(F.col("lat").isNotNull(), encode(F.col("lat"), F.col("lon"), precision)).alias("geohash"), "ended")
    return celled.groupBy("user").transformWithStateInPandas(TrajectoryScoreProcessor(period_micros(period) / 1e6, threshold, known), SCORED, "append", "none")


class TimedBreakpointProcessor(StatefulProcessor):
    """Stays of a user; a stay that no later point ends is given out once event time has passed its last labelled point by the limit."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stay", "start double, scan double, left boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, scan, left = self.state.get() if self.state.exists() else (None, None, False)
        out = []
        every = pd.concat(list(rows)).sort_values(["t", "event_id"])
        for t, label in zip(every.t, every.label, strict=True):
            if label is not None and label == label:
                if scan is None or left:
                    start = t
                scan, left = t, False
            elif scan is not None and t - scan >= self.seconds:
                if not left:
                    out.append((int(key[0]), start, scan, t))
                left = True
        if scan is not None:
            self.state.update((start, scan, left))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if not left:
                self.handle.registerTimer(int((scan + self.seconds) * 1000) + 1)
        yield pd.DataFrame(out, columns=["user", "start_ts", "scan_ts", "last_ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, scan, left = self.state.get()
        self.state.update((start, scan, True))
        out = [] if left else [(int(key[0]), start, scan, None)]
        yield pd.DataFrame(out, columns=["user", "start_ts", "scan_ts", "last_ts"]).astype("float64").astype({"user": "int64"})

    def close(self) -> None:
        pass


def timed_breakpoints(labelled: DataFrame, seconds: float, late: str = "1 hour") -> DataFrame:
    """A stream of labelled(user, event_id, ts, label) as stays, times in seconds. last_ts is null for a stay that silence ended: the watermark passed
    it by `seconds` and no point had come."""
    timed = labelled.withWatermark("ts", late).select("user", "event_id", "ts", unix_seconds(F.col("ts")).alias("t"), F.col("label").cast("string").alias("label"))
    return timed.groupBy("user").transformWithStateInPandas(TimedBreakpointProcessor(seconds), "user long, start_ts double, scan_ts double, last_ts double", "append", "eventtime")


def state_rows(spark: SparkSession, checkpoint: str, variable: str, operator: int = 0, batch: int | None = None) -> DataFrame:
    """The state of a stream as a table: the grouping key's columns and those of a state variable, as it was after a batch (the last one, without it).
    A list has a row for each element. operator: which stateful operator of the query, from 0."""
    read = spark.read.format("statestore").option("stateVarName", variable).option("operatorId", operator)
    if batch is not None:
        read = read.option("batchId", batch)
    rows = read.load(checkpoint)
    if "list_element" in rows.columns:
        return rows.select("key.*", "list_element.*")
    return rows.select("key.*", "value.*")
