"""Stateful streams by user: the point machine, token rows, windows and their scores, detectors, stay breakpoints, queues.

State lives in the query's state store; a restart goes on from the checkpoint. Late points: with a watermark (`late`), points behind it are
dropped, and a user's open trajectory is given out once event time passes its last point by the separation time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from waymark.functions.cells import cell_spacing, encode
from waymark.functions.scalars import period_micros, unix_seconds
from waymark.functions.sequences import line_cells
from waymark.operators.compress import Machine, StreamParams, compressed_rows
from waymark.operators.ibdd import Detector, IbddParams, Postings, celled

OUT = "user long, session long, traj long, ord int, ts double, lat double, lon double, weight double, dx double, dt double, speed double, acceleration double"


class CompressProcessor(StatefulProcessor):
    """The same machine as in batch; its state is one value a user, and a timer flushes what stays open."""

    def __init__(self, params: StreamParams):
        self.params = params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "data binary, traj long")

    def _rows(self, user: int, traj: int, done: list) -> list[tuple]:
        return [r[:-1] for r in compressed_rows(user, 0, traj, done)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine, traj = Machine(self.params), 0
        if self.state.exists():
            data, traj = self.state.get()
            machine = pickle.loads(data)
        out: list[tuple] = []
        every = pd.concat(list(rows)).sort_values(["t", "event_id"])
        for lat, lon, t in zip(every.lat, every.lon, every.t, strict=True):
            if done := machine.push(lat, lon, t):
                out += self._rows(int(key[0]), traj, done)
                traj += 1
        self.state.update((pickle.dumps(machine), traj))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((every.t.max() + self.params.separation_time) * 1000) + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.state.exists():
            data, traj = self.state.get()
            if done := pickle.loads(data).finish():
                out = self._rows(int(key[0]), traj, done)
            self.state.update((pickle.dumps(Machine(self.params)), traj + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def compress_stream(points: DataFrame, params: StreamParams = StreamParams(), late: str = "1 hour") -> DataFrame:
    """A stream of points(user, event_id, ts, lat, lon) as compressed trajectories, each when it is finished."""
    timed = points.withWatermark("ts", late).select("user", "event_id", "ts", "lat", "lon", unix_seconds(F.col("ts")).alias("t"))
    return timed.groupBy("user").transformWithStateInPandas(CompressProcessor(params), OUT, "append", "eventtime")


class ScoreProcessor(StatefulProcessor):
    """Carries the least similarity of a user; rows at or before the last scored time are refused."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("least", "least double, scanned double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least, scanned = self.state.get() if self.state.exists() else (1.0, float("-inf"))
        out = []
        every = pd.concat(list(rows)).sort_values(["t", "event_id"])
        before = scanned
        for event_id, t, s in zip(every.event_id, every.t, every.similarity, strict=True):
            if t <= before:
                continue
            least, scanned = min(least, s), max(scanned, t)
            out.append((int(key[0]), event_id, s, 1 - least, 1 - least > self.threshold))
        self.state.update((least, scanned))
        yield pd.DataFrame(out, columns=["user", "event_id", "similarity", "anomaly_score", "anomaly"])

    def close(self) -> None:
        pass


def score_stream(scored: DataFrame, threshold: float) -> DataFrame:
    """A stream of scored(user, event_id, ts, similarity) with anomaly_score and anomaly."""
    timed = scored.select("user", "event_id", unix_seconds(F.col("ts")).alias("t"), "similarity")
    return timed.groupBy("user").transformWithStateInPandas(ScoreProcessor(threshold), "user long, event_id long, similarity double, anomaly_score double, anomaly boolean", "append", "none")


class BreakpointProcessor(StatefulProcessor):
    """Open stay of a user: start, last labelled time, whether the row before was an exit."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
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
        yield pd.DataFrame(out, columns=["user", "start_ts", "scan_ts", "last_ts"])

    def close(self) -> None:
        pass


def breakpoint_stream(labelled: DataFrame, seconds: float) -> DataFrame:
    """A stream of labelled(user, event_id, ts, label) as finished stays, times in seconds."""
    timed = labelled.select("user", "event_id", unix_seconds(F.col("ts")).alias("t"), F.col("label").cast("string").alias("label"))
    return timed.groupBy("user").transformWithStateInPandas(BreakpointProcessor(seconds), "user long, start_ts double, scan_ts double, last_ts double", "append", "none")


class CellProcessor(StatefulProcessor):
    """Rows of the token frame as points come: the last row of a user bridges to the next batch. Rows whose cell equals the one before are dropped,
    and so is a batch that repeats a time (of itself or of the last row)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "t double, lat double, lon double, geohash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["t", "event_id"])
        t, lat, lon, cell = self.state.get() if self.state.exists() else (None, None, None, None)
        out: list[tuple] = []
        if not every.t.duplicated().any() and (t is None or every.t.iloc[0] > t):
            for event_id, now, a, b, c in zip(every.event_id, every.t, every.lat, every.lon, every.geohash, strict=True):
                if c != cell:
                    out.append((int(key[0]), event_id, now, a, b, c, lat, lon, cell))
                    lat, lon, cell = a, b, c
                t = now
            self.state.update((float(t), lat, lon, cell))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CELLS.split(", ")])

    def close(self) -> None:
        pass


CELLS = "user long, event_id long, t double, lat double, lon double, geohash string, before_lat double, before_lon double, before_cell string"


def cell_stream(points: DataFrame, precision: int, interpolate: bool = True, bits: int = 2) -> DataFrame:
    """A stream of points(user, event_id, ts, lat, lon) as token rows (user, event_id, t, lat, lon, geohash, between), as token_rows() gives them in
    batch. State finds the row before; cells are Column expressions on either side of it."""
    timed = points.select("user", "event_id", unix_seconds(F.col("ts")).alias("t"), "lat", "lon", encode(F.col("lat"), F.col("lon"), precision, bits).alias("geohash"))
    rows = timed.groupBy("user").transformWithStateInPandas(CellProcessor(), CELLS, "append", "none")
    line = line_cells(F.col("before_lat"), F.col("before_lon"), F.col("lat"), F.col("lon"), precision, cell_spacing(precision, bits), bits)
    none = F.array().cast("array<string>")
    inner = F.filter(line, lambda c: (c != F.col("before_cell")) & (c != F.col("geohash"))) if interpolate else none
    return rows.select("user", "event_id", "t", "lat", "lon", "geohash", F.when(F.col("before_cell").isNull(), none).otherwise(inner).alias("between"))


class WindowScoreProcessor(StatefulProcessor):
    """Trailing windows of a user's token rows: the rows of the last window wait in a list state, the least similarity and the last scored time in a
    value. Rows at or before the last scored time are refused. Supports travel with the processor, their size is checked."""

    def __init__(self, seconds: float, threshold: float, supports):
        self.seconds, self.threshold, self.supports = seconds, threshold, supports

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "t double, tokens array<string>")
        self.state = handle.getValueState("least", "least double, scanned double")

    def _similarity(self, user: int, tokens: list[str]) -> float:
        return max((common_length(tokens, p) for p in self.supports.get(user, ())), default=0) / len(tokens) if tokens else 0.0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least, scanned = self.state.get() if self.state.exists() else (float("inf"), float("-inf"))
        window = [(t, list(tokens)) for t, tokens in (self.rows.get() if self.rows.exists() else ())]
        every = pd.concat(list(rows)).sort_values(["t", "event_id"])
        every = every[every.t > scanned]
        out: list[tuple] = []
        for t, group in every.groupby("t", sort=True):
            window = [(w, x) for w, x in window if w > t - self.seconds] + [(t, list(x)) for x in group.tokens]
            s = self._similarity(int(key[0]), [x for _, tokens in window for x in tokens])
            least, scanned = min(least, s), float(t)
            out += [(int(key[0]), event_id, s, 1 - least, 1 - least > self.threshold) for event_id in group.event_id]
        if window:
            self.rows.put([(float(t), x) for t, x in window])
            self.state.update((least, scanned))
        yield pd.DataFrame(out, columns=["user", "event_id", "similarity", "anomaly_score", "anomaly"])

    def close(self) -> None:
        pass


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def window_score_stream(rows: DataFrame, support: DataFrame, period: str, threshold: float, most_bytes: int = 8 << 20) -> DataFrame:
    """A stream of token rows(user, event_id, t, geohash, between) scored in trailing windows against support(user, pattern).

    The supports go to every task, so their size is checked: more than most_bytes of tokens raise ValueError (score in batch with a join then).
    """
    size = support.agg(F.coalesce(F.sum(F.aggregate("pattern", F.lit(0).cast("long"), lambda n, t: n + F.length(t))), F.lit(0))).first()[0]
    if size > most_bytes:
        raise ValueError(f"supports of {size} bytes are too large to send to every task")
    known: dict[int, list[list[str]]] = {}
    for r in support.select("user", "pattern").collect():
        known.setdefault(r.user, []).append(list(r.pattern))
    tokens = rows.select("user", "event_id", "t", F.concat("between", F.array("geohash")).alias("tokens"))
    made = "user long, event_id long, similarity double, anomaly_score double, anomaly boolean"
    return tokens.groupBy("user").transformWithStateInPandas(WindowScoreProcessor(period_micros(period) / 1e6, threshold, known), made, "append", "none")


class DetectorProcessor(StatefulProcessor):
    """The comparison detector a point at a time; its whole state (token buffer, working supports as numbers, counters) is one value a user."""

    def __init__(self, params: IbddParams, spacing: float, supports: list[list[str]]):
        self.params, self.spacing, self.supports = params, spacing, supports

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("detector", "data binary")
        self.index = Postings.of(self.supports)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            d = pickle.loads(self.state.get()[0])
            d.index = self.index
        else:
            d = Detector(self.params, self.index, self.spacing, self.params.separation, self.params.rate)
        every = pd.concat(list(rows)).sort_values(["t", "event_id"])
        out = [(int(key[0]), e, d.push(*p)) for e, *p in zip(every.event_id, every.cell, every.east, every.north, strict=True)]
        self.state.update((pickle.dumps(d),))
        yield pd.DataFrame(out, columns=["user", "event_id", "label"])

    def close(self) -> None:
        pass


def detector_stream(points: DataFrame, supports: list[list[str]], params: IbddParams) -> DataFrame:
    """A stream of points(user, event_id, ts, lat, lon) with labels. A stream has no estimates of whole trajectories, so params must give separation
    and rate; supports are the learned sequences of one batch of trajectories."""
    if params.separation is None or params.rate is None:
        raise ValueError("a stream needs a separation and a rate")
    rows = celled(points, params.precision).select("user", "event_id", unix_seconds(F.col("ts")).alias("t"), "cell", "east", "north")
    return rows.groupBy("user").transformWithStateInPandas(DetectorProcessor(params, cell_spacing(params.precision), supports), "user long, event_id long, label int", "append", "none")


class QueueProcessor(StatefulProcessor):
    """A queue and a value a key, with a time to live: commands rpush, lpop, rpop, lrange, llen, set, get, delete, answered in order."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "v string", self.ttl_ms) if self.ttl_ms else handle.getListState("items", "v string")
        self.value = handle.getValueState("value", "v string", self.ttl_ms) if self.ttl_ms else handle.getValueState("value", "v string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items = [v for (v,) in self.items.get()] if self.items.exists() else []
        value = self.value.get()[0] if self.value.exists() else None
        before, out = (list(items), value), []
        every = pd.concat(list(rows)).sort_values("seq")
        for seq, command, arg in zip(every.seq, every.command, every.arg, strict=True):
            answer = None
            if command == "rpush":
                items.append(arg)
                answer = str(len(items))
            elif command in ("lpop", "rpop"):
                answer = items.pop(0 if command == "lpop" else -1) if items else None
            elif command == "lrange":
                lo, hi = (int(x) + (len(items) if int(x) < 0 else 0) for x in arg.split())
                answer = ",".join(items[max(0, lo) : hi + 1])
            elif command == "llen":
                answer = str(len(items))
            elif command == "set":
                value = arg
            elif command == "get":
                answer = value
            elif command == "delete":
                items, value = [], None
            else:
                raise ValueError(f"no such command: {command}")
            out.append((key[0], int(seq), answer))
        if items != before[0]:
            self.items.put([(v,) for v in items]) if items else self.items.clear()
        if value != before[1]:
            self.value.update((value,)) if value is not None else self.value.clear()
        yield pd.DataFrame(out, columns=["key", "seq", "answer"])

    def close(self) -> None:
        pass


def queue_stream(commands: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    """A stream of commands(key, seq, command, arg) with their answers (key, seq, answer); what is older than ttl_seconds is gone."""
    mode = "processingtime" if ttl_seconds else "none"
    processor = QueueProcessor(int(ttl_seconds * 1000) if ttl_seconds else None)
    return commands.groupBy("key").transformWithStateInPandas(processor, "key string, seq long, answer string", "append", mode)
