"""The keyed point-stream machine: splits at gaps, merges stays to their running median, extends tracks.

Every step depends on the running median of the stay so far, so it is one ordered fold a key. A gap in time longer than the
separation time splits whatever the state is (a stay keeps the time of its last member), so sessions between such gaps are folded
apart, which bounds the work of one very long key.
"""

from __future__ import annotations

import math
from bisect import bisect, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS
from waymark.functions.scalars import unix_seconds
from waymark.operators.motion import by_time, gap_segments


def great_circle(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """The same distance as the Column form, for folds."""
    p, q = math.radians(lat1), math.radians(lat2)
    a = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS * math.atan2(math.sqrt(a), math.sqrt(1 - a))


@dataclass(frozen=True)
class StreamParams:
    """Limits of the machine in metres, seconds and m/s2; negative values raise ValueError, others than numbers TypeError."""

    merging_distance: float = 28.0
    separation_distance: float = 500.0
    separation_time: float = 300.0
    max_acceleration: float = 7.0
    max_radius: float = 100.0
    compat_speed: bool = False

    def __post_init__(self):
        for name in ("merging_distance", "separation_distance", "separation_time", "max_acceleration", "max_radius"):
            try:
                value = float(getattr(self, name))
            except (TypeError, ValueError):
                raise TypeError(f"{name} must be a number") from None
            if value < 0:
                raise ValueError(f"{name} must not be negative")
            object.__setattr__(self, name, value)


@dataclass
class Point:
    lat: float
    lon: float
    t: float
    weight: float = 0.0
    dx: float = 0.0
    dt: float = 0.0
    speed: float = 0.0
    acceleration: float = 0.0
    members: list[tuple[float, float, float]] = field(default_factory=list)

    def parts(self) -> list[tuple[float, float, float]]:
        return self.members or [(self.lat, self.lon, self.t)]


def _median_with(values: list[float], x: float | None = None) -> float:
    """Median of sorted values, and of x as if it were among them."""
    if x is None:
        n = len(values)
        return values[n // 2] if n % 2 else (values[n // 2 - 1] + values[n // 2]) / 2
    n, k = len(values) + 1, bisect(values, x)
    at = lambda i: values[i] if i < k else x if i == k else values[i - 1]
    return at(n // 2) if n % 2 else (at(n // 2 - 1) + at(n // 2)) / 2


class Middle:
    """Coordinate-wise running median of a stay: sorted coordinates, so a member costs an insertion and a look costs a bisection."""

    def __init__(self, members: list[tuple[float, float, float]]):
        self.lats, self.lons = sorted(m[0] for m in members), sorted(m[1] for m in members)

    def add(self, lat: float, lon: float) -> None:
        insort(self.lats, lat)
        insort(self.lons, lon)

    def at(self, lat: float | None = None, lon: float | None = None) -> tuple[float, float]:
        return _median_with(self.lats, lat), _median_with(self.lons, lon)


class Machine:
    """push() takes points in order and returns a finished trajectory or None; finish() returns the last one or None."""

    def __init__(self, params: StreamParams):
        self.p = params
        self.head: Point | None = None
        self.merged: list[tuple[float, float, float]] = []
        self.middle = Middle([])
        self.track: list[Point] = []

    def measure(self, point: Point, last: Point) -> None:
        point.dx = great_circle(last.lat, last.lon, point.lat, point.lon)
        point.dt = abs(point.t - last.t)
        before = last.speed if last.members or not self.p.compat_speed else 0.0
        point.speed = point.dx / point.dt if point.dt else 0.0
        point.acceleration = (point.speed - before) / point.dt if point.dt else 0.0

    def _settle(self) -> None:
        if self.merged or not self.track:
            self.track.append(self.head)

    def push(self, lat: float, lon: float, t: float) -> list[Point] | None:
        point = Point(lat, lon, t)
        if self.head is None:
            self.head = point
            return None
        self.measure(point, self.head)
        if point.dt > self.p.separation_time or point.dx > self.p.separation_distance:
            done = self.finish()
            self.head = Point(lat, lon, t)
            return done
        if point.dx <= self.p.merging_distance:
            tried = (self.middle if self.merged else Middle(self.head.parts())).at(lat, lon)
            if great_circle(*tried, lat, lon) < self.p.max_radius:
                if not self.merged:
                    self.merged = list((self.track.pop() if self.track else self.head).parts())
                    self.middle = Middle(self.merged)
                self.merged.append((lat, lon, t))
                self.middle.add(lat, lon)
                # A stay has the time of its last member; its weight is the seconds from first to last. It shares the growing list.
                self.head = Point(*self.middle.at(), t, t - self.merged[0][2], members=self.merged)
                if self.track:
                    self.measure(self.head, self.track[-1])
                return None
        self._settle()
        if abs(point.acceleration) <= self.p.max_acceleration:
            self.track.append(point)
        self.merged = []
        self.head = point
        return None

    def finish(self) -> list[Point] | None:
        if self.head is None:
            return None
        self._settle()
        done, self.track, self.merged, self.head = self.track, [], [], None
        return done or None


COMPRESSED = "user long, session long, traj long, ord int, ts double, lat double, lon double, weight double, dx double, dt double, speed double, acceleration double, members array<struct<lat:double,lon:double,ts:double>>"


def compressed_rows(user: int, session: int, traj: int, track: list[Point]) -> Iterator[tuple]:
    for k, p in enumerate(track):
        yield (user, session, traj, k, p.t, p.lat, p.lon, p.weight, p.dx, p.dt, p.speed, p.acceleration, [{"lat": a, "lon": b, "ts": c} for a, b, c in p.members])


def compress(points: DataFrame, params: StreamParams = StreamParams()) -> DataFrame:
    """Trajectories of points(user, event_id, ts, lat, lon), as COMPRESSED plus `traj_id`; each session is one fold."""
    gap = unix_seconds(F.col("ts")) - unix_seconds(F.lag("ts").over(by_time()))
    sessions = gap_segments(points.withColumn("_gap", gap), F.coalesce(F.col("_gap") > params.separation_time, F.lit(False)), name="session")
    names = [c.split()[0] for c in COMPRESSED.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Partitions come sorted by session and time; one machine runs on, and a new session finishes the last."""
        machine, last, traj = Machine(params), None, 0
        for rows in batches:
            out: list[tuple] = []
            for user, session, lat, lon, t in zip(rows.user, rows.session, rows.lat, rows.lon, rows.t, strict=True):
                if (user, session) != last:
                    if last and (done := machine.finish()):
                        out += compressed_rows(*last, traj, done)
                    last, traj = (user, session), 0
                if done := machine.push(lat, lon, t):
                    out += compressed_rows(*last, traj, done)
                    traj += 1
            yield pd.DataFrame(out, columns=names)
        if last and (done := machine.finish()):
            yield pd.DataFrame(list(compressed_rows(*last, traj, done)), columns=names)

    timed = sessions.select("user", "session", "event_id", "lat", "lon", unix_seconds(F.col("ts")).alias("t"))
    found = timed.repartition("user", "session").sortWithinPartitions("user", "session", "t", "event_id").mapInPandas(fold, COMPRESSED)
    return found.withColumn("traj_id", F.sha2(F.concat_ws("|", "user", "session", "traj"), 256))


def compress_queue(points: DataFrame, params: StreamParams = StreamParams()) -> DataFrame:
    """compress() of a queue of points; ValueError if there is none."""
    if points.isEmpty():
        raise ValueError("the queue of points is empty")
    return compress(points, params)


def members(compressed: DataFrame) -> DataFrame:
    """The points behind each compressed row, or the row itself where it has none."""
    own = F.array(F.struct("lat", "lon", F.col("ts").alias("ts")))
    each = F.explode(F.when(F.size("members") > 0, F.col("members")).otherwise(own))
    return compressed.select("user", "traj_id", "ord", each.alias("m")).select("user", "traj_id", "ord", "m.ts", "m.lat", "m.lon")
