"""Seeded trajectories for fixtures: stops, walks, whole routes, labelled batches."""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS
from waymark.operators.compress import great_circle

#: Walking speed and noise of the large example (m/s, s, m).
SPEED = (4.0 / 3.6, 0.5 / 3.6)
STEP = (5.0, 20.0)
POSITION = 8.75


@dataclass(frozen=True)
class WayPoint:
    """A place; a positive duration (seconds) makes it a stop."""

    lat: float
    lon: float
    duration: float = 0.0
    std: float = 5.0

    def __post_init__(self):
        if self.duration < 0:
            raise ValueError("duration must not be negative")

    @property
    def is_stop(self) -> bool:
        return self.duration > 0


def _jitter(rng: random.Random, lat: float, lon: float, std: float) -> tuple[float, float]:
    return lat + rng.gauss(0, std) / 111_195, lon + rng.gauss(0, std) / 63_000


def stop(rng: random.Random, at: WayPoint) -> list[tuple[float, float, float]]:
    """(lat, lon, dt) around a place as long as its duration lasts; the point that would go beyond it is left out."""
    out, left = [], at.duration
    while (dt := STEP[0] + abs(rng.gauss(0, STEP[1]))) <= left:
        out.append((*_jitter(rng, at.lat, at.lon, at.std), dt))
        left -= dt
    return out


def walk(rng: random.Random, route: list[tuple[float, float]]) -> list[tuple[float, float, float]]:
    """(lat, lon, dt) along the vertices of a route at a noisy speed."""
    out, leg, done = [], 0, 0.0
    while leg < len(route) - 1:
        dt = STEP[0] + abs(rng.gauss(0, STEP[1]))
        done += max(0.0, SPEED[0] + rng.gauss(0, SPEED[1])) * dt
        while leg < len(route) - 1 and done >= (size := great_circle(*route[leg], *route[leg + 1])):
            done, leg = done - size, leg + 1
        if leg < len(route) - 1:
            part = done / size
            (a, b), (c, d) = route[leg], route[leg + 1]
            out.append((*_jitter(rng, a + (c - a) * part, b + (d - b) * part, POSITION), dt))
    return out


def trajectory(waypoints: list[WayPoint], seed: int, routes: dict | None = None) -> list[tuple[float, float, float]]:
    """Start stop, the routes between neighbours (a straight line where routes has none), stops on the way, end stop."""
    if len(waypoints) < 2:
        raise ValueError("a trajectory needs two waypoints or more")
    rng, out = random.Random(seed), []
    for a, b in zip(waypoints, waypoints[1:], strict=False):
        if a.is_stop:
            out += stop(rng, a)
        ends = ((a.lat, a.lon), (b.lat, b.lon))
        out += walk(rng, (routes or {}).get(ends, list(ends)))
    return out + (stop(rng, waypoints[-1]) if waypoints[-1].is_stop else [])


def restless(n: int, size: int, seed: int) -> list[int]:
    """n numbers below size, repeats allowed, but never one twice in a row: each is drawn from the others than the one before."""
    if size < 2:
        raise ValueError("two numbers or more are needed")
    rng, out = random.Random(seed), []
    last = rng.randrange(size)
    for _ in range(n):
        step = rng.randrange(1, size)
        last = (last + step) % size
        out.append(last)
    return out


def pattern(kind: str, places: list[tuple[float, float]], seed: int) -> list[WayPoint]:
    """Waypoints of a named pattern: repeated (there and back), looping (the middle twice), deviating (a detour before the end)."""
    rng = random.Random(seed)
    a, b, c = (places[i] for i in rng.sample(range(len(places)), 3))
    way = {"repeated": [a, b, a], "looping": [a, b, c, b, c], "deviating": [a, (b[0] + 0.003, b[1] + 0.001), b]}[kind]
    return [WayPoint(*way[0], 600), *[WayPoint(*p) for p in way[1:-1]], WayPoint(*way[-1], 600)]


def onset(points: list[tuple[float, float, float]], way: list[tuple[float, float]], metres: float = 60.0, run: int = 3) -> int | None:
    """Position of the first of `run` points in a row that are farther than metres from a way (its vertices, in plane degrees); None without one.

    The wider distance than a corridor's allows for the noise of a single track.
    """
    east = math.cos(math.radians(way[0][0]))

    def far(lat: float, lon: float) -> bool:
        least = math.inf
        for (a, b), (c, d) in zip(way, way[1:], strict=False):
            dx, dy = (d - b) * east, c - a
            px, py = (lon - b) * east, lat - a
            t = min(1.0, max(0.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            least = min(least, math.hypot(px - t * dx, py - t * dy))
        return math.radians(least) * EARTH_RADIUS > metres

    held = 0
    for k, (lat, lon, _) in enumerate(points):
        held = held + 1 if far(lat, lon) else 0
        if held == run:
            return k - run + 1
    return None


def labelled(kind: str, places: list[tuple[float, float]], seed: int) -> tuple[list[tuple[float, float, float]], int | None]:
    """Points of a pattern and the position where it turns anomalous: a detour where it leaves the direct way, a loop where its middle comes
    again; None for the regular one."""
    waypoints = pattern(kind, places, seed)
    made = trajectory(waypoints, seed)
    if kind == "deviating":
        return made, onset(made, [(waypoints[0].lat, waypoints[0].lon), (waypoints[-1].lat, waypoints[-1].lon)])
    if kind == "looping":
        # The first point near the far end; from there on the track repeats itself.
        end = waypoints[-1]
        return made, next((k for k, (lat, lon, _) in enumerate(made) if great_circle(lat, lon, end.lat, end.lon) < 30), None)
    return made, None


def batch(seeds: list[int], places: list[tuple[float, float]]) -> str:
    """A labelled batch: JSON list of frames (df, uid, anomalous), each df a JSON frame indexed by epoch milliseconds."""
    frames = []
    for seed in seeds:
        kind = ("repeated", "looping", "deviating")[seed % 3]
        t, rows, index = 0.0, [], []
        made, start = labelled(kind, places, seed)
        for k, (lat, lon, dt) in enumerate(made):
            t += dt
            rows.append([lat, lon, f"t{seed}", k == start])
            index.append(int(t * 1000))
        frames.append([json.dumps({"columns": ["latitude", "longitude", "uid", "anom_start"], "index": index, "data": rows}), f"t{seed}", kind != "repeated"])
    return json.dumps([json.dumps({"columns": ["df", "uid", "anomalous"], "index": list(range(len(frames))), "data": frames})])


@dataclass(frozen=True)
class Profile:
    """So many trajectories over the same waypoints."""

    name: str
    waypoints: tuple[WayPoint, ...]
    n: int = 1
    anomalous: bool = False


def _clocked(made: DataFrame, gap: float) -> DataFrame:
    """made(uid, ord, ..., dt) with `ts` in place of dt: running sums; a trajectory begins `gap` seconds after the one before ends."""
    length = made.groupBy("uid").agg((F.sum("dt") + gap).alias("_length"))
    # One row a trajectory goes through this window.
    begin = length.withColumn("_begin", F.sum("_length").over(W.orderBy("uid")) - F.col("_length")).select("uid", "_begin")
    clock = F.sum("dt").over(W.partitionBy("uid").orderBy("ord")) + F.col("_begin")
    return made.join(begin, "uid").withColumn("ts", F.timestamp_micros((clock * 1e6).cast("long"))).drop("dt", "_begin")


def simulated(spark: SparkSession, n: int, places: list[tuple[float, float]], seed: int = 0, gap: float = 3600.0) -> DataFrame:
    """(uid, ord, lat, lon, anomalous, anom_start, ts) of n seeded trajectories, made on executors, one after the other with gaps between."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for i in b.id:
                kind = ("repeated", "looping", "deviating")[i % 3]
                made, start = labelled(kind, places, seed + int(i))
                rows += [(int(i), k, *p, kind != "repeated", k == start) for k, p in enumerate(made)]
            yield pd.DataFrame(rows, columns=["uid", "ord", "lat", "lon", "dt", "anomalous", "anom_start"])

    made = spark.range(n).mapInPandas(run, "uid long, ord int, lat double, lon double, dt double, anomalous boolean, anom_start boolean")
    return _clocked(made, gap)


def from_profiles(spark: SparkSession, profiles: list[Profile], seed: int = 0, gap: float = 3600.0, routes: dict | None = None) -> DataFrame:
    """(uid, ord, lat, lon, profile, anomalous, ts): n trajectories of each profile, along given routes or straight."""
    wanted = [(k, i) for k, p in enumerate(profiles) for i in range(p.n)]

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for uid, k in zip(b.uid, b.k, strict=True):
                p = profiles[k]
                rows += [(int(uid), o, *point, p.name, p.anomalous) for o, point in enumerate(trajectory(list(p.waypoints), seed + int(uid), routes))]
            yield pd.DataFrame(rows, columns=["uid", "ord", "lat", "lon", "dt", "profile", "anomalous"])

    each = spark.createDataFrame([(uid, k) for uid, (k, _) in enumerate(wanted)], "uid long, k int")
    made = each.repartition(max(1, len(wanted) // 100)).mapInPandas(run, "uid long, ord int, lat double, lon double, dt double, profile string, anomalous boolean")
    return _clocked(made, gap)
