"""The older stream filter and its variants: acceleration reject, stay means, Kalman smoothing, map matching over static routes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geo import segment_distance
from waymark.operators.motion import by_time, gap_segments, motion_flat

TRACK_COLUMNS = ["user", "track", "ord", "ts", "lat", "lon", "n"]
TRACK = "user long, track int, ord int, ts double, lat double, lon double, n long"


def _parts(points: DataFrame, max_acceleration: float, min_time: float) -> DataFrame:
    """Plausible points with the number of their track."""
    return gap_segments(motion_flat(points).where(F.abs("change") <= max_acceleration), F.col("dt") > min_time, name="track")


def paired_tracks(points: DataFrame, max_acceleration: float = 2.5, merge: float = 10.0, min_time: float = 300.0) -> DataFrame:
    """(track_id, tag, ord, ts, lat, lon): each track raw and filtered under one id."""
    key = F.sha2(F.concat_ws("|", "user", "track"), 256).alias("track_id")
    raw = _parts(points, max_acceleration, min_time)
    place = F.row_number().over(W.partitionBy("user", "track").orderBy("ts", "event_id")) - 1
    raw = raw.select(key, F.lit("raw").alias("tag"), place.cast("long").alias("ord"), F.col("ts").cast("double").alias("ts"), "lat", "lon")
    kept = filtered_tracks(points, max_acceleration, merge, min_time)
    return raw.unionByName(kept.select(key, F.lit("filtered").alias("tag"), F.col("ord").cast("long").alias("ord"), "ts", "lat", "lon"))


def filtered_tracks(points: DataFrame, max_acceleration: float = 2.5, merge: float = 10.0, min_time: float = 300.0) -> DataFrame:
    """TRACK rows: implausible points rejected, runs within `merge` Manhattan metres of the run's mean replaced by their mean (last time),
    tracks split where dt exceeds min_time. One fold a time-gap session."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A run is its sums, its number of points and its last time.
        last, k, x, y, n, end = None, 0, 0.0, 0.0, 0, 0.0
        for g in batches:
            out = []
            for user, track, lat, lon, t in zip(g.user, g.track, g.lat, g.lon, g.t, strict=True):
                if n:
                    m_lat, m_lon = x / n, y / n
                    near = abs(lat - m_lat) * 111_120 + abs(lon - m_lon) * 111_120 * np.cos(np.radians(m_lat)) <= merge
                    if (user, track) != last or not near:
                        out.append((*last, k, end, m_lat, m_lon, n))
                        x, y, n, k = 0.0, 0.0, 0, k + 1
                if (user, track) != last:
                    last, k = (user, track), 0
                x, y, n, end = x + lat, y + lon, n + 1, t
            yield pd.DataFrame(out, columns=TRACK_COLUMNS)
        if n:
            yield pd.DataFrame([(*last, k, end, x / n, y / n, n)], columns=TRACK_COLUMNS)

    timed = _parts(points, max_acceleration, min_time).select("user", "track", "event_id", "lat", "lon", F.col("ts").cast("double").alias("t"))
    return timed.repartition("user", "track").sortWithinPartitions("user", "track", "t", "event_id").mapInPandas(run, TRACK)


@dataclass(frozen=True)
class Smoothing:
    """Noise of measurements, and of place and speed at each step; spread of the first state. unit: what a second of speed adds to the place.

    late: a step is predicted with the time of the step before (1 at first), and the state begins at zero instead of the first point.
    """

    noise: float = 1e-5
    place: float = 1e-8
    speed: float = 1e-8
    spread: float = 1e-5
    unit: float = 1.0
    scale: float = 1.0
    late: bool = False


#: The older filter, in thousandths of a degree.
OLDER = Smoothing(noise=1e-5, place=1e-6, speed=1.0, spread=1e12, unit=0.001, scale=1000.0, late=True)


def kalman(tracks: DataFrame, how: Smoothing = Smoothing()) -> DataFrame:
    """tracks(user, track, ord, ts, lat, lon) smoothed by a constant-velocity filter, started anew in each track.

    Latitude and longitude have the same noise and do not mix, so each is a state of place and speed and both share one covariance (a, b; b, d).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, x, v, a, b, d, last, wait = None, np.zeros(2), np.zeros(2), 0.0, 0.0, 0.0, 0.0, 1.0
        for g in batches:
            out = []
            for user, track, lat, lon, t in zip(g.user, g.track, g.lat, g.lon, g.ts, strict=True):
                z, fresh = np.array([lat, lon]) * how.scale, (user, track) != before
                if fresh:
                    before, x, v, a, b, d, wait = (user, track), np.zeros(2) if how.late else z, np.zeros(2), how.spread, 0.0, how.spread, 1.0
                if not fresh or how.late:
                    step = 0.0 if fresh else t - last
                    f = how.unit * (wait if how.late else step)
                    x, a, b, d, wait = x + f * v, a + 2 * f * b + f * f * d + how.place, b + f * d, d + how.speed, step
                    k, m = a / (a + how.noise), b / (a + how.noise)
                    x, v, a, b, d = x + k * (z - x), v + m * (z - x), (1 - k) * a, (1 - k) * b, d - m * b
                last = t
                out.append(tuple(x / how.scale))
            yield g.assign(lat=[p for p, _ in out], lon=[q for _, q in out])[["user", "track", "ord", "ts", "lat", "lon"]]

    rows = tracks.select("user", "track", "ord", "ts", "lat", "lon").repartition("user", "track").sortWithinPartitions("user", "track", "ord")
    return rows.mapInPandas(run, "user long, track int, ord int, ts double, lat double, lon double")


def triples(points: DataFrame) -> DataFrame:
    """(user, event_id, start, middle, end): each point with the two before it, event ids; short beginnings are left out."""
    w = by_time()
    out = points.select("user", "event_id", "ts", F.lag("event_id", 2).over(w).alias("start"), F.lag("event_id", 1).over(w).alias("middle"), F.col("event_id").alias("end"))
    return out.where("start is not null").select("user", "event_id", "start", "middle", "end")


def overlapping_vertices(triples: DataFrame, routes: DataFrame, buffer: float = 1e-5, limit: float = 5.0, cell: float = 1e-3) -> DataFrame:
    """Map matching: triples(id, a, b, c) and routes(src, dst, ord, x, y, length). Keeps the vertices of route (a, b) within `buffer` of route
    (a, c), for triples whose route lengths differ by a factor of 1 + limit at most.

    The edges of a route, widened by the buffer, are indexed by the cells (of `cell` degrees) they touch, and a vertex meets the edges of its own cell only.
    """
    short, long = (routes.select(F.col("src").alias("a"), F.col("dst").alias(d), F.col("ord").alias(f"{p}_ord"), F.col("x").alias(f"{p}_x"), F.col("y").alias(f"{p}_y"), F.col("length").alias(f"{p}_len")) for p, d in (("s", "b"), ("l", "c")))
    after = W.partitionBy("a", "c").orderBy("l_ord")
    edges = long.withColumns({"_x": F.lead("l_x").over(after), "_y": F.lead("l_y").over(after)}).where("_x is not null")
    at = lambda v: F.floor(v / cell).cast("long")
    touched = [F.explode(F.sequence(at(F.least(f"l_{v}", f"_{v}") - buffer), at(F.greatest(f"l_{v}", f"_{v}") + buffer))) for v in "xy"]
    indexed = edges.withColumn("_gx", touched[0]).withColumn("_gy", touched[1])
    vertices = triples.join(short, ["a", "b"]).withColumns({"_gx": at(F.col("s_x")), "_gy": at(F.col("s_y"))})
    both = vertices.join(indexed, ["a", "c", "_gx", "_gy"])
    ok = F.abs(F.col("l_len") - F.col("s_len")) / F.nullif(F.col("l_len"), F.lit(0.0)) <= limit
    near = segment_distance(*[F.col(c) for c in ("s_x", "s_y", "l_x", "l_y", "_x", "_y")])
    return both.where(ok & (near <= buffer)).select("id", F.col("s_ord").alias("ord"), F.col("s_x").alias("x"), F.col("s_y").alias("y")).distinct()
