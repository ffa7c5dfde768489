"""Points in polygons by a cover of each polygon with cells of a quadtree."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import in_ring
from waymark.sources.tables import staged

#: Cells that cover a polygon, at most; edge cells are split, largest first, while there is room.
CELLS = 64
DEEPEST = 24
#: Bytes of covers that travel to every task; larger ones meet the points in a shuffle.
BROADCAST_BYTES = 32 << 20
COVER = "level int, x long, y long, inner boolean"


def _inside(ring: np.ndarray, x: float, y: float) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    over = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((over & (x < at)).sum() % 2)


def _meets(ring: np.ndarray, w: float, s: float, e: float, n: float) -> bool:
    """Whether an edge of the ring comes into a box, borders included."""
    a, d = ring, np.roll(ring, -1, axis=0) - ring
    lo, hi = np.zeros(len(a)), np.ones(len(a))
    for k, (least, most) in enumerate(((w, e), (s, n))):
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.stack([(least - a[:, k]) / d[:, k], (most - a[:, k]) / d[:, k]])
        flat = d[:, k] == 0
        outside = flat & ((a[:, k] < least) | (a[:, k] > most))
        lo = np.where(flat, np.where(outside, 2.0, lo), np.maximum(lo, t.min(0)))
        hi = np.where(flat, hi, np.minimum(hi, t.max(0)))
    return bool((lo <= hi).any())


def cover(ring: list[tuple[float, float]], cells: int = CELLS, deepest: int = DEEPEST) -> list[tuple[int, int, int, bool]]:
    """(level, x, y, inner) of at most `cells` cells of 360 / 2**level degrees that cover a polygon; an inner cell lies in it whole, with the rest a point has to be tested. x may lie beyond the seam."""
    shape = np.array(ring, np.float64)
    (w, s), (e, n) = shape.min(0), shape.max(0)
    level = 0
    while level < deepest and max(e - w, n - s) * 2 ** (level + 1) <= 360:
        level += 1
    side = 360 / 2**level
    start = [(level, x, y) for x in range(int((w + 180) // side), int((e + 180) // side) + 1) for y in range(int((s + 90) // side), int((n + 90) // side) + 1)]
    inner: list[tuple[int, int, int]] = []
    edge: list[tuple[int, int, int]] = []

    def place(cell: tuple[int, int, int]) -> None:
        z, x, y = cell
        side = 360 / 2**z
        left, low = x * side - 180, y * side - 90
        # A little wider, so that rounding never takes an edge cell for an inner one.
        if _meets(shape, left - side * 1e-9, low - side * 1e-9, left + side * (1 + 1e-9), low + side * (1 + 1e-9)):
            heapq.heappush(edge, cell)
        elif _inside(shape, left + side / 2, low + side / 2):
            inner.append(cell)

    for cell in start:
        place(cell)
    while edge and edge[0][0] < deepest and len(inner) + len(edge) + 3 <= cells:
        z, x, y = heapq.heappop(edge)
        for dx in (0, 1):
            for dy in (0, 1):
                place((z + 1, 2 * x + dx, 2 * y + dy))
    return [(*c, True) for c in inner] + [(*c, False) for c in edge]


def covers(fences: DataFrame, cells: int = CELLS) -> DataFrame:
    """fences(..., ring) with a row for each cell of their covers; cells beyond the seam are those on its other side."""
    kept = [f for f in fences.schema.fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [cover([(p["x"], p["y"]) for p in ring], cells) if ring is not None and len(ring) > 2 else [] for ring in frame.ring]
            rows = frame.loc[frame.index.repeat([len(f) for f in found])].reset_index(drop=True)
            flat = [(z, x % 2**z, y, i) for f in found for z, x, y, i in f]
            yield pd.concat([rows, pd.DataFrame(flat, columns=["level", "x", "y", "inner"])], axis=1)

    return fences.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + COVER)


def cell_at(level: int | Column) -> tuple[Column, Column]:
    """The cell of a place at a level. The cells' sides are exact powers of two of 360, so a place falls into one cell."""
    side = F.lit(360.0) / F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    last = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return F.pmod(F.floor((F.col("lon") + 180) / side), last.cast("long")), F.floor((F.col("lat") + 90) / side)


def _holds(fence: Column, inside: Callable[[Column], Column] | None = None) -> Column:
    """Whether a fence with its box holds the place (lat, lon), also from beyond the seam; inside: see label_by_fence()."""
    if inside is not None:
        return fence["inner"] | inside(fence)
    x, y = F.col("lon"), F.col("lat")
    x = F.when(x < fence["min_x"], x + 360).when(x > fence["max_x"], x - 360).otherwise(x)
    boxed = (x >= fence["min_x"]) & (x <= fence["max_x"]) & (y >= fence["min_y"]) & (y <= fence["max_y"])
    return fence["inner"] | (boxed & in_ring(x, y, fence["ring"]))


def label_by_fence(points: DataFrame, fences: DataFrame, cells: int = CELLS, broadcast_bytes: int = BROADCAST_BYTES, inside: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds `label` to points(event_id, lat, lon, ...): the first fence(ord, label, ring, min_x, max_x, min_y, max_y) that holds the point, or null.

    A fence is at most `cells` cells, however wide. Where all covers fit in broadcast_bytes, points look up their cell at each level that occurs and are never
    shuffled; else they meet the cells in a shuffle, and the first fence of each is found in another. A ring may go beyond 180 degrees on either side.
    inside: a test of a fence struct for the place (lat, lon) that decides in edge cells in place of the ring, where rounding on the border has to be that of a formula.
    """
    found = staged(covers(fences.select("ord", "label", "ring", "min_x", "max_x", "min_y", "max_y"), cells), "covers")
    size = found.agg(F.sum(F.lit(64) + 16 * F.size("ring")), F.sort_array(F.collect_set("level"))).first()
    each = F.struct("ord", "label", F.when(~F.col("inner"), F.col("ring")).alias("ring"), "min_x", "max_x", "min_y", "max_y", "inner")
    if (size[0] or 0) <= broadcast_bytes:
        out, lists = points, []
        for level in size[1]:
            name = f"_fences{level}"
            at = found.where(F.col("level") == level).groupBy(F.col("x").alias("_cx"), F.col("y").alias("_cy")).agg(F.collect_list(each).alias(name))
            x, y = cell_at(level)
            out = out.withColumns({"_cx": x, "_cy": y}).join(F.broadcast(at), ["_cx", "_cy"], "left").drop("_cx", "_cy")
            lists.append(F.coalesce(name, F.array().cast(at.schema[name].dataType)))
        if not lists:
            return points.withColumn("label", F.lit(None).cast("string"))
        holding = F.transform(F.filter(F.concat(*lists), lambda f: _holds(f, inside)), lambda f: F.struct(f["ord"].alias("ord"), f["label"].alias("label")))
        return out.withColumn("label", F.array_min(holding)["label"]).select(*points.columns, "label")
    levels = F.explode(F.array(*[F.struct(F.lit(z).alias("level"), cell_at(z)[0].alias("x"), cell_at(z)[1].alias("y")) for z in size[1]]))
    keyed = points.select("event_id", "lat", "lon", levels.alias("c")).select("event_id", "lat", "lon", "c.*")
    hits = keyed.join(found.select("level", "x", "y", each.alias("_f")), ["level", "x", "y"]).where(_holds(F.col("_f"), inside))
    first = hits.groupBy("event_id").agg(F.min(F.struct("_f.ord", "_f.label")).alias("_first"))
    return points.join(first, "event_id", "left").withColumn("label", F.col("_first.label")).select(*points.columns, "label")
