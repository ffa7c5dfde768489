"""Spatial, interval and containment joins as bucketed equi-joins with exact residual predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geo import EARTH_RADIUS, haversine
from waymark.sources.tables import staged


#: Rows of one side that meet in one task; a cell with more is cut into blocks. Of larger inputs the cells above a share of 1 in
#: HOT_CELLS are cut instead, so the list of cells that are cut, which is broadcast, stays under HOT_CELLS rows.
BLOCK_ROWS = 4096
HOT_CELLS = 1 << 16


def _on_sphere(rows: DataFrame, prefix: str) -> DataFrame:
    """rows with their place on the unit sphere: a grid of three axes has neither seam nor poles."""
    lat, lon = F.radians(f"{prefix}lat"), F.radians(f"{prefix}lon")
    return rows.withColumns({"_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat)})


def _reached(reach: float, side: float) -> Column:
    """Cells of the grid that come as near to the place (_x, _y, _z) as reach and that the sphere passes through."""

    def axis(v: str) -> Column:
        cells = F.sequence(F.floor((F.col(v) - reach) / side), F.floor((F.col(v) + reach) / side))
        low, high = (lambda i: i * side), (lambda i: (i + 1) * side)
        off = lambda i: F.greatest(low(i) - F.col(v), F.col(v) - high(i), F.lit(0.0))
        near = lambda i: F.when((low(i) <= 0) & (high(i) >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low(i)), F.abs(high(i))))
        far = lambda i: F.greatest(F.abs(low(i)), F.abs(high(i)))
        return F.transform(cells, lambda i: F.struct(i.alias("i"), (off(i) * off(i)).alias("off"), (near(i) * near(i)).alias("near"), (far(i) * far(i)).alias("far")))

    xs, ys, zs = axis("_x"), axis("_y"), axis("_z")
    cell = lambda x, y, z: F.struct(x["i"].alias("cx"), y["i"].alias("cy"), z["i"].alias("cz"), *[(x[c] + y[c] + z[c]).alias(c) for c in ("off", "near", "far")])
    every = F.flatten(F.transform(xs, lambda x: F.flatten(F.transform(ys, lambda y: F.transform(zs, lambda z: cell(x, y, z))))))
    return F.filter(every, lambda c: (c["off"] <= reach * reach) & (c["near"] <= 1 + 1e-9) & (c["far"] >= 1 - 1e-9))


def radius_join(a: DataFrame, b: DataFrame, metres: float, by: str | None = None, block_rows: int = BLOCK_ROWS, stored: bool = False) -> DataFrame:
    """Pairs of a(a_id, a_lat, a_lon) and b(b_id, b_lat, b_lon) within a great-circle distance, with `dist`; by: only pairs whose
    a_<by> and b_<by> are equal.

    Rows meet in the cells of a grid on the unit sphere, as wide as the chord of the distance; b has a copy in each cell that it reaches. A
    cell with more than block_rows rows on a side is dealt over pairs of blocks, so that no task has more than a block of each. Both sides are read
    twice, to count cells and to join, so they are staged unless stored says that they are cheap to read.
    """
    a, b = (a, b) if stored else (staged(a, "radius-a"), staged(b, "radius-b"))
    chord = 2 * math.sin(min(metres / EARTH_RADIUS, math.pi) / 2)
    reach = chord * (1 + 1e-9) + 1e-12
    side = min(max(reach, 1e-7), 2.0)
    place = ["_cx", "_cy", "_cz", *(["_by"] if by else [])]
    here = F.explode(F.array(F.struct(*[F.floor(F.col(v) / side).alias(f"c{v[1]}") for v in ("_x", "_y", "_z")])))
    sides = []
    for rows, prefix, cells in ((a, "a_", here), (b, "b_", F.explode(_reached(reach, side)))):
        each = _on_sphere(rows, prefix).withColumn("_c", cells).withColumns({f"_c{v}": F.col(f"_c.c{v}") for v in "xyz"}).drop("_c", "_x", "_y", "_z")
        sides.append(each.withColumn("_by", F.col(f"{prefix}{by}")) if by else each)
    counts = [rows.groupBy(*place).agg(F.count("*").alias(n)) for rows, n in zip(sides, ("_na", "_nb"), strict=True)]
    total = counts[0].agg(F.coalesce(F.sum("_na"), F.lit(0)).alias("_ta")).join(counts[1].agg(F.coalesce(F.sum("_nb"), F.lit(0)).alias("_tb")))  # one row
    limits = {n: F.greatest(F.lit(block_rows), F.col(t) / HOT_CELLS) for n, t in (("_na", "_ta"), ("_nb", "_tb"))}
    hot = counts[0].join(counts[1], place).join(F.broadcast(total), (F.col("_na") > limits["_na"]) | (F.col("_nb") > limits["_nb"]))
    hot = hot.select(*place, *[F.ceil(F.col(n) / limits[n]).cast("int").alias(p) for n, p in (("_na", "_pa"), ("_nb", "_pb"))])
    dealt = []
    for rows, name, own, other in ((sides[0], "a_id", ("_pa", "_i"), ("_pb", "_j")), (sides[1], "b_id", ("_pb", "_j"), ("_pa", "_i"))):
        rows = rows.join(F.broadcast(hot), place, "left").withColumn(own[1], F.coalesce(F.pmod(F.xxhash64(name), F.col(own[0])), F.lit(0)).cast("int"))
        dealt.append(rows.withColumn(other[1], F.explode(F.sequence(F.lit(0), F.coalesce(other[0], F.lit(1)) - 1))).drop("_pa", "_pb"))
    both = dealt[0].join(dealt[1], [*place, "_i", "_j"])
    dist = haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return both.withColumn("dist", dist).where(F.col("dist") <= metres).drop(*place, "_i", "_j")


def radius_pairs(places: DataFrame, metres: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Unordered pairs (src < dst) of places(id, lat, lon) within a distance."""
    places = staged(places.select("id", "lat", "lon"), "places")
    a, b = (places.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "lat", "lon")]) for p in "ab")
    pairs = radius_join(a, b, metres, block_rows=block_rows, stored=True).where("a_id < b_id")
    return pairs.select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "dist")


def nearest(points: DataFrame, places: DataFrame, metres: float = 750.0, k: int = 10) -> DataFrame:
    """For each of points(id, lat, lon), up to k places(id, lat, lon) within a distance, nearest first (ties by id)."""
    a, b = (d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "lat", "lon")]) for p, d in (("a", points), ("b", places)))
    rank = F.row_number().over(W.partitionBy("a_id").orderBy("dist", "b_id"))
    found = radius_join(a, b, metres).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select(F.col("a_id").alias("point_id"), F.col("b_id").alias("place_id"), "dist", "rank")


def update_from(stored: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """stored with its columns overwritten by the non-null ones of new; adds no rows."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return stored.join(fresh, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def interval_segments(points: DataFrame, breaks: DataFrame) -> DataFrame:
    """Points between the breakpoints(user, start_ts, scan_ts) of their user, both ends included, with the segment's number.

    Segment 0 ends at the first start; the last begins at the last scan and has no end. Boundary points are in two segments. Breakpoints lie
    among the points in order of time, so one window finds the last scan up to a point and the start that ends its span; points and breaks never
    multiply.
    """
    order = W.partitionBy("user").orderBy("scan_ts")
    b = breaks.withColumns({"n": F.row_number().over(order), "hi": F.lead("start_ts").over(order)})
    spans = b.select("user", F.struct(F.col("n").alias("segment"), F.col("scan_ts").alias("lo"), "hi").alias("_span"), F.col("scan_ts").alias("_at"))
    first = b.where("n = 1").select("user", F.struct(F.lit(0).alias("segment"), F.lit(None).cast("timestamp").alias("lo"), F.col("start_ts").alias("hi")).alias("_span"), F.lit(None).cast("timestamp").alias("_at"))
    marks = spans.unionByName(first)
    # Spans may overlap at their ends (a start at the scan before), so the last two spans up to a point can hold it.
    both = points.select("*", F.lit(None).cast(marks.schema["_span"].dataType).alias("_span"), F.col("ts").alias("_at"), F.lit(1).alias("_kind")).unionByName(marks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    so_far = W.partitionBy("user").orderBy(F.col("_at").asc_nulls_first(), "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = both.withColumn("_i", F.sum(1 - F.col("_kind")).over(so_far)).withColumn("_last", F.last("_span", ignorenulls=True).over(so_far))
    known = W.partitionBy("user").orderBy(F.col("_at").asc_nulls_first(), "_kind")
    near = near.withColumn("_previous", F.when(F.col("_kind") == 0, F.lag("_last").over(known))).withColumn("_previous", F.last("_previous", ignorenulls=True).over(so_far))
    held = F.filter(F.array("_previous", "_last"), lambda s: s.isNotNull() & (s["lo"].isNull() | (F.col("ts") >= s["lo"])) & (s["hi"].isNull() | (F.col("ts") <= s["hi"])))
    out = near.where("_kind = 1").withColumn("_s", F.explode(held))
    return out.select(*points.columns, F.col("_s.segment").alias("segment"))


def append_checked(kept: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both; ValueError if a key of new is in kept or twice in new."""
    twice = new.groupBy(*keys).count().where("count > 1").limit(1).union(new.join(kept.select(*keys), keys, "left_semi").select(*keys, F.lit(0).cast("long")).limit(1))
    if not twice.isEmpty():
        raise ValueError(f"keys overlap: {keys}")
    return kept.unionByName(new)
