"""Token sequences (arrays of strings) as Column expressions, and pluggable scoring functions."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.cells import check_precision, encode, encode_xy
from waymark.functions.geo import from_utm, to_utm, utm_zone

TOKENS = "array<string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def drop_repeats(tokens: Column) -> Column:
    """The first of each run of equal tokens."""
    add = lambda done, t: F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1) == t), done).otherwise(F.concat(done, F.array(t)))
    return F.aggregate(tokens, F.array().cast(TOKENS), add)


def contains_run(tokens: Column, run: Column) -> Column:
    """Whether run is a contiguous part of tokens; an empty run is part of any."""
    n, m = F.size(tokens), F.size(run)
    return F.when(m == 0, True).when(m > n, False).otherwise(F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), n - m + 1)), lambda i: F.slice(tokens, i, m) == run))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table for each token of a."""
    zero = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(above: Column, x: Column) -> Column:
        cells = F.arrays_zip(b.alias("y"), F.slice(above, F.lit(2), F.size(b)).alias("up"), F.slice(above, F.lit(1), F.size(b)).alias("corner"))
        add = lambda done, c: F.concat(done, F.array(F.when(c["y"] == x, c["corner"] + 1).otherwise(F.greatest(c["up"], F.element_at(done, -1)))))
        return F.aggregate(cells, F.array(F.lit(0)), add)

    return F.element_at(F.aggregate(a, zero, row), -1)


def line_cells(lat1: Column, lon1: Column, lat2: Column, lon2: Column, precision: int, spacing: float, bits: int = 2) -> Column:
    """Cells of equally spaced points of the straight UTM line between two points, both ends included, without repeats.

    The zone is that of the first point; a line shorter than a cell still gives both ends.
    """
    check_precision(precision, bits)
    zone = utm_zone(lon1)
    (e1, n1), (e2, n2) = to_utm(lat1, lon1, zone), to_utm(lat2, lon2, zone)
    ends = F.struct(zone.alias("zone"), e1.alias("e1"), n1.alias("n1"), e2.alias("e2"), n2.alias("n2"))

    def cells(line: Column) -> Column:
        count = F.greatest(F.lit(2), F.floor(F.hypot(line["e2"] - line["e1"], line["n2"] - line["n1"]) / spacing).cast("int") + 1)
        return let(F.struct(line.alias("l"), count.alias("n")), lambda x: F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda i: cell(x["l"], i / (x["n"] - 1))))

    def cell(line: Column, part: Column) -> Column:
        lat, lon = from_utm(line["e1"] + (line["e2"] - line["e1"]) * part, line["n1"] + (line["n2"] - line["n1"]) * part, line["zone"])
        return let(F.struct(lat.alias("lat"), lon.alias("lon")), lambda p: encode(p["lat"], p["lon"], precision, bits))

    return drop_repeats(let(ends, cells))


def interpolated(cells: Column, between: Column) -> Column:
    """A sequence of cells with the cells between neighbours (an array for each pair) put in, joints once; one token or none comes back as it is."""
    pairs = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), lambda c, i: F.concat(F.get(between, i), F.array(c)))
    return F.when(F.size(cells) < 2, cells).otherwise(drop_repeats(F.concat(F.slice(cells, 1, 1), F.flatten(pairs))))


class ScoringFunction:
    """A named function of two token lists with a float result; tried on random lists when it is made."""

    def __init__(self, fn: Callable[..., float], *args, **kwargs):
        self.fn, self.args, self.kwargs = fn, args, kwargs
        rng = random.Random(5)
        for _ in range(5):
            a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 6))] for _ in range(2))
            if not isinstance(float(fn(a, b, *args, **kwargs)), float):
                raise TypeError("a scoring function must return a float")

    def column(self, a: Column, b: Column) -> Column:
        fn, args, kwargs = self.fn, self.args, self.kwargs

        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([float(fn(list(p), list(q), *args, **kwargs)) for p, q in zip(x, y, strict=True)])

        return run(a, b)


def ensemble(a: Column, b: Column, weighted: dict[str, tuple[ScoringFunction | None, float]] | None = None) -> Column:
    """Weighted sum of scores over the length of a; by default the common subsequence with weight 1 (None stands for it)."""
    total = F.lit(0.0)
    for fn, weight in (weighted or {"alignment": (None, 1.0)}).values():
        total = total + weight * (common_subsequence(a, b).cast("double") if fn is None else fn.column(a, b))
    return F.when(F.size(a) > 0, total / F.size(a)).otherwise(0.0)


def _walk(x: float, y: float, x2: float, y2: float) -> list[tuple[int, int]]:
    """Grid cells that a segment crosses, in order; a corner counts as a step in x, then in y."""
    cell = [math.floor(x), math.floor(y)]
    move = (x2 - x, y2 - y)
    step = [1 if d > 0 else -1 for d in move]
    left = [abs(math.floor(b) - c) for b, c in zip((x2, y2), cell, strict=True)]
    # Part of the way at the next grid line on each axis; both axes have as many lines as lie between the ends.
    ahead = lambda k: ((cell[k] + (step[k] > 0)) - (x, y)[k]) / move[k] if left[k] else math.inf
    out = [tuple(cell)]
    while left[0] or left[1]:
        k = 0 if ahead(0) <= ahead(1) else 1
        cell[k] += step[k]
        left[k] -= 1
        out.append(tuple(cell))
    return out


def crossed_cells(lat1: Column, lon1: Column, lat2: Column, lon2: Column, precision: int, bits: int = 2) -> Column:
    """All cells that the straight line between two points crosses, in order.

    The walk is a loop without a length known before, so it runs on Arrow batches; the names of its cells are Column folds.
    """
    level = check_precision(precision, bits)
    side = 1 << level

    @F.pandas_udf("array<struct<x:long,y:long>>")
    def walk(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        at = lambda lat, lon: ((lon + 180) / 360 * side, (lat + 90) / 180 * side)
        return pd.Series([None if any(v is None or v != v for v in p) else [{"x": x, "y": y} for x, y in _walk(*at(p[0], p[1]), *at(p[2], p[3]))] for p in zip(a, b, c, d, strict=True)])

    return F.transform(walk(lat1, lon1, lat2, lon2), lambda p: encode_xy(p["x"], p["y"], level, bits))
