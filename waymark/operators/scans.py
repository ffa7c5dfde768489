"""Ordered scans where one user may hold a large share of all rows: blocks of time are scanned apart and meet through summaries.

A user with more rows than a task should have is cut into blocks of time of about equal size. First pass: windows inside each block. A block is
summarised by its last row, its sums and its least values; the summaries of the blocks before it, combined in order, are what a block carries in. Second
pass: each row adds its block's carry. Only summaries of cut users are ever ordered as a whole, and there are at most about 2 * HOT_USERS of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geo import haversine
from waymark.functions.scalars import seconds_between

#: A user is cut if it has more than 1 / HOT_USERS of all rows and more than BLOCK_ROWS.
HOT_USERS = 1024
BLOCK_ROWS = 1 << 16
#: Steps of the quantiles that borders of blocks are taken from.
STEPS = 1024


def blocked(rows: DataFrame, key: str, time: str = "ts", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with `_block`: null for a user that is not cut, else the number of its block of time. Rows of one time are in one block."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    limit = max(block_rows, (counts.agg(F.sum("_n")).first()[0] or 0) // HOT_USERS)
    hot = counts.where(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    at = F.unix_micros(F.col(time).cast("timestamp"))
    steps = F.array(*[F.lit(i / STEPS) for i in range(1, STEPS)])
    own = rows.join(F.broadcast(hot), key).groupBy(key, "_parts").agg(F.percentile_approx(at, steps, 4 * STEPS).alias("_q"))
    borders = F.transform(F.sequence(F.lit(1), F.greatest(F.col("_parts") - 1, F.lit(1))), lambda i: F.get("_q", F.floor(i * STEPS / F.col("_parts")).cast("int") - 1))
    cut = own.select(key, F.array_distinct(borders).alias("_borders"))
    joined = rows.join(F.broadcast(cut), key, "left").withColumn("_at", at)
    # The number of borders before the time, by halving steps.
    powers = F.array(*[F.lit(1 << i) for i in range(STEPS.bit_length() - 1, -1, -1)])
    found = F.aggregate(powers, F.lit(0), lambda n, step: F.when(F.coalesce(F.get("_borders", n + step - 1) < F.col("_at"), F.lit(False)), n + step).otherwise(n))
    return joined.withColumn("_block", F.when(F.col("_borders").isNotNull(), found)).drop("_borders", "_at")


@dataclass
class Scan:
    """What to work out for each row, by name: lags of columns, running sums and least values of expressions, the last value that is not null."""

    lags: dict[str, str] = field(default_factory=dict)
    sums: dict[str, Column] = field(default_factory=dict)
    least: dict[str, Column] = field(default_factory=dict)
    last: dict[str, Column] = field(default_factory=dict)


def scanned(rows: DataFrame, scan: Scan, key: str, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """blocked() rows with the columns of the scan, as windows over each whole user would give them."""
    inside = W.partitionBy(key, "_block").orderBy(*order)
    run = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    values = rows.withColumns({f"_s_{n}": c for kind in (scan.sums, scan.least, scan.last) for n, c in kind.items()})
    own = {f"_o_{n}": F.lag(F.struct(F.col(c).alias("v"))).over(inside) for n, c in scan.lags.items()}
    own |= {f"_o_{n}": F.sum(f"_s_{n}").over(run) for n in scan.sums} | {f"_o_{n}": F.min(f"_s_{n}").over(run) for n in scan.least} | {f"_o_{n}": F.last(f"_s_{n}", True).over(run) for n in scan.last}
    within = values.withColumns(own)
    at = F.struct(*order)
    summaries = [F.max_by(F.struct(F.col(c).alias("v")), at).alias(n) for n, c in scan.lags.items()]
    summaries += [F.sum(f"_s_{n}").alias(n) for n in scan.sums] + [F.min(f"_s_{n}").alias(n) for n in scan.least]
    summaries += [F.max_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), at)).alias(n) for n in scan.last]
    blocks = values.where("_block is not null").groupBy(key, "_block").agg(*summaries)
    before = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = {n: F.last(n).over(before) for n in scan.lags} | {n: F.sum(n).over(before) for n in scan.sums} | {n: F.min(n).over(before) for n in scan.least} | {n: F.last(n, True).over(before) for n in scan.last}
    carry = blocks.select(key, "_block", *[c.alias(f"_c_{n}") for n, c in carried.items()])
    both = within.join(F.broadcast(carry), [key, "_block"], "left")
    done = {n: F.coalesce(f"_o_{n}", f"_c_{n}")["v"] for n in scan.lags}
    done |= {n: F.when(F.col(f"_c_{n}").isNull(), F.col(f"_o_{n}")).otherwise(F.col(f"_c_{n}") + F.coalesce(f"_o_{n}", F.lit(0))) for n in scan.sums}
    done |= {n: F.least(f"_o_{n}", f"_c_{n}") for n in scan.least} | {n: F.coalesce(f"_o_{n}", f"_c_{n}") for n in scan.last}
    names = [*scan.lags, *scan.sums, *scan.least, *scan.last]
    return both.withColumns(done).drop(*[f"{p}{n}" for n in names for p in ("_s_", "_o_", "_c_")])


def hot_motion(points: DataFrame, key: str = "user", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """motion() where one key may hold a large share of the points: dx, dt, speed and acceleration, with `_block` for further scans."""
    rows = scanned(blocked(points, key, block_rows=block_rows), Scan(lags={"_lat": "lat", "_lon": "lon", "_t": "ts"}), key)
    dt = F.coalesce(seconds_between(F.col("_t"), F.col("ts")), F.lit(0.0))
    dx = F.coalesce(haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    rows = rows.withColumns({"dx": dx, "dt": dt}).withColumn("speed", F.when(F.col("dt") > 0, F.col("dx") / F.col("dt")).otherwise(0.0)).drop("_lat", "_lon", "_t")
    rows = scanned(rows, Scan(lags={"_speed": "speed"}), key)
    change = F.when(F.col("dt") > 0, (F.col("speed") - F.coalesce("_speed", F.lit(0.0))) / F.col("dt")).otherwise(0.0)
    return rows.withColumn("acceleration", change).drop("_speed")
