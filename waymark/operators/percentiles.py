"""Exact percentiles by refining histograms: no task ever holds the values, or a map of all distinct ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.sources.tables import staged

#: Bins of a round for each range that still holds a wanted rank.
BINS = 4096
#: Groups of at most so many values are left to Spark's own aggregate, which holds a group's values in one task.
DIRECT = 1 << 17
#: Values closer to zero than this share the first round's middle bin.
_SMALL = 1e-300


def _same(columns: Sequence[str], suffix: str) -> Column:
    """Equal groups, nulls included; without groups all rows are one."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{c}{suffix}")) for c in columns], F.lit(True))


def _suffixed(rows: DataFrame, columns: Sequence[str], suffix: str) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{c}{suffix}" for c in columns})


def exact_percentiles(rows: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), bins: int = BINS, direct: int = DIRECT) -> DataFrame:
    """(by, share, value): the exact percentiles of a column, linear between neighbours, for all shares (0 to 1) and groups at once.

    Each round counts the values of every range that holds a wanted rank in at most `bins` bins, with the least and the greatest value of a bin, so what a
    task keeps is bounded by bins, ranges and groups. The first round's bins are even in the logarithm, the others' in the value, so that a few
    rounds end with any distribution: a rank is found when it is a bin's first or last. Nulls and values that are no numbers are left out. Where no
    group has more than `direct` values, Spark's own exact aggregate does it in one pass.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares must be from 0 to 1")
    by, shares = list(by), [float(s) for s in dict.fromkeys(shares)]
    values = rows.select(*by, F.col(column).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    if (values.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= direct:
        listed = values.groupBy(*by).agg(F.percentile("_x", shares).alias("v")).where("v is not null")
        return listed.select(*by, F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("v").alias("value"))).alias("p")).select(*by, "p.*")
    values = staged(values, "values")
    ends = staged(values.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).where("_n > 0"), "value-ends")
    asked = ends.select(*by, "_n", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("_at", (F.col("_n") - 1) * F.col("share"))
    wanted = asked.select(*by, F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).distinct()
    ranges = ends.select(*by, "_lo", "_hi", F.lit(0).cast("long").alias("_below"))
    found, first = None, True
    while True:
        known = _suffixed(ranges, by, "_r")
        within = values.join(known, _same(by, "_r") & F.col("_x").between(F.col("_lo"), F.col("_hi"))).drop(*[f"{c}_r" for c in by])
        scaled = (lambda v: F.signum(v) * F.log1p(F.abs(v) / _SMALL)) if first else (lambda v: v)
        # Halves, so that no difference overflows.
        part = (scaled(F.col("_x")) / 2 - scaled(F.col("_lo")) / 2) / F.nullif(scaled(F.col("_hi")) / 2 - scaled(F.col("_lo")) / 2, F.lit(0.0))
        binned = within.withColumn("_bin", F.least(F.floor(F.coalesce(part, F.lit(0.0)) * bins), F.lit(bins - 1)))
        counted = binned.groupBy(*by, "_lo", "_below", "_bin").agg(F.count("*").alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        order = W.partitionBy(*by, "_lo").orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        placed = counted.withColumn("_below", F.col("_below") + F.sum("_c").over(order) - F.col("_c"))
        ranks = _suffixed(wanted, by, "_w")
        hits = placed.join(ranks, _same(by, "_w") & (F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_c")))
        hits = staged(hits.select(*by, "_rank", "_below", "_c", "_a", "_b"), "value-bins")
        value = F.when(F.col("_rank") == F.col("_below"), F.col("_a")).when(F.col("_rank") == F.col("_below") + F.col("_c") - 1, F.col("_b")).when(F.col("_a") == F.col("_b"), F.col("_a"))
        hits = hits.withColumn("_v", value)
        done = hits.where("_v is not null").select(*by, "_rank", "_v")
        found = done if found is None else found.unionByName(done)
        left = hits.where("_v is null")
        if left.isEmpty():
            break
        wanted = left.select(*by, "_rank")
        ranges, first = left.select(*by, F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), "_below").distinct(), False
    ends_of = [_suffixed(found.select(*by, F.col("_rank").alias(f"_r{i}"), F.col("_v").alias(f"_v{i}")), by, f"_{i}") for i in (0, 1)]
    out = asked.join(ends_of[0], _same(by, "_0") & (F.col("_r0") == F.floor("_at"))).join(ends_of[1], _same(by, "_1") & (F.col("_r1") == F.ceil("_at")))
    between = (F.ceil("_at") - F.col("_at")) * F.col("_v0") + (F.col("_at") - F.floor("_at")) * F.col("_v1")
    return out.select(*by, "share", F.when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise(between).alias("value"))
