"""Row filters, conditional updates, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions.geo import to_utm
from waymark.operators.percentiles import exact_percentiles
from waymark.sources.tables import staged


def bounding_box(points: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Points strictly inside; KeyError for missing columns, ValueError for inverted bounds."""
    if missing := {"lat", "lon", "ts"} - set(points.columns):
        raise KeyError(f"missing columns: {sorted(missing)}")
    if south >= north or west >= east:
        raise ValueError("a lower bound must be below its upper bound")
    return points.where((F.col("lat") > south) & (F.col("lat") < north) & (F.col("lon") > west) & (F.col("lon") < east))


def heavier(rows: DataFrame, *least: float, column: str = "weight") -> DataFrame:
    return rows.where(F.col(column) > max(least))


def above_percentile(rows: DataFrame, percent: int, column: str = "weight") -> DataFrame:
    """Rows strictly above the exact percentile (linear interpolation); its one row is broadcast."""
    if not isinstance(percent, int) or not 0 < percent < 100:
        raise ValueError("percent must be a whole number between 0 and 100")
    limit = exact_percentiles(rows, column, [percent / 100]).select(F.col("value").alias("_limit"))
    return rows.crossJoin(F.broadcast(limit)).where(F.col(column) > F.col("_limit")).drop("_limit")


def plausible(rows: DataFrame, most: float = 7.0) -> DataFrame:
    return rows.where(F.abs("acceleration") <= most)


def is_noise(lat1: Column, lon1: Column, lat2: Column, lon2: Column, separation: float) -> Column:
    """Whether the step from the last point of a cell is as long as the separation or longer, in the first point's UTM zone."""
    (e1, n1), (e2, n2) = to_utm(lat1, lon1), to_utm(lat2, lon2)
    return F.hypot(e2 - e1, n2 - n1) >= separation


def is_critical(traversed: Column, n: Column, spacing: float, rate: float) -> Column:
    """Whether a cell was barely touched: short way and few points."""
    return (traversed <= spacing / 3) & (n <= spacing / (5 * rate))


def drop_consecutive(rows: DataFrame, column: str, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each run of equal values."""
    before = F.lag(column).over(W.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    return rows.withColumn("_first", first | ~before.eqNullSafe(F.col(column))).where("_first").drop("_first")


def keep_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the last in the given order."""
    w = W.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def any_field_contains(rows: DataFrame, text: str, skip: tuple[str, ...] = ("id",)) -> DataFrame:
    """Rows with a field, but for skip, whose string form holds the text; null counts as empty."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c not in skip]
    return rows.where(F.exists(F.array(*fields), lambda f: F.contains(f, F.lit(text))))


def page(rows: DataFrame, start: int, size: int, order: list[Column]) -> DataFrame:
    """A page of the sorted rows; a start beyond the end is pulled back to the last page."""
    total = rows.count()
    if total and start >= total:
        start = (total - 1) // size * size
    return rows.orderBy(*order).offset(start).limit(size)


def select_rows(rows: DataFrame, matching: Column, flag: bool = True) -> DataFrame:
    """rows with `selected` set where matching holds; a flag set before stays where it does not."""
    before = F.col("selected") if "selected" in rows.columns else F.lit(False)
    return rows.withColumn("selected", F.when(matching, F.lit(flag)).otherwise(before))


def delete_selected(rows: DataFrame, matching: Column) -> DataFrame:
    """rows less those that are selected and match."""
    return rows.where(~(F.col("selected") & F.coalesce(matching, F.lit(False))))


def first_groups(rows: DataFrame, groups: int, key: str, order: list[str]) -> DataFrame:
    """The rows of the first groups only, in order: reading stops after so many tracks."""
    first = rows.groupBy(key).agg(*[F.min(o).alias(o) for o in order]).orderBy(*order, key).limit(groups).select(key)
    return rows.join(F.broadcast(first), key, "left_semi")


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order of the whole table: ranges are sorted apart, and each begins where the counts of those before it end.

    What is put in order as a whole and broadcast is one count for each range.
    """
    ranged = rows.withColumns({f"_k{i}": c for i, c in enumerate(order)})
    ranged = ranged.repartitionByRange(*[F.col(f"_k{i}") for i in range(len(order))]).sortWithinPartitions(*[f"_k{i}" for i in range(len(order))])
    ranged = ranged.drop(*[f"_k{i}" for i in range(len(order))])
    held = staged(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranges")
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).select(*rows.columns, name)


def in_order(rows: DataFrame, column: str, direction: str | None = "asc", collation: str = "UNICODE_CI") -> DataFrame:
    """rows sorted by a column, numbers as numbers and strings by a collation; None leaves them as they are."""
    if direction is None:
        return rows
    if direction not in ("asc", "desc"):
        raise ValueError("direction must be asc, desc or None")
    key = F.collate(F.col(column), collation) if rows.schema[column].dataType.typeName() == "string" else F.col(column)
    return rows.orderBy(key.asc() if direction == "asc" else key.desc())
