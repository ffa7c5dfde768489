"""Stores of trajectories, breakpoints, support sets and results as partitioned tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def trajectory_headers(compressed: DataFrame) -> DataFrame:
    """(user, traj_id, start_ts, end_ts, start and end place, n_points): one row a trajectory, from its first and last point."""
    return compressed.groupBy("user", "traj_id").agg(
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
        F.min_by("lat", "ord").alias("start_lat"), F.min_by("lon", "ord").alias("start_lon"),
        F.max_by("lat", "ord").alias("end_lat"), F.max_by("lon", "ord").alias("end_lon"),
        F.count("*").alias("n_points"),
    )


#: Folders of a table. A value's rows are in one of them, sorted, so folders and files do not grow with the number of values.
BUCKETS = 256


def _bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def _bucketed(rows: DataFrame, by: list[str]) -> DataFrame:
    name = f"{by[0]}_bucket"
    dealt = rows.withColumn(name, _bucket(F.col(by[0])))
    return dealt.hint("rebalance", F.col(name)).sortWithinPartitions(name, *by)


def save(rows: DataFrame, path: str, by: list[str], rows_a_file: int = 1_000_000) -> None:
    """Append to a table in folders by the hash of the first of the given columns, sorted by all of them; files are cut by rows."""
    _bucketed(rows, by).write.mode("append").option("maxRecordsPerFile", rows_a_file).partitionBy(f"{by[0]}_bucket").parquet(path)


def replace(rows: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite what is stored under the values that rows has in the given columns, no others."""
    name, rows = f"{by[0]}_bucket", staged(rows, "replacing")
    new = rows.withColumn(name, _bucket(F.col(by[0])))
    stored = rows.sparkSession.read.parquet(path)
    touched = stored.join(F.broadcast(new.select(name).distinct()), name, "left_semi").drop(name)
    kept = touched.join(rows.select(*by).distinct(), by, "left_anti")
    both = staged(kept.unionByName(rows), "replaced")
    _bucketed(both, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def newest_first(headers: DataFrame, user: int) -> DataFrame:
    return headers.where(F.col("user") == user).orderBy(F.col("start_ts").desc(), "traj_id")


def load(spark: SparkSession, path: str, **equal) -> DataFrame:
    """A stored table, pruned to the folders of the given values."""
    rows = spark.read.parquet(path)
    for column, value in equal.items():
        if f"{column}_bucket" in rows.columns:
            rows = rows.where(F.col(f"{column}_bucket") == _bucket(F.lit(value).cast(rows.schema[column].dataType)))
        rows = rows.where(F.col(column) == value)
    return rows.drop(*[c for c in rows.columns if c.endswith("_bucket")])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for intermediate tables in the folder that all executors share (spark.checkpoint.dir, else the warehouse; on one machine
    without it a temporary folder, deleted at the end)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root is None and spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root or spark.conf.get('spark.sql.warehouse.dir')}/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the shared folder and read back: what uses them several times reads them, and a lost executor costs a reread."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def closed(breaks: DataFrame) -> DataFrame:
    """The breakpoints that are stored: those whose stay has ended."""
    return breaks.where("last_ts is not null")


def clear(spark: SparkSession, path: str, by: str, values: list) -> None:
    """Takes the rows whose `by` is one of the values out of a stored table; only their folders are written anew."""
    name, stored = f"{by}_bucket", spark.read.parquet(path)
    kind = stored.schema[by].dataType
    found = spark.range(1).select(F.explode(F.array_distinct(F.array(*[_bucket(F.lit(v).cast(kind)) for v in values]))).alias("b")).collect() if values else []
    buckets = [r.b for r in found]
    kept = staged(stored.where(F.col(name).isin(buckets) & ~F.coalesce(F.col(by).isin(values), F.lit(False))).drop(name), "cleared")
    for bucket in buckets:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}={bucket}")
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    save(kept, path, [by])


def into_table(path: str, by: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch is a folder of its own (batch=...), so a batch that runs again replaces itself."""

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/batch={batch}")

    return sink


def into_documents(path: str) -> Callable[[DataFrame, int], None]:
    """The same with each row as a JSON document."""

    def sink(rows: DataFrame, batch: int) -> None:
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(f"{path}/batch={batch}")

    return sink
