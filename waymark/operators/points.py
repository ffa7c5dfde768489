"""The points view over the event table: a 10 by 10 grid of places, one row an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user, ts, lat, lon, value); only the columns it needs reach the scan."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), "value", k.alias("k"))
    return e.select("event_id", "user", "ts", (F.lit(55.36) + F.floor(F.col("k") / 10) * 0.0002).alias("lat"), (F.lit(10.38) + (F.col("k") % 10) * 0.0003).alias("lon"), "value")
