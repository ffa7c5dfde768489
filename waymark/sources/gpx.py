"""GPX track points through the XML reader and writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACK_POINT = T.StructType([T.StructField(f"_{c}", T.DoubleType()) for c in ("lat", "lon")] + [T.StructField(n, t) for n, t in (("ele", T.DoubleType()), ("time", T.TimestampType()), ("course", T.DoubleType()), ("speed", T.DoubleType()), ("geoidheight", T.DoubleType()), ("src", T.StringType()), ("sat", T.IntegerType()), ("hdop", T.DoubleType()), ("vdop", T.DoubleType()), ("pdop", T.DoubleType()))])


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(latitude, longitude, external_timestamp) of all track points below a path; one scan, in no order."""
    raw = spark.read.format("xml").option("rowTag", "trkpt").schema(TRACK_POINT).load(path)
    return raw.select(F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.col("time").alias("external_timestamp"))


def gpx_points(spark: SparkSession, path: str, user: int = 0) -> DataFrame:
    """The scan as points (event_id, user, ts, lat, lon), in order of time. The id is a hash of time and place, so it does not depend on that order."""
    found = read_gpx(spark, path).orderBy("external_timestamp")
    return found.select(F.xxhash64("external_timestamp", "latitude", "longitude").alias("event_id"), F.lit(user).cast("long").alias("user"), F.col("external_timestamp").alias("ts"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def write_gpx(points: DataFrame, path: str) -> None:
    """Track points of points(ts, lat, lon) as XML, one file a partition."""
    rows = points.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("ts").alias("time"))
    rows.write.format("xml").option("rootTag", "trkseg").option("rowTag", "trkpt").save(path)
