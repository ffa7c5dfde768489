"""Nested JSON batches of labelled trajectories: a list of JSON frames whose `df` fields hold JSON frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTER = "struct<columns:array<string>,index:array<long>,data:array<array<string>>>"
#: A frame is one string, however long; a document that cannot be read whole is an error, not a loss.
WHOLE = {"maxStringLen": str(2**31 - 1), "mode": "FAILFAST"}


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """(file, batch, uid, anomalous, ts, latitude, longitude, anom_start)."""
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.posexplode(F.from_json("value", "array<string>", WHOLE)).alias("batch", "frame"))
    outer = text.select("file", "batch", F.from_json("frame", OUTER, WHOLE).alias("o"))
    at = lambda name: F.array_position(F.col("o.columns"), name).cast("int")
    rows = outer.select("file", "batch", F.explode("o.data").alias("r"), *[at(c).alias(f"_{c}") for c in ("df", "uid", "anomalous")])
    rows = rows.select("file", "batch", F.element_at("r", F.col("_uid")).alias("uid"), F.element_at("r", F.col("_anomalous")).cast("boolean").alias("anomalous"), F.element_at("r", F.col("_df")).alias("df"))
    frames = rows.withColumn("f", F.from_json("df", "struct<columns:array<string>,index:array<long>,data:array<array<string>>>", WHOLE))
    each = frames.select("file", "batch", "uid", "anomalous", F.col("f.columns").alias("names"), F.explode(F.arrays_zip(F.col("f.index").alias("ms"), F.col("f.data").alias("v"))).alias("p"))
    pick = lambda name, kind: F.get(F.col("p.v"), F.array_position("names", name).cast("int") - 1).cast(kind)
    return each.select("file", "batch", "uid", "anomalous", F.timestamp_millis("p.ms").alias("ts"), pick("latitude", "double").alias("latitude"), pick("longitude", "double").alias("longitude"), pick("anom_start", "boolean").alias("anom_start"))
