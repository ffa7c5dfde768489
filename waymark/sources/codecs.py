"""JSON forms of points, sensors and trajectories, GeoJSON exports, ingest checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOTION = "struct<x:double,y:double,z:double,external_timestamp:timestamp>"
MAGNET = "struct<x:double,y:double,z:double,magnitude:double,internal_timestamp:timestamp>"
MEMBER = "latitude:double,longitude:double,external_timestamp:timestamp"
POINT = f"struct<latitude:double,longitude:double,weight:double,dx:double,dt:double,speed:double,acceleration:double,accuracy:double,external_timestamp:timestamp,user:string,label:string,trajectory:string,datapoints:array<struct<{MEMBER}>>,magnetometer_data:{MAGNET},device_motion_data:{MOTION}>"
TRAJECTORY = f"struct<uid:string,color:string,user:string,tag:string,datapoints:array<struct<{MEMBER}>>>"
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def point_json(columns: dict[str, Column]) -> Column:
    """A point document of the given fields; fields left out are null."""
    return F.to_json(F.from_json(F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]), EXACT), POINT, EXACT), {**EXACT, "ignoreNullFields": "false"})


def read_point(document: Column) -> Column:
    return F.from_json(document, POINT, EXACT)


def trajectory_json(points: DataFrame, key: str = "user", tag: str = "raw") -> DataFrame:
    """(key, document) with a trajectory's points in order; ValueError-like failure at run time for a null user."""
    each = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("ts").alias("external_timestamp"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", each.alias("p")))), lambda r: r["p"])
    user = F.when(F.col(key).isNull(), F.raise_error(F.lit("a trajectory needs a user"))).otherwise(F.col(key).cast("string"))
    return points.groupBy(key).agg(ordered.alias("datapoints")).select(key, F.to_json(F.struct(F.sha2(user, 256).alias("uid"), user.alias("user"), F.lit(tag).alias("tag"), "datapoints"), EXACT).alias("document"))


def read_trajectories(documents: DataFrame) -> DataFrame:
    """(uid, user, tag, ord, latitude, longitude, external_timestamp) of documents(document)."""
    t = documents.select(F.from_json("document", TRAJECTORY, EXACT).alias("t"))
    return t.select("t.uid", "t.user", "t.tag", F.posexplode("t.datapoints").alias("ord", "p")).select("uid", "user", "tag", "ord", "p.*")


def point_features(points: DataFrame, key: str = "user") -> DataFrame:
    """(key, geojson): a FeatureCollection of each key's points in order."""
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), F.format_string("%.4f", "lon"), F.lit(","), F.format_string("%.4f", "lat"), F.lit(']},"properties":{"id":'), F.col("event_id").cast("string"), F.lit("}}"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", feature.alias("f")))), lambda r: r["f"])
    return points.groupBy(key).agg(ordered.alias("f")).select(key, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("f", ","), F.lit("]}")).alias("geojson"))


def line_features(points: DataFrame, key: str = "user") -> DataFrame:
    """(key, geojson): a LineString of each key's points in order."""
    pair = F.concat(F.lit("["), F.format_string("%.4f", "lon"), F.lit(","), F.format_string("%.4f", "lat"), F.lit("]"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", pair.alias("f")))), lambda r: r["f"])
    return points.groupBy(key).agg(ordered.alias("f")).select(key, F.concat(F.lit('{"type":"LineString","coordinates":['), F.array_join("f", ","), F.lit("]}")).alias("geojson"))


def ingest(frame: DataFrame, user: int) -> DataFrame:
    """A frame of raw points as rows of a user; KeyError if a required column is missing."""
    if missing := {"longitude", "latitude", "external_timestamp"} - set(frame.columns):
        raise KeyError(f"missing columns: {sorted(missing)}")
    return frame.select(F.lit(user).cast("long").alias("user"), F.col("external_timestamp").cast("timestamp").alias("ts"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
