"""Geodesy as Column expressions. Angles in degrees, lengths in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere, metres a degree, WGS84 and UTM.
EARTH_RADIUS = 6_371_000.0
METRES_A_DEGREE = 1000 * 10000.8 / 90
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EASTING = 500_000.0

Number = Column | float


def _c(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1: Number, lon1: Number, lat2: Number, lon2: Number) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _flat(lat1: Column, lon1: Column, lat2: Column, lon2: Column, legacy: bool) -> tuple[Column, Column]:
    shrink = F.cos(F.radians((lat1 + lat2) / 2))
    north, east = (lat2 - lat1) * METRES_A_DEGREE, (lon2 - lon1) * METRES_A_DEGREE
    return (north * shrink, east) if legacy else (north, east * shrink)


def equirectangular(lat1: Number, lon1: Number, lat2: Number, lon2: Number, legacy: bool = False) -> Column:
    """legacy: the cosine shrinks the latitude difference instead of the longitude difference."""
    north, east = _flat(*map(_c, (lat1, lon1, lat2, lon2)), legacy)
    return F.sqrt(north * north + east * east)


def manhattan(lat1: Number, lon1: Number, lat2: Number, lon2: Number, legacy: bool = False) -> Column:
    north, east = _flat(*map(_c, (lat1, lon1, lat2, lon2)), legacy)
    return F.abs(north) + F.abs(east)


def distance(lat1: Number, lon1: Number, lat2: Number, lon2: Number, exact: bool = False, legacy: bool = False) -> Column:
    """Haversine if asked for or where a coordinate differs by more than 0.2 degrees, else equirectangular."""
    args = tuple(map(_c, (lat1, lon1, lat2, lon2)))
    far = F.lit(exact) | (F.abs(args[2] - args[0]) > 0.2) | (F.abs(args[3] - args[1]) > 0.2)
    return F.when(far, haversine(*args)).otherwise(equirectangular(*args, legacy))


def bearing(lat1: Number, lon1: Number, lat2: Number, lon2: Number) -> Column:
    """Initial compass bearing from 0 to 360."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y, x = F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lat: Number, lon: Number, radians: Number, metres: Number) -> tuple[Column, Column]:
    """(lat, lon) at a bearing in radians and a distance on the sphere."""
    lat, lon, way, d = map(_c, (lat, lon, radians, metres))
    a, d = F.radians(lat), d / EARTH_RADIUS
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(way))
    east = F.atan2(F.sin(way) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.degrees(to), lon + F.degrees(east)


def polar(lat: Number, lon: Number) -> tuple[Column, Column]:
    lat, lon = _c(lat), _c(lon)
    return F.hypot(lat, lon), F.atan2(lat, lon)


def utm_zone(lon: Number) -> Column:
    return F.floor((_c(lon) + 180) / 6).cast("int") + 1


def to_utm(lat: Number, lon: Number, zone: Column | int | None = None) -> tuple[Column, Column]:
    """(easting, northing) by the transverse Mercator series; zone: that of lon unless given."""
    lat, lon = _c(lat), _c(lon)
    zone = utm_zone(lon) if zone is None else F.lit(zone) if isinstance(zone, int) else zone
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
    n = WGS84_A / F.sqrt(1 - e2 * sin * sin)
    t, c = tan * tan, ep2 * cos * cos
    a = F.radians(lon - (zone * 6 - 183)) * cos
    m = WGS84_A * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi)
        - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    a2 = a * a
    east = UTM_SCALE * n * a * (1 + a2 / 6 * (1 - t + c) + a2 * a2 / 120 * (5 - 18 * t + t * t + 72 * c - 58 * ep2)) + UTM_EASTING
    north = UTM_SCALE * (m + n * tan * a2 / 2 * (1 + a2 / 12 * (5 - t + 9 * c + 4 * c * c) + a2 * a2 / 360 * (61 - 58 * t + t * t + 600 * c - 330 * ep2)))
    return east, north + F.when(lat < 0, 10_000_000.0).otherwise(0.0)


def from_utm(east: Number, north: Number, zone: Column | int) -> tuple[Column, Column]:
    """(lat, lon) of northern UTM coordinates."""
    east, north, zone = _c(east), _c(north), F.lit(zone) if isinstance(zone, int) else zone
    e2 = WGS84_F * (2 - WGS84_F)
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    mu = north / UTM_SCALE / (WGS84_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)

    def place(phi: Column) -> Column:
        sin, cos, tan = F.sin(phi), F.cos(phi), F.tan(phi)
        n = WGS84_A / F.sqrt(1 - e2 * sin * sin)
        parts = {"phi": phi, "tan": tan, "cos": cos, "n": n, "r": WGS84_A * (1 - e2) / F.pow(1 - e2 * sin * sin, 1.5), "t": tan * tan, "c": ep2 * cos * cos, "d": (east - UTM_EASTING) / (n * UTM_SCALE)}
        return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in parts.items()])), series), 0)

    def series(p: Column) -> Column:
        phi, tan, cos, n, r, t, c, d = (p[k] for k in ("phi", "tan", "cos", "n", "r", "t", "c", "d"))
        d2 = d * d
        lat = phi - n * tan / r * d2 * (F.lit(0.5) - d2 / 24 * (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) + d2 * d2 / 720 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c))
        lon = d * (1 - d2 / 6 * (1 + 2 * t + c) + d2 * d2 / 120 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t)) / cos
        return F.struct(F.degrees(lat).alias("lat"), F.degrees(lon).alias("lon"))

    at = F.get(F.transform(F.array(phi), place), 0)  # each step is worked out once
    return at["lat"], at["lon"] + (zone * 6 - 183)


def polyline_points(encoded: Column, precision: float = 1e-6) -> Column:
    """Array of (lat, lon) of a polyline string: differences in zig-zag groups of five bits."""
    codes = F.transform(F.split(encoded, ""), lambda ch: F.ascii(ch) - 63)
    start = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("shift"), F.array().cast("array<long>").alias("out"))

    def step(acc: Column, code: Column) -> Column:
        value = acc["value"] + F.call_function("shiftleft", code.bitwiseAND(31).cast("long"), acc["shift"])
        signed = F.when(value.bitwiseAND(1) == 1, F.bitwise_not(F.shiftright(value, 1))).otherwise(F.shiftright(value, 1))
        done = code < 32
        return F.struct(F.when(done, F.lit(0).cast("long")).otherwise(value).alias("value"), F.when(done, 0).otherwise(acc["shift"] + 5).alias("shift"), F.when(done, F.concat(acc["out"], F.array(signed))).otherwise(acc["out"]).alias("out"))

    steps = F.aggregate(F.filter(codes, lambda c: c >= 0), start, step, lambda acc: acc["out"])
    # Differences alternate: a latitude waits for its longitude.
    total = F.struct(F.lit(0).cast("long").alias("lat"), F.lit(0).cast("long").alias("lon"), F.lit(False).alias("waits"), F.array().cast("array<struct<lat:double,lon:double>>").alias("out"))

    def add(acc: Column, d: Column) -> Column:
        lat, lon = F.when(acc["waits"], acc["lat"]).otherwise(acc["lat"] + d), F.when(acc["waits"], acc["lon"] + d).otherwise(acc["lon"])
        point = F.array(F.struct((lat * precision).alias("lat"), (lon * precision).alias("lon")))
        return F.struct(lat.alias("lat"), lon.alias("lon"), (~acc["waits"]).alias("waits"), F.when(acc["waits"], F.concat(acc["out"], point)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, total, add, lambda acc: acc["out"])


def polyline_encoded(points: Column, precision: float = 1e-6) -> Column:
    """The polyline string of an array of (lat, lon): polyline_points() gives the points back, rounded to the precision."""
    whole = F.transform(points, lambda p: F.struct(F.round(p["lat"] / precision).cast("long").alias("a"), F.round(p["lon"] / precision).cast("long").alias("b")))

    def groups(d: Column) -> Column:
        """Zig-zag, then five bits at a time from the low end; all but the last carry a flag."""
        turned = F.when(d < 0, F.bitwise_not(F.shiftleft(d, 1))).otherwise(F.shiftleft(d, 1))
        last = F.greatest(F.ceil(F.length(F.bin(turned)) / 5).cast("int") - 1, F.lit(0))
        low = lambda k: F.call_function("shiftright", turned, k * 5).bitwiseAND(31)
        return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda k: F.char(low(k) + F.when(k < last, 32).otherwise(0) + 63)), "")

    before = lambda w, i, c: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(w, i - 1)[c])
    return F.get(F.transform(F.array(whole), lambda w: F.array_join(F.transform(w, lambda p, i: F.concat(groups(p["a"] - before(w, i, "a")), groups(p["b"] - before(w, i, "b")))), "")), 0)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment in plane coordinates."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(F.lit(0.0))
    return F.hypot(px - ax - t * dx, py - ay - t * dy)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether (x, y) is inside a ring, an array of struct<x, y> that need not repeat its first point."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))
    return (n >= 3) & (F.size(hits) % 2 == 1)


def _segments(path: Column) -> Column:
    """array<struct<a, b, n>>: the segments of a path (array<struct<x, y>>) and their lengths."""
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("n"))
    m = F.greatest(F.size(path) - 1, F.lit(0))
    return F.zip_with(F.slice(path, F.lit(1), m), F.slice(path, F.lit(2), m), pair)


def path_length(path: Column) -> Column:
    """Length of a path, an array<struct<x, y>> in plane coordinates; 0 for one point or none."""
    return F.aggregate(_segments(path), F.lit(0.0), lambda acc, s: acc + s["n"])


def point_along(path: Column, metres: Column) -> Column:
    """struct<x, y> so far along a path; its ends for lengths below 0 or beyond it. A path needs two points or more."""
    start = F.struct(F.lit(0.0).alias("done"), F.get(path, 0).alias("p"))

    def step(acc: Column, s: Column) -> Column:
        part = F.when(s["n"] > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (metres - acc["done"]) / s["n"]))).otherwise(F.lit(0.0))
        at = F.struct((s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * part).alias("x"), (s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * part).alias("y"))
        return F.struct((acc["done"] + s["n"]).alias("done"), F.when(metres > acc["done"], at).otherwise(acc["p"]).alias("p"))

    return F.aggregate(_segments(path), start, step, lambda acc: acc["p"])


def near_path(x: Column, y: Column, path: Column, metres: Column | float) -> Column:
    """Whether a point is within a buffer of so many metres around a path."""
    return F.exists(_segments(path), lambda s: segment_distance(x, y, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]) <= metres)
