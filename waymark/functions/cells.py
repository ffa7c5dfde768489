"""Grid cells: Hilbert-order strings (base 4, 16 or 64) and base-32 geohashes, as Column folds."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import to_utm

#: Greatest precision by bits a character, and the alphabets.
PRECISIONS = {2: 31, 4: 15, 6: 9}
ALPHABETS = {2: "0123", 4: "0123456789abcdef", 6: "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"}
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
COMPASS = {"n": (0, 1), "ne": (1, 1), "e": (1, 0), "se": (1, -1), "s": (0, -1), "sw": (-1, -1), "w": (-1, 0), "nw": (-1, 1)}
PRIME_MERIDIAN = (51.477928, -0.001545)


def check_precision(precision: int, bits: int = 2) -> int:
    """The grid level of a precision; ValueError outside what a character size allows."""
    if bits not in PRECISIONS:
        raise ValueError(f"bits a character must be one of {sorted(PRECISIONS)}")
    if not isinstance(precision, int) or not 0 <= precision <= PRECISIONS[bits]:
        raise ValueError(f"precision must be from 0 to {PRECISIONS[bits]}")
    return precision * bits // 2


def cell_xy(lat: Column, lon: Column, level: int) -> tuple[Column, Column]:
    """Column and row of the grid of 2^level by 2^level cells."""
    side = 1 << level
    at = lambda v, span: F.least(F.lit(side - 1), F.floor((v + span / 2) / span * side)).cast("long")
    return at(lon, 360.0), at(lat, 180.0)


def _curve_steps() -> list[int]:
    """The curve three levels at a time: at 64 * state + 8 * (bits of x) + (bits of y), 4 * (six bits of the code) + the next state. Bit 0 of a state exchanges
    x and y, bit 1 turns both over."""
    out = []
    for at in range(256):
        state, code = at >> 6, 0
        for s in (2, 1, 0):
            rx, ry = at >> 3 + s & 1 ^ state >> 1, at >> s & 1 ^ state >> 1
            rx, ry = (ry, rx) if state & 1 else (rx, ry)
            code = code << 2 | 3 * rx ^ ry
            state ^= 0 if ry else 3 if rx else 1
        out.append(code << 2 | state)
    return out


CURVE = _curve_steps()


def encode_xy(x: Column, y: Column, level: int, bits: int = 2) -> Column:
    """Hilbert-order string of a cell. A step looks up three levels; levels put on top to fill the first step exchange x and y each."""
    if not level:
        return F.lit("")
    groups, low = -(-level // 3), (1 << level) - 1
    table = F.expr(f"array({', '.join(map(str, CURVE))})")
    part = lambda v, s: F.call_function("shiftright", v, s).bitwiseAND(7)

    def step(at: Column) -> Callable[[Column, Column], Column]:
        here = lambda acc, s: acc.bitwiseAND(3) * 64 + part(at["x"], s) * 8 + part(at["y"], s)
        return lambda acc, s: F.shiftleft(F.call_function("shiftright", acc, F.lit(2)), 8) + F.get(table, here(acc, s).cast("int"))

    walk = lambda at: F.aggregate(F.sequence(F.lit(3 * groups - 3), F.lit(0), F.lit(-3)), F.lit((3 * groups - level) % 2).cast("long"), step(at))
    start = F.struct(x.cast("long").bitwiseAND(low).alias("x"), y.cast("long").bitwiseAND(low).alias("y"))
    code = F.shiftrightunsigned(F.get(F.transform(F.array(start), walk), 0), 2)
    if bits == 2:
        return F.lpad(F.conv(code.cast("string"), 10, 4), level, "0")
    size = level * 2 // bits
    digit = lambda i: F.call_function("shiftright", code, ((size - 1 - i) * bits).cast("int")).bitwiseAND((1 << bits) - 1)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.substring(F.lit(ALPHABETS[bits]), (digit(i) + 1).cast("int"), F.lit(1))), "")


def encode(lat: Column, lon: Column, precision: int, bits: int = 2) -> Column:
    level = check_precision(precision, bits)
    return encode_xy(*cell_xy(lat, lon, level), level, bits)


def decode_xy(cell: Column, bits: int = 2) -> Column:
    """struct<x, y, level> of a cell string."""
    digits = F.transform(F.split(cell, ""), lambda ch: F.instr(F.lit(ALPHABETS[bits]), ch) - 1)
    if bits > 2:
        digits = F.flatten(F.transform(digits, lambda d: F.transform(F.sequence(F.lit(bits - 2), F.lit(0), F.lit(-2)), lambda s: F.call_function("shiftright", d, s).bitwiseAND(3))))
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(1).cast("long").alias("side"))

    def step(acc: Column, d: Column) -> Column:
        rx = F.shiftright(d, 1).bitwiseAND(1)
        ry = rx.bitwiseXOR(d.bitwiseAND(1))
        x, y, side = acc["x"], acc["y"], acc["side"]
        turn, flip = ry == 0, (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, side - 1 - x).otherwise(x), F.when(flip, side - 1 - y).otherwise(y)
        return F.struct((F.when(turn, fy).otherwise(fx) + rx * side).alias("x"), (F.when(turn, fx).otherwise(fy) + ry * side).alias("y"), (side * 2).alias("side"))

    # Least significant digit first: each step turns what it has and adds a quadrant around it.
    return F.aggregate(F.reverse(digits), start, step, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y"), F.round(F.log2(acc["side"])).cast("int").alias("level")))


def decode(cell: Column, bits: int = 2) -> Column:
    """struct<lon, lat> of a cell's centre, in that order."""
    at = decode_xy(cell, bits)
    side = F.pow(F.lit(2.0), at["level"])
    return F.struct(((at["x"] + 0.5) / side * 360 - 180).alias("lon"), ((at["y"] + 0.5) / side * 180 - 90).alias("lat"))


def rectangle(cell: Column, bits: int = 2) -> Column:
    """struct<min_lon, min_lat, max_lon, max_lat>."""
    at = decode_xy(cell, bits)
    side = F.pow(F.lit(2.0), at["level"])
    edge = lambda v, n, span: (v + n) / side * span - span / 2
    return F.struct(edge(at["x"], 0, 360).alias("min_lon"), edge(at["y"], 0, 180).alias("min_lat"), edge(at["x"], 1, 360).alias("max_lon"), edge(at["y"], 1, 180).alias("max_lat"))


def neighbours(x: Column, y: Column, level: int, bits: int = 2) -> Column:
    """map of compass point -> cell string; columns wrap around, rows beyond a pole are left out."""
    side = 1 << level
    pairs = [F.struct(F.lit(k).alias("key"), F.when((y + dy >= 0) & (y + dy < side), encode_xy(F.pmod(x + dx, F.lit(side)), y + dy, level, bits)).alias("value")) for k, (dx, dy) in COMPASS.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))


def base32(lat: Column, lon: Column, precision: int) -> Column:
    """Geohash with interleaved bits, longitude first."""
    n = 5 * precision
    lon_bits, lat_bits = (n + 1) // 2, n // 2
    at = lambda v, span, b: F.least(F.lit((1 << b) - 1), F.floor((v + span / 2) / span * (1 << b))).cast("long")
    x, y = at(lon, 360.0, lon_bits), at(lat, 180.0, lat_bits)

    def bit(i: int) -> Column:
        return F.shiftright(x, lon_bits - 1 - i // 2).bitwiseAND(1) if i % 2 == 0 else F.shiftright(y, lat_bits - 1 - i // 2).bitwiseAND(1)

    def letter(k: int) -> Column:
        code = sum((bit(5 * k + i) * (16 >> i) for i in range(1, 5)), bit(5 * k) * 16)
        return F.substring(F.lit(BASE32), (code + 1).cast("int"), F.lit(1))

    return F.concat(*[letter(k) for k in range(precision)])


def base32_centre(cell: Column) -> Column:
    """struct<lat, lon> of a geohash's centre."""
    start = F.struct(F.lit(-90.0).alias("s"), F.lit(90.0).alias("n"), F.lit(-180.0).alias("w"), F.lit(180.0).alias("e"), F.lit(True).alias("even"))
    bits = F.flatten(F.transform(F.split(cell, ""), lambda ch: F.transform(F.sequence(F.lit(4), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", F.instr(F.lit(BASE32), ch) - 1, k).bitwiseAND(1))))

    def step(acc: Column, b: Column) -> Column:
        lat, lon, up = (acc["s"] + acc["n"]) / 2, (acc["w"] + acc["e"]) / 2, b == 1
        return F.struct(
            F.when(~acc["even"] & up, lat).otherwise(acc["s"]).alias("s"),
            F.when(~acc["even"] & ~up, lat).otherwise(acc["n"]).alias("n"),
            F.when(acc["even"] & up, lon).otherwise(acc["w"]).alias("w"),
            F.when(acc["even"] & ~up, lon).otherwise(acc["e"]).alias("e"),
            (~acc["even"]).alias("even"),
        )

    return F.aggregate(bits, start, step, lambda a: F.struct(((a["s"] + a["n"]) / 2).alias("lat"), ((a["w"] + a["e"]) / 2).alias("lon")))


def centre_to_north(lat: float, lon: float, precision: int, bits: int = 2) -> tuple[Column, Column, Column, Column]:
    """UTM easting and northing of the centre of a cell and of its northern neighbour."""
    level = check_precision(precision, bits)
    side = 1 << level
    x, y = min(side - 1, int((lon + 180) / 360 * side)), min(side - 1, int((lat + 90) / 180 * side))
    centre = lambda row: ((row + 0.5) / side * 180 - 90, (x + 0.5) / side * 360 - 180)
    zone = int((centre(y)[1] + 180) // 6) + 1
    return (*to_utm(*centre(y), zone), *to_utm(*centre(y + 1), zone))


@lru_cache(maxsize=128)
def cell_spacing(precision: int, bits: int = 2, lat: float = PRIME_MERIDIAN[0], lon: float = PRIME_MERIDIAN[1]) -> float:
    """Metres between the centres of a cell and its northern neighbour; one number for the whole plan."""
    from pyspark.sql import SparkSession

    e0, n0, e1, n1 = centre_to_north(lat, lon, precision, bits)
    return SparkSession.getActiveSession().range(1).select(F.hypot(e1 - e0, n1 - n0)).first()[0]
