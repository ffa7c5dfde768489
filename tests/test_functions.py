"""Known answers of the scalar library."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import cells, geo, scalars, sequences


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_hilbert_known_answers(spark):
    lat, lon = F.lit(51.477928), F.lit(-0.001545)
    got = one(spark, *[cells.encode(lat, lon, p).alias(str(p)) for p in (16, 17, 18)])
    assert got == ("1233233233223003", "12332332332230032", "123323323322300320")


@pytest.mark.parametrize("bits, precision", [(2, 20), (4, 10), (6, 6)])
def test_cells_decode_to_their_centre(spark, bits, precision):
    cell = cells.encode(F.lit(55.36), F.lit(10.38), precision, bits)
    centre = spark.range(1).select(cell.alias("c")).select(cells.decode(F.col("c"), bits).alias("p"), "c").first()
    again = one(spark, cells.encode(F.lit(centre.p.lat), F.lit(centre.p.lon), precision, bits))
    assert again[0] == centre.c and abs(centre.p.lat - 55.36) < 0.01


def test_precision_limits():
    for precision, bits in ((32, 2), (16, 4), (10, 6), (-1, 2), (5, 3), (5.0, 2)):
        with pytest.raises(ValueError):
            cells.check_precision(precision, bits)


def test_cell_spacing(spark):
    assert [round(cells.cell_spacing(p), 3) for p in (17, 18, 19)] == [152.809, 76.405, 38.202]


def test_haversine(spark):
    assert one(spark, F.round(geo.haversine(55.367946, 10.405759, 55.364467, 10.392707), 6))[0] == pytest.approx(911.03646983, abs=1e-5)


def test_utm_returns(spark):
    e, n = geo.to_utm(F.lit(55.36), F.lit(10.38))
    lat, lon = geo.from_utm(e, n, 32)
    got = one(spark, lat, lon, e)
    assert got[0] == pytest.approx(55.36, abs=1e-8) and got[1] == pytest.approx(10.38, abs=1e-8) and 580_000 < got[2] < 590_000


def test_base32(spark):
    assert one(spark, cells.base32(F.lit(57.64911), F.lit(10.40744), 11))[0] == "u4pruydqqvj"


def test_polyline(spark):
    got = one(spark, geo.polyline_points(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@"), 1e-5), geo.polyline_points(F.lit("")))
    assert [(round(p.lat, 5), round(p.lon, 5)) for p in got[0]] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)] and got[1] == []


def test_sequences(spark):
    a = lambda s: F.array(*[F.lit(c) for c in s])
    got = one(spark, sequences.common_subsequence(a("1234"), a("29347")), sequences.contains_run(a("1234"), a("123")), sequences.contains_run(a("2345"), a("124")), sequences.drop_repeats(a("aabba")), sequences.ensemble(a("1234"), a("29347")))
    assert got == (3, True, False, ["a", "b", "a"], 0.75)


def test_scoring_functions_are_tried(spark):
    shared = sequences.ScoringFunction(lambda a, b: float(len(set(a) & set(b))))
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert rows.select(sequences.ensemble(F.col("a"), F.col("b"), {"set": (shared, 0.5), "alignment": (None, 0.5)})).first()[0] == 0.5
    with pytest.raises((TypeError, ValueError)):
        sequences.ScoringFunction(lambda a, b: "x")


def test_ring(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    assert one(spark, geo.in_ring(F.lit(1.0), F.lit(3.0), ring), geo.in_ring(F.lit(5.0), F.lit(3.0), ring)) == (True, False)


def test_times_and_keys(spark):
    got = one(spark, scalars.unix_seconds(F.lit("2021-08-26 12:04:24.001").cast("timestamp")), scalars.parse_time(F.lit("nonsense")), scalars.colour_hex(F.lit(255)), scalars.colour_rgb(F.lit(0x010203)), scalars.unix_seconds(F.lit(None).cast("timestamp")))
    assert got == (1629979464.001, None, "#0000ff", [1, 2, 3], None)
    assert scalars.period_micros("2.5T") == 150_000_000
    for bad in ("5m", "T", 5, "-1T"):
        with pytest.raises(ValueError):
            scalars.period_micros(bad)


def test_queue_ranges_like_python(spark):
    items = list(range(20))
    pairs = [(a, b) for a in range(-20, 20, 3) for b in range(-20, 20, 3)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", scalars.range_slice(F.lit(items), F.col("a"), F.col("b")).alias("got"))
    for r in rows.collect():
        lo, hi = (x + 20 if x < 0 else x for x in (r.a, r.b))
        assert r.got == items[lo : hi + 1]


def test_crossed_cells(spark):
    assert sequences._walk(0.5, 0.5, 3.5, 0.6) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert sequences._walk(2.5, 2.5, 0.4, 0.3)[-1] == (0, 0) and sequences._walk(1.2, 1.2, 1.4, 1.3) == [(1, 1)]
    rows = spark.createDataFrame([(55.36, 10.38, 55.361, 10.382)], "a double, b double, c double, d double")
    got = rows.select(sequences.crossed_cells(*[F.col(c) for c in "abcd"], 20).alias("w"), cells.encode(F.col("a"), F.col("b"), 20).alias("first"), cells.encode(F.col("c"), F.col("d"), 20).alias("last")).first()
    assert got.w[0] == got["first"] and got.w[-1] == got["last"] and len(set(got.w)) == len(got.w) > 2
