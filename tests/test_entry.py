"""The entry module: every SQL twin has a query, and results equal DuckDB's on the smallest tables."""

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
TEXT = {n for n in entry.queries() if n.startswith("op") and n[2].isdigit()} | {"pipeline"}


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return None if math.isnan(v) else round(float(v), 9) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def test_twins_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - TEXT))
def test_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    found = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(x) for x in r)) for r in df.select(*columns).collect()) == want


#: Queries without a twin, and what holds for their rows.
HELD = {
    "stay_cluster_midpoints": lambda rows: rows and all(55.35 < r.mid_lat < 55.37 and 10.37 < r.mid_lon < 10.39 and r.n > 0 for r in rows),
    "cluster_fences": lambda rows: rows and all(r.corners >= 3 and r.min_x < r.max_x and r.min_y < r.max_y for r in rows),
}


def test_all_others_have_a_twin():
    assert set(entry.queries()) - set(entry.oracle_sql()) - TEXT == set(HELD)


@pytest.mark.parametrize("name", sorted(HELD))
def test_without_twin(spark, name):
    assert HELD[name](entry.queries()[name](spark, str(SF)).collect())


def test_wide_fences_on_borders(spark, tmp_path):
    """Customers right on the border of a diamond, within rounding of it on either side."""
    keys = [13973, 19125, 80253, 86065, 127743, 132895, 189049, 241513, 246665, 541234, 619851, 733621, 899231, 2364838, 2660156]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.read.parquet(str(SF / "nation.parquet")).write.parquet(str(tmp_path / "nation.parquet"))
    con = duckdb.connect()
    for t in ("customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["people_in_wide_fences"]).fetchall(), key=repr)
    got = entry.queries()["people_in_wide_fences"](spark, str(tmp_path)).collect()
    assert sorted(((r.event_id, r.label) for r in got), key=repr) == want and 0 < sum(label is None for _, label in want) < len(keys)
