"""Every catalogue query against its SQL in DuckDB, on the smallest driver tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__
from cadenza.plans import containers, signals  # noqa: F401
from cadenza.plans.catalogue import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) and not v.is_integer() else str(int(v)) if isinstance(v, (bool, int, float)) else str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_band_energy_of_all_bands(spark):
    frames = QUERIES["spectrum_peak_hold"](spark, str(DATA)).select("stream_id").distinct().count()
    got = QUERIES["spectrum_band_energy_all"](spark, str(DATA)).select("stream_id", "frame_no", "band", "energy").collect()
    by = {}
    for r in got:
        by.setdefault((r["stream_id"], r["frame_no"]), {})[r["band"]] = r["energy"]
    assert len({s for s, _ in by}) == frames and all(sorted(x) == list(range(64)) for x in by.values())
    assert any(x[40] > 0 for x in by.values()) and all(x[63] == 0 for x in by.values())
    part = QUERIES["spectrum_band_energy"](spark, str(DATA)).collect()
    assert part and all(by[r["stream_id"], r["frame_no"]][r["band"]] == r["energy"] for r in part)
