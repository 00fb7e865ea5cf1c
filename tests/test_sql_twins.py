"""Every registered query of the library against its SQL twin."""

import duckdb
import pytest

import __spark_entry__ as entry
from terrafield.plans.fixtures import BASE_TABLES
from terrafield.plans.registry import REGISTRY
from tools.compare_with_sql import compare

def names():
    return [n for n in entry.oracle_sql() if n in REGISTRY]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", names())
def test_same_rows(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert compare(name, got, df.columns, cur.fetchall(), cols) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["place_id", "town_id", "town", "dist_m"] and df.count() > 0


def test_viewsheds_reach_the_default_radius(spark, sf_dir):
    run = lambda name: entry.queries()[name](spark, sf_dir)
    samples = 360 * round(15 * 1609.344 / 50)
    assert {r.samples for r in run("a12_coverage_report").collect()} == {samples}
    assert run("w7_viewshed").filter("step > 161").count() > 0  # beyond five miles
