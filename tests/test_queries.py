"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries

from .oracle import TABLES, actual, connect, difference, expected


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


def test_registry():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["source", "value_status", "n_rows"]


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, sf_dir, connection, name):
    got = actual(queries()[name](spark, sf_dir))
    if name in oracle_sql():
        problem = difference(got, expected(connection, oracle_sql()[name]))
        assert not problem, problem


def test_area_view_of_areas_that_share_a_code(spark, sf_dir, tmp_path):
    """A code holds five digits of the key, so that areas with longer keys share the polygons of one code."""
    for name in TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    (tmp_path / "part.parquet").unlink()
    rows = "select * replace (p_partkey % 60 + 100000 as p_partkey) from part where p_partkey < 60 union all select * from part"
    connect(sf_dir).execute(f"copy ({rows}) to '{tmp_path}/part.parquet' (format parquet)")
    view = queries()["area_view"](spark, str(tmp_path))
    want = expected(connect(str(tmp_path)), oracle_sql()["area_view"])
    problem = difference(actual(view), want)
    assert not problem, problem
    assert sum(want[1].values()) > 2 * 260
    # the rows with polygons are made last: their texts are dealt out once, by code
    plan = view._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "floodarea_id" not in top and "fwdcode" in top
