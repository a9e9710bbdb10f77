"""Every query against its DuckDB SQL, at the smallest scale."""

from __future__ import annotations

import math
import os

import pytest

from fenwright import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    rows = found.collect()
    if name not in catalog.oracle_sql():
        return
    told = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(found.columns)
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in found.columns) for r in told.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in rows) == expected


def test_filters_reach_the_scan(spark):
    """A period and a person become predicates of the scan, and only the columns in use are read."""
    from fenwright.operators import cube

    path = spark.createDataFrame([("2024-01-01", "a", "b", "c", 1, 0, "unused")], "order_date string, person string, business string, subcategory string, total_count long, error_count long, extra string")
    import tempfile

    folder = tempfile.mkdtemp()
    path.selectExpr("cast(order_date as date) order_date", "person", "business", "subcategory", "total_count", "error_count", "extra").write.mode("overwrite").parquet(folder)
    view = cube.within(spark.read.parquet(folder), "2024-01-01", "2024-02-01", person="a").groupBy("business").sum("error_count")
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(order_date), IsNotNull(person), GreaterThanOrEqual(order_date" in plan
    assert "extra" not in plan.split("ReadSchema:")[1] and "total_count" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_point_joins_are_equi_joins(spark):
    from fenwright.operators import spatial
    from fenwright.plans import domain

    plan = spatial.within(domain.points(spark, SF), 250.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
