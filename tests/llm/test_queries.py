"""Every corpus query that has SQL against it, on whole tables; and that each operator of the list has a query."""

from __future__ import annotations

import os

import pytest

from fenwright.llm import queries
from tests.test_queries import TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for sf in ("sf0.001", "sf0.01"):
        con.execute(f"CREATE SCHEMA \"{sf}\"")
        for t in TABLES:
            con.execute(f"CREATE VIEW \"{sf}\".{t} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, duck, name, sf):
    found = queries.queries()[name](spark, f"/root/testdata/{sf}")
    rows = found.collect()
    duck.execute(f'USE "{sf}"')
    told = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(found.columns)
    expected = sorted(tuple(plain(r[columns.index(c)]) for c in found.columns) for r in told.fetchall())
    assert sorted(tuple(plain(v) for v in r) for r in rows) == expected


def test_each_operator_has_a_query():
    assert {int(q[2:].split("_")[0]) for q in queries.queries() if q.startswith("op")} == set(range(1, 14))
