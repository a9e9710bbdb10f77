"""Queries by name, with their DuckDB SQL where one exists."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its own name. Its columns `dates` become text, in Spark and in the SQL, as clients differ in dates. Spark
    writes a plus before years of five digits, which goes."""

    def put(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({d: F.ltrim(F.col(d).cast("string"), F.lit("+")) for d in dates})

        QUERIES[f.__name__] = run if dates else f
        if sql:
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'"{d}"::VARCHAR AS "{d}"' for d in dates)}) FROM ({sql})" if dates else sql
        return f

    return put
