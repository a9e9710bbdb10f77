"""Queries of the readers: orders as the cells of truth workbooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenwright.plans import domain as D
from fenwright.registry import query
from fenwright.sources import truth

#: Orders a workbook, months that are read, empty rows that end a sheet.
ORDERS_A_BOOK, MONTHS, BLANK = 5_000, tuple(range(1, 11)), 50


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of the orders, a sheet for each month. Some rows lack a number or a person, are of another month or repeat a number; every
    third workbook has a gap in its sheets that ends them."""
    n = F.col("o_orderkey")
    o = D.order_rows(spark, sf_dir).join(D.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("order_number")), "order_number")
    book = F.floor(n / ORDERS_A_BOOK)
    placed = o.withColumns({"path": F.concat(F.lit("truth-"), book), "month": F.month("order_date"), "book": book})
    nth = F.row_number().over(Window.partitionBy("path", "month").orderBy("o_orderkey"))
    number = F.when(n % 97 == 0, None).when(n % 89 == 0, F.lit("7")).otherwise(F.concat(n.cast("string"), F.lit(".0")))
    day = F.when(n % 83 == 0, F.add_months("order_date", 1)).otherwise(F.col("order_date")).cast("string")
    cells = F.array(number, day, F.when(F.col("cancelled"), truth.CANCELLED).otherwise("완료"), F.when(n % 79 != 0, F.col("person")), F.col("department"), F.col("business"), F.col("subcategory"))
    rows = placed.withColumn("nth", nth).select("path", F.format_string("%d월", "month").alias("sheet"), (F.col("nth") + F.when((F.col("book") % 3 == 0) & (F.col("nth") > 100), 60).otherwise(1)).cast("int").alias("row"), cells.alias("cells"))
    head = rows.select("path", "sheet").distinct().select("*", F.lit(1).alias("row"), F.array(*map(F.lit, truth.COLUMNS)).alias("cells"))
    return rows.unionByName(head)


CELLS = f"""WITH {D.ORDER_ROWS_SQL}, o AS (SELECT *, order_number::BIGINT AS k, 'truth-' || (order_number::BIGINT // {ORDERS_A_BOOK}) AS path, month(order_date) AS month FROM order_rows),
n AS (SELECT *, row_number() OVER (PARTITION BY path, month ORDER BY k) AS nth FROM o),
r AS (SELECT path, month, CASE WHEN k % 97 = 0 THEN NULL WHEN k % 89 = 0 THEN '7' ELSE k::VARCHAR END AS number, CASE WHEN k % 83 = 0 THEN (order_date + INTERVAL 1 MONTH)::DATE ELSE order_date END AS day, cancelled, CASE WHEN k % 79 <> 0 THEN person END AS person, department, business, subcategory, nth + 2 + CASE WHEN (k // {ORDERS_A_BOOK}) % 3 = 0 AND nth > 100 THEN 59 ELSE 0 END AS row
  FROM n WHERE month <= {MONTHS[-1]} AND NOT ((k // {ORDERS_A_BOOK}) % 3 = 0 AND nth > 100)),
j AS (SELECT *, CASE WHEN number IS NULL THEN NULL WHEN department <> '사업부' THEN 'department' WHEN replace(subcategory, ' ', '') = '5-LOW' THEN 'subcategory' WHEN cancelled THEN 'cancelled' ELSE 'truth' END AS scope, row_number() OVER (PARTITION BY number ORDER BY month, path, row) AS again FROM (
  SELECT * REPLACE (CASE business WHEN 'AFRICA' THEN '중부' WHEN 'AMERICA' THEN '북부' ELSE '남부' END AS business) FROM r))"""


def _truth(spark: SparkSession, sf_dir: str) -> truth.Truth:
    cells = _cells(spark, sf_dir)
    named = F.when(F.get("cells", 5) == "AFRICA", "중부").when(F.get("cells", 5) == "AMERICA", "북부").otherwise("남부")
    cells = cells.withColumn("cells", F.when(F.col("row") == 1, F.col("cells")).otherwise(F.transform("cells", lambda c, i: F.when(i == 5, named).otherwise(c))))
    return truth.read(cells, MONTHS, excluded=["5- LOW"], blank_rows=BLANK)


@query(f"""{CELLS}, g AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY month, path, row) AS first FROM j WHERE scope = 'truth' AND person IS NOT NULL AND month(day) = month)
SELECT number AS order_number, day AS order_date, person, business, subcategory, month::INT AS month, month || '월' AS sheet, row::INT AS row FROM g WHERE first = 1""", dates=("order_date",))
def truth_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir).records


@query(f"""{CELLS} SELECT m.month::INT AS month, count(number) AS source_rows, count(*) FILTER (scope = 'truth') AS truth_rows, count(*) FILTER (scope = 'department') AS excluded_department, 0::BIGINT AS excluded_business, count(*) FILTER (scope = 'subcategory') AS excluded_subcategory, count(*) FILTER (scope = 'cancelled') AS excluded_cancelled, count(*) FILTER (j.month IS NOT NULL AND number IS NULL) AS missing_orders
FROM (SELECT unnest(range(1, {MONTHS[-1] + 1})) AS month) m LEFT JOIN j ON j.month = m.month GROUP BY m.month""")
def truth_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir).summaries


@query(f"""{CELLS}, p AS (SELECT 'missing_order' AS kind, month, row, number, NULL AS detail FROM j WHERE number IS NULL UNION ALL SELECT 'duplicate_order', month, row, number, NULL FROM j WHERE number IS NOT NULL AND again > 1
  UNION ALL SELECT 'missing_value', month, row, number, '생성인' FROM j WHERE scope = 'truth' AND person IS NULL UNION ALL SELECT 'wrong_month', month, row, number, day::VARCHAR FROM j WHERE scope = 'truth' AND person IS NOT NULL AND month(day) <> month)
SELECT kind, month::INT AS month, row::INT AS row, number AS order_number, detail FROM p""")
def truth_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir).problems
