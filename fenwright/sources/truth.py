"""The monthly truth workbook: confirmed orders by sheet, with every row that is not as it must be."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenwright.operators import clean
from fenwright.operators.cut import cut

# Columns of a truth sheet, what is counted, name of a month's sheet, rows in which a header is looked for, empty rows that end a sheet.
ORDER, DATE, STATUS, PERSON, DEPARTMENT, BUSINESS, SUBCATEGORY = COLUMNS = ("오더번호", "오더생성일", "상태", "생성인", "생성부서", "사업부", "소분류")
COUNTED_DEPARTMENT, CANCELLED = "사업부", "오더취소"
BUSINESSES = ("중부", "북부", "남부", "동부", "서부")
SHEET = "{}월"
HEADER_WITHIN, BLANK_ROWS = 50, 200

KINDS = ("missing_sheet", "missing_header", "missing_columns", "missing_order", "duplicate_order", "missing_value", "wrong_month")


class Truth(NamedTuple):
    """records (order_number, order_date, person, business, subcategory, month, sheet, row), summaries by month, and problems (kind, month, row, order_number, detail)."""

    records: DataFrame
    summaries: DataFrame
    problems: DataFrame


class TruthError(ValueError):
    pass


def cell_date(c: Column) -> Column:
    """A cell's date: days since the end of 1899, or a date with or without a time."""
    day = F.try_to_date(F.regexp_replace(F.substring(c, 1, 10), "[./]", "-"), "yyyy-M-d")
    serial = F.when(c.rlike(r"^\d{5}(\.\d+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(c.cast("double")).cast("int")))
    return F.coalesce(serial, F.try_to_date(c, "yyyyMMdd"), day)


def _last_value(name: str) -> Column:
    """The cell under a header; of two headers of one name the last counts."""
    at = F.array_position(F.reverse("names"), name)
    return F.when(at > 0, F.get("cells", (F.size("names") - at).cast("int")))


def _below(cells: DataFrame, heads: DataFrame, blank_rows: int) -> DataFrame:
    """(month, row, values by column) of the rows under each header, up to the first `blank_rows` rows in a row without any of the columns."""
    rows = cells.join(heads.where("size(missing) = 0"), ["path", "sheet"]).where(F.col("row") > F.col("top"))
    values = rows.select("path", "sheet", "month", "row", "top", *(clean.blank_to_null(_last_value(c)).alias(c) for c in COLUMNS)).na.drop(how="all", subset=list(COLUMNS))
    # Empty rows need not be stored, so they are counted between rows that say something. A sheet has a million rows at most.
    w = Window.partitionBy("path", "sheet").orderBy("row")
    gap = F.col("row") - F.coalesce(F.lag("row").over(w), F.col("top")) - 1
    ended = F.max((F.col("gap") >= blank_rows).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return values.withColumn("gap", gap).withColumn("ended", ended).where("ended = 0").drop("gap", "ended", "top")


def read(cells: DataFrame, months: Sequence[int], excluded: Sequence[str] = (), blank_rows: int = BLANK_ROWS) -> Truth:
    """The truth in workbook cells (path, sheet, row, cells) for months, each on its sheet.

    Rows of other departments, businesses, excluded subcategories (compared without spaces) and cancelled orders are counted and left
    out, in this order. An order number may stand once in all sheets, in rows that are left out as well.
    """
    if blank_rows < 1:
        raise ValueError("blank_rows must be 1 or more")
    spark = cells.sparkSession
    wanted = spark.createDataFrame([(m, SHEET.format(m)) for m in months], "month int, name string")
    trimmed = cells.withColumn("cells", F.transform("cells", lambda c: clean.strip(F.coalesce(c, F.lit("")))))
    own = cut(trimmed.join(F.broadcast(wanted), clean.strip(F.col("sheet")) == F.col("name")).drop("name"), "truth-cells")
    sheets = own.select("path", "sheet", "month").distinct()
    is_head = (F.col("row") < HEADER_WITHIN) & F.array_contains("cells", ORDER)
    heads = own.where(is_head).groupBy("path", "sheet").agg(F.min_by(F.struct(F.col("row").alias("top"), F.col("cells").alias("names")), "row").alias("h")).select("path", "sheet", "h.*")
    heads = heads.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, COLUMNS)), "names")))
    # Rows are read a second and third time, so they end their lineage here.
    rows = _below(own.drop("month"), heads.join(sheets, ["path", "sheet"]), blank_rows).withColumn("order_number", clean.blank_to_null(clean.order_number_historical(F.col(ORDER))))
    places = Window.partitionBy("order_number").orderBy("month", "path", "row")
    out = clean.compact(F.coalesce(F.col(SUBCATEGORY), F.lit(""))).isin([x for x in ("".join(e.split()) for e in excluded) if x])
    scope = (
        F.when(~F.col(DEPARTMENT).eqNullSafe(COUNTED_DEPARTMENT), "department")
        .when(~clean.true(F.col(BUSINESS).isin(*BUSINESSES)), "business")
        .when(out, "subcategory")
        .when(F.col(STATUS).eqNullSafe(CANCELLED), "cancelled")
        .otherwise("truth")
    )
    named = rows.withColumns({"scope": F.when(F.col("order_number").isNotNull(), scope), "order_date": cell_date(F.col(DATE)), "nth": F.when(F.col("order_number").isNotNull(), F.row_number().over(places))})
    lacks = F.filter(F.array(F.when(F.col("order_date").isNull(), DATE), *(F.when(F.col(c).isNull(), c) for c in (PERSON, SUBCATEGORY))), lambda c: c.isNotNull())
    judged = cut(named.withColumns({"lacks": F.when(F.col("scope") == "truth", lacks).otherwise(F.array().cast("array<string>")), "row": F.col("row") + 1}), "truth-rows")

    problem = lambda df, kind, detail, row="cast(null as int)", number="cast(null as string)": df.select(F.lit(kind).alias("kind"), "month", F.expr(row).alias("row"), F.expr(number).alias("order_number"), detail.cast("string").alias("detail"))
    of_row = lambda where, kind, detail: problem(judged.where(where), kind, detail, "row", "order_number")
    wrong = F.month("order_date") != F.col("month")
    problems = (
        problem(wanted.join(sheets, "month", "left_anti"), "missing_sheet", F.col("name"))
        .unionByName(problem(sheets.join(heads, ["path", "sheet"], "left_anti"), "missing_header", F.col("sheet")))
        .unionByName(problem(heads.where("size(missing) > 0").join(sheets, ["path", "sheet"]), "missing_columns", F.array_join("missing", ", ")))
        .unionByName(of_row("order_number is null", "missing_order", F.lit(None)))
        .unionByName(of_row("nth > 1", "duplicate_order", F.lit(None)))
        .unionByName(of_row("size(lacks) > 0", "missing_value", F.array_join("lacks", ", ")))
        .unionByName(of_row((F.col("scope") == "truth") & (F.size("lacks") == 0) & wrong, "wrong_month", F.col("order_date")))
    )
    good = judged.where((F.col("scope") == "truth") & (F.size("lacks") == 0) & ~wrong)
    first = good.withColumn("n", F.row_number().over(places)).where("n = 1")
    records = first.select("order_number", "order_date", F.col(PERSON).alias("person"), F.col(BUSINESS).alias("business"), F.col(SUBCATEGORY).alias("subcategory"), "month", "sheet", "row")
    counted = judged.groupBy("month").agg(
        F.count("order_number").alias("source_rows"), F.count_if(F.col("scope") == "truth").alias("truth_rows"), *(F.count_if(F.col("scope") == s).alias(f"excluded_{s}") for s in ("department", "business", "subcategory", "cancelled")), F.count_if(F.col("order_number").isNull()).alias("missing_orders")
    )
    return Truth(records, wanted.select("month").join(counted, "month", "left").na.fill(0), problems)


def checked(truth: Truth, shown: int = 10) -> Truth:
    """The truth, if it has no problem; else an error that says how many of each kind there are, and the first of them."""
    counts = {r["kind"]: r["n"] for r in truth.problems.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # a row a kind
    if counts:
        first = truth.problems.orderBy(*(F.col(c).asc_nulls_first() for c in ("kind", "month", "row", "order_number", "detail"))).limit(shown).collect()
        told = "; ".join(" ".join(str(v) for v in r if v is not None) for r in first)
        raise TruthError(", ".join(f"{counts[k]} {k}" for k in KINDS if k in counts) + f": {told}")
    return truth
