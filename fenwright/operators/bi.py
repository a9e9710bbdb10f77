"""Overview figures over a cube: trends, comparisons, rankings, patterns, thresholds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fenwright.operators.cube import rate


def sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_count", "error_count")]


def with_rate(df: DataFrame) -> DataFrame:
    return df.withColumn("error_rate", rate(F.col("error_count"), F.col("total_count")))


def trend(cube: DataFrame, start: str, end: str, by: str = "day", series: str | None = None) -> DataFrame:
    """Counts and rate for every day or month of the period, zero where nothing happened."""
    unit, step = ("order_date", "interval 1 day") if by == "day" else (F.trunc("order_date", "month"), "interval 1 month")
    first, last = (F.lit(x).cast("date") if by == "day" else F.trunc(F.lit(x).cast("date"), "month") for x in (start, end))
    keys = ["bucket", *([series] if series else [])]
    found = cube.withColumn("bucket", unit if isinstance(unit, Column) else F.col(unit)).groupBy(*keys).agg(*sums())
    spine = cube.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr(step))).alias("bucket"))
    if series:
        spine = cube.select(series).distinct().crossJoin(F.broadcast(spine))  # a period's days, at most
    filled = spine.join(found, keys, "left").select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_count", "error_count")))
    return with_rate(filled)


def by_dimensions(cube: DataFrame, *keys: str) -> DataFrame:
    return with_rate(cube.groupBy(*keys).agg(*sums()))


def summary(cube: DataFrame) -> DataFrame:
    return with_rate(cube.agg(*sums(), F.max("order_date").alias("last_date")))


def yearly(cube: DataFrame, month: int | None = None) -> DataFrame:
    if month is not None:
        cube = cube.where(F.month("order_date") == month)
    return with_rate(cube.groupBy(F.year("order_date").alias("year")).agg(*sums()))


def ranking(cube: DataFrame, keys: list[str], by: str, limit: int) -> DataFrame:
    """Rows numbered from 1 by errors or by rate; the other figure and then the names break ties."""
    figures = ["error_count", "error_rate"] if by == "count" else ["error_rate", "error_count"]
    order = [F.desc(f) for f in figures] + [F.asc_nulls_last(k) for k in keys]
    top = by_dimensions(cube, *keys).orderBy(*order).limit(max(1, min(100, limit)))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def benchmark(cube: DataFrame) -> DataFrame:
    """Each person's errors inside their business: rank and share to one decimal."""
    per = by_dimensions(cube, "business", "person")
    inside = Window.partitionBy("business")
    order = inside.orderBy(F.desc("error_count"), F.desc("error_rate"), F.asc_nulls_last("person"))
    share = F.coalesce(F.bround(F.try_divide(F.col("error_count"), F.sum("error_count").over(inside)) * 100, 1), F.lit(0.0))
    return per.withColumn("rank", F.row_number().over(order)).withColumn("share", share)


#: What blank categories and details are called.
NO_CATEGORY, NO_DETAIL = "(미분류)", "(내용 없음)"


def grouped_details(rows: DataFrame) -> DataFrame:
    """(person, category, detail, n, place) of rows (person, category, detail): groups of a person, the largest first."""
    filled = lambda c, name: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(name)).alias(c)
    counted = rows.select("person", filled("category", NO_CATEGORY), filled("detail", NO_DETAIL)).groupBy("person", "category", "detail").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("n"), "category", "detail")))


def shift_window(start: date, end: date, mode: str) -> tuple[date, date]:
    """The comparison period: both ends a month or a year earlier, at the month's end where the day does not exist."""
    import calendar

    back = 1 if mode == "previous_month" else 12

    def moved(d: date) -> date:
        at = d.year * 12 + d.month - 1 - back
        year, month = divmod(at, 12)
        return date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1]))

    return moved(start), moved(end)


def window(mode: str, year: int | None = None, month: int | None = None, start: date | None = None, end: date | None = None, most_days: int = 1095) -> tuple[date, date, str]:
    """(start, end, bucket unit) of a year, a month or a range of at most `most_days` days."""
    import calendar

    if mode == "year":
        return date(year, 1, 1), date(year, 12, 31), "month"
    if mode == "month":
        return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1]), "day"
    if not start or not end or end < start or (end - start).days + 1 > most_days:
        raise ValueError("the range is empty, reversed or too long")
    return start, end, "day"


def compare(cube: DataFrame, current: tuple[str, str], previous: tuple[str, str], *keys: str) -> DataFrame:
    """Both periods by keys (zero where one has no rows), and the differences; rates are rounded before and after."""
    inside = lambda p: F.col("order_date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    now, then = inside(current), inside(previous)
    either = cube.where(now | then)
    part = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0))
    both = either.groupBy(*keys).agg(*(part(c, w).alias(f"{p}_{c[:5]}") for p, w in (("current", now), ("previous", then)) for c in ("total_count", "error_count")))
    rated = both.withColumn("current_rate", rate(F.col("current_error"), F.col("current_total"))).withColumn("previous_rate", rate(F.col("previous_error"), F.col("previous_total")))
    return rated.withColumn("delta_count", F.col("current_error") - F.col("previous_error")).withColumn("delta_rate", F.bround(F.col("current_rate") - F.col("previous_rate"), 2))


def causes(compared: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The largest changes: by size of the change, then by current errors, then by name."""
    return compared.orderBy(F.desc(F.abs("delta_count")), F.desc("current_error"), F.asc_nulls_last(key)).limit(limit)


def in_order(df: DataFrame, column: str, names: tuple[str, ...]) -> DataFrame:
    """Rows in the order of `names`, others after them by name; the place is `position`."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(column))
    return df.withColumn("position", F.when(place > 0, place).otherwise(len(names) + 1)).orderBy("position", F.asc_nulls_last(column))


def baseline(cube: DataFrame, start: str, end: str) -> DataFrame:
    """20th and 80th percentile (interpolated, two decimals) of the daily rates of a period."""
    daily = by_dimensions(cube.where(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))), "order_date").where("total_count > 0")
    return daily.agg(*(F.bround(F.percentile("error_rate", p), 2).alias(n) for p, n in ((0.2, "p20"), (0.8, "p80"))), F.count("*").alias("days"))


def new_or_repeated(details: DataFrame, prior: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """details with `repeated`: from an automatic batch, or its keys are in prior, or stood earlier in the order."""
    seen = prior.select(*keys).distinct().withColumn("in_prior", F.lit(True))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return details.join(seen, keys, "left").withColumn("repeated", F.col("automatic") | F.coalesce("in_prior", F.lit(False)) | (nth > 1)).drop("in_prior")


def top_patterns(marked: DataFrame, keys: list[str], least: int = 3, limit: int = 8) -> DataFrame:
    """Repeated patterns seen `least` times or more, the most frequent first."""
    counted = marked.where("repeated").groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counted.orderBy(F.desc("n"), *keys).limit(limit)


def filters(cube: DataFrame) -> DataFrame:
    """Bounds and lists for filter menus, in one pass."""
    return cube.agg(F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"), F.count_distinct("person").alias("people"), F.array_join(F.array_sort(F.collect_set("business")), ",").alias("businesses"), F.array_join(F.array_sort(F.collect_set(F.date_format("order_date", "yyyy-MM"))), ",").alias("months"))


def overview(cube: DataFrame, start: str, end: str) -> DataFrame:
    """Figures for subcategory, business and (business, person) in one pass over the period (grouping sets)."""
    view = cube.where(F.col("order_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    sets = view.groupingSets([[F.col("subcategory")], [F.col("business")], [F.col("business"), F.col("person")]], "subcategory", "business", "person")
    return with_rate(sets.agg(F.grouping_id().cast("int").alias("gid"), *sums()))
