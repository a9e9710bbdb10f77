"""Order rows: names, scopes, counters, filters, pages, and what is safe to export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwright.operators.cut import cut

SPACE = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Without Unicode space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Single spaces for any run of Unicode space, none at the ends; null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a fixed schema in its order: absent ones null, others gone."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def tidy(df: DataFrame, required: str) -> DataFrame:
    """Named columns only, trimmed, blank as null, rows without any value or without the required one dropped."""
    named = [c for c in df.columns if c.strip() and not c.startswith("Unnamed:")]
    out = df.select(*[(blank_to_null(F.col(f"`{c}`")) if df.schema[c].dataType == T.StringType() else F.col(f"`{c}`")).alias(c.strip()) for c in named])
    return out.na.drop(how="all").where(F.col(required).isNotNull())


def order_number(c: Column) -> Column:
    """Trimmed, and without the `.0` that a number read as a float ends with."""
    return F.regexp_replace(strip(c.cast("string")), r"^(\d+)\.0$", "$1")


def order_number_historical(c: Column) -> Column:
    """The older form: no commas, and no zeros after the point of a signed number."""
    return F.regexp_replace(F.regexp_replace(strip(c.cast("string")), ",", ""), r"^([+-]?\d+)\.0+$", "$1")


def center(c: Column, moved: Mapping[str, str]) -> Column:
    """Upper case, renamed where a center has moved."""
    out = F.upper(strip(c))
    for old, new in moved.items():
        out = F.when(out == old, new).otherwise(out)
    return out


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """Value of a short fixed table, null where it has none."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[c] if pairs else F.lit(None).cast("string")


def business(prefix: Column, existing: Column, center_code: Column, by_prefix: Mapping[str, str], by_center: Mapping[str, str], exceptions: Mapping[str, str]) -> Column:
    """By exception, by the creator's prefix, the given one if it is a known one, or by the center."""
    known = sorted(set(by_center.values()))
    return F.coalesce(lookup(prefix, exceptions), lookup(F.substring(prefix, 1, 5), by_prefix), F.when(existing.isin(known), existing), lookup(center_code, by_center))


#: Fixed value: where a district's name stands in an address.
AREA = r"(?:^|[\s(])([가-힣]+(?:동|읍|면|가))(?=[\s)]|$)"


def split_address(c: Column) -> Column:
    """struct(road, old, area): before the first parenthesis and inside the parentheses if those end the text, else
    the whole text twice; the district of the old form, or else of the road form."""
    whole = strip(c)
    at = F.instr(whole, "(")
    split = (at > 1) & whole.endswith(")")
    road = F.when(split, strip(F.substring_index(whole, "(", 1))).otherwise(whole)
    old = F.when(split, strip(F.substring(whole, at + 1, F.length(whole) - at - 1))).otherwise(whole)
    area = lambda x: F.nullif(F.regexp_extract(x, AREA, 1), F.lit(""))
    return F.struct(F.nullif(road, F.lit("")).alias("road"), F.nullif(old, F.lit("")).alias("old"), F.coalesce(area(old), area(road)).alias("area"))


def date_columns(df: DataFrame, suffixes: Sequence[str] = ("일", "일자", "날짜", "date")) -> list[str]:
    return [c for c in df.columns if any(c.endswith(s) for s in suffixes)]


def parse_dates(df: DataFrame, columns: Sequence[str], formats: Sequence[str] = ("yyyy-MM-dd", "yyyy.MM.dd", "yyyyMMdd")) -> tuple[DataFrame, DataFrame]:
    """df with dates (null if invalid), and one row of how many values of each column were filled but invalid."""
    parsed = {c: F.coalesce(*[F.try_to_date(F.substring(strip(F.col(c).cast("string")), 1, len(f)), f) for f in formats]) for c in columns}
    bad = df.agg(*[F.count_if(F.coalesce(blank_to_null(F.col(c).cast("string")).isNotNull() & p.isNull(), F.lit(False))).alias(c) for c, p in parsed.items()])
    return df.withColumns(parsed), bad


def true(c: Column) -> Column:
    """A condition in which unknown is false."""
    return F.coalesce(c, F.lit(False))


def in_dashboard(department: str = "사업부") -> Column:
    """The denominator: the department's rows that are not cancelled."""
    return true(F.col("department") == department) & ~true(F.col("cancelled"))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def scopes(rows: DataFrame, excluded: DataFrame, department: str = "사업부") -> tuple[DataFrame, DataFrame]:
    """(analysis, dashboard) rows: excluded categories (compared without spaces) stay in the dashboard's count only."""
    dashboard = rows.where(in_dashboard(department))
    keys = excluded.select(compact(F.col("category")).alias("key")).distinct()
    return dashboard.withColumn("key", compact(F.col("subcategory"))).join(keys, "key", "left_anti").drop("key"), dashboard


def counters(rows: DataFrame, excluded: Sequence[str], department: str = "사업부") -> DataFrame:
    """What the scopes leave out, in one pass."""
    out = true(compact(F.col("subcategory")).isin([c.replace(" ", "") for c in excluded]))
    inside = in_dashboard(department)
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(inside).alias("dashboard"),
        F.count_if(inside & ~out).alias("analysis"),
        F.count_if(~true(F.col("department") == department)).alias("other_department"),
        F.count_if(true(F.col("department") == department) & true(F.col("cancelled"))).alias("cancelled"),
        F.count_if(inside & out).alias("excluded"),
    )


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def reconcile(rows: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Truth keys without a row, or with several: key, matches."""
    counted = rows.groupBy(key).agg(F.count("*").alias("matches"))
    return truth.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("matches", F.lit(0)).alias("matches")).where("matches <> 1")


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the text in any column, whatever the case."""
    values = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    return df.where(F.exists(values, lambda v: v.contains(text.lower())))


def column_filters(df: DataFrame, filters: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """A list: one of these values; a text: contained. All must hold; case does not matter. At most 20 columns of 200 values of 100 characters."""
    if len(filters) > 20 or any(c not in df.columns for c in filters):
        raise ValueError("too many filters, or an unknown column")
    for c, wanted in filters.items():
        value = F.lower(filter_text(F.col(c)))
        if isinstance(wanted, str):
            df = df.where(value.contains(wanted[:100].lower()))
        else:
            if len(wanted) > 200 or any(len(w) > 100 for w in wanted):
                raise ValueError("too many or too long values")
            df = df.where(value.isin([w.lower() for w in wanted]))
    return df


def filter_text(c: Column) -> Column:
    """As shown in a filter menu: null empty, midnight as its date, whole floats without their `.0`."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2})[T ]00:00:00(?:\.0+)?$", "$1"), r"^(\d+)\.0$", "$1")


def distinct_values(df: DataFrame, column: str, contains: str = "", limit: int = 200) -> DataFrame:
    """The first values of a column by lower case, with whether there are more."""
    limit = max(1, min(200, limit))
    values = df.select(filter_text(F.col(column)).alias("value")).where(F.lower("value").contains(contains.lower())).distinct()
    top = values.orderBy(F.lower("value"), "value").limit(limit + 1)
    place = F.row_number().over(Window.orderBy(F.lower("value"), "value"))
    return top.withColumn("place", place).withColumn("truncated", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit).drop("place")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 50) -> DataFrame:
    """One page of the ordered rows; sizes up to 500. Spark takes the first rows of each partition only."""
    size = max(1, min(500, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def escape_formulas(df: DataFrame) -> DataFrame:
    """Texts that a spreadsheet would take for a formula begin with an apostrophe."""
    risky = lambda c: F.when(F.regexp_replace(c, r"(?U)^\s+", "").rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
    return df.withColumns({f.name: risky(F.col(f.name)) for f in df.schema if f.dataType == T.StringType()})


def row_id(order: Column) -> Column:
    """A number for a row without one, from its order number."""
    return F.lit(1_000_000_000) + F.crc32(order).bitwiseAND(F.lit(0x3FFFFFFF))


#: Rows of one range of the order, so that numbering takes one task for each range, not one for all.
NUMBERED_RANGE = "_range"


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with each row's place in the order, from 1: ranges are sorted apart, and each begins behind those before it."""
    sorted_ = cut(df.orderBy(*order).withColumn(NUMBERED_RANGE, F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = sorted_.groupBy(NUMBERED_RANGE).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    begins = sizes.select(F.col(NUMBERED_RANGE).alias("_r"), F.col("_first"), F.coalesce(F.sum("_n").over(Window.orderBy(NUMBERED_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return sorted_.join(F.broadcast(begins), F.col(NUMBERED_RANGE) == F.col("_r")).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_r", "_first", "_before", "_at", NUMBERED_RANGE)


def file_name(c: Column) -> Column:
    """A text as the name of a file: what file systems refuse becomes an underscore, no space or dot at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|]+', "_"), r"^[ .]+|[ .]+$", "")


def address_summary(records: DataFrame) -> DataFrame:
    """Per (scope, address): rows, distinct households, rows of each use, units in order, the most frequent district (the first seen of equals)."""
    uses = records.groupBy("scope", "address", "use").agg(F.count("*").alias("n")).groupBy("scope", "address").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("use", "n")))).alias("use_counts"))
    districts = records.groupBy("scope", "address", "district").agg(F.count("*").alias("n"), F.min("position").alias("seen"))
    mode = districts.where("district is not null").groupBy("scope", "address").agg(F.min_by("district", F.struct(-F.col("n"), F.col("seen"))).alias("district"))
    main = records.groupBy("scope", "address").agg(F.count("*").alias("orders"), F.count_distinct("household").alias("households"))
    return main.join(uses, ["scope", "address"]).join(mode, ["scope", "address"], "left")
