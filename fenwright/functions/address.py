"""Parts of Korean addresses as column expressions, and coordinates for addresses without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenwright.operators.clean import squeeze

# Where an address of no known district is put, and how far estimates are spread, in degrees.
CENTER_LAT, CENTER_LON, SPREAD = 36.3504119, 127.3845475, 0.006


def base(c: Column) -> Column:
    """Without what stands in parentheses."""
    return squeeze(F.regexp_replace(c, r"\s*\([^)]*\)", ""))


def street_stem(c: Column) -> Column:
    """The road without the house number."""
    return squeeze(F.regexp_replace(squeeze(F.substring_index(c, "(", 1)), r"\s+\d[\d-]*$", ""))


def inner(c: Column) -> Column:
    return squeeze(F.regexp_extract(F.coalesce(c, F.lit("")), r"\(([^)]+)\)", 1))


def lot(c: Column) -> Column:
    """struct(dong, main, sub) of the old form in parentheses: the first word, and the last that is a lot number."""
    words = F.split(inner(c), " ")
    number = F.try_element_at(F.filter(words, lambda w: w.rlike(r"^\d+(?:-\d+)?$")), F.lit(-1))
    part = lambda i: F.split(number, "-")
    return F.struct(F.get(words, F.lit(0)).alias("dong"), F.get(part(0), F.lit(0)).try_cast("int").alias("main"), F.get(part(1), F.lit(1)).try_cast("int").alias("sub"))


def _until(words: Column, stop: Column, inclusive: bool) -> Column:
    """Words before the first for which `stop` (an array of flags) holds, with it if inclusive."""
    at = F.array_position(stop, True)
    return F.when(at == 0, words).otherwise(F.slice(words, F.lit(1), (at if inclusive else at - 1).cast("int")))


def locality(c: Column) -> Column:
    """City and district: the words before the first with a number or that names a road."""
    words = F.split(squeeze(F.substring_index(c, "(", 1)), " ")
    return F.array_join(_until(words, F.transform(words, lambda w: w.rlike(r"\d|(?:로|길)$")), False), " ")


def lot_hint(c: Column) -> Column:
    """The old form as a query: city and district, then the parentheses up to the first number."""
    words = F.split(inner(c), " ")
    short = F.array_join(_until(words, F.transform(words, lambda w: w.rlike(r"\d")), True), " ")
    return F.when(short == "", "").otherwise(squeeze(F.concat_ws(" ", locality(c), short)))


def queries(c: Column) -> Column:
    """What to ask a geocoder, in turn: the old form, the whole, the road form."""
    return F.array_distinct(F.filter(F.array(lot_hint(c), squeeze(c), base(c)), lambda q: q != ""))


def parcel_lot(pnu: Column) -> Column:
    """Lot of a 19-digit parcel number: `산` for mountain parcels, the main number, and the sub-number if there is one."""
    main, sub = F.substring(pnu, 12, 4).try_cast("int"), F.substring(pnu, 16, 4).try_cast("int")
    text = F.concat(F.when(F.substring(pnu, 11, 1) == "2", "산").otherwise(""), main.cast("string"), F.when(sub > 0, F.concat(F.lit("-"), sub.cast("string"))).otherwise(""))
    return F.when(pnu.rlike(r"^\d{19}$"), text)


def _digest(c: Column) -> Column:
    """The text's bytes as a little-endian number, modulo 10^8."""
    code = F.hex(F.encode(c, "UTF-8"))
    places = F.when(F.length(code) > 0, F.sequence(F.lit(0), (F.length(code) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).cast("long").alias("unit"))
    byte = lambda i: F.conv(F.substring(code, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, start, lambda a, i: F.struct(((a["sum"] + byte(i) * a["unit"]) % 10**8).alias("sum"), (a["unit"] * 256 % 10**8).alias("unit")), lambda a: a["sum"])


def resolve(records: DataFrame, known: DataFrame) -> DataFrame:
    """records (address, dong) with lat, lon and coord_source: exact; by the base address if one known address has it; or
    near the district's middle, at a place that depends on the address alone. known: address, dong, lat, lon."""
    exact = known.groupBy("address").agg(F.min(F.struct("lat", "lon")).alias("exact"))
    bases = known.groupBy(base(F.col("address")).alias("base")).agg(F.count("*").alias("n"), F.min(F.struct("lat", "lon")).alias("only")).where("n = 1").drop("n")
    middles = known.groupBy("dong").agg(F.avg("lat").alias("mid_lat"), F.avg("lon").alias("mid_lon"))
    joined = records.withColumn("base", base(F.col("address"))).join(exact, "address", "left").join(bases, "base", "left").join(middles, "dong", "left")
    d = _digest(F.col("address"))
    off = lambda x: (x % 10_000 / 10_000 - 0.5) * SPREAD
    guess = F.struct((F.coalesce("mid_lat", F.lit(CENTER_LAT)) + off(d)).alias("lat"), (F.coalesce("mid_lon", F.lit(CENTER_LON)) + off(F.floor(d / 10_000))).alias("lon"))
    source = F.when(F.col("exact").isNotNull(), "exact").when(F.col("only").isNotNull(), "base_match").otherwise("district_estimate")
    return joined.withColumn("at", F.coalesce("exact", "only", guess)).select(*records.columns, F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), source.alias("coord_source"))
