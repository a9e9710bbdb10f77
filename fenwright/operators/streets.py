"""Street blocks: addresses chained along their street, components of chains, blocks of limited size.

records: scope, id, dong, road_stem, lot_main, lot_sub, lat, lon. A street of one district is the unit
of the ordered work; components and neighbours are ordinary joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwright.functions import geo
from fenwright.operators.graph import connected_components

# What likens addresses, when they chain (distance, score, lot gap), when a block breaks, how many it holds.
OTHER_DONG, OTHER_STREET, OTHER_STREET_FAR, FAR = 90.0, 50.0, 45.0, 70.0
LOT_WEIGHT, LOT_MOST, SUB_WEIGHT, SUB_MOST = 4.0, 80.0, 2.0, 24.0
CHAINS = ((22.0, 95.0, None), (55.0, 118.0, 4), (38.0, 108.0, 8))
BREAK_METRES, BREAK_LOTS, MOST_ADDRESSES = 65.0, 10, 80
NEIGHBOUR_METRES = 220.0
NO_LOT = 10**9


def affinity(a: str, b: str, distance: Column) -> Column:
    """How unlike two records (struct columns) are: metres, and more for another district or street and for lots apart."""
    l, r = F.col(a), F.col(b)  # noqa: E741
    gap = lambda k, weight, most: F.when((l[k] - r[k]).isNotNull(), F.least(F.abs(l[k] - r[k]) * weight, F.lit(most))).otherwise(F.lit(0.0))
    street = F.when(l["road_stem"] != r["road_stem"], OTHER_STREET + F.when(distance > FAR, OTHER_STREET_FAR).otherwise(0.0)).otherwise(0.0)
    return distance + F.when(l["dong"] != r["dong"], OTHER_DONG).otherwise(0.0) + street + gap("lot_main", LOT_WEIGHT, LOT_MOST) + gap("lot_sub", SUB_WEIGHT, SUB_MOST)


def _metres(lat1: float, lon1: float, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * geo.EARTH * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one street: each address to the first of the run it stands in; an address too far from it begins a run."""
    main, sub = pdf["lot_main"].fillna(NO_LOT), pdf["lot_sub"].fillna(NO_LOT)
    pdf = pdf.assign(_m=main, _s=sub).sort_values(["_m", "_s", "id"], kind="stable").reset_index(drop=True)
    lat, lon, m, s = (pdf[c].to_numpy(float) for c in ("lat", "lon", "lot_main", "lot_sub"))
    ids, links, first = pdf["id"].to_numpy(), [], 0
    while first < len(pdf):
        rest = slice(first + 1, len(pdf))
        d = _metres(lat[first], lon[first], lat[rest], lon[rest])
        lots, subs = np.abs(m[rest] - m[first]), np.abs(s[rest] - s[first])
        score = d + np.nan_to_num(np.minimum(lots * LOT_WEIGHT, LOT_MOST)) + np.nan_to_num(np.minimum(subs * SUB_WEIGHT, SUB_MOST))
        near = np.zeros(len(d), bool)
        for metres, most, gap in CHAINS:
            near |= (d <= metres) & (score <= most) & (True if gap is None else lots <= gap)
        stop = int(np.argmin(near)) if len(near) and not near.all() else len(near)
        links += [(ids[first], i) for i in ids[first + 1 : first + 1 + stop]]
        first += stop + 1
    return pd.DataFrame(links, columns=["a", "b"]).astype({"a": "int64", "b": "int64"})


def chains(records: DataFrame) -> DataFrame:
    """(a, b): links along each street of each district."""
    return records.groupBy("scope", "dong", "road_stem").applyInPandas(_chain, "a long, b long")


def _pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """Parts of one component: in street order, cut at breaks and when a part is full."""
    pdf = pdf.assign(_m=pdf["lot_main"].fillna(NO_LOT), _s=pdf["lot_sub"].fillna(NO_LOT)).sort_values(["road_stem", "_m", "_s", "lat", "lon", "id"], kind="stable").reset_index(drop=True)
    if len(pdf) <= MOST_ADDRESSES:
        return pdf.assign(piece=0)[["component", "id", "piece"]]
    lat, lon = pdf["lat"].to_numpy(float), pdf["lon"].to_numpy(float)
    far = np.concatenate([[False], [_metres(a, b, c, d) > BREAK_METRES for a, b, c, d in zip(lat[:-1], lon[:-1], lat[1:], lon[1:])]])
    street = (pdf["road_stem"] != pdf["road_stem"].shift()).to_numpy()
    lots = (pdf["lot_main"].astype(float).diff().abs() > BREAK_LOTS).to_numpy()
    run = np.cumsum(far | street | lots)
    place = pd.Series(run).groupby(run).cumcount().to_numpy() // MOST_ADDRESSES
    return pdf.assign(piece=pd.factorize(pd.Series(list(zip(run, place))))[0])[["component", "id", "piece"]]


def blocks(records: DataFrame) -> DataFrame:
    """(id, component, piece): the block of every record; a record without links is one of its own."""
    found = connected_components(chains(records), "a", "b").select(F.col("node").alias("id"), "component")
    whole = records.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("component", "id", "piece")])
    parts = whole.select(F.col("component").cast("long").alias("component"), F.col("id").cast("long").alias("id"), "road_stem", "lot_main", "lot_sub", "lat", "lon")
    return parts.groupBy("component").applyInPandas(lambda pdf: _pieces(pdf).astype("int64"), schema).select("id", "component", "piece")


def neighbours(blocks: DataFrame, most: int = 10) -> DataFrame:
    """(block, neighbour, metres, nth) of blocks (block, lat, lon) at most NEIGHBOUR_METRES apart, through cells of that size."""
    size = NEIGHBOUR_METRES / 111_000
    wide = F.lit(NEIGHBOUR_METRES) / (111_000 * F.cos(F.radians(F.lit(38.0))))
    gy, gx = F.floor(F.col("lat") / size), F.floor(F.col("lon") / wide)
    left = blocks.select("block", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.explode(F.sequence(gx - 1, gx + 1)).alias("gx"), gy.alias("g")).withColumn("gy", F.explode(F.sequence(F.col("g") - 1, F.col("g") + 1)))
    right = blocks.select(F.col("block").alias("neighbour"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), gx.alias("gx"), gy.alias("gy"))
    near = left.join(right, ["gx", "gy"]).where("block <> neighbour").withColumn("metres", geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))).where(F.col("metres") <= NEIGHBOUR_METRES)
    nth = F.row_number().over(Window.partitionBy("block").orderBy("metres", "neighbour"))
    return near.withColumn("nth", nth).where(F.col("nth") <= most).select("block", "neighbour", "metres", "nth")
