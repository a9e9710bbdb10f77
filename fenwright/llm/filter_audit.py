"""How filters interact: what each step of every order of filters removes, by part, from counts of masks.

A row's mask has a bit for each filter that it fails. Rows are counted by part and mask; the subset-zeta transform of a
part's 2^k counts (one running sum along each of the k axes) gives, for every set of masks' bits, the rows that fail
none but those, and so the survivors of every subset of filters. A step of an order is the difference between two neighbouring subsets:
its survivors after and before. Labels are counted alike. So all k! orders cost one pass over the rows.

The duplicate filter fails a row whose text some smaller id has, anywhere in the table. Rows of one text have one mask of the other
filters, so they are counted by digest of the text, mask, part and labels, with the least id of each count; only these counts
meet the least id of their text. A group of copies, however large, is a row for each part and label by then.

Cases: a null text is an empty one; a null part is the empty string. A null id has no label, and is neither a
duplicate nor makes one. A row counts as good or toxic if any label of its id says 1. Repeated rows count
as often as they stand; they have one id, so none makes the other a duplicate. An empty table has no
parts and gives no rows. Texts are taken whole. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenwright.llm import _store

WORD = r"[^\x20\x09-\x0D]+"
#: Filters of `judge` in the order of their bits; the last is the duplicate filter.
FILTERS = "ABCDE"
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts that a task holds at once, each with a row for every order and step.
PARTS_AT_ONCE = 64


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Which filters a text fails, from itself and its words; none looks at other rows."""
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * upper > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, passes, fails): rows by part, mask of the text filters and labels that are no duplicates, and that are."""
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    failures = text_failures(F.col("text"), F.col("words"))
    mask = sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(failures.values())), F.lit(0))
    rows = texts.select("id", "part", mask.alias("mask"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest")).groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(told, "id", "left").na.fill(False, ["good", "toxic"])
    # Of each count: its least id, the rows with that id, and the rows without any.
    counts = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    counts = _store.written(counts, "mask-counts")  # read twice; the texts only once
    least = counts.groupBy("digest").agg(F.min("low").alias("least"))
    first = F.when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(F.lit(0))
    passes = F.col("n_null") + F.coalesce(first, F.lit(0))
    return counts.join(least, "digest").groupBy("part", "mask", "good", "toxic").agg(F.sum(passes).alias("passes"), F.sum(F.col("n") - passes).alias("fails"))


def zeta(counts: np.ndarray, k: int) -> np.ndarray:
    """For counts (..., 2^k) by mask: at each set of bits the sum over its subsets."""
    cube = counts.reshape(*counts.shape[:-1], *[2] * k)
    for axis in range(cube.ndim - k, cube.ndim):
        cube = np.cumsum(cube, axis)
    return cube.reshape(counts.shape)


def steps(counts: np.ndarray, k: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """For counts (parts, 3, 2^k) of all, good and toxic rows by mask: the orders, and (parts, orders * k, 7) figures in the order of COLUMNS."""
    below, every = zeta(counts, k), (1 << k) - 1
    orders = list(itertools.permutations(range(k)))
    which = np.array(orders)
    after = np.cumsum(1 << which, axis=1)  # the filters applied up to each step, as bits
    which, after = which.ravel(), after.ravel()
    left = below[:, :, every ^ after]
    lost = below[:, :, every ^ (after ^ (1 << which))] - left
    removed = lost[:, 0]
    failing = below[:, 0, [every]] - below[:, 0, every ^ (1 << which)]
    alone = below[:, 0, 1 << which] - below[:, 0, [0]]
    by_filter = np.stack([removed[:, which == f].sum(1) for f in range(k)], 1)
    return orders, np.stack([left[:, 0], removed, failing - removed, alone, lost[:, 1], lost[:, 2], by_filter[:, which]], 2)


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, COLUMNS) for each part of `mask_counts`, every order of the filters and every step."""
    k = len(filters)
    last = 1 << (k - 1)
    # A part has 2^(k-1) masks of the other filters and four pairs of labels at most.
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "passes", "fails")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, PARTS_AT_ONCE) for b in batches for i in range(0, b.num_rows, PARTS_AT_ONCE)):
            table = np.zeros((batch.num_rows, 3, 2 * last), np.int64)
            for p, own in enumerate(batch.column(1).to_pylist()):
                for c in own:
                    for bit, n in ((0, c["passes"]), (last, c["fails"])):
                        table[p, :, c["mask"] + bit] += np.array([n, n * c["good"], n * c["toxic"]])
            orders, found = steps(table, k)
            size = len(orders) * k
            names = pa.array(np.repeat(["".join(filters[f] for f in o) for o in orders], k).tolist())
            numbers = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))
            for p, part in enumerate(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * size, pa.string()), names, numbers, *(pa.array(found[p, :, i].copy()) for i in range(len(COLUMNS)))], names=["part", "filter_order", "step", *COLUMNS])

    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step."""
    return audit(mask_counts(docs, labels))
