"""Benchmark decontamination by Wu-Manber search over words.

Texts are lower-cased (A-Z) and cut into words of ASCII letters and digits and everything beyond
ASCII. A pattern is a window of `size` consecutive words of a benchmark item, or a whole item of
fewer words. Patterns of one length are searched together: a table over pairs of words says how
far a pair that ends the current position allows to skip; a pair that ends patterns selects them
by its hash; then all their words' hashes, and at last the bytes, are compared. Word hashes come
from numpy for a slice of texts at once, and many stretches of text advance side by side.

The benchmark goes to the executors in parts, one pass over each row's text for each part. A part
holds PART_BYTES of text about, in pieces of PIECE_WORDS words at most, of long items several, which overlap
so that every window is in one. What is broadcast are arrays of some six times the text (a hash and
two offsets for each word; a hash, a place and its items for each distinct window), no Python objects but item ids.

Cases: null or empty text has no words and no hits. An item without words never occurs; items
of one id count as one, with all their windows; an item without id makes hits, but is not among the
items. Repeated rows are judged alike, each on its own. Without items nothing is contaminated.
Item ids may be of any type; they are listed as strings. Extra columns are ignored by `judge` and kept by `filter_documents`, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwright.llm import _store
from fenwright.llm import _text as X

SIZE = 10
PART_BYTES, PIECE_WORDS = 6 << 20, 50_000
STRETCH = 512
TABLE_BITS = 18


@dataclass
class Patterns:
    """All distinct patterns of one length: where each stands among the words of the part, in the order of the pair that ends them."""

    length: int
    block: int
    at: np.ndarray
    suffix: np.ndarray
    shift: np.ndarray
    first: np.ndarray  # where each pattern's items begin in `items`
    items: np.ndarray  # numbers of names


@dataclass
class Part:
    """The words of some items, their patterns by length, and the items' ids."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    patterns: list[Patterns]
    names: list[str]


def _hashed(t: X.Texts) -> tuple[X.Texts, X.Words, np.ndarray]:
    t = X.Texts(X.LOWER[t.data], t.offsets)
    words = X.words_of(t, X.ALNUM)
    return t, words, X.span_hash(X.prefix_sums(t.data), words.start, words.end)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: int, length: int) -> bytes:
    return b" ".join(data[i:j].tobytes() for i, j in zip(start[at : at + length].tolist(), end[at : at + length].tolist()))


def compile_patterns(items: list[tuple[str | None, str | None]], size: int = SIZE) -> Part:
    names = sorted({i for i, _ in items if i is not None})
    number = {name: i for i, name in enumerate(names)} | {None: -1}
    raw = [(text or "").encode() for _, text in items]
    t, words, h = _hashed(X.Texts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])))
    item_of, counts = np.array([number[i] for i, _ in items], np.int64), words.counts()
    out = []
    for length in range(1, size + 1):
        at = words.first[np.flatnonzero(counts == length)] if length < size else words.windows(size)
        if not len(at):
            continue
        block = min(2, length)
        _, one, same = np.unique(X.gram_hash(h, at, length), return_index=True, return_inverse=True)
        for j in range(length):
            assert (h[at + j] == h[at[one[same]] + j]).all()  # windows of one hash are equal
        shift = np.full(1 << TABLE_BITS, length - block + 1, np.uint8)
        for j in range(length - block + 1):
            np.minimum.at(shift, _index(X.gram_hash(h, at[one] + j, block)), np.uint8(length - block - j))
        suffix = X.gram_hash(h, at[one] + length - block, block)
        order = np.argsort(suffix, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs = np.unique(np.stack([place[same], item_of[words.doc[at]]], 1)[item_of[words.doc[at]] >= 0], axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
        out.append(Patterns(length, block, at[one][order].astype(np.int32), suffix[order], shift, first.astype(np.int32), pairs[:, 1].astype(np.int32)))
    return Part(t.data, words.start.astype(np.int32), words.end.astype(np.int32), h, out, names)


def _index(pair: np.ndarray) -> np.ndarray:
    return (pair >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def occurrences(p: Patterns, part: Part, t: X.Texts, words: X.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and pattern numbers of all occurrences, never across texts."""
    first, last = words.first[:-1], words.first[1:] - p.length + 1
    parts = np.maximum(0, -(-(last - first) // STRETCH))
    at = np.repeat(first, parts) + STRETCH * X.spread(parts)
    stop = np.minimum(at + STRETCH, np.repeat(last, parts))
    pairs = X.gram_hash(h, np.arange(words.n - p.block + 1), p.block) if words.n >= p.block else np.zeros(0, np.uint64)
    index = _index(pairs)
    stops = []
    while len(at):
        skip = p.shift[index[at + p.length - p.block]].astype(np.int64)
        stops.append(at[skip == 0])
        at = at + np.maximum(skip, 1)
        more = at < stop
        at, stop = at[more], stop[more]
    at = np.concatenate(stops) if stops else np.zeros(0, np.int64)
    pair = pairs[at + p.length - p.block]
    lo, hi = np.searchsorted(p.suffix, pair, "left"), np.searchsorted(p.suffix, pair, "right")
    n = hi - lo
    at, which = np.repeat(at, n), np.repeat(lo, n) + X.spread(n)
    for j in range(p.length):
        same = h[at + j] == part.hashes[p.at[which] + j]
        at, which = at[same], which[same]
    known: dict[int, bytes] = {}
    sure = np.zeros(len(at), bool)
    for k, (a, w) in enumerate(zip(at.tolist(), which.tolist())):
        if w not in known:
            known[w] = _joined(part.data, part.start, part.end, int(p.at[w]), p.length)
        sure[k] = _joined(t.data, words.start, words.end, a, p.length) == known[w]
    return at[sure], which[sure]


def _pieces(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, text, bytes): items as strings, lower-cased; long ones in pieces that overlap by size - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in X.slices(batches, "text"):
            t = X.Texts(X.LOWER[t.data], t.offsets)
            words = X.words_of(t, X.ALNUM)
            of = [(d, i) for d, n in enumerate(words.counts().tolist()) for i in range(0, max(1, n - size + 1), PIECE_WORDS)]
            texts = []
            for d, i in of:
                a, b = words.first[d] + i, min(words.first[d] + i + PIECE_WORDS + size - 1, words.first[d + 1])
                texts.append(t.data[words.start[a] : words.end[b - 1]].tobytes() if b > a else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([d for d, _ in of], pa.int64())), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["item_id", "text", "bytes"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, text string, bytes long")


def find(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those of `keep`), n_words, hits (list of [first, end) word spans) and items (ids), with prefix."""
    spark = docs.sparkSession
    X.bounded_batches(spark)
    keep = docs.columns if keep is None else keep
    own = [prefix + c for c in ("n_words", "hits", "items")]
    pieces = _store.written(_pieces(benchmark, size), "benchmark-pieces")
    total = pieces.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, math.ceil(total / PART_BYTES))
    out = docs.select(*keep, *([] if "text" in keep else ["text"]))
    for n in range(parts):
        some = pieces.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == n).select("item_id", "text").distinct().collect()
        part = spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in some], size))
        out = _pass(out, part, own, first=n == 0)
    return out.select(*keep, *own)


def _pass(docs: DataFrame, part, own: list[str], first: bool) -> DataFrame:
    kept = docs.columns if first else docs.columns[:-3]
    types = [T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())]
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, k) for c, k in zip(own, types))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in X.slices(batches, "text"):
            t, words, h = _hashed(t)
            hit = np.zeros(words.n + 1, np.int64)
            items: list[set] = [set() for _ in range(t.n)]
            if not first:
                before = batch.columns[-2:]
                for d, (spans, known) in enumerate(zip(before[0].to_pylist(), before[1].to_pylist())):
                    items[d].update(known)
                    for i, j in zip(spans[::2], spans[1::2]):
                        hit[words.first[d] + i] += 1
                        hit[words.first[d] + j] -= 1
            for p in part.value.patterns:
                at, which = occurrences(p, part.value, t, words, h)
                np.add.at(hit, at, 1)
                np.add.at(hit, at + p.length, -1)
                for d, w in set(zip(words.doc[at].tolist(), which.tolist())):
                    items[d].update(part.value.names[i] for i in p.items[p.first[w] : p.first[w + 1]].tolist())
            # Spans may touch at the border of two texts, so runs are cut there.
            inside = np.cumsum(hit)[:-1] > 0
            of = words.doc[: words.n]
            edge = np.ones(words.n, bool)
            edge[1:] = (inside[1:] != inside[:-1]) | (of[1:] != of[:-1])
            begin = np.flatnonzero(edge)
            end = np.append(begin[1:], words.n)[: len(begin)]
            full = inside[begin]
            begin, end = begin[full], end[full]
            doc = of[begin]
            spans = np.stack([begin - words.first[doc], end - words.first[doc]], 1).ravel()
            cuts = np.searchsorted(doc, np.arange(t.n + 1)) * 2
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(spans, pa.int64()))
            columns = batch.columns[: len(kept)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words.counts(), pa.int64()), lists, pa.array([sorted(i) for i in items], pa.list_(pa.string()))], names=[*kept, *own])

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    hit = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a.n + a.sign * x).alias("n"), (-a.sign).alias("sign")), lambda a: a.n)
    ids = F.array_join(F.array_sort("items"), ",")
    counted = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return counted.withColumn("contaminated", F.col("n_hit") > 0)


def filter_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any hit, with their own columns only."""
    prefix = "b_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return find(docs, benchmark, prefix=prefix).where(F.size(prefix + "hits") == 0).select(*docs.columns)


def brute_force(text: str | None, items: list[tuple[int, str | None]], size: int = SIZE) -> tuple[int, int, int, str, bool]:
    """What `judge` gives for one text, by comparing every window with every window; for tests."""
    import re

    upper = {c: c + 32 for c in range(65, 91)}
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(upper))
    words, hit, ids = cut(text), set(), set()
    for item, x in items:
        own = cut(x)
        n = min(size, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(item)
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)
