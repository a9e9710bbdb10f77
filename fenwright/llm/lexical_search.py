"""Ranked lexical search: the best documents for each query, by WAND over shards of documents.

Terms are words of ASCII letters and digits and everything beyond ASCII, with A-Z lower-cased. A document's score
is the sum, over the query's terms with their repeats, of the term's weight times a saturating whole-number
function of how often the document holds it (see `weight` and `impacts`).

1. One pass over the texts counts each document's terms and notes how often it holds the queries' terms. Words are found by
   their 64-bit hash and compared byte by byte. These postings are written to the shared folder.
2. Their totals (documents, terms, documents by term) give the weights.
3. Each shard, consecutive documents with SHARD_POSTINGS postings at most or one document, sorts its postings by term and document, keeps
   the maximum impact of each term, and answers each query by WAND. Documents are taken by blocks in the order of their ids: terms whose
   maxima together cannot beat the heap's threshold select no pivot, so their postings are not walked through. The pivots of a block
   are the documents that the maxima of their other terms, with all of those, bring above the threshold. Pivots look the remaining terms up, highest maximum
   first, and are dropped as soon as what is left cannot lift them above it. What survives enters the heap; a later document
   of equal score never does, as ids ascend.
4. The shards' heaps are merged by Spark: the best of each task before the shuffle, then those of each query.

Queries are answered in blocks of PART_ROWS (query, term) pairs about, which bounds what is collected and broadcast; each block is one
pass over the texts. A shard's memory is bounded by its postings, whatever the number of documents or copies.

Cases: null or empty texts have no terms, are not counted and never found. A query without terms, or whose terms no document holds, has
no rows. Query rows of one id are one query with the terms of all of them; a null id is a query of its own.
Repeated rows of a document are ranked each on its own. Equal scores are ranked by ascending id, a null id last. An empty table
gives no rows. Very long texts are taken whole. Ids may be of any type that can be ordered. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fenwright.llm import _store
from fenwright.llm import _text as X

TOP = 10
PART_ROWS = 500_000
SHARD_POSTINGS, SHARD_DOCS = 2 << 20, 1 << 16
FIRST_BLOCK, LAST_BLOCK = 128, 16_384


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight w adds to the score of a document of n terms that holds it tf times."""
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _terms(t: X.Texts) -> tuple[X.Texts, X.Words, np.ndarray]:
    t = X.Texts(X.LOWER[t.data], t.offsets)
    words = X.words_of(t, X.ALNUM)
    return t, words, X.span_hash(X.prefix_sums(t.data), words.start, words.end)


@dataclass
class Vocabulary:
    """The queries' terms in the order of their hashes: bytes, where each stands, hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    @property
    def n(self) -> int:
        return len(self.hashes)

    def numbers(self, t: X.Texts, words: X.Words, h: np.ndarray) -> np.ndarray:
        """The number of each word's term, or -1."""
        if not self.n or not words.n:
            return np.full(words.n, -1)
        at = np.searchsorted(self.hashes, h)
        at[at == self.n] = 0
        at[self.hashes[at] != h] = -1
        size = words.end - words.start
        at[(at >= 0) & (size != (self.end - self.start)[at])] = -1
        known = np.flatnonzero(at >= 0)
        for length in np.unique(size[known]).tolist():
            of = known[size[known] == length]
            span = np.arange(length)
            for some in np.array_split(of, max(1, len(of) * length >> 20)):
                same = (t.data[words.start[some, None] + span] == self.data[self.start[at[some], None] + span]).all(1)
                at[some[~same]] = -1
        return at


def vocabulary(terms: list[str]) -> tuple[Vocabulary, dict[str, int]]:
    """Of distinct terms; and the number of each."""
    raw = [x.encode() for x in terms]
    ends = np.cumsum([0, *map(len, raw)])
    t = X.Texts(np.frombuffer(b"".join(raw), np.uint8), ends)
    h = X.span_hash(X.prefix_sums(t.data), ends[:-1], ends[1:])
    order = np.argsort(h)
    if len(h) > 1 and (h[order][1:] == h[order][:-1]).any():
        raise ValueError("two terms of one hash")
    return Vocabulary(t.data, ends[:-1][order], ends[1:][order], h[order]), {terms[j]: i for i, j in enumerate(order.tolist())}


def query_terms(queries: DataFrame, id: str, text: str) -> DataFrame:
    """(item, term, times): how often each query holds each of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in X.slices(batches, "text"):
            t, words, _ = _terms(t)
            terms = [t.data[i:j].tobytes() for i, j in zip(words.start.tolist(), words.end.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(words.doc)), pa.array(terms, pa.binary()).cast(pa.string())], names=["item", "term"])

    kind = queries.schema[id].dataType
    return queries.select(F.col(id).alias("item"), F.col(text).alias("text")).mapInArrow(run, T.StructType([T.StructField("item", kind), T.StructField("term", T.StringType())])).groupBy("item", "term").agg(F.count("*").alias("times"))


def postings(docs: DataFrame, id: str, text: str, known) -> DataFrame:
    """(id, n, terms, tfs) of each document with a term: how many terms it has, and which of the broadcast vocabulary how often."""
    kind = docs.schema[id].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = known.value
        for batch, t in X.slices(batches, "text"):
            t, words, h = _terms(t)
            number = v.numbers(t, words, h)
            held = number >= 0
            key, tf = np.unique(words.doc[held] * max(v.n, 1) + number[held], return_counts=True)
            cuts = np.searchsorted(key, np.arange(t.n + 1) * max(v.n, 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (key % max(v.n, 1), tf)]
            n = words.counts()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def term_counts(held: DataFrame, n_terms: int) -> dict[int, int]:
    """Documents by term; a row for each term and task goes through the shuffle, and one for each term to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    return dict(tuple(r) for r in held.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect())


@dataclass
class Shard:
    """Postings of some documents by term, then document: the documents' places, impacts; where each term begins; the maximum of each."""

    n_docs: int
    keys: np.ndarray  # term * n_docs + place
    impact: np.ndarray
    most: np.ndarray

    @staticmethod
    def of(terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, n: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> Shard:
        """Of documents in the order of their ids: their postings one after another, how many each has, their numbers of terms."""
        place = np.repeat(np.arange(len(sizes)), sizes)
        key = terms.astype(np.int64) * max(len(sizes), 1) + place
        order = np.argsort(key)
        value = impacts(weights[terms], tfs.astype(np.int64), n[place], n_docs, n_terms)[order]
        most = np.zeros(len(weights), np.int64)
        np.maximum.at(most, terms[order], value)
        return Shard(len(sizes), key[order], value, most)


def blocks(n: int) -> np.ndarray:
    """Edges of blocks of documents: short ones first, so that the threshold rises early."""
    out, size = [0], FIRST_BLOCK
    while out[-1] < n:
        out.append(min(n, out[-1] + size))
        size = min(2 * size, LAST_BLOCK)
    return np.array(out)


def wand(shard: Shard, terms: np.ndarray, times: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best documents of a shard with a score above 0, best first."""
    bound = times * shard.most[terms]
    order = np.argsort(bound, kind="stable")
    order = order[bound[order] > 0]
    terms, times, bound = terms[order], times[order], bound[order]
    upto = np.cumsum(bound)  # the maxima of a term and all lower ones together
    edges = blocks(shard.n_docs)
    cuts = np.searchsorted(shard.keys, terms[:, None] * shard.n_docs + edges)
    heap = np.zeros(0, np.int64), np.zeros(0, np.int64)  # places, scores
    least = 0
    for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        # Terms before this one cannot beat the threshold together: they select no pivot.
        first = int(np.searchsorted(upto, least, "right"))
        if first == len(terms):
            break
        n = cuts[first:, b + 1] - cuts[first:, b]
        at = np.repeat(cuts[first:, b], n) + X.spread(n)
        of = np.repeat(np.arange(first, len(terms)), n)
        place = shard.keys[at] - terms[of] * shard.n_docs - lo
        rest = int(upto[first - 1]) if first else 0
        # Sums of whole numbers below 2^53 are exact in doubles.
        pivots = np.flatnonzero(np.bincount(place, bound[of], hi - lo) > max(0, least - rest))
        if not len(pivots):
            continue
        score = np.bincount(place, times[of] * shard.impact[at], hi - lo)[pivots].astype(np.int64)
        for i in range(first - 1, -1, -1):
            live = score + upto[i] > least
            pivots, score = pivots[live], score[live]
            if not len(pivots):
                break
            own = shard.keys[cuts[i, b] : cuts[i, b + 1]]
            if len(own):
                key = terms[i] * shard.n_docs + lo + pivots
                j = np.minimum(np.searchsorted(own, key), len(own) - 1)
                score = score + np.where(own[j] == key, times[i] * shard.impact[cuts[i, b] + j], 0)
        better = score > least
        if better.any():
            places, scores = np.concatenate([heap[0], pivots[better] + lo]), np.concatenate([heap[1], score[better]])
            best = np.lexsort((places, -scores))[:top]
            heap = places[best], scores[best]
            if len(best) == top:
                least = int(heap[1][-1])
    return heap


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive documents of a task, with SHARD_POSTINGS postings and SHARD_DOCS documents at most, or one document."""
    now: list[pa.RecordBatch] = []
    docs = held = 0
    for batch in batches:
        ends, at = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, before + SHARD_POSTINGS - held, "right")), at + SHARD_DOCS - docs)
            if to <= at and now:
                yield pa.Table.from_batches(now)
                now, docs, held = [], 0, 0
                continue
            to = min(max(to, at + 1), batch.num_rows)
            now.append(batch.slice(at, to - at))
            docs, held, at = docs + to - at, held + int(ends[to - 1]) - before, to
    if now:
        yield pa.Table.from_batches(now)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int32)


def shard_heaps(held: DataFrame, plan, top: int = TOP) -> DataFrame:
    """(item, doc, score): the heap of each shard for each query of the broadcast plan (queries, weights, totals)."""
    kind = held.schema["id"].dataType
    of_item, item_type = plan.value["kind"], to_arrow_type(plan.value["kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for table in _shards(batches):
            # Ids ascend within a shard, nulls last.
            table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")], null_placement="at_end"))
            lists = table.column("terms").combine_chunks()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            shard = Shard.of(_numbers(table.column("terms")), _numbers(table.column("tfs")), sizes, table.column("n").to_numpy(), p["weights"], p["n_docs"], p["n_terms"])
            found = [wand(shard, terms, times, top) for terms, times in p["queries"]]
            n = [len(places) for places, _ in found]
            item = pa.array(p["items"], item_type).take(pa.array(np.repeat(np.arange(len(n)), n)))
            places, scores = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([item, table.column("id").combine_chunks().take(pa.array(places)), pa.array(scores, pa.int64())], names=["item", "doc", "score"])

    return held.mapInArrow(run, T.StructType([T.StructField("item", of_item), T.StructField("doc", kind), T.StructField("score", T.LongType())]))


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc, score): the `top` best documents of each query with a score above 0."""
    spark = docs.sparkSession
    X.bounded_batches(spark)
    kinds = queries.schema[item_id].dataType, docs.schema[doc_id].dataType
    asked = _store.written(query_terms(queries, item_id, text), "query-terms")
    parts = math.ceil(asked.count() / PART_ROWS)
    out = spark.createDataFrame([], T.StructType([T.StructField("item", kinds[0]), T.StructField("doc", kinds[1]), T.StructField("score", T.LongType())]))
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()
        words, number = vocabulary(sorted({r["term"] for r in rows}))
        if not words.n:
            continue
        held = _store.written(postings(docs, doc_id, text, spark.sparkContext.broadcast(words)), "postings")
        n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        df = term_counts(held, words.n)
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r["item"], []).append((number[r["term"]], r["times"]))
        plan = {
            "kind": kinds[0], "items": list(by_item), "queries": [tuple(np.array(x, np.int64) for x in zip(*pairs)) for pairs in by_item.values()],
            "weights": np.array([weight(n_docs, df.get(i, 0)) for i in range(words.n)], np.int64), "n_docs": n_docs, "n_terms": n_terms,
        }
        out = out.unionByName(shard_heaps(held, spark.sparkContext.broadcast(plan), top))
    # Spark keeps the best `top` of each task before it shuffles.
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select("item", "rank", "doc", "score")


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ten best documents of each benchmark item: item_id, rank, doc_id, score."""
    return search(docs, benchmark).withColumnsRenamed({"item": "item_id", "doc": "doc_id"})
