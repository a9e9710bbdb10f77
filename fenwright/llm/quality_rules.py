"""Quality rules with risk-controlled thresholds.

Every rule compares one figure of a document with a cutoff. Cutoffs come from a grid that is
fixed before any data is seen, so all labelled documents serve as the holdout. For each stratum
(a language; null is one of its own) the cutoffs of all rules are tightened one after another along a path that the stratum's
bad documents alone set. Its good documents test what each step rejects: the step stands if the exact
(Clopper-Pearson) upper bound on the share of good documents rejected by all rules together stays within the risk, and the first that
does not ends the path. As steps are tested in an order that good documents have no part in, until the first failure, each has the stratum's whole
error probability (fixed sequence); that is delta divided by the number of strata and the table as a whole (Bonferroni). So with
probability 1 - delta no stratum's rules together reject more than `risk` of its good documents.
A stratum with too few labels for any cutoff (`labels_needed`) takes those of the table as a whole, tested in the same way.

Cases: null or empty text has no words and fails the base rules (n_words < 50). Labels without a
quality, or for unknown documents, count for nothing; a document labelled more than once is good
only if all its labels say so. Repeated rows are judged alike, each on its own. An empty table,
or one without labels, gives base rules only. Extra columns are ignored by `features` and kept
by `filter_documents`, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwright.llm import _text as X

BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE_COLUMNS, "n_lines")
SYMBOLS = b"#*$%&|<>"

#: Rules: name, the figure as (numerator, denominator), and its grid from lenient to strict. Beyond a cutoff: rejected.
RULES: tuple[tuple[str, str, str, tuple[float, ...]], ...] = (
    ("symbols", "n_symbols", "n_words", (1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    ("dup_lines", "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    ("repeats", "n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    ("long_words", "word_chars", "n_words", (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    ("short_words", "n_words", "word_chars", (0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.275, 0.25)),
)
RISK, DELTA = 0.01, 0.05


def _measure(t: X.Texts) -> dict[str, np.ndarray]:
    words = X.words_of(t, X.NOT_SPACE)
    sums = X.prefix_sums(t.data)
    is_word = X.NOT_SPACE[t.data]
    out = {
        "n_words": words.counts(),
        "word_chars": t.sums(is_word & ((t.data & 0xC0) != 0x80)),
        "n_symbols": t.sums(np.isin(t.data, np.frombuffer(SYMBOLS, np.uint8))),
    }
    # Words in three-word windows that occur twice or more in their text.
    at = words.windows(3)
    key = X.mix(X.gram_hash(X.span_hash(sums, words.start, words.end), at, 3) + words.doc[at].astype(np.uint64) * X.BASE)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(words.n + 1, bool)
    for j in range(3):
        covered[at[again] + j] = True
    out["n_repeat_words"] = np.bincount(words.doc[covered[:-1]], minlength=t.n)[: t.n]
    # Lines with a word, and those equal to an earlier one.
    breaks = np.flatnonzero(t.data == 0x0A)
    start = np.sort(np.concatenate([t.offsets[:-1], breaks + 1]))
    start = start[: np.searchsorted(start, len(t.data))]
    start = np.unique(start)
    stop = np.append(start[1:], len(t.data))
    stop = stop - ((stop > start) & (t.data[np.maximum(stop, 1) - 1] == 0x0A)) if len(start) else stop
    filled = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    start, stop = start[filled], stop[filled]
    doc = np.searchsorted(t.offsets, start, "right") - 1
    lines = np.unique(X.mix(X.span_hash(sums, start, stop) + doc.astype(np.uint64) * X.BASE), return_index=True)[1]
    out["n_lines"] = np.bincount(doc, minlength=t.n)[: t.n]
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[lines], minlength=t.n)[: t.n]
    return out


def features(docs: DataFrame, text: str = "text", prefix: str = "", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those of `keep`), then the counts of COUNTS (with prefix) as long."""
    X.bounded_batches(docs.sparkSession)
    names = [prefix + c for c in COUNTS]
    keep = docs.columns if keep is None else keep
    at = [docs.columns.index(c) for c in keep]
    schema = T.StructType([*(docs.schema[i] for i in at), *(T.StructField(c, T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in X.slices(batches, text):
            found = _measure(t)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in at), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=[*keep, *names])

    return docs.mapInArrow(run, schema)


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact one-sided binomial bound: the largest rate at which k or fewer of n still have probability `error`."""
    if n == 0 or k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def at_most(p: float) -> float:
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(logs)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(x - top) for x in terms)

    for _ in range(60):
        mid = (lo + hi) / 2
        if mid <= 0 or mid >= 1:
            break
        lo, hi = (mid, hi) if at_most(mid) > error else (lo, mid)
    return hi


def _figure(numerator: str, denominator: str, prefix: str) -> Column:
    n, d = F.col(prefix + numerator), F.col(prefix + denominator)
    return F.when(d > 0, n.cast("double") / d).otherwise(F.lit(0.0))


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def _cells(docs: DataFrame, labels: DataFrame, id: str, text: str, stratum: str) -> dict[tuple[str | None, bool, tuple[int, ...]], int]:
    """How many labelled documents that pass the base rules there are of each stratum, label and, by rule, number of cutoffs that the figure is beyond.

    What comes to the driver: one row for each of these, 80,190 at most a stratum and label, whatever the number of documents.
    """
    judged = labels.select(F.col(id).alias("id"), F.col("quality").alias("q")).where("id is not null and q is not null").groupBy("id").agg(F.min("q").alias("q"))
    measured = features(docs.select(F.col(id).alias("id"), F.col(stratum).alias("stratum"), F.col(text).alias("text")), keep=["id", "stratum"]).where(~base_failed())
    beyond = F.array(*[sum((_figure(n, d, "") > c).cast("int") for c in grid) for _, n, d, grid in RULES])
    rows = measured.select("id", "stratum", beyond.alias("beyond")).join(judged, "id").groupBy("stratum", (F.col("q") > 0).alias("good"), "beyond").count().collect()
    return {(r["stratum"], r["good"], tuple(r["beyond"])): r["count"] for r in rows}


def _is_beyond(rule: int, place: int, beyond: tuple[int, ...]) -> bool:
    """Grids go from lenient to strict, so a figure beyond `b` cutoffs is beyond the last b of them."""
    return beyond[rule] >= len(RULES[rule][3]) - place


def _path(bad: list[tuple[tuple[int, ...], int]]) -> list[dict[int, int]]:
    """The places of the cutoffs by rule, one step after another, each stricter: always the step that rejects most further
    bad documents, to the most lenient cutoff that does. It sees no good document, so those can test it."""
    now: dict[int, int] = {}
    out, left = [], bad
    while left:
        gains = [(sum(n for b, n in left if _is_beyond(r, i, b)), r, i) for r, rule in enumerate(RULES) for i in range(now.get(r, -1) + 1, len(rule[3]))]
        gain, r, i = max(gains, key=lambda x: (x[0], -x[2], -x[1]), default=(0, 0, 0))
        if not gain:
            break
        # The way there goes by each cutoff that rejects more than the one before.
        for j in range(now.get(r, -1) + 1, i + 1):
            rest = [x for x in left if not _is_beyond(r, j, x[0])]
            if len(rest) < len(left):
                now = now | {r: j}
                out.append(now)
                left = rest
    return out


def _strictest(good: list[tuple[tuple[int, ...], int]], path: list[dict[int, int]], risk: float, error: float) -> dict[str, float]:
    """The last step of the path before the first one whose bound is above the risk."""
    total, found = sum(n for _, n in good), {}
    for step in path:
        lost = sum(n for b, n in good if any(_is_beyond(r, i, b) for r, i in step.items()))
        if upper_bound(lost, total, error) > risk:
            break
        found = step
    return {RULES[r][0]: RULES[r][3][i] for r, i in found.items()}


def labels_needed(risk: float, error: float) -> int:
    """Good documents without which no cutoff can be certified, even if it rejects none of them."""
    return math.ceil(math.log(error) / math.log1p(-risk))


def thresholds(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id: str = "doc_id", text: str = "text", stratum: str = "lang") -> dict[str | None, dict[str, float]]:
    """The cutoffs of all rules together by stratum: what they reject together is certified, with the whole risk.

    A stratum's cutoffs are tightened along a path that its bad documents alone set, and its good ones test step after step
    until the first failure, so each step has the stratum's whole error (fixed sequence). A stratum with fewer than
    `labels_needed` good documents takes the cutoffs of all strata together, tested in the same way with an error of
    their own: for such strata the promise is one over the good documents of all strata, not over theirs.
    """
    counted = _cells(docs, labels, id, text, stratum)
    strata = {s for s, _, _ in counted}
    error = delta / (len(strata) + 1)
    of = lambda good, s=None, all=False: [(b, n) for (at, g, b), n in counted.items() if g == good and (all or at == s)]
    pooled = _strictest(of(True, all=True), _path(of(False, all=True)), risk, error)
    return {s: _strictest(of(True, s), _path(of(False, s)), risk, error) if sum(n for _, n in of(True, s)) >= labels_needed(risk, error) else pooled for s in strata}


def with_rejected(measured: DataFrame, cutoffs: dict[str | None, dict[str, float]], name: str, stratum: str = "lang", prefix: str = "") -> DataFrame:
    """measured and whether a rule of the row's stratum is beyond its cutoff; a stratum without cutoffs rejects nothing.

    The cutoffs, one row a stratum, are broadcast; there are as many as `_cells` brought to the driver.
    """
    rules = [rule for rule, *_ in RULES]
    row = lambda s: (s, *(cutoffs[s].get(rule) for rule in rules))
    kind = measured.schema[stratum].dataType.simpleString()
    table = measured.sparkSession.createDataFrame([row(s) for s in cutoffs], f"stratum {kind}, " + ", ".join(f"{rule} double" for rule in rules)).select(F.struct("*").alias(name))
    joined = measured.join(F.broadcast(table), F.col(stratum).eqNullSafe(F.col(f"{name}.stratum")), "left")
    beyond = [F.coalesce(_figure(n, d, prefix) > F.col(name)[rule], F.lit(False)) for rule, n, d, _ in RULES]
    return joined.withColumn(name, functools.reduce(Column.__or__, beyond))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept."""
    cutoffs = thresholds(docs, labels, risk, delta)
    measured = features(docs.select("doc_id", "lang", "text"), keep=["doc_id", "lang"])
    judged = with_rejected(measured, cutoffs, "rejected")
    return judged.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & ~F.col("rejected")).alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, with their own columns only."""
    cutoffs = thresholds(docs, labels, risk, delta)
    prefix = X.fresh(docs, "q_")
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    judged = with_rejected(features(docs, prefix=prefix), cutoffs, prefix + "rejected", prefix=prefix)
    return judged.where(~base_failed(prefix) & ~F.col(prefix + "rejected")).select(*docs.columns)
