"""Text rules: which owners' patterns a text holds, and what follows from that."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fenwright.functions import text as X
from fenwright.operators.cut import cut, dealt

# When a candidate is promoted by likeness.
MIN_SCORE, MAX_NORMAL, MIN_MARGIN, MIN_INFORMATIVE, PREFILTER = 0.75, 0.55, 0.20, 2, 30


#: Up to so many rules a rule table is broadcast, so that the n-grams of texts, of which there are many, are not shuffled to meet it.
FEW_RULES = 200_000


def few(rules: DataFrame) -> DataFrame:
    """rules, to be broadcast if their counted number allows; beyond that Spark chooses."""
    return F.broadcast(rules) if rules.limit(FEW_RULES + 1).count() <= FEW_RULES else rules


#: Up to so many different keys of rules come to the driver and go into the plan as literals.
FEW_KEYS = 2_000


def _held(words: str, keys: list[str]) -> Column:
    """Those of `keys` (words joined by spaces) that stand in the words. Only where a key's first word is, words are joined."""
    found = []
    for size in sorted({k.count(" ") + 1 for k in keys}):
        sized = [k for k in keys if k.count(" ") + 1 == size]
        if size == 1:
            candidates = F.col(words)
        else:
            firsts = sorted({k.split(" ")[0] for k in sized})
            at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))), lambda i: F.get(words, i).isin(*firsts))  # noqa: B023
            candidates = F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, F.lit(size)), " "))  # noqa: B023
        found.append(F.array_intersect(candidates, F.array(*map(F.lit, sized))))
    return F.flatten(F.array(*found)) if found else F.array().cast("array<string>")


def owners(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, owners): texts (id, normal) against rules (owner, kind, key, key2).

    Kinds: token and phrase (one to four consecutive words), combo (two such, both present), sentence (the whole text).
    Few keys (FEW_KEYS, counted) are looked for in each text as it is read, so that only hits become rows; beyond that, texts
    meet rules by equal n-grams, of the sizes that the rules have.
    """
    listed = texts.select("id", F.filter(X.words(F.col("normal")), lambda t: F.length(t) >= 1).alias("w"))
    single = rules.where("kind in ('token', 'phrase')").select("owner", "key", F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    combos = rules.where("kind = 'combo'").select("owner", F.explode(F.array_distinct(F.array("key", "key2"))).alias("part"), F.col("key").alias("a"), F.col("key2").alias("b")).withColumnRenamed("part", "key")
    # One pass over the texts serves single patterns and the halves of combinations.
    wanted = single.unionByName(combos).where("key is not null").where(F.size(F.split("key", " ")) <= 4).where((F.length("key") >= 2) | F.contains("key", F.lit(" "))).distinct()
    keys = [r["key"] for r in wanted.select("key").distinct().orderBy("key").limit(FEW_KEYS + 1).collect()]
    if len(keys) <= FEW_KEYS:
        grams = listed.select("id", F.explode(_held("w", keys)).alias("key"))
    else:
        sizes = [r["n"] for r in wanted.select(F.size(F.split("key", " ")).alias("n")).distinct().orderBy("n").collect()]  # four at most
        grams = listed.select("id", F.explode(F.flatten(F.array(*[X.runs(F.col("w"), n) for n in sizes]))).alias("key"))
    met = grams.join(few(wanted), "key").groupBy("id", "owner", "a", "b").agg(F.count_distinct("key").alias("n"))
    found = met.where("a is null or a = b or n = 2").select("id", "owner")
    whole = texts.join(few(rules.where("kind = 'sentence'").select(F.col("key").alias("normal"), "owner")), "normal").select("id", "owner")
    return found.unionByName(whole).groupBy("id").agg(F.array_sort(F.collect_set("owner")).alias("owners"))


def other_than(owners: Column, own: Column) -> Column:
    return F.coalesce(F.exists(owners, lambda o: o != own), F.lit(False))


def decide(rows: DataFrame) -> DataFrame:
    """rows with flags (shape in normal, auto_error or null; exact, phrase, exact_review, phrase_review, dominant,
    context, override, own, hard_other) and what they lead to: is_auto, is_normal, is_candidate, locked.

    An error found by shape, whole text or phrase is automatic. A lock (a rule under review, a
    dominant foreign owner, a foreign context) keeps the rest from being normal unless the shape
    says so; otherwise an override, or an own pattern that no hard foreign one contradicts, makes it normal.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    normal_shape = F.coalesce(F.col("shape") == "normal", F.lit(False))
    auto = F.coalesce(F.col("shape") == "auto_error", F.lit(False)) | flag("exact") | flag("phrase")
    lock = ~normal_shape & (flag("exact_review") | flag("phrase_review") | flag("dominant") | flag("context"))
    normal = normal_shape | (~auto & ~lock & (flag("override") | (flag("own") & ~flag("hard_other"))))
    return rows.withColumns({"is_auto": auto, "is_normal": normal, "is_candidate": ~auto & ~normal, "locked": ~auto & ~normal & lock})


def context_conflict(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, foreign): texts (id, own, normal) with two context patterns, of four words at most, of one foreign owner, neither inside the other.
    Few keys (FEW_KEYS, counted) are looked for in each text as it is read, as in `owners`."""
    listed = texts.select("id", "own", X.words(F.col("normal")).alias("w"))
    wanted = contexts.select("key").where(F.col("key").isNotNull() & (F.size(F.split("key", " ")) <= 4)).distinct()
    keys = [r["key"] for r in wanted.orderBy("key").limit(FEW_KEYS + 1).collect()]
    held = _held("w", keys) if len(keys) <= FEW_KEYS else F.flatten(F.array(*[X.runs(F.col("w"), n) for n in (1, 2, 3, 4)]))
    grams = listed.select("id", "own", F.explode(held).alias("key"))
    met = grams.join(few(contexts.select("owner", "key")), "key").where("owner <> own").select("id", "owner", "key").distinct()
    hits = met.withColumn("parts", F.split("key", " "))
    a, b = hits.alias("a"), hits.alias("b")
    pairs = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.owner") == F.col("b.owner")) & (F.col("a.key") < F.col("b.key")))
    apart = (F.size(F.array_except("a.parts", "b.parts")) > 0) & (F.size(F.array_except("b.parts", "a.parts")) > 0)
    return pairs.where(apart).select(F.col("a.id").alias("id"), F.col("a.owner").alias("foreign")).distinct()


# Evidence that makes a pattern a context: for one word, for more, and for learned ones.
SINGLE_LENGTH, SINGLE_SUPPORT, SINGLE_MONTHS = 4, 20, 4
SCOPED_SUPPORT, SCOPED_MONTHS = 10, 3
LEARNED_WORDS, LEARNED_SUPPORT = 3, 10


def strict_contexts(origins: DataFrame) -> DataFrame:
    """(owner, value) of patterns pure enough to lock other owners' rows: of one owner only, with an origin (role, support,
    months, error_hits, normal_support, other_frequency) of enough support and no errors."""
    words = F.size(F.split("value", " "))
    scoped = (F.col("role") == "scoped_normal") & (F.col("error_hits") == 0)
    single = scoped & (words == 1) & (F.length("value") >= SINGLE_LENGTH) & (F.col("support") >= SINGLE_SUPPORT) & (F.col("months") >= SINGLE_MONTHS)
    several = scoped & (words > 1) & (F.col("support") >= SCOPED_SUPPORT) & (F.col("months") >= SCOPED_MONTHS)
    learned = (F.col("role") == "auto_normal") & (words >= LEARNED_WORDS) & (F.col("normal_support") >= LEARNED_SUPPORT) & (F.col("other_frequency") == 0) & (F.col("error_hits") == 0)
    shared = origins.groupBy("value").agg(F.count_distinct("owner").alias("owners")).where("owners > 1").select("value")
    return origins.where(single | several | learned).select("owner", "value").distinct().join(shared, "value", "left_anti").select("owner", "value")


def leading_lock(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, foreign): texts (id, own, normal) whose first informative words begin with a longer pattern of another owner
    than of their own. A pattern has three words at most to stand there, so three equal prefixes are all that is joined."""
    first = leading(F.col("normal"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(first), F.lit(1))), lambda n: F.struct(F.array_join(F.slice(first, F.lit(1), n), " ").alias("key"), n.alias("words")))
    begun = texts.select("id", "own", F.explode(prefixes).alias("p")).select("id", "own", "p.*").where("key <> ''")
    hits = begun.join(contexts.select("owner", "key").distinct(), "key").groupBy("id", "own", "owner").agg(F.max("words").alias("words"))
    own = hits.where("owner = own").select("id", F.col("words").alias("own_words"))
    return hits.where("owner <> own").join(own, "id", "left").where(F.col("words") > F.coalesce("own_words", F.lit(0))).select("id", F.col("owner").alias("foreign"))


def bracket_segments(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(r"[\[(【]([^\])】]*)[\])】]"), F.lit(1)), lambda s: F.trim(s) != "")


# Bracketed words that name no work.
GENERIC_TAGS = ("고객", "요청", "확인", "안내", "문의", "통화", "방문", "접수")


def bracket_lock(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(id, foreign): texts (id, own, text) with a bracketed part that holds a pattern of their own and one of another
    owner. contexts: (owner, kind, key, key2) as for `owners`; a foreign word alone is not enough."""
    parts = texts.select("id", "own", F.posexplode(bracket_segments(F.col("text"))).alias("nth", "part")).withColumn("normal", X.normal(F.col("part")))
    kept = parts.where((F.col("normal") != "") & ~F.regexp_replace("normal", " ", "").isin(*GENERIC_TAGS))
    named = kept.select(F.struct("id", "own", "nth").alias("id"), "normal")
    found = owners(named, contexts).where(F.array_contains("owners", F.col("id.own")))
    return found.select("id.id", "id.own", F.explode("owners").alias("foreign")).where("foreign <> own").select("id", "foreign").distinct()


def leading(normalised: Column, generic: tuple[str, ...] = X.GENERIC_PHRASE) -> Column:
    """The first three words that say something."""
    return F.slice(F.filter(X.words(normalised), lambda t: ~t.isin(*generic)), 1, 3)


#: Letters of references that are broadcast at once; more are met in further passes.
REFERENCE_LETTERS = 16 << 20


def _pairs(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs of letters in a text (a single letter stands for itself), and how often each is there: `text.pair_counts` as arrays."""
    letters = X.letters(text).astype(np.uint64)
    behind = letters[1:] if len(letters) > 1 else np.full(len(letters), 0xFFFFFFFF, np.uint64)
    return np.unique((letters[: len(behind)] << np.uint64(32)) | behind, return_counts=True)


class References:
    """Reference signatures by owner as an inverted index: for each pair of letters the references that hold it, with their share of it; and
    for each letter, with how often."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        self.of: dict[str, tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.letters: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for owner in sorted({o for o, _ in rows}):
            # In descending order, so that of equal cosines the greater signature comes first.
            refs = sorted({r for o, r in rows if o == owner}, reverse=True)
            held = [_pairs(r) for r in refs]
            code = np.concatenate([c for c, _ in held])
            share = np.concatenate([n / (math.sqrt((n * n).sum()) or 1.0) for _, n in held])
            order = np.argsort(code, kind="stable")
            keys, first = np.unique(code[order], return_index=True)
            at = np.repeat(np.arange(len(refs), dtype=np.int32), [len(c) for c, _ in held])
            self.of[owner] = refs, keys, np.append(first, len(code)), at[order], share[order]
            single = [np.unique(X.letters(r), return_counts=True) for r in refs]
            letter, n = (np.concatenate(c) for c in zip(*single))
            order = np.argsort(letter, kind="stable")
            keys, first = np.unique(letter[order], return_index=True)
            at = np.repeat(np.arange(len(refs), dtype=np.int32), [len(c) for c, _ in single])
            self.letters[owner] = keys, np.append(first, len(letter)), at[order], n[order], np.array([len(r) for r in refs])

    def cosines(self, owner: str, sig: str) -> np.ndarray:
        """The cosine to each reference; each list of the index is read once, at one time."""
        refs, keys, first, at, share = self.of[owner]
        code, n = _pairs(sig)
        place, which = _listed(keys, first, code)
        return np.bincount(at[place], share[place] * n[which], len(refs)) / (math.sqrt((n * n).sum()) or 1.0)

    def nearest(self, owner: str, sig: str, most: int) -> list[tuple[float, str]]:
        """(cosine, reference) of the references of largest cosine."""
        cos, refs = self.cosines(owner, sig), self.of[owner][0]
        order = np.argsort(-np.round(cos, 12), kind="stable")[:most]
        return [(float(cos[i]), refs[i]) for i in order.tolist()]

    def best(self, owner: str, sig: str, best: float, first: int) -> float:
        """The best likeness to any reference, or `best` if none is better. The `first` of largest cosine are compared first, then all others by an
        upper bound, letters in common in any order, until it is no better than what was found."""
        cos, refs = self.cosines(owner, sig), self.of[owner][0]
        keys, begin, at, many, size = self.letters[owner]
        letter, n = np.unique(X.letters(sig), return_counts=True)
        place, which = _listed(keys, begin, letter)
        common = np.bincount(at[place], np.minimum(many[place], n[which]), len(refs))
        bound = X.COSINE_WEIGHT * cos + X.SEQUENCE_WEIGHT * 2 * common / np.maximum(1, len(sig) + size)
        near = np.zeros(len(refs), bool)
        near[np.argsort(-cos, kind="stable")[:first]] = True
        for some in (np.flatnonzero(near), np.flatnonzero(~near)):
            for i in some[np.argsort(-bound[some], kind="stable")].tolist():
                if bound[i] <= best:
                    break
                r, c = refs[i], float(cos[i])
                if sig and r:
                    # As many letters as cannot make it better, less one against rounding.
                    least = math.floor((best - X.COSINE_WEIGHT * c) * (len(sig) + len(r)) / (2 * X.SEQUENCE_WEIGHT)) - 1
                    best = max(best, X.COSINE_WEIGHT * c + X.SEQUENCE_WEIGHT * 2 * X.in_blocks(sig, r, least) / (len(sig) + len(r)))
        return best


def _listed(keys: np.ndarray, first: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the lists of an index that these codes have, and which code each is of."""
    spot = np.searchsorted(keys, code)
    met = np.flatnonzero(keys[np.minimum(spot, len(keys) - 1)] == code) if len(keys) else spot[:0]
    begin = first[spot[met]]
    size = first[spot[met] + 1] - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum()), np.repeat(met, size)


#: Letters of candidates that a task takes at once, whatever the size of the batches that it is given.
LETTERS_AT_ONCE = 1 << 20


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of not much more than LETTERS_AT_ONCE."""
    size = pc.utf8_length(batch.column("sig")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    first = np.flatnonzero(np.diff((np.cumsum(size) - size) // LETTERS_AT_ONCE, prepend=-1))
    for begin, end in zip(first, [*first[1:], len(batch)]):
        yield batch.slice(begin, end - begin)


_NEAR = "array<struct<cos: double, ref: string>>"


def _compared(candidates: DataFrame, references: DataFrame, kind: str, said: Callable[[References, str, str, object], object]) -> DataFrame:
    """(owner, sig, said): of each different candidate whose owner has references, what is said, as a column of that kind, of it, the
    references, and what was said of those before. Candidates are dealt once and stay in their row; where references come in several passes,
    each pass is a table, so that a task holds one index."""
    spark = candidates.sparkSession
    known = cut(references.where("sig is not null").select("owner", "sig").distinct(), "references")
    parts = max(1, math.ceil((known.agg(F.sum(F.length("sig"))).first()[0] or 0) / REFERENCE_LETTERS))
    # By text alone: with an owner that is one constant, Spark would deal them once more, into few tasks.
    rows = dealt(candidates.where("sig is not null").select("owner", "sig"), "sig").distinct().withColumn("said", F.lit(None).cast(kind))
    for part in range(parts):
        index = spark.sparkContext.broadcast(References([tuple(r) for r in known.where(F.pmod(F.xxhash64("owner", "sig"), F.lit(parts)) == part).collect()]))
        schema = to_arrow_schema(rows.schema)

        def run(batches: Iterator[pa.RecordBatch], index=index, schema=schema) -> Iterator[pa.RecordBatch]:
            for chunk in (c for b in batches for c in _chunks(b)):
                found = []
                for owner, sig, before in zip(*(chunk.column(c).to_pylist() for c in ("owner", "sig", "said"))):
                    found.append(said(index.value, owner, sig, before) if owner in index.value.of else before)
                yield pa.RecordBatch.from_arrays([chunk.column("owner"), chunk.column("sig"), pa.array(found, schema.field(2).type)], schema=schema)

        done = rows.mapInArrow(run, rows.schema)
        rows = done if part == parts - 1 else cut(done, "compared")
    return rows.where("said is not null")


def nearest(candidates: DataFrame, references: DataFrame, most: int = PREFILTER) -> DataFrame:
    """(owner, sig, ref, cos, nth): of each different candidate (owner, sig) the `most` references (owner, sig) of its owner with the largest
    cosine of their pairs of letters, exactly; of equal ones (to twelve places) the greatest. Candidates of any length are read where they
    are; references come to them as an index, REFERENCE_LETTERS at a time, so no pair of texts is ever a row of a shuffle.
    """
    def said(index: References, owner: str, sig: str, before: list[dict] | None) -> list[dict]:
        pairs = [(n["cos"], n["ref"]) for n in before or []] + index.nearest(owner, sig, most)
        if before:
            pairs = sorted(sorted(pairs, key=lambda p: p[1], reverse=True), key=lambda p: -np.round(p[0], 12))[:most]
        return [{"cos": c, "ref": r} for c, r in pairs]

    found = _compared(candidates, references, _NEAR, said)
    return found.select("owner", "sig", F.posexplode("said").alias("before", "n")).select("owner", "sig", "n.ref", "n.cos", (F.col("before") + 1).alias("nth"))


def closest(candidates: DataFrame, references: DataFrame, first: int = PREFILTER) -> DataFrame:
    """(owner, sig, score): the best likeness of each different candidate (owner, sig) to any of the references (owner, sig) of its owner, 0 if it
    is like none; candidates of owners without references have no row. The `first` references of largest cosine are compared first, the others
    as far as they could be better, so the score is that of all pairs, whatever `first` is."""
    return _compared(candidates, references, "double", lambda index, owner, sig, before: index.best(owner, sig, before or 0.0, first)).withColumnRenamed("said", "score")


def promote(candidates: DataFrame, errors: DataFrame, normals: DataFrame) -> DataFrame:
    """Candidates (id, owner, sig, informative, locked) that are near known errors of their owner and far from its normal texts. An owner
    without either has nothing to compare with; a candidate unlike every normal text is as far as can be."""
    near = closest(candidates, errors).withColumnRenamed("score", "positive")
    far = closest(candidates, normals).withColumnRenamed("score", "negative")
    both = candidates.join(near, ["owner", "sig"]).join(far, ["owner", "sig"])
    return both.where(~F.col("locked") & (F.col("informative") >= MIN_INFORMATIVE) & (F.col("positive") >= MIN_SCORE) & (F.col("negative") < MAX_NORMAL) & (F.col("positive") - F.col("negative") >= MIN_MARGIN))
