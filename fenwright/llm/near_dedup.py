"""Near duplicates: MinHash signatures joined under a Hamming distance through several indexes.

Documents are sets of word shingles; two are linked if their Jaccard similarity reaches a bound,
confirmed on the full sets. Candidates come from signatures of SLOTS values of 16 bits: two sets
of similarity s differ in a share 1 - s of them. With a distance threshold r and CHUNKS chunks,
some chunk of any pair within the threshold has at most r // CHUNKS differing values (pigeonhole),
here one, so each chunk is entered four times, each time without one of its four values, and
every pair within the threshold meets under some key. A pair of similarity 0.8 is beyond the
threshold with a chance of 6e-7, one of 0.85 with 4e-10.

Groups of copies may hold a third of all rows, so pairs are never listed; every step gives at most
one row for each member of a group it looks at:
1. Documents of equal sets are one class from the start.
2. Under each key, every class is held against the smallest one only (if their signatures are
   within the threshold), and components are formed.
3. Keys that still join several components are searched in blocks. Two components with a pair within
   the threshold, whose sets can reach the similarity at all (by their sizes, and by what they hold
   in each of BINS parts of the hash space, which bounds the intersection from above), belong to one
   neighbourhood; a block tells only links that join components not yet joined there.
4. A neighbourhood is compared on full sets in blocks of SET_VALUES shingles, all blocks with all
   others, but for the inside of one component. A block again tells only links that join something.
So every pair within the threshold is either inside one component or compared on its full sets.

Cases: null, empty or blank text has no shingles, is linked with nothing and is its own
component. Fewer words than a shingle: the whole sequence is one shingle. Repeated rows are
linked (if not empty). Rows of one doc_id and different texts are different documents, both of
which may be kept. A null doc_id stays null unless a linked document has an id; such rows are
kept only if nothing is linked with them. Extra columns are ignored by `judge`, kept by
`filter_documents`. Sets are told apart, and shingles compared, by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenwright.llm import _store
from fenwright.llm import _text as X
from fenwright.operators.graph import connected_components

SLOTS, CHUNKS, DISTANCE = 64, 16, 31
WIDTH = SLOTS // CHUNKS
assert DISTANCE // CHUNKS == 1
#: Parts of the hash space in which a set's shingles are counted, one byte each; a full byte bounds nothing.
BINS, FULL = 256, 255
#: Requests held against one stored text in a task; classes of a key in one block; shingles in one block of full sets.
PROBES, BUCKET_BLOCK, SET_VALUES = 2048, 1024, 500_000

_rng = np.random.default_rng(7_000_003)
FACTORS = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(t: X.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and where each text's begin."""
    t = X.Texts(X.LOWER[t.data], t.offsets)
    words = X.words_of(t, X.NOT_SPACE)
    h = X.span_hash(X.prefix_sums(t.data), words.start, words.end)
    at = words.windows(size)
    hashes, doc = [X.gram_hash(h, at, size)], [words.doc[at]]
    counts = words.counts()
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        hashes.append(X.gram_hash(h, words.first[short], n))
        doc.append(short)
    value, doc = np.concatenate(hashes), np.concatenate(doc)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(t.n + 1))


def _signatures(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    out = np.empty((len(begins), SLOTS), np.uint16)
    for k in range(SLOTS):
        out[:, k] = X.mix(np.minimum.reduceat(values * FACTORS[k], begins)).astype(np.uint16)
    return out


def _bins(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many of each set's shingles fall in each part of the hash space, FULL at most."""
    n = len(begins) - 1
    cell = np.repeat(np.arange(n), np.diff(begins)) * BINS + (X.mix(values) >> np.uint64(56)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=n * BINS), FULL).astype(np.uint8).reshape(n, BINS)


def _parts(texts: DataFrame, size: int) -> DataFrame:
    """(set, bins) of texts (set, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in X.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in _bins(*shingle_sets(t, size))], pa.binary())], names=["set", "bins"])

    return texts.select("set", "text").mapInArrow(run, "set long, bins binary")


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, set (hash of the shingle set), sig; set and sig are null for empty sets."""
    X.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in X.slices(batches, "text"):
            values, begins = shingle_sets(t, size)
            n = np.diff(begins)
            full = np.flatnonzero(n)
            sets, sig = np.zeros(t.n, np.uint64), np.zeros((t.n, SLOTS), np.uint16)
            if len(full):
                sets[full] = X.mix(np.add.reduceat(X.mix(values + X.BASE), begins[full]) + n[full].astype(np.uint64))
                sig[full] = _signatures(values, begins[full])
            empty = n == 0
            raw = pa.array([None if e else row.tobytes() for e, row in zip(empty.tolist(), sig)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets.view(np.int64), pa.int64(), mask=empty), raw], names=["doc_id", "th", "n_shingles", "set", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, n_shingles long, set long, sig binary")


def _keys(classes: DataFrame) -> DataFrame:
    """(key, set): each chunk of the signature without each of its values, with chunk and place in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.int64)
            keys = np.empty((len(sig), CHUNKS, WIDTH), np.int64)
            for w in range(WIDTH):
                rest = [sig[:, :, j] for j in range(WIDTH) if j != w]
                keys[:, :, w] = (np.arange(CHUNKS) * WIDTH + w) << 48 | rest[0] << 32 | rest[1] << 16 | rest[2]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), CHUNKS * WIDTH))], names=["key", "set"])

    return classes.select("set", "sig").mapInArrow(run, "key long, set long")


def _distance_ok(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(-1) <= DISTANCE


def _near_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those (set, pivot) whose signatures are within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SLOTS) for i in (2, 3))
                yield batch.select(["set", "pivot"]).filter(pa.array(_distance_ok(a, b)))

    sig = classes.select("set", "sig")
    both = pairs.join(sig, "set").join(sig.select(F.col("set").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
    return both.select("set", "pivot", "sig", "pivot_sig").mapInArrow(run, "set long, pivot long")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b): those (set, pivot) that are alike on full sets.

    The sets held against one pivot are dealt out over several tasks when they are many, each with a copy of the pivot.
    """
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("parts"))
    asked = pairs.join(parts, "pivot").select("set", "pivot", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("asks"))
    held = parts.select(F.col("pivot").alias("set"), "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("asks"))
    rows = asked.unionByName(held).join(texts, "set").select("pivot", "part", "asks", "set", "text")
    dealt = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = np.zeros(0, np.uint64)
        for batch, t in X.slices(batches, "text"):
            flat, begins = shingle_sets(t, size)
            hit = np.zeros(t.n, bool)
            for i, asks in enumerate(np.asarray(batch.column(2)).tolist()):
                own = flat[begins[i] : begins[i + 1]]
                if not asks:
                    stored = own
                    continue
                at = np.minimum(np.searchsorted(stored, own), len(stored) - 1)
                common = int((stored[at] == own).sum())
                hit[i] = 100 * common >= percent * (len(own) + len(stored) - common)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(0)], names=["a", "b"]).filter(pa.array(hit))

    return dealt.mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """Rows (key, lo, hi, set, component, many, sig, bins) dealt out so that any two of one key meet in some (key, lo, hi):
    keys of many classes are cut into blocks, and each pair of blocks is one group."""
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set"), blocks).cast("int")
    rows = members.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "component", "many", "sig", "bins")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "component")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first `keys` columns, which come one after another."""
    group, held = None, []
    for batch in batches:
        key = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                now = tuple(key[:, lo].tolist())
                if now != group:
                    if held:
                        yield pa.Table.from_batches(held)
                    group, held = now, []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


class _Joined:
    """Which of the items 0, 1, .. are joined, as a label of each."""

    def __init__(self, component: np.ndarray) -> None:
        self.label = np.unique(component, return_inverse=True)[1]
        self.left = int(self.label.max()) + 1

    def join(self, a: int, others: np.ndarray) -> list[int]:
        """Join a with the others; one of them for each label that was another one."""
        labels, first = np.unique(self.label[others], return_index=True)
        own = self.label[a]
        new = labels != own
        if new.any():
            to = np.arange(int(self.label.max()) + 1)
            to[labels[new]] = own
            self.label = to[self.label]
            self.left -= int(new.sum())
        return others[first[new]].tolist()


def _alike(many: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be as similar as `percent` at all."""
    return 100 * np.minimum(many, others) >= percent * np.maximum(many, others)


def _neighbours(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that have a pair within the threshold under some key, as many as join them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for t in _runs(batches, 3):
            comp, many = (np.asarray(t.column(c).combine_chunks()) for c in ("component", "many"))
            if (comp == comp[0]).all():
                continue
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
            bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(-1, BINS)
            joined, out = _Joined(comp), []
            for i in range(len(comp)):
                if joined.left == 1:
                    break
                j = np.flatnonzero((joined.label != joined.label[i]) & _alike(many[i], many, percent))
                j = j[(sig[j] != sig[i]).sum(1) <= DISTANCE]
                if len(j):
                    least = np.minimum(bins[j], bins[i])
                    common = least.sum(1, dtype=np.int64)
                    j = j[(100 * common >= percent * (many[i] + many[j] - common)) | (least == FULL).any(1)]
                    out += [(int(comp[i]), int(comp[k])) for k in joined.join(i, j)]
            out = [p for p in out if p not in seen]
            if len(seen) > 1 << 20:
                seen.clear()
            seen.update(out)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return _blocks(members).mapInArrow(run, "a long, b long").distinct()


def _compared(inside: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes of one neighbourhood, on full sets, as many as join what is linked there.

    inside: (set, component, area, many). Blocks hold SET_VALUES shingles about, or one class; a component
    of that size has blocks of its own, which are not held against each other.
    """
    sizes = inside.groupBy("area", "component").agg(F.sum("many").alias("values"))
    owner = F.when(F.col("values") >= SET_VALUES, F.col("component")).otherwise(0)
    owned = _store.written(sizes.withColumn("large", F.col("values") >= SET_VALUES).withColumn("owner", owner), "near-owners")
    blocks = owned.groupBy("area", "large", "owner").agg(F.ceil(F.sum("values") / SET_VALUES).cast("int").alias("blocks"))
    blocks = _store.written(blocks, "near-blocks")
    each = blocks.select("area", "large", "owner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    one, two = (F.struct("large", "owner", "block").alias(n) for n in "xy")
    pairs = each.select("area", one).join(each.select("area", two), "area").where("x <= y and not (x.large and y.large and x.owner = y.owner)")
    pairs = pairs.select("area", F.xxhash64("x").alias("lo"), F.xxhash64("y").alias("hi"))
    places = pairs.select("area", F.col("lo").alias("at"), "lo", "hi").unionByName(pairs.where("lo <> hi").select("area", F.col("hi").alias("at"), "lo", "hi"))
    dealt = inside.join(owned.drop("values"), ["area", "component"]).join(blocks, ["area", "large", "owner"])
    block = F.when(F.col("large"), F.pmod(F.xxhash64("set"), "blocks")).otherwise(F.pmod(F.xxhash64("component"), "blocks")).cast("int").alias("block")
    dealt = dealt.select("area", "set", "component", F.xxhash64(F.struct("large", "owner", block)).alias("at"))
    rows = dealt.join(places, ["area", "at"]).join(texts, "set").select("area", "lo", "hi", "at", "set", "component", "text")
    rows = rows.repartition("area", "lo", "hi").sortWithinPartitions("area", "lo", "hi", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            comp, name, at = (np.asarray(t.column(c).combine_chunks()) for c in ("component", "set", "at"))
            joined = _Joined(comp)
            if joined.left == 1:
                continue
            parts = [shingle_sets(x, size) for _, x in X.slices(t.to_batches(), "text")]
            many = np.concatenate([np.diff(b) for _, b in parts])
            values, owner = np.concatenate([v for v, _ in parts]), np.repeat(np.arange(len(many)), many)
            # Each shingle's owners stand together: places[s] .. places[s + 1] for the shingle numbers of `values`.
            order = np.argsort(values, kind="stable")
            new = np.ones(len(values), bool)
            new[1:] = values[order][1:] != values[order][:-1]
            places, number = np.append(np.flatnonzero(new), len(values)), np.empty(len(values), np.int64)
            number[order] = np.cumsum(new) - 1
            owners, begin = owner[order], np.cumsum(many) - many
            asks = at == at[0]  # one block, or the smaller one of two, is held against all
            asks = asks if 2 * asks.sum() <= len(asks) or asks.all() else ~asks
            a, b = [], []
            for i in np.flatnonzero(asks).tolist():
                if joined.left == 1:
                    break
                own = number[begin[i] : begin[i] + many[i]]
                n = places[own + 1] - places[own]
                common = np.bincount(owners[np.repeat(places[own], n) + X.spread(n)], minlength=len(many))
                j = np.flatnonzero((100 * common >= percent * (many + many[i] - common)) & (joined.label != joined.label[i]))
                if len(j):
                    found = joined.join(i, j)
                    a += [int(name[i])] * len(found)
                    b += name[found].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, th (xxhash64 of the text), n_shingles, component_id of every row of docs (doc_id, text)."""
    cut = lambda df, name: _store.written(df, f"near-{name}")
    sketched = cut(sketches(docs, size), "sketches")
    one = [F.first(c).alias(c) for c in ("sig", "n_shingles")]
    classes = cut(sketched.where("set is not null").groupBy("set").agg(*one, F.min(F.struct("doc_id", "th")).alias("one")), "classes")

    # 2. Against the smallest class under each key.
    keys = _keys(classes)
    buckets = keys.groupBy("key").agg(F.min("set").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = cut(keys.join(buckets, "key"), "members")
    pairs = members.where("set <> pivot").select("set", "pivot").distinct()
    near = cut(_near_pairs(pairs, classes), "pairs")
    wanted = members.select("set").distinct().join(classes, "set").select("set", "one.*")
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text")
    texts = texts.join(wanted.hint("shuffle_hash"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).select("set", "text")
    texts = cut(texts.groupBy("set").agg(F.first("text").alias("text")), "texts")
    links = cut(_confirmed(near, texts, size, percent), "links")
    found = cut(connected_components(links, "a", "b"), "found")

    # 3. Neighbourhoods of components that some key still joins.
    labelled = members.select("key", "n", "set").join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    left = labelled.join(open_keys, "key")
    some = cut(_parts(texts.join(left.select("set").distinct(), "set"), size), "parts").join(classes.select("set", F.col("n_shingles").alias("many"), "sig"), "set")
    left = left.join(some, "set")
    areas = connected_components(cut(_neighbours(left, percent), "neighbours"), "a", "b").select(F.col("node").alias("component"), F.col("component").alias("area"))

    # 4. Comparison inside neighbourhoods.
    inside = classes.select("set", F.col("n_shingles").alias("many")).join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    inside = cut(inside.join(areas, "component"), "inside")
    more = cut(_compared(inside, texts, size, percent), "more-links")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more), "a", "b")

    rows = sketched.select("doc_id", "th", "n_shingles", "set").join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    smallest = cut(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest")), "smallest")
    return rows.join(smallest, "component", "left").select("doc_id", "th", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))


def judge(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    found = components(docs.select("doc_id", "text"), size, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def filter_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their group: one row each, also where its row is repeated."""
    found = components(docs.select("doc_id", "text"), size, percent)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "th", "n_shingles").agg(F.count("*").alias("n"))
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"))
    one = row.join(kept.hint("shuffle_hash"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).select("row", "d", "h", "n", "n_shingles")
    again = one.where("n > 1 and n_shingles > 0").groupBy("d", "h").agg(F.first("row").alias("row"))
    return one.where("n = 1 or n_shingles = 0").select("row.*").unionByName(again.select("row.*"))
