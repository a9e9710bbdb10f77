"""Repeated substrings: bytes covered by a string of LENGTH bytes that also starts elsewhere go.

Texts are UTF-8 bytes; strings never cross documents, may repeat inside one, and are judged on the
input. Which starts have a partner is decided by suffix arrays, after a routing that brings together
what can be equal:

1. A start's anchor is the GRAM-byte string inside its LENGTH bytes with the least hash (leftmost
   of equals). It depends on those bytes alone, so equal strings have equal anchors. Runs of starts
   with one anchor are rows; runs whose anchor stands at one place only have no partner and go no further.
2. A piece is the text that a run's strings cover, known by its hash at first. Equal pieces are one from here
   on, with their number: all their strings are found. Only anchors that also have a piece at one place go
   further, with the bytes of one place of each piece.
3. Pieces with one anchor form a shard with others, of SHARD_BYTES about. There Larsson-Sadakane
   refinement sorts all suffixes to LENGTH bytes (by 8 bytes first, then doubling, in groups not yet
   single), and Kasai's common prefixes, many pieces side by side, tell neighbours that share LENGTH bytes.
4. Pieces of one very frequent anchor are dealt over several shards. Such shards publish their strings as
   sorted 64-bit fingerprints, cut by range; the runs of all shards in a range are merged, and each run
   finds by binary search in the merged order which of its strings other shards hold as well.

Passages (`words` over 0) go the same way beside the bytes, with words for letters: a word is its 64-bit
hash, a string is `words` consecutive ones, and a string counts if another document has it. They are
counted, never removed: 51 words are often less than LENGTH bytes. Rows of one id and one text are one
document here. The lowest bit of an anchor tells the two kinds apart.

Cases: null or empty text has no bytes. Texts shorter than LENGTH keep all bytes. Repeated rows
are documents of their own, so a row of LENGTH bytes or more that is there twice loses all. Texts of
any length are whole (over PART bytes they are anchored in overlapping parts). An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenwright.llm import _store
from fenwright.llm import _text as X

LENGTH, GRAM = 400, 160
#: Of a passage, in words: over 50, and the gram of its anchor.
WORDS, WORD_GRAM = 51, 12
PART = 4 << 20
SHARD_BYTES, SHARD_PIECES = 1 << 20, 1500
#: Up to so many list entries, what is removed from documents is broadcast.
FEW_ENTRIES = 1_000_000
_PLACE = np.uint64((1 << 24) - 1)


def anchors(t: X.Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, anchor hash) of each run of starts with one anchor; starts count from the text's begin."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    # Stretches of about PART bytes: whole texts, or overlapping parts of a long one.
    i = 0
    while i < t.n:
        j = max(i + 1, int(np.searchsorted(t.offsets, t.offsets[i] + PART, "right")) - 1)
        at, end = int(t.offsets[i]), int(t.offsets[j])
        while at < end:
            stop = end if j > i + 1 else min(end, at + PART)
            for o, x in zip(out, _anchors(t, i, j, at, stop, length, gram)):
                o.append(x)
            at = end if stop == end else stop - length + 1
        i = j
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _anchors(t: X.Texts, i: int, j: int, at: int, stop: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    data = t.data[at:stop]
    n, width = len(data), length - gram + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    sums = X.prefix_sums(data)
    grams = X.mix((sums[gram:] - sums[:-gram]) * X.powers(n)[1][: n - gram + 1])
    least, span = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    while 2 * span <= width:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[: n - length + 1], least[width - span : width - span + n - length + 1])
    begin, end = np.maximum(t.offsets[i:j], at) - at, np.minimum(t.offsets[i + 1 : j + 1], stop) - at
    many = np.maximum(0, end - begin - length + 1)
    start = np.repeat(begin, many) + X.spread(many)
    doc = np.repeat(np.arange(i, j), many)
    place = (least[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start))[: len(first)] - 1
    base = t.offsets[doc[first]] - at
    return doc[first], start[first] - base, start[last] - base, grams[place[first]]


def word_texts(t: X.Texts) -> X.Texts:
    """The texts as words: 64-bit hashes in place of bytes."""
    w = X.words_of(t, X.NOT_SPACE)
    return X.Texts(X.span_hash(X.prefix_sums(t.data), w.start, w.end), w.first)


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` bytes at least (beyond the end: zero bytes), by Larsson-Sadakane refinement;
    of words (64 bits) in place of bytes likewise."""
    n = len(data)
    if data.dtype == np.uint8:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        head, h = np.zeros(n, np.uint64), 8
        for b in range(8):
            head = head << np.uint64(8) | padded[b : b + n]
    else:
        head, h = data, 1
    order = np.argsort(head)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1

    def number(new: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Group numbers: the place of the group's first member. `at`: places, ascending; new: whether a group begins."""
        return np.maximum.accumulate(np.where(new, at, 0))

    sorted_head = head[order]
    new = np.ones(n, bool)
    new[1:] = sorted_head[1:] != sorted_head[:-1]
    groups = number(new, np.arange(n))
    rank[order] = groups
    last = np.append(new[1:], True)
    at = np.flatnonzero(~(new & last))  # places in groups that are not single
    while h < depth and len(at):
        own = order[at]
        next_rank = rank[np.minimum(own + h, n)] + 1
        key = groups[at].astype(np.uint64) << np.uint64(32) | next_rank.astype(np.uint64)
        resort = np.argsort(key)
        own, key = own[resort], key[resort]
        order[at] = own
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        fresh = number(new, at)
        groups[at] = fresh
        rank[own] = fresh
        last = np.append(new[1:], True)
        at = at[~(new & last)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, begin: np.ndarray, many: np.ndarray, before: np.ndarray, length: int) -> np.ndarray:
    """Bytes, up to `length`, that each start shares with the start `before` it in suffix order (-1: none).

    Starts are begin[k] .. begin[k] + many[k] - 1 of each piece k, in text order. As in Kasai's method, what a
    start shares is at least what its predecessor in the text shared, less one, as long as the partner has moved
    along; all pieces advance together, eight bytes or one word at a step.
    """
    padded = np.concatenate([data, np.zeros(length + 16, data.dtype)])
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 8, 8), (1, 1)).copy().view("<u8")[:, 0] if data.dtype == np.uint8 else padded
    out = np.zeros(len(data), np.int64)
    order = np.argsort(-many, kind="stable")
    begin, many = begin[order], many[order]
    known = np.zeros(len(begin), np.int64)
    partner = np.full(len(begin), -2)
    for step in range(int(many.max()) if len(many) else 0):
        live = int(np.searchsorted(-many, -step, "left"))
        p = begin[:live] + step
        q = before[p]
        known = np.where(q == partner[:live] + 1, np.maximum(known[:live] - 1, 0), np.maximum(known[:live] - 1, 0) * 0)
        grow = np.flatnonzero(q >= 0)
        while len(grow):
            x = words[p[grow] + known[grow]] ^ words[q[grow] + known[grow]]
            if data.dtype == np.uint8:
                low = x & (~x + np.uint64(1))
                same = np.where(x == 0, 8, (np.log2(np.where(low == 0, 1, low).astype(np.float64)).astype(np.int64)) // 8)
            else:
                same = (x == 0).astype(np.int64)
            known[grow] = np.minimum(known[grow] + same, length)
            grow = grow[(x == 0) & (known[grow] < length)]
        known[q < 0] = 0
        out[p] = known
        partner = q
    return out


def repeated_starts(pieces: list[bytes], counts: np.ndarray, length: int = LENGTH, of: np.ndarray | None = None) -> list[np.ndarray]:
    """For each piece, which of its starts have an equal string in the shard: in another piece, at another
    place of its own, or in an equal piece (counts: how many there are). With `of`, the pieces are of words,
    and the equal string must be of another document: of has the least and largest document of each."""
    kind = np.uint8 if of is None else np.uint64
    data = np.frombuffer(b"".join(pieces), kind)
    sizes = np.array([len(p) for p in pieces], np.int64) // data.itemsize
    begin, many = np.cumsum(sizes) - sizes, sizes - length + 1
    valid = np.zeros(len(data), bool)
    starts = np.repeat(begin, many) + X.spread(many)
    valid[starts] = True
    order = suffix_order(data, length)
    order = order[valid[order]]
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = common_prefixes(data, begin, many, before, length)[order] >= length
    hit = np.zeros(len(data), bool)
    if of is not None:
        piece = np.repeat(np.arange(len(pieces)), sizes)[order]
        hit[order] = _across(~shared, of[piece])
        return [hit[b : b + m] for b, m in zip(begin.tolist(), many.tolist())]
    hit[order] = shared | np.append(shared[1:], False)[: len(order)]
    return [hit[b : b + m] | (c > 1) for b, m, c in zip(begin.tolist(), many.tolist(), counts.tolist())]


def _across(new: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which members are in a group of several documents; new: where a group begins, of: least and largest document of each member."""
    first = np.flatnonzero(new)
    several = np.minimum.reduceat(of[:, 0], first) != np.maximum.reduceat(of[:, 1], first)
    return np.repeat(several, np.diff(np.append(first, len(new))))


def _ranges(hit: np.ndarray) -> list[int]:
    """[first, end) pairs of a mask, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge.tolist()


def find_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int = 0, word_gram: int = WORD_GRAM) -> DataFrame:
    """(doc_id, th, first, last, anchor, ph) of docs (doc_id, text); ph: hash of the piece."""
    X.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in X.slices(batches, "text"):
            units = [(t, length, gram)] + ([(word_texts(t), words, word_gram)] if words else [])
            for kind, (u, string, part) in enumerate(units):
                doc, first, last, key = anchors(u, string, part)
                begin = u.offsets[doc]
                ph = X.span_hash(X.prefix_sums(u.data), begin + first, begin + last + string)
                of, key = pa.array(doc), key.astype(np.uint64) & ~np.uint64(1) | np.uint64(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(key.view(np.int64)), pa.array(ph.view(np.int64))], names=["doc_id", "th", "first", "last", "anchor", "ph"])

    return docs.mapInArrow(run, "doc_id long, th long, first long, last long, anchor long, ph long")


#: What goes with a piece from its runs to its shard.
_PIECE = ("anchor", "part", "parts", "ph", "count", "low", "high")


def _pieces(docs: DataFrame, length: int, words: int) -> DataFrame:
    """(*_PIECE, piece): each of the runs of docs (runs (first, last, *_PIECE), text) with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in X.slices(batches, "text"):
            runs = batch.column(0)
            flat, cuts = runs.flatten(), np.diff(runs.offsets.to_numpy())
            first, last, key = (flat.field(i).to_numpy() for i in range(3))
            doc = np.repeat(np.arange(t.n), cuts)
            units, strings = (t, word_texts(t) if words else t), (length, words)
            bytes_ = [units[k].data[b : e + strings[k]].tobytes() for k, b, e in zip((key & 1).tolist(), *((np.where(key & 1, units[1].offsets[doc], t.offsets[doc]) + x).tolist() for x in (first, last)))]
            yield pa.RecordBatch.from_arrays([*(flat.field(2 + i) for i in range(len(_PIECE))), pa.array(bytes_, pa.binary())], names=[*_PIECE, "piece"])

    return docs.mapInArrow(run, "anchor long, part int, parts int, ph long, count long, low long, high long, piece binary")


def _search(shards: DataFrame, length: int, words: int, ranges: int) -> DataFrame:
    """Rows (anchor, ph, hits) with flat [first, end) pairs of starts of pieces at one place, and for pieces of shared anchors rows
    (range, shard, prints, refs): sorted fingerprints of a shard's strings, with (anchor, ph, start) of each,
    and for words the least and largest document."""
    kinds = {"anchor": pa.int64(), "ph": pa.int64(), "hits": pa.list_(pa.int32()), "range": pa.int32(), "shard": pa.int64(), "prints": pa.list_(pa.int64()), "refs": pa.list_(pa.int64())}
    schema = "anchor long, ph long, hits array<int>, range int, shard long, prints array<bigint>, refs array<bigint>"

    def solve(held: list[tuple], shared: bool) -> pa.RecordBatch:
        pieces, kind = [h[2] for h in held], held[0][0] & 1
        string = (length, words)[kind]
        documents = np.array([h[4:] for h in held], np.int64) if kind else None
        hits = repeated_starts(pieces, np.array([h[3] for h in held]), string, documents)
        rows = {k: [] for k in kinds}

        def put(**x: object) -> None:
            for k in kinds:
                rows[k].append(x.get(k))

        for (anchor, ph, _, count, low, high), hit in zip(held, hits):
            if (low == high if kind else count == 1) and hit.any():
                put(anchor=anchor, ph=ph, hits=_ranges(hit))
        if shared:
            data = np.frombuffer(b"".join(pieces), np.uint64 if kind else np.uint8)
            sizes = np.array([len(p) for p in pieces], np.int64) // data.itemsize
            many = sizes - string + 1
            piece, start = np.repeat(np.arange(len(pieces)), many), X.spread(many)
            at = (np.cumsum(sizes) - sizes)[piece] + start
            prints = X.span_hash(X.prefix_sums(data), at, at + string)
            order = np.argsort(prints)
            prints, piece, start = prints[order], piece[order], start[order]
            of = (prints >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            cuts = np.searchsorted(of, np.arange(ranges + 1))
            name = hash((held[0][0], held[0][1])) & 0x7FFFFFFFFFFFFFFF
            ids = np.array([(h[0], h[1]) for h in held], np.int64)
            for r in range(ranges):
                lo, hi = cuts[r], cuts[r + 1]
                if hi > lo:
                    refs = np.stack([ids[piece[lo:hi], 0], ids[piece[lo:hi], 1], start[lo:hi]], 1)
                    refs = np.hstack([refs, documents[piece[lo:hi]]]) if kind else refs
                    put(range=r, shard=name, prints=prints[lo:hi].view(np.int64), refs=refs.ravel())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for k, v in zip(kinds.values(), rows.values())], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], []), [0, 0]  # whole anchors, of bytes and of words
        group, last = [], None  # the anchor that is being read

        def close() -> Iterator[pa.RecordBatch]:
            kind, more = group[0][0] & 1, sum(len(g[2]) for g in group)
            if last[2] > 1:
                yield solve(group, True)
                return
            if held[kind] and size[kind] + more > SHARD_BYTES:
                yield solve(held[kind], False)
                held[kind].clear()
                size[kind] = 0
            held[kind].extend(group)
            size[kind] += more

        for batch in batches:
            for anchor, part, parts, *piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (anchor, part, parts) != last:
                    if group:
                        yield from close()
                    group, last = [], (anchor, part, parts)
                group.append((anchor, *piece))
        if group:
            yield from close()
        for rest in held:
            if rest:
                yield solve(rest, False)

    return shards.mapInArrow(run, schema)


def _merged(published: DataFrame) -> DataFrame:
    """(anchor, ph, hits) of strings that several shards published, by binary search in each range's merged order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        group = None

        def flush() -> pa.RecordBatch:
            anchor, ph, hits = [], [], []
            for width in (3, 5):  # bytes, words
                own = [x for x in held if x[1].shape[1] == width]
                if len(own) < 2:
                    continue
                if width == 3:
                    merged = np.sort(np.concatenate([np.unique(p) for p, _ in own]))
                else:
                    merged, of = np.concatenate([p for p, _ in own]), np.concatenate([r[:, 3:] for _, r in own])
                    order = np.argsort(merged, kind="stable")
                    merged = merged[order]
                    merged = merged[_across(np.append(True, merged[1:] != merged[:-1]), of[order])]
                for prints, refs in own:
                    many = np.searchsorted(merged, prints, "right") - np.searchsorted(merged, prints, "left")
                    found = refs[many > (width == 3)]
                    anchor += found[:, 0].tolist()
                    ph += found[:, 1].tolist()
                    hits += [[s, s + 1] for s in found[:, 2].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(ph, pa.int64()), pa.array(hits, pa.list_(pa.int32()))], names=["anchor", "ph", "hits"])

        for batch in batches:
            for i, r in enumerate(batch.column(0).to_pylist()):
                if r != group:
                    if held:
                        yield flush()
                    group, held = r, []
                prints = np.asarray(batch.column(2)[i].values)
                held.append((prints, np.asarray(batch.column(3)[i].values).reshape(len(prints), -1)))
        if held:
            yield flush()

    return published.repartition("range").sortWithinPartitions("range", "shard").mapInArrow(run, "anchor long, ph long, hits array<int>")


def _joined(hits: list[int], length: int) -> list[tuple[int, int]]:
    """The maximal stretches [first, end) that strings of `length` from these starts (flat [first, end) pairs) cover."""
    pairs = np.array(hits, np.int64).reshape(-1, 2)
    pairs[:, 1] += length - 1
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return list(zip(pairs[first, 0].tolist(), reach[np.append(first[1:], len(pairs)) - 1].tolist()))


def _apply(docs: DataFrame, length: int, words: int, texts: bool) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and the kept bytes), n_passage_words: docs (doc_id, hits, passages, text),
    hits and passages being flat starts [first, end), of bytes and of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, t in X.slices(batches, "text"):
            size, removed, many, sha, spans, kept = [], [], [], [], [], []
            passage = [sum(b - a for a, b in _joined(hits, words)) if hits else 0 for hits in batch.column(2).to_pylist()]
            for i, hits in enumerate(batch.column(1).to_pylist()):
                data = t.one(i)
                size.append(len(data))
                out = []
                if hits:
                    out = _joined(hits, length)
                    edges = [0, *(x for p in out for x in p), len(data)]
                    data = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                removed.append(size[-1] - len(data))
                many.append(len(out))
                sha.append(hashlib.sha256(data).hexdigest())
                spans.append([x for p in out for x in p])
                kept.append(data if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, many)), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary()), pa.array(passage, pa.int64())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "n_passage_words"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<bigint>, kept binary, n_passage_words long")


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = True, words: int = 0, word_gram: int = WORD_GRAM) -> DataFrame:
    """One row per row of docs (doc_id, text): what `_apply` gives; passages of `words` words at least are counted (0: none)."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")

    paths: dict[str, str] = {}

    def cut(df: DataFrame, name: str) -> DataFrame:
        paths[name] = _store.new_path(spark, f"suffix-{name}")
        out = _store.written_at(df, paths[name])
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # shuffle files of finished stages can go
        return out

    def drop(*names: str) -> None:
        for name in names:
            if name in paths:
                _store.drop(spark, paths.pop(name))

    runs = cut(find_runs(own, length, gram, words, word_gram), "runs")
    twice = cut(runs.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")  # a table, so that Spark can split a hot anchor in the join
    shared = cut(runs.join(twice, "anchor"), "shared")
    drop("runs", "anchors")

    of_words = F.col("anchor").bitwiseAND(1) == 1
    document = F.when(of_words, F.xxhash64("doc_id", "th"))
    place = [F.first(c).alias(c) for c in ("doc_id", "th", "first", "last")]  # any one
    distinct = cut(shared.groupBy("anchor", "ph").agg(F.count("*").alias("count"), F.min(document).alias("low"), F.max(document).alias("high"), *place), "distinct")
    single = F.when(of_words, F.col("low") == F.col("high")).otherwise(F.col("count") == 1)
    shares = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.max(single).alias("open"), F.min("low").alias("least"), F.max("high").alias("most"))
    shares = shares.where("n > 1 and open and (least is null or least <> most)")
    shares = cut(shares.select("anchor", F.ceil(F.col("n") / SHARD_PIECES).cast("int").alias("parts")), "shares")
    most = shares.where("parts > 1").agg(F.sum("parts")).first()[0] or 0
    ranges = max(8, most // 2)  # about as many merge groups as shards to merge
    asked = distinct.join(shares, "anchor").withColumn("part", F.pmod(F.xxhash64("ph"), "parts").cast("int"))
    keys = cut(asked.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_list(F.struct("first", "last", *_PIECE)).alias("runs")), "asked")
    found = own.join(keys.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))
    pieces = cut(_pieces(found.select("runs", "text"), length, words), "pieces")
    drop("asked", "shares")

    dealt = pieces.select("anchor", "part", "parts", "ph", "piece", "count", "low", "high")
    dealt = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "ph")
    solved = cut(_search(dealt, length, words, ranges), "solved")
    drop("pieces")
    hits = solved.where("hits is not null").select("anchor", "ph", "hits")
    if most:
        hits = hits.unionByName(_merged(solved.where("range is not null").select("range", "shard", "prints", "refs")))
        hits = hits.groupBy("anchor", "ph").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    alike = distinct.where(~single).select("anchor", "ph", F.array(F.lit(0), (F.col("last") - F.col("first") + 1).cast("int")).alias("hits"))
    hits = cut(hits.unionByName(alike), "found")  # a table again, so that a piece of very many places can be split in the join
    drop("distinct", "solved")
    placed = shared.join(hits, ["anchor", "ph"]).select("doc_id", "th", of_words.alias("of_words"), F.transform("hits", lambda h: h + F.col("first")).alias("hits"))
    listed = [F.flatten(F.collect_list(F.when(F.col("of_words") == kind, F.col("hits")))).alias(name) for kind, name in ((False, "hits"), (True, "passages"))]
    by_doc = cut(placed.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(*listed), "hits")
    drop("shared", "found")
    entries = by_doc.agg(F.sum(F.size("hits") + F.size("passages") + 4)).first()[0] or 0
    keys = F.broadcast(by_doc) if entries <= FEW_ENTRIES else by_doc.hint("shuffle_hash")
    final = own.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    return _apply(final.select("doc_id", "hits", "passages", "text"), length, words, texts)


def judge(docs: DataFrame, words: int = 0) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `words`, also n_passage_words:
    its words inside a string of so many words that another document has as well."""
    out = dedup(docs.select("doc_id", "text"), texts=False, words=words)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["n_passage_words"] * (words > 0))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """What `judge` gives for these texts, by a table of all strings; for tests."""
    places: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            places[t[i : i + length]] = places.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if places[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
