"""Token ids as binary files: ids ranked by frequency, one to four bytes each, control bytes apart.

Format: a folder with `ranks` (rank, id; all ids in use, most frequent first) and `blocks`, a
table in ascending doc_id order. A block holds whole documents: their ids (doc_ids), token
counts, one control byte for four tokens (two bits each: bytes of the token's rank less one, first
token in the lowest bits) and the bytes of the ranks, little-endian. `shard` is the block's
range of doc_ids, `block` its place there, `offset` the tokens before it in its shard. The
container is Parquet, so Spark's commit protocol guards the files. A block decodes by itself,
with a 256-row table of lengths.

Texts are encoded by the tokenizers library. Where the tokenizer's own normaliser and splitter prove
that it cuts at ASCII white space (CUTS_AT_SPACE), texts are cut there first, and each distinct piece is
encoded once a slice, with a bounded memory of frequent pieces. Any other tokenizer gets whole texts.

Cases: null or empty text has the end id only. Rows of one doc_id stay together, ordered by token
count and bytes. Null doc_ids come first. An empty table gives empty folders. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenwright.llm import _store, _text

END_ID = 2
SHARD_TOKENS, BLOCK_TOKENS, MOST_SHARDS = 4 << 20, 1 << 18, 65_536
#: Pieces whose ids a worker remembers; beyond that it starts anew.
MEMORY = 700_000
#: Larger slices meet fewer distinct pieces for their size.
SLICE = 6 << 20
#: What the file of a tokenizer states if it lower-cases in normal form, drops white space, and splits off runs
#: of letters, single digits and runs of anything else. Fixed values of that kind of file.
CUTS_AT_SPACE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Latin letters and digits that stay one letter or digit when lower-cased, so the splitter cuts between them and punctuation.
BEFORE_CUT = frozenset(c for c in map(chr, range(0x250)) if c.isalnum() and len(c.lower()) == 1 and c.lower().isalnum())

#: Bytes of each of the four tokens that a control byte describes.
LENGTHS = np.array([[(c >> 2 * j & 3) + 1 for j in range(4)] for c in range(256)], np.uint8)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next beyond 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else more))
        more += b not in plain
    return out


class Encoder:
    """Ids of texts, by their pieces between ASCII white space if the tokenizer states CUTS_AT_SPACE.

    What such a tokenizer does with a piece depends on the piece alone. So does a piece's end of
    ordinary punctuation after BEFORE_CUT, which it always cuts off. Lower-case Latin words in normal
    form pass its normaliser and splitter unchanged and go to its merges directly.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        stated = json.loads(self.tokenizer.to_str())
        self.pieces = all(stated[part] == said for part, said in CUTS_AT_SPACE.items()) and all(t["special"] and t["content"].isascii() and not set(t["content"]) & set(" \t\n\v\f\r") for t in stated["added_tokens"])
        self.letters = dict(enumerate(_byte_letters()))
        self.forget()

    def forget(self) -> None:
        """Know the end mark only; it is piece 0."""
        self.known: dict[str, int] = {"\n": 0}
        self.ids = np.full(1 << 16, END_ID, np.uint32)  # ids of all pieces, with room to grow
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.ones(1 << 14, np.int64)
        self.used = 1

    def _add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n, used = len(self.known), self.used
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        while len(self.start) < n + len(pieces):
            self.start, self.count = np.concatenate([self.start] * 2), np.concatenate([self.count] * 2)
        while len(self.ids) < used + len(ids):
            self.ids = np.concatenate([self.ids] * 2)
        self.start[n : n + len(pieces)] = used + np.cumsum(counts) - counts
        self.count[n : n + len(pieces)] = counts
        self.ids[used : used + len(ids)] = ids
        self.used += len(ids)

    def _add_lists(self, pieces: list[str], found: list[list[int]]) -> None:
        counts = np.fromiter(map(len, found), np.int64, len(found))
        self._add(pieces, np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces one after another, and how many each has."""
        counts = self.count[numbers]
        ends = np.cumsum(counts)
        at = np.repeat(self.start[numbers] - ends + counts, counts)
        at += np.arange(len(at))
        return self.ids[at], counts

    def _number(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > MEMORY:
            self.forget()
        known, simple, cut = self.known, {}, {}
        for p in [p for p in pieces if p not in known]:
            head = p.rstrip(",.;:!?")
            if head != p and head and head[-1] in BEFORE_CUT:
                cut[p] = head, p[len(head) :]
                simple[head] = simple[p[len(head) :]] = None
            else:
                simple[p] = None
        words, rest = [], []
        for p in simple:
            if p not in known:
                plain = p.isalpha() and (p.isascii() or (max(p) < "\u0250" and unicodedata.is_normalized("NFC", p))) and p == p.lower()
                (words if plain else rest).append(p)
        merge, letters = self.tokenizer.model.tokenize, self.letters
        self._add_lists(words, [[t.id for t in merge(p if p.isascii() else p.encode().decode("latin-1").translate(letters))] for p in words])
        if rest:
            self._add_lists(rest, [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)])
        if cut:
            halves = np.fromiter((known[x] for pair in cut.values() for x in pair), np.int64, 2 * len(cut))
            ids, counts = self._gather(halves)
            self._add(list(cut), ids, counts.reshape(-1, 2).sum(1))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def __call__(self, t: _text.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text, and the number of ids of each text."""
        if not self.pieces:
            found = [[*e.ids, END_ID] for e in self.tokenizer.encode_batch_fast([t.one(i).decode() for i in range(t.n)], add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, t.n)
            return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts
        # Strings in <| |> are the only ones whose case matters to the tokenizer.
        data = t.data if b"<|" in t.data.tobytes() else _text.LOWER[t.data]
        texts = pa.LargeStringArray.from_buffers(t.n, pa.py_buffer(np.ascontiguousarray(t.offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        split = pc.ascii_split_whitespace(texts)
        pieces = split.flatten().dictionary_encode()
        number = self._number(pieces.dictionary.to_pylist())
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        # Each text's pieces, and the end mark after them; empty pieces at its borders have no ids.
        words = np.zeros(len(pieces) + t.n, np.int64)
        marks = first[1:] + np.arange(t.n)
        inner = np.ones(len(words), bool)
        inner[marks] = False
        words[inner] = number[pieces.indices.to_numpy()]
        flat, counts = self._gather(words)
        total = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.diff(total[np.concatenate([[0], marks + 1])])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, with what it remembers."""
    return Encoder(path)


def pack(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each document; `ranks` holds their tokens one after another."""
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    used = np.arange(4) < size[:, None]
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()
    data_ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    quads = -(-counts // 4)
    at = np.repeat(4 * (np.cumsum(quads) - quads), counts) + _text.spread(counts)
    codes = np.zeros(4 * int(quads.sum()), np.uint8)
    codes[at] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8).tobytes()
    control_ends = np.concatenate([[0], np.cumsum(quads)])
    cut = lambda x, e: [x[i:j] for i, j in zip(e[:-1].tolist(), e[1:].tolist())]
    return cut(control, control_ends), cut(data, data_ends)


def unpack(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents of a block, one after another."""
    quads = -(-counts // 4)
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    lengths = lengths[np.repeat(4 * (np.cumsum(quads) - quads), counts) + _text.spread(counts)].astype(np.int64)
    at = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = np.zeros(len(lengths), np.uint32)
    for j in range(4):
        out |= np.where(lengths > j, padded[at + j], 0).astype(np.uint32) << np.uint32(8 * j)
    return out


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n and ids (bytes, 16 bits each if the vocabulary allows, else 32) of each document."""
    _text.bounded_batches(docs.sparkSession)
    kind = _kind(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch, t in _text.slices(batches, "text", SLICE):
            tokens, counts = encode(t)
            ends = np.concatenate([[0], np.cumsum(counts)]) * np.dtype(kind).itemsize
            data = tokens.astype(kind).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([data[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary")


def _kind(tokenizer: str) -> str:
    return "<u2" if _tokenizer(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def token_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """(id, n) of all token ids; each task sends at most one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=len(total))
            found[: len(total)] += total
            total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write doc_id and text of docs to path. What comes to the driver is bounded by the vocabulary and by MOST_SHARDS."""
    spark = docs.sparkSession
    kind = _kind(tokenizer)
    tokens = _store.written(tokenised(docs, tokenizer), "token-ids")
    counted = token_counts(tokens, kind).orderBy(F.desc("n"), "id").collect()
    ids = np.array([r["id"] for r in counted], np.uint32)
    rank_of = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")

    shards = max(1, min(MOST_SHARDS, -(-sum(r["n"] for r in counted) // SHARD_TOKENS)))
    marks = [i / shards for i in range(1, shards)]
    bounds = tokens.agg(F.percentile_approx("doc_id", marks, 10 * shards)).first()[0] if marks else []
    bounds = np.unique(np.array(bounds or [], np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.asarray(batch.column(1))
            control, data = pack(rank_of[np.frombuffer(b"".join(batch.column(2).to_pylist()), kind)], counts)
            shard = np.searchsorted(bounds, np.asarray(batch.column(0).fill_null(-(1 << 63))), "left")
            shard[np.asarray(batch.column(0).is_null())] = 0
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column(0), batch.column(1), pa.array(control, pa.binary()), pa.array(data, pa.binary())], names=["shard", "doc_id", "n", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, offset, held, size = -1, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            ids, n, control, data = (pa.concat_arrays([h[i] for h in held]) for i in range(1, 5))
            row = {"shard": [shard], "block": [block], "offset": [offset], "tokens": [size], "doc_ids": [ids.to_pylist()], "n_tokens": [n.to_pylist()], "control": [b"".join(control.to_pylist())], "data": [b"".join(data.to_pylist())]}
            return pa.RecordBatch.from_pydict(row, pa.schema({"shard": pa.int32(), "block": pa.int32(), "offset": pa.int64(), "tokens": pa.int64(), "doc_ids": pa.list_(pa.int64()), "n_tokens": pa.list_(pa.int64()), "control": pa.binary(), "data": pa.binary()}))

        for batch in batches:
            of, n = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            at = 0
            while at < len(of):
                if held and (of[at] != shard or size >= BLOCK_TOKENS):
                    yield out()
                    block, offset, held, size = (block + 1, offset + size, [], 0) if of[at] == shard else (0, 0, [], 0)
                shard = int(of[at])
                more = int(np.searchsorted(of, shard, "right")) - at
                take = min(more, int(np.searchsorted(np.cumsum(n[at : at + more]), BLOCK_TOKENS - size)) + 1)
                held.append(batch.slice(at, take).columns)
                size += int(n[at : at + take].sum())
                at += take
        if held:
            yield out()

    coded = tokens.mapInArrow(encode, "shard int, doc_id long, n long, control binary, data binary")
    placed = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n", "control", "data")
    schema = "shard int, block int, offset long, tokens long, doc_ids array<bigint>, n_tokens array<bigint>, control binary, data binary"
    placed.mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32; start counts the tokens of all documents before it."""
    ids = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    blocks = spark.read.parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("all"))
    base = F.coalesce(F.sum("all").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = {r["shard"]: r["base"] for r in shards.select("shard", base.alias("base")).collect()}  # MOST_SHARDS at most

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.array(r["n_tokens"], np.int64)
                tokens = ids[unpack(r["control"], r["data"], counts)].astype("<u4").tobytes()
                ends = np.cumsum(counts)
                start = bases[r["shard"]] + r["offset"] + ends - counts
                crc = [zlib.crc32(tokens[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    out = blocks.select("shard", "offset", "doc_ids", "n_tokens", "control", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out


def judge(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs to a folder in the shared directory and give what its files hold, per document."""
    spark = docs.sparkSession
    path = _store.new_path(spark, "tokens")
    write(docs, path, tokenizer)
    return read(spark, path)
