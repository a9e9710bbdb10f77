"""Vectorised text work on Arrow batches: UTF-8 bytes, words, hashes, per-document sums.

All functions look at one slice of an Arrow batch at a time, a few MB of text
(one document at least), so memory does not depend on how many rows a task has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(BASE), -1, 1 << 64))
#: A random 64-bit value for each byte value, so that sums of powers carry no structure of the alphabet.
BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

#: Byte classes. SPACES: the separators of [^\x20\x09-\x0D]+; every other byte belongs to a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Lower-case ASCII letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, or one row, so that very long texts fit in a worker's memory.

    All operators set the same bound, so a DataFrame that runs after another operator was called keeps its own.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_powers = [np.zeros(0, np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; a worker keeps one pair of arrays, as long as it has needed."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        up, down = np.full(size, BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = [np.multiply.accumulate(up, out=up), np.multiply.accumulate(down, out=down)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the sum of value(byte) * BASE**position over data[i:j]; 64-bit data are their own values."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((BYTE_VALUE[data] if data.dtype == np.uint8 else data) * powers(len(data))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end], independent of where they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


@dataclass
class Texts:
    """Consecutive texts of one slice: bytes of all, and where each begins; the last offset is the end."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return np.diff(total[self.offsets])

    def one(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, where, data = column.buffers()
    where = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[where[0] : where[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, where - where[0])


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut batches so that the texts of a slice hold `most` bytes at most, or are one text."""
    for batch in batches:
        whole = texts_of(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < whole.n:
            to = max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + most, "right")) - 1)
            lo, hi = whole.offsets[at], whole.offsets[to]
            yield batch.slice(at, to - at), Texts(whole.data[lo:hi], whole.offsets[at : to + 1] - lo)
            at = to


@dataclass
class Words:
    """Words of a slice of texts, in order: byte span, text number, first word of each text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # first word of each text, and the number of words

    @property
    def n(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, size: int) -> np.ndarray:
        """Numbers of the words that begin `size` consecutive words of one text."""
        if self.n < size:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: self.n - size + 1] == self.doc[size - 1 :])


def words_of(t: Texts, is_word: np.ndarray) -> Words:
    """Maximal runs of bytes of the class, never across texts."""
    inside = np.zeros(len(t.data) + 2, np.int8)
    inside[1:-1] = is_word[t.data]
    change = np.diff(inside)
    begins, ends = change[:-1] == 1, change[1:] == -1
    cut = t.offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(t.data))]
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]  # a word at the end of one text, one at the start of the next
    begins[cut], ends[cut - 1] = True, True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, t.offsets)
    return Words(start, end, np.repeat(np.arange(t.n), np.diff(first)), first)


def gram_hash(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of `size` consecutive values of h from each position."""
    out = np.full(len(at), size, np.uint64)
    for j in range(size):
        out = mix(out * BASE + h[at + j])
    return out


def spread(counts: np.ndarray) -> np.ndarray:
    """0..count-1 for each count, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
