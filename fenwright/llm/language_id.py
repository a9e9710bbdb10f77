"""Language of texts by error-correcting output codes over byte n-grams.

Each language has a codeword of bits, and a binary classifier predicts each bit. Up to EXHAUSTIVE languages every split
of them into two is a bit (four languages: seven bits, any two codewords four apart, so one wrong bit does no harm);
beyond, codewords are the best of some random draws of a fixed seed. A classifier is a ridge regression on n-gram
frequencies: one to four bytes of a lower-cased word with a space on either side, hashed into BUCKETS.

Decoding weighs losses: a language's loss is the mean of exp(-margin) over its bits, each bit weighed by how often its
classifier was right on that language's own learning rows, each left out in turn (known in closed form). The least loss
names the language. The score is that language's share of exp(-sharpness * loss) over all languages; the sharpness is the one
that makes the same left-out rows likeliest. A text is ambiguous if the second language's share comes within CLOSE of the first's, or if
more bits are wrong than the code can correct.

The classifiers learn from a bounded sample: of each language the ROWS_A_LANGUAGE ids of least hash, TRAIN_ROWS in all at most, with whole
texts. Rows to learn from are those that `learn` allows, with text and language; nothing but the text goes into a prediction. Only
the sample's n-gram counts come to the driver, 16 KB a row, and only the weights are broadcast.

Cases: a text that is null or has no letter is `und`, with score 0, and ambiguous. Without any row to learn from all are `und`; with one
language all other texts are of it, with score 1. Rows without id are not learned from. An id with several texts or repeated rows counts
once a language, with its greatest text. Repeated rows are judged alike, each on its own. An empty table gives no rows. Very long texts
are taken whole, in slices of words. Extra columns are ignored, whatever their names; ids may be of any type.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwright.llm import _text as X

GRAMS, BUCKETS = (1, 2, 3, 4), 1 << 12
ROWS_A_LANGUAGE, TRAIN_ROWS = 500, 4000
EXHAUSTIVE = 6
RIDGE = 0.1
CLOSE = 0.2
UNKNOWN = "und"
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def code_words(k: int) -> np.ndarray:
    """Codewords of k languages, one a row, of -1 and 1: all splits into two, or random ones with distances as long as found."""
    if k <= EXHAUSTIVE:
        splits = [bits for bits in itertools.product((1, -1), repeat=k) if bits[0] == 1 and -1 in bits]
        return np.array(splits, np.int8).reshape(-1, k).T
    rng, length, best, at = np.random.default_rng(20240311), math.ceil(10 * math.log2(k)), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, length))
        apart = int(distances(code))
        if (np.abs(code.sum(0)) < k).all() and apart > at:
            best, at = code, apart
    return best


def distances(code: np.ndarray) -> int:
    """The least number of bits in which two codewords differ."""
    same = code.astype(np.int64) @ code.T.astype(np.int64)
    return int((code.shape[1] - same[~np.eye(len(code), dtype=bool)].max()) // 2) if len(code) > 1 else 0


def grams(t: X.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the distinct words of lower-cased texts, each n-gram's word; each running word's distinct word and text."""
    words = X.words_of(t, LETTERS)
    _, one, which = np.unique(X.span_hash(X.prefix_sums(t.data), words.start, words.end), return_index=True, return_inverse=True)
    size = words.end[one] - words.start[one] + 2
    first = np.cumsum(size) - size
    data = np.full(int(size.sum()), 0x20, np.uint64)
    inside = np.repeat(first + 1, size - 2) + X.spread(size - 2)
    data[inside] = t.data[np.repeat(words.start[one], size - 2) + X.spread(size - 2)]
    of = np.repeat(np.arange(len(one)), size)
    buckets, owners, code = [], [], np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | data[n - 1 :]
        if n in GRAMS:
            own = np.flatnonzero(of[:m] == of[n - 1 :])
            buckets.append((X.mix(code[own] | np.uint64(n << 56)) >> np.uint64(64 - int(math.log2(BUCKETS)))).astype(np.int64))
            owners.append(of[own])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(buckets), join(owners), which, words.doc


def margins(t: X.Texts, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """What the classifiers (columns of weights) say of each text."""
    bucket, word, which, doc = grams(t)
    n_words = int(word.max()) + 1 if len(word) else 0
    per_word = np.bincount(word, minlength=n_words).astype(float)
    total = np.bincount(doc, per_word[which], t.n)
    out = np.zeros((t.n, len(bias)))
    for b in range(len(bias)):
        said = np.bincount(word, weights[bucket, b], n_words)
        out[:, b] = np.bincount(doc, said[which], t.n) / np.maximum(total, 1) + bias[b]
    return out


def frequencies(t: X.Texts) -> np.ndarray:
    """Share of each bucket among the n-grams of one text."""
    bucket, word, which, _ = grams(t)
    times = np.bincount(which, minlength=int(word.max()) + 1 if len(word) else 0).astype(float)
    counts = np.bincount(bucket, times[word], BUCKETS)
    return (counts / max(counts.sum(), 1.0)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    trust: np.ndarray  # languages x bits: shares of 1 a language
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    sharpness: float

    def losses(self, margin: np.ndarray) -> np.ndarray:
        return (np.exp(-np.clip(margin[:, None] * self.code, -8, 8)) * self.trust).sum(2)

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each row of margins: the language's number, its share, the second's share, wrong bits."""
        share = _shares(self.losses(margin), self.sharpness)
        best = share.argmax(1)
        rest = share.copy()
        rest[np.arange(len(best)), best] = 0
        wrong = ((margin > 0) != (self.code[best] > 0)).sum(1)
        return best, share[np.arange(len(best)), best], rest.max(1), wrong


def _shares(loss: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(-sharpness * (loss - loss.min(1, keepdims=True)))
    return e / e.sum(1, keepdims=True)


def fit(languages: list[str], of: np.ndarray, x: np.ndarray) -> Model:
    """From rows of n-gram shares and their languages' numbers: one ridge regression a bit, solved for all bits at once."""
    code = code_words(len(languages))
    scale = 1 / (np.sqrt((x.astype(np.float64) ** 2).mean(0)) + 1e-4)
    mean = x.mean(0)
    z = ((x - mean) * scale).astype(np.float32)
    gram = (z @ z.T).astype(np.float64)
    target = code[of].astype(float)
    base = target.mean(0)
    inverse = np.linalg.inv(gram + RIDGE * np.trace(gram) / len(x) * np.eye(len(x)))
    dual = inverse @ (target - base)
    weights = (z.T @ dual) * scale[:, None]
    bias = base - mean @ weights
    # What each row gets from classifiers that have learned from all others.
    left_out = target - dual / np.diag(inverse)[:, None]
    right = np.stack([((left_out[of == c] > 0) == (code[c] > 0)).mean(0) for c in range(len(languages))])
    trust = np.maximum(right, 1e-3)
    model = Model(languages, code.astype(float), trust / trust.sum(1, keepdims=True), weights, bias, 1.0)
    loss = model.losses(left_out)
    likelihood = lambda s: np.log(np.maximum(_shares(loss, s)[np.arange(len(of)), of], 1e-12)).sum()
    model.sharpness = max((0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0), key=likelihood)
    return model


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in lower case, null where there is no letter; the column `text` is the last."""
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        text = pc.if_else(pc.match_substring_regex(text, r"\p{L}"), text, None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.utf8_lower(text)], names=batch.schema.names)


def sample(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, text): rows to learn from, as many as the bounds allow."""
    allowed = docs.where(learn & F.col(id).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    place = F.xxhash64("lang", F.col("id").cast("string"))
    counted = {r["lang"]: r["n"] for r in allowed.groupBy("lang").agg(F.approx_count_distinct("id").alias("n")).collect()}
    most = min(ROWS_A_LANGUAGE, max(1, TRAIN_ROWS // max(1, len(counted))))
    # Hashes below a language's bound are half as many again as wanted, so that few texts are shuffled.
    bounds = [(s, min(2**63 - 1, int(-(2**63) + (1.5 * most + 50) / n * 2**64))) for s, n in counted.items()]
    bound = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound long"))
    near = allowed.withColumn("place", place).join(bound, "lang").where("place <= bound").groupBy("lang", "id", "place").agg(F.max("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "text")


def train(docs: DataFrame, learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The model, or none where there is nothing to learn from."""
    X.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lowered(batches):
            rows = [frequencies(X.texts_of(batch.column(1).slice(i, 1))).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "x"])

    rows = sample(docs, learn, id, text, lang).mapInArrow(run, "lang string, x binary").collect()
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # the order of partitions makes no difference
    return fit(languages, np.array([languages.index(r["lang"]) for r in rows]), np.stack([np.frombuffer(r["x"], np.float32) for r in rows]))


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs, then lang_pred, score, second_score, wrong_bits, ambiguous."""
    spark = docs.sparkSession
    X.bounded_batches(spark)
    known = spark.sparkContext.broadcast(model)
    added = {"lang_pred": T.StringType(), "score": T.DoubleType(), "second_score": T.DoubleType(), "wrong_bits": T.IntegerType(), "ambiguous": T.BooleanType()}
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, k) for c, k in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = known.value
        correctable = (distances(m.code) - 1) // 2 if m else 0
        for batch, t in X.slices(_lowered(batches), batch_text):
            has = batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)
            lang, best, second, wrong = np.full(t.n, UNKNOWN, object), np.zeros(t.n), np.zeros(t.n), np.zeros(t.n, np.int32)
            unsure = np.ones(t.n, bool)
            if m and has.any():
                at, share, rest, bits = m.decode(margins(t, m.weights, m.bias))
                lang[has] = np.array(m.languages, object)[at][has]
                best[has], second[has], wrong[has] = share[has], rest[has], bits[has]
                unsure = ~has | (share - rest < CLOSE) | (bits > correctable)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang.tolist(), pa.string()), pa.array(best), pa.array(second), pa.array(wrong.astype(np.int32)), pa.array(unsure)], names=[*keep, *added])

    batch_text = X.fresh(docs.select(*keep), "text")
    return docs.select(*keep, F.col(text).alias(batch_text)).mapInArrow(run, schema)


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, and how sure that is. Held-out documents are not learned from."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, ~held_out)
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
