"""URL filter: host and path rules, and a weighted vocabulary found by Aho-Corasick.

Rules (host/path) allow or block a host with all its subdomains where the path begins as the
rule's does; of several that fit, the longest decides, and block before allow at one length. Elsewhere
the vocabulary decides: one strict term, or at least MIN_SOFT different soft terms whose weights
reach MIN_WEIGHT, blocks. A term counts only between characters that are no ASCII letters or
digits, so `essex` holds no `sex`. A-Z is lower-cased first; escapes are not decoded.

Cases: a null or empty url has no host, path, rule or term and is allowed. Repeated rows are judged
alike. An empty table gives an empty result. Extra columns are ignored, whatever their names. A
very long url is searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenwright.llm import _text

#: The vocabulary: strict terms, and soft terms by weight. One soft term never decides; terms of weight 1 need to be three.
STRICT = tuple(
    "bdsm blowjob brazzers camgirl camgirls camsex chaturbate creampie cumshot deepthroat escortgirls escorts femdom fleshlight gangbang handjob hentai hookers hotwife livejasmin milf milfs nsfw onlyfans "
    "onlyporn pegging porn pornhub pornhd porno pornos pornstar pornstars redtube rule34 sexcam sexcams sexshop sextoys shemale stripchat swingers threesome tubeporn upskirt wank xhamster xnxx xvideos xxx youporn".split()
)
_BY_WEIGHT = {
    3: "erotic erotica erotik fetish hookup levitra nudes sex sexe sexo stripper viagra cialis xanax",
    2: "babes bookmaker bordel casino casinos cracked cracks desnuda escort gambling jackpot keygen lingerie lolita naked nackt nude nudist nue pills poker roulette serialz sexy slots sportsbet sportsbook steroids strip torrent torrents torrentz tramadol vape wager warez webcams",
    1: "adult adults amateur bet bets betting bingo blackjack cam cams cbd crack dating flirt free girls hot kissing leaks live loan loans lottery lotto mature odds pharmacy pirate singles teen teens vip webcam win winner xl",
}
SOFT = tuple((term, weight) for weight, terms in _BY_WEIGHT.items() for term in terms.split())
MIN_SOFT, MIN_WEIGHT = 2, 3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        out.add_word(term, (i, len(term)))
    out.make_automaton()
    return out


def terms(pages: DataFrame, strict: Sequence[str], soft: Mapping[str, int] | Sequence[tuple[str, int]], id: str = "page_id", url: str = "url") -> DataFrame:
    """id, url, n_strict and n_soft (different terms found), soft_weight (their weights' sum)."""
    soft = tuple(dict(soft).items())
    words = (*strict, *(w for w, _ in soft))
    weights = np.array([0] * len(strict) + [w for _, w in soft], np.int64)
    n_strict = len(strict)
    _text.bounded_batches(pages.sparkSession)
    kind = pages.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(words)
        for batch in batches:
            urls = [u or "" for u in batch.column(1).to_pylist()]
            joined = "\n".join(urls).translate({a: a + 32 for a in range(65, 91)})
            ends = np.cumsum([len(u) + 1 for u in urls])
            free = lambda i: not ((c := joined[i]).isascii() and c.isalnum()) if 0 <= i < len(joined) else True
            hits = {(end, term) for end, (term, n) in automaton.iter(joined) if free(end + 1) and free(end - n)} if urls else set()
            row = np.searchsorted(ends, [e for e, _ in hits], "right") if hits else np.zeros(0, np.int64)
            pairs = np.array(sorted({(int(r), t) for r, (_, t) in zip(row, hits)}), np.int64).reshape(-1, 2)
            is_strict = pairs[:, 1] < n_strict
            count = lambda w: pa.array(np.bincount(pairs[:, 0], w, len(urls)).astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, count(is_strict), count(~is_strict), count(weights[pairs[:, 1]])], names=["id", "url", "n_strict", "n_soft", "soft_weight"])

    return pages.select(F.col(id).alias("id"), F.col(url).alias("url")).mapInArrow(run, f"id {kind}, url string, n_strict long, n_soft long, soft_weight long").withColumnRenamed("id", id)


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. rules: (verdict, host/path), few enough for one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], strict: Sequence[str] = STRICT, soft: Sequence[tuple[str, int]] = SOFT, min_soft: int = MIN_SOFT, min_weight: int = MIN_WEIGHT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_strict, n_soft, soft_weight."""
    found = terms(pages, strict, soft).select("*", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = found.withColumn("r", rule(F.col("host"), F.col("path"), rules))
    blocked = (F.col("n_strict") > 0) | ((F.col("n_soft") >= min_soft) & (F.col("soft_weight") >= min_weight))
    verdict = F.coalesce(F.col("r.verdict"), F.when(blocked, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft", "soft_weight")
