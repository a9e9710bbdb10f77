"""Normal forms, tokens, n-grams and likeness of short texts."""

from __future__ import annotations

import functools
import math
import operator
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that say nothing, for phrases and for likeness; weights of likeness; bounds of the ordered match.
GENERIC_PHRASE = ("고객", "요청", "확인", "안내", "처리", "완료", "예정", "문의", "통화", "전화", "방문", "접수", "오더", "사항", "내용", "관련", "드립니다", "바랍니다")
GENERIC_LIKENESS = (*GENERIC_PHRASE, "부탁드립니다", "해주세요", "전화번호값", "날짜값", "금액값", "기간값", "수치값", "성명값", "주소값")
COSINE_WEIGHT, SEQUENCE_WEIGHT = 0.55, 0.45
SPLIT_TOKENS, GAP_TOKENS = 2, 6

LETTERS = "[^가-힣a-z]+"
MARKS = r"<(?:전화번호|성명|이메일|식별번호)>"


def normal(c: Column, drop_marks: bool = True) -> Column:
    """Lower case, Hangul and a-z only, single spaces. Masked texts keep the words of their marks unless those are dropped."""
    text = F.lower(F.coalesce(c, F.lit("")))
    if drop_marks:
        text = F.regexp_replace(text, MARKS, " ")
    return F.trim(F.regexp_replace(text, LETTERS, " "))


def signature(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), LETTERS, "")


def words(normalised: Column) -> Column:
    return F.filter(F.split(normalised, " "), lambda t: t != "")


def tokens(normalised: Column) -> Column:
    """Words of two letters or more."""
    return F.filter(F.split(normalised, " "), lambda t: F.length(t) >= 2)


def skips(words: Column, places: Sequence[int]) -> Column:
    """From each word on, the words at these places (0 is the word itself), joined by spaces; null where one of them is. Shifted copies of the
    list are zipped, so each is cut once. Give a column: an expression would be worked out for every copy."""
    many = F.greatest(F.size(words) - places[-1], F.lit(0))
    out = F.slice(words, F.lit(1), many)
    for shift in places[1:]:
        out = F.zip_with(out, F.slice(words, F.lit(shift + 1), many), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def runs(words: Column, size: int) -> Column:
    """All `size` consecutive words, joined by spaces. Give a column, as for `skips`."""
    return skips(words, range(size))


def ngrams(words: Column, size: int) -> Column:
    """The set of `size` consecutive words, joined by spaces."""
    return F.array_distinct(runs(words, size))


def informative(words: Column, generic: Sequence[str] = GENERIC_LIKENESS) -> Column:
    """How many different words say something."""
    return F.size(F.filter(F.array_distinct(words), lambda t: (F.length(t) >= 2) & ~t.isin(*generic)))


def remove_names(words: Column, names: Column, titles: Sequence[str] = ("님", "씨")) -> Column:
    """Words without known names, bare or with a title."""
    bare = lambda t: F.regexp_replace(t, f"(?:{'|'.join(titles)})$", "")
    return F.filter(words, lambda t: ~F.array_contains(names, t) & ~F.array_contains(names, bare(t)))


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def matched(a: np.ndarray, b: np.ndarray) -> int:
    """`in_blocks` of texts given by their letters."""
    return in_blocks(*(x.tobytes().decode("utf-32-le") for x in (a, b)))


@functools.lru_cache(16)
def _beginnings(text: str) -> tuple[np.ndarray, int, np.ndarray]:
    """The letters of a text; how many bits tell one; and what each stretch of it begins with, as many letters as fit a number, in order."""
    held, code = np.unique(letters(text), return_inverse=True)
    bits = (len(held) + 1).bit_length()
    return held, bits, np.unique(_packed(code + 1, bits))


def _packed(code: np.ndarray, bits: int) -> np.ndarray:
    """Of each place, the codes of the letters from there on as one number, 0 behind the end."""
    size = 62 // bits
    padded, out = np.append(code, np.zeros(size, np.int64)), np.zeros(len(code), np.int64)
    for i in range(size):
        out = (out << bits) | padded[i : i + len(code)]
    return out


def _longest(rows: str, side: str) -> list[int]:
    """Of each place of `rows`, how long a stretch from there on stands in `side`."""
    held, bits, begun = _beginnings(side)
    size, found = 62 // bits, letters(rows)
    spot = np.minimum(np.searchsorted(held, found), len(held) - 1)
    code = _packed(np.where(held[spot] == found, spot + 1, len(held) + 1), bits)
    above = np.searchsorted(begun, code)
    apart = np.minimum(code ^ begun[np.minimum(above, len(begun) - 1)], code ^ begun[np.maximum(above - 1, 0)])
    out = (size - np.searchsorted(1 << (bits * np.arange(size, dtype=np.int64)), apart, "right")).tolist()
    for i, known in enumerate(out):
        if known == size:
            known = max(known, out[i - 1] - 1 if i else 0)
            while i + known < len(rows) and rows[i : i + known + 1] in side:
                known += 1
        out[i] = min(known, len(rows) - i)
    return out


def in_blocks(a: str, b: str, least: int = -1) -> int:
    """Letters in matching blocks: the longest common block (the first in a, then in b), then those before and behind it, and so on.
    Once there cannot be more than `least`, the rest is left and what was found is returned.

    Stretches from each letter of the shorter text are looked for in the longer one. How long one can be there is kept from the whole to its
    parts, where it can only be shorter, so most are not looked for again.
    """
    if not a or not b:
        return 0
    by_a = len(a) <= len(b)
    rows, side = (a, b) if by_a else (b, a)
    find, longest = side.find, _longest(rows, side)
    total, todo, open_ = 0, [(0, len(rows), 0, len(side))], len(rows)
    while todo and total + open_ > least:
        r0, r1, s0, s1 = todo.pop()
        open_ -= min(r1 - r0, s1 - s0)
        most = at_row = at_side = 0
        for bound, i in sorted([(min(longest[i], r1 - i), -i) for i in range(r0, r1) if longest[i]], reverse=True):
            if bound < most:
                break
            i, k = -i, bound
            at = find(rows[i : i + k], s0, s1)
            if at < 0:
                k = most or 1
                at = find(rows[i : i + k], s0, s1) if k < bound else -1
                if at < 0:
                    longest[i] = k - 1
                    continue
                while (further := find(rows[i : i + k + 1], at, s1)) >= 0:
                    k, at = k + 1, further
                longest[i] = k
            if k > most or ((i, at) < (at_row, at_side) if by_a else (at, i) < (at_side, at_row)):
                most, at_row, at_side = k, i, at
        if most:
            total += most
            for r, q, s, t in ((r0, at_row, s0, at_side), (at_row + most, r1, at_side + most, s1)):
                if r < q and s < t:
                    todo.append((r, q, s, t))
                    open_ += min(q - r, t - s)
    return total


def pair_counts(text: str) -> Counter:
    """How often each pair of letters stands in a text; a single letter stands for itself."""
    return Counter(map(operator.add, text, text[1:]) if len(text) > 1 else text)


def _likeness(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    grams = [pair_counts(x) for x in (a, b)]
    dot = sum(n * grams[1][g] for g, n in grams[0].items())
    norms = math.prod(math.sqrt(sum(n * n for n in g.values())) for g in grams)
    return COSINE_WEIGHT * dot / norms + SEQUENCE_WEIGHT * 2 * in_blocks(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two signatures: cosine of their character pairs, blended with the ratio of matching blocks."""
    return pd.Series([_likeness(x, y) for x, y in zip(a, b)])


def adjacent(words: Column) -> Column:
    """Each word with the next one behind it."""
    return F.zip_with(words, F.concat(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), F.array(F.lit(""))), lambda a, b: F.concat(a, b))


def holds_phrase(words: Column, phrase: Column, pairs: Column | None = None, spaced: Column | None = None, packed: Column | None = None) -> Column:
    """Whether a text's words hold a phrase's words in order: each inside one or two adjacent words, the earliest that fit, no word
    used twice, at most GAP_TOKENS words between. The phrase's words are folded over the place behind the last match, -1 once one is missing.
    Give columns; and where many phrases are looked for in a text, `adjacent` of its words, and the words joined by spaces and by nothing, as columns too.

    The first word may stand anywhere. Where its first place in the text without spaces is one inside a single word, the spaces before it
    tell the place, and the list of words is not gone through.
    """
    pairs = adjacent(words) if pairs is None else pairs
    spaced = F.array_join(words, " ") if spaced is None else spaced
    packed = F.array_join(words, "") if packed is None else packed
    once = lambda value, use: F.get(F.transform(F.array(value), use), 0)

    def behind(held: Column, at: Column, word: Column) -> Column:
        step = F.array_position(held, True).cast("int")
        return once(step, lambda n: F.when(n == 0, -1).otherwise(at + n + F.when(F.contains(F.get(words, at + n - 1), word), 0).otherwise(1)))

    def follow(at: Column, word: Column) -> Column:
        ahead = F.array(*map(F.lit, range(GAP_TOKENS + 1)))  # by their places, as a slice would copy the whole list first
        return F.when(at < 0, -1).otherwise(behind(F.transform(ahead, lambda n: F.contains(F.get(pairs, at + n), word)), at, word))

    def first(word: Column) -> Column:
        before = lambda p: F.size(F.split(F.left(spaced, p), " ")) - 1
        inside = lambda p, n: F.when((p > 0) & (F.instr(packed, word) == p - n), n + 1).otherwise(behind(F.transform(pairs, lambda t: F.contains(t, word)), F.lit(0), word))
        return F.when(F.contains(packed, word), once(F.instr(spaced, word), lambda p: once(before(p), lambda n: inside(p, n)))).otherwise(-1)

    wanted = F.filter(F.split(phrase, " "), lambda t: t != "")
    rest = F.slice(wanted, F.lit(2), F.greatest(F.size(wanted) - 1, F.lit(0)))
    return (F.size(wanted) > 0) & (F.size(words) > 0) & (F.aggregate(rest, first(F.get(wanted, 0)), follow) > 0)


# Words of the likeness template.
AMOUNTS, DAYS, PHONES = ("원", "만원", "천원", "백만원", "금액"), ("일까지", "월까지", "날짜", "일자"), ("전화번호", "연락처번호")
PERIOD = r"^(?:한|두|세|네|몇)?(?:달|개월)(?:분)?$"
NAME_CONTEXT = ("부탁드립니다", "요청드립니다", "연락처", "전화번호", "전화번호값", "고객명", "성명", "명의자")


def template(detail: Column, surnames: str, not_names: Sequence[str]) -> Column:
    """The text's intent: phones and mails gone, with the name beside them; amounts, days and periods as one word each."""
    raw = F.regexp_replace(F.lower(F.coalesce(detail, F.lit(""))), r"(?<!\d)01[016789](?:[-.\s]?\d){7,8}(?!\d)", " 전화번호값 ")
    raw = F.regexp_replace(raw, r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", " 이메일값 ")
    all_words = words(normal(raw))
    removed = ("전화번호값", "이메일값")
    beside = lambda t: t.isin(*removed) | F.coalesce(t.rlike(f"(?:{'|'.join(NAME_CONTEXT)})$"), F.lit(False))
    name = lambda t: t.rlike(f"^[{surnames}][가-힣]{{1,4}}$") & ~t.isin(*not_names)
    marked = F.transform(all_words, lambda t, i: F.when(t.isin(*removed), None).when(name(t) & (F.coalesce(beside(F.get(all_words, i - 1)), F.lit(False)) | F.coalesce(F.get(all_words, i + 1).isin(*NAME_CONTEXT), F.lit(False))), None).when(t.isin(*AMOUNTS), "금액값").when(t.isin(*DAYS), "날짜값").when(t.rlike(PERIOD), "기간값").when(t.isin(*PHONES), "전화번호값").otherwise(t))
    return F.array_join(F.filter(marked, lambda t: t.isNotNull()), " ")
