"""Language identification, ranked search and the filter audit against brute force and on odd rows."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fenwright.llm import filter_audit, language_id, lexical_search

SCHEMA = "doc_id long, text string, lang string, source string, item string, PART int, words string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def prose(n: int, seed: int, words: tuple[str, ...] = ("the", "über", "NASA", "x1", "Haus", "a", "éé")) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(60)) * (r.random() < 0.6) for _ in range(n))


TEXTS = [None, "", "  \n ", "###", "one", "One TWO one", prose(80, 1), prose(80, 1), prose(80, 1), prose(30_000, 2), "é" * 5000, prose(60, 3) + " $", "ABC DEF " * 30, "the " * 70]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, None if i % 4 == 1 else f"s{i % 3}", "x", 1, "y") for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[9], (None, prose(80, 1), "en", "", None, None, None), (3, prose(80, 1), None, "s0", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, top=10):
    """What `judge` gives, by scoring every document for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c, n in held:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in wanted.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


ITEMS = [(1, "One two the the NASA"), (2, None), (3, "..."), (4, "nowhere-at-all"), (5, prose(40, 1)), (5, "über"), (None, "a haus x1"), (7, prose(80, 1)), (8, "é" * 5000), (9, prose(3000, 2)), (10, "one one one")]


def test_search(spark, docs, empty):
    items = spark.createDataFrame([(*r, "extra") for r in ITEMS], "item_id long, text string, term string")
    expected = ranked([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    got = lexical_search.judge(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected
    assert lexical_search.judge(empty, items).count() == 0 and lexical_search.judge(docs, items.limit(0)).count() == 0


def test_search_over_many_shards_and_query_blocks(spark, monkeypatch):
    rows = [(i, prose(5 + i * 7 % 90, i % 400)) for i in range(1500)]
    items = [(f"q{k}", prose(12, k)) for k in range(20)]
    expected = ranked(rows, items)
    docs, queries = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id string, text string")
    for name, value in (("SHARD_POSTINGS", 700), ("SHARD_DOCS", 100), ("PART_ROWS", 60), ("FIRST_BLOCK", 8), ("LAST_BLOCK", 32)):
        monkeypatch.setattr(lexical_search, name, value)
    assert sorted((tuple(r) for r in lexical_search.judge(docs, queries).collect()), key=str) == expected


def test_wand_skips_what_cannot_win(monkeypatch):
    """The heap is that of all scores; documents with common terms only are not looked up once it is full."""
    r = np.random.default_rng(3)
    n, weights = 20_000, np.array([5, 40, 900, 2000])
    held = [np.flatnonzero(np.array([True, i % 2 == 0, r.random() < 0.02, r.random() < 0.005])) for i in range(n)]
    sizes, flat = np.array(list(map(len, held))), np.concatenate(held)
    tfs, lengths = r.integers(1, 9, len(flat)), r.integers(20, 400, n)
    shard = lexical_search.Shard.of(flat, tfs, sizes, lengths, weights, n, int(lengths.sum()))
    score = np.zeros(n, np.int64)
    np.add.at(score, shard.keys % n, np.array([1, 2, 1, 1])[shard.keys // n] * shard.impact)
    best = np.lexsort((np.arange(n), -score))[:10]
    walked, spread = [], lexical_search.X.spread
    monkeypatch.setattr(lexical_search.X, "spread", lambda counts: walked.append(int(counts.sum())) or spread(counts))
    places, scores = lexical_search.wand(shard, np.arange(4), np.array([1, 2, 1, 1]))
    assert places.tolist() == best.tolist() and scores.tolist() == score[best].tolist()
    assert sum(walked) < 0.1 * len(flat)


def followed(docs, labels):
    """What `judge` gives, by sending each row through each order of the filters."""
    good, toxic, least = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}, {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    rows = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        rows.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = Counter()
    for part in {r[0] for r in rows}:
        own, removed_of = [r for r in rows if r[0] == part], Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                hit = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_of[f] += len(hit)
                steps.append((part, "".join(order), k + 1, len(left), len(hit), sum(f in r[1] for r in own) - len(hit), sum(r[1] == {f} for r in own), sum(r[2] for r in hit), sum(r[3] for r in hit), f))
        out.update((*s[:-1], removed_of[s[-1]]) for s in steps)
    return out


def test_filter_audit(spark, docs, empty):
    told = [(6, 1, 0), (6, 0, None), (7, None, 1), (None, 1, 1), (12, 1, 1), (999, 1, 0), (3, 1, 1)]
    labels = spark.createDataFrame([(*r, "x") for r in told], "doc_id long, quality int, toxic int, part string")
    expected = followed([(r.doc_id, r.text, r.source) for r in docs.collect()], told)
    got = filter_audit.judge(docs, labels)
    assert Counter(tuple(r) for r in got.collect()) == expected
    assert filter_audit.judge(empty, labels).count() == 0
    assert sum(r.toxic_lost + r.good_lost for r in filter_audit.judge(docs, labels.limit(0)).collect()) == 0


def test_zeta_sums_over_subsets():
    counts = np.random.default_rng(1).integers(0, 50, (3, 2, 16))
    below = filter_audit.zeta(counts, 4)
    for s in range(16):
        assert (below[:, :, s] == sum(counts[:, :, m] for m in range(16) if m & ~s == 0)).all()
    orders, found = filter_audit.steps(np.random.default_rng(2).integers(0, 50, (2, 3, 8)), 3)
    assert len(orders) == 6 and found.shape == (2, 18, 7)


VOICES = {"aa": ("la", "mañana", "est", "ciudad", "que"), "bb": ("the", "nation", "with", "ing", "over"), "cc": ("über", "schaft", "nicht", "und", "keit"), "dd": ("szcz", "wy", "nie", "dzie", "ość"), "ee": ("ja", "on", "kaupunki", "ään", "yö")}


def crc(i):
    return zlib.crc32(str(i).encode()) % 4


@pytest.mark.parametrize("n_languages", [2, 5])
def test_language_of_held_out_texts(spark, n_languages):
    langs = list(VOICES)[:n_languages]
    rows = [(i, prose(random.Random(i).choice((2, 8, 60)), i, VOICES[langs[i % n_languages]]), langs[i % n_languages] if i % 9 else None) for i in range(400 * n_languages)]
    rows += [(10_001, None, "aa"), (10_002, "", "bb"), (10_003, "12 34 %%", "aa"), (None, "la mañana", "aa"), (10_004, prose(20_000, 5, VOICES["bb"]), None), (10_005, "é", None), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = language_id.judge(docs).collect()
    assert len(got) == len(rows)
    true = {i: langs[i % n_languages] for i in range(400 * n_languages)}
    held = [r for r in got if r.held_out and r.doc_id in true]
    assert all(r.held_out == (r.doc_id is not None and crc(r.doc_id) == 2) for r in got) and len(held) > 80 * n_languages
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and by_id[i].ambiguous for i in (10_001, 10_002, 10_003))
    assert by_id[10_004].lang_pred == "bb" and by_id[10_005].lang_pred in langs and all(0 <= r.score <= 1 for r in got)


def test_language_ignores_held_out_labels_and_other_columns(spark):
    rows = [(i, prose(20, i, VOICES[list(VOICES)[i % 3]]), list(VOICES)[i % 3]) for i in range(600)]
    schema = "doc_id long, text string, lang string"
    plain = {r.doc_id: tuple(r) for r in language_id.judge(spark.createDataFrame(rows, schema).repartition(5)).collect()}
    told = [(i, t, "zz" if crc(i) == 2 else s) for i, t, s in rows]
    assert {r.doc_id: tuple(r) for r in language_id.judge(spark.createDataFrame(told, schema)).collect()} == plain


def test_language_without_much_to_learn(spark, empty):
    schema = "doc_id long, text string, lang string"
    docs = [(i, "some words", None) for i in range(4)]
    assert {r.lang_pred for r in language_id.judge(spark.createDataFrame(docs, schema)).collect()} == {"und"}
    one = [(i, prose(5, i), "aa" if crc(i) != 2 else None) for i in range(12)]
    got = language_id.judge(spark.createDataFrame(one, schema)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("aa", 1.0)}
    assert language_id.judge(empty).count() == 0


def test_codewords_are_apart():
    for k in (2, 3, 4, 5, 6, 7, 20, 100):
        code = language_id.code_words(k)
        assert len(code) == k and len({tuple(c) for c in code.tolist()}) == k
        assert (np.abs(code.astype(int).sum(0)) < k).all()
        assert k < 4 or language_id.distances(code) >= 4


def test_one_wrong_bit_is_corrected():
    code = language_id.code_words(4).astype(float)
    model = language_id.Model(list("abcd"), code, np.full(code.shape, 1 / 7), np.zeros((1, 7)), np.zeros(7), 4.0)
    for c in range(4):
        for b in range(7):
            said = code[c].copy()
            said[b] *= -1
            assert model.decode(said[None])[0][0] == c and model.decode(said[None])[3][0] == 1
