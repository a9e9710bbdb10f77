"""Operators on small hand-made tables with known results."""

from __future__ import annotations

import itertools
import math
import random
import struct
import zipfile
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenwright.functions import address, geo, privacy
from fenwright.functions import text as X
from fenwright.operators import bi, clean, cube, graph, learn, route, rules, spatial, state, streets
from fenwright.sources import tables
from fenwright.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scopes_and_rate(spark):
    rows = spark.createDataFrame([("A", "사업부", "제외 분류", False), ("B", "품질", "x", False), ("C", "사업부", "x", True), ("D", "사업부", "x", False), ("E", "사업부", "x", None)], "order_number string, department string, subcategory string, cancelled boolean")
    analysis, dashboard = clean.scopes(rows, spark.createDataFrame([("제외분류",)], "category string"))
    assert [sorted(r.order_number for r in df.collect()) for df in (analysis, dashboard)] == [["D", "E"], ["A", "D", "E"]]
    counted = clean.counters(rows, ["제외 분류"]).first()
    assert (counted.rows, counted.dashboard, counted.analysis, counted.other_department, counted.cancelled, counted.excluded) == (5, 3, 2, 1, 1, 1)
    assert one(spark, cube.rate(F.lit(1), F.lit(3))) == 33.33 and one(spark, cube.rate(F.lit(1), F.lit(32))) == 3.12 and one(spark, cube.rate(F.lit(0), F.lit(0))) == 0.0


def test_comparison_windows():
    assert bi.shift_window(date(2026, 4, 22), date(2026, 5, 26), "previous_month") == (date(2026, 3, 22), date(2026, 4, 26))
    assert bi.shift_window(date(2026, 4, 22), date(2026, 5, 26), "previous_year") == (date(2025, 4, 22), date(2025, 5, 26))
    assert bi.shift_window(date(2024, 2, 29), date(2024, 3, 31), "previous_month") == (date(2024, 1, 29), date(2024, 2, 29))
    assert bi.window("month", 2024, 2) == (date(2024, 2, 1), date(2024, 2, 29), "day")
    with pytest.raises(ValueError):
        bi.window("range", start=date(2020, 1, 1), end=date(2024, 1, 1))


def test_patterns_and_people(spark):
    rows = [("J2", "k", False, 1), ("J3", "k", False, 2), ("J5", "k", False, 3), ("J4", "n", False, 4), ("J6", "a", True, 5)]
    details = spark.createDataFrame(rows, "id string, key string, automatic boolean, at int")
    prior = spark.createDataFrame([("k",)], "key string")
    marked = bi.new_or_repeated(details, prior, ["key"], ["at"])
    assert sorted(r.id for r in marked.where("repeated").collect()) == ["J2", "J3", "J5", "J6"]
    assert [tuple(r) for r in bi.top_patterns(marked, ["key"]).collect()] == [("k", 3)]
    people = spark.createDataFrame([("2024-01-01", "김민", "중부", "c", 5, 2), ("2024-01-01", "김민", "북부", "c", 5, 3)], "order_date string, person string, business string, subcategory string, total_count long, error_count long")
    ranked = bi.ranking(people, ["business", "person"], "count", 5).collect()
    assert [(r.business, r.error_count, r.rank) for r in ranked] == [("북부", 3, 1), ("중부", 2, 2)]


def test_masking(spark):
    cases = [("납입자번호 문의 010-7736-7599 김순임", "x", "납입자번호 문의 <전화번호> <성명>"), ("정상 검침 507", "x", "정상 검침 507"), ("고객명오등록 홍길동 → 김철수", "고객정보 추가/수정", "고객명오등록 <성명> → <성명>"), ("02-123-4567 김장 문의", "x", "<전화번호> 김장 문의"), ("성명: 홍길동", "x", "성명: <성명>"), ("a.b@c.co 900101-1234567", "x", "<이메일> <식별번호>"), (None, "x", None)]
    df = spark.createDataFrame([(d, s) for d, s, _ in cases], "detail string, category string")
    assert [r.v for r in df.select(privacy.mask(F.col("detail"), F.col("category")).alias("v")).collect()] == [e for *_, e in cases]
    addresses = spark.createDataFrame([("서울시 중구 1", "중구동 2", "010-1234-5678"), (None, "", "x")], "`주 소` string, `구주소` string, detail string").withColumnRenamed("주 소", "주소")
    masked, counters = privacy.mask_frame(addresses, "detail")
    assert [tuple(r) for r in masked.collect()] == [("***", "***", "<전화번호>"), (None, "", "x")]
    c = counters.first()
    assert (c.changed, c.phones, c.addresses) == (1, 1, 2)


def test_text_forms(spark):
    assert one(spark, X.normal(F.lit("<전화번호> 계량기 12 Ab-c"))) == "계량기 ab c"
    surnames, not_names = privacy.SURNAMES, privacy.NOT_NAMES
    assert one(spark, X.template(F.lit("계량기지침확인필요 010-1234-5678 김봉기"), surnames, not_names)) == "계량기지침확인필요"
    assert one(spark, X.template(F.lit("58,404원 24일까지 2개월 체납"), surnames, not_names)) == "금액값 날짜값 기간값 체납"
    pairs = spark.createDataFrame([("혹서기 안내 격월 후 검침", "혹서기 격월 검침"), ("혹 서기 격월검침", "혹서기 격월 검침"), ("격월 혹서기 검침", "혹서기 격월 검침"), ("가 나", ""), ("혹서기 a b c d e f g 격월", "혹서기 격월"), ("혹서기 a b c d e f g h 격월", "혹서기 격월")], "t string, p string")
    assert [r.v for r in pairs.select(X.words(F.col("t")).alias("w"), "p").select(X.holds_phrase(F.col("w"), F.col("p")).alias("v")).collect()] == [True, False, False, False, True, False]
    same = spark.createDataFrame([("abcd", "abcd"), ("abcd", "wxyz"), ("", "a"), (None, "a")], "a string, b string")
    assert [round(r.v, 6) for r in same.select(X.likeness("a", "b").alias("v")).collect()] == [1.0, 0.0, 0.0, 0.0]
    names = F.array(F.lit("홍길동"))
    assert one(spark, X.remove_names(F.array(*map(F.lit, ("홍길동님", "요청", "홍길동"))), names)) == ["요청"]


def test_decisions(spark):
    flags = ("shape", "exact", "phrase", "exact_review", "phrase_review", "dominant", "context", "override", "own", "hard_other")
    rows = [("shape_normal", "normal", dict(exact=True)), ("auto", None, dict(phrase=True, own=True)), ("locked", None, dict(own=True, context=True)), ("normal", None, dict(own=True)), ("override", None, dict(own=True, hard_other=True, override=True)), ("hard", None, dict(own=True, hard_other=True)), ("nothing", None, {})]
    df = spark.createDataFrame([(n, s, *(bool(f.get(c)) for c in flags[1:])) for n, s, f in rows], "id string, shape string, " + ", ".join(f"{c} boolean" for c in flags[1:]))
    got = {r.id: (r.is_auto, r.is_normal, r.is_candidate, r.locked) for r in rules.decide(df).collect()}
    assert got == {"shape_normal": (True, True, False, False), "auto": (True, False, False, False), "locked": (False, False, True, True), "normal": (False, True, False, False), "override": (False, True, False, False), "hard": (False, False, True, False), "nothing": (False, False, True, False)}


def test_promotion_by_likeness(spark):
    c = spark.createDataFrame([("similar", "o", "계량기교체요청오류", 3, False), ("normal", "o", "정상업무처리문구", 3, False), ("locked", "o", "계량기교체요청오류", 3, True), ("other", "p", "계량기교체요청오류", 3, False)], "id string, owner string, sig string, informative int, locked boolean")
    errors = spark.createDataFrame([("o", "계량기교체요청오류건")], "owner string, sig string")
    normals = spark.createDataFrame([("o", "정상업무처리문구")], "owner string, sig string")
    assert [r.id for r in rules.promote(c, errors, normals).collect()] == ["similar"]
    # Unlike every normal text is as far as can be; without any normal text of the owner there is nothing to be far from.
    assert [r.id for r in rules.promote(c, errors, normals.select("owner", F.lit("xyz").alias("sig"))).collect()] == ["similar"]
    assert rules.promote(c, errors, normals.where("owner = 'p'")).count() == 0 and rules.promote(c, errors.limit(0), normals).count() == 0
    twice = c.unionByName(c)
    assert [r.id for r in rules.promote(twice, errors, normals).collect()] == ["similar"] * 2


def test_matching_blocks_are_those_of_difflib():
    from difflib import SequenceMatcher

    r = random.Random(7)
    for _ in range(300):
        a, b = ("".join(r.choice("abc가"[: r.randint(1, 4)]) for _ in range(r.randint(0, 25))) for _ in range(2))
        expected = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert X.matched(X.letters(a), X.letters(b)) == expected, (a, b)


def test_nearest_references_are_exact(spark, monkeypatch):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdef") for _ in range(n))
    refs = [(o, text(r.randint(1, 30))) for o in "xy" for _ in range(40)] + [("x", "zz"), ("x", "")]
    cands = [(i, "xyz"[i % 3], text(r.randint(0, 60))) for i in range(60)] + [(60, "x", "qqqq"), (61, "x", None), (62, "x", text(4000))]
    expected = {}
    for _, o, s in cands:
        if s is not None and o != "z":
            expected[o, s] = max(X._likeness(s, q) for p, q in refs if p == o)
    for bound in (rules.REFERENCE_LETTERS, 200):
        monkeypatch.setattr(rules, "REFERENCE_LETTERS", bound)
        got = {(g.owner, g.sig): g.score for g in rules.closest(spark.createDataFrame(cands, "id int, owner string, sig string"), spark.createDataFrame(refs, "owner string, sig string"), 100).collect()}
        assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_ordered_match_against_plain_search(spark):
    def finds(words, anchors):
        at = 0
        for nth, anchor in enumerate(anchors):
            for start in range(at, len(words) if nth == 0 else min(len(words), at + X.GAP_TOKENS + 1)):
                end = next((start + n for n in range(X.SPLIT_TOKENS) if start + n < len(words) and anchor in "".join(words[start : start + n + 1])), None)
                if end is not None:
                    at = end + 1
                    break
            else:
                return False
        return bool(anchors) and bool(words)

    r = random.Random(11)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 3)))
    rows = [(" ".join(word() for _ in range(r.randint(0, 25))), " ".join(word() + r.choice(["", "a", "b"]) for _ in range(r.randint(0, 4)))) for _ in range(600)]
    df = spark.createDataFrame(rows, "t string, p string").select("t", "p", X.words(F.col("t")).alias("w")).select("t", "p", X.holds_phrase(F.col("w"), F.col("p")).alias("v"))
    assert all(row.v == finds([w for w in row.t.split(" ") if w], [w for w in row.p.split(" ") if w]) for row in df.collect())


def test_overlapping_periods(spark):
    r = random.Random(2)
    period = lambda: (lambda s, n: (s, s + n))(r.randint(-500, 500), r.choice((0, 1, 3, 30, 400)))
    left, right = [period() for _ in range(200)] + [(5, 4), (None, 3), (9000, None)], [period() for _ in range(6)] + [(700, 600)]
    df = lambda rows: spark.createDataFrame(rows, "start int, end int")
    got = {tuple(x) for x in learn.overlapping(df(left), df(right)).collect()}
    assert got == {(s, e) for s, e in left if s is None or e is None or any(s <= b and a <= e for a, b in right if a <= b and s <= e)}
    assert learn.overlapping(df(left), df([(None, 1)])).count() == len(set(left)) and learn.overlapping(df(left), df([]).limit(0)).count() == 0
    dates = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 31)), (date(2024, 2, 1), date(2024, 2, 29))], "start date, end date")
    assert [x.start for x in learn.overlapping(dates, dates.where("start = date'2024-02-01'")).collect()] == [date(2024, 2, 1)]


def test_learning(spark):
    texts = ["혹서기 안내로 격월 후 검침", "혹서기 동안 격월 방문 검침", "혹서기 중 격월 제외 검침"]
    rows = spark.createDataFrame([("검침", t, t, 1) for t in texts], "owner string, signature string, normal string, weight long")
    found = learn.eligible(learn.core_phrases(rows), learn.CORE_SUPPORT, learn.CORE_SIGNATURES)
    assert ("혹서기 격월 검침", 3, 3) in {(r.phrase, r.support, r.signatures) for r in found.collect()}
    single = learn.eligible(learn.core_phrases(rows.limit(1).withColumn("weight", F.lit(3))), learn.CORE_SUPPORT, learn.CORE_SIGNATURES)
    assert single.count() == 0  # one sentence three times is not diverse
    e = spark.createDataFrame([("a", "x y", 2, 8, 3, 2, 1, 0), ("a", "x z", 2, 7, 3, 2, 1, 0), ("a", "x y z", 3, 5, 2, 2, 1, 0), ("a", "p q r", 3, 4, 2, 2, 1, 0), ("a", "f g", 2, 9, 3, 2, 1, 1), ("a", "r r", 2, 30, 3, 2, 9, 0)], "owner string, pattern string, size int, support long, dates long, people long, coverage long, foreign long")
    good = learn.promotable(e)
    assert sorted(r.pattern for r in good.collect()) == ["r r", "x y", "x y z"]
    assert sorted(r.pattern for r in learn.outermost(good).collect()) == ["r r", "x y z"]
    snapshots = spark.createDataFrame([(i, i + 1, "old") for i in range(0, 90, 2)], "start int, end int, name string")
    fresh = spark.createDataFrame([(87, 88, "new")], "start int, end int, name string")
    kept = learn.keep_snapshots(snapshots, fresh).collect()
    assert len(kept) == 36 and not {86, 88} & {r.start for r in kept} and any(r.name == "new" for r in kept)
    origins = spark.createDataFrame([("o", "p", "manual", True, False, False), ("o", "p", "auto", False, True, True)], "owner string, pattern string, source string, own boolean, override boolean, hard boolean")
    b = learn.behaviour(origins).first()
    assert (b.own, b.override, b.collision) == (True, True, "hard") and learn.invalid(origins).count() == 0
    assert learn.merge_origins(origins, origins.where("source = 'auto'").withColumn("pattern", F.lit("q"))).where("source = 'auto'").first().pattern == "q"


def test_addresses_and_numbers(spark):
    split = lambda t: tuple(one(spark, clean.split_address(F.lit(t))))
    assert split("대전 중구 계룡로 1 (오류동 12-3)") == ("대전 중구 계룡로 1", "오류동 12-3", "오류동")
    assert split("대전 중구 오류동 12") == ("대전 중구 오류동 12", "대전 중구 오류동 12", "오류동")
    assert split(" ") == (None, None, None)
    assert one(spark, clean.order_number(F.lit(" 28812757.0 "))) == "28812757" and one(spark, clean.order_number_historical(F.lit("1,234.00"))) == "1234"
    assert one(spark, clean.squeeze(F.lit("　a \t b　"))) == "a b"
    assert one(spark, clean.row_id(F.lit("a"))) == 1_000_000_000 + (0xE8B7BE43 & 0x3FFFFFFF)
    df, bad = clean.parse_dates(spark.createDataFrame([("2024-01-02",), ("x",), (" ",), (None,), ("2024.03.04",)], "d string"), ["d"])
    assert [str(r.d) for r in df.collect()] == ["2024-01-02", "None", "None", "None", "2024-03-04"] and bad.first().d == 1
    grid = spark.createDataFrame([(0, "2026-01-01T00:00:00", 28812757.0), (1, "2026-01-02T00:00:00", 5.0), (2, "2026-01-03T00:00:00", 28812758.0)], "id int, d string, n double").withColumn("n", F.col("n").cast("decimal(12,1)"))
    assert [r.id for r in clean.column_filters(grid, {"d": ["2026-01-01", "2026-01-03"]}).orderBy("id").collect()] == [0, 2]
    assert [r.value for r in clean.distinct_values(grid, "n", "288").collect()] == ["28812757", "28812758"]


def test_geometry(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    segs = geo.segments(square)
    v = lambda c: one(spark, c)
    assert v(geo.signed_area(segs)) == 16 and tuple(v(geo.centroid(segs))) == (2.0, 2.0)
    p = lambda x, y: (F.lit(float(x)), F.lit(float(y)), segs)
    assert [v(geo.inside(*p(*q))) for q in ((1, 1), (4, 2), (5, 1), (0, 0))] == [True, True, False, True]
    assert v(geo.to_polygon(*p(7, 8))) == 5.0
    beside = geo.segments(F.transform(square, lambda c: F.struct((c.x + 5).alias("x"), (c.y + 1).alias("y"))))
    assert v(geo.between_polygons(segs, beside)) == 1.0 and v(geo.shared_border(segs, beside)) == pytest.approx(3.0)
    at = v(geo.to_plane(F.lit(38.0), F.lit(127.0)))
    assert (at.x, at.y) == pytest.approx((200_000.0, 600_000.0), abs=1e-6)
    east = v(geo.to_plane(F.lit(37.5), F.lit(127.5)))
    assert (east.x, east.y) == pytest.approx((244_200.0, 544_590.0), abs=60)
    assert v(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111_194.9, abs=0.1)


def test_spatial_joins(spark):
    ring = lambda x, y, s: F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))])
    shapes = [(1, 0, 0, 100), (2, 20, 20, 50), (3, 101, 0, 40), (4, 400, 400, 10)]
    polygons = None
    for n, x, y, s in shapes:
        p = spark.range(1).select(F.lit(n).alias("polygon"), geo.segments(ring(x, y, s)).alias("segs"), *(F.lit(float(v)).alias(k) for k, v in (("x1", x), ("y1", y), ("x2", x + s), ("y2", y + s), ("area", s * s), ("cx", x + s / 2), ("cy", y + s / 2))))
        polygons = p if polygons is None else polygons.unionByName(p)
    points = spark.createDataFrame([(1, 30.0, 30.0), (2, 5.0, 5.0), (3, 150.0, 20.0), (4, 300.0, 300.0)], "id int, x double, y double")
    assert sorted(tuple(r) for r in spatial.locate(points, polygons).collect()) == [(1, 2, 0.0), (2, 1, 0.0), (3, 3, 9.0)]
    edges = {(r.a, r.b): (r.relation, r.border) for r in spatial.neighbours(polygons).collect()}
    assert edges[1, 3] == ("touches", 1.0) and edges[1, 2] == ("near", 20.0) and not any(4 in k for k in edges)
    lines = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 50.0, 10.0, 50.0)], "edge int, ax double, ay double, bx double, by double")
    wall = spark.createDataFrame([(0.0, 10.0, 10.0, 0.0)], "ax double, ay double, bx double, by double")
    assert [r.edge for r in spatial.crossing(lines, wall).collect()] == [1]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, n) for n in range(501, 560)] + [(7, 7), (None, 3)]
    parent = list(range(1000))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    nodes = {n for e in edges for n in e if None not in e and e[0] != e[1]}
    got = graph.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b")
    assert sorted((r.node, r.component) for r in got.collect()) == sorted((n, find(n)) for n in nodes)
    assert graph.connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_routes(spark):
    rng = random.Random(2)
    rows = [("s", i, rng.uniform(0, 2000), rng.uniform(0, 2000), rng.randrange(1, 9)) for i in range(60)] + [("t", 100, 0.0, 0.0, 5)]
    points = spark.createDataFrame(rows, "scope string, id long, x double, y double, orders long")
    ordered = route.greedy(points)
    found = route.split_even(ordered, 5).collect()
    assert sorted((r.scope, r.pos) for r in found) == sorted([("s", n + 1) for n in range(60)] + [("t", 1)])
    people = [r.person for r in sorted(found, key=lambda r: r.pos) if r.scope == "s"]
    assert people == sorted(people) and set(people) == {1, 2, 3, 4, 5}
    total = sum(r[4] for r in rows[:60])
    loads = [sum(r.orders for r in found if r.scope == "s" and r.person == p) for p in range(1, 6)]
    assert all(abs(x - total / 5) <= 0.25 * total / 5 for x in loads)
    assert {r.people for r in route.allocate(spark.createDataFrame([("s", 1, 10, 9), ("s", 2, 30, 9)], "scope string, cluster int, orders long, units long"), 4).collect()} == {1, 3}
    jumps = spark.createDataFrame([("s", 1, 0.0, 0.0, 1), ("s", 2, 100.0, 0.0, 1), ("s", 3, 700.0, 0.0, 1), ("s", 4, 710.0, 0.0, 90)], "scope string, pos long, x double, y double, orders long")
    assert [r.group for r in route.measured(jumps).orderBy("pos").collect()] == [0, 0, 1, 1]
    assert {(r.group, r.island) for r in route.islands(jumps, 2).collect()} == {(0, True), (1, False)}


def all_cuts(n, people):
    return [(*c, n) for c in itertools.combinations(range(1, n), people - 1)]


def part_costs(sums, jumps, ends, price):
    out, begin = 0.0, 0
    for end in ends:
        out += price(sums[end] - sums[begin], jumps[begin + 1 : end], jumps[end] if end < len(jumps) else 0.0)
        begin = end
    return out


def test_partitions_against_all_cuts():
    rng = random.Random(8)
    lone = lambda d: 0.0 if d <= 400 else (d - 400) * 7.0 if d <= 800 else 9000 + (d - 800) * 14.0 if d <= 1000 else 28000 + (d - 1000) * 60.0
    for trial in range(80):
        n, people = rng.randint(1, 9), rng.randint(1, 4)
        sums = np.cumsum([0.0, *(rng.randint(1, 9 if trial % 2 else 2) for _ in range(n))])
        jumps = np.array([0.0, *(rng.uniform(0, 650) if trial % 3 else rng.uniform(0, 1500) for _ in range(n - 1))])
        target = sums[-1] / people
        low, high = math.floor(target * 0.9), math.ceil(target * 1.1)
        # Most even parts.
        price = lambda load, inside, after: (load - target) ** 2  # noqa: B023, E731
        best = min(part_costs(sums, jumps, c, price) for c in all_cuts(n, min(people, n)))
        assert part_costs(sums, jumps, route.even_cuts(sums, people), price) == pytest.approx(best)
        # Without long jumps: as far as it goes.
        out = lambda load: max(0, low - load) + max(0, load - high)  # noqa: B023, E731
        price = lambda load, inside, after: math.inf if len(inside) and max(inside) > 500 else 55 * (load - target) ** 2 + 1e6 * out(load) ** 2 + 1e8 * out(load) + 20 * max(inside, default=0)  # noqa: B023, E731
        got = route.zone_cuts(sums, jumps, people, target)
        cut = {(m, k): min(part_costs(sums[: m + 1], jumps[:m], c, price) for c in all_cuts(m, k)) for m in range(1, n + 1) for k in range(1, min(people, m) + 1)}
        finite = {x: c for x, c in cut.items() if c < math.inf}
        far = n if (n, min(people, n)) in finite else max(m for m, _ in finite)
        cost, k = (finite[n, min(people, n)], min(people, n)) if (n, min(people, n)) in finite else min((c, k) for (m, k), c in finite.items() if m == far)
        assert got[-1] == far and len(got) == k and part_costs(sums[: far + 1], jumps[:far], got, price) == pytest.approx(cost)
        # Within hard bounds, or one after another.
        price = lambda load, inside, after: math.inf if not low <= load <= high else 120 * abs(load - target) + 1e5 * sum(map(lone, inside)) - 0.18 * min(lone(after), 12000)  # noqa: B023, E731
        got = route.bounded_cuts(sums, jumps, people)
        best = min((part_costs(sums, jumps, c, price) for c in all_cuts(n, people)), default=math.inf)
        assert got[-1] == n and len(got) == people and got == sorted(got)
        if best < math.inf:
            assert part_costs(sums, jumps, got, price) == pytest.approx(best)


def test_parts_chosen_one_after_another():
    sums, jumps = np.cumsum([0.0, 5, 5, 30, 5, 5, 5]), np.zeros(6)
    assert route.bounded_cuts(sums, jumps, 3) == [2, 3, 6]  # 55 / 3 each cannot be; 10 and 30 are nearest in turn


def test_split_leaves_what_is_behind_long_jumps(spark):
    rows = [("s", i, i, 100.0 * i + (2000.0 if i > 3 else 0.0) + (2000.0 if i > 5 else 0.0), 0.0, 2) for i in range(8)]
    got = route.split(spark.createDataFrame(rows, "scope string, pos long, id long, x double, y double, orders long"), 2).orderBy("pos").collect()
    assert [r.person for r in got] == [1, 1, 1, 1, 2, 2, None, None]


def test_residual_components(spark):
    rows = [("s", 1, i, 100.0 * i, 0.0, 20) for i in range(4)] + [("s", 2, 10, 300.0, 200.0, 9), ("s", 3, 11, 0.0, 900.0, 10), ("s", 3, 12, 10.0, 900.0, 10), ("s", 4, 13, 0.0, 9000.0, 20), ("s", 4, 14, 0.0, 9001.0, 20), ("s", 5, 15, 0.0, 400.0, 10), ("s", 5, 16, 0.0, 401.0, 10), ("s", 6, 17, 0.0, 9500.0, 50)]
    got = {r.component: (r.nearest, r.reason) for r in route.residual_components(spark.createDataFrame(rows, "scope string, component long, id long, x double, y double, orders long")).collect()}
    assert got == {1: (None, None), 2: (200.0, "small_isolated_block"), 3: (900.0, "small_far_island_component"), 4: (None, "medium_far_component"), 5: (400.0, None), 6: (None, None)}


def test_statuses(spark):
    patterns = spark.createDataFrame([("a", "x y", 0, False), ("a", "y z", 0, True), ("a", "p q", 3, False), ("b", "x y", 0, False), ("b", "s t", 0, False)], "owner string, pattern string, foreign long, selected boolean")
    errors = spark.createDataFrame([("b", "w s t u"), ("b", "w s t u"), ("a", "xx y")], "owner string, normal string")
    active = spark.createDataFrame([("a", "x y"), ("a", "p q"), ("b", "s t"), ("c", "old one")], "owner string, pattern string")
    got = {(r.owner, r.pattern): r.status for r in learn.statuses(learn.error_hits(patterns, errors), active).collect()}
    assert got == {("a", "x y"): "active", ("a", "y z"): "active", ("a", "p q"): "proposed", ("b", "x y"): "proposed", ("b", "s t"): "blocked_error", ("c", "old one"): "active"}


def test_state(spark):
    day = date(2024, 1, 1)
    dims = [(day, "p", "b", "c")]
    details = spark.createDataFrame([(1, 1, "A", *dims[0]), (2, 2, "B", *dims[0])], "detail_id long, batch_id long, order_number string, order_date date, person string, business string, subcategory string")
    batches = spark.createDataFrame([(1, "auto", "j", 1, False), (2, "manual", "j", 2, False)], "batch_id long, batch_type string, job_id string, approved_at long, rolled_back boolean")
    none = spark.createDataFrame([], "order_number string, at long, restored boolean")
    totals = spark.createDataFrame([(*dims[0], 3)], "order_date date, person string, business string, subcategory string, total_count long")
    errors = lambda d, b, x: state.with_errors(totals, state.active(d, b, x)).first().error_count
    assert errors(details, batches, none) == 2
    out = spark.createDataFrame([("A", 1, False)], "order_number string, at long, restored boolean")
    assert errors(details, batches, out) == 1
    fresh = spark.createDataFrame([(11, 1, "A", *dims[0]), (12, 1, "B", *dims[0])], details.schema)
    again, counts = state.replace_automatic(details, batches, fresh, out)
    assert errors(again, batches, out) == 1 and tuple(counts.first()) == (1, 1)
    assert errors(details, batches, out.unionByName(spark.createDataFrame([("A", 2, True)], out.schema))) == 2
    assert errors(details, state.roll_back_latest(batches), none) == 1
    new, refused = state.approve(details, batches, out, spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("D",)], "order_number string"))
    assert sorted(r.order_number for r in new.collect()) == ["A", "C"] and sorted(r.order_number for r in refused.collect()) == ["B", "D", "D"]
    classified = spark.createDataFrame([("A", True, 1), ("A", True, 2), ("B", True, 3), ("C", False, 4)], "order_number string, is_auto boolean, position int")
    candidates, confirmed = state.views(classified, state.active(details, batches, out), out)
    assert sorted(r.order_number for r in candidates.collect()) == ["A", "C"] and [r.order_number for r in confirmed.collect()] == ["B"]


def test_stream_keeps_the_cube(spark, tmp_path):
    schema = "row_id long, order_date date, person string, business string, subcategory string, is_error boolean"
    source, rows, out, log = (str(tmp_path / n) for n in ("in", "rows", "cube", "log"))
    for n, batch in enumerate(([(1, date(2024, 1, 1), "p", "b", "c", True), (2, date(2024, 1, 2), "p", "b", "c", False)], [(3, date(2024, 1, 1), "p", "b", "c", False), (1, date(2024, 1, 1), "p", "b", "c", True), (4, None, "p", "b", "c", True)])):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        events.keep_cube(events.read(spark, source, schema), rows, out, log).awaitTermination()
    got = sorted((str(r.order_date), r.total_count, r.error_count) for r in spark.read.parquet(out).collect())
    assert got == [("2024-01-01", 2, 1), ("2024-01-02", 1, 0)]


def workbook(path, sheets):
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {x} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = lambda n, row: "".join(f'<c r="{chr(65 + j)}{n}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row) if v is not None)
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {x}><sheetData>" + "".join(f'<row r="{n}">{cells(n, row)}</row>' for n, row in enumerate(rows, 1) if row) + "</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "H071_2024.01_안전점검.xlsx", {"notes": [["a"]], "orders": [["title"], ["오더번호 ", "상태", None, "내역"], ["1.0", " ", None, "x "], [None, " "], ["2", "ok", "z"]]})
    rows = tables.with_header(tables.workbook_cells(spark, f"file://{tmp_path}"), ["오더번호", "상태"], ["오더번호", "상태", "내역", "없음"])
    assert sorted((r["오더번호"], r["상태"], r["내역"], r["없음"]) for r in rows.collect()) == [("1.0", None, "x", None), ("2", "ok", None, None)]
    spark.dataSource.register(tables.WorkbookSource)
    path = str(tmp_path / "H071_2024.01_안전점검.xlsx")
    assert spark.read.format("workbook").option("paths", path).load().count() == 6
    with open(path, "rb") as f:
        assert tables.header_row(tables.sheet_rows(f.read()), ["오더번호", "상태"]) == ("orders", 1)
    files = spark.createDataFrame([(path,), ("/x/other.xlsx",)], "path string")
    assert [(r.center, r.month) for r in tables.matching_workbooks(files).collect()] == [("H071", "2024.01")]


def test_shapes(spark, tmp_path):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    body = struct.pack("<i4d", 5, 0, 0, 4, 4) + struct.pack("<iii", 1, 5, 0) + b"".join(struct.pack("<dd", *p) for p in square)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    got = tables.polygons(spark, f"file://{tmp_path}").collect()
    assert [(r.record, len(r.rings[0]), r.x2) for r in got] == [(1, 5, 4.0)]
    assert tables.polygons(spark, f"file://{tmp_path}", box=(10, 10, 20, 20)).count() == 0


def test_versions_and_pasted(spark, tmp_path):
    store = tables.Versions(spark, f"file://{tmp_path}/v")
    assert store.current() is None
    first = store.write({"t": spark.range(3)})
    assert store.current() == first and store.read("t").count() == 3
    second = store.write({"t": spark.range(5)}, expected=first)
    assert store.read("t").count() == 5
    with pytest.raises(RuntimeError):
        store.write({"t": spark.range(1)}, expected=first)
    assert store.current() == second
    # A writer that died after creating its pointer: the last complete version stays current; a fresh one is waited for, an old one not.
    (tmp_path / "v" / "_current" / "000000000003").write_text("")
    assert store.current() == second
    with pytest.raises(RuntimeError):
        store.write({"t": spark.range(1)}, expected=second)
    store.STALE = -1
    third = store.write({"t": spark.range(7)}, expected=second)
    assert store.current() == third and store.read("t").count() == 7
    known = spark.createDataFrame([("12",)], "order_number string")
    got = tables.pasted(spark, "title\nx\t오더 번호\ny\t12.0\nz\t12\n\n\"a\nb\"\t34", known)
    assert sorted(tuple(r) for r in got.collect()) == [("12", 2, True), ("34", 1, False)]
    got = tables.pasted(spark, "a\t9\t12.0\nb\t34\n12\t12", known)  # without a header: known orders only, one a row
    assert [tuple(r) for r in got.collect()] == [("12", 2, True)]
    with pytest.raises(Exception, match="at most 500"):
        tables.pasted(spark, "오더번호\n" + "\n".join(map(str, range(501))), known).collect()


def test_address_parts(spark):
    v = lambda c: one(spark, c)
    text = F.lit("대전 중구 계룡로 12-3 (오류동 45-6 아파트)")
    assert v(address.base(text)) == "대전 중구 계룡로 12-3" and v(address.street_stem(text)) == "대전 중구 계룡로"
    assert tuple(v(address.lot(text))) == ("오류동", 45, 6) and v(address.locality(text)) == "대전 중구"
    assert v(address.queries(text)) == ["대전 중구 오류동 45-6", "대전 중구 계룡로 12-3 (오류동 45-6 아파트)", "대전 중구 계룡로 12-3"]
    assert v(address.lot_hint(F.lit("대전 중구"))) == "" and tuple(v(address.lot(F.lit("x")))) == ("", None, None)
    assert v(address.parcel_lot(F.lit("3014010100200120003"))) == "산12-3" and v(address.parcel_lot(F.lit("1"))) is None
    assert v(address._digest(F.lit("대전 1"))) == int.from_bytes("대전 1".encode(), "little") % 10**8
    known = spark.createDataFrame([("가로 1 (a)", "d", 36.0, 127.0), ("나로 2", "d", 36.2, 127.2)], "address string, dong string, lat double, lon double")
    got = {r.address: r for r in address.resolve(spark.createDataFrame([("가로 1 (a)", "d"), ("가로 1 (b)", "d"), ("다로 3", "d"), ("다로 3", "e")], "address string, dong string"), known).where("dong = 'd'").collect()}
    assert {a: r.coord_source for a, r in got.items()} == {"가로 1 (a)": "exact", "가로 1 (b)": "base_match", "다로 3": "district_estimate"}
    assert abs(got["다로 3"].lat - 36.1) <= 0.003 and (got["가로 1 (b)"].lat, got["가로 1 (b)"].lon) == (36.0, 127.0)


def test_street_blocks(spark):
    rows = [("s", i, "d", "r", i, None, 36.0 + i * 0.0001, 127.0) for i in range(100)] + [("s", 500, "d", "q", None, None, 36.5, 127.0)]
    df = spark.createDataFrame(rows, "scope string, id long, dong string, road_stem string, lot_main int, lot_sub int, lat double, lon double")
    # 11 m apart, so the first reaches 4 lots on (the fifth is 55.6 m away); the next run begins there.
    links = {(r.a, r.b) for r in streets.chains(df).collect()}
    assert {(0, 1), (0, 4)} <= links and (0, 5) not in links and (5, 6) in links
    found = {r.id: (r.component, r.piece) for r in streets.blocks(df).collect()}
    assert found[0] == found[4] == (0, 0) and found[5] == (5, 0) and found[500] == (500, 0)
    big = spark.createDataFrame([("s", i, "d", "r", 1, None, 36.0, 127.0) for i in range(170)], df.schema)
    sizes = streets.blocks(big).groupBy("component", "piece").count().collect()
    assert sorted(r["count"] for r in sizes) == [10, 80, 80]
    near = streets.neighbours(spark.createDataFrame([(1, 36.0, 127.0), (2, 36.001, 127.001), (3, 36.01, 127.0)], "block int, lat double, lon double"))
    assert sorted((r.block, r.neighbour) for r in near.collect()) == [(1, 2), (2, 1)]
    pair = spark.createDataFrame([(("d", "r", 1, 2), ("e", "q", 5, None))], "a struct<dong:string,road_stem:string,lot_main:int,lot_sub:int>, b struct<dong:string,road_stem:string,lot_main:int,lot_sub:int>")
    assert pair.select(streets.affinity("a", "b", F.lit(100.0)).alias("v")).first().v == 100 + 90 + 50 + 45 + 16
    parts = route.units(spark.createDataFrame([("s", 1, i, 4) for i in range(10)] + [("s", 2, 1, 3)], "scope string, block int, pos int, orders int"), 10, 8, 13)
    assert sorted((r.block, r.pos, r.unit) for r in parts.collect())[-2:] == [(1, 9, 4), (2, 1, 0)]


def test_context_locks(spark):
    contexts = spark.createDataFrame([("a", "요금 이체"), ("b", "요금 이체 변경"), ("b", "이체"), ("c", "변경")], "owner string, key string")
    texts = spark.createDataFrame([(1, "a", "고객 요금 이체 변경"), (2, "b", "요금 이체 변경"), (3, "a", "변경 요청"), (4, "c", "변경")], "id int, own string, normal string")
    assert sorted(tuple(r) for r in rules.leading_lock(texts, contexts).collect()) == [(1, "b"), (3, "c")]
    assert one(spark, rules.bracket_segments(F.lit("a [b c] (d) 【】 ( )"))) == ["b c", "d"]
    origins = [("a", "계량기교체", "scoped_normal", 20, 4, 0, 0, 0), ("a", "짧은", "scoped_normal", 50, 9, 0, 0, 0), ("a", "두 단어", "scoped_normal", 10, 3, 0, 0, 0), ("a", "틀린 것", "scoped_normal", 10, 3, 1, 0, 0), ("a", "세 단어 문구", "auto_normal", 0, 0, 0, 10, 0), ("a", "남의 세 단어", "auto_normal", 0, 0, 0, 10, 2), ("a", "함께 쓴", "scoped_normal", 30, 9, 0, 0, 0), ("b", "함께 쓴", "scoped_normal", 30, 9, 0, 0, 0), ("a", "손 으로", "manual", 99, 9, 0, 99, 0)]
    df = spark.createDataFrame(origins, "owner string, value string, role string, support int, months int, error_hits int, normal_support int, other_frequency int")
    assert sorted(r.value for r in rules.strict_contexts(df).collect()) == ["계량기교체", "두 단어", "세 단어 문구"]


def test_parcel_neighbours_are_of_all_parcels(spark, monkeypatch):
    from fenwright.plans import spatial_queries

    # Points in every cell of a square of nine by nine, two in one of them.
    n = range(-4, 5)
    rows = [(f"{i},{j}", (i + 0.5) * spatial_queries.SIDE, (j + 0.25) * spatial_queries.SIDE) for i in n for j in n] + [("again", 1.0, 1.0)]
    monkeypatch.setattr(spatial_queries.D, "points", lambda spark, sf_dir: spark.createDataFrame(rows, "id string, x double, y double"))
    number = lambda i, j: (i + 5000) * 10000 + j + 5000
    held = {(i, j) for i in n for j in n if (i + 2 * j) % 3}
    expected = {(*sorted((number(i, j), number(i + di, j + dj))), "touches") for i, j in held for di in (-1, 0, 1) for dj in (-1, 0, 1) if (di or dj) and (i + di, j + dj) in held}
    got = [tuple(r) for r in spatial_queries.parcel_neighbours(spark, "no folder").select("a", "b", "relation").collect()]
    assert len(held) == 54 and len(got) == len(expected) and set(got) == expected


def test_matching_blocks_of_long_texts_and_given_up():
    from difflib import SequenceMatcher

    r = random.Random(11)
    for letters, n in (("ab", 300), ("abcdefghijklmnopqrstuvwxyz", 2000), ("가나다라abc" * 9, 900)):
        for m in (1, 40, 300):
            a, b = ("".join(r.choice(letters) for _ in range(k)) for k in (n, m))
            b += a[n // 2 : n // 2 + 40]
            for x, y in ((a, b), (b, a)):
                expected = sum(k.size for k in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
                assert X.in_blocks(x, y) == expected and X.in_blocks(x, y, expected - 1) == expected
                assert X.in_blocks(x, y, expected) <= expected and X.in_blocks(x, y, len(y)) <= expected
    assert X.in_blocks("", "a") == X.in_blocks("a", "") == 0


def test_nearest_shuffles_no_pairs(spark):
    cands = spark.createDataFrame([("o", "계량기교체요청오류"), ("o", "a"), ("o", ""), ("p", "a")], "owner string, sig string")
    refs = spark.createDataFrame([("o", s) for s in ("계량기교체", "ab", "a", "")], "owner string, sig string")
    found = rules.nearest(cands, refs, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1  # once had a window over each text, repeated for every reference
    alike = rules.nearest(cands.withColumn("owner", F.lit("o")), refs, 3)
    assert alike._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [(n.sig, n.ref, n.nth) for n in found.where("sig in ('a', '')").orderBy("sig", "nth").collect()] == [("", "계량기교체", 1), ("", "ab", 2), ("", "a", 3), ("a", "a", 1), ("a", "계량기교체", 2), ("a", "ab", 3)]
    assert found.where("owner = 'p'").count() == 0
