"""Rule documents, shapes with attributes and pasted rows, on small hand-made tables."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from fenwright.operators import documents as D
from fenwright.operators import rules
from fenwright.sources import tables

RULES = "owner string, kind string, value string, status string, own boolean, override boolean, cross string, dominant boolean"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_rules_become_lookups(spark):
    df = spark.createDataFrame([
        ("a", "token", "검침", None, True, False, "hard", False),
        ("a", "contiguous", "검침 요청 건", "active", True, None, "soft", True),
        ("b", "unordered_parts", "계량기 교체 + 누출", "ACTIVE ", None, True, None, None),
        ("b", "exact_normalized", "가스 1 누출!", "active", True, False, "none", False),
        ("b", "contiguous", "자동", " Retired", True, True, "hard", True),
        ("b", "unordered_parts", "하나만", "active", True, False, "none", False),
    ], RULES)
    found = D.lookups(df)
    assert rows(found) == sorted([
        ("own", "a", "token", "검침", None), ("collision", "a", "token", "검침", None), ("hard", "a", "token", "검침", None),
        ("own", "a", "phrase", "검침 요청", None), ("collision", "a", "phrase", "검침 요청", None), ("dominant", "a", "phrase", "검침 요청", None),
        ("override", "b", "combo", "계량기 교체", "누출"), ("own", "b", "sentence", "가스 누출", None),
    ])
    texts = spark.createDataFrame([(1, "누출 후 계량기 교체"), (2, "가스 누출"), (3, "검침 요청")], "id int, normal string")
    assert rows(rules.owners(texts, found.select("owner", "kind", "key", "key2").distinct())) == [(1, ["b"]), (2, ["b"]), (3, ["a"])]
    with pytest.raises(Exception, match="no owner"):
        D.lookups(df.withColumn("value", F.lit(" "))).collect()
    assert D.lookups(df.limit(0)).count() == 0


def test_error_document(spark):
    exact = spark.createDataFrame([("a", "가스누출", "active", 3), ("a", "가스누출", "active", 2), ("a", "검침", "ambiguous", 1), ("b", "충돌", "active", 1), ("b", "충돌", "ambiguous", 1)], "owner string, signature string, status string, confirmed int")
    phrases = spark.createDataFrame([("a", "가스 누출", "active", 5), ("a", "검침 건", "ambiguous", 5), ("a", "이상 건", "unknown", 5)], "owner string, phrase string, status string, support int")
    good, bad = D.error_rules(exact, phrases)
    assert rows(good, "owner", "kind", "value", "decision", "strength", F.size("origins")) == [
        ("a", "exact_normalized", "가스누출", "auto_error", "exact", 2), ("a", "exact_normalized", "검침", "review_lock", "review", 1),
        ("a", "ordered_distinct_tokens", "가스 누출", "auto_error", "phrase", 1), ("a", "ordered_distinct_tokens", "검침 건", "audit_only", "audit", 1)]
    assert rows(bad, "owner", "value", "states") == [("a", "이상 건", 1), ("b", "충돌", 2)]
    assert good.select("rule_id").distinct().count() == 4 and good.where("rule_id not rlike '^error_[0-9a-f]{20}$'").count() == 0
    again, _ = D.error_rules(exact.repartition(3, "confirmed"), phrases)
    assert D.digest(good).first() == D.digest(again).first() != D.digest(good.where("owner = kind")).first()
    assert rows(D.summary(good))[0] == ("audit_only", "ambiguous", 1, 1)


def test_truth_and_population(spark):
    order = "order_number string, owner string, signature string"
    historical = spark.createDataFrame([("1", "a", "s"), ("2", "a", "s"), ("3", "b", "t")], order)
    truth, doubled = D.truth(historical.where("order_number in ('1', '3')"), spark.createDataFrame([("9", "a", "s"), ("3", "b", "t")], order))
    assert rows(truth, "order_number", "current") == [("1", False), ("9", True)] and rows(doubled) == [("3", 2)]
    negatives = spark.createDataFrame([("7", "a", "s")], order)
    assert rows(D.population(historical, truth, negatives)) == [("a", "s", False), ("a", "s", False), ("a", "s", True), ("a", "s", True), ("b", "t", False)]


def test_baseline_is_made_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"1")
    mark = D.fingerprint(spark, [f"file://{tmp_path}/in"], ["v1"])
    made = []
    make = lambda: (made.append(1), spark.range(3))[1]
    root = f"file://{tmp_path}/kept"
    assert D.baseline(spark, root, mark, make).count() == D.baseline(spark, root, mark, make).count() == 3 and len(made) == 1
    assert D.fingerprint(spark, [f"file://{tmp_path}/in"], ["v1"]) == mark != D.fingerprint(spark, [f"file://{tmp_path}/in"], ["v2"])
    (tmp_path / "in" / "a.bin").write_bytes(b"12")
    assert D.fingerprint(spark, [f"file://{tmp_path}/in"], ["v1"]) != mark


def test_documents_are_edited_and_filtered(spark):
    origins = spark.createDataFrame([("a", "token", "x", "manual", "old"), ("a", "token", "x", "auto", "active"), ("a", "token", "y", "manual", "active"), ("a", "token", "z", None, "active")], "owner string, kind string, value string, source string, status string")
    entries = spark.createDataFrame([("a", "token", "x"), ("a", "token", "x"), ("b", "token", "w")], "owner string, kind string, value string")
    once = D.upsert_manual(origins, entries)
    assert [r for r in rows(once, "owner", "value", F.coalesce("source", F.lit("")), "status")] == [("a", "x", "auto", "active"), ("a", "x", "manual", "active"), ("a", "y", "manual", "active"), ("a", "z", "", "active"), ("b", "w", "manual", "active")]
    assert D.digest(once).first() == D.digest(D.upsert_manual(once, entries)).first()
    auto = spark.createDataFrame([("a", "t", "p", "active", "auto", 5), ("a", "t", "q", "active", "auto", 5), ("a", "t", "q", "active", "auto", 6), ("a", None, "r", "active", "auto", 1), ("a", "t", "m", "active", "manual", 1)], "owner string, pattern_type string, pattern string, status string, source string, support int")
    good, bad = D.automatic(auto)
    assert rows(good, "pattern", "support") == [("p", 5)] and bad.count() == 3
    patterns = spark.createDataFrame([("a", "단일키워드", "x"), ("a", "연속문구", "x y"), ("b", "단일키워드", "x")], "owner string, kind string, value string")
    assert rows(D.without_priority(patterns, patterns.limit(1))) == [("a", "연속문구", "x y"), ("b", "단일키워드", "x")]
    assert rows(D.precise(patterns)) == [("a", "연속문구", "x y")]
    records = spark.createDataFrame([("a", "k", "하나 둘 셋", "proposed", 10, 0, None), ("a", "k", "하나 둘", "active", 99, 0, 0), ("a", "k", "넷 둘 셋", "active", 10, 1, 0), ("a", "k", "다섯 둘 셋", None, 12, 0, 0)], "owner string, kind string, value string, status string, support int, foreign int, error_hits int")
    assert rows(D.dominant_patterns(records), "value") == [("하나 둘 셋",)]
    assert rows(D.active_patterns(records), "value") == [("넷 둘 셋",), ("하나 둘",)]
    assert rows(D.scoped_patterns(records), "value") == [("넷 둘 셋",), ("다섯 둘 셋",), ("하나 둘",)]


def test_reclassified_and_closed_reviews(spark):
    decided = spark.createDataFrame([("1", True, False), ("2", False, True), ("3", False, True)], "order_number string, is_auto boolean, is_candidate boolean")
    candidates, errors = D.reclassify(decided, decided.where("order_number = '2'"))
    assert rows(candidates, "order_number") == [("2",)] and rows(errors, "order_number") == [("1",)]
    left, approved = decided.where("is_candidate"), decided.where("order_number in ('1', '2')")
    june, july = ("2026-06-01", "2026-06-30"), ("2026-07-01", "2026-07-31")
    assert rows(D.closed_review(left, approved, june, july), "order_number") == [("3",)]
    assert D.closed_review(left, approved, june, ("2026-06-30", "2026-07-31")).count() == 0
    assert D.closed_review(left, approved.where("is_auto"), june, july).count() == 0


def dbf(fields, records):
    size = 1 + sum(n for _, n in fields)
    head = b"".join(name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([n]) + b"\0" * 15 for name, n in fields) + b"\r"
    body = b"".join(flag + b"".join(v.encode("cp949").ljust(n) for v, (_, n) in zip(values, fields)) for flag, values in records)
    return b"\x03\0\0\0" + struct.pack("<iHH", len(records), 32 + len(head), size) + b"\0" * 20 + head + body


def test_shapes_with_attributes(spark, tmp_path):
    square = lambda x: [(x, 0.0), (x + 4, 0.0), (x + 4, 4.0), (x, 4.0), (x, 0.0)]
    shp = b"\0" * 100
    for n in range(3):
        body = struct.pack("<i4d", 5, 0, 0, 4, 4) + struct.pack("<iii", 1, 5, 0) + b"".join(struct.pack("<dd", *p) for p in square(1000.0 * n))
        shp += struct.pack(">ii", n + 1, len(body) // 2) + body
    (tmp_path / "a.shp").write_bytes(shp)
    (tmp_path / "a.dbf").write_bytes(dbf([("PNU", 6), ("A5", 8), ("A6", 12), ("EMD_CD", 4), ("EMD_NM", 8)], [(b" ", ["30110", "UQS115", "도로", "11", "오류동"]), (b"*", ["x", "", "", "", ""]), (b" ", ["", "", "철도 도로", "12", "문화동"])]))
    (tmp_path / "a.cpg").write_bytes(b"EUC-KR\n")
    where = f"file://{tmp_path}"
    got = tables.shapes(spark, where)
    assert rows(got, "record", "source_key") == [(1, "30110"), (2, "shape_1"), (3, "shape_2")]
    assert rows(tables.shapes(spark, where, (0, 0, 800, 1)), "record") == [(1,), (2,)]
    assert rows(tables.transport_barriers(got), "record", "source", "code", "name") == [(1, "transport", "UQS115", "도로")]
    assert rows(tables.legal_dongs(tables.attributes(spark, where)), "code", "name", "district") == [("11", "오류동", ""), ("12", "문화동", "")]
    roads = spark.createDataFrame([("대로 1", None, None), ("기타 도로시설", None, "UQS111"), (None, None, "UQS120"), ("길", None, None)], "n string, g string, c string")
    assert [r.v for r in roads.select(tables.is_road_barrier(F.col("n"), F.col("g"), F.col("c")).alias("v")).collect()] == [True, False, True, False]
    assert [tables.encoding_of(x) for x in (None, b"", b"UTF-8", b"KSC-5601")] == ["cp949", "cp949", "UTF-8", "cp949"]


def test_pasted_whole_rows(spark):
    columns = ["서비스처리센터", "오더번호", "상태", "소분류", "내역", "오더생성일", "오더생성자", "사업부"]
    line = ["H071", "1234567.0", "완료", "검침", "내용", "2026-01-02", "CSC7101", "중부"]
    want = [("1234567.0", "검침", "H071")]
    pick = ("오더번호", "소분류", "서비스처리센터")
    assert rows(tables.pasted_rows(spark, "\t".join(columns) + "\n" + "\t".join(line), columns), *pick) == want
    assert rows(tables.pasted_rows(spark, "\t".join(columns[1:]) + "\n" + "\t".join(line[1:]) + "\n\t\t", columns), *pick) == want
    assert rows(tables.pasted_rows(spark, "\t".join(line), columns), *pick) == want
    assert rows(tables.pasted_rows(spark, "\t".join(line[1:]), columns), *pick) == want
    assert tables.pasted_rows(spark, "오더번호\t소분류\n1\tx", columns) is None and tables.pasted_rows(spark, "a\tb", columns) is None
    free = ["세대", "1234567", "완료", "대", "중", "소", "77", "자세한", "내역", "h072", "2026.01.02", "10:00", "csc7201", "홍", "부서", "북부"]
    got = tables.pasted_rows(spark, "\t".join(free), columns)
    assert rows(got, "오더번호", "서비스처리센터", "소분류", "내역", "오더생성일", "오더생성자", "사업부") == [("1234567", "H072", "소", "자세한 내역", "2026.01.02", "CSC7201", "북부")]
    with pytest.raises(ValueError, match="same name"):
        tables.pasted_rows(spark, "오더번호\t내역\t내역\n1\t2\t3", columns)
