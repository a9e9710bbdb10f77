"""The truth workbook: each thing that can be wrong with it."""

from __future__ import annotations

from datetime import date

import pytest

from fenwright.sources import tables, truth
from tests.test_operators import workbook

HEAD = ["오더번호", "오더생성일", "상태", "생성인", "생성부서", "사업부", "소분류"]


def order(number, day="2025-03-04", status="완료", person="김민", department="사업부", business="중부", subcategory="검침"):
    return [number, day, status, person, department, business, subcategory]


def read(spark, tmp_path, sheets, months=(3,), **options):
    workbook(tmp_path / "truth.xlsx", sheets)
    return truth.read(tables.workbook_cells(spark, f"file://{tmp_path}"), months, **options)


def problems(found):
    return sorted((r.kind, r.month, r.row, r.order_number, r.detail) for r in found.problems.collect())


def test_records_and_counts(spark, tmp_path):
    rows = [["제목"], [], HEAD, order("1.0"), order("1,002", day="45720"), order("3", department="품질"), order("4", business="본사"), order("5", subcategory="제 외"), order("6", status="오더취소"), order("7", day="2025.03.31 10:11", person=" 박 ")]
    found = read(spark, tmp_path, {"3월": rows, "other": [HEAD, order("1")], " 4월": [HEAD, order("9", day="20250401")]}, months=(3, 4), excluded=["제외"])
    assert problems(found) == []
    assert sorted((r.order_number, r.order_date, r.person, r.month, r.row) for r in truth.checked(found).records.collect()) == [("1", date(2025, 3, 4), "김민", 3, 4), ("1002", date(2025, 3, 4), "김민", 3, 5), ("7", date(2025, 3, 31), "박", 3, 10), ("9", date(2025, 4, 1), "김민", 4, 2)]
    assert sorted(tuple(r) for r in found.summaries.collect()) == [(3, 7, 3, 1, 1, 1, 1, 0), (4, 1, 1, 0, 0, 0, 0, 0)]


def test_a_sheet_ends_after_empty_rows(spark, tmp_path):
    rows = [HEAD, order("1"), *[[]] * 3, order("2"), *[[]] * 4, order("3")]
    assert {r.order_number for r in read(spark, tmp_path, {"3월": rows}, blank_rows=4).records.collect()} == {"1", "2"}
    assert {r.order_number for r in read(spark, tmp_path, {"3월": rows}, blank_rows=3).records.collect()} == {"1"}
    assert {r.order_number for r in read(spark, tmp_path, {"3월": rows}).records.collect()} == {"1", "2", "3"}
    # Cells of other columns do not keep a sheet going; a row without number does, and is a problem.
    noted = [HEAD, order("1"), *[[None] * 7 + ["note"]] * 2, [None, None, "완료"], *[[]] * 2, order("2")]
    found = read(spark, tmp_path, {"3월": noted}, blank_rows=3)
    assert {r.order_number for r in found.records.collect()} == {"1", "2"} and problems(found) == [("missing_order", 3, 5, None, None)]
    with pytest.raises(ValueError):
        read(spark, tmp_path, {"3월": noted}, blank_rows=0)


@pytest.mark.parametrize(
    ("sheets", "expected"),
    [
        ({"5월": [HEAD]}, ("missing_sheet", 3, None, None, "3월")),
        ({"3월": [["오더"], order("1")]}, ("missing_header", 3, None, None, "3월")),
        ({"3월": [*[["x"]] * 50, HEAD, order("1")]}, ("missing_header", 3, None, None, "3월")),
        ({"3월": [[c for c in HEAD if c not in ("상태", "사업부")], order("1")]}, ("missing_columns", 3, None, None, "사업부, 상태")),
        ({"3월": [HEAD, order("1"), order("1.00", department="품질")]}, ("duplicate_order", 3, 3, "1", None)),
        ({"3월": [HEAD, order("1", person=None, day="soon")]}, ("missing_value", 3, 2, "1", "오더생성일, 생성인")),
        ({"3월": [HEAD, order("1", day="2025-04-01")]}, ("wrong_month", 3, 2, "1", "2025-04-01")),
    ],
)
def test_problems_are_told(spark, tmp_path, sheets, expected):
    found = read(spark, tmp_path, sheets)
    assert problems(found) == [expected]
    with pytest.raises(truth.TruthError, match=f"1 {expected[0]}"):
        truth.checked(found)


def test_problems_of_rows_left_out_do_not_count(spark, tmp_path):
    rows = [HEAD, order("1", department="품질", person=None, day=None), order("2", status="오더취소", day="2020-01-01"), order("3")]
    found = read(spark, tmp_path, {"3월": rows})
    assert problems(found) == [] and [r.order_number for r in found.records.collect()] == ["3"]


def test_the_same_number_on_two_sheets(spark, tmp_path):
    found = read(spark, tmp_path, {"3월": [HEAD, order("1")], "4월": [HEAD, order("1", day="2025-04-02")]}, months=(3, 4))
    assert problems(found) == [("duplicate_order", 4, 2, "1", None)] and [r.month for r in found.records.collect()] == [3]
