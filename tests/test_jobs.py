"""Workbooks written by tasks, and jobs restored whole or not at all."""

from __future__ import annotations

import glob
import io
import os
import shutil
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fenwright.operators import clean
from fenwright.sources import jobs, tables

ROWS = [(1, "=1+1", "010-1234-5678 문의", 1.5, date(2025, 1, 2)), (2, " plain ", "a <b> & \"c\"\x07", None, None), (3, None, "줄\n바꿈", -2.0, date(2025, 1, 3)), (4, "'@x", "", 0.0, None), (5, "-5", "x" * 40_000, 7.25, None)]
SCHEMA = "n int, formula string, detail string, amount double, day date"


def test_workbooks_are_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    jobs.save_workbook(df, path, "후보 군")
    found = tables.with_header(tables.workbook_cells(spark, f"file://{path}"), ["n", "detail"], ["n", "formula", "detail", "amount", "day"])
    got = {int(r.n): (r.formula, r.detail, r.amount, r.day) for r in found.collect()}
    assert got[1] == ("'=1+1", "010-1234-5678 문의", "1.5", "2025-01-02") and got[2] == ("plain", 'a <b> & "c"', None, None)
    assert got[3] == (None, "줄\n바꿈", "-2.0", "2025-01-03") and got[4][:2] == ("'@x", None) and got[5][:2] == ("'-5", "x" * 40_000)
    assert not [f for f in os.listdir(path) if not f.endswith(".xlsx")]
    files = set(glob.glob(f"{path}/*.xlsx"))
    jobs.save_workbook(df.limit(1), path, "s")
    assert len(glob.glob(f"{path}/*.xlsx")) == 1 and not files & set(glob.glob(f"{path}/*.xlsx"))
    jobs.save_workbook(df.limit(0), path, "s", mode="append")
    assert len(glob.glob(f"{path}/*.xlsx")) == 1
    jobs.save_workbook(df, path, "s", detail="detail")
    assert "010-1234" not in "".join(str(r.cells) for r in tables.workbook_cells(spark, f"file://{path}").collect())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.createDataFrame(ROWS, SCHEMA)
    jobs.save_workbook(good, path, "s")
    before = sorted(os.listdir(path))
    bad = spark.range(0, 400, 1, 4).select(F.when(F.col("id") == 399, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="no"):
        jobs.save_workbook(bad, path, "s")
    assert sorted(os.listdir(path)) == before


def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path):
    writer = jobs.WorkbookWriter(str(tmp_path / "out"), "s", ["v"], True)
    writer.begin()

    def rows():
        yield ("a",)
        writer.abort([])
        yield ("b",)

    for late in (rows(), iter([("c",)])):
        with pytest.raises(RuntimeError, match="aborted"):
            writer.write(late)
    assert os.listdir(tmp_path / "out") == []


def test_sheets_have_an_end():
    stream = io.BytesIO()
    assert jobs.write_sheets(stream, "s", ["a"], iter([(i,) for i in range(7)]), most=4) == 7
    rows = list(tables.sheet_rows(stream.getvalue()))
    assert [(s, n) for s, n, c in rows if c == ["a"]] == [("s 1", 0), ("s 2", 0), ("s 3", 0)]
    assert [c[0] for _, n, c in rows if n] == [str(i) for i in range(7)]
    assert [jobs._letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


@pytest.fixture
def store(spark, tmp_path):
    made = jobs.JobStore(spark, f"file://{tmp_path}/jobs")
    rows = spark.createDataFrame(ROWS, SCHEMA)
    made.save("job1", "in.xlsx", datetime(2025, 2, 1).isoformat(), (date(2025, 1, 1), date(2025, 1, 31)), {"rows": rows, "candidates": rows.where("n > 3"), "none": rows.limit(0)}, {"rows": 5})
    return made, f"{tmp_path}/jobs"


def test_a_job_is_restored_as_it_was(spark, store):
    made, _ = store
    job = made.restore()
    assert job.manifest["job_id"] == "job1" and job.manifest["summaries"] == {"rows": 5} and set(job.tables) == {"rows", "candidates", "none"}
    expected = spark.createDataFrame(ROWS, SCHEMA)
    assert job.tables["rows"].schema.simpleString() == expected.schema.simpleString()
    # A text that had a mark of its own before a formula is the one thing that cannot be told from an escaped one.
    assert sorted(map(tuple, job.tables["rows"].where("n <> 4").collect())) == sorted(map(tuple, expected.where("n <> 4").collect()))
    assert job.tables["none"].count() == 0
    assert [r.formula for r in jobs.unescape_formulas(clean.escape_formulas(expected.select("formula").where("n in (1, 5)"))).collect()] == ["=1+1", "-5"]


def test_damaged_jobs_are_refused(spark, store, tmp_path):
    made, root = store
    (folder,) = (f for f in glob.glob(f"{root}/*") if not os.path.basename(f).startswith("_"))
    # Rows that another job wrote: same columns, same number.
    spark.createDataFrame(ROWS[:4] + [(5, "-6", "y", 7.25, None)], SCHEMA).write.mode("overwrite").parquet(f"{folder}/rows")
    with pytest.raises(jobs.JobDamaged, match="rows is not what was saved: hash"):
        made.restore()
    shutil.rmtree(f"{folder}/candidates")
    spark.createDataFrame(ROWS, SCHEMA).write.mode("overwrite").parquet(f"{folder}/rows")
    with pytest.raises(jobs.JobDamaged):
        made.restore()
    spark.createDataFrame([('{"version": 1, "job_id": ""}',)], "json string").write.mode("overwrite").parquet(f"{folder}/manifest")
    with pytest.raises(jobs.JobDamaged, match="job_id"):
        made.restore()
    with pytest.raises(jobs.JobDamaged, match="no job"):
        jobs.JobStore(spark, f"file://{tmp_path}/other").restore()
    with pytest.raises(ValueError):
        made.save("j", "s", "t", (date(2025, 1, 1), date(2025, 1, 1)), {})


def test_the_latest_job_counts(spark, store):
    made, _ = store
    other = spark.createDataFrame([("a",)], "v string")
    made.save("job2", "b.xlsx", "2025", (date(2025, 1, 1), date(2025, 1, 1)), {"rows": other})
    job = made.restore()
    assert job.manifest["job_id"] == "job2" and set(job.tables) == {"rows"} and [r.v for r in job.tables["rows"].collect()] == ["a"]
    made.save("job3", "b.xlsx", "2025", (date(2025, 1, 2), date(2025, 1, 1)), {"rows": other})
    with pytest.raises(jobs.JobDamaged, match="period"):
        made.restore()
