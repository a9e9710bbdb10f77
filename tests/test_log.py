"""The event log: ids of many writers, and a stream that stops and resumes without a lost or doubled entry."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from fenwright.streaming import log


@pytest.fixture
def stream(spark, tmp_path):
    spark.dataSource.register(log.EventLogSource)
    path, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))

    def run(**options):
        df = spark.readStream.format("event_log").options(path=path, **options).load()
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.id, r.type, r.message, r.data) for r in spark.read.schema(log.SCHEMA).parquet(out).where("id is not null").collect())

    return log.EventLog(path), run


def test_ids_ascend_for_many_writers(tmp_path):
    logs = [log.EventLog(str(tmp_path / "log")) for _ in range(8)]
    with ThreadPoolExecutor(8) as pool:
        ids = list(pool.map(lambda n: logs[n % 8].publish("t", f"m{n}"), range(120)))
    assert sorted(ids) == list(range(1, 121))
    found = logs[0].after(0, 1000)
    assert [e["id"] for e in found] == list(range(1, 121)) and {e["message"] for e in found} == {f"m{n}" for n in range(120)}
    assert [e["id"] for e in logs[0].after(117)] == [118, 119, 120] and len(logs[0].after(0)) == 100
    assert logs[0].latest()["id"] == 120 and log.EventLog(str(tmp_path / "none")).latest() is None


def test_stream_resumes_after_a_restart(stream):
    events, run = stream
    for n in range(5):
        events.publish("upload", f"first {n}", {"rows": n, "name": "a"})
    assert run() == [(n + 1, "upload", f"first {n}", {"rows": str(n), "name": "a"}) for n in range(5)]
    assert len(run()) == 5  # nothing new, nothing doubled
    for n in range(3):
        events.publish("approve", f"second {n}")
    assert [x[0] for x in run()] == list(range(1, 9))


def test_stream_starts_after_an_id(stream):
    events, run = stream
    for n in range(6):
        events.publish("t", str(n))
    assert [x[0] for x in run(after="4")] == [5, 6]
    events.publish("t", "later")
    assert [x[0] for x in run(after="4")] == [5, 6, 7]  # the checkpoint counts, not the option


def test_entries_are_dealt_to_tasks_and_gaps_are_passed(tmp_path):
    events = log.EventLog(str(tmp_path / "log"))
    for n in range(7):
        events.publish("t", str(n))
    (tmp_path / "log" / f"{4:0{log.DIGITS}d}").unlink()
    reader = log.EventLogReader(str(tmp_path / "log"), 0, 0)
    parts = reader.partitions({"id": 0, "beat": 0}, reader.latestOffset())
    assert [(p.first, p.last) for p in parts] == [(1, 8)]
    assert [r[0] for p in parts for r in reader.read(p)] == [1, 2, 3, 5, 6, 7]
    many = reader.partitions({"id": 0, "beat": 0}, {"id": 2500, "beat": 0})
    assert [(p.first, p.last) for p in many] == [(1, 1001), (1001, 2001), (2001, 2501)]


def test_heartbeats_of_a_silent_log(spark, tmp_path):
    reader = log.EventLogReader(str(tmp_path), 0, 0.5)
    start = reader.initialOffset()
    assert start["id"] == 0 and reader.partitions(start, start) == []
    time.sleep(0.6)
    end = reader.latestOffset()
    (beat,) = reader.partitions(start, end)
    ((id, kind, *_),) = list(reader.read(beat))
    assert (id, kind) == (None, log.HEARTBEAT)
    spark.dataSource.register(log.EventLogSource)
    df = spark.readStream.format("event_log").options(path=str(tmp_path / "log"), heartbeat="0.5").load()
    query = df.writeStream.format("memory").queryName("beats").start()
    try:
        log.EventLog(str(tmp_path / "log")).publish("t", "one")
        deadline = time.time() + 60
        while time.time() < deadline and spark.sql("select 1 from beats where type = 'heartbeat'").count() < 2:
            time.sleep(0.5)
    finally:
        query.stop()
    rows = spark.sql("select * from beats").collect()
    assert sum(r.type == log.HEARTBEAT for r in rows) >= 2 and [r.message for r in rows if r.id is not None] == ["one"]
