import json

import pytest

from tidemill.plans.runlog import RunLog
from tidemill.sources import tables
from tidemill.streaming import windows


def event(session, at, kind="click"):
    return {"event_id": f"{session}{at}", "session_id": session, "user_id": "u", "page": "/",
            "event_type": kind, "event_time": f"2024-01-01T00:{at}+00:00"}


@pytest.fixture
def drop(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    count = iter(range(100))

    def write(*events):
        n = next(count)
        file = folder / f"{n:03d}.json"
        file.write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events))
        import os
        os.utime(file, (1_700_000_000 + n, 1_700_000_000 + n))  # file order is event order
    write.folder = str(folder)
    return write


def run(spark, tmp_path, drop, files_per_batch=1):
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))
    raw = windows.file_events(spark, drop.folder, files_per_batch)
    totals = windows.run_stream(
        windows.window_counts(windows.decode_events(raw)), str(tmp_path / "gold"),
        str(tmp_path / "checkpoint"), log, "clickstream", trigger=None, poll=1.0)
    return totals, log


def gold(spark, tmp_path, rows):
    table = tables.read_table(spark, str(tmp_path / "gold"))
    return [(r[0].minute, *r[2:]) for r in rows(table, "window_start", "event_type")]


def test_windows_close_once_and_resume(spark, tmp_path, drop, rows):
    drop(event("a", "00:05"), event("a", "00:50"), event("b", "00:55"))
    drop(event("a", "01:40"))
    drop(event("c", "03:00"))
    drop(event("c", "05:00"))
    totals, log = run(spark, tmp_path, drop)
    closed = [(0, "click", 3, 2), (1, "click", 1, 1), (3, "click", 1, 1)]
    assert gold(spark, tmp_path, rows) == closed
    assert (totals.rows_read, totals.windows_closed) == (6, 3)
    beats = log.runs()
    assert beats.filter("status = 'success' and job_type = 'streaming'").count() == totals.batches
    sums = beats.selectExpr("sum(rows_read)", "sum(rows_written)").first()
    assert tuple(sums) == (6, 3)
    # The open window waits in the checkpoint; a late row for a closed one is dropped.
    drop(event("z", "00:10"), event("d", "05:30"))
    drop(event("d", "09:00"))
    totals, _ = run(spark, tmp_path, drop)
    assert gold(spark, tmp_path, rows) == closed + [(5, "click", 2, 2)]
    assert totals.rows_too_late == 1


def test_stream_equals_batch(spark, tmp_path, drop, rows):
    events = [event(f"s{i % 3}", f"{i // 60:02d}:{i % 60:02d}", "buy" if i % 4 else "click")
              for i in range(0, 600, 7)]
    for start in range(0, len(events), 30):
        drop(*events[start:start + 30])
    drop(event("end", "30:00"))
    run(spark, tmp_path, drop, files_per_batch=2)
    raw = spark.read.text(drop.folder)
    batch = windows.window_counts_batch(windows.decode_events(raw))
    done = batch.filter("window_end <= timestamp'2024-01-01 00:29:30'")
    assert rows(tables.read_table(spark, str(tmp_path / "gold")), "window_start", "event_type") == \
        rows(done, "window_start", "event_type")


def test_bad_json_fails_the_run(spark, tmp_path, drop):
    drop(event("a", "00:05"), "{broken")
    with pytest.raises(Exception):
        run(spark, tmp_path, drop)
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))
    row = log.runs().first()
    assert row["status"] == "failed" and row["job_name"] == windows.JOB_NAME


def test_null_session_counts_as_one(spark, rows):
    df = spark.createDataFrame(
        [(f"2024-01-01 00:00:0{i}", "x", s) for i, s in enumerate([None, None, "a"])],
        "t string, event_type string, session_id string").selectExpr(
            "cast(t as timestamp) as event_time", "event_type", "session_id")
    assert rows(windows.window_counts_batch(df).select("event_count", "distinct_sessions")) == [(3, 2)]


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        windows.kafka_events(spark, "host:1", "topic")


def test_timed_run_leaves_heartbeats(spark, tmp_path, drop, rows):
    drop(event("a", "00:05"), event("b", "05:00"))
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))
    counts = windows.window_counts(windows.decode_events(windows.file_events(spark, drop.folder)))
    totals = windows.run_stream(counts, str(tmp_path / "gold"), str(tmp_path / "checkpoint"), log,
                                "clickstream", trigger="1 second", timeout=12, poll=1.0)
    assert not spark.streams.active
    assert (totals.rows_read, totals.windows_closed) == (2, 1)
    assert log.runs("streaming").count() == totals.batches >= 2


def test_open_windows_are_flushed_and_replaced_when_they_close(spark, tmp_path, drop, rows):
    drop(event("a", "00:05"), event("b", "00:50"), event("a", "03:00"), event("c", "03:10"), event("c", "03:20"))
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))

    def go(**options):
        counts = windows.window_counts(windows.decode_events(windows.file_events(spark, drop.folder)))
        return windows.run_stream(counts, str(tmp_path / "gold"), str(tmp_path / "checkpoint"), log, "clickstream",
                                  trigger=None, **options)

    totals = go(flush=True)
    assert (totals.windows_closed, totals.windows_flushed) == (1, 1)
    batch = windows.window_counts_batch(windows.decode_events(spark.read.text(drop.folder)))
    assert gold(spark, tmp_path, rows) == [(0, "click", 2, 2), (3, "click", 3, 2)]
    assert rows(tables.read_table(spark, str(tmp_path / "gold")), "window_start") == rows(batch, "window_start")
    drop(event("d", "03:40"), event("a", "03:41"))  # the flushed window goes on, and closes
    drop(event("e", "09:00"))
    totals = go()
    assert gold(spark, tmp_path, rows) == [(0, "click", 2, 2), (3, "click", 5, 3)]
    assert go(flush=True).windows_flushed == 1
    assert gold(spark, tmp_path, rows) == [(0, "click", 2, 2), (3, "click", 5, 3), (9, "click", 1, 1)]
    written = log.runs("streaming").filter("status = 'success'").selectExpr("sum(rows_written)").first()[0]
    assert written == 1 + 1 + 1 + 1


def test_heartbeats_outlast_the_progress_spark_keeps(spark, tmp_path, drop):
    for minute in range(7):
        drop(event("a", f"{minute:02d}:05"), event("b", f"{minute:02d}:06"))
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        totals, log = run(spark, tmp_path, drop)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    beats = log.runs("streaming")
    assert totals.batches >= 7 and beats.count() == totals.batches
    assert (totals.rows_read, beats.selectExpr("sum(rows_read)").first()[0]) == (14, 14)


def test_a_repeated_batch_adds_no_heartbeat(spark, tmp_path, drop):
    drop(event("a", "00:05"), event("b", "03:00"))
    run(spark, tmp_path, drop)
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))
    before = sorted(r[0] for r in log.runs().select("run_id").collect())
    for commit in (tmp_path / "checkpoint/commits").iterdir():  # as if the driver had died before it noted the last batch
        if f"{len(before) - 1}" in commit.name:
            commit.unlink()
    totals, _ = run(spark, tmp_path, drop)
    assert totals.batches == 1
    after = sorted(r[0] for r in log.runs().select("run_id").collect())
    assert set(before) <= set(after) and len(after) == len(set(after))
    assert len(after) == len(before)


def test_a_timed_run_stops_between_batches_and_goes_on(spark, tmp_path, drop, rows):
    for minute in range(6):
        drop(event("a", f"{minute:02d}:05"), event("b", f"{minute:02d}:06"))
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))

    def go(**options):
        counts = windows.window_counts(windows.decode_events(windows.file_events(spark, drop.folder, 1)))
        return windows.run_stream(counts, str(tmp_path / "gold"), str(tmp_path / "checkpoint"), log, "clickstream",
                                  trigger="1 second", flush=True, **options)

    first = go(timeout=2.0)
    assert not spark.streams.active and 0 < first.rows_read < 12
    second = go(timeout=300, idle=2.5)
    assert first.rows_read + second.rows_read == 12
    batch = windows.window_counts_batch(windows.decode_events(spark.read.text(drop.folder)))
    assert rows(tables.read_table(spark, str(tmp_path / "gold")), "window_start") == rows(batch, "window_start")
    assert log.runs().filter("status <> 'success'").count() == 0


def test_events_are_parted_once_and_rejected_ones_kept(spark, tmp_path, drop, rows):
    good = [event("a", "00:05"), event("b", "00:06")]
    drop(*good, "{broken", "[1]", '{"session_id": "x", "event_type": "click"}', json.dumps({**good[0], "event_time": "noon"}))
    drop(event("c", "02:00"), json.dumps({**good[0], "user_id": {"a": 1}}) + "}")
    folder, checkpoint = str(tmp_path / "events"), str(tmp_path / "parting")

    def part():
        windows.part_events(windows.file_events(spark, drop.folder, 1), folder, checkpoint).awaitTermination()

    part()
    bad = windows.rejected_events(spark, folder)
    assert sorted(r[0] for r in rows(bad.select("reason"))) == [
        "event_time is missing", "event_time is no timestamp", "not a JSON event", "not a JSON event", "not a JSON event"]
    assert rows(bad.filter("record = '{broken'").select("batch")) == [(0,)]
    for commit in (tmp_path / "parting/commits").iterdir():  # its last batch is repeated
        if "1" in commit.name:
            commit.unlink()
    part()
    assert windows.rejected_events(spark, folder).count() == 5
    log = RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))
    totals = windows.run_stream(windows.window_counts(windows.good_events(spark, folder)), str(tmp_path / "gold"),
                                str(tmp_path / "checkpoint"), log, "events", trigger=None, flush=True)
    assert totals.rows_read == 3
    assert gold(spark, tmp_path, rows) == [(0, "click", 2, 2), (2, "click", 1, 1)]
