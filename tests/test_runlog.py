from datetime import datetime, timedelta, timezone

import pytest

from tidemill.plans import reports, wastage
from tidemill.plans.runlog import HOURLY_RATE_USD, RunLog
from tidemill import schemas

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def log(spark, tmp_path):
    return RunLog(spark, str(tmp_path / "runs"), str(tmp_path / "reads"))


def test_start_then_end_is_one_row(log):
    assert log.runs().count() == 0 and log.reads().count() == 0
    run = log.start("load", "batch_ingestion", ["raw/x"])
    row = log.runs().first()
    assert (row["status"], row["ended_at"], row["output_tables"]) == ("running", None, [])
    run.rows_written, run.output_tables = 7, ["bronze/x"]
    log.end(run)
    [row] = log.runs().collect()
    assert row["run_id"] == run.run_id and row["status"] == "success"
    assert row["rows_written"] == 7 and row["input_tables"] == ["raw/x"]
    assert row["estimated_cost_usd"] == pytest.approx(
        row["duration_seconds"] * HOURLY_RATE_USD / 3600)


def test_supplied_cost_wins(log):
    run = log.start("load", "dbt")
    run.estimated_cost_usd = 2.5
    log.end(run)
    assert log.runs().first()["estimated_cost_usd"] == 2.5


def test_track_logs_failure_on_the_same_run(log):
    with pytest.raises(ValueError), log.track("job", "dbt", ["a"]) as run:
        raise ValueError("broken")
    [row] = log.runs().collect()
    assert (row["run_id"], row["status"], row["error_message"]) == (run.run_id, "failed", "broken")
    assert row["duration_seconds"] is None and row["estimated_cost_usd"] is None


def test_fail_without_run(log):
    log.fail("job", "no start")
    row = log.runs().first()
    assert row["job_type"] == "unknown" and row["run_id"] and row["input_tables"] == []


def test_reads_and_compaction(spark, log, tmp_path, rows):
    log.record_read("gold.x", "dashboard")
    log.record_read("gold.x", "dashboard")
    assert rows(log.reads().select("table_name", "reader_job")) == [("gold.x", "dashboard")] * 2
    run = log.start("a", "dbt")
    assert log.compact() == 0
    log.end(run)
    log.end(log.start("b", "dbt"))
    want = [("a", "success"), ("b", "success")]
    assert rows(log.runs().select("job_name", "status"), "job_name") == want
    assert log.compact() == 1
    assert rows(log.runs("dbt").select("job_name", "status"), "job_name") == want
    assert log.runs("streaming").count() == 0


def runs_of(spark, entries):
    """Runs from (id, job, status, seconds, inputs, outputs), each a minute after the last."""
    rows = []
    for i, (run_id, job, status, seconds, inputs, outputs) in enumerate(entries):
        end = T0 + timedelta(minutes=i)
        rows.append((run_id, job, "dbt", status, end, end, seconds, None, None, None, inputs,
                     outputs, "boom" if status == "failed" else None,
                     None if seconds is None else seconds * 0.001))
    return spark.createDataFrame(rows, schemas.PIPELINE_RUNS)


def test_unused_tables(spark, rows):
    runs = runs_of(spark, [("1", "a", "success", 1.0, [], ["x", "y"]),
                           ("2", "b", "failed", None, ["x"], []),
                           ("3", "c", "running", None, None, ["z"])])
    none = spark.createDataFrame([], schemas.TABLE_READS)
    assert rows(wastage.unused_tables(runs, none).select("table_name")) == [("y",)]
    reads = spark.createDataFrame([("y", T0, "dash")], schemas.TABLE_READS)
    assert wastage.unused_tables(runs, reads).count() == 0
    plan = wastage.unused_tables(runs, none)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan


def trend_of(spark, durations):
    """Trend of one job, durations newest first."""
    entries = [(str(i), "j", "success", d, [], []) for i, d in enumerate(reversed(durations))]
    return wastage.runtime_trend(runs_of(spark, entries))


def test_trend(spark, rows):
    slower = trend_of(spark, [12.0] * 5 + [10.0] * 5 + [99.0] * 3)
    row = slower.first()
    assert (row["avg_recent_duration"], row["avg_prior_duration"],
            row["runtime_trend_ratio"]) == (12.0, 10.0, 1.2)
    [finding] = rows(wastage.trend_findings(slower))
    assert finding[2] == ("runtime trending up: recent runs average 12.00s vs 10.00s before "
                          "(+20%), total est. cost so far $0.4070")
    for durations in ([1.0] * 5, [5.0] * 5 + [0.0] * 5):
        trend = trend_of(spark, durations)
        assert trend.first()["runtime_trend_ratio"] is None
        assert wastage.runtime_regressions(trend).count() == 0


def test_trend_ranks_below_the_shuffle(spark):
    plan = trend_of(spark, [1.0])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_report_and_totals(spark, rows):
    runs = runs_of(spark, [(str(i), "j", "success", d, ["in"], ["out"])
                           for i, d in enumerate([1.0] * 5 + [2.0] * 5)])
    reads = spark.createDataFrame([], schemas.TABLE_READS)
    columns = spark.createDataFrame([("a", "x"), ("b", "x")],
                                    "table_name string, column_name string")
    report = wastage.wastage_report(runs, reads, columns)
    found = {row[0]: row[1:] for row in rows(report)}
    assert found[wastage.UNUSED_TITLE] == (
        "out", "written by a pipeline (last: 2024-01-01 00:09:00+00:00) but never read as an "
               "input by any other tracked run")
    assert found[wastage.TREND_TITLE][0] == "j" and found[wastage.SCHEMAS_TITLE][0] == "a <-> b"
    totals = dict(rows(wastage.findings_total(report)))
    assert totals[None] == 3 and set(totals.values()) == {1, 3}


def test_reports(spark, rows):
    runs = runs_of(spark, [("1", "a", "success", 5.0, [], []), ("2", "b", "success", 9.0, [], []),
                           ("3", "b", "failed", None, [], []), ("4", "c", "failed", None, [], [])])
    as_of = T0 + timedelta(days=3, minutes=2)
    assert rows(reports.top_cost(runs, as_of, n=1)) == [("b", pytest.approx(0.009))]
    assert [r[0] for r in rows(reports.recent_failures(runs, as_of))] == ["c", "b"]
    assert [r[0] for r in rows(reports.recent_failures(runs, as_of + timedelta(minutes=1)))] == ["c"]
    assert len(rows(reports.runs_by_type(runs, "dbt"))) == 4
    plan = reports.top_cost(runs, as_of)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
