from datetime import datetime, timezone

import pytest

from tidemill import schemas
from tidemill.plans import questions, retrieval
from tidemill.session import scratch_path

AT = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def runs(spark):
    row = ("1", "load", "dbt", "success", AT, AT, 9.0, None, None, None, [], ["x"], None, 0.5)
    return spark.createDataFrame([row], schemas.PIPELINE_RUNS)


@pytest.fixture
def reads(spark):
    return spark.createDataFrame([], schemas.TABLE_READS)


def test_first_match_wins(spark, rows):
    asked = ["Why did the expensive job fail?", "is it slow?", "Hello", "BROKEN orphan", None,
             "any Orphans?"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "qid int, question string")
    assert [r[2] for r in rows(questions.route(df), "qid")] == [
        "top_cost_pipelines", "runtime_trend", "doc_search", "recent_failures", "doc_search",
        "unused_tables"]


def test_tools_by_name(spark, rows, runs, reads):
    assert rows(questions.run_tool("top_cost_pipelines", runs, reads, AT)) == [("load", 0.5)]
    assert questions.run_tool("top_cost_pipelines", runs, reads).count() == 0  # long ago by now
    assert questions.run_tool("recent_failures", runs, reads, AT).count() == 0
    assert rows(questions.run_tool("unused_tables", runs, reads).select("table_name")) == [("x",)]
    assert questions.run_tool("runtime_trend", runs, reads).first()["job_name"] == "load"
    with pytest.raises(ValueError, match="Unknown tool"):
        questions.run_tool("other", runs, reads)


def test_answers_open_the_store_only_when_needed(spark, rows, runs, reads):
    def closed():
        raise AssertionError("not needed")

    cost = spark.createDataFrame([(1, "what does it cost?")], "qid int, question string")
    routed, found = questions.answers(cost, runs, reads, closed, AT)
    assert list(found) == ["top_cost_pipelines"]
    docs = spark.createDataFrame([("a.md", "kafka topics")], "source string, text string")
    store = retrieval.embed(retrieval.chunk(docs), dims=8)
    both = cost.union(spark.createDataFrame([(2, "kafka?")], cost.schema))
    routed, found = questions.answers(both, runs, reads, lambda: store, AT, dims=8)
    assert set(found) == {"top_cost_pipelines", "doc_search"}
    assert rows(found["doc_search"]) == [(2, "[a.md]\nkafka topics")]


def test_scratch_is_below_the_shared_folder(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert root is None or first.startswith(root.rstrip("/") + "/x-")
