"""Questions about jobs: pick a tool by keyword and run it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import routing
from tidemill.plans import reports, retrieval, wastage


def route(questions: DataFrame, column: str = "question") -> DataFrame:
    """The questions with the tool that answers each."""
    return questions.withColumn("tool", routing.route(F.col(column)))


def run_tool(name: str, runs: DataFrame, reads: DataFrame,
             as_of: datetime | Column | None = None) -> DataFrame:
    """The answer rows of one tool; ``as_of`` defaults to now."""
    as_of = F.current_timestamp() if as_of is None else as_of
    tools = {
        "top_cost_pipelines": lambda: reports.top_cost(runs, as_of),
        "recent_failures": lambda: reports.recent_failures(runs, as_of),
        "unused_tables": lambda: wastage.unused_tables(runs, reads),
        "runtime_trend": lambda: wastage.runtime_trend(runs),
    }
    if name not in tools:
        raise ValueError(f"Unknown tool {name!r}; one of {sorted(tools)}")
    return tools[name]()


def answers(asked: DataFrame, runs: DataFrame, reads: DataFrame, store: Callable[[], DataFrame],
            as_of: datetime | Column | None = None, k: int = retrieval.CONTEXT_HITS,
            fn: retrieval.Embedder | None = None,
            dims: int = retrieval.DIMS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Route questions (qid, question) and give what each tool in use answers from.

    Returns the questions with their tool, and per tool its rows. Document
    search gives one context per question; the other tools answer all their
    questions alike. ``store`` is opened only if a question needs it.
    """
    routed = route(asked)
    used = {row["tool"] for row in routed.select("tool").distinct().collect()}
    found = {tool: run_tool(tool, runs, reads, as_of) for tool in sorted(used)
             if tool != routing.DOC_SEARCH}
    if routing.DOC_SEARCH in used:
        texts = (routed.filter(F.col("tool") == routing.DOC_SEARCH)
                 .select("qid", F.col("question").alias("text")))
        found[routing.DOC_SEARCH] = retrieval.context(
            retrieval.retrieve(texts, store(), k, fn, dims))
    return routed, found


#: How each tool's answer is ordered, as SQL.
ORDERS = {
    "top_cost_pipelines": "total_cost DESC NULLS LAST, job_name",
    "recent_failures": "ended_at DESC, job_name, error_message",
    "unused_tables": "last_written DESC NULLS LAST, table_name",
    "runtime_trend": "runtime_trend_ratio DESC NULLS LAST, job_name",
}


def tool_context(answer: DataFrame, order: str) -> DataFrame:
    """One row (context): a tool's whole answer as text in its order, a line per row, values parted by bars."""
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in answer.columns])
    return answer.withColumn("_line", line).agg(F.coalesce(
        F.expr(f"listagg(_line, '\n') WITHIN GROUP (ORDER BY {order})"), F.lit("")).alias("context"))


def contexts(routed: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(qid, tool, context) of every question, from what ``answers`` gives."""
    out = None
    for tool, answer in found.items():
        asked = routed.filter(F.col("tool") == tool).select("qid", "tool")
        if tool == routing.DOC_SEARCH:
            part = asked.join(answer, "qid")
        else:
            part = asked.join(tool_context(answer, ORDERS[tool]).withColumn("tool", F.lit(tool)), "tool")
        part = part.select("qid", "tool", "context")
        out = part if out is None else out.unionByName(part)
    return out
