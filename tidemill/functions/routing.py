"""Route a question to a tool by keyword."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tools in matching order, each with the words that select it.
ROUTES = {
    "top_cost_pipelines": ("cost", "expensive", "spend"),
    "recent_failures": ("fail", "error", "broke"),
    "unused_tables": ("unused", "waste", "orphan"),
    "runtime_trend": ("slow", "trend", "degrad"),
}
DOC_SEARCH = "doc_search"


def mentions(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(word) for word in words])


def route(question: Column) -> Column:
    """The first tool one of whose words occurs in the question, else document search."""
    text = F.lower(question)
    choice = F.when(F.lit(False), F.lit(None))
    for tool, words in ROUTES.items():
        choice = choice.when(mentions(text, words), F.lit(tool))
    return choice.otherwise(F.lit(DOC_SEARCH))
