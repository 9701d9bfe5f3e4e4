"""Chat formatting: tool calls linked with their results, ordered, validated, as canonical JSON.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import prepared, table

#: How a message carries calls: an assistant's text is {"tool_calls": [{"id", "name", "arguments"}]},
#: with "content" beside it if there is any; a tool's is {"tool_call_id", "content"}. A call's name and
#: arguments may stand in a "function" object of its own, the arguments as an object or as JSON text.
_CALL = "id:string,name:string,arguments:string"
CALLS = f"struct<content:string,tool_calls:array<struct<{_CALL},function:struct<name:string,arguments:string>>>>"
CALL_KEYS = "struct<tool_calls:array<map<string,variant>>>"
RESULT = "struct<tool_call_id:string,content:string>"
#: Types an argument may be declared to have, and how a JSON value of that type is written.
TYPES = {
    "string": r'^"', "integer": r"^-?[0-9]+$", "number": r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$",
    "boolean": r"^(true|false)$", "array": r"^\[", "object": r"^\{",
}

#: The production tools, against which ``op10_chat`` checks calls: tool -> argument -> (type, required).
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True)},
    "run_code": {"language": ("string", True), "code": ("string", True), "timeout": ("number", False)},
    "read_file": {"path": ("string", True)},
    "write_file": {"path": ("string", True), "content": ("string", True), "append": ("boolean", False)},
    "query_table": {"sql": ("string", True), "parameters": ("array", False)},
    "call_service": {"name": ("string", True), "body": ("object", True)},
}


def quoted(value: Column) -> Column:
    """A JSON string."""
    plain = F.to_json(F.array(F.coalesce(value, F.lit(""))))
    return F.substring(plain, F.lit(2), F.length(plain) - 2)


def canonical(raw: Column) -> Column:
    """A JSON value with sorted keys and no blanks; text that isn't JSON becomes a string."""
    return F.coalesce(F.to_json(F.try_parse_json(raw)), quoted(raw))


def others(keys: Column, known: tuple[str, ...]) -> Column:
    """The members of an object (a map) that aren't known, as JSON; null if there are none."""
    def unknown(key: Column, value: Column) -> Column:
        inside = F.array_except(F.json_object_keys(F.to_json(value)), F.array(F.lit("name"), F.lit("arguments")))
        used = (key == "function") & (F.size(inside) == 0) if "arguments" in known else F.lit(False)
        return ~key.isin(*known) & ~F.coalesce(used, F.lit(False))

    return F.nullif(F.to_json(F.map_filter(keys, unknown)), F.lit("{}"))


def extra(more: Column) -> Column:
    """The member that holds what isn't known, or nothing."""
    return F.when(more.isNotNull(), F.concat(F.lit(',"extra":'), canonical(more))).otherwise("")


def argument_problem(name: Column, raw: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments, or null: an unknown tool, no object, a missing,
    unknown or ill-typed argument. ``schemas``: tool -> argument -> (type, required)."""
    value = F.try_parse_json(raw)
    problem = F.lit("unknown tool")
    for tool, arguments in sorted(schemas.items(), reverse=True):
        checks = F.when(value.isNull() | ~F.regexp_like(F.to_json(value), F.lit(r"^\{")), "not an object")
        for argument, (kind, required) in sorted(arguments.items()):
            part = F.to_json(F.try_variant_get(value, f'$["{argument}"]', "variant"))
            if required:
                checks = checks.when(part.isNull(), f"missing {argument}")
            checks = checks.when(part.isNotNull() & ~F.regexp_like(part, F.lit(TYPES[kind])), f"{argument} is no {kind}")
        names = F.json_object_keys(F.to_json(value))
        unknown = F.array_except(names, F.array(*[F.lit(a) for a in arguments]).cast("array<string>"))
        checks = checks.when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.get(F.array_sort(unknown), F.lit(0))))
        problem = F.when(name == tool, checks).otherwise(problem)
    return problem


def formatted(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] | None = None) -> DataFrame:
    """One row per message: conv_id, turn, role, place_turn, place, n_calls, n_bad, linked, problem, json.

    Calls and results link by a hash join on (conv_id, call id); of several calls
    with an id the earliest turn counts, the others are a problem. The order is
    topological: (place_turn, place) is the message's own turn and 0, but a
    result that stands before its call moves right behind it, so every
    result follows its call; messages in equal places go by their JSON. ``linked``
    is whether a result has its call (null for other messages), ``problem`` the
    first fault: a result without a call, a call without a result or with an id
    used before, arguments against the tool's schema (checked when ``schemas`` are given).

    Faulty messages are kept and marked. A text that carries no calls, or one without a name, is content
    as it is; members of a message or call that mean nothing here are kept under ``extra``; null roles and texts count as empty, null ids and turns stay null
    and link with nothing. Repeated rows are repeated. One row is one message,
    however long its conversation: no conversation is gathered. Other columns
    are ignored; no rows give no rows.
    """
    prepared(messages.sparkSession)
    base = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    looks = F.startswith(F.ltrim("text"), F.lit("{"))
    called = F.when((F.col("role") == "assistant") & looks, F.from_json("text", CALLS))
    answered = F.when((F.col("role") == "tool") & looks, F.from_json("text", RESULT))
    parsed = base.withColumn("called", called).withColumn("answered", answered)
    named = F.forall("called.tool_calls", lambda c: F.coalesce(c["name"], c["function"]["name"]).isNotNull())
    is_call = F.coalesce(named, F.lit(False))
    call_id = F.col("answered.tool_call_id")
    parsed = parsed.withColumns({
        "calls": F.when(is_call, F.zip_with(
            "called.tool_calls", F.from_json("text", CALL_KEYS)["tool_calls"], lambda c, keys: F.struct(
                c["id"].alias("id"), F.coalesce(c["name"], c["function"]["name"]).alias("name"),
                F.coalesce(c["arguments"], c["function"]["arguments"]).alias("arguments"),
                others(keys, ("id", "name", "arguments")).alias("more"))))
        .otherwise(F.from_json(F.lit("[]"), f"array<struct<{_CALL},more:string>>")),
        "more": F.when(is_call, others(F.from_json("text", "map<string,variant>"), ("content", "tool_calls"))).when(
            call_id.isNotNull(), others(F.from_json("text", "map<string,variant>"), ("content", "tool_call_id"))),
        "content": F.when(is_call, F.coalesce("called.content", F.lit(""))).when(
            call_id.isNotNull(), F.coalesce("answered.content", F.lit(""))).otherwise(F.col("text")),
        "call_id": call_id}).drop("called", "answered", "text")
    each = parsed.select("conv_id", "turn", F.explode("calls").alias("call")).filter("call.id is not null")
    calls = each.groupBy("conv_id", F.col("call.id").alias("call_id")).agg(
        F.min("turn").alias("call_turn"), F.count("*").alias("times"))
    answers = parsed.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))
    known = calls.join(answers, ["conv_id", "call_id"], "left")
    # Per message: how many of its calls have a problem of linking, by its turn. Only calls travel.
    used = (each.select("conv_id", "turn", F.col("call.id").alias("call_id"))
            .join(known, ["conv_id", "call_id"]).groupBy("conv_id", "turn").agg(
                F.count_if(F.col("answers").isNull()).alias("open"),
                F.count_if((F.col("times") > 1)).alias("doubled")))
    faults = (F.transform("calls", lambda c: argument_problem(c["name"], F.coalesce(c["arguments"], F.lit("{}")), schemas))
              if schemas else F.array().cast("array<string>"))
    parsed = parsed.withColumn("faults", F.filter(faults, lambda f: f.isNotNull()))
    plain = parsed.filter("call_id is null and size(calls) = 0")
    with_calls = parsed.filter("call_id is null and size(calls) > 0").join(used, ["conv_id", "turn"], "left")
    with_answer = parsed.filter("call_id is not null").join(calls, ["conv_id", "call_id"], "left")
    none = F.lit(None)
    rows = plain.select("*", none.cast("long").alias("call_turn"), none.cast("long").alias("open"),
                        none.cast("long").alias("doubled"))
    rows = rows.unionByName(with_calls.withColumn("call_turn", none.cast("long")))
    rows = rows.unionByName(with_answer.drop("times").withColumns(
        {"open": none.cast("long"), "doubled": none.cast("long")}))
    late = F.col("call_turn") >= F.col("turn")
    tool_calls = F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform("calls", lambda c: F.concat(
        F.lit('{"arguments":'), canonical(F.coalesce(c["arguments"], F.lit("{}"))), extra(c["more"]),
        F.lit(',"id":'), quoted(c["id"]),
        F.lit(',"name":'), quoted(c["name"]), F.lit("}"))), ","), F.lit("]"))
    json = F.concat(
        F.lit('{"content":'), quoted(F.col("content")), extra(F.col("more")), F.lit(',"role":'), quoted(F.col("role")),
        F.when(F.col("call_id").isNotNull(), F.concat(F.lit(',"tool_call_id":'), quoted(F.col("call_id")))).otherwise(F.lit("")),
        F.when(F.size("calls") > 0, tool_calls).otherwise(F.lit("")), F.lit("}"))
    answer = F.col("call_id").isNotNull()
    linked = F.when(answer, F.col("call_turn").isNotNull())
    return rows.select(
        "conv_id", "turn", "role", F.when(late, F.col("call_turn")).otherwise(F.col("turn")).alias("place_turn"),
        F.when(late, 1).otherwise(0).alias("place"), F.size("calls").cast("long").alias("n_calls"),
        F.size("faults").cast("long").alias("n_bad"), linked.alias("linked"),
        F.when(answer & F.col("call_turn").isNull(), "result without call")
        .when(F.col("doubled") > 0, "call id used twice").when(F.col("open") > 0, "call without result")
        .otherwise(F.get("faults", F.lit(0))).alias("problem"), json.alias("json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"), SCHEMAS)


# The test conversations hold no calls, so that their messages stay in place.
SQL = """
SELECT conv_id, turn, coalesce(role, '') AS role, turn AS place_turn, 0 AS place, 0::BIGINT AS n_calls,
       0::BIGINT AS n_bad, NULL::BOOLEAN AS linked, NULL::VARCHAR AS problem,
       '{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(coalesce(role, '')) || '}' AS json
FROM conversations
"""
