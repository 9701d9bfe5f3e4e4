"""Personal data: generated candidates, boosted trees on format and context, calibrated thresholds.

DataFrame functions only; the driver sees a bounded table of counts, never rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import prepared, stage, table
from tidemill.llm.quality import Trees, fit

#: Cells of features the model is fitted on, at most: the most frequent ones.
CELLS = 20_000
#: The share of positives that a kind's candidates at the threshold or above must have.
PRECISION = 0.98
KINDS = ("email", "ip", "card", "phone")
MORE = ("mailbox", "number")

# Possessive loops: nothing after them could use what they give back, and they neither recurse
# nor retry, whatever the length of the text. A run that fails from its start fails from its middle.
_RUN_START = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
EMAIL = _RUN_START + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
MAILBOX = (_RUN_START + r"[A-Za-z0-9._%+-]++\x20?(?:@|[(\[](?:at|AT)[)\]])\x20?[A-Za-z0-9-]++"
           r"(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]++)++")
NUMBER = r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
#: Rows without these hold no match.
_NEEDS = {EMAIL: r"@", IP: r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", CARD: CARD, PHONE: r"\+[0-9]",
          MAILBOX: r"@|[(\[](?:at|AT)[)\]]", NUMBER: NUMBER}


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value), in code points.

    What stands between the matches gives their places.
    """
    gaps, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = "struct<at:int,out:array<struct<start:int,end:int,value:string>>>"
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(values)).alias("gap"), values.alias("value"))

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out")).cast(kind)
    matched = F.aggregate(steps, zero, lambda s, x: step(s, x).cast(kind), lambda s: s["out"])
    return F.when(F.regexp_like(text, F.lit(_NEEDS[pattern])), matched).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(
        i % 2 == 1, F.coalesce(c.cast("int"), F.lit(0)) * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
        .otherwise(F.coalesce(c.cast("int"), F.lit(0))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _byte_parts(value: Column) -> Column:
    """Whether all parts of a dotted number are at most 255."""
    return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3)
                    & (F.coalesce(F.substring(F.concat(F.lit("0"), F.regexp_replace(p, "^0+", "")), 1, 4).cast("int"), F.lit(0)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """The validated spans of every base kind."""
    return {
        "email": found(text, EMAIL),
        "ip": F.filter(found(text, IP), lambda s: _byte_parts(s["value"])),
        "card": F.filter(found(text, CARD), lambda s: F.length(digits(s["value"])).between(13, 19)
                         & luhn(digits(s["value"]))),
        "phone": F.filter(found(text, PHONE), lambda s: F.length(digits(s["value"])).between(9, 15)),
    }


FEATURES = ("mailbox", "digits", "groups", "first", "last", "separator", "paren", "context", "before", "after")


def _side(char: Column) -> Column:
    """0 for blank or nothing, 1 for a letter or digit, 2 for anything else."""
    return F.when(F.regexp_like(char, F.lit(r"^\s*$")), 0).when(
        F.regexp_like(char, F.lit(r"[\p{L}\p{N}]")), 1).otherwise(2)


def _features(text: Column, span: Column, mailbox: bool) -> Column:
    """Format and context of a candidate, as small whole numbers; nothing that a base kind validates."""
    value = span["value"]
    groups = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0))
    count = F.length(digits(value))
    context = F.lower(F.substring(text, F.greatest(span["start"] - 23, F.lit(1)), F.least(span["start"], F.lit(24))))
    where = (F.when(F.regexp_like(context, F.lit(r"phone|tel\b|call|mobile|fax")), 1)
             .when(F.regexp_like(context, F.lit(r"card|visa|account|iban|ssn")), 2)
             .when(F.regexp_like(context, F.lit(r"mail|contact")), 3).otherwise(0))
    bucket = (F.when(count < 7, 0).when(count < 9, 1).when(count < 12, 2).when(count < 13, 3)
              .when(count < 16, 4).when(count == 16, 5).when(count < 20, 6).otherwise(7))
    separator = (F.when(F.regexp_like(value, F.lit("-")), 2).when(F.regexp_like(value, F.lit(r"\.")), 3)
                 .when(F.regexp_like(value, F.lit(r"\x20")), 1).otherwise(0))
    edge = F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise(F.lit(""))
    numbers = {
        "mailbox": F.lit(int(mailbox)), "digits": bucket, "groups": F.least(F.size(groups), F.lit(5)),
        "first": F.least(F.length(F.coalesce(F.get(groups, F.lit(0)), F.lit(""))), F.lit(5)),
        "last": F.least(F.length(F.coalesce(F.get(groups, F.size(groups) - 1), F.lit(""))), F.lit(5)),
        "separator": separator, "paren": F.regexp_like(value, F.lit(r"[(\[]")).cast("int"), "context": where,
        "before": _side(edge), "after": _side(F.substring(text, span["end"] + 1, F.lit(1))),
    }
    return F.struct(*[numbers[name].cast("int").alias(name) for name in FEATURES])


def candidates(text: Column) -> Column:
    """Generated spans with their features: array of (start, end, kind, features)."""
    def of(kind: str, pattern: str) -> Column:
        return F.transform(found(text, pattern), lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            _features(text, s, kind == "mailbox").alias("features")))

    return F.concat(of("mailbox", MAILBOX), of("number", NUMBER))


def _overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, a column per base kind, ``base`` (all of them), ``more`` (candidates with ``valid``)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns(base_spans(F.col("text"))).withColumn("made", candidates(F.col("text")))
    docs = docs.withColumn("base", F.concat(*KINDS))
    return docs.withColumn("more", F.transform("made", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"),
        c["features"].alias("features"), _overlaps(c, F.col("base")).alias("valid")))).drop("made")


def shaped(features: Column) -> Column:
    """Candidates that are personal data by format and context, whether a base kind validates them or not:
    written-out mailboxes, numbers with an area code in brackets or in 3-3-4 digits, numbers after a word for phones."""
    grouped = (features["paren"] == 1) & (features["groups"] >= 3) & (features["last"] >= 3)
    plain = (features["groups"] == 3) & (features["first"] == 3) & (features["last"] == 4) & (features["digits"] == 2)
    area = (features["paren"] == 1) & (features["first"] == 3) & (features["digits"] == 2)
    return F.when(features["mailbox"] == 1, features["paren"] == 1).otherwise(
        features["digits"].between(1, 4) & (grouped | plain | area | (features["context"] == 1)))


def train(found_in: DataFrame) -> tuple[Trees, dict[str, float]]:
    """Trees and each kind's calibrated threshold, from how often each cell of features is positive.

    A candidate counts as positive where it overlaps a validated base span or is
    ``shaped``. All documents are counted. The trees see the CELLS most frequent
    cells; thresholds come from all cells, summed by the score's first three digits.
    """
    cells = stage(found_in.filter("size(more) > 0").select(F.explode("more").alias("c")).groupBy("c.features").agg(
        F.count("*").alias("n"), F.count_if("c.valid").alias("valid"))
        .withColumn("valid", F.when(shaped(F.col("features")), F.col("n")).otherwise(F.col("valid"))), "cells")
    frequent = cells.orderBy(F.desc("n"), "features").limit(CELLS).collect()
    rows = np.array([list(c.features) for c in frequent for _ in (0, 1)], np.float32).reshape(-1, len(FEATURES))
    labels = np.array([y for _ in frequent for y in (1, 0)], float)
    weights = np.array([w for c in frequent for w in (c.valid, c.n - c.valid)], float)
    model = fit(rows[weights > 0], labels[weights > 0], trees=24, depth=3, rate=0.3, weights=weights[weights > 0])
    limits = dict.fromkeys(MORE, 2.0)
    if not frequent:
        return model, limits
    steps = (cells.groupBy(F.col("features.mailbox").alias("mailbox"),
                           F.floor(score(model, F.col("features")) * 1000).alias("step"))
             .agg(F.sum("n").alias("n"), F.sum("valid").alias("valid")).orderBy(F.desc("step")).collect())
    for kind in MORE:
        own = [r for r in steps if r.mailbox == int(kind == "mailbox")]
        share = (np.cumsum([r.valid for r in own]) + 1) / (np.cumsum([r.n for r in own]) + 2)
        enough = np.flatnonzero(share >= PRECISION)
        if len(enough):
            limits[kind] = own[enough[-1]].step / 1000
    return model, limits


def score(model: Trees, features: Column) -> Column:
    """The model as a SQL expression: one nested CASE per tree, summed, through the logistic function."""
    inner = model.feature.shape[1] if len(model.feature) else 0

    def node(tree: int, at: int) -> Column:
        if at >= inner:
            return F.lit(float(model.leaf[tree, at - inner]))
        limit = float(model.above[tree, at])
        if np.isinf(limit):
            return node(tree, 2 * at + 1)
        name = FEATURES[int(model.feature[tree, at])]
        return F.when(features[name] <= limit, node(tree, 2 * at + 1)).otherwise(node(tree, 2 * at + 2))

    total = F.lit(float(model.base))
    for tree in range(len(model.feature)):
        total = total + node(tree, 0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, text, the spans of each base kind and ``added``: (start, end, kind, score).

    Base spans are those that validate. The method adds candidates that overlap
    none of them and whose score reaches their kind's threshold; with nothing to learn
    from, none. Null text counts as empty and has no spans; repeated rows are
    searched each; other columns are ignored; no rows give no rows.
    """
    prepared(docs.sparkSession)
    rows = marked(docs)
    model, limits = train(rows)
    fresh = F.filter("more", lambda c: ~c["valid"])
    scored = F.transform(fresh, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"),
        score(model, c["features"]).alias("score")))
    added = F.filter(scored, lambda c: c["score"] >= F.when(
        c["kind"] == "mailbox", limits["mailbox"]).otherwise(limits["number"]) - 1e-12)
    return rows.select("doc_id", "text", *KINDS, added.alias("added"))


def redacted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every span found replaced by its kind in brackets."""
    spans = personal_data(docs)

    def named(column: str, kind) -> Column:
        return F.transform(column, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind")))

    base = [named(k, lambda s, k=k: F.lit(k)) for k in KINDS]
    every = F.array_sort(F.concat(*base, named("added", lambda s: s["kind"])))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(state, s):
        gap = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.when(s["start"] >= state["at"], F.struct(
            s["end"].alias("at"), F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]")).alias("out"))).otherwise(
            F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out")))

    kept = F.aggregate(every, zero, step, lambda s: F.concat(
        s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return spans.select("doc_id", kept.alias("text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = personal_data(table(spark, sf_dir, "documents"))

    def named(column, kind) -> Column:
        return F.transform(column, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string")))

    base = F.concat(*[named(k, lambda s, k=k: F.lit(k)) for k in KINDS])

    def added(kind: str) -> Column:
        return named(F.filter("added", lambda s: s["kind"] == kind), lambda s: s["kind"])

    more = F.concat(*[added(kind) for kind in MORE])
    return spans.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", base, more).alias("spans"))
