"""Secret scans: credentials by pattern, and weak parts linked with what completes them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import prepared, table

BASE = ("assign", "access", "hex")
#: Weak parts: reported only where what completes them stands within REACH code points
#: in the same scope (a stretch without a blank line).
WEAK = ("key", "user", "endpoint")
REACH = 300
#: Bits per character a key must have at least, by its own letters' frequencies.
ENTROPY = 3.5

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                     re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# Possessive loops: what follows can't use what they would give back.
_KEY = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/_-]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])")
_USER = re.compile(r"(?<![A-Za-z0-9_])(?:user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*"
                   r"[\"']?([A-Za-z0-9_.@-]{3,}+)", re.IGNORECASE | re.ASCII)
_URL = re.compile(r"://[^\s\"'<>]{4,}+")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+")
_HOST = re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}(?![0-9])", re.ASCII)
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")

# What any part needs, cheap to test on a whole batch of texts: it may let through more, never less.
_MAY = (r"(?i)password|passwd|secret|token|api_?key|akia|[0-9a-f]{24}|[a-z0-9+/_-]{32}|://|:[0-9]{2}|"
        r"user|login|account|client|access")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs from the first letter of their scheme on, and hosts with a port that aren't inside one."""
    urls = []
    for m in _URL.finditer(text):
        start = m.start()
        while start > 0 and text[start - 1] in _SCHEME:
            start -= 1
        while start < m.start() and not text[start].isalpha():
            start += 1
        if m.start() - start >= 2:
            urls.append((start, m.end()))
    ends = np.array([end for _, end in urls])
    hosts = []
    for m in _HOST.finditer(text):
        at = int(np.searchsorted(ends, m.start(), side="right"))  # the first URL that ends behind it
        if at == len(urls) or m.start() < urls[at][0]:
            hosts.append((m.start(), m.end()))
    return urls + hosts


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    """Parts that mean nothing alone: mixed high-entropy keys, user names, endpoints."""
    found = [("key", m.start(), m.end()) for m in _KEY.finditer(text)
             if re.search("[a-z]", m.group()) and re.search("[A-Z]", m.group()) and re.search("[0-9]", m.group())
             and entropy(m.group()) >= ENTROPY]
    found += [("user", m.start(1), m.end(1)) for m in _USER.finditer(text)]
    return found + [("endpoint", start, end) for start, end in endpoints(text)]


def meets(spans: np.ndarray, others: np.ndarray, scope: np.ndarray) -> np.ndarray:
    """Which of the (start, end) spans have one of the others within REACH in the same scope.

    An interval join on sorted starts and ends: no pairs are made.
    """
    if not len(spans) or not len(others):
        return np.zeros(len(spans), dtype=bool)
    low = np.searchsorted(scope, spans[:, 0], side="right")
    edges = np.concatenate([[0], scope, [np.iinfo(np.int64).max]])
    begin = np.maximum(edges[low], spans[:, 0] - REACH)
    end = np.minimum(edges[low + 1], spans[:, 1] + REACH)
    starts, ends = np.sort(others[:, 0]), np.sort(others[:, 1])
    return np.searchsorted(starts, end, side="left") > np.searchsorted(ends, begin, side="right")


def linked_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the weak parts that complementary parts confirm.

    A key needs an identifier (access id or user name), a user name needs a
    secret (assignment, hex or key), an endpoint needs both. A weak part that
    overlaps a base span is that span's and not reported again.
    """
    base = base_spans(text)
    weak = weak_parts(text)
    if not weak:
        return base, []

    def at(spans):
        return np.array([s[1:] for s in spans], dtype=np.int64).reshape(-1, 2)

    held = at(base)
    starts, ends = np.sort(held[:, 0]), np.sort(held[:, 1])
    weak = [s for s in weak if np.searchsorted(starts, s[2]) <= np.searchsorted(ends, s[1], side="right")]
    scope = np.array([m.end() for m in _BLANK_LINE.finditer(text)], dtype=np.int64)
    users = at([s for s in weak if s[0] == "user"] + [s for s in base if s[0] == "access"])
    secrets = at([s for s in weak if s[0] == "key"] + [s for s in base if s[0] in ("assign", "hex")])
    places = at(weak)
    by_user, by_secret = meets(places, users, scope), meets(places, secrets, scope)
    needs = {"key": by_user, "user": by_secret, "endpoint": by_user & by_secret}
    more = [s for i, s in enumerate(weak) if needs[s[0]][i]]
    return base, sorted(more, key=lambda s: (s[1], WEAK.index(s[0]), s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
SCHEMA = ("doc_id long, base array<struct<kind:string,start:long,end:long,value:string>>, "
          "linked array<struct<kind:string,start:long,end:long,value:string>>")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        likely = pc.fill_null(pc.match_substring_regex(texts, _MAY), False).to_pylist()
        base, more = [], []
        for text, may in zip(texts, likely, strict=True):
            text = text.as_py() if may else ""
            found = linked_spans(text) if may else ([], [])
            for out, spans in zip((base, more), found, strict=True):
                out.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in spans])
        kind = pa.list_(_SPAN)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(base, kind), pa.array(more, kind)], ["doc_id", "base", "linked"])


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, linked): the spans of every document, in code points, ends exclusive.

    Base spans match alone; linked ones are weak parts with complementary parts
    in reach (``linked_spans``). Null text counts as empty and has none. Repeated
    rows are scanned each; other columns are ignored; no rows give no rows.
    """
    prepared(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan, SCHEMA)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))

    def joined(column):
        return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    order = F.create_map(*[F.lit(x) for i, k in enumerate(BASE + WEAK) for x in (k, i)])
    every = F.array_sort(F.transform(F.concat("base", "linked"), lambda s: F.struct(
        s["start"].alias("start"), F.element_at(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined(every).alias("spans"))
