import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import fim

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ODD = ["", None, " ", "\n\n", "a", " a", "a ", " a ", "a b", "é　ü  x", "one\x00two three", "a<P>b c", "x <S> y",
       "<M>", "<P", "<S <M <", "< <S ><P", "\x1c\x85 b", "w" * 3000 + " v" * 900 + " " * 4000 + "end"]


def by_hand(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(rng, count):
    letters = ["a", "bc", "é", "　", "\U0001f600", " ", "  ", "\n", "\t\x0b", "w" * 40]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(400))) for _ in range(count)]


def test_index_finds_every_boundary():
    rng = random.Random(1)
    some = [t or "" for t in ODD] + texts(rng, 200) + ["x" * (1 << i) + " y" for i in range(16)]
    offsets, first = fim.boundaries(pa.array(some))
    index = fim.RankIndex.fit(offsets, first)
    assert len(index.begin) < len(offsets) / 4 and np.abs(index.residual.astype(int)).max() <= fim.ERROR
    for i, text in enumerate(some):
        ends = np.cumsum([0, *map(len, UNITS.findall(text))])
        ranks = np.arange(len(ends))
        assert index.cut(np.full(len(ends), i), ranks).tolist() == ends.tolist()
        assert len(ends) == (list(first) + [len(offsets)])[i + 1] - first[i]


def test_steep_texts_are_split_until_exact():
    text = "".join(("w" * (1 << (i % 14))) + " " for i in range(500))
    offsets, first = fim.boundaries(pa.array([text, "a b"]))
    index = fim.RankIndex.fit(offsets, first)
    assert len(index.begin) > 20
    assert index.cut(np.zeros(len(offsets) - 3, int), np.arange(len(offsets) - 3)).tolist() == offsets[:-3].tolist()


def test_documents(spark, docs):
    rng = random.Random(2)
    pairs = [(i, t) for i, t in enumerate(ODD * 8 + texts(rng, 150))]
    pairs += [(5, "same id, other text"), (5, "same id, other text"), (None, "no id at all"), (-3, "a b c d e")]
    got = fim.fill_in_middle(docs(pairs))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = sorted((by_hand(*p) for p in pairs), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {row[2] for row in want} == {"plain", "psm", "spm"}
    back = got.select("doc_id", fim.restored(got["output"], got["form"]).alias("t"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in pairs), key=repr)
    assert fim.fill_in_middle(docs([])).count() == 0


@pytest.mark.parametrize("rate, first, forms", [(100, 100, {"spm"}), (100, 0, {"psm"}), (0, 50, {"plain"})])
def test_shares(spark, docs, rate, first, forms):
    got = fim.fill_in_middle(docs([(i, "some words here") for i in range(20)]), rate=rate, suffix_first=first)
    assert {r["form"] for r in got.collect()} == forms
