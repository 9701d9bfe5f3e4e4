import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import words
from tidemill.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


TEXTS = ["", "a", "Hello world", "<|endoftext|> is special", "x" * 5000, " " * 7000 + "end", "é ü 漢字 ​ 🎉",
         "tabs\t\tand\n\n\nlines  ", "it's I'll don't 123 4567 !!??", "\x00\x01", "a" + " " * 2500]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizer_s(tokenizer, text):
    assert packing.encode(text, PATH).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_checksums_of_any_cut():
    ids = np.random.default_rng(1).integers(0, 50257, 1003).astype("<u4")
    crcs = packing.checkpoints(ids)
    for start in range(0, 1003, packing.STEP):
        for end in (*range(start + packing.STEP, 1003, 200), 1003):
            if end % packing.STEP and end != 1003:
                continue
            after = crcs[-1] if end == 1003 else crcs[end // packing.STEP]
            want = zlib.crc32(ids[start:end].tobytes())
            assert packing.crc_between(int(crcs[start // packing.STEP]), int(after), 4 * (end - start)) == want


def verify(pairs, got, tokenizer):
    """Every id in one piece, pieces without gaps in their sequences; returns the share of padding."""
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in pairs]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    by_doc = defaultdict(list)
    for (doc, _), x in zip(pairs, ids, strict=True):
        by_doc[doc, len(x)].append(x)
    assert set(pieces) == set(by_doc)
    for key, texts in by_doc.items():
        want = sum(map(len, texts))
        assert sum(r.length for r in pieces[key]) == want and all(r.length > 0 for r in pieces[key])
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[key], key=lambda r: r.start):
                assert r.start == at and zlib.crc32(texts[0][at:at + r.length].tobytes()) == r.ids_crc32
                at += r.length
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return padding / max(1, sum(map(len, ids)))


def test_nothing_is_lost(docs, tokenizer):
    pairs = list(enumerate(TEXTS)) + [(None, "null id"), (None, None), (50, "twice"), (50, "twice"), (51, None)]
    verify(pairs, packing.pack(docs(pairs), PATH).collect(), tokenizer)
    assert packing.pack(docs([]), PATH).count() == 0


def test_little_padding_and_an_even_mixture(spark, tokenizer, monkeypatch):
    rng = random.Random(2)
    pairs = [(i, words(rng, rng.randrange(1, 900))) for i in range(600)]
    source = {i: "hot" if i % 3 else f"s{i % 4}" for i, _ in pairs}
    df = spark.createDataFrame([(i, t, source[i]) for i, t in pairs], "doc_id long, text string, source string")
    monkeypatch.setattr(packing, "QUEUE_ROWS", 50)
    got = packing.pack(df.repartition(5), PATH).collect()
    assert verify(pairs, got, tokenizer) < 0.01
    # Every stretch of the packed tokens holds the sources in about their shares.
    total = sum(r.length for r in got)
    share = sum(r.length for r in got if source[r.doc_id] == "hot") / total
    order = sorted({r.sequence_id for r in got})
    for begin in range(0, len(order) - 40, 40):
        part = set(order[begin:begin + 40])
        here = [r for r in got if r.sequence_id in part]
        own = sum(r.length for r in here if source[r.doc_id] == "hot") / sum(r.length for r in here)
        assert abs(own - share) < 0.12


def test_weights_set_the_mixture(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 300), "a" if i % 2 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, PATH, weights={"a": 0.75, "b": 0.25}).collect()
    source = {i: s for i, _, s in rows}
    early = sorted({r.sequence_id for r in got})[:60]
    here = [r for r in got if r.sequence_id in set(early)]
    own = sum(r.length for r in here if source[r.doc_id] == "a") / sum(r.length for r in here)
    assert 0.65 < own < 0.85
