import random
import re

import public_tokenizers
import pytest

from tidemill.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", " ", "  ", "\n", " \n", "a  ", "  a", "'", "'r", "'re", "'ll'l 'sx it's' x'v", "hello world's we've I'm",
       "  x  \n\n y　　z é'll 'l", "日本語テキスト 123 456", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endof",
       "\U0001f600\U0001f600 x́", "\x00\x01", "x" * 255, "x" * 256, "é" * 128, "a b" * 171, "　" * 300 + "a", " " * 700]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in own.encode_batch(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def counted():
    first, kinds = tc.character_classes(PATH)
    special = re.compile(b"|".join(re.escape(s.encode()) for s in tc.special_strings(PATH)))

    def count(texts, machine=None):
        machine = machine or tc._machine(PATH)
        return tc.count_tokens([t.encode() for t in texts], machine, first, kinds, special).tolist()
    return count


def test_odd_texts(counted, library):
    assert counted(ODD) == library(ODD)
    for text in ODD:  # whatever else is in the batch
        assert counted([text]) == library([text])


@pytest.mark.parametrize("letters", [
    "ab", "aeth ", "'srtlvedm ", "0123 a'", "éü日本 　x'", "\n\t a'!?r", "abcdefghijklmnopqrstuvwxyz ABC'.,-", "=-_/*# a"])
def test_random_texts(counted, library, letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(700))) for _ in range(120)]
    assert counted(texts) == library(texts)


def test_characters_of_all_planes(counted, library):
    rng = random.Random(3)
    places = [(0x20, 0x7f), (0x80, 0x3000), (0x3000, 0xd800), (0xe000, 0x110000)]
    texts = ["".join(chr(rng.randrange(*rng.choice(places))) for _ in range(300)) for _ in range(60)]
    assert counted(texts) == library(texts)


def test_a_long_piece_passes_through_all_chunks(counted, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice("etaoin") for _ in range(40_000)), "ab" * 30_000, "x" + " " * 20_000]
    assert counted(texts + ODD) == library(texts + ODD)


def test_states_are_forgotten_and_found_again(counted, library, monkeypatch):
    monkeypatch.setattr(tc, "STATES", 50)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde th") for _ in range(900)) for _ in range(60)]
    machine = tc.PieceMachine(PATH)
    assert counted(texts, machine) == library(texts)
    assert len(machine.entries) < 5_000


def test_classes_are_the_tokenizers_own():
    from tokenizers import Tokenizer
    split = Tokenizer.from_file(PATH).pre_tokenizer.pre_tokenize_str
    first, kinds = tc.character_classes(PATH)
    rng = random.Random(6)
    points = [p for p in (rng.randrange(128, 0x110000) for _ in range(4000)) if not 0xD800 <= p < 0xE000]
    points += [0x85, 0xa0, 0x2028, 0x3000, 0xfeff]
    for point in points:
        kind = kinds[first.searchsorted(point, side="right") - 1]
        joined = [lead for lead in "a1!" if len(split(lead + chr(point))) == 1]
        assert joined == {tc.LETTER: ["a"], tc.NUMBER: ["1"], tc.OTHER: ["!"], tc.SPACE: []}[kind]


def test_scan_composes_maps():
    import numpy as np
    rng = np.random.default_rng(1)
    maps = rng.integers(0, 12, (37, 12))
    begins = np.array([0, 1, 5, 30])
    want, state = [], 0
    for i, row in enumerate(maps):
        state = row[tc.FRESH if i in begins else state]
        want.append(state)
    assert tc.scan(maps, begins).tolist() == want


def test_documents(spark, docs, library):
    rng = random.Random(7)
    texts = [*ODD, None, None, *("".join(rng.choice("the of x\n") for _ in range(rng.randrange(4000))) for _ in range(30))]
    pairs = list(enumerate(texts)) + [(3, "twice"), (3, "twice"), (None, "no id")]
    got = tc.token_counts(docs(pairs), PATH, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 100)
            for (i, t), n in zip(pairs, library([t or "" for _, t in pairs]), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert tc.token_counts(docs([]), PATH).count() == 0


def test_other_kinds_of_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tc.special_strings(public_tokenizers.path("word_bpe_49k.json"))
