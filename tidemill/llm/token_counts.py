"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers read the bytes of a text one after the other. The first,
of twelve states, marks where a piece (a word with its blank, a number, a run of
marks or blanks) begins. The second reads pieces: after each byte its state
knows how the bytes so far are encoded, and the transition is annotated with by
how much the number of tokens changes. Texts are cut into chunks of equal length that are read
side by side; what a chunk does to a state is a map, and the maps of a text's
chunks compose by a parallel prefix scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import prepared, table

#: Bytes of a chunk.
CHUNK = 256
#: States of the piece transducer a process holds; beyond them it begins anew with those in use.
STATES = 200_000
#: Documents with more tokens are over the limit.
LIMIT = 512
#: Below so many chunks at once bytes are read one by one.
FEW = 24

# Classes of symbols for the first transducer. The letters of 's 't 'm 'd 're 've 'll stand apart;
# INNER is a byte inside a character, END the end of a text or a special token.
LETTER, SINGLE, R, V, L, E, NUMBER, BLANK, SPACE, QUOTE, OTHER, INNER, END = range(13)
# Its states: a piece begins whatever follows; inside letters, numbers, marks; one blank or space, or
# several, the last one named; a quote that begins a piece, and that with r, v or l.
(FRESH, LETTERS, NUMBERS, MARKS, ONE_BLANK, MORE_BLANK, ONE_SPACE, MORE_SPACE,
 QUOTED, QUOTED_R, QUOTED_V, QUOTED_L) = range(12)
BEGINS, BEFORE = 1, 2  # a piece begins at this character; at the one before it
_LETTERS = (LETTER, SINGLE, R, V, L, E)


def _word_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and marks for every state and class, as flat arrays."""
    following = np.zeros((12, 13), dtype=np.uint8)
    marks = np.zeros((12, 13), dtype=np.uint8)
    runs = {**{c: LETTERS for c in _LETTERS}, NUMBER: NUMBERS, OTHER: MARKS, QUOTE: MARKS}
    opening = {**runs, QUOTE: QUOTED, BLANK: ONE_BLANK, SPACE: ONE_SPACE, END: FRESH}
    done = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}
    for state in range(12):
        for kind, begun in opening.items():
            to, mark = begun, BEGINS
            if state in (LETTERS, NUMBERS, MARKS) and runs.get(kind) == state:
                to, mark = state, 0
            elif state in (ONE_BLANK, MORE_BLANK, ONE_SPACE, MORE_SPACE):
                more = state in (MORE_BLANK, MORE_SPACE)
                if kind in (BLANK, SPACE):
                    to, mark = (MORE_BLANK if kind == BLANK else MORE_SPACE), 0
                elif kind != END:
                    # The last of several goes alone or, a blank, with what follows.
                    mark = BEFORE if more else 0
                    if state in (ONE_BLANK, MORE_BLANK):
                        to = runs[kind]
                    else:
                        mark |= BEGINS
            elif state == QUOTED:
                if kind == SINGLE:
                    to, mark = FRESH, 0
                elif kind in (R, V, L):
                    to, mark = {R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], 0
                elif kind in (OTHER, QUOTE):
                    to, mark = MARKS, 0
            elif state in done:
                if kind == done[state]:
                    to, mark = FRESH, 0
                elif kind in _LETTERS:
                    to, mark = LETTERS, BEFORE
                else:
                    mark = BEGINS | BEFORE
            following[state, kind], marks[state, kind] = to, mark
        following[state, INNER] = state
    return following.reshape(-1), marks.reshape(-1)


_FOLLOWING, _MARKS = _word_machine()


@cache
def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def character_classes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(first code point, class) of every run of code points of one class, by the tokenizer's own rules.

    Libraries differ in their version of Unicode, so the file's pre-tokenizer is asked.
    """
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    probes = (("a", LETTER), ("1", NUMBER), ("!", OTHER))
    kinds = np.full(0x110000, SPACE, dtype=np.uint8)

    def fill(begin: int, end: int) -> None:
        """Blocks that stay one piece behind a probe are of one class; others are halved."""
        text = "".join(map(chr, range(begin, end)))
        for lead, kind in probes:
            if len(split(lead + text)) == 1:
                kinds[begin:end] = kind
                return
        if end - begin > 1:
            middle = (begin + end) // 2
            fill(begin, middle)
            fill(middle, end)

    for begin in range(0, 0x110000, 256):
        if not 0xD800 <= begin < 0xE000:
            fill(begin, begin + 256)
    for letters, kind in (("stmd", SINGLE), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", BLANK)):
        for letter in letters:
            kinds[ord(letter)] = kind
    first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    return first.astype(np.int32), kinds[first]


def special_strings(path: str) -> list[str]:
    """The added tokens of the file; raises where it isn't a plain byte-level BPE."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec["pre_tokenizer"] or {}
    odd = [t for t in spec["added_tokens"]
           if t["single_word"] or t["lstrip"] or t["rstrip"] or t.get("normalized")]
    model = spec["model"]
    if (model["type"] != "BPE" or spec["normalizer"] or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("ignore_merges") or odd):
        raise ValueError(f"{path} is not a plain byte-level BPE")
    return [t["content"] for t in spec["added_tokens"]]


class PieceMachine:
    """The transducer of pieces, with its states and transitions built as texts reach them.

    The encoding of a piece is the one sequence of tokens in which any two
    neighbours stay apart when encoded alone. So the last token after each byte
    follows from the last token before it. A state holds, for every
    suffix of the bytes read that begins some token, its place in the tree of
    tokens, the last token ahead of the suffix, and how many tokens fewer there are up to that.
    """

    DEAD, START, PAD = 0, 1, 256

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = _byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.ids = {token: i for token, i in model["vocab"].items() if len(token) == 1 or token in made}
        size = max(self.ids.values()) + 1
        self.born = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.pair = {}
        for at, (a, b) in enumerate(merges):
            a, b, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.pair.setdefault((a, b), at)
            if self.left[whole] == whole:  # the first merge that makes it
                self.born[whole], self.left[whole], self.right[whole] = at, a, b
        self._whole: dict[int, bool] = {}
        # The tree of tokens: children by node and byte, the token that ends at a node.
        self.child: dict[int, int] = {}
        self.token, self.grows = [-1], [True]
        for text, token in self.ids.items():
            node = 0
            for letter in text:
                key = node << 8 | letters[letter]
                self.grows[node] = True
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
            if self.whole(token):
                self.token[node] = token
        self._clear()

    def _clear(self) -> None:
        self.entries: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.side: dict[int, bool] = {}
        # Transitions by state and symbol, in open addressing: few of a state's symbols ever occur.
        self.bits, self.held = 16, 0
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.int32)
        self._state(())
        self._state(((0, -1, 0),))

    def apart(self, a: int, b: int, until: int = 1 << 60) -> bool:
        """Whether no merge joins the end of ``a`` with the begin of ``b`` before ``until``.

        Goes back through the merges that made both. A merge across comes too late
        where an end has merged inside its token by then; of equal merges the left one is first.
        """
        end_a = end_b = until
        while True:
            at = self.pair.get((a, b))
            if at is not None and at < end_a and (at < end_b or at == end_b < until):
                return False
            if self.born[a] > self.born[b]:
                end_a, a = self.born[a], self.right[a]
            elif self.born[b] >= 0:
                end_b, b = self.born[b], self.left[b]
            else:
                return True

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as that token."""
        found = self._whole.get(token)
        if found is None:
            a, b = self.left[token], self.right[token]
            found = a == token or (self.whole(a) and self.whole(b) and self.apart(a, b, self.born[token]))
            self._whole[token] = found
        return found

    def _state(self, key: tuple) -> int:
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.entries)
            self.entries.append(key)
        return state

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The transitions from the states, -1 where one isn't known yet. DEAD stays, a text's end leads there."""
        keys = states << 9 | symbols
        at = self._slots(keys)
        values, there = self.values[at], self.keys[at]
        other = np.flatnonzero((there != keys))
        last = (1 << self.bits) - 1
        while len(other):  # taken by another key: the next place
            empty = self.keys[at[other]] < 0
            values[other[empty]] = -1
            other = other[~empty]
            at[other] = (at[other] + 1) & last
            same = self.keys[at[other]] == keys[other]
            values[other[same]] = self.values[at[other[same]]]
            other = other[~same]
        values[(states == self.DEAD) | (symbols == self.PAD)] = 128
        return values

    def _add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Enter new transitions; at most half of the places are taken."""
        self.held += len(keys)
        if self.held * 2 > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while self.held * 2 > 1 << self.bits:
                self.bits += 1
            self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
            self.values = np.zeros(1 << self.bits, dtype=np.int32)
        at, last = self._slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one place one is entered
            self.values[at[free]] = values[free]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & last

    def _step(self, state: int, byte: int) -> int:
        """A new transition: the next state and, in the low byte, the change of the count plus 128."""
        grown, token, count = [], -1, 0
        for node, last, n in self.entries[state]:
            child = self.child.get(node << 8 | byte)
            if child is None:
                continue
            if self.grows[child]:
                grown.append((child, last, n))
            ending = self.token[child]
            if token < 0 <= ending:
                fits = True
                if last >= 0:
                    key = last << 20 | ending
                    fits = self.side.get(key)
                    if fits is None:
                        fits = self.side[key] = self.apart(last, ending)
                if fits:
                    token, count = ending, n + 1
        key = tuple([(node, last, n - count) for node, last, n in grown] + [(0, token, 0)])
        return self._state(key) << 8 | (count + 128)

    def _room(self, states: np.ndarray) -> np.ndarray:
        """Forget all but the states in use once there are too many; returns their new numbers."""
        if len(self.entries) <= STATES:
            return states
        used, back = np.unique(states, return_inverse=True)
        keys = [self.entries[s] for s in used]
        self._clear()
        return np.array([self._state(k) for k in keys], dtype=np.int64)[back]

    def _fill(self, states: np.ndarray, symbols: np.ndarray) -> None:
        pairs = np.unique(states << 9 | symbols)
        self._add(pairs, np.array([self._step(pair >> 9, pair & 511) for pair in pairs.tolist()], dtype=np.int32))

    def bodies(self, symbols: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read all chunks, columns of the arrays, from their first piece on: last states and counts."""
        states = np.zeros(symbols.shape[1], dtype=np.int64)
        counts = np.zeros(symbols.shape[1], dtype=np.int64)
        for row, begin in zip(symbols, begins, strict=True):
            states = self._room(states)
            np.copyto(states, self.START, where=begin)
            states = self._advance(states, row, counts)
        return states, counts

    def _advance(self, states: np.ndarray, row: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = self.find(states, row)
        if values.min(initial=0) < 0:
            missing = np.flatnonzero(values < 0)
            self._fill(states[missing], row[missing].astype(np.int64))
            values[missing] = self.find(states[missing], row[missing])
        counts += (values & 255) - 128
        return (values >> 8).astype(np.int64)

    def heads(self, symbols: np.ndarray, lengths: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read the first ``lengths`` bytes of chunks from the given states: last states and counts."""
        if len(states) < FEW:
            ends, counts, moves = [], [], {}
            for column, (length, state) in enumerate(zip(lengths.tolist(), states.tolist(), strict=True)):
                total = 0
                for symbol in symbols[:length, column].tolist():
                    value = moves.get(state << 9 | symbol)
                    if value is None:
                        value = moves[state << 9 | symbol] = self._step(state, symbol)
                    state = value >> 8
                    total += (value & 255) - 128
                ends.append(state)
                counts.append(total)
            return np.array(ends, dtype=np.int64), np.array(counts, dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        symbols, lengths, states = symbols[:, order], lengths[order], states[order]
        counts = np.zeros(len(states), dtype=np.int64)
        for place in range(int(lengths[0])):
            active = int(np.searchsorted(-lengths, -place, side="left"))  # longer than ``place``
            states[:active] = self._advance(states[:active], symbols[place, :active], counts[:active])
        ends, totals = np.empty_like(states), np.empty_like(counts)
        ends[order], totals[order] = states, counts
        return ends, totals


@lru_cache(maxsize=2)
def _machine(path: str) -> PieceMachine:
    return PieceMachine(path)


def _classes_of(raw: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The class of every byte: a character's at its first byte, INNER at the others; END for byte 255."""
    plain = np.empty(256, dtype=np.uint8)
    plain[:128] = kinds[np.searchsorted(first, np.arange(128), side="right") - 1]
    plain[128:192], plain[192:] = INNER, END
    out = plain[raw]
    lead = np.flatnonzero((raw >= 0xC0) & (raw < 0xFF))
    if len(lead):
        ahead = np.stack([raw[np.minimum(lead + i, len(raw) - 1)] for i in range(4)]).astype(np.int32)
        low = ahead[1:] & 63
        points = np.where(
            ahead[0] < 0xE0, (ahead[0] & 31) << 6 | low[0],
            np.where(ahead[0] < 0xF0, (ahead[0] & 15) << 12 | low[0] << 6 | low[1],
                     (ahead[0] & 7) << 18 | low[0] << 12 | low[1] << 6 | low[2]))
        out[lead] = kinds[np.searchsorted(first, points, side="right") - 1]
    return out


def scan(maps: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Prefix composition of the chunks' maps: each chunk's last state, texts beginning at FRESH.

    ``maps[k, s]`` is the state chunk ``k`` leads to from ``s``; the first map of a text is made
    constant, so nothing passes from text to text. Log-many rounds, all chunks at once.
    """
    maps = maps.copy()
    maps[begins] = maps[begins, FRESH][:, None]
    width = 1
    while width < len(maps):
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width], axis=1)
        width *= 2
    return maps[:, 0]


def count_tokens(texts: list[bytes], machine: PieceMachine, first: np.ndarray, kinds: np.ndarray,
                 special: re.Pattern | None) -> np.ndarray:
    """The number of tokens of every text (UTF-8)."""
    if special:
        texts = [special.sub(b"\xff", text) if special.search(text) else text for text in texts]
    sizes = np.array([len(text) for text in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    # Every text begins a chunk and has room for its end.
    chunks = sizes // CHUNK + 1
    total = int(chunks.sum())
    opens = np.cumsum(chunks) - chunks
    place = np.arange(len(raw)) + np.repeat(opens * CHUNK - (np.cumsum(sizes) - sizes), sizes)

    def grid(values: np.ndarray, rest: int, kind) -> np.ndarray:
        out = np.full(total * CHUNK, rest, dtype=kind)
        out[place] = values
        return out

    classes = grid(_classes_of(raw, first, kinds), END, np.uint8)
    across = np.ascontiguousarray(classes.reshape(total, CHUNK).T)
    # What every chunk does to every state, then the state every chunk begins in.
    states = np.repeat(np.arange(12, dtype=np.uint8)[:, None], total, axis=1)
    for row in across:
        states = _FOLLOWING[states * np.uint8(13) + row]
    last = scan(states.T.astype(np.int64), opens)
    state = np.empty(total, dtype=np.uint8)
    state[1:], state[opens] = last[:-1], FRESH
    marks = np.empty((CHUNK, total), dtype=np.uint8)
    for i, row in enumerate(across):
        at = state * np.uint8(13) + row
        marks[i] = _MARKS[at]
        state = _FOLLOWING[at]
    whole = np.flatnonzero(classes != INNER)  # characters, and what lies behind a text's end
    flat = marks.T.reshape(-1)[whole]
    begun = (flat & BEGINS) > 0
    begun[:-1] |= (flat[1:] & BEFORE) > 0
    begins = np.zeros(total * CHUNK, dtype=bool)
    begins[whole] = begun
    begins = begins.reshape(total, CHUNK)
    symbols = grid(raw, PieceMachine.PAD, np.int16)
    symbols = np.ascontiguousarray(symbols.reshape(total, CHUNK).T)
    return _pieces(machine, symbols, begins, opens)


def _pieces(machine: PieceMachine, symbols: np.ndarray, begins: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Tokens of every text, from its chunks' symbols and where pieces begin.

    From its first piece on, a chunk's map is constant; ahead of that it
    takes up the state of the chunk before. Chunks without any begin of a piece pass their state on.
    """
    total = len(begins)
    some = begins.any(axis=1)
    heads = np.where(some, begins.argmax(axis=1), CHUNK)
    heads[symbols[0] == PieceMachine.PAD] = 0  # nothing of the text is left
    if len(machine.entries) > STATES:
        machine._clear()
    states, counts = machine.bodies(symbols, np.ascontiguousarray(begins.T))
    keys = [machine.entries[s] for s in np.unique(states)]  # states are renumbered when there are too many
    back = np.unique(states, return_inverse=True)[1]
    open_ = np.flatnonzero((heads > 0))
    final = some | (heads == 0)
    while len(open_):
        ready = open_[final[open_ - 1]]
        if len(machine.entries) > STATES:
            machine._clear()
        begin = np.array([machine._state(keys[i]) for i in back[ready - 1].tolist()], dtype=np.int64)
        ends, more = machine.heads(symbols[:, ready], heads[ready], begin)
        counts[ready] += more
        passing = ~some[ready]
        for chunk, end in zip(ready[passing].tolist(), ends[passing].tolist(), strict=True):
            back[chunk] = len(keys)
            keys.append(machine.entries[end])
        final[ready] = True
        open_ = open_[~np.isin(open_, ready)]
    return np.add.reduceat(counts, opens) if total else counts


def _counted(path: str, first: np.ndarray, kinds: np.ndarray, special: list[str]):
    # The longest of the special strings that begin at a place counts.
    wanted = b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        pattern = re.compile(wanted) if wanted else None
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            counts = count_tokens(texts, machine, first, kinds, pattern) if texts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document.

    ``tokenizer`` is a file of a plain byte-level BPE, at the same place on all
    machines; counts are those of its library, without added begin and end
    tokens; a special string inside a text is one token. Null text counts as empty and has
    no tokens; repeated rows are counted each, null ids stay null; other columns are ignored,
    whatever their names. No rows give no rows. A very long text is read in
    chunks like any other; memory stays in proportion to a batch's bytes.
    """
    prepared(docs.sparkSession)
    special = special_strings(tokenizer)
    first, kinds = character_classes(tokenizer)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = docs.mapInArrow(_counted(tokenizer, first, kinds, special),
                              "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
