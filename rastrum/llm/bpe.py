"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order of priority, into one deterministic automaton
whose arcs carry tokens.  It starts with a single state that loops on every base
symbol.  The gadget of a merge (u, v) -> w changes it so: the state that u leads
to is copied without its arc for v, u leads to the copy, and wherever u could be
read w can be read as well, leading to where v led.  What remains accepts a
sequence of tokens if and only if it is what BPE makes of its concatenation.

Copies share what they have in common: a state holds a link to the state that
it was copied from and the arcs that were taken away since.

Encoding a word runs over its symbols from left to right, without turning back.  A
second automaton tells the tokens that end at a place; one of them, and one only,
continues a path of the first from where it begins.  So the last token at a place
depends on the second automaton's state and on the first one's states at the places
that its tokens may begin at.  Both make one state of a deterministic automaton
over symbols, and its transitions are a table by state and symbol, filled as they
meet and begun anew when it is full.  Words new to a worker go through it side by
side, a symbol of each at a time.  Decoding emits the labels of the arcs.

The automaton is compiled once, on the driver, and broadcast: some MB, whatever the
input's size.  No token crosses white space, so texts are cut there as bytes, and
what stands between is normalised, split and encoded once while a worker remembers
it; the table and what workers remember are bounded.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import pickle
import re
import sys
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEVER = 1 << 60
NO_EVENT: tuple[list[int], list[int], list[int]] = ([], [], [])
#: The symbol of a word's end; others are bytes.
END = 256
#: For the table of transitions: an odd factor whose products' upper bits are the place to look at first.
HASH, ALL64 = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: What stands between the ids of one piece and the next while many are looked up at once; no id has its bits.
PART = b"\xff\xff\xff\xff"


def byte_symbols() -> dict[int, str]:
    """Printable stand-ins for the 256 bytes: the byte itself where that is a visible Latin-1 character, else code points from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(visible))
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(rest)}


def category_class(first: str, most: int = sys.maxunicode) -> str:
    """A regular expression class's inside for the code points up to `most` whose general category begins with `first`."""
    ranges, begin = [], None
    for code in range(most + 2):
        inside = code <= most and unicodedata.category(chr(code))[0] == first
        if inside and begin is None:
            begin = code
        elif not inside and begin is not None:
            ranges.append(f"\\U{begin:08x}-\\U{code - 1:08x}")
            begin = None
    return "".join(ranges)


#: The code points that are white space to the tokenizer's patterns.
UNICODE_SPACE = r"\t-\r\x20\x85\xa0  -     　"


class MergeAutomaton:
    """The compiled automaton; state 0 is the start and every state accepts."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], spelling=lambda token: tuple(map(ord, token))):
        self.label = {i: s for s, i in vocabulary.items()}
        self.parent, self.born, self.taken = [-1], [0], [{}]
        before_event, newest = [-1], [0]  # per removed arc the one before it in the state's history; per state its last
        removed = [(-1, -1)]  # token and rank
        self.left: dict[int, tuple[int, int]] = {}  # token -> (token it extends, rank)
        users, self.leads = [1 << 30], {}
        pairs = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
        made = {w for _, _, w in pairs}
        for i in vocabulary.values():
            if i not in made:
                self.leads[i] = 0
        for rank, (u, v, w) in enumerate(pairs):
            if u not in self.leads or v not in self.leads or w in self.leads:
                continue
            before, after = self.leads[u], self.leads[v]
            if not self._permits_now(before, v):
                continue  # v never follows u here: an earlier merge takes it first
            self.leads[w], self.left[w] = after, (u, rank)
            users[after] += 1
            if users[before] > 1:
                users[before] -= 1
                self.parent.append(before)
                self.born.append(rank)
                self.taken.append({})
                users.append(1)
                newest.append(newest[before])
                self.leads[u] = before = len(users) - 1
            self.taken[before][v] = rank
            before_event.append(newest[before])
            removed.append((v, rank))
            newest[before] = len(removed) - 1
        self._begin()
        self._number(before_event, removed, newest)
        self._match({i: spelling(self.label[i]) for i in self.leads})

    def _match(self, spelt: dict[int, tuple[int, ...]]) -> None:
        """The automaton of all tokens' spellings: a trie, for each node the longest suffix that is a node too, and the tokens that end there."""
        self.shift = max((x for s in spelt.values() for x in s), default=0).bit_length()
        self.trie: dict[int, int] = {}
        own, order = [None], [(0, 0, 0)]  # a token per node; node, the one before it, symbol
        for token, symbols in spelt.items():
            node = 0
            for x in symbols:
                key = node << self.shift | x
                if key not in self.trie:
                    self.trie[key] = len(own)
                    order.append((len(own), node, x))
                    own.append(None)
                node = self.trie[key]
            own[node] = (token, len(symbols))
        depth = [0] * len(own)
        for node, before, _ in order[1:]:
            depth[node] = depth[before] + 1
        self.fail = [0] * len(own)
        self.ends: list[tuple] = [()] * len(own)  # (token, length), the longest first
        self.depth = depth
        self.lengths = {t: len(x) for t, x in spelt.items()}
        self.spans = np.zeros(max(spelt, default=-1) + 1, np.int64)  # the lengths again, by token
        self.spans[list(spelt)] = [len(x) for x in spelt.values()]
        for node, before, x in sorted(order[1:], key=lambda o: depth[o[0]]):
            if before:
                self.fail[node] = self._step(self.fail[before], x)
            rest = self.ends[self.fail[node]]
            self.ends[node] = (own[node], *rest) if own[node] else rest

    def _step(self, node: int, x: int) -> int:
        """The longest suffix of the node's string and x that is a node."""
        while (found := self.trie.get(node << self.shift | x)) is None and node:
            node = self.fail[node]
        return found or 0

    def _number(self, before: list[int], removed: list[tuple[int, int]], newest: list[int]) -> None:
        """Numbers the removals so that those in a state's history are the intervals that hold its number.

        No arc is removed twice in one history, so a token's intervals are disjoint
        and bisection finds the one that may hold a number.
        """
        n = len(before)
        size = [1] * n
        for e in range(n - 1, 0, -1):
            size[before[e]] += size[e]
        low, free = [0] * n, [1] * n
        for e in range(1, n):  # what comes before an event has a lower index
            low[e] = free[before[e]]
            free[before[e]] += size[e]
            free[e] = low[e] + 1
        self.when: dict[int, tuple[list[int], list[int], list[int]]] = {}
        for e in sorted(range(1, n), key=low.__getitem__):
            begin, end, rank = self.when.setdefault(removed[e][0], ([], [], []))
            begin.append(low[e])
            end.append(low[e] + size[e])
            rank.append(removed[e][1])
        self.place = [low[e] for e in newest]
        del self.parent, self.born, self.taken

    def permits(self, state: int, token: int) -> bool:
        """Whether `state` has an arc for `token`: no token at its left was removed before the token was made."""
        place, when = self.place[state], NEVER
        while True:
            begin, end, rank = self.when.get(token, NO_EVENT)
            k = bisect_right(begin, place) - 1
            if k >= 0 and place < end[k] and rank[k] <= when:
                return False
            if token not in self.left:
                return True
            token, when = self.left[token]

    def _permits_now(self, state: int, token: int) -> bool:
        """As permits, while the automaton is made: up the chain of copies."""
        when = NEVER
        while True:
            s, t = state, when
            while s >= 0:
                if self.taken[s].get(token, NEVER) <= t and token in self.taken[s]:
                    return False
                t = min(t, self.born[s])
                s = self.parent[s]
            if token not in self.left:
                return True
            token, when = self.left[token]

    #: States of the table of transitions; beyond, it is begun anew.
    STATES = 1 << 18

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("keys", "values", "last", "known", "context")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._begin()

    def _begin(self) -> None:
        self.filled, self.bits = 0, 16
        self._open()
        self.context = [(0, (0,), -1)]  # per state the matched node, the merge automaton's states at its places and the token that ends here
        self.known = {self.context[0]: 0}
        self.last = array("i", [-1])  # the tokens again

    def _open(self) -> None:
        """An empty table of transitions: keys, -1 where there is none, and the states they lead to, by hash and then the next free place."""
        self.keys, self.values = array("q", [-1]) * (1 << self.bits), array("i", [0]) * (1 << self.bits)

    def _next(self, at: int, x: int) -> int:
        """The state that a symbol leads to."""
        key, keys, mask = at << self.shift | x, self.keys, (1 << self.bits) - 1
        h = (key * HASH & ALL64) >> 64 - self.bits
        while (k := keys[h]) != key:
            if k < 0:
                keys[h], self.values[h] = key, (to := self._transition(at, x))
                self.filled += 1
                if 2 * self.filled > len(keys):
                    self._widen()
                return to
            h = h + 1 & mask
        return self.values[h]

    def _widen(self) -> None:
        old, self.bits = [(k, v) for k, v in zip(self.keys, self.values) if k >= 0], self.bits + 1
        self._open()
        keys, values, mask = self.keys, self.values, (1 << self.bits) - 1
        for k, v in old:
            h = (k * HASH & ALL64) >> 64 - self.bits
            while keys[h] >= 0:
                h = h + 1 & mask
            keys[h], values[h] = k, v

    def _nexts(self, wanted: np.ndarray) -> np.ndarray:
        """As _next for many keys, -1 where the table has none."""
        keys, values = np.frombuffer(self.keys, np.int64), np.frombuffer(self.values, np.int32)
        h = ((wanted.astype(np.uint64) * np.uint64(HASH)) >> np.uint64(64 - self.bits)).astype(np.int64)
        found = keys[h]
        to = np.where(found == wanted, values[h], -1)
        open_ = np.flatnonzero((found != wanted) & (found >= 0))
        while len(open_):
            h[open_] = h[open_] + 1 & len(keys) - 1
            at, want = h[open_], wanted[open_]
            found = keys[at]
            same = found == want
            to[open_[same]] = values[at[same]]
            open_ = open_[~same & (found >= 0)]
        return to

    def _transition(self, at: int, x: int) -> int:
        """The state that a symbol leads to, found from both automata."""
        node, places, _ = self.context[at]
        node = self._step(node, x)
        for token, length in self.ends[node]:
            if self.permits(places[-length], token):
                break
        else:
            raise ValueError("a word has no path in the automaton")
        places = (*places, self.leads[token])[-self.depth[node] - 1 :]
        state = node, places, token
        to = self.known.get(state)
        if to is None:
            to = self.known[state] = len(self.last)
            self.last.append(token)
            self.context.append(state)
        return to

    def path(self, symbols: Iterable[int]) -> list[int]:
        """Token ids of one word, given as symbols of the tokens' spellings."""
        if len(self.last) >= self.STATES:
            self._begin()
        step, at, passed = self._next, 0, []
        for x in symbols:
            at = step(at, x)
            passed.append(at)
        ids, end, last, lengths = [], len(passed), self.last, self.lengths
        while end:
            token = last[passed[end - 1]]
            ids.append(token)
            end -= lengths[token]
        return ids[::-1]

    def paths(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of some words, one after the other, and how many there are of each; `ends` are the places after each word's symbols."""
        if len(self.last) >= self.STATES:
            self._begin()
        begins = np.concatenate([[0], ends[:-1]])
        sizes = ends - begins
        order = np.argsort(-sizes, kind="stable")
        starts, reached = begins[order], np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left")
        at, passed = np.zeros(len(ends), np.int64), np.empty(len(symbols), np.int64)
        for k, n in enumerate(reached.tolist()):  # the n longest have a symbol at place k
            where = starts[:n] + k
            keys = at[:n] << self.shift | symbols[where]
            to = self._nexts(keys)
            if len(missing := np.flatnonzero(to < 0)):
                new, which = np.unique(keys[missing], return_inverse=True)
                to[missing] = np.array([self._next(x >> self.shift, x & (1 << self.shift) - 1) for x in new.tolist()])[which]
            at[:n] = passed[where] = to
        last = np.array(self.last, np.int32)[passed]
        ids, before, left = np.full(len(symbols), -1, np.int32), ends.copy(), begins
        counts = np.zeros(len(ends), np.int64)
        words = np.arange(len(ends))
        while len(words):
            token = last[before - 1]
            ids[before - 1] = token
            counts[words] += 1
            before = before - self.spans[token]
            more = before > left
            words, before, left = words[more], before[more], left[more]
        return ids[ids >= 0], counts


class Memory(dict):
    """What was found of late: when `most` are held, those before them go, and what is asked for again comes back."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest, self.before, self.passing = most, longest, {}, []

    def hold(self, keys: Iterable, make) -> None:
        """Holds these keys until it is called again; make(list of keys) gives the values of those not remembered.  Keys over `longest` are then forgotten."""
        for key in self.passing:
            del self[key]
        self.passing = []
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        new = [key for key in keys if key not in self]
        if self.before and new:
            get = self.before.get
            self.update((key, value) for key, value in zip(new, map(get, new)) if value is not None)
            new = [key for key in new if key not in self]
        if new:
            self.update(zip(new, make(new)))
            self.passing = [key for key in new if len(key) > self.longest]


class Encoder:
    """Whole texts to ids and back, for tokenizer files with word ends and byte symbols."""

    #: What a worker remembers of words, and of pieces between white space, of at most LONGEST bytes: twice as many at most.
    WORDS, PIECES, SPELT, LONGEST = 30_000, 120_000, 120_000, 48
    #: Words that go through the automaton side by side, and texts, and about so many bytes of them, whose pieces are looked up together.
    ABREAST, TEXTS, BYTES = 8192, 256, 1 << 20

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        end, byte = model["end_of_word_suffix"], {c: b for b, c in byte_symbols().items()}
        spelling = lambda t: (*(byte[c] for c in t[: -len(end)]), END) if t.endswith(end) else tuple(byte[c] for c in t)
        special = {t["content"] for t in spec["added_tokens"]}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
        self.automaton = MergeAutomaton(vocabulary, [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], spelling)
        added = spec["added_tokens"]
        if any(t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in added):
            raise ValueError("added tokens must be taken as they stand and hold no white space")
        self.special = {t["content"]: t["id"] for t in added}
        self.automaton.label |= {i: s for s, i in self.special.items()}
        if max(self.automaton.label) >= 1 << 24:
            raise ValueError("ids must have 24 bits at most, as bulks are parted by a number of 32 set bits")
        letter, number = category_class("L"), category_class("N")
        self.pattern = f"[{letter}]+|\n|'s|'t|'re|'ve|'m|'ll|'d|[{number}]|[^{UNICODE_SPACE}{letter}{number}]+"
        self.__setstate__(self.__dict__)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("word", "ascii_word", "split", "begin", "words", "pieces", "spelt")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.word = re.compile(self.pattern)
        self.ascii_word = re.compile("[a-z]+|\n|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^ \t-\ra-z0-9]+")
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.begin = os.path.commonprefix(list(self.special)).encode()
        self.words, self.pieces, self.spelt = (Memory(n, self.LONGEST) for n in (self.WORDS, self.PIECES, self.SPELT))

    def of_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words without white space, as packed numbers; PART for the line feeds among them."""
        for at in range(0, len(words), self.ABREAST):
            part = words[at : at + self.ABREAST]
            short = [w for w in part if w != "\n" and len(w) <= self.LONGEST]
            found = {"\n": PART}
            if short:
                symbols = np.frombuffer("\n".join([*short, ""]).encode(), np.uint8).astype(np.int64)
                ends = np.flatnonzero(symbols == 10) + 1
                symbols[ends - 1] = END
                ids, counts = self.automaton.paths(symbols, ends)
                packed, stops = ids.tobytes(), (4 * np.cumsum(counts)).tolist()
                found.update((w, packed[lo:hi]) for w, lo, hi in zip(short, [0, *stops], stops))
            for w in part:
                yield found[w] if w in found else array("I", self.automaton.path((*w.encode(), END))).tobytes()

    def of_lines(self, text: str, word: re.Pattern) -> list[bytes]:
        """Ids of each line of a normalised text without other ASCII white space."""
        found = word.findall(text)
        self.words.hold(set(found), self.of_words)
        return b"".join(map(self.words.__getitem__, found)).split(PART)

    def of_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of what stands between ASCII white space."""
        out: list[bytes] = [b""] * len(pieces)
        plain, other = [], []
        for k, p in enumerate(pieces):
            if self.split and self.begin in p and len(parts := self.split.split(p.decode())) > 1:
                between = iter(self.of_pieces([x.encode() for x in parts[::2]]))
                out[k] = b"".join(array("I", [self.special[x]]).tobytes() if j % 2 else next(between) for j, x in enumerate(parts))
            else:
                (plain if p.isascii() else other).append(k)
        for chosen, word in (plain, self.ascii_word), (other, self.word):
            if chosen:
                text = b"\n".join([pieces[k] for k in chosen]).decode()
                text = text.lower() if word is self.ascii_word else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
                for k, ids in zip(chosen, self.of_lines(text, word)):
                    out[k] = ids
        return out

    def grouped(self, texts: Iterable[bytes | None]) -> Iterator[list[list[bytes]]]:
        """The texts' pieces, some texts at a time."""
        group, size = [], 0
        for text in texts:
            group.append(text.split() if text else [])
            size += len(text or b"")
            if len(group) >= self.TEXTS or size >= self.BYTES:
                yield group
                group, size = [], 0
        if group:
            yield group

    def packed(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """The ids of each text in UTF-8 as unsigned 32-bit numbers of the machine's byte order."""
        for group in self.grouped(texts):
            self.pieces.hold(set().union(*group), self.of_pieces)
            for pieces in group:
                yield b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs, joined by one space as the tokenizer has no decoder."""
        return " ".join(map(self.automaton.label.__getitem__, ids))

    def of_spelt(self, pieces: list[bytes]) -> Iterator[tuple[str, str]]:
        label = self.automaton.label
        self.pieces.hold(pieces, self.of_pieces)
        for piece in pieces:
            ids = memoryview(self.pieces[piece]).cast("I").tolist()
            yield "".join([f"{i} " for i in ids]), "".join([label[i] + " " for i in ids])

    def spelled(self, texts: Iterable[bytes | None]) -> Iterator[tuple[str, str]]:
        """The ids of each text in decimal and the decoded text, both joined by one space."""
        for group in self.grouped(texts):
            self.spelt.hold(set().union(*group), self.of_spelt)
            for pieces in group:
                both = list(map(self.spelt.__getitem__, pieces))
                yield "".join([b[0] for b in both])[:-1], "".join([b[1] for b in both])[:-1]


_compiled: dict[str, bytes] = {}
_loaded: dict[bytes, Encoder] = {}


def share_tokenizer(spark: SparkSession, path: str):
    """Broadcasts the compiled encoder, pickled: some MB, whatever the input's size."""
    if path not in _compiled:
        with open(path, encoding="utf-8") as f:
            _compiled[path] = pickle.dumps(Encoder(f.read()))
        gc.collect()
    return spark.sparkContext.broadcast(_compiled[path])


def encoder_of(shared) -> Encoder:
    """The encoder of a broadcast, loaded once in a worker, with what it remembers."""
    digest = hashlib.sha256(shared.value).digest()
    if digest not in _loaded:
        _loaded.clear()
        _loaded[digest] = pickle.loads(shared.value)
    return _loaded[digest]


@contextmanager
def uncollected():
    """No search for cycles meanwhile: encoding makes none, and what is remembered is large."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def each_text(column: pa.Array, step: int = 256) -> Iterator[bytes | None]:
    """The texts of a column of binary, some at a time."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col).cast("string"), "utf-8").alias("text"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col and ``ids`` (array of int), the tokens of the whole text.

    Null and empty texts have an empty array.  Rows that repeat, and rows whose id
    is null, are encoded each on its own; other columns are not looked at.  An empty
    table gives an empty one.  Very long texts are encoded whole, one at a time.
    """
    shared = share_tokenizer(docs.sparkSession, tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                with uncollected():
                    packed = list(enc.packed(each_text(part.column(1))))
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype="int32")
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="int32")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id_col and ``text``, the labels of the ids' arcs; null and empty ids give an empty text, an empty table an empty one.

    Rows that repeat, and rows whose id is null, are decoded each on its own.
    """
    shared = share_tokenizer(encoded.sparkSession, tokenizer)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder_of(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([enc.decode(x or ()) for x in part.column(1).to_pylist()], pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_tokens, ids_sha256 and decoded_sha256 of the whole text's ids and of what they decode to.

    The ids are those of ``encode`` and the text is that of ``decode``; joining their
    steps spares the arrays' way through the JVM.  Null and empty texts have no ids
    and decode to the empty text.  Rows that repeat, and rows whose id is null, are
    taken each on its own; an empty table gives an empty one; other columns are not
    looked at.
    """
    shared = share_tokenizer(docs.sparkSession, tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder_of(shared)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            with uncollected():
                for ids, decoded in enc.spelled(each_text(batch.column(1))):
                    n.append(ids.count(" ") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
