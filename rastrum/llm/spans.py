"""Substring dedup: runs of words that occur more than once go, wherever they stand.

Suffix automata of reference shards decide, but they aren't broadcast: the corpus is
its own reference, and to stream every document past every shard would take work
that grows with the square of the corpus, and memory without a bound.  Instead a
window is sent to the one shard where its like can be.  Its anchor is the least hash
of the ANCHOR-word runs in it, so equal windows have equal anchors, and neighbouring
windows with one anchor form a segment.

1. Anchors that occur once hold no repeated window; nor is there more to ask where
   all segments of an anchor are equal: they repeat as a whole.
2. What is left are anchors with different segments, as at the ends of shared
   passages and at edits.  One copy of each is taken from its text and sent to the
   anchor's shard.  A shard's suffix automaton counts how often each of its states
   occurs; streaming a segment past it gives the matching statistics, and where the
   match is as long as a window its count says if it repeats.  Anchors with very
   many segments are spread over several shards, past each of which their segments
   are streamed.
3. Repeated windows are gathered per document and their words taken out.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.llm.common import salted_join, written
from rastrum.llm.words import Ranges, hashed, texts_of, word_hashes

WINDOW = 35
ANCHOR = 8
#: Segments in a shard, about.
SHARD = 2000


def least_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each window of `span` values the leftmost place of the least one, by doubling."""
    place, size = np.arange(len(values)), 1

    def merged(v, p, by):
        later = v[by:] < v[:-by]
        return np.where(later, v[by:], v[:-by]), np.where(later, p[by:], p[:-by])

    while 2 * size <= span:
        values, place = merged(values, place, size)
        size *= 2
    return place if size == span else merged(values, place, span - size)[1]


def segments(h: np.ndarray, bounds: np.ndarray, window: int, anchor: int):
    """Text, anchor, first window, number of windows and hash of each segment of the texts' word hashes; None if there is no window."""
    if len(h) < window:
        return None
    ranges = Ranges(h)
    runs = ranges.of(np.arange(len(h) - anchor + 1), np.arange(anchor, len(h) + 1))
    place = least_places(runs, window - anchor + 1)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(text[: len(place)] == text[window - 1 :])  # windows that no text's end cuts
    if not len(inside):
        return None
    place, text = place[inside], text[inside]
    cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(text) != 0)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(place)]]) - 1
    start, end = inside[first], inside[last] + 1
    return text[first], runs[place[first]], start - bounds[text[first]], end - start, ranges.of(start, end + window - 1)


class SuffixAutomaton:
    """Of several sequences, with the weight of all places where a state's strings end."""

    def __init__(self):
        self.arcs: list[dict] = [{}]
        self.link, self.size, self.weight = [-1], [0], [0]

    def _state(self, size: int, arcs: dict, link: int) -> int:
        self.arcs.append(arcs)
        self.size.append(size)
        self.link.append(link)
        self.weight.append(0)
        return len(self.size) - 1

    def _split(self, at: int, word, target: int) -> int:
        """A copy of `target` for the strings that reach it through `at`."""
        copy = self._state(self.size[at] + 1, dict(self.arcs[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.arcs[at].get(word) == target:
            self.arcs[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, words: list, weight: int) -> None:
        last, arcs, link, size = 0, self.arcs, self.link, self.size
        for word in words:
            target = arcs[last].get(word)
            if target is not None:
                last = target if size[target] == size[last] + 1 else self._split(last, word, target)
            else:
                new, at = self._state(size[last] + 1, {}, 0), last
                while at >= 0 and word not in arcs[at]:
                    arcs[at][word] = new
                    at = link[at]
                if at >= 0:
                    target = arcs[at][word]
                    link[new] = target if size[target] == size[at] + 1 else self._split(at, word, target)
                last = new
            self.weight[last] += weight

    def close(self) -> None:
        """Sums weights up the links; call once, after the last add."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.weight[self.link[s]] += self.weight[s]

    def counts(self, words: list, length: int) -> list[int]:
        """For each run of `length` words how much weight the automaton has of it."""
        arcs, link, size, out = self.arcs, self.link, self.size, []
        state = matched = 0
        for i, word in enumerate(words, 1):
            while state and word not in arcs[state]:
                state = link[state]
                matched = size[state]
            if word in arcs[state]:
                state = arcs[state][word]
                matched += 1
            while state and size[link[state]] >= length:
                state = link[state]
                matched = size[state]
            if i >= length:
                out.append(self.weight[state] if matched >= length else 0)
        return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, the text as bytes, and k and th, which tell texts of one id apart by 64 bits and texts without id by 128."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.schema[id_col].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    k = F.coalesce(F.col(id_col).cast("long") if whole else F.xxhash64(id_col), F.lit(0).cast("long"))
    k = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("no id"), text)).otherwise(k)
    return docs.select(F.col(id_col).alias("id"), k.alias("k"), F.xxhash64(text, F.col(id_col).isNull()).alias("th"), F.encode(text, "utf-8").alias("text"))


#: Bytes of text cut up at a time, about.
SLICE = 2 << 20


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, th and marks (array<struct<start, mask>>): bit i of mask says that the window at word start + i repeats.

    The windows of a segment have one anchor, so there are window - anchor + 1 at
    most, which must be less than the 63 bits of a mask.
    """
    if not 0 < anchor <= window < anchor + 62:
        raise ValueError("an anchor must be shorter than the window, by less than 62 words")
    texts = _texts(docs, id_col, text_col)

    def cut_up(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
                if (found := segments(*hashed(data, offsets[at : to + 1]), window, anchor)) is not None:
                    row, a, start, n, seg = found
                    keys = [batch.column(c).take(pa.array(row + at)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(a.view("int64")), pa.array(start.astype("int32")), pa.array(n.astype("int32")), pa.array(seg.view("int64"))], ["k", "th", "anchor", "start", "n", "seg"])
                at = to

    found = texts.select("k", "th", "text").mapInArrow(cut_up, "k long, th long, anchor long, start int, n int, seg long")
    repeated = found.groupBy("anchor").agg(F.count("*").alias("times"), F.min("seg").alias("a"), F.max("seg").alias("b")).where("times > 1")
    repeated = written(repeated.select("anchor", "times", (F.col("a") != F.col("b")).alias("differ")))
    held = written(salted_join(found, repeated, ["anchor"], "times"))

    kept = ["k", "th", "start", "n"]
    one = held.where("differ").groupBy("anchor", "seg").agg(F.count("*").alias("c"), F.first("times").alias("times"), F.min(F.struct(*kept)).alias("at"))
    one = written(one.select("anchor", "seg", "c", "times", "at.*"))
    shards = max(1, one.count() // SHARD)
    wanted = one.groupBy("k", "th").agg(F.collect_list(F.struct("anchor", "seg", "c", "times", "start", "n")).alias("wanted"))

    def spelled(batches):
        for batch in batches:
            out = []
            for text, asked in zip(batch.column(0), batch.column(1), strict=True):
                h = word_hashes(text.as_py())
                out += [{"anchor": w["anchor"], "seg": w["seg"], "c": w["c"], "times": w["times"], "words": h[w["start"] : w["start"] + w["n"] + window - 1].tobytes()} for w in asked.as_py()]
            yield pa.RecordBatch.from_pylist(out, SPELLED)

    words = texts.select("k", "th", "text").join(wanted, ["k", "th"])
    words = words.select("text", "wanted").mapInArrow(spelled, "anchor long, seg long, c long, times long, words binary")
    parts = F.ceil(F.col("times") / SHARD).cast("int")
    dealt = words.select("anchor", "seg", "c", "words", parts.alias("parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = dealt.select(F.pmod(F.xxhash64("anchor", "part"), F.lit(shards)).alias("shard"), "part", "anchor", "seg", "c", "words", (F.pmod("seg", "parts") == F.col("part")).alias("own"))

    def matched(data):
        automata, seen = defaultdict(SuffixAutomaton), set()  # one per part: what streams past the other parts of its anchor must not meet itself
        rows = list(zip(data.column("part").to_pylist(), data.column("anchor").to_pylist(), data.column("seg").to_pylist(), data.column("c").to_pylist(), [np.frombuffer(w, dtype=np.uint64).tolist() for w in data.column("words").to_pylist()], data.column("own").to_pylist(), strict=True))
        for part, a, seg, c, run, own in rows:
            if own and (a, seg) not in seen:  # rows that repeat a document spell its segments again
                seen.add((a, seg))
                automata[part].add(run, c)
        for automaton in automata.values():
            automaton.close()
        mask = [sum(1 << i for i, c in enumerate(automata[part].counts(run, window)) if c > (1 if own else 0)) for part, _, _, _, run, own in rows]
        return pa.table({"anchor": data.column("anchor"), "seg": data.column("seg"), "mask": pa.array(mask, pa.int64())})

    masks = dealt.groupBy("shard").applyInArrow(matched, "anchor long, seg long, mask long").groupBy("anchor", "seg").agg(F.bit_or("mask").alias("mask"))
    masks = written(masks.join(one.select("anchor", "seg", "c"), ["anchor", "seg"]).where("mask <> 0"))
    some = salted_join(held.where("differ").select("k", "th", "start", "anchor", "seg"), masks, ["anchor", "seg"], "c").select("k", "th", "start", "mask")
    whole = held.where("not differ").select("k", "th", "start", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    return whole.unionByName(some).groupBy("k", "th").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))


SPELLED = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("c", pa.int64()), ("times", pa.int64()), ("words", pa.binary())])


def dedup_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_words, n_removed and text, the words that stay joined by one space.

    Words are maximal runs of other than ASCII white space.  A word goes if a window
    of `window` consecutive words covers it whose words also stand anywhere else, in
    the same text or another.  Windows are compared by 64 bits of hash among those
    with equal 64-bit anchors.  Null and empty texts have no word.  Rows that repeat
    repeat all their windows.  Rows of one id, or of none, are texts of their own.
    """
    texts = _texts(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    marks = repeated_windows(docs, window, anchor, id_col, text_col)

    def taken(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = text.split()
                    total.append(len(words))
                    if not found:
                        gone.append(0)
                        kept.append(b" ".join(words).decode())
                        continue
                    start, mask = (np.array([m[f] for m in found], dtype=np.int64) for f in ("start", "mask"))
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    for bit in range(window):
                        s = start[(mask >> bit) & 1 == 1] + bit
                        np.add.at(edges, s, 1)
                        np.add.at(edges, s + window, -1)
                    stays = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                    gone.append(len(words) - len(stays))
                    kept.append(b" ".join([words[i] for i in stays]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "text"])

    joined = texts.select("id", "k", "th", "text").join(marks, ["k", "th"], "left").select("id", "text", "marks")
    return joined.mapInArrow(taken, f"id {kind}, n_words long, n_removed long, text string").withColumnsRenamed({"id": id_col, "text": text_col})
