"""Best-fit packing of token pieces, improved by swap-based local search.

Documents are tokenised and cut into pieces where they stand.  The pieces, a few
numbers each, are dealt into groups of about GROUP pieces by a hash; what grows
with the corpus is the number of groups, never a group.  Within a group, pieces
are placed best fit, longest first.  Then the local search moves single pieces and
exchanges one for one and two for one between underfull bins, always so that the
sum of squared fills rises, which drains the emptiest bins until they vanish.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from heapq import heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.llm.bpe import each_text, encoder_of, share_tokenizer, uncollected
from rastrum.llm.common import cut

GROUP = 20_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece.

    A document is its ids and then the separator; so a null or empty text has one
    piece of one token.  Only documents longer than `capacity` are cut.  Repeated
    rows have their pieces each.
    """
    shared = share_tokenizer(docs.sparkSession, tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    end, step = separator.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        enc = encoder_of(shared)
        for batch in batches:
            taken, piece, start, length, crc = [], [], [], [], []
            with uncollected():
                for k, ids in enumerate(enc.packed(each_text(batch.column(1)))):
                    packed = memoryview(ids + end)
                    for p, lo in enumerate(range(0, len(packed), step)):
                        part = packed[lo : lo + step]
                        taken.append(k)
                        piece.append(p)
                        start.append(lo // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    found = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col).cast("string"), "utf-8").alias("text"))
    return found.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id_col)


class Bins:
    """Bins of one group, each a sorted list of piece lengths; `by_size` says which bins hold a length."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.by_fill: dict[int, set[int]] = defaultdict(set)
        self.fills: list[int] = []  # the fills below capacity that some bin has, ascending

    def _moved(self, b: int, fill: int) -> None:
        old = self.fill[b]
        if old in self.by_fill:
            self.by_fill[old].discard(b)
            if not self.by_fill[old]:
                del self.by_fill[old]
                del self.fills[bisect_left(self.fills, old)]
        self.fill[b] = fill
        if 0 < fill < self.capacity:
            if fill not in self.by_fill:
                insort(self.fills, fill)
            self.by_fill[fill].add(b)

    def add(self, b: int, size: int) -> None:
        insort(self.items[b], size)
        self._moved(b, self.fill[b] + size)

    def remove(self, b: int, size: int) -> None:
        del self.items[b][bisect_left(self.items[b], size)]
        self._moved(b, self.fill[b] - size)

    def best_fit(self, size: int, other_than: int = -1) -> int:
        """The fullest bin that still takes `size`, or -1."""
        k = bisect_left(self.fills, self.capacity - size + 1) - 1
        while k >= 0:
            b = min((b for b in self.by_fill[self.fills[k]] if b != other_than), default=-1)
            if b >= 0:
                return b
            k -= 1
        return -1

    def place(self, size: int) -> None:
        b = self.best_fit(size)
        if b < 0:
            b = len(self.items)
            self.items.append([])
            self.fill.append(0)
        self.add(b, size)

    def enlist(self, b: int) -> None:
        """Puts an underfull bin into the index from piece length to (fill, bin)."""
        if 0 < self.fill[b] < self.capacity:
            for size in set(self.items[b]):
                if size not in self.holders:
                    insort(self.lengths, size)
                    self.holders[size] = []
                insort(self.holders[size], (self.fill[b], b))

    def delist(self, b: int) -> None:
        for size in set(self.items[b]):
            held = self.holders[size]
            del held[bisect_left(held, (self.fill[b], b))]
            if not held:
                del self.holders[size]
                del self.lengths[bisect_left(self.lengths, size)]

    def exchange(self, b: int, mine: tuple[int, ...], other: int, theirs: tuple[int, ...]) -> None:
        self.delist(b)
        self.delist(other)
        for size in mine:
            self.remove(b, size)
        for size in theirs:
            self.remove(other, size)
            self.add(b, size)
        for size in mine:
            self.add(other, size)
        self.enlist(b)
        self.enlist(other)

    def drain(self, b: int) -> int:
        """One improving move out of bin b, to the bin returned; -1 if there is none among all underfull bins that aren't emptier.

        Of the bins that hold a length, the emptiest has the most room for what
        comes instead; so one bin a length stands for all, and what fails there
        fails in the others.
        """
        mine, fill = self.items[b], self.fill[b]
        for size in sorted(set(mine), reverse=True):  # move
            other = self.best_fit(size, b)
            if other >= 0 and self.fill[other] + size > fill:
                self.exchange(b, (size,), other, ())
                return other
        sizes = sorted(set(mine))
        given = {x + y: (x, y) for i, x in enumerate(sizes) for y in sizes[i:] if x < y or mine.count(x) > 1}  # two for one
        given |= {x: (x,) for x in sizes}  # one for one
        sums, best = sorted(given), None
        for theirs in self.lengths[bisect_left(self.lengths, sums[0] + fill - self.capacity) : bisect_left(self.lengths, sums[-1])]:
            held = self.holders[theirs]
            k = bisect_left(held, (fill, -1))
            if k < len(held) and held[k][1] == b:
                k += 1
            if k == len(held):
                continue
            fits = bisect_left(sums, theirs + self.capacity - held[k][0] + 1)
            top = sums[fits - 1] if fits else 0  # the largest that fits instead
            if top > theirs and (best is None or top - theirs > best[0]):
                best = (top - theirs, top, held[k][1], theirs)
        if best is None:
            return -1
        self.exchange(b, given[best[1]], best[2], (best[3],))
        return best[2]

    def search(self) -> None:
        """Drains bins, emptiest first, until a whole round over all underfull bins finds no move.

        Within a round, bins with the contents of one that had no move are passed
        over; as others may have changed since, the next round asks all again.
        """
        self.holders: dict[int, list[tuple[int, int]]] = {}
        self.lengths: list[int] = []
        for b in range(len(self.items)):
            self.enlist(b)
        moved = True
        while moved:
            moved, stuck = False, set()
            waiting = [(f, b) for f in self.fills for b in sorted(self.by_fill[f])]
            while waiting:
                f, b = heappop(waiting)
                if self.fill[b] != f or (key := tuple(self.items[b])) in stuck:
                    continue
                other = self.drain(b)
                if other < 0:
                    stuck.add(key)
                    continue
                moved = True
                for x in (b, other):
                    if 0 < self.fill[x] < self.capacity:
                        heappush(waiting, (self.fill[x], x))


def fill_bins(lengths: list[int], capacity: int) -> list[list[int]]:
    """The lengths, sorted into as few bins as best fit and the local search find."""
    bins = Bins(capacity)
    for size in sorted(lengths, reverse=True):
        if size >= capacity:
            bins.items.append([size])
            bins.fill.append(size)
        else:
            bins.place(size)
    bins.search()
    return [x for x in bins.items if x]


def pack(found: DataFrame, capacity: int = 2048, group: int = GROUP, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces.

    Ties between pieces of a length go by id and piece.  An empty table has no
    sequence.  sequence_id is unique over all groups.
    """
    found = cut(found)
    groups = max(1, -(-found.count() // group))
    kind = found.schema[id_col].dataType.simpleString()
    columns = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(key, data):
        import numpy as np

        data = data.combine_chunks()
        index = pc.sort_indices(data, [("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]).to_pylist()
        lengths = data.column("length").to_pylist()
        waiting: dict[int, list[int]] = defaultdict(list)
        for i in reversed(index):
            waiting[lengths[i]].append(i)
        sequence, offset = np.zeros(len(lengths), "int64"), np.zeros(len(lengths), "int64")
        base = key[0].as_py()
        for b, sizes in enumerate(fill_bins(lengths, capacity)):
            at = 0
            for size in reversed(sizes):
                i = waiting[size].pop()
                sequence[i], offset[i] = base + b * groups, at
                at += size
        return data.select(["id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = found.select(F.pmod(F.xxhash64(*columns), F.lit(groups)).alias("bin_group"), F.col(id_col).alias("id"), *columns[1:])
    packed = dealt.groupBy("bin_group").applyInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
