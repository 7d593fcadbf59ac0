"""Exact top-k search by inner product with an impact-ordered index.

Vectors of whole numbers are dealt into blocks.  A block's index has a posting list
per dimension, cut into segments of equal quantised value (the component above the
dimension's least, divided by a step and rounded down).  A query reads a list from
the top where its own component is positive and from the bottom where it is
negative; counted from the far end, all impacts are positive, and the same constant
is missing from all scores.  Segments come score at a time: in descending order of
their highest impact, whatever the dimension.  Each adds its lower bound to the
accumulators of its members.  What a vector may still gain is bounded by the highest
unread segment of each dimension and by what was rounded down.  Reading stops only on
the proof that all but a few vectors can't reach the k-th best lower bound; those few
are scored again with the vectors themselves.

A tile, one block and some of the queries, is a task; blocks and query groups are
about as large, so that what is copied grows with the square root of a tile's work.
A tile's k best per query are candidates for the k best of all, which are kept by a
window that cuts to k before and after its shuffle.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastrum.llm.common import cut

#: Levels that a dimension's values are quantised to, about.
LEVELS = 32
#: Vectors and queries of a tile at most.
BLOCK, QUERIES = 8192, 4096
#: Segments between two attempts at a proof.
ROUND = 64
#: Whole numbers up to here are exact in floating point, and so are their sums.
EXACT = 1 << 53


class ImpactIndex:
    """Segments of one block: for each dimension and quantised value the members' places."""

    def __init__(self, vectors: np.ndarray, levels: int = LEVELS):
        self.vectors = vectors
        n, dims = vectors.shape
        self.least, self.most = vectors.min(axis=0), vectors.max(axis=0)
        self.step = np.maximum(1.0, np.ceil((self.most - self.least + 1) / levels))
        self.lists: list[list[tuple[float, np.ndarray]]] = []  # per dimension (low end above the least, members), ascending
        for d in range(dims):
            level = np.floor((vectors[:, d] - self.least[d]) / self.step[d])
            order = np.argsort(level, kind="stable")
            cuts = np.flatnonzero(np.diff(level[order])) + 1
            self.lists.append([(float(level[m[0]] * self.step[d]), np.sort(m)) for m in np.split(order, cuts)])

    def impacts(self, query: np.ndarray):
        """(highest impact, lowest impact, dimension, members) of all segments that may add to a score; impacts are counted from each list's far end."""
        out = []
        for d in np.flatnonzero((query != 0) & (self.most > self.least)).tolist():
            q, step, span = float(query[d]), float(self.step[d]), float(self.most[d] - self.least[d])
            for low, members in self.lists[d]:
                high = min(low + step - 1, span)
                out.append((q * high, q * low, d, members) if q > 0 else (-q * (span - low), -q * (span - high), d, members))
        return out

    def search(self, query: np.ndarray, k: int, skip: np.ndarray) -> tuple[list[tuple[int, int]], float]:
        """(score, place) of the k best, without the places `skip`, and of all that equal the last of them; and the share of postings read."""
        n = len(self.vectors)
        gains = sorted(self.impacts(query), key=lambda s: -s[0])
        lower = np.zeros(n)
        lower[skip] = -np.inf
        # A vector is in one segment of a dimension, so the highest unread one bounds what is to come.
        unread: dict[int, list[float]] = {}
        for high, _, d, _ in reversed(gains):
            unread.setdefault(d, []).append(high)
        loose = _loosest(gains)
        rest, slack, begun, read = sum(b[-1] for b in unread.values()), 0.0, set(), 0
        total, few = rest, max(4 * k, n // 16)
        if not np.isfinite(4 * total):  # out of floating point's range: no bound holds
            gains, rest = [], np.inf
        for number, (_, low, d, members) in enumerate(gains, 1):
            if low:
                lower[members] += low
            read += len(members)
            if d not in begun:  # what rounding down may have cost
                begun.add(d)
                slack += loose[d]
            bounds = unread[d]
            rest -= bounds.pop()
            rest += bounds[-1] if bounds else 0
            if number % ROUND == 0 and k < n and np.count_nonzero(lower >= np.partition(lower, n - k)[n - k] - slack - rest) <= few:
                break
        kth = np.partition(lower, n - k)[n - k] if k < n and np.isfinite(rest) else -np.inf
        spare = 1e-9 * total if total >= EXACT else 0  # bounds are rounded themselves
        possible = np.flatnonzero((lower >= (kth - slack - rest - spare if np.isfinite(kth) else -np.inf)) & (lower > -np.inf))
        scores = exact_scores(self.vectors[possible], query)
        best = heapq.nlargest(k, scores)
        kept = [(s, p) for s, p in zip(scores, possible.tolist(), strict=True) if len(scores) <= k or s >= best[-1]]
        return kept, read / max(1, n * len(unread))


def _loosest(gains: list[tuple]) -> dict[int, float]:
    out: dict[int, float] = {}
    for high, low, d, _ in gains:
        out[d] = max(out.get(d, 0.0), high - low)
    return out


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products as Python's whole numbers: by floating point where all sums are exact in it, else one by one."""
    if not len(vectors):
        return []
    if float(np.abs(vectors).max()) * float(np.abs(query).max()) * len(query) < EXACT:
        return [int(s) for s in (vectors @ query).tolist()]
    q = [int(x) for x in query.tolist()]
    return [sum(int(x) * y for x, y in zip(v, q, strict=True)) for v in vectors.tolist()]


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v, floor(scale * x) per component as array<double>, whose whole numbers are exact at any size.

    Vectors that are null or hold null or non-finite components, or a component
    that leaves the range of doubles when scaled, and rows without an id are left out.  Repeated
    rows stay; other columns are not looked at; an empty table gives an empty one.
    """
    x = F.col(vector_col)
    finite = lambda e: ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & finite(e.cast("double") * scale))
    # floor() gives a long; beyond 2**52 a double is whole already
    whole = lambda e: F.when(F.abs(e) < float(1 << 52), F.floor(e).cast("double")).otherwise(e)
    return vectors.where(F.coalesce(sound, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: whole(e.cast("double") * scale)).alias("v"))


MOST = (1 << 63) - 1


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best vectors of each query but those of its own id; ties go to the smaller id.

    vectors and queries have vec_id and v (array<double> of whole numbers).  Vectors
    meet queries of their own length only.  Repeated rows are candidates each.
    Scores are compared exactly at any size; what leaves 64 bits is returned as the
    nearest end of their range.  Tables without rows give none.  Other columns are
    not looked at.
    """
    return ranked(tiled(vectors, queries, k, block, group), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query among its tiles' bests."""
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    rows = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return rows.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def tiled(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, group: int = QUERIES) -> DataFrame:
    """Each tile's k best per query: query_id, vec_id, score, key (in the order of exact scores) and the share of postings read."""
    spark = vectors.sparkSession
    vectors, queries = cut(vectors.select("vec_id", "v")), cut(queries.select("vec_id", "v"))
    n, m = vectors.count(), queries.count()
    blocks = max(1, -(-n // block))
    groups = max(1, -(-m // group), min(m // 16, -(-spark.sparkContext.defaultParallelism // blocks)))
    sides = vectors.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("c"), F.lit(False).alias("asks"), "vec_id", "v")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int").alias("c"), F.lit(True).alias("asks"), "vec_id", "v")

    def run(key, data):
        rows = {True: {}, False: {}}
        for asks, i, v in zip(data.column("asks").to_pylist(), data.column("vec_id").to_pylist(), data.column("v").to_pylist(), strict=True):
            rows[asks].setdefault(len(v), []).append((i, v))
        out = []
        for size, wanted in rows[True].items():
            own = sorted(rows[False].get(size, ()))
            if not own:
                continue
            ids = np.array([i for i, _ in own])
            index = ImpactIndex(np.array([v for _, v in own], dtype=np.float64).reshape(len(own), size))
            for q, v in wanted:
                found, share = index.search(np.array(v, dtype=np.float64), k, np.flatnonzero(ids == q))
                for s, i in heapq.nsmallest(k, ((-s, int(ids[p])) for s, p in found)):
                    out.append((q, i, max(-MOST - 1, min(MOST, -s)), order_key(-s), share))
        return pa.table({name: pa.array([o[c] for o in out], kind) for c, (name, kind) in enumerate(zip(("query_id", "vec_id", "score", "key", "share"), (*[pa.int64()] * 3, pa.string(), pa.float64()), strict=True))})

    return sides.unionByName(asked).groupBy("b", "c").applyInArrow(run, "query_id long, vec_id long, score long, key string, share double")


def order_key(score: int) -> str:
    """A text that stands in the order of whole numbers of any size: sign, number of digits, digits."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):04d}{digits}"
    return f"0{9999 - len(digits):04d}" + digits.translate(NINES)


NINES = str.maketrans("0123456789", "9876543210")
