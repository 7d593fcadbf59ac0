"""Code books from histograms: alphabet compaction, symbol choice, code lengths and canonical codes."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_BITS = 14


def compact_index(hist: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sym, idx: the place of each used symbol among them."""
    return hist.select(key, "sym", (F.row_number().over(Window.partitionBy(key).orderBy("sym")) - 1).alias("idx"))


def remap(symbols: DataFrame, hist: DataFrame, key: str = "doc_id") -> DataFrame:
    """Symbols by their compact index; a book has at most as many rows as its stream."""
    return symbols.join(compact_index(hist, key), [key, "sym"]).select(key, "seq", "idx")


def unmap(compact: DataFrame, hist: DataFrame, key: str = "doc_id") -> DataFrame:
    """Back from compact indices; an index outside of the book is an error."""
    joined = compact.join(compact_index(hist, key), [key, "idx"], "left")
    return joined.select(key, "seq", F.when(F.col("sym").isNotNull(), F.col("sym")).otherwise(F.raise_error(F.lit("index outside of the code book")).cast("int")).alias("sym"))


def map_sizes(hist: DataFrame, key: str = "doc_id") -> DataFrame:
    """Bytes of three forms of the list of used symbols, the smallest form (earlier ones win ties), and whether compaction pays."""
    gap = F.col("sym") - F.lag("sym").over(Window.partitionBy(key).orderBy("sym")) - 1
    sizes = hist.withColumn("gap", gap).groupBy(key).agg(F.count("*").alias("used"), (F.max("sym") + 1).cast("long").alias("sym_len"), F.sum(F.when(F.col("gap") >= 255, 3).when(F.col("gap").isNotNull(), 1).otherwise(0)).alias("gaps"))
    sizes = sizes.select(key, "used", "sym_len", (3 + 2 * F.col("used")).alias("raw_bytes"), (3 + F.floor((F.col("sym_len") + 7) / 8)).alias("bitmap_bytes"), (5 + F.col("gaps")).alias("delta_bytes"))
    least = F.least("raw_bytes", "bitmap_bytes", "delta_bytes")
    form = F.when(F.col("raw_bytes") == least, "raw").when(F.col("bitmap_bytes") == least, "bitmap").otherwise("delta")
    pays = (F.col("used") > 1) & (F.col("used") < F.floor(F.col("sym_len") / 2)) & (8 * least < F.col("sym_len") - F.col("used"))
    return sizes.withColumns({"form": form, "pays": pays})


def most_frequent(hist: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """The k most frequent symbols; ties go to the smaller symbol."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cnt"), "sym"))
    return hist.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "rank", "sym", "cnt")


def shannon_lengths(hist: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sym, cnt, len: the least whole number of bits not below the symbol's information, at least 1."""
    n = F.sum("cnt").over(Window.partitionBy(key))
    times = F.ceil(n / F.col("cnt")).cast("long")
    return hist.select(key, "sym", "cnt", F.when(times <= 2, 1).otherwise(F.length(F.bin(times - 1))).cast("int").alias("len"))


def canonical(lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds code: codes of a length count upwards, and a longer length begins after all shorter ones, scaled up."""
    over = Window.partitionBy(key)
    with_most = lengths.withColumn("most", F.max("len").over(over))
    before = F.sum(F.expr("shiftleft(1L, most - len)")).over(over.orderBy("len", "sym").rowsBetween(Window.unboundedPreceding, -1))
    return with_most.select(*lengths.columns, F.expr("most").alias("most"), F.coalesce(before, F.lit(0).cast("long")).alias("before")).withColumn("code", F.expr("shiftright(before, most - len)")).drop("most", "before")


def code_lengths(counts: list[int]) -> list[int]:
    """Lengths of a minimum-redundancy prefix code; one symbol alone has one bit."""
    if len(counts) == 1:
        return [1]
    heap = [(c, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: list[int] = [-1] * len(counts)
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = len(parent)
        parent.append(-1)
        heapq.heappush(heap, (a + b, len(parent) - 1))
    depth = [0] * len(parent)
    for i in range(len(parent) - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return depth[: len(counts)]


def chosen(counts: list[int], most: int = MOST_BITS) -> int:
    """How many of the most frequent symbols have codes of at most `most` bits."""
    low, high = 0, len(counts)
    while low < high:
        middle = (low + high + 1) // 2
        if max(code_lengths(counts[:middle])) <= most:
            low = middle
        else:
            high = middle - 1
    return low


def huffman_lengths(hist: DataFrame, key: str = "doc_id", most: int = MOST_BITS) -> DataFrame:
    """key, sym (null: the escape for all symbols not chosen), cnt, len; a group is one histogram."""
    kind = hist.schema[key].dataType.simpleString()

    def run(data):
        rows = sorted(zip(data.column("sym").to_pylist(), data.column("cnt").to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
        keep = chosen([c for _, c in rows], most)
        book = [*rows[:keep], *([(None, sum(c for _, c in rows[keep:]))] if keep < len(rows) else [])]
        return pa.table({key: pa.array([data.column(key)[0].as_py()] * len(book), data.column(key).type), "sym": pa.array([s for s, _ in book], pa.int32()), "cnt": pa.array([c for _, c in book], pa.int64()), "len": pa.array(code_lengths([c for _, c in book]), pa.int32())})

    return hist.select(key, "sym", "cnt").groupBy(key).applyInArrow(run, f"{key} {kind}, sym int, cnt long, len int")


def payload_bits(lengths: DataFrame, depth: int, key: str = "doc_id") -> DataFrame:
    """key, bits: what the coded stream takes, with depth bits after each escape."""
    return lengths.groupBy(key).agg(F.sum(F.col("cnt") * (F.col("len") + F.when(F.col("sym").isNull(), depth).otherwise(0))).alias("bits"))
