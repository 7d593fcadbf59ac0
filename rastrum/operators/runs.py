"""Run lengths: symbols to runs and words and back, as gaps and islands.

A run of three or more equal symbols is a `same` island; what stands between such
runs is a `diff` island.  With mid = 2**(depth - 1) - 1, a word up to mid counts equal
symbols and a word above it, less mid, counts literals; so islands are split into
pieces, of mid - 3 each while more than mid - 1 are left, where a diff island keeps
room for two symbols if a same island follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pieces(symbols: DataFrame, depth: int, key: str = "image_id") -> DataFrame:
    """Adds island, is_same and piece to key, seq, sym."""
    most = (1 << (depth - 1)) - 2
    over = Window.partitionBy(key).orderBy("seq")
    run = F.sum(F.coalesce((F.col("sym") != F.lag("sym").over(over)).cast("int"), F.lit(1))).over(over)
    by_run = symbols.withColumn("run", run).withColumn("is_same", F.count("*").over(Window.partitionBy(key, "run")) >= 3)
    begins = F.coalesce((F.col("run") != F.lag("run").over(over)) & (F.col("is_same") | F.lag("is_same").over(over)), F.lit(True))
    islands = by_run.withColumn("island", F.sum(begins.cast("int")).over(over))
    whole = Window.partitionBy(key, "island")
    sized = islands.withColumns({"size": F.count("*").over(whole), "start": F.min("seq").over(whole)})
    next_same = F.lead("is_same").over(over)
    follows = F.max(F.when((F.col("seq") == F.col("start") + F.col("size") - 1) & ~F.col("is_same") & F.coalesce(next_same, F.lit(False)), 2).otherwise(0)).over(whole)
    cuts = F.greatest(F.lit(0), F.ceil((F.col("size") + follows - most) / (most - 2)))
    piece = F.least(F.floor((F.col("seq") - F.col("start")) / (most - 2)), cuts)
    return sized.withColumn("piece", piece.cast("long")).drop("run", "size", "start")


def runs(symbols: DataFrame, depth: int, key: str = "image_id") -> DataFrame:
    """key, start_seq, kind ('same' or 'diff'), len, value (the first symbol)."""
    grouped = pieces(symbols, depth, key).groupBy(key, "island", "piece", "is_same")
    out = grouped.agg(F.min("seq").cast("long").alias("start_seq"), F.count("*").alias("len"), F.min_by("sym", "seq").alias("value"))
    return out.select(key, "start_seq", F.when(F.col("is_same"), "same").otherwise("diff").alias("kind"), "len", "value")


def words(symbols: DataFrame, depth: int, key: str = "image_id") -> DataFrame:
    """key, word_no (from 0), word: counts and payload, without a header."""
    mid = (1 << (depth - 1)) - 1
    cut = pieces(symbols, depth, key)
    first = F.row_number().over(Window.partitionBy(key, "island", "piece").orderBy("seq")) == 1
    size = F.count("*").over(Window.partitionBy(key, "island", "piece"))
    count = F.when(F.col("is_same"), size).otherwise(size + mid).cast("int")
    out = F.when(first, F.array(count, F.col("sym"))).when(F.col("is_same"), F.array().cast("array<int>")).otherwise(F.array(F.col("sym")))
    each = cut.withColumn("out", out).select(key, "seq", F.posexplode("out").alias("part", "word"))
    return each.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("seq", "part")) - 1).alias("word_no"), "word")


def with_length(rows: DataFrame, symbols: DataFrame, key: str = "image_id") -> DataFrame:
    """key, word_no, word of whole streams: two words say first how many symbols there are, the high 16 bits before the low ones."""
    n = symbols.groupBy(key).agg(F.count("*").alias("n"))
    head = n.select(key, F.posexplode(F.array(F.shiftright("n", 16), F.col("n").bitwiseAND(65535))).alias("word_no", "word"))
    whole = lambda d, before: d.select(key, (F.col("word_no") + before).cast("long").alias("word_no"), F.col("word").cast("int").alias("word"))
    return whole(head, 0).unionByName(whole(rows, 2))
