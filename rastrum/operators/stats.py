"""Histograms of symbol streams and what entropy coders derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrum.functions.scalars import high_bit

BASE_LOG, LEAST_LOG, MOST_LOG = 11, 5, 16
#: The rests beyond which small probabilities are rounded up, in 2**-20.
ROUND_UP = (0, 473195, 504333, 520860, 550000, 700000, 750000, 830000)


def histogram(symbols: DataFrame, key: str = "doc_id") -> DataFrame:
    return symbols.groupBy(key, "sym").agg(F.count("*").alias("cnt"))


def summary(hist: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, sym_len (largest symbol + 1), distinct_syms, unused, max_cnt, entropy (bits per symbol)."""
    over = Window.partitionBy(key)
    with_n = hist.withColumn("n", F.sum("cnt").over(over))
    share = F.col("cnt") / F.col("n")
    out = with_n.groupBy(key).agg(F.max("n").alias("n"), (F.max("sym") + 1).cast("long").alias("sym_len"), F.count("*").alias("distinct_syms"), F.max("cnt").alias("max_cnt"), F.round(F.sum(-share * F.log2(share)), 6).alias("entropy"))
    return out.withColumn("unused", F.col("sym_len") - F.col("distinct_syms")).withColumn("entropy", F.abs("entropy"))


def table_log(n: Column, sym_len: Column) -> Column:
    """Log of a coder's table size for n symbols below sym_len."""
    source = high_bit(n - 1) - 2
    least = F.least(high_bit(n - 1) + 1, high_bit(sym_len - 1) + 2)
    log = F.greatest(F.least(F.lit(BASE_LOG), source), least)
    density = F.floor(n / sym_len)
    log = F.when((sym_len > 512) & (density > 16) & (log < 13), 13).when((log < 12) & (((density > 64) & (sym_len > 256)) | ((density > 32) & (sym_len > 128))), 12).otherwise(log)
    return F.least(F.greatest(F.least(log, source), F.lit(LEAST_LOG)), F.lit(MOST_LOG)).cast("int")


def coded(stats: DataFrame) -> DataFrame:
    """Adds table_log, and flags for what a coder refuses: a single symbol, and counts too even to gain by."""
    n, longest = F.col("n"), F.col("max_cnt")
    single = longest == n
    even = ~single & ((longest == 1) | (longest < F.shiftright(n, 15)))
    enough = (n > 2) & (F.col("sym_len") > 1)
    return stats.withColumns({"single": single, "incompressible": even, "table_log": F.when(enough, table_log(n, F.col("sym_len")))})


def normalized(hist: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sym, cnt, norm, fallback: counts scaled to 2**table_log; rare symbols get -1, the most frequent one takes the rest.

    All products stay below 2**63.  fallback says that the rest is too large for
    that, and that the second method of the coders' kernels is to be used.
    """
    over = Window.partitionBy(key)
    logs = coded(summary(hist, key)).where(~F.col("single") & F.col("table_log").isNotNull()).select(key, "n", "table_log")
    rows = hist.join(logs, key)
    scale = 62 - F.col("table_log")
    step = F.expr("4611686018427387904L div n")
    rows = rows.withColumns({"scale": scale, "scaled": F.col("cnt") * step})
    rows = rows.withColumn("proba", F.expr("shiftright(scaled, scale)"))
    rest = F.expr("scaled - shiftleft(proba, scale)")
    beat = F.expr("shiftleft(1L, scale - 20)") * F.get(F.array(*(F.lit(x).cast("long") for x in ROUND_UP)), F.least(F.col("proba"), F.lit(7)).cast("int"))
    up = (F.col("proba") < 8) & (rest > beat)
    rare = F.col("cnt") <= F.expr("shiftright(n, table_log)")
    rows = rows.withColumn("norm", F.when(rare, F.lit(-1).cast("long")).otherwise(F.col("proba") + up.cast("long")))
    left = F.expr("shiftleft(1L, table_log)") - F.sum(F.abs("norm")).over(over)
    first = F.row_number().over(over.orderBy(F.desc("norm"), "sym")) == 1
    rows = rows.withColumns({"left": left, "first": first, "largest": F.max("norm").over(over)})
    fallback = -F.col("left") >= F.shiftright(F.col("largest"), 1)
    return rows.select(key, "sym", "cnt", F.when(F.col("first") & ~fallback, F.col("norm") + F.col("left")).otherwise(F.col("norm")).alias("norm"), fallback.alias("fallback"), "table_log")


def geometric_mean(x: str) -> Column:
    return F.exp(F.avg(F.log(x)))
