"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session of one machine that names none (as in tests) gets a folder of our
    own; a cluster without one is an error, as its machines' folders aren't shared.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "rastrum-checkpoints")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from what is written."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, although body may use it often."""
    return F.transform(F.array(value), body)[0]


#: Elements of a block whose sums are taken together.
SUM_BLOCK = 256


def sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it; two levels keep the work near linear."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / SUM_BLOCK).cast("int")), lambda b: F.slice(lengths, b * SUM_BLOCK + 1, SUM_BLOCK))

    def inside(block: Column, before: Column) -> Column:
        return F.aggregate(block, F.struct(before.alias("at"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    return let(blocks, lambda bs: let(F.transform(bs, total), lambda ts: F.flatten(F.transform(bs, lambda b, k: inside(b, total(F.slice(ts, 1, k)))))))


def words_of(text: Column) -> Column:
    """Maximal runs of other than ASCII white space; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def written(df: DataFrame) -> DataFrame:
    """As cut, for large tables: a Parquet table in the shared folder."""
    place = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    out = df.sparkSession.read.schema(df.schema).parquet(place)
    out._rs_place = place
    return out


def forget(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._rs_place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes to broadcast at most; the driver holds them several times over while it builds a table of them.
BROADCAST_BYTES = 8 << 20
#: Bits of the table by which few_join leaves rows out.
FILTER_BITS = 1 << 25


def is_small(df: DataFrame) -> bool:
    """Whether df's rows have BROADCAST_BYTES at most; df should have been written, as it is read for that."""
    variable = [c for c, t in df.dtypes if t in ("string", "binary")]
    size = F.lit(16 * len(df.columns)) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in variable), F.lit(0))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it is small."""
    return F.broadcast(df) if is_small(df) else df


def few_join(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of wide rows with right, which has few of their keys and should have been written.

    If right is too large for a broadcast, a bitmap of FILTER_BITS over the hashes of
    its keys is sent instead, and only rows whose bit is set, among them all that have
    a partner, are shuffled.
    """
    if is_small(right):
        return rows.join(F.broadcast(right), key)
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bucket, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = cut(right.groupBy(bucket.alias("_rs_bucket")).agg(F.bitmap_construct_agg(at).alias("_rs_map")))
    byte = F.conv(F.hex(F.substring("_rs_map", F.expr("CAST(_rs_at div 8 AS INT) + 1"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumns({"_rs_bucket": bucket, "_rs_at": at}).join(F.broadcast(maps), "_rs_bucket")
    held = found.where(F.getbit(byte, F.col("_rs_at") % 8) == 1).select(*rows.columns)
    return held.join(right, key)


def partitions_for(spark: SparkSession, size: float, each: int = 32 << 20) -> int:
    """A number of partitions for so many bytes, no less than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // each) + 1)


#: A key is hot if it has at least this share of the rows; so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000
HOT_SALTS = 64


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner", few: int = 0) -> DataFrame:
    """Inner or left join of left with right, which has one row a key and in `weight` how many rows of left have it.

    The hot keys, a thousand at most by their definition, are broadcast to give their
    rows of left one of HOT_SALTS salts; their rows of right are repeated as often.
    Every other key has less than HOT_SHARE of the rows.  right should have been
    written, as it is read three times.  If it has at most `few` rows, it is
    broadcast as a whole.
    """
    total, size = right.agg(F.coalesce(F.sum(weight), F.lit(0)), F.count("*")).collect()[0]
    if size <= few:
        return left.join(F.broadcast(right), keys, how)
    hot = right.where(F.col(weight) >= max(1000.0, total * HOT_SHARE)).select(*keys, F.lit(True).alias("_rs_hot"))
    salt = F.when(F.col("_rs_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(HOT_SALTS))).otherwise(0).cast("int")
    rows = left.join(F.broadcast(hot), keys, "left").withColumn("_rs_salt", salt).drop("_rs_hot")
    last = F.when(F.col(weight) >= max(1000.0, total * HOT_SHARE), HOT_SALTS - 1).otherwise(0)
    return rows.join(right.withColumn("_rs_salt", F.explode(F.sequence(F.lit(0), last))), [*keys, "_rs_salt"], how).drop("_rs_salt")
