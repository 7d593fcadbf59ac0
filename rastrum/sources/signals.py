"""Signals derived from relational tables, and their packed forms.

A grey grid has the columns image_id, y, x, v; a one-dimensional signal vec_id, x, v;
a symbol stream doc_id, seq, sym; a colour grid image_id, y, x, r, g, b; a frame
sequence series, frame, px, v.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_WIDTH = 64
#: Suppliers whose items make a picture, and users whose events make a series.  Either has a
#: bounded number of rows whatever the scale, so it is the number of pictures that grows.
SUPPLIERS, USERS = 4, 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grey_grid(spark: SparkSession, sf_dir: str, width: int = GRID_WIDTH, whole: bool = False) -> DataFrame:
    """12-bit grey images from lineitem, `width` samples a row; the last row may be short, or with `whole` is filled up with 0."""
    return _colour_or_grey(spark, sf_dir, width, ["v"], whole)


def colour_grid(spark: SparkSession, sf_dir: str, width: int = GRID_WIDTH, whole: bool = False) -> DataFrame:
    """8-bit colour images on the same grid."""
    return _colour_or_grey(spark, sf_dir, width, ["r", "g", "b"], whole)


def _colour_or_grey(spark, sf_dir, width, values, whole):
    image = f"CAST(l_suppkey div {SUPPLIERS} AS INT)"
    items = _table(spark, sf_dir, "lineitem").selectExpr(
        f"{image} image_id",
        f"row_number() OVER (PARTITION BY {image} ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) - 1 at",
        f"count(*) OVER (PARTITION BY {image}) n",
        "CAST(CAST(l_quantity AS BIGINT) * 64 + CAST(l_discount * 100 + 0.5 AS BIGINT) AS INT) v",
        "CAST(l_quantity * 5 AS INT) r",
        "CAST(l_partkey % 256 AS INT) g",
        "CAST(l_orderkey % 256 AS INT) b",
    )
    placed = items.select("image_id", "n", F.expr(f"CAST(at div {width} AS INT)").alias("y"), F.expr(f"CAST(at % {width} AS INT)").alias("x"), *values)
    if whole:  # the last sample stands for the places after it in its row
        last = F.col("y") * width + F.col("x") == F.col("n") - 1
        filled = placed.withColumn("place", F.explode(F.when(last, F.sequence("x", F.lit(width - 1))).otherwise(F.array("x"))))
        placed = filled.select("image_id", "y", F.col("place").alias("x"), *(F.when(F.col("place") == F.col("x"), F.col(v)).otherwise(0).alias(v) for v in values))
    return placed.select("image_id", "y", "x", *values)


def vector_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 points per vector of embeddings, in 16 bits."""
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e")).select("vec_id", "x", (F.floor(F.col("e").cast("double") * 1024) + 32768).cast("int").alias("v"))


def text_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code points of each text in order."""
    chars = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "")).alias("seq", "ch"))
    return chars.where("ch <> ''").select("doc_id", "seq", F.ascii("ch").alias("sym"))


def event_frames(spark: SparkSession, sf_dir: str, frame_size: int = 64) -> DataFrame:
    """10-bit frames of `frame_size` samples from the events of each series."""
    series = f"CAST(user_id div {USERS} AS INT)"
    ordered = _table(spark, sf_dir, "events").selectExpr(
        f"{series} series",
        "CAST(floor(value) AS INT) & 1023 v",
        f"row_number() OVER (PARTITION BY {series} ORDER BY ts, event_id) - 1 at",
    )
    return ordered.selectExpr("series", f"CAST(at div {frame_size} AS INT) frame", f"CAST(at % {frame_size} AS INT) px", "v")
