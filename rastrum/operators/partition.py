"""Strips, tiles, pyramids and frames as keys, and index relations over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rastrum.functions.scalars import box_value


def uniform_strips(grid: DataFrame, strips: int, key: str = "image_id") -> DataFrame:
    """Adds strip_id: strips of the height divided by their number, rounded up."""
    height = F.max("y").over(Window.partitionBy(key)) + 1
    return grid.withColumn("strip_id", F.floor(F.col("y") / F.ceil(height / F.least(F.lit(strips), height))).cast("int"))


def row_costs(grid: DataFrame, key: str = "image_id") -> DataFrame:
    """key, y, cost: the sum of absolute differences to the row above; 0 for the first row."""
    up = F.lag("v").over(Window.partitionBy(key, "x").orderBy("y"))
    return grid.withColumn("d", F.coalesce(F.abs(F.col("v") - up), F.lit(0))).groupBy(key, "y").agg(F.sum("d").cast("long").alias("cost"))


def adaptive_strips(costs: DataFrame, strips: int, key: str = "image_id") -> DataFrame:
    """key, strip_id, y0: strip i begins at the first row before which at least i / strips of all cost lies.

    Starts ascend strictly and stay below the height, so the last strips of an image
    whose cost is all at its end may be left out: every strip has a row.  Images
    without cost have strips of equal height, images of fewer rows one strip a row.
    """
    over = Window.partitionBy(key)
    summed = costs.withColumns({"total": F.sum("cost").over(over), "height": (F.max("y").over(over) + 1).cast("long"), "before": F.sum("cost").over(over.orderBy("y")) - F.col("cost")})
    wanted = summed.withColumn("n", F.least(F.lit(strips).cast("long"), F.col("height"))).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("n") - 1, F.lit(1).cast("long"))))).where("i < n")
    few = F.col("height") <= strips
    reached = F.when(few, F.col("y") >= F.col("i")).when(F.col("total") == 0, F.col("y") >= F.expr("i * height div n")).otherwise(F.col("before") * F.col("n") >= F.col("total") * F.col("i"))
    first = wanted.groupBy(key, "i").agg(F.min(F.when(reached & (F.col("y") > 0), F.col("y"))).alias("f"), F.max("height").alias("height"))
    first = first.withColumn("f", F.coalesce(F.col("f").cast("long"), F.col("height") - 1))
    shifted = F.max(F.col("f") - F.col("i")).over(over.orderBy("i")) + F.col("i")
    starts = first.withColumn("y0", shifted).where("y0 < height").select(key, F.col("i").alias("strip_id"), "y0")
    return costs.select(key).distinct().select(key, F.lit(0).cast("long").alias("strip_id"), F.lit(0).cast("long").alias("y0")).unionByName(starts)


def to_strips(grid: DataFrame, starts: DataFrame, key: str = "image_id") -> DataFrame:
    """Adds the strip_id of the last start at or above the row, by a running maximum over rows and starts together."""
    marks = starts.select(key, F.col("y0").cast("int").alias("y"), F.lit(-1).alias("x"), F.lit(None).cast("int").alias("v"), "strip_id")
    both = grid.select(key, "y", "x", "v", F.lit(None).cast("long").alias("strip_id")).unionByName(marks)
    over = Window.partitionBy(key).orderBy("y", "x")
    return both.withColumn("strip_id", F.max("strip_id").over(over).cast("int")).where("x >= 0")


def tiles(grid: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """Adds tile_y, tile_x and the place ty, tx in the tile."""
    div = lambda c, s: F.floor(F.col(c) / s).cast("int")
    return grid.withColumns({"tile_y": div("y", tile_h), "tile_x": div("x", tile_w), "ty": (F.col("y") % tile_h).cast("int"), "tx": (F.col("x") % tile_w).cast("int")})


def padded(tiled: DataFrame, tile_w: int, tile_h: int, key: str = "image_id") -> DataFrame:
    """Whole tiles: places outside of the image are 0."""
    names = tiled.select(key, "tile_y", "tile_x").distinct()
    places = names.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(tile_w * tile_h - 1))))
    places = places.withColumns({"ty": F.floor(F.col("at") / tile_w).cast("int"), "tx": (F.col("at") % tile_w).cast("int")}).drop("at")
    return places.join(tiled.select(key, "tile_y", "tile_x", "ty", "tx", "v"), [key, "tile_y", "tile_x", "ty", "tx"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def region(tiled: DataFrame, x: int, y: int, w: int, h: int, tile_w: int, tile_h: int) -> DataFrame:
    """The samples of a rectangle: whole tiles are picked by key, then places; what lies outside of the image is left out."""
    if x < 0 or y < 0 or w <= 0 or h <= 0:
        raise ValueError("a region needs a place in the image and a size")
    picked = tiled.where(F.col("tile_x").between(x // tile_w, (x + w - 1) // tile_w) & F.col("tile_y").between(y // tile_h, (y + h - 1) // tile_h))
    return picked.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))


def level_count(width: int, height: int, tile_w: int, tile_h: int) -> int:
    """Levels until a picture fits one tile."""
    levels = 1
    while width > tile_w or height > tile_h:
        width, height, levels = width // 2, height // 2, levels + 1
        if width <= 1 and height <= 1:
            break
    return levels


def level_plan(spark: SparkSession, width: int, height: int, tile_w: int, tile_h: int, levels: int | None = None) -> DataFrame:
    """level, width, height, tiles_x, tiles_y, first_tile: at most a few dozen rows, planned on the driver."""
    rows, first = [], 0
    for level in range(levels or level_count(width, height, tile_w, tile_h)):
        across, down = -(-width // tile_w), -(-height // tile_h)
        rows.append((level, width, height, across, down, first))
        first += across * down
        width, height = max(1, width // 2), max(1, height // 2)
    return spark.createDataFrame(rows, "level int, width int, height int, tiles_x int, tiles_y int, first_tile long")


def halved(grid: DataFrame, key: str = "image_id", values: tuple[str, ...] = ("v",)) -> DataFrame:
    """The next level: rounded means of 2 by 2 samples; odd last rows and columns are dropped."""
    half = grid.groupBy(key, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"))
    sums = half.agg(F.count("*").alias("c"), *(F.sum(v).alias(v) for v in values))
    return sums.where("c = 4").select(key, "y", "x", *(box_value(v).alias(v) for v in values))


def pyramid(grid: DataFrame, levels: int, key: str = "image_id", values: tuple[str, ...] = ("v",)) -> DataFrame:
    """level, key, y, x and values of all levels."""
    out, now = grid.select(F.lit(0).alias("level"), key, "y", "x", *values), grid
    for level in range(1, levels):
        now = halved(now, key, values)
        out = out.unionByName(now.select(F.lit(level).alias("level"), key, "y", "x", *values))
    return out


def offsets(parts: DataFrame, keys: list[str], order: list[str], length: str = "length") -> DataFrame:
    """Adds offset: the sum of lengths before a part, in order."""
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(length).over(over), F.lit(0)).cast("long"))
