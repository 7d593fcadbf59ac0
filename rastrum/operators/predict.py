"""Prediction of a sample from its neighbours, residuals, and inverses that are prefix sums.

A grid has the columns key, y, x, v.  Neighbours come from two windows, along rows
and along columns; a cell is found by its place, so a short last row is no
exception.  Partitions are single rows and columns of an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrum.functions import scalars as S


def with_neighbours(grid: DataFrame, key: str = "image_id") -> DataFrame:
    """Adds w, n, nw and ne, null where there is no such cell."""
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    after = grid.withColumn("e", F.lead("v").over(row)).withColumn("w", F.lag("v").over(row))
    return after.withColumns({"n": F.lag("v").over(column), "nw": F.lag("w").over(column), "ne": F.lag("e").over(column)}).drop("e")


def average(w, n, nw, ne) -> Column:
    return F.shiftright(w + n, 1)


def gradient(w, n, nw, ne) -> Column:
    """The average, corrected by an eighth of the slope above, within half the local activity."""
    room = F.shiftright(F.abs(w - nw) + F.abs(n - nw), 1)
    return average(w, n, nw, ne) + S.clamp(F.shiftright(F.coalesce(ne, nw) - nw, 3), -room, room)


def median_edge(w, n, nw, ne) -> Column:
    return F.when(nw >= F.greatest(w, n), F.least(w, n)).when(nw <= F.least(w, n), F.greatest(w, n)).otherwise(w + n - nw)


def paeth(w, n, nw, ne) -> Column:
    guess = w + n - nw
    a, b, c = F.abs(guess - w), F.abs(guess - n), F.abs(guess - nw)
    return F.when((a <= b) & (a <= c), w).when(b <= c, n).otherwise(nw)


#: Rules for cells with both a left and an upper neighbour; others take the one they have, or 0.
PREDICTORS = {"avg": average, "grad": gradient, "med": median_edge, "paeth": paeth}


def prediction(name: str) -> Column:
    """The named predictor over columns w, n, nw and ne; `left` looks at the left neighbour only."""
    w, n, nw, ne = (F.col(c) for c in ("w", "n", "nw", "ne"))
    if name == "left":
        return F.coalesce(w, F.lit(0))
    return F.coalesce(F.when(w.isNull(), n).when(n.isNull(), w).otherwise(PREDICTORS[name](w, n, nw, ne)), F.lit(0)).cast("int")


def residuals(grid: DataFrame, predictor: str = "avg", key: str = "image_id") -> DataFrame:
    """key, y, x, v, pred and residual for a named predictor."""
    near = with_neighbours(grid, key)
    return near.select(key, "y", "x", "v", prediction(predictor).alias("pred")).withColumn("residual", F.col("v") - F.col("pred"))


def words(residual: Column, v: Column, depth: int, zigzagged: bool = False) -> Column:
    """A residual as words: a literal, or the escape and the sample itself."""
    t = S.threshold_of(depth)
    literal = S.zigzag(residual) if zigzagged else residual + t
    return F.when(F.abs(residual) >= t, F.array(F.lit(S.escape_of(depth)), v)).otherwise(F.array(literal))


def symbols(res: DataFrame, depth: int, key: str = "image_id", zigzagged: bool = False) -> DataFrame:
    """key, seq (from 0), sym, is_escape: the residuals' words in raster order."""
    each = res.select(key, "y", "x", F.posexplode(words(F.col("residual"), F.col("v"), depth, zigzagged)).alias("part", "sym"), (F.abs("residual") >= S.threshold_of(depth)).alias("is_escape"))
    order = Window.partitionBy(key).orderBy("y", "x", "part")
    return each.select(key, (F.row_number().over(order) - 1).alias("seq"), "sym", "is_escape")


def undo_left(res: DataFrame, depth: int, key: str = "image_id") -> DataFrame:
    """Samples from residuals of the left predictor: a sum along the row that begins again at each escape."""
    row = Window.partitionBy(key, "y").orderBy("x")
    escaped = F.abs("residual") >= S.threshold_of(depth)
    parts = res.withColumn("part", F.sum(escaped.cast("int")).over(row)).withColumn("term", F.when(escaped, F.col("v")).otherwise(F.col("residual")))
    within = Window.partitionBy(key, "y", "part").orderBy("x")
    return parts.select(key, "y", "x", F.sum("term").over(within).cast("int").alias("restored"))


def frame_residuals(frames: DataFrame) -> DataFrame:
    """series, frame, px, res: differences to the frame before, wrapped to 16 bits and zigzagged; frame 0 is kept as it is."""
    over = Window.partitionBy("series", "px").orderBy("frame")
    before = F.lag("v").over(over)
    return frames.select("series", "frame", "px", F.when(before.isNull(), F.col("v")).otherwise(S.zigzag(S.wrap16(F.col("v") - before))).alias("res"), before.isNull().alias("is_first"))


def undo_frames(coded: DataFrame) -> DataFrame:
    """series, frame, px, v: running sums modulo 65536 over the frames."""
    over = Window.partitionBy("series", "px").orderBy("frame")
    step = F.when(F.col("is_first"), F.col("res")).otherwise(S.unzigzag("res"))
    return coded.select("series", "frame", "px", F.sum(step).over(over).bitwiseAND(65535).cast("int").alias("v"))


def frame_at(coded: DataFrame, frame: int, temporal: bool = True) -> DataFrame:
    """One frame; of a temporal sequence its predecessors are read too, and no later one."""
    if frame < 0:
        raise ValueError("there is no frame before the first")
    return undo_frames(coded.where(F.col("frame") <= frame)).where(F.col("frame") == frame) if temporal else coded.where(F.col("frame") == frame)
