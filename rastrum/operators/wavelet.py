"""The reversible 5/3 lifting wavelet over positions of windows; neither direction is a recurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lift(df: DataFrame, keys: list[str], at: str, value: str, predict: int, first: str, only: str | None = None) -> DataFrame:
    """Both lifting steps along `at`; predict is -1 forward and 1 back, `first` the step taken first.  `only` names a column of the cells to lift, which see no others."""
    w = Window.partitionBy(*keys, *([only] if only else [])).orderBy(at)
    odd = F.pmod(F.col(at), F.lit(2)) == 1
    taken = F.col(only) if only else F.lit(True)

    def step(d: DataFrame, name: str) -> DataFrame:
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        if name == "odd":  # an odd sample always has a left neighbour
            return d.withColumn(value, F.when(taken & odd, F.col(value) + predict * F.shiftright(before + F.coalesce(after, before), 1)).otherwise(F.col(value)))
        changed = F.col(value) - predict * F.shiftright(F.coalesce(before, after) + F.coalesce(after, before) + 2, 2)
        return d.withColumn(value, F.when(taken & ~odd, F.coalesce(changed, F.col(value))).otherwise(F.col(value)))  # one without neighbours stays

    for name in (first, "even" if first == "odd" else "odd"):
        df = step(df, name)
    return df.withColumn(value, F.col(value).cast("int"))


def forward(df: DataFrame, keys: list[str], at: str = "x", value: str = "v") -> DataFrame:
    """In place along `at`: even positions become low-pass, odd ones details."""
    return _lift(df, keys, at, value, -1, "odd")


def inverse(df: DataFrame, keys: list[str], at: str = "x", value: str = "v") -> DataFrame:
    return _lift(df, keys, at, value, 1, "even")


def forward_interleaved(df: DataFrame, key: str = "image_id") -> DataFrame:
    """One level in two dimensions with all coefficients where their samples were."""
    return forward(forward(df.select(key, "y", "x", "v"), [key, "y"], "x"), [key, "x"], "y")


def inverse_interleaved(df: DataFrame, key: str = "image_id") -> DataFrame:
    return inverse(inverse(df.select(key, "y", "x", "v"), [key, "x"], "y"), [key, "y"], "x")


def _half(at: str, size: Column, back: bool = False) -> Column:
    """Interleaved position to separated position (low half first), or back."""
    low = F.shiftright(size + 1, 1)
    if back:
        return F.when(F.col(at) < low, 2 * F.col(at)).otherwise(2 * (F.col(at) - low) + 1).cast("int")
    return F.when(F.pmod(F.col(at), F.lit(2)) == 0, F.shiftright(F.col(at), 1)).otherwise(low + F.shiftright(F.col(at), 1)).cast("int")


def _sized(df: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key)
    return df.withColumns({"rows": F.max("y").over(w) + 1, "cols": F.max("x").over(w) + 1})


def sizes(df: DataFrame, key: str = "image_id") -> DataFrame:
    """key, rows, cols."""
    return df.groupBy(key).agg((F.max("y") + 1).alias("rows"), (F.max("x") + 1).alias("cols"))


def _at_level(size: str, level: int) -> Column:
    """The height or width of the low corner after so many levels."""
    return F.shiftright(F.col(size) + ((1 << level) - 1), level)


def _corner(df: DataFrame, level: int) -> DataFrame:
    return df.withColumn("low_", (F.col("y") < _at_level("rows", level)) & (F.col("x") < _at_level("cols", level)))


def _moved(df: DataFrame, level: int, back: bool) -> DataFrame:
    places = {c: F.when(F.col("low_"), _half(c, _at_level(size, level), back)).otherwise(F.col(c)) for c, size in (("x", "cols"), ("y", "rows"))}
    return df.withColumns(places)


def forward_2d(df: DataFrame, levels: int = 1, key: str = "image_id") -> DataFrame:
    """key, y, x, v of a full rectangular grid to its coefficients, subbands apart; each further level takes the low corner.

    All cells stay in one relation, of which each level lifts those of its corner, so
    the plan grows by two sorts a level.
    """
    now = _sized(df.select(key, "y", "x", "v"), key)
    for level in range(levels):
        now = _corner(now, level)
        now = _lift(_lift(now, [key, "y"], "x", "v", -1, "odd", "low_"), [key, "x"], "y", "v", -1, "odd", "low_")
        now = _moved(now, level, False)
    return now.select(key, "y", "x", "v")


def inverse_2d(df: DataFrame, levels: int = 1, key: str = "image_id") -> DataFrame:
    """Back from forward_2d, the coarsest level first."""
    now = _sized(df.select(key, "y", "x", "v"), key)
    for level in range(levels - 1, -1, -1):
        now = _moved(_corner(now, level), level, True)
        now = _lift(_lift(now, [key, "x"], "y", "v", 1, "even", "low_"), [key, "y"], "x", "v", 1, "even", "low_")
    return now.select(key, "y", "x", "v")


def _place(levels: int) -> tuple[Column, Column]:
    """y and x of the coefficient at seq in scan order, from the picture's rows and cols; null beyond its end.

    Up to level k there are as many coefficients as its low corner has cells, and from
    there on come its three bands, each in raster order.
    """
    sized = lambda k: (_at_level("rows", k).cast("long"), _at_level("cols", k).cast("long"))
    r, c = sized(levels)
    bands = [(F.lit(0), r, c, F.lit(0), F.lit(0))]  # first seq, height, width, top, left
    for k in range(levels, 0, -1):
        (r, c), (whole_r, whole_c) = sized(k), sized(k - 1)
        low, right, below = r * c, r * (whole_c - c), (whole_r - r) * c
        bands += [(low, r, whole_c - c, F.lit(0), c), (low + right, whole_r - r, c, r, F.lit(0)), (low + right + below, whole_r - r, whole_c - c, r, c)]
    y = x = F.lit(None)
    for first, height, width, top, left in reversed(bands):
        at, wide = F.col("seq").cast("long") - first, F.greatest(width, F.lit(1))
        inside = at < height * width
        y, x = F.when(inside, top + F.floor(at / wide)).otherwise(y), F.when(inside, left + at % wide).otherwise(x)
    return y.cast("int"), x.cast("int")


def placed(coded: DataFrame, sized: DataFrame, levels: int, key: str = "image_id") -> DataFrame:
    """Adds y and x to coefficients in scan order (key, seq), from the pictures' sizes (key, rows, cols) alone.

    The sizes are what is joined: a table of all places, made from them, would look as
    small to Spark as they are, and be broadcast.  Neither side is, as what follows
    needs each picture's coefficients together anyway.
    """
    y, x = _place(levels)
    return coded.join(sized.select(key, "rows", "cols").hint("merge"), key).withColumns({"y": y, "x": x}).drop("rows", "cols")


def places(sized: DataFrame, levels: int, key: str = "image_id") -> DataFrame:
    """key, seq, y, x: where each coefficient in scan order belongs, from the pictures' sizes (key, rows, cols) alone."""
    y, x = _place(levels)
    cells = sized.select(key, "rows", "cols", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1)).alias("seq"))
    return cells.select(key, "seq", y.alias("y"), x.alias("x"))


def subbands(df: DataFrame, levels: int, key: str = "image_id") -> DataFrame:
    """Adds level and band ('LL', 'HL', 'LH', 'HH') to separated coefficients."""
    sized = _sized(df, key)
    rows, cols = F.col("rows"), F.col("cols")
    level, band = F.lit(levels), F.lit("LL")
    bounds = []
    for k in range(1, levels + 1):
        rows, cols = F.floor((rows + 1) / 2), F.floor((cols + 1) / 2)
        bounds.append((k, rows, cols))
    for k, r, c in reversed(bounds):
        right, below = F.col("x") >= c, F.col("y") >= r
        level = F.when(right | below, F.lit(k)).otherwise(level)
        band = F.when(right & below, F.lit("HH")).when(right, F.lit("HL")).when(below, F.lit("LH")).otherwise(band)
    return sized.withColumns({"level": level.cast("int"), "band": band}).drop("rows", "cols")


def scan_order(df: DataFrame, levels: int, key: str = "image_id") -> DataFrame:
    """Adds seq: coarse to fine, bands in order, raster within a band."""
    rank = F.when(F.col("band") == "LL", 0).when(F.col("band") == "HL", 1).when(F.col("band") == "LH", 2).otherwise(3)
    over = Window.partitionBy(key).orderBy(F.desc("level"), rank, "y", "x")
    return subbands(df, levels, key).withColumn("seq", F.row_number().over(over) - 1)
