"""A fluent way to build one lazy plan over a grid, and codecs for whole pictures.

    Signal(grid, depth=12).predict("grad").symbols().histogram().summary()
    Codec("grad", "tans").decode(Codec("grad", "tans").encode(grid, ["image_id"]), ["image_id"])
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.functions import scalars as S
from rastrum.operators import codebook, kernels, partition, predict, runs, stats, wavelet
from rastrum.sources import container


@dataclass(frozen=True)
class Signal:
    """A relation on its way through prediction, symbols, runs and counts."""

    df: DataFrame
    depth: int = 16
    key: str = "image_id"

    def _next(self, df: DataFrame) -> Signal:
        return Signal(df, self.depth, self.key)

    def predict(self, name: str = "avg") -> Signal:
        return self._next(predict.residuals(self.df, name, self.key))

    def symbols(self, zigzagged: bool = False) -> Signal:
        return self._next(predict.symbols(self.df, self.depth, self.key, zigzagged))

    def runs(self) -> Signal:
        return self._next(runs.runs(self.df, self.depth, self.key))

    def run_words(self) -> Signal:
        words = runs.words(self.df, self.depth, self.key)
        return self._next(words.select(self.key, F.col("word_no").alias("seq"), F.col("word").alias("sym")))

    def wavelet(self, levels: int = 3) -> Signal:
        return self._next(wavelet.scan_order(wavelet.forward_2d(self.df, levels, self.key), levels, self.key))

    def histogram(self) -> Signal:
        return self._next(stats.histogram(self.df, self.key))

    def summary(self) -> DataFrame:
        return stats.coded(stats.summary(self.df, self.key))

    def normalized(self) -> DataFrame:
        return stats.normalized(self.df, self.key)

    def code_lengths(self) -> DataFrame:
        return codebook.huffman_lengths(self.df, self.key)


@dataclass(frozen=True)
class Codec:
    """Planes by predictor and coder; each group of keys is coded on its own."""

    predictor: str = "avg"
    coder: str = "tans"
    use_runs: bool = True

    def encode(self, grid: DataFrame, keys: list[str]) -> DataFrame:
        return kernels.encoded_planes(grid, keys, self.predictor, self.coder, self.use_runs)

    def decode(self, blobs: DataFrame, keys: list[str]) -> DataFrame:
        return kernels.decoded_planes(blobs, keys)


def encode_pyramid(grid: DataFrame, levels: int, tile: int, codec: Codec | None = None, key: str = "image_id") -> DataFrame:
    """key, level, tile_y, tile_x, data, n_samples, length: all levels' tiles, coded."""
    tiled = partition.tiles(partition.pyramid(grid, levels, key), tile, tile)
    return (codec or Codec()).encode(tiled, [key, "level", "tile_y", "tile_x"])


def decode_region(blobs: DataFrame, level: int, x: int, y: int, w: int, h: int, tile: int, key: str = "image_id") -> DataFrame:
    """key, y, x, v of a rectangle of a level; only the tiles that it touches are decoded."""
    if level < 0 or x < 0 or y < 0 or w <= 0 or h <= 0:
        raise ValueError("a region needs a level, a place in the picture and a size")
    touched = blobs.where((F.col("level") == level) & F.col("tile_x").between(x // tile, (x + w - 1) // tile) & F.col("tile_y").between(y // tile, (y + h - 1) // tile))
    samples = Codec().decode(touched, [key, "tile_y", "tile_x"])
    placed = samples.select(key, (F.col("tile_y") * tile + F.col("y")).alias("y"), (F.col("tile_x") * tile + F.col("x")).alias("x"), "v")
    return placed.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))


#: Bits of a tile's number in a container: plane, column, row, level, from the lowest.
PLANE_BITS, PLACE_BITS = 2, 28
COLOURS = ("r", "g", "b")


def _number(level, tile_y, tile_x, plane):
    return F.shiftleft(F.shiftleft(F.shiftleft(level.cast("long"), PLACE_BITS) + tile_y, PLACE_BITS) + tile_x, PLANE_BITS) + plane


def encode_rgb_pyramid(grid: DataFrame, levels: int, tile: int, codec: Codec | None = None, key: str = "image_id") -> DataFrame:
    """key, container: a picture's header and the coded tiles of all its levels, three planes each.

    The header, entry -1, is width, height, tile size and number of levels in 32 bits each.
    """
    cells = partition.pyramid(grid, levels, key, COLOURS)
    c = S.colour_forward(*COLOURS)
    planes = cells.select(key, "level", "y", "x", c["luma"].alias("a"), S.zigzag(c["co"]).alias("b"), S.zigzag(c["cg"]).alias("c"))
    planes = planes.select(key, "level", "y", "x", F.posexplode(F.array("a", "b", "c")).alias("plane", "v"))
    coded = (codec or Codec()).encode(partition.tiles(planes, tile, tile), [key, "level", "tile_y", "tile_x", "plane"])
    tiles = coded.select(key, _number(F.col("level"), F.col("tile_y"), F.col("tile_x"), F.col("plane")).alias("at"), "data")
    word = lambda value: F.lpad(F.hex(value), 8, "0")
    size = grid.groupBy(key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    heads = size.select(key, F.lit(-1).cast("long").alias("at"), F.unhex(F.concat(word("w"), word("h"), word(F.lit(tile)), word(F.lit(levels)))).alias("data"))
    return container.write(heads.unionByName(tiles), key, "at", "tiles")


def pyramid_headers(containers: DataFrame, key: str = "image_id") -> DataFrame:
    """key, width, height, tile, levels, from the containers' headers alone."""
    index = container.read_index(containers, key).where("attribute = -1")
    word = lambda k: F.conv(F.substring(F.hex("data"), 8 * k + 1, 8), 16, 10).cast("int")
    return container.slices(containers, index, key).select(key, *(word(k).alias(n) for k, n in enumerate(("width", "height", "tile", "levels"))))


def decode_rgb_tiles(containers: DataFrame, wanted: DataFrame, key: str = "image_id") -> DataFrame:
    """key, level, tile_y, tile_x, y, x (in the tile), r, g, b of the wanted tiles (key, level, tile_y, tile_x); one that isn't there is an error."""
    numbered = wanted.withColumn("plane", F.explode(F.sequence(F.lit(0), F.lit(2))))
    numbered = numbered.withColumn("attribute", _number(F.col("level"), F.col("tile_y"), F.col("tile_x"), F.col("plane")))
    found = numbered.join(container.read_index(containers, key), [key, "attribute"], "left")
    there = F.when(F.col("length").isNull(), F.raise_error(F.lit("there is no such tile")).cast("long")).otherwise(F.col("length"))
    blobs = container.slices(containers, found.withColumn("length", there), key)
    names = [key, "level", "tile_y", "tile_x", "plane"]
    wide = kernels.decoded_planes(blobs.select(*names, "data"), names).groupBy(key, "level", "tile_y", "tile_x", "y", "x")
    parts = wide.agg(*(F.max(F.when(F.col("plane") == k, F.col("v"))).alias(n) for k, n in enumerate("abc")))
    back = S.colour_inverse("a", S.unzigzag("b"), S.unzigzag("c"))
    return parts.select(key, "level", "tile_y", "tile_x", "y", "x", *(back[n].alias(n) for n in COLOURS))


def decode_rgb_region(containers: DataFrame, level: int, x: int, y: int, w: int, h: int, key: str = "image_id") -> DataFrame:
    """key, y, x, r, g, b of a rectangle of a level, cut at the picture's edge; a level or place that a picture lacks is an error."""
    if level < 0 or x < 0 or y < 0 or w <= 0 or h <= 0:
        raise ValueError("a region needs a level, a place in the picture and a size")
    heads = pyramid_headers(containers, key).withColumns({"wide": F.shiftright("width", level), "high": F.shiftright("height", level)})
    fault = F.when(F.col("levels") <= level, "there is no such level").when((F.col("wide") <= x) | (F.col("high") <= y), "the region lies outside of the picture")
    heads = heads.withColumn("tile", F.when(fault.isNotNull(), F.raise_error(fault).cast("int")).otherwise(F.col("tile")))
    last = lambda at, size, bound: F.floor((F.least(F.lit(at + size), F.col(bound)) - 1) / F.col("tile")).cast("int")
    first = lambda at: F.floor(F.lit(at) / F.col("tile")).cast("int")
    wanted = heads.select(key, "tile", F.lit(level).alias("level"), F.explode(F.sequence(first(y), last(y, h, "high"))).alias("tile_y"), first(x).alias("x0"), last(x, w, "wide").alias("x1"))
    wanted = wanted.select(key, "tile", "level", "tile_y", F.explode(F.sequence("x0", "x1")).alias("tile_x"))
    samples = decode_rgb_tiles(containers, wanted.drop("tile"), key).join(heads.select(key, "tile"), key)
    placed = samples.select(key, (F.col("tile_y") * F.col("tile") + F.col("y")).alias("y"), (F.col("tile_x") * F.col("tile") + F.col("x")).alias("x"), *COLOURS)
    return placed.where(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))
