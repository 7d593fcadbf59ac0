"""File sources and sinks: raw samples, DICOM, TIFF, PGM, histograms as CSV, benchmark text.

Files are read with Spark's binaryFile source, so any store that Spark reads will do;
the parsers run on their bytes in Arrow functions.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLES = "path string, frame int, y int, x int, v int"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _sample_batches(path: str, frame: int, plane: np.ndarray):
    y, x = np.divmod(np.arange(plane.size), plane.shape[1])
    n = plane.size
    yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.full(n, frame, "int32")), pa.array(y.astype("int32")), pa.array(x.astype("int32")), pa.array(plane.ravel().astype("int32"))], ["path", "frame", "y", "x", "v"])


def raw_samples(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """SAMPLES of headerless files of little-endian 16-bit samples; a file of another size is an error."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(content) != 2 * width * height:
                    raise ValueError(f"{p} has {len(content)} bytes, not {2 * width * height}")
                yield from _sample_batches(p, 0, np.frombuffer(content, "<u2").reshape(height, width))

    return _files(spark, path).mapInArrow(run, SAMPLES)


#: DICOM value representations with a 32-bit length, and transfer syntaxes without compression.
LONG_VR = (b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"OD", b"OL", b"UC", b"UR")
IMPLICIT_LE, EXPLICIT_LE = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"


def parse_dicom(content: bytes) -> dict:
    """rows, columns, frames (list of planes) and instance of an uncompressed little-endian file; the first sample of each pixel is taken."""
    if content[128:132] != b"DICM":
        raise ValueError("not a DICOM file")
    at, explicit, found = 132, True, {}
    while at + 8 <= len(content):
        group, element = struct.unpack_from("<HH", content, at)
        as_explicit = explicit or group == 2
        if as_explicit:
            vr = content[at + 4 : at + 6]
            size, at = (struct.unpack_from("<I", content, at + 8)[0], at + 12) if vr in LONG_VR else (struct.unpack_from("<H", content, at + 6)[0], at + 8)
        else:
            size, at = struct.unpack_from("<I", content, at + 4)[0], at + 8
        if size == 0xFFFFFFFF:
            raise ValueError("encapsulated pixels and sequences of unknown length aren't read")
        found[group, element] = content[at : at + size]
        at += size
        if (group, element) == (2, 0x10):
            syntax = found[2, 0x10].rstrip(b"\0 ").decode()
            if syntax not in (IMPLICIT_LE, EXPLICIT_LE):
                raise ValueError(f"transfer syntax {syntax} isn't read")
            explicit = syntax == EXPLICIT_LE
        if (group, element) == (0x7FE0, 0x10):
            break
    number = lambda tag, default: struct.unpack("<H", found[tag][:2])[0] if tag in found else default
    text = lambda tag, default: int(found[tag].rstrip(b"\0 ") or default) if tag in found else default
    rows, columns, samples, bits = number((0x28, 0x10), 0), number((0x28, 0x11), 0), number((0x28, 2), 1), number((0x28, 0x100), 16)
    count = text((0x28, 8), 1)
    pixels = np.frombuffer(found[0x7FE0, 0x10], "<u2" if bits > 8 else "u1", rows * columns * samples * count)
    frames = pixels.reshape(count, rows, columns, samples)[..., 0]
    return {"rows": rows, "columns": columns, "frames": list(frames), "instance": text((0x20, 0x13), 0)}


def dicom_samples(spark: SparkSession, path: str) -> DataFrame:
    """SAMPLES of multi-frame files, frames in their order."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, plane in enumerate(parse_dicom(content)["frames"]):
                    yield from _sample_batches(p, k, plane)

    return _files(spark, path).mapInArrow(run, SAMPLES)


def dicom_series(spark: SparkSession, path: str) -> DataFrame:
    """SAMPLES of a folder of single-frame files as one series: frames by instance number, then path; sizes must agree."""

    def head(batches):
        for batch in batches:
            found = [parse_dicom(c) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], pa.int32()) for k in ("instance", "rows", "columns"))], ["path", "instance", "rows", "columns"])

    heads = _files(spark, path).mapInArrow(head, "path string, instance int, rows int, columns int")
    from pyspark.sql import Window

    sizes = heads.agg(F.count_distinct("rows", "columns").alias("sizes"))
    order = heads.select("path", (F.row_number().over(Window.orderBy("instance", "path")) - 1).alias("no"))
    checked = order.join(F.broadcast(sizes)).select("path", F.when(F.col("sizes") <= 1, F.col("no")).otherwise(F.raise_error(F.lit("the series' pictures differ in size")).cast("int")).alias("frame"))
    return dicom_samples(spark, path).drop("frame").join(checked, "path").select("path", "frame", "y", "x", "v")


#: The tags of TIFF that are looked at, and bytes of its types.
TIFF_TAGS = {256: "width", 257: "height", 259: "compression", 273: "offsets", 277: "samples", 279: "counts"}
TIFF_SIZES = {1: 1, 3: 2, 4: 4}


def parse_tiff(content: bytes) -> np.ndarray:
    """height x width x 3 bytes of an uncompressed RGB file."""
    end = {b"II": "<", b"MM": ">"}.get(content[:2])
    if end is None or struct.unpack_from(end + "H", content, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(end + "I", content, 4)[0]
    found = {"compression": [1], "samples": [1]}
    for k in range(struct.unpack_from(end + "H", content, at)[0]):
        tag, kind, n = struct.unpack_from(end + "HHI", content, at + 2 + 12 * k)
        if tag in TIFF_TAGS and kind in TIFF_SIZES:
            place = at + 10 + 12 * k
            if n * TIFF_SIZES[kind] > 4:
                place = struct.unpack_from(end + "I", content, place)[0]
            found[TIFF_TAGS[tag]] = struct.unpack_from(f"{end}{n}{'B H I'.split()[(1, 3, 4).index(kind)]}", content, place)
    if found["compression"][0] != 1 or found["samples"][0] != 3:
        raise ValueError("only uncompressed files of three samples a pixel are read")
    data = b"".join(content[o : o + n] for o, n in zip(found["offsets"], found["counts"], strict=True))
    return np.frombuffer(data, "u1", found["width"][0] * found["height"][0] * 3).reshape(found["height"][0], found["width"][0], 3)


def tiff_colours(spark: SparkSession, path: str) -> DataFrame:
    """path, y, x, r, g, b."""

    def run(batches):
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                picture = parse_tiff(content)
                y, x = np.divmod(np.arange(picture.shape[0] * picture.shape[1]), picture.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(y)), *(pa.array(a.astype("int32")) for a in (y, x, *picture.reshape(-1, 3).T))], ["path", "y", "x", "r", "g", "b"])

    return _files(spark, path).mapInArrow(run, "path string, y int, x int, r int, g int, b int")


def pgm(plane: np.ndarray) -> bytes:
    """A 16-bit portable grey map."""
    return f"P5\n{plane.shape[1]} {plane.shape[0]}\n65535\n".encode() + plane.astype(">u2").tobytes()


def raw_bytes(v: list[Column], bits: int = 16) -> Column:
    """Samples of a row as one binary, little-endian; for packing rows in the JVM."""
    one = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0")) if bits <= 8 else F.unhex(F.concat(F.lpad(F.hex(c.bitwiseAND(255)), 2, "0"), F.lpad(F.hex(F.shiftright(c, 8)), 2, "0")))
    return F.concat(*map(one, v))


def write_histogram_csv(residuals: DataFrame, path: str, depth: int, key: str = "image_id", limit: int = 255) -> None:
    """image, residual, count: residuals clamped to the limit, escaped ones as 0."""
    clamped_histogram(residuals, depth, key, limit).select(F.col(key).alias("image"), "residual", F.col("cnt").alias("count")).write.option("header", True).csv(path)


def clamped_histogram(residuals: DataFrame, depth: int, key: str = "image_id", limit: int = 255) -> DataFrame:
    from rastrum.functions.scalars import clamp, threshold_of

    value = F.when(F.abs("residual") >= threshold_of(depth), F.lit(0)).otherwise(clamp("residual", F.lit(-limit), F.lit(limit)))
    return residuals.groupBy(key, value.cast("int").alias("residual")).agg(F.count("*").alias("cnt"))


def benchmark_lines(spark: SparkSession, path: str) -> DataFrame:
    """codec, image, mb_per_s, ratio from lines like `BenchmarkName/codec/image-8  10  123 ns/op  45.6 MB/s  3.4 ratio`."""
    line = spark.read.text(path)
    pick = lambda pattern: F.regexp_extract("value", pattern, 1)
    out = line.select(pick(r"^Benchmark\w*/([^/\s]+)/").alias("codec"), pick(r"^Benchmark\w*/[^/\s]+/([^\s]+?)(?:-\d+)?\s").alias("image"), F.nullif(pick(r"([\d.]+) MB/s"), F.lit("")).cast("double").alias("mb_per_s"), F.nullif(pick(r"([\d.]+) ratio"), F.lit("")).cast("double").alias("ratio"))
    return out.where("codec <> ''")


def by_codec(bench: DataFrame, value: str = "mb_per_s") -> DataFrame:
    """A row per image and a column per codec."""
    return bench.groupBy("image").pivot("codec").agg(F.max(value))


def synthetic_slide(spark: SparkSession, width: int, height: int, seed: int = 7) -> DataFrame:
    """y, x, r, g, b: a coloured, textured disc on white, by hashes of place and seed."""
    at = spark.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    inside = F.pow(F.col("x") - width / 2, 2) + F.pow(F.col("y") - height / 2, 2) < (min(width, height) * 0.4) ** 2
    noise = lambda k: F.pmod(F.xxhash64("x", "y", F.lit(seed), F.lit(k)), F.lit(24)).cast("int")
    colour = lambda base, k: F.when(inside, F.lit(base) + noise(k)).otherwise(F.lit(255))
    return at.select("y", "x", colour(180, 0).alias("r"), colour(110, 1).alias("g"), colour(160, 2).alias("b"))
