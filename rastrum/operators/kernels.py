"""Per-group kernels: reconstruction that needs what it has reconstructed, and whole codecs.

A group is one strip, tile, frame or plane, so its size is bounded by its geometry
whatever the number of images.  Groups go to Arrow functions as rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.functions.scalars import MIN_DEPTH, escape_of, threshold_of
from rastrum.operators import coders


def predict_cell(name: str, w, n, nw, ne):
    """The rules for cells with both neighbours, on arrays."""
    if name == "avg":
        return (w + n) >> 1
    if name == "med":
        return np.where(nw >= np.maximum(w, n), np.minimum(w, n), np.where(nw <= np.minimum(w, n), np.maximum(w, n), w + n - nw))
    if name == "grad":
        room = (np.abs(w - nw) + np.abs(n - nw)) >> 1
        return ((w + n) >> 1) + np.clip((ne - nw) >> 3, -room, room)
    a, b, c = np.abs(n - nw), np.abs(w - nw), np.abs(w + n - 2 * nw)
    return np.where((a <= b) & (a <= c), w, np.where(b <= c, n, nw))


def fronts(height: int, width: int):
    """Cells in an order in which all of a front's neighbours w, n, nw and ne lie in earlier ones: x + 2 y is constant on a front."""
    y, x = np.divmod(np.arange(height * width), width)
    order = np.argsort(x + 2 * y, kind="stable")
    cuts = np.flatnonzero(np.diff((x + 2 * y)[order])) + 1
    return [(y[f], x[f]) for f in np.split(order, cuts)]


def predictions(plane: np.ndarray, name: str, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    w, n = plane[y, np.maximum(x - 1, 0)], plane[np.maximum(y - 1, 0), x]
    nw = plane[np.maximum(y - 1, 0), np.maximum(x - 1, 0)]
    ne = np.where(x + 1 < plane.shape[1], plane[np.maximum(y - 1, 0), np.minimum(x + 1, plane.shape[1] - 1)], nw)
    inner = predict_cell(name, w, n, nw, ne)
    if name == "left":
        return np.where(x > 0, w, 0)
    return np.where((x > 0) & (y > 0), inner, np.where(x > 0, w, np.where(y > 0, n, 0)))


def forward(plane: np.ndarray, name: str) -> np.ndarray:
    y, x = np.divmod(np.arange(plane.size), plane.shape[1])
    return plane - predictions(plane, name, y, x).reshape(plane.shape)


def inverse(residual: np.ndarray, name: str, escaped: np.ndarray | None = None) -> np.ndarray:
    """Samples from residuals, front by front; where `escaped` the residual is the sample."""
    plane = np.zeros(residual.shape, dtype=np.int64)
    for y, x in fronts(*residual.shape):
        guess = predictions(plane, name, y, x)
        plane[y, x] = residual[y, x] + (guess if escaped is None else np.where(escaped[y, x], 0, guess))
    return plane


def to_words(plane: np.ndarray, name: str, depth: int) -> np.ndarray:
    """Residual words in raster order, escapes inline."""
    flat, res = plane.ravel(), forward(plane, name).ravel()
    out = np.abs(res) >= threshold_of(depth)
    at = np.arange(len(flat)) + np.concatenate([[0], np.cumsum(out[:-1])]) if len(flat) else np.zeros(0, dtype=np.int64)
    words = np.zeros(len(flat) + int(out.sum()), dtype=np.int64)
    words[at] = np.where(out, escape_of(depth), res + threshold_of(depth))
    words[at[out] + 1] = flat[out]
    return words


def from_words(words: np.ndarray, shape: tuple[int, int], name: str, depth: int) -> np.ndarray:
    """A sample may equal the escape, so escapes are told apart from the left: of a row of equal words every second one is."""
    mark = words == escape_of(depth)
    place = np.arange(len(words))
    start = np.maximum.accumulate(np.where(mark & ~np.concatenate([[False], mark[:-1]]), place, -1)) if len(words) else place
    escape = mark & ((place - start) % 2 == 0)
    sample = np.concatenate([[False], escape[:-1]]) if len(words) else escape
    first = place[~sample]
    escaped = escape[first]
    value = np.where(escaped, words[np.minimum(first + 1, len(words) - 1)], words[first] - threshold_of(depth)) if len(words) else words
    return inverse(value.reshape(shape), name, escaped.reshape(shape))


def run_words(data: np.ndarray, depth: int) -> np.ndarray:
    """Counts and payload of the runs of a stream."""
    mid, n = (1 << (depth - 1)) - 1, len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))
    size = np.diff([*begin, n])
    islands: list[list] = []  # start, length, same
    for s, k in zip(begin.tolist(), size.tolist(), strict=True):
        if k < 3 and islands and not islands[-1][2]:
            islands[-1][1] += k
        else:
            islands.append([s, k, k >= 3])
    out = []
    for number, (s, k, same) in enumerate(islands):
        room = mid - 1 - (2 if not same and number + 1 < len(islands) else 0)
        while k:
            piece = k if k <= room else mid - 3
            out.append(np.array([piece, data[s]]) if same else np.concatenate([[mid + piece], data[s : s + piece]]))
            s, k = s + piece, k - piece
    return np.concatenate(out)


def unrun_words(words: np.ndarray, depth: int) -> np.ndarray:
    mid, at, out, n = (1 << (depth - 1)) - 1, 0, [], len(words)
    while at < n:
        count = int(words[at])
        if count <= mid:
            out.append(np.full(count, words[at + 1]))
            at += 2
        else:
            out.append(words[at + 1 : at + 1 + count - mid])
            at += 1 + count - mid
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


PLANE = struct.Struct("<4sHIIHB")
ZERO, CONSTANT, CODED = 0, 1, 2


def encode_plane(plane: np.ndarray, predictor: str = "avg", coder: str = "tans", use_runs: bool = True) -> bytes:
    """Prediction, escapes, runs and entropy coding of one plane; constant planes are their value."""
    most = int(plane.max()) if plane.size else 0
    depth = max(MIN_DEPTH, most.bit_length())
    if not plane.size or plane.min() == plane.max():
        return PLANE.pack(b"RPL1", ZERO if most == 0 else CONSTANT, *plane.shape, most, 0)
    words = to_words(plane.astype(np.int64), predictor, depth)
    if use_runs:
        words = run_words(words, depth)
    return PLANE.pack(b"RPL1", CODED, *plane.shape, depth, PREDICTORS.index(predictor) * 2 + use_runs) + coders.encode(words, coder)


PREDICTORS = ("avg", "grad", "med", "paeth", "left")


def decode_plane(blob: bytes) -> np.ndarray:
    magic, mode, height, width, value, flags = PLANE.unpack_from(blob)
    if magic != b"RPL1":
        raise ValueError("not a coded plane")
    if mode != CODED:
        return np.full((height, width), value if mode == CONSTANT else 0, dtype=np.int64)
    words = coders.decode_any(blob[PLANE.size :])
    if flags & 1:
        words = unrun_words(words, value)
    return from_words(words, (height, width), PREDICTORS[flags >> 1], value)


def _dense(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A plane from rows, places taken from the least y and x on; gaps are 0."""
    y, x = y - y.min(), x - x.min()
    plane = np.zeros((int(y.max()) + 1, int(x.max()) + 1), dtype=np.int64)
    plane[y, x] = v
    return plane


def column(data: pa.Table, name: str) -> np.ndarray:
    return data.column(name).to_numpy().astype(np.int64)


def restored(res: DataFrame, predictor: str, keys: list[str]) -> DataFrame:
    """keys, y, x, restored from residuals of a predictor that needs its own results; a group's rows fill a rectangle but for its last row's end."""
    kinds = ", ".join(f"{k} {res.schema[k].dataType.simpleString()}" for k in keys)

    def run(data):
        y, x, r = (column(data, c) for c in ("y", "x", "residual"))
        plane = inverse_partial(y - y.min(), x - x.min(), r, predictor)
        return data.select([*keys, "y", "x"]).append_column("restored", pa.array(plane.astype("int32")))

    return res.select(*keys, "y", "x", "residual").groupBy(*keys).applyInArrow(run, f"{kinds}, y int, x int, restored int")


def inverse_partial(y, x, r, predictor):
    """As inverse, for cells given one by one; cells that aren't there are no neighbour of any that is but to the upper right, where they don't exist either."""
    residual = np.zeros((int(y.max()) + 1, int(x.max()) + 1), dtype=np.int64)
    residual[y, x] = r
    return inverse(residual, predictor)[y, x]


def encoded_planes(grid: DataFrame, keys: list[str], predictor: str = "avg", coder: str = "tans", use_runs: bool = True) -> DataFrame:
    """keys, data (binary), n_samples, length: one coded plane per group of keys."""
    kinds = ", ".join(f"{k} {grid.schema[k].dataType.simpleString()}" for k in keys)

    def run(data):
        blob = encode_plane(_dense(*(column(data, c) for c in ("y", "x", "v"))), predictor, coder, use_runs)
        head = [pa.array([data.column(k)[0].as_py()], data.column(k).type) for k in keys]
        return pa.table([*head, pa.array([blob], pa.binary()), pa.array([data.num_rows], pa.int64()), pa.array([len(blob)], pa.int64())], names=[*keys, "data", "n_samples", "length"])

    return grid.select(*keys, "y", "x", "v").groupBy(*keys).applyInArrow(run, f"{kinds}, data binary, n_samples long, length long")


def decoded_planes(blobs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, v from data, places counted from 0 in each group."""
    kinds = ", ".join(f"{k} {blobs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                plane = decode_plane(batch.column(len(keys))[i].as_py())
                y, x = np.divmod(np.arange(plane.size), max(1, plane.shape[1]))
                head = [pa.array([batch.column(k)[i].as_py()] * plane.size, batch.schema.field(k).type) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*head, pa.array(y.astype("int32")), pa.array(x.astype("int32")), pa.array(plane.ravel().astype("int32"))], [*keys, "y", "x", "v"])

    return blobs.select(*keys, "data").mapInArrow(run, f"{kinds}, y int, x int, v int")


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def coded_streams(symbols: DataFrame, keys: list[str], coder: str = "tans", runs_depth: int | None = None) -> DataFrame:
    """keys, data, n_symbols, length: each group's symbols, in the order of seq, coded; with runs_depth, their run words are."""

    def run(data):
        order = np.argsort(column(data, "seq"), kind="stable")
        sym = column(data, "sym")[order]
        blob = coders.encode(sym if runs_depth is None else run_words(sym, runs_depth), coder)
        head = [pa.array([data.column(k)[0].as_py()], data.column(k).type) for k in keys]
        return pa.table([*head, pa.array([blob], pa.binary()), pa.array([len(order)], pa.int64()), pa.array([len(blob)], pa.int64())], names=[*keys, "data", "n_symbols", "length"])

    return symbols.select(*keys, "seq", "sym").groupBy(*keys).applyInArrow(run, f"{_kinds(symbols, keys)}, data binary, n_symbols long, length long")


def decoded_streams(blobs: DataFrame, keys: list[str], runs_depth: int | None = None) -> DataFrame:
    """keys, seq, sym from data; runs_depth as it was coded."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out = coders.decode_any(batch.column(len(keys))[i].as_py())
                out = out if runs_depth is None else unrun_words(out, runs_depth)
                head = [pa.array([batch.column(k)[i].as_py()] * len(out), batch.schema.field(k).type) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*head, pa.array(np.arange(len(out))), pa.array(out.astype("int32"))], [*keys, "seq", "sym"])

    return blobs.select(*keys, "data").mapInArrow(run, f"{_kinds(blobs, keys)}, seq long, sym int")


def unrun_streams(words: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """keys, seq, sym of whole streams of run words (word_no, word), which say their length in two words first."""

    def run(data):
        word = column(data, "word")[np.argsort(column(data, "word_no"), kind="stable")]
        out = unrun_words(word[2:], depth)
        if len(out) != (int(word[0]) << 16) + int(word[1]):
            raise ValueError("a stream of runs doesn't have the length that it says")
        head = [pa.array([data.column(k)[0].as_py()] * len(out), data.column(k).type) for k in keys]
        return pa.table([*head, pa.array(np.arange(len(out))), pa.array(out.astype("int32"))], names=[*keys, "seq", "sym"])

    return words.select(*keys, "word_no", "word").groupBy(*keys).applyInArrow(run, f"{_kinds(words, keys)}, seq long, sym int")


def coefficients(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, v from coefficient words (seq, sym): zigzagged, or the escape and 32 bits in two words."""

    def run(data):
        word = column(data, "sym")[np.argsort(column(data, "seq"), kind="stable")]
        out, at = [], 0
        while at < len(word):  # literals up to the next escape, then the escape
            ahead = np.flatnonzero(word[at:] == 65535)
            to = at + int(ahead[0]) if len(ahead) else len(word)
            part = word[at:to]
            out.append((part >> 1) ^ -(part & 1))
            if to < len(word):
                wide = (int(word[to + 1]) << 16) | int(word[to + 2])
                out.append(np.array([wide - (1 << 32) if wide >> 31 else wide]))
            at = to + 3
        out = np.concatenate(out) if out else word
        head = [pa.array([data.column(k)[0].as_py()] * len(out), data.column(k).type) for k in keys]
        return pa.table([*head, pa.array(np.arange(len(out))), pa.array(out.astype("int32"))], names=[*keys, "seq", "v"])

    return words.select(*keys, "seq", "sym").groupBy(*keys).applyInArrow(run, f"{_kinds(words, keys)}, seq long, v int")


def mismatches(one: DataFrame, two: DataFrame, on: list[str], value: str, group: str) -> DataFrame:
    """group, n, mismatches between two relations that should have the same rows."""
    a, b = one.select(*on, F.col(value).alias("a")), two.select(*on, F.col(value).alias("b"))
    return a.join(b, on, "full").groupBy(group).agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("mismatches"))
