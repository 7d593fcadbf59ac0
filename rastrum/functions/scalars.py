"""Scalar functions on integer samples, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Depths below this are taken for it: smaller alphabets have no room for run lengths and escapes.
MIN_DEPTH = 4


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bit_depth(most) -> Column:
    """Bits that the largest sample needs; 0 for 0."""
    return F.when(_col(most) > 0, F.length(F.bin(_col(most)))).otherwise(0)


def coding_depth(most) -> Column:
    return F.greatest(bit_depth(most), F.lit(MIN_DEPTH))


def threshold_of(depth: int) -> int:
    """Residuals of at least this size are escaped."""
    return (1 << (depth - 1)) - 1


def escape_of(depth: int) -> int:
    return (1 << depth) - 1


def power2(exponent) -> Column:
    return F.pow(F.lit(2), _col(exponent)).cast("int")


def threshold(depth) -> Column:
    return power2(_col(depth) - 1) - 1


def escape(depth) -> Column:
    return power2(depth) - 1


def high_bit(x) -> Column:
    """Floor of log2, for x > 0."""
    return F.length(F.bin(_col(x))) - 1


def table_step(size) -> Column:
    """How far the spreading of symbols over a coder's table goes on each time."""
    return F.shiftright(_col(size), 1) + F.shiftright(_col(size), 3) + 3


def zigzag(x) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    return F.when(_col(x) >= 0, 2 * _col(x)).otherwise(-2 * _col(x) - 1).cast("int")


def unzigzag(u) -> Column:
    return F.shiftright(_col(u), 1).bitwiseXOR(-_col(u).bitwiseAND(1)).cast("int")


def wrap16(d) -> Column:
    """The signed 16-bit number congruent to d."""
    return ((_col(d) + 32768).bitwiseAND(65535) - 32768).cast("int")


#: Wavelet coefficients of at most this size are literals; others are an escape and two halves.
COEFFICIENT_LIMIT, COEFFICIENT_ESCAPE = 32767, 65535


def coefficient_words(c) -> Column:
    """A signed coefficient as 16-bit words."""
    c = _col(c)
    halves = F.array(F.lit(COEFFICIENT_ESCAPE), F.shiftright(c, 16).bitwiseAND(65535), c.bitwiseAND(65535))
    return F.when(c.between(-COEFFICIENT_LIMIT, COEFFICIENT_LIMIT), F.array(zigzag(c))).otherwise(halves)


def colour_forward(r, g, b) -> dict[str, Column]:
    """The reversible luma and chroma transform; chroma is signed."""
    r, g, b = _col(r), _col(g), _col(b)
    co = r - b
    t = b + F.shiftright(co, 1)
    cg = g - t
    return {"luma": (t + F.shiftright(cg, 1)).cast("int"), "co": co.cast("int"), "cg": cg.cast("int")}


def colour_inverse(luma, co, cg) -> dict[str, Column]:
    luma, co, cg = _col(luma), _col(co), _col(cg)
    t = luma - F.shiftright(cg, 1)
    b = t - F.shiftright(co, 1)
    return {"r": (co + b).cast("int"), "g": (cg + t).cast("int"), "b": b.cast("int")}


def box_value(total) -> Column:
    """Rounded mean of four samples from their sum."""
    return F.floor((_col(total) + 2) / 4).cast("int")


def ratio(raw, packed) -> Column:
    return _col(raw) / _col(packed)


def clamp(x, low, high) -> Column:
    return F.least(F.greatest(_col(x), _col(low)), _col(high))
