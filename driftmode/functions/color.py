"""Colour and pixel projections as column expressions.

All arithmetic is in doubles with literals written as such, so results don't depend on the engine's
decimal rules. ``quantised`` puts values on a grid of 2**-20; sums of such values are exact, hence
independent of order and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The colour matrices, the white point and the thresholds of the L* curve.
RGB_TO_XYZ = ((0.4125, 0.3576, 0.1804), (0.2125, 0.7154, 0.0721), (0.0193, 0.1192, 0.9502))
XYZ_TO_RGB = ((3.2405, -1.5371, -0.4985), (-0.9693, 1.8760, 0.0416), (0.0556, -0.2040, 1.0573))
U_WHITE, V_WHITE = 0.19784977571475, 0.46834507665248
L_THRESHOLD, L_LINEAR = 0.008856, 903.3

GRID = 1048576.0


def quantised(c: Column) -> Column:
    """The value on the grid of 2**-20, halves rounded up."""
    return F.floor(c * F.lit(GRID) + F.lit(0.5)) / F.lit(GRID)


def unpack_rgba(c: Column) -> list[Column]:
    """r, g, b, a of a packed pixel; r is the lowest byte."""
    return [F.shiftright(c, 8 * k).bitwiseAND(0xFF) for k in range(4)]


def pack_rgba(r: Column, g: Column, b: Column) -> Column:
    """A packed pixel with alpha 0; channels are cut to integers."""
    r, g, b = (c.cast("int") for c in (r, g, b))
    return r.bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(F.shiftleft(b, 16))


def xyz(r: Column, g: Column, b: Column) -> list[Column]:
    return [F.lit(m[0]) * r + F.lit(m[1]) * g + F.lit(m[2]) * b for m in RGB_TO_XYZ]


def lightness(y: Column) -> Column:
    rel = y / F.lit(255.0)
    return F.when(rel > L_THRESHOLD, F.lit(116.0) * F.pow(rel, F.lit(1.0) / F.lit(3.0)) - F.lit(16.0)).otherwise(F.lit(L_LINEAR) * rel)


def chroma(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """u' and v'; those of black are set by hand."""
    c = x + F.lit(15.0) * y + F.lit(3.0) * z
    return F.when(c != 0, F.lit(4.0) * x / c).otherwise(F.lit(4.0)), F.when(c != 0, F.lit(9.0) * y / c).otherwise(F.lit(0.6))


def rgb_to_luv(df: DataFrame, quantise: bool = True) -> DataFrame:
    """``df`` with r, g, b replaced by l, u, v."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    x, y, z = xyz(r, g, b)
    rest = [c for c in df.columns if c not in ("r", "g", "b")]
    step = df.select(*rest, x.alias("_x"), y.alias("_y"), z.alias("_z"))
    up, vp = chroma(F.col("_x"), F.col("_y"), F.col("_z"))
    step = step.select(*rest, lightness(F.col("_y")).alias("l"), up.alias("_u"), vp.alias("_v"))
    done = quantised if quantise else (lambda c: c)
    return step.select(
        *rest,
        done(F.col("l")).alias("l"),
        done(F.lit(13.0) * F.col("l") * (F.col("_u") - F.lit(U_WHITE))).alias("u"),
        done(F.lit(13.0) * F.col("l") * (F.col("_v") - F.lit(V_WHITE))).alias("v"),
    )


def clamp_byte(c: Column) -> Column:
    """Rounded half away from zero, within 0 and 255."""
    return F.least(F.greatest(F.round(c, 0).cast("int"), F.lit(0)), F.lit(255))


def luv_to_rgb(df: DataFrame) -> DataFrame:
    """``df`` with l, u, v replaced by bytes r, g, b; all below L 0.1 is black."""
    rest = [c for c in df.columns if c not in ("l", "u", "v")]
    l, black = F.col("l"), F.col("l") < 0.1  # noqa: E741
    t = (l + F.lit(16.0)) / F.lit(116.0)
    y = F.when(l < 8.0, l / F.lit(L_LINEAR)).otherwise(t * t * t)
    safe = F.when(black, F.lit(1.0)).otherwise(l)
    step = df.select(*rest, black.alias("_k"), y.alias("_y"), (F.col("u") / (F.lit(13.0) * safe) + F.lit(U_WHITE)).alias("_u"), (F.col("v") / (F.lit(13.0) * safe) + F.lit(V_WHITE)).alias("_v"))
    v4 = F.when(F.col("_v") == 0, F.lit(None)).otherwise(F.lit(4.0) * F.col("_v"))
    x = F.lit(9.0) * F.col("_u") * F.col("_y") / v4
    z = (F.lit(12.0) - F.lit(3.0) * F.col("_u") - F.lit(20.0) * F.col("_v")) * F.col("_y") / v4
    step = step.select(*rest, "_k", x.alias("_x"), "_y", z.alias("_z"))
    out = [clamp_byte((F.lit(m[0]) * F.col("_x") + F.lit(m[1]) * F.col("_y") + F.lit(m[2]) * F.col("_z")) * F.lit(255.0)) for m in XYZ_TO_RGB]
    return step.select(*rest, *(F.when(F.col("_k"), F.lit(0)).otherwise(c).alias(n) for c, n in zip(out, "rgb")))


def place(idx: Column, width: int | Column) -> tuple[Column, Column]:
    """x and y of a row-major index."""
    w = width if isinstance(width, Column) else F.lit(width)
    x = F.pmod(idx, w)
    return x.cast("int"), ((idx - x) / w).cast("int")


def index_of(x: Column, y: Column, width: int | Column) -> Column:
    w = width if isinstance(width, Column) else F.lit(width)
    return x.cast("bigint") + y.cast("bigint") * w


def truncated(c: Column) -> Column:
    """Cut towards zero."""
    return c.cast("int")


#: Colours of iteration counts, a band of ten each, the last one open.
ITERATION_COLOURS = ((242, 241, 240), (232, 231, 230), (222, 221, 220), (212, 211, 210), (202, 201, 200), (192, 191, 190), (182, 181, 180), (172, 171, 170), (162, 49, 0))


def iteration_colour(iters: Column) -> list[Column]:
    """r, g, b of an iteration count."""
    out = []
    for channel in range(3):
        c = F.lit(ITERATION_COLOURS[-1][channel])
        for band in range(len(ITERATION_COLOURS) - 2, -1, -1):
            c = F.when(iters < 10 * (band + 1), F.lit(ITERATION_COLOURS[band][channel])).otherwise(c)
        out.append(c)
    return out
