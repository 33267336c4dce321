"""Opponent axes, Lab, Oklab and colour differences as column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lattice import clamp

# The orthonormal opponent basis, one row an axis.
OPPONENT = ((1 / math.sqrt(3),) * 3, (1 / math.sqrt(2), -1 / math.sqrt(2), 0.0), (1 / math.sqrt(6), 1 / math.sqrt(6), -2 / math.sqrt(6)))
# Linear sRGB to XYZ (D65), the white point, and the Oklab matrices.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))

Triple = tuple[Column, Column, Column]


def _times(matrix, v: Triple) -> Triple:
    return tuple(row[0] * v[0] + row[1] * v[1] + row[2] * v[2] for row in matrix)


def to_opponent(r: Column, g: Column, b: Column) -> Triple:
    return _times(OPPONENT, (r, g, b))


def from_opponent(y: Column, c1: Column, c2: Column) -> Triple:
    return _times(tuple(zip(*OPPONENT)), (y, c1, c2))


def srgb_to_linear(c: Column) -> Column:
    v = clamp(c)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_lab(r: Column, g: Column, b: Column) -> Triple:
    """CIE Lab (D65) of display sRGB."""
    d = 6.0 / 29.0

    def f(t: Column) -> Column:
        return F.when(t > d**3, F.cbrt(t)).otherwise(t / (3 * d * d) + 4.0 / 29.0)

    x, y, z = (f(v / w) for v, w in zip(_times(TO_XYZ, tuple(map(srgb_to_linear, (r, g, b)))), WHITE))
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def to_oklab(r: Column, g: Column, b: Column) -> Triple:
    lms = _times(TO_LMS, tuple(map(srgb_to_linear, (r, g, b))))
    return _times(TO_OKLAB, tuple(F.cbrt(F.greatest(v, F.lit(0.0))) for v in lms))


def delta_e_76(p: Triple, q: Triple) -> Column:
    """Euclidean distance in Lab."""
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p[1:], q[1:])), (p[0] - q[0]) * (p[0] - q[0])))


def with_delta_e_2000(df: DataFrame, p: tuple[str, str, str], q: tuple[str, str, str], name: str) -> DataFrame:
    """`df` with CIEDE2000, after Sharma, Wu and Dalal (2005), between the Lab columns p and q, as column `name`.

    Intermediate values are columns of their own for as long as they are used, so that the plan computes each once.
    """
    l1, a1, b1, l2, a2, b2 = map(F.col, (*p, *q))
    kept = df.columns

    def hue(x: Column, y: Column) -> Column:
        h = F.degrees(F.atan2(y, x))
        return F.when((x == 0.0) & (y == 0.0), 0.0).when(h < 0.0, h + 360.0).otherwise(h)

    def seventh(c: Column) -> Column:
        c7 = F.pow(c, F.lit(7.0))
        return F.sqrt(c7 / (c7 + 25.0**7))

    c = F.col
    df = df.withColumn("_g", 0.5 * (1.0 - seventh((F.hypot(a1, b1) + F.hypot(a2, b2)) / 2.0)))
    df = df.withColumns({"_x1": a1 * (1.0 + c("_g")), "_x2": a2 * (1.0 + c("_g"))})
    df = df.withColumns({"_c1": F.hypot(c("_x1"), b1), "_c2": F.hypot(c("_x2"), b2), "_h1": hue(c("_x1"), b1), "_h2": hue(c("_x2"), b2)})
    turn, total, grey = c("_h2") - c("_h1"), c("_h1") + c("_h2"), c("_c1") * c("_c2") == 0.0
    df = df.withColumns(
        {
            "_dh": F.when(grey, 0.0).when(F.abs(turn) <= 180.0, turn).when(turn > 180.0, turn - 360.0).otherwise(turn + 360.0),
            "_hm": F.when(grey, total).when(F.abs(turn) <= 180.0, total / 2.0).when(total < 360.0, (total + 360.0) / 2.0).otherwise((total - 360.0) / 2.0),
            "_cm": (c("_c1") + c("_c2")) / 2.0,
            "_lm": ((l1 + l2) / 2.0 - 50.0) * ((l1 + l2) / 2.0 - 50.0),
        }
    )
    hm = c("_hm")
    wave = 1.0 - 0.17 * F.cos(F.radians(hm - 30.0)) + 0.24 * F.cos(F.radians(2.0 * hm)) + 0.32 * F.cos(F.radians(3.0 * hm + 6.0)) - 0.20 * F.cos(F.radians(4.0 * hm - 63.0))
    df = df.withColumns(
        {
            "_u": (l2 - l1) / (1.0 + 0.015 * c("_lm") / F.sqrt(20.0 + c("_lm"))),
            "_v": (c("_c2") - c("_c1")) / (1.0 + 0.045 * c("_cm")),
            "_w": 2.0 * F.sqrt(c("_c1") * c("_c2")) * F.sin(F.radians(c("_dh") / 2.0)) / (1.0 + 0.015 * c("_cm") * wave),
            "_r": -2.0 * seventh(c("_cm")) * F.sin(F.radians(60.0 * F.exp(-F.pow((hm - 275.0) / 25.0, F.lit(2.0))))),
        }
    )
    u, v, w = c("_u"), c("_v"), c("_w")
    return df.select(*kept, F.sqrt(F.greatest(u * u + v * v + w * w + c("_r") * v * w, F.lit(0.0))).alias(name))
