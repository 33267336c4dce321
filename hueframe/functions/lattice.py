"""Column builders for points of an N x N x N lattice; a node's id counts red fastest: b * N^2 + g * N + r."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LUMA = (0.2126, 0.7152, 0.0722)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def flat_index(r: Column, g: Column, b: Column, n: int) -> Column:
    return b * (n * n) + g * n + r


def grid_coords(node: Column, n: int) -> tuple[Column, Column, Column]:
    """(r, g, b) of a node id."""
    return F.pmod(node, F.lit(n)), F.pmod(F.floor(node / n), F.lit(n)), F.floor(node / (n * n))


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def bin_index(c: Column, bins: int) -> Column:
    """Bin of a channel; out-of-range values fall into the edge bins."""
    return F.floor(clamp(c, 0.0, 0.999999) * bins).cast("long")


def bin_id(r: Column, g: Column, b: Column, bins: int) -> Column:
    return flat_index(bin_index(r, bins), bin_index(g, bins), bin_index(b, bins), bins)


def occupied_node(r: Column, g: Column, b: Column, n: int) -> Column:
    """The node at or below a colour on every axis."""
    return flat_index(*(F.floor(clamp(c) * (n - 1)).cast("long") for c in (r, g, b)), n)


def _cell(c: Column, n: int) -> tuple[Column, Column]:
    at = clamp(c) * (n - 1)
    low = F.least(F.floor(at), F.lit(n - 2)).cast("long")
    return low, at - low


def trilinear(r: Column, g: Column, b: Column, n: int) -> Column:
    """Array of the cell's eight (node, w)."""
    axes = [_cell(c, n) for c in (r, g, b)]
    corners = []
    for dr in (0, 1):
        for dg in (0, 1):
            for db in (0, 1):
                weight = F.lit(1.0)
                for (_, f), d in zip(axes, (dr, dg, db)):
                    weight = weight * (f if d else 1.0 - f)
                node = flat_index(axes[0][0] + dr, axes[1][0] + dg, axes[2][0] + db, n)
                corners.append(F.struct(node.alias("node"), weight.alias("w")))
    return F.array(*corners)


def tetrahedral(r: Column, g: Column, b: Column, n: int) -> Column:
    """Array of the four (node, w) on the path from the cell's low corner to its high one, largest fraction first.

    On ties the first axis counts as larger, so that largest and smallest are different axes.
    """
    (ir, fr), (ig, fg), (ib, fb) = (_cell(c, n) for c in (r, g, b))
    base = flat_index(ir, ig, ib, n)
    steps = (F.lit(1), F.lit(n), F.lit(n * n))
    high, low = F.greatest(fr, fg, fb), F.least(fr, fg, fb)
    middle = fr + fg + fb - high - low
    first = F.when(fr == high, steps[0]).when(fg == high, steps[1]).otherwise(steps[2])
    last = F.when(fb == low, steps[2]).when(fg == low, steps[1]).otherwise(steps[0])
    far = base + (1 + n + n * n)
    path = ((base, 1.0 - high), (base + first, high - middle), (far - last, middle - low), (far, low))
    return F.array(*(F.struct(node.alias("node"), w.alias("w")) for node, w in path))


KERNELS = {"trilinear": trilinear, "tetrahedral": tetrahedral}


def corners(kernel: str, r: Column, g: Column, b: Column, n: int) -> Column:
    """Nodes and weights by the kernel's name."""
    if kernel not in KERNELS:
        raise ValueError(f"kernel is one of {sorted(KERNELS)}, not {kernel!r}")
    return KERNELS[kernel](r, g, b, n)


def smoothstep(c: Column) -> Column:
    t = clamp(c)
    return t * t * (3.0 - 2.0 * t)


def shadow_boost(lum: Column, shadow: float | Column, deep: float | Column, most: float = 25.0) -> Column:
    """`most` below the deep threshold, 1 above the shadow threshold, a smooth step between."""
    t = smoothstep((lum - F.lit(deep)) / F.greatest(F.lit(shadow) - F.lit(deep), F.lit(1e-8)))
    return most * (1.0 - t) + t


def neutral_boost(r: Column, g: Column, b: Column, k: float = 3.0, sigma: float = 0.12) -> Column:
    """1 + k * exp(-d^2 / 2 sigma^2), d the distance to the axis r = g = b."""
    mean = (r + g + b) / 3.0
    squared = sum(((c - mean) * (c - mean) for c in (g, b)), (r - mean) * (r - mean))
    return 1.0 + k * F.exp(-squared / (2.0 * sigma * sigma))


def prior_strength(distance: Column, scale: float = 3.0) -> Column:
    return 1.0 - F.exp(-distance / scale)


def sanitize(c: Column) -> Column:
    """NaN to 0, infinities to 1 and -1; finite values, negative ones too, stay."""
    v, inf = c.cast("double"), float("inf")
    return F.when(F.isnan(v), 0.0).when(v == inf, 1.0).when(v == -inf, -1.0).otherwise(v)
