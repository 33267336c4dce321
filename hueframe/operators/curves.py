"""Piecewise-linear curves, isotonic regression, and the affine-and-curves baseline."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.lattice import clamp, grid_coords
from .binning import MEAN_IN, MEAN_OUT
from .storage import kept

TINY = 1e-8
#: Baselines up to which they are broadcast: 3 kB each, so 12 MB at most. Beyond, Spark joins them by their size.
FEW = 4096


def _keys(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def interpolated(x: Column, xs: Column, ys: Column) -> Column:
    """Value at x of the curve through (xs, ys), arrays in ascending order of xs; constant beyond the ends."""
    i = F.greatest(F.least(F.size(F.filter(xs, lambda k: k <= x)), F.size(xs) - 1), F.lit(1))
    x0, x1, y0, y1 = F.element_at(xs, i), F.element_at(xs, i + 1), F.element_at(ys, i), F.element_at(ys, i + 1)
    inside = y0 + (y1 - y0) * (x - x0) / F.when(x1 > x0, x1 - x0).otherwise(1.0)
    return F.when(F.size(xs) == 1, ys[0]).when(x <= xs[0], ys[0]).when(x >= F.element_at(xs, -1), F.element_at(ys, -1)).otherwise(inside)


def curve_arrays(knots: DataFrame, by: str | Sequence[str] = "channel") -> DataFrame:
    """(by, xs, ys) of knots (by, x, y)."""
    by = _keys(by)
    out = knots.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("k"))
    return out.select(*by, F.transform("k", lambda k: k["x"]).alias("xs"), F.transform("k", lambda k: k["y"]).alias("ys"))


def evaluate(df: DataFrame, curves: DataFrame, x_col: str, out: str, by: str | Sequence[str] = "channel") -> DataFrame:
    """`df` with each row's curve value; one row of arrays for each curve, so an equi-join."""
    return df.join(curves, _keys(by)).withColumn(out, interpolated(F.col(x_col), F.col("xs"), F.col("ys"))).drop("xs", "ys")


def inverse(xs: Column, ys: Column) -> tuple[Column, Column]:
    """Arrays of the curve with axes swapped; flat steps are dropped, a curve without any rise is its mean."""
    zipped = F.arrays_zip(xs.alias("xs"), ys.alias("ys"))
    k = F.filter(zipped, lambda v, i: (i == 0) | (v["ys"] - F.element_at(ys, F.greatest(i, F.lit(1))) > 1e-12))
    mean = F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.size(xs)
    flat = F.size(k) < 2
    return F.when(flat, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.transform(k, lambda v: v["ys"])), F.when(flat, F.array(mean, mean)).otherwise(F.transform(k, lambda v: v["xs"]))


def inverted(curves: DataFrame, by: str | Sequence[str] = "channel") -> DataFrame:
    """(by, xs, ys) of curves (by, xs, ys) with axes swapped."""
    xs, ys = inverse(F.col("xs"), F.col("ys"))
    return curves.select(*_keys(by), xs.alias("xs"), ys.alias("ys"))


def isotonic(points: DataFrame, by: str | Sequence[str] = "channel", order: str = "knot", y: str = "y", w: str = "w") -> DataFrame:
    """(by, order, y) with y non-decreasing and nearest in weighted squares.

    The fitted value at i is the largest, over starts j <= i, of the smallest weighted mean of j..k over ends
    k >= i. Each start has running sums of its own, n^2 / 2 rows for a curve of n knots: differences of sums over the
    whole curve would lose knots of tiny weight.
    """
    by = _keys(by)
    knots = points.select(*by, F.col(order).alias("i"), (F.col(y) * F.col(w)).alias("yw"), F.col(w).alias("w"))
    run = Window.partitionBy(*by, "j").orderBy("i")
    spans = knots.join(knots.select(*by, F.col("i").alias("j")), by).where("j <= i").select(*by, "j", "i", (F.sum("yw").over(run) / F.sum("w").over(run)).alias("m"))
    least = spans.withColumn("m", F.min("m").over(Window.partitionBy(*by, "j").orderBy(F.desc("i"))))
    return least.groupBy(*by, F.col("i").alias(order)).agg(F.max("m").alias(y))


def running_maximum(points: DataFrame, by: str, order: str, y: str) -> DataFrame:
    """Values raised to the largest before them."""
    return points.withColumn(y, F.max(y).over(Window.partitionBy(by).orderBy(order)))


def shaper_table(points: DataFrame, forward, size: int = 4096) -> DataFrame:
    """(curve, i, x, y): `forward` at `size` even places for each distinct `curve` of `points`, made non-decreasing."""
    grid = points.select("curve").distinct().select("curve", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")).withColumn("x", F.col("i") / float(size - 1))
    return running_maximum(grid.withColumn("y", forward(F.col("x"))), "curve", "i", "y")


def affine_value(r: Column, g: Column, b: Column, theta: str = "theta") -> tuple[Column, ...]:
    """M x + b by the column `theta`: for each channel its three factors and its bias."""
    t = F.col(theta)
    return tuple(t[4 * c] * r + t[4 * c + 1] * g + t[4 * c + 2] * b + t[4 * c + 3] for c in range(3))


def baseline_value(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """h_c(M x + b) by the columns `theta`, `xs` and `ys` of a baseline, which has three curves of at most 64 knots."""
    return tuple(interpolated(z, F.col("xs")[c], F.col("ys")[c]) for c, z in enumerate(affine_value(r, g, b)))


def _sums(xs: tuple[Column, ...], y: Column, w: Column, prefix: str = "") -> list[Column]:
    ones = (*xs, F.lit(1.0))
    return [F.sum(w * ones[i] * ones[j]).alias(f"{prefix}a{i}{j}") for i in range(4) for j in range(i, 4)] + [F.sum(w * ones[i] * y).alias(f"{prefix}b{i}") for i in range(4)]


def affine_sums(df: DataFrame, xs: tuple[Column, ...], y: Column, w: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the 4-parameter weighted normal equations: a_ij over inputs and a constant, and b_i."""
    return df.groupBy(*by).agg(*_sums(xs, y, w))


@F.pandas_udf(ArrayType(DoubleType()))
def _solved(sums: pd.Series) -> pd.Series:
    """Least-squares solutions of systems given as 14 sums; the shortest where a system leaves a choice."""
    upper = [(i, j) for i in range(4) for j in range(i, 4)]

    def solve(row: np.ndarray) -> np.ndarray:
        row, a = np.nan_to_num(np.asarray(row, float)), np.zeros((4, 4))
        for (i, j), v in zip(upper, row):
            a[i, j] = a[j, i] = v
        return np.linalg.lstsq(a, row[10:], rcond=None)[0]

    return sums.map(solve)


def _sized(small: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(small) if few else small


def _joined(df: DataFrame, small: DataFrame, by: Sequence[str], few: bool) -> DataFrame:
    """`df` with the columns of its lattice's row of `small`, or with the only row's where there is no `by`."""
    return df.join(_sized(small, few), list(by)) if by else df.join(F.broadcast(small))


def fit_affine(samples: DataFrame, targets: tuple[Column, ...], delta: float = 1.0, rounds: int = 3, by: Sequence[str] = (), few: bool = True) -> DataFrame:
    """(by..., theta): weighted, Huber-robust affine fits, one for each lattice; see `affine_value` for theta.

    Each round is one aggregate, 14 sums for each channel of a lattice. `few` says that the lattices are at most FEW, so that
    the last round's fits are broadcast to the samples.
    """
    keys, xs, solved = [*by, "channel"], tuple(map(F.col, MEAN_IN)), None
    each = F.posexplode(F.array(*targets)).alias("channel", "y")
    long = kept(samples.select(*by, *MEAN_IN, F.greatest(F.col("alpha"), F.lit(0.0)).alias("alpha"), each))
    for _ in range(rounds + 1):
        rows = long.withColumn("w", F.col("alpha"))
        if solved is not None:
            t = F.col("t")
            off = F.abs(t[0] * xs[0] + t[1] * xs[1] + t[2] * xs[2] + t[3] - F.col("y"))
            rows = long.join(_sized(solved, few), keys).withColumn("off", off).withColumn("w", F.col("alpha") * F.when(F.col("off") < delta, 1.0).otherwise(delta / (F.col("off") + TINY)))
        sums = _sums(xs, F.col("y"), F.col("w"))
        solved = rows.groupBy(*keys).agg(F.array(*sums).alias("sums")).select(*keys, _solved("sums").alias("t"))
    whole = solved.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("channel", "t"))).alias("t"))
    return whole.select(*by, F.flatten("t.t").alias("theta"))


def monotone_knots(samples: DataFrame, z: tuple[Column, ...], knots: int = 64, by: Sequence[str] = ()) -> DataFrame:
    """(by..., channel, knot, x, y): weighted means of the outputs in `knots` even bins of z, empty ones interpolated, made isotonic."""
    keys = [*by, "channel"]
    long = samples.select(*by, "alpha", F.posexplode(F.array(*(F.struct(c.alias("z"), F.col(o).alias("y")) for c, o in zip(z, MEAN_OUT)))).alias("channel", "v")).select(*keys, "alpha", "v.z", "v.y")
    ends = long.groupBy(*keys).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    placed = long.join(ends if by else F.broadcast(ends), keys)
    step = F.greatest(F.col("high") - F.col("low"), F.lit(TINY)) / knots
    means = placed.groupBy(*keys, F.least(F.floor((F.col("z") - F.col("low")) / step), F.lit(knots - 1)).cast("int").alias("knot")).agg((F.sum(F.col("alpha") * F.col("y")) / F.sum("alpha")).alias("y"), F.sum("alpha").alias("w")).where("w > 0")
    grid = ends.select(*keys, "low", "high", F.explode(F.sequence(F.lit(0), F.lit(knots - 1))).alias("knot")).withColumn("x", F.col("low") + (F.col("knot") + 0.5) * step)
    known = means.join(grid, [*keys, "knot"])
    filled = evaluate(grid, curve_arrays(known.select(*keys, "x", "y"), keys), "x", "y_line", keys).join(means, [*keys, "knot"], "left")
    # Each curve's knots are read several times below.
    filled = kept(filled.select(*keys, "knot", "x", F.coalesce("y", "y_line").alias("y"), F.coalesce("w", F.lit(TINY)).alias("w")))
    return isotonic(filled.drop("x"), keys).join(filled.select(*keys, "knot", "x"), [*keys, "knot"]).select(*keys, "knot", "x", "y")


def fit_baseline(samples: DataFrame, rounds: int = 3, knots: int = 64, delta: float = 1.0, by: Sequence[str] = ("lut_id",)) -> DataFrame:
    """(by..., theta, xs, ys): for each lattice a baseline of an affine map and three curves, see `baseline_value`.

    Alternates the affine fits, on outputs taken back through the curves, with the curves: all lattices in the same jobs, two for each
    alternation. A lattice without samples has no row; the lattices don't share anything.
    """
    few = not by or samples.select(*by).distinct().count() <= FEW
    back: DataFrame | None = None
    for _ in range(rounds):
        rows, targets = samples, tuple(map(F.col, MEAN_OUT))
        if back is not None:
            rows = _joined(samples, back, by, few)
            targets = tuple(interpolated(o, F.col(f"xs{c}"), F.col(f"ys{c}")) for c, o in enumerate(targets))
        theta = kept(fit_affine(rows, targets, delta, by=by, few=few))
        curves = curve_arrays(monotone_knots(_joined(samples, theta, by, few), affine_value(*map(F.col, MEAN_IN)), knots, by), [*by, "channel"])
        whole = curves.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("channel", "xs", "ys"))).alias("k"))
        found = kept(_joined(whole, theta, by, few).select(*by, "theta", F.col("k.xs").alias("xs"), F.col("k.ys").alias("ys")))
        swapped = F.transform(F.arrays_zip("xs", "ys"), lambda k: F.struct(*(v.alias(n) for n, v in zip(("xs", "ys"), inverse(k["xs"], k["ys"])))))
        ends = found.select(*by, swapped.alias("k"))
        back = kept(ends.select(*by, *(F.col("k")[c][v].alias(f"{v}{c}") for c in range(3) for v in ("xs", "ys"))))
    return found


def quality_gate(samples: DataFrame, predicted: tuple[Column, ...], by: tuple[str, ...] = (), threshold: float = 0.95) -> DataFrame:
    """(by..., ratio, passes): the prediction's weighted squared error over that of leaving colours as they are."""
    square = lambda cols: sum(((F.col(o) - c) * (F.col(o) - c) for o, c in zip(MEAN_OUT[1:], cols[1:])), (F.col("or_") - cols[0]) * (F.col("or_") - cols[0]))
    mean = lambda cols: F.sum(F.col("alpha") * square(cols)) / F.sum("alpha")
    ratio = mean(predicted) / F.greatest(mean(tuple(map(F.col, MEAN_IN))), F.lit(TINY))
    return samples.groupBy(*by).agg(ratio.alias("ratio")).withColumn("passes", F.col("ratio") < threshold)


def baseline_lattice(baselines: DataFrame, n: int) -> DataFrame:
    """Lattices (lut_id, node_id, r, g, b) of baselines (lut_id, theta, xs, ys)."""
    at = tuple(clamp(c / float(n - 1)) for c in grid_coords(F.col("node_id"), n))
    rows = baselines.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n**3 - 1).cast("long"))).alias("node_id"))
    return rows.select("lut_id", "node_id", *(c.alias(k) for c, k in zip(baseline_value(*at), "rgb")))
