"""Regularised lattice regression: data, smoothness and prior terms with robust re-weighting."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.lattice import clamp, corners, grid_coords, luma, neutral_boost, prior_strength, shadow_boost
from . import curves, lattices
from .binning import MEAN_IN, MEAN_OUT
from .quantiles import quantiles
from .storage import kept


@dataclass(frozen=True)
class FitOptions:
    """How a lattice is fitted; the defaults are the engine's."""

    size: int = 33
    kernel: str = "tetrahedral"
    smoothness: float = 0.1
    prior: float = 0.01
    loss: str = "huber"
    delta: float = 1.0
    rounds: int = 3
    connectivity: int = 6
    basis: str = "rgb"
    chroma_ratio: float = 4.0
    neutral_k: float = 3.0
    neutral_sigma: float = 0.12
    shadow: float = 0.25
    deep: float = 0.08
    prior_model: str = "identity"
    coarse: int = 17
    coarse_scale: float = 2.0


def data_rows(samples: DataFrame, n: int, kernel: str, keys: tuple[str, ...] = ("pair_id", "bin_id")) -> DataFrame:
    """(keys..., node, val): the square root of a sample's weight times its interpolation weights."""
    rows = samples.select(*keys, F.sqrt("alpha").alias("root"), F.explode(corners(kernel, *map(F.col, MEAN_IN), n)).alias("c"))
    return rows.select(*keys, F.col("c.node").alias("node"), (F.col("root") * F.col("c.w")).alias("val"))


def data_rhs(samples: DataFrame, keys: tuple[str, ...] = ("pair_id", "bin_id")) -> DataFrame:
    return samples.select(*keys, *((F.sqrt("alpha") * F.col(o)).alias(f"rhs_{k}") for o, k in zip(MEAN_OUT, "rgb")))


def smoothness_rows(nodes: DataFrame, n: int, smoothness: float, shadow: float, deep: float, connectivity: int = 6) -> DataFrame:
    """(row, col, val): the Laplacian, each row scaled by the root of smoothness times its node's shadow boost."""
    return lattices.laplacian(nodes, n, connectivity).withColumn("val", F.col("val") * F.sqrt(smoothness * _boost(F.col("row"), n, shadow, deep)))


def prior_rows(distances: DataFrame, n: int, prior: float, scale: float = 3.0, key: str = "lut_id") -> DataFrame:
    """(key, node_id, val, rhs_r, rhs_g, rhs_b): pull towards the identity, stronger away from data."""
    at = grid_coords(F.col("node_id"), n)
    val = F.sqrt(prior * prior_strength(F.col("distance"), scale))
    return distances.select(key, "node_id", val.alias("val"), *((val * c / float(n - 1)).alias(f"rhs_{k}") for c, k in zip(at, "rgb")))


def _boost(node: Column, n: int, shadow: float | Column, deep: float | Column) -> Column:
    return shadow_boost(luma(*(c / float(n - 1) for c in grid_coords(node, n))), shadow, deep)


def _stencil(x: np.ndarray, n: int, around: list[tuple[int, int, int, float]]) -> np.ndarray:
    """The lattice Laplacian of x, by shifted differences; it is its own transpose."""
    cube, out = x.reshape(n, n, n), np.zeros((n, n, n))
    cut = lambda d: (slice(max(-d, 0), n - max(d, 0)), slice(max(d, 0), n - max(-d, 0)))
    for dr, dg, db, w in around:
        here, there = zip(*(cut(d) for d in (db, dg, dr)))
        out[here] += w * (cube[here] - cube[there])
    return out.ravel()


def _stencil_diagonal(scale: np.ndarray, n: int, around: list[tuple[int, int, int, float]]) -> np.ndarray:
    """The diagonal of the Laplacian, `scale` a node, and the Laplacian again."""
    cube = scale.reshape(n, n, n)
    own, others = np.zeros((n, n, n)), np.zeros((n, n, n))
    cut = lambda d: (slice(max(-d, 0), n - max(d, 0)), slice(max(d, 0), n - max(-d, 0)))
    for dr, dg, db, w in around:
        here, there = zip(*(cut(d) for d in (db, dg, dr)))
        own[here] += w
        others[here] += w * w * cube[there]
    return (cube * own * own + others).ravel()


class _Diagonals:
    """A symmetric sparse matrix of entries (i, j, v), i <= j, as one array for each difference j - i: a lattice has 14 at most."""

    def __init__(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, size: int):
        steps, which = np.unique(j - i, return_inverse=True)
        self.parts = [(int(d), np.bincount(i[which == k], v[which == k], size)) for k, d in enumerate(steps)]
        self.diagonal = next((values for d, values in self.parts if d == 0), np.zeros(size))

    def times(self, x: np.ndarray) -> np.ndarray:
        out = self.diagonal * x
        for d, values in self.parts:
            if d:
                out[:-d] += values[:-d] * x[d:]
                out[d:] += values[:-d] * x[:-d]
        return out


#: Relative change of a channel below which its robust rounds end.
STILL = 1e-4


def _solve(n: int, around, delta: float, robust: bool, first: bool):
    """Conjugate gradients on one channel's normal equations, scaled by their diagonal: Spark's sums for the data, the lattice for the rest."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        size = n**3
        kind, i, v = (table.column(c).to_numpy() for c in ("kind", "i", "v"))
        pairs = kind == 0
        data = _Diagonals(i[pairs], table.column("j").to_numpy()[pairs].astype(np.int64), v[pairs], size)
        order = np.flatnonzero(kind == 1)
        order = order[np.argsort(i[order])]
        smooth, prior, goal, now = (table.column(c).to_numpy()[order] for c in ("smooth", "prior", "goal", "now"))
        b = np.bincount(i[kind == 2], v[kind == 2], size)
        if robust and not first:
            weight = lambda r: np.where(np.abs(r) < delta, 1.0, delta / (np.abs(r) + 1e-8))
            smooth = smooth * weight(np.sqrt(smooth) * _stencil(now, n, around))
            prior = prior * weight(np.sqrt(prior) * (now - goal))
        b = b + prior * goal

        def times(x: np.ndarray) -> np.ndarray:
            return data.times(x) + _stencil(smooth * _stencil(x, n, around), n, around) + prior * x

        x, stop = now.copy(), 1e-10 * max(float(np.linalg.norm(b)), 1e-30)
        diagonal = data.diagonal + _stencil_diagonal(smooth, n, around) + prior
        scale = 1.0 / np.where(diagonal > 0, diagonal, 1.0)
        r = b - times(x)
        p = scale * r
        rz = r @ p
        for _ in range(5000):
            if np.linalg.norm(r) <= stop:
                break
            ap = times(p)
            step = rz / (p @ ap)
            x += step * p
            r -= step * ap
            z = scale * r
            rz, before = r @ z, rz
            p = z + rz / before * p
        moving = robust and (first or bool(np.linalg.norm(x - now) >= STILL * (np.linalg.norm(now) + 1e-8)))
        return pa.table({"lut_id": pa.array([key[0].as_py()] * size, pa.string()), "channel": np.full(size, key[1].as_py(), np.int32), "node_id": np.arange(size), "x": x, "moving": np.full(size, moving)})

    return run


def fit_channels(samples: DataFrame, goals: DataFrame, n: int, o: FitOptions, occupied: bool = True, shadows: DataFrame | None = None) -> DataFrame:
    """Lattices (lut_id, node_id, r, g, b) from samples (lut_id, inputs, outputs, alpha) and goals of the same form as lattices.

    All that grows with samples is Spark's: corner weights, their products summed into normal equations, residuals
    and robust weights of each round. A task then solves one channel of one lattice, whose n^3 unknowns and at
    most 27 products a node are bounded by n, whatever the number of samples. Lattices don't share anything: a channel whose
    values no longer move leaves the robust rounds, whatever the others do. `shadows` (lut_id, shadow, deep) gives lattices thresholds of their own.
    """
    opponent, around = o.basis == "opponent", lattices.offsets(o.connectivity if n >= 3 else 6)
    if opponent:
        samples = samples.withColumns({c: v for c, v in zip(MEAN_OUT, colour.to_opponent(*map(F.col, MEAN_OUT)))})
        goals = goals.withColumns({c: v for c, v in zip("rgb", colour.to_opponent(*map(F.col, "rgb")))})
    at = tuple(c / float(n - 1) for c in grid_coords(F.col("node_id"), n))
    ids = goals.select("lut_id", "node_id")
    if occupied:
        near = samples.select("lut_id", lattices.flat_index(*(F.floor(clamp(F.col(c)) * (n - 1)).cast("long") for c in MEAN_IN), n).alias("node_id")).distinct()
        ids = ids.join(lattices.distance_to_data(near, n), ["lut_id", "node_id"], "left").withColumn("distance", F.coalesce("distance", F.lit(1.0)))
    else:
        ids = ids.withColumn("distance", F.lit(1.0))
    chroma = F.col("channel") > 0
    smooth = o.smoothness * _boost(F.col("node_id"), n, F.col("shadow"), F.col("deep"))
    prior = o.prior * prior_strength(F.col("distance"))
    if opponent:
        smooth = F.when(chroma, smooth * o.chroma_ratio).otherwise(smooth)
        prior = F.when(chroma, prior * neutral_boost(*at, o.neutral_k, o.neutral_sigma)).otherwise(prior)
    own = {"shadow": F.lit(o.shadow), "deep": F.lit(o.deep)}
    if shadows is not None:
        ids, own = ids.join(shadows.select("lut_id", "shadow", "deep"), "lut_id", "left"), {k: F.coalesce(k, v) for k, v in own.items()}
    fixed = ids.withColumns(own).join(goals, ["lut_id", "node_id"]).select("lut_id", "node_id", "distance", "shadow", "deep", F.posexplode(F.array("r", "g", "b")).alias("channel", "goal"))
    fixed = kept(fixed.select("lut_id", "channel", "node_id", smooth.alias("smooth"), prior.alias("prior"), "goal"))
    samples = kept(samples)
    key = ["lut_id", "channel"]
    found: DataFrame | None = None
    moving: DataFrame | None = None
    robust = o.loss == "huber"
    products = F.flatten(F.transform("c", lambda a: F.transform("c", lambda b: F.struct(a["node"].alias("i"), b["node"].alias("j"), (a["w"] * b["w"]).alias("v")))))
    for _ in range(1 + (o.rounds if robust else 0)):
        rows, now = samples, fixed.withColumn("now", F.col("goal"))
        huber = [F.lit(1.0)] * 3
        if found is not None:
            rows = lattices.apply_lattice(samples, _wide(found), n, o.kernel, MEAN_IN, on=("lut_id",))
            off = [F.abs(F.sqrt("alpha") * (F.col(p) - F.col(t))) for p, t in zip(("pr", "pg", "pb"), MEAN_OUT)]
            huber = [F.when(x < o.delta, 1.0).otherwise(o.delta / (x + 1e-8)) for x in off]
            now = fixed.join(found.withColumnRenamed("x", "now"), [*key, "node_id"])
        cornered = rows.withColumn("c", corners(o.kernel, *map(F.col, MEAN_IN), n))
        each = F.posexplode(F.array(*(F.struct((F.col("alpha") * h).alias("w"), F.col(t).alias("y")) for h, t in zip(huber, MEAN_OUT)))).alias("channel", "s")
        long = cornered.select("lut_id", "c", each)
        node = [F.col("p.i").alias("i"), F.col("p.j").alias("j")]
        if found is None:
            # Without robust weights the channels have the same products.
            pairs = cornered.select("lut_id", "alpha", F.explode(products).alias("p")).where("p.i <= p.j AND p.v <> 0").groupBy("lut_id", *node).agg(F.sum(F.col("alpha") * F.col("p.v")).alias("v"))
            pairs = pairs.select("lut_id", F.explode(F.array(*map(F.lit, range(3)))).alias("channel"), "i", "j", "v")
        else:
            pairs = long.select(*key, "s", F.explode(products).alias("p")).where("p.i <= p.j AND p.v <> 0").groupBy(*key, *node).agg(F.sum(F.col("s.w") * F.col("p.v")).alias("v"))
        sums = long.select(*key, "s", F.explode("c").alias("p")).groupBy(*key, F.col("p.node").alias("i")).agg(F.sum(F.col("s.w") * F.col("s.y") * F.col("p.w")).alias("v"))
        none = [F.lit(None).cast("double").alias(c) for c in ("smooth", "prior", "goal", "now")]
        system = pairs.select(*key, F.lit(0).alias("kind"), "i", "j", "v", *none).union(now.select(*key, F.lit(1), F.col("node_id"), F.lit(None).cast("long"), F.lit(None).cast("double"), "smooth", "prior", "goal", "now")).union(sums.select(*key, F.lit(2), "i", F.lit(None).cast("long"), "v", *none))
        if moving is not None:
            system = system.join(moving, key, "left_semi")
        solved = kept(system.groupBy(*key).applyInArrow(_solve(n, around, o.delta, robust, found is None), "lut_id string, channel int, node_id long, x double, moving boolean"))
        if moving is not None:
            found = found.join(moving, key, "left_anti").unionByName(solved.drop("moving"))
        else:
            found = solved.drop("moving")
        moving = solved.where("moving AND node_id = 0").select(*key)
        if not robust or moving.isEmpty():
            break
    out = _wide(found)
    if opponent:
        out = out.select("lut_id", "node_id", *(v.alias(k) for k, v in zip("rgb", colour.from_opponent(*map(F.col, "rgb")))))
    return kept(out)


def _wide(found: DataFrame) -> DataFrame:
    """Channels' values (lut_id, channel, node_id, x) as lattices."""
    return found.groupBy("lut_id", "node_id").agg(*(F.max(F.when(F.col("channel") == c, F.col("x"))).alias(k) for c, k in enumerate("rgb")))


def schedule(size: int, coarse: int) -> list[int]:
    """Sizes from coarse to fine, each doubling the cells, the last one `size`."""
    out, n = [], coarse
    while n < size:
        out.append(n)
        n = 2 * n - 1
    return [*out, size]


def _goal(samples: DataFrame, n: int, value=lambda r, g, b: (r, g, b)) -> DataFrame:
    """Lattices with `value`(r, g, b) at each node, one for each lut_id of the samples."""
    ids = samples.select("lut_id").distinct().select("lut_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n**3 - 1).cast("long"))).alias("node_id"))
    at = tuple(c / float(n - 1) for c in grid_coords(F.col("node_id"), n))
    return ids.select("lut_id", "node_id", *(v.alias(k) for k, v in zip("rgb", value(*at))))


def _zero(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return (F.lit(0.0),) * 3


def fit_lattice(samples: DataFrame, options: FitOptions = FitOptions(), shadows: DataFrame | None = None) -> DataFrame:
    """Lattices fitted to samples (lut_id, ir, ig, ib, or_, og, ob, alpha), clamped to -0.5..1.5; each as if it were alone.

    `prior_model` "identity" pulls towards the identity; "baseline_residual" fits what a lattice's own affine-and-curves baseline leaves,
    "baseline_multigrid_residual" does so from coarse to fine, each level starting from the last; lattices whose baseline
    fails its quality gate go back to the identity, in the jobs of the others. `shadows` (lut_id, shadow, deep) gives lattices thresholds of their own.
    """
    o, n = options, options.size
    if o.prior_model not in ("identity", "baseline_residual", "baseline_multigrid_residual"):
        raise ValueError(f"unknown prior model {o.prior_model}")
    samples = kept(samples.select("lut_id", *MEAN_IN, *MEAN_OUT, "alpha"))
    if o.prior_model == "identity":
        return lattices.clip_lattice(fit_channels(samples, _goal(samples, n), n, o, shadows=shadows))
    base = accepted_baselines(samples, o.delta)
    based, others = samples.join(base, "lut_id"), samples.join(base, "lut_id", "left_anti")
    value = curves.baseline_value(*map(F.col, MEAN_IN))
    if o.prior_model == "baseline_residual":
        rest = based.withColumns({c: F.col(c) - v for c, v in zip(MEAN_OUT, value)}).select(samples.columns)
        return lattices.clip_lattice(_plus(fit_channels(rest.unionByName(others), _goal(base, n, _zero).unionByName(_goal(others, n)), n, o, shadows=shadows), curves.baseline_lattice(base, n)))
    sizes = schedule(n, o.coarse)
    now, at = curves.baseline_lattice(base, sizes[0]), sizes[0]
    based = based.select(samples.columns)
    for i, m in enumerate(sizes):
        now = lattices.resample(now, at, m)
        rest = lattices.apply_lattice(based, now, m, o.kernel, MEAN_IN, on=("lut_id",)).withColumns({c: F.col(c) - F.col(p) for c, p in zip(MEAN_OUT, ("pr", "pg", "pb"))}).select(samples.columns)
        goals = _goal(base, m, _zero)
        if m == n:
            rest, goals = rest.unionByName(others), goals.unionByName(_goal(others, n))
        level = replace(o, smoothness=o.smoothness * o.coarse_scale ** (len(sizes) - 1 - i))
        now, at = kept(_plus(fit_channels(rest, goals, m, level, occupied=m == n, shadows=shadows), now)), m
    return lattices.clip_lattice(now)


def accepted_baselines(samples: DataFrame, delta: float = 1.0) -> DataFrame:
    """(lut_id, theta, xs, ys) of the lattices whose baseline passes the quality gate."""
    base = curves.fit_baseline(samples, delta=delta)
    gate = curves.quality_gate(samples.join(base, "lut_id"), curves.baseline_value(*map(F.col, MEAN_IN)), ("lut_id",))
    return kept(base.join(gate.where("passes"), "lut_id", "left_semi"))


def _plus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lattices `a` with those of `b` added where there are any."""
    more = b.select("lut_id", "node_id", *(F.col(k).alias(f"d{k}") for k in "rgb"))
    return a.join(more, ["lut_id", "node_id"], "left").select("lut_id", "node_id", *((F.col(k) + F.coalesce(f"d{k}", F.lit(0.0))).alias(k) for k in "rgb"))


def refine(lattice: DataFrame, samples: DataFrame, options: FitOptions = FitOptions(), rounds: int = 2, shadows: DataFrame | None = None) -> DataFrame:
    """Refits with less weight on samples whose error is above twice their lattice's 95th percentile, and 0.8 of the smoothness.

    Only lattices with such samples are fitted again; a lattice without any leaves the rounds.
    """
    keep = ["lut_id", *MEAN_IN, *MEAN_OUT, "alpha"]
    samples = samples.select(keep)
    for _ in range(rounds):
        out = lattices.apply_lattice(samples, lattice, options.size, options.kernel, MEAN_IN, on=("lut_id",))
        error = F.sqrt(sum(((F.col(p) - F.col(t)) * (F.col(p) - F.col(t)) for p, t in zip(("pg", "pb"), MEAN_OUT[1:])), (F.col("pr") - F.col("or_")) * (F.col("pr") - F.col("or_"))))
        out = kept(out.withColumn("error", error))
        limits = quantiles(out, ("lut_id",), {"q": (F.col("error"), (0.95,))}).select("lut_id", (2.0 * F.col("q")[0]).alias("limit"))
        out = out.join(limits, "lut_id")
        again = kept(out.where(F.col("error") > F.col("limit")).select("lut_id").distinct())
        if again.isEmpty():
            break
        lowered = F.when(F.col("error") > F.col("limit"), F.col("alpha") * F.col("limit") / (F.col("error") + 1e-8)).otherwise(F.col("alpha"))
        samples = kept(out.withColumn("alpha", lowered).select(keep).join(again, "lut_id", "left_semi"))
        fitted = fit_lattice(samples, replace(options, smoothness=options.smoothness * 0.8), shadows)
        lattice = kept(lattice.join(again, "lut_id", "left_anti").unionByName(fitted.select(lattice.columns)))
    return lattice


def pair_errors(samples: DataFrame, lattice: DataFrame, n: int, kernel: str = "tetrahedral", by: tuple[str, ...] | list[str] = ("pair_id",)) -> DataFrame:
    """(by..., mse): weighted squared error of each pair's samples; infinite without weight."""
    out = lattices.apply_lattice(samples, lattice, n, kernel, MEAN_IN, on=("lut_id",))
    square = sum(((F.col(p) - F.col(t)) * (F.col(p) - F.col(t)) for p, t in zip(("pg", "pb"), MEAN_OUT[1:])), (F.col("pr") - F.col("or_")) * (F.col("pr") - F.col("or_")))
    return out.groupBy(*by).agg(F.when(F.sum("alpha") > 1e-12, F.sum(F.col("alpha") * square) / F.sum("alpha")).otherwise(float("inf")).alias("mse"))
