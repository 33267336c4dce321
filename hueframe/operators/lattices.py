"""Lattices (lut_id, node_id, r, g, b): making, applying, measuring, and their neighbourhoods."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colour
from ..functions.lattice import clamp, corners, flat_index, grid_coords, luma, smoothstep
from .quantiles import quantiles
from .storage import kept

RGB = ("r", "g", "b")
MAX_SIZE = 129


def nodes(spark: SparkSession, n: int) -> DataFrame:
    """(node_id, r_idx, g_idx, b_idx) of all n^3 nodes."""
    if not 2 <= n <= MAX_SIZE:
        raise ValueError(f"a lattice has 2 to {MAX_SIZE} nodes a side, not {n}")
    at = grid_coords(F.col("id"), n)
    return spark.range(n**3).select(F.col("id").alias("node_id"), *(c.cast("int").alias(f"{k}_idx") for c, k in zip(at, RGB)))


def identity_lattice(spark: SparkSession, n: int, lut_id: str = "identity") -> DataFrame:
    return nodes(spark, n).select(F.lit(lut_id).alias("lut_id"), "node_id", *((F.col(f"{k}_idx") / float(n - 1)).alias(k) for k in RGB))


def clip_lattice(lattice: DataFrame, low: float = -0.5, high: float = 1.5) -> DataFrame:
    return lattice.withColumns({k: clamp(F.col(k), low, high) for k in RGB})


#: Nodes a side up to which the cells of a single lattice are broadcast: some 300 bytes for each of (n - 1)^3.
BROADCAST_SIZE = 33


def lattice_cells(lattice: DataFrame, n: int, on: tuple[str, ...] = ()) -> DataFrame:
    """(on..., cell, at): of each of the (n - 1)^3 cells, named by its lowest node, the colours of its eight corners, red fastest."""
    near = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    at = [c.cast("long") for c in grid_coords(F.col("node_id"), n)]
    low = [c - F.shiftright("k", i).bitwiseAND(F.lit(1)) for i, c in enumerate(at)]
    rows = lattice.select(*on, "node_id", *RGB, near).where((F.least(*low) >= 0) & (F.greatest(*low) < n - 1))
    return rows.groupBy(*on, flat_index(*low, n).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("k", *RGB))).alias("at"))


def apply_lattice(df: DataFrame, lattice: DataFrame, n: int, kernel: str = "tetrahedral", columns: tuple[str, str, str] = RGB, out: tuple[str, str, str] = ("pr", "pg", "pb"), on: tuple[str, ...] = ()) -> DataFrame:
    """`df` with the lattice's colour for each row's colour, in the columns `out`.

    The lattice is first gathered by cells, so that one join on the cell gives a row all its corners. The cells of one
    lattice of up to BROADCAST_SIZE nodes a side are broadcast; of a larger one, or with `on`, columns that say which
    lattice a row uses, Spark chooses the join by their size.
    """
    if not 2 <= n <= MAX_SIZE:
        raise ValueError(f"a lattice has 2 to {MAX_SIZE} nodes a side, not {n}")
    cells = lattice_cells(lattice, n, on).withColumnRenamed("cell", "_cell").withColumnRenamed("at", "_at")
    rows = df.withColumn("_c", corners(kernel, *map(F.col, columns), n)).withColumn("_cell", F.col("_c")[0]["node"])
    rows = rows.join(F.broadcast(cells) if not on and n <= BROADCAST_SIZE else cells, [*on, "_cell"])

    def corner(i: int) -> Column:
        step = F.col("_c")[i]["node"] - F.col("_cell")
        place = step % n + 2 * (F.floor(step / n) % n) + 4 * F.floor(step / (n * n))
        return F.element_at("_at", (place + 1).cast("int"))

    k = {"trilinear": 8, "tetrahedral": 4}[kernel]
    value = lambda c: sum((F.col("_c")[i]["w"] * corner(i)[c] for i in range(1, k)), F.col("_c")[0]["w"] * corner(0)[c])
    return rows.select(*df.columns, *(value(c).alias(o) for c, o in zip(RGB, out)))


def resample(lattice: DataFrame, n: int, size: int) -> DataFrame:
    """Lattices of `n` nodes a side read at the nodes of `size` a side, by trilinear interpolation."""
    if n == size:
        return lattice
    at = grid_coords(F.col("node_id"), size)
    targets = lattice.select("lut_id").distinct().select("lut_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size**3 - 1).cast("long"))).alias("node_id"))
    targets = targets.select("lut_id", "node_id", *((c / float(size - 1)).alias(k) for c, k in zip(at, ("x", "y", "z"))))
    return apply_lattice(targets, lattice, n, "trilinear", ("x", "y", "z"), ("pr", "pg", "pb"), ("lut_id",)).select("lut_id", "node_id", *(F.col(f"p{k}").alias(k) for k in RGB))


def _along(axis: int, n: int) -> Window:
    """Windows along one axis of each lattice."""
    at = grid_coords(F.col("node_id"), n)
    rest = [c for i, c in enumerate(at) if i != axis]
    return Window.partitionBy("lut_id", *rest).orderBy(at[axis])


def total_variation(lattice: DataFrame, n: int) -> DataFrame:
    """(lut_id, total_variation): absolute steps along the three axes, over 3 n^3."""
    steps = [F.abs(F.col(c) - F.lag(c).over(_along(axis, n))) for axis in range(3) for c in RGB]
    rows = lattice.select("lut_id", sum((F.coalesce(s, F.lit(0.0)) for s in steps[1:]), F.coalesce(steps[0], F.lit(0.0))).alias("s"))
    return rows.groupBy("lut_id").agg((F.sum("s") / float(3 * n**3)).alias("total_variation"))


def out_of_gamut(lattice: DataFrame) -> DataFrame:
    """(lut_id, oog_pct): share of channel values below 0 or above 1."""
    out = sum((F.when((F.col(c) < 0.0) | (F.col(c) > 1.0), 1).otherwise(0) for c in RGB[1:]), F.when((F.col("r") < 0.0) | (F.col("r") > 1.0), 1).otherwise(0))
    return lattice.groupBy("lut_id").agg((F.sum(out) / (3.0 * F.count(F.lit(1))) * 100.0).alias("oog_pct"))


def neutral_monotonicity(lattice: DataFrame, n: int) -> DataFrame:
    """(lut_id, violations): steps along the grey diagonal on which any channel falls."""
    w = Window.partitionBy("lut_id").orderBy("node_id")
    falls = F.greatest(*(F.when(F.col(c) < F.lag(c).over(w), 1).otherwise(0) for c in RGB))
    return lattice.where(F.col("node_id") % (1 + n + n * n) == 0).select("lut_id", falls.alias("f")).groupBy("lut_id").agg(F.sum("f").alias("violations"))


def lattice_stats(lattice: DataFrame) -> DataFrame:
    return lattice.groupBy("lut_id").agg(*(f(c).alias(f"{name}_{c}") for c in RGB for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))


def offsets(connectivity: int) -> list[tuple[int, int, int, float]]:
    """(dr, dg, db, weight) of the 6, 18 or 26 neighbours: weight 1 over the distance, scaled so that they sum to 6."""
    far = {6: 1, 18: 2, 26: 3}[connectivity]
    steps = [d for d in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, d)) <= far]
    raw = [1.0 / math.sqrt(sum(map(abs, d))) for d in steps]
    return [(*d, w * 6.0 / sum(raw)) for d, w in zip(steps, raw)]


def neighbours(rows: DataFrame, n: int, connectivity: int = 6) -> DataFrame:
    """Rows (node_id, ...) with each of their neighbours inside the lattice: `neighbour` and `weight`."""
    around = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("dr", "dg", "db", "weight"), o))) for o in offsets(connectivity if n >= 3 or connectivity == 6 else 6)))
    at = grid_coords(F.col("node_id"), n)
    moved = [c + F.col(f"o.d{k}") for c, k in zip(at, RGB)]
    inside = (F.least(*moved) >= 0) & (F.greatest(*moved) < n)
    return rows.withColumn("o", F.explode(around)).where(inside).select(*rows.columns, flat_index(*moved, n).cast("long").alias("neighbour"), F.col("o.weight").alias("weight"))


def laplacian(rows: DataFrame, n: int, connectivity: int = 6) -> DataFrame:
    """Matrix (row, col, val) over the distinct node ids of `rows`: minus the weight off, their sum on the diagonal."""
    edges = neighbours(rows.select("node_id").distinct(), n, connectivity)
    off = edges.select(F.col("node_id").alias("row"), F.col("neighbour").alias("col"), (-F.col("weight")).alias("val"))
    return off.union(edges.groupBy("node_id").agg(F.sum("weight").alias("val")).select("node_id", "node_id", "val"))


def laplacian_of(lattice: DataFrame, n: int, connectivity: int = 6) -> DataFrame:
    """(lut_id, node_id, lr, lg, lb): the Laplacian applied to lattices."""
    other = lattice.select("lut_id", F.col("node_id").alias("neighbour"), *(F.col(c).alias(f"n{c}") for c in RGB))
    joined = neighbours(lattice, n, connectivity).join(other, ["lut_id", "neighbour"])
    return joined.groupBy("lut_id", "node_id").agg(*(F.sum(F.col("weight") * (F.col(c) - F.col(f"n{c}"))).alias(f"l{c}") for c in RGB))


def distance_to_data(occupied: DataFrame, n: int, key: str = "lut_id") -> DataFrame:
    """(key, node_id, distance): each node's exact Euclidean distance to the nearest occupied node (key, node_id).

    Axis by axis: a line's squared distances are the smallest of the line's known ones plus the squared step along
    it. A group is one line, at most n entries, so three shuffles of at most n^3 rows do what comparing every
    node with every occupied one would. A key without occupied nodes has no rows.
    """
    at = grid_coords(F.col("node_id"), n)
    rows = occupied.select(key, *(c.cast("int").alias(k) for c, k in zip(at, RGB)), F.lit(0).alias("d")).distinct()
    for axis in RGB:
        rest = [k for k in RGB if k != axis]
        line = rows.groupBy(key, *rest).agg(F.collect_list(F.struct(F.col(axis).alias("at"), "d")).alias("line"))
        line = line.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        rows = line.select(key, *RGB, F.expr(f"array_min(transform(line, x -> x.d + (x.at - {axis}) * (x.at - {axis})))").alias("d"))
    return rows.select(key, flat_index(F.col("r").cast("long"), F.col("g"), F.col("b"), n).alias("node_id"), F.sqrt(F.col("d").cast("double")).alias("distance"))


def coverage(distances: DataFrame, key: str = "lut_id", near: float = 2.0, far: float = 5.0) -> DataFrame:
    """(key, bucket, nodes): nodes that are covered, sparse or empty by their distance to data."""
    bucket = F.when(F.col("distance") < near, "covered").when(F.col("distance") <= far, "sparse").otherwise("empty")
    return distances.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("nodes"))


def quality_metrics(samples: DataFrame, lattice: DataFrame, n: int, kernel: str = "tetrahedral", columns: tuple[str, ...] = ("ir", "ig", "ib", "or_", "og", "ob")) -> DataFrame:
    """One row for each lut_id: differences of predicted and true colours, where they are largest, and the lattice's health.

    `samples` carry lut_id and true colours; `occupied_nodes` counts the nodes they fall on.
    """
    source, truth = columns[:3], columns[3:]
    out = apply_lattice(samples.select("lut_id", *columns), lattice, n, kernel, source, on=("lut_id",))
    for prefix, cols in (("p", ("pr", "pg", "pb")), ("t", truth)):
        out = out.withColumns({f"{prefix}_{k}": v for k, v in zip(("L", "A", "B"), colour.to_lab(*map(F.col, cols)))})
    out = colour.with_delta_e_2000(out, ("p_L", "p_A", "p_B"), ("t_L", "t_A", "t_B"), "de")
    occupied = flat_index(*(F.floor(clamp(F.col(c)) * (n - 1)).cast("long") for c in source), n)
    out = kept(out.select("lut_id", *source, "pr", "pg", "pb", "de", occupied.alias("node")))
    ranks = quantiles(out, ("lut_id",), {"q": (F.col("de"), (0.5, 0.95))}).select("lut_id", F.col("q")[0].alias("median_de2000"), F.col("q")[1].alias("p95_de2000"))
    found = out.groupBy("lut_id").agg(
        F.avg("de").alias("mean_de2000"),
        F.max("de").alias("max_de2000"),
        F.max_by(F.struct(*(F.col(c) for c in ("pr", "pg", "pb"))), F.struct("de", "pr", "pg", "pb")).alias("worst_predicted"),
        F.max_by(F.struct(*(F.col(c).alias(k) for c, k in zip(source, RGB))), F.struct("de", "pr", "pg", "pb")).alias("worst_source"),
        F.countDistinct("node").alias("occupied_nodes"),
    )
    found = found.withColumn("coverage_pct", F.col("occupied_nodes") / float(n**3) * 100.0)
    found = found.join(ranks, "lut_id")
    return found.join(total_variation(lattice, n), "lut_id").join(out_of_gamut(lattice), "lut_id").join(neutral_monotonicity(lattice, n), "lut_id")


def smooth_shadows(lattice: DataFrame, n: int, shadow: float = 0.25, deep: float = 0.08, sigma_deep: float = 3.0, sigma_mid: float = 1.5) -> DataFrame:
    """Lattices blurred in the shadows: two wide Gaussian passes below the deep threshold, a narrow one up to the shadow threshold."""
    lum = luma(*(c / float(n - 1) for c in grid_coords(F.col("node_id"), n)))
    far = blurred(blurred(lattice, n, sigma_deep), n, sigma_deep)
    named = lambda df, p: df.select("lut_id", "node_id", *(F.col(c).alias(f"{p}{c}") for c in RGB))
    both = lattice.join(named(far, "d"), ["lut_id", "node_id"]).join(named(blurred(lattice, n, sigma_mid), "m"), ["lut_id", "node_id"])
    t, s = smoothstep(lum / max(deep, 1e-8)), smoothstep((lum - deep) / max(shadow - deep, 1e-8))
    mix = lambda c: (F.col(f"d{c}") * (1.0 - t) + F.col(f"m{c}") * t) * (1.0 - s) + F.col(c) * s
    return both.select("lut_id", "node_id", *(mix(c).alias(c) for c in RGB))


def blurred(lattice: DataFrame, n: int, sigma: float) -> DataFrame:
    """Gaussian blur, cut at four sigmas, edges mirrored, one axis after the other: each line is gathered once."""
    reach = int(4.0 * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    kernel = [w / sum(raw) for w in raw]
    at = grid_coords(F.col("node_id"), n)
    rows = lattice.select("lut_id", *(c.cast("int").alias(f"{k}_") for c, k in zip(at, RGB)), *RGB)

    def pick(i: int, k: int) -> int:
        j = (i + k) % (2 * n)
        return j if j < n else 2 * n - 1 - j

    # Weight of each place of a line for each other place, mirrored copies summed: n x n numbers, fixed by n and sigma.
    matrix = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for k, w in enumerate(kernel):
            matrix[i][pick(i, k - reach)] += w
    weights = F.array(*(F.array(*map(F.lit, row)) for row in matrix))
    for axis in RGB:
        rest = [f"{k}_" for k in RGB if k != axis]
        line = rows.groupBy("lut_id", *rest).agg(F.array_sort(F.collect_list(F.struct(f"{axis}_", *RGB))).alias("line"))
        line = line.withColumn(f"{axis}_", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("w", F.element_at(weights, F.col(f"{axis}_") + 1))
        dot = lambda c: F.aggregate(F.zip_with("line", "w", lambda x, w: x[c] * w), F.lit(0.0), lambda a, b: a + b)
        rows = line.select("lut_id", *(f"{k}_" for k in RGB), *(dot(c).alias(c) for c in RGB))
    return rows.select("lut_id", flat_index(F.col("r_").cast("long"), F.col("g_"), F.col("b_"), n).alias("node_id"), *RGB)


def hald_identity(spark: SparkSession, level: int) -> DataFrame:
    """The identity plate (y, x, r, g, b) of side level^3, whose lattice has level^2 nodes a side."""
    if not 2 <= level <= 16:
        raise ValueError(f"a level is 2 to 16, not {level}")
    side, n = level**3, level**2
    x, y = F.col("id") % side, F.floor(F.col("id") / side)
    parts = (x % n, F.floor(x / n) + (y % level) * level, F.floor(y / level))
    return spark.range(side * side).select(y.cast("int").alias("y"), x.cast("int").alias("x"), *((c / float(n - 1)).alias(k) for c, k in zip(parts, RGB)))


def hald_place(node: Column, level: int) -> tuple[Column, Column]:
    """(y, x) of a node on the plate."""
    r, g, b = grid_coords(node, level**2)
    return (b * level + F.floor(g / level)).cast("int"), (r + (g % level) * level**2).cast("int")


def hald_readout(plate: DataFrame, level: int) -> DataFrame:
    """Lattices (lut_id, node_id, r, g, b) from processed plates (lut_id, y, x, r, g, b)."""
    n = level**2
    parts = (F.col("x") % n, F.floor(F.col("x") / n) + (F.col("y") % level) * level, F.floor(F.col("y") / level))
    return plate.select("lut_id", flat_index(*(c.cast("long") for c in parts), n).alias("node_id"), *RGB)


#: Output pixels a side of the tiles in which images are scaled.
TILE = 256


def _tiles_of(at: str, old: str, new: str) -> Column:
    """The tiles of output places along one axis that source place `at` has a part in; null if it has none."""
    # A place of the output reads the two source places around it, so that it is less than one from either.
    step = (F.col(old) - 1) / (F.col(new) - 1)
    whole = (F.col(new) == 1) | (F.col(old) == 1)
    low = F.when(whole, F.lit(0.0)).otherwise(F.greatest(F.ceil((F.col(at) - 1) / step - 1e-6), F.lit(0)))
    high = F.when(whole, F.col(new) - 1.0).otherwise(F.least(F.floor((F.col(at) + 1) / step + 1e-6), F.col(new) - 1))
    return F.when((low <= high) & (~whole | (F.col(at) == 0)), F.sequence(F.floor(low / TILE).cast("int"), F.floor(high / TILE).cast("int")))


def _axis(tile: int, old: int, new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Output places of a tile, the lower source place that each reads, and the weight of the upper one."""
    out = np.arange(tile * TILE, min((tile + 1) * TILE, new))
    at = out * (old - 1) / (new - 1) if new > 1 else np.zeros(1)
    low = np.maximum(np.minimum(np.floor(at).astype(np.int64), old - 2), 0)
    return out, low, at - low


def _scaled_tile(key: tuple, rows: pa.Table) -> pa.Table:
    """One tile of output pixels, gathered from the source pixels around it; a place none of whose source pixels is there has no row."""
    image, tile_y, tile_x, h, w, height, width = (k.as_py() for k in key)
    (oy, y0, fy), (ox, x0, fx) = _axis(tile_y, h, height), _axis(tile_x, w, width)
    lines, columns = np.unique([y0, y0 + 1]), np.unique([x0, x0 + 1])
    y, x = rows["y"].to_numpy(), rows["x"].to_numpy()
    near = np.isin(y, lines) & np.isin(x, columns)
    place = (np.searchsorted(lines, y) * len(columns) + np.searchsorted(columns, x))[near]
    shape = len(lines), len(columns)
    held = lambda v, f=None: np.bincount(v, f, shape[0] * shape[1]).reshape(shape)
    there, values = held(place) > 0, []
    for c in RGB:
        given = rows[c].is_valid().to_numpy()[near]
        # Nulls count for nothing, as in a sum.
        values.append((held(place[given], rows[c].fill_null(0.0).to_numpy()[near][given]), held(place[given]) > 0))
    size = len(oy), len(ox)
    seen, sums, known = np.zeros(size, bool), np.zeros((3, *size)), np.zeros((3, *size), bool)
    for dy, wy in ((0, 1.0 - fy), (1, fy)):
        for dx, wx in ((0, 1.0 - fx), (1, fx)):
            weight, at = np.outer(wy, wx), np.ix_(np.searchsorted(lines, y0 + dy), np.searchsorted(columns, x0 + dx))
            used = (weight > 0) & there[at]
            seen |= used
            for c, (sum_, given) in enumerate(values):
                some = used & given[at]
                sums[c][some] += (weight * sum_[at])[some]
                known[c] |= some
    iy, ix = np.nonzero(seen)
    out = {"image_id": pa.array([image] * len(iy), pa.string()), "y": pa.array(oy[iy], pa.int32()), "x": pa.array(ox[ix], pa.int32())}
    return pa.table(out | {c: pa.array(sums[i][iy, ix], pa.float64(), mask=~known[i][iy, ix]) for i, c in enumerate(RGB)})


def resize(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Images (image_id, y, x, r, g, b) scaled bilinearly to sizes (image_id, height, width), corners onto corners.

    Source pixels go once to each tile of 256 x 256 output pixels that reads them: those on a tile's rim go to its neighbour too, those
    that no output pixel reads go nowhere. A tile reads at most four source pixels for each of its own, however far an image is scaled.
    """
    own = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    both = own.join(sizes, "image_id").select("image_id", *(F.col(c).cast("int").alias(c) for c in ("h", "w", "height", "width")))
    rows = pixels.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(F.col(c).cast("double").alias(c) for c in RGB)).join(both, "image_id")
    tiles = rows.withColumn("ty", F.explode(_tiles_of("y", "h", "height"))).withColumn("tx", F.explode(_tiles_of("x", "w", "width")))
    return tiles.groupBy("image_id", "ty", "tx", "h", "w", "height", "width").applyInArrow(_scaled_tile, "image_id string, y int, x int, r double, g double, b double")
