"""From pixels to bins to weighted samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lattice

SOURCE, TARGET = ("sr", "sg", "sb"), ("tr", "tg", "tb")
MEAN_IN, MEAN_OUT, VARIANCE = ("ir", "ig", "ib"), ("or_", "og", "ob"), ("vr", "vg", "vb")


def pair_pixels(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source and target pixels of a pair, joined by position: (pair_id, y, x, sr, sg, sb, tr, tg, tb)."""
    at = ["pair_id", "y", "x"]
    named = lambda df, cols: df.select(*at, *(F.col(c).alias(n) for c, n in zip("rgb", cols)))
    return named(source, SOURCE).join(named(target, TARGET), at)


def sanitize_pixels(pixels: DataFrame, columns: tuple[str, ...] = (*SOURCE, *TARGET)) -> DataFrame:
    return pixels.withColumns({c: lattice.sanitize(F.col(c)) for c in columns})


def bin_pixels(pairs: DataFrame, bins: int = 64, min_samples: int = 3) -> DataFrame:
    """Bins of each pair that hold `min_samples` pixels or more.

    (pair_id, bin_id, n, mean input ir ig ib, mean output or_ og ob, output variance vr vg vb, centroid cx cy).
    Only the bin is clamped; means take the values as they are. Variance is the sample's, 0 for a single pixel;
    the centroid is in shares of the pair's width and height. One shuffle, after sums within tasks: at most
    bins^3 rows of each pair and task move.
    """
    sums = pairs.groupBy("pair_id", lattice.bin_id(*map(F.col, SOURCE), bins).alias("bin_id")).agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(s).alias(m) for s, m in zip(SOURCE, MEAN_IN)),
        *(F.avg(t).alias(m) for t, m in zip(TARGET, MEAN_OUT)),
        *(F.coalesce(F.var_samp(t), F.lit(0.0)).alias(v) for t, v in zip(TARGET, VARIANCE)),
        F.avg("x").alias("cx"),
        F.avg("y").alias("cy"),
        F.max("x").alias("right"),
        F.max("y").alias("bottom"),
    )
    whole = Window.partitionBy("pair_id")
    share = lambda mean, edge: F.col(mean) / F.greatest(F.max(edge).over(whole), F.lit(1))
    return sums.withColumns({"cx": share("cx", "right"), "cy": share("cy", "bottom")}).drop("right", "bottom").where(F.col("n") >= max(min_samples, 1))


def mean_variance() -> Column:
    return (F.col("vr") + F.col("vg") + F.col("vb")) / 3.0


def confidence() -> Column:
    """High for little variance and three pixels or more."""
    return 1.0 / (1.0 + 0.5 * mean_variance()) * F.least(F.lit(1.0), F.col("n") / 3.0)


def contradiction() -> Column:
    """Mean variance against the length of the mean output."""
    length = F.sqrt(F.col("or_") * F.col("or_") + F.col("og") * F.col("og") + F.col("ob") * F.col("ob"))
    return mean_variance() / (length + 0.05)


def contradictory_bins(bins: DataFrame, threshold: float = 0.3) -> DataFrame:
    return bins.withColumn("contradiction", contradiction()).where(F.col("contradiction") > threshold)


def clip_penalty(r: Column, g: Column, b: Column, low: float = 0.05, high: float = 0.98) -> Column:
    """1 inside the range; falls to 0 as the darkest channel nears 0 or the brightest 1."""
    dark, bright = F.least(r, g, b), F.greatest(r, g, b)
    down = F.when(dark < low, dark / low).otherwise(1.0)
    up = F.when(bright > high, (1.0 - bright) / (1.0 - high)).otherwise(1.0)
    return F.greatest(down * up, F.lit(0.0))


def sample_weights(bins: DataFrame, by_frequency: bool = False, min_samples: int = 3, shadow: float | Column = 0.25, over: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Bins as samples with weight `alpha`, whose mean over the rows that share the columns `over` is 1.

    Confidence falls with variance, the more so in shadows: its factor goes from 10 above the shadow threshold to
    0.5 at black... of luminance, linearly. Clipped colours count less; `by_frequency` multiplies by pixels.
    """
    t = lattice.clamp(lattice.luma(*map(F.col, MEAN_IN)) / F.greatest(F.lit(shadow), F.lit(1e-8)))
    trust = 1.0 / (1.0 + (0.5 * t + 10.0 * (1.0 - t)) * mean_variance()) * F.least(F.lit(1.0), F.col("n") / float(max(min_samples, 1)))
    raw = trust * clip_penalty(*map(F.col, MEAN_IN))
    raw = raw * F.col("n") if by_frequency else raw
    mean = F.avg("raw").over(Window.partitionBy(*over))
    weighted = bins.withColumn("raw", raw)
    return weighted.withColumn("alpha", F.when(mean > 1e-8, F.col("raw") / mean).otherwise(F.col("raw"))).drop("raw")


def samples_of(weighted: DataFrame) -> DataFrame:
    return weighted.select("pair_id", "bin_id", "n", *MEAN_IN, *MEAN_OUT, "alpha")


def occupied_nodes(samples: DataFrame, n: int) -> DataFrame:
    """Distinct lattice nodes that samples of a pair fall on."""
    return samples.select("pair_id", lattice.occupied_node(*map(F.col, MEAN_IN), n).alias("node_id")).distinct()


def detect_transfer(pixels: DataFrame) -> DataFrame:
    """(pair_id, transfer): "linear" where a source value is above 2, else "unknown"."""
    return pixels.groupBy("pair_id").agg(F.max(F.greatest(*SOURCE)).alias("highest"), F.avg((F.col("sr") + F.col("sg") + F.col("sb")) / 3.0).alias("mean")).withColumn("transfer", F.when(F.col("highest") > 2.0, "linear").otherwise("unknown"))


def balanced(samples: DataFrame, pairs: DataFrame, mode: str = "by_bins", by: tuple[str, ...] = ()) -> DataFrame:
    """Samples whose weights give each pair its share.

    `pairs` has (pair_id, weight, pixels). A pair's weights sum to its weight ("equal"), times its bins
    ("by_bins") or its pixels ("by_pixels"), and then all are scaled to a mean of 1. Adds `pair_share`. With `by`, keys that both tables
    have, shares are of the pairs with the same keys.
    """
    key = [*by, "pair_id"]
    sums = samples.groupBy(*key).agg(F.sum("alpha").alias("total"), F.count(F.lit(1)).alias("n_bins")).join(pairs.select(*key, "weight", "pixels"), key)
    target = {"equal": F.col("weight"), "by_bins": F.col("weight") * F.col("n_bins"), "by_pixels": F.col("weight") * F.col("pixels")}[mode]
    sums = sums.withColumn("goal", F.when(F.col("total") > 1e-12, target).otherwise(0.0))
    scale = sums.groupBy(*by).agg(F.sum("goal").alias("all_goal"), F.sum("n_bins").alias("all_bins"))
    factor = F.when(F.col("total") > 1e-12, F.col("goal") / F.col("total") * F.col("all_bins") / F.col("all_goal")).otherwise(0.0)
    factors = (sums.join(scale, list(by)) if by else sums.crossJoin(scale)).select(*key, factor.alias("factor"), (F.col("goal") / F.col("all_goal")).alias("pair_share"))
    return samples.join(factors, key).withColumn("alpha", F.col("alpha") * F.col("factor")).drop("factor")
