"""Percentiles, normalisation, thresholds, outliers and standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import luma
from .binning import SOURCE, TARGET
from .quantiles import quantiles
from .storage import kept

MAD_SCALE = 1.4826


def _affine(source: str, target: str) -> tuple[Column, Column]:
    """Gain and bias that map the source's 5th and 95th percentile, the arrays `source`, onto the target's."""
    s, t = F.col(source), F.col(target)
    gain = (t[1] - t[0]) / F.greatest(s[1] - s[0], F.lit(1e-8))
    return gain, t[0] - gain * s[0]


def pair_normalization(pixels: DataFrame, mode: str) -> DataFrame:
    """(pair_id, gain_r, bias_r, ... ) of each pair, by mode "none", "luma_affine" or "rgb_affine"."""
    if mode == "none":
        return pixels.select("pair_id").distinct().select("pair_id", *(F.lit(v).alias(f"{n}_{c}") for c in "rgb" for n, v in (("gain", 1.0), ("bias", 0.0))))
    ends = (0.05, 0.95)
    if mode == "luma_affine":
        found = quantiles(pixels, ("pair_id",), {k: (luma(*map(F.col, c)), ends) for k, c in (("s", SOURCE), ("t", TARGET))})
        return found.select("pair_id", *(x.alias(f"{n}_{c}") for c in "rgb" for n, x in zip(("gain", "bias"), _affine("s", "t"))))
    if mode == "rgb_affine":
        found = quantiles(pixels, ("pair_id",), {c: (F.col(c), ends) for c in (*SOURCE, *TARGET)})
        return found.select("pair_id", *(x.alias(f"{n}_{c}") for c, s, t in zip("rgb", SOURCE, TARGET) for n, x in zip(("gain", "bias"), _affine(s, t))))
    raise ValueError(f"mode is none, luma_affine or rgb_affine, not {mode!r}")


def normalize_pairs(pixels: DataFrame, mode: str) -> DataFrame:
    """Pixels with each pair's source mapped by its gains and biases; values aren't clipped."""
    found = pair_normalization(pixels, mode)
    return pixels.join(found, "pair_id").withColumns({s: F.col(s) * F.col(f"gain_{c}") + F.col(f"bias_{c}") for s, c in zip(SOURCE, "rgb")}).select(pixels.columns)


def shadow_thresholds(samples: DataFrame, by: tuple[str, ...] = ("pair_id",), columns: tuple[str, ...] = ("ir", "ig", "ib"), shadow: float = 0.25, deep: float = 0.08, gap: float = 0.02, most: float = 0.6) -> DataFrame:
    """(by..., shadow, deep, adapted): thresholds raised to the 30th and 10th percentile of luminance where highlights are low.

    That is where the 99th percentile is below 0.9 and the mean between 0.05 and 0.6; else the given ones stay.
    """
    rows = samples.select(*by, luma(*map(F.col, columns)).alias("l"))
    means = rows.groupBy(*by).agg(F.avg("l").alias("mean"))
    shares = quantiles(rows, by, {"p": (F.col("l"), (0.1, 0.3, 0.99))})
    found = means.join(shares, [*by]) if by else means.crossJoin(shares)
    low = F.greatest(F.lit(deep), F.col("p")[0])
    high = F.least(F.greatest(F.lit(shadow), F.col("p")[1]), F.lit(most))
    high = F.when(high <= low + gap, F.least(F.lit(most), low + gap)).otherwise(high)
    low = F.least(low, high - gap)
    adapted = (F.col("p")[2] < 0.9) & (F.col("mean") > 0.05) & (F.col("mean") < 0.6)
    return found.select(*by, F.when(adapted, high).otherwise(shadow).alias("shadow"), F.when(adapted, low).otherwise(deep).alias("deep"), adapted.alias("adapted"))


def outlier_pairs(errors: DataFrame, sigma: float = 3.0, min_pairs: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """`errors` (by..., pair_id, mse, ...) with `median`, `mad` and `outlier`: mse beyond the median by more than sigma robust deviations.

    Median and deviation are of the finite errors of the pairs with the same keys `by`; infinite, NaN and null errors count as pairs but
    are never outliers. Nothing is an outlier among fewer than max(min_pairs, 3) pairs, or if fewer than min_pairs would be left.
    """
    errors = kept(errors)
    keys, finite = list(by), F.abs(F.col("mse")) < float("inf")
    joined = lambda a, b: a.join(b, keys) if keys else a.crossJoin(b)  # noqa: E731  without keys b is one row
    middle = kept(quantiles(errors, by, {"m": (F.when(finite, F.col("mse")), (0.5,))}).select(*keys, F.col("m")[0].alias("median")))
    off = joined(errors, middle).select(*keys, F.when(finite, F.abs(F.col("mse") - F.col("median"))).alias("off"))
    mad = quantiles(off, by, {"m": (F.col("off"), (0.5,))}).select(*keys, F.col("m")[0].alias("mad"))
    marked = joined(errors, joined(middle, mad)).withColumn("beyond", F.coalesce(finite & (F.col("mse") > F.col("median") + sigma * MAD_SCALE * F.col("mad")), F.lit(False)))
    counts = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_pairs"), F.sum(F.when(F.col("beyond"), 0).otherwise(1)).alias("_left"))
    out = F.col("beyond") & (F.col("_pairs") >= max(min_pairs, 3)) & (F.col("_left") >= min_pairs)
    return joined(marked, counts).withColumn("outlier", out).drop("beyond", "_left", "_pairs")


def robust_standardize(features: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dim, value, z): each dimension less its median, over 1.4826 times its median absolute deviation (1 if tiny)."""
    long = features.select(id_col, F.posexplode(vec_col).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    scale = robust_scale(long)
    return long.join(scale, "dim").select(id_col, "dim", "value", ((F.col("value") - F.col("median")) / F.col("scale")).alias("z"))


def robust_scale(long: DataFrame) -> DataFrame:
    """(dim, median, scale) of rows (dim, value)."""
    middle = kept(quantiles(long, ("dim",), {"m": (F.col("value"), (0.5,))}).select("dim", F.col("m")[0].alias("median")))
    off = long.join(middle, "dim").select("dim", F.abs(F.col("value") - F.col("median")).alias("off"))
    mad = quantiles(off, ("dim",), {"m": (F.col("off"), (0.5,))}).select("dim", (MAD_SCALE * F.col("m")[0]).alias("scale"))
    return middle.join(mad, "dim").withColumn("scale", F.when(F.col("scale") < 1e-8, 1.0).otherwise(F.col("scale")))


def seeded_subsample(df: DataFrame, id_col: str, share: float = 0.1, least: int = 1000, above: int = 10_000) -> DataFrame:
    """All rows up to `above`; else max(share of rows, least) rows in the order of a hash of the id, so that reruns agree.

    Rows are counted in 4096 ranges of the hash. Whole ranges stay where they are; only the range in which the number
    is reached is put in order.
    """
    n = df.count()
    if n <= above:
        return df
    mixed = F.pmod(F.col(id_col) * F.lit(2_654_435_761), F.lit(4_294_967_296))
    part = F.shiftright(mixed, 20)
    counts = {r["part"]: r["count"] for r in df.groupBy(part.alias("part")).count().collect()}
    left = max(int(n * share), least)
    for at in sorted(counts):
        if counts[at] > left:
            break
        left -= counts[at]
    else:
        return df
    return df.where(part < at).union(df.where(part == at).orderBy(mixed, id_col).limit(left))
