"""Feature vectors of pairs and sources, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import luma
from .binning import MEAN_IN, MEAN_OUT, SOURCE
from .numbering import numbered

TRANSFORM, APPEARANCE = 18, 8


def _saturation(cols: tuple[str, ...]) -> Column:
    return F.greatest(*cols) - F.least(*cols)


def _mean(x: Column, w: Column) -> Column:
    """Weighted mean; the plain mean if there is no weight."""
    return F.when(F.sum(w) > 1e-12, F.sum(x * w) / F.sum(w)).otherwise(F.avg(x))


def pair_signature(bins: DataFrame) -> DataFrame:
    """(pair_id, transform): 18 count-weighted values of a pair's bins.

    Mean shift, mean absolute shift, deviation of shifts, slope of output on input (three each); mean and deviation
    of luminance and of its shift; mean saturation and its shift. All come from one pass of sums.
    """
    n = F.col("n").cast("double")
    rows = bins.select("pair_id", "n", *MEAN_IN, *MEAN_OUT, luma(*map(F.col, MEAN_IN)).alias("l"), (luma(*map(F.col, MEAN_OUT)) - luma(*map(F.col, MEAN_IN))).alias("dl"), _saturation(MEAN_IN).alias("s"), (_saturation(MEAN_OUT) - _saturation(MEAN_IN)).alias("ds"))
    aggs = {}
    for i, o, c in zip(MEAN_IN, MEAN_OUT, "rgb"):
        x, y = F.col(i), F.col(o)
        aggs |= {f"x_{c}": _mean(x, n), f"y_{c}": _mean(y, n), f"xx_{c}": _mean(x * x, n), f"xy_{c}": _mean(x * y, n), f"ad_{c}": _mean(F.abs(y - x), n), f"dd_{c}": _mean((y - x) * (y - x), n)}
    for v in ("l", "dl"):
        aggs |= {v: _mean(F.col(v), n), f"{v}2": _mean(F.col(v) * F.col(v), n)}
    aggs |= {v: _mean(F.col(v), n) for v in ("s", "ds")}
    m = rows.groupBy("pair_id").agg(*(v.alias(f"m_{k}") for k, v in aggs.items()))
    c = lambda name: F.col(f"m_{name}")
    root = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    shift = {k: c(f"y_{k}") - c(f"x_{k}") for k in "rgb"}
    slope = {k: (c(f"xy_{k}") - c(f"x_{k}") * c(f"y_{k}")) / F.greatest(c(f"xx_{k}") - c(f"x_{k}") * c(f"x_{k}"), F.lit(1e-8)) for k in "rgb"}
    values = [*shift.values(), *(c(f"ad_{k}") for k in "rgb"), *(root(c(f"dd_{k}") - shift[k] * shift[k]) for k in "rgb"), *slope.values(), c("l"), root(c("l2") - c("l") * c("l")), c("dl"), root(c("dl2") - c("dl") * c("dl")), c("s"), c("ds")]
    return m.select("pair_id", F.array(*values).alias("transform"))


def appearance_from_bins(bins: DataFrame, by: str = "pair_id") -> DataFrame:
    """(by, appearance): count-weighted mean and deviation of each source channel, mean luminance and saturation."""
    n = F.col("n").cast("double")
    means = bins.groupBy(by).agg(*(_mean(F.col(i), n).alias(f"m_{i}") for i in MEAN_IN), *(_mean(F.col(i) * F.col(i), n).alias(f"q_{i}") for i in MEAN_IN), _mean(luma(*map(F.col, MEAN_IN)), n).alias("l"), _mean(_saturation(MEAN_IN), n).alias("s"))
    spread = (F.sqrt(F.greatest(F.col(f"q_{i}") - F.col(f"m_{i}") * F.col(f"m_{i}"), F.lit(0.0))) for i in MEAN_IN)
    return means.select(by, F.array(*(F.col(f"m_{i}") for i in MEAN_IN), *spread, F.col("l"), F.col("s")).alias("appearance"))


def appearance_from_pixels(pixels: DataFrame, by: str = "pair_id", columns: tuple[str, ...] = SOURCE) -> DataFrame:
    """The same eight values straight from pixels, unweighted."""
    found = pixels.groupBy(by).agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"d_{c}") for c in columns), F.avg(luma(*map(F.col, columns))).alias("l"), F.avg(_saturation(columns)).alias("s"))
    return found.select(by, F.array(*(F.col(f"m_{c}") for c in columns), *(F.col(f"d_{c}") for c in columns), F.col("l"), F.col("s")).alias("appearance"))


def shot_signatures(frames: DataFrame) -> DataFrame:
    """(shot_id, shot_index, frame_count, appearance) of frames (shot_id, frame_index, appearance): means over each shot's frames, shots by first frame."""
    values = frames.select("shot_id", "frame_index", F.posexplode("appearance").alias("dim", "v")).groupBy("shot_id", "dim").agg(F.avg("v").alias("v"), F.min("frame_index").alias("first"), F.count(F.lit(1)).alias("frames"))
    shots = values.groupBy("shot_id").agg(F.min("first").alias("shot_index"), F.max("frames").alias("frame_count"), F.array_sort(F.collect_list(F.struct("dim", "v"))).alias("a"))
    return shots.select("shot_id", "shot_index", "frame_count", F.transform("a", lambda x: x["v"]).alias("appearance"))


def cluster_centroids(assigned: DataFrame) -> DataFrame:
    """(cluster_id, count, t_sig_00..15, a_sig_00..07): means over rows (cluster_id, transform, appearance).

    The report has room for 16 of the 18 transform values.
    """
    names = [(f"t_sig_{i:02d}", F.col("transform")[i]) for i in range(16)] + [(f"a_sig_{i:02d}", F.col("appearance")[i]) for i in range(APPEARANCE)]
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("count"), *(F.avg(v).alias(n) for n, v in names))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (cluster_id, ...) with cluster_label from (cluster_id, label), or cluster_NN where there is none."""
    known = labels.select("cluster_id", F.col("label").alias("_label"))
    return rows.join(known, "cluster_id", "left").withColumn("cluster_label", F.coalesce("_label", F.format_string("cluster_%02d", F.col("cluster_id") + 1))).drop("_label")


def formatted(c: Column, digits: int) -> Column:
    """Text with `digits` decimals; empty for null."""
    return F.when(c.isNull(), "").otherwise(F.format_string(f"%.{digits}f", c.cast("double")))


def assignment_report(rows: DataFrame) -> DataFrame:
    """The ten text columns of the assignment report, of rows (pair_index from 0, source, target, weight, cluster_id, cluster_label, transfer_fn, normalization, detected, occupied_bins)."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    return rows.select((F.col("pair_index") + 1).cast("string").alias("pair_index"), text("source").alias("source"), text("target").alias("target"), formatted(F.col("weight"), 6).alias("weight"), F.col("cluster_id").cast("string").alias("cluster_id"), "cluster_label", text("transfer_fn").alias("transfer_fn_override"), text("normalization").alias("normalization"), text("detected").alias("detected_transfer_function"), text("occupied_bins").alias("occupied_bins"))


#: Columns of the metrics report and their decimals; None for columns that are text as they are.
METRICS = {"label": None, "output_path": None, "mean_de2000": 4, "median_de2000": 4, "p95_de2000": 4, "max_de2000": 4, "total_variation": 6, "coverage_pct": 3, "oog_pct": 3, "num_pairs": None, "num_pairs_used": None, "occupied_bins": None, "outlier_dropped_count": None, "total_time_s": 3, "cluster_indices": None}


def metrics_report(master: DataFrame, clusters: DataFrame) -> DataFrame:
    """The text columns of the metrics report, of the master's rows and the clusters'."""
    both = master.unionByName(clusters, allowMissingColumns=True)
    have = set(both.columns)
    return both.select(*((F.lit("") if c not in have else formatted(F.col(c), d) if d is not None else F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c, d in METRICS.items()))


def dense_ids(rows: DataFrame, label_col: str, order_col: str) -> DataFrame:
    """Rows with cluster_id 0, 1, ... by the first appearance of their label."""
    firsts = rows.groupBy(label_col).agg(F.min(order_col).alias("first"))
    ids = numbered(firsts, ["first", label_col], "cluster_id").select(label_col, F.col("cluster_id").cast("int").alias("cluster_id"))
    return rows.join(ids, label_col)
