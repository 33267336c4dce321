"""Routing of ordered shots to clusters: distances, smoothing, assignment and reports."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered
from .statistics import MAD_SCALE
from .storage import kept


def _centroid_scale(long: DataFrame) -> DataFrame:
    """(dim, median, scale) of centroids' values (dim, value), which are a row a cluster."""
    middle = long.groupBy("dim").agg(F.median("value").alias("median"))
    mad = long.join(middle, "dim").groupBy("dim").agg(F.first("median").alias("median"), (MAD_SCALE * F.median(F.abs(F.col("value") - F.col("median")))).alias("scale"))
    return mad.withColumn("scale", F.when(F.col("scale") < 1e-8, 1.0).otherwise(F.col("scale")))


def shot_distances(shots: DataFrame, centroids: DataFrame) -> DataFrame:
    """(track, shot_index, cluster_id, distance): Euclidean distance of each shot's vector to each centroid's.

    shots (track, shot_index, vec), centroids (cluster_id, vec). Dimensions are scaled by the centroids' median and
    robust deviation. Centroids are one row a cluster; shots stay where they are.
    """
    long = centroids.select("cluster_id", F.posexplode("vec").alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    scaled = long.join(_centroid_scale(long), "dim").select("cluster_id", "dim", "median", "scale", ((F.col("value") - F.col("median")) / F.col("scale")).alias("z"))
    rows = scaled.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("dim", "median", "scale", "z"))).alias("c")).orderBy("cluster_id").collect()
    options = F.array(*(F.struct(F.lit(r["cluster_id"]).alias("cluster_id"), F.array(*(F.struct(*(F.lit(float(v[k])).alias(k) for k in ("median", "scale", "z"))) for v in r["c"])).alias("c")) for r in rows))
    off = F.zip_with(F.col("vec"), F.col("o.c"), lambda v, c: ((v.cast("double") - c["median"]) / c["scale"] - c["z"]))
    distance = F.sqrt(F.aggregate(off, F.lit(0.0), lambda a, v: a + v * v))
    return shots.withColumn("o", F.explode(options)).select("track", "shot_index", F.col("o.cluster_id").alias("cluster_id"), distance.alias("distance"))


#: Shots that one task takes at a time.
SEGMENT = 4096


def moving_average(distances: DataFrame, window: int, segment: int = SEGMENT) -> DataFrame:
    """Distances averaged over `window` shots around each; beyond a track's ends its first and last values count on.

    A series of shots is cut into segments, of which each has copies of the `window // 2` shots beside it, so that no task
    holds a series however long it is; its first and last value come from an aggregate.
    """
    if window % 2 == 0:
        raise ValueError(f"a window has an odd number of shots, not {window}")
    pad, size = window // 2, max(segment, window // 2, 1)
    series = ["track", "cluster_id"]
    placed = kept(numbered(distances, ["shot_index"], "_p", series))
    ends = placed.groupBy(*series).agg((F.max("_p") + 1).alias("_n"), F.min_by("distance", "_p").alias("_first"), F.max_by("distance", "_p").alias("_last"))
    part, at = F.floor(F.col("_p") / size), F.col("_p") % size
    copies = F.array_compact(F.array(part, F.when(at < pad, part - 1), F.when(at >= size - pad, part + 1)))
    rows = placed.withColumn("_home", part).withColumn("_part", F.explode(copies))
    near = Window.partitionBy(*series, "_part").orderBy("_p").rowsBetween(-pad, pad)
    inside = rows.withColumn("_sum", F.sum("distance").over(near)).where(F.col("_part") == F.col("_home")).join(ends, series)
    missing = lambda m: F.greatest(m, F.lit(0))
    total = F.col("_sum") + missing(pad - F.col("_p")) * F.col("_first") + missing(F.col("_p") + pad - F.col("_n") + 1) * F.col("_last")
    return inside.withColumn("distance", total / float(window)).select(distances.columns)


def nearest(distances: DataFrame) -> DataFrame:
    """(track, shot_index, cluster_id): the smallest distance, ties to the smallest id."""
    return distances.groupBy("track", "shot_index").agg(F.min(F.struct("distance", "cluster_id")).alias("m")).select("track", "shot_index", "m.cluster_id")


def _step(cost: np.ndarray, d: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Costs after one more shot, and the cluster before it for each cluster, along the last axis. On equal costs the smallest cluster comes first, be it staying or moving."""
    j = cost.argmin(-1)[..., None]
    moved, here = np.take_along_axis(cost, j, -1) + penalty, np.arange(cost.shape[-1])
    stay = (cost < moved) | ((cost == moved) & (here <= j))
    return d + np.where(stay, cost, moved), np.where(stay, here, j)


def _segment_costs(d: np.ndarray, penalty: float) -> np.ndarray:
    """(k + 1, k): least costs of a segment's shots that end in a cluster, for each cluster in which the shot before it was, and at last for no shot before it."""
    k = d.shape[1]
    cost = np.vstack([_step(np.where(np.eye(k, dtype=bool), 0.0, np.inf), d[0], penalty)[0], d[:1]])
    for row in d[1:]:
        cost = _step(cost, row, penalty)[0]
    return cost


def _traced(d: np.ndarray, entry: np.ndarray | None, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Costs after a segment, and for each of its shots the cluster before; `entry` are the costs before it."""
    back = np.zeros(d.shape, np.int64)
    cost = d[0]
    if entry is not None:
        cost, back[0] = _step(entry, d[0], penalty)
    for t in range(1, len(d)):
        cost, back[t] = _step(cost, d[t], penalty)
    return cost, back


def cheapest_path(distances: DataFrame, penalty: float, segment: int = SEGMENT) -> DataFrame:
    """(track, shot_index, cluster_id, cost): the path of least distance plus `penalty` for each change of cluster.

    A track is cut into segments of shots by their index, which may have gaps. Each gives the least costs between any clusters before and at its end, k x k numbers; those,
    folded in order, give the costs at which each segment starts; from them each segment tells which cluster before it leads to which at its
    end; followed from the last, that gives each segment's ends, and then its shots. All shots are worked on segment by segment;
    the two folds hold k x k and k numbers a segment of one track, not its shots. All shots of a track have the same clusters.
    """
    wide = distances.groupBy("track", "shot_index").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "distance"))).alias("d"))
    shots = F.array_sort(F.collect_list(F.struct("shot_index", "d")))
    rows = wide.groupBy("track", F.floor(F.col("shot_index") / segment).cast("long").alias("seg")).agg(shots.alias("s"))
    segments = kept(rows.select("track", "seg", F.col("s.shot_index").alias("shots"), F.col("s")[0]["d"]["cluster_id"].alias("ids"), F.flatten(F.transform("s", lambda v: v["d"]["distance"])).alias("d")))

    def costs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            m = [_segment_costs(np.reshape(d, (-1, len(ids))), penalty).ravel() for d, ids in zip(f.d, f.ids)]
            yield pd.DataFrame({"track": f.track, "seg": f.seg, "m": m})

    def entries(group: pd.DataFrame) -> pd.DataFrame:
        out, now = [], None
        for m in group.sort_values("seg").m:
            out.append(now)
            m = np.reshape(m, (-1, math.isqrt(len(m))))  # (k + 1) k numbers
            now = m[-1] if now is None else (now[:, None] + m[:-1]).min(0)
        return pd.DataFrame({"track": group.track, "seg": np.sort(group.seg), "entry": out})

    starts = kept(segments.mapInPandas(costs, "track string, seg long, m array<double>").groupBy("track").applyInPandas(entries, "track string, seg long, entry array<double>"))
    with_costs = segments.join(starts, ["track", "seg"])

    def maps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for d, ids, entry in zip(f.d, f.ids, f.entry):
                cost, back = _traced(np.reshape(d, (-1, len(ids))), entry, penalty)
                at = np.arange(len(ids))
                for row in back[::-1]:
                    at = row[at]
                out.append((at, cost))
            yield pd.DataFrame({"track": f.track, "seg": f.seg, "back": [a for a, _ in out], "costs": [c for _, c in out]})

    def exits(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seg")
        back, last = list(group.back), np.asarray(group.costs.iloc[-1])
        at, out = int(last.argmin()), []
        for b in back[::-1]:
            out.append(at)
            at = int(b[at])
        return pd.DataFrame({"track": group.track, "seg": group.seg, "exit": out[::-1], "cost": float(last.min())})

    ends = kept(with_costs.mapInPandas(maps, "track string, seg long, back array<long>, costs array<double>").groupBy("track").applyInPandas(exits, "track string, seg long, exit long, cost double"))

    def paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for track, shots, d, ids, entry, at, cost in zip(f.track, f.shots, f.d, f.ids, f.entry, f.exit, f.cost):
                back = _traced(np.reshape(d, (-1, len(ids))), entry, penalty)[1]
                path = np.empty(len(back), np.int64)
                for t in range(len(back) - 1, -1, -1):
                    path[t], at = at, back[t, at]
                yield pd.DataFrame({"track": track, "shot_index": shots, "cluster_id": np.asarray(ids)[path], "cost": cost})

    return with_costs.join(ends, ["track", "seg"]).mapInPandas(paths, "track string, shot_index int, cluster_id int, cost double")


def confidence_margin(distances: DataFrame) -> DataFrame:
    """(track, shot_index, margin): second smallest distance less the smallest; 0 for a single cluster."""
    least = F.slice(F.array_sort(F.collect_list("distance")), 1, 2)
    return distances.groupBy("track", "shot_index").agg(least.alias("d")).select("track", "shot_index", F.when(F.size("d") > 1, F.element_at("d", -1) - F.col("d")[0]).otherwise(0.0).alias("margin"))


def switches(assigned: DataFrame) -> DataFrame:
    """(track, switches): changes of cluster from one shot to the next."""
    placed = numbered(assigned.select("track", "shot_index", "cluster_id"), ["shot_index"], "p", ["track"])
    # Each shot meets the one before it: a segment of two rows, not a track.
    both = placed.withColumn("at", F.explode(F.array(F.col("p"), F.col("p") + 1))).groupBy("track", "at").agg(F.min_by("cluster_id", "p").alias("a"), F.max_by("cluster_id", "p").alias("b"), F.count(F.lit(1)).alias("n"))
    return both.groupBy("track").agg(F.sum(F.when((F.col("n") == 2) & (F.col("a") != F.col("b")), 1).otherwise(0)).alias("switches"))


def route(distances: DataFrame, window: int = 1, penalty: float = 0.0) -> DataFrame:
    """(track, shot_index, cluster_id, distance, margin): assignment on smoothed distances, reported with the raw ones."""
    smooth = moving_average(distances, window) if window > 1 else distances
    chosen = cheapest_path(smooth, penalty).drop("cost") if penalty > 0 else nearest(smooth)
    return chosen.join(distances, ["track", "shot_index", "cluster_id"]).join(confidence_margin(distances), ["track", "shot_index"])
