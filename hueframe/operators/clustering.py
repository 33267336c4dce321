"""Clustering of feature vectors: k-means, silhouette, and the choice of k."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .statistics import robust_scale
from .storage import kept


def standardized(features: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): robustly standardised vectors. Only medians and scales, a number each for a dimension, come to the driver."""
    long = features.select(F.posexplode(vec_col).alias("dim", "value")).withColumn("value", F.col("value").cast("double"))
    scale = {r["dim"]: (r["median"], r["scale"]) for r in robust_scale(long).collect()}
    middle, width = (F.array(*(F.lit(scale.get(i, (None, None))[j]).cast("double") for i in range(max(scale, default=-1) + 1))) for j in (0, 1))
    z = F.transform(vec_col, lambda v, i: (v.cast("double") - F.get(middle, i)) / F.get(width, i))
    return features.where(F.size(vec_col) > 0).select(F.col(id_col).alias("id"), z.alias("x"))


def squared_distance(x: Column, centre: list[float]) -> Column:
    at = F.expr(f"array({', '.join(f'{float(v)!r}D' for v in centre)})")
    return F.aggregate(F.zip_with(x, at, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)


def _nearest(centres: list[list[float]]) -> Column:
    """(d, cluster_id) of the nearest centre, ties to the first."""
    return F.array_min(F.array(*(F.struct(squared_distance(F.col("x"), c).alias("d"), F.lit(i).alias("cluster_id")) for i, c in enumerate(centres))))


def assign(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Points (id, x) with their nearest centre, ties to the first, and the squared distance."""
    return points.withColumn("best", _nearest(centres)).select("id", "x", "best.cluster_id", F.col("best.d").alias("d"))


def means(assigned: DataFrame) -> dict[int, list[float]]:
    """Mean vector of each cluster: k rows come back."""
    return _means(assigned.withColumn("start", F.lit(0)))[0]


def _means(assigned: DataFrame) -> dict[int, dict[int, list[float]]]:
    """Mean vectors by start and cluster: starts times k rows come back."""
    long = assigned.select("start", "cluster_id", F.posexplode("x").alias("dim", "v"))
    return _collected(long.groupBy("start", "cluster_id", "dim").agg(F.avg("v").alias("v")))


def _collected(long: DataFrame) -> dict[int, dict[int, list[float]]]:
    rows = long.groupBy("start", "cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda p: p["v"]).alias("c")).collect()
    out: dict[int, dict[int, list[float]]] = {}
    for r in rows:
        out.setdefault(r["start"], {})[r["cluster_id"]] = r["c"]
    return out


def _round(points: DataFrame, starts: dict[int, list[list[float]]]) -> dict[int, dict[int, list[float]]]:
    """Mean vectors of the points nearest to each centre, for each start: tasks add their points up, and only their sums are shuffled.

    A point that lacks a component is in the first cluster, as with `assign`, and counts for those it has.
    """
    centres = {s: np.array(c, np.float64) for s, c in starts.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            lists = batch.column(0)
            wide = max((len(c[0]) for c in centres.values()), default=0)
            n = np.asarray(lists.value_lengths().fill_null(0))
            flat = lists.flatten()
            wide = max(wide, int(n.max(initial=0)))
            given = np.arange(wide) < n[:, None]
            x, there = np.zeros(given.shape), np.zeros(given.shape, bool)
            x[given], there[given] = flat.fill_null(0.0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
            for s, c in centres.items():
                d = np.stack([((x[:, : len(v)] - v) ** 2).sum(1) for v in c], axis=1)
                d[np.isnan(d)] = np.inf
                own = np.where(there.all(1) & (n == c.shape[1]), d.argmin(1), 0)
                for i in np.unique(own):
                    mine = own == i
                    part = (x[mine].sum(0), there[mine].sum(0))
                    if (s, i) in held:
                        size = max(wide, len(held[s, i][0]))
                        held[s, i] = [np.pad(a, (0, size - len(a))) + np.pad(b, (0, size - len(b))) for a, b in zip(held[s, i], part)]
                    else:
                        held[s, i] = list(part)
        keys = list(held)
        columns = [pa.array([k[0] for k in keys], pa.int32()), pa.array([int(k[1]) for k in keys], pa.int32())]
        columns += [pa.array([held[k][0] for k in keys], pa.list_(pa.float64())), pa.array([held[k][1] for k in keys], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["start", "cluster_id", "total", "n"])

    parts = points.select(F.col("x").cast("array<double>")).mapInArrow(sums, "start int, cluster_id int, total array<double>, n array<long>")
    each = parts.select("start", "cluster_id", F.posexplode(F.arrays_zip("total", "n")).alias("dim", "v"))
    found = each.groupBy("start", "cluster_id", "dim").agg(F.sum("v.total").alias("t"), F.sum("v.n").alias("n")).where("n > 0")
    return _collected(found.select("start", "cluster_id", "dim", (F.col("t") / F.col("n")).alias("v")))


def _uniform(seed: int) -> Column:
    """A number in (0, 1] from the id and a seed."""
    return (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 1).cast("double") / float(1 << 52)


def seeds(points: DataFrame, k: int, starts: list[int]) -> list[list[list[float]]]:
    """k-means++ centres for each seed of `starts`: each further one is drawn with odds of its squared distance to those before, by exponential keys from hashes.

    One pass over the points draws a centre for every start. Equal points give fewer centres than k.
    """
    found: list[list[list[float]]] = [[] for _ in starts]
    for i in range(k):
        picks = []
        for s, (seed, centres) in enumerate(zip(starts, found)):
            key = _uniform(seed)
            if centres:
                d = _nearest(centres)["d"]
                key = F.when(d > 0, -F.log(_uniform(seed + i)) / d)
            picks.append(F.min(F.when(key.isNotNull(), F.struct(key.alias("key"), "id", "x")))["x"].alias(f"s{s}"))
        row = points.agg(*picks).first()
        for s, centres in enumerate(found):
            if row[s] is not None and len(centres) == i:
                centres.append(row[s])
    return [c for c in found if c]


def lloyd(points: DataFrame, centres: list[list[float]], rounds: int = 64) -> tuple[DataFrame, float, list[list[float]]]:
    """(assigned points, inertia, centres) after rounds of assignment and means, until centres stay. An empty cluster keeps its centre."""
    return lloyd_best(points, [centres], rounds)


def lloyd_best(points: DataFrame, starts: list[list[list[float]]], rounds: int = 64) -> tuple[DataFrame, float, list[list[float]]]:
    """`lloyd` from several starts, the one of least inertia; a round is one pass over the points for all starts that still move."""
    starts, moving = list(starts), list(range(len(starts)))
    for _ in range(rounds):
        found = _round(points, {s: starts[s] for s in moving})
        still = []
        for s in moving:
            new = [found.get(s, {}).get(i, c) for i, c in enumerate(starts[s])]
            if not all(math.isclose(a, b, rel_tol=0, abs_tol=1e-12) for p, q in zip(new, starts[s]) for a, b in zip(p, q)):
                still.append(s)
            starts[s] = new
        moving = still
        if not moving:
            break
    inertias = points.agg(*(F.sum(_nearest(c)["d"]) for c in starts)).first()
    best = min(range(len(starts)), key=lambda s: (inertias[s] or 0.0, s))
    return assign(points, starts[best]), inertias[best] or 0.0, starts[best]


def kmeans(points: DataFrame, k: int, starts: int = 8, seed: int = 42) -> tuple[DataFrame, float]:
    """Assigned points and inertia of the best of several starts; points (id, x) are passed over, not gathered."""
    points = kept(points)
    found = kmeans_centres(points, k, starts, seed)
    if not found:
        return points.select("id", "x", F.lit(0).alias("cluster_id"), F.lit(0.0).alias("d")), 0.0
    assigned = assign(points, found)
    return assigned, assigned.agg(F.sum("d")).first()[0] or 0.0


def kmeans_centres(points: DataFrame, k: int, starts: int = 8, seed: int = 42) -> list[list[float]]:
    """Centres of the best of several starts; none where there are no points."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    first = seeds(points, k, [seed + 1000 * s for s in range(1 if k == 1 else max(starts, 1))])
    return lloyd_best(points, first)[2] if first else []


#: Points of a part at most; fewer where there would be too few parts to share out.
BLOCK = 8192
#: Clusters up to which sums by cluster are products of matrices.
FEW = 64


def silhouettes(assigned: DataFrame, block: int | None = None) -> DataFrame:
    """(id, cluster_id, a, b, s) of points (id, x, cluster_id): mean distance within, to the nearest other cluster, and the score; see `silhouettes_each`."""
    return silhouettes_each(assigned.select("id", "x", F.array("cluster_id").alias("labels")), block).drop("choice")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all x from all y by a product of matrices; those that it would round, of points much closer than they are far from zero, by differences."""
    a, b = (x**2).sum(1)[:, None], (y**2).sum(1)
    with np.errstate(over="ignore", invalid="ignore"):
        d = a + b - 2 * (x @ y.T)
        rounded = ~(d > 1e-5 * (a + b)) | ~np.isfinite(d)
        for i in np.flatnonzero(rounded.any(1)):
            near = np.flatnonzero(rounded[i])
            d[i, near] = ((y[near] - x[i]) ** 2).sum(1)
        return np.sqrt(d, out=d)


class _Sums:
    """Sums of a matrix's columns by their clusters, which are numbered: a product for a few, else sums of runs."""

    def __init__(self, code: np.ndarray, clusters: int):
        self.sizes = np.bincount(code, minlength=clusters)
        self.flat = np.eye(clusters)[code] if clusters <= FEW else None
        self.order, self.starts = np.argsort(code, kind="stable"), np.cumsum(self.sizes) - self.sizes

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return m @ self.flat if self.flat is not None else np.add.reduceat(m[:, self.order], self.starts, axis=1)


def silhouettes_each(labelled: DataFrame, block: int | None = None) -> DataFrame:
    """(choice, id, cluster_id, a, b, s) of points (id, x, labels), `labels` an array of clusters, one for each of several choices.

    Every point meets every other, which the score needs and which costs the square of their number, once for all choices. Points are dealt into
    parts of about `block`, by their count (by default at least 16 parts of 500 points and more, and at most BLOCK points a part), and a part is packed into one row, which is sent once to each square that it takes
    part in: each two parts meet in one task, which takes their distances and sums by cluster as products of matrices. Sums of some hundred points are a row, and
    these rows are added up by points.
    A point alone in its cluster has a = 0.
    """
    if block is None:
        count = labelled.count()
        most = labelled.select(F.posexplode("labels")).groupBy("pos").agg(F.countDistinct("col").alias("n")).agg(F.max("n")).first()[0] or 0
        # Sums by very many clusters are wide, so that parts are smaller then.
        block = min(BLOCK if most <= FEW else 2000, max(500, count // 16))
        blocks = max(math.ceil(count / block), 1)
    else:
        blocks = max(math.ceil(labelled.count() / block), 1)
    part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    packed = kept(labelled.groupBy(part.alias("p")).agg(F.array_sort(F.collect_list(F.struct("id", F.col("x").cast("array<double>").alias("x"), "labels"))).alias("v")))
    packed = packed.select("p", F.col("v.id").alias("ids"), F.flatten("v.x").alias("xs"), F.flatten("v.labels").alias("labels"))
    # Squares are the pairs p <= q; a part goes to the blocks squares that have it on either side.
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    sides = packed.select("*", every).withColumns({"low": F.least("p", "o"), "high": F.greatest("p", "o")})

    def sums(parts: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for p, ids, xs, labels in zip(parts["p"], parts["ids"], parts["xs"], parts["labels"]):
            ids = np.asarray(ids)
            sides.append((p, ids, np.reshape(xs, (len(ids), -1)), np.reshape(labels, (len(ids), -1))))
        alone = len(sides) == 1 and parts.p.iloc[0] == parts.o.iloc[0]
        out = []
        for (p, ids, x, labels), (_, _, y, theirs) in ((sides[0], sides[0]),) if alone else (sides, sides[::-1]) if len(sides) == 2 else ():
            x, y = x - y[0], y - y[0]
            found = [np.unique(theirs[:, c], return_inverse=True) for c in range(theirs.shape[1])]
            by = [_Sums(code, len(names)) for names, code in found]
            # Some hundred points at a time, all rows of an id together.
            firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            cuts = [*firsts[np.unique(np.searchsorted(firsts, np.arange(0, len(ids), 256)).clip(max=len(firsts) - 1))], len(ids)]
            for at, to in zip(cuts[:-1], cuts[1:]):
                d = _distances(x[at:to], y)
                if alone:  # rows of one id, which lie in one part, leave each other out
                    same = ids[at:to, None] == ids
                    d[same] = 0.0
                for c, (names, _) in enumerate(found):
                    n = by[c].sizes - by[c](same.astype(float)) if alone else np.tile(by[c].sizes, (to - at, 1))
                    mine = (ids[at:to], labels[at:to, c]) if alone else ([], [])
                    out.append((p, at, c, *mine, names, by[c](d).ravel(), n.ravel()))
        return pd.DataFrame(out, columns=["p", "at", "choice", "ids", "labels", "others", "totals", "counts"])

    def scores(parts: pd.DataFrame) -> pd.DataFrame:
        """Sums of all squares for a few points, to their scores."""
        own = next(i for i, ids in enumerate(parts["ids"]) if len(ids))
        ids, labels = np.asarray(parts["ids"].iloc[own]), np.asarray(parts["labels"].iloc[own])
        names = np.unique(np.concatenate(list(parts["others"])))
        total, n = np.zeros((len(ids), len(names))), np.zeros((len(ids), len(names)))
        for others, t, c in zip(parts["others"], parts["totals"], parts["counts"]):
            at = np.searchsorted(names, others)
            total[:, at] += np.reshape(t, (len(ids), -1))
            n[:, at] += np.reshape(c, (len(ids), -1))
        points, of = np.unique(np.stack([ids, labels], axis=1), axis=0, return_inverse=True)
        if len(points) < len(ids):  # a point given twice in a cluster is one of the result
            total, n = (np.stack([np.bincount(of.ravel(), v, len(points)) for v in m.T], axis=1) for m in (total, n))
            ids, labels = points.T
        mean = np.divide(total, n, out=np.zeros_like(total), where=n > 0)
        mine = labels[:, None] == names
        a = np.where(mine, mean, 0.0).sum(1)
        b = np.where(mine | (n <= 0), np.inf, mean).min(1)
        alone = np.isinf(b) & ((~mine & (n > 0)).sum(1) == 0)
        with np.errstate(invalid="ignore"):
            s = np.where(alone, 0.0, (b - a) / np.maximum(np.maximum(a, b), 1e-12))
        return pd.DataFrame({"choice": parts["choice"].iloc[0], "id": ids, "cluster_id": labels, "a": a, "b": np.where(alone, np.nan, b), "s": s})

    packs = sides.groupBy("low", "high").applyInPandas(sums, "p int, at int, choice int, ids array<long>, labels array<int>, others array<int>, totals array<double>, counts array<double>")
    return packs.groupBy("p", "at", "choice").applyInPandas(scores, "choice int, id long, cluster_id int, a double, b double, s double")


def auto_clusters(points: DataFrame, most: int = 6, starts: int = 8, seed: int = 42, least: float = 0.10, block: int | None = None) -> tuple[DataFrame, int, float]:
    """(assigned, k, silhouette) of the k from 2 to `most` with the best mean silhouette (ties: the smallest k); one cluster if that is below `least` or points are two or fewer.

    The points' distances to each other are worked out once, for all k.
    """
    points = kept(points)
    n = points.count()
    ks = list(range(2, min(most, n) + 1)) if n > 2 else []
    centres = [kmeans_centres(points, k, starts, seed) for k in ks]
    best, score = None, -1.0
    if ks:
        labelled = kept(points.select("id", "x", F.array(*(_nearest(c)["cluster_id"] for c in centres)).alias("labels")))
        scores = {r["choice"]: r["s"] for r in silhouettes_each(labelled, block).groupBy("choice").agg(F.avg("s").alias("s")).collect()}
        for i in range(len(ks)):
            if scores.get(i) is not None and scores[i] > score:
                best, score = i, scores[i]
    if best is None or score < least:
        return points.select("id", "x", F.lit(0).alias("cluster_id"), F.lit(0.0).alias("d")), 1, score
    return assign(points, centres[best]), ks[best], score
