"""Nearest neighbours: an inverted file with product-quantised residuals, whose errors bound what can be left out, and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's centroids; an empty cell starts anew at the point that is farthest from its centroid."""
    rng = np.random.default_rng(seed)
    unique = np.unique(x, axis=0)
    c = unique[rng.permutation(len(unique))[:k]].astype(np.float64)
    for _ in range(rounds):
        d = (c**2).sum(1) - 2 * (x @ c.T)
        own = d.argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(c))
        far = np.argsort(-(d[np.arange(len(x)), own] + (x**2).sum(1)))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[far[np.cumsum(n == 0) - 1]])
    return c


@dataclass
class Index:
    """Coarse centroids, and for each run of dimensions the centroids of residuals."""

    coarse: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]
    sample_ids: np.ndarray
    sample: np.ndarray
    centre: np.ndarray

    def lists(self, x: np.ndarray) -> np.ndarray:
        return ((self.coarse**2).sum(1) - 2 * (x @ self.coarse.T)).argmin(1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[lists]
        return np.stack([((b**2).sum(1) - 2 * (rest[:, i:j] @ b.T)).argmin(1) for b, (i, j) in zip(self.books, self.cuts)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that codes stand for."""
        return np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)

    def limits(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """For each query (id, vector) a distance within which k rows of the sample with other ids lie; infinite where the sample has fewer."""
        out = np.full(len(x), np.inf)
        firsts = np.unique(self.sample_ids, return_index=True)[1]
        if len(firsts) > k:
            for at in range(0, len(x), 64):
                q = x[at : at + 64]
                d = _squares(q - self.centre, self.sample - self.centre)[0]
                d[ids[at : at + 64, None] == self.sample_ids] = np.inf
                for i in range(len(q)):
                    best = d[i, firsts] if len(firsts) == len(self.sample_ids) else np.minimum.reduceat(d[i], firsts)
                    best = np.argpartition(best, k - 1)[:k]
                    rows = firsts[best] if len(firsts) == len(self.sample_ids) else np.array([a + d[i, a:z].argmin() for a, z in zip(firsts[best], np.append(firsts, len(d[i]))[best + 1])])
                    # Measured anew: whatever rounding picked, k other ids are that near.
                    out[at + i] = np.sqrt(((self.sample[rows] - q[i]) ** 2).sum(1)).max()
        return out


def _squares(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all q from all x by a product of matrices, and how far rounding may move them."""
    a, b = (q**2).sum(1)[:, None], (x**2).sum(1)
    return a + b - 2 * (q @ x.T), (a + b) * (8e-16 * (x.shape[1] + 8))


def _bounds(q: np.ndarray, x: np.ndarray, error: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of all q from rows that lie within `error` of x; 0 and infinity where numbers are too large to square."""
    with np.errstate(over="ignore", invalid="ignore"):
        d, slack = _squares(q, x)
        low = np.sqrt(np.maximum(d - slack, 0)) - error
        high = np.sqrt(np.maximum(d + slack, 0)) + error
    return np.nan_to_num(low * (1 - 1e-12), nan=0.0, posinf=0.0, neginf=0.0), np.nan_to_num(high * (1 + 1e-12), nan=np.inf, posinf=np.inf)


def fit_index(vectors: DataFrame, count: int, dim: int, sample: int = 16_384, lists: int | None = None, runs: int = 16, seed: int = 7) -> Index:
    """Index of (vec_id, vec) rows from a bounded sample of `sample` vectors, smallest hash first.

    There are about sqrt(count) lists, at most an eighth of the sample. The driver gets the sample alone.
    """
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "vec").collect()
    x = np.array([r["vec"] for r in rows], np.float64).reshape(-1, dim)
    ids = np.array([r["vec_id"] for r in rows], np.int64)
    order = np.argsort(ids, kind="stable")
    k = lists or int(np.clip(np.sqrt(count) / 2, 1, max(sample // 8, 1)))
    coarse = _kmeans(x, k, 10, seed)
    edges = np.linspace(0, dim, min(runs, dim) + 1).astype(int)
    cuts = [(int(i), int(j)) for i, j in zip(edges, edges[1:])]
    small = x[: min(len(x), 8192)]
    index = Index(coarse, [], cuts, ids[order], x[order], x.mean(0))
    rest = small - coarse[index.lists(small)]
    index.books = [_kmeans(rest[:, i:j], 256, 6, seed + i) for i, j in cuts]
    return index


def usable(vec: Column, dim: int | None = None) -> Column:
    """Not null, not all zero, every component finite; of length `dim` if that is given."""
    inf = float("inf")
    fine = vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(vec, lambda x: x != 0)
    return F.coalesce(fine if dim is None else fine & (F.size(vec) == dim), F.lit(False))


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", probe_share: float = 1.0, shortlist: int = 200, rows_a_block: int = 4096, queries_a_block: int = 1024, lists: int | None = None, sample: int = 16_384) -> DataFrame:
    """For each query row, the k nearest rows found, other than rows of its own id: (query_id, rank, vec_id, score).

    `is_query` is a predicate on the column `vec_id`. Every usable row is in the index: in the list of its nearest
    coarse centroid, its residual in product-quantised codes. A query has a limit, the distance of its k-th nearest row in the index's
    sample, and looks into all lists that may hold a row within it, by the least and the greatest distance of the list's rows from the centroid. List and queries meet in blocks of bounded
    size: a long list is split, so that a hot list, say of one vector that many rows repeat, is many blocks. In a
    block, asymmetric distances of all codes, give or take the codes' own errors, bound each row's distance. Rows that may
    be among the best k are measured exactly, in double precision, on the vectors themselves; where they are more than `shortlist` for a query, distances on the
    vectors bound them first. Each block gives its best k ids, each with its lowest score; the best k of all blocks stay, nearest first, ties to the
    smaller id. No neighbour is missed, whatever the vectors, as long as `probe_share` is 1; with less, a query looks only into that share of all lists, the nearest, and more until they hold k rows other than its own id's.

    Rows whose vector is null, zero, of another length than most, or holds a null or non-finite component take no
    part, nor do rows with a null id. Repeated rows are dropped before all else; an id with several vectors counts once, by
    its nearest. A table without usable rows, or with fewer than k
    other rows, gives what there is. Other columns are left out, whatever their names.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    out = "query_id long, vec_id long, score double"
    top = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if top is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, count = top["dim"], top["count"]
    rows = rows.where(F.size("vec") == dim).dropDuplicates(["vec_id", "vec"])
    index = fit_index(rows, count, dim, sample, lists)
    shared = df.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            own = shared.value.lists(x)
            codes = shared.value.encode(x, own)
            away = np.sqrt(((x - shared.value.coarse[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), pa.array(away)], names=["vec_id", "list", "code", "vec", "away"])

    kind = df.select(F.col(vec_col)).schema[0].dataType.simpleString()
    filed = stored(rows.mapInArrow(assign, f"vec_id long, list int, code binary, vec {kind}, away double"))
    sizes, homes = np.zeros(len(index.coarse), np.int64), np.zeros(len(index.coarse), np.int64)
    inner, outer = np.full(len(sizes), np.inf), np.full(len(sizes), -np.inf)
    for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("inner"), F.max("away").alias("outer")).collect():  # one row a list
        sizes[r["list"]], inner[r["list"]], outer[r["list"]] = r["n"], r["inner"], r["outer"]
    for r in filed.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().collect():  # ids, each in the first list that holds it
        homes[r["list"]] = r["count"]
    row_blocks = np.maximum(-(-sizes // rows_a_block), 1)
    probes = max(1, int(np.ceil(probe_share * len(sizes))))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value.coarse
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            limits = shared.value.limits(batch.column(0).to_numpy(), x, k)
            chosen = []
            for q, limit in zip(x, limits):
                away = np.sqrt(((centres - q) ** 2).sum(1))
                order = np.argsort(away, kind="stable")
                held = np.cumsum(homes[order])
                n = max(probes, min(int((held < k + 1).sum()) + 1, len(sizes)))
                with np.errstate(invalid="ignore"):
                    beyond = np.maximum(away - outer, inner - away) > limit + 1e-9 * (limit + away)
                chosen.append(order[:n][~beyond[order[:n]]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.list_(pa.int32())), batch.column(1), pa.array(limits)], names=["query_id", "lists", "q", "limit"])

    asked = stored(filed.where(is_query).dropDuplicates(["vec_id"]).select("vec_id", "vec").mapInArrow(probe, f"query_id long, lists array<int>, q {kind}, limit double"))
    queries = np.zeros(len(sizes), np.int64)
    for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect():
        queries[r["list"]] = r["count"]
    asked = asked.select("query_id", F.explode("lists").alias("list"), "q", "limit")
    query_blocks = np.maximum(-(-queries // queries_a_block), 1)

    def blocks(numbers: np.ndarray) -> Column:
        return F.element_at(F.array(*map(F.lit, map(int, numbers))), F.col("list") + 1)

    left = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), blocks(query_blocks))).withColumn("rb", F.explode(F.sequence(F.lit(0), (blocks(row_blocks) - 1).cast("int"))))
    right = filed.drop("away").withColumn("rb", F.pmod(F.xxhash64("vec_id"), blocks(row_blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), (blocks(query_blocks) - 1).cast("long"))))

    def search(key: tuple, asks: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if asks.num_rows and held.num_rows:
            held = held.sort_by("vec_id")
            ids = held["vec_id"].to_numpy()
            vecs = _matrix(held["vec"].combine_chunks(), dim)
            firsts = np.unique(ids, return_index=True)[1]
            repeats = len(firsts) < len(ids)
            centre = shared.value.coarse[key[0].as_py()]
            rest = vecs - centre
            coded = shared.value.decode(np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(len(ids), -1))
            error = np.sqrt(((rest - coded) ** 2).sum(1)) * (1 + 1e-12)
            qids, limits, qs = asks["query_id"].to_numpy(), asks["limit"].to_numpy(), _matrix(asks["q"].combine_chunks(), dim)

            def within(q: np.ndarray, x: np.ndarray, error: np.ndarray | float, own: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                """Rows that may be among the best k ids, and the distance that none of these exceeds."""
                low, high = _bounds(q, x, error)
                high[own] = np.inf
                each = np.minimum.reduceat(high, firsts, axis=1) if repeats else high
                if each.shape[1] >= k:
                    limit = np.minimum(limit, np.partition(each, k - 1, axis=1)[:, k - 1])
                return (low <= limit[:, None] * (1 + 1e-9)) & ~own, limit

            for at in range(0, len(qs), 64):
                part = slice(at, at + 64)
                own = qids[part, None] == ids
                keep, limit = within(qs[part] - centre, coded, error, own, limits[part])
                if keep.sum() > shortlist * len(keep):
                    keep &= within(qs[part] - centre, rest, 0.0, own, limit)[0]
                for qid, q, may in zip(qids[part], qs[part], keep):
                    near = np.flatnonzero(may)
                    if not len(near):
                        continue
                    exact = np.sqrt(((vecs[near] - q) ** 2).sum(1))
                    best = np.lexsort((ids[near], exact))
                    if repeats:
                        best = best[np.sort(np.unique(ids[near][best], return_index=True)[1])]
                    best = best[:k]
                    found.append((np.full(len(best), qid), ids[near][best], exact[best]))
        cols = [np.concatenate(x) if found else np.zeros(0) for x in (zip(*found) if found else ((), (), ()))]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    pairs = left.groupBy("list", "rb", "qb").cogroup(right.groupBy("list", "rb", "qb")).applyInArrow(search, out)
    merged = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
