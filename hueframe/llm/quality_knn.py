"""Quality classifier: similarity-weighted votes of nearest labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

HASHED = 2048  # cells of hashed byte 3-grams
BURSTS = 8  # words by how often the text repeats them: 1, 2, 3-4, 5-8, ...
LETTERS = 6  # lower, upper, digit, other ASCII, non-ASCII, white space
SIZE = HASHED + BURSTS + LETTERS
_KIND = np.full(256, 3, np.uint8)
_KIND[ord("a") : ord("z") + 1], _KIND[ord("A") : ord("Z") + 1], _KIND[ord("0") : ord("9") + 1], _KIND[128:] = 0, 1, 2, 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def features(text: str | None) -> np.ndarray:
    """Square roots of term shares of a whole text, by block: byte 3-grams, repetition of words, kinds of characters."""
    out = np.zeros(SIZE, np.float32)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    if not raw.split():
        return out
    b = np.frombuffer(raw, np.uint8)
    if len(b) > 2:
        x = b.astype(np.uint32)
        grams = ((x[:-2] * np.uint32(65_599) + x[1:-1] * np.uint32(257) + x[2:]) * np.uint32(2_654_435_761)) >> np.uint32(21)
        out[:HASHED] = np.sqrt(np.bincount(grams, minlength=HASHED) / len(grams))
    counts = np.fromiter(Counter(raw.split()).values(), np.int64)
    bursts = np.bincount(np.minimum(np.ceil(np.log2(counts)).astype(int), BURSTS - 1), weights=counts, minlength=BURSTS)
    out[HASHED : HASHED + BURSTS] = np.sqrt(bursts / counts.sum())
    out[HASHED + BURSTS :] = np.sqrt(np.bincount(_KIND[b], minlength=LETTERS) / len(b))
    return out


@dataclass
class Model:
    """Mean and axes of the latent space, labelled unit vectors there, and what to answer without neighbours."""

    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    weights: np.ndarray | float = 1.0  #: of each labelled vector's vote

    def place(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.mean) @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray, neighbours: int = 15, power: float = 8.0) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, each weighted by a power of its cosine."""
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cosines = self.place(x) @ self.vectors.T
        k = min(neighbours, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(float) ** power * np.broadcast_to(self.weights, len(self.labels))[near]
        total = weights.sum(axis=1)
        votes = (weights * self.labels[near]).sum(axis=1)
        return np.where(total > 1e-12, votes / np.maximum(total, 1e-12), self.prior)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 1500, axes: int = 48) -> Model:
    """Latent space and labelled vectors from a bounded sample: at most `sample` rows of each label, smallest hash of the id first.

    `docs` and `labels` are the rows that may be learnt from. Labels are 0 or 1; others and nulls are left out,
    an id with several labels takes the smallest, and of several texts of one id the smallest counts. The sample is taken from labels whose
    document is there, by their ids alone; each label's votes weigh as much as its share of all of those, so that the sample's size doesn't
    change the mix. The driver gets at most 2 * sample vectors of fixed length
    and finds the axes there; the model that tasks get is as bounded.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = stored(known.join(rows.select("id"), "id", "left_semi"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id")
    picked = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).select("id", "y")
    rows = rows.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([features(t).astype("<f4").tobytes() for t in batch.column(2).to_pylist()], pa.binary())], names=["id", "y", "x"])

    got = sorted((r["id"], r["y"], bytes(r["x"])) for r in rows.select("id", "y", "text").mapInArrow(run, "id long, y int, x binary").collect())
    got = [r for r in got if any(r[2])]
    y = np.array([r[1] for r in got], float)
    if not len(got):
        return Model(np.zeros(SIZE, np.float32), np.zeros((SIZE, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    x = np.array([np.frombuffer(r[2], "<f4") for r in got])
    mean = x.mean(axis=0)
    values, vectors = np.linalg.eigh(((x - mean).T @ (x - mean)).astype(np.float64))
    top = np.argsort(-values)[:axes]
    weight = {v: n / max((y == v).sum(), 1) for v, n in counts.items()}
    weight = {v: w / max(weight.values()) for v, w in weight.items()}
    model = Model(mean, np.ascontiguousarray(vectors[:, top]).astype(np.float32), np.zeros((0, 1), np.float32), y, counts.get(1, 0) / sum(counts.values()), np.array([weight[int(v)] for v in y]))
    model.vectors = model.place(x).astype(np.float32)
    return model


def score_quality(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, block: int = 256, keep: bool = False) -> DataFrame:
    """One row (doc_id, score, predicted) for each row of `df`; with `keep`, instead df's rows of score `threshold` or more.

    The model is broadcast; each task takes its texts in blocks, and a block's cosines with all labelled vectors
    are one matrix product. Texts without a word (null, empty) score 0; with no labelled row all others score
    0.5. Repeated rows each give a row, a null id stays null, an empty table gives an empty one; other columns of
    `df` may have any name.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scores(part: pa.RecordBatch, at: int) -> np.ndarray:
        texts = part.column(at).to_pylist()
        x = np.array([features(t) for t in texts]).reshape(len(texts), SIZE)
        return np.where(x.any(axis=1), shared.value.score(x), 0.0)

    if keep:
        at = df.columns.index(text_col)

        def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, block):
                    yield part.filter(pa.array(scores(part, at) >= threshold))

        return df.mapInArrow(only, df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, block):
                s = scores(part, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, score double, predicted int")
