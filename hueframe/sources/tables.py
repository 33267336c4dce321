"""Manifests and reports as tables."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .images import check_output, located

_FIELDS = "a string, b string, c string, d string, e string, f string, g string"
# The names that a header row may give its columns.
PAIR_HEADER = (("source", "src"), ("target", "tgt"), ("weight", "w"), ("cluster", "scene", "group"), ("transfer_fn", "transfer", "tf"), ("normalization", "normalize", "norm"))
SHOT_HEADER = (("shot_id", "shot", "id"), ("frame_path", "frame", "path"), ("transfer_fn", "transfer", "tf"))


def _rows(text: DataFrame, header: tuple[tuple[str, ...], ...], least: int) -> DataFrame:
    """(line_no, n, fields) of manifests (value): CSV lines but blank ones, comments and headers; a wrong number of fields is an error."""
    lines = text.select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).where("trim(line) <> '' AND NOT startswith(trim(line), '#')")
    fields = F.from_csv("line", _FIELDS, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "nullValue": ""})
    rows = lines.select((F.col("i") + 1).alias("line_no"), fields.alias("v"), F.size(F.split("line", r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")).alias("n"))
    most = len(header)
    rows = rows.where(F.when(F.col("n").between(least, most), True).otherwise(F.raise_error(F.format_string(f"manifest line %d: {least} to {most} fields, not %d", "line_no", "n")).cast("boolean")))
    named = F.col("n") >= 2
    for name, options in zip("abcdef", header):
        named = named & ((F.col("n") < "abcdef".index(name) + 1) | F.lower(F.col(f"v.{name}")).isin(*options))
    return rows.where(~F.coalesce(named, F.lit(False))).select("line_no", "n", *(F.col(f"v.{k}").alias(k) for k in "abcdef"[:most]))


def _resolved(c: Column, folder: str) -> Column:
    return F.when(c.startswith("/") | c.contains("://"), c).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), c))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(pair_index, source, target, weight, cluster, transfer_fn, normalization) of a pair manifest; relative paths are the manifest's folder's."""
    rows = _rows(spark.read.text(path, wholetext=True), PAIR_HEADER, 2)
    weight = F.coalesce(F.col("c").cast("double"), F.lit(1.0))
    checked = F.when(weight >= 0, weight).otherwise(F.raise_error(F.format_string("manifest line %d: a weight below 0", "line_no")).cast("double"))
    folder = located(path).rsplit("/", 1)[0]
    rows = numbered(rows, ["line_no"], "place")
    return rows.select(F.col("place").cast("int").alias("pair_index"), _resolved(F.col("a"), folder).alias("source"), _resolved(F.col("b"), folder).alias("target"), checked.alias("weight"), F.col("d").alias("cluster"), F.lower("e").alias("transfer_fn"), F.lower("f").alias("normalization"))


def read_shots(spark: SparkSession, path: str) -> DataFrame:
    """(frame_index, shot_id, frame_path, transfer_fn) of a shot manifest; a line of one field is a shot of its own."""
    rows = _rows(spark.read.text(path, wholetext=True), SHOT_HEADER, 1)
    alone = F.col("n") == 1
    counted = numbered(numbered(rows.withColumn("alone", alone.cast("int")), ["line_no"], "place"), ["line_no"], "k", sums="alone")
    shot = F.when(alone, F.format_string("shot_%04d", "k")).otherwise(F.coalesce("a", F.format_string("shot_%04d", "line_no")))
    folder = located(path).rsplit("/", 1)[0]
    return counted.select(F.col("place").cast("int").alias("frame_index"), shot.alias("shot_id"), _resolved(F.when(alone, F.col("a")).otherwise(F.col("b")), folder).alias("frame_path"), F.lower("c").alias("transfer_fn"))


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, cluster_label, lut_path, vec) of a centroid report: its eight appearance values, 0 where missing."""
    raw = spark.read.csv(path, header=True)
    value = lambda i: F.coalesce(F.col(f"a_sig_{i:02d}").try_cast("double"), F.lit(0.0)) if f"a_sig_{i:02d}" in raw.columns else F.lit(0.0)
    text = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    out = raw.select(F.col("cluster_id").cast("int").alias("cluster_id"), text("cluster_label").alias("cluster_label"), text("lut_path").alias("lut_path"), F.array(*map(value, range(8))).alias("vec"))
    if out.isEmpty():
        raise ValueError(f"no centroids in {path}")
    return out


def write_csv(rows: DataFrame, path: str | Path, order: str | None = None) -> Path:
    """A report as one CSV file with a header, on the driver's disk; reports have a row a pair, cluster or shot."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    check_output(path)
    with path.open("w", encoding="utf-8", newline="") as f:
        import csv

        out = csv.writer(f)
        out.writerow(rows.columns)
        out.writerows(tuple(r) for r in (rows.orderBy(order) if order else rows).toLocalIterator())
    return path


def cluster_path(base: str | Path, label: str) -> Path:
    """The output path of a cluster: the label follows the stem, all but letters, digits, - and _ replaced."""
    base = Path(base)
    safe = re.sub(r"[^\w-]", "_", label).strip("_") or "cluster"
    return base.with_name(f"{base.stem}_{safe}{base.suffix}")


def short_name(path: str | Path, most: int = 28) -> bool:
    """Whether a converter that takes names of `most` characters accepts this one."""
    return len(Path(path).name) <= most
