"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Weights that the sources take in turn, by code point of their names, null last.
WEIGHTS = (3, 1, 2)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of sources: rows (key, source_size) in, with `target` out.

    The targets share `share` times all sizes by weight; none passes `most` times its source's size, and what is
    over goes to the others by weight. With the sources sorted by cap over weight, each gives the level that
    would hold if all before it were at their caps; the highest such level is the one where all fits.
    """
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy("key")) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    levels = (
        ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("all_size", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max((F.lit(share) * F.col("all_size") - F.col("caps_before")) / F.col("weights_left")).over(Window.partitionBy()))
    )
    return levels.select("key", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _size_class(size: Column) -> Column:
    return F.when(size < 4096, F.expr("size div 32")).otherwise(128 + F.least(F.expr("size div 4096"), F.lit(1000)))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", carry: list[str] | None = None, cell_rows: int = 20_000) -> DataFrame:
    """Each row of `df` with its copies in the mix: (row: struct of df's columns, or of those in `carry`, size, source_size, target, copies, taken).

    A document's expected copies are its source's target over its source's size. Within a source the documents
    stand by size class, hash of their id and size; the running sum of expected copies plus one random offset
    of the source passes an integer as often as the document is taken. Order by size makes every stretch of sizes
    give its share, so that the words taken come near the target too. The running sum is a rank times a constant:
    ranks come from counts of (source, class, bucket) cells plus a rank inside the cell, so that no task holds a
    whole source. A bucket is as many first digits of the hash as keep about `cell_rows` rows a bucket, even if all
    rows were of one source and class; ranks don't depend on their number. Offsets come from the source's name and `seed`: reruns agree.

    Null text has size 0 (and a full share of copies, which take no words); null source is a source of its own,
    last; repeated rows stand side by side and are taken each for itself; a null id is an id like others; an empty
    table gives an empty one. df's columns may have any name.
    """
    digits = min(max(math.ceil(math.log(max(df.count() / cell_rows, 1), 16)), 1), 8)
    rows = (
        df.select(F.struct(*(F.col(f"`{c}`") for c in carry or df.columns)).alias("row"), F.col(id_col).cast("string").alias("k"), F.col(source_col).cast("string").alias("s"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
        .withColumn("key", F.when(F.col("s").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "s")))
        .withColumn("class", _size_class(F.col("size")).cast("long"))
        .withColumn("hash", F.md5(F.coalesce("k", F.lit("")).cast("binary")))
        .withColumn("bucket", F.substring("hash", 1, digits))
        .drop("s", "k")
    )
    cell = ["key", "class", "bucket"]
    # Read several times below, and small: so many rows as there are cells, whatever the documents.
    cells = stored(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")))
    classes = cells.groupBy("key", "class").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    targets = source_targets(classes.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, most)
    before = Window.partitionBy("key").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("key", "class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_class = classes.select("key", "class", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above")).join(targets, "key")
    starts = cells.select(*cell, F.coalesce(F.sum("n").over(within), F.lit(0)).alias("start")).join(by_class, ["key", "class"]).select(*cell, (F.col("above") + F.col("start")).alias("start"), "source_size", "target")

    rank = F.col("start") + F.row_number().over(Window.partitionBy(*cell).orderBy("hash", "size"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key")).cast("binary")), 1, 7), 16, 10).cast("double") / F.lit(268435456.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    passed = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return (
        rows.join(starts, cell)
        .withColumn("rank", rank)
        .withColumn("rate", rate)
        .withColumn("offset", offset)
        .withColumn("copies", F.least(passed, F.lit(int(most))))
        .select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def emit_mix(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document's row as often as it is taken."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
