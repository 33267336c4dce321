"""Numbers of rows in order, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept


def numbered(rows: DataFrame, order: Sequence[str], out: str, by: Sequence[str] = (), sums: str | None = None) -> DataFrame:
    """`rows` with `out`, the place 0, 1, ... of each among the rows with the same keys `by` (which aren't null), in the order of `order`.

    Rows are dealt by ranges of keys and order and stored; each range is numbered by itself, and the counts of the ranges before,
    a row for each range and key, are added. With `sums`, an integer column, `out` is instead its running sum,
    the row's own value included. Equal rows get their numbers in any order.
    """
    parted = kept(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    keys = [*by, "_range"]
    value = F.col(sums) if sums else F.lit(1)
    counts = parted.groupBy(*keys).agg(F.sum(value).cast("long").alias("_n"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.withColumn("_local", local).join(before, keys).withColumn(out, F.col("_before") + F.col("_local") - (0 if sums else 1)).drop("_range", "_local", "_before")
