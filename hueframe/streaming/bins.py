"""Bins of a stream of pixel pairs, kept as sums that batches add to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import bin_id
from ..operators.binning import MEAN_IN, MEAN_OUT, SOURCE, TARGET


def running_bins(pairs: DataFrame, bins: int = 64) -> DataFrame:
    """(pair_id, bin_id, n, mean inputs, mean outputs) of a streaming or a plain DataFrame of pixel pairs.

    State is one row of sums for each occupied bin, at most bins^3 a pair; a stream is to be written in update or
    complete mode.
    """
    return pairs.groupBy("pair_id", bin_id(*map(F.col, SOURCE), bins).alias("bin_id")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(s).alias(m) for s, m in zip(SOURCE, MEAN_IN)), *(F.avg(t).alias(m) for t, m in zip(TARGET, MEAN_OUT)))
