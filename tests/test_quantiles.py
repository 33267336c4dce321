"""Exact quantiles against Spark's own percentile, with zones so small that they must be cut."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hueframe.operators.quantiles import quantiles

SHARES = (0.0, 0.05, 0.5, 0.95, 1.0)


def rows_of(kind):
    rng = random.Random(3)
    if kind == "smooth":
        return [(rng.choice("ab"), rng.gauss(0, 1)) for _ in range(900)]
    if kind == "ties":
        return [("a", float(rng.randrange(4))) for _ in range(500)] + [("b", 7.0)] * 300
    if kind == "skewed":  # nearly all values in one cell of the first cut
        return [("a", 1e-9 * rng.random()) for _ in range(600)] + [("a", 1e12), ("a", -1e12), ("b", 1.0)]
    if kind == "extreme":
        return [("a", v) for v in (1.7e308, -1.7e308, 5e-324, 0.0, 1.0)] * 9
    return [(None, 1.0), (None, 3.0), ("a", None), ("b", 2.0), ("b", None), ("b", 8.0)]


@pytest.mark.parametrize("kind", ["smooth", "ties", "skewed", "extreme", "nulls"])
@pytest.mark.parametrize("held, most", [(0, 3), (0, 1_000_000), (4_000_000, 3)])
def test_equals_percentile(spark, kind, held, most):
    df = spark.createDataFrame(rows_of(kind), "g string, v double")
    wanted = {"x": (F.col("v"), SHARES), "y": (-F.col("v"), (0.5,))}
    got = {r["g"]: (r["x"], r["y"]) for r in quantiles(df, ("g",), wanted, held, most).collect()}
    ps = F.array(*map(F.lit, SHARES))
    want = {r["g"]: (r["x"], [r["y"]]) for r in df.groupBy("g").agg(F.percentile("v", ps).alias("x"), F.median(-F.col("v")).alias("y")).collect()}
    assert got.keys() == want.keys()
    for g, (x, y) in want.items():
        for a, b in zip([*got[g][0], *got[g][1]], [*(x or [None] * len(SHARES)), *y]):
            assert a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-21), (g, got[g], want[g])


@pytest.mark.parametrize("held", [0, 4_000_000])
def test_without_groups_and_without_rows(spark, held):
    df = spark.createDataFrame([(float(i),) for i in (5, 1, 4, 2)], "v double")
    wanted = {"m": (F.col("v"), (0.5,))}
    assert quantiles(df, (), wanted, held).first()["m"] == [3.0]
    assert quantiles(df.where("v > 9"), (), wanted, held).first()["m"] == [None]
    assert quantiles(df.withColumn("g", F.lit(1)).where("v > 9"), ("g",), wanted, held).count() == 0


def test_values_that_are_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in [-inf, -inf, *map(float, range(20)), inf, inf, nan, nan, nan]], "v double")
    at = (0.0, 2 / 26, 11 / 26, 22 / 26, 1.0)
    x = quantiles(df, (), {"x": (F.col("v"), at)}, held=0, most=2).first()["x"]
    assert x[0] == -inf and x[1] == pytest.approx(0.0) and x[2] == pytest.approx(9.0) and x[3] == inf and math.isnan(x[4])
