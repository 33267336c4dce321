"""Lattices of a batch: one job for all gives what each group's pairs give alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hueframe.operators import statistics
from hueframe.operators.fitting import FitOptions
from hueframe.plans import extract as plans

from .test_operators import as_array, pixels

OPTIONS = plans.Options(fit=FitOptions(size=3, loss="l2"), bins=4, min_samples=1, outlier_sigma=3.0)
GAINS = {"a0": (1.1, 0.9, 1.05), "a1": (1.1, 0.92, 1.0), "a2": (1.08, 0.9, 1.02), "a3": (1.12, 0.91, 1.01), "b0": (0.5, 0.8, 1.2), "b1": (0.52, 0.82, 1.15)}


@pytest.fixture(scope="module")
def given(spark):
    out = None
    for i, (pair, gain) in enumerate(GAINS.items()):
        df = pixels(spark, 600, gain, 10 + i, pair)
        if pair == "a3":  # an outlier among the a's
            df = df.withColumns({t: 1.0 - F.col(t) for t in ("tr", "tg", "tb")})
        out = df if out is None else out.unionByName(df)
    weights = spark.createDataFrame([(p, 3.0 if p == "a1" else 1.0, None) for p in GAINS], "pair_id string, weight double, transfer_fn string")
    return out, weights


def test_groups_are_single_extractions(spark, given, tmp_path):
    rows, weights = given
    ready = plans.prepare(rows, OPTIONS, weights)
    members = spark.createDataFrame([("master", p) for p in GAINS] + [(p[0], p) for p in GAINS], "lut_id string, pair_id string")
    found = plans.fit_groups(spark, ready, members, OPTIONS, {"a": tmp_path / "a.cube", "b": None})
    assert set(found) == {"master", "a", "b"} and found["a"].output.exists() and found["b"].output is None
    assert found["a"].diagnostics["dropped_pairs"] == ["a3"] and found["b"].diagnostics["dropped_pairs"] == []
    for lut in ("a", "b"):
        mine = F.col("pair_id").startswith(lut)
        alone = plans.extract(spark, rows.where(mine), OPTIONS, None, weights.where(mine))
        assert np.allclose(as_array(found[lut].lattice, 3), as_array(alone.lattice, 3), atol=1e-7)
        assert {k: found[lut].diagnostics[k] for k in ("occupied_bins", "dropped_pairs", "transfers")} == {k: alone.diagnostics[k] for k in ("occupied_bins", "dropped_pairs", "transfers")}
        a, b = found[lut].metrics.first(), alone.metrics.first()
        assert a["mean_de2000"] == pytest.approx(b["mean_de2000"], abs=1e-6)
        stats = {r["pair_id"]: r["mse"] for r in found[lut].pairs.collect()}
        assert stats.keys() == {p for p in GAINS if p[0] == lut}


def test_small_groups_are_refused(spark, given):
    rows, weights = given
    few = rows.where("pair_id <> 'b1' OR (y = 0 AND x < 3)")
    with pytest.raises(ValueError, match="b1"):
        plans.extract(spark, few, OPTIONS, None, weights)


def test_infinite_and_missing_errors_are_no_outliers(spark):
    def marked(values, **more):
        rows = spark.createDataFrame([(f"p{i}", v) for i, v in enumerate(values)], "pair_id string, mse double")
        return [r["pair_id"] for r in statistics.outlier_pairs(rows, **more).where("outlier").orderBy("pair_id").collect()]

    inf = float("inf")
    assert marked([1.0, 1.1, 0.9, 1.05, inf]) == []
    assert marked([1.0, 1.1, 50.0, inf, inf, inf]) == ["p2"]
    assert marked([1.0, 1.1, 0.9, 1.05, 50.0, None, float("nan")]) == ["p4"]
    assert marked([inf, inf, inf]) == [] and marked([]) == []


def test_outliers_within_groups(spark):
    """An error that is usual in its own group isn't judged by another's."""
    rows = [("x", f"x{i}", 1.0 + 0.01 * i) for i in range(5)] + [("x", "bad", 3.0)] + [("y", f"y{i}", 3.0 + 0.1 * i) for i in range(5)] + [("z", "z0", 9.0)]
    df = spark.createDataFrame(rows, "lut_id string, pair_id string, mse double")
    assert [tuple(r) for r in statistics.outlier_pairs(df, by=("lut_id",)).where("outlier").select("lut_id", "pair_id").collect()] == [("x", "bad")]


def test_thresholds_of_the_command_line():
    import argparse

    from hueframe import __main__ as cli

    p = argparse.ArgumentParser()
    cli._fit_arguments(p)
    o = cli._options(p.parse_args([]))
    assert o.auto_shadows and o.shadow_threshold is None and o.fit.chroma_ratio == 4.0 and o.fit.delta == 1.0
    o = cli._options(p.parse_args("--shadow-manual --shadow-threshold 0.4 --deep-shadow-threshold 0.1 --chroma-ratio 2 --huber-delta 0.5".split()))
    assert (o.auto_shadows, o.shadow_threshold, o.deep_threshold, o.fit.chroma_ratio, o.fit.delta) == (False, 0.4, 0.1, 2.0, 0.5)
    with pytest.raises(SystemExit):
        p.parse_args(["--shadow-threshold", "1.5"])


def test_given_thresholds_hold(spark, given):
    """Given thresholds override the automatic ones, one by one; without either, the fit's own are kept."""
    rows, weights = given
    dark = rows.where("pair_id = 'b0'").withColumns({c: F.col(c) * 0.4 for c in ("sr", "sg", "sb")})
    fit = lambda **more: as_array(plans.extract(spark, dark, plans.Options(fit=FitOptions(size=3, loss="l2"), bins=16, min_samples=1, **more)).lattice, 3)
    automatic, manual, both = fit(), fit(auto_shadows=False), fit(shadow_threshold=0.25, deep_threshold=0.08)
    assert not np.allclose(automatic, manual) and np.allclose(manual, both)


def test_normalization_of_each_pair(spark, given):
    rows, _ = given
    modes = spark.createDataFrame([("a0", "rgb_affine"), ("a1", " Luma_affine "), ("a2", None), ("b0", ""), ("b1", "none")], "pair_id string, normalization string")
    few = rows.where("pair_id <> 'a3'")
    got = {r["pair_id"]: r["v"] for r in plans.normalized(few, plans.Options(), modes).groupBy("pair_id").agg(F.sum("sr").alias("v")).collect()}
    for pair, mode in (("a0", "rgb_affine"), ("a1", "luma_affine"), ("a2", "none"), ("b0", "none"), ("b1", "none")):
        mine = few.where(F.col("pair_id") == pair)
        mine = mine if mode == "none" else statistics.normalize_pairs(mine, mode)
        assert got[pair] == pytest.approx(mine.agg(F.sum("sr")).first()[0])


def test_many_lattices_through_sparks_writer(spark, tmp_path):
    """Ten lattices, names that a path can't hold as they are or that look like numbers, written by tasks and read back."""
    from hueframe.operators import lattices
    from hueframe.sources import cube

    names = [f"00{i}" for i in range(8)] + ["a/b c", "x=1%"]
    every = lattices.identity_lattice(spark, 3).drop("lut_id").crossJoin(spark.createDataFrame([(v, i / 10) for i, v in enumerate(names)], "lut_id string, k double")).withColumn("r", F.col("r") * F.col("k"))
    every = every.select("lut_id", "node_id", "r", "g", "b")
    folder = cube.write_cubes(every, str(tmp_path / "all"), 3, title="t")
    got = {(r["lut_id"], r["node_id"]): (r["r"], r["g"], r["b"]) for r in cube.read_cubes(spark, folder).collect()}
    want = {(r["lut_id"], r["node_id"]): (r["r"], r["g"], r["b"]) for r in every.collect()}
    assert {k for k, _ in got} == set(names)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert len([f for f in (tmp_path / "all").rglob("*.txt")]) == 10
    with pytest.raises(Exception, match="hasn't 27 nodes"):
        cube.write_cubes(every.where("node_id < 26"), str(tmp_path / "short"), 3)
