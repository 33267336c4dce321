"""Lattices that are fitted together are what each is alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hueframe.operators import binning, curves, fitting, lattices
from hueframe.operators.fitting import FitOptions

from .test_operators import as_array, samples

GAINED = lambda x: np.clip(x * [1.2, 0.8, 1.0] + 0.02, 0, 1)
BENT = lambda x: 1 - x**0.6


def noisy(x):
    """The identity but for a few samples far off."""
    return np.where(np.arange(len(x))[:, None] % 41 == 7, 1 - x, x)


def sets(spark, *given):
    return [samples(spark, f, n, seed, lut).drop("pair_id", "bin_id") for f, n, seed, lut in given]


def joined(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def of(lattice, lut, n):
    return as_array(lattice.where(F.col("lut_id") == lut), n)


@pytest.mark.parametrize("more", [{"loss": "huber", "delta": 0.05, "rounds": 3}, {"basis": "opponent"}, {"prior_model": "baseline_residual"}, {"prior_model": "baseline_multigrid_residual", "coarse": 2}])
def test_fits_together_are_fits_alone(spark, more):
    """One lattice whose baseline passes its gate, one that is the identity but for outliers and fails it."""
    o = FitOptions(**({"size": 3, "loss": "l2", "smoothness": 0.01} | more))
    parts = sets(spark, (BENT, 200, 1, "bent"), (noisy, 150, 2, "noisy"))
    together = fitting.fit_lattice(joined(parts), o)
    for lut, part in zip(("bent", "noisy"), parts):
        assert np.allclose(of(together, lut, 3), of(fitting.fit_lattice(part, o), lut, 3), atol=1e-7), lut


def test_gate_is_each_lattices_own(spark):
    parts = sets(spark, (BENT, 200, 1, "bent"), (lambda x: x, 100, 2, "same"))
    base = fitting.accepted_baselines(joined(parts))
    assert [r["lut_id"] for r in base.collect()] == ["bent"]
    rows = joined(parts).join(base, "lut_id")
    assert curves.quality_gate(rows, curves.baseline_value(*map(F.col, binning.MEAN_IN)), ("lut_id",)).first()["ratio"] < 0.05


def test_baselines_many_lattices(spark):
    """More lattices than are broadcast give the same rows."""
    parts = joined(sets(spark, *((lambda x, k=k: x ** (0.5 + 0.1 * k), 80, k, f"l{k}") for k in range(6))))
    want = {r["lut_id"]: r for r in curves.fit_baseline(parts, rounds=2).collect()}
    few, curves.FEW = curves.FEW, 3
    try:
        got = {r["lut_id"]: r for r in curves.fit_baseline(parts, rounds=2).collect()}
    finally:
        curves.FEW = few
    assert len(got) == 6
    for lut, r in want.items():
        assert np.allclose(got[lut]["theta"], r["theta"]) and np.allclose(got[lut]["ys"], r["ys"])


def test_baseline_of_singular_inputs(spark):
    """Grey inputs leave the matrix open: the shortest solution, and finite curves; a single colour is a constant."""
    grey = joined(sets(spark, (lambda x: x, 60, 1, "grey"))).withColumns({"ig": F.col("ir"), "ib": F.col("ir"), "or_": F.col("ir") * 0.5, "og": F.col("ir") * 0.5, "ob": F.col("ir") * 0.5})
    one = joined(sets(spark, (lambda x: x, 20, 1, "one"))).withColumns({c: F.lit(0.25) for c in ("ir", "ig", "ib")}).withColumns({c: F.lit(0.75) for c in ("or_", "og", "ob")})
    rows = grey.unionByName(one)
    got = rows.join(curves.fit_baseline(rows), "lut_id").select("lut_id", "ir", *(v.alias(k) for v, k in zip(curves.baseline_value(*map(F.col, binning.MEAN_IN)), "rgb"))).collect()
    for r in got:
        want = 0.75 if r["lut_id"] == "one" else r["ir"] * 0.5
        assert max(abs(r[k] - want) for k in "rgb") < 0.02


def test_refine_together_is_refine_alone(spark):
    o = FitOptions(size=3, loss="l2", smoothness=0.01)
    parts = sets(spark, (GAINED, 200, 1, "even"), (noisy, 150, 2, "noisy"))
    both = joined(parts)
    first = fitting.fit_lattice(both, o)
    together = fitting.refine(first, both, o, 2)
    for lut, part in zip(("even", "noisy"), parts):
        alone = fitting.refine(fitting.fit_lattice(part, o), part, o, 2)
        assert np.allclose(of(together, lut, 3), of(alone, lut, 3), atol=1e-7), lut
    # The noisy lattice moves towards the identity.
    ident = as_array(lattices.identity_lattice(spark, 3), 3)
    assert np.abs(of(together, "noisy", 3) - ident).mean() < np.abs(of(first, "noisy", 3) - ident).mean()


def test_own_thresholds(spark):
    o = FitOptions(size=3, loss="l2")
    parts = sets(spark, (GAINED, 100, 1, "x"), (BENT, 100, 2, "y"))
    own = spark.createDataFrame([("x", 0.6, 0.3)], "lut_id string, shadow double, deep double")
    got = fitting.fit_lattice(joined(parts), o, own)
    assert np.allclose(of(got, "x", 3), of(fitting.fit_lattice(parts[0], FitOptions(size=3, loss="l2", shadow=0.6, deep=0.3)), "x", 3), atol=1e-8)
    assert np.allclose(of(got, "y", 3), of(fitting.fit_lattice(parts[1], o), "y", 3), atol=1e-8)


def test_unknown_prior_is_refused(spark):
    with pytest.raises(ValueError):
        fitting.fit_lattice(joined(sets(spark, (GAINED, 5, 1, "x"))), FitOptions(prior_model="none"))
