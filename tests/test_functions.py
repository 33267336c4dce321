import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hueframe.functions import colour, lattice, transfer

# Published CIEDE2000 test pairs (L, a, b of two colours, difference).
SHARMA = """
50.0000 2.6772 -79.7751 50.0000 0.0000 -82.7485 2.0425
50.0000 3.1571 -77.2803 50.0000 0.0000 -82.7485 2.8615
50.0000 2.8361 -74.0200 50.0000 0.0000 -82.7485 3.4412
50.0000 -1.3802 -84.2814 50.0000 0.0000 -82.7485 1.0000
50.0000 0.0000 0.0000 50.0000 -1.0000 2.0000 2.3669
50.0000 -1.0000 2.0000 50.0000 0.0000 0.0000 2.3669
50.0000 2.4900 -0.0010 50.0000 -2.4900 0.0009 7.1792
50.0000 2.4900 -0.0010 50.0000 -2.4900 0.0011 7.2195
50.0000 -0.0010 2.4900 50.0000 0.0009 -2.4900 4.8045
50.0000 2.5000 0.0000 50.0000 0.0000 -2.5000 4.3065
50.0000 2.5000 0.0000 73.0000 25.0000 -18.0000 27.1492
50.0000 2.5000 0.0000 61.0000 -5.0000 29.0000 22.8977
60.2574 -34.0099 36.2677 60.4626 -34.1751 39.4387 1.2644
22.7233 20.0904 -46.6940 23.0331 14.9730 -42.5619 2.0373
2.0776 0.0795 -1.1350 0.9033 -0.0636 -0.5514 0.9082
"""


def test_ciede2000_pairs(spark):
    rows = [tuple(map(float, x.split())) for x in SHARMA.split("\n") if x]
    df = spark.createDataFrame(rows, "l double, a double, b double, m double, c double, d double, want double")
    out = colour.with_delta_e_2000(df, ("l", "a", "b"), ("m", "c", "d"), "de")
    assert out.columns == [*df.columns, "de"]
    assert all(r["de"] == pytest.approx(r["want"], abs=1e-4) for r in out.collect())


@pytest.fixture(scope="module")
def ramp(spark):
    return spark.range(0, 201).select((F.col("id") / 100.0 - 0.2).alias("x"))


@pytest.mark.parametrize("name", sorted(transfer.CURVES))
def test_curves_go_back(ramp, name):
    to_linear, from_linear = transfer.curves(name)
    low = 1.01 if name == "log_c4" else 0.02  # below 1 this curve's two branches, as they are used, don't meet
    off = ramp.where(F.col("x").between(low, low + 1)).select(F.abs(from_linear(to_linear(F.col("x"))) - F.col("x")).alias("d")).agg(F.max("d")).first()[0]
    assert off < 1e-3
    steps = [r[0] for r in ramp.where("x > 0.1").select(to_linear(F.col("x"))).collect()]
    assert all(a < b for a, b in zip(steps, steps[1:]))


def test_unknown_transfer_has_no_curve():
    assert transfer.curves("linear") == (None, None) and transfer.curves("nothing") == (None, None)


def test_log_shaper(ramp):
    row = ramp.where("x > 0.001 AND x <= 1").select(F.max(F.abs(transfer.log_shaper_inverse(transfer.log_shaper(F.col("x"))) - F.col("x")))).first()
    assert row[0] < 1e-12
    assert transfer.shaper("linear")[2] == "auto" and transfer.shaper("linear", False)[2] == "disabled" and transfer.shaper("log_c3", True)[2] == "forced"
    ends = ramp.select(F.min(transfer.log_shaper(F.col("x"))), F.max(transfer.log_shaper(F.col("x")))).first()
    assert ends[0] >= 0 and ends[1] <= 1


@pytest.fixture(scope="module")
def colours(spark):
    rng = np.random.default_rng(42)
    corner = [(float(a), float(b), float(c)) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    rows = corner + [tuple(map(float, v)) for v in rng.random((300, 3))] + [(-0.5, 1.5, 0.5), (0.25, 0.25, 0.25)]
    return spark.createDataFrame([(i, *v) for i, v in enumerate(rows)], "i int, r double, g double, b double").cache()


@pytest.mark.parametrize("kernel,k", [("trilinear", 8), ("tetrahedral", 4)])
def test_corner_weights(colours, kernel, k):
    c = lattice.corners(kernel, *map(F.col, "rgb"), 5)
    for r in colours.select(c.alias("c")).collect():
        w = [x["w"] for x in r["c"]]
        assert len(w) == k and sum(w) == pytest.approx(1) and min(w) >= -1e-12 and all(0 <= x["node"] < 125 for x in r["c"])
    with pytest.raises(ValueError):
        lattice.corners("cubic", *map(F.col, "rgb"), 5)


def test_opponent_goes_back(colours):
    out = colours.select(*"rgb", *(c.alias(f"o{i}") for i, c in enumerate(colour.to_opponent(*map(F.col, "rgb")))))
    back = out.select(*"rgb", *(c.alias(f"x{k}") for k, c in zip("rgb", colour.from_opponent(F.col("o0"), F.col("o1"), F.col("o2")))), "o1", "o2").collect()
    for r in back:
        assert all(r[k] == pytest.approx(r[f"x{k}"], abs=1e-12) for k in "rgb")
        if r["r"] == r["g"] == r["b"]:
            assert abs(r["o1"]) < 1e-12 and abs(r["o2"]) < 1e-12


def test_indices_and_boosts(spark):
    at = [c.cast("long") for c in lattice.grid_coords(F.col("id"), 7)]
    assert spark.range(343).where(lattice.flat_index(*at, 7) != F.col("id")).count() == 0
    v = spark.range(1).select(lattice.neutral_boost(F.lit(0.5), F.lit(0.5), F.lit(0.5)), lattice.shadow_boost(F.lit(0.0), 0.25, 0.08), lattice.shadow_boost(F.lit(1.0), 0.25, 0.08), lattice.prior_strength(F.lit(3.0)), lattice.smoothstep(F.lit(0.5))).first()
    assert tuple(v) == pytest.approx((4.0, 25.0, 1.0, 1 - math.exp(-1), 0.5))


def test_lab_of_white_and_black(spark):
    row = spark.range(1).select(*colour.to_lab(F.lit(1.0), F.lit(1.0), F.lit(1.0)), *colour.to_oklab(F.lit(1.0), F.lit(1.0), F.lit(1.0)), *colour.to_lab(F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()
    assert tuple(row) == pytest.approx((100, 0, 0, 1, 0, 0, 0, 0, 0), abs=2e-2)
