import numpy as np
import pytest
from pyspark.sql import functions as F

from hueframe import queries
from hueframe.operators import binning, clustering, curves, fitting, lattices, numbering, routing, signatures, statistics
from hueframe.operators.fitting import FitOptions
from hueframe.streaming.bins import running_bins

PX = "pair_id string, y int, x int, sr double, sg double, sb double, tr double, tg double, tb double"
SAMPLES = "lut_id string, pair_id string, bin_id long, ir double, ig double, ib double, or_ double, og double, ob double, alpha double"


def pixels(spark, n=900, gain=(1.1, 0.9, 1.05), seed=123, pair="p"):
    rng = np.random.default_rng(seed)
    s = rng.random((n, 3))
    t = np.clip(s * gain + (0.02, -0.01, 0.03), 0, 1)
    return spark.createDataFrame([(pair, i // 30, i % 30, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(s, t))], PX)


def samples(spark, f, n=300, seed=1, lut="a"):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    y = f(x)
    return spark.createDataFrame([(lut, lut, i, *map(float, a), *map(float, b), 1.0) for i, (a, b) in enumerate(zip(x, y))], SAMPLES)


def as_array(lattice, n):
    out = np.zeros((n**3, 3))
    for r in lattice.collect():
        out[r["node_id"]] = r["r"], r["g"], r["b"]
    return out


def grid(n):
    i = np.arange(n**3)
    return np.stack([i % n, i // n % n, i // n**2], axis=1) / (n - 1)


def test_bins_keep_all_pixels(spark):
    df = pixels(spark)
    bins = binning.bin_pixels(df, 8, 1).collect()
    assert sum(r["n"] for r in bins) == 900
    total = sum(r["n"] * r["ir"] for r in bins)
    assert total == pytest.approx(df.agg(F.sum("sr")).first()[0])
    assert all(r["n"] > 1 or r["vr"] == 0 for r in bins) and all(0 <= r["cx"] <= 1 and 0 <= r["cy"] <= 1 for r in bins)
    assert binning.bin_pixels(df, 8, 5).where("n < 5").count() == 0
    weights = binning.sample_weights(binning.bin_pixels(df, 8, 1))
    assert weights.agg(F.avg("alpha")).first()[0] == pytest.approx(1)


def test_streamed_bins_are_batch_bins(spark, tmp_path):
    df = pixels(spark)
    df.where("y < 10").write.parquet(str(tmp_path / "in"))
    df.where("y >= 10").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_bins(stream, 8).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r["bin_id"], r["n"]): r["og"] for r in binning.bin_pixels(df, 8, 1).collect()}
    got = {(r["bin_id"], r["n"]): r["og"] for r in spark.table("streamed").collect()}
    assert got == pytest.approx(want)


def test_lattices_apply_and_resample(spark):
    ident = lattices.identity_lattice(spark, 5)
    df = pixels(spark, 200)
    for kernel in ("trilinear", "tetrahedral"):
        out = lattices.apply_lattice(df, ident, 5, kernel, ("sr", "sg", "sb"))
        assert out.where("abs(pr - sr) + abs(pg - sg) + abs(pb - sb) > 1e-9").count() == 0
    assert np.allclose(as_array(lattices.resample(ident, 5, 9), 9), grid(9))
    assert lattices.total_variation(ident, 5).count() == 1
    assert lattices.neutral_monotonicity(ident, 5).first()["violations"] == 0
    assert lattices.out_of_gamut(ident).first()["oog_pct"] == 0
    with pytest.raises(ValueError):
        lattices.identity_lattice(spark, 200)


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_laplacian(spark, connectivity):
    m = np.zeros((64, 64))
    for r in lattices.laplacian(lattices.nodes(spark, 4), 4, connectivity).collect():
        m[r["row"], r["col"]] = r["val"]
    assert np.allclose(m, m.T) and np.allclose(m.sum(1), 0)
    inner = 1 + 4 + 16
    assert m[inner, inner] == pytest.approx(6)
    ramp = lattices.identity_lattice(spark, 4)
    at = lattices.laplacian_of(ramp, 4, connectivity).where(F.col("node_id") == inner).first()
    assert abs(at["lr"]) < 1e-12
    x = np.random.default_rng(0).random(64)
    assert np.allclose(fitting._stencil(x, 4, lattices.offsets(connectivity)), m @ x)


def test_distances_are_brute_force(spark):
    rng = np.random.default_rng(3)
    n, occ = 7, rng.choice(343, 9, replace=False)
    g = grid(n) * (n - 1)
    want = np.sqrt(((g[:, None] - g[occ][None]) ** 2).sum(2)).min(1)
    got = lattices.distance_to_data(spark.createDataFrame([("a", int(i)) for i in occ], "lut_id string, node_id long"), n).collect()
    assert len(got) == 343 and all(r["distance"] == pytest.approx(want[r["node_id"]]) for r in got)


def test_hald_plates(spark):
    plate = lattices.hald_identity(spark, 3)
    assert plate.count() == 729
    got = as_array(lattices.hald_readout(plate.withColumn("lut_id", F.lit("h")), 3), 9)
    assert np.allclose(got, grid(9))
    y, x = lattices.hald_place(F.col("node_id"), 3)
    again = lattices.hald_readout(lattices.identity_lattice(spark, 9).select("lut_id", y.alias("y"), x.alias("x"), "r", "g", "b"), 3)
    assert np.allclose(as_array(again, 9), grid(9))
    with pytest.raises(ValueError):
        lattices.hald_identity(spark, 1)


def test_resize(spark):
    img = spark.createDataFrame([("i", y, x, float(x), float(y), 1.0) for y in range(5) for x in range(9)], "image_id string, y int, x int, r double, g double, b double")
    out = lattices.resize(img, spark.createDataFrame([("i", 3, 5)], "image_id string, height int, width int")).collect()
    assert len(out) == 15 and all(r["r"] == pytest.approx(2 * r["x"]) and r["g"] == pytest.approx(2 * r["y"]) and r["b"] == pytest.approx(1) for r in out)


@pytest.mark.parametrize("old, new", [((5, 9), (3, 5)), ((7, 3), (600, 2)), ((1, 4), (5, 1)), ((2, 1), (1, 3)), ((40, 700), (3, 520)), ((6, 6), (6, 6)), ((3, 3), (1, 1))])
def test_resize_is_the_plain_sum(spark, old, new):
    """Over several tiles, up and down, sides of one pixel, with missing, null and repeated pixels: each place is the sum over its neighbours."""
    import math
    import random

    rng = random.Random(old[1] * new[0])
    every = [("i", y, x, *(None if rng.random() < 0.05 else rng.random() for _ in "rgb")) for y in range(old[0]) for x in range(old[1]) if rng.random() < 0.9 or (y, x) in ((old[0] - 1, 0), (0, old[1] - 1))]
    every += every[:1] + [("other", 0, 0, 0.1, 0.2, 0.3), (None, 0, 0, 0.1, 0.2, 0.3)]
    schema = "image_id string, y int, x int, r double, g double, b double"
    found = lattices.resize(spark.createDataFrame(every, schema), spark.createDataFrame([("i", *new), ("absent", 2, 2)], "image_id string, height int, width int")).collect()
    cells = {}
    for image, y, x, *colour in every:
        if image == "i":
            cells.setdefault((y, x), []).append(colour)
    want = {}
    for oy in range(new[0]):
        for ox in range(new[1]):
            sy, sx = (o * (a - 1) / (b - 1) if b > 1 else 0.0 for o, a, b in zip((oy, ox), old, new))
            y0, x0 = (max(min(math.floor(s), a - 2), 0) for s, a in zip((sy, sx), old))
            for y, wy in ((y0, 1 - sy + y0), (y0 + 1, sy - y0)):
                for x, wx in ((x0, 1 - sx + x0), (x0 + 1, sx - x0)):
                    if wy * wx > 0 and (y, x) in cells:
                        now = want.setdefault((oy, ox), [None] * 3)
                        for c in range(3):
                            for v in (k[c] for k in cells[y, x] if k[c] is not None):
                                now[c] = (now[c] or 0.0) + wy * wx * v
    got = {(r["y"], r["x"]): [r["r"], r["g"], r["b"]] for r in found}
    assert len(found) == len(got) and set(got) == set(want) and {r["image_id"] for r in found} == {"i"}
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for k in want for a, b in zip(got[k], want[k]))


def test_resize_sends_pixels_once(spark):
    """One exchange has pixels in it, and pixels that no output reads stay behind."""
    import io
    from contextlib import redirect_stdout

    img = spark.range(300 * 300).select(F.lit("i").alias("image_id"), F.floor(F.col("id") / 300).alias("y"), (F.col("id") % 300).alias("x"), *(F.rand(1).alias(c) for c in "rgb"))
    out = lattices.resize(img, spark.createDataFrame([("i", 10, 10)], "image_id string, height int, width int"))
    assert out.count() == 100
    with redirect_stdout(io.StringIO()) as text:
        out.explain()
    plan = text.getvalue().split("== Initial Plan ==")[-1]
    assert sum("Exchange hashpartitioning" in line and "ty#" in line for line in plan.split("\n")) == 1


def test_shadow_smoothing_keeps_constants_and_lights(spark):
    flat = lattices.identity_lattice(spark, 5).withColumns({k: F.lit(0.3) for k in "rgb"})
    assert np.allclose(as_array(lattices.smooth_shadows(flat, 5), 5), 0.3)
    ident = lattices.identity_lattice(spark, 5)
    assert np.allclose(as_array(lattices.smooth_shadows(ident, 5), 5)[-1], 1)


def test_affine_and_curves_are_found(spark):
    m, b = np.diag([1.2, 0.9, 1.1]), np.array([0.05, -0.02, 0.03])
    df = samples(spark, lambda x: x @ m.T + b, 400)
    theta = np.reshape(curves.fit_affine(df, tuple(map(F.col, binning.MEAN_OUT))).first()["theta"], (3, 4))
    assert np.allclose(theta[:, :3], m, atol=1e-6) and np.allclose(theta[:, 3], b, atol=1e-6)
    base = curves.fit_baseline(samples(spark, lambda x: x**0.8, 500), rounds=2)
    assert all(a <= c + 1e-12 for ys in base.first()["ys"] for a, c in zip(ys, ys[1:]))
    rows = samples(spark, lambda x: x**0.8, 500).join(base, "lut_id")
    gate = curves.quality_gate(rows, curves.baseline_value(*map(F.col, binning.MEAN_IN))).first()
    assert gate["passes"] and gate["ratio"] < 0.3
    same = curves.quality_gate(samples(spark, lambda x: x), tuple(map(F.col, binning.MEAN_IN))).first()
    assert same["ratio"] == 0 or not same["passes"]


def test_isotonic_pools(spark):
    pts = spark.createDataFrame([("a", i, float(y), float(w)) for i, (y, w) in enumerate([(1, 1), (3, 1), (2, 3), (2, 1), (5, 1), (4, 1)])], "channel string, knot int, y double, w double")
    got = [r["y"] for r in curves.isotonic(pts).orderBy("knot").collect()]
    assert got == pytest.approx([1, 2.2, 2.2, 2.2, 4.5, 4.5])
    raised = [r["y"] for r in curves.running_maximum(pts, "channel", "knot", "y").orderBy("knot").collect()]
    assert raised == [1, 3, 3, 3, 5, 5]


def test_interpolation_and_inversion(spark):
    knots = spark.createDataFrame([("a", 0.0, 0.0), ("a", 0.5, 0.25), ("a", 0.6, 0.25), ("a", 1.0, 1.0), ("flat", 0.0, 0.4), ("flat", 1.0, 0.4)], "channel string, x double, y double")
    curve = curves.curve_arrays(knots)
    df = spark.createDataFrame([("a", -1.0), ("a", 0.25), ("a", 0.8), ("a", 2.0), ("flat", 0.7)], "channel string, v double")
    got = [r["o"] for r in curves.evaluate(df, curve, "v", "o").orderBy("channel", "v").collect()]
    assert got == pytest.approx([0.0, 0.125, 0.625, 1.0, 0.4])
    back = curves.evaluate(spark.createDataFrame([("a", 0.125), ("a", 1.0), ("flat", 0.9)], "channel string, v double"), curves.inverted(curve), "v", "o").orderBy("channel", "v").collect()
    assert [r["o"] for r in back] == pytest.approx([0.25, 1.0, 0.5])


OPTIONS = FitOptions(size=4, rounds=1)


def test_identity_and_gain_are_fitted(spark):
    got = as_array(fitting.fit_lattice(samples(spark, lambda x: x), FitOptions(size=4, rounds=1, smoothness=0.003)), 4)
    assert np.abs(got - grid(4)).max() < 0.1
    gained = as_array(fitting.fit_lattice(samples(spark, lambda x: x * [1.1, 0.9, 1.0]), FitOptions(size=4, rounds=0, loss="l2", smoothness=0.003)), 4)
    assert np.abs(gained - grid(4) * [1.1, 0.9, 1.0]).max() < 0.15


def test_fit_solves_the_normal_equations(spark):
    """Against dense least squares on the rows that the operators give."""
    n, o = 3, FitOptions(size=3, loss="l2", smoothness=0.2, prior=0.05)
    df = samples(spark, lambda x: 1 - x, 40)
    rows = {r["bin_id"]: i for i, r in enumerate(df.select("bin_id").orderBy("bin_id").collect())}
    a = np.zeros((40, 27))
    for r in fitting.data_rows(df, n, o.kernel).collect():
        a[rows[r["bin_id"]], r["node"]] += r["val"]
    b = np.array([[r["rhs_r"], r["rhs_g"], r["rhs_b"]] for r in fitting.data_rhs(df).orderBy("bin_id").collect()])
    s = np.zeros((27, 27))
    for r in fitting.smoothness_rows(lattices.nodes(spark, n), n, o.smoothness, o.shadow, o.deep).collect():
        s[r["row"], r["col"]] = r["val"]
    near = binning.occupied_nodes(df, n).withColumnRenamed("pair_id", "lut_id")
    p, pb = np.zeros((27, 27)), np.zeros((27, 3))
    for r in fitting.prior_rows(lattices.distance_to_data(near, n), n, o.prior).collect():
        p[r["node_id"], r["node_id"]] = r["val"]
        pb[r["node_id"]] = r["rhs_r"], r["rhs_g"], r["rhs_b"]
    want = np.linalg.lstsq(np.vstack([a, s, p]), np.vstack([b, np.zeros((27, 3)), pb]), rcond=None)[0]
    got = as_array(fitting.fit_channels(df, fitting._goal(df, n, lambda *c: c), n, o), n)
    assert np.allclose(got, want, atol=1e-5)


@pytest.mark.parametrize("more", [{"basis": "opponent"}, {"prior_model": "baseline_residual"}, {"prior_model": "baseline_multigrid_residual", "coarse": 3, "size": 5}])
def test_other_fits(spark, more):
    o = FitOptions(**({"size": 3, "rounds": 0, "loss": "l2", "smoothness": 0.003} | more))
    got = as_array(fitting.fit_lattice(samples(spark, lambda x: x * [1.1, 0.9, 1.0] + 0.02, 200), o), o.size)
    assert np.abs(got - (grid(o.size) * [1.1, 0.9, 1.0] + 0.02)).max() < 0.15


def test_refinement_and_schedule(spark):
    assert fitting.schedule(33, 17) == [17, 33] and fitting.schedule(65, 17) == [17, 33, 65] and fitting.schedule(9, 17) == [9]
    df = samples(spark, lambda x: np.where(np.arange(len(x))[:, None] == 3, 1 - x, x), 150)
    first = fitting.fit_lattice(df, FitOptions(size=3, rounds=0, loss="l2"))
    after = as_array(fitting.refine(first, df, FitOptions(size=3, rounds=0, loss="l2"), 1), 3)
    assert np.abs(after - grid(3)).mean() <= np.abs(as_array(first, 3) - grid(3)).mean() + 1e-9


def test_strong_prior_wins(spark):
    df = samples(spark, lambda x: x * 0, 50)
    got = as_array(fitting.fit_lattice(df, FitOptions(size=3, rounds=0, loss="l2", prior=1e6, smoothness=0.0)), 3)
    far = lattices.distance_to_data(binning.occupied_nodes(df, 3).withColumnRenamed("pair_id", "lut_id"), 3).where("distance > 0").collect()
    assert all(np.allclose(got[r["node_id"]], grid(3)[r["node_id"]], atol=1e-2) for r in far)


def test_outliers(spark):
    rows = spark.createDataFrame([(f"p{i}", 0.01 + 0.001 * i) for i in range(6)] + [("bad", 1.0)], "pair_id string, mse double")
    assert [r["pair_id"] for r in statistics.outlier_pairs(rows).where("outlier").collect()] == ["bad"]
    assert statistics.outlier_pairs(rows, min_pairs=7).where("outlier").count() == 0
    assert statistics.outlier_pairs(rows.limit(2)).where("outlier").count() == 0


def test_balance(spark):
    df = samples(spark, lambda x: x, 30, lut="a").union(samples(spark, lambda x: x, 10, lut="b"))
    pairs = spark.createDataFrame([("a", 1.0, 100), ("b", 3.0, 50)], "pair_id string, weight double, pixels long")
    for mode, share in (("equal", 0.75), ("by_bins", 0.5), ("by_pixels", 0.6)):
        out = binning.balanced(df, pairs, mode)
        assert out.agg(F.avg("alpha")).first()[0] == pytest.approx(1)
        assert out.where("pair_id = 'b'").agg(F.sum("alpha")).first()[0] / 40 == pytest.approx(share)


DIST = "track string, shot_index int, cluster_id int, distance double"


def distances(spark, rows):
    return spark.createDataFrame([("t", i, c, v) for i, r in enumerate(rows) for c, v in enumerate(r)], DIST)


def path(df):
    return [r["cluster_id"] for r in df.orderBy("shot_index").collect()]


def test_routing(spark):
    d = distances(spark, [(0.1, 0.2), (0.2, 0.1), (0.1, 0.2), (0.2, 0.1)])
    assert path(routing.route(d)) == [0, 1, 0, 1]
    assert len(set(path(routing.route(d, penalty=0.25)))) == 1
    assert routing.switches(routing.route(d)).first()["switches"] == 3
    assert {round(r["margin"], 6) for r in routing.route(d).collect()} == {0.1}
    with pytest.raises(ValueError):
        routing.moving_average(d, 4)


def whole_path(d, penalty):
    """The first of the cheapest paths, shot by shot over the whole track."""
    cost, back = list(d[0]), []
    for row in d[1:]:
        steps = [min((c + (penalty if a != b else 0.0), a) for a, c in enumerate(cost)) for b in range(len(row))]
        back.append([a for _, a in steps])
        cost = [v + c for v, (c, _) in zip(row, steps)]
    at = min(range(len(cost)), key=lambda b: (cost[b], b))
    out = [at]
    for b in back[::-1]:
        at = b[at]
        out.append(at)
    return out[::-1], min(cost)


@pytest.mark.parametrize("segment", [1, 2, 7])
def test_cheapest_path_by_segments(spark, segment):
    """Several tracks of eighths, so that equal costs are equal; gaps in the shots' numbers; ties."""
    rng = np.random.default_rng(segment)
    tracks = {f"t{i}": rng.integers(0, 3 if i % 2 else 9, (n, 3)) / 8 for i, n in enumerate((1, 2, 13, 30))} | {"even": np.full((15, 4), 0.5)}
    rows = [(t, 3 * i + 5, 10 + c, float(v)) for t, d in tracks.items() for i, r in enumerate(d) for c, v in enumerate(r)]
    got = routing.cheapest_path(spark.createDataFrame(rows, DIST), 0.25, segment).collect()
    for t, d in tracks.items():
        want, cost = whole_path(d.tolist(), 0.25)
        mine = sorted((r["shot_index"], r["cluster_id"], r["cost"]) for r in got if r["track"] == t)
        assert mine == [(3 * i + 5, 10 + c, cost) for i, c in enumerate(want)]
    smooth = routing.moving_average(spark.createDataFrame(rows, DIST), 5, segment)
    for r in smooth.collect():
        d, i = tracks[r["track"]], (r["shot_index"] - 5) // 3
        assert r["distance"] == pytest.approx(np.pad(d[:, r["cluster_id"] - 10], 2, mode="edge")[i : i + 5].mean())
    assert smooth.count() == len(rows)
    moves = {r["track"]: r["switches"] for r in routing.switches(spark.createDataFrame(got)).collect()}
    assert moves == {t: sum(a != b for a, b in zip(p, p[1:])) for t, p in ((t, whole_path(d.tolist(), 0.25)[0]) for t, d in tracks.items())}


def test_numbers_follow_the_order(spark):
    rows = [(k, (i * 7919) % 1000) for k in ("a", "b") for i in range(500)] + [("c", 3)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = numbering.numbered(df, ["v"], "n", ["k"]).collect()
    for k in "abc":
        mine = sorted((r["n"], r["v"]) for r in got if r["k"] == k)
        assert [n for n, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)
    whole = numbering.numbered(df, ["k", "v"], "n").orderBy("n").collect()
    assert [r["n"] for r in whole] == list(range(1001)) and [(r["k"], r["v"]) for r in whole] == sorted(rows)
    sums = {r["v"]: r["s"] for r in numbering.numbered(df.where("k = 'a'"), ["v"], "s", sums="v").collect()}
    assert sums == {v: sum(w for k, w in rows if k == "a" and w <= v) for k, v in rows if k == "a"}
    assert numbering.numbered(df.limit(0), ["v"], "n").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cheapest_path_is_brute_force(spark, seed):
    import itertools

    d = np.random.default_rng(seed).random((6, 3)).round(1)
    cost = lambda p: sum(d[i, c] for i, c in enumerate(p)) + 0.3 * sum(a != b for a, b in zip(p, p[1:]))
    best = min(map(cost, itertools.product(range(3), repeat=6)))
    got = routing.cheapest_path(distances(spark, d.tolist()), 0.3)
    assert got.first()["cost"] == pytest.approx(best) and cost(path(got)) == pytest.approx(best)


@pytest.mark.parametrize("window", [3, 5, 9])
def test_moving_average_replicates_edges(spark, window):
    d = np.random.default_rng(1).random((6, 2))
    pad = np.pad(d, ((window // 2, window // 2), (0, 0)), mode="edge")
    want = np.array([[pad[i : i + window, c].mean() for c in range(2)] for i in range(6)])
    got = routing.moving_average(distances(spark, d.tolist()), window).collect()
    assert all(r["distance"] == pytest.approx(want[r["shot_index"], r["cluster_id"]]) for r in got)


@pytest.mark.parametrize("block", [3, 7, 2000])
def test_silhouettes_of_all_choices_at_once(spark, block):
    rng = np.random.default_rng(5)
    x, labels = rng.normal(size=(23, 3)), np.stack([rng.integers(0, 2, 23), rng.integers(0, 4, 23), np.zeros(23, int), np.arange(23)], axis=1)
    df = spark.createDataFrame([(i, list(map(float, v)), list(map(int, c))) for i, (v, c) in enumerate(zip(x, labels))], "id long, x array<double>, labels array<int>")
    got = {(r["choice"], r["id"]): (r["a"], r["b"], r["s"]) for r in clustering.silhouettes_each(df, block).collect()}
    assert len(got) == 23 * 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for (c, i), (a, b, s) in got.items():
        mine, rest = labels[:, c] == labels[i, c], np.arange(23) != i
        want_a = d[i][mine & rest].mean() if (mine & rest).any() else 0.0
        others = [d[i][labels[:, c] == o].mean() for o in set(labels[:, c]) - {labels[i, c]}]
        assert a == pytest.approx(want_a)
        assert (b is None and s == 0) if not others else b == pytest.approx(min(others)) and s == pytest.approx((min(others) - want_a) / max(min(others), want_a))


def test_clusters(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(-2, 0.1, (8, 6)), rng.normal(2, 0.1, (8, 6))])
    feats = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    points = clustering.standardized(feats, "vec_id", "embedding")
    found, k, score = clustering.auto_clusters(points, 3, starts=1)
    label = {r["id"]: r["cluster_id"] for r in found.collect()}
    assert k == 2 and score > 0.5 and len({label[i] for i in range(8)}) == 1 and label[0] != label[8]
    assert clustering.auto_clusters(points.where("id < 2"))[1] == 1
    same = points.withColumn("x", F.array(F.lit(1.0), F.lit(2.0)))
    assert clustering.kmeans(same, 3, 1)[1] == 0
    lone = points.where("id IN (0, 1, 9)").withColumn("cluster_id", F.when(F.col("id") == 9, 1).otherwise(0))
    assert clustering.silhouettes(lone).where("id = 9").first()["s"] == 1


def test_reports(spark):
    labels = spark.createDataFrame([(0, "day")], "cluster_id int, label string")
    rows = signatures.labelled(spark.createDataFrame([(0,), (4,)], "cluster_id int"), labels).orderBy("cluster_id").collect()
    assert [r["cluster_label"] for r in rows] == ["day", "cluster_05"]
    master = spark.createDataFrame([("master", 1.23456, None)], "label string, mean_de2000 double, max_de2000 double")
    out = signatures.metrics_report(master, master.limit(0))
    assert out.columns == list(signatures.METRICS)
    row = out.first()
    assert row["mean_de2000"] == "1.2346" and row["max_de2000"] == "" and row["cluster_indices"] == ""


def test_data_matrix_has_all_entries(spark, sf):
    """Each sample has the four corners of its tetrahedron, whose values add up to the root of its weight."""
    rows = queries.data_matrix(spark, sf).collect()
    roots = {(r["pair_id"], r["bin_id"]): r["alpha"] ** 0.5 for r in queries.samples(spark, sf).select("pair_id", "bin_id", "alpha").collect()}
    assert len(rows) == 4 * len(roots) == len({(r["pair_id"], r["bin_id"], r["node"]) for r in rows})
    sums = dict.fromkeys(roots, 0.0)
    for r in rows:
        sums[r["pair_id"], r["bin_id"]] += r["val"]
    assert sums == pytest.approx(roots, abs=4e-6)


def test_silhouettes_leave_rows_of_one_id_out(spark):
    """Rows of one id don't count for each other; copies far from zero have no distance."""
    rows = [(0, [0.0, 0.0], 0), (0, [8.0, 0.0], 0), (1, [3.0, 4.0], 0), (2, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "id long, x array<double>, cluster_id int")
    got = {(r["id"], r["cluster_id"]): r for r in clustering.silhouettes(df).collect()}
    assert len(got) == 3
    assert got[0, 0]["a"] == pytest.approx((5 + 41**0.5) / 2) and got[0, 0]["b"] == pytest.approx((1 + 65**0.5) / 2)
    far = spark.createDataFrame([(i, [1e6 + i % 3, 0.1], i % 3) for i in range(30)], "id long, x array<double>, cluster_id int")
    assert {(r["a"], r["s"]) for r in clustering.silhouettes(far, 7).collect()} == {(0.0, 1.0)}


def test_means_of_a_round(spark):
    """A round's sums shuffle a row for each task, start, cluster and dimension; its means are those of the assigned points."""
    x = np.random.default_rng(4).normal(size=(200, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    starts = {0: x[:2].tolist(), 3: x[5:8].tolist()}
    for s, got in clustering._round(points, starts).items():
        own = ((x[:, None] - np.array(starts[s])[None]) ** 2).sum(2).argmin(1)
        assert all(np.allclose(got[i], x[own == i].mean(0), rtol=1e-12) for i in range(len(starts[s])))
    some = spark.createDataFrame([(0, [5.0, 1.0, 2.0]), (1, [1.0, None, 0.0]), (2, None)], "id long, x array<double>")
    assert clustering._round(some, {0: [[0.0, 0.0, 0.0], [5.0, 1.0, 1.0]]}) == {0: {0: [1.0, 0.0], 1: [5.0, 1.0, 2.0]}}
