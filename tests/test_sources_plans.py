import csv
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hueframe.operators import lattices
from hueframe.operators.fitting import FitOptions
from hueframe.plans import extract as plans
from hueframe.sources import cube, images, tables

OPTIONS = plans.Options(fit=FitOptions(size=3, rounds=0, loss="l2"), bins=8, min_samples=1)


def picture(seed=99, n=24):
    return np.random.default_rng(seed).random((n, n, 3))


def save(path, pixels, bits=16):
    path.write_bytes(images.encode_png(pixels, bits))
    return str(path)


def filtered_png(pixels, kind):
    """A PNG whose rows all use one filter."""
    h, w, _ = pixels.shape
    raw = (pixels * 255).astype(np.int64).reshape(h, -1)
    rows, above = [], np.zeros(w * 3, np.int64)
    for line in raw:
        left, corner = np.r_[0, 0, 0, line[:-3]], np.r_[0, 0, 0, above[:-3]]
        p = left + above - corner
        dist = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        guess = [0 * line, left, above, (left + above) // 2, np.choose(dist.argmin(0), [left, above, corner])][kind]
        rows.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    p = picture(n=9)
    assert np.array_equal(images.decode(filtered_png(p, kind)), np.floor(p * 255).astype(int) / 255)


@pytest.mark.parametrize("bits", [8, 16])
def test_images_round_trip(spark, tmp_path, bits):
    p = picture()
    p[0, 0] = (-0.5, 1.5, 0.5)
    path = save(tmp_path / "a.png", p, bits)
    got = images.read_images(spark, path).toPandas()
    out = np.zeros((24, 24, 3))
    out[got.y, got.x] = got[["r", "g", "b"]].to_numpy()
    assert np.abs(out - np.clip(p, 0, 1)).max() <= 1 / (2**bits - 1)
    assert tuple(images.read_dimensions(spark, path).select("width", "height").first()) == (24, 24)
    again = images.write_image(images.read_images(spark, path), tmp_path / "b.png", bits)
    assert np.abs(images.decode(again.read_bytes()) - out).max() <= 1 / (2**bits - 1)


def test_tiff():
    p = (picture(n=4) * 65535).astype("<u2")
    body = p.tobytes()
    tags = [(256, 3, 4), (257, 3, 4), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 3), (279, 4, len(body))]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    raw = b"II*\0" + struct.pack("<I", 8 + len(body)) + body + ifd
    assert images.dimensions(raw) == (4, 4) and np.allclose(images.decode(raw), p / 65535)
    with pytest.raises(ValueError):
        images.decode(b"GIF89a" + b"\0" * 40)


def bmp(p):
    """A BMP of 24 bits: lines from the bottom up, blue first, padded to four bytes."""
    h, w, _ = p.shape
    pad = -3 * w % 4
    body = b"".join(p[y, :, ::-1].tobytes() + bytes(pad) for y in reversed(range(h)))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def test_bmp_and_jpeg(spark, tmp_path):
    p = np.floor(picture(n=6) * 255).astype(np.uint8)[:, :5]
    folder = tmp_path / "some images"
    folder.mkdir()
    (folder / "a b.BMP").write_bytes(bmp(p))
    save(folder / "c.png", p / 255.0, 8)
    (folder / "notes.txt").write_text("no image")
    jvm = spark.sparkContext._jvm
    decoded = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(folder / "a b.BMP")))
    assert jvm.javax.imageio.ImageIO.write(decoded, "jpg", jvm.java.io.File(str(folder / "d.jpg")))
    again = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(folder / "d.jpg")))  # noise loses much in a JPEG: its own pixels are the truth
    rgb = np.array([[again.getRGB(x, y) for x in range(5)] for y in range(6)])
    truth = np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], axis=2)
    got = images.read_images(spark, str(folder)).toPandas()
    by_name = {k.rsplit("/", 1)[1]: v for k, v in got.groupby("image_id")}
    assert sorted(by_name) == ["a b.BMP", "c.png", "d.jpg"]
    for name, want, off in (("a b.BMP", p, 1e-12), ("c.png", p, 1.01 / 255), ("d.jpg", truth, 1e-12)):
        rows = by_name[name]
        out = np.full(p.shape, np.nan)
        out[rows.y, rows.x] = rows[["r", "g", "b"]].to_numpy()
        assert np.abs(out - want / 255.0).max() <= off, name
    sizes = images.read_dimensions(spark, [str(folder / n) for n in ("a b.BMP", "c.png", "d.jpg")]).collect()
    assert {(r["width"], r["height"]) for r in sizes} == {(5, 6)} and len(sizes) == 3
    assert images.read_images(spark, str(folder / "d.jpg")).count() == 30


def test_bands_of_an_image(spark, tmp_path):
    """Lines of several bands, one of them without any pixel, and pixels that are missing."""
    width = 400_000 // 40  # a band is 100 lines
    rows = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (250, 3, 0.0, 1.0, 0.0), (250, width - 1, 0.0, 0.0, 1.0)], "y int, x int, r double, g double, b double")
    out = images.decode(images.write_image(rows, tmp_path / "a.png", 8).read_bytes())
    assert out.shape == (251, width, 3) and out.sum() == 3.0
    assert out[0, 0, 0] == out[250, 3, 1] == out[250, width - 1, 2] == 1.0


def test_output_paths(tmp_path):
    assert images.check_output(tmp_path / "a.png") == tmp_path / "a.png"
    with pytest.raises(FileNotFoundError):
        images.check_output(tmp_path / "none" / "a.png")
    with pytest.raises(IsADirectoryError):
        images.check_output(tmp_path)
    assert images.check_input("s3a://bucket/a.JPG") == images.located("s3a://bucket/a.JPG") == "s3a://bucket/a.JPG"


def test_limits(tmp_path):
    for size in ((0, 4), (20_000, 1), (16_000, 16_000)):
        with pytest.raises(ValueError):
            images.check_size(*size)
    with pytest.raises(FileNotFoundError):
        images.check_input(tmp_path / "none.png")
    (tmp_path / "a.exr").write_bytes(b"x")
    with pytest.raises(ValueError):
        images.check_input(tmp_path / "a.exr")


def test_cube_files(spark, tmp_path):
    lattice = lattices.identity_lattice(spark, 4)
    path = cube.write_cube(lattice, tmp_path / "a.cube", 4, title="look", shaper=[(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)])
    lines = path.read_text().splitlines()
    assert lines[0] == 'TITLE "look"' and "LUT_1D_SIZE 2" in lines and "LUT_3D_SIZE 4" in lines and lines[-1] == "1.000000 1.000000 1.000000"
    files = cube.read_files(spark, str(path))
    d = cube.describe(files).first()
    assert (d["size"], d["size_1d"], d["title"], d["problem"]) == (4, 2, "look", None)
    got = cube.read_cube(spark, str(path)).orderBy("node_id").collect()
    want = lattice.orderBy("node_id").collect()
    assert all(abs(a[k] - b[k]) < 2e-6 for a, b in zip(got, want) for k in "rgb") and len(got) == 64
    assert cube.shaper_rows(files).count() == 2
    with pytest.raises(ValueError):
        cube.write_cube(lattice, tmp_path / "b.cube", 200)
    with pytest.raises(ValueError):
        cube.write_cube(lattice, tmp_path / "b.cube", 5)


@pytest.mark.parametrize("text,problem", [("0 0 0\n", "no LUT_3D_SIZE"), ("LUT_3D_SIZE 1\n0 0 0", "out of range"), ("LUT_3D_SIZE 500", "out of range"), ("LUT_3D_SIZE 2\n0 0 0", "wrong number"), ("LUT_3D_SIZE 2\n" + "0 0 nan\n" * 8, "finite"), ("LUT_1D_SIZE 1\nLUT_3D_SIZE 2\n" + "0 0 0\n" * 9, "LUT_1D_SIZE"), ("LUT_3D_SIZE 2\n" + "\n" * 400 + "0 0 0\n" * 8, "too many"), ("DOMAIN_MIN a b c\nLUT_3D_SIZE 2\n" + "0 0 0\n" * 8, "domain")])
def test_bad_cube_files(spark, text, problem):
    files = spark.createDataFrame([("x", text)], "lut_id string, text string")
    assert problem in cube.describe(files).first()["problem"]
    if "0 0 0" in text:
        with pytest.raises(Exception, match="bad .cube"):
            cube.parse_text(files).collect()


def test_pair_manifests(spark, tmp_path):
    (tmp_path / "m.csv").write_text('source,target,weight\n# note\n\na.png, b.png\n/x/c.png,"d,e.png",2.5,Day,LINEAR,None\nf.png,g.png,,Night\n')
    rows = tables.read_pairs(spark, str(tmp_path / "m.csv")).orderBy("pair_index").collect()
    assert [r["pair_index"] for r in rows] == [0, 1, 2]
    assert rows[0]["source"] == str(tmp_path / "a.png") and rows[0]["weight"] == 1 and rows[0]["cluster"] is None
    assert tuple(rows[1])[1:] == ("/x/c.png", str(tmp_path / "d,e.png"), 2.5, "Day", "linear", "none")
    assert rows[2]["weight"] == 1 and rows[2]["cluster"] == "Night"
    for bad in ("only\n", "a,b,-1\n", "a,b,1,c,d,e,f\n"):
        (tmp_path / "bad.csv").write_text(bad)
        with pytest.raises(Exception):
            tables.read_pairs(spark, str(tmp_path / "bad.csv")).collect()


def test_shot_manifests(spark, tmp_path):
    (tmp_path / "s.csv").write_text("shot_id,frame_path\ns1,a.png\nb.png\n,c.png,Linear\nd.png\n")
    rows = tables.read_shots(spark, str(tmp_path / "s.csv")).orderBy("frame_index").collect()
    assert [r["shot_id"] for r in rows] == ["s1", "shot_0001", "shot_0004", "shot_0002"] and rows[2]["transfer_fn"] == "linear"


def test_names():
    assert str(tables.cluster_path("/o/x.cube", "day / one")) == "/o/x_day___one.cube" and tables.cluster_path("x.cube", "//").name == "x_cluster.cube"
    assert tables.short_name("a" * 23 + ".aml2") and not tables.short_name("a" * 24 + ".aml2")
    assert [plans.grade(v) for v in (0.5, 2, 4, 9)] == ["invisible", "good", "fair", "poor"]


def test_extract_one_pair(spark, tmp_path):
    p = picture()
    source, target = save(tmp_path / "s.png", p), save(tmp_path / "t.png", np.clip(p * 1.1 + 0.02, 0, 1))
    stages = []
    r = plans.extract_pair(spark, source, target, tmp_path / "o.cube", OPTIONS, progress=lambda s, f, m: stages.append(s))
    assert r.output.exists() and stages == ["preprocess", "sampling", "solving", "validation", "export", "export"]
    m = r.metrics.first()
    assert r.lattice.count() == 27 and m["mean_de2000"] < 12 and r.diagnostics["transfers"] == ["unknown"]
    checked = plans.validate(spark, source, target, str(r.output)).first()
    assert checked["mean_de2000"] < 15
    with pytest.raises(plans.Cancelled):
        plans.extract_pair(spark, source, target, options=OPTIONS, cancel=lambda: True)


def test_cancel_within_a_stage(spark):
    """A job of minutes ends within seconds of the caller's word, and later jobs of the session run."""
    import threading
    import time

    def slow(batches):
        for b in batches:
            time.sleep(120)
            yield b

    stop, began = threading.Event(), time.time()
    threading.Timer(2.0, stop.set).start()
    with pytest.raises(plans.Cancelled, match="within"), plans.cancellable(spark, stop.is_set):
        spark.range(8, numPartitions=2).mapInArrow(slow, "id long").count()
    assert time.time() - began < 40 and spark.range(5).count() == 5
    # An error of the job's own stays what it is.
    with pytest.raises(ZeroDivisionError), plans.cancellable(spark, lambda: False):
        1 / 0
    # A fit that is told to end while it solves doesn't come to its measures.
    rows = [("p", y, x, *(min(max(v, 0.0), 1.0) for v in (x / 23, y / 23, (x + y) / 46)), *(min(1.1 * v, 1.0) for v in (x / 23, y / 23, (x + y) / 46))) for y in range(24) for x in range(24)]
    pixels = spark.createDataFrame(rows, "pair_id string, y int, x int, sr double, sg double, sb double, tr double, tg double, tb double")
    stages = []
    with pytest.raises(plans.Cancelled, match="within"):
        plans.extract(spark, pixels, OPTIONS, progress=lambda s, f, m: stages.append(s), cancel=lambda: "solving" in stages)
    assert "validation" not in stages and spark.range(5).count() == 5


@pytest.fixture(scope="module")
def batch(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("batch")
    lines = ["source,target,weight,cluster"]
    for i in range(4):
        p = picture(i, 16) * (1.0 if i < 2 else 0.4)
        save(folder / f"s{i}.png", p)
        save(folder / f"t{i}.png", np.clip(p * (1.05 if i < 2 else 1.3), 0, 1))
        lines.append(f"s{i}.png,t{i}.png,{3 if i == 0 else 1},{'day' if i < 2 else 'night'}")
    (folder / "m.csv").write_text("\n".join(lines) + "\n")
    results = plans.extract_batch(spark, str(folder / "m.csv"), folder / "o.cube", OPTIONS, cluster="manual", reports=folder)
    return folder, results


def test_extract_batch(batch):
    folder, results = batch
    assert set(results) == {"master", "day", "night"} and (folder / "o_day.cube").exists() and (folder / "o.cube").exists()
    assigned = list(csv.DictReader((folder / "cluster_assignments.csv").open()))
    assert len(assigned) == 4 and {r["cluster_label"] for r in assigned} == {"day", "night"} and assigned[0].keys() >= {"pair_index", "detected_transfer_function"}
    metrics = list(csv.DictReader((folder / "batch_metrics.csv").open()))
    line = plans.summary(results["master"])
    assert line.startswith(f"pairs: {metrics[0]['num_pairs']}, used: {metrics[0]['num_pairs_used']}, bins: {metrics[0]['occupied_bins']}") and line.endswith(" s")
    assert [r["label"] for r in metrics][0] == "master" and len(metrics) == 3 and metrics[0]["num_pairs"] == "4"
    assert len(list(csv.DictReader((folder / "cluster_centroids.csv").open()))) == 2


def test_route_shots(spark, batch):
    folder, _ = batch
    (folder / "shots.csv").write_text("a,s0.png\na,s1.png\nb,s2.png\nc,s0.png\n")
    rows = plans.route_shots(spark, str(folder / "shots.csv"), str(folder / "cluster_centroids.csv"), folder / "routes.csv").collect()
    assert [r["shot_id"] for r in rows] == ["a", "b", "c"] and [r["cluster_label"] for r in rows] == ["day", "night", "day"] and rows[0]["frame_count"] == 2
    assert len(list(csv.DictReader((folder / "routes.csv").open()))) == 3


def test_outlier_pair_is_dropped(spark):
    from .test_operators import pixels

    rows = None
    for i in range(5):
        p = pixels(spark, 400, seed=i, pair=f"p{i}")
        p = p if i < 4 else p.withColumns({t: 1 - F.col(s) for s, t in (("sr", "tr"), ("sg", "tg"), ("sb", "tb"))})
        rows = p if rows is None else rows.union(p)
    r = plans.extract(spark, rows, plans.Options(fit=OPTIONS.fit, bins=4, min_samples=1, outlier_sigma=3.0))
    assert r.diagnostics["dropped_pairs"] == ["p4"] and r.pairs.where("pair_id = 'p4' AND mse IS NULL").count() == 1
    mixed = rows.withColumn("sr", F.when(F.col("pair_id") == "p0", F.col("sr") * 9).otherwise(F.col("sr")))
    with pytest.raises(ValueError, match="several transfer"):
        plans.extract(spark, mixed, OPTIONS)


def test_hald(spark, tmp_path):
    plate = plans.hald_generate(spark, tmp_path / "h.png", 2)
    path = plans.hald_reconstruct(spark, str(plate), tmp_path / "h.cube", 2, size=7)
    got = cube.read_cube(spark, str(path)).where("node_id = 342").first()
    assert (got["r"], got["g"], got["b"]) == pytest.approx((1, 1, 1), abs=1e-4)
    with pytest.raises(ValueError):
        plans.hald_reconstruct(spark, str(plate), tmp_path / "h.cube", 12)
    with pytest.raises(ValueError):
        plans.hald_reconstruct(spark, str(plate), tmp_path / "h.cube", 3)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
