"""Decoders against the files that the JVM writes, and against encoders written plainly here."""

import struct
import time
import zlib

import numpy as np
import pytest

from hueframe.sources import images


def java_image(jvm, p, kind):
    """A BufferedImage (3 RGB, 10 grey, 12 two colours, 13 palette) of (height, width, 3) bytes."""
    h, w, _ = p.shape
    image = jvm.java.awt.image.BufferedImage(w, h, kind)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, p[y, x])
            image.setRGB(x, y, (255 << 24 | r << 16 | g << 8 | b) - (1 << 32))
    return image


def written(spark, image, path, form, change):
    jvm = spark._jvm
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(form).next()
    how = writer.getDefaultWriteParam()
    change(how)
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    out.close()
    h, w = image.getHeight(), image.getWidth()
    return np.array([[[image.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(w)] for y in range(h)]) / 255.0


@pytest.fixture(scope="module")
def picture():
    rng = np.random.default_rng(3)
    smooth = np.add.outer(np.arange(37) * 5, np.arange(45) * 2)[:, :, None] + np.array([0, 40, 90])
    return (smooth + rng.integers(0, 9, smooth.shape)) % 256


@pytest.mark.parametrize("kind", [5, 10, 12, 13])
@pytest.mark.parametrize("passes", [False, True])
def test_png_kinds(spark, tmp_path, picture, kind, passes):
    image = java_image(spark._jvm, picture, kind)
    want = written(spark, image, tmp_path / "a.png", "png", lambda p: p.setProgressiveMode(1 if passes else 0))
    raw = (tmp_path / "a.png").read_bytes()
    assert raw[28] == passes and raw[25] == {5: 2, 10: 0, 12: 0, 13: 3}[kind]
    # The JVM converts grey on the way out of getRGB; its samples are as they were set only for the others.
    got = images.decode(raw)
    grey = np.array([[image.getRaster().getSample(x, y, 0) for x in range(45)] for y in range(37)]) / 255.0 if kind == 10 else None
    assert np.array_equal(got, np.repeat(grey[:, :, None], 3, axis=2) if kind == 10 else want)


@pytest.mark.parametrize("side", [(1, 1), (1, 9), (9, 1), (3, 2), (5, 5)])
def test_small_interlaced_images(spark, tmp_path, picture, side):
    """Passes that are empty hold no lines."""
    image = java_image(spark._jvm, picture[: side[0], : side[1]], 5)
    want = written(spark, image, tmp_path / "a.png", "png", lambda p: p.setProgressiveMode(1))
    assert np.array_equal(images.decode((tmp_path / "a.png").read_bytes()), want)


@pytest.mark.parametrize("packing", ["LZW", "Deflate", "ZLib", "PackBits", None])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_packings(spark, tmp_path, picture, packing, tile):
    def how(p):
        if packing:
            p.setCompressionMode(2)
            p.setCompressionType(packing)
        if tile:
            p.setTilingMode(2)
            p.setTiling(*tile, 0, 0)

    for kind in (5, 13):
        image = java_image(spark._jvm, picture, kind)
        want = written(spark, image, tmp_path / f"{kind}.tif", "tiff", how)
        raw = (tmp_path / f"{kind}.tif").read_bytes()
        assert images.dimensions(raw) == (45, 37) and np.abs(images.decode(raw) - want).max() < 1e-12
    # The source reads them as it reads others.
    rows = images.read_images(spark, str(tmp_path / "5.tif")).toPandas()
    assert len(rows) == 45 * 37


def test_lzw_widens_and_clears(spark, tmp_path):
    p = np.random.default_rng(5).integers(0, 256, (80, 90, 3))
    image = java_image(spark._jvm, p, 5)
    want = written(spark, image, tmp_path / "a.tif", "tiff", lambda q: (q.setCompressionMode(2), q.setCompressionType("LZW")))
    assert np.array_equal(images.decode((tmp_path / "a.tif").read_bytes()), want)


def tiff(order, tags, parts):
    """A TIFF of parts and tags {tag: (type, values)}; where parts lie is added under 273 and 279."""
    at, starts = 8, []
    for part in parts:
        starts.append(at)
        at += len(part)
    tags = dict(tags) | {273: (4, starts), 279: (4, [len(x) for x in parts])}
    entries, extra, place = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, (kind, values) in sorted(tags.items()):
        body = struct.pack(order + {3: "H", 4: "I"}[kind] * len(values), *values)
        if len(body) > 4:
            entries += struct.pack(order + "HHII", tag, kind, len(values), place + len(extra))
            extra += body
        else:
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(order + "I", at) + b"".join(parts) + struct.pack(order + "H", len(tags)) + entries + bytes(4) + extra


@pytest.mark.parametrize("order", "<>")
def test_tiff_predictors_planes_and_bits(order):
    p = np.random.default_rng(8).integers(0, 65536, (6, 7, 3))
    size = {256: (3, [7]), 257: (3, [6]), 277: (3, [3]), 262: (3, [2])}
    turned = np.diff(p, axis=1, prepend=0) % 65536
    strips = [zlib.compress(turned[y : y + 4].astype(order + "u2").tobytes()) for y in (0, 4)]
    raw = tiff(order, size | {258: (3, [16] * 3), 259: (3, [8]), 317: (3, [2]), 278: (3, [4])}, strips)
    assert np.array_equal(images.decode(raw), p / 65535)
    planes = [p[:, :, c].astype(order + "u2").tobytes() for c in range(3)]
    assert np.array_equal(images.decode(tiff(order, size | {258: (3, [16] * 3), 284: (3, [2])}, planes)), p / 65535)
    f = (p / 60000).astype(np.float32)
    highest = f.astype(">f4").view(np.uint8).reshape(6, 21, 4).transpose(0, 2, 1).reshape(6, 28, 3)
    turned = np.diff(highest.astype(int), axis=1, prepend=0) % 256
    raw = tiff(order, size | {258: (3, [32] * 3), 339: (3, [3] * 3), 259: (3, [8]), 317: (3, [3])}, [zlib.compress(turned.astype(np.uint8).tobytes())])
    assert np.array_equal(images.decode(raw), f)
    bits = np.random.default_rng(9).integers(0, 2, (6, 7))
    packed = np.packbits(bits, axis=1).tobytes()
    for light, want in ((0, 1 - bits), (1, bits)):
        raw = tiff(order, size | {258: (3, [1]), 277: (3, [1]), 262: (3, [light])}, [packed])
        assert np.array_equal(images.decode(raw), np.repeat(want[:, :, None], 3, axis=2))
    with pytest.raises(ValueError):
        images.decode(tiff(order, size | {258: (3, [16] * 3), 259: (3, [7])}, [b""]))
    with pytest.raises(ValueError):
        images.decode(tiff(order, size | {258: (3, [16] * 3), 317: (3, [3])}, planes))


def test_mixed_filters_and_a_large_image():
    """Lines with filters of their own, undone one byte after the other; four million pixels of the slowest filter take seconds."""
    rng = np.random.default_rng(11)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    png = lambda w, h, rows: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")
    h, w = 23, 17
    rows = rng.integers(0, 256, (h, 1 + 3 * w)).astype(np.uint8)
    rows[:, 0] = rng.integers(0, 5, h)
    plain = np.zeros((h + 1, 3 * w + 3), int)
    for y in range(h):
        for i in range(3 * w):
            a, b, c = plain[y + 1, i], plain[y, i + 3], plain[y, i]
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            plain[y + 1, i + 3] = (int(rows[y, i + 1]) + [0, a, b, (a + b) // 2, paeth][rows[y, 0]]) % 256
    assert np.array_equal(images.decode(png(w, h, rows)), plain[1:, 3:].reshape(h, w, 3) / 255)
    rows = np.full((2000, 6001), 4, np.uint8)
    began = time.time()
    assert images.decode(png(2000, 2000, rows)).shape == (2000, 2000, 3) and time.time() - began < 30
