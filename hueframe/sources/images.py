"""Images as pixel tables: PNG and TIFF by their headers; JPEG and BMP through Spark's image source."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decoders import MAX_PIXELS, MAX_SIDE, PNG, check_size, decode, dimensions  # noqa: F401

# File kinds that are images.
OWN_EXTENSIONS, JVM_EXTENSIONS = (".png", ".tif", ".tiff"), (".jpg", ".jpeg", ".bmp")
EXTENSIONS = OWN_EXTENSIONS + JVM_EXTENSIONS
OTHER_EXTENSIONS = (".exr", ".dpx", ".hdr")
SCHEMA = "image_id string, y int, x int, r double, g double, b double"


def check_input(path: str | Path) -> Path | str:
    """The path of an image. One with a scheme, as hdfs:// or s3a://, is for Spark to find; others are on this machine's disk."""
    remote = "://" in str(path)
    suffix = os.path.splitext(str(path))[1].lower()
    if not remote and not Path(path).is_file():
        raise FileNotFoundError(f"no file {path}")
    if suffix not in EXTENSIONS:
        raise ValueError(f"{suffix} is not read here" + " (no decoder)" * (suffix in OTHER_EXTENSIONS))
    return str(path) if remote else Path(path)


def check_output(path: str | Path) -> Path:
    """The path of a file to write: its folder must be there and be writable, and it must not be a folder itself."""
    path = Path(path)
    if not path.parent.is_dir():
        raise FileNotFoundError(f"no folder {path.parent}")
    if not os.access(path.parent, os.W_OK):
        raise PermissionError(f"cannot write to {path.parent}")
    if path.is_dir():
        raise IsADirectoryError(f"{path} is a folder")
    return path


def located(path: str | Path) -> str:
    """The full path of a file, as it is if it names a scheme."""
    return str(path) if "://" in str(path) else str(Path(path).resolve())


def _chunk(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def _png_start(width: int, height: int, bits: int) -> bytes:
    if bits not in (8, 16):
        raise ValueError("8 or 16 bits")
    check_size(width, height)
    return PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, 2, 0, 0, 0))


def _scanlines(pixels: np.ndarray, bits: int) -> bytes:
    """Lines of (height, width, 3) values, each behind its filter byte 0; values are clipped to 0..1 and cut, not rounded."""
    height = len(pixels)
    whole = np.floor(np.clip(pixels, 0.0, 1.0) * (2**bits - 1)).astype(">u2" if bits == 16 else np.uint8)
    return np.concatenate([np.zeros((height, 1), np.uint8), whole.reshape(height, -1).view(np.uint8).reshape(height, -1)], axis=1).tobytes()


def encode_png(pixels: np.ndarray, bits: int = 16) -> bytes:
    """A PNG of (height, width, 3) values, clipped to 0..1 and cut, not rounded, to integers."""
    height, width, _ = pixels.shape
    return _png_start(width, height, bits) + _chunk(b"IDAT", zlib.compress(_scanlines(pixels, bits))) + _chunk(b"IEND", b"")


def _pixel_rows(name: str, image: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
    height, width, _ = image.shape
    block = max(1, rows // width)
    for top in range(0, height, block):
        part = image[top : top + block].reshape(-1, 3)
        y, x = np.divmod(np.arange(len(part)), width)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array((y + top).astype(np.int32)), pa.array(x.astype(np.int32)), *(pa.array(part[:, c].astype(np.float64)) for c in range(3))], names=["image_id", "y", "x", "r", "g", "b"])


def pixels_of(files: DataFrame, rows: int = 200_000) -> DataFrame:
    """Pixels (image_id, y, x, r, g, b) of files (path, content): a task decodes one image at a time and hands on blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _pixel_rows(batch.column(0)[i].as_py(), decode(batch.column(1)[i].as_py()), rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def pixels_of_decoded(found: DataFrame, rows: int = 200_000) -> DataFrame:
    """Pixels of Spark's own image rows (image): 8 bits, blue first, grey or with alpha. A file that isn't an image is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                origin, height, width, channels, data = (c[i].as_py() for c in batch.columns)
                if channels not in (1, 3, 4):
                    raise ValueError(f"{origin} is no image that can be decoded")
                check_size(width, height)
                image = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                yield from _pixel_rows(unquote(origin), (image[:, :, :1].repeat(3, axis=2) if channels == 1 else image[:, :, 2::-1]) / 255.0, rows)

    return found.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, SCHEMA)


def _found(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """Files (path, content) for the own decoders and image rows of Spark's source; folders are searched for both, by suffix."""
    paths = [path] if isinstance(path, str) else list(path)
    out = []
    for kind, mine, others in (("binaryFile", OWN_EXTENSIONS, JVM_EXTENSIONS), ("image", JVM_EXTENSIONS, OWN_EXTENSIONS)):
        here = [p for p in paths if not p.lower().endswith(others)]
        names = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in mine)
        out.append(spark.read.format(kind).option("pathGlobFilter", f"*{{{names}}}").load(here) if here else None)
    return tuple(out)


def _joined(parts: list[DataFrame | None]) -> DataFrame:
    some = [p for p in parts if p is not None]
    if not some:
        raise ValueError("no paths are given")
    return some[0].union(some[1]) if len(some) == 2 else some[0]


def read_images(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pixels (image_id, y, x, r, g, b) of image files, or of those in folders, on any store that Spark reads."""
    own, jvm = _found(spark, path)
    return _joined([own and pixels_of(own), jvm and pixels_of_decoded(jvm)])


def read_dimensions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(image_id, width, height): of PNG and TIFF from headers, of JPEG and BMP from the decoded image."""
    schema = "image_id string, width int, height int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [dimensions(c.as_py()) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32())], names=["image_id", "width", "height"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([unquote(v) for v in batch.column(0).to_pylist()], pa.string()), *batch.columns[1:]], names=["image_id", "width", "height"])

    own, jvm = _found(spark, path)
    return _joined([own and own.select("path", "content").mapInArrow(run, schema), jvm and jvm.select("image.origin", "image.width", "image.height").mapInArrow(named, schema)])


def write_image(pixels: DataFrame, path: str | Path, bits: int = 16) -> Path:
    """One image of rows (y, x, r, g, b) as a PNG on the driver's disk; its size has the limits of an image.

    Tasks make bands of lines of about a million pixels; the driver compresses one band at a time. Missing pixels are black.
    """
    path = check_output(path)
    size = pixels.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).first()
    height, width = size["h"] or 0, size["w"] or 0
    start = _png_start(width, height, bits)
    lines = max(1, 1_000_000 // width)

    def band(key: tuple, rows: pa.Table) -> pa.Table:
        top = key[0].as_py() * lines
        out = np.zeros((min(lines, height - top), width, 3))
        out[rows["y"].to_numpy() - top, rows["x"].to_numpy()] = np.stack([rows[c].to_numpy() for c in "rgb"], axis=1)
        return pa.table({"band": pa.array([key[0].as_py()], pa.int64()), "lines": pa.array([_scanlines(out, bits)], pa.binary())})

    keyed = pixels.select(F.floor(F.col("y") / lines).alias("band"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *(F.col(c).cast("double").alias(c) for c in "rgb"))
    bands = keyed.groupBy("band").applyInArrow(band, "band long, lines binary").orderBy("band")
    squeeze, at = zlib.compressobj(), 0
    with path.open("wb") as f:
        f.write(start)
        for row in bands.toLocalIterator():
            for missing in range(at, row["band"]):
                body = squeeze.compress(bytes((1 + width * bits // 8 * 3) * lines))
                f.write(_chunk(b"IDAT", body) if body else b"")
            body = squeeze.compress(row["lines"])
            f.write(_chunk(b"IDAT", body) if body else b"")
            at = row["band"] + 1
        f.write(_chunk(b"IDAT", squeeze.flush()) + _chunk(b"IEND", b""))
    return path
