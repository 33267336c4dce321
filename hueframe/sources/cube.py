"""Lattice files in the .cube text format: red fastest, six decimals."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .images import check_output

MAX_SIZE = 129


def data_lines(lattice: DataFrame) -> DataFrame:
    """(lut_id, node_id, line) of lattices."""
    return lattice.select("lut_id", "node_id", F.format_string("%.6f %.6f %.6f", "r", "g", "b").alias("line"))


def header(n: int, title: str = "", kernel: str = "tetrahedral", low=(0.0, 0.0, 0.0), high=(1.0, 1.0, 1.0), shaper: list[tuple[float, float, float]] | None = None) -> list[str]:
    if not 2 <= n <= MAX_SIZE:
        raise ValueError(f"a .cube file has 2 to {MAX_SIZE} nodes a side, not {n}")
    if shaper is not None and (len(shaper) < 2 or any(len(s) != 3 for s in shaper)):
        raise ValueError("a shaper has two rows or more of three values")
    triple = lambda v: " ".join(f"{x:.6f}" for x in v)
    lines = [f'TITLE "{title}"'] if title else []
    lines += [f"# For {kernel} interpolation", ""]
    if shaper is not None:
        lines += [f"LUT_1D_SIZE {len(shaper)}", *map(triple, shaper), ""]
    return [*lines, f"LUT_3D_SIZE {n}", f"DOMAIN_MIN {triple(low)}", f"DOMAIN_MAX {triple(high)}", ""]


def text_of(lattice: DataFrame, n: int, **options) -> DataFrame:
    """(lut_id, text): whole files as text, one row a lattice, whose n^3 lines n bounds."""
    head = "\n".join(header(n, **options))
    body = data_lines(lattice).groupBy("lut_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "line"))).alias("l"))
    return body.select("lut_id", F.concat(F.lit(head + "\n"), F.array_join(F.transform("l", lambda v: v["line"]), "\n"), F.lit("\n")).alias("text"))


def write_cube(lattice: DataFrame, path: str | Path, n: int, **options) -> Path:
    """One lattice as a file on the driver's disk; its text comes as a single row."""
    path = check_output(path)
    rows = text_of(lattice, n, **options).take(2)
    if len(rows) != 1:
        raise ValueError("a .cube file holds one lattice")
    if rows[0]["text"].count("\n") < n**3:
        raise ValueError(f"the lattice has fewer than {n**3} nodes")
    path.write_text(rows[0]["text"], encoding="utf-8")
    return path


def write_cubes(lattice: DataFrame, folder: str, n: int, **options) -> str:
    """Any number of lattices as .cube texts in a new folder of any store, one file in `lut_id=...` for each, written by the executors.

    Spark's committer renames files into place, so that a lost task leaves none behind. A lattice that lacks nodes is an error, and so is a folder that exists.
    """
    head = "\n".join(header(n, **options))
    body = data_lines(lattice).groupBy("lut_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "line"))).alias("l"))
    whole = F.when(F.size("l") == n**3, F.array_join(F.transform("l", lambda v: v["line"]), "\n")).otherwise(F.raise_error(F.format_string(f"lattice %s hasn't {n**3} nodes", F.col("lut_id"))))
    body.select("lut_id", F.concat(F.lit(head + "\n"), whole).alias("text")).write.partitionBy("lut_id").text(folder)
    return folder


def read_cubes(spark: SparkSession, folder: str) -> DataFrame:
    """Lattices of a folder that `write_cubes` wrote, by the names that they had."""
    rows = spark.read.schema("value string, lut_id string").text(folder, wholetext=True)
    return parse_text(rows.select("lut_id", F.col("value").alias("text")))


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_ODD = r"(?i)^[-+]?(?:nan|inf|infinity)$"


def _lines(files: DataFrame) -> DataFrame:
    """(lut_id, line_no, line, size_1d_line...) of files (lut_id, text), without comments and blank lines."""
    raw = files.select("lut_id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    return raw.select("lut_id", "line_no", F.trim("line").alias("line")).where("line <> '' AND NOT startswith(line, '#')")


def _number_after(word: str) -> Column:
    return F.max(F.when(F.upper("line").startswith(word), F.element_at(F.split("line", r"\s+"), -1)))


def describe(files: DataFrame) -> DataFrame:
    """(lut_id, size, size_1d, title, domain_min, domain_max, rows, odd, lines, problem) of files; `problem` is null for sound ones."""
    is_row = F.col("line").rlike(rf"^{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}")
    parts = F.split("line", r"\s+")
    odd = (F.size(parts) >= 3) & F.exists(F.slice(parts, 1, 3), lambda p: p.rlike(_ODD)) & F.forall(F.slice(parts, 1, 3), lambda p: p.rlike(_ODD) | p.rlike(rf"^{_NUMBER}$"))
    domain = lambda word: F.max(F.when(F.upper("line").startswith(word), F.transform(F.slice(parts, 2, 3), lambda p: p.try_cast("double"))))
    title = F.max(F.when(F.upper("line").startswith("TITLE"), F.when(F.instr("line", '"') > 0, F.regexp_extract("line", '"([^"]*)', 1)).otherwise(F.trim(F.substring("line", 7, 10_000)))))
    found = _lines(files).groupBy("lut_id").agg(_number_after("LUT_3D_SIZE").alias("s3"), _number_after("LUT_1D_SIZE").alias("s1"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(domain("DOMAIN_MIN"), F.array(*[F.lit(0.0)] * 3)).alias("domain_min"), F.coalesce(domain("DOMAIN_MAX"), F.array(*[F.lit(1.0)] * 3)).alias("domain_max"), F.sum(is_row.cast("int")).alias("rows"), F.sum(odd.cast("int")).alias("odd"))
    sized = files.select("lut_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).alias("lines")).join(found, "lut_id", "left").withColumns({"size": F.col("s3").try_cast("int"), "size_1d": F.coalesce(F.col("s1").try_cast("int"), F.lit(0))})
    expected = F.col("size") * F.col("size") * F.col("size")
    problem = (
        F.when(F.col("s3").isNull(), "no LUT_3D_SIZE")
        .when(F.col("size").isNull() | (F.col("size") < 2) | (F.col("size") > MAX_SIZE), "LUT_3D_SIZE out of range")
        .when(F.col("s1").isNotNull() & (F.col("size_1d") < 2), "LUT_1D_SIZE out of range")
        .when(F.col("odd") > 0, "a value that isn't finite")
        .when(F.exists("domain_min", lambda v: v.isNull()) | F.exists("domain_max", lambda v: v.isNull()), "a domain that isn't numbers")
        .when(F.col("lines") > expected + F.col("size_1d") + 200, "too many lines")
        .when(F.col("rows") != expected + F.col("size_1d"), "a wrong number of rows")
    )
    return sized.withColumn("problem", problem).select("lut_id", "size", "size_1d", "title", "domain_min", "domain_max", "rows", "odd", "lines", "problem")


def parse_text(files: DataFrame) -> DataFrame:
    """Lattices (lut_id, node_id, r, g, b) of files (lut_id, text); rows that aren't three numbers are left out, as are the shaper's.

    A file with a problem, as `describe` finds it, raises an error when its rows are read.
    """
    rows = _lines(files).where(F.col("line").rlike(rf"^{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}"))
    kept = rows.groupBy("lut_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).join(describe(files).select("lut_id", "size_1d", "problem"), "lut_id")
    kept = kept.where(F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("bad .cube file: "), "problem")).cast("boolean")).otherwise(True))
    each = kept.select("lut_id", "size_1d", F.posexplode("l").alias("at", "v")).where("at >= size_1d")
    value = F.split("v.line", r"\s+")
    return each.select("lut_id", (F.col("at") - F.col("size_1d")).cast("long").alias("node_id"), *(value[i].cast("double").alias(k) for i, k in enumerate("rgb")))


def shaper_rows(files: DataFrame) -> DataFrame:
    """(lut_id, i, r, g, b) of the files' one-dimensional tables."""
    rows = _lines(files).where(F.col("line").rlike(rf"^{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}"))
    kept = rows.groupBy("lut_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).join(describe(files).select("lut_id", "size_1d"), "lut_id")
    value = F.split("v.line", r"\s+")
    return kept.select("lut_id", "size_1d", F.posexplode("l").alias("i", "v")).where("i < size_1d").select("lut_id", "i", *(value[i].cast("double").alias(k) for i, k in enumerate("rgb")))


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """Lattices of one .cube file, or of all in a folder or pattern; a lattice is named by its file."""
    return parse_text(read_files(spark, path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("lut_id"), F.col("value").alias("text"))
