"""Whole jobs: extracting lattices from image pairs, routing shots, plates, and checks of existing lattices."""

from __future__ import annotations

import inspect
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import transfer
from ..functions.lattice import clamp
from ..operators import binning, clustering, fitting, lattices, numbering, routing, signatures, statistics
from ..operators.binning import MEAN_IN, SOURCE, TARGET
from ..operators.storage import kept
from ..sources import cube, images, tables

Progress = Callable[[str, float, str], None]
Cancel = Callable[[], bool]
#: Share of the whole that each stage takes, for progress bars.
STAGE_WEIGHTS = {"preprocess": 10, "sampling": 20, "solving": 50, "refinement": 10, "validation": 5, "export": 5}


class Cancelled(RuntimeError):
    """The caller's `cancel` said so, between two stages or within one."""


@contextmanager
def cancellable(spark: SparkSession, cancel: Cancel | None, every: float = 0.2) -> Iterator[None]:
    """Runs what is inside under a tag of its own; when `cancel` says so, a watcher ends the tag's jobs, those that start later too.

    `cancel` is asked from the watcher's thread, every `every` seconds. Other jobs of the session go on.
    """
    if cancel is None:
        yield
        return
    tag, over, said = f"run-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(every):
            if said.is_set() or cancel():
                said.set()
                spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as problem:
        if said.is_set() and not isinstance(problem, Cancelled):
            raise Cancelled("within a stage") from problem
        raise
    finally:
        over.set()
        watcher.join()
        spark.sparkContext.removeJobTag(tag)


def _stoppable(job: Callable) -> Callable:
    """A job with parameters `spark` and `cancel`, made cancellable."""
    signature = inspect.signature(job)

    @wraps(job)
    def run(*args, **kwargs):
        given = signature.bind(*args, **kwargs).arguments
        with cancellable(given["spark"], given.get("cancel")):
            return job(*args, **kwargs)

    return run


@dataclass(frozen=True)
class Options:
    """What a job does; the defaults are the engine's."""

    fit: fitting.FitOptions = fitting.FitOptions()
    bins: int = 64
    min_samples: int = 3
    by_frequency: bool = False
    transfer: str = "auto"
    shaper: bool | None = None
    auto_shadows: bool = True
    shadow_threshold: float | None = None
    deep_threshold: float | None = None
    refine_rounds: int = 0
    title: str = ""
    normalization: str = "none"
    balance: str = "by_bins"
    allow_mixed_transfers: bool = False
    outlier_sigma: float = 0.0
    min_pairs: int = 3


@dataclass
class Result:
    """Lattices (lut_id, ...), one row of metrics each, their samples and pair statistics, and where files went."""

    lattice: DataFrame
    metrics: DataFrame
    samples: DataFrame
    pairs: DataFrame
    output: Path | None = None
    diagnostics: dict = field(default_factory=dict)


class _Steps:
    def __init__(self, progress: Progress | None, cancel: Cancel | None):
        self.progress, self.cancel = progress, cancel

    def __call__(self, stage: str, share: float, message: str) -> None:
        if self.cancel is not None and self.cancel():
            raise Cancelled(stage)
        if self.progress is not None:
            self.progress(stage, share, message)


def image_pairs(spark: SparkSession, pairs: DataFrame) -> DataFrame:
    """Pixel pairs of rows (pair_id, source, target): images of a pair are scaled to their smaller size on each axis."""
    paths = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("source").alias("path")), F.struct(F.lit("t").alias("side"), F.col("target").alias("path")))).alias("f")).select("pair_id", "f.side", "f.path")
    files = sorted({r["path"] for r in paths.select("path").distinct().toLocalIterator()})
    for f in files:
        images.check_input(f)
    name = F.regexp_replace(F.col("image_id"), r"^file:/+", "/")
    pixels = kept(images.read_images(spark, files).withColumn("path", name).drop("image_id").join(paths, "path").withColumn("image_id", F.concat_ws("\u0001", "side", "pair_id")).drop("path"))
    sizes = pixels.groupBy("pair_id", "side").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    least = sizes.groupBy("pair_id").agg(F.min("h").alias("height"), F.min("w").alias("width"))
    odd = kept(sizes.join(least, "pair_id").where("h <> height OR w <> width").select(F.concat_ws("\u0001", "side", "pair_id").alias("image_id"), "height", "width"))
    columns = ["image_id", "y", "x", "r", "g", "b"]
    same = pixels.select(columns).join(odd, "image_id", "left_anti")
    both = same if odd.isEmpty() else same.union(lattices.resize(pixels.select(columns).join(odd, "image_id", "left_semi"), odd).select(columns))
    at = both.select(F.substring("image_id", 1, 1).alias("side"), F.substring("image_id", 3, 10_000).alias("pair_id"), *columns[1:])
    return binning.sanitize_pixels(binning.pair_pixels(at.where("side = 's'"), at.where("side = 't'")))


def shaped(pixels: DataFrame, options: Options, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pixels with their sources shaped, and (pair_id, transfer): a pair's own transfer function, else the options', "auto" meaning detection."""
    found = binning.detect_transfer(pixels).select("pair_id", F.col("transfer").alias("detected"))
    own = F.col("transfer_fn") if overrides is not None else F.lit(None).cast("string")
    joined = found.join(overrides.select("pair_id", "transfer_fn"), "pair_id", "left") if overrides is not None else found
    wanted = F.coalesce(own, F.lit(options.transfer))
    chosen = joined.select("pair_id", F.when(wanted == "auto", F.col("detected")).otherwise(wanted).alias("transfer"))
    if options.shaper is False:
        return pixels, chosen
    both = pixels.join(chosen, "pair_id")
    return both.withColumns({s: F.when(F.col("transfer") == "linear", transfer.log_shaper(F.col(s))).otherwise(F.col(s)) for s in SOURCE}).drop("transfer"), chosen


def _fit(rows: DataFrame, pairs: DataFrame, options: Options) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, dict]]:
    """(lattices, metrics, samples, info) of bins (lut_id, pair_id, ...) and pairs (lut_id, pair_id, weight, pixels), for all lattices in one job.

    A lattice has thresholds, weights, balance and rounds of its own; thresholds that the options give hold for all; `info` has a row of counts for each.
    """
    counts = rows.groupBy("lut_id", "pair_id").agg(F.count(F.lit(1)).alias("bins"))
    if low := counts.where("bins < 10").orderBy("lut_id", "pair_id").take(1):
        raise ValueError(f"fewer than 10 occupied bins in pair {low[0]['pair_id']}")
    odd = F.sum(F.when(binning.contradiction() > 0.3, 1).otherwise(0))
    info = {r["lut_id"]: {"occupied_bins": r["bins"], "contradictory_bins": r["odd"]} for r in rows.groupBy("lut_id").agg(F.count(F.lit(1)).alias("bins"), odd.alias("odd")).collect()}
    if not info:
        raise ValueError("fewer than 10 occupied bins")
    given = {k: v for k, v in (("shadow", options.shadow_threshold), ("deep", options.deep_threshold)) if v is not None}
    fit, shadows = replace(options.fit, **given), None
    automatic = options.auto_shadows and len(given) < 2
    if automatic:
        shadows = kept(statistics.shadow_thresholds(rows, ("lut_id",)).withColumns({k: F.lit(v) for k, v in given.items()}))
        rows = rows.join(shadows.select("lut_id", "shadow"), "lut_id")
        for r in shadows.select("lut_id", "adapted").collect():
            info[r["lut_id"]]["shadows_adapted"] = r["adapted"]
    over = ("lut_id", "pair_id")
    weighted = binning.sample_weights(rows, options.by_frequency, options.min_samples, F.col("shadow") if automatic else fit.shadow, over=over)
    samples = kept(binning.balanced(weighted, pairs, options.balance, ("lut_id",)).drop("shadow"))
    lattice = fitting.fit_lattice(samples, fit, shadows)
    if options.refine_rounds:
        lattice = fitting.refine(lattice, samples, fit, options.refine_rounds, shadows)
    lattice = kept(lattice)
    return lattice, kept(lattices.quality_metrics(samples, lattice, fit.size, fit.kernel)), samples, info


@dataclass
class Prepared:
    """Bins of pairs, what is known of each pair (pair_id, weight, pixels, bins, transfer), and the shaped pixels that the bins are of."""

    bins: DataFrame
    pairs: DataFrame
    pixels: DataFrame


def normalized(pixels: DataFrame, options: Options, pairs: DataFrame | None = None) -> DataFrame:
    """Pixels normalised by each pair's own mode, the column `normalization` of `pairs`, or the options' where that is null or empty."""
    if pairs is None or "normalization" not in pairs.columns:
        return statistics.normalize_pairs(pixels, options.normalization) if options.normalization != "none" else pixels
    mode = F.coalesce(F.nullif(F.lower(F.trim("normalization")), F.lit("")), F.lit(options.normalization))
    modes = kept(pairs.select("pair_id", mode.alias("mode")))
    out = None
    for m in sorted(r[0] for r in modes.select("mode").distinct().collect()):
        part = pixels.join(modes.where(F.col("mode") == m), "pair_id", "left_semi")
        part = statistics.normalize_pairs(part, m) if m != "none" else part
        out = part if out is None else out.unionByName(part)
    return pixels if out is None else out


def prepare(pixels: DataFrame, options: Options = Options(), pairs: DataFrame | None = None) -> Prepared:
    """Pixels shaped, normalised and binned; they are read for detection and, once more, for bins."""
    ready, transfers = shaped(pixels, options, pairs)
    given = normalized(ready, options, pairs)
    every = kept(binning.bin_pixels(given, options.bins, 1))
    rows = every.where(F.col("n") >= max(options.min_samples, 1))
    counts = every.groupBy("pair_id").agg(F.sum("n").alias("pixels"), F.sum(F.when(F.col("n") >= max(options.min_samples, 1), 1).otherwise(0)).alias("bins"))
    weights = pairs.select("pair_id", F.coalesce("weight", F.lit(1.0)).alias("weight")) if pairs is not None else counts.select("pair_id", F.lit(1.0).alias("weight"))
    return Prepared(rows, kept(counts.join(weights, "pair_id").join(transfers, "pair_id", "left")), ready)


@_stoppable
def fit_groups(spark: SparkSession, ready: Prepared, members: DataFrame, options: Options, outputs: dict[str, str | Path | None], progress: Progress | None = None, cancel: Cancel | None = None) -> dict[str, Result]:
    """A lattice for each lut_id of `members` (lut_id, pair_id), all fitted by the same Spark jobs from the same bins.

    Each lattice is what its pairs alone give: weights are balanced over its own pairs, pairs with mixed transfer functions are refused
    unless allowed, and with `outlier_sigma` pairs of outlying error within it are left out and it is fitted once more, the
    other lattices staying as they are. `outputs` names the files to write. Lattices and files are a few; bins and samples stay in Spark.
    """
    began, step, n, kernel = time.time(), _Steps(progress, cancel), options.fit.size, options.fit.kernel
    key = ["lut_id", "pair_id"]
    members = kept(members.select(*key).distinct())
    pairs = kept(members.join(ready.pairs, "pair_id"))
    kinds = {r["lut_id"]: sorted(r["kinds"]) for r in pairs.groupBy("lut_id").agg(F.collect_set("transfer").alias("kinds")).collect()}
    for lut, found in sorted(kinds.items()):
        if len(found) > 1 and not options.allow_mixed_transfers:
            raise ValueError(f"pairs have several transfer functions: {', '.join(found)}")
    step("solving", 0.0, "fitting")
    rows = kept(ready.bins.join(members, "pair_id"))
    lattice, metrics, samples, info = _fit(rows, pairs, options)
    dropped: dict[str, list[str]] = {}
    if options.outlier_sigma > 0:
        errors = fitting.pair_errors(samples, lattice, n, kernel, key)
        out = kept(statistics.outlier_pairs(errors, options.outlier_sigma, options.min_pairs, ("lut_id",)).where("outlier").select(*key))
        dropped = {r["lut_id"]: sorted(r["pairs"]) for r in out.groupBy("lut_id").agg(F.collect_list("pair_id").alias("pairs")).collect()}
        if dropped:
            again = kept(out.select("lut_id").distinct())
            left = lambda df: df.join(again, "lut_id", "left_semi").join(out, key, "left_anti")
            new = _fit(left(rows), left(pairs), options)
            lattice, metrics, samples = (kept(a.join(again, "lut_id", "left_anti").unionByName(b)) for a, b in zip((lattice, metrics, samples), new))
            info |= new[3]
    step("validation", 0.0, "measuring")
    stats = kept(pairs.join(fitting.pair_errors(samples, lattice, n, kernel, key), key, "left"))
    results: dict[str, Result] = {}
    for lut in sorted(info):
        mine = lambda df, lut=lut: df.where(F.col("lut_id") == lut)
        path = None
        if outputs.get(lut) is not None:
            step("export", 0.0, f"writing {lut}")
            table = None
            if kinds[lut] == ["linear"] and options.shaper is not False:
                grid = spark.range(4096).select((F.col("id") / 4095.0).alias("x"), "id").select("id", transfer.log_shaper(F.col("x")).alias("y")).withColumn("y", F.max("y").over(Window.orderBy("id"))).orderBy("id")
                table = [(r["y"],) * 3 for r in grid.collect()]
            path = cube.write_cube(mine(lattice), outputs[lut], n, title=options.title, kernel=kernel, shaper=table)
        more = {"transfers": kinds[lut], "dropped_pairs": dropped.get(lut, []), "total_time_s": time.time() - began}
        results[lut] = Result(mine(lattice), mine(metrics), mine(samples), mine(stats).drop("lut_id"), path, info[lut] | more)
    step("export", 1.0, "done")
    return results


@_stoppable
def extract(spark: SparkSession, pixels: DataFrame, options: Options = Options(), output: str | Path | None = None, pairs: DataFrame | None = None, progress: Progress | None = None, cancel: Cancel | None = None) -> Result:
    """A lattice "master" from pixel pairs (pair_id, y, x, sr..tb), of one pair or several; `pairs` (pair_id, weight, transfer_fn, normalization) says how each counts. See `fit_groups`."""
    step = _Steps(progress, cancel)
    step("preprocess", 0.0, "normalising, shaping and gathering bins")
    ready = prepare(pixels, options, pairs)
    step("sampling", 1.0, "bins gathered")
    members = ready.pairs.select(F.lit("master").alias("lut_id"), "pair_id")
    return fit_groups(spark, ready, members, options, {"master": output}, progress, cancel)["master"]


@_stoppable
def extract_pair(spark: SparkSession, source: str, target: str, output: str | Path | None = None, options: Options = Options(), progress: Progress | None = None, cancel: Cancel | None = None) -> Result:
    """A lattice from two image files."""
    rows = spark.createDataFrame([("pair", images.located(source), images.located(target))], "pair_id string, source string, target string")
    return extract(spark, image_pairs(spark, rows), options, output, progress=progress, cancel=cancel)


@_stoppable
def extract_batch(spark: SparkSession, manifest: str, output: str | Path, options: Options = Options(), cluster: str = "none", clusters: int = 2, most_clusters: int = 6, reports: str | Path | None = None, progress: Progress | None = None, cancel: Cancel | None = None) -> dict[str, Result]:
    """Lattices from a manifest of pairs: "master" over all, and one for each cluster.

    `cluster` is "none", "manual" (the manifest's labels), "fixed" (k-means of `clusters`) or "auto" (best silhouette
    up to `most_clusters`). Pixels are binned once, for signatures and for all lattices, which the same jobs fit. A cluster must not be
    called "master". With `reports`, a folder, the assignment,
    centroid and metrics reports are written there.
    """
    rows = kept(tables.read_pairs(spark, manifest).withColumn("pair_id", F.format_string("pair_%05d", "pair_index")))
    pixels = kept(image_pairs(spark, rows))
    step = _Steps(progress, cancel)
    step("preprocess", 0.0, "normalising, shaping and gathering bins")
    ready = prepare(pixels, options, rows)
    step("sampling", 1.0, "bins gathered")
    master = ready.pairs.select(F.lit("master").alias("lut_id"), "pair_id")
    if cluster == "none" and reports is None:
        return fit_groups(spark, ready, master, options, {"master": output}, progress, cancel)
    plain = options.normalization == "none" and rows.where("normalization <> 'none' AND normalization <> ''").isEmpty()
    bins = ready.bins if plain else kept(binning.bin_pixels(ready.pixels, options.bins, options.min_samples))
    marks = kept(signatures.pair_signature(bins).join(signatures.appearance_from_bins(bins), "pair_id").join(rows.select("pair_id", F.col("pair_index").cast("long").alias("id"), "cluster"), "pair_id"))
    points = clustering.standardized(marks.select("id", F.col("transform").alias("v")), "id", "v")
    if cluster == "manual":
        named = signatures.dense_ids(marks.select("id", F.coalesce("cluster", F.lit("cluster_01")).alias("label")), "label", "id")
    elif cluster == "fixed":
        named = clustering.kmeans(points, clusters)[0].select("id", "cluster_id").withColumn("label", F.format_string("cluster_%02d", F.col("cluster_id") + 1))
    else:
        named = (clustering.auto_clusters(points, most_clusters)[0] if cluster == "auto" else points.withColumn("cluster_id", F.lit(0))).select("id", "cluster_id").withColumn("label", F.format_string("cluster_%02d", F.col("cluster_id") + 1))
    assigned = kept(marks.join(named.select("id", "cluster_id", "label"), "id"))
    labels = {r["cluster_id"]: r["label"] for r in assigned.select("cluster_id", "label").distinct().collect()}
    if cluster != "none" and "master" in labels.values():
        raise ValueError('a cluster must not be called "master"')
    members, outputs = master, {"master": output}
    if cluster != "none":
        members = master.unionByName(assigned.select(F.col("label").alias("lut_id"), "pair_id"))
        outputs |= {label: tables.cluster_path(output, label) for label in labels.values()}
    results = fit_groups(spark, ready, members, options, outputs, progress, cancel)
    results = {"master": results["master"]} | {label: results[label] for label in labels.values() if label in results}
    if reports is not None:
        folder = Path(reports)
        given = rows.join(assigned.select("pair_id", "cluster_id", F.col("label").alias("cluster_label")), "pair_id", "left").join(results["master"].pairs.select("pair_id", F.col("transfer").alias("detected"), F.col("bins").alias("occupied_bins")), "pair_id", "left")
        tables.write_csv(signatures.assignment_report(given), folder / "cluster_assignments.csv")
        where = spark.createDataFrame([(k, v, str(results[v].output) if v in results else "") for k, v in labels.items()], "cluster_id int, cluster_label string, lut_path string")
        tables.write_csv(where.join(signatures.cluster_centroids(assigned), "cluster_id").orderBy("cluster_id"), folder / "cluster_centroids.csv")
        tables.write_csv(metrics_rows(spark, results), folder / "batch_metrics.csv")
    return results


def summary(result: Result) -> str:
    """One line on a result of a batch: pairs given and used, bins, the pairs that were dropped as outliers, and seconds."""
    d = result.diagnostics
    given, used = result.pairs.count(), result.samples.select("pair_id").distinct().count()
    dropped = f", outliers dropped: {', '.join(map(str, d['dropped_pairs']))}" if d["dropped_pairs"] else ""
    return f"pairs: {given}, used: {used}, bins: {d['occupied_bins']}{dropped}, {d['total_time_s']:.2f} s"


def metrics_rows(spark: SparkSession, results: dict[str, Result]) -> DataFrame:
    """The metrics report's rows, the master's first."""
    parts = []
    for label, r in results.items():
        d = r.diagnostics
        more = {"label": label, "output_path": str(r.output or ""), "num_pairs": r.pairs.count(), "num_pairs_used": r.samples.select("pair_id").distinct().count(), "occupied_bins": d["occupied_bins"], "outlier_dropped_count": len(d["dropped_pairs"]), "total_time_s": float(d["total_time_s"])}
        parts.append(r.metrics.select("mean_de2000", "median_de2000", "p95_de2000", "max_de2000", "total_variation", "coverage_pct", "oog_pct", *(F.lit(v).alias(k) for k, v in more.items())))
    rest = parts[0].limit(0)
    for p in parts[1:]:
        rest = rest.unionByName(p)
    return signatures.metrics_report(parts[0], rest)


def route_shots(spark: SparkSession, shots: str, centroids: str, output: str | Path | None = None, window: int = 1, penalty: float = 0.0, options: Options = Options()) -> DataFrame:
    """The routing report of a shot manifest against a centroid report: (shot_index, shot_id, cluster_id, cluster_label, lut_path, distance, confidence_margin, frame_count, frames)."""
    frames = kept(tables.read_shots(spark, shots))
    files = sorted({r[0] for r in frames.select("frame_path").distinct().toLocalIterator()})
    for f in files:
        images.check_input(f)
    pixels = images.read_images(spark, files).withColumn("path", F.regexp_replace("image_id", r"^file:/+", "/"))
    rows = pixels.join(frames, pixels["path"] == frames["frame_path"]).select(F.col("frame_index").cast("string").alias("pair_id"), "y", "x", *(F.col(k).alias(c) for k, c in zip("rgb", SOURCE)), *(F.col(k).alias(c) for k, c in zip("rgb", TARGET)))
    ready, _ = shaped(binning.sanitize_pixels(rows), options, frames.select(F.col("frame_index").cast("string").alias("pair_id"), "transfer_fn"))
    looks = signatures.appearance_from_pixels(ready).select(F.col("pair_id").cast("int").alias("frame_index"), "appearance").join(frames, "frame_index")
    found = signatures.shot_signatures(looks)
    ranked = numbering.numbered(found.withColumnRenamed("shot_index", "first"), ["first"], "place")
    order = kept(ranked.withColumn("shot_index", F.col("place").cast("int")).drop("place"))
    cents = kept(tables.read_centroids(spark, centroids))
    distances = kept(routing.shot_distances(order.select(F.lit("shots").alias("track"), "shot_index", F.col("appearance").alias("vec")), cents))
    chosen = routing.route(distances, window, penalty).join(order.select("shot_index", "shot_id", "frame_count"), "shot_index").join(cents.drop("vec"), "cluster_id")
    names = looks.groupBy("shot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "frame_path"))), lambda v: v["frame_path"]), ";").alias("frames"))
    label = F.coalesce("cluster_label", F.format_string("cluster_%02d", F.col("cluster_id") + 1))
    out = chosen.join(names, "shot_id").select((F.col("shot_index") + 1).alias("shot_index"), "shot_id", "cluster_id", label.alias("cluster_label"), F.coalesce("lut_path", F.lit("")).alias("lut_path"), F.format_string("%.8f", "distance").alias("distance"), F.format_string("%.8f", "margin").alias("confidence_margin"), "frame_count", "frames").orderBy("shot_index")
    if output is not None:
        tables.write_csv(out, output)
    return out


def hald_generate(spark: SparkSession, output: str | Path, level: int = 8, bits: int = 16) -> Path:
    return images.write_image(lattices.hald_identity(spark, level), output, bits)


def hald_reconstruct(spark: SparkSession, processed: str, output: str | Path, level: int = 8, size: int | None = None, title: str = "") -> Path:
    """The lattice of a processed plate, resampled to `size` if given; files hold at most 129 nodes a side."""
    n = size or level**2
    if n > cube.MAX_SIZE:
        raise ValueError(f"level {level} has {level**2} nodes a side; give a size of at most {cube.MAX_SIZE}")
    plate = images.read_images(spark, str(images.check_input(processed)))
    side = plate.agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).first()
    if (side["h"], side["w"]) != (level**3, level**3):
        raise ValueError(f"a plate of level {level} is {level**3} pixels square, not {side['w']} x {side['h']}")
    lattice = lattices.hald_readout(plate.withColumn("lut_id", F.lit("hald")), level)
    return cube.write_cube(lattices.resample(lattice, level**2, n), output, n, title=title)


def validate(spark: SparkSession, source: str, target: str, lut: str, kernel: str = "tetrahedral") -> DataFrame:
    """Metrics of an existing .cube file on an image pair's pixels, of which large pairs are sampled."""
    rows = spark.createDataFrame([("pair", images.located(source), images.located(target))], "pair_id string, source string, target string")
    pixels = image_pairs(spark, rows)
    pixels = statistics.seeded_subsample(pixels.withColumn("place", F.col("y").cast("long") * images.MAX_SIDE + F.col("x")), "place")
    files = cube.read_files(spark, lut)
    problem = cube.describe(files).first()
    if problem is None or problem["problem"]:
        raise ValueError(f"{lut}: {problem['problem'] if problem else 'not found'}")
    lattice = cube.parse_text(files).withColumn("lut_id", F.lit("given"))
    named = pixels.select(F.lit("given").alias("lut_id"), *(clamp(F.col(c)).alias(m) for c, m in zip(SOURCE, MEAN_IN)), *(F.col(c).alias(m) for c, m in zip(TARGET, binning.MEAN_OUT)))
    return lattices.quality_metrics(named, lattice, problem["size"], kernel)


def grade(de: float) -> str:
    """How a mean difference is called: invisible below 1, good below 3, fair below 5."""
    return "invisible" if de < 1 else "good" if de < 3 else "fair" if de < 5 else "poor"
