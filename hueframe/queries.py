"""The registered queries of the colour engine over the driver's tables, and their SQL.

Pixel pairs are a view of `lineitem`, shots one of `events`, feature vectors are `embeddings`. Results are rounded
to six digits, so that the order of sums doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sql as S
from .functions import colour, lattice as L, transfer as T
from .operators import binning as B, clustering as K, curves as C, fitting as X, lattices as N, routing as R, signatures as G, statistics as P
from .operators.binning import MEAN_IN, MEAN_OUT, SOURCE, TARGET
from .sources import cube

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BINS, NODES = S.BINS, S.NODES


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = "WITH " + sql.strip()
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def spread(df: DataFrame, column: str, names: list[str], *keys: str) -> DataFrame:
    """An array column as columns."""
    return df.select(*keys, *(F.col(column)[i].alias(n) for i, n in enumerate(names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, d: str) -> DataFrame:
    source = {"r": F.col("l_quantity") / 50.0, "g": F.col("l_extendedprice") / 105000.0, "b": F.col("l_discount") * 10.0}
    return table(spark, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("pair_id"),
        F.pmod(F.col("l_orderkey"), F.lit(1000)).cast("int").alias("y"),
        F.col("l_linenumber").cast("int").alias("x"),
        *(v.alias(f"s{k}") for k, v in source.items()),
        *(L.clamp(v * 1.08 + 0.02).alias(f"t{k}") for k, v in source.items()),
    )


def bins(spark: SparkSession, d: str, n: int = BINS) -> DataFrame:
    return B.bin_pixels(pixels(spark, d), n, 3)


def samples(spark: SparkSession, d: str) -> DataFrame:
    return B.sample_weights(bins(spark, d))


def pair_lattices(spark: SparkSession, d: str) -> DataFrame:
    """A lattice for each pair: mean outputs of the bins that are its nodes, the identity elsewhere."""
    have = bins(spark, d, NODES).select(F.col("pair_id").alias("lut_id"), F.col("bin_id").alias("node_id"), *MEAN_OUT)
    all_ = pixels(spark, d).select(F.col("pair_id").alias("lut_id")).distinct().select("lut_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(NODES**3 - 1).cast("long"))).alias("node_id"))
    at = L.grid_coords(F.col("node_id"), NODES)
    return all_.join(have, ["lut_id", "node_id"], "left").select("lut_id", "node_id", *(F.coalesce(F.col(o), c / float(NODES - 1)).alias(k) for o, c, k in zip(MEAN_OUT, at, "rgb")))


PB = f"{S.PX}, {S.bins()}"
PS = f"{PB}, {S.samples()}"
PL = f"{PB}, {S.LATTICE}"
IO = "ir, ig, ib, or_, og, ob"


def rs(*names: str) -> str:
    return ", ".join(S.r(n, n) for n in names)


# ---- bins, weights, filters


@query(f"{PB} SELECT pair_id, bin_id, n, {rs(*IO.split(', '), 'vr', 'vg', 'vb', 'cx', 'cy')} FROM bins")
def bin_aggregate(spark, d):
    return rounded(bins(spark, d))


@query(f"{PB} SELECT pair_id, bin_id, {S.r(f'1.0 / (1.0 + 0.5 * {S.VAR}) * least(1.0, n / 3.0)', 'confidence')}, {S.r(S.CONTRADICTION, 'contradiction')}, {S.r(S.PENALTY, 'penalty')} FROM bins")
def bin_confidence(spark, d):
    return rounded(bins(spark, d).select("pair_id", "bin_id", B.confidence().alias("confidence"), B.contradiction().alias("contradiction"), B.clip_penalty(*map(F.col, MEAN_IN)).alias("penalty")))


@query(f"{PB} SELECT pair_id, bin_id, {S.r(S.CONTRADICTION, 'contradiction')} FROM bins WHERE {S.CONTRADICTION} > 0.0003")
def contradiction_filter(spark, d):
    return rounded(B.contradictory_bins(bins(spark, d), 0.0003).select("pair_id", "bin_id", "contradiction"))


@query(f"{PS} SELECT pair_id, bin_id, n, {rs(*IO.split(', '), 'alpha')} FROM samples")
def sample_weights(spark, d):
    return rounded(B.samples_of(samples(spark, d)))


@query(f"{PB}, {S.samples(True)} SELECT pair_id, bin_id, {rs('alpha')} FROM samples")
def sample_weights_by_frequency(spark, d):
    return rounded(B.sample_weights(bins(spark, d), by_frequency=True).select("pair_id", "bin_id", "alpha"))


@query(f"{PB} SELECT DISTINCT pair_id, {S.node_of(17)} AS node_id FROM bins")
def occupied_nodes(spark, d):
    return B.occupied_nodes(bins(spark, d), 17)


@query(f"{PB} SELECT pair_id, bin_id, bin_id % 16 AS r_idx, (bin_id // 16) % 16 AS g_idx, bin_id // 256 AS b_idx, (bin_id // 256) * 256 + ((bin_id // 16) % 16) * 16 + bin_id % 16 AS again FROM bins")
def node_indices(spark, d):
    at = [c.cast("long") for c in L.grid_coords(F.col("bin_id"), BINS)]
    return bins(spark, d).select("pair_id", "bin_id", *(c.alias(f"{k}_idx") for c, k in zip(at, "rgb")), L.flat_index(*at, BINS).cast("long").alias("again"))


_BAD = "CASE WHEN y % 50 = 0 THEN CAST('NaN' AS DOUBLE) WHEN y % 50 = 1 THEN CAST('Infinity' AS DOUBLE) WHEN y % 50 = 2 THEN CAST('-Infinity' AS DOUBLE) ELSE sr - 0.5 END"


@query(f"{S.PX}, b AS (SELECT pair_id, {_BAD} AS v FROM px), c AS (SELECT pair_id, CASE WHEN isnan(v) THEN 0.0 WHEN v = CAST('Infinity' AS DOUBLE) THEN 1.0 WHEN v = CAST('-Infinity' AS DOUBLE) THEN -1.0 ELSE v END AS v FROM b) SELECT pair_id, count(*) AS n, {S.r('sum(v)', 'total')}, {S.r('min(v)', 'low')}, {S.r('max(v)', 'high')} FROM c GROUP BY 1")
def sanitize(spark, d):
    y = F.col("y") % 50
    bad = pixels(spark, d).select("pair_id", F.when(y == 0, float("nan")).when(y == 1, float("inf")).when(y == 2, float("-inf")).otherwise(F.col("sr") - 0.5).alias("v"))
    return rounded(B.sanitize_pixels(bad, ("v",)).groupBy("pair_id").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")))


@query("""o AS (SELECT o_orderstatus AS pair_id, CAST(o_orderkey // 1000 AS INT) AS y, CAST(o_orderkey % 1000 AS INT) AS x, o_totalprice / 600000.0 AS v FROM orders),
j AS (SELECT s.pair_id, s.v AS sv, t.v * 1.08 + 0.02 AS tv FROM o s JOIN o t USING (pair_id, y, x) WHERE t.x % 3 <> 0)
SELECT pair_id, count(*) AS n, round(sum(sv), 6) + 0.0 AS source, round(sum(tv), 6) + 0.0 AS target FROM j GROUP BY 1""")
def pixel_join(spark, d):
    v = F.col("o_totalprice") / 600000.0
    frame = table(spark, d, "orders").select(F.col("o_orderstatus").alias("pair_id"), F.expr("CAST(o_orderkey div 1000 AS INT)").alias("y"), (F.col("o_orderkey") % 1000).cast("int").alias("x"), *(v.alias(k) for k in "rgb"))
    target = frame.where("x % 3 <> 0").withColumns({k: F.col(k) * 1.08 + 0.02 for k in "rgb"})
    return rounded(B.pair_pixels(frame, target).groupBy("pair_id").agg(F.count("sr").alias("n"), F.sum("sr").alias("source"), F.sum("tr").alias("target")))


# ---- colour maths


_OPP = {"y_": "(ir + ig + ib) / sqrt(3.0)", "c1": "(ir - ig) / sqrt(2.0)", "c2": "(ir + ig - 2.0 * ib) / sqrt(6.0)"}


_BACK = {"r": ("y_ / sqrt(3.0) + c1 / sqrt(2.0) + c2 / sqrt(6.0)", "ir"), "g": ("y_ / sqrt(3.0) - c1 / sqrt(2.0) + c2 / sqrt(6.0)", "ig"), "b": ("y_ / sqrt(3.0) - 2.0 * c2 / sqrt(6.0)", "ib")}


@query(f"{PB}, op AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _OPP.items())} FROM bins) SELECT pair_id, bin_id, {rs(*_OPP)}, {', '.join(f'abs({v} - {c}) < 1e-9 AS back_{k}' for k, (v, c) in _BACK.items())} FROM op")
def opponent(spark, d):
    out = bins(spark, d).withColumns({k: c for c, k in zip(colour.to_opponent(*map(F.col, MEAN_IN)), _OPP)})
    same = [(F.abs(v - F.col(c)) < 1e-9).alias(f"back_{k}") for v, c, k in zip(colour.from_opponent(*map(F.col, _OPP)), MEAN_IN, "rgb")]
    return rounded(out.select("pair_id", "bin_id", *_OPP, *same))


@query(f"{PB}, {S.lab('bins', MEAN_IN, 's', 'x1')} SELECT pair_id, bin_id, {S.r('sL_', 'lightness')}, {S.r('sA_', 'a')}, {S.r('sB_', 'b')} FROM x1")
def lab(spark, d):
    return rounded(bins(spark, d).select("pair_id", "bin_id", *(c.alias(k) for c, k in zip(colour.to_lab(*map(F.col, MEAN_IN)), ("lightness", "a", "b")))))


_LMS = [f"cbrt(greatest({a} * l0 + {b} * l1 + {c} * l2, 0.0))" for a, b, c in colour.TO_LMS]


@query(f"{PB}, v AS (SELECT *, {', '.join(f'{S.linear(c)} AS l{i}' for i, c in enumerate(MEAN_IN))} FROM bins), m AS (SELECT *, {', '.join(f'{x} AS m{i}' for i, x in enumerate(_LMS))} FROM v) SELECT pair_id, bin_id, {', '.join(S.r(f'{a} * m0 + {b} * m1 + {c} * m2', k) for (a, b, c), k in zip(colour.TO_OKLAB, ('lightness', 'a', 'b')))} FROM m")
def oklab(spark, d):
    return rounded(bins(spark, d).select("pair_id", "bin_id", *(c.alias(k) for c, k in zip(colour.to_oklab(*map(F.col, MEAN_IN)), ("lightness", "a", "b")))))


@query(f"{PB}, {S.lab('bins', MEAN_IN, 's', 'q1')}, {S.lab('q1', MEAN_OUT, 't', 'q2')}, {S.de2000('q2', 's', 't', 'q3')} SELECT pair_id, bin_id, {S.r('sqrt(pow(sL_ - tL_, 2) + pow(sA_ - tA_, 2) + pow(sB_ - tB_, 2))', 'de76')}, {S.r('de', 'de2000')} FROM q3")
def delta_e(spark, d):
    out = bins(spark, d)
    for p, cols in (("p", MEAN_IN), ("q", MEAN_OUT)):
        out = out.withColumns({f"{p}{k}": v for k, v in zip("LAB", colour.to_lab(*map(F.col, cols)))})
    p, q = ("pL", "pA", "pB"), ("qL", "qA", "qB")
    out = out.withColumn("de76", colour.delta_e_76(tuple(map(F.col, p)), tuple(map(F.col, q))))
    return rounded(colour.with_delta_e_2000(out, p, q, "de2000").select("pair_id", "bin_id", "de76", "de2000"))


_X = "(ir - 0.05)"
_CURVES = {
    "logc3_lin": f"CASE WHEN {_X} > 5.367655 * 0.010591 + 0.092809 THEN (pow(10.0, ({_X} - 0.385537) / 0.247190) - 0.052272) / 5.555556 ELSE ({_X} - 0.092809) / 5.367655 END",
    "lin_logc3": f"CASE WHEN {_X} > 0.010591 THEN 0.247190 * log10(greatest(5.555556 * {_X} + 0.052272, 1e-10)) + 0.385537 ELSE 5.367655 * {_X} + 0.092809 END",
    "logc4_lin": f"CASE WHEN {_X} >= 0 THEN (pow(2.0, ({_X} - 1.0) * 7.0) - 64.0) / 2231.82630906905 ELSE {_X} * 0.0740718950408889 END",
    "lin_logc4": f"CASE WHEN {_X} >= (1.0 - 64.0) / 2231.82630906905 THEN log2(greatest(2231.82630906905 * {_X} + 64.0, 1e-10)) / 7.0 + 1.0 ELSE {_X} / 0.0740718950408889 END",
    "slog3_lin": f"CASE WHEN {_X} >= 171.2102946929 / 1023.0 THEN pow(10.0, ({_X} * 1023.0 - 420.0) / 261.5) * 0.19 - 0.01 ELSE ({_X} * 1023.0 - 95.0) * 0.01125 / (171.2102946929 - 95.0) END",
    "lin_slog3": f"CASE WHEN {_X} >= 0.01125 THEN (420.0 + log10(greatest(({_X} + 0.01) / 0.19, 1e-10)) * 261.5) / 1023.0 ELSE ({_X} * (171.2102946929 - 95.0) / 0.01125 + 95.0) / 1023.0 END",
    "vlog_lin": f"CASE WHEN {_X} < 0.181 THEN ({_X} - 0.125) / 5.6 ELSE pow(10.0, ({_X} - 0.598206) / 0.241514) - 0.00873 END",
    "lin_vlog": f"CASE WHEN {_X} < 0.01 THEN 5.6 * {_X} + 0.125 ELSE 0.241514 * log10(greatest({_X} + 0.00873, 1e-10)) + 0.598206 END",
    "shaped": f"{S.clamp(f'(log2(greatest({_X}, 1e-10) / 0.18) + 10.0) / 20.0')}",
    "unshaped": "0.18 * pow(2.0, ir * 20.0 - 10.0)",
}


@query(f"{PB} SELECT pair_id, bin_id, {', '.join(S.r(v, k) for k, v in _CURVES.items())} FROM bins")
def transfer_curves(spark, d):
    x = F.col("ir") - 0.05
    named = {"logc3": "log_c3", "logc4": "log_c4", "slog3": "slog3", "vlog": "vlog"}
    cols = {n: f(x) for k, v in named.items() for n, f in zip((f"{k}_lin", f"lin_{k}"), T.curves(v))}
    return rounded(bins(spark, d).select("pair_id", "bin_id", *(v.alias(k) for k, v in cols.items()), T.log_shaper(x).alias("shaped"), T.log_shaper_inverse(F.col("ir")).alias("unshaped")))


_DETECT = "v AS (SELECT pair_id, sr * (CASE WHEN pair_id LIKE 'N%' THEN 4.0 ELSE 1.0 END) AS sr, sg, sb FROM px), t AS (SELECT pair_id, CASE WHEN max(greatest(sr, sg, sb)) > 2.0 THEN 'linear' ELSE 'unknown' END AS transfer FROM v GROUP BY 1)"


def _detected(spark, d):
    return B.detect_transfer(pixels(spark, d).withColumn("sr", F.col("sr") * F.when(F.col("pair_id").startswith("N"), 4.0).otherwise(1.0)))


@query(f"{S.PX}, {_DETECT} SELECT pair_id, transfer FROM t")
def detect_transfer(spark, d):
    return _detected(spark, d).select("pair_id", "transfer")


@query(f"{S.PX}, {_DETECT} SELECT string_agg(DISTINCT transfer, ',' ORDER BY transfer) AS transfers, count(DISTINCT transfer) > 1 AS mixed FROM t")
def mixed_transfers(spark, d):
    return _detected(spark, d).agg(F.array_join(F.sort_array(F.collect_set("transfer")), ",").alias("transfers"), (F.countDistinct("transfer") > 1).alias("mixed"))


@query(f"""{PB}, g AS (SELECT p.pair_id AS curve, i.range AS i, {S.clamp('(log2(greatest(i.range / 63.0, 1e-10) / 0.18) + 10.0) / 20.0')} AS y FROM (SELECT DISTINCT pair_id FROM px) p CROSS JOIN range(64) i)
SELECT curve, CAST(i AS INT) AS i, round(max(y) OVER (PARTITION BY curve ORDER BY i), 6) + 0.0 AS y FROM g""")
def shaper_table(spark, d):
    return rounded(C.shaper_table(pixels(spark, d).select(F.col("pair_id").alias("curve")), T.log_shaper, 64).select("curve", "i", "y"))


# ---- lattices


def _applied(kernel):
    def run(spark, d):
        rows = bins(spark, d).select(F.col("pair_id").alias("lut_id"), "bin_id", *MEAN_IN)
        return rounded(N.apply_lattice(rows, pair_lattices(spark, d), NODES, kernel, MEAN_IN, on=("lut_id",)).select(F.col("lut_id").alias("pair_id"), "bin_id", "pr", "pg", "pb"))

    return run


for _kernel in L.KERNELS:
    query(f"{PL}, {S.applied(_kernel)} SELECT pair_id, bin_id, {rs('pr', 'pg', 'pb')} FROM out", f"apply_lattice_{_kernel}")(_applied(_kernel))


_STEP = " + ".join(f"coalesce(abs({c} - lag({c}) OVER (PARTITION BY lut_id, {rest} ORDER BY {axis})), 0.0)" for c in "rgb" for axis, rest in (("i", "j, k"), ("j", "i, k"), ("k", "i, j")))
_OUTSIDE = " + ".join(f"(CASE WHEN {c} < 0 OR {c} > 1 THEN 1 ELSE 0 END)" for c in "rgb")


@query(f"{PL}, s AS (SELECT lut_id, {_STEP} AS s FROM lattice) SELECT lut_id, {S.r(f'sum(s) / {3.0 * NODES**3}', 'total_variation')} FROM s GROUP BY 1")
def lattice_variation(spark, d):
    return rounded(N.total_variation(pair_lattices(spark, d), NODES))


_WIDE = "wide AS (SELECT lut_id, node_id, i, j, k, r * 1.2 - 0.1 AS r, g, b * 2.2 - 0.7 AS b FROM lattice)"


def _wide(spark, d):
    return pair_lattices(spark, d).withColumns({"r": F.col("r") * 1.2 - 0.1, "b": F.col("b") * 2.2 - 0.7})


@query(f"{PL}, {_WIDE} SELECT lut_id, {S.r(f'sum({_OUTSIDE}) / (3.0 * count(*)) * 100.0', 'oog_pct')} FROM wide GROUP BY 1")
def lattice_out_of_gamut(spark, d):
    return rounded(N.out_of_gamut(_wide(spark, d)))


@query(f"{PL}, {_WIDE} SELECT lut_id, {', '.join(S.r(f'{f}({c})', f'{n}_{c}') for c in 'rgb' for n, f in (('min', 'min'), ('max', 'max'), ('mean', 'avg')))} FROM (SELECT lut_id, {', '.join(f'{S.clamp(c, str(-0.5), str(1.5))} AS {c}' for c in 'rgb')} FROM wide) GROUP BY 1")
def lattice_clip_stats(spark, d):
    return rounded(N.lattice_stats(N.clip_lattice(_wide(spark, d))))


@query(f"{PL}, g AS (SELECT lut_id, {', '.join(f'{c} - lag({c}) OVER (PARTITION BY lut_id ORDER BY node_id) AS d{c}' for c in 'rgb')} FROM lattice WHERE i = j AND j = k) SELECT lut_id, CAST(sum(CASE WHEN dr < 0 OR dg < 0 OR db < 0 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM g GROUP BY 1")
def neutral_monotonicity(spark, d):
    return N.neutral_monotonicity(pair_lattices(spark, d), NODES)


def _laplacian_sql(connectivity: int) -> str:
    far = {6: 1, 18: 2, 26: 3}[connectivity]
    offs = ", ".join(f"({a}, {b}, {c}, CAST({w!r} AS DOUBLE))" for a, b, c, w in N.offsets(connectivity))
    assert far
    return f"{PL}, o(di, dj, dk, w) AS (VALUES {offs}) SELECT a.lut_id, a.node_id, {', '.join(S.r(f'sum(o.w * (a.{c} - n.{c}))', f'l{c}') for c in 'rgb')} FROM lattice a CROSS JOIN o JOIN lattice n ON n.lut_id = a.lut_id AND n.i = a.i + o.di AND n.j = a.j + o.dj AND n.k = a.k + o.dk GROUP BY 1, 2"


for _c in (6, 18, 26):
    query(_laplacian_sql(_c), f"laplacian_{_c}")(lambda spark, d, c=_c: rounded(N.laplacian_of(pair_lattices(spark, d), NODES, c)))


@query(f"""{PB}, occ AS (SELECT DISTINCT pair_id AS lut_id, {S.node_of(NODES)} AS node_id FROM bins),
n AS (SELECT range AS node_id FROM range({NODES**3})),
dd AS (SELECT o.lut_id, n.node_id, sqrt(min(pow(n.node_id % {NODES} - o.node_id % {NODES}, 2) + pow((n.node_id // {NODES}) % {NODES} - (o.node_id // {NODES}) % {NODES}, 2) + pow(n.node_id // {NODES**2} - o.node_id // {NODES**2}, 2))) AS distance FROM occ o CROSS JOIN n GROUP BY 1, 2)
SELECT lut_id, node_id, {rs('distance')}, {S.r('1.0 - exp(-distance / 3.0)', 'strength')} FROM dd""")
def distance_to_data(spark, d):
    occ = B.occupied_nodes(bins(spark, d), NODES).withColumnRenamed("pair_id", "lut_id")
    return rounded(N.distance_to_data(occ, NODES).withColumn("strength", L.prior_strength(F.col("distance"))))


@query(SQL["distance_to_data"].removeprefix("WITH ").split("\nSELECT lut_id, node_id,")[0] + " SELECT lut_id, CASE WHEN distance < 2 THEN 'covered' WHEN distance <= 5 THEN 'sparse' ELSE 'empty' END AS bucket, count(*) AS nodes FROM dd GROUP BY 1, 2")
def coverage(spark, d):
    occ = B.occupied_nodes(bins(spark, d), NODES).withColumnRenamed("pair_id", "lut_id")
    return N.coverage(N.distance_to_data(occ, NODES))


_T = S.clamp(f"({S.luma('ir', 'ig', 'ib')} - 0.08) / 0.17")
_MID = "(ir + ig + ib) / 3.0"


@query(f"{PB} SELECT pair_id, bin_id, {S.r(f'25.0 * (1.0 - {_T} * {_T} * (3.0 - 2.0 * {_T})) + {_T} * {_T} * (3.0 - 2.0 * {_T})', 'shadow')}, {S.r(f'1.0 + 3.0 * exp(-(pow(ir - {_MID}, 2) + pow(ig - {_MID}, 2) + pow(ib - {_MID}, 2)) / (2.0 * 0.12 * 0.12))', 'neutral')} FROM bins")
def boosts(spark, d):
    m = tuple(map(F.col, MEAN_IN))
    return rounded(bins(spark, d).select("pair_id", "bin_id", L.shadow_boost(L.luma(*m), 0.25, 0.08).alias("shadow"), L.neutral_boost(*m).alias("neutral")))


@query(f"""{PL}, {S.applied('trilinear', 'grid')} SELECT pair_id AS lut_id, bin_id AS node_id, {S.r('pr', 'r')}, {S.r('pg', 'g')}, {S.r('pb', 'b')} FROM out""".replace("cell AS", "grid AS (SELECT p.lut_id AS pair_id, n.range AS bin_id, (n.range % 13) / 12.0 AS ir, ((n.range // 13) % 13) / 12.0 AS ig, (n.range // 169) / 12.0 AS ib FROM (SELECT DISTINCT lut_id FROM lattice) p CROSS JOIN range(2197) n), cell AS", 1))
def lattice_resample(spark, d):
    return rounded(N.resample(pair_lattices(spark, d), NODES, 13))


@query(f"{PL} SELECT lut_id, CAST(k * 3 + j // 3 AS INT) AS y, CAST(i + (j % 3) * 9 AS INT) AS x, {rs('r', 'g', 'b')} FROM lattice")
def hald_plate(spark, d):
    y, x = N.hald_place(F.col("node_id"), 3)
    return rounded(pair_lattices(spark, d).select("lut_id", y.alias("y"), x.alias("x"), "r", "g", "b"))


@query(f"{PL} SELECT lut_id, node_id, {rs('r', 'g', 'b')} FROM lattice")
def hald_readout(spark, d):
    y, x = N.hald_place(F.col("node_id"), 3)
    return rounded(N.hald_readout(pair_lattices(spark, d).select("lut_id", y.alias("y"), x.alias("x"), "r", "g", "b"), 3))


@query(f"{PL} SELECT lut_id, node_id, printf('%.6f %.6f %.6f', r, g, b) AS line FROM lattice")
def cube_lines(spark, d):
    return cube.data_lines(pair_lattices(spark, d))


@query(f"{PL} SELECT lut_id, node_id, {rs('r', 'g', 'b')} FROM lattice")
def cube_round_trip(spark, d):
    return rounded(cube.parse_text(cube.text_of(pair_lattices(spark, d), NODES)).select("lut_id", "node_id", "r", "g", "b"))


_WORST = [f"worst_{c}" for c in ("pr", "pg", "pb", *MEAN_IN)]
_QM = f"""{PL}, {S.applied('tetrahedral')}, {S.lab('out', ('pr', 'pg', 'pb'), 's', 'z1')}, {S.lab('z1', MEAN_OUT, 't', 'z2')}, {S.de2000('z2', 's', 't', 'z3')},
tv AS (SELECT lut_id, sum(s) / {3.0 * NODES**3} AS total_variation FROM (SELECT lut_id, {_STEP} AS s FROM lattice) GROUP BY 1), og_ AS (SELECT lut_id, sum({_OUTSIDE}) / (3.0 * count(*)) * 100.0 AS oog_pct FROM lattice GROUP BY 1),
gd AS (SELECT lut_id, {', '.join(f'{c} - lag({c}) OVER (PARTITION BY lut_id ORDER BY node_id) AS d{c}' for c in 'rgb')} FROM lattice WHERE i = j AND j = k), mo AS (SELECT lut_id, CAST(sum(CASE WHEN dr < 0 OR dg < 0 OR db < 0 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM gd GROUP BY 1),
qm AS (SELECT pair_id AS lut_id, avg(de) AS mean_de2000, median(de) AS median_de2000, quantile_cont(de, 0.95) AS p95_de2000, max(de) AS max_de2000, count(DISTINCT {S.node_of(NODES)}) AS occupied_nodes, {', '.join(f'arg_max({w[6:]}, de) AS {w}' for w in _WORST)} FROM z3 GROUP BY 1)
SELECT lut_id, {rs('mean_de2000', 'median_de2000', 'p95_de2000', 'max_de2000')}, occupied_nodes, {S.r(f'occupied_nodes / {float(NODES**3)} * 100.0', 'coverage_pct')}, {rs('total_variation', 'oog_pct', *_WORST)}, violations FROM qm JOIN tv USING (lut_id) JOIN og_ USING (lut_id) JOIN mo USING (lut_id)"""


@query(_QM)
def quality_metrics(spark, d):
    rows = bins(spark, d).withColumnRenamed("pair_id", "lut_id")
    found = N.quality_metrics(rows, pair_lattices(spark, d), NODES)
    worst = [F.col(f"worst_predicted.{c}").alias(f"worst_{c}") for c in ("pr", "pg", "pb")] + [F.col(f"worst_source.{k}").alias(f"worst_{c}") for k, c in zip("rgb", MEAN_IN)]
    return rounded(found.select("lut_id", "mean_de2000", "median_de2000", "p95_de2000", "max_de2000", "occupied_nodes", "coverage_pct", "total_variation", "oog_pct", "violations", *worst))


def _blur_sql(sigma: float, times: int) -> list[list[float]]:
    """Weights of each place of a line for each other after `times` Gaussian passes, edges mirrored."""
    reach = int(4.0 * sigma + 0.5)
    raw = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    m = np.zeros((NODES, NODES))
    for i in range(NODES):
        at = (i + np.arange(-reach, reach + 1)) % (2 * NODES)
        np.add.at(m[i], np.minimum(at, 2 * NODES - 1 - at), raw / raw.sum())
    return np.linalg.matrix_power(m, times).tolist()


def _blurred_sql(name: str, sigma: float, times: int) -> str:
    rows = ", ".join(f"({i}, {j}, CAST({w!r} AS DOUBLE))" for i, line in enumerate(_blur_sql(sigma, times)) for j, w in enumerate(line))
    out, last = f"{name}w(o, s, w) AS (VALUES {rows})", "lattice"
    for axis in "ijk":
        at = ", ".join(f"{name}w.o AS {a}" if a == axis else a for a in "ijk")
        out += f", {name}{axis} AS (SELECT lut_id, {at}, {', '.join(f'sum(w * {c}) AS {c}' for c in 'rgb')} FROM {last} JOIN {name}w ON {axis} = {name}w.s GROUP BY 1, 2, 3, 4)"
        last = f"{name}{axis}"
    return out


_step = lambda x: f"({S.clamp(x)} * {S.clamp(x)} * (3.0 - 2.0 * {S.clamp(x)}))"
_NODE_LUM = "(0.2126 * l.i + 0.7152 * l.j + 0.0722 * l.k) / 8.0"


@query(f"""{PL}, {_blurred_sql('far', 3.0, 2)}, {_blurred_sql('mid', 1.5, 1)}, st AS (SELECT l.*, {_step(f'{_NODE_LUM} / 0.08')} AS t, {_step(f'({_NODE_LUM} - 0.08) / 0.17')} AS s FROM lattice l)
SELECT l.lut_id, l.node_id, {', '.join(S.r(f'(f.{c} * (1.0 - t) + m.{c} * t) * (1.0 - s) + l.{c} * s', c) for c in 'rgb')} FROM st l JOIN fark f USING (lut_id, i, j, k) JOIN midk m USING (lut_id, i, j, k)""")
def lattice_shadow_smoothing(spark, d):
    return rounded(N.smooth_shadows(pair_lattices(spark, d), NODES))


@query(f"""img AS (SELECT event_type AS image_id, CAST(day(ts) - 1 AS INT) AS y, CAST(hour(ts) AS INT) AS x, avg(value) AS v FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3),
sz AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM img GROUP BY 1),
g AS (SELECT image_id, h, w, yy.range AS oy, xx.range AS ox, yy.range * (h - 1) / 19.0 AS sy, xx.range * (w - 1) / 11.0 AS sx FROM sz CROSS JOIN range(20) yy CROSS JOIN range(12) xx),
f AS (SELECT *, greatest(least(floor(sy), h - 2), 0) AS y0, greatest(least(floor(sx), w - 2), 0) AS x0 FROM g),
c AS (SELECT image_id, oy, ox, y0 + a.range AS y, x0 + b.range AS x, (CASE WHEN a.range = 1 THEN sy - y0 ELSE 1.0 - (sy - y0) END) * (CASE WHEN b.range = 1 THEN sx - x0 ELSE 1.0 - (sx - x0) END) AS wt FROM f CROSS JOIN range(2) a CROSS JOIN range(2) b)
SELECT c.image_id, CAST(oy AS INT) AS y, CAST(ox AS INT) AS x, {S.r('sum(wt * v)', 'r')}, {S.r('sum(wt * v * 0.5)', 'g')}, {S.r('sum(wt * (1.0 - v))', 'b')} FROM c JOIN img ON img.image_id = c.image_id AND img.y = c.y AND img.x = c.x WHERE wt > 0 GROUP BY 1, 2, 3""")
def image_resize(spark, d):
    v = F.avg("value").alias("r")
    img = table(spark, d, "events").where("value IS NOT NULL").groupBy(F.col("event_type").alias("image_id"), (F.dayofmonth("ts") - 1).alias("y"), F.hour("ts").alias("x")).agg(v).withColumns({"g": F.col("r") * 0.5, "b": 1.0 - F.col("r")})
    sizes = img.select("image_id").distinct().select("image_id", F.lit(20).alias("height"), F.lit(12).alias("width"))
    return rounded(N.resize(img, sizes).select("image_id", "y", "x", "r", "g", "b"))


# ---- percentiles, normalisation, outliers


def _affine_sql(mode: str) -> str:
    q = lambda c, p: f"quantile_cont({c}, {p})"
    gain = lambda s, t: f"({q(t, 0.95)} - {q(t, 0.05)}) / greatest({q(s, 0.95)} - {q(s, 0.05)}, 1e-8)"
    pairs = {"r": ("sr", "tr"), "g": ("sg", "tg"), "b": ("sb", "tb")} if mode == "rgb_affine" else {k: (S.luma("sr", "sg", "sb"), S.luma("tr", "tg", "tb")) for k in "rgb"}
    parts = ", ".join(f"{S.r(gain(s, t), f'gain_{k}')}, {S.r(f'{q(t, 0.05)} - {gain(s, t)} * {q(s, 0.05)}', f'bias_{k}')}" for k, (s, t) in pairs.items())
    return f"{S.PX} SELECT pair_id, {parts} FROM px GROUP BY 1"


for _m in ("luma_affine", "rgb_affine"):
    query(_affine_sql(_m), f"normalization_{_m}")(lambda spark, d, m=_m: rounded(P.pair_normalization(pixels(spark, d), m)))


@query("n0 AS (" + _affine_sql("rgb_affine").replace("round(", "(").replace(", 6) + 0.0", ")").replace(f"{S.PX} SELECT", f"WITH {S.PX} SELECT") + f"), {S.PX} SELECT pair_id, count(*) AS n, {', '.join(S.r(f'avg(s{k} * gain_{k} + bias_{k})', f'mean_{k}') for k in 'rgb')} FROM px JOIN n0 USING (pair_id) GROUP BY 1")
def normalized_means(spark, d):
    out = P.normalize_pairs(pixels(spark, d), "rgb_affine")
    return rounded(out.groupBy("pair_id").agg(F.count("sr").alias("n"), *(F.avg(s).alias(f"mean_{k}") for s, k in zip(SOURCE, "rgb"))))


@query(f"""{PB}, v AS (SELECT pair_id, {S.luma('ir * 0.7', 'ig * 0.7', 'ib * 0.7')} AS l FROM bins), q AS (SELECT pair_id, quantile_cont(l, 0.1) AS p1, quantile_cont(l, 0.3) AS p3, quantile_cont(l, 0.99) AS p9, avg(l) AS m FROM v GROUP BY 1),
a AS (SELECT *, greatest(0.08, p1) AS lo, least(greatest(0.25, p3), 0.6) AS hi0, p9 < 0.9 AND m > 0.05 AND m < 0.6 AS adapted FROM q), b AS (SELECT *, CASE WHEN hi0 <= lo + 0.02 THEN least(0.6, lo + 0.02) ELSE hi0 END AS hi FROM a)
SELECT pair_id, round(CASE WHEN adapted THEN hi ELSE 0.25 END, 6) + 0.0 AS shadow, round(CASE WHEN adapted THEN least(lo, hi - 0.02) ELSE 0.08 END, 6) + 0.0 AS deep, adapted FROM b""")
def shadow_thresholds(spark, d):
    return rounded(P.shadow_thresholds(bins(spark, d).withColumns({c: F.col(c) * 0.7 for c in MEAN_IN})))


_MSE = f"{PS}, e AS (SELECT pair_id, sum(alpha * (pow(or_ - ir, 2) + pow(og - ig, 2) + pow(ob - ib, 2))) / sum(alpha) * (CASE WHEN pair_id = 'NO' THEN 50.0 ELSE 1.0 END) AS mse FROM samples GROUP BY 1)"


def _pair_mse(spark, d):
    rows = samples(spark, d).withColumn("lut_id", F.lit("identity"))
    found = X.pair_errors(rows, N.identity_lattice(spark, NODES), NODES)
    return found.withColumn("mse", F.col("mse") * F.when(F.col("pair_id") == "NO", 50.0).otherwise(1.0))


@query(f"{_MSE} SELECT pair_id, {rs('mse')} FROM e")
def pair_mse(spark, d):
    return rounded(_pair_mse(spark, d))


@query(f"""{_MSE}, m AS (SELECT median(mse) AS med FROM e), s AS (SELECT median(abs(mse - med)) AS mad FROM e, m), b AS (SELECT pair_id, mse > med + 3.0 * 1.4826 * mad AS beyond FROM e, m, s)
SELECT pair_id, beyond AND (SELECT count(*) FROM b) >= 3 AND (SELECT count(*) FROM b WHERE NOT beyond) >= 3 AS outlier FROM b""")
def outlier_pairs(spark, d):
    return P.outlier_pairs(_pair_mse(spark, d)).select("pair_id", "outlier")


@query("""v AS (SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), m AS (SELECT dim, median(CAST(value AS DOUBLE)) AS med FROM v GROUP BY 1),
s AS (SELECT dim, any_value(med) AS med, 1.4826 * median(abs(CAST(value AS DOUBLE) - med)) AS sc FROM v JOIN m USING (dim) GROUP BY 1)
SELECT vec_id, CAST(dim AS INT) AS dim, round((value - med) / (CASE WHEN sc < 1e-8 THEN 1.0 ELSE sc END), 6) + 0.0 AS z FROM v JOIN s USING (dim)""")
def robust_standardize(spark, d):
    return rounded(P.robust_standardize(table(spark, d, "embeddings")).select("vec_id", "dim", "z"))


@query("o AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS h FROM orders) SELECT o_orderkey FROM o ORDER BY h, o_orderkey LIMIT (SELECT CASE WHEN count(*) <= 10000 THEN count(*) ELSE greatest(CAST(floor(count(*) * 0.1) AS BIGINT), 1000) END FROM orders)")
def seeded_subsample(spark, d):
    return P.seeded_subsample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


# ---- signatures, balance, reports

_SIG = [f"shift_{c}" for c in "rgb"] + [f"abs_{c}" for c in "rgb"] + [f"dev_{c}" for c in "rgb"] + [f"slope_{c}" for c in "rgb"] + ["lum", "lum_dev", "dlum", "dlum_dev", "sat", "dsat"]
_APP = [f"mean_{c}" for c in "rgb"] + [f"dev_{c}" for c in "rgb"] + ["lum", "sat"]
_wm = lambda x: f"(sum(n * ({x})) / sum(n))"
_sat = lambda a, b, c: f"(greatest({a}, {b}, {c}) - least({a}, {b}, {c}))"
_V = f"v AS (SELECT *, {S.luma(*MEAN_IN)} AS l, {S.luma(*MEAN_OUT)} - {S.luma(*MEAN_IN)} AS dl, {_sat(*MEAN_IN)} AS s, {_sat(*MEAN_OUT)} - {_sat(*MEAN_IN)} AS ds FROM bins), mu AS (SELECT pair_id AS pid, {', '.join(f'{_wm(x)} AS m_{x}' for x in (*MEAN_IN, *MEAN_OUT, 'l', 'dl'))} FROM v GROUP BY 1), vm AS (SELECT * FROM v JOIN mu ON pid = pair_id)"
_IOC = list(zip(MEAN_IN, MEAN_OUT, "rgb"))
_SIGSQL = {
    **{f"shift_{c}": f"{_wm(o)} - {_wm(i)}" for i, o, c in _IOC},
    **{f"abs_{c}": _wm(f"abs({o} - {i})") for i, o, c in _IOC},
    **{f"dev_{c}": f"sqrt({_wm(f'pow({o} - {i} - (m_{o} - m_{i}), 2)')})" for i, o, c in _IOC},
    **{f"slope_{c}": f"{_wm(f'({i} - m_{i}) * ({o} - m_{o})')} / greatest({_wm(f'pow({i} - m_{i}, 2)')}, 1e-8)" for i, o, c in _IOC},
    "lum": _wm("l"), "lum_dev": f"sqrt({_wm('pow(l - m_l, 2)')})", "dlum": _wm("dl"), "dlum_dev": f"sqrt({_wm('pow(dl - m_dl, 2)')})", "sat": _wm("s"), "dsat": _wm("ds"),
}


@query(f"{PB}, {_V} SELECT pair_id, {', '.join(S.r(_SIGSQL[k], k) for k in _SIG)} FROM vm GROUP BY 1")
def pair_signature(spark, d):
    return rounded(spread(G.pair_signature(bins(spark, d)), "transform", _SIG, "pair_id"))


_APPSQL = {**{f"mean_{c}": _wm(i) for i, _, c in _IOC}, **{f"dev_{c}": f"sqrt({_wm(f'pow({i} - m_{i}, 2)')})" for i, _, c in _IOC}, "lum": _wm("l"), "sat": _wm("s")}


@query(f"{PB}, {_V} SELECT pair_id, {', '.join(S.r(_APPSQL[k], k) for k in _APP)} FROM vm GROUP BY 1")
def appearance_from_bins(spark, d):
    return rounded(spread(G.appearance_from_bins(bins(spark, d)), "appearance", _APP, "pair_id"))


_PIX = {**{f"mean_{c}": f"avg(s{c})" for c in "rgb"}, **{f"dev_{c}": f"stddev_pop(s{c})" for c in "rgb"}, "lum": f"avg({S.luma(*SOURCE)})", "sat": f"avg({_sat(*SOURCE)})"}


@query(f"{S.PX} SELECT pair_id, {', '.join(S.r(_PIX[k], k) for k in _APP)} FROM px GROUP BY 1")
def appearance_from_pixels(spark, d):
    return rounded(spread(G.appearance_from_pixels(pixels(spark, d)), "appearance", _APP, "pair_id"))


@query(f"{S.PX}, f AS (SELECT substr(pair_id, 1, 1) AS shot_id, y % 40 AS frame_index, {', '.join(f'{_PIX[k]} AS {k}' for k in _APP)} FROM px GROUP BY 1, 2) SELECT shot_id, min(frame_index) AS shot_index, count(*) AS frame_count, {', '.join(S.r(f'avg({k})', k) for k in _APP)} FROM f GROUP BY 1")
def shot_signatures(spark, d):
    frames = pixels(spark, d).withColumn("f", F.struct(F.substring("pair_id", 1, 1).alias("shot_id"), (F.col("y") % 40).alias("frame_index")))
    out = G.shot_signatures(G.appearance_from_pixels(frames, "f").select("f.shot_id", "f.frame_index", "appearance"))
    return rounded(spread(out, "appearance", _APP, "shot_id", "shot_index", "frame_count"))


def _balance_sql(mode: str) -> str:
    goal = {"equal": "weight", "by_bins": "weight * nb", "by_pixels": "weight * pixels"}[mode]
    return f"""{PS}, pp AS (SELECT pair_id, count(*) AS pixels, CASE WHEN pair_id = 'AF' THEN 3.0 ELSE 1.0 END AS weight FROM px GROUP BY 1),
s AS (SELECT pair_id, sum(alpha) AS total, count(*) AS nb, any_value({goal.replace('nb', '0') if mode != 'by_bins' else 'weight'}) AS g0 FROM samples JOIN pp USING (pair_id) GROUP BY 1),
q AS (SELECT pair_id, total, {'g0 * nb' if mode == 'by_bins' else 'g0'} AS goal, nb FROM s)
SELECT pair_id, bin_id, {S.r('alpha * goal / total * (SELECT sum(nb) FROM q) / (SELECT sum(goal) FROM q)', 'alpha')}, {S.r('goal / (SELECT sum(goal) FROM q)', 'pair_share')} FROM samples JOIN q USING (pair_id)"""


def _balance(mode):
    def run(spark, d):
        weight = F.when(F.col("pair_id") == "AF", 3.0).otherwise(1.0)
        pairs = pixels(spark, d).groupBy("pair_id").agg(F.count(F.lit(1)).alias("pixels")).withColumn("weight", weight)
        return rounded(B.balanced(samples(spark, d), pairs, mode).select("pair_id", "bin_id", "alpha", "pair_share"))

    return run


for _m in ("equal", "by_bins", "by_pixels"):
    query(_balance_sql(_m), f"pair_balance_{_m}")(_balance(_m))


def _customers(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("cluster_id"), F.col("c_acctbal").alias("weight"), "c_mktsegment")
    labels = table(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").cast("int").alias("cluster_id"), F.col("n_name").alias("label"))
    return G.labelled(c, labels)


@query("""j AS (SELECT c.*, n.n_name FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey % 3 <> 0)
SELECT CAST(c_custkey AS VARCHAR) AS pair_index, c_mktsegment AS source, '' AS target, printf('%.6f', c_acctbal) AS weight, CAST(c_nationkey AS VARCHAR) AS cluster_id, coalesce(n_name, printf('cluster_%02d', CAST(c_nationkey AS INT) + 1)) AS cluster_label, '' AS transfer_fn_override, '' AS normalization, 'unknown' AS detected_transfer_function, '' AS occupied_bins FROM j""")
def assignment_report(spark, d):
    none = F.lit(None).cast("string")
    rows = _customers(spark, d).select((F.col("c_custkey") - 1).alias("pair_index"), F.col("c_mktsegment").alias("source"), none.alias("target"), "weight", "cluster_id", "cluster_label", none.alias("transfer_fn"), none.alias("normalization"), F.lit("unknown").alias("detected"), none.alias("occupied_bins"))
    return G.assignment_report(rows)


@query(f"""{PB}, e AS (SELECT pair_id, avg(abs(or_ - ir)) AS m, max(abs(or_ - ir)) AS x, count(*) AS nb FROM bins GROUP BY 1), a AS (SELECT 'master' AS label, avg(m) AS m, max(x) AS x, sum(nb) AS nb FROM e UNION ALL SELECT pair_id, m, x, nb FROM e)
SELECT label, printf('%.4f', round(m, 6)) AS mean_de2000, printf('%.4f', round(x, 6)) AS max_de2000, CAST(CAST(nb AS BIGINT) AS VARCHAR) AS occupied_bins, '' AS total_time_s FROM a""")
def metrics_report(spark, d):
    shift = F.abs(F.col("or_") - F.col("ir"))
    e = bins(spark, d).groupBy("pair_id").agg(F.avg(shift).alias("m"), F.max(shift).alias("x"), F.count(F.lit(1)).alias("occupied_bins"))
    named = lambda df: df.select("label", F.round("m", 6).alias("mean_de2000"), F.round("x", 6).alias("max_de2000"), "occupied_bins")
    master = named(e.agg(F.avg("m").alias("m"), F.max("x").alias("x"), F.sum("occupied_bins").alias("occupied_bins")).withColumn("label", F.lit("master")))
    return G.metrics_report(master, named(e.withColumnRenamed("pair_id", "label"))).select("label", "mean_de2000", "max_de2000", "occupied_bins", "total_time_s")


@query("f AS (SELECT c_mktsegment AS label, min(c_custkey) AS first FROM customer GROUP BY 1), k AS (SELECT label, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS cluster_id FROM f) SELECT k.cluster_id, label, count(*) AS members, min(c_custkey) AS first, max(c_custkey) AS last FROM customer JOIN k ON label = c_mktsegment GROUP BY 1, 2")
def cluster_members(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"))
    return G.dense_ids(rows, "label", "c_custkey").groupBy("cluster_id", "label").agg(F.count("c_custkey").alias("members"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


@query(f"SELECT label AS cluster_id, count(*) AS count, {', '.join(S.r(f'avg(CAST(embedding[{i + 1}] AS DOUBLE))', f't_sig_{i:02d}') for i in range(16))}, {', '.join(S.r(f'avg(CAST(embedding[{i + 19}] AS DOUBLE))', f'a_sig_{i:02d}') for i in range(8))} FROM embeddings GROUP BY 1")
def cluster_centroids(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))
    return rounded(G.cluster_centroids(e.select(F.col("label").alias("cluster_id"), F.slice("embedding", 1, 18).alias("transform"), F.slice("embedding", 19, 8).alias("appearance"))))


SQL["cluster_centroids"] = SQL["cluster_centroids"].removeprefix("WITH ")


@query(f"{_MSE}, m AS (SELECT median(mse) AS med FROM e), s AS (SELECT median(abs(mse - med)) AS mad FROM e, m), k AS (SELECT pair_id FROM e, m, s WHERE mse <= med + 3.0 * 1.4826 * mad) SELECT b.pair_id, count(*) AS bins, {S.r('avg(e.mse)', 'mse')} FROM bins b LEFT JOIN (SELECT * FROM e JOIN k USING (pair_id)) e USING (pair_id) GROUP BY 1")
def final_pair_stats(spark, d):
    errors = _pair_mse(spark, d)
    dropped = P.outlier_pairs(errors).where("outlier")
    kept = errors.join(dropped, "pair_id", "left_anti")
    return rounded(bins(spark, d).join(kept, "pair_id", "left").groupBy("pair_id").agg(F.count(F.lit(1)).alias("bins"), F.avg("mse").alias("mse")))


# ---- curves and fits


_CURVE = """kn AS (SELECT CAST(o_orderkey % 12 AS INT) AS knot, avg(o_totalprice) / 300000.0 + any_value(o_orderkey % 12) * 0.002 AS y, count(*) AS w FROM orders GROUP BY 1)"""


def _knots(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 12).cast("int").alias("knot"), "o_totalprice")
    return o.groupBy("knot").agg((F.avg("o_totalprice") / 300000.0).alias("y"), F.count(F.lit(1)).alias("w")).select(F.lit("all").alias("channel"), "knot", (F.col("y") + F.col("knot") * 0.002).alias("y"), "w")


_ISO = f"""{_CURVE}, sp AS (SELECT a.knot AS j, b.knot AS k, sum(c.y * c.w) / sum(c.w) AS m FROM kn a JOIN kn b ON a.knot <= b.knot JOIN kn c ON c.knot BETWEEN a.knot AND b.knot GROUP BY 1, 2),
lo AS (SELECT i.knot, sp.j, min(sp.m) AS m FROM kn i JOIN sp ON sp.j <= i.knot AND sp.k >= i.knot GROUP BY 1, 2), iso AS (SELECT knot, max(m) AS y FROM lo GROUP BY 1)"""


@query(f"{_ISO} SELECT 'all' AS channel, knot, {rs('y')} FROM iso")
def isotonic(spark, d):
    return rounded(C.isotonic(_knots(spark, d)))


_SEG = f"{_ISO}, seg AS (SELECT knot / 11.0 AS x0, lead(knot / 11.0) OVER (ORDER BY knot) AS x1, y AS y0, lead(y) OVER (ORDER BY knot) AS y1 FROM iso)"


@query(f"{S.PX}, {S.bins()}, {_SEG} SELECT pair_id, bin_id, {S.r('CASE WHEN ir <= 0 THEN (SELECT y FROM iso WHERE knot = 0) WHEN ir >= 1 THEN (SELECT y FROM iso WHERE knot = 11) ELSE y0 + (y1 - y0) * (ir - x0) / (x1 - x0) END', 'value')} FROM bins JOIN seg ON ir >= x0 AND ir < x1 OR ir >= 1 AND x0 = 0 OR ir <= 0 AND x0 = 0")
def interpolate_curve(spark, d):
    curve = C.curve_arrays(C.isotonic(_knots(spark, d)).select("channel", (F.col("knot") / 11.0).alias("x"), "y"))
    rows = bins(spark, d).select("pair_id", "bin_id", "ir", F.lit("all").alias("channel"))
    return rounded(C.evaluate(rows, curve, "ir", "value").select("pair_id", "bin_id", "value"))


_ONES = ("ir", "ig", "ib", "1.0")


@query(f"{PS} SELECT pair_id, {', '.join(S.r(f'sum(alpha * {_ONES[i]} * {_ONES[j]})', f'a{i}{j}') for i in range(4) for j in range(i, 4))}, {', '.join(S.r(f'sum(alpha * {_ONES[i]} * og)', f'b{i}') for i in range(4))} FROM samples GROUP BY 1")
def affine_normal_equations(spark, d):
    return rounded(C.affine_sums(samples(spark, d), tuple(map(F.col, MEAN_IN)), F.col("og"), F.col("alpha"), ("pair_id",)))


@query(f"{PS}, e AS (SELECT pair_id, sum(alpha * (pow(or_ - (ir * 1.08 + 0.02), 2) + pow(og - (ig * 1.08 + 0.02), 2) + pow(ob - (ib * 1.08 + 0.02), 2))) / sum(alpha) AS p, sum(alpha * (pow(or_ - ir, 2) + pow(og - ig, 2) + pow(ob - ib, 2))) / sum(alpha) AS q FROM samples GROUP BY 1) SELECT pair_id, {S.r('p / greatest(q, 1e-8)', 'ratio')}, p / greatest(q, 1e-8) < 0.95 AS passes FROM e")
def quality_gate(spark, d):
    return rounded(C.quality_gate(samples(spark, d), tuple(F.col(c) * 1.08 + 0.02 for c in MEAN_IN), ("pair_id",)))


@query(f"""{PS}, long AS ({' UNION ALL '.join(f'SELECT {c} AS channel, alpha, round({i}, 9) AS z, {o} AS y FROM samples' for c, (i, o) in enumerate(zip(MEAN_IN, MEAN_OUT)))}),
ends AS (SELECT channel, min(z) AS low, greatest(max(z) - min(z), 1e-8) / 64 AS step FROM long GROUP BY 1),
mk AS (SELECT channel, CAST(least(floor((z - low) / step), 63) AS INT) AS knot, sum(alpha * y) / sum(alpha) AS y, sum(alpha) AS w FROM long JOIN ends USING (channel) GROUP BY 1, 2 HAVING sum(alpha) > 0),
gr AS (SELECT e.channel, CAST(range AS INT) AS knot, low + (range + 0.5) * step AS x, mk.y, mk.w FROM ends e CROSS JOIN range(64) LEFT JOIN mk ON mk.channel = e.channel AND mk.knot = range),
nb AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN knot END) OVER (PARTITION BY channel ORDER BY knot) AS p, min(CASE WHEN y IS NOT NULL THEN knot END) OVER (PARTITION BY channel ORDER BY knot DESC) AS q FROM gr),
fl AS (SELECT n.channel, n.knot, n.x, coalesce(n.w, 1e-8) AS w, CASE WHEN n.y IS NOT NULL THEN n.y WHEN p IS NULL THEN b.y WHEN q IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (n.x - a.x) / (b.x - a.x) END AS y
  FROM nb n LEFT JOIN gr a ON a.channel = n.channel AND a.knot = n.p LEFT JOIN gr b ON b.channel = n.channel AND b.knot = n.q),
sp AS (SELECT a.channel, a.knot AS j, b.knot AS k, sum(c.y * c.w) / sum(c.w) AS m FROM fl a JOIN fl b ON a.channel = b.channel AND a.knot <= b.knot JOIN fl c ON c.channel = a.channel AND c.knot BETWEEN a.knot AND b.knot GROUP BY 1, 2, 3),
lo AS (SELECT i.channel, i.knot, sp.j, min(sp.m) AS m FROM fl i JOIN sp ON sp.channel = i.channel AND sp.j <= i.knot AND sp.k >= i.knot GROUP BY 1, 2, 3), iso AS (SELECT channel, knot, max(m) AS y FROM lo GROUP BY 1, 2)
SELECT channel, knot, {S.r('fl.x', 'x')}, {S.r('iso.y', 'y')} FROM iso JOIN fl USING (channel, knot)""")
def baseline_curves(spark, d):
    """Inputs rounded to nine digits, so that no mean at the very edge of a knot goes by the order of sums."""
    return rounded(C.monotone_knots(samples(spark, d), tuple(F.round(c, 9) for c in MEAN_IN), 64))

def _eliminated(m: list[list[str]]) -> str:
    """CTEs e0 to e4: Gauss-Jordan steps over the columns m00 to m34 of `ne`."""
    out, size = [f"e0 AS (SELECT channel, {', '.join(f'{v} AS m{i}{j}' for i, row in enumerate(m) for j, v in enumerate(row))} FROM ne)"], len(m)
    for k in range(size):
        cells = (f"m{k}{j} / m{k}{k} AS m{k}{j}" if i == k else f"m{i}{j} - m{i}{k} * m{k}{j} / m{k}{k} AS m{i}{j}" for i in range(size) for j in range(size + 1))
        out.append(f"e{k + 1} AS (SELECT channel, {', '.join(cells)} FROM e{k})")
    return ", ".join(out)


_NE = ", ".join(f"sum(alpha * {_ONES[i]} * {_ONES[j]}) AS a{i}{j}" for i in range(4) for j in range(i, 4)) + ", " + ", ".join(f"sum(alpha * {_ONES[i]} * y) AS b{i}" for i in range(4))


@query(f"""{PS}, ne AS (SELECT channel, {_NE} FROM ({' UNION ALL '.join(f'SELECT {c} AS channel, alpha, ir, ig, ib, {o} AS y FROM samples' for c, o in enumerate(MEAN_OUT))}) GROUP BY 1),
{_eliminated([[*(f'a{min(i, j)}{max(i, j)}' for j in range(4)), f'b{i}'] for i in range(4)])} SELECT CAST(channel AS BIGINT) AS channel, {S.r('m04', 'from_r')}, {S.r('m14', 'from_g')}, {S.r('m24', 'from_b')}, {S.r('m34', 'bias')} FROM e4""")
def affine_fit(spark, d):
    fit = C.fit_affine(samples(spark, d), tuple(map(F.col, MEAN_OUT))).select(F.posexplode(F.sequence(F.lit(0), F.lit(8), F.lit(4))).alias("channel", "k"), "theta")
    return rounded(fit.select(F.col("channel").cast("long").alias("channel"), *(F.col("theta")[F.col("k") + i].alias(c) for i, c in enumerate(("from_r", "from_g", "from_b", "bias")))))


def _curve(spark, d):
    return C.curve_arrays(C.isotonic(_knots(spark, d)).select("channel", (F.col("knot") / 11.0).alias("x"), "y"))


@query(f"{_ISO}, s AS (SELECT knot / 11.0 AS v, y, y - lag(y) OVER (ORDER BY knot) AS rise FROM iso) SELECT 'all' AS channel, {S.r('y', 'x')}, {S.r('v', 'y')} FROM s WHERE rise IS NULL OR rise > 1e-12")
def inverse_curve(spark, d):
    out = C.inverted(_curve(spark, d)).select("channel", F.explode(F.arrays_zip("xs", "ys")).alias("k"))
    return rounded(out.select("channel", F.col("k.xs").alias("x"), F.col("k.ys").alias("y")))


_MATRIX, _BIAS = np.array([[0.8, 0.1, 0.1], [0.05, 0.9, 0.05], [0.0, 0.1, 0.9]]), np.array([0.01, 0.0, -0.02])
_AFFINE = [" + ".join(f"{float(v)} * {c}" for v, c in zip(row, ("i / 8.0", "j / 8.0", "k / 8.0"))) + f" + {float(b)}" for row, b in zip(_MATRIX, _BIAS)]


@query(f"""{_SEG}, nd AS (SELECT range AS node_id, range % 9 AS i, (range // 9) % 9 AS j, range // 81 AS k FROM range(729)),
z AS ({' UNION ALL '.join(f"SELECT node_id, '{c}' AS c, {e} AS z FROM nd" for c, e in zip('rgb', _AFFINE))}),
v AS (SELECT node_id, c, CASE WHEN z <= 0 THEN (SELECT y FROM iso WHERE knot = 0) WHEN z >= 1 THEN (SELECT y FROM iso WHERE knot = 11) ELSE y0 + (y1 - y0) * (z - x0) / (x1 - x0) END AS y FROM z JOIN seg ON z >= x0 AND z < x1 OR z >= 1 AND x0 = 0 OR z < 0 AND x0 = 0)
SELECT 'baseline' AS lut_id, node_id, {', '.join(S.r(f"max(CASE WHEN c = '{c}' THEN y END)", c) for c in 'rgb')} FROM v GROUP BY 2""")
def baseline_lattice(spark, d):
    """A 3 x 3 matrix, then one curve of 12 knots that is learnt from orders, at the nodes of a lattice."""
    theta = F.array(*(F.lit(float(v)) for row, b in zip(_MATRIX, _BIAS) for v in (*row, b)))
    base = _curve(spark, d).select(F.lit("baseline").alias("lut_id"), theta.alias("theta"), F.array("xs", "xs", "xs").alias("xs"), F.array("ys", "ys", "ys").alias("ys"))
    return rounded(C.baseline_lattice(base, NODES))


@query(f"{PS} SELECT pair_id, bin_id, {', '.join(S.r(f'sqrt(alpha) * {o}', f'rhs_{c}') for c, o in zip('rgb', MEAN_OUT))} FROM samples")
def data_rhs(spark, d):
    return rounded(X.data_rhs(samples(spark, d)))


@query(_laplacian_sql(18).split(" SELECT a.lut_id")[0] + f""", lp AS (SELECT a.lut_id, a.node_id, {', '.join(f'sum(o.w * (a.{c} - n.{c})) AS l{c}' for c in 'rgb')} FROM lattice a CROSS JOIN o JOIN lattice n ON n.lut_id = a.lut_id AND n.i = a.i + o.di AND n.j = a.j + o.dj AND n.k = a.k + o.dk GROUP BY 1, 2)
SELECT l.lut_id, l.node_id, {', '.join(S.r(f"sqrt(0.1 * (25.0 - 24.0 * {_step(f'({_NODE_LUM} - 0.08) / 0.17')})) * l{c}", f'l{c}') for c in 'rgb')} FROM lattice l JOIN lp USING (lut_id, node_id)""")
def smoothness_terms(spark, d):
    """The smoothness rows of a fit, times each pair's lattice."""
    lattice = pair_lattices(spark, d)
    rows = X.smoothness_rows(N.identity_lattice(spark, NODES), NODES, 0.1, 0.25, 0.08, 18)
    out = lattice.withColumnRenamed("node_id", "col").join(rows, "col").groupBy("lut_id", F.col("row").alias("node_id"))
    return rounded(out.agg(*(F.sum(F.col("val") * F.col(c)).alias(f"l{c}") for c in "rgb")))


@query(SQL["distance_to_data"].removeprefix("WITH ").split("\nSELECT lut_id, node_id,")[0] + f" SELECT lut_id, node_id, {S.r('sqrt(0.01 * (1.0 - exp(-distance / 3.0)))', 'val')}, {', '.join(S.r(f'sqrt(0.01 * (1.0 - exp(-distance / 3.0))) * ({at}) / 8.0', f'rhs_{c}') for c, at in zip('rgb', ('node_id % 9', '(node_id // 9) % 9', 'node_id // 81')))} FROM dd")
def prior_terms(spark, d):
    occ = B.occupied_nodes(bins(spark, d), NODES).withColumnRenamed("pair_id", "lut_id")
    return rounded(X.prior_rows(N.distance_to_data(occ, NODES), NODES, 0.01))


@query(f"{PS}, {S.applied('tetrahedral', 'samples').split(', pred AS')[0].replace(chr(10) + 'pred AS', '')}, m AS (SELECT pair_id, bin_id, sqrt(alpha) AS root FROM samples) SELECT c.pair_id, c.bin_id, node_id AS node, round(sum(root * w), 6) + 0.0 AS val FROM corner c JOIN m USING (pair_id, bin_id) GROUP BY 1, 2, 3")
def data_matrix(spark, d):
    """The entries of the data matrix: each sample's row has all corners of its tetrahedron, as the reference stores them, those of weight zero too."""
    rows = X.data_rows(samples(spark, d), NODES, "tetrahedral")
    return rounded(rows.groupBy("pair_id", "bin_id", F.col("node").cast("long").alias("node")).agg(F.sum("val").alias("val")))


def _letters(spark, d):
    """Samples of three lattices: pairs by the first letter of their names."""
    return samples(spark, d).withColumn("lut_id", F.substring("pair_id", 1, 1))


@query()
def lattice_fit(spark, d):
    """A fit with the engine's defaults: 33 nodes a side, tetrahedral, robust rounds."""
    return rounded(X.fit_lattice(_letters(spark, d)))


@query(f"RECURSIVE {PS}, {S.fit_parts()}, {S.fit_round(0)} {S.fit_result(0)}")
def lattice_fit_l2(spark, d):
    return rounded(X.fit_lattice(_letters(spark, d), X.FitOptions(size=3, loss="l2")))


@query(f"RECURSIVE {PS}, {S.fit_parts()}, {S.fit_round(0)}, {S.fit_round(1, delta=0.01)} {S.fit_result(1)}")
def lattice_fit_robust(spark, d):
    return rounded(X.fit_lattice(_letters(spark, d), X.FitOptions(size=3, delta=0.01, rounds=1)))


@query(f"RECURSIVE {PS}, {S.fit_parts()}, {S.fit_round(0)}, {S.fit_refined()}, {S.fit_round(1, smoothness=0.8, source='refined')}, {S.fit_chosen()} {S.fit_result(2)}")
def lattice_refine(spark, d):
    rows, options = _letters(spark, d), X.FitOptions(size=3, loss="l2")
    return rounded(X.refine(X.fit_lattice(rows, options), rows, options, rounds=1))


_MIXED = "mixed AS (SELECT * REPLACE (0.8 * or_ + 0.2 * og * ob AS or_, 0.8 * og + 0.2 * or_ * ob AS og, 0.8 * ob + 0.2 * or_ * og AS ob) FROM samples)"


def _mixed(spark, d):
    """Samples of three lattices whose channels depend on each other: without that, discounts lie on the edges of knots."""
    r, g, b = (F.col(c) for c in MEAN_OUT)
    return _letters(spark, d).withColumns({"or_": 0.8 * r + 0.2 * g * b, "og": 0.8 * g + 0.2 * r * b, "ob": 0.8 * b + 0.2 * r * g})


@query(f"{PS}, {_MIXED}, {S.baselines('mixed')} SELECT lut AS lut_id, CAST(ch AS INT) AS channel, knot, {rs('x', 'y')} FROM knots")
def baseline_fit(spark, d):
    """Baselines of three lattices fitted together: their curves' knots, whose places follow from the affine maps."""
    found = C.fit_baseline(_mixed(spark, d)).select("lut_id", F.posexplode(F.arrays_zip("xs", "ys")).alias("channel", "k"))
    return rounded(found.select("lut_id", "channel", F.posexplode(F.arrays_zip(F.col("k.xs").alias("x"), F.col("k.ys").alias("y"))).alias("knot", "p")).select("lut_id", "channel", "knot", "p.x", "p.y"))


@query(f"RECURSIVE {PS}, {_MIXED}, {S.baselines('mixed')}, {S.fit_parts()}, {S.on_baseline()}, {S.fit_round(0, source='chb', nodes='fxb')} {S.fit_on_baseline(0)}")
def baseline_residual_fit(spark, d):
    """Three lattices over baselines of their own."""
    return rounded(X.fit_lattice(_mixed(spark, d), X.FitOptions(size=3, loss="l2", prior_model="baseline_residual")))


@query(f"RECURSIVE {PS}, {_MIXED}, {S.baselines('mixed')}, {S.fit_parts()}, {S.fit_parts(2, '2', 0.2)}, {S.multigrid()} {S.fit_on_baseline(1)}")
def multigrid_fit(spark, d):
    """Three lattices over baselines of their own, from two nodes a side to three."""
    return rounded(X.fit_lattice(_mixed(spark, d), X.FitOptions(size=3, loss="l2", prior_model="baseline_multigrid_residual", coarse=2)))


# ---- routing


def _shots(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL")
    stats = [(f("value") / 500.0).alias(n) for n, f in (("m", F.avg), ("lo", F.min), ("hi", F.max))]
    # One row a day before days are ranked.
    days = e.groupBy(F.col("event_type").alias("track"), F.to_date("ts").alias("day")).agg(*stats)
    days = days.withColumn("shot_index", F.row_number().over(Window.partitionBy("track").orderBy("day")) - 1)
    vec = F.array("m", "lo", "hi").alias("vec")
    cents = e.groupBy("event_type").agg(*stats).select((F.row_number().over(Window.orderBy("event_type")) - 1).alias("cluster_id"), vec)
    return R.shot_distances(days.select("track", "shot_index", vec), cents)


@query(f"{S.DISTANCES} SELECT track, shot_index, cluster_id, {rs('distance')} FROM dist")
def shot_distances(spark, d):
    return rounded(_shots(spark, d))


def _average_sql(window: int) -> str:
    pad = window // 2
    w = "(PARTITION BY track, cluster_id ORDER BY shot_index"
    total = " + ".join(f"CASE WHEN p + ({o}) < 1 THEN fv WHEN p + ({o}) > n THEN lv ELSE {'distance' if not o else f'lag(distance, {-o})' if o < 0 else f'lead(distance, {o})'} {'' if not o else f'OVER {w})'} END" for o in range(-pad, pad + 1))
    return f"""{S.DISTANCES}, ma0 AS (SELECT *, row_number() OVER {w}) AS p, count(*) OVER (PARTITION BY track, cluster_id) AS n, first_value(distance) OVER {w}) AS fv, last_value(distance) OVER {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lv FROM dist),
ma AS (SELECT track, shot_index, cluster_id, ({total}) / {window}.0 AS distance FROM ma0)"""


for _w in (3, 5):
    query(f"{_average_sql(_w)} SELECT track, shot_index, cluster_id, {rs('distance')} FROM ma", f"moving_average_{_w}")(lambda spark, d, w=_w: rounded(R.moving_average(_shots(spark, d), w)))

_NEAR = "near AS (SELECT track, shot_index, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY track, shot_index ORDER BY distance, cluster_id) AS k FROM {0}) WHERE k = 1)"


@query(f"{S.DISTANCES}, {_NEAR.format('dist')}, mg AS (SELECT track, shot_index, (list(distance ORDER BY distance))[2] - min(distance) AS margin FROM dist GROUP BY 1, 2) SELECT n.track, n.shot_index, n.cluster_id, {S.r('d.distance', 'distance')}, {S.r('mg.margin', 'margin')} FROM near n JOIN dist d USING (track, shot_index, cluster_id) JOIN mg USING (track, shot_index)")
def route_shots(spark, d):
    return rounded(R.route(_shots(spark, d)))


@query(f"{_average_sql(3)}, {_NEAR.format('ma')}, ch AS (SELECT track, cluster_id <> lag(cluster_id) OVER (PARTITION BY track ORDER BY shot_index) AS c FROM near) SELECT track, CAST(sum(CASE WHEN c THEN 1 ELSE 0 END) AS BIGINT) AS switches FROM ch GROUP BY 1")
def cluster_switches(spark, d):
    return R.switches(R.route(_shots(spark, d), window=3))


_K = range(5)
_STEPSQL = ", ".join(f"d.d{c} + least({', '.join(f'v.c{b}' + ('' if b == c else ' + 0.25') for b in _K)})" for c in _K)


@query(f"""RECURSIVE {S.DISTANCES}, wide AS (SELECT track, shot_index, {', '.join(f'max(CASE WHEN cluster_id = {c} THEN distance END) AS d{c}' for c in _K)} FROM dist GROUP BY 1, 2),
vit AS (SELECT track, shot_index AS t, {', '.join(f'd{c} AS c{c}' for c in _K)} FROM wide WHERE shot_index = 0 UNION ALL SELECT v.track, v.t + 1, {_STEPSQL} FROM vit v JOIN wide d ON d.track = v.track AND d.shot_index = v.t + 1)
SELECT track, round(least(c0, c1, c2, c3, c4), 6) + 0.0 AS cost FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t DESC) AS k FROM vit) WHERE k = 1""")
def cheapest_path_cost(spark, d):
    return rounded(R.cheapest_path(_shots(spark, d), 0.25).groupBy("track").agg(F.max("cost").alias("cost")))


_from = lambda c: f"list_sort([{', '.join(f"{{'cost': v.c{b}{'' if b == c else ' + 0.25'}, 'from': {b}}}" for b in _K)}])[1]"
_pick = lambda c: f"CASE f{c}['from'] {' '.join(f'WHEN {b} THEN p{b}' for b in _K)} END"


@query(f"""RECURSIVE {_average_sql(3)}, wide AS (SELECT track, shot_index, {', '.join(f'max(CASE WHEN cluster_id = {c} THEN distance END) AS d{c}' for c in _K)} FROM ma GROUP BY 1, 2),
vit AS (SELECT track, shot_index AS t, {', '.join(f'd{c} AS c{c}, [{c}] AS p{c}' for c in _K)} FROM wide WHERE shot_index = 0
  UNION ALL SELECT track, t, {', '.join(f"f{c}['cost'] + d{c} AS c{c}, list_append({_pick(c)}, {c}) AS p{c}" for c in _K)} FROM (SELECT v.track, v.t + 1 AS t, {', '.join(f'd.d{c}, v.p{c}, {_from(c)} AS f{c}' for c in _K)} FROM vit v JOIN wide d ON d.track = v.track AND d.shot_index = v.t + 1)),
fin AS (SELECT track, list_sort([{', '.join(f"{{'cost': c{c}, 'path': p{c}}}" for c in _K)}])[1]['path'] AS path FROM vit QUALIFY row_number() OVER (PARTITION BY track ORDER BY t DESC) = 1),
ch AS (SELECT track, CAST(generate_subscripts(path, 1) - 1 AS INT) AS shot_index, unnest(path) AS cluster_id FROM fin),
mg AS (SELECT track, shot_index, (list(distance ORDER BY distance))[2] - min(distance) AS margin FROM dist GROUP BY 1, 2)
SELECT track, shot_index, cluster_id, {S.r('distance', 'distance')}, {S.r('margin', 'margin')} FROM ch JOIN dist USING (track, shot_index, cluster_id) JOIN mg USING (track, shot_index)""")
def cheapest_path(spark, d):
    return rounded(R.route(_shots(spark, d), window=3, penalty=0.25))


# ---- clustering


@query("""p AS (SELECT a.vec_id AS id, a.label AS c, b.label AS o, avg(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS m FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT id, c, coalesce(max(CASE WHEN c = o THEN m END), 0.0) AS a, min(CASE WHEN c <> o THEN m END) AS b FROM p GROUP BY 1, 2) SELECT id, c AS cluster_id, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b, round((b - a) / greatest(a, b, 1e-12), 6) + 0.0 AS s FROM s""")
def silhouettes(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), F.col("label").alias("cluster_id"))
    return rounded(K.silhouettes(points))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


def _lloyd_sql(rounds: int) -> str:
    mean = lambda src, key: f"SELECT {key} AS c, list(v ORDER BY dim) AS m FROM (SELECT {key}, dim, avg(v) AS v FROM (SELECT {key}, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {src}) GROUP BY 1, 2) GROUP BY 1"
    out = "pt AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label % 3 AS g FROM embeddings), m0 AS (" + mean("pt", "g") + ")"
    for k in range(rounds + 1):
        out += f", as{k} AS (SELECT id, any_value(x) AS x, min({{'d': pow(list_distance(x, m), 2), 'c': CAST(c AS INT)}}) AS b FROM pt CROSS JOIN m{k} GROUP BY 1), g{k} AS (SELECT id, x, b['c'] AS g, b['d'] AS d FROM as{k}), m{k + 1} AS ({mean(f'g{k}', 'g')})"
    return f"{out} SELECT id, g AS cluster_id, {S.r('d', 'd')} FROM g{rounds}"


@query(_lloyd_sql(4))
def lloyd(spark, d):
    """Four rounds from the means of three given groups."""
    points = _vectors(spark, d)
    start = K.means(points.withColumn("cluster_id", F.col("label") % 3))
    return rounded(K.lloyd(points.select("id", "x"), [start[i] for i in sorted(start)], 4)[0].select("id", "cluster_id", "d"))


@query()
def kmeans(spark, d):
    points = K.standardized(table(spark, d, "embeddings"), "vec_id", "embedding")
    found, _ = K.kmeans(points, 3)
    return rounded(found.select("id", "cluster_id", "d"))


_GROUPS = """v0 AS (SELECT vec_id AS id, label % 3 AS g, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings),
md AS (SELECT median(a) AS ma, median(b) AS mb, median(c) AS mc FROM v0), sc AS (SELECT 1.4826 * median(abs(a - ma)) AS sa, 1.4826 * median(abs(b - mb)) AS sb, 1.4826 * median(abs(c - mc)) AS sc FROM v0, md),
v AS (SELECT id, g, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c FROM v0, md, sc),
p AS (SELECT x.id, x.g, y.g AS o, avg(sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) + CASE WHEN x.g = y.g THEN 0.0 WHEN x.g = 2 OR y.g = 2 THEN 10000.0 ELSE 20000.0 END)) AS m FROM v x JOIN v y ON x.id <> y.id GROUP BY 1, 2, 3),
s AS (SELECT id, g, coalesce(max(CASE WHEN g = o THEN m END), 0.0) AS w, min(CASE WHEN g <> o THEN m END) AS b FROM p GROUP BY 1, 2), t AS (SELECT avg((b - w) / greatest(b, w, 1e-12)) AS score FROM s)"""


@query(f"{_GROUPS} SELECT id, CAST(min(id) OVER (PARTITION BY g) AS BIGINT) AS first_id, 3 AS k, {S.r('score', 'silhouette')} FROM v, t")
def auto_clusters(spark, d):
    """The number of clusters and the clusters of vectors that lie in three groups, named by their smallest id."""
    e = table(spark, d, "embeddings")
    group = F.col("label") % 3
    far = [F.when(group == g, 100.0).otherwise(0.0) for g in (0, 1)]
    points = K.standardized(e.select("vec_id", F.concat(F.slice("embedding", 1, 3).cast("array<double>"), F.array(*far)).alias("x")), "vec_id", "x")
    found, k, score = K.auto_clusters(points, 4, 4)
    firsts = found.groupBy("cluster_id").agg(F.min("id").alias("first_id"))
    return rounded(found.join(firsts, "cluster_id").select("id", "first_id", F.lit(k).alias("k"), F.lit(score).alias("silhouette")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Pixels to bins to weighted samples, through a lattice, to each pair's error."""
    return pair_mse(spark, d)
