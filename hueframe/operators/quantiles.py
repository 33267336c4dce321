"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept

#: Cells into which a zone of values is cut, and rows up to which it is put in order instead.
PARTS, ZONE_ROWS = 4096, 100_000
#: Groups that a task aggregates at once before it sorts (Spark's threshold), and values that they may hold: some 400 MB.
GROUPS_AT_ONCE, HELD = 128, 4_000_000
_INF = float("inf")


def _same(a: DataFrame, b: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Join on keys, nulls equal; `b` gives its other columns, which `a` doesn't have."""
    named = b.withColumnsRenamed({k: f"{k}_" for k in keys})
    on = list(more)
    on += [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return a.join(named, on).drop(*(f"{k}_" for k in keys))


def _measured(v: Column, suffix: str = "") -> list[Column]:
    finite = F.when(F.abs(v) < _INF, v)
    parts = {"n": F.count(v), "lo": F.min(v), "hi": F.max(v), "flo": F.min(finite), "fhi": F.max(finite)}
    return [c.alias(k + suffix) for k, c in parts.items()]


def quantiles(rows: DataFrame, by: Sequence[str], wanted: dict[str, tuple[Column, Sequence[float]]], held: int = HELD, most: int = ZONE_ROWS) -> DataFrame:
    """(by..., name...): for each group an array of exact quantiles of each wanted column, interpolated linearly.

    `wanted` names (column, shares). Rows are counted first, with map-side sums over the keys alone. If the largest groups
    together hold no more than `held` values, `percentile` takes them in one pass. Else the values' ranges are measured and, while a wanted rank lies in a zone of
    more than `most` rows of different values, such zones are cut in PARTS cells, whose rows are counted, and the cell that
    holds the rank is the next zone. Only a zone's distinct values are put in order at last, so that no task
    holds a group, however large. `rows` is read once for each of these passes. Each ends in a table of a row for a
    group and rank; the driver sees one number of each. Nulls are left out, null groups are groups, NaN is the
    largest value. A group without values has nulls; an empty table gives no rows, or one of nulls without `by`.
    """
    group = [f"_g{i}" for i in range(len(by))]
    keys = [*group, "_k"]
    columns = [c.cast("double") for c, _ in wanted.values()]
    named = [F.col(b).alias(g) for b, g in zip(by, group)]
    if len(columns) == 1:
        long = rows.select(*named, F.lit(0).alias("_k"), columns[0].alias("v"))
    else:
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("_k"), c.alias("v")) for i, c in enumerate(columns))))
        long = rows.select(*named, each.alias("p")).select(*group, "p._k", "p.v")
    # At most so many values does a task hold at once that takes the largest groups; only keys are read for it.
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).limit(GROUPS_AT_ONCE)
    largest = counts.agg(F.sum("n")).first()[0] or 0
    empty = {name: F.array(*[F.lit(None).cast("double")] * len(ps)) for name, (_, ps) in wanted.items()}
    if largest * len(columns) <= held:
        arrays = [F.coalesce(F.percentile(c, F.array(*(F.lit(float(p)) for p in ps))), empty[name]).alias(name) for c, (name, (_, ps)) in zip(columns, wanted.items())]
        return rows.groupBy(*by).agg(*arrays)
    each = rows.select(*named, *(c.alias(f"v{i}") for i, c in enumerate(columns))).groupBy(*group).agg(*(F.struct(F.lit(i).alias("_k"), *_measured(F.col(f"v{i}"))).alias(f"r{i}") for i in range(len(columns))))
    ranges = kept(each.select(*group, F.explode(F.array(*(f"r{i}" for i in range(len(columns))))).alias("r")).select(*group, "r.*"))
    shares = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(j).alias("s"), F.lit(float(p)).alias("p")) for i, (_, ps) in enumerate(wanted.values()) for j, p in enumerate(ps)))
    targets = ranges.where("n > 0").withColumn("o", F.explode(F.filter(shares, lambda o: o["k"] == F.col("_k")))).withColumn("at", F.col("o.p") * (F.col("n") - 1))
    targets = targets.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    targets = targets.select(*keys, "o.s", (F.col("at") - F.floor("at")).alias("f"), "rank", "n", "lo", "hi", "flo", "fhi", F.lit(1).alias("z"))
    zone = [*keys, "z"]

    def narrowed(targets: DataFrame, cell: Column, cuts: bool = True) -> DataFrame:
        """Each rank's cell as its zone, the rank counted from there; `z` numbers a group's zones."""
        zones = targets.select(*zone, "lo", "hi", "flo", "fhi").distinct()
        inside = _same(long, zones, keys, F.col("v").between(F.col("lo"), F.col("hi")))
        cells = inside.groupBy(*zone, cell.alias("cell")).agg(*(_measured(F.col("v"), "2") if cuts else [F.count("v").alias("n2")]))
        if not cuts:
            cells = cells.withColumns({f"{k}2": F.col("cell") for k in ("lo", "hi", "flo", "fhi")})
        before = F.sum("n2").over(Window.partitionBy(*zone).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.withColumn("before", F.coalesce(before, F.lit(0))).drop("cell")
        there = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n2"))
        found = _same(targets, cells, zone, there)
        found = found.select(*keys, "s", "f", (F.col("rank") - F.col("before")).alias("rank"), *(F.col(f"{k}2").alias(k) for k in ("n", "lo", "hi", "flo", "fhi")))
        return kept(found.withColumn("z", F.dense_rank().over(Window.partitionBy(*keys).orderBy("lo"))))

    # Halves keep the width finite; values that aren't finite have cells of their own.
    width = (F.col("fhi") * 0.5 - F.col("flo") * 0.5)
    even = F.coalesce(F.floor(F.try_divide(F.col("v") * 0.5 - F.col("flo") * 0.5, width) * PARTS), F.lit(0))
    cell = F.when(F.col("v") == -_INF, -1).when(F.col("v") >= _INF, PARTS + 1).otherwise(even)
    largest = None
    while True:
        now = targets.where((F.col("lo") < F.col("hi")) & (F.col("n") > most)).agg(F.sum("n")).first()[0]
        if now is None or now == largest:
            break
        largest, targets = now, narrowed(targets, cell)
    last = narrowed(targets, F.col("v"), cuts=False)
    value = F.when(F.min("lo") == F.max("lo"), F.min("lo")).otherwise(F.min("lo") + (F.max("lo") - F.min("lo")) * F.first("f"))
    found = last.groupBy(*keys, "s").agg(value.alias("value"))
    arrays = [F.array(*(F.max(F.when((F.col("_k") == i) & (F.col("s") == j), F.col("value"))) for j in range(len(ps)))).alias(name) for i, (name, (_, ps)) in enumerate(wanted.items())]
    if not by:
        return found.agg(*arrays)
    given = found.groupBy(*group).agg(*arrays).withColumnsRenamed({g: f"{g}_" for g in group})
    on = [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in group]
    return ranges.select(*group).distinct().join(given, on, "left").select(*(F.col(g).alias(b) for b, g in zip(by, group)), *(F.coalesce(name, e).alias(name) for name, e in empty.items()))
