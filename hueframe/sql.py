"""Pieces of the SQL that the registered queries are checked against: the same views and formulas, written for a SQL engine."""

from __future__ import annotations

import re

BINS, NODES = 16, 9


def r(x: str, name: str) -> str:
    """A rounded column; adding 0 turns a negative zero into zero."""
    return f"round({x}, 6) + 0.0 AS {name}"


def clamp(x: str, low: str = "0.0", high: str = "1.0") -> str:
    return f"least(greatest({x}, {low}), {high})"


def luma(a: str, b: str, c: str) -> str:
    return f"(0.2126 * {a} + 0.7152 * {b} + 0.0722 * {c})"


def bin_id(n: int, cols: tuple[str, str, str] = ("sr", "sg", "sb")) -> str:
    i = [f"CAST(floor({clamp(c, '0.0', '0.999999')} * {n}) AS BIGINT)" for c in cols]
    return f"({i[2]} * {n * n} + {i[1]} * {n} + {i[0]})"


def node_of(n: int, cols: tuple[str, str, str] = ("ir", "ig", "ib")) -> str:
    i = [f"CAST(floor({clamp(c)} * {n - 1}) AS BIGINT)" for c in cols]
    return f"({i[2]} * {n * n} + {i[1]} * {n} + {i[0]})"


PX = """px AS (SELECT l_returnflag || l_linestatus AS pair_id, CAST(l_orderkey % 1000 AS INT) AS y, CAST(l_linenumber AS INT) AS x,
  l_quantity / 50.0 AS sr, l_extendedprice / 105000.0 AS sg, l_discount * 10.0 AS sb,
  least(greatest(l_quantity / 50.0 * 1.08 + 0.02, 0.0), 1.0) AS tr, least(greatest(l_extendedprice / 105000.0 * 1.08 + 0.02, 0.0), 1.0) AS tg,
  least(greatest(l_discount * 10.0 * 1.08 + 0.02, 0.0), 1.0) AS tb FROM lineitem)"""


def bins(n: int = BINS, name: str = "bins") -> str:
    stats = ", ".join([f"avg({s}) AS {m}" for s, m in zip(("sr", "sg", "sb", "tr", "tg", "tb"), ("ir", "ig", "ib", "or_", "og", "ob"))] + [f"coalesce(var_samp({t}), 0.0) AS v{t[1]}" for t in ("tr", "tg", "tb")])
    return f"""{name}0 AS (SELECT pair_id, {bin_id(n)} AS bin_id, count(*) AS n, {stats}, avg(x) AS mx, avg(y) AS my, max(x) AS rx, max(y) AS ry FROM px GROUP BY 1, 2),
{name} AS (SELECT * FROM (SELECT * EXCLUDE (mx, my, rx, ry), mx / greatest(max(rx) OVER (PARTITION BY pair_id), 1) AS cx, my / greatest(max(ry) OVER (PARTITION BY pair_id), 1) AS cy FROM {name}0) WHERE n >= 3)"""


VAR = "((vr + vg + vb) / 3.0)"
CONTRADICTION = f"({VAR} / (sqrt(or_ * or_ + og * og + ob * ob) + 0.05))"
PENALTY = "greatest((CASE WHEN least(ir, ig, ib) < 0.05 THEN least(ir, ig, ib) / 0.05 ELSE 1.0 END) * (CASE WHEN greatest(ir, ig, ib) > 0.98 THEN (1.0 - greatest(ir, ig, ib)) / 0.02 ELSE 1.0 END), 0.0)"


def samples(by_frequency: bool = False) -> str:
    t = clamp(f"{luma('ir', 'ig', 'ib')} / 0.25")
    raw = f"1.0 / (1.0 + (0.5 * {t} + 10.0 * (1.0 - {t})) * {VAR}) * least(1.0, n / 3.0) * {PENALTY}" + (" * n" if by_frequency else "")
    return f"w0 AS (SELECT *, {raw} AS raw FROM bins), samples AS (SELECT *, CASE WHEN avg(raw) OVER (PARTITION BY pair_id) > 1e-8 THEN raw / avg(raw) OVER (PARTITION BY pair_id) ELSE raw END AS alpha FROM w0)"


LATTICE = f"""{bins(NODES, "nb")},
lattice AS (SELECT p.pair_id AS lut_id, n.node_id, n.node_id % {NODES} AS i, (n.node_id // {NODES}) % {NODES} AS j, n.node_id // {NODES * NODES} AS k,
  coalesce(nb.or_, (n.node_id % {NODES}) / {NODES - 1}.0) AS r, coalesce(nb.og, ((n.node_id // {NODES}) % {NODES}) / {NODES - 1}.0) AS g, coalesce(nb.ob, (n.node_id // {NODES * NODES}) / {NODES - 1}.0) AS b
  FROM (SELECT DISTINCT pair_id FROM px) p CROSS JOIN (SELECT range AS node_id FROM range({NODES**3})) n LEFT JOIN nb ON nb.pair_id = p.pair_id AND nb.bin_id = n.node_id)"""


def applied(kernel: str, source: str = "bins", n: int = NODES) -> str:
    """CTE `out`: the rows of `source` with the pair's lattice applied to ir, ig, ib, as pr, pg, pb."""
    cell = ", ".join(f"{clamp(c)} * {n - 1} - least(floor({clamp(c)} * {n - 1}), {n - 2}) AS f{k}, CAST(least(floor({clamp(c)} * {n - 1}), {n - 2}) AS BIGINT) AS l{k}" for c, k in zip(("ir", "ig", "ib"), "rgb"))
    if kernel == "trilinear":
        parts = [f"SELECT pair_id, bin_id, (lb + {b}) * {n * n} + (lg + {g}) * {n} + lr + {a} AS node_id, " + " * ".join(f if d else f"(1.0 - {f})" for f, d in (("fr", a), ("fg", g), ("fb", b))) + " AS w FROM cell" for a in (0, 1) for g in (0, 1) for b in (0, 1)]
        return f"cell AS (SELECT *, {cell} FROM {source}), corner AS ({' UNION ALL '.join(parts)}), {_OUT.format(source=source)}"
    far = 1 + n + n * n
    steps = f"""path AS (SELECT *, lb * {n * n} + lg * {n} + lr AS base, greatest(fr, fg, fb) AS hi, least(fr, fg, fb) AS lo, fr + fg + fb - greatest(fr, fg, fb) - least(fr, fg, fb) AS md,
  CASE WHEN fr = greatest(fr, fg, fb) THEN 1 WHEN fg = greatest(fr, fg, fb) THEN {n} ELSE {n * n} END AS up,
  CASE WHEN fb = least(fr, fg, fb) THEN {n * n} WHEN fg = least(fr, fg, fb) THEN {n} ELSE 1 END AS down FROM cell)"""
    parts = [f"SELECT pair_id, bin_id, {node} AS node_id, {w} AS w FROM path" for node, w in (("base", "1.0 - hi"), ("base + up", "hi - md"), (f"base + {far} - down", "md - lo"), (f"base + {far}", "lo"))]
    return f"cell AS (SELECT *, {cell} FROM {source}), {steps}, corner AS ({' UNION ALL '.join(parts)}), {_OUT.format(source=source)}"


_OUT = """pred AS (SELECT c.pair_id, c.bin_id, sum(c.w * t.r) AS pr, sum(c.w * t.g) AS pg, sum(c.w * t.b) AS pb FROM corner c JOIN lattice t ON t.lut_id = c.pair_id AND t.node_id = c.node_id GROUP BY 1, 2),
out AS (SELECT s.*, pr, pg, pb FROM {source} s JOIN pred USING (pair_id, bin_id))"""


def linear(c: str) -> str:
    v = clamp(c)
    return f"(CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END)"


def lab(source: str, cols: tuple[str, str, str], p: str, out: str) -> str:
    """CTEs that end in `out`: rows of `source` with the Lab columns pL, pA, pB."""
    f = lambda t: f"(CASE WHEN {t} > pow(6.0 / 29.0, 3) THEN cbrt({t}) ELSE {t} / (3.0 * pow(6.0 / 29.0, 2)) + 4.0 / 29.0 END)"
    l0, l1, l2 = (f"{p}l{i}" for i in range(3))
    return f"""{out}_a AS (SELECT *, {", ".join(f"{linear(c)} AS {p}l{i}" for i, c in enumerate(cols))} FROM {source}),
{out}_b AS (SELECT *, (0.4124564 * {l0} + 0.3575761 * {l1} + 0.1804375 * {l2}) / 0.95047 AS {p}x, (0.2126729 * {l0} + 0.7151522 * {l1} + 0.0721750 * {l2}) AS {p}y, (0.0193339 * {l0} + 0.1191920 * {l1} + 0.9503041 * {l2}) / 1.08883 AS {p}z FROM {out}_a),
{out} AS (SELECT *, 116.0 * {f(p + "y")} - 16.0 AS {p}L_, 500.0 * ({f(p + "x")} - {f(p + "y")}) AS {p}A_, 200.0 * ({f(p + "y")} - {f(p + "z")}) AS {p}B_ FROM {out}_b)"""


def de2000(source: str, p: str, q: str, out: str) -> str:
    """CTEs that end in `out`: rows of `source` with CIEDE2000 of two Lab triples as `de`."""
    root = lambda c: f"sqrt(pow({c}, 7) / (pow({c}, 7) + 6103515625.0))"
    hue = lambda a, b: f"(CASE WHEN {a} = 0 AND {b} = 0 THEN 0.0 WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360.0 ELSE degrees(atan2({b}, {a})) END)"
    length = lambda a, b: f"sqrt({a} * {a} + {b} * {b})"
    return f"""{out}1 AS (SELECT *, 0.5 * (1.0 - {root(f"(({length(p + 'A_', p + 'B_')} + {length(q + 'A_', q + 'B_')}) / 2.0)")}) AS gg FROM {source}),
{out}2 AS (SELECT *, {p}A_ * (1.0 + gg) AS x1, {q}A_ * (1.0 + gg) AS x2 FROM {out}1),
{out}3 AS (SELECT *, {length("x1", p + "B_")} AS c1, {length("x2", q + "B_")} AS c2, {hue("x1", p + "B_")} AS h1, {hue("x2", q + "B_")} AS h2 FROM {out}2),
{out}4 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0.0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360.0 ELSE h2 - h1 + 360.0 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2.0 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360.0) / 2.0 ELSE (h1 + h2 - 360.0) / 2.0 END AS hm,
  (c1 + c2) / 2.0 AS cm, pow(({p}L_ + {q}L_) / 2.0 - 50.0, 2) AS lm FROM {out}3),
{out}5 AS (SELECT *, ({q}L_ - {p}L_) / (1.0 + 0.015 * lm / sqrt(20.0 + lm)) AS u_, (c2 - c1) / (1.0 + 0.045 * cm) AS v_,
  2.0 * sqrt(c1 * c2) * sin(radians(dh / 2.0)) / (1.0 + 0.015 * cm * (1.0 - 0.17 * cos(radians(hm - 30.0)) + 0.24 * cos(radians(2.0 * hm)) + 0.32 * cos(radians(3.0 * hm + 6.0)) - 0.20 * cos(radians(4.0 * hm - 63.0)))) AS w_,
  -2.0 * {root("cm")} * sin(radians(60.0 * exp(-pow((hm - 275.0) / 25.0, 2)))) AS r_ FROM {out}4),
{out} AS (SELECT *, sqrt(greatest(u_ * u_ + v_ * v_ + w_ * w_ + r_ * v_ * w_, 0.0)) AS de FROM {out}5)"""


TRACKS = """tr AS (SELECT event_type AS track, CAST(dense_rank() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE)) - 1 AS INT) AS shot_index, value FROM events WHERE value IS NOT NULL),
shots AS (SELECT track, shot_index, avg(value) / 500.0 AS m, min(value) / 500.0 AS lo, max(value) / 500.0 AS hi FROM tr GROUP BY 1, 2),
cents AS (SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS INT) AS cluster_id, avg(value) / 500.0 AS m, min(value) / 500.0 AS lo, max(value) / 500.0 AS hi FROM events WHERE value IS NOT NULL GROUP BY event_type)"""


def scaled(col: str) -> str:
    mad = f"(1.4826 * (SELECT median(abs(c.{col} - (SELECT median({col}) FROM cents))) FROM cents c))"
    return f"(CASE WHEN {mad} < 1e-8 THEN 1.0 ELSE {mad} END)"


DISTANCES = f"""{TRACKS}, dist AS (SELECT s.track, s.shot_index, c.cluster_id, sqrt({" + ".join(f"pow((s.{k} - c.{k}) / {scaled(k)}, 2)" for k in ("m", "lo", "hi"))}) AS distance FROM shots s CROSS JOIN cents c)"""


# The fit of small lattices, one for each first letter of a pair's name: three nodes a side, 27 unknowns for each
# lattice and channel, solved by Gauss-Jordan elimination in a recursive query.


def fit_parts(n: int = 3, t: str = "", smoothness: float = 0.1) -> str:
    """CTEs of a fit of `n` nodes a side, `t` at the end of their names: corners of samples `c3`, channels `ch3`, the Laplacian `lap`, and nodes `fx` with their terms."""
    edge = float(n - 1)
    lum = f"least(greatest((({luma(f'i / {edge}', f'j / {edge}', f'k / {edge}')}) - 0.08) / 0.17, 0.0), 1.0)"
    boost = f"(25.0 - 24.0 * {lum} * {lum} * (3.0 - 2.0 * {lum}))"
    corner = re.sub(r"\b(cell|path|corner)\b", rf"\g<1>{t}", applied("tetrahedral", "samples", n).split(", pred AS")[0])
    return f"""{corner}, c3{t} AS (SELECT * FROM corner{t} WHERE w <> 0),
ch3{t} AS ({" UNION ALL ".join(f"SELECT substr(pair_id, 1, 1) AS lut, pair_id, bin_id, {c} AS ch, alpha, {o} AS y FROM samples" for c, o in enumerate(("or_", "og", "ob")))}),
nd3{t} AS (SELECT range AS node, range % {n} AS i, (range // {n}) % {n} AS j, range // {n * n} AS k FROM range({n**3})),
lap0{t} AS (SELECT a.node AS r, b.node AS c FROM nd3{t} a JOIN nd3{t} b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1),
lap{t} AS (SELECT r, c, -1.0 AS v FROM lap0{t} UNION ALL SELECT r, r, CAST(count(*) AS DOUBLE) FROM lap0{t} GROUP BY 1),
oc3{t} AS (SELECT DISTINCT substr(pair_id, 1, 1) AS lut, {node_of(n)} AS node FROM samples),
ds3{t} AS (SELECT lut, n.node, min(sqrt(pow(n.i - m.i, 2) + pow(n.j - m.j, 2) + pow(n.k - m.k, 2))) AS dist FROM oc3{t} o JOIN nd3{t} m ON m.node = o.node CROSS JOIN nd3{t} n GROUP BY 1, 2),
fx{t} AS (SELECT lut, node, ch, {smoothness} * {boost} AS sm, 0.01 * (1.0 - exp(-dist / 3.0)) AS pr, (CASE ch WHEN 0 THEN i WHEN 1 THEN j ELSE k END) / {edge} AS goal FROM ds3{t} JOIN nd3{t} USING (node) CROSS JOIN (SELECT range AS ch FROM range(3)))"""


def fit_round(t: int, delta: float | None = None, smoothness: float = 1.0, source: str = "ch3", nodes: str = "fx", n: int = 3, tag: str = "") -> str:
    """CTEs that end in `x{t}`, the solution for samples `source` and nodes' terms `nodes`; with `delta`, all terms are weighted by residuals of the round before."""
    huber = lambda r: f"(CASE WHEN abs({r}) < {delta} THEN 1.0 ELSE {delta} / (abs({r}) + 1e-8) END)"
    if delta is None:
        terms = f"d{t} AS (SELECT * FROM {source}), s{t} AS (SELECT lut, node, ch, sm * {smoothness} AS sm, pr, goal FROM {nodes})"
    else:
        terms = f"""d{t} AS (SELECT lut, pair_id, bin_id, ch, alpha * {huber("sqrt(alpha) * (p - y)")} AS alpha, y FROM {source} JOIN (SELECT c.pair_id, c.bin_id, x.ch, sum(c.w * x.x) AS p FROM c3{tag} c JOIN x{t - 1} x ON x.lut = substr(c.pair_id, 1, 1) AND x.node = c.node_id GROUP BY 1, 2, 3) USING (pair_id, bin_id, ch)),
s{t} AS (SELECT f.lut, f.node, f.ch, sm * {huber("sqrt(sm) * e")} AS sm, pr * {huber("sqrt(pr) * (x.x - goal)")} AS pr, goal FROM {nodes} f JOIN x{t - 1} x USING (lut, node, ch) JOIN (SELECT x.lut, x.ch, l.r AS node, sum(l.v * x.x) AS e FROM x{t - 1} x JOIN lap{tag} l ON l.c = x.node GROUP BY 1, 2, 3) USING (lut, node, ch))"""
    return f"""{terms},
a{t} AS (SELECT lut, ch, i, j, sum(v) AS v FROM (SELECT lut, ch, p.node_id AS i, q.node_id AS j, d.alpha * p.w * q.w AS v FROM d{t} d JOIN c3{tag} p USING (pair_id, bin_id) JOIN c3{tag} q USING (pair_id, bin_id)
  UNION ALL SELECT lut, ch, node_id, {n**3}, d.alpha * p.w * y FROM d{t} d JOIN c3{tag} p USING (pair_id, bin_id)
  UNION ALL SELECT lut, ch, p.c, q.c, sm * p.v * q.v FROM s{t} s JOIN lap{tag} p ON p.r = s.node JOIN lap{tag} q ON q.r = s.node
  UNION ALL SELECT lut, ch, node, node, pr FROM s{t} UNION ALL SELECT lut, ch, node, {n**3}, pr * goal FROM s{t}) GROUP BY 1, 2, 3, 4),
m{t} AS (SELECT f.lut, f.ch, f.node AS i, list(coalesce(a.v, 0.0) ORDER BY c.range) AS line FROM {nodes} f CROSS JOIN range({n**3 + 1}) c LEFT JOIN a{t} a ON a.lut = f.lut AND a.ch = f.ch AND a.i = f.node AND a.j = c.range GROUP BY 1, 2, 3),
e{t} AS (SELECT 0 AS step, lut, ch, i, line FROM m{t} UNION ALL SELECT a.step + 1, a.lut, a.ch, a.i, CASE WHEN a.i = a.step THEN [v / a.line[a.step + 1] for v in a.line] ELSE [a.line[z] - a.line[a.step + 1] / p.line[a.step + 1] * p.line[z] for z in range(1, {n**3 + 2})] END
  FROM e{t} a JOIN e{t} p ON p.lut = a.lut AND p.ch = a.ch AND p.i = a.step WHERE a.step < {n**3}),
x{t} AS (SELECT lut, ch, i AS node, line[{n**3 + 1}] AS x FROM e{t} WHERE step = {n**3})"""


def fit_refined() -> str:
    """CTE `refined`: samples whose error is above twice their lattice's 95th percentile lose weight in proportion."""
    return """er AS (SELECT pair_id, bin_id, sqrt(sum(pow(p - y, 2))) AS e FROM ch3 JOIN (SELECT c.pair_id, c.bin_id, x.ch, sum(c.w * x.x) AS p FROM c3 c JOIN x0 x ON x.lut = substr(c.pair_id, 1, 1) AND x.node = c.node_id GROUP BY 1, 2, 3) USING (pair_id, bin_id, ch) GROUP BY 1, 2),
lim AS (SELECT substr(pair_id, 1, 1) AS lut, 2.0 * quantile_cont(e, 0.95) AS lim FROM er GROUP BY 1), refined AS (SELECT lut, pair_id, bin_id, ch, CASE WHEN e > lim THEN alpha * lim / (e + 1e-8) ELSE alpha END AS alpha, y FROM ch3 JOIN er USING (pair_id, bin_id) JOIN lim USING (lut))"""


def fit_chosen() -> str:
    """CTE `x2`: the second solution of lattices of which any sample lost weight, else the first."""
    return "x2 AS (SELECT a.lut, a.ch, a.node, CASE WHEN a.lut IN (SELECT lut FROM er JOIN lim ON lut = substr(pair_id, 1, 1) WHERE e > lim) THEN b.x ELSE a.x END AS x FROM x0 a JOIN x1 b USING (lut, ch, node))"


def fit_result(t: int) -> str:
    return f"SELECT lut AS lut_id, node AS node_id, {', '.join(r(clamp(f'max(CASE WHEN ch = {c} THEN x END)', '-0.5', '1.5'), k) for c, k in enumerate('rgb'))} FROM x{t} GROUP BY 1, 2"


# Baselines: an affine map and three curves for each first letter of a pair's name.

_ONES = ("ir", "ig", "ib", "1.0")


def on_curve(v: str, xs: str, ys: str) -> str:
    """Value at `v` of the curve through two lists; constant beyond the ends."""
    i = f"CAST(greatest(least(len(list_filter({xs}, lambda q: q <= {v})), len({xs}) - 1), 1) AS INT)"
    return f"(CASE WHEN len({xs}) = 1 OR {v} <= {xs}[1] THEN {ys}[1] WHEN {v} >= {xs}[len({xs})] THEN {ys}[len({ys})] ELSE {ys}[{i}] + ({ys}[{i} + 1] - {ys}[{i}]) * ({v} - {xs}[{i}]) / ({xs}[{i} + 1] - {xs}[{i}]) END)"


def affine_of(p: str, x: tuple[str, str, str]) -> str:
    return f"({p}.t0 * {x[0]} + {p}.t1 * {x[1]} + {p}.t2 * {x[2]} + {p}.t3)"


def solved_affine(name: str, source: str) -> str:
    """CTEs that end in `name` (lut, ch, t0..t3): least squares of rows (lut, ch, w, ir, ig, ib, y) by elimination."""
    sums = ", ".join(f"sum(w * {_ONES[min(i, j)]} * {_ONES[max(i, j)]}) AS m{i}{j}" for i in range(4) for j in range(4)) + ", " + ", ".join(f"sum(w * {_ONES[i]} * y) AS m{i}4" for i in range(4))
    out = [f"{name}_0 AS (SELECT lut, ch, {sums} FROM {source} GROUP BY 1, 2)"]
    for k in range(4):
        cells = (f"m{k}{j} / m{k}{k} AS m{k}{j}" if i == k else f"m{i}{j} - m{i}{k} * m{k}{j} / m{k}{k} AS m{i}{j}" for i in range(4) for j in range(5))
        out.append(f"{name}_{k + 1} AS (SELECT lut, ch, {', '.join(cells)} FROM {name}_{k})")
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT lut, ch, {', '.join(f'm{i}4 AS t{i}' for i in range(4))} FROM {name}_4)"])


def baselines(source: str = "samples", rounds: int = 3, irls: int = 3) -> str:
    """CTEs `base` (lut, ch, t0..t3, xs, ys) and `knots` (lut, ch, knot, x, y) of samples."""
    inputs = ("s.ir", "s.ig", "s.ib")
    out = [f"b_0 AS MATERIALIZED ({' UNION ALL '.join(f'SELECT substr(pair_id, 1, 1) AS lut, pair_id, bin_id, {c} AS ch, alpha, ir, ig, ib, {o} AS out, {o} AS y FROM {source}' for c, o in enumerate(('or_', 'og', 'ob')))})"]
    for a in range(rounds):
        if a:
            out.append(f"b_{a} AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN len(k.bx) < 2 THEN list_avg(k.xs) ELSE {on_curve('s.out', 'k.bx', 'k.bys')} END AS y) FROM b_0 s JOIN k_{a - 1} k USING (lut, ch))")
        for t in range(irls + 1):
            if t == 0:
                out.append(f"w_{a}_0 AS (SELECT *, greatest(alpha, 0.0) AS w FROM b_{a})")
            else:
                off = f"abs({affine_of('p', inputs)} - s.y)"
                out.append(f"w_{a}_{t} AS (SELECT s.*, greatest(alpha, 0.0) * CASE WHEN {off} < 1.0 THEN 1.0 ELSE 1.0 / ({off} + 1e-8) END AS w FROM b_{a} s JOIN t_{a}_{t - 1} p USING (lut, ch))")
            out.append(solved_affine(f"t_{a}_{t}", f"w_{a}_{t}"))
        p = f"t_{a}_{irls}"
        out.append(f"""z_{a} AS MATERIALIZED (SELECT lut, ch, alpha, out AS y, {affine_of('p', inputs)} AS z FROM b_0 s JOIN {p} p USING (lut, ch)),
d_{a} AS MATERIALIZED (SELECT lut, ch, min(z) AS low, greatest(max(z) - min(z), 1e-8) / 64 AS step FROM z_{a} GROUP BY 1, 2),
m_{a} AS (SELECT lut, ch, CAST(least(floor((z - low) / step), 63) AS INT) AS knot, sum(alpha * y) / sum(alpha) AS y, sum(alpha) AS w FROM z_{a} JOIN d_{a} USING (lut, ch) GROUP BY 1, 2, 3 HAVING sum(alpha) > 0),
g_{a} AS MATERIALIZED (SELECT e.lut, e.ch, CAST(range AS INT) AS knot, low + (range + 0.5) * step AS x, m.y, m.w FROM d_{a} e CROSS JOIN range(64) LEFT JOIN m_{a} m ON m.lut = e.lut AND m.ch = e.ch AND m.knot = range),
l_{a} AS (SELECT lut, ch, list(x ORDER BY knot) AS lx, list(y ORDER BY knot) AS ly FROM g_{a} WHERE y IS NOT NULL GROUP BY 1, 2),
f_{a} AS MATERIALIZED (SELECT g.lut, g.ch, g.knot, g.x, coalesce(g.w, 1e-8) AS w, coalesce(g.y, {on_curve('g.x', 'l.lx', 'l.ly')}) AS y FROM g_{a} g JOIN l_{a} l USING (lut, ch)),
sp_{a} AS MATERIALIZED (SELECT a.lut, a.ch, a.knot AS j, b.knot AS k, sum(c.y * c.w) / sum(c.w) AS m FROM f_{a} a JOIN f_{a} b ON a.lut = b.lut AND a.ch = b.ch AND a.knot <= b.knot JOIN f_{a} c ON c.lut = a.lut AND c.ch = a.ch AND c.knot BETWEEN a.knot AND b.knot GROUP BY 1, 2, 3, 4),
lo_{a} AS (SELECT i.lut, i.ch, i.knot, s.j, min(s.m) AS m FROM f_{a} i JOIN sp_{a} s ON s.lut = i.lut AND s.ch = i.ch AND s.j <= i.knot AND s.k >= i.knot GROUP BY 1, 2, 3, 4),
i_{a} AS MATERIALIZED (SELECT lut, ch, knot, x, v.y FROM (SELECT lut, ch, knot, max(m) AS y FROM lo_{a} GROUP BY 1, 2, 3) v JOIN (SELECT lut, ch, knot, x FROM f_{a}) USING (lut, ch, knot)),
r_{a} AS (SELECT *, y - lag(y) OVER (PARTITION BY lut, ch ORDER BY knot) AS rise FROM i_{a}),
k_{a} AS MATERIALIZED (SELECT lut, ch, list(x ORDER BY knot) AS xs, list(y ORDER BY knot) AS ys, list(y ORDER BY knot) FILTER (rise IS NULL OR rise > 1e-12) AS bx, list(x ORDER BY knot) FILTER (rise IS NULL OR rise > 1e-12) AS bys FROM r_{a} GROUP BY 1, 2)""")
    return ",\n".join([*out, f"knots AS (SELECT * FROM i_{rounds - 1}), base AS MATERIALIZED (SELECT p.*, xs, ys FROM t_{rounds - 1}_{irls} p JOIN k_{rounds - 1} USING (lut, ch))"])


def on_baseline() -> str:
    """CTEs after `baselines` and `fit_parts`: samples `chb` and nodes `fxb` without the baselines that pass, and `nb`, those at the nodes."""
    value = on_curve(affine_of("b", ("s.ir", "s.ig", "s.ib")), "b.xs", "b.ys")
    at = on_curve(affine_of("b", ("n.i / 2.0", "n.j / 2.0", "n.k / 2.0")), "b.xs", "b.ys")
    return f"""pv AS MATERIALIZED (SELECT s.lut, s.pair_id, s.bin_id, s.ch, s.alpha, s.out, {value} AS p, CASE s.ch WHEN 0 THEN s.ir WHEN 1 THEN s.ig ELSE s.ib END AS own FROM b_0 s JOIN base b USING (lut, ch)),
gate AS MATERIALIZED (SELECT lut, sum(alpha * pow(out - p, 2)) / greatest(sum(alpha * pow(out - own, 2)), 1e-8 * sum(alpha) / 3) < 0.95 AS passes FROM pv GROUP BY 1),
chb AS MATERIALIZED (SELECT lut, pair_id, bin_id, ch, alpha, CASE WHEN passes THEN out - p ELSE out END AS y FROM pv JOIN gate USING (lut)),
fxb AS MATERIALIZED (SELECT f.* REPLACE (CASE WHEN passes THEN 0.0 ELSE goal END AS goal) FROM fx f JOIN gate USING (lut)),
nb AS (SELECT b.lut, b.ch, n.node, CASE WHEN passes THEN {at} ELSE 0.0 END AS base FROM base b JOIN gate USING (lut) CROSS JOIN nd3 n)"""


def fit_on_baseline(t: int) -> str:
    value = clamp("max(CASE WHEN ch = {} THEN x + base END)", "-0.5", "1.5")
    return f"SELECT lut AS lut_id, node AS node_id, {', '.join(r(value.replace('{}', str(c)), k) for c, k in enumerate('rgb'))} FROM x{t} JOIN nb USING (lut, ch, node) GROUP BY 1, 2"


def multigrid() -> str:
    """CTEs after `baselines`, `fit_parts` of three nodes and of two, named by "2": two levels over the baselines, `now3` the lattices without the last fit `x1`.

    All baselines pass their gate here.
    """
    at = lambda e: on_curve(affine_of("b", (f"n.i / {e}", f"n.j / {e}", f"n.k / {e}")), "b.xs", "b.ys")
    rest = lambda now, tag: f"SELECT s.lut, s.pair_id, s.bin_id, s.ch, s.alpha, s.out - p.p AS y FROM b_0 s JOIN (SELECT c.pair_id, c.bin_id, v.ch, sum(c.w * v.v) AS p FROM c3{tag} c JOIN {now} v ON v.lut = substr(c.pair_id, 1, 1) AND v.node = c.node_id GROUP BY 1, 2, 3) p USING (pair_id, bin_id, ch)"
    w = " * ".join(f"(CASE WHEN m.{k} = 1 THEN n.{k} / 2.0 ELSE 1.0 - n.{k} / 2.0 END)" for k in "ijk")
    return f"""g2 AS MATERIALIZED (SELECT b.lut, b.ch, n.node, {at(1.0)} AS v FROM base b CROSS JOIN nd32 n),
r2 AS MATERIALIZED ({rest("g2", "2")}), z2 AS MATERIALIZED (SELECT lut, node, ch, sm, 0.01 * (1.0 - exp(-1.0 / 3.0)) AS pr, 0.0 AS goal FROM fx2),
{fit_round(0, source="r2", nodes="z2", n=2, tag="2")},
now2 AS MATERIALIZED (SELECT g.lut, g.ch, g.node, v + x AS v FROM g2 g JOIN x0 USING (lut, ch, node)),
now3 AS MATERIALIZED (SELECT o.lut, o.ch, n.node, sum({w} * o.v) AS v FROM nd3 n CROSS JOIN nd32 m JOIN now2 o ON o.node = m.node GROUP BY 1, 2, 3),
r3 AS MATERIALIZED ({rest("now3", "")}), z3 AS MATERIALIZED (SELECT lut, node, ch, sm, pr, 0.0 AS goal FROM fx),
{fit_round(1, source="r3", nodes="z3")},
nb AS (SELECT lut, ch, node, v AS base FROM now3)"""
