"""The catalogue's queries as DuckDB SQL over the same tables."""

from __future__ import annotations

import numpy as np

from bandloom.operators import geodesy, library
from bandloom.operators.classify import PALETTE, chi2_quantile
from bandloom.queries import AXIS, BANDS, BLUE, BOXES, GREEN, NIR, RED, SWIR2, SYSTEMS, TARGETS, TRIANGLE, WIDTH

r6 = "round({}, 6) + 0.0".format

E = f"WITH e AS (SELECT vec_id, label, (vec_id // {WIDTH})::INT AS y, (vec_id % {WIDTH})::INT AS x, embedding::DOUBLE[] AS v FROM embeddings)"
ABS = E + ", a AS (SELECT vec_id, label, y, x, list_transform(v, lambda q: abs(q)) AS v FROM e)"
LI = "WITH li AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS b1, l_extendedprice::DOUBLE AS b2, l_discount::DOUBLE AS b3, l_tax::DOUBLE AS b4 FROM lineitem)"
ITEM_BANDS = LI + ", ib AS (SELECT unnest([0, 1, 2, 3]) AS band, unnest([b1, b2, b3, b4]) AS v FROM li)"


def clip(x: str, lo: float = -1, hi: float = 1) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def items(value: str, before: str = "", out: str = "result", source: str = "li") -> str:
    return f"{LI}{before} SELECT l_orderkey, l_linenumber, {r6(value)} AS {out} FROM {source}"


def flag(x: str) -> str:
    return f"(CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def trunc(x: str) -> str:
    return f"trunc({x})"


def index(name: str, value: str) -> str:
    return f"{ABS} SELECT vec_id, {r6(clip(value))} AS {name} FROM (SELECT vec_id, v[{NIR + 1}] AS nir, v[{RED + 1}] AS red, v[{GREEN + 1}] AS green, v[{BLUE + 1}] AS blue, v[{SWIR2 + 1}] AS swir FROM a)"


RGB = ABS + f""", c AS (SELECT vec_id, v[{RED + 1}] AS r0, v[{GREEN + 1}] AS g0, v[{BLUE + 1}] AS b0 FROM a),
s AS (SELECT min(r0) AS r1, max(r0) AS r2, min(g0) AS g1, max(g0) AS g2, min(b0) AS b1, max(b0) AS b2 FROM c),
rgb AS (SELECT vec_id, (r0 - r1) / (r2 - r1) AS r, (g0 - g1) / (g2 - g1) AS g, (b0 - b1) / (b2 - b1) AS b FROM c, s),
m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM rgb),
h0 AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (g - b) / d WHEN v = g THEN 2.0::DOUBLE + (b - r) / d ELSE 4.0::DOUBLE + (r - g) / d END / 6.0::DOUBLE AS h1 FROM m),
hsv AS (SELECT vec_id, r, g, b, CASE WHEN h1 < 0 THEN h1 + 1.0::DOUBLE ELSE h1 END AS h, CASE WHEN v = 0 THEN 0 ELSE d / v END AS s, v FROM h0)"""


def stretched(stats: str, value: str) -> str:
    return f"{LI}, st AS (SELECT {stats} FROM li) SELECT l_orderkey, l_linenumber, {r6(clip(value, 0, 1))} AS s FROM li, st"


PERCENT = "quantile_cont(b2, {0}::DOUBLE) AS lo, quantile_cont(b2, {1}::DOUBLE) AS hi"


def polygon(x: str, y: str) -> str:
    """Parity of the triangle's edges to the right of a point."""
    parts = []
    for (x0, y0), (x1, y1) in zip(TRIANGLE, [*TRIANGLE[1:], TRIANGLE[0]]):
        parts.append(f"(CASE WHEN (({y} < {y0}) <> ({y} < {y1})) AND {x} < {x0} + ({y} - {y0}) * ({x1 - x0}::DOUBLE / {y1 - y0}) THEN 1 ELSE 0 END)")
    return f"(({' + '.join(parts)}) % 2 = 1)"


def box(name: str) -> str:
    x0, y0, x1, y1 = BOXES[name]
    return f"(x >= {x0} AND x < {x1} AND y >= {y0} AND y < {y1})"


LONG = ", l AS (SELECT vec_id, label, y, x, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS band FROM {0})"


def means(source: str) -> str:
    """Mean vectors of the labels, as lists, numbered by label."""
    return LONG.format(source) + ", mb AS (SELECT label, band, avg(value) AS m FROM l GROUP BY label, band), refs AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cls, m FROM (SELECT label, list(m ORDER BY band) AS m FROM mb GROUP BY label))"


SAM = E + means("e") + """, ang AS (SELECT e.vec_id, e.label, refs.cls, refs.label AS pred,
  acos(least(greatest(list_dot_product(e.v, refs.m) / (greatest(sqrt(list_dot_product(e.v, e.v)), 1e-8) * greatest(sqrt(list_dot_product(refs.m, refs.m)), 1e-8)), -1), 1)) AS angle FROM e, refs),
best AS (SELECT vec_id, any_value(label) AS label, arg_min(cls, (angle, cls)) AS cls, min(angle) AS score, arg_min(pred, (angle, cls)) AS pred FROM ang GROUP BY vec_id)"""

SID = ABS + means("a") + """, fl AS (SELECT a.vec_id, refs.cls, list_transform(a.v, lambda q: greatest(q, 1e-8::DOUBLE)) AS p, list_transform(refs.m, lambda q: greatest(q, 1e-8::DOUBLE)) AS q FROM a, refs),
pr AS (SELECT vec_id, cls, list_transform(p, lambda z: z / list_sum(p)) AS p, list_transform(q, lambda z: z / list_sum(q)) AS q FROM fl),
dv AS (SELECT vec_id, cls, greatest(list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) * (ln(z[1]) - ln(z[2])))), 0) AS d FROM pr)"""

NEAR = """, d2 AS (SELECT e.vec_id, {c}.cls, list_sum(list_transform(list_zip(e.v, {c}.m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM e, {c}),
{out} AS (SELECT vec_id, arg_min(cls, (d, cls)) AS cls FROM d2 GROUP BY vec_id)"""
CENTRES = E + ", c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cls, v AS m FROM e ORDER BY vec_id LIMIT 4)" + NEAR.format(c="c0", out="n0")
NEW = CENTRES + LONG.format("e") + ", nb AS (SELECT n0.cls, band, avg(value) AS m, count(*) AS n FROM l JOIN n0 USING (vec_id) GROUP BY n0.cls, band)"

CONFUSION = SAM + ", cm AS (SELECT label AS ref, pred, count(*) AS n FROM best GROUP BY label, pred)"
MARGINS = CONFUSION + """, cl AS (SELECT ref AS cls FROM cm UNION SELECT pred FROM cm),
mg AS (SELECT cls, coalesce((SELECT sum(n) FROM cm WHERE ref = cls), 0) AS rn, coalesce((SELECT sum(n) FROM cm WHERE pred = cls), 0) AS pn, coalesce((SELECT sum(n) FROM cm WHERE ref = cls AND pred = cls), 0) AS hit FROM cl)"""

def cov_table(source: str, scale: str = "") -> str:
    """Covariances of all pairs of bands of a table of lists v."""
    return f""", b AS (SELECT row_number() OVER () AS r, v FROM {source}), u AS (SELECT r, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS band FROM b)
SELECT p.band::INT AS i, q.band::INT AS j, {r6(f'covar_samp(p.value, q.value){scale}')} AS c FROM u p JOIN u q ON p.r = q.r AND p.band <= q.band GROUP BY p.band, q.band"""


DIFFERENCES = f"{E}, p AS (SELECT v, lag(v) OVER (PARTITION BY y ORDER BY x) AS b FROM e), s AS (SELECT list_transform(list_zip(v, b), lambda z: z[1] - z[2]) AS v FROM p WHERE b IS NOT NULL)"

CONTINUUM = ABS + LONG.format("a") + f""", hull AS (SELECT i.vec_id, i.band, any_value(i.value) AS v, greatest(any_value(i.value), max(j.value + (k.value - j.value) * (i.band - j.band) / (k.band - j.band))) AS h
  FROM l i JOIN l j ON j.vec_id = i.vec_id AND j.band <= i.band JOIN l k ON k.vec_id = i.vec_id AND k.band >= i.band AND k.band > j.band GROUP BY i.vec_id, i.band)
SELECT vec_id, band::INT AS band, {r6(clip('v / greatest(h, 1e-7)', 0, 1))} AS cr FROM hull"""


def inverse(source: str, n: int) -> str:
    """CTEs of Gauss and Jordan on matrices source(k, i, j, v) of n rows: inv(k, i, v) with rows as lists, and det(k, logdet)."""
    pivot, row, column = (f"max(CASE WHEN {c} THEN v END) OVER (PARTITION BY k{by})" for c, by in (("i = step AND j = step", ""), ("i = step", ", j"), ("j = step", ", i")))
    return f""", gj AS (SELECT 0 AS step, k, i, j, v FROM {source} UNION ALL SELECT 0, k, i, i + {n}, 1.0::DOUBLE FROM {source} WHERE i = j UNION ALL SELECT 0, k, i, j + {n}, 0.0::DOUBLE FROM {source} WHERE i <> j
UNION ALL SELECT step + 1, k, i, j, CASE WHEN i = step THEN v / p ELSE v - f * r / p END FROM (SELECT *, {pivot} AS p, {row} AS r, {column} AS f FROM gj WHERE step < {n})),
inv AS (SELECT k, i, list(v ORDER BY j) AS m FROM gj WHERE step = {n} AND j >= {n} GROUP BY k, i),
det AS (SELECT k, sum(ln(v)) AS logdet FROM gj WHERE step < {n} AND i = step AND j = step GROUP BY k)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


MLC = recursive(ABS + means("a") + """, cv AS (SELECT p.label AS k, p.band AS i, q.band AS j, covar_samp(p.value, q.value) AS c FROM l p JOIN l q ON p.vec_id = q.vec_id GROUP BY p.label, p.band, q.band),
tr AS (SELECT k, sum(c) AS t FROM cv WHERE i = j GROUP BY k),
reg AS (SELECT k, i, j, c + CASE WHEN i = j THEN 1e-4::DOUBLE * t / 64 + 1e-6::DOUBLE ELSE 0 END AS v FROM cv JOIN tr USING (k))""" + inverse("reg", 64) + f""",
dev AS (SELECT a.vec_id, refs.label AS k, list_transform(list_zip(a.v, refs.m), lambda z: z[1] - z[2]) AS y FROM a, refs),
d2 AS (SELECT vec_id, k, sum(y[i + 1] * list_dot_product(y, m)) AS d FROM dev JOIN inv USING (k) GROUP BY vec_id, k),
sc AS (SELECT vec_id, k, d, -0.5::DOUBLE * (logdet + d) AS s FROM d2 JOIN det USING (k)),
top AS (SELECT vec_id, arg_min(k, (-s, k)) AS cls, arg_min(d, (-s, k)) AS d FROM sc GROUP BY vec_id)
SELECT vec_id, CASE WHEN d <= {chi2_quantile(0.99, 64)!r}::DOUBLE THEN cls ELSE -1 END::INT AS cls, round(d, 3) + 0.0 AS score FROM top""")

ABUNDANCE = recursive(ABS + means("a") + ", gram AS (SELECT 0 AS k, p.cls AS i, q.cls AS j, list_dot_product(p.m, q.m) AS v FROM refs p, refs q)" + inverse("gram", 10) + f""",
dots AS (SELECT vec_id, list(list_dot_product(a.v, refs.m) ORDER BY cls) AS d FROM a, refs GROUP BY vec_id)
SELECT vec_id, i::INT AS member, {r6('greatest(list_dot_product(d, m), 0)')} AS share FROM dots, inv""")

TWO = f", t AS (SELECT vec_id, y, x, v[{RED + 1}] AS a, v[{NIR + 1}] AS b FROM e), m AS (SELECT avg(a) AS ma, avg(b) AS mb, covar_samp(a, a) AS c11, covar_samp(a, b) AS c12, covar_samp(b, b) AS c22 FROM t)"
EIGEN = """, lm AS (SELECT *, (c11 + c22) / 2 + sqrt(((c11 - c22) / 2) ** 2 + c12 * c12) AS l1, (c11 + c22) / 2 - sqrt(((c11 - c22) / 2) ** 2 + c12 * c12) AS l2 FROM {0}),
raw AS (SELECT *, c12 / sqrt(c12 * c12 + (l1 - c11) ** 2) AS p1, (l1 - c11) / sqrt(c12 * c12 + (l1 - c11) ** 2) AS q1, c12 / sqrt(c12 * c12 + (l2 - c11) ** 2) AS p2, (l2 - c11) / sqrt(c12 * c12 + (l2 - c11) ** 2) AS q2 FROM lm),
ev AS (SELECT * REPLACE (p1 * s1 AS p1, q1 * s1 AS q1, p2 * s2 AS p2, q2 * s2 AS q2) FROM (SELECT *, CASE WHEN (CASE WHEN abs(q1) > abs(p1) THEN q1 ELSE p1 END) < 0 THEN -1 ELSE 1 END AS s1, CASE WHEN (CASE WHEN abs(q2) > abs(p2) THEN q2 ELSE p2 END) < 0 THEN -1 ELSE 1 END AS s2 FROM raw))"""
PCA2 = E + TWO + EIGEN.format("m") + f" SELECT vec_id, {r6('p1 * (a - ma) + q1 * (b - mb)')} AS s0, {r6('p2 * (a - ma) + q2 * (b - mb)')} AS s1 FROM t, ev"
MNF2 = E + TWO + """, df AS (SELECT a - lag(a) OVER w AS da, b - lag(b) OVER w AS db FROM t WINDOW w AS (PARTITION BY y ORDER BY x)),
ns AS (SELECT covar_samp(da, da) / 2 + 1e-6::DOUBLE AS n11, covar_samp(da, db) / 2 AS n12, covar_samp(db, db) / 2 + 1e-6::DOUBLE AS n22 FROM df WHERE da IS NOT NULL),
ch AS (SELECT 1 / sqrt(n11) AS i11, 1 / sqrt(n22 - n12 * n12 / n11) AS i22, -(n12 / n11) / sqrt(n22 - n12 * n12 / n11) AS i21 FROM ns),
wh AS (SELECT ma, mb, i11, i21, i22, i11 * i11 * c11 AS c11, i11 * (i21 * c11 + i22 * c12) AS c12, i21 * i21 * c11 + 2 * i21 * i22 * c12 + i22 * i22 * c22 AS c22 FROM m, ch)""" + EIGEN.format("wh") + f"""
SELECT vec_id, {r6('(p1 * i11 + q1 * i21) * (a - ma) + q1 * i22 * (b - mb)')} AS s0, {r6('(p2 * i11 + q2 * i21) * (a - ma) + q2 * i22 * (b - mb)')} AS s1 FROM t, ev"""


def rounds(kmeans: int, isodata: int) -> str:
    """Rounds of clustering from the centres c0, one after the other; rounds of ISODATA keep classes of 10 or more."""
    sql = E + LONG.format("e") + ", c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cls, v AS m FROM e ORDER BY vec_id LIMIT 4)"
    for i in range(kmeans + isodata):
        sql += NEAR.format(c=f"c{i}", out=f"n{i}").replace("d2", f"d{i}_") + f", b{i} AS (SELECT cls, band, avg(value) AS m, count(*) AS n FROM l JOIN n{i} USING (vec_id) GROUP BY cls, band)"
        keep = "WHERE n >= 10" if i >= kmeans else ""
        sql += f", c{i + 1} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY cls) - 1 AS cls, list(m ORDER BY band) AS m FROM b{i} {keep} GROUP BY cls)"
    last = kmeans + isodata
    return sql + NEAR.format(c=f"c{last}", out="done").replace("d2", "dd").replace("SELECT vec_id, arg_min(cls, (d, cls)) AS cls FROM", "SELECT vec_id, arg_min(cls, (d, cls))::INT AS cls, min(d) AS d FROM")


def spline() -> str:
    """Twice the size by the cubic spline through the pixels: weights of the pixels around a place, by its fraction."""
    b = lambda d: 2 / 3 - d**2 + d**3 / 2 if d <= 1 else max(0.0, 2 - d) ** 3 / 6
    z = 3**0.5 - 2
    w = [(p, o, sum(b(abs(p - t)) * 3**0.5 * z ** abs(t - o) for t in range(-1, 3))) for p in (0.0, 0.25, 0.75) for o in range(-24, 26)]
    at = lambda t, n: f"least(greatest(({t} + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), {n} - 1)"
    return E + f""", s AS (SELECT max(y) + 1 AS h FROM e), w(p, o, w) AS (VALUES {', '.join(f'({p}::DOUBLE, {o}, {v!r}::DOUBLE)' for p, o, v in w)}),
ry AS (SELECT t, h, {at('t', 'h')} AS u FROM s, unnest(range(0, 2 * h)) AS a(t)), rx AS (SELECT t, {at('t', str(WIDTH))} AS u FROM range(0, {2 * WIDTH}) a(t)),
up AS (SELECT t AS ty, e.x, sum(w * v[1]) AS v FROM ry JOIN w ON w.p = u - floor(u) JOIN e ON e.y = least(greatest(floor(u) + o, 0), h - 1) GROUP BY t, e.x)
SELECT ty::INT AS y, t::INT AS x, {r6('sum(w * v)')} AS v FROM rx JOIN w ON w.p = u - floor(u) JOIN up ON up.x = least(greatest(floor(u) + o, 0), {WIDTH - 1}) GROUP BY ty, t"""


def pan_sharpened(method: str) -> str:
    """Three bands of ten by ten pixels, bilinear on the grid of twenty by twenty, and sharpened."""
    at = lambda t: f"least(greatest(({t} + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), 9)"
    grid = ABS + f""", ms AS (SELECT y, x - 5 AS x, v[{RED + 1}] AS r, v[{GREEN + 1}] AS g, v[{BLUE + 1}] AS b FROM a WHERE x >= 5 AND x < 15 AND y < 10),
t AS (SELECT y, x, list_sum(v) / 64 AS pan, {at('y')} AS fy, {at('x')} AS fx FROM a WHERE x < 20 AND y < 20),
wt AS (SELECT t.y, t.x, any_value(t.pan) AS pan, {', '.join(f'sum((1 - abs(fy - ms.y)) * (1 - abs(fx - ms.x)) * {c}) / sum((1 - abs(fy - ms.y)) * (1 - abs(fx - ms.x))) AS {c}' for c in 'rgb')} FROM t JOIN ms ON abs(fy - ms.y) < 1 AND abs(fx - ms.x) < 1 GROUP BY t.y, t.x)"""
    if method == "brovey":
        return grid + f" SELECT y::INT AS y, x::INT AS x, {', '.join(r6(f'{c} * pan / ({SIM} + 1e-6)') + f' AS {c}' for c in 'rgb')} FROM wt"
    return grid + f""", q AS (SELECT *, {SIM} AS gs FROM wt),
m AS (SELECT avg(pan) AS mp, stddev_pop(pan) AS sp, avg(gs) AS mg, stddev_pop(gs) AS sg, var_pop(gs) AS vg, covar_samp(r, gs) AS cr, covar_samp(g, gs) AS cg, covar_samp(b, gs) AS cb FROM q)
SELECT y::INT AS y, x::INT AS x, {', '.join(r6(f'{c} + c{c} / (vg + 1e-6) * ((pan - mp) / (sp + 1e-6) * sg + mg - gs)') + f' AS {c}' for c in 'rgb')} FROM q, m"""


def resampled(method: str) -> str:
    """Twice the size: each target looks up its neighbours."""
    at = lambda t, n: f"least(greatest(({t} + 0.5::DOUBLE) / 2 - 0.5::DOUBLE, 0), {n} - 1)"
    grid = E + f", s AS (SELECT max(y) + 1 AS h FROM e), t AS (SELECT ty, tx, h FROM s, unnest(range(0, 2 * h)) AS a(ty), unnest(range(0, {2 * WIDTH})) AS b(tx))"
    if method == "nearest":
        return grid + f" SELECT ty::INT AS y, tx::INT AS x, {r6('v[1]')} AS v FROM t JOIN e ON e.y = ty // 2 AND e.x = tx // 2"
    return grid + f""", q AS (SELECT ty, tx, {at('ty', 'h')} AS fy, {at('tx', str(WIDTH))} AS fx FROM t)
SELECT ty::INT AS y, tx::INT AS x, {r6('sum((1 - abs(fy - e.y)) * (1 - abs(fx - e.x)) * v[1])')} AS v FROM q JOIN e ON abs(fy - e.y) < 1 AND abs(fx - e.x) < 1 GROUP BY ty, tx"""




def project(name: str, *steps: str, digits: tuple[int, int] = (3, 8)) -> str:
    """Each step has the columns that come to those before it (vec_id, lat, lon, p and l: radians), the last one x and y. What comes back are the
    degrees themselves."""
    _, lat, lon = SYSTEMS[name]
    out = f"{E}, s AS (SELECT vec_id, {lat}::DOUBLE + 0.04::DOUBLE * (y % 1000 + 0.5::DOUBLE) AS lat, {lon}::DOUBLE + 0.8::DOUBLE * (x + 0.5::DOUBLE) AS lon FROM e), s0 AS (SELECT *, radians(lat) AS p, radians(lon) AS l FROM s)"
    for i, step in enumerate(steps):
        out += f", s{i + 1} AS (SELECT *, {step} FROM s{i})"
    there, back = digits
    return f"{out} SELECT vec_id, round(x, {there}) + 0.0 AS x, round(y, {there}) + 0.0 AS y, round(lat, {back}) + 0.0 AS lat, round(lon, {back}) + 0.0 AS lon FROM s{len(steps)}"


WGS, GRS = (f"(1 / {v}::DOUBLE)" for v in ("298.257223563", "298.257222101"))
SEMI = "6378137::DOUBLE"


def ecc2(f: str) -> str:
    return f"({f} * (2 - {f}))"


def par(deg: str, f: str) -> str:
    """Radius of a parallel, for an equator of 1."""
    return f"(cos(radians({deg}::DOUBLE)) / sqrt(1 - {ecc2(f)} * pow(sin(radians({deg}::DOUBLE)), 2)))"


def iso(p: str, f: str) -> str:
    e = f"sqrt({ecc2(f)})"
    return f"(tan(pi() / 4 - {p} / 2) / pow((1 - {e} * sin({p})) / (1 + {e} * sin({p})), {e} / 2))"


def qq(p: str, f: str) -> str:
    e = f"sqrt({ecc2(f)})"
    return f"((1 - {ecc2(f)}) * (sin({p}) / (1 - {ecc2(f)} * pow(sin({p}), 2)) - ln((1 - {e} * sin({p})) / (1 + {e} * sin({p}))) / (2 * {e})))"


def rad(deg: str) -> str:
    return f"radians({deg}::DOUBLE)"


LAMBERT = project(
    "project_lambert_conic",
    f"ln({par('49', GRS)} / {par('44', GRS)}) / ln({iso(rad('49'), GRS)} / {iso(rad('44'), GRS)}) AS n",
    f"{SEMI} * {par('49', GRS)} / (n * pow({iso(rad('49'), GRS)}, n)) AS big",
    f"big * pow({iso('p', GRS)}, n) AS rho, big * pow({iso(rad('46.5'), GRS)}, n) AS rho0, n * (l - {rad('3')}) AS th",
    "700000 + rho * sin(th) AS x, 6600000 + rho0 - rho * cos(th) AS y",
)
ALBERS = project(
    "project_albers_conic",
    f"(pow({par('29.5', GRS)}, 2) - pow({par('45.5', GRS)}, 2)) / ({qq(rad('45.5'), GRS)} - {qq(rad('29.5'), GRS)}) AS n",
    f"pow({par('29.5', GRS)}, 2) + n * {qq(rad('29.5'), GRS)} AS big",
    f"{SEMI} * sqrt(big - n * {qq('p', GRS)}) / n AS rho, {SEMI} * sqrt(big - n * {qq(rad('23'), GRS)}) / n AS rho0, n * (l + {rad('96')}) AS th",
    "rho * sin(th) AS x, rho0 - rho * cos(th) AS y",
)
POLAR = project("project_polar_stereographic", f"{SEMI} * {par('70', WGS)} * {iso('p', WGS)} / {iso(rad('70'), WGS)} AS rho, l + {rad('45')} AS th", "rho * sin(th) AS x, -rho * cos(th) AS y")
MERCATOR = project("project_web_mercator", f"{SEMI} * l AS x, {SEMI} * asinh(tan(p)) AS y")
# The published series in the third flattening, to its fourth power.
TRANSVERSE = project(
    "project_transverse_mercator",
    f"{WGS} / (2 - {WGS}) AS n, sqrt({ecc2(WGS)}) AS ecc, l - {rad('117')} AS dl",
    "sinh(atanh(sin(p)) - ecc * atanh(ecc * sin(p))) AS t, n / 2 - 2 * pow(n, 2) / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS a1, 13 * pow(n, 2) / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS a2, 61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS a3, 49561 * pow(n, 4) / 161280 AS a4",
    "atan2(t, cos(dl)) AS xi, asinh(sin(dl) / sqrt(t * t + pow(cos(dl), 2))) AS eta, 0.9996::DOUBLE * 6378137::DOUBLE / (1 + n) * (1 + pow(n, 2) / 4 + pow(n, 4) / 64 + pow(n, 6) / 256) AS r",
    "500000 + r * (eta + " + " + ".join(f"a{j} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j in range(1, 5)) + ") AS x, r * (xi + " + " + ".join(f"a{j} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j in range(1, 5)) + ") AS y",
)
# The seven values turned round (the exact inverse of scale and turn by the adjugate), and latitudes by iteration.
AIRY, ARC = "(1 / 299.3249646::DOUBLE)", "(pi() / 648000)"
DATUM = project(
    "datum_shift",
    f"{SEMI} / sqrt(1 - {ecc2(WGS)} * pow(sin(p), 2)) AS nu, 0.15::DOUBLE * {ARC} AS rx, 0.247::DOUBLE * {ARC} AS ry, 0.842::DOUBLE * {ARC} AS rz",
    f"nu * cos(p) * cos(l) - 446.448::DOUBLE AS u, nu * cos(p) * sin(l) + 125.157::DOUBLE AS v, nu * (1 - {ecc2(WGS)}) * sin(p) - 542.06::DOUBLE AS w, (1 + rx * rx + ry * ry + rz * rz) * (1 - 20.489e-6::DOUBLE) AS d",
    "((1 + rx * rx) * u + (rz + rx * ry) * v + (rx * rz - ry) * w) / d AS gx, ((rx * ry - rz) * u + (1 + ry * ry) * v + (rx + ry * rz) * w) / d AS gy, ((ry + rx * rz) * u + (ry * rz - rx) * v + (1 + rz * rz) * w) / d AS gz",
    f"sqrt(gx * gx + gy * gy) AS q, atan2(gz, sqrt(gx * gx + gy * gy) * (1 - {ecc2(AIRY)})) AS f0",
    *(f"atan2(gz + {ecc2(AIRY)} * 6377563.396::DOUBLE / sqrt(1 - {ecc2(AIRY)} * pow(sin(f{i}), 2)) * sin(f{i}), q) AS f{i + 1}" for i in range(6)),
    "degrees(atan2(gy, gx)) AS x, degrees(f6) AS y",
    digits=(8, 6),
)
LAT, LON = geodesy.sql("(500000.0::DOUBLE + 10 * (x + 0.5::DOUBLE))", "(3500000.0::DOUBLE - 10 * (y + 0.5::DOUBLE))", 50)
LIB = "WITH lib AS (SELECT name, unnest(range(400, 2501))::DOUBLE AS wl, unnest(r) AS r FROM (VALUES " + ", ".join(f"('{n}', {[float(v) for v in curve]!r}::DOUBLE[])" for n, _, curve in library.curves()) + ") t(name, r))"
# Spectra by key against the library: brackets of its grid on the bands' axis, then sums over the grid.
MATCH = ABS + LONG.format("a") + LIB.replace("WITH lib", ", lib") + f""", pt AS (SELECT {{0}} AS k, ({AXIS!r}::DOUBLE[])[band + 1] AS wl, avg(value) AS v FROM l GROUP BY ALL),
br AS (SELECT t.wl, (SELECT max(w) FROM unnest({AXIS!r}::DOUBLE[]) u(w) WHERE w <= t.wl) AS w0, (SELECT min(w) FROM unnest({AXIS!r}::DOUBLE[]) u(w) WHERE w >= t.wl) AS w1 FROM (SELECT DISTINCT wl FROM lib) t WHERE t.wl <= 2400),
q AS (SELECT p0.k, br.wl, CASE WHEN w0 = w1 THEN p0.v ELSE p0.v + (p1.v - p0.v) * (br.wl - w0) / (w1 - w0) END AS q FROM br JOIN pt p0 ON p0.wl = w0 JOIN pt p1 ON p1.wl = w1 AND p1.k = p0.k),
m AS (SELECT k, name, degrees(acos(least(greatest(sum(q * r) / (sqrt(sum(q * q)) * sqrt(sum(r * r))), -1), 1))) AS angle FROM lib JOIN q USING (wl) GROUP BY k, name)"""
SHARP = ABS + f", p AS (SELECT vec_id, v[{RED + 1}] AS r, v[{GREEN + 1}] AS g, v[{BLUE + 1}] AS b, list_sum(v) / 64 AS pan FROM a)"
SIM = "(r * (1.0::DOUBLE / 3) + g * (1.0::DOUBLE / 3) + b * (1.0::DOUBLE / 3))"

ORACLES: dict[str, str] = {
    "pixel_to_geo": f"{E} SELECT vec_id, {r6('500000.0::DOUBLE + 10 * (x + 0.5::DOUBLE)')} AS gx, {r6('3500000.0::DOUBLE - 10 * (y + 0.5::DOUBLE)')} AS gy FROM e",
    "utm_to_wgs84": f"{E} SELECT vec_id, {r6(LAT)} AS lat, {r6(LON)} AS lon FROM e",
    "project_transverse_mercator": TRANSVERSE,
    "project_lambert_conic": LAMBERT,
    "project_albers_conic": ALBERS,
    "project_polar_stereographic": POLAR,
    "project_web_mercator": MERCATOR,
    "datum_shift": DATUM,
    "band_subset": f"{E} SELECT vec_id, {r6('v[5]')} AS b0, {r6('v[3]')} AS b1, {r6('v[1]')} AS b2 FROM e",
    "spatial_subset": f"{E} SELECT (y - 3)::INT AS y, (x - 5)::INT AS x, {r6('v[1]')} AS v FROM e WHERE x >= 5 AND x < 15 AND y >= 3 AND y < 12",
    "band_match": f"""WITH bands AS (SELECT max(len(embedding)) AS n FROM embeddings), axis AS (SELECT i::INT AS band, 400.0::DOUBLE + i * (2000.0::DOUBLE / (n - 1)) AS wl FROM bands, range(n) t(i)),
w(target, aim) AS (VALUES ('blue', 480.0::DOUBLE), ('green', 550.0::DOUBLE), ('red', 660.0::DOUBLE), ('nir', 840.0::DOUBLE), ('swir2', 2200.0::DOUBLE))
SELECT target, arg_min(band, (abs(wl - aim), band)) AS band, {r6('arg_min(wl, (abs(wl - aim), band))')} AS wl FROM axis, w WHERE abs(wl - aim) < 350 GROUP BY target""",
    "overview": f"{E}, s AS (SELECT greatest(1, greatest({WIDTH}, max(y) + 1) // 10) AS step FROM e) SELECT vec_id, {r6('v[1]')} AS v FROM e, s WHERE y % step = 0 AND x % step = 0",
    "display_pyramid": f"{E}, lv AS (SELECT k::INT AS k FROM range(1, 31) r(k), (SELECT max(y) + 1 AS h FROM e) WHERE greatest(h, {WIDTH}) > 4 * 2 ** (k - 1)) SELECT k AS level, y >> k AS y, x >> k AS x, count(*) AS n, {r6(f'avg(v[{RED + 1}])')} AS red, {r6(f'avg(v[{NIR + 1}])')} AS nir FROM e, lv GROUP BY ALL",
    "bandmath_ratio": items("CASE WHEN b2 / 1000 + b3 = 0 THEN 0 ELSE (b1 - b4) / (b2 / 1000 + b3) END + CASE WHEN b3 = 0 THEN 0 ELSE b1 / b3 END"),
    "bandmath_logical": items(f"{flag('10 < b1 AND b1 <= 30')} + {flag('b1 > 25 AND b3 < 0.05::DOUBLE')} + {flag('b3 = 0 OR b4 > 0.05::DOUBLE')} + {flag('NOT b4 >= 0.04::DOUBLE')} + {flag('b1 <> 17')}"),
    "bandmath_global": items("(b2 - lo) / (hi - lo) + (b1 - m) / sd + b2 / md + b3 / sm", ", st AS (SELECT min(b2) AS lo, max(b2) AS hi, avg(b1) AS m, stddev_pop(b1) AS sd, quantile_cont(b2, 0.5) AS md, sum(b3) AS sm FROM li)", source="li, st"),
    "bandmath_casts": items(f"{trunc('b2 / 7')} + {trunc(clip('b1 * 9', 0, 255))} + {trunc(clip('b2', 0, 65535))} + round_even(b1 / 4, 0) + {trunc('0 - b1 / 3')}"),
    "bandmath_where": items("CASE WHEN b1 > m THEN least(greatest(b2, 1000), 50000) ELSE greatest(b1, b4 * 100) END + least(b1, 20)", ", st AS (SELECT avg(b1) AS m FROM li)", source="li, st"),
    "bandmath_trig": items(f"sin(b1) + cos(b3) + tan(b4) + asin({clip('b3 * 20')}) + acos({clip('b4')}) + atan(b2) + atan2(b1, b2) + sqrt(greatest(b2, 0)) + exp(b3) + ln(greatest(b1, 1e-7)) + log10(greatest(b2, 1e-7)) + abs(-b1) + sign(b4 - 0.04::DOUBLE) + floor(b3 * 100) + ceil(b4 * 100) + pow(b1, 2)"),
    "ndvi": index("ndvi", "(nir - red) / (nir + red + 1e-6)"),
    "ndwi": index("ndwi", "(green - nir) / (green + nir + 1e-6)"),
    "evi": index("evi", "2.5::DOUBLE * CASE WHEN nir + 6 * red - 7.5::DOUBLE * blue + 1 + 1e-6 = 0 THEN 0 ELSE (nir - red) / (nir + 6 * red - 7.5::DOUBLE * blue + 1 + 1e-6) END"),
    "savi": index("savi", "(nir - red) / (nir + red + 0.5::DOUBLE + 1e-6) * 1.5::DOUBLE"),
    "nbr": index("nbr", "(nir - swir) / (nir + swir + 1e-6)"),
    "rgb_to_hsv": f"{RGB} SELECT vec_id, {r6('h')} AS h, {r6('s')} AS s, {r6('v')} AS v FROM hsv",
    "hsv_to_rgb": f"{RGB} SELECT vec_id, {r6('r')} AS r, {r6('g')} AS g, {r6('b')} AS b FROM hsv",
    "luminance": f"{RGB} SELECT vec_id, {r6('0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b')} AS gray FROM rgb",
    "band_stats": f"{ITEM_BANDS} SELECT band, count(v) AS n, {r6('min(v)')} AS min_v, {r6('max(v)')} AS max_v, {r6('avg(v)')} AS mean_v, {r6('stddev_pop(v)')} AS std_v FROM ib GROUP BY band",
    "cube_statistics": E + LONG.format("e") + f" SELECT band::INT AS band, count(value) AS n, {r6('min(value)')} AS min_v, {r6('max(value)')} AS max_v, {r6('avg(value)')} AS mean_v, {r6('stddev_pop(value)')} AS std_v FROM l GROUP BY band",
    "band_report": f"{ITEM_BANDS} SELECT 'Band ' || (band + 1) AS \"Band\", printf('%.6f', min(v)) AS \"Min\", printf('%.6f', max(v)) AS \"Max\", printf('%.6f', avg(v)) AS \"Mean\", printf('%.6f', stddev_pop(v)) AS \"StdDev\", count(v) AS \"PixelCount\" FROM ib GROUP BY band",
    "band_histogram": f"{ITEM_BANDS}, st AS (SELECT band, min(v) AS lo, max(v) AS hi FROM ib GROUP BY band) SELECT band, least(floor((v - lo) / (hi - lo) * 100), 99)::INT AS bin, count(*) AS n FROM ib JOIN st USING (band) GROUP BY 1, 2",
    "stretch_linear2": stretched(PERCENT.format("0.02", "0.98"), "(b2 - lo) / (hi - lo)"),
    "stretch_linear5": stretched(PERCENT.format("0.05", "0.95"), "(b2 - lo) / (hi - lo)"),
    "stretch_gaussian": stretched("avg(b2) - 3 * stddev_pop(b2) AS lo, avg(b2) + 3 * stddev_pop(b2) AS hi", "(b2 - lo) / (hi - lo)"),
    "stretch_minmax": stretched("min(b2) AS lo, max(b2) AS hi", "(b2 - lo) / (hi - lo)"),
    "stretch_uint8": f"{LI}, st AS (SELECT {PERCENT.format('0.02', '0.98')} FROM li) SELECT l_orderkey, l_linenumber, floor({clip('(b2 - lo) / (hi - lo)', 0, 1)} * 255)::INT AS u8 FROM li, st",
    "stretch_equalize": f"""{LI}, st AS (SELECT min(b2) AS lo, max(b2) AS hi, count(*) AS n FROM li),
hb AS (SELECT least(floor((b2 - lo) / (hi - lo) * 256), 255)::INT AS bin, count(*) AS c FROM li, st GROUP BY 1),
cdf AS (SELECT list(c ORDER BY i) AS c FROM (SELECT i, sum(coalesce(hb.c, 0)) OVER (ORDER BY i) / (SELECT n FROM st) AS c FROM range(256) r(i) LEFT JOIN hb ON hb.bin = i)),
p AS (SELECT l_orderkey, l_linenumber, c, least(greatest((b2 - lo) / ((hi - lo) / 256) - 0.5::DOUBLE, 0), 255) AS place FROM li, st, cdf),
q AS (SELECT *, least(floor(place), 254)::INT AS low FROM p)
SELECT l_orderkey, l_linenumber, {r6('least(greatest(c[low + 1] + (c[low + 2] - c[low + 1]) * (place - low), 0), 1)')} AS s FROM q""",
    "roi_bbox_stats": f"{E} SELECT count(*) AS n, {r6('min(v[1])')} AS min_v, {r6('max(v[1])')} AS max_v, {r6('avg(v[1])')} AS mean_v, {r6('stddev_pop(v[1])')} AS std_v FROM e WHERE {box('a')}",
    "roi_polygon_mask": f"{E} SELECT vec_id, {polygon('x', 'y')} AS inside FROM e",
    "roi_multiband": E + LONG.format("e") + " " + " UNION ALL ".join(f"SELECT '{n}' AS roi, band, count(*) AS n, {r6('avg(value)')} AS mean_v, {r6('stddev_pop(value)')} AS std_v FROM l WHERE {box(n)} GROUP BY band" for n in BOXES),
    "roi_mean_spectrum": E + LONG.format("e") + f" SELECT band, {r6('avg(value)')} AS mean_v FROM l WHERE {polygon('x', 'y')} GROUP BY band",
    "roi_coastline": E + f""", h AS (SELECT max(y) + 1 AS h FROM e), n AS (SELECT max(o_orderkey) + 1 AS n FROM orders),
v AS (SELECT o_orderkey AS pos, o_orderkey * {float(WIDTH)}::DOUBLE / n::DOUBLE AS vx, o_totalprice * h::DOUBLE / 500000.0::DOUBLE AS vy FROM orders, n, h
  UNION ALL SELECT n, {float(WIDTH)}::DOUBLE, h + 1.0::DOUBLE FROM n, h UNION ALL SELECT n + 1, 0.0::DOUBLE, h + 1.0::DOUBLE FROM n, h),
g AS (SELECT vx AS x0, vy AS y0, coalesce(lead(vx) OVER w, first_value(vx) OVER w) AS x1, coalesce(lead(vy) OVER w, first_value(vy) OVER w) AS y1 FROM v WINDOW w AS (ORDER BY pos)),
i AS (SELECT vec_id FROM e JOIN g ON (y < y0) <> (y < y1) AND x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0)) GROUP BY vec_id HAVING count(*) % 2 = 1)
SELECT vec_id, i.vec_id IS NOT NULL AS inside FROM e LEFT JOIN i USING (vec_id)""",
    "roi_of_orders": E + f""", h AS (SELECT max(y) + 1 AS h FROM e),
v AS (SELECT l_orderkey, l_quantity / 2.0::DOUBLE AS vx, l_extendedprice * h::DOUBLE / 100000.0::DOUBLE AS vy, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem, h),
g AS (SELECT l_orderkey, vx AS x0, vy AS y0, coalesce(lead(vx) OVER w, first_value(vx) OVER w) AS x1, coalesce(lead(vy) OVER w, first_value(vy) OVER w) AS y1 FROM v WHERE c > 2
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, vx, vy)),
i AS (SELECT l_orderkey, vec_id, any_value(v[1]) AS value FROM e JOIN g ON (y < y0) <> (y < y1) AND x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0)) GROUP BY l_orderkey, vec_id HAVING count(*) % 2 = 1)
SELECT l_orderkey, count(*) AS n, {r6('min(value)')} AS min_v, {r6('max(value)')} AS max_v, {r6('avg(value)')} AS mean_v FROM i GROUP BY l_orderkey""",
    "roi_mask_layer": f"{E} SELECT y, x, CASE WHEN {box('c')} THEN 255 ELSE 0 END AS mask FROM e",
    "scene_mean_spectrum": E + LONG.format("e") + f" SELECT band, {r6('avg(value)')} AS mean_v FROM l GROUP BY band",
    "sam_classify": f"{SAM} SELECT vec_id, cls::INT AS cls, {r6('score')} AS score FROM best",
    "sam_rules": f"{SAM} SELECT vec_id, cls::INT AS cls, {r6('angle')} AS angle FROM ang",
    "sam_threshold": f"{SAM} SELECT vec_id, CASE WHEN score <= 1.2::DOUBLE THEN cls ELSE -1 END::INT AS cls FROM best",
    "sid_classify": f"{SID} SELECT vec_id, arg_min(cls, (d, cls))::INT AS cls, {r6('min(d)')} AS score FROM dv GROUP BY vec_id",
    "kmeans_step": f"{NEW} SELECT cls::INT AS cls, band, {r6('m')} AS centre FROM nb",
    "isodata_prune": NEW + ", c1 AS (SELECT row_number() OVER (ORDER BY cls) - 1 AS cls, m FROM (SELECT cls, list(m ORDER BY band) AS m FROM nb GROUP BY cls HAVING min(n) >= 10))" + NEAR.format(c="c1", out="n1").replace("d2 ", "d3 ").replace("FROM d2", "FROM d3") + " SELECT vec_id, cls::INT AS cls FROM n1",
    "thematic_rgb": f"""{E}, pal AS (SELECT {[list(c) for c in PALETTE]!r} AS p),
c AS (SELECT vec_id, CASE WHEN label - 1 < 0 THEN [0, 0, 0] ELSE p[(label - 1) % 10 + 1] END AS c FROM e, pal) SELECT vec_id, c[1]::INT AS r, c[2]::INT AS g, c[3]::INT AS b FROM c""",
    "library_match": MATCH.format("0") + f" SELECT name, {r6('angle')} AS angle FROM m",
    "library_identify": MATCH.format("vec_id") + f" SELECT k AS vec_id, arg_min(name, (angle, name)) AS name, {r6('min(angle)')} AS angle FROM m GROUP BY k",
    "spectrum_resample": E + LONG.format("e") + f""", pts AS (SELECT vec_id, ({AXIS!r})[band + 1] AS wl, value FROM l), t(wl) AS (VALUES {', '.join(f'({w}::DOUBLE)' for w in TARGETS)}),
br AS (SELECT t.wl, (SELECT max(w) FROM unnest({AXIS!r}) u(w) WHERE w <= t.wl) AS w0, (SELECT min(w) FROM unnest({AXIS!r}) u(w) WHERE w >= t.wl) AS w1 FROM t)
SELECT k.vec_id, br.wl, {r6('CASE WHEN w0 = w1 THEN p0.value ELSE p0.value + (p1.value - p0.value) * (br.wl - w0) / (w1 - w0) END')} AS value
FROM (SELECT vec_id FROM e) k CROSS JOIN br LEFT JOIN pts p0 ON p0.vec_id = k.vec_id AND p0.wl = w0 LEFT JOIN pts p1 ON p1.vec_id = k.vec_id AND p1.wl = w1""",
    "confusion_matrix": f"{CONFUSION} SELECT ref, pred, n FROM cm",
    "confusion_cube": f"{SAM} SELECT label AS ref, pred, count(*) AS n FROM best GROUP BY CUBE (label, pred)",
    "accuracy_metrics": f"""{MARGINS}, k AS (SELECT sum(hit)::DOUBLE / sum(rn) AS po, sum(rn::DOUBLE * pn) / (sum(rn)::DOUBLE * sum(rn)) AS pe FROM mg)
SELECT {r6('po * 100')} AS oa, {r6('CASE WHEN pe >= 1 THEN 1 ELSE (po - pe) / (1 - pe) END')} AS kappa FROM k""",
    "producer_user_accuracy": f"{MARGINS} SELECT cls, {r6('CASE WHEN rn = 0 THEN 0 ELSE hit * 100.0::DOUBLE / rn END')} AS pa, {r6('CASE WHEN pn = 0 THEN 0 ELSE hit * 100.0::DOUBLE / pn END')} AS ua FROM mg",
    "label_confusion": "SELECT quality AS ref, toxic AS pred, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality, toxic",
    "covariance": f"{E}{cov_table('e')}",
    "mnf_noise_cov": DIFFERENCES + cov_table("s", " * 0.5"),
    "pca_scores": PCA2,
    "pca_energy": E + LONG.format("e") + f", mb AS (SELECT band, avg(value) AS m FROM l GROUP BY band) SELECT vec_id, {r6('sum((value - m) * (value - m))')} AS energy FROM l JOIN mb USING (band) GROUP BY vec_id",
    "mnf_scores": MNF2,
    "mlc_classify": MLC,
    "svm_separable": f"{E} SELECT vec_id, CASE WHEN v[1] > 0 THEN 2 ELSE 1 END::INT AS cls FROM e WHERE abs(v[1]) > 0.05::DOUBLE",
    "ica_covariance": "SELECT i::INT AS i, j::INT AS j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM range(3) a(i), range(3) b(j) WHERE i <= j",
    "sff_residuals": ABS + means("a") + """, p AS (SELECT cls, m, list_dot_product(m, m) AS mm FROM refs WHERE cls < 2), k AS (SELECT count(*) FILTER (x % 5 < 4) AS many, count(*) AS n FROM e),
c AS (SELECT sqrt(greatest(a.mm * b.mm - list_dot_product(a.m, b.m) ** 2, 0) / (a.mm * b.mm)) AS off FROM p a, p b WHERE a.cls = 0 AND b.cls = 1)
SELECT """ + r6("m[1]") + " AS first, " + r6("off * (n - many) / n") + """ AS residual FROM p, c, k WHERE cls = 1""",
    "resize_average_uneven": E + f""", h AS (SELECT max(y) + 1 AS h FROM e), g AS (SELECT i::INT AS gy, j::INT AS gx, (i + 0.5) * h / 6 AS cy, (j + 0.5) * {WIDTH} / 10 AS cx, h / 12 AS ry, {WIDTH} / 20 AS rx FROM range(6) a(i), range(10) b(j), h),
w AS (SELECT gy, gx, v, greatest(0, least(y + 1, cy + ry) - greatest(y, cy - ry)) * greatest(0, least(x + 1, cx + rx) - greatest(x, cx - rx)) AS w FROM e, g)
SELECT gy AS y, gx AS x, {r6('sum(w * v[1]) / sum(w)')} AS v0, {r6('sum(w * v[64]) / sum(w)')} AS v63 FROM w GROUP BY gy, gx""",
    "sff_pure": ABS + means("a") + f", top AS (SELECT row_number() OVER (ORDER BY m) - 1 AS member, m FROM refs WHERE cls < 3), u AS (SELECT member, unnest(m) AS v, generate_subscripts(m, 1) - 1 AS band FROM top) SELECT member::INT AS member, band::INT AS band, {r6('v')} AS v FROM u",
    "kmeans_full": rounds(10, 0) + f" SELECT vec_id, cls, {r6('d')} AS score FROM done",
    "isodata_full": rounds(5, 10) + " SELECT vec_id, cls FROM done",
    "resample_cubic": spline(),
    "pan_sharpen_brovey": pan_sharpened("brovey"),
    "pan_sharpen_gram_schmidt": pan_sharpened("gram_schmidt"),
    "raster_accuracy": f"{E}, f AS (SELECT y, x, label FROM e WHERE x < 20 AND y < 20), c AS (SELECT y, x - 15 AS x, label FROM e WHERE x >= 15 AND y < 10) SELECT c.label::INT AS ref, f.label::INT AS pred, count(*) AS n FROM f JOIN c ON c.y = f.y // 2 AND c.x = f.x // 2 GROUP BY c.label, f.label",
    "warp_average": f"{E} SELECT (y // 2)::INT AS y, (x // 2)::INT AS x, {r6('avg(v[1])')} AS v0, {r6('avg(v[2])')} AS v1 FROM e WHERE x < 20 AND y < 20 GROUP BY y // 2, x // 2",
    "pca_variance": E + LONG.format("e") + f" SELECT {r6('sum(s)')} AS variance FROM (SELECT var_samp(value) AS s FROM l GROUP BY band)",
    "abundance": ABUNDANCE,
    "continuum": CONTINUUM,
    "toa_reflectance": items("CASE WHEN b1 * 200 > 0 THEN b1 * 200 * 2e-5 + -0.1::DOUBLE ELSE 0 END", out="rho"),
    "toa_radiance": items("CASE WHEN b1 * 200 > 0 THEN b1 * 200 * 0.5::DOUBLE + 10 ELSE 0 END", out="rho"),
    "dos1": items("CASE WHEN b1 > 0 THEN greatest(0, b1 * 200 * 2e-5 + -0.1::DOUBLE - p) ELSE 0 END", ", st AS (SELECT quantile_cont(r, 0.01::DOUBLE) AS p FROM (SELECT b1 * 200 * 2e-5 + -0.1::DOUBLE AS r FROM li WHERE b1 > 0) WHERE r > 0)", "rho", "li, st"),
    "layer_stack": f"""{LI}, g AS (SELECT l_orderkey, sum(b1) AS q, avg(b2) AS p FROM li GROUP BY l_orderkey)
SELECT coalesce(o_orderkey, l_orderkey)::BIGINT AS o_orderkey, {r6('o_totalprice::DOUBLE')} AS b0, {r6('q')} AS b1, {r6('p')} AS b2 FROM orders FULL JOIN g ON o_orderkey = l_orderkey""",
    "resample_nearest": resampled("nearest"),
    "resample_bilinear": resampled("bilinear"),
    "subset_resize": f"""{E}, c AS (SELECT y - 2 AS y, x - 4 AS x, v FROM e WHERE x >= 4 AND x < 14 AND y >= 2 AND y < 12),
t AS (SELECT ty, tx, (ty + 0.5::DOUBLE) * 2 - 0.5::DOUBLE AS fy, (tx + 0.5::DOUBLE) * 2 - 0.5::DOUBLE AS fx FROM range(5) a(ty), range(5) b(tx)),
w AS (SELECT ty, tx, (1 - abs(fy - y)) * (1 - abs(fx - x)) AS w, v FROM t JOIN c ON abs(fy - y) < 1 AND abs(fx - x) < 1)
SELECT ty::INT AS y, tx::INT AS x, {r6('sum(w * v[1])')} AS v0, {r6('sum(w * v[8])')} AS v1 FROM w GROUP BY ty, tx""",
    "mosaic_grid": f"{E} SELECT 25::INT AS width, (max(y) + 1)::INT AS height, 500000.0::DOUBLE AS x_origin, 3500000.0::DOUBLE AS y_origin FROM e",
    "mosaic_feather": f"""{E}, s AS (SELECT max(y) + 1 AS h FROM e),
f AS (SELECT y, x, v, least(greatest(least(y + 0.5::DOUBLE, h - y - 0.5::DOUBLE) / 4, 0), 1) AS wy, CASE WHEN x < 20 THEN least(greatest(least(x + 0.5::DOUBLE, 20 - x - 0.5::DOUBLE) / 4, 0), 1) ELSE 0 END AS wa,
  CASE WHEN x >= 5 THEN least(greatest(least(x - 5 + 0.5::DOUBLE, 25 - x - 0.5::DOUBLE) / 4, 0), 1) ELSE 0 END AS wb FROM e, s)
SELECT y, x, {r6('(wy * wa * v[1] + wy * wb * v[2]) / (wy * wa + wy * wb)')} AS v FROM f""",
    "brovey": f"{SHARP} SELECT vec_id, {', '.join(r6(f'{c} * pan / ({SIM} + 1e-6)') + f' AS {c}' for c in 'rgb')} FROM p",
    "gram_schmidt": f"""{SHARP}, g AS (SELECT *, {SIM} AS gs FROM p),
m AS (SELECT avg(pan) AS mp, stddev_pop(pan) AS sp, avg(gs) AS mg, stddev_pop(gs) AS sg, var_pop(gs) AS vg, covar_samp(r, gs) AS cr, covar_samp(g, gs) AS cg, covar_samp(b, gs) AS cb FROM g)
SELECT vec_id, {', '.join(r6(f'{c} + c{c} / (vg + 1e-6) * ((pan - mp) / (sp + 1e-6) * sg + mg - gs)') + f' AS {c}' for c in 'rgb')} FROM g, m""",
    "stream_statistics": f"SELECT event_type, count(value) AS n, {r6('min(value)')} AS min_v, {r6('max(value)')} AS max_v, {r6('avg(value)')} AS mean_v, {r6('stddev_pop(value)')} AS std_v FROM events GROUP BY event_type",
}
