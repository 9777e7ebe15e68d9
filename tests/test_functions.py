"""Scalar functions and stretches against closed-form values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.functions import color, indices, stretch
from bandloom.functions.bandmath import band_math, bind, names_in
from bandloom.plans.quantile import quantiles


def one(spark, columns, **values):
    row = spark.createDataFrame([tuple(float(v) for v in values.values())], list(values)).select(*(c.alias(f"o{i}") for i, c in enumerate(columns))).first()
    return list(row)


def test_indices(spark):
    n, r, g, b, s = (F.col(c) for c in ("n", "r", "g", "b", "s"))
    got = one(spark, [indices.ndvi(n, r), indices.ndwi(g, n), indices.evi(n, r, b), indices.savi(n, r), indices.nbr(n, s)], n=0.8, r=0.1, g=0.3, b=0.05, s=0.05)
    assert got[0] == pytest.approx(0.7777, abs=1e-3)
    assert got == pytest.approx([0.7 / 0.9, -0.5 / 1.1, min(1, 2.5 * 0.7 / (0.8 + 0.6 - 0.375 + 1)), 0.7 / 1.4 * 1.5, 0.75 / 0.85], abs=1e-5)
    assert np.isnan(one(spark, [indices.ndvi(n, r)], n=float("nan"), r=0.1)[0])


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        ("(b1-b2)/b3", 1.6), ("sqrt(b1*10.0)+exp(0.0)", 11), ("min(b1)", 10), ("max(b1,b2)", 10), ("1.0/b1", 0.1), ("(b1>5)*b2", 2), ("1 < b2 < 3", 1),
        ("b1/0", 0), ("fix(2.7)", 2), ("fix(-2.7)", -2), ("byte(300)", 255), ("byte(-5)", 0), ("uint(70000)", 65535), ("uint(-1)", 0), ("round(2.5)", 2),
        ("b1 > 5 and b2 > 5", 0), ("b1 > 5 or b2 > 5", 1), ("~b1", 0), ("B1 + 1 - 1", 10), ("log(0)", np.log(1e-7)), ("mean(b1 * 2 - mean(b1))", 10),
    ],
)
def test_band_math(spark, expression, want):
    df = spark.createDataFrame([(10.0, 2.0, 5.0)], "b1 double, b2 double, b3 double")
    assert band_math(df, expression, {b: F.col(b) for b in ("b1", "b2", "b3")}).first().result == pytest.approx(want)


@pytest.mark.parametrize("bad", ["__import__('os')", "b9", "b1 % 2", "b1 // 2", "'x'", "b1.real", "[b1]", "lambda: 1", "not b1", "pi", "e * b1", "f(b1)", "b1 +", "(lambda x: x)(b1)"])
def test_band_math_refuses(spark, bad):
    df = spark.createDataFrame([(1.0,)], "b1 double")
    with pytest.raises(ValueError):
        band_math(df, bad, {"b1": F.col("b1")})


def test_band_math_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([(nan,), (5.0,), (7.0,)], "b double")
    out = lambda e: [r[0] for r in band_math(df, e, {"b": F.col("b")}).select("result").collect()]
    for f in ("fix", "int", "long", "byte", "uint"):
        got = out(f"{f}(b)")
        assert np.isnan(got[0]) and got[1:] == [5, 7]
    assert out("b > 3") == [0, 1, 1]
    assert out("b != 5") == [1, 0, 1]
    assert out("mean(b)") == [6, 6, 6]
    assert np.isnan(out("clip(b, -1, 1)")[0]) and np.isnan(out("min(b, 3)")[0])
    assert out("where(b, 1, 0)")[0] == 1


def test_binding(spark):
    assert names_in("float(b1) + Red * sin(NIR)") == ["b1", "Red", "NIR"]
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "spectrum array<double>")
    e = "b3 - red"
    assert band_math(df, e, bind(e, "spectrum", ["Blue", "Red band", "NIR"])).first().result == 1
    with pytest.raises(ValueError):
        bind("swir", "spectrum", ["Blue"])


def test_colour_round_trip(spark):
    rows = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 1.0), (0.2, 0.7, 0.4), (0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "r double, g double, b double")
    h, s, v = color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    hsv = df.select(h.alias("h"), s.alias("s"), v.alias("v"))
    assert list(hsv.first()) == [0, 1, 1]
    back = hsv.select(*color.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"))).collect()
    assert np.allclose([list(r) for r in back], rows)
    scaled = color.unit_scaled(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, flat double"), ["a", "flat"]).collect()
    assert [tuple(r) for r in scaled] == [(0, 0), (1, 0)]


def column(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")


def stretched(df):
    return [r.s for r in df.orderBy("i").collect()]


def test_stretches(spark):
    v = np.linspace(10, 500, 100)
    df = column(spark, v)
    lo, hi = np.percentile(v, [2, 98])
    assert np.allclose(stretched(stretch.linear_percent(df, "v")), np.clip((v - lo) / (hi - lo), 0, 1))
    assert stretched(stretch.min_max(df, "v"))[::99] == [0, 1]
    m, d = v.mean(), 3 * v.std()
    assert np.allclose(stretched(stretch.gaussian(df, "v")), np.clip((v - m + d) / (2 * d), 0, 1))
    hist, edges = np.histogram(v, 256)
    want = np.interp(v, (edges[:-1] + edges[1:]) / 2, hist.cumsum() / 100)
    assert np.allclose(stretched(stretch.equalize(df, "v")), want)
    u8 = [r.u8 for r in stretch.stretch(df, "v", "No Stretch").orderBy("i").collect()]
    assert (min(u8), max(u8)) == (0, 255)


def test_stretch_edges(spark):
    nan = float("nan")
    for f in (stretch.linear_percent, stretch.gaussian, stretch.min_max, stretch.equalize):
        assert stretched(f(column(spark, [nan, nan]), "v")) == [0, 0]
        got = stretched(f(column(spark, [nan, -9999, 1, 2, 3]), "v", nodata=-9999.0))
        assert got[:2] == [0, 0] and all(0 <= x <= 1 for x in got)
    assert stretched(stretch.min_max(column(spark, [7, 7]), "v")) == [0, 0]


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    for v in (rng.normal(size=5000), rng.integers(0, 7, 3000), [5.0], [1.0, 1e-300, 1e300], np.repeat([1.0, 1.0 + 2**-52], 50)):
        got = quantiles(column(spark, v), "v", [0, 0.013, 0.02, 0.5, 0.98, 1])
        assert np.allclose(got, np.quantile(np.asarray(v, float), [0, 0.013, 0.02, 0.5, 0.98, 1]), rtol=1e-12)
    assert quantiles(column(spark, [float("nan")]), "v", [0.5]) is None
