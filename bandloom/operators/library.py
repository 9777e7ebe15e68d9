"""The reference library of spectra, and matching against it.

Entries are closed-form curves on one grid, 400 to 2500 nm by 1 nm: twenty rows, always small enough to send along.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from bandloom.plans import num
from bandloom.plans.num import lit

GRID = np.arange(400.0, 2501.0)

# The parameters of the library's curves.
# Vegetation: (red edge in nm, near-infrared level, dryness)
VEGETATION = {
    "Green Vegetation": (700.0, 0.52, 0.0),
    "Mature Leaf": (720.0, 0.58, 0.0),
    "Conifer Needles": (760.0, 0.40, 0.0),
    "Dry Grass": (700.0, 0.42, 0.75),
    "Senescent Foliage": (700.0, 0.40, 1.0),
}
PIGMENT = [(400.0, 0.10), (450.0, 0.06), (500.0, 0.10), (550.0, 0.30), (600.0, 0.15), (650.0, 0.07), (690.0, 0.10)]
LEAF_BANDS = [(1400.0, 90.0, 0.60), (1900.0, 80.0, 0.62), (2300.0, 70.0, 0.28), (2100.0, 50.0, 0.10)]
DRY_LEAF = [(400, 0.14), (700, 0.26), (1100, 0.30), (1400, 0.22), (1900, 0.16), (2500, 0.20)]
EDGE_WIDTH = 22.0
# Soils and rocks: (base level, slope, absorption bands of centre, width, depth)
SOIL = {
    "Dry Sand": (0.30, 0.25, [(1400.0, 70.0, 0.15), (1900.0, 90.0, 0.22)]),
    "Loam": (0.24, 0.15, [(1400.0, 80.0, 0.28), (1900.0, 95.0, 0.36)]),
    "Wet Soil": (0.16, 0.10, [(1400.0, 80.0, 0.45), (1900.0, 95.0, 0.55)]),
    "Red Soil (Ferric)": (0.27, 0.20, [(900.0, 110.0, 0.30), (1900.0, 90.0, 0.30)]),
}
ROCK = {
    "Granite": (0.32, 0.18, [(1400.0, 75.0, 0.12), (2200.0, 80.0, 0.15)]),
    "Basalt": (0.18, 0.12, [(1400.0, 75.0, 0.14), (2200.0, 80.0, 0.18)]),
    "Limestone": (0.45, 0.10, [(1400.0, 90.0, 0.10), (1900.0, 100.0, 0.30), (2300.0, 70.0, 0.22)]),
    "Dolomite": (0.38, 0.12, [(1400.0, 90.0, 0.12), (1900.0, 100.0, 0.18), (2300.0, 70.0, 0.15)]),
    "Hematite": (0.18, 0.05, [(880.0, 60.0, 0.45), (660.0, 50.0, 0.25), (1900.0, 90.0, 0.25)]),
    "Kaolinite": (0.42, 0.10, [(1400.0, 70.0, 0.32), (2200.0, 60.0, 0.40)]),
    "Calcite": (0.48, 0.08, [(1400.0, 80.0, 0.14), (1900.0, 95.0, 0.28), (2350.0, 45.0, 0.45)]),
}
# Water, snow and ice: control points
WATER = {
    "Clear Water": [(400, 0.045), (600, 0.032), (700, 0.012), (900, 0.004), (1200, 0.001), (2500, 0.0)],
    "Turbid Water": [(400, 0.115), (600, 0.095), (700, 0.072), (800, 0.058), (1000, 0.040), (1400, 0.020), (1900, 0.010), (2500, 0.005)],
}
SNOW = {
    "Dry Snow": [(400, 0.80), (600, 0.86), (800, 0.88), (1100, 0.87), (1400, 0.62), (1500, 0.80), (1900, 0.45), (2100, 0.72), (2500, 0.55)],
    "Ice": [(400, 0.58), (600, 0.62), (800, 0.60), (1100, 0.55), (1400, 0.34), (1500, 0.50), (1900, 0.22), (2100, 0.44), (2500, 0.30)],
}


def _line(points: Sequence[tuple[float, float]]) -> np.ndarray:
    x, y = zip(*points)
    return np.interp(GRID, x, y)


def _absorbed(curve: np.ndarray, bands: Sequence[tuple[float, float, float]]) -> np.ndarray:
    for centre, width, depth in bands:
        curve = curve * (1 - depth * np.exp(-(((GRID - centre) / width) ** 2) / 2))
    return curve


def curves() -> list[tuple[str, str, np.ndarray]]:
    """(name, category, reflectance on GRID), in the library's order."""
    out = []
    for name, (edge, level, dry) in VEGETATION.items():
        leaf = _absorbed(_line(PIGMENT) + level / (1 + np.exp((edge - GRID) / EDGE_WIDTH)), LEAF_BANDS)
        out.append((name, "Vegetation", leaf * (1 - dry) + _line(DRY_LEAF) * dry))
    for category, group in (("Soil", SOIL), ("Rock", ROCK)):
        out += [(name, category, _absorbed(base + base * slope * (GRID - GRID[0]) / 2100, bands)) for name, (base, slope, bands) in group.items()]
    for category, nodes in (("Water", WATER), ("Snow/Ice", SNOW)):
        out += [(name, category, _line(points)) for name, points in nodes.items()]
    return [(n, c, np.maximum(v, 0)) for n, c, v in out]


def library(spark: SparkSession, step: int = 1) -> DataFrame:
    """(name, category, wavelengths, reflectance), every step-th nm."""
    rows = [(n, c, GRID[::step].tolist(), v[::step].tolist()) for n, c, v in curves()]
    return spark.createDataFrame(rows, "name string, category string, wavelengths array<double>, reflectance array<double>")


def categories() -> list[str]:
    return list(dict.fromkeys(c for _, c, _ in curves()))


def find(name: str) -> tuple[str, str, np.ndarray] | None:
    return next((e for e in curves() if e[0] == name), None)


def resample_spectrum(points: DataFrame, targets: DataFrame) -> DataFrame:
    """points(key, wl, value) at targets(wl): (key, wl, value), linear between the neighbours, NaN outside their range.
    Repeated wavelengths count once (the first by value). Each point reaches to the next one, so a target finds its
    bracket by a range join in which the targets, a short axis, are sent along."""
    from pyspark.sql import Window

    once = points.filter(~F.isnan("value") & ~F.isnan("wl")).groupBy("key", "wl").agg(F.min("value").alias("value"))
    after = Window.partitionBy("key").orderBy("wl")
    spans = once.select("key", "wl", "value", F.lead("wl").over(after).alias("wl2"), F.lead("value").over(after).alias("value2"))
    t = F.broadcast(targets.select(F.col("wl").alias("t")).distinct())
    hit = spans.join(t, (F.col("t") >= F.col("wl")) & ((F.col("t") < F.col("wl2")) | (F.col("t") == F.col("wl"))))
    lerp = F.when(F.col("t") == F.col("wl"), F.col("value")).otherwise(F.col("value") + (F.col("value2") - F.col("value")) * (F.col("t") - F.col("wl")) / (F.col("wl2") - F.col("wl")))
    found = hit.select("key", "t", lerp.alias("v"))
    grid = once.select("key").distinct().crossJoin(t)
    return grid.join(found, ["key", "t"], "left").select("key", F.col("t").alias("wl"), F.coalesce("v", lit(float("nan"))).alias("value"))


def spectral_angle_degrees(a: Sequence[float], b: Sequence[float]) -> float:
    """The angle between two curves over the places where both are finite; NaN without any, or for a curve of zeros."""
    x, y = np.asarray(a, float), np.asarray(b, float)
    both = np.isfinite(x) & np.isfinite(y)
    size = np.linalg.norm(x[both]) * np.linalg.norm(y[both])
    return float(np.degrees(np.arccos(np.clip(x[both] @ y[both] / size, -1, 1)))) if size > 1e-12 else float("nan")


def _interpolation(wavelengths: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """The matrix that takes values at ascending wavelengths to the part of the axis between them; rows are places of it."""
    at = np.searchsorted(wavelengths, axis, side="right") - 1
    at = np.minimum(at, len(wavelengths) - 2)
    share = (axis - wavelengths[at]) / (wavelengths[at + 1] - wavelengths[at])
    out = np.zeros((len(axis), len(wavelengths)))
    out[np.arange(len(axis)), at] = 1 - share
    out[np.arange(len(axis)), at + 1] += share
    return out


def angles(df: DataFrame, wavelengths: Sequence[float], spectrum: str = "spectrum", only: Sequence[str] | None = None, step: int = 1, out: str = "angles") -> tuple[DataFrame, list[str]]:
    """df with the spectral angles in degrees of each pixel to the library's entries, and the entries' names: match() for
    every pixel, without a row for each nanometre. Interpolation is linear, so products with entries and lengths on the
    library's axis follow from two small matrices over the pixel's own bands. Pixels with a missing or infinite value, and
    those of zeros, have angles of NaN. Raises ValueError where the wavelengths and the library don't meet."""
    from .classify import _kernel

    wl = np.asarray(wavelengths, float)
    order = np.argsort(wl)
    axis = GRID[::step]
    inside = (axis >= wl.min()) & (axis <= wl.max())
    if len(np.unique(wl)) != len(wl) or len(wl) < 2:
        raise ValueError("two wavelengths or more are needed, each of them once")
    if not inside.any():
        raise ValueError("the spectra and the library have no wavelengths in common")
    entries = [(n, v[::step][inside]) for n, c, v in curves() if only is None or c in only]
    rule = _interpolation(wl[order], axis[inside])
    products, lengths = rule.T @ np.stack([v for _, v in entries], axis=1), rule.T @ rule
    norms = np.array([np.linalg.norm(v) for _, v in entries])

    def work(x: np.ndarray) -> list[np.ndarray]:
        x = x[:, order] if x.shape[1] == len(order) else np.full((len(x), len(order)), np.nan)
        x = np.where(np.isfinite(x).all(axis=1)[:, None], x, np.nan)
        size = np.sqrt(np.maximum(((x @ lengths) * x).sum(axis=1), 0))[:, None]
        with np.errstate(all="ignore"):
            cos = x @ products / (size * norms)
        return [np.where((size > 1e-12) & (norms > 1e-12), np.degrees(np.arccos(np.clip(cos, -1, 1))), np.nan)]

    doubles = df.withColumn("_library", num.doubles(spectrum))
    return _kernel(doubles, "_library", work, {out: ArrayType(DoubleType())}).drop("_library"), [n for n, _ in entries]


def identified(df: DataFrame, wavelengths: Sequence[float], spectrum: str = "spectrum", max_angle: float | None = None, only: Sequence[str] | None = None, step: int = 1) -> DataFrame:
    """df with the name of the entry at the least spectral angle (of equals the first name) and the angle in degrees; both are
    null for pixels without an angle, or farther than max_angle."""
    found, names = angles(df, wavelengths, spectrum, only, step, "_angles")
    each = F.filter(F.arrays_zip(F.col("_angles").alias("angle"), F.array(*(lit(n) for n in names)).alias("name")), lambda e: ~F.isnan(e["angle"]))
    best = F.array_min(each)
    if max_angle is not None:
        best = F.when(best["angle"] <= max_angle, best)
    return found.withColumns({"_best": best}).withColumns({"name": F.col("_best.name"), "angle": F.col("_best.angle")}).drop("_best", "_angles")


def match(spark: SparkSession, wavelengths: Sequence[float], values: Sequence[float], max_angle: float | None = None, only: Sequence[str] | None = None, step: int = 1) -> DataFrame:
    """(name, category, angle in degrees), ascending: the library by spectral angle to one spectrum, over the part of the
    grid that it covers. Raises ValueError when it covers none."""
    wl, v = np.asarray(wavelengths, float), np.asarray(values, float)
    keep = np.isfinite(wl) & np.isfinite(v)
    wl, first = np.unique(wl[keep], return_index=True)
    v = v[keep][first]
    axis = GRID[::step]
    if not len(wl) or wl[0] > axis[-1] or wl[-1] < axis[0]:
        raise ValueError("the spectrum and the library have no wavelengths in common")
    on_grid = np.interp(axis, wl, v, left=np.nan, right=np.nan)
    query = spark.createDataFrame([(float(w), float(q)) for w, q in zip(axis, on_grid) if np.isfinite(q)], "wl double, q double")
    entries = library(spark, step) if only is None else library(spark, step).filter(F.col("category").isin(*only))
    each = entries.select("name", "category", F.explode(F.arrays_zip("wavelengths", "reflectance")).alias("e")).select("name", "category", F.col("e.wavelengths").alias("wl"), F.col("e.reflectance").alias("r"))
    sums = each.join(F.broadcast(query), "wl").groupBy("name", "category").agg(F.sum(F.col("q") * F.col("r")).alias("qr"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    weak = (F.sqrt("qq") <= 1e-12) | (F.sqrt("rr") <= 1e-12)
    cos = F.col("qr") / F.when(weak, 1.0).otherwise(F.sqrt("qq") * F.sqrt("rr"))
    out = sums.select("name", "category", F.when(weak, float("nan")).otherwise(F.degrees(F.acos(F.least(F.greatest(cos, lit(-1.0)), lit(1.0))))).alias("angle")).filter(~F.isnan("angle"))
    return (out if max_angle is None else out.filter(F.col("angle") <= max_angle)).orderBy("angle", "name")
