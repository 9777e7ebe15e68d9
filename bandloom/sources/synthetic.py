"""Synthetic scenes: four closed-form materials in the quadrants of an image, with noise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.plans.num import matrix
from bandloom.plans.raster import BandInfo, Raster, RasterMetadata

CLASSES = ("vegetation", "water", "soil", "urban")


def _bell(wl: np.ndarray, centre: float, width: float) -> np.ndarray:
    return np.exp(-(((wl - centre) / width) ** 2) / 2)


def spectra(wavelengths: np.ndarray) -> dict[str, np.ndarray]:
    """Reflectance of the four materials."""
    wl = np.asarray(wavelengths, float)
    # Plateaus, absorption bands (centre, width, depth) and limits of the curves.
    leaf = 0.05 + 0.08 * _bell(wl, 550, 40) + 0.45 / (1 + np.exp((720 - wl) / 25))
    leaf -= sum(depth * _bell(wl, c, w) for c, w, depth in ((970, 40, 0.1), (1200, 50, 0.15), (1400, 60, 0.35), (1940, 70, 0.4)))
    water = np.where(wl > 750, 0.01, 0.12 * _bell(wl, 480, 120))
    soil = 0.10 + 0.35 * (wl - 400) / 2000 - 0.08 * _bell(wl, 2200, 30)
    urban = 0.25 + 0.10 * np.sin((wl - 400) / 400)
    limits = {"vegetation": (leaf, 0.01, 0.85), "water": (water, 0.005, 0.2), "soil": (soil, 0.05, 0.6), "urban": (urban, 0.15, 0.5)}
    return {n: np.clip(c, lo, hi) for n, (c, lo, hi) in limits.items()}


def cube(lines: int = 128, samples: int = 128, bands: int = 64, start: float = 400.0, end: float = 2400.0, noise: float = 0.005, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bands by lines by samples, wavelengths, classes): small scenes for tests, drawn in one stream."""
    wl = np.linspace(start, end, bands)
    truth = 2 * (np.arange(lines) >= lines // 2)[:, None] + (np.arange(samples) >= samples // 2)[None, :]
    table = np.array([spectra(wl)[c] for c in CLASSES], np.float32)
    clean = table[truth].transpose(2, 0, 1)
    drawn = np.random.default_rng(seed).normal(0, noise, clean.shape).astype(np.float32)
    return np.clip(clean + drawn, 0, 1), wl, truth.astype(np.int32)


def scene(spark: SparkSession, lines: int, samples: int, bands: int = 64, start: float = 400.0, end: float = 2400.0, noise: float = 0.005, seed: int = 42) -> tuple[Raster, DataFrame]:
    """The same at any size, made where it is used: (raster, truth with y, x, cls). Noise is seeded by pixel and band."""
    wl = np.linspace(start, end, bands)
    table = [spectra(wl)[c].tolist() for c in CLASSES]
    pixels = spark.range(lines * samples).select((F.col("id") / samples).cast("int").alias("y"), (F.col("id") % samples).cast("int").alias("x"))
    cls = 2 * (F.col("y") >= lines // 2).cast("int") + (F.col("x") >= samples // 2).cast("int")
    truth = pixels.withColumn("cls", cls)

    def unit(i, salt: int):
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), "y", "x", i), 11) + 0.5) / float(1 << 53)

    def drawn(i):  # Box and Muller's normal numbers from two hashes
        return noise * F.sqrt(-2 * F.ln(unit(i, 1))) * F.cos(2 * np.pi * unit(i, 2))

    noisy = F.transform(F.get(matrix(table), F.col("cls")), lambda v, i: F.least(F.greatest(v + drawn(i), F.lit(0.0)), F.lit(1.0)).cast("float"))
    details = tuple(BandInfo(i, f"Band {i + 1}", float(w)) for i, w in enumerate(wl))
    return Raster(RasterMetadata(samples, lines, bands, band_details=details), truth.select("y", "x", noisy.alias("spectrum")), "synthetic"), truth
