"""Spectral indices as Column expressions. Each is clipped to [-1, 1]; NaN stays NaN."""

from __future__ import annotations

from pyspark.sql import Column

from bandloom.plans.num import clip

EPS = 1e-6


def _ratio(a: Column, b: Column, eps: float) -> Column:
    return clip((a - b) / (a + b + eps), -1, 1)


def ndvi(nir: Column, red: Column, eps: float = EPS) -> Column:
    return _ratio(nir, red, eps)


def ndwi(green: Column, nir: Column, eps: float = EPS) -> Column:
    return _ratio(green, nir, eps)


def nbr(nir: Column, swir2: Column, eps: float = EPS) -> Column:
    return _ratio(nir, swir2, eps)


def evi(nir: Column, red: Column, blue: Column, g: float = 2.5, c1: float = 6.0, c2: float = 7.5, l: float = 1.0, eps: float = EPS) -> Column:  # noqa: E741
    from bandloom.plans.num import safe_div

    return clip(g * safe_div(nir - red, nir + c1 * red - c2 * blue + l + eps), -1, 1)


def savi(nir: Column, red: Column, l: float = 0.5, eps: float = EPS) -> Column:  # noqa: E741
    return clip((nir - red) / (nir + red + l + eps) * (1.0 + l), -1, 1)
