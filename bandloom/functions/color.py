"""Colour transforms as Column expressions, and the unit scaling that they start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.plans.num import clip


def unit_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with each column scaled to [0, 1] over all its numbers; a flat column becomes 0. The statistics are one row."""
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    stats = df.agg(*(f(known(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    x = df.crossJoin(F.broadcast(stats))
    for c in columns:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        x = x.withColumn(c, F.when(hi > lo, (F.col(c) - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)).otherwise(0.0))
    return x.select(*df.columns)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value in [0, 1] of colours in [0, 1]."""
    v = F.greatest(r, g, b)
    delta = v - F.least(r, g, b)
    safe = F.when(delta == 0, 1.0).otherwise(delta)
    h = F.when(delta == 0, 0.0).when(v == r, (g - b) / safe).when(v == g, 2.0 + (b - r) / safe).otherwise(4.0 + (r - g) / safe) / 6.0
    h = F.when(h < 0, h + 1.0).otherwise(h)
    return h, F.when(v == 0, 0.0).otherwise(delta / F.when(v == 0, 1.0).otherwise(v)), v


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    h, s, v = (clip(c, 0, 1) for c in (h, s, v))
    sextant = F.floor(h * 6.0)
    f = h * 6.0 - sextant
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    i = F.when(F.isnan(h), -1).otherwise(sextant % 6)

    def pick(*six: Column) -> Column:
        out = F.when(i == 0, six[0])
        for k in range(1, 6):
            out = out.when(i == k, six[k])
        return out.otherwise(float("nan"))

    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b
