"""Exact quantiles of tables of any size.

The aggregate `percentile` gathers every distinct value in one place. Here the values between the ends of a range are
counted in BINS bins, only the bins that hold a wanted rank are kept, with their own least and greatest values as the new
ends, and those are counted again, until a bin holds one value. A round is one grouped count whose result has at most
BINS rows for each rank; doubles are told apart after a few rounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096


def ranked(df: DataFrame, column: str, ranks: Sequence[int], ends: tuple[float, float]) -> dict[int, float]:
    """The values at these ranks (from 0) of a column of finite doubles between ends."""
    found: dict[int, float] = {}
    spans: list[tuple[float, float, int, list[int]]] = [(*ends, 0, sorted(set(ranks)))]  # ends, values before, ranks
    while spans:
        which, place = F.lit(None).cast("int"), F.lit(None).cast("int")
        v = F.col(column)
        for k, (lo, hi, _, wanted) in enumerate(spans):
            inside = (v >= lo) & (v <= hi)
            width = (hi - lo) / BINS
            at = F.least(F.floor((v - lo) / width), F.lit(BINS - 1)).cast("int") if width > 0 else F.lit(0)
            which, place = F.when(inside, k).otherwise(which), F.when(inside, at).otherwise(place)
        bins = df.select(which.alias("k"), place.alias("b"), v.alias("v")).filter("k is not null").groupBy("k", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = sorted(bins.collect(), key=lambda r: (r.k, r.b))
        after = []
        for k, (_, _, before, wanted) in enumerate(spans):
            for r in (r for r in rows if r.k == k):
                own = [w for w in wanted if before <= w < before + r.n]
                for w in own:
                    if r.lo == r.hi or w == before:
                        found[w] = r.lo
                    elif w == before + r.n - 1:
                        found[w] = r.hi
                if rest := [w for w in own if w not in found]:
                    after.append((r.lo, r.hi, before, rest))
                before += r.n
        spans = after
    return found


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float] | None:
    """Quantiles of a column's finite values, between neighbours by proportion; None without any."""
    v = F.col(column).cast("double")
    x = df.select(v.alias("v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    n, lo, hi = x.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = [q * (n - 1) for q in shares]
    values = ranked(x, "v", [r for a in at for r in (math.floor(a), math.ceil(a))], (lo, hi))
    out = []
    for a in at:
        low, high = values[math.floor(a)], values[math.ceil(a)]
        out.append(low + (high - low) * (a - math.floor(a)))
    return out
