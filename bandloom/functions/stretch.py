"""Contrast stretches to [0, 1]: exact statistics in one aggregate, then an expression for each row.

Valid values are finite and not the sentinel; all others become 0, as do all values when none is valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.plans.num import clip, lit, valid
from bandloom.plans.quantile import quantiles


def _scaled(df: DataFrame, column: str, nodata: float | None, lo: Column, hi: Column, out: str, flat_zero: bool = False) -> DataFrame:
    """Row-wise (v - lo) / (hi - lo), where lo and hi are aggregates over the valid values."""
    stats = df.select(F.when(valid(F.col(column), nodata), F.col(column)).alias("v")).agg(lo.alias("_lo"), hi.alias("_hi"))
    x = df.crossJoin(F.broadcast(stats))  # one row
    top = F.col("_hi") if flat_zero else F.when(F.col("_hi") <= F.col("_lo"), F.col("_lo") + 1e-6).otherwise(F.col("_hi"))
    span = top - F.col("_lo")
    value = clip((F.col(column) - F.col("_lo")) / F.when(span == 0, 1.0).otherwise(span), 0, 1)
    value = F.when(span > 0, value).otherwise(0.0) if flat_zero else value
    value = F.when(valid(F.col(column), nodata) & F.col("_lo").isNotNull(), value).otherwise(0.0)
    return x.withColumn(out, value).drop("_lo", "_hi")


def linear_percent(df: DataFrame, column: str, percent: float = 2.0, nodata: float | None = None, out: str = "s", accuracy: int | None = None) -> DataFrame:
    """Between percentiles p and 100 - p, exact at any size; with accuracy, approximate in a single pass."""
    shares = [percent / 100, 1 - percent / 100]
    if accuracy:
        rank = lambda q: F.percentile_approx("v", q, accuracy)
        return _scaled(df, column, nodata, rank(shares[0]), rank(shares[1]), out)
    ends = quantiles(df.filter(valid(F.col(column), nodata)), column, shares)
    if ends is None:
        return df.withColumn(out, lit(0.0))
    lo, hi = ends
    hi = lo + 1e-6 if hi <= lo else hi
    return df.withColumn(out, F.when(valid(F.col(column), nodata), clip((F.col(column) - lo) / (hi - lo), 0, 1)).otherwise(0.0))


def gaussian(df: DataFrame, column: str, std_factor: float = 3.0, nodata: float | None = None, out: str = "s") -> DataFrame:
    """Between mean - n and mean + n standard deviations."""
    mean, std = F.avg("v"), F.stddev_pop("v")
    return _scaled(df, column, nodata, mean - std_factor * std, mean + std_factor * std, out)


def min_max(df: DataFrame, column: str, nodata: float | None = None, out: str = "s") -> DataFrame:
    return _scaled(df, column, nodata, F.min("v"), F.max("v"), out, flat_zero=True)


def equalize(df: DataFrame, column: str, bins: int = 256, nodata: float | None = None, out: str = "s") -> DataFrame:
    """By the cumulative histogram, interpolated between bin centres. The lookup is a row of `bins` numbers."""
    v = df.select(F.col(column).alias("v")).filter(valid(F.col("v"), nodata))
    ends = v.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count("v").alias("_n"))
    ends = ends.withColumns({"_a": F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")), "_b": F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))})
    width = (F.col("_b") - F.col("_a")) / bins
    held = v.crossJoin(F.broadcast(ends)).select(F.least(F.floor((F.col("v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), lit(bins - 1)).cast("int").alias("bin"))
    counts = held.groupBy("bin").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left")
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # over `bins` rows
    cdf = every.withColumn("c", F.sum(F.coalesce("n", lit(0))).over(run)).agg(F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("_cdf"))
    table = ends.crossJoin(cdf).select("_a", width.alias("_w"), F.transform("_cdf", lambda s: s["c"] / F.greatest(F.col("_n"), lit(1))).alias("_cdf"))
    x = df.crossJoin(F.broadcast(table))
    at = (F.col(column) - F.col("_a")) / F.col("_w") - 0.5  # in bins, from the first centre
    at = F.least(F.greatest(at, lit(0.0)), lit(float(bins - 1)))
    low = F.least(F.floor(at), lit(bins - 2)).cast("int")
    left, right = F.get("_cdf", low), F.get("_cdf", low + 1)
    value = clip(left + (right - left) * (at - low), 0, 1)
    return x.withColumn(out, F.when(valid(F.col(column), nodata) & F.col("_w").isNotNull(), value).otherwise(0.0)).drop("_a", "_w", "_cdf")


def stretch(df: DataFrame, column: str, mode: str = "Linear 2%", nodata: float | None = None, out: str = "u8") -> DataFrame:
    """By the name of a mode, to 0..255. A name that isn't known is min-max."""
    name = mode.lower()
    if "2%" in name:
        x = linear_percent(df, column, 2.0, nodata, "_s")
    elif "5%" in name:
        x = linear_percent(df, column, 5.0, nodata, "_s")
    elif "equal" in name or "均衡" in name:
        x = equalize(df, column, nodata=nodata, out="_s")
    elif "gauss" in name or "高斯" in name:
        x = gaussian(df, column, nodata=nodata, out="_s")
    else:
        x = min_max(df, column, nodata, "_s")
    return x.withColumn(out, F.floor(F.col("_s") * 255.0).cast("int")).drop("_s")


def overview(df: DataFrame, width: int, height: int, size: int = 400) -> DataFrame:
    """Every step-th pixel, so that about `size` remain along the longer side."""
    step = max(1, max(width, height) // size)
    return df.filter((F.col("y") % step == 0) & (F.col("x") % step == 0))
