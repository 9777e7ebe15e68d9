"""Band statistics and histograms: one pass over all bands, grouped map-side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandloom.plans import num
from bandloom.plans.num import lit, valid
from bandloom.plans.ship import ship


def long_bands(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """A row for each pixel and band: band, value (double), and the other columns."""
    others = [c for c in df.columns if c != spectrum]
    return df.select(*others, F.posexplode(F.col(spectrum).cast("array<double>")).alias("band", "value"))


def summary(value: str = "value") -> list[Column]:
    v = F.col(value)
    return [F.count(v).alias("n"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.avg(v).alias("mean_v"), F.stddev_pop(v).alias("std_v")]


def band_statistics(bands: DataFrame, nodata: float | None = None) -> DataFrame:
    """(band, n, min_v, max_v, mean_v, std_v) of bands(band, value); without a valid value n and the rest are 0."""
    held = bands.select("band", F.when(valid(F.col("value"), nodata), F.col("value")).alias("value"))
    found = held.groupBy("band").agg(*summary())
    return found.select("band", "n", *(F.coalesce(c, lit(0.0)).alias(c) for c in ("min_v", "max_v", "mean_v", "std_v")))


def spectrum_statistics(df: DataFrame, nodata: float | None = None, spectrum: str = "spectrum") -> DataFrame:
    """band_statistics() of all bands of df(spectrum) in one pass: a task sums up its spectra in a kernel and sends a row for
    each band, so pixels are never exploded. Squares about the means are merged, so large offsets don't cancel."""
    ship(df.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            v = np.ascontiguousarray(np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1).T)
            ok = np.isfinite(v) if nodata is None else np.isfinite(v) & (v != nodata)
            n = ok.sum(axis=1).astype(float)
            t = np.where(ok, v, 0).sum(axis=1)  # along a row NumPy sums by halves, which loses least
            mean = t / np.maximum(n, 1)
            q = np.where(ok, v - mean[:, None], 0)
            q = (q * q).sum(axis=1)
            lo, hi = np.where(ok, v, np.inf).min(axis=1), np.where(ok, v, -np.inf).max(axis=1)
            if held is not None:
                n0, mean0, q0, lo0, hi0, t0 = held
                both, gap = np.maximum(n + n0, 1), mean - mean0
                mean, q = mean0 + gap * n / both, q0 + q + gap * gap * n * n0 / both
                n, lo, hi, t = n + n0, np.minimum(lo, lo0), np.maximum(hi, hi0), t + t0
            held = n, mean, q, lo, hi, t
        if held is not None:
            names = ["band", "n", "m", "q", "lo", "hi", "t"]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held[0])), pa.int32()), pa.array(held[0].astype(np.int64)), *map(pa.array, held[1:])], names=names)

    x = df.select(num.doubles(spectrum).alias("v")).filter("v is not null")
    rows = x.mapInArrow(sums, "band int, n long, m double, q double, lo double, hi double, t double")
    near = F.min(F.when(F.col("n") > 0, F.col("m"))).over(Window.partitionBy("band"))  # a row for each task and band
    rows = rows.withColumn("r", near).withColumn("d", F.when(F.col("n") > 0, F.col("m") - F.col("r")).otherwise(0.0))
    each = rows.groupBy("band").agg(
        F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum(F.col("n") * F.col("d")).alias("s"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("s2"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("t").alias("t"),
    )
    n = F.when(F.col("n") > 0, F.col("n"))
    some = lambda c: F.coalesce(F.when(F.col("n") > 0, c), lit(0.0))
    variance = F.greatest((F.col("q") + F.col("s2") - F.col("s") * F.col("s") / n) / n, lit(0.0))
    return each.select("band", "n", some(F.col("lo")).alias("min_v"), some(F.col("hi")).alias("max_v"), some(F.col("t") / n).alias("mean_v"), some(F.sqrt(variance)).alias("std_v"))


def band_histogram(bands: DataFrame, bins: int = 100, nodata: float | None = None) -> DataFrame:
    """(band, bin, n) over equal widths between the least and the greatest value; the last bin is closed. A constant band
    is counted in the middle bin. The range of each band is a row, sent to the values."""
    held = bands.filter(valid(F.col("value"), nodata)).select("band", "value")
    ends = held.groupBy("band").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    flat = F.col("_hi") <= F.col("_lo")
    span = F.when(flat, 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    place = F.when(flat, lit(bins // 2)).otherwise(F.least(F.floor((F.col("value") - F.col("_lo")) / span * bins), lit(bins - 1)))
    joined = held.join(F.broadcast(ends), "band")  # a row for each band
    return joined.select("band", place.cast("int").alias("bin")).groupBy("band", "bin").agg(F.count("*").alias("n"))


def report(stats: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """The lines of the statistics file: Band, Min, Max, Mean, StdDev, PixelCount with six decimals."""
    name = F.concat(lit("Band "), (F.col("band") + 1).cast("string"))
    x = stats if names is None else stats.join(F.broadcast(names), "band", "left")
    label = name if names is None else F.coalesce("name", name)
    six = lambda c: F.format_string("%.6f", F.col(c))
    return x.select(label.alias("Band"), six("min_v").alias("Min"), six("max_v").alias("Max"), six("mean_v").alias("Mean"), six("std_v").alias("StdDev"), F.col("n").alias("PixelCount"))


def scene_mean(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """(band, mean_v) over the pixels whose whole spectrum is finite."""
    from bandloom.plans.num import all_finite

    x = df.filter(all_finite(F.col(spectrum).cast("array<double>"))).select(F.col(spectrum).alias("spectrum"))
    return long_bands(x).groupBy("band").agg(F.avg("value").alias("mean_v"))


def covariance_table(spark: SparkSession, covariance: np.ndarray) -> DataFrame:
    """(i, j, c), i <= j, of a matrix of bands by bands."""
    rows = [(i, j, float(covariance[i, j])) for i in range(len(covariance)) for j in range(i, len(covariance))]
    return spark.createDataFrame(rows, "i int, j int, c double")
