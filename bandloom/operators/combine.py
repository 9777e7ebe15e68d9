"""Rasters put together: stacks, subsets, mosaics, pan-sharpening."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.plans.num import lit
from bandloom.plans.raster import BandInfo, Raster, RasterMetadata

from . import projections
from .roi import ROI
from .warp import Grid, Source, merged, resized, to_world

METHODS = {"nearest": "nearest", "bilinear": "bilinear", "cubic": "cubic", "bicubic": "cubic", "cubics": "cubic", "cubic_spline": "cubic_spline", "cubicspline": "cubic_spline", "average": "average", "lanczos": "lanczos"}


def method_name(name: str) -> str:
    try:
        return METHODS[name.lower().replace(" ", "")]
    except KeyError:
        raise ValueError(f"unknown resampling {name!r}: nearest, bilinear, cubic, cubic_spline, average or lanczos") from None


def on_grid(r: Raster, target: RasterMetadata, method: str) -> DataFrame:
    """(y, x, spectrum) of a raster on another one's grid: warped where both are placed in the world, else resized."""
    m = r.meta
    if m.transform and target.transform and m.crs and target.crs and (m.crs == target.crs or projections.supported(m.crs) and projections.supported(target.crs)):
        if (m.transform, m.crs, m.width, m.height) == (target.transform, target.crs, target.width, target.height):
            return r.df.select("y", "x", "spectrum")
        return warped(r.df, m, Grid(target.width, target.height, tuple(target.transform), target.crs), method)
    if (m.height, m.width) == (target.height, target.width):
        return r.df.select("y", "x", "spectrum")
    return resized(r.df, (m.height, m.width), (target.height, target.width), m.bands, method)


def stack(sources: Sequence[tuple[Raster, int]], method: str = "nearest") -> Raster:
    """Bands of several rasters on the grid of the first: an equi-join on the pixel, written as a union and a group so
    that any number of layers is one shuffle. A raster sends its bands together."""
    if not sources:
        raise ValueError("nothing to stack")
    first = sources[0][0].meta
    rasters: list[Raster] = []
    wanted: list[list[int]] = []
    cells, details = [], []
    for k, (r, b) in enumerate(sources):
        if not 0 <= b < r.meta.bands:
            raise IndexError(f"band {b} of {r.meta.bands}")
        part = next((i for i, other in enumerate(rasters) if other is r), len(rasters))
        if part == len(rasters):
            rasters.append(r)
            wanted.append([])
        cells.append((part, len(wanted[part])))
        wanted[part].append(b)
        info = r.meta.band_details[b] if b < len(r.meta.band_details) else BandInfo(b, f"Band {b + 1}")
        details.append(replace(info, index=k, name=f"{r.name}: {info.name}"))
    parts = []
    for i, (r, bands) in enumerate(zip(rasters, wanted)):
        x = on_grid(r.select_bands(bands), first, method_name(method))
        parts.append(x.select("y", "x", lit(i).alias("part"), F.col("spectrum").cast("array<double>").alias("spectrum")))
    x = reduce(DataFrame.unionByName, parts).groupBy("y", "x").agg(F.map_from_entries(F.collect_list(F.struct("part", "spectrum"))).alias("_m"))
    spectrum = F.array(*(F.coalesce(F.get(F.try_element_at("_m", lit(part)), lit(i)), lit(float("nan"))) for part, i in cells))
    meta = replace(first, bands=len(sources), band_details=tuple(details), default_bands=None, dtype="float32")
    return Raster(meta, x.select("y", "x", spectrum.alias("spectrum")), "stack")


def crop(df: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """The pixels of a half-open window, counted from its corner."""
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    return df.filter(inside).withColumns({"y": (F.col("y") - y0).cast("int"), "x": (F.col("x") - x0).cast("int")})


def subset(r: Raster, x0: int, x1: int, y0: int, y1: int, bands: Sequence[int] | None = None, scale: float = 1.0, method: str = "bilinear") -> Raster:
    """A window, bands in the given order, and a new size; the geotransform follows."""
    x0, y0 = min(max(x0, 0), r.meta.width - 1), min(max(y0, 0), r.meta.height - 1)
    x1, y1 = min(max(x1, x0 + 1), r.meta.width), min(max(y1, y0 + 1), r.meta.height)
    chosen = list(range(r.meta.bands)) if bands is None else list(bands)
    part = r.select_bands(chosen)
    h, w = y1 - y0, x1 - x0
    th, tw = max(1, round(h * scale)), max(1, round(w * scale))
    df = crop(part.df.select("y", "x", "spectrum"), x0, x1, y0, y1)
    if (th, tw) != (h, w):
        df = resized(df, (h, w), (th, tw), len(chosen), method_name(method))
    transform = None
    if r.meta.transform:
        a, b, c, d, e, f = r.meta.transform[:6]
        transform = (a / scale, b / scale, c + a * x0 + b * y0, d / scale, e / scale, f + d * x0 + e * y0)
    kept = r.meta.default_bands
    default = tuple(chosen.index(b) for b in kept) if kept and all(b in chosen for b in kept) else None
    return Raster(replace(part.meta, width=tw, height=th, transform=transform, default_bands=default), df, f"{r.name} subset")


def subset_to_roi(r: Raster, region: ROI, **how) -> Raster:
    """The window that holds a region."""
    box = region.bounds()
    if box is None:
        raise ValueError("the region is empty")
    x0, y0, x1, y1 = box
    return subset(r, x0, x1, y0, y1, **how)


def bounds(meta: RasterMetadata) -> tuple[float, float, float, float]:
    """(left, bottom, right, top)."""
    a, b, c, d, e, f = meta.transform[:6]
    xs = [a * x + b * y + c for x in (0, meta.width) for y in (0, meta.height)]
    ys = [d * x + e * y + f for x in (0, meta.width) for y in (0, meta.height)]
    return min(xs), min(ys), max(xs), max(ys)


def outline(meta: RasterMetadata, target: str, steps: int = 21) -> tuple[float, float, float, float]:
    """Bounds in another coordinate system, from points along the edges. Raises ValueError where an edge has no place in it."""
    along, ends = np.linspace(0, 1, steps), np.repeat([0.0, 1.0], steps)
    x, y = np.concatenate((np.tile(along, 2), ends)) * meta.width, np.concatenate((ends, np.tile(along, 2))) * meta.height
    x, y = projections.converted(*to_world(meta.transform, x, y), meta.crs, target)
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError(f"{target} can't show the whole raster")
    return float(x.min()), float(y.min()), float(x.max()), float(y.max())


def warped(df: DataFrame, meta: RasterMetadata, grid: Grid, method: str, nodata: float | None = None) -> DataFrame:
    """df(y, x, spectrum) on a grid, in the same or another coordinate system."""
    if not all(c == grid.crs or projections.supported(c) for c in (meta.crs or "", grid.crs)):
        raise ValueError(f"no way is known from {meta.crs} to {grid.crs}")
    source = Source(meta.width, meta.height, tuple(meta.transform), meta.crs or "", meta.nodata if nodata is None else nodata)
    return merged([(df, source)], grid, meta.bands, method)


def mosaic_grid(metas: Sequence[RasterMetadata], crs: str | None = None, resolution: float | None = None) -> Grid:
    """The north-up grid that holds all rasters, with the pixel size of the first unless given."""
    if not metas:
        raise ValueError("no rasters")
    if any(not m.crs or not m.transform for m in metas):
        raise ValueError("every raster needs a coordinate system and a transform")
    target = crs or metas[0].crs
    if any(m.crs != target for m in metas):
        if resolution is None:
            raise ValueError("a resolution is needed to change the coordinate system")
        if not all(projections.supported(c) for c in (target, *(m.crs for m in metas))):
            raise ValueError(f"no way is known to {target}")
    boxes = [bounds(m) if m.crs == target else outline(m, target) for m in metas]
    left, bottom, right, top = min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)
    dx, dy = (resolution, resolution) if resolution else (abs(metas[0].transform[0]), abs(metas[0].transform[4]))
    return Grid(max(1, math.ceil((right - left) / dx - 1e-9)), max(1, math.ceil((top - bottom) / dy - 1e-9)), (dx, 0.0, left, 0.0, -dy, top), target)


def window(meta: RasterMetadata, grid: Grid) -> tuple[int, int, int, int]:
    """Rows and columns of the grid that a raster covers: (y0, y1, x0, x1), half-open."""
    left, bottom, right, top = bounds(meta)
    dx, _, gx, _, dy, gy = grid.transform
    cut = lambda v, n: min(max(v, 0), n)
    x0, x1 = cut(math.floor((left - gx) / dx + 1e-9), grid.width), cut(math.ceil((right - gx) / dx - 1e-9), grid.width)
    y0, y1 = cut(math.floor((top - gy) / dy + 1e-9), grid.height), cut(math.ceil((bottom - gy) / dy - 1e-9), grid.height)
    return y0, y1, x0, x1


def feather(y: np.ndarray, x: np.ndarray, box: tuple[int, int, int, int], pixels: float) -> np.ndarray:
    """Weights of places in a box (y0, y1, x0, x1): they rise from its edges over so many pixels."""
    if pixels <= 0:
        return np.ones(len(y))
    rise = lambda i, n: np.clip(np.minimum(i + 0.5, n - i - 0.5) / pixels, 0, 1)
    return rise(y - box[0], box[1] - box[0]) * rise(x - box[2], box[3] - box[2])


def mosaic(rasters: Sequence[Raster], crs: str | None = None, resolution: float | None = None, method: str = "bilinear", background: float | None = 0.0, feather_pixels: float = 0.0) -> Raster:
    """One raster from many: the weighted mean where they overlap, the background where there is none (without one those
    pixels are left out). All sources meet in one shuffle to the tiles of the mosaic."""
    if len({r.meta.bands for r in rasters}) > 1:
        raise ValueError("rasters differ in their number of bands")
    grid = mosaic_grid([r.meta for r in rasters], crs, resolution)
    sources = []
    for r in rasters:
        m = r.meta
        if m.crs == grid.crs:
            box = window(m, grid)
        else:
            left, bottom, right, top = outline(m, grid.crs)
            box = window(RasterMetadata(1, 1, 1, crs=grid.crs, transform=(right - left, 0.0, left, 0.0, bottom - top, top)), grid)
        weight = partial(feather, box=box, pixels=feather_pixels)
        sources.append((r.df, Source(m.width, m.height, tuple(m.transform), m.crs, m.nodata, weight=weight)))
    pixels = merged(sources, grid, rasters[0].meta.bands, method_name(method), None if background is None else float(background))
    meta = replace(rasters[0].meta, width=grid.width, height=grid.height, transform=grid.transform, crs=grid.crs)
    return Raster(meta, pixels, "mosaic")


def pan_band(meta: RasterMetadata) -> int | None:
    """The panchromatic band: the one named so, or numbered 8 in a scene's metadata, or the only one."""
    named = [i for i, b in enumerate(meta.band_details) if "pan" in b.name.lower() or b.mtl_band == 8]
    return named[0] if named else 0 if meta.bands == 1 else None


def pan_sharpened(pan: Raster, ms: Raster, method: str = "brovey", bands: Sequence[int] | None = None, weights: Sequence[float] | None = None, band: int | None = None) -> Raster:
    """ms on the grid of pan, sharpened: bands are resized (bilinear) to the pan grid and joined with the pan band pixel by
    pixel; grid, coordinate system and transform are pan's, band details those of ms. Moments are exact."""
    band = pan_band(pan.meta) if band is None else band
    if band is None:
        raise ValueError("which band is the panchromatic one?")
    chosen = list(range(ms.meta.bands)) if bands is None else list(bands)
    if not chosen:
        raise ValueError("no bands to sharpen")
    part = ms.select_bands(chosen)
    fine = resized(part.df, (ms.meta.height, ms.meta.width), (pan.meta.height, pan.meta.width), len(chosen), "bilinear")
    names = [f"_m{i}" for i in range(len(chosen))]
    x = fine.select("y", "x", *(F.get("spectrum", lit(i)).alias(n) for i, n in enumerate(names)))
    x = x.join(pan.band(band).withColumn("_pan", F.col("value").cast("double")).drop("value"), ["y", "x"])
    if method == "brovey":
        x = x.select("y", "x", F.array(*brovey(F.col("_pan"), [F.col(n) for n in names], weights)).alias("spectrum"))
    elif method == "gram_schmidt":
        x = gram_schmidt(x, "_pan", names, weights, names).select("y", "x", F.array(*names).alias("spectrum"))
    else:
        raise ValueError(f"unknown method {method!r}: brovey or gram_schmidt")
    meta = replace(part.meta, width=pan.meta.width, height=pan.meta.height, transform=pan.meta.transform, crs=pan.meta.crs, dtype="float32")
    return Raster(meta, x, f"{ms.name} sharpened")


def brovey(pan: Column, ms: Sequence[Column], weights: Sequence[float] | None = None) -> list[Column]:
    """Bands scaled by the pan channel over their weighted mean."""
    if not ms:
        raise ValueError("no bands to sharpen")
    w = [1.0] * len(ms) if weights is None else list(weights)
    intensity = reduce(lambda a, b: a + b, (m * (x / sum(w)) for m, x in zip(ms, w)))
    return [m * pan / (intensity + 1e-6) for m in ms]


def gram_schmidt(df: DataFrame, pan: str, ms: Sequence[str], weights: Sequence[float] | None = None, out: Sequence[str] | None = None) -> DataFrame:
    """df with sharpened bands: the simulated pan channel's share of each band is replaced by the real one, matched in
    mean and deviation. All moments come from one aggregate, a row sent along."""
    if not ms:
        raise ValueError("no bands to sharpen")
    w = [1.0] * len(ms) if weights is None else list(weights)
    simulated = reduce(lambda a, b: a + b, (F.col(m) * (x / sum(w)) for m, x in zip(ms, w)))
    x = df.withColumn("_gs", simulated)
    moments = x.agg(
        F.avg(pan).alias("_mp"), F.stddev_pop(pan).alias("_sp"), F.avg("_gs").alias("_mg"), F.stddev_pop("_gs").alias("_sg"),
        F.var_pop("_gs").alias("_vg"), *(F.covar_samp(m, "_gs").alias(f"_c{i}") for i, m in enumerate(ms)),
    )
    x = x.crossJoin(F.broadcast(moments))
    matched = (F.col(pan) - F.col("_mp")) / (F.col("_sp") + 1e-6) * F.col("_sg") + F.col("_mg")
    made = {n: F.col(m) + F.col(f"_c{i}") / (F.col("_vg") + 1e-6) * (matched - F.col("_gs")) for i, (m, n) in enumerate(zip(ms, out or [f"{m}_sharp" for m in ms]))}
    return x.withColumns(made).select(*df.columns, *(n for n in made if n not in df.columns))
