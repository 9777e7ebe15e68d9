"""Rasters moved to other grids: resizing, warping, reprojection and mosaics, by tiles of the target.

A kernel works out where each source pixel falls and sends its whole spectrum to the tiles that it reaches (one, or a few
at their edges). All pixels of a tile meet in one Arrow kernel, which looks up every target pixel's neighbours for all
bands at once, in as many sources as there are, and adds them up. So a spectrum is shuffled about once, whatever the
number of bands, sources and neighbours, and no grid is generated but one row a tile where holes must be filled.

Missing values take no part: the weights of the others are scaled to 1, unless they are to count as zeros. Sources may be
rotated; coordinate systems are those of projections.py. A place within rounding of a pixel's centre is that centre, so
aligned grids take values over as they are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.plans import num
from bandloom.plans.ship import ship

from . import projections

Affine = tuple[float, ...]
#: How far a method looks, in source pixels. A spline's filter forgets by 0.27 a pixel: 20 more leave 1e-11.
REACH = {"nearest": 0.5, "bilinear": 1.0, "cubic": 2.0, "cubic_spline": 2.0, "lanczos": 3.0, "average": 0.5, "spline": 22.0}
TILE, SOURCE_TILE, PAD = 128, 256, 24
#: In pixels, what rounding of world coordinates makes.
NEAR = 1e-9


@dataclass(frozen=True)
class Grid:
    width: int
    height: int
    transform: Affine
    crs: str


def to_world(t: Affine, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d, e, f = t[:6]
    return a * x + b * y + c, d * x + e * y + f


def to_pixel(t: Affine, wx: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d, e, f = t[:6]
    det = a * e - b * d
    return ((wx - c) * e - (wy - f) * b) / det, ((wy - f) * a - (wx - c) * d) / det


@dataclass(frozen=True)
class Source:
    """A raster's place, and where it falls on the target grid. With clamp, coordinates beyond the edge move to it."""

    width: int
    height: int
    transform: Affine
    crs: str
    nodata: float | None = None
    clamp: bool = False
    weight: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None

    def on(self, grid: Grid, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (y, x) on the grid of this raster's pixels, in pixel centres."""
        wx, wy = projections.converted(*to_world(self.transform, x + 0.5, y + 0.5), self.crs, grid.crs)
        tx, ty = to_pixel(grid.transform, wx, wy)
        return ty - 0.5, tx - 0.5

    def of(self, grid: Grid, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in this raster of pixels of the grid."""
        wx, wy = projections.converted(*to_world(grid.transform, x + 0.5, y + 0.5), grid.crs, self.crs)
        sx, sy = to_pixel(self.transform, wx, wy)
        return sy - 0.5, sx - 0.5

    def ratio(self, grid: Grid) -> tuple[float, float]:
        """Pixels of the grid for one of this raster: the most and the least, over its edges and centre."""
        ys, xs = (np.linspace(0, n - 1, 9) if n > 1 else np.zeros(9) for n in (self.height, self.width))
        y, x = (v.ravel() for v in np.meshgrid(ys, xs, indexing="ij"))
        here = self.on(grid, y, x)
        steps = [np.hypot(*(p - q for p, q in zip(self.on(grid, y + dy, x + dx), here))) for dy, dx in ((1, 0), (0, 1))]
        found = [s[np.isfinite(s)] for s in steps]
        return max((float(s.max()) for s in found if len(s)), default=1.0), min((float(s.min()) for s in found if len(s)), default=1.0)

    def footprint(self, grid: Grid) -> tuple[float, float]:
        """How many of this raster's pixels a pixel of the grid covers along this raster's y and x, in the middle of what
        both have in common. A turn moves an axis' share to the other one."""
        ys, xs = (np.linspace(0, n - 1, 9) for n in (grid.height, grid.width))
        y, x = (v.ravel() for v in np.meshgrid(ys, xs, indexing="ij"))
        here = self.of(grid, y, x)
        steps = [[p - q for p, q in zip(self.of(grid, y + dy, x + dx), here)] for dy, dx in ((1, 0), (0, 1))]
        within = (here[0] >= -1) & (here[0] <= self.height) & (here[1] >= -1) & (here[1] <= self.width)
        out = []
        for axis in (0, 1):
            size = np.hypot(steps[0][axis], steps[1][axis])
            size = size[np.isfinite(size) & within] if (within & np.isfinite(size)).any() else size[np.isfinite(size)]
            out.append(float(np.median(size)) if len(size) else 1.0)
        return out[0], out[1]


def _weights(method: str, d: np.ndarray, scale: float) -> np.ndarray:
    """Weight of a source pixel at distance d."""
    d = np.abs(d)
    if method == "bilinear":
        return np.maximum(1 - d, 0)
    if method == "cubic":  # convolution with a slope of -1/2
        return np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
    if method in ("cubic_spline", "spline"):
        return np.where(d <= 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0))
    if method == "lanczos":
        return np.where(d < 3, np.sinc(d) * np.sinc(d / 3), 0)
    half = max(scale, 1.0) / 2  # average: the part of the pixel that the target pixel covers
    return np.clip(np.minimum(d + 0.5, half) - np.maximum(d - 0.5, -half), 0, 1)


def centred(v: np.ndarray) -> np.ndarray:
    """Places, on the centres of pixels where they are NEAR them."""
    whole = np.rint(v)
    return np.where(np.abs(v - whole) < NEAR, whole, v)


def interpolated(cells: np.ndarray, y0: int, x0: int, sy: np.ndarray, sx: np.ndarray, method: str, scale: tuple[float, float], zeros: bool = False) -> np.ndarray:
    """Values at places (sy, sx) of a raster whose pixels from (y0, x0) on are cells (height, width, bands; NaN where
    missing). scale: source pixels for one of the target, along y and x. zeros: missing ones count as 0."""
    h, w, bands = cells.shape
    if method == "spline":
        cells = _spline_coefficients(_spline_coefficients(cells, 0), 1)
        y0, x0, h, w = y0 - PAD, x0 - PAD, *cells.shape[:2]

    def look(py: np.ndarray, px: np.ndarray) -> np.ndarray:
        iy, ix = py - y0, px - x0
        ok = (iy >= 0) & (iy < h) & (ix >= 0) & (ix < w)
        v = cells[np.where(ok, iy, 0), np.where(ok, ix, 0)]
        v[~ok] = np.nan
        return v

    if method == "nearest":
        return look(np.floor(sy + 0.5).astype(int), np.floor(sx + 0.5).astype(int))
    taps = [int(math.ceil(max(REACH[method] if method != "spline" else 2.0, s / 2 + 0.5 if method == "average" else 0))) for s in scale]
    by, bx = np.floor(sy).astype(int), np.floor(sx).astype(int)
    total, weight = np.zeros((len(sy), bands)), np.zeros((len(sy), bands))
    for i in range(1 - taps[0], taps[0] + 1):
        wy = _weights(method, sy - (by + i), scale[0])
        if not wy.any():
            continue
        for j in range(1 - taps[1], taps[1] + 1):
            wt = (wy * _weights(method, sx - (bx + j), scale[1]))[:, None]
            if not wt.any():
                continue
            v = look(by + i, bx + j)
            ok = np.isfinite(v)
            total += np.where(ok, v, 0) * wt
            weight += ok * wt
    some = weight > 1e-9
    return np.where(some, total if zeros else total / np.where(some, weight, 1), np.nan)


def _spline_coefficients(cells: np.ndarray, axis: int) -> np.ndarray:
    """Coefficients of the cubic B-spline through the values along an axis; the last value goes on beyond the edges."""
    g = np.moveaxis(cells, axis, 0)
    c = 6.0 * np.concatenate((np.repeat(g[:1], PAD, axis=0), g, np.repeat(g[-1:], PAD, axis=0)))
    z = math.sqrt(3) - 2
    for i in range(1, len(c)):
        c[i] += z * c[i - 1]
    c[-1] *= z / (z - 1)
    for i in range(len(c) - 2, -1, -1):
        c[i] = z * (c[i + 1] - c[i])
    return np.moveaxis(c, 0, axis)


def _spectra(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)


def merged(sources: Sequence[tuple[DataFrame, Source]], grid: Grid, bands: int, method: str, fill: float | None = None, zeros: bool = False) -> DataFrame:
    """(y, x, spectrum array<double>) on the grid: the weighted mean of the sources (y, x, spectrum) that have a value. With
    fill every pixel of the grid is there, without only those with a value in a band. zeros: missing neighbours count as 0."""
    if method not in REACH:
        raise ValueError(f"unknown resampling {method!r}")
    places = [s for _, s in sources]
    spark = sources[0][0].sparkSession
    ship(spark)
    ratios, prints = [s.ratio(grid) for s in places], [s.footprint(grid) for s in places]
    tile = max(4, min(TILE, math.ceil(SOURCE_TILE * min(r for _, r in ratios))))
    ny, nx = -(-grid.height // tile), -(-grid.width // tile)
    schema = "ty int, tx int, k int, y int, x int, spectrum array<double>"

    def sender(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        place = places[k]
        reach = (REACH[method] + 1) * ratios[k][0] + 1.5

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                y, x = b.column(0).to_numpy().astype(float), b.column(1).to_numpy().astype(float)
                with np.errstate(all="ignore"):
                    ty, tx = place.on(grid, y, x)
                    near = [np.clip(np.floor(np.nan_to_num((t + d * reach) / tile, nan=-1e9)), -2, n + 1).astype(np.int64) for t, n in ((ty, ny), (tx, nx)) for d in (-1, 1)]
                y1, y2, x1, x2 = np.maximum(near[0], 0), np.minimum(near[1], ny - 1), np.maximum(near[2], 0), np.minimum(near[3], nx - 1)
                for i in range(max(0, int((y2 - y1).max()) + 1)):
                    for j in range(max(0, int((x2 - x1).max()) + 1)):
                        at = np.flatnonzero((y1 + i <= y2) & (x1 + j <= x2))
                        if len(at):
                            part = b.take(pa.array(at))
                            heads = [pa.array(v, pa.int32()) for v in (y1[at] + i, x1[at] + j, np.full(len(at), k))]
                            yield pa.RecordBatch.from_arrays([*heads, *part.columns], names=["ty", "tx", "k", "y", "x", "spectrum"])

        return send

    sent = [df.select("y", "x", num.doubles("spectrum").alias("spectrum")).filter("spectrum is not null").mapInArrow(sender(k), schema) for k, (df, _) in enumerate(sources)]
    if fill is not None:  # a row for each tile
        every = spark.range(ny * nx).selectExpr(f"cast(id div {nx} as int) ty", f"cast(id % {nx} as int) tx", "-1 k", "0 y", "0 x", "cast(array() as array<double>) spectrum")
        sent.append(every)

    def work(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        ys, xs = (np.arange(t * tile, min(n, (t + 1) * tile)) for t, n in ((ty, grid.height), (tx, grid.width)))
        y, x = (v.ravel() for v in np.meshgrid(ys, xs, indexing="ij"))
        total, weight = np.zeros((len(y), bands)), np.zeros((len(y), bands))
        ks = table.column("k").to_numpy()
        for k in range(len(places)):
            mine = table.filter(pa.array(ks == k))
            if not mine.num_rows:
                continue
            place = places[k]
            py, px, v = mine.column("y").to_numpy(), mine.column("x").to_numpy(), _spectra(mine.column("spectrum"))
            if place.nodata is not None:
                v = np.where(v == place.nodata, np.nan, v)
            y0, x0 = int(py.min()), int(px.min())
            cells = np.full((int(py.max()) - y0 + 1, int(px.max()) - x0 + 1, bands), np.nan)
            cells[py - y0, px - x0] = np.where(np.isfinite(v), v, np.nan)
            with np.errstate(all="ignore"):
                sy, sx = place.of(grid, y.astype(float), x.astype(float))
            sy, sx = centred(sy), centred(sx)
            inside = np.isfinite(sy) & np.isfinite(sx)
            if place.clamp:
                sy, sx = np.clip(sy, 0, place.height - 1), np.clip(sx, 0, place.width - 1)
            else:
                inside &= (sy >= -0.5) & (sy < place.height - 0.5) & (sx >= -0.5) & (sx < place.width - 0.5)
                if method != "average":
                    sy, sx = np.clip(sy, 0, place.height - 1), np.clip(sx, 0, place.width - 1)
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            if zeros and method == "spline":  # whose filter needs the missing ones as well, as far as it reaches
                far = int(REACH[method])
                low = [max(0, int(math.floor(v[at].min())) - far) for v in (sy, sx)]
                high = [min(n - 1, int(math.ceil(v[at].max())) + far) for v, n in ((sy, place.height), (sx, place.width))]
                whole = np.zeros((high[0] - low[0] + 1, high[1] - low[1] + 1, bands))
                held = (py >= low[0]) & (py <= high[0]) & (px >= low[1]) & (px <= high[1])
                whole[py[held] - low[0], px[held] - low[1]] = np.nan_to_num(cells[py[held] - y0, px[held] - x0])
                cells, y0, x0 = whole, *low
            got = interpolated(cells, y0, x0, sy[at], sx[at], method, prints[k], zeros)
            own = np.ones(len(at)) if place.weight is None else place.weight(y[at], x[at])
            ok = np.isfinite(got) & (own > 0)[:, None]
            total[at] += np.where(ok, got, 0) * own[:, None]
            weight[at] += ok * own[:, None]
        some = weight > 0
        out = np.where(some, total / np.where(some, weight, 1), np.nan if fill is None else fill)
        keep = np.flatnonzero(some.any(axis=1)) if fill is None else np.arange(len(y))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * bands, pa.int32()), pa.array(out[keep].ravel()))
        return pa.table([pa.array(y[keep], pa.int32()), pa.array(x[keep], pa.int32()), lists], names=["y", "x", "spectrum"])

    return reduce(DataFrame.unionByName, sent).groupBy("ty", "tx").applyInArrow(work, "y int, x int, spectrum array<double>")


def resized(df: DataFrame, size: tuple[int, int], target: tuple[int, int], bands: int, method: str = "bilinear", zeros: bool = False) -> DataFrame:
    """(y, x, spectrum) of a raster of size (height, width) on a grid of another size; the corners of both coincide. Cubic
    is the spline through the values. zeros: missing pixels, such as those of a last line that isn't full, count as 0."""
    if size == target:
        return df.select("y", "x", num.doubles("spectrum").alias("spectrum"))
    (h, w), (th, tw) = size, target
    grid = Grid(tw, th, (w / tw, 0.0, 0.0, 0.0, h / th, 0.0), "")
    source = Source(w, h, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0), "", clamp=True)
    return merged([(df, source)], grid, bands, "spline" if method == "cubic" else method, zeros=zeros)


def resample(band: DataFrame, size: tuple[int, int], target: tuple[int, int], method: str = "bilinear", zeros: bool = False) -> DataFrame:
    """(y, x, value) of one band on a grid of another size."""
    x = band.select("y", "x", F.array(F.col("value").cast("double")).alias("spectrum"))
    return resized(x, size, target, 1, method, zeros).select("y", "x", F.get("spectrum", F.lit(0)).alias("value"))
