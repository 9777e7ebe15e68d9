"""Spectral transforms: components, noise whitening, independent sources, endmembers, unmixing, continuum removal.

Statistics of the whole image are partial sums of each task; matrices of bands by bands are worked out on the driver and
go back to the rows as literals or in an Arrow kernel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from bandloom.plans import num
from bandloom.plans.linalg import canonical, eigen, mean_and_covariance, moments
from bandloom.plans.num import lit
from bandloom.plans.raster import BandInfo, Raster
from bandloom.plans.ship import ship

from .classify import _kernel, vectors


def component_report(kind: str, name: str, bands: int, values: Sequence[float], shares: Sequence[float] = ()) -> str:
    """What the components of a transform hold, as text. kind pca: values are eigenvalues, shares their parts of the
    variance; mnf: eigenvalues, from which the signal to noise follows; ica: standard deviations of the components."""
    title, each = {
        "pca": ("Principal components", lambda i, v: f"PC {i}: eigenvalue {v:.4e}, variance {100 * shares[i - 1]:.2f} %"),
        "mnf": ("Minimum noise fraction", lambda i, v: f"MNF {i}: eigenvalue {v:.4f}, estimated SNR {max(0.0, v - 1):.2f}"),
        "ica": ("Independent components", lambda i, v: f"IC {i}: standard deviation {v:.4f}"),
    }[kind]
    lines = [f"{title} of {name}", f"Bands: {bands}", f"Components: {len(values)}", *(each(i, float(v)) for i, v in enumerate(values, 1))]
    if kind == "pca":
        lines.append(f"Variance explained: {100 * sum(shares):.2f} %")
    return "\n".join(lines)


def abundance_raster(r: Raster, members: np.ndarray) -> Raster:
    """A raster with a band for each member's share; 0 is its nodata value."""
    x = abundances(r.df, members).select("y", "x", F.col("abundance").alias("spectrum"))
    details = tuple(BandInfo(i, f"Endmember {i + 1}") for i in range(len(members)))
    return Raster(replace(r.meta, bands=len(members), dtype="float32", nodata=0.0, band_details=details, default_bands=None), x, f"{r.name} abundance")


def project(df: DataFrame, weights: np.ndarray, mean: np.ndarray, spectrum: str = "spectrum", out: str = "scores") -> DataFrame:
    """df with weights' rows times (spectrum - mean); NaN for pixels that aren't finite."""

    def f(x: np.ndarray) -> list:
        ok = np.isfinite(x).all(axis=1)
        y = np.where(ok[:, None], x - mean, 0) @ weights.T
        y[~ok] = np.nan
        return [y]

    return _kernel(df, spectrum, f, {out: ArrayType(DoubleType())})


def without_scores(df: DataFrame, components: int, spectrum: str) -> tuple[DataFrame, int, int]:
    """df with scores of NaN, for an image without a valid pixel; its bands; how many components are kept."""
    head = df.select(F.size(spectrum)).filter(F.col(spectrum).isNotNull()).first()
    bands = head[0] if head else 0
    return df.withColumn("scores", F.array_repeat(lit(float("nan")), min(components, bands))), bands, min(components, bands)


def pca(df: DataFrame, components: int = 3, spectrum: str = "spectrum") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """df with scores; all eigenvalues; the share of variance of each kept component. Without a valid pixel all are NaN or 0."""
    n, mean, cov = mean_and_covariance(df, spectrum)
    if not n:
        out, bands, k = without_scores(df, components, spectrum)
        return out, np.zeros(bands), np.zeros(k)
    values, vectors = eigen(cov)
    k = min(components, len(values))
    total = values.sum()
    return project(df, vectors[:, :k].T, mean, spectrum), values, values[:k] / total if total > 0 else np.zeros(k)


def differences(df: DataFrame, spectrum: str = "spectrum") -> DataFrame:
    """(d): each pixel less its left neighbour, within a line; the window is one line of the image."""
    line = Window.partitionBy("y").orderBy("x")
    x = df.select("y", "x", num.doubles(spectrum).alias("_s"), F.lag(num.doubles(spectrum)).over(line).alias("_p"), F.lag("x").over(line).alias("_px"))
    return x.filter((F.col("x") - F.col("_px") == 1)).select(F.zip_with("_s", "_p", lambda a, b: a - b).alias("d"))


def difference_covariance(df: DataFrame, spectrum: str = "spectrum") -> tuple[int, np.ndarray]:
    """Count and covariance of differences(). Neighbours that a task reads one after the other, as rasters are stored, are
    taken there; only pixels whose neighbour lies elsewhere are shuffled. It reads the image twice."""
    ship(df.sparkSession)
    pixels = df.select("y", "x", num.doubles(spectrum).alias("s")).filter("s is not null")

    def pairs(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        y, x = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy().astype(np.int64)
        v = vectors(b.column(2))
        next_to = (y[1:] == y[:-1]) & (x[1:] == x[:-1] + 1) if len(y) else np.zeros(0, bool)
        first = np.concatenate((~next_to, [True]))[: len(y)] if len(y) else next_to  # without a right neighbour here
        last = np.concatenate(([True], ~next_to))[: len(y)] if len(y) else next_to  # without a left one
        return v, next_to, first, last

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, next_to, _, _ = pairs(b)
            d = (v[1:] - v[:-1])[next_to] if b.num_rows else v
            yield pa.RecordBatch.from_arrays([pa.array(list(d), pa.list_(pa.float64()))], names=["d"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, first, last = pairs(b)
            at = np.flatnonzero(first | last)
            part = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(first[at]), pa.array(last[at])], names=["y", "x", "s", "r", "l"])

    inside = pixels.mapInArrow(inner, "d array<double>")
    line = Window.partitionBy("y").orderBy("x")
    x = pixels.mapInArrow(edges, "y int, x int, s array<double>, r boolean, l boolean")
    x = x.withColumns({"_p": F.lag("s").over(line), "_px": F.lag("x").over(line), "_r": F.lag("r").over(line)})
    met = x.filter((F.col("x") - F.col("_px") == 1) & F.col("l") & F.col("_r")).select(F.zip_with("s", "_p", lambda a, b: a - b).alias("d"))
    parts = [moments(part, "d") for part in (inside, met)]
    n = sum(p[0] for p in parts)
    if not n:
        return 0, np.zeros((0, 0))
    s, g = (sum(p[i] for p in parts if p[0]) for i in (1, 2))  # differences are small and centred: one pass is exact enough
    return n, (g - np.outer(s, s) / n) / max(n - 1, 1)


def mnf(df: DataFrame, components: int = 3, spectrum: str = "spectrum") -> tuple[DataFrame, np.ndarray]:
    """df with scores of the minimum noise fraction, and the eigenvalues (signal to noise + 1) of the kept ones. Noise is
    half the covariance of neighbours' differences; the image is whitened by it before components are taken."""
    valid_pixels, mean, cov = mean_and_covariance(df, spectrum)
    if not valid_pixels:
        out, _, k = without_scores(df, components, spectrum)
        return out, np.zeros(k)
    n, noise = difference_covariance(df, spectrum)
    b = len(mean)
    if not n:
        out, values, _ = pca(df, components, spectrum)
        return out, values[:components]
    noise = noise / 2 + 1e-6 * np.eye(b)
    inverse = np.linalg.inv(np.linalg.cholesky(noise))
    values, vectors = eigen(inverse @ cov @ inverse.T)
    k = min(components, b)
    return project(df, vectors[:, :k].T @ inverse, mean, spectrum), values[:k]


CONTRASTS = {
    "logcosh": (np.tanh, lambda u, g: 1 - g**2),
    "exp": (lambda u: u * np.exp(-(u**2) / 2), lambda u, g: (1 - u**2) * np.exp(-(u**2) / 2)),
    "cube": (lambda u: u**3, lambda u, g: 3 * u**2),
}


def ica(df: DataFrame, components: int = 3, max_iter: int = 200, tol: float = 1e-4, algorithm: str = "parallel", fun: str = "logcosh", random_state: int = 42, spectrum: str = "spectrum", sample: int = 50_000, key: Sequence[str] = ("y", "x")) -> tuple[DataFrame, np.ndarray]:
    """df with independent components, and the mixing matrix. Whitening uses all pixels; the rotation is found by fixed
    points on a sample of at most `sample` pixels (the lowest seeded hashes of the key), as it is a fit of a few numbers."""
    if fun not in CONTRASTS:
        raise ValueError(f"unknown contrast {fun!r}")
    n, mean, cov = mean_and_covariance(df, spectrum)
    k = min(components, len(mean))
    if n < k + 1:
        raise ValueError("too few valid pixels")
    values, vectors = eigen(cov)
    k = max(1, min(k, int((values > values[0] * 1e-12).sum())))
    white = (vectors[:, :k] / np.sqrt(values[:k])).T
    z = (sampled(df, sample, random_state, key, spectrum) - mean) @ white.T
    g, dg = CONTRASTS[fun]
    rng = np.random.default_rng(random_state)
    w = rng.normal(size=(k, k))

    def decorrelated(w: np.ndarray) -> np.ndarray:
        u, s, vt = np.linalg.svd(w, full_matrices=False)
        return u @ vt

    if algorithm == "parallel":
        w = decorrelated(w)
        for _ in range(max_iter):
            u = z @ w.T
            gu = g(u)
            new = decorrelated(gu.T @ z / len(z) - dg(u, gu).mean(axis=0)[:, None] * w)
            change = np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1).max()
            w = new
            if change < tol:
                break
    else:
        for i in range(k):
            v = w[i] / np.linalg.norm(w[i])
            for _ in range(max_iter):
                u = z @ v
                gu = g(u)
                new = z.T @ gu / len(z) - dg(u, gu).mean() * v
                new -= w[:i].T @ (w[:i] @ new)
                new /= np.linalg.norm(new)
                change = abs(abs(new @ v) - 1)
                v = new
                if change < tol:
                    break
            w[i] = v
    unmixing = canonical((w @ white).T).T
    return project(df, unmixing, mean, spectrum), np.linalg.pinv(unmixing)


def sampled(df: DataFrame, most: int, seed: int, key: Sequence[str], spectrum: str) -> np.ndarray:
    """Finite spectra, `most` at most: those of the lowest seeded hashes of the key. They are fetched below a bound on the
    hash under which a few more are expected; only where too few are there (equal keys have equal hashes) are rows sorted."""
    x = df.select(num.doubles(spectrum).alias("s"), F.xxhash64(lit(seed), *key).alias("h")).filter(num.all_finite(F.col("s")))
    n = x.count()
    low = x
    if n > most:
        low = x.filter(F.col("h") <= lit(min((1 << 63) - 1, -(1 << 63) + (1 << 64) * (most + 50 + 6 * math.isqrt(most)) // n)))
    rows = low.limit(2 * most + 1000).collect()
    if len(rows) < min(n, most) or len(rows) > 2 * most:
        rows = x.orderBy("h", "s").limit(most).collect()
    return np.array([s for _, s in sorted((r.h, r.s) for r in rows)[:most]])


def hull_directions(x: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Up to count unit vectors of pixels that are extreme along random axes, no two of them nearly the same; the mean's if
    there is none."""
    axes = np.random.default_rng(seed).normal(size=(x.shape[1], 40 * count))
    found: list[np.ndarray] = []
    for i in dict.fromkeys((x @ axes).argmax(axis=0).tolist()):
        norm = np.linalg.norm(x[i])
        if norm > 1e-9 and all(x[i] @ u / norm <= 0.999 for u in found):
            found.append(x[i] / norm)
        if len(found) == count:
            break
    mean = x.mean(axis=0)
    return np.array(found) if found else (mean / np.linalg.norm(mean) if mean.any() else np.full(len(mean), len(mean) ** -0.5))[None]


def fitted_directions(x: np.ndarray, starts: np.ndarray, rounds: int, tolerance: float, inlier_fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """Each start after its search, and the mean of what it leaves of the pixels, relative to their lengths. A round moves a
    direction to the mean of the pixels in its basin (the inlier_fraction that it explains best), weighted by projection over
    residual. All directions move together: their projections are one matrix product."""
    lengths = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
    u, moving = starts.copy(), np.arange(len(starts))
    for _ in range(rounds):
        z = x @ u[moving].T
        off = np.sqrt(np.maximum(lengths[:, None] ** 2 - z**2, 0)) / lengths[:, None]
        basin = off <= np.quantile(off, inlier_fraction, axis=0)
        still = []
        for k, i in enumerate(moving):
            own = x[basin[:, k]]
            along = z[basin[:, k], k]
            rest = np.linalg.norm(own - np.outer(along, u[i]), axis=1)
            step = (np.maximum(along, 0) / np.maximum(rest, 1e-12)) @ own
            size = np.linalg.norm(step)
            if size < 1e-12:
                continue
            step /= size
            if np.linalg.norm(step - u[i]) >= tolerance:
                still.append(i)
            u[i] = step
        moving = np.array(still, int)
        if not len(moving):
            break
    return u, off_ray(x, u, lengths).mean(axis=0)


def off_ray(x: np.ndarray, u: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How far pixels are from the rays along unit vectors, relative to their lengths: pixels by vectors."""
    z = np.maximum(x @ u.T, 0)
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x)[:, None] - z**2, 0)) / lengths[:, None]


def scene_residuals(df: DataFrame, directions: np.ndarray, spectrum: str) -> np.ndarray:
    """The mean of off_ray() over all finite pixels of the image, in one pass: a task sends its sums."""
    ship(df.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(directions))
        for b in batches:
            if b.num_rows:
                x = vectors(b.column(0))
                x = np.maximum(x[np.isfinite(x).all(axis=1)], 0)
                n += len(x)
                total += off_ray(x, directions, np.maximum(np.linalg.norm(x, axis=1), 1e-12)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], names=["n", "total"])

    each = df.select(num.doubles(spectrum).alias("s")).filter("s is not null").mapInArrow(sums, "n long, total array<double>")
    row = each.agg(F.sum("n"), *(F.sum(F.get("total", lit(i))) for i in range(len(directions)))).first()
    return np.array(row[1:]) / row[0]


def endmembers(df: DataFrame, count: int = 0, max_iterations: int = 60, tolerance: float = 1e-6, inlier_fraction: float = 0.15, spectral_fraction: float = 0.02, min_variance_fraction: float = 0.001, max_samples: int = 20_000, seed: int = 42, spectrum: str = "spectrum", key: Sequence[str] = ("y", "x")) -> tuple[np.ndarray, np.ndarray]:
    """(endmember spectra, mean relative residual of the image against each): spectral feature fitting.

    An endmember is a ray from the origin onto which spectra collapse (negative values are noise and count as 0). Directions
    start at vertices of the hull, are refined within their basins (fitted_directions()), and the one that leaves least is
    taken. What all taken so far explain together, by least squares, is taken off the spectra before the next search. An
    endmember's spectrum is the mean of the spectral_fraction of pixels nearest to its ray. The search works on at most
    max_samples pixels, on the driver; residuals are those of the whole image, before anything is taken off. Without a count,
    there are as many as the covariance has eigenvalues above min_variance_fraction of its largest."""
    x = sampled(df, max_samples, seed, key, spectrum)
    if x.ndim < 2 or len(x) <= x.shape[1]:
        raise ValueError("more pixels than bands are needed")
    bands = x.shape[1]
    if count <= 0:
        values = np.linalg.eigvalsh(np.atleast_2d(np.cov(x.T)))
        count = int((values > values.max() * max(min_variance_fraction, bands * np.finfo(float).eps)).sum())
    count = min(max(count, 1), bands)
    x = np.maximum(x, 0)
    left, taken = x, np.zeros((0, bands))
    for k in range(count):
        starts = hull_directions(left, min(12, max(2, 4 * count)), seed + k)
        found, residual = fitted_directions(left, starts, max_iterations, tolerance, inlier_fraction)
        taken = np.vstack([taken, found[residual.argmin()]])
        left = np.maximum(x - x @ np.linalg.pinv(taken) @ taken, 0)
    off = off_ray(x, taken, np.maximum(np.linalg.norm(x, axis=1), 1e-12))
    near = off <= np.maximum(np.quantile(off, spectral_fraction, axis=0), off.min(axis=0))
    return np.array([x[near[:, k]].mean(axis=0) for k in range(count)]), scene_residuals(df, taken, spectrum)


def abundances(df: DataFrame, members: np.ndarray, spectrum: str = "spectrum", out: str = "abundance") -> DataFrame:
    """df with non-negative least-squares shares: the pseudo-inverse is a small literal matrix."""
    inverse = np.linalg.pinv(np.asarray(members, float)).T  # members by bands
    shares = F.transform(num.matvec(inverse.tolist(), num.doubles(spectrum)), lambda v: F.greatest(v, lit(0.0)))
    return df.withColumn(out, shares)


def upper_hulls(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which places (pixel, band) are corners of each pixel's upper hull. All pixels keep a stack of corners and take the bands
    in step; those whose last corner lies under the new line drop it, until none does."""
    n, bands = y.shape
    stack, held = np.zeros((n, bands), np.int64), np.zeros(n, np.int64)
    for i in range(bands):
        at = np.flatnonzero(held > 1)
        while len(at):
            a, b = stack[at, held[at] - 2], stack[at, held[at] - 1]
            ya = y[at, a]
            at = at[~((x[b] - x[a]) * (y[at, i] - ya) < (y[at, b] - ya) * (x[i] - x[a]))]
            held[at] -= 1
            at = at[held[at] > 1]
        stack[np.arange(n), held] = i
        held += 1
    corner = np.zeros((n, bands), bool)
    pixel, place = np.nonzero(np.arange(bands) < held[:, None])
    corner[pixel, stack[pixel, place]] = True
    return corner


def continua(spectra: np.ndarray, wavelengths: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(spectra over their upper hulls, hulls) of a matrix of pixels; shorter than three bands they stay."""
    y = np.asarray(spectra, float)
    bands = y.shape[1]
    if bands < 3:
        return y.copy(), y.copy()
    x = np.arange(bands, dtype=float) if wavelengths is None else np.asarray(wavelengths, float)
    corner, place = upper_hulls(x, y), np.arange(bands)
    left = np.maximum.accumulate(np.where(corner, place, 0), axis=1)
    right = np.minimum.accumulate(np.where(corner, place, bands - 1)[:, ::-1], axis=1)[:, ::-1]
    yl, yr = np.take_along_axis(y, left, axis=1), np.take_along_axis(y, right, axis=1)
    share = (x - x[left]) / np.where(left == right, 1, x[right] - x[left])
    hull = np.maximum(yl + (yr - yl) * share, 1e-7)
    return np.clip(y / hull, 0, 1), hull


def continuum_1d(spectrum: Sequence[float], wavelengths: Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same for one spectrum."""
    removed, hull = continua(np.asarray(spectrum, float)[None], wavelengths)
    return removed[0], hull[0]


def continuum_removed(df: DataFrame, wavelengths: Sequence[float] | None = None, spectrum: str = "spectrum", out: str = "cr") -> DataFrame:
    return _kernel(df, spectrum, lambda x: [continua(x, wavelengths)[0]], {out: ArrayType(DoubleType())})
