"""Classification: spectral angle and divergence, clustering, maximum likelihood, support vectors, colouring.

Row-local work is one matrix product an Arrow batch against a small model (measured: an expression over 64 bands and 10
references takes seconds to compile and far more a pixel); clustering iterates with one grouped mean a round. Ties go to the lowest class, pixels that aren't finite are -1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from bandloom.plans import num
from bandloom.plans.linalg import class_moments
from bandloom.plans.num import lit
from bandloom.plans.ship import ship

UNCLASSIFIED = -1
# The colours of classes, in order.
PALETTE = [(0, 180, 0), (0, 100, 240), (180, 120, 60), (150, 150, 150), (240, 220, 40), (180, 50, 200), (255, 128, 0), (0, 220, 220), (220, 30, 30), (100, 200, 100)]


def class_means(df: DataFrame, label: str, vector: str = "spectrum") -> list[list[float]]:
    """The mean vector of each class, in order of the label: classes by bands."""
    x = df.select(F.col(label).alias("c"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "v"))
    rows = x.groupBy("c", "i").agg(F.avg("v").alias("v")).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m")).orderBy("c").collect()
    return [[e.v for e in r.m] for r in rows]


def angles(x: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles in radians, pixels by references. Bands in which a reference is NaN are left out of that angle."""
    known = np.isfinite(references)
    ref = np.where(known, references, 0)
    lengths = np.sqrt((x * x) @ known.T.astype(float)) if not known.all() else np.sqrt((x * x).sum(axis=1))[:, None]
    cos = (x @ ref.T) / (np.maximum(lengths, 1e-8) * np.maximum(np.linalg.norm(ref, axis=1), 1e-8))
    return np.arccos(np.clip(cos, -1, 1))


def divergences(x: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Spectral information divergences, pixels by references; values are floored at 1e-8 and scaled to sum 1."""
    p, q = np.maximum(x, 1e-8), np.maximum(references, 1e-8)
    p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
    lp, lq = np.log(p), np.log(q)
    return np.maximum((p * lp).sum(axis=1)[:, None] + (q * lq).sum(axis=1) - p @ lq.T - lp @ q.T, 0)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """In double, expanded about the centres' mean so that large offsets don't cancel."""
    mean = centres.mean(axis=0)
    y, c = x - mean, centres - mean
    return np.maximum((y * y).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * y @ c.T, 0)


def _nearest(df: DataFrame, spectrum: str, scores, table: Sequence[Sequence[float]], limit: float | None, rules: bool) -> DataFrame:
    """df with cls and score of the lowest score: one matrix product a batch, and no shuffle."""
    refs = np.asarray(table, float)

    def f(x: np.ndarray) -> list:
        ok = np.isfinite(x).all(axis=1)
        all_ = scores(np.where(ok[:, None], x, 1.0), refs)
        all_[~ok] = np.nan
        best = np.where(ok, np.nan_to_num(all_, nan=np.inf).argmin(axis=1), 0)
        own = all_[np.arange(len(x)), best]
        good = ok if limit is None else ok & (own <= limit)
        return [np.where(good, best, UNCLASSIFIED).astype(np.int32), own, all_][: 3 if rules else 2]

    names = {"cls": IntegerType(), "score": DoubleType()} | ({"rules": ArrayType(DoubleType())} if rules else {})
    return _kernel(df, spectrum, f, names)


def spectral_angle(df: DataFrame, references: Sequence[Sequence[float]], max_angle: float | None = None, spectrum: str = "spectrum", rules: bool = False) -> DataFrame:
    """df with cls and score (radians), and on demand all angles."""
    return _nearest(df, spectrum, angles, references, max_angle, rules)


def information_divergence(df: DataFrame, references: Sequence[Sequence[float]], max_divergence: float | None = None, spectrum: str = "spectrum", rules: bool = False) -> DataFrame:
    return _nearest(df, spectrum, divergences, references, max_divergence, rules)


def nearest_centre(df: DataFrame, centres: Sequence[Sequence[float]], spectrum: str = "spectrum") -> DataFrame:
    return _nearest(df, spectrum, squared_distances, centres, None, False)


def centre_means(df: DataFrame, centres: Sequence[Sequence[float]], spectrum: str = "spectrum") -> DataFrame:
    """(cls, band, centre, n): the means of the finite pixels nearest to each centre. A task assigns and sums its pixels in
    one kernel and sends a row for each class."""
    ship(df.sparkSession)
    table = np.asarray(centres, float)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(len(table), np.int64), np.zeros(table.shape)
        for b in batches:
            x = vectors(b.column(0)) if b.num_rows else np.zeros((0, table.shape[1]))
            x = x[np.isfinite(x).all(axis=1)]
            cls = squared_distances(x, table).argmin(axis=1)
            n += np.bincount(cls, minlength=len(table))
            s += (np.arange(len(table))[:, None] == cls).astype(float) @ x
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array([s[c].tolist() for c in some], pa.list_(pa.float64()))], names=["cls", "n", "s"])

    rows = df.select(num.doubles(spectrum).alias("v")).filter("v is not null").mapInArrow(sums, "cls int, n long, s array<double>")
    each = rows.select("cls", "n", F.posexplode("s").alias("band", "v")).groupBy("cls", "band").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return each.select("cls", "band", (F.col("v") / F.col("n")).alias("centre"), "n")


def kmeans_step(df: DataFrame, centres: Sequence[Sequence[float]], spectrum: str = "spectrum") -> tuple[np.ndarray, np.ndarray]:
    """New centres (NaN for an empty class) and members of each class after one assignment."""
    out, members = np.full((len(centres), len(centres[0])), np.nan), np.zeros(len(centres), np.int64)
    for r in centre_means(df, centres, spectrum).collect():  # classes by bands
        out[r.cls, r.band], members[r.cls] = r.centre, r.n
    return out, members


def kmeans(df: DataFrame, classes: int = 4, max_iter: int = 20, tol: float = 1e-4, seed: int = 42, spectrum: str = "spectrum", key: Sequence[str] = ("y", "x"), start: Sequence[Sequence[float]] | None = None) -> tuple[DataFrame, np.ndarray]:
    """df with cls and score (squared distance), and the centres. Rounds use all finite pixels; the first centres are given
    by start, or are the rows with the lowest seeded hash of the key, so a rerun starts alike. Empty classes start anew
    from the next rows."""
    order = F.xxhash64(lit(seed), *key)
    rows = df.select(*key, num.doubles(spectrum).alias("_s")).filter(num.all_finite(F.col("_s")))
    seeds = [np.array(c, float) for c in start or ()] or [np.array(r[0]) for r in rows.orderBy(order, *key).limit(classes * 3).select("_s").collect()]
    classes = len(start) if start else classes
    if not seeds:
        return df.withColumns({"cls": lit(UNCLASSIFIED), "score": lit(float("nan"))}), np.zeros((0, 0))
    centres, spare = np.array(seeds[:classes]), seeds[classes:]
    for _ in range(max_iter):
        new, members = kmeans_step(df, centres.tolist(), spectrum)
        for c in np.flatnonzero(members == 0):
            new[c] = spare.pop(0) if spare else centres[c]
        moved = float(np.linalg.norm(new - centres))
        centres = new
        if moved < tol:
            break
    return nearest_centre(df, centres.tolist(), spectrum), centres


def isodata(df: DataFrame, classes: int = 4, min_members: int = 10, max_iter: int = 10, seed: int = 42, spectrum: str = "spectrum", key: Sequence[str] = ("y", "x"), start: Sequence[Sequence[float]] | None = None) -> tuple[DataFrame, np.ndarray]:
    """K-means of five rounds, then rounds that drop classes of fewer than min_members and move the others."""
    _, centres = kmeans(df, classes, 5, seed=seed, spectrum=spectrum, key=key, start=start)
    for _ in range(max_iter if len(centres) else 0):
        new, members = kmeans_step(df, centres.tolist(), spectrum)
        keep = members >= min_members
        if not keep.any():
            break
        done = keep.all() and np.linalg.norm(new - centres) < 1e-4
        centres = new[keep]
        if done:
            break
    return (nearest_centre(df, centres.tolist(), spectrum) if len(centres) else df.withColumns({"cls": lit(UNCLASSIFIED), "score": lit(float("nan"))})), centres


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_quantile(p: float, df: int) -> float:
    """The value below which chi-squared of df degrees lies with probability p."""
    lo, hi = 0.0, float(df)
    while gamma_p(df / 2, hi / 2) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def vectors(column: pa.Array) -> np.ndarray:
    """A matrix of lists of one length; null lists are rows of NaN."""
    if not column.null_count:
        return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r is not None), default=0)
    return np.array([[np.nan] * width if r is None else r for r in rows], np.float64).reshape(len(rows), width)


def _kernel(df: DataFrame, spectrum: str, f, names: Mapping[str, object]) -> DataFrame:
    """df with columns that f makes from a matrix of the pixels' bands, batch by batch."""
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, *(StructField(n, kind) for n, kind in names.items())])
    arrow = {IntegerType(): pa.int32(), DoubleType(): pa.float64(), ArrayType(DoubleType()): pa.list_(pa.float64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors(b.column(spectrum))
            made = f(x) if b.num_rows else [[] for _ in names]
            cols = [pa.array(list(m) if isinstance(kind, ArrayType) else m, arrow[kind]) for m, kind in zip(made, names.values())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def maximum_likelihood(df: DataFrame, training: DataFrame, probability: float = 0.0, sample_priors: bool = False, spectrum: str = "spectrum") -> DataFrame:
    """df with cls and score (squared Mahalanobis distance). Gaussian classes of training(class_id, spectrum); with a
    probability, pixels farther than the chi-squared quantile of 1 - probability are -1."""
    found = class_moments(training, "class_id")
    ids = sorted(found)
    if len(ids) < 2:
        raise ValueError("two classes or more are needed")
    models = []
    for c in ids:
        n, mean, cov = found[c]
        if not n:
            raise ValueError(f"class {c} has no finite pixels")
        b = len(mean)
        cov = cov + (1e-4 * np.trace(cov) / b + 1e-6) * np.eye(b)
        models.append((n, mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]))
    total = sum(m[0] for m in models)
    limit = chi2_quantile(1 - probability, len(models[0][1])) if probability > 0 else None

    def f(x: np.ndarray) -> list:
        ok = np.isfinite(x).all(axis=1)
        d2, score = np.empty((len(models), len(x))), np.empty((len(models), len(x)))
        for k, (n, mean, inverse, logdet) in enumerate(models):
            y = np.where(ok[:, None], x - mean, 0)
            d2[k] = np.einsum("ij,jk,ik->i", y, inverse, y)
            score[k] = (math.log(n / total) if sample_priors else 0) - 0.5 * (logdet + d2[k])
        best = score.argmax(axis=0)
        own = d2[best, np.arange(len(x))]
        good = ok if limit is None else ok & (own <= limit)
        return [np.where(good, np.array(ids)[best], UNCLASSIFIED).astype(np.int32), np.where(ok, own, np.nan)]

    return _kernel(df, spectrum, f, {"cls": IntegerType(), "score": DoubleType()})


def thematic_rgb(cls: Column, palette: Sequence[tuple[int, int, int]] | Mapping[int, tuple[int, int, int]] = PALETTE, unclassified: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """struct(r, g, b): a list is used in turn, a mapping leaves classes that it doesn't name unclassified."""
    rgb = lambda c: F.struct(*(lit(v).alias(n) for n, v in zip("rgb", c)))
    if isinstance(palette, Mapping):
        out = F.when(cls < 0, rgb(unclassified))
        for k, c in palette.items():
            out = out.when(cls == k, rgb(c))
        return out.otherwise(rgb(unclassified))
    return F.when(cls < 0, rgb(unclassified)).otherwise(F.get(F.array(*map(rgb, palette)), (cls % len(palette)).cast("int")))
