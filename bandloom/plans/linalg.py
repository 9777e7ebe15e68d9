"""Small matrices from large tables: one pass of partial sums, then NumPy on a bands-by-bands matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship


def moments(df: DataFrame, vector: str = "spectrum", shift: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and Gram matrix of the all-finite vectors less shift. Each task sends one row of sums."""
    ship(df.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for b in batches:
            col = b.column(0)
            if not len(col):
                continue
            x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)
            x = x[np.isfinite(x).all(axis=1)]
            x = x if shift is None else x - shift
            n += len(x)
            s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
            g = x.T @ x if g is None else g + x.T @ x
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([g.ravel().tolist()])], names=["n", "s", "g"])

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v is not null").mapInArrow(partial, "n long, s array<double>, g array<double>")
    every = F.concat(F.array(F.col("n").cast("double")), "s", "g")
    each = rows.select(F.posexplode(every).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # bands * (bands + 1) rows
    if not each:
        return 0, np.zeros(0), np.zeros((0, 0))
    flat = np.zeros(len(each))
    for r in each:
        flat[r.i] = r.v
    b = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    return int(flat[0]), flat[1 : b + 1], flat[b + 1 :].reshape(b, b)


def mean_and_covariance(df: DataFrame, vector: str = "spectrum") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (n - 1), in two passes so that large offsets don't cancel."""
    head = df.select(F.col(vector).cast("array<double>").alias("v")).filter(F.forall("v", lambda e: ~F.isnan(e) & (F.abs(e) < float("inf")))).first()
    if head is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    shift = np.array(head[0])
    n, s, g = moments(df, vector, shift)
    mean = s / n
    cov = (g - n * np.outer(mean, mean)) / max(n - 1, 1)
    return n, mean + shift, cov


def class_moments(df: DataFrame, label: str, vector: str = "spectrum") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of each class, in one pass: a task sends a row of sums for each class it has seen. A class
    without finite vectors has count 0."""
    ship(df.sparkSession)
    head = df.select(F.col(vector).cast("array<double>").alias("v")).filter(F.forall("v", lambda e: ~F.isnan(e) & (F.abs(e) < float("inf")))).first()
    shift = np.array(head[0]) if head else None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
            c = b.column(0).to_numpy()
            for k in np.unique(c):
                own = x[c == k]
                own = own[np.isfinite(own).all(axis=1)] - (0 if shift is None else shift)
                flat = np.concatenate(([float(len(own))], own.sum(axis=0), (own.T @ own).ravel()))
                sums[int(k)] = sums[int(k)] + flat if int(k) in sums else flat
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["c", "s"])

    rows = df.select(F.col(label).cast("int").alias("c"), F.col(vector).cast("array<double>").alias("v")).filter("c is not null and v is not null")
    each = rows.mapInArrow(partial, "c int, s array<double>").select("c", F.posexplode("s").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"))
    flats: dict[int, dict[int, float]] = {}
    for r in each.collect():  # classes by bands * (bands + 1)
        flats.setdefault(r.c, {})[r.i] = r.v
    out = {}
    for c, cells in flats.items():
        flat = np.array([cells[i] for i in range(len(cells))])
        b, n = int((np.sqrt(4 * len(flat) - 3) - 1) / 2), int(flat[0])
        mean = flat[1 : b + 1] / max(n, 1)
        cov = (flat[b + 1 :].reshape(b, b) - n * np.outer(mean, mean)) / max(n - 1, 1)
        out[c] = (n, mean + (0 if shift is None else shift), cov)
    return out


def canonical(vectors: np.ndarray) -> np.ndarray:
    """Columns with a sign of their own: the largest loading is positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1, 1)


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and vectors as columns."""
    w, v = np.linalg.eigh(cov)
    return w[::-1], canonical(v[:, ::-1])
