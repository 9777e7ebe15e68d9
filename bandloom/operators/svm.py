"""Support vector machines: trained from a bounded sample, a task for each fit, and applied in an Arrow kernel.

Two-class machines for all pairs of classes are fitted by sequential minimal optimisation; sigmoids on cross-validated
decisions give pair probabilities, which are coupled into one distribution for each pixel. The sample, max_samples of each
class at most, goes to all tasks; a task fits one fold of one pair, so it holds the kernel matrix of two classes at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from bandloom.plans import num
from bandloom.plans.num import lit
from bandloom.plans.ship import ship

from .classify import UNCLASSIFIED, _kernel

#: Kernel values that a task holds at once.
CELLS = 1 << 23
#: Parts that decisions are cross-validated on.
FOLDS = 5
#: Spectra up to which the driver fits machines itself, in less time than tasks take to begin.
FEW = 500


def kernel(name: str, a: np.ndarray, b: np.ndarray, gamma: float, degree: int, coef0: float) -> np.ndarray:
    if name == "linear":
        return a @ b.T
    if name == "poly":
        return (gamma * (a @ b.T) + coef0) ** degree
    if name == "sigmoid":
        return np.tanh(gamma * (a @ b.T) + coef0)
    if name == "rbf":
        return np.exp(-gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))
    raise ValueError(f"unknown kernel {name!r}")


def smo(k: np.ndarray, y: np.ndarray, c: float, tol: float = 1e-3, rounds: int = 20_000) -> tuple[np.ndarray, float]:
    """Multipliers and offset of the machine for kernel matrix k and signs y: the most violating pair is moved."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(rounds):
        score = -y * g
        up = ((y > 0) & (a < c)) | ((y < 0) & (a > 0))
        low = ((y < 0) & (a < c)) | ((y > 0) & (a > 0))
        i, j = int(np.argmax(np.where(up, score, -np.inf))), int(np.argmin(np.where(low, score, np.inf)))
        gap = score[i] - score[j]
        if gap < tol:
            break
        step = gap / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, c - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += y * step * (k[:, i] - k[:, j])
    score = -y * g
    up = ((y > 0) & (a < c)) | ((y < 0) & (a > 0))
    low = ((y < 0) & (a < c)) | ((y > 0) & (a > 0))
    return a * y, float((score[up].max(initial=-1e9) + score[low].min(initial=1e9)) / 2)


def sigmoid(f: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | f) = 1 / (1 + exp(a f + b)), by Newton's method on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((neg + 1) / (pos + 1)))

    def loss(a: float, b: float) -> float:
        z = a * f + b
        return float((t * z + np.logaddexp(0, -z)).sum())

    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(a * f + b, -500, 500)))
        d, w = t - p, p * (1 - p)
        grad = np.array([(f * d).sum(), d.sum()])
        hess = np.array([[(f * f * w).sum() + 1e-12, (f * w).sum()], [(f * w).sum(), w.sum() + 1e-12]])
        if np.abs(grad).max() < 1e-5:
            break
        step, size, now = np.linalg.solve(hess, grad), 1.0, loss(a, b)
        while size > 1e-10 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
    return a, b


def coupled(pair: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Class probabilities, pixels by classes, from pair[:, i, j] = P(i | i or j)."""
    n, k, _ = pair.shape
    q = -pair * pair.transpose(0, 2, 1)
    diagonal = np.einsum("nij->ni", pair.transpose(0, 2, 1) ** 2) - np.einsum("nii->ni", pair) ** 2
    q[:, np.arange(k), np.arange(k)] = diagonal
    p = np.full((n, k), 1 / k)
    for _ in range(rounds):
        qp = np.einsum("nij,nj->ni", q, p)
        pqp = np.einsum("ni,ni->n", p, qp)
        if np.abs(qp - pqp[:, None]).max(initial=0) < 0.005 / k:
            break
        for t in range(k):
            qp = np.einsum("nij,nj->ni", q, p)
            pqp = np.einsum("ni,ni->n", p, qp)
            p[:, t] += (pqp - qp[:, t]) / np.maximum(q[:, t, t], 1e-12)
            p = np.maximum(p, 1e-12)
            p /= p.sum(axis=1, keepdims=True)
    return p


def sample(training: DataFrame, max_samples: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """At most max_samples finite spectra of each class, those with the lowest seeded hashes. Classes are counted, then one
    job fetches the spectra whose hashes lie so low that about twice as many are expected, and the rest is cut off. A class
    that falls short of that, as equal spectra have equal hashes, is a top-k of its own."""
    x = training.select("class_id", num.doubles("spectrum").alias("s")).filter(num.all_finite(F.col("s")))
    x = x.withColumn("h", F.xxhash64(lit(seed), "s"))
    counts = {r.class_id: r["count"] for r in x.groupBy("class_id").count().collect()}
    low = lit(False)
    for c, n in counts.items():
        bound = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 2 * (max_samples + 50) // n)
        low = F.when(F.col("class_id") == c, F.col("h") <= lit(bound)).otherwise(low)
    found: dict = {c: [] for c in counts}
    once = x.filter(low).groupBy("class_id", "h", "s").agg(F.count("*").alias("n"))  # equal spectra come as one row
    for r in once.collect():
        found[r.class_id].append((r.h, r.s, r.n))
    rows = []
    for c in sorted(counts):
        own = [s for _, s, n in sorted(found[c]) for _ in range(min(n, max_samples))][:max_samples]
        if len(own) < min(max_samples, counts[c]):
            own = [r.s for r in x.filter(F.col("class_id") == c).orderBy("h", "s").limit(max_samples).collect()]
        rows += [(c, s) for s in own]
    return np.array([s for _, s in rows]), np.array([c for c, _ in rows])


def fitted(spark: SparkSession, x: np.ndarray, labels: np.ndarray, kernel_name: str, c: float, gamma: float, degree: int, coef0: float) -> list[tuple]:
    """(i, j, rows of x, multipliers, offset, slope and offset of the sigmoid) of the machine for each pair of classes."""
    ids = np.unique(labels)
    pairs = [(i, j) for i in range(len(ids)) for j in range(i + 1, len(ids))]
    tasks = [(p, f) for f in range(-1, FOLDS) for p in range(len(pairs))]  # fold -1: the machine of all rows, which takes longest

    def one(task: tuple[int, int], x: np.ndarray, labels: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray, float]:
        """Pair, fold, and the multipliers and offset, or the decisions on what the fold holds out."""
        p, f = task
        rows = np.flatnonzero((labels == ids[pairs[p][0]]) | (labels == ids[pairs[p][1]]))
        y = np.where(labels[rows] == ids[pairs[p][0]], 1.0, -1.0)
        fold = np.arange(len(rows)) % FOLDS
        fit, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if f >= 0 and (len(np.unique(y[fit])) < 2 or not len(test)):
            return p, f, test, np.zeros(len(test)), 0.0
        w, b = smo(kernel(kernel_name, x[rows[fit]], x[rows[fit]], gamma, degree, coef0), y[fit], c)
        if f < 0:
            return p, f, rows, w, b
        return p, f, test, kernel(kernel_name, x[rows[test]], x[rows[fit]], gamma, degree, coef0) @ w + b, 0.0

    if len(x) <= FEW:
        done = [one(t, x, labels) for t in tasks]
    else:
        ship(spark)
        sent = spark.sparkContext.broadcast((x, labels))
        done = spark.sparkContext.parallelize(tasks, len(tasks)).map(lambda t: one(t, *sent.value)).collect()
        sent.unpersist()
    found = {(p, f): rest for p, f, *rest in done}
    machines = []
    for p, (i, j) in enumerate(pairs):
        rows, w, b = found[p, -1]
        held = np.zeros(len(rows))
        for f in range(FOLDS):
            held[found[p, f][0]] = found[p, f][1]
        used = np.abs(w) > 1e-12
        machines.append((i, j, rows[used], w[used], b, *sigmoid(held, np.where(labels[rows] == ids[i], 1.0, -1.0))))
    return machines


def classify(df: DataFrame, training: DataFrame, kernel_name: str = "rbf", c: float = 100.0, gamma: float | str = "scale", degree: int = 3, coef0: float = 0.0, probability: float = 0.0, max_samples: int = 2000, spectrum: str = "spectrum") -> DataFrame:
    """df with cls and probabilities (by ascending class id); below the probability, and for pixels that aren't finite,
    cls is -1."""
    x, labels = sample(training, max_samples)
    ids = np.unique(labels)
    if len(ids) < 2:
        raise ValueError("two classes or more are needed")
    width = float(gamma) if gamma != "scale" else 1 / (x.shape[1] * max(x.var(), 1e-12))
    machines = fitted(df.sparkSession, x, labels, kernel_name, c, width, degree, coef0)
    support = np.unique(np.concatenate([m[2] for m in machines]))
    machines = [(i, j, np.searchsorted(support, rows), *rest) for i, j, rows, *rest in machines]
    x, step = x[support], max(64, CELLS // max(1, len(support)))

    def f(pixels: np.ndarray) -> list:
        ok = np.isfinite(pixels).all(axis=1)
        p = np.zeros((len(pixels), len(ids)))
        cls = np.full(len(pixels), UNCLASSIFIED, np.int32)
        for at in range(0, len(pixels), step):
            part = slice(at, at + step)
            k = kernel(kernel_name, np.where(ok[part, None], pixels[part], 0), x, width, degree, coef0)
            pair = np.full((len(k), len(ids), len(ids)), 0.5)
            for i, j, rows, w, b, slope, offset in machines:
                one = 1 / (1 + np.exp(np.clip(slope * (k[:, rows] @ w + b) + offset, -500, 500)))
                one = np.clip(one, 1e-7, 1 - 1e-7)
                pair[:, i, j], pair[:, j, i] = one, 1 - one
            p[part] = coupled(pair)
        p[~ok] = 0
        best = p.argmax(axis=1)
        good = ok & (p.max(axis=1, initial=0) >= probability)
        cls[good] = ids[best[good]]
        return [cls, p]

    return _kernel(df, spectrum, f, {"cls": IntegerType(), "probabilities": ArrayType(DoubleType())})
