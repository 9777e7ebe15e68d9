"""Accuracy assessment from pairs of reference and predicted classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.plans.num import lit
from bandloom.plans.raster import Raster

from .warp import resample


def confusion_matrix(pairs: DataFrame, ref: str = "ref", pred: str = "pred", nodata: float | None = None) -> DataFrame:
    """(ref, pred, n) for the combinations that occur; pairs with a missing or nodata side don't count."""
    x = pairs.select(F.col(ref).cast("double").alias("ref"), F.col(pred).cast("double").alias("pred"))
    for c in ("ref", "pred"):
        keep = F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        x = x.filter(keep if nodata is None else keep & (F.col(c) != nodata))
    return x.groupBy(F.col("ref").cast("int").alias("ref"), F.col("pred").cast("int").alias("pred")).agg(F.count("*").alias("n"))


def raster_pairs(classified: Raster, reference: Raster, resize: bool = False) -> DataFrame:
    """(ref, pred) of two class rasters, pixel by pixel. Rasters of different size are an error, unless the reference may be
    resized to the classified one (nearest pixel, so classes stay classes)."""
    size, other = ((r.meta.height, r.meta.width) for r in (classified, reference))
    if size != other and not resize:
        raise ValueError(f"shapes differ: classified {size}, reference {other}")
    truth = reference.band(0) if size == other else resample(reference.band(0), other, size, "nearest")
    return classified.band(0).withColumnRenamed("value", "pred").join(truth.withColumnRenamed("value", "ref"), ["y", "x"]).select("ref", "pred")


def assess(classified: Raster, reference: Raster, nodata: float | None = None, resize: bool = False) -> DataFrame:
    """The confusion matrix of two class rasters."""
    return confusion_matrix(raster_pairs(classified, reference, resize), nodata=nodata)


def confusion_cube(pairs: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """The matrix with its margins: null stands for all."""
    return pairs.cube(F.col(ref).alias("ref"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _margins(matrix: DataFrame) -> DataFrame:
    """(cls, ref_n, pred_n, hit): a row for each class, from a matrix of classes by classes."""
    each = matrix.select(F.explode(F.array(
        F.struct(F.col("ref").alias("cls"), F.col("n").alias("ref_n"), lit(0).cast("long").alias("pred_n"), F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(lit(0).cast("long")).alias("hit")),
        F.struct(F.col("pred").alias("cls"), lit(0).cast("long").alias("ref_n"), F.col("n").alias("pred_n"), lit(0).cast("long").alias("hit")),
    )).alias("e")).select("e.*")
    return each.groupBy("cls").agg(F.sum("ref_n").alias("ref_n"), F.sum("pred_n").alias("pred_n"), F.sum("hit").alias("hit"))


def accuracy_metrics(matrix: DataFrame) -> DataFrame:
    """(oa in percent, kappa); kappa is 1 where chance alone is certain."""
    m = _margins(matrix).agg(F.sum("ref_n").alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("ref_n").cast("double") * F.col("pred_n")).alias("cross"))
    po, pe = F.col("hit") / F.col("n"), F.col("cross") / (F.col("n").cast("double") * F.col("n"))
    return m.filter("n > 0").select((po * 100).alias("oa"), F.when(pe >= 1.0, 1.0).otherwise((po - pe) / F.when(pe >= 1.0, 1.0).otherwise(1.0 - pe)).alias("kappa"))


def producer_user_accuracy(matrix: DataFrame) -> DataFrame:
    """(cls, pa, ua) in percent; 0 where a margin is empty."""
    share = lambda m: F.when(F.col(m) == 0, 0.0).otherwise(F.col("hit") * 100.0 / F.when(F.col(m) == 0, 1).otherwise(F.col(m)))
    return _margins(matrix).select("cls", share("ref_n").alias("pa"), share("pred_n").alias("ua"))


def report(matrix: DataFrame, names: dict[int, str] | None = None, path: str | None = None) -> str:
    """A text report from the small matrix, also written to a file if a path is given. Raises ValueError when there is nothing to assess."""
    cells = {(r.ref, r.pred): r.n for r in matrix.collect()}  # classes by classes
    if not cells:
        raise ValueError("no valid pixels in common")
    classes = sorted({c for pair in cells for c in pair})
    label = lambda c: (names or {}).get(c, f"Class {c}")
    n, hit = sum(cells.values()), sum(cells.get((c, c), 0) for c in classes)
    row, col = {c: sum(cells.get((c, k), 0) for k in classes) for c in classes}, {c: sum(cells.get((k, c), 0) for k in classes) for c in classes}
    pe = sum(row[c] * col[c] for c in classes) / n**2
    kappa = 1.0 if pe >= 1 else (hit / n - pe) / (1 - pe)
    lines = ["Accuracy assessment", f"Pixels: {n}", f"Overall accuracy: {100 * hit / n:.4f} %", f"Kappa coefficient: {kappa:.4f}", "", "Confusion matrix (rows: reference, columns: classified)"]
    lines.append(" " * 16 + "".join(f"{label(c)[:12]:>14}" for c in classes) + f"{'Total':>14}")
    for c in classes:
        lines.append(f"{label(c)[:15]:<16}" + "".join(f"{cells.get((c, k), 0):>14}" for k in classes) + f"{row[c]:>14}")
    lines.append(f"{'Total':<16}" + "".join(f"{col[c]:>14}" for c in classes) + f"{n:>14}")
    lines += ["", f"{'Class':<16}{'Producer %':>14}{'User %':>14}{'Omission %':>14}{'Commission %':>14}"]
    for c in classes:
        pa = 100 * cells.get((c, c), 0) / row[c] if row[c] else 0.0
        ua = 100 * cells.get((c, c), 0) / col[c] if col[c] else 0.0
        lines.append(f"{label(c)[:15]:<16}{pa:>14.2f}{ua:>14.2f}{100 - pa:>14.2f}{100 - ua:>14.2f}")
    text = "\n".join(lines)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    return text
