"""Column algebra with NumPy's rules for NaN.

In Spark NaN equals NaN and is greater than all numbers, `least` passes over it, and division by zero raises. The
functions here give what array code expects: NaN spreads, comparisons with it are false, and a zero divisor is guarded.
All arithmetic is in double; results are cast where they are stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def lit(x: float | int | str | bool | None) -> Column:
    return F.lit(x)


def either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, lit(float(lo))), lit(float(hi))))


def minimum(a: Column, b: Column) -> Column:
    return F.when(either_nan(a, b), lit(float("nan"))).otherwise(F.least(a, b))


def maximum(a: Column, b: Column) -> Column:
    return F.greatest(a, b)  # NaN is the greatest


def safe_div(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or NaN."""
    return F.when((b == 0) | F.isnan(b), lit(0.0)).otherwise(a / F.when(b == 0, lit(1.0)).otherwise(b))


def truncated(x: Column) -> Column:
    """Toward zero; what isn't finite is NaN."""
    return F.when(finite(x), x - x % 1).otherwise(lit(float("nan")))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < INF)


def valid(x: Column, nodata: float | None = None) -> Column:
    """Finite and not the sentinel."""
    return finite(x) if nodata is None else finite(x) & (x != nodata)


def doubles(spectrum: str | Column) -> Column:
    return (F.col(spectrum) if isinstance(spectrum, str) else spectrum).cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def all_finite(spectrum: Column) -> Column:
    return F.forall(spectrum, finite)


def vector(values: Sequence[float]) -> Column:
    return F.array(*(lit(float(v)) for v in values))


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.array(*map(vector, rows))


def matvec(rows: Sequence[Sequence[float]], x: Column) -> Column:
    """The product of a small literal matrix and a column of vectors."""
    return F.transform(matrix(rows), lambda r: dot(r, x))


def r6(x: Column) -> Column:
    return F.round(x, 6) + lit(0.0)  # no negative zero
