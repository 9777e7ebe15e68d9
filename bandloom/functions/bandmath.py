"""Band math: an expression language that is compiled to Columns, so that Catalyst owns folding and code generation.

The syntax is checked node by node; anything outside the language raises ValueError and nothing is ever evaluated as
Python. Functions of one argument over the whole image (min, max, mean, std, median, sum) become a one-row aggregate
that is sent to all rows; they may nest.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.plans.num import clip, either_nan, finite, lit, maximum, minimum, safe_div, truncated
from bandloom.plans.quantile import quantiles

RESERVED = {"and", "or", "not", "true", "false", "none", "pi", "e"}  # no variables, though some have no meaning here
# The expressions on offer.
PRESETS = {
    "Normalized Difference (NDVI: NIR-Red)": "(float(b4) - float(b3)) / (float(b4) + float(b3))",
    "Normalized Difference (NDWI: Green-NIR)": "(float(b2) - float(b4)) / (float(b2) + float(b4))",
    "Simple Ratio (b1 / b2)": "float(b1) / (float(b2) + 1e-6)",
    "Threshold Mask (b1 > 0)": "(float(b1) > 0.0) * float(b1)",
    "Geometric Mean": "sqrt(float(b1) * float(b2))",
    "Luminance Composite (Rec. 601)": "0.299 * float(b1) + 0.587 * float(b2) + 0.114 * float(b3)",
}


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def truth(x: Column) -> Column:
    return x != 0  # NaN counts as true


def integer(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    return truncated(x if lo is None else clip(x, lo, hi))


GLOBAL = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_pop, "sum": F.sum, "median": None}
COMPARE = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
}
BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: safe_div,
    ast.Pow: F.pow,
    ast.BitAnd: lambda a, b: flag(truth(a) & truth(b)),
    ast.BitOr: lambda a, b: flag(truth(a) | truth(b)),
}
floored = lambda x: maximum(x, lit(1e-7))
ONE = {
    "exp": F.exp, "sqrt": lambda x: F.sqrt(maximum(x, lit(0.0))), "abs": F.abs, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": lambda x: F.asin(clip(x, -1, 1)), "acos": lambda x: F.acos(clip(x, -1, 1)), "atan": F.atan, "sign": F.signum,
    "round": F.rint, "floor": lambda x: F.when(finite(x), F.floor(x).cast("double")).otherwise(x),
    "ceil": lambda x: F.when(finite(x), F.ceil(x).cast("double")).otherwise(x), "float": lambda x: x, "double": lambda x: x,
    "byte": lambda x: integer(x, 0, 255), "uint": lambda x: integer(x, 0, 65535),
    **{n: (lambda x: F.ln(floored(x))) for n in ("log", "ln", "alog")}, **{n: (lambda x: F.log10(floored(x))) for n in ("log10", "alog10")},
    **{n: integer for n in ("fix", "int", "long")},
}
MORE = {
    "atan2": (2, F.atan2),
    "clip": (3, lambda x, lo, hi: F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, lo), hi))),
    "where": (3, lambda c, x, y: F.when(truth(c), x).otherwise(y)),
}


class Compiler:
    """One expression over named columns; `levels` holds the aggregates by how deep they nest."""

    def __init__(self, variables: Mapping[str, Column]):
        self.variables = {k.lower(): v.cast("double") for k, v in variables.items()}
        self.levels: list[list[tuple[str, str, Column]]] = []  # (alias, function, argument)

    def column(self, node: ast.AST) -> Column:
        return self.build(node)[0]

    def build(self, node: ast.AST) -> tuple[Column, int]:
        """The Column of a node and its depth: how many aggregates must come before it."""
        match node:
            case ast.Expression(body=body):
                return self.build(body)
            case ast.Constant(value=bool() | int() | float() as value):
                return lit(float(value)), 0
            case ast.Name(id=name):
                key = name.lower()
                if key in self.variables:
                    return self.variables[key], 0
                raise ValueError(f"unknown name {name!r}")
            case ast.BinOp(left=left, op=op, right=right) if type(op) in BINARY:
                return self.apply(BINARY[type(op)], left, right)
            case ast.UnaryOp(op=ast.UAdd(), operand=operand):
                return self.build(operand)
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return self.apply(lambda x: -x, operand)
            case ast.UnaryOp(op=ast.Invert(), operand=operand):
                return self.apply(lambda x: flag(~truth(x)), operand)
            case ast.Compare(left=left, ops=ops, comparators=others):
                if not all(type(o) in COMPARE or isinstance(o, ast.NotEq) for o in ops):
                    raise ValueError("comparison isn't supported")
                sides = [self.build(x) for x in (left, *others)]
                out = lit(1.0)
                for (a, _), op, (b, _) in zip(sides, ops, sides[1:]):
                    nan = either_nan(a, b)
                    out = out * (flag(nan | (a != b)) if isinstance(op, ast.NotEq) else flag(~nan & COMPARE[type(op)](a, b)))
                return out, max(d for _, d in sides)
            case ast.BoolOp(op=op, values=values):
                parts = [self.build(v) for v in values]
                out = truth(parts[0][0])
                for p, _ in parts[1:]:
                    out = (out & truth(p)) if isinstance(op, ast.And) else (out | truth(p))
                return flag(out), max(d for _, d in parts)
            case ast.Call(func=ast.Name(id=name), args=args):
                return self.call(name.lower(), args)
        raise ValueError(f"{type(node).__name__} isn't supported")

    def apply(self, f, *nodes: ast.AST) -> tuple[Column, int]:
        parts = [self.build(n) for n in nodes]
        return f(*(p for p, _ in parts)), max(d for _, d in parts)

    def call(self, name: str, args: Sequence[ast.AST]) -> tuple[Column, int]:
        if name in GLOBAL and len(args) == 1:
            x, depth = self.build(args[0])
            while len(self.levels) <= depth:
                self.levels.append([])
            alias = f"_g{depth}_{len(self.levels[depth])}"
            self.levels[depth].append((alias, name, F.when(~F.isnan(x), x)))
            return F.coalesce(F.col(alias), lit(float("nan"))), depth + 1
        if name in ("min", "max") and args:
            two = minimum if name == "min" else maximum
            parts = [self.build(a) for a in args]
            out = parts[0][0]
            for p, _ in parts[1:]:
                out = two(out, p)
            return out, max(d for _, d in parts)
        if name in ONE and len(args) == 1:
            return self.apply(ONE[name], *args)
        if name in MORE and len(args) == MORE[name][0]:
            return self.apply(MORE[name][1], *args)
        raise ValueError(f"{name}() with {len(args)} arguments isn't supported")


def band_math(df: DataFrame, expression: str, variables: Mapping[str, Column], out: str = "result") -> DataFrame:
    """df with the value of expression for each row."""
    try:
        tree = ast.parse(expression.strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not an expression: {expression!r}") from e
    compiler = Compiler(variables)
    value = compiler.column(tree)
    x = df
    for level in compiler.levels:
        for alias, _, argument in (g for g in level if g[1] == "median"):
            middle = quantiles(x.select(argument.alias("v")), "v", [0.5])
            x = x.withColumn(alias, lit(middle[0] if middle else None).cast("double"))
        if row := [GLOBAL[name](argument).alias(alias) for alias, name, argument in level if name != "median"]:
            x = x.crossJoin(F.broadcast(x.agg(*row)))  # one row
    return x.withColumn(out, value).select(*df.columns, out)


def names_in(expression: str) -> list[str]:
    """The variables of an expression, in order of appearance."""
    known = RESERVED | set(GLOBAL) | set(ONE) | set(MORE)
    found = re.findall(r"(?<![\w.])[A-Za-z_]\w*", expression)
    return list(dict.fromkeys(n for n in found if n.lower() not in known))


def bind(expression: str, spectrum: str, band_names: Sequence[str]) -> dict[str, Column]:
    """Columns of an expression's variables: b<n> is the n-th band, other names match band names."""
    out = {}
    for name in names_in(expression):
        m = re.fullmatch(r"[bB](\d+)", name)
        if m and 1 <= int(m[1]) <= len(band_names):
            index = int(m[1]) - 1
        else:
            index = next((i for i, b in enumerate(band_names) if name.lower() in b.lower()), None)
            if index is None:
                raise ValueError(f"no band for {name!r}")
        out[name] = F.get(spectrum, lit(index)).cast("double")
    return out
