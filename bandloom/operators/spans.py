"""Polygons as scanline spans, and pixels joined to them.

A polygon's edges cross a line of pixels at places that, sorted, bound what lies inside: the first to the second, the third
to the fourth, and so on (even-odd). So a region is a table of spans (region, y, x0, x1), half-open and without overlap, and
pixels meet the spans of their own line and tile of TILE columns in an equi-join. No expression grows with the vertices,
no task gets a whole polygon, and a pixel is compared with the few spans of its tile only.

An edge that stays between two columns of pixels for many lines is one run of lines. Runs of a part that share a column
cancel out where two lie over each other, and only what is left is taken apart into lines: a ring of many vertices costs a
row or two for each of them, and lines by columns of the image at most.

Edges are (region, part, x0, y0, x1, y1); a region is the union of its parts, each a closed ring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.plans.session import stored
from bandloom.plans.ship import ship

TILE = 64
#: Runs of edges that a task makes at once.
RUNS = 1 << 20
#: Spans by tiles that are sent to all tasks; beyond that pixels are shuffled by line and tile.
MAX_SENT = 1 << 20
Bounds = tuple[int, int, int, int]


def edges_of_polygons(regions: DataFrame, region: str = "roi_id") -> DataFrame:
    """Edges of regions(region, polygons array<array<struct<x, y>>>)."""
    rings = regions.select(F.col(region).alias("region"), F.posexplode("polygons").alias("part", "_ring"))
    after = lambda i, c: F.get("_ring", (i + 1) % F.size("_ring"))[c]
    edge = F.transform("_ring", lambda v, i: F.struct(v["x"].alias("x0"), v["y"].alias("y0"), after(i, "x").alias("x1"), after(i, "y").alias("y1")))
    return rings.select("region", "part", F.inline(edge))


def edges_of_vertices(vertices: DataFrame) -> DataFrame:
    """Edges of vertices(region, part, pos, x, y), whose pos are consecutive in a part. Neighbours meet by position, so even
    a ring of all rows is dealt over the tasks."""
    ends = vertices.groupBy("region", "part").agg(F.min("pos").alias("_low"), F.max("pos").alias("_high"))
    closing = vertices.join(ends, ["region", "part"]).filter("pos = _low").select("region", "part", (F.col("_high") + 1).alias("pos"), "x", "y")
    ring = vertices.select("region", "part", "pos", "x", "y").unionByName(closing)
    after = ring.select("region", "part", (F.col("pos") - 1).alias("pos"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return vertices.withColumnsRenamed({"x": "x0", "y": "y0"}).join(after, ["region", "part", "pos"]).select("region", "part", "x0", "y0", "x1", "y1")


def reached(x0: np.ndarray, y0: np.ndarray, slope: np.ndarray, low: np.ndarray, high: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The first of the lines low to high on which an edge has come past a column: beyond it if the edge goes right, at or
    before it if it goes left; high + 1 if none. Found by the inverse, and by halving where rounding leaves that in doubt."""

    def past(y: np.ndarray, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        return (x0[of] + (y - y0[of]) * slope[of] > column[of]) == (slope[of] > 0)

    with np.errstate(all="ignore"):
        guess = np.nan_to_num(np.ceil(y0 + (column - x0) / slope), nan=0, posinf=2**62, neginf=-(2**62))
    found = np.clip(guess, low, high + 1).astype(np.int64)
    doubt = np.flatnonzero(((found > low) & past(found - 1)) | ((found <= high) & ~past(found)))
    a, b = low[doubt].astype(np.int64), high[doubt].astype(np.int64) + 1
    while len(doubt) and (a < b).any():
        middle = (a + b) // 2
        hit = past(middle, doubt) | (middle > high[doubt])
        a, b = np.where(hit, a, np.minimum(middle + 1, b)), np.where(hit, middle, b)
    found[doubt] = a
    return found


def runs_of_edges(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, bounds: Bounds | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(edge, column, first line, line after the last): between these lines an edge runs just before a column of pixels. With
    bounds (x0, y0, x1, y1) columns beyond them move to them. An edge has no more runs than columns, nor than lines."""
    with np.errstate(all="ignore"):
        low, high = np.ceil(np.minimum(y0, y1)), np.ceil(np.maximum(y0, y1)) - 1
        if bounds:
            low, high = np.maximum(low, bounds[1]), np.minimum(high, bounds[3] - 1)
        edge = np.flatnonzero(np.isfinite(x0) & np.isfinite(x1) & np.isfinite(y0) & np.isfinite(y1) & (low <= high))
        x0, y0, low, high, slope = x0[edge], y0[edge], low[edge].astype(np.int64), high[edge].astype(np.int64), ((x1 - x0) / (y1 - y0))[edge]

    def before(y: np.ndarray, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        c = np.ceil(x0[of] + (y - y0[of]) * slope[of])
        return np.nan_to_num(np.clip(c, bounds[0], bounds[2]) if bounds else c).astype(np.int64)

    first, last = before(low), before(high)
    lines, columns = high - low + 1, np.abs(last - first) + 1
    total = np.cumsum(np.minimum(lines, columns))
    start = 0
    while start < len(edge):
        # as many edges as make RUNS; of one edge alone, however long, a part at a time
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + RUNS, "right")))
        n_lines, n_columns = lines[start:stop], columns[start:stop]
        steep, by_line, by_column = (start + np.flatnonzero(c) for c in (n_columns == 1, (n_columns > 1) & (n_lines <= n_columns), (n_columns > 1) & (n_lines > n_columns)))
        if len(steep):
            yield edge[steep], first[steep], low[steep], high[steep] + 1
        for e, n in ((by_line, lines), (by_column, columns)):
            size = int(n[e].sum()) if len(e) else 0
            for at in range(0, size, RUNS):
                k = np.arange(at, min(size, at + RUNS))
                ends = np.cumsum(n[e])
                own = np.searchsorted(ends, k, "right")
                step, own = k - (ends - n[e])[own], e[own]
                if e is by_line:
                    y = low[own] + step
                    yield edge[own], before(y, own), y, y + 1
                    continue
                way = np.sign(last - first)[own]
                c = first[own] + way * step
                # to the right a column is left for the next one when the edge is beyond it, to the left when it is before it
                held = (x0[own], y0[own], slope[own], low[own], high[own])
                left = lambda c: reached(*held, np.where(way > 0, c, c - 1).astype(float))
                a = np.where(c == first[own], low[own], left(c - way))
                b = np.where(c == last[own], high[own] + 1, left(c))
                some = a < b
                yield edge[own][some], c[some], a[some], b[some]
        start = stop


def spans_of_edges(edges: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """(region, y, x0, x1) of pixels inside, within bounds (x0, y0, x1, y1) if given."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [np.asarray(b.column(c).to_numpy(zero_copy_only=False), np.float64) for c in ("x0", "y0", "x1", "y1")]
            for edge, c, first, after in runs_of_edges(*ends, bounds):
                heads = [b.column(k).take(pa.array(edge)) for k in ("region", "part")]
                yield pa.RecordBatch.from_arrays([*heads, *(pa.array(v, pa.int32()) for v in (c, first, after))], names=["region", "part", "c", "y0", "y1"])

    x = edges.select("region", "part", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).filter("y0 <> y1")
    kinds = {f.name: f.dataType.simpleString() for f in x.schema}
    runs = x.mapInArrow(run, f"region {kinds['region']}, part {kinds['part']}, c int, y0 int, y1 int")
    # where runs of a column begin and end, twice in one place cancels out; between the first and second is one run, and so on
    turns = runs.select("region", "part", "c", F.explode(F.array("y0", "y1")).alias("y")).groupBy("region", "part", "c", "y").agg(F.count("*").alias("_n")).filter("_n % 2 = 1")
    column = Window.partitionBy("region", "part", "c").orderBy("y")
    left = turns.select("region", "part", "c", F.col("y").alias("_first"), F.lead("y").over(column).alias("_after"), F.row_number().over(column).alias("_k")).filter("_k % 2 = 1")
    each = left.select("region", "part", "c", F.explode(F.sequence("_first", F.col("_after") - 1)).alias("y"))
    lines = each.groupBy("region", "part", "y").agg(F.sort_array(F.collect_list("c")).alias("_at"))
    pairs = F.transform(F.filter("_at", lambda v, i: i % 2 == 0), lambda v, i: F.struct(v.alias("x0"), F.get("_at", 2 * i + 1).alias("x1")))
    found = lines.select("region", "y", F.inline(pairs))
    return united(found.filter("x0 < x1"))


def united(spans: DataFrame) -> DataFrame:
    """spans(region, y, x0, x1) without overlaps: a span that starts beyond all before it opens a new one."""
    line = Window.partitionBy("region", "y").orderBy("x0", "x1")
    reached = F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1))
    x = spans.withColumn("_new", F.coalesce((F.col("x0") > reached).cast("int"), F.lit(1)))
    x = x.withColumn("_run", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("region", "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_run")


def spans_of_boxes(boxes: DataFrame) -> DataFrame:
    """(region, y, x0, x1) of boxes(region, x0, y0, x1, y1), half-open."""
    some = boxes.filter("y0 < y1 and x0 < x1").select("region", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1")
    return united(some)


def by_tiles(spans: DataFrame) -> DataFrame:
    """(region, _sy, _tile, x0, x1): each span once for every tile that it reaches, stored."""
    tiles = F.sequence(F.floor(F.col("x0") / TILE), F.floor((F.col("x1") - 1) / TILE))
    return stored(spans.select("region", F.col("y").alias("_sy"), F.explode(tiles).alias("_tile"), "x0", "x1"), "spans")


def inside(pixels: DataFrame, spans: DataFrame, how: str = "inner") -> DataFrame:
    """pixels(y, x, ...) with region: a row for each region that a pixel is in, and one with null for those in none if how
    is left. spans as by_tiles() gives them."""
    many = spans.count()
    box = spans.agg(F.min("_sy"), F.max("_sy"), F.min("x0"), F.max("x1")).first() if many else None
    px, py = F.col("x"), F.col("y")
    if how == "inner" and box:  # what reaches the scan
        pixels = pixels.filter((py >= box[0]) & (py <= box[1]) & (px >= box[2]) & (px < box[3]))
    side = spans.withColumnsRenamed({"x0": "_x0", "x1": "_x1"})
    hit = (py == F.col("_sy")) & (F.floor(px / TILE) == F.col("_tile")) & (px >= F.col("_x0")) & (px < F.col("_x1"))
    return pixels.join(F.broadcast(side) if many <= MAX_SENT else side, hit, how).drop("_sy", "_tile", "_x0", "_x1")


def lookup(x: Column, y: Column, lines: list[list[tuple[int, int]]], first: int) -> Column:
    """Whether a pixel is in one of the spans of its line, from line `first` on: one literal, whatever the vertices."""
    import json

    table = F.from_json(F.lit(json.dumps([[{"a": a, "b": b} for a, b in spans] for spans in lines])), "array<array<struct<a: int, b: int>>>")
    own = F.get(table, (y - F.lit(first)).cast("int"))
    return F.coalesce(F.exists(own, lambda s: (x >= s["a"]) & (x < s["b"])), F.lit(False))
