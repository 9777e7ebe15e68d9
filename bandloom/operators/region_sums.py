"""Statistics below many regions on an image that fits into a task, without a row for each line of a region or each pixel.

Along the longer side of the image values are summed up by halves: two pixels, four, eight and so on. A region is taken
apart into stretches along that side, one or a few for each line across it, and a stretch is put together from as many sums
as its length has binary digits, twice at most. So a region costs its extent along the shorter side, whatever the image's
length, and all of it is done where the region's row lies: one row for each region and band leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.plans.num import valid
from bandloom.plans.ship import ship

from .spans import reached

#: Pixels by bands of an image whose sums are sent to all tasks, about 100 bytes each.
MAX_CELLS = 1 << 20
#: Places where outlines enter or leave lines that a task holds at once, a single region's aside.
TURNS = 1 << 19
RINGS = "array<array<struct<x: double, y: double>>>"
#: By quantity (pixels, valid ones, their total, squares about their mean, least, greatest) what stands for no pixel.
NONE = (0.0, 0.0, 0.0, 0.0, np.inf, -np.inf)


@dataclass(frozen=True)
class Sums:
    """An image from (x0, y0) to before (x1, y1), in lines of places: rows of pixels, or columns if turned. stats: by band and
    quantity all levels one after the other, each beginning at starts with lengths places to a line."""

    box: tuple[int, int, int, int]
    turned: bool
    bands: list
    stats: list[list[np.ndarray]]
    starts: list[int]
    lengths: list[int]


def halved(level: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of neighbours along lines."""
    some, n, total, squares, low, high = (np.pad(v, ((0, 0), (0, v.shape[1] % 2)), constant_values=e).reshape(len(v), -1, 2) for v, e in zip(level, NONE))
    means, both = total / np.maximum(n, 1), n.sum(axis=2)
    between = (means[..., 0] - means[..., 1]) ** 2 * n[..., 0] * n[..., 1] / np.maximum(both, 1)
    return [some.sum(axis=2), both, total.sum(axis=2), squares.sum(axis=2) + between, low.min(axis=2), high.max(axis=2)]


def sums_of(bands: DataFrame, nodata: float | None = None) -> Sums | None:
    """Of bands(y, x, band, value); None if the image is empty or larger than MAX_CELLS."""
    x = bands.filter("y is not null and x is not null").select("band", "y", "x", F.when(valid(F.col("value"), nodata), F.col("value")).cast("double").alias("v"))
    size = x.agg(F.min("x"), F.min("y"), F.max("x") + 1, F.max("y") + 1, F.collect_set("band"), F.count_if(F.col("band").isNull())).first()
    if size[0] is None or size[5] or (size[2] - size[0]) * (size[3] - size[1]) * len(size[4]) > MAX_CELLS:
        return None
    box, found = tuple(size[:4]), sorted(size[4])
    quantities = (F.count("*"), F.count("v"), F.sum("v"), F.var_pop("v") * F.count("v"), F.min("v"), F.max("v"))
    cells = x.groupBy("band", "y", "x").agg(*(q.cast("double").alias(f"q{i}") for i, q in enumerate(quantities))).toArrow()  # MAX_CELLS rows at most
    turned = box[3] - box[1] > box[2] - box[0]
    line, place = (cells.column(c).to_numpy() - box[i] for c, i in (("x", 0), ("y", 1))) if turned else (cells.column(c).to_numpy() - box[i] for c, i in (("y", 1), ("x", 0)))
    shape = (box[2] - box[0], box[3] - box[1]) if turned else (box[3] - box[1], box[2] - box[0])
    of = np.array([found.index(b) for b in cells.column("band").to_pylist()])
    levels = []
    for k in range(len(found)):
        at = of == k
        level = []
        for i, empty in enumerate(NONE):
            q = np.full(shape, empty)
            v = np.asarray(cells.column(f"q{i}").to_numpy(), np.float64)[at]
            q[line[at], place[at]] = np.where(np.isnan(v), empty, v)
            level.append(q)
        levels.append([level])
        while levels[-1][-1][0].shape[1] > 1:
            levels[-1].append(halved(levels[-1][-1]))
    lengths = [level[0].shape[1] for level in levels[0]]
    starts = np.cumsum([0, *(shape[0] * n for n in lengths)])[:-1].tolist()
    stats = [[np.concatenate([level[i].ravel() for level in own]) for i in range(len(NONE))] for own in levels]
    return Sums(box, turned, found, stats, starts, lengths)


def turns(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, ring: np.ndarray, box: tuple[int, int, int, int], turned: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ring, line, place), an even number for each ring and line: sorted, the first to the second lie inside the ring, the
    third to the fourth, and so on. Edges of a ring follow each other."""
    with np.errstate(all="ignore"):
        low, high = np.maximum(np.ceil(np.minimum(y0, y1)), box[1]), np.minimum(np.ceil(np.maximum(y0, y1)), box[3]) - 1
        use = np.flatnonzero(np.isfinite(x0) & np.isfinite(x1) & np.isfinite(y0) & np.isfinite(y1) & (low <= high))
    x0, y0, x1, y1, ring, low, high = x0[use], y0[use], x1[use], y1[use], ring[use], low[use].astype(np.int64), high[use].astype(np.int64)
    with np.errstate(all="ignore"):
        slope = (x1 - x0) / (y1 - y0)
    if not turned:
        n = high - low + 1
        e = np.repeat(np.arange(len(n)), n)
        y = low[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
        return ring[e], y - box[1], np.clip(np.nan_to_num(np.ceil(x0[e] + (y - y0[e]) * slope[e])), box[0], box[2]).astype(np.int64) - box[0]
    first, last = (np.clip(np.nan_to_num(np.ceil(x0 + (y - y0) * slope)), box[0], box[2]).astype(np.int64) for y in (low, high))

    def spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each column from a to before b, and whose it is."""
        n = np.maximum(b - a, 0)
        own = np.repeat(np.arange(len(n)), n)
        return own, a[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)

    # a column turns where an edge passes it, and at a corner if the edges that meet there lie on both its sides
    e, c = spread(np.minimum(first, last), np.maximum(first, last))
    found = [(ring[e], c, reached(x0[e], y0[e], slope[e], low[e], high[e], c.astype(float)))]
    up = y1 > y0
    begin, end = (np.where(up, low, high + 1), np.where(up, first, last)), (np.where(up, high + 1, low), np.where(up, last, first))
    after = np.arange(1, len(ring) + 1)
    heads = np.flatnonzero(np.concatenate(([True], ring[1:] != ring[:-1]))) if len(ring) else after
    after[np.append(heads[1:] - 1, len(ring) - 1)[: len(heads)]] = heads
    y, x, ny, nx = *end, begin[0][after], begin[1][after]
    meet, left, least = y == ny, np.full(len(ring), box[0]), np.minimum(x, nx)  # they don't where an edge between them was left out
    for a, b, at in ((least, np.where(meet, np.maximum(x, nx), least), y), (left, np.where(meet, left, x), y), (left, np.where(meet, left, nx), ny)):
        e, c = spread(a, b)
        found.append((ring[e], c, at[e]))
    ring, c, y = (np.concatenate(v) for v in zip(*found))
    return ring, c - box[0], y - box[1]


def stretches(turn: tuple[np.ndarray, np.ndarray, np.ndarray], region: np.ndarray, sums: Sums) -> tuple[np.ndarray, ...]:
    """(region, line, from, to) without overlap of the turns of rings; region: whose each ring is."""
    lines, places = sums.starts[1] // sums.lengths[0] if len(sums.starts) > 1 else len(sums.stats[0][0]), sums.lengths[0] + 1
    key = np.sort((turn[0] * lines + turn[1]) * places + turn[2])
    group, a, b = key[::2] // places, key[::2] % places, key[1::2] % places
    some = a < b
    group, a, b = group[some], a[some], b[some]
    own, line = region[group // lines], group % lines
    if (region[1:] == region[:-1]).any():
        base = (own * lines + line) * places
        order = np.lexsort((a, base))
        own, line, base, a, b = own[order], line[order], base[order], a[order], b[order]
        if len(a):
            a = np.maximum(a, np.concatenate(([0], np.maximum.accumulate(base + b)[:-1])) - base)
            some = a < b
            own, line, a, b = own[some], line[some], a[some], b[some]
    return own, line, a, b


def parts(own: np.ndarray, line: np.ndarray, a: np.ndarray, b: np.ndarray, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
    """(region, place in stats) of the sums that make up the stretches."""
    owners, nodes = [], []
    for start, length in zip(sums.starts, sums.lengths):
        if not len(a):
            break
        for odd, at in (((a & 1) == 1, a), ((b & 1) == 1, b - 1)):
            i = np.flatnonzero(odd & (a < b))
            owners.append(own[i])
            nodes.append(start + line[i] * length + at[i])
            if at is a:
                a = a + (odd & (a < b))
        a, b = (a + 1) >> 1, b >> 1
        left = np.flatnonzero(a < b)
        own, line, a, b = own[left], line[left], a[left], b[left]
    return np.concatenate(owners), np.concatenate(nodes)


def summed(regions: int, own: np.ndarray, node: np.ndarray, stats: list[np.ndarray]) -> list[np.ndarray]:
    """Pixels, valid ones, least, greatest, mean and deviation by region."""
    some, n, total = (np.bincount(own, q[node], regions) for q in stats[:3])
    mean = total / np.maximum(n, 1)
    part = stats[1][node]
    gap = stats[2][node] / np.maximum(part, 1) - mean[own]
    squares = np.bincount(own, stats[3][node] + part * gap * gap, regions)
    low, high = np.full(regions, np.inf), np.full(regions, -np.inf)
    np.minimum.at(low, own, stats[4][node])
    np.maximum.at(high, own, stats[5][node])
    none = n == 0
    return [some, n, *(np.where(none, np.nan, v) for v in (low, high, mean, np.sqrt(squares / np.maximum(n, 1))))]


def statistics(rois: DataFrame, sums: Sums, region: str = "name") -> DataFrame:
    """(roi, band, n, min_v, max_v, mean_v, std_v) below a table of regions; those equal in `region` are united."""
    spark = rois.sparkSession
    ship(spark)
    corner = lambda x, y: F.struct(F.col(f"bbox.{x}").cast("double").alias("x"), F.col(f"bbox.{y}").cast("double").alias("y"))
    square = F.array(F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))
    rings = F.when(F.coalesce(F.size("polygons") > 0, F.lit(False)), F.col("polygons").cast(RINGS)).when(F.expr("bbox.x0 < bbox.x1 and bbox.y0 < bbox.y1"), square)
    x = rois.select(F.col(region).alias("roi"), rings.alias("rings")).groupBy("roi").agg(F.flatten(F.collect_list("rings")).alias("rings"))
    sent = spark.sparkContext.broadcast(sums)
    names, kind = ["roi", "band", "n", "min_v", "max_v", "mean_v", "std_v"], x.schema["roi"].dataType.simpleString()
    band = "string" if isinstance(sums.bands[0], str) else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = sent.value
        box = image.box
        for b in batches:
            rings = pc.list_flatten(b.column("rings"))
            region = pc.list_parent_indices(b.column("rings")).to_numpy()
            points, ring = pc.list_flatten(rings), pc.list_parent_indices(rings).to_numpy()
            if not len(points):
                continue
            x0, y0 = (np.asarray(pc.struct_field(points, c).to_numpy(zero_copy_only=False), np.float64) for c in "xy")
            heads = np.flatnonzero(np.concatenate(([True], ring[1:] != ring[:-1])))
            after = np.arange(1, len(ring) + 1)
            after[np.append(heads[1:] - 1, len(ring) - 1)] = heads
            x1, y1 = x0[after], y0[after]
            far = np.clip(np.nan_to_num(np.abs(x1 - x0)), 0, box[2] - box[0]) if image.turned else np.clip(np.nan_to_num(np.abs(y1 - y0)), 0, box[3] - box[1])
            size = np.cumsum(far + 2)
            whose = region[ring]  # ascending
            ends = np.append(np.flatnonzero(whose[1:] != whose[:-1]) + 1, len(whose))
            start = 0
            while start < len(whose):
                # as many whole regions as make TURNS
                at = np.searchsorted(size, (size[start - 1] if start else 0) + TURNS, "right")
                k = np.searchsorted(ends, at, "right") - 1
                stop = int(ends[k]) if k >= 0 and ends[k] > start else int(ends[np.searchsorted(ends, start, "right")])
                part = slice(start, stop)
                start = stop
                found = turns(x0[part], y0[part], x1[part], y1[part], ring[part] - ring[part][0], image.box, image.turned)
                if not len(found[0]):
                    continue
                own = region[ring[part][0] : ring[part][-1] + 1]
                first = own[0]
                own, node = parts(*stretches(found, own - first, image), image)
                for i, name in enumerate(image.bands):
                    some, n, *rest = summed(whose[stop - 1] - first + 1, own, node, image.stats[i])
                    at = np.flatnonzero(some > 0)
                    heads = [b.column("roi").take(pa.array(at + first)), pa.array([name] * len(at), pa.string() if band == "string" else pa.int64()), pa.array(n[at].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*heads, *(pa.array(v[at]) for v in rest)], names=names)

    return x.mapInArrow(run, f"roi {kind}, band {band}, n long, min_v double, max_v double, mean_v double, std_v double")
