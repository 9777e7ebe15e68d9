"""Display pyramids: means of blocks of 2 by 2, 4 by 4 and so on, level by level, and tiles of them as images.

Each level is summed from the one below it, so all levels together cost a third more than the first. Sums and numbers of valid
values go up, not means, so that a level holds the means of the pixels themselves, whatever is missing and at the edges.
A task makes the image of a tile, of tile * tile pixels at most, and writes it under a name of its own before it gets the
tile's, so a task that is run again leaves the same file.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.plans.num import clip, valid
from bandloom.plans.quantile import quantiles
from bandloom.plans.raster import Raster
from bandloom.plans.session import stored
from bandloom.plans.ship import ship
from bandloom.sources.writer import write_png

TILE = 256


def depth(width: int, height: int, tile: int = TILE) -> int:
    """How often a raster is halved until it fits into one tile."""
    return max(0, (max(width, height, 1) - 1) // tile).bit_length()


def levels(df: DataFrame, width: int, height: int, bands: Sequence[int], nodata: float | None = None, tile: int = TILE) -> DataFrame:
    """(level, y, x, n, mean) of pixels (y, x, spectrum): of each band, how many valid pixels a block has and their mean
    (null without any). Level k has blocks of 2**k by 2**k; the last one fits into a tile. Blocks without a row of pixels
    have none. A raster that fits into a tile has no levels."""
    values = [F.get("spectrum", F.lit(b)).cast("double") for b in bands]
    good = [valid(v, nodata) for v in values]
    sums, counts = [f"s{i}" for i in range(len(bands))], [f"n{i}" for i in range(len(bands))]
    below = df.select("y", "x", *(F.when(g, v).otherwise(0.0).alias(s) for g, v, s in zip(good, values, sums)), *(g.cast("long").alias(n) for g, n in zip(good, counts)))
    mean = F.array(*(F.when(F.col(n) > 0, F.col(s) / F.col(n)) for s, n in zip(sums, counts)))
    shape = lambda x, level: x.select(F.lit(level).alias("level"), "y", "x", F.array(*counts).alias("n"), mean.alias("mean"))
    found = shape(below, 0).limit(0)
    for level in range(1, depth(width, height, tile) + 1):
        half = below.groupBy(F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x"))
        below = stored(half.agg(*(F.sum(c).alias(c) for c in (*sums, *counts))), f"level-{level}")
        found = shape(below, level) if level == 1 else found.unionByName(shape(below, level))
    return found


def write_tiles(r: Raster, folder: str, bands: Sequence[int] | None = None, tile: int = TILE, percent: float = 2.0) -> DataFrame:
    """The pyramid as images `folder/level/row-column.png`, of one band in grey or three in colour, level 0 being the raster
    itself; (level, row, column, pixels, path) of those written. folder is one that all executors share. All levels are stretched between the same percentiles of
    each band's pixels; what is missing is black, as is a band of which nothing is valid."""
    bands = list(r.meta.default_rgb() if bands is None else bands)
    if len(bands) not in (1, 3):
        raise ValueError("an image has one band or three")
    m = r.meta
    ends = []
    for b in bands:
        v = r.df.select(F.get("spectrum", F.lit(b)).cast("double").alias("v"))
        ends.append(quantiles(v.filter(valid(F.col("v"), m.nodata)), "v", [percent / 100, 1 - percent / 100]))

    def shade(v, i: int):
        if ends[i] is None:
            return F.lit(0)
        low, high = ends[i]
        share = clip((v - low) / (max(high - low, 1e-6)), 0, 1)
        return F.when(valid(v, m.nodata), F.floor(share * 255)).otherwise(0).cast("int")

    own = r.df.select(F.lit(0).alias("level"), "y", "x", F.array(*(F.get("spectrum", F.lit(b)).cast("double") for b in bands)).alias("mean"))
    every = own.unionByName(levels(r.df, m.width, m.height, bands, m.nodata, tile).drop("n"))
    shades = [shade(F.coalesce(F.get("mean", F.lit(i)), F.lit(float("nan"))), i).cast("smallint").alias(f"c{i}") for i in range(len(bands))]
    tiles = every.select("level", *((F.col(c) / tile).cast("int").alias(t) for c, t in (("y", "row"), ("x", "column"))), "y", "x", *shades)
    sizes = [(-(-m.height // (1 << k)), -(-m.width // (1 << k))) for k in range(depth(m.width, m.height, tile) + 1)]

    def image(t: pa.Table) -> pa.Table:
        level, row, column = (t.column(c)[0].as_py() for c in ("level", "row", "column"))
        top, left = row * tile, column * tile
        h, w = min(tile, sizes[level][0] - top), min(tile, sizes[level][1] - left)
        out = np.zeros((h, w, len(bands)), np.uint8)
        y, x = t.column("y").to_numpy() - top, t.column("x").to_numpy() - left
        for i in range(len(bands)):
            out[y, x, i] = t.column(f"c{i}").to_numpy()
        path = os.path.join(folder, str(level), f"{row}-{column}.png")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        made = f"{path}.{uuid.uuid4().hex}"
        try:
            write_png(made, out if len(bands) == 3 else out[:, :, 0])
            os.replace(made, path)
        finally:
            if os.path.exists(made):
                os.remove(made)
        at = {c: pa.array([v], pa.int32()) for c, v in (("level", level), ("row", row), ("column", column))}
        return pa.table(at | {"pixels": pa.array([t.num_rows], pa.int64()), "path": [path]})

    ship(r.df.sparkSession)
    return stored(tiles.groupBy("level", "row", "column").applyInArrow(image, "level int, row int, column int, pixels long, path string"), "tiles")
