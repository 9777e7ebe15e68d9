"""Pyramids against blocks cut by hand, and their tiles read back."""

import os
import struct
import zlib

import numpy as np
import pytest

from bandloom.operators import pyramid
from bandloom.plans.raster import Raster, RasterMetadata


def block_means(a: np.ndarray, k: int) -> dict:
    """(y, x) to the mean of the block's valid values."""
    found = {}
    for y in range(0, a.shape[0], 1 << k):
        for x in range(0, a.shape[1], 1 << k):
            part = a[y : y + (1 << k), x : x + (1 << k)]
            part = part[np.isfinite(part)]
            found[y >> k, x >> k] = (len(part), part.mean() if len(part) else None)
    return found


def read_png(path: str) -> np.ndarray:
    raw = open(path, "rb").read()
    w, h, _, color = struct.unpack(">IIBB", raw[16:26])
    at, data = 8, b""
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        data += raw[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    samples = 3 if color == 2 else 1
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * samples)
    return rows[:, 1:].reshape(h, w, samples)


@pytest.mark.parametrize("side, tile, n", [(1, 4, 0), (4, 4, 0), (5, 4, 1), (8, 4, 1), (9, 4, 2), (256, 256, 0), (257, 256, 1), (1 << 20, 256, 12)])
def test_depth(side, tile, n):
    assert pyramid.depth(side, 1, tile) == pyramid.depth(1, side, tile) == n


def scene() -> np.ndarray:
    cube = np.random.default_rng(3).normal(10, 3, (3, 13, 22)).astype(np.float32)
    cube[0, :8, :8] = np.nan
    cube[1, 2, 3] = np.inf
    return cube


def test_levels_are_means_of_valid_pixels(spark):
    cube = scene()
    got = pyramid.levels(Raster.from_numpy(spark, cube).df, 22, 13, (0, 1), tile=4).collect()
    assert {x.level for x in got} == {1, 2, 3}
    for k in (1, 2, 3):
        rows = {(x.y, x.x): x for x in got if x.level == k}
        for i in (0, 1):
            want = block_means(cube[i].astype(float), k)
            assert rows.keys() == want.keys()
            for at, (n, mean) in want.items():
                assert rows[at].n[i] == n and (rows[at].mean[i] is None if mean is None else rows[at].mean[i] == pytest.approx(mean))


def test_missing_values_and_rasters_of_one_tile(spark):
    cube = np.array([[[1, -9, 3], [5, 7, -9]]], np.float32)
    df = Raster.from_numpy(spark, cube).df
    assert pyramid.levels(df, 3, 2, (0,), tile=4).count() == 0
    got = {(x.y, x.x): (x.n[0], x.mean[0]) for x in pyramid.levels(df, 3, 2, (0,), -9.0, tile=2).collect()}
    assert got == {(0, 0): (3, pytest.approx(13 / 3)), (0, 1): (1, 3.0)}
    assert pyramid.levels(df.limit(0), 9, 9, (0,), tile=4).count() == 0


@pytest.mark.parametrize("bands", [(0, 1, 2), (1,)])
def test_tiles_are_read_back(spark, tmp_path, bands):
    cube = scene()
    r = Raster.from_numpy(spark, cube, RasterMetadata(22, 13, 3))
    for _ in range(2):  # once more over the same files
        made = pyramid.write_tiles(r, str(tmp_path), bands, tile=8).collect()
    assert {(x.level, x.row, x.column) for x in made} == {(0, i, j) for i in range(2) for j in range(3)} | {(1, 0, 0), (1, 0, 1), (2, 0, 0)}
    assert sorted(os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs) == sorted(x.path for x in made)
    want = []
    for b in bands:
        v = cube[b].astype(float)
        low, high = np.percentile(v[np.isfinite(v)], [2, 98])
        want.append((low, high))
    for x in made:
        image = read_png(x.path)
        for i, b in enumerate(bands):
            low, high = want[i]
            means = {at: (0 if mean is None else int(np.clip((mean - low) / (high - low), 0, 1) * 255)) for at, (_, mean) in block_means(cube[b].astype(float), x.level).items()}
            for (y, c), value in np.ndenumerate(image[:, :, i]):
                assert abs(int(value) - means[x.row * 8 + y, x.column * 8 + c]) <= 1, (x, y, c)


def test_images_have_one_band_or_three(spark, tmp_path):
    with pytest.raises(ValueError, match="one band or three"):
        pyramid.write_tiles(Raster.from_numpy(spark, scene()), str(tmp_path), (0, 1))
