"""Continuum removal and library search for all pixels at once, against one spectrum at a time."""

import time

import numpy as np
import pytest

from bandloom.operators import library, transforms


def slow_hull(x, y):
    """The least concave function above the values: the most that any chord reaches."""
    n = len(x)
    return np.array([max([y[i], *(y[a] + (y[b] - y[a]) * (x[i] - x[a]) / (x[b] - x[a]) for a in range(i + 1) for b in range(i, n) if b > a)]) for i in range(n)])


def test_hulls_by_chords():
    rng = np.random.default_rng(5)
    for x, y in (
        (np.arange(12.0), rng.uniform(0, 1, (40, 12))),
        (np.sort(rng.uniform(400, 2500, 12)), rng.uniform(0, 1, (40, 12))),
        (np.arange(12.0), rng.integers(0, 3, (60, 12)).astype(float)),  # ties
        (np.arange(12.0), np.tile(np.arange(12.0), (3, 1))),  # one line
        (np.arange(12.0), np.stack([np.zeros(12), np.full(12, 0.5), -np.ones(12)])),
    ):
        removed, hull = transforms.continua(y, x)
        want = np.maximum([slow_hull(x, v) for v in y], 1e-7)
        assert np.allclose(hull, want, atol=1e-12) and np.allclose(removed, np.clip(y / want, 0, 1))


def test_continua_edges():
    assert transforms.continua(np.zeros((0, 6)))[0].shape == (0, 6)
    assert transforms.continua(np.array([[1.0, 2.0]]))[0].tolist() == [[1.0, 2.0]]
    mixed = np.array([[0.2, 0.5, 0.1, 0.4], [np.nan] * 4])
    removed = transforms.continua(mixed)[0]
    assert np.allclose(removed[0], transforms.continuum_1d(mixed[0])[0]) and np.isnan(removed[1]).all()


def test_continua_are_fast():
    """65,536 pixels of 64 bands in step take less than a tenth of the time a pixel that they take one at a time."""
    y = np.random.default_rng(2).uniform(0, 1, (65_536, 64))
    begun = time.thread_time()
    transforms.continua(y)
    whole = time.thread_time() - begun
    begun = time.thread_time()
    for v in y[:500]:
        transforms.continua(v[None])
    assert whole / len(y) * 10 < (time.thread_time() - begun) / 500


def test_identified_as_matched(spark):
    rng = np.random.default_rng(3)
    wl = np.linspace(380, 2450, 40)  # from below the library's first wavelength
    pixels = [rng.uniform(0.01, 1, 40).tolist() for _ in range(4)] + [np.interp(wl, library.GRID, library.find("Kaolinite")[2]).tolist()]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pixels)], "id int, spectrum array<float>")
    got = {r.id: (r.name, r.angle) for r in library.identified(df, wl).collect()}
    found, names = library.angles(df, wl)
    every = {r.id: dict(zip(names, r.angles)) for r in found.collect()}
    for i, p in enumerate(pixels):
        want = [(r.name, r.angle) for r in library.match(spark, wl, np.float32(p).astype(float)).collect()]
        assert got[i][0] == want[0][0] and got[i][1] == pytest.approx(want[0][1], abs=1e-6)
        assert every[i] == pytest.approx(dict(want), abs=1e-6)
    assert got[4][0] == "Kaolinite"
    back = library.identified(df.filter("id = 4"), wl[::-1]).first()  # the order of bands is that of the wavelengths
    assert back.angle != pytest.approx(got[4][1])


def test_identified_edges(spark):
    wl = [500.0, 800.0, 1600.0]
    rows = [(0, None), (1, [0.0, 0.0, 0.0]), (2, [float("nan"), 0.1, 0.2]), (3, [0.1, float("inf"), 0.2]), (4, [0.05, 0.5, 0.3]), (5, [0.05, 0.5, 0.3])]
    df = spark.createDataFrame(rows, "name_of int, spectrum array<float>")
    got = {r.name_of: r.name for r in library.identified(df, wl).collect()}
    assert [got[i] for i in range(4)] == [None] * 4 and got[4] == got[5] is not None
    assert library.identified(df, wl, max_angle=1e-9).filter("name is not null").count() == 0
    only = library.identified(df, wl, only=["Rock"]).filter("name_of = 4").first()
    assert only.name in library.find(only.name)[0] and library.find(only.name)[1] == "Rock"
    assert library.identified(df.limit(0), wl).count() == 0
    for bad in ([1.0, 2.0, 3.0], [500.0, 500.0, 600.0], [500.0]):
        with pytest.raises(ValueError):
            library.identified(df, bad)
