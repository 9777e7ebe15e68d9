"""Coordinate systems against published worked examples, and there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import combine, projections
from bandloom.plans.raster import RasterMetadata

ARRAYS = projections.Arrays
JAMAICA = "+proj=lcc +lat_0=18 +lon_0=-77 +x_0=250000 +y_0=150000 +ellps=clrk66"
ANTARCTIC = "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000"
UPS = "+proj=stere +lat_0=90 +lon_0=0 +k=0.994 +x_0=2000000 +y_0=2000000"
CLARKE_ALBERS = "+proj=aea +lat_0=23 +lon_0=-96 +lat_1=29.5 +lat_2=45.5 +ellps=clrk66"


def degrees(d, m=0, s=0.0):
    return d + m / 60 + s / 3600


@pytest.mark.parametrize(
    "crs, lat, lon, x, y, near",
    [
        ("EPSG:27700", 50.5, 0.5, 577274.99, 69740.50, 0.02),
        (JAMAICA, degrees(17, 55, 55.8), -degrees(76, 56, 37.26), 255966.58, 142493.51, 0.01),
        (ANTARCTIC, -75.0, 120.0, 7255380.79, 7053389.56, 0.01),
        (UPS, 73.0, 44.0, 3320416.75, 632668.43, 0.01),
        ("EPSG:3857", degrees(24, 22, 54.433), -degrees(100, 20), -11169055.58, 2800000.0, 0.01),
        (CLARKE_ALBERS, 35.0, -75.0, 1885472.7, 1535925.0, 0.1),
    ],
)
def test_worked_examples(crs, lat, lon, x, y, near):
    got = projections.forward(np.array([lat]), np.array([lon]), projections.system(crs), ARRAYS)
    assert got[0][0] == pytest.approx(x, abs=near) and got[1][0] == pytest.approx(y, abs=near)


def test_datum_step():
    s = projections.system("+proj=longlat +towgs84=0,0,4.5,0,0,0.554,0.219")
    got = projections.applied((3657660.66, 255768.55, 5201382.11), (s.matrix, s.shift))
    assert got == pytest.approx((3657660.78, 255778.43, 5201387.75), abs=0.01)
    matrix, shift = projections.step(projections.system("EPSG:4326"), s)
    assert projections.applied(got, (matrix, shift)) == pytest.approx((3657660.66, 255768.55, 5201382.11), abs=1e-6)
    assert projections.step(projections.system("EPSG:4326"), projections.system("EPSG:4258")) is None


@pytest.mark.parametrize(
    "crs, south, north, west, east",
    [
        ("EPSG:32650", -80, 84, 90, 144), ("EPSG:32750", -80, 84, 117, 123), ("EPSG:25832", 40, 70, 0, 20), ("EPSG:2193", -48, -33, 165, 179.9), ("EPSG:2154", 41, 52, -5, 10), ("EPSG:3034", 30, 75, -20, 40),
        ("EPSG:3577", -45, -8, 110, 155), ("EPSG:5070", 20, 55, -130, -60), ("EPSG:3413", 50, 90, -180, 179.9), ("EPSG:3031", -90, -60, -180, 179.9), ("EPSG:3857", -85, 85, -180, 179.9),
        ("+proj=lcc +lat_1=-30 +lat_2=-50 +lat_0=-40 +lon_0=140 +ellps=intl", -60, -10, 110, 170), ("+proj=merc +lat_ts=40 +lon_0=170 +ellps=bessel", -80, 80, 100, 179.9), ("+proj=utm +zone=33 +south", -80, 0, 10, 20),
    ],
)
def test_there_and_back(crs, south, north, west, east):
    lat, lon = (v.ravel() for v in np.meshgrid(np.linspace(south, north, 41), np.linspace(west, east, 37)))
    s = projections.system(crs)
    back = projections.inverse(*projections.forward(lat, lon, s, ARRAYS), s, ARRAYS)
    pole = np.abs(lat) == 90  # where every longitude is the same place
    assert np.abs(back[0] - lat).max() < 1e-9 and np.abs((back[1] - lon + 180) % 360 - 180)[~pole].max() < 1e-9


def test_scales():
    """A short step north and one east are as long as they are on the ground, up to the scale: equal in a conformal system,
    of product 1 in an equal-area one."""
    for crs, lat, lon, conformal in (("EPSG:2154", 47.0, 1.0, True), ("EPSG:3413", 80.0, 10.0, True), ("EPSG:27700", 55.0, -4.0, True), ("EPSG:5070", 40.0, -80.0, False), ("EPSG:3577", -20.0, 140.0, False)):
        s, d = projections.system(crs), 1e-5
        e2, a, sine = s.ellipsoid.e**2, s.ellipsoid.a, np.sin(np.radians(lat))
        north = a * (1 - e2) / (1 - e2 * sine**2) ** 1.5 * np.radians(d)
        east = a / np.sqrt(1 - e2 * sine**2) * np.cos(np.radians(lat)) * np.radians(d)
        x, y = projections.forward(np.array([lat - d / 2, lat + d / 2, lat, lat]), np.array([lon, lon, lon - d / 2, lon + d / 2]), s, ARRAYS)
        h, k = np.hypot(x[1] - x[0], y[1] - y[0]) / north, np.hypot(x[3] - x[2], y[3] - y[2]) / east
        assert h == pytest.approx(k, rel=1e-6) if conformal else h * k == pytest.approx(1, rel=1e-6)


def test_columns_are_the_arrays(spark):
    lat, lon = np.linspace(50.0, 58.0, 9), np.linspace(-6.0, 2.0, 9)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat)], "x double, y double").withColumn("_0_xy", F.lit("kept"))
    for crs in ("EPSG:27700", "EPSG:3857", "EPSG:3034", "EPSG:3413", "EPSG:32630", CLARKE_ALBERS):
        rows = projections.reprojected(df, "EPSG:4326", crs).collect()
        want = projections.converted(lon, lat, "EPSG:4326", crs)
        assert np.allclose([r.x for r in rows], want[0], atol=1e-6) and np.allclose([r.y for r in rows], want[1], atol=1e-6) and rows[0]["_0_xy"] == "kept"
    none = spark.createDataFrame([(None, 1.0), (0.0, 90.0)], "x double, y double")
    got = projections.reprojected(none, "EPSG:4326", "EPSG:3413").collect()
    assert got[0].x is None and (got[1].x, got[1].y) == pytest.approx((0, 0), abs=1e-6)


def test_unknown_systems():
    for crs in ("EPSG:2056", "+proj=somerc", "+proj=stere +lat_0=40", "+proj=lcc +lat_1=10 +lat_2=-10", "+proj=tmerc +ellps=unheard", "+proj=tmerc +units=us-ft", "elsewhere", ""):
        assert not projections.supported(crs)


def test_warp_between_systems(spark):
    """A smooth field on a Lambert grid, seen in Web Mercator, has the values of its places."""
    from bandloom.plans.raster import Raster

    field = lambda lat, lon: 100 * (lat - 45) + 10 * lon
    t = (2000.0, 0.0, 600000.0, 0.0, -2000.0, 6700000.0)
    y, x = np.mgrid[0:40, 0:40]
    lon, lat = projections.converted(t[2] + 2000 * (x + 0.5), t[5] - 2000 * (y + 0.5), "EPSG:2154", "EPSG:4326")
    rows = [(int(i), int(j), [float(v)]) for i, j, v in zip(y.ravel(), x.ravel(), field(lat, lon).ravel())]
    r = Raster(RasterMetadata(40, 40, 1, transform=t, crs="EPSG:2154"), spark.createDataFrame(rows, "y int, x int, spectrum array<float>"))
    m = combine.mosaic([r], crs="EPSG:3857", resolution=3000.0, background=-9999.0)
    got, g = m.to_numpy()[0], m.meta.transform
    y, x = np.mgrid[0 : m.meta.height, 0 : m.meta.width]
    lon, lat = projections.converted(g[2] + 3000 * (x + 0.5), g[5] - 3000 * (y + 0.5), "EPSG:3857", "EPSG:4326")
    inside = got != -9999.0
    assert inside.sum() > 1000 and np.abs(got - field(lat, lon))[inside].max() < 2  # half a pixel at the edge
    with pytest.raises(ValueError):
        combine.mosaic([r], crs="EPSG:2056", resolution=3000.0)


def test_outline():
    world = RasterMetadata(360, 180, 1, transform=(1.0, 0.0, -180.0, 0.0, -1.0, 90.0), crs="EPSG:4326")
    with pytest.raises(ValueError):
        combine.outline(world, "+proj=tmerc +lon_0=-90")  # a quarter of the globe away the scale is infinite
    left, bottom, right, top = combine.outline(RasterMetadata(10, 10, 1, transform=(1.0, 0.0, 0.0, 0.0, -1.0, 50.0), crs="EPSG:4326"), "EPSG:3857")
    assert (left, right) == pytest.approx((0, 1113194.9079), abs=1e-3) and bottom < top
