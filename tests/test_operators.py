"""Operators against closed forms, NumPy and planted truth."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import accuracy, bands as band_names, classify, combine, geodesy, library, radiometry, roi, stats, svm, transforms, warp
from bandloom.plans.linalg import mean_and_covariance
from bandloom.plans.raster import BandInfo, Raster, RasterMetadata
from bandloom.sources import synthetic


def raster(spark, cube, **meta):
    cube = np.asarray(cube, float)
    m = RasterMetadata(1, 1, 1, **meta)
    return Raster.from_numpy(spark, cube, m)


def image(df, value="cls"):
    rows = df.select("y", "x", value).collect()
    out = np.zeros((max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        out[r.y, r.x] = r[2]
    return out


def bands(spark, a):
    a = np.asarray(a, float)
    return spark.createDataFrame([(y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "y int, x int, value double")


def test_statistics(spark):
    df = bands(spark, np.arange(1, 10).reshape(3, 3)).withColumn("band", F.lit(0))
    s = stats.band_statistics(df).first()
    assert (s.n, s.min_v, s.max_v, s.mean_v) == (9, 1, 9, 5) and s.std_v == pytest.approx(np.arange(1, 10).std())
    got = {r.bin: r.n for r in stats.band_histogram(df, 10).collect()}
    want, _ = np.histogram(np.arange(1, 10), 10)
    assert [got.get(i, 0) for i in range(10)] == want.tolist()
    flat = bands(spark, np.full((8, 8), 100)).withColumn("band", F.lit(0))
    assert [(r.bin, r.n) for r in stats.band_histogram(flat, 256).collect()] == [(128, 64)]
    none = df.withColumn("value", F.lit(float("nan")))
    s = stats.band_statistics(none).first()
    assert (s.n, s.min_v, s.max_v) == (0, 0, 0)
    assert stats.report(stats.band_statistics(df)).first()["Mean"] == "5.000000"


def test_roi(spark):
    box = roi.ROI("box", bbox=(0, 0, 4, 4))
    a = np.fromfunction(lambda y, x: (y + x) % 2, (10, 10))
    a[:2, :2] = -9999
    df = bands(spark, a).withColumn("band", F.lit(0))
    s = roi.roi_statistics(df, [box], -9999.0).first()
    assert (s.n, s.mean_v) == (12, 0.5)
    assert roi.roi_statistics(df, [box]).first().min_v == -9999
    r = roi.ROI("two")
    r.add_polygon([(1, 1), (3, 1), (3, 3), (1, 3)])
    r.add_polygon([(6, 6), (8, 6), (8, 8), (6, 8)])
    mask = image(roi.mask_layer(df, r), "mask")
    assert mask[2, 2] == mask[7, 7] == 255 and mask[4, 4] == 0
    r.remove_last_polygon()
    assert r.num_polygons == 1 and image(roi.mask_layer(df, r), "mask")[7, 7] == 0
    with pytest.raises(ValueError):
        r.add_polygon([(0, 0), (1, 1)])
    assert roi.ROI.from_dict(r.to_dict()).polygons == r.polygons
    assert roi.ROI.from_dict({"polygon_points": [[0, 0], [1, 0], [1, 1]]}).num_polygons == 1
    masked = df.withColumn("spectrum", F.array(F.lit(-1.0), F.col("value")))
    got = {x.band: x.mean_v for x in roi.roi_mean_spectrum(masked, box, -1.0).collect()}
    assert np.isnan(got[0]) and not np.isnan(got[1])


def test_roi_file(spark, tmp_path):
    r = roi.ROI("a", bbox=(1, 2, 3, 4))
    roi.save_rois([r], str(tmp_path / "r.json"))
    assert roi.load_rois(str(tmp_path / "r.json"))[0].bbox == (1, 2, 3, 4)
    assert roi.roi_table(spark, [r]).first().bbox.x1 == 3


def test_accuracy(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 0, 2, 2], [0, 0, 1, 1, 2, 2])), "ref int, pred int")
    m = accuracy.confusion_matrix(df)
    a = accuracy.accuracy_metrics(m).first()
    assert a.oa == pytest.approx(500 / 6) and a.kappa == pytest.approx(0.75)
    assert "Kappa coefficient: 0.7500" in accuracy.report(m)
    pu = {r.cls: (r.pa, r.ua) for r in accuracy.producer_user_accuracy(m).collect()}
    assert pu[0] == pytest.approx((200 / 3, 100)) and pu[1] == pytest.approx((100, 50))
    assert accuracy.confusion_matrix(df, nodata=2.0).count() == 3
    with pytest.raises(ValueError):
        accuracy.report(m.limit(0))


def test_radiometry(spark):
    df = spark.createDataFrame([(10000.0,), (0.0,), (float("nan"),), (500.0,)], "dn double")
    rho = [r[0] for r in df.select(radiometry.reflectance(F.col("dn"), sun_elevation=30.0)).collect()]
    assert rho[:3] == pytest.approx([0.1, 0, 0])
    assert df.select(radiometry.radiance(F.col("dn"), 0.5, 10.0)).collect()[3][0] == 260
    ramp = spark.createDataFrame([(float(v),) for v in np.linspace(5000, 15000, 100)], "dn double")
    low = radiometry.dark_object(ramp, "dn").agg(F.min("rho")).first()[0]
    assert 0 <= low < 0.05
    names = ["Coastal Aerosol", "Blue", "Green", "Red", "Near Infrared (NIR)", "SWIR 1", "SWIR 2", "Cirrus", "TIRS 1", "TIRS 2", "Panchromatic"]
    assert [radiometry.band_number(BandInfo(i, n)) for i, n in enumerate(names)] == [1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 8]
    assert radiometry.band_number(BandInfo(0, "Near Infrared", mtl_band=4)) == 4
    meta = RasterMetadata(1, 1, 1, band_details=(BandInfo(0, "Red"),), raw_header={"mtl_data": {"L1_METADATA_FILE": {"RADIOMETRIC_RESCALING": {"REFLECTANCE_MULT_BAND_4": "1e-4"}}}})
    px = spark.createDataFrame([(0, 0, [1000.0])], "y int, x int, spectrum array<float>")
    assert radiometry.calibrate(px, meta).first().spectrum == pytest.approx([0.0], abs=1e-7)
    assert radiometry.calibrate(px, meta, mult=1e-3, add=0.5).first().spectrum == pytest.approx([1.5])


def test_sam_and_sid(spark):
    cube, _, truth = synthetic.cube(24, 24, 12)
    r = raster(spark, cube)
    refs = [cube[:, 2, 2].tolist(), cube[:, 2, 20].tolist(), cube[:, 20, 2].tolist(), cube[:, 20, 20].tolist()]
    got = image(classify.spectral_angle(r.df, refs))
    assert (got == truth).mean() > 0.95
    assert (image(classify.information_divergence(r.df, refs)) == truth).mean() > 0.95
    assert (image(classify.information_divergence(r.df, refs, 1e-9)) == -1).mean() > 0.95
    assert (image(classify.spectral_angle(r.df, refs, 1e9)) >= 0).all()
    cube[:, 0, 0] = np.nan
    assert image(classify.spectral_angle(raster(spark, cube).df, refs))[0, 0] == -1


def two_classes(seed=7):
    rng = np.random.default_rng(seed)
    cube = np.empty((4, 20, 20))
    cube[:, :, :10] = np.array([10, 20, 30, 40])[:, None, None] + rng.normal(0, 0.5, (4, 20, 10))
    cube[:, :, 10:] = np.array([80, 70, 60, 50])[:, None, None] + rng.normal(0, 0.5, (4, 20, 10))
    return cube


def training(spark, cube):
    rows = [(c, cube[:, y, x].tolist()) for c, cols in ((0, range(10)), (1, range(10, 20))) for y in range(20) for x in cols]
    return spark.createDataFrame(rows, "class_id int, spectrum array<double>")


def test_supervised(spark):
    cube = two_classes()
    t = training(spark, cube)
    cube[:, 0, 0], cube[:, 0, 1] = np.nan, 9999
    df = raster(spark, cube).df
    got = image(classify.maximum_likelihood(df, t, 0.01))
    assert got[0, 0] == got[0, 1] == -1 and (got[:, :10] == 0).sum() >= 190 and (got[:, 10:] == 1).sum() >= 190
    out = svm.classify(df, t)
    got = image(out)
    assert got[0, 0] == -1 and (got[:, :10] == 0).sum() >= 195 and (got[:, 10:] == 1).sum() >= 195
    sums = [sum(r.probabilities) for r in out.collect()]
    assert all(s == pytest.approx(1, abs=1e-4) or s == 0 for s in sums)
    for k in ("linear", "poly"):
        assert (image(svm.classify(df, t, k))[:, 10:] == 1).sum() >= 195
    with pytest.raises(ValueError):
        classify.maximum_likelihood(df, t.filter("class_id = 0"))
    with pytest.raises(ValueError):
        svm.kernel("odd", np.eye(2), np.eye(2), 1, 3, 0)


def test_chi2():
    assert classify.chi2_quantile(0.99, 4) == pytest.approx(13.2767, abs=1e-4)
    assert classify.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)


def test_kmeans(spark):
    cube = two_classes()
    cube[:, 3, 3] = np.nan
    df = raster(spark, cube).df
    done, centres = classify.kmeans(df, 2)
    got = image(done)
    assert got[3, 3] == -1 and len(centres) == 2 and len(np.unique(got[:, 10:])) == 1 and len(np.unique(got[:3, :10])) == 1
    assert image(classify.kmeans(df, 2)[0]).tolist() == got.tolist()
    empty = raster(spark, np.full((2, 3, 3), np.nan)).df
    assert (image(classify.kmeans(empty, 2)[0]) == -1).all()
    assert classify.kmeans(raster(spark, np.ones((2, 1, 2))).df, 5)[0].count() == 2
    kept, left = classify.isodata(df, 4, min_members=30)
    assert len(left) <= 4 and kept.count() == 400


def test_thematic(spark):
    df = spark.createDataFrame([(-1,), (0,), (11,)], "c int")
    assert [tuple(r[0]) for r in df.select(classify.thematic_rgb(F.col("c"))).collect()] == [(0, 0, 0), (0, 180, 0), (0, 100, 240)]
    assert [tuple(r[0]) for r in df.select(classify.thematic_rgb(F.col("c"), {0: (1, 2, 3)}, (9, 9, 9))).collect()] == [(9, 9, 9), (1, 2, 3), (9, 9, 9)]


def test_covariance_and_components(spark):
    cube, _, _ = synthetic.cube(32, 32, 16)
    df = raster(spark, cube).df
    flat = cube.reshape(16, -1).astype(np.float32).astype(float)
    n, mean, cov = mean_and_covariance(df)
    assert n == 1024 and np.allclose(mean, flat.mean(axis=1)) and np.allclose(cov, np.cov(flat))
    scores, values, share = transforms.pca(df, 3)
    assert len(values) == 16 and share[0] > share[1]
    s = np.array([r[0] for r in scores.select("scores").collect()])
    assert np.allclose(s.var(axis=0, ddof=1), values[:3])
    assert len(transforms.mnf(df, 3)[1]) == 3


def test_mnf_whitens_correlated_noise(spark):
    rng = np.random.default_rng(0)
    mix = rng.normal(size=(4, 4))
    cube = (mix @ rng.normal(size=(4, 60 * 60))).reshape(4, 60, 60)
    done, values = transforms.mnf(raster(spark, cube).df, 4)
    s = np.zeros((4, 60, 60))
    for r in done.collect():
        s[:, r.y, r.x] = r.scores
    noise = (s[:, :, 1:] - s[:, :, :-1]).reshape(4, -1)
    assert np.allclose(np.cov(noise), 2 * np.eye(4), atol=0.1)
    assert np.allclose(s.reshape(4, -1).var(axis=1, ddof=1), values, rtol=1e-3)


def test_ica(spark):
    rng = np.random.default_rng(3)
    src = np.vstack([rng.uniform(-1, 1, 900), rng.laplace(size=900)])
    cube = (rng.normal(size=(4, 2)) @ src + rng.normal(0, 1e-3, (4, 900))).reshape(4, 30, 30)
    for kind in ("parallel", "deflation"):
        done, mixing = transforms.ica(raster(spark, cube).df, 2, algorithm=kind)
        s = np.array([r[0] for r in done.orderBy("y", "x").select("scores").collect()]).T
        best = np.abs(np.corrcoef(np.vstack([s, src]))[:2, 2:])
        assert best.max(axis=1).min() > 0.95 and mixing.shape == (4, 2)
    assert transforms.ica(raster(spark, cube).df, 99)[1].shape[1] <= 4
    with pytest.raises(ValueError):
        transforms.ica(raster(spark, cube[:, :1, :2]).df, 4)


def test_endmembers_and_abundances(spark):
    rng = np.random.default_rng(0)
    true = np.abs(rng.normal(size=(3, 30)).cumsum(axis=1)) + 0.1
    share = rng.dirichlet([0.5] * 3, 3000)
    share[:60] = np.repeat(np.eye(3), 20, axis=0)
    df = raster(spark, (share @ true + rng.normal(0, 1e-4, (3000, 30))).T.reshape(30, 50, 60)).df
    found, residuals = transforms.endmembers(df, 3)
    corr = np.corrcoef(np.vstack([found, true]))[:3, 3:]
    assert sorted(corr.argmax(axis=1)) == [0, 1, 2] and corr.max(axis=1).min() > 0.95
    assert len(residuals) == 3 and (residuals > 0).all() and (residuals < 1).all()
    exact = raster(spark, (share[:100] @ true).T.reshape(30, 10, 10)).df
    got = np.array([r[0] for r in transforms.abundances(exact, true).orderBy("y", "x").select("abundance").collect()])
    assert np.allclose(got, share[:100], atol=1e-5)
    with pytest.raises(ValueError):
        transforms.endmembers(raster(spark, np.ones((5, 1, 2))).df, 2)


def test_continuum(spark):
    cr, hull = transforms.continuum_1d([0.5, 0.8, 0.4, 0.3, 0.7, 0.9, 0.6], np.arange(400, 1100, 100))
    assert np.allclose(cr, [1, 1, 0.4848, 0.3529, 0.8, 1, 1], atol=1e-4)
    assert transforms.continuum_1d([1, 2])[0].tolist() == [1, 2]
    rng = np.random.default_rng(1)
    cube = rng.uniform(0.1, 1, (6, 5, 5))
    got = [r.cr for r in transforms.continuum_removed(raster(spark, cube).df).orderBy("y", "x").collect()]
    assert np.allclose(got, [transforms.continuum_1d(v)[0] for v in cube.reshape(6, -1).T.astype(np.float32)])


def test_library(spark):
    assert len(library.curves()) == 20 and library.categories() == ["Vegetation", "Soil", "Rock", "Water", "Snow/Ice"] and library.find("none") is None
    for name in ("Green Vegetation", "Kaolinite", "Ice"):
        ranked = library.match(spark, library.GRID, library.find(name)[2], step=10).collect()
        assert ranked[0].name == name and ranked[0].angle < 1e-3 and [r.angle for r in ranked] == sorted(r.angle for r in ranked)
    only = library.match(spark, library.GRID, library.find("Ice")[2], only=["Water"], step=50).collect()
    assert {r.category for r in only} == {"Water"}
    with pytest.raises(ValueError):
        library.match(spark, [100.0, 200.0], [1.0, 2.0])
    points = spark.createDataFrame([(1, 450.0, 0.2), (1, 550.0, 0.3), (1, 650.0, 0.4), (1, 450.0, 0.9)], "key int, wl double, value double")
    t = spark.createDataFrame([(400.0,), (450.0,), (600.0,), (650.0,), (800.0,)], "wl double")
    got = [r.value for r in library.resample_spectrum(points, t).orderBy("wl").collect()]
    assert np.isnan(got[0]) and got[1:4] == pytest.approx([0.2, 0.35, 0.4]) and np.isnan(got[4])


def test_resample(spark):
    a = np.zeros((9, 9))
    a[4, 4] = 1
    up = image(warp.resample(bands(spark, a), (9, 9), (18, 18)), "value")
    assert up.sum() == pytest.approx(4.0) and up[8, 8] == up.max()
    b = image(warp.resample(bands(spark, [[10, 20], [30, 40]]), (2, 2), (4, 4)), "value")
    assert b.shape == (4, 4) and b.min() == 10 and b.max() == 40
    down = image(warp.resample(bands(spark, np.arange(16).reshape(4, 4)), (4, 4), (2, 2)), "value")
    assert down.ravel().tolist() == [2.5, 4.5, 10.5, 12.5]
    near = image(warp.resample(bands(spark, [[1, 2], [3, 4]]), (2, 2), (4, 4), "nearest"), "value")
    assert near[:2, :2].tolist() == [[1, 1], [1, 1]] and near[3, 3] == 4
    flat = image(warp.resample(bands(spark, np.full((150, 10), 3.0)), (150, 10), (300, 25), "cubic"), "value")
    assert flat.shape == (300, 25) and np.allclose(flat, 3)
    ramp = np.add.outer(np.arange(150.0), np.zeros(6))
    whole = image(warp.resample(bands(spark, ramp), (150, 6), (300, 6), "cubic"), "value")
    assert np.allclose(whole[20:-20, 0], (np.arange(20, 280) + 0.5) / 2 - 0.5, atol=1e-6)
    with pytest.raises(ValueError):
        combine.method_name("odd")


def test_pansharpen(spark):
    df = spark.createDataFrame([(100.0, 40.0, 50.0, 60.0)], "pan double, a double, b double, c double")
    got = df.select(*combine.brovey(F.col("pan"), [F.col(c) for c in "abc"])).first()
    assert list(got) == pytest.approx([80, 100, 120], rel=1e-5)
    with pytest.raises(ValueError):
        combine.brovey(F.col("pan"), [])
    rng = np.random.default_rng(2)
    ms = rng.uniform(10, 20, (200, 2))
    pan = ms.mean(axis=1)
    df = spark.createDataFrame([(float(p), float(a), float(b)) for p, (a, b) in zip(pan, ms)], "pan double, a double, b double")
    got = combine.gram_schmidt(df, "pan", ["a", "b"]).collect()
    assert np.allclose([(r.a_sharp, r.b_sharp) for r in got], ms, atol=1e-3)  # the real pan is the simulated one


def test_subset(spark):
    base = np.arange(100).reshape(10, 10)
    t = (30.0, 0.0, 500000.0, 0.0, -30.0, 4000000.0)
    r = raster(spark, np.stack([base, 2 * base, 3 * base]), transform=t, crs="EPSG:32650")
    s = combine.subset(r, 3, 7, 2, 8, [0, 2])
    got = s.to_numpy()
    assert got.shape == (2, 6, 4) and np.array_equal(got[1], 3 * base[2:8, 3:7])
    half = combine.subset(r, 2, 8, 2, 8, scale=0.5)
    assert (half.meta.width, half.meta.height) == (3, 3)
    assert half.meta.transform == (60.0, 0.0, 500060.0, 0.0, -60.0, 3999940.0)


def test_stack(spark):
    a, b = raster(spark, np.full((20, 30), 5.0)), raster(spark, np.full((10, 15), 10.0))
    s = combine.stack([(a, 0), (b, 0)])
    got = s.to_numpy()
    assert got.shape == (2, 20, 30) and (got[0] == 5).all() and (got[1] == 10).all()
    with pytest.raises(ValueError):
        combine.stack([])


def tile(spark, value, x0, n=10, h=10, px=30.0, crs="EPSG:32650"):
    return raster(spark, np.full((h, n), value), transform=(px, 0.0, 500000.0 + x0, 0.0, -px, 4000000.0), crs=crs)


def test_mosaic(spark):
    a, b = tile(spark, 5.0, 0), tile(spark, 9.0, 300)
    g = combine.mosaic_grid([a.meta, b.meta])
    assert (g.width, g.height, g.transform[2], g.transform[5]) == (20, 10, 500000.0, 4000000.0)
    m = combine.mosaic([a, b], method="nearest").to_numpy()[0]
    assert (m[:, :10] == 5).all() and (m[:, 10:] == 9).all()
    gap = combine.mosaic([tile(spark, 3.0, 0, 6), tile(spark, 7.0, 360, 6)], background=-1).to_numpy()[0]
    assert (gap[:, 6:12] == -1).all() and (gap[:, :6] == 3).all()
    a, b = tile(spark, 0.0, 0, 20, 20), tile(spark, 100.0, 300, 20, 20)
    f = combine.mosaic([a, b], feather_pixels=8).to_numpy()[0]
    assert f.shape == (20, 30) and (np.diff(f[10, 10:20]) > 0).all() and f[10, 2] == 0
    with pytest.raises(ValueError):
        combine.mosaic_grid([a.meta, tile(spark, 1.0, 0, crs="EPSG:32651").meta])
    with pytest.raises(ValueError):
        combine.mosaic_grid([RasterMetadata(1, 1, 1)])


def test_reprojection(spark):
    df = spark.createDataFrame([(114.2, 36.1), (119.9, -12.5)], "lon double, lat double")
    for crs in ("EPSG:32650", "EPSG:32750"):
        x, y = geodesy.transformed(F.col("lon"), F.col("lat"), "EPSG:4326", crs)
        there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        back = there.select("lon", "lat", *geodesy.transformed(F.col("x"), F.col("y"), crs, "EPSG:4326")).collect()
        assert all(r[2:] == pytest.approx(tuple(r[:2]), abs=1e-7) for r in back)
    a = np.fromfunction(lambda y, x: 100.0 + x + y, (20, 20))
    t = (30.0, 0.0, 500000.0, 0.0, -30.0, 4000000.0)
    m = combine.mosaic([raster(spark, a, transform=t, crs="EPSG:32650")], crs="EPSG:4326", resolution=0.0003, background=-1)
    got = m.to_numpy()[0]
    assert m.meta.crs == "EPSG:4326" and got.max() <= 138 and (got[4:-4, 4:-4] > 100).all()
    with pytest.raises(ValueError):
        combine.mosaic([raster(spark, a, transform=t, crs="EPSG:2056")], crs="EPSG:4326", resolution=1.0)


def test_utm(spark):
    df = spark.createDataFrame([(500000.0, 0.0), (448251.795, 5411932.678)], "e double, n double")
    lat, lon = geodesy.utm_to_wgs84(F.col("e"), F.col("n"), "EPSG:32631")
    got = [tuple(r) for r in df.select(lat, lon).collect()]
    assert got[0] == pytest.approx((0, 3)) and got[1] == pytest.approx((48.858222, 2.2945), abs=2e-4)
    with pytest.raises(ValueError):
        geodesy.zone_of("EPSG:3857")


def test_band_matching():
    wl = np.linspace(400, 2400, 64)
    meta = RasterMetadata(1, 1, 64, band_details=tuple(BandInfo(i, "", float(w)) for i, w in enumerate(wl)))
    assert band_names.match_bands(meta) == {"blue": 3, "green": 5, "red": 8, "nir": 14, "swir2": 57}
    named = RasterMetadata(1, 1, 3, band_details=(BandInfo(0, "Near Infrared"), BandInfo(1, "Red"), BandInfo(2, "SWIR 2")))
    assert band_names.match_bands(named) == {"red": 1, "nir": 0, "swir2": 2}
    micro = RasterMetadata(1, 1, 1, band_details=(BandInfo(0, "", 0.66),))
    assert band_names.match_bands(micro)["red"] == 0


def test_regions_as_references_and_windows(spark):
    a = np.stack([np.fromfunction(lambda y, x: x, (6, 6)), np.full((6, 6), 2.0)])
    r = raster(spark, a)
    left, none = roi.ROI("l", bbox=(0, 0, 2, 6)), roi.ROI("n", bbox=(50, 50, 60, 60))
    assert roi.references_from_rois(r.df, [left, none], 2) == [[0.5, 2.0], [0.0, 0.0]]
    assert combine.subset_to_roi(r, left).to_numpy().shape == (2, 6, 2)
    with pytest.raises(ValueError):
        combine.subset_to_roi(r, roi.ROI())


def brute(values, sy, sx, method):
    """Values at places of one band, by definition."""
    h, w = values.shape
    taps = {"bilinear": 1, "cubic": 2, "cubic_spline": 2, "lanczos": 3}[method]

    def weight(d):
        d = abs(d)
        if method == "bilinear":
            return max(0.0, 1 - d)
        if method == "cubic":
            return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0
        if method == "cubic_spline":
            return 2 / 3 - d**2 + d**3 / 2 if d <= 1 else (2 - d) ** 3 / 6 if d < 2 else 0.0
        return float(np.sinc(d) * np.sinc(d / 3)) if d < 3 else 0.0

    out = np.full(sy.shape, np.nan)
    for at in np.ndindex(sy.shape):
        y, x = min(max(sy[at], 0), h - 1), min(max(sx[at], 0), w - 1)
        if not (-0.5 <= sy[at] < h - 0.5 and -0.5 <= sx[at] < w - 0.5):
            continue
        total = weights = 0.0
        for i in range(int(np.floor(y)) - taps + 1, int(np.floor(y)) + taps + 1):
            for j in range(int(np.floor(x)) - taps + 1, int(np.floor(x)) + taps + 1):
                if 0 <= i < h and 0 <= j < w and np.isfinite(values[i, j]):
                    k = weight(y - i) * weight(x - j)
                    total, weights = total + k * values[i, j], weights + k
        out[at] = total / weights if weights > 1e-9 else np.nan
    return out


@pytest.mark.parametrize("method", ["bilinear", "cubic", "cubic_spline", "lanczos"])
def test_warps_by_definition(spark, method, monkeypatch):
    """Every method, across tiles, with holes, on a shifted and finer grid."""
    monkeypatch.setattr(warp, "TILE", 8)
    rng = np.random.default_rng(3)
    v = rng.uniform(1, 9, (14, 17))
    v[5, 6] = v[0, 3] = np.nan
    r = raster(spark, np.stack([v, 2 * v]), transform=(30.0, 0.0, 0.0, 0.0, -30.0, 420.0), crs="EPSG:32650")
    grid = warp.Grid(31, 22, (18.0, 0.0, -40.0, 0.0, -20.0, 435.0), "EPSG:32650")
    got = np.full((2, 22, 31), np.nan)
    for p in combine.warped(r.df, r.meta, grid, method).collect():
        got[:, p.y, p.x] = p.spectrum
    x, y = np.meshgrid(-40 + 18 * (np.arange(31) + 0.5), 435 - 20 * (np.arange(22) + 0.5))
    want = brute(v.astype(np.float32).astype(float), (420 - y) / 30 - 0.5, x / 30 - 0.5, method)
    assert np.allclose(got[0], want, equal_nan=True) and np.allclose(got[1], 2 * got[0], equal_nan=True, rtol=1e-5)


def test_average_and_rotation(spark):
    v = np.arange(64.0).reshape(8, 8)
    r = raster(spark, v, transform=(10.0, 0.0, 0.0, 0.0, -10.0, 80.0), crs="EPSG:32650")
    out = np.zeros((4, 4))
    for p in combine.warped(r.df, r.meta, warp.Grid(4, 4, (20.0, 0.0, 0.0, 0.0, -20.0, 80.0), "EPSG:32650"), "average").collect():
        out[p.y, p.x] = p.spectrum[0]
    assert np.allclose(out, v.reshape(4, 2, 4, 2).mean(axis=(1, 3)))
    turned = raster(spark, v, transform=(0.0, 10.0, 0.0, 10.0, 0.0, 0.0), crs="EPSG:32650")  # rows and columns change places
    out = np.zeros((8, 8))
    for p in combine.warped(turned.df, turned.meta, warp.Grid(8, 8, (10.0, 0.0, 0.0, 0.0, -10.0, 80.0), "EPSG:32650"), "nearest").collect():
        out[p.y, p.x] = p.spectrum[0]
    assert np.array_equal(out, v.T[::-1])
    with pytest.raises(ValueError):
        combine.mosaic([r], method="odd")


def test_zone_to_zone(spark):
    """A smooth field in zone 50, seen from zone 51 near their border, has the values of its places."""
    field = lambda lat, lon: 1000 * (lat - 36) + 100 * (lon - 120)
    t = (500.0, 0.0, 765000.0, 0.0, -500.0, 4000000.0)
    x, y = np.meshgrid(t[2] + 500 * (np.arange(40) + 0.5), t[5] - 500 * (np.arange(40) + 0.5))
    lat, lon = geodesy.utm_to_wgs84(x, y, "EPSG:32650", geodesy.Arrays)
    a = raster(spark, field(lat, lon), transform=t, crs="EPSG:32650")
    m = combine.mosaic([a], crs="EPSG:32651", resolution=500.0, background=-9999.0)
    assert m.meta.crs == "EPSG:32651"
    got = m.to_numpy()[0]
    g = m.meta.transform
    x, y = np.meshgrid(g[2] + 500 * (np.arange(m.meta.width) + 0.5), g[5] - 500 * (np.arange(m.meta.height) + 0.5))
    lat, lon = geodesy.utm_to_wgs84(x, y, "EPSG:32651", geodesy.Arrays)
    inside = got != -9999.0
    assert 0.8 * 1600 < inside.sum() < 1.2 * 1600 and np.abs(got - field(lat, lon))[inside].max() < 3  # half a pixel at the edge
    back = geodesy.converted(*geodesy.converted(x, y, "EPSG:32651", "EPSG:32650"), "EPSG:32650", "EPSG:32651")
    assert np.allclose(back[0], x, atol=1e-3) and np.allclose(back[1], y, atol=1e-3)


def test_pan_sharpened_raster(spark):
    t = (15.0, 0.0, 0.0, 0.0, -15.0, 300.0)
    pan = raster(spark, np.full((20, 20), 100.0), transform=t, crs="EPSG:32650")
    ms = raster(spark, np.stack([np.full((10, 10), v) for v in (40.0, 50.0, 60.0)]))
    out = combine.pan_sharpened(pan, ms)
    assert (out.meta.width, out.meta.height, out.meta.bands, out.meta.transform) == (20, 20, 3, t)
    assert np.allclose(out.to_numpy(), np.array([80.0, 100.0, 120.0])[:, None, None], rtol=1e-3)
    flat = combine.pan_sharpened(raster(spark, np.full((20, 20), 50.0)), ms, "gram_schmidt", [0, 2])
    assert np.allclose(flat.to_numpy(), np.array([40.0, 60.0])[:, None, None], atol=1e-3)
    named = RasterMetadata(1, 1, 2, band_details=(BandInfo(0, "Red"), BandInfo(1, "Panchromatic")))
    assert combine.pan_band(named) == 1 and combine.pan_band(RasterMetadata(1, 1, 3)) is None
    for bad in ({"method": "odd"}, {"bands": []}):
        with pytest.raises(ValueError):
            combine.pan_sharpened(pan, ms, **bad)


def test_accuracy_of_rasters(spark, tmp_path):
    c = raster(spark, np.array([[0.0, 1.0], [2.0, 0.0]]))
    same = accuracy.assess(c, c)
    assert accuracy.accuracy_metrics(same).first().oa == 100 and same.count() == 3
    big = raster(spark, np.kron([[0.0, 1.0], [2.0, 1.0]], np.ones((2, 2))))
    with pytest.raises(ValueError, match="shapes differ"):
        accuracy.assess(big, c)
    out = {(r.ref, r.pred): r.n for r in accuracy.assess(big, c, resize=True).collect()}
    assert out == {(0, 0): 4, (1, 1): 4, (2, 2): 4, (0, 1): 4}
    text = accuracy.report(same, path=str(tmp_path / "report.txt"))
    assert (tmp_path / "report.txt").read_text().strip() == text.strip()


def test_angles_reports_and_names(spark):
    assert library.spectral_angle_degrees([1, 2, 3], [2, 4, 6]) == pytest.approx(0, abs=1e-5)
    assert library.spectral_angle_degrees([1, 0, np.nan], [0, 1, 5]) == pytest.approx(90)
    assert np.isnan(library.spectral_angle_degrees([0, 0], [1, 1])) and np.isnan(library.spectral_angle_degrees([np.nan], [1.0]))
    assert "estimated SNR 2.50" in transforms.component_report("mnf", "scene", 4, [3.5, 0.9]) and "estimated SNR 0.00" in transforms.component_report("mnf", "scene", 4, [0.9])
    assert "Variance explained: 90.00 %" in transforms.component_report("pca", "scene", 4, [8.0, 1.0], [0.8, 0.1])
    meta = RasterMetadata(1, 1, 3, band_details=(BandInfo(0, "Red", 655.0), BandInfo(1, "", 865.0), BandInfo(2, "Blue", 482.0)))
    done = radiometry.calibrated_meta(meta, "radiance", [2, 1])
    assert [b.name for b in done.band_details] == ["Blue (radiance)", "Band 2 (radiance)"] and done.band_details[0].wavelength == 482.0
    r = raster(spark, np.array([[[1.0]], [[2.0]], [[3.0]]]), band_details=meta.band_details)
    assert r.profile_by_wavelength(0, 0) == [(482.0, 3.0), (655.0, 1.0), (865.0, 2.0)] and r.profile_by_wavelength(5, 5) is None
    shares = transforms.abundance_raster(r, np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]))
    assert shares.meta.nodata == 0.0 and shares.meta.bands == 2 and shares.to_numpy()[:, 0, 0].tolist() == [1.0, 2.0]


def test_difference_covariance(spark):
    """The same as by a window over lines, however the pixels lie in the tasks."""
    rng = np.random.default_rng(4)
    df = raster(spark, rng.normal(size=(3, 9, 40))).df
    want = np.cov(np.array([r.d for r in transforms.differences(df).collect()]).T)
    for spread in (df.coalesce(1), df.repartition(5), df.repartition(3, "y").sortWithinPartitions("y", "x"), df.orderBy("x", "y")):
        n, got = transforms.difference_covariance(spread)
        assert n == 9 * 39 and np.allclose(got, want)
    assert transforms.difference_covariance(raster(spark, np.ones((2, 3, 1))).df)[0] == 0


def test_statistics_of_spectra(spark):
    rng = np.random.default_rng(5)
    cube = rng.normal(1e6, 1.0, (3, 20, 20)).astype(np.float32)
    cube[1, :5] = np.nan
    cube[2, 3] = -9999.0
    df = raster(spark, cube).df
    for nodata in (None, -9999.0):
        want = {r.band: r for r in stats.band_statistics(stats.long_bands(df), nodata).collect()}
        for r in stats.spectrum_statistics(df.repartition(4), nodata).collect():
            assert (r.n, r.min_v, r.max_v) == (want[r.band].n, want[r.band].min_v, want[r.band].max_v)
            assert r.mean_v == pytest.approx(want[r.band].mean_v) and r.std_v == pytest.approx(want[r.band].std_v, rel=1e-9)
    assert stats.spectrum_statistics(df.limit(0)).count() == 0
    assert [(r.n, r.mean_v) for r in stats.spectrum_statistics(raster(spark, np.full((1, 2, 2), np.nan)).df).collect()] == [(0, 0.0)]


def test_command_line(spark, tmp_path, capsys):
    from bandloom import __main__ as command
    from bandloom.sources import writer

    cube, wl, _ = synthetic.cube(12, 10, 4)
    path = writer.export(raster(spark, cube), str(tmp_path / "scene.dat"))
    assert command.main([]) == 2 and command.main([path]) == 0
    out = capsys.readouterr().out
    assert "10 x 12 x 4 float32" in out and f"{cube[0].astype(np.float32).astype(float).mean():.6f}" in out and "120" in out


@pytest.mark.parametrize("target", [(64, 4), (13, 29), (4, 64), (96, 10), (64, 64)])
def test_average_shrinks_each_axis_by_itself(spark, target):
    """Weights by the covered part of each source pixel, along y and x apart."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(64, 64))
    rows = [(y, x, [float(v[y, x])]) for y in range(64) for x in range(64)]
    df = spark.createDataFrame(rows, "y int, x int, spectrum array<double>")

    def parts(n, m):
        out = np.zeros((m, n))
        for i in range(m):
            centre, half = (i + 0.5) * n / m, max(n / m, 1) / 2
            for j in range(n):
                out[i, j] = max(0, min(j + 1, centre + half) - max(j, centre - half))
        return out / out.sum(axis=1, keepdims=True)

    want = parts(64, target[0]) @ v @ parts(64, target[1]).T
    got = np.full(target, np.nan)
    for r in warp.resized(df, (64, 64), target, 1, "average").collect():
        got[r.y, r.x] = r.spectrum[0]
    assert np.allclose(got, want)


def test_average_of_a_turned_raster(spark):
    """A quarter turn swaps the axes' shares."""
    v = np.arange(40.0 * 12).reshape(40, 12)
    df = spark.createDataFrame([(y, x, [float(v[y, x])]) for y in range(40) for x in range(12)], "y int, x int, spectrum array<double>")
    source = warp.Source(12, 40, (0.0, 1.0, 0.0, 1.0, 0.0, 0.0), "")  # x goes down, y to the right
    grid = warp.Grid(10, 4, (4.0, 0.0, 0.0, 0.0, 3.0, 0.0), "")
    assert np.allclose(source.footprint(grid), (4, 3))
    got = {(r.y, r.x): r.spectrum[0] for r in warp.merged([(df, source)], grid, 1, "average").collect()}
    assert got == {(i, j): pytest.approx(v.T[3 * i : 3 * i + 3, 4 * j : 4 * j + 4].mean()) for i in range(4) for j in range(10)}


def test_components_without_a_valid_pixel(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, x, [nan] * 4) for x in range(3)] + [(1, 0, None)], "y int, x int, spectrum array<double>")
    out, values, shares = transforms.pca(df, 3)
    assert all(np.isnan(r.scores).all() and len(r.scores) == 3 for r in out.collect()) and values.tolist() == [0] * 4 and shares.tolist() == [0] * 3
    out, values = transforms.mnf(df, 9)
    assert all(np.isnan(r.scores).all() and len(r.scores) == 4 for r in out.collect()) and values.tolist() == [0] * 4
    assert transforms.pca(df.limit(0), 3)[0].collect() == []


def test_svm_memory_is_a_pair_of_classes(spark, monkeypatch):
    """Kernels are of two classes in training, and of blocks of pixels by the support vectors in prediction."""
    rng = np.random.default_rng(0)
    rows = [(c, [float(v) for v in rng.normal(3 * c, 1, 3)]) for c in range(6) for _ in range(60)]
    sizes, inner = [], svm.kernel

    def seen(name, a, b, *rest):
        sizes.append(len(a) * len(b))
        return inner(name, a, b, *rest)

    monkeypatch.setattr(svm, "kernel", seen)
    training = spark.createDataFrame(rows, "class_id int, spectrum array<double>")
    out = svm.classify(training.withColumnRenamed("class_id", "truth"), training)
    assert max(sizes) <= 120**2
    assert np.mean([r.cls == r.truth for r in out.collect()]) > 0.85


def planted(rng, k=4, bands=30, pixels=20_000):
    """Separate bumps, mixed at random, with some pure pixels."""
    grid = np.arange(bands)
    members = np.array([0.1 + np.exp(-0.5 * ((grid - c) / 2.5) ** 2) for c in np.linspace(3, bands - 4, k)])
    share = rng.dirichlet([0.6] * k, pixels)
    share[: 150 * k] = np.repeat(np.eye(k), 150, axis=0)
    return members, share @ members + rng.normal(0, 0.002, (pixels, bands))


def test_features_of_a_planted_scene(spark):
    """Each feature matches a member of its own, and they differ from each other."""
    members, x = planted(np.random.default_rng(0))
    df = raster(spark, x.T.reshape(30, 100, 200)).df
    found, residuals = transforms.endmembers(df, 3)
    corr = np.corrcoef(np.vstack([found, members]))
    assert corr[:3, 3:].max(axis=1).min() > 0.95 and len(set(corr[:3, 3:].argmax(axis=1))) == 3
    assert (corr[:3, :3] - np.eye(3)).max() < 0.85
    again, _ = transforms.endmembers(df.repartition(7), 3)
    assert np.allclose(found, again)


def test_residuals_are_of_the_whole_image(spark):
    """Also where the search sees a sample only; and against rays that are known."""
    members, x = planted(np.random.default_rng(1), 2, 12, 3000)
    df = raster(spark, x.T.reshape(12, 50, 60)).df
    found, residuals = transforms.endmembers(df, 2, max_samples=400)
    u = np.eye(12)[:2]
    want = [np.mean(np.linalg.norm(np.maximum(x, 0) - np.maximum(x @ v, 0)[:, None] * v, axis=1) / np.linalg.norm(np.maximum(x, 0), axis=1)) for v in u]
    assert transforms.scene_residuals(df, u, "spectrum") == pytest.approx(want, abs=1e-6)
    assert len(residuals) == 2 and np.corrcoef(np.vstack([found, members]))[:2, 2:].max() > 0.99


def test_a_search_stays_in_its_basin():
    """With a small basin a start ends at its own feature; with all pixels as inliers it ends between them."""
    members, x = planted(np.random.default_rng(2), 2, 12, 2000)
    unit = members / np.linalg.norm(members, axis=1, keepdims=True)
    x = np.maximum(x, 0)
    own, _ = transforms.fitted_directions(x, unit.copy(), 60, 1e-6, 0.1)
    assert (np.einsum("ij,ij->i", own, unit) > 0.999).all()
    wide, _ = transforms.fitted_directions(x, unit.copy(), 1, 1e-6, 1.0)
    assert (np.einsum("ij,ij->i", wide, unit) < 0.9999).any()


def test_feature_count_follows_the_variance(spark):
    members, x = planted(np.random.default_rng(3), 3, 10, 2000)
    df = raster(spark, x.T.reshape(10, 40, 50)).df
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    found, _ = transforms.endmembers(df, min_variance_fraction=float((values[1] + values[2]) / 2 / values[0]))
    assert len(found) == 2  # shares sum to 1: three members vary in two directions
    assert len(transforms.endmembers(df, 99)[0]) == 10


def test_samples_by_hash(spark):
    df = spark.range(5000).selectExpr("cast(id as int) y", "0 x", "cast(array(id, 1) as array<double>) spectrum")
    one, two = (transforms.sampled(d, 300, 7, ("y", "x"), "spectrum") for d in (df, df.repartition(9)))
    assert len(one) == 300 and (one == two).all()
    assert len(transforms.sampled(df.withColumn("y", F.lit(1)), 300, 7, ("y", "x"), "spectrum")) == 300
    assert len(transforms.sampled(df.limit(0), 300, 7, ("y", "x"), "spectrum")) == 0


def test_machines_are_fitted_in_tasks(spark, monkeypatch):
    """The driver fits none itself: their number grows with the square of the classes."""
    monkeypatch.setattr(svm, "FEW", 0)
    driver, fit = os.getpid(), svm.smo
    monkeypatch.setattr(svm, "smo", lambda *a: fit(*a) if os.getpid() != driver else pytest.fail("fitted on the driver"))
    rng = np.random.default_rng(1)
    cube = np.concatenate([rng.normal(m, 0.1, (4, 10, 2)) for m in (0, 3, 6)])
    r = raster(spark, cube.transpose(2, 0, 1)).df
    truth = F.floor(F.col("y") / 4).cast("int")
    got = svm.classify(r, r.select(truth.alias("class_id"), "spectrum")).select(truth.alias("t"), "cls").collect()
    assert len(got) == 120 and all(p.t == p.cls for p in got)
