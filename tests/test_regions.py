"""Regions by scanline spans: many vertices, many regions, unions, and the joins that take them to pixels."""

import math
import time
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandloom.operators import roi, spans


def pixels(spark, height, width):
    return spark.range(height * width).selectExpr(f"cast(id div {width} as int) y", f"cast(id % {width} as int) x", "cast(array(id, -id) as array<float>) spectrum")


def odd(polygon, x, y):
    """Even-odd by a plain scan of the edges."""
    hit = False
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]]):
        if (y < y0) != (y < y1) and x < x0 + (y - y0) * ((x1 - x0) / (y1 - y0)):
            hit = not hit
    return hit


def star(rng, n, cx, cy, size):
    return [(cx + size * rng.uniform(0.2, 1) * math.cos(a), cy + size * rng.uniform(0.2, 1) * math.sin(a)) for a in np.linspace(0, 2 * np.pi, n, endpoint=False)]


SHAPES = [
    [(1, 1), (8, 1), (8, 8), (1, 8)],  # on pixel corners
    [(0.5, 0.5), (9.5, 9.5), (9.5, 0.5), (0.5, 9.5)],  # crosses itself
    [(2, 2), (2, 2), (7, 2), (7, 2), (4, 9)],  # repeated points
    [(-5, -5), (30, 4), (-5, 14)],  # beyond the image
    [(3, 3), (6, 3), (3, 3)],  # flat
    [(1, 1), (9, 1), (9, 9), (1, 9), (1, 1), (3, 3), (3, 6), (6, 6), (6, 3), (3, 3)],  # a hole
]


@pytest.mark.parametrize("polygon", SHAPES)
def test_spans_agree_with_a_plain_scan(spark, polygon):
    r = roi.ROI("r")
    r.add_polygon(polygon)
    df = pixels(spark, 12, 11)
    want = {(y, x) for y in range(12) for x in range(11) if odd(r.polygons[0], x, y)}
    by_mask = {(p.y, p.x) for p in df.filter(r.mask(F.col("x"), F.col("y"))).collect()}
    joined = roi.below(df, roi.roi_table(spark, [r])).collect()
    assert by_mask == want and sorted((p.y, p.x) for p in joined) == sorted(want)


def test_unions_and_names(spark):
    """Polygons of a region, and regions of a name, are united; a pixel is counted once, by expression and by join."""
    rng = Random(2)
    rois = [roi.ROI("a", polygons=[star(rng, 9, 8, 8, 7), star(rng, 7, 10, 9, 6)]), roi.ROI("b", bbox=(3, 2, 9, 12)), roi.ROI("a", bbox=(0, 0, 4, 4)), roi.ROI("none"), roi.ROI("b", polygons=[star(rng, 12, 15, 15, 9)])]
    df = pixels(spark, 20, 20)
    masks = {}
    for r in rois:
        for y in range(20):
            for x in range(20):
                box = r.bbox and not r.polygons and r.bbox[0] <= x < r.bbox[2] and r.bbox[1] <= y < r.bbox[3]
                if box or any(odd(p, x, y) for p in r.polygons):
                    masks.setdefault((y, x), set()).add(r.name)
    want = sorted((y, x, n) for (y, x), names in masks.items() for n in names)
    for given in (rois, roi.roi_table(spark, rois)):
        assert sorted((p.y, p.x, p.region) for p in roi.below(df, given).collect()) == want
        left = roi.below(df, given, "left").collect()
        assert sum(p.region is None for p in left) == 400 - len(masks) and len(left) == 400 - len(masks) + len(want)


def test_vertices_by_rows(spark):
    rng = Random(8)
    rings = {("one", 0): star(rng, 40, 10, 10, 9), ("one", 1): star(rng, 5, 4, 4, 3), ("two", 0): star(rng, 3, 12, 6, 8)}
    rows = [(region, part, i + 100, x, y) for (region, part), ring in rings.items() for i, (x, y) in enumerate(ring)]
    rng.shuffle(rows)
    edges = spans.edges_of_vertices(spark.createDataFrame(rows, "region string, part int, pos long, x double, y double"))
    found = spans.spans_of_edges(edges, bounds=(2, 3, 15, 18))
    got = {(r.region, r.y, x) for r in found.collect() for x in range(r.x0, r.x1)}
    want = {(region, y, x) for (region, _), ring in rings.items() for y in range(3, 18) for x in range(2, 15) if odd(ring, x, y)}
    assert got == want
    lines = [(r.region, r.y, r.x0, r.x1) for r in found.orderBy("region", "y", "x0").collect()]
    assert all(a[:2] != b[:2] or a[3] < b[2] for a, b in zip(lines, lines[1:]))  # no overlap


def test_wide_joins_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(spans, "MAX_SENT", 0)
    rng = Random(4)
    r = roi.ROI("r", polygons=[star(rng, 30, 100, 20, 90)])
    x = roi.below(pixels(spark, 40, 200), roi.roi_table(spark, [r]))
    assert "BroadcastHashJoin" not in x._jdf.queryExecution().optimizedPlan().toString()
    assert {(p.y, p.x) for p in x.collect()} == {(y, x) for y in range(40) for x in range(200) if odd(r.polygons[0], x, y)}


def coast(n, height, width):
    rng = np.random.default_rng(1)
    xs = np.linspace(0, width, n)
    return [*zip(xs.tolist(), (height * (0.5 + 0.4 * np.sin(xs / 9)) + rng.uniform(-3, 3, n)).tolist()), (float(width), height + 1.0), (0.0, height + 1.0)]


def test_coastline_of_100_000_vertices(spark):
    """By expression and by join, in seconds; both agree with a plain scan of the edges near some pixels."""
    height, width = 100, 100
    line = coast(100_000, height, width)
    r = roi.ROI("coast")
    r.add_polygon(line)
    df = pixels(spark, height, width).repartition(4)
    start = time.monotonic()
    mask = {(p.y, p.x) for p in df.filter(r.mask(F.col("x"), F.col("y"))).select("y", "x").collect()}
    joined = {(p.y, p.x) for p in roi.below(df, roi.roi_table(spark, [r])).select("y", "x").collect()}
    assert time.monotonic() - start < 60
    assert mask == joined and 2000 < len(mask) < 8000
    x0, y0 = np.array(line).T
    x1, y1 = np.roll(x0, -1), np.roll(y0, -1)
    with np.errstate(all="ignore"):
        for y in range(0, height, 7):
            at = (x0 + (y - y0) * ((x1 - x0) / (y1 - y0)))[(y < y0) != (y < y1)]
            assert [(y, x) in mask for x in range(width)] == [bool((x < at).sum() % 2) for x in range(width)]


def test_a_thousand_regions_in_one_pass(spark):
    rng = Random(6)
    rois = [roi.ROI(f"r{i}", polygons=[star(rng, rng.randint(3, 9), rng.uniform(0, 60), rng.uniform(0, 60), 5)]) for i in range(1000)]
    bands = pixels(spark, 60, 60).select("y", "x", F.lit(0).alias("band"), F.get("spectrum", F.lit(0)).alias("value"))
    got = {r.roi: (r.n, r.mean_v) for r in roi.roi_statistics(bands, rois).collect()}
    want = {}
    for r in rois:
        (a, b, c, d) = r.bounds()
        v = [60 * y + x for y in range(max(b, 0), min(d, 60)) for x in range(max(a, 0), min(c, 60)) if odd(r.polygons[0], x, y)]
        if v:
            want[r.name] = (len(v), pytest.approx(np.mean(v)))
    assert got == want


def test_odd_regions(spark):
    df = pixels(spark, 5, 5)
    assert roi.below(df, []).count() == 0 and roi.below(df, roi.roi_table(spark, [])).count() == 0
    assert roi.below(df, roi.roi_table(spark, [roi.ROI("empty"), roi.ROI("box", bbox=(3, 3, 3, 9))])).count() == 0
    with pytest.raises(ValueError):
        roi.ROI("r").add_polygon([(0, 0), (1, float("nan")), (2, 2)])
    two = {0: [roi.ROI("p", bbox=(0, 0, 3, 3)), roi.ROI("q", bbox=(1, 1, 4, 4))], 1: [roi.ROI("s", bbox=(0, 0, 1, 1))]}
    assert roi.training_from_rois(df, two).groupBy("class_id").count().orderBy("class_id").collect() == [(0, 14), (1, 1)]


@pytest.mark.parametrize("shape", [(3000, 5), (5, 3000)])
def test_a_ring_of_many_vertices_costs_no_row_for_each_line(spark, shape):
    """Edges that stay between two columns are runs: a tall image makes no more of them."""
    height, width = shape
    rng = Random(3)
    ring = [(width * i / 400, rng.uniform(0, height)) for i in range(400)] + [(float(width), height + 1.0), (0.0, height + 1.0)]
    x0, y0 = np.array(ring).T
    edge, column, first, after = (np.concatenate(v) for v in zip(*spans.runs_of_edges(x0, y0, np.roll(x0, -1), np.roll(y0, -1))))
    assert len(edge) <= len(ring) + 2 * width and (first < after).all()
    rows = [("r", 0, i, *p) for i, p in enumerate(ring)]
    found = spans.spans_of_edges(spans.edges_of_vertices(spark.createDataFrame(rows, "region string, part int, pos long, x double, y double")))
    got = {(s.y, x) for s in found.collect() for x in range(s.x0, s.x1)}
    for y in rng.sample(range(height), 5):
        for x in range(0, width, max(1, width // 50)):
            assert ((y, x) in got) == odd(ring, x, y)


def test_edges_that_all_but_stand_are_placed_line_by_line():
    """The inverse of an edge that moves by less than rounding over many lines doesn't give the line."""
    x0, y0, x1, y1 = (np.array([v]) for v in (5 - 1e-14, 0.0, 5 + 1e-14, 4000.0))
    at = x0 + np.arange(4000) * ((x1 - x0) / (y1 - y0))
    runs = [np.concatenate(v) for v in zip(*spans.runs_of_edges(x0, y0, x1, y1))]
    got = np.zeros(4000, int)
    for _, c, a, b in zip(*runs):
        got[a:b] = c
    assert (got == np.ceil(at)).all()


@pytest.mark.parametrize("size", [(60, 9), (9, 60)])
def test_statistics_of_a_table_are_looked_up(spark, size, monkeypatch):
    """Unions, boxes, equal names, invalid and missing pixels; no row for a line or a pixel of a region is made."""
    rng, (height, width) = Random(9), size
    shapes = [roi.ROI(f"r{i % 30}", polygons=[[(rng.uniform(-5, width + 5), rng.uniform(-5, height + 5)) for _ in range(rng.randint(3, 8))] for _ in range(rng.randint(1, 3))]) for i in range(60)]
    shapes += [roi.ROI("box", bbox=(2, 3, 7, 8)), roi.ROI("none"), roi.ROI("off", bbox=(90, 90, 99, 99)), roi.ROI("flat", bbox=(5, 5, 5, 9))]
    pixel = {(y, x): float("nan") if rng.random() < 0.1 else rng.gauss(1e6, 1) for y in range(height) for x in range(width) if rng.random() < 0.9}
    bands = spark.createDataFrame([(y, x, b, v * (b + 1)) for (y, x), v in pixel.items() for b in (0, 1)], "y int, x int, band int, value double")
    monkeypatch.setattr(spans, "inside", lambda *a, **k: pytest.fail("pixels were joined"))
    got = {(r.roi, r.band): r for r in roi.roi_statistics(bands, roi.roi_table(spark, shapes)).collect()}
    want = {}
    for r in shapes:
        for (y, x), v in pixel.items():
            if any(odd(p, x, y) for p in r.polygons) or (r.bbox and r.bbox[0] <= x < r.bbox[2] and r.bbox[1] <= y < r.bbox[3]):
                want.setdefault(r.name, {})[y, x] = v
    assert got.keys() == {(n, b) for n in want for b in (0, 1)}
    for n, inside in want.items():
        v = np.array([v for v in inside.values() if v == v])
        for b in (0, 1):
            r = got[n, b]
            assert r.n == len(v)
            have = (r.min_v, r.max_v, r.mean_v, r.std_v)
            assert np.allclose(have, [f(v * (b + 1)) for f in (np.min, np.max, np.mean, np.std)] if len(v) else [np.nan] * 4, rtol=1e-9, equal_nan=True)
