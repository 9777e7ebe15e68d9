"""Files written and read again."""

import os

import numpy as np
import pytest

from bandloom.plans.raster import BandInfo, Raster, RasterMetadata
from bandloom.sources import envi, landsat, reader, sink, synthetic, tiff, writer
from bandloom.streaming import running

UTM = RasterMetadata(1, 1, 1, crs="EPSG:32650", transform=(10.0, 0.0, 500000.0, 0.0, -10.0, 3500000.0))


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_envi_round_trip(spark, tmp_path, interleave):
    cube, wl, _ = synthetic.cube(20, 16, 5)
    meta = RasterMetadata(1, 1, 1, crs=UTM.crs, transform=UTM.transform, band_details=tuple(BandInfo(i, f"b{i}", float(w)) for i, w in enumerate(wl)), default_bands=(2, 1, 0))
    r = Raster.from_numpy(spark, cube, meta)
    path = writer.export(r, str(tmp_path / "scene.hdr"), interleave=interleave)
    back = reader.open_raster(spark, str(tmp_path / "scene.hdr"))
    assert path.endswith("scene.dat") and np.allclose(back.to_numpy(), cube.astype(np.float32))
    assert (back.meta.interleave, back.meta.crs, back.meta.default_bands) == (interleave, "EPSG:32650", (2, 1, 0))
    assert back.meta.transform == UTM.transform and back.meta.band_details[1].wavelength == pytest.approx(wl[1])
    assert back.profile(3, 4) == pytest.approx(cube[:, 4, 3].tolist()) and back.profile(99, 0) is None
    part = envi.read_envi(spark, path, [3, 0])
    assert np.allclose(part.to_numpy(), cube[[3, 0]].astype(np.float32)) and part.meta.bands == 2
    with pytest.raises(IndexError):
        back.band(9)


def test_envi_strips_are_pruned():
    r = envi.StripReader()
    r.height, r.strip = 1000, 100
    list(r.pushFilters([envi.EqualTo(("y",), 250)]))
    assert [(p.y0, p.y1) for p in r.partitions()] == [(250, 251)]


def test_envi_header_details(spark, tmp_path):
    a = np.arange(60, dtype=">u2").reshape(2, 6, 5)
    (tmp_path / "a.dat").write_bytes(b"12345678" + a.tobytes())
    text = "ENVI\nsamples = 5\nlines = 6\nbands = 2\ndata type = 12\nheader offset = 8\nbyte order = 1\nmap info = {UTM, 3, 2, 500030, 4000000, 30, 30, 50, North, WGS-84}\nwavelength units = Micrometers\nwavelength = {0.5,\n 0.6}\n"
    (tmp_path / "a.hdr").write_text(text + "data ignore value = -9999\n")
    r = reader.open_raster(spark, str(tmp_path / "a.dat"))
    assert np.array_equal(r.to_numpy(), a.astype(float)) and r.meta.dtype == "uint16" and r.meta.nodata == -9999
    assert r.meta.transform == (30.0, 0.0, 499970.0, 0.0, -30.0, 4000030.0) and r.meta.band_details[0].wavelength == pytest.approx(500)
    (tmp_path / "a.hdr").write_text(text + "data ignore value = 0\n")
    assert envi.metadata(str(tmp_path / "a.hdr")).nodata is None
    (tmp_path / "a.hdr").write_text(text.replace("= 12", "= 6"))
    with pytest.raises(ValueError, match="complex"):
        envi.Layout.of(str(tmp_path / "a.hdr"))


def test_integer_export(spark, tmp_path):
    r = Raster.from_numpy(spark, [[np.nan, 50.7], [100, 250]], RasterMetadata(1, 1, 1, band_details=(BandInfo(0, "g", 560.5),)))
    path = writer.export(r, str(tmp_path / "u.dat"), dtype="uint8", nodata=0)
    text = (tmp_path / "u.hdr").read_text()
    assert np.fromfile(path, np.uint8).tolist() == [0, 50, 100, 250] and "560.5" in text and "Nanometers" in text
    assert writer.converted(np.array([np.inf, -5, 300, 2.9]), "uint8", None).tolist() == [0, 0, 255, 2]
    with pytest.raises(ValueError):
        writer.export(r, path, bands=[])


@pytest.mark.parametrize("compress", ["none", "lzw", "deflate"])
@pytest.mark.parametrize("dtype", ["float32", "int16"])
def test_tiff_round_trip(spark, tmp_path, compress, dtype):
    rng = np.random.default_rng(0)
    cube = rng.integers(0, 300, (3, 70, 40))
    meta = RasterMetadata(1, 1, 1, crs=UTM.crs, transform=UTM.transform, band_details=tuple(BandInfo(i, f"b{i}", 500.0 + i) for i in range(3)))
    path = writer.export(Raster.from_numpy(spark, cube, meta), str(tmp_path / "a.tif"), "GTiff", dtype=dtype, nodata=-1, compress=compress)
    back = reader.open_raster(spark, path)
    assert np.array_equal(back.to_numpy(), cube) and back.meta.crs == "EPSG:32650" and back.meta.transform == UTM.transform
    assert back.meta.nodata == -1 and back.meta.band_details[2].wavelength == 502 and back.meta.band_details[1].name == "b1" and back.meta.dtype == dtype
    assert np.array_equal(tiff.read_tiff(spark, path, [2]).to_numpy()[0], cube[2])


def test_lzw_long():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", bytes(rng.integers(0, 256, 20000, dtype=np.uint8)), b"ab" * 30000, bytes(range(256)) * 90):
        assert tiff.lzw(tiff.lzw_packed(data)) == data


def test_landsat(spark, tmp_path):
    names = {4: "s_B4.TIF", 5: "s_B5.TIF"}
    mtl = 'GROUP = L1_METADATA_FILE\n  GROUP = PRODUCT_METADATA\n    SPACECRAFT_ID = "LANDSAT_8"\n    DATE_ACQUIRED = 2020-01-02\n'
    mtl += "".join(f'    FILE_NAME_BAND_{k} = "{v.lower()}"\n' for k, v in names.items()) + '    FILE_NAME_BAND_6 = "gone.TIF"\n  END_GROUP = PRODUCT_METADATA\n'
    mtl += "  GROUP = IMAGE_ATTRIBUTES\n    SUN_ELEVATION = not-a-number\n  END_GROUP = IMAGE_ATTRIBUTES\nEND_GROUP = L1_METADATA_FILE\nEND\n"
    (tmp_path / "s_MTL.txt").write_text(mtl)
    for k, v in names.items():
        tiff.write_tiff(str(tmp_path / v), np.full((300, 6, 1), 100 * k, np.uint16), UTM)
    r = reader.open_raster(spark, str(tmp_path))
    assert (r.meta.bands, r.meta.nodata, r.meta.raw_header["sun_elevation"]) == (2, 0.0, 0.0)
    assert [b.mtl_band for b in r.meta.band_details] == [4, 5] and (r.to_numpy()[1] == 500).all()
    assert landsat.parse_mtl(str(tmp_path / "s_MTL.txt"))["L1_METADATA_FILE"]["PRODUCT_METADATA"]["DATE_ACQUIRED"] == "2020-01-02"


def test_dispatch(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        reader.open_raster(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        reader.open_raster(spark, str(tmp_path))
    (tmp_path / "x.bin").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        reader.open_raster(spark, str(tmp_path / "x.bin"))


def test_scene_at_scale(spark):
    r, truth = synthetic.scene(spark, 12, 10, 8)
    rows = r.df.collect()
    assert len(rows) == 120 and all(0 <= v <= 1 for x in rows for v in x.spectrum) and truth.select("cls").distinct().count() == 4
    assert r.df.collect() == rows


def test_png(tmp_path):
    writer.write_png(str(tmp_path / "a.png"), np.zeros((2, 3, 3)))
    assert (tmp_path / "a.png").read_bytes()[:4] == b"\x89PNG"


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double").write.parquet(str(tmp_path / "s.parquet"))
    got = {r.k: (r.n, r.mean_v) for r in running.statistics_of_stream(spark, str(tmp_path / "s.parquet"), "k", "v").collect()}
    assert got == {"a": (2, 2.0), "b": (1, 5.0)}


def raster_of(spark, cube, **meta):
    return Raster.from_numpy(spark, cube, RasterMetadata(1, 1, 1, **({"crs": UTM.crs, "transform": UTM.transform} | meta)))


@pytest.mark.parametrize("size", [(40, 70), (33, 32), (1, 1), (16, 100)])
def test_tiles(spark, tmp_path, size):
    """Tiles at the edges are padded; the file has as many as the grid asks for."""
    cube = np.random.default_rng(1).integers(0, 99, (2, *size))
    path = writer.export(raster_of(spark, cube), str(tmp_path / "a.tif"), "GTiff", dtype="int16", compress="deflate", tile=16)
    t = tiff.Tiff.of(path)
    assert len(t.tags[tiff.TILES]) == -(-size[0] // 16) * -(-size[1] // 16) and t.one(tiff.TILE_W) == 16
    assert np.array_equal(reader.open_raster(spark, path).to_numpy(), cube) and os.listdir(tmp_path) == ["a.tif"]
    with pytest.raises(ValueError, match="16"):
        writer.export(raster_of(spark, cube), path, "GTiff", tile=10)


def test_tiles_without_pixels_share_one(spark, tmp_path):
    """A large grid with a few pixels is a small file, and reads back with nodata elsewhere."""
    df = spark.createDataFrame([(5, 7, [1.0]), (900, 40, [2.0]), (-1, 0, [9.0]), (0, 5000, [9.0])], "y int, x int, spectrum array<float>")
    r = Raster(RasterMetadata(2000, 1000, 1, crs=UTM.crs, transform=UTM.transform), df, "few")
    path = writer.export(r, str(tmp_path / "few.tif"), "GTiff", nodata=-5, compress="none", tile=64)
    assert os.path.getsize(path) < 64 * 64 * 4 * 3 + 16 * 16 * 32 * 4
    back = {(p.y, p.x): p.spectrum[0] for p in reader.open_raster(spark, path).df.filter("spectrum[0] > -5").collect()}
    assert back == {(5, 7): 1, (900, 40): 2} and reader.open_raster(spark, path).df.count() == 2_000_000


def test_offsets_of_64_bits(spark, tmp_path):
    """Tiles beyond 5 GB, in a sparse file."""
    cube = np.random.default_rng(2).normal(size=(3, 50, 40)).astype(np.float32)
    path = str(tmp_path / "big.tif")
    writer.export_tiff(raster_of(spark, cube), path, "float32", -1.0, -1.0, "lzw", 16, first=5 << 30)
    assert os.path.getsize(path) > 5 << 30 and os.stat(path).st_blocks * 512 < 10_000_000
    assert min(tiff.Tiff.of(path).tags[tiff.TILES]) >= 5 << 30
    back = reader.open_raster(spark, path)
    assert np.array_equal(back.to_numpy(), cube) and back.meta.nodata == -1 and back.meta.transform == UTM.transform


def test_layout_grows_to_64_bits_where_it_must():
    meta = RasterMetadata(1, 1, 1)
    small = tiff.Layout.of((256, 256, 1), np.dtype("u1"), [65536], 0, meta, "none", 256)
    assert small.known[0][1][2] == 42
    large = tiff.Layout.of((70_000, 70_000, 1), np.dtype("u1"), [65536] * 274**2, 0, meta, "none", 256)
    assert large.known[0][1][2] == 43 and large.offsets[-1] == 16 + 65536 * (274**2 - 1) > 1 << 32


@pytest.mark.parametrize("format", ["ENVI", "GTiff"])
def test_a_failed_task_leaves_no_file(spark, tmp_path, format):
    """What stood at the target stays as it was."""
    path = tmp_path / "a.dat"
    path.write_bytes(b"before")

    def bad(batches):
        for b in batches:
            if 7 in b.column("y").to_pylist():
                raise RuntimeError("lost")
            yield b

    r = raster_of(spark, np.ones((1, 20, 20)))
    broken = replace_df(r, r.df.repartition(4).mapInArrow(bad, r.df.schema))
    with pytest.raises(Exception, match="lost"):
        writer.export(broken, str(path), format)
    assert path.read_bytes() == b"before" and os.listdir(tmp_path) == ["a.dat"]


def replace_df(r, df):
    return Raster(r.meta, df, r.name)


def test_pieces(spark, tmp_path):
    """Pieces that come twice are harmless if counted; a wrong count aborts; known bytes and holes stay."""
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(2, bytearray(b"cd")), (6, bytearray(b"g"))], "at long, data binary").repartition(2)
    sink.write_pieces(rows, path, 8, [(0, b"ab")])
    assert open(path, "rb").read() == b"abcd\0\0g\0"
    with pytest.raises(Exception, match="pieces"):
        sink.write_pieces(rows, path, 3, [(0, b"x")], count=5)
    sink.write_pieces(rows.union(rows), path, 8, [(0, b"AB")], count=4)
    assert open(path, "rb").read() == b"ABcd\0\0g\0" and os.listdir(tmp_path) == ["p"]
    task, out = sink.PieceWriter({"temporary": path, "target": path, "pieces": "1"}), [bytes(9), b"z"]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 3], pa.int64()), pa.array(out, pa.binary())], names=["at", "data"])
    assert task.write(iter([batch])) == task.write(iter([batch])) == sink.Written(2, 10)


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_envi_strips_without_pixels(spark, tmp_path, monkeypatch, interleave):
    monkeypatch.setattr(writer, "BLOCK", 100)
    df = spark.createDataFrame([(0, 1, [1.0, 2.0]), (28, 3, [3.0, 4.0])], "y int, x int, spectrum array<float>")
    path = writer.export(Raster(RasterMetadata(10, 30, 2), df, "few"), str(tmp_path / "few.dat"), interleave=interleave, nodata=-1, dtype="int16")
    want = np.full((2, 30, 10), -1)
    want[:, 0, 1], want[:, 28, 3] = (1, 2), (3, 4)
    assert np.array_equal(reader.open_raster(spark, path).to_numpy(), want)
