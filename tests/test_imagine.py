"""Imagine files, written here by hand from the format's description."""

import struct

import numpy as np
import pytest

from bandloom.sources import imagine, reader

WORDS = (
    "{1:lversion,1:lfreeList,1:lrootEntryPtr,1:sentryHeaderLength,1:ldictionaryPtr,}Ehfa_File,"
    "{1:lwidth,1:lheight,1:e3:thematic,athematic,fft of real-valued data,layerType,"
    "1:e13:u1,u2,u4,u8,s8,u16,s16,u32,s32,f32,f64,c64,c128,pixelType,1:lblockWidth,1:lblockHeight,}Eimg_Layer,"
    "{1:*bvalueBD,}Eimg_NonInitializedValue,"
    "{1:SfileCode,1:Loffset,1:lsize,1:e2:false,true,logvalid,1:e2:no compression,ESRI GRID compression,compressionType,}Edms_VirtualBlockInfo,"
    "{1:lmin,1:lmax,}Edms_FreeIDList,"
    "{1:lnumvirtualblocks,1:lnumobjectsperblock,1:lnextobjectnum,1:e2:no compression,RLC compression,compressionType,"
    "0:poEdms_VirtualBlockInfo,blockinfo,0:poEdms_FreeIDList,freelist,1:tmodTime,}Edms_State,"
    "{1:dx,1:dy,}Eprj_Coordinate,{1:dwidth,1:dheight,}Eprj_Size,"
    "{0:pcproName,1:*oEprj_Coordinate,upperLeftCenter,1:*oEprj_Coordinate,lowerRightCenter,1:*oEprj_Size,pixelSize,0:pcunits,}Eprj_MapInfo,"
    "{1:x{1:dradius,}Ball,ball,1:e2:EPRJ_INTERNAL,EPRJ_EXTERNAL,proType,1:lproNumber,0:pcproExeName,0:pcproName,1:lproZone,0:pdproParams,}Eprj_ProParameters,"
    "{0:pcdatumname,1:e3:EPRJ_DATUM_PARAMETRIC,EPRJ_DATUM_GRID,EPRJ_DATUM_REGRESSION,type,}Eprj_Datum,."
)
CODES = "u1 u2 u4 u8 s8 u16 s16 u32 s32 f32 f64 c64 c128".split()


class File:
    """Bytes put down one after another; nodes are linked at the end."""

    def __init__(self):
        self.out = bytearray(imagine.MAGIC + struct.pack("<I", 20) + bytes(18))

    def put(self, data: bytes) -> int:
        self.out += data
        return len(self.out) - len(data)

    def pointer(self, n: int, data: bytes) -> bytes:
        return struct.pack("<II", n, 0) + data

    def node(self, name: str, kind: str, data: bytes = b"", children: list[int] = ()) -> int:
        at = self.put(data)
        for a, b in zip(children, children[1:]):
            struct.pack_into("<I", self.out, a, b)
        head = struct.pack("<5Ii64s32sI", 0, 0, 0, children[0] if children else 0, at, len(data), name.encode(), kind.encode(), 0)
        return self.put(head + bytes(4))

    def save(self, path, root: int) -> str:
        words = self.put(WORDS.encode() + b"\0")
        struct.pack_into("<iIIhI", self.out, 20, 1, 0, root, 128, words)
        path.write_bytes(bytes(self.out))
        return str(path)


def low_first(values, bits):
    flat = (np.asarray(values, np.uint8)[:, None] >> np.arange(bits) & 1).astype(np.uint8).reshape(-1)
    return np.packbits(flat, bitorder="little").tobytes()


def raw_block(a: np.ndarray, kind: str) -> bytes:
    bits = imagine.BITS[kind]
    return low_first(a.reshape(-1), bits) if bits < 8 else a.astype("<" + imagine.KINDS[kind]).tobytes()


def run_block(a: np.ndarray, kind: str, runs: bool = True) -> bytes:
    """Run-length coded, with the fewest bits."""
    flat = a.reshape(-1).astype("<" + imagine.KINDS[kind])
    code = flat.view("<u4").astype(np.int64) if kind == "f32" else flat.astype(np.int64)
    least = int(code.min())
    code = code - least
    lengths = b""
    if runs:
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        for n in np.diff(np.append(starts, len(code))).tolist():
            more = next(m for m in range(4) if n < 1 << (8 * m + 6))
            lengths += (n | more << (8 * more + 6)).to_bytes(more + 1, "big")
        code = code[starts]
    bits = next(b for b in (0, 1, 2, 4, 8, 16, 32) if int(code.max()) < 1 << b)
    packed = b"" if bits == 0 else low_first(code, bits) if bits < 8 else code.astype(f">u{bits // 8}").tobytes()
    head = struct.pack("<IiIB", least & 0xFFFFFFFF, len(code) if runs else -1, 13 + len(lengths), bits)
    return head + lengths + packed


def layer(f: File, name: str, a: np.ndarray, kind: str, block: int, coded=None, absent=(), missing=None) -> int:
    h, w = a.shape
    padded = np.zeros((-(-h // block) * block, -(-w // block) * block), a.dtype)
    padded[:h, :w] = a
    infos, k = b"", 0
    for y in range(0, h, block):
        for x in range(0, w, block):
            part = padded[y : y + block, x : x + block]
            data = coded(part, kind) if coded else raw_block(part, kind)
            there = k not in absent
            infos += struct.pack("<hiIHH", 0, f.put(data) if there else 0, len(data), there, coded is not None)
            k += 1
    state = struct.pack("<IIIH", k, block * block, k, coded is not None) + f.pointer(k, infos) + f.pointer(0, b"") + struct.pack("<I", 0)
    children = [f.node("RasterDMS", "Edms_State", state)]
    if missing is not None:
        value = struct.pack("<iihh", 1, 1, imagine.BASE.index("f64"), 0) + struct.pack("<d", missing)
        children.append(f.node("Eimg_NonInitializedValue", "Eimg_NonInitializedValue", f.pointer(1, value)))
    return f, struct.pack("<IIHHII", w, h, 1, CODES.index(kind), block, block), name, children


def finished(part, more=()) -> int:
    f, own, name, children = part
    return f.node(name, "Eimg_Layer", own, [*children, *more])


def place(f: File, number: int, zone: int, datum: str, params=(0.0,) * 15) -> list[int]:
    text = lambda s: f.pointer(len(s) + 1, s.encode() + b"\0")
    pair = lambda x, y: f.pointer(1, struct.pack("<dd", x, y))
    info = text("UTM") + pair(500005.0, 3499995.0) + pair(500225.0, 3499775.0) + pair(10.0, 10.0) + text("meters")
    system = struct.pack("<dHI", 6378137.0, 0, number) + text("") + text("UTM") + struct.pack("<I", zone) + f.pointer(len(params), struct.pack(f"<{len(params)}d", *params))
    below = [f.node("Datum", "Eprj_Datum", text(datum) + struct.pack("<H", 0))]
    return [f.node("Map_Info", "Eprj_MapInfo", info), f.node("Projection", "Eprj_ProParameters", system, below)]


def test_floats_in_blocks_with_a_place(spark, tmp_path):
    f, cube = File(), np.random.default_rng(1).random((3, 150, 70)).astype(np.float32)
    other = finished(layer(f, "pyramid", cube[0][:10, :10], "f32", 64))  # of another size: no band
    nodes = [finished(layer(f, f"Layer_{i + 1}", a, "f32", 64), place(f, imagine.UTM, 50, "WGS 84") if i == 0 else ()) for i, a in enumerate(cube)]
    path = f.save(tmp_path / "scene.img", f.node("root", "root", b"", [*nodes, other]))
    r = reader.open_raster(spark, path)
    assert (r.meta.width, r.meta.height, r.meta.bands, r.meta.dtype, r.meta.crs) == (70, 150, 3, "float32", "EPSG:32650")
    assert r.meta.transform == (10.0, 0.0, 500000.0, 0.0, -10.0, 3500000.0)
    assert [b.name for b in r.meta.band_details] == ["Layer_1", "Layer_2", "Layer_3"]
    assert np.array_equal(r.to_numpy(), cube)
    assert np.array_equal(imagine.read_imagine(spark, path, [2, 0]).to_numpy(), cube[[2, 0]])
    assert r.profile(69, 149) == pytest.approx(cube[:, 149, 69].tolist())
    assert r.df.filter("y = 100").count() == 70
    with pytest.raises(IndexError):
        imagine.ImagineReader({"path": path, "bands": "3"})


@pytest.mark.parametrize("kind", ["u1", "u2", "u4", "u8", "s8", "u16", "s16", "u32", "s32", "f32", "f64"])
@pytest.mark.parametrize("coded", [None, run_block, lambda a, k: run_block(a, k, False)])
def test_kinds_of_pixels(tmp_path, kind, coded):
    rng = np.random.default_rng(2)
    low, high = {"u1": (0, 2), "u2": (0, 4), "u4": (0, 16), "u8": (0, 256), "s8": (-128, 128)}.get(kind, (-5 if kind[0] == "s" else 0, 1000))
    a = np.repeat(rng.integers(low, high, (40, 9)), 5, axis=1).astype(imagine.KINDS[kind])
    if kind[0] == "f":
        a = a / 7
    a[:20] = a[0, 0]  # runs of over 63 and constant blocks
    f = File()
    path = f.save(tmp_path / "a.img", f.node("root", "root", b"", [finished(layer(f, "Layer_1", a, kind, 16, coded))]))
    if kind == "f64" and coded:
        with pytest.raises(ValueError, match="f64"):
            imagine.Imagine(path).rows(0, 40, [0])
        return
    m = imagine.Imagine(path)
    assert np.array_equal(m.rows(0, 40, [0])[:, :, 0], a.astype(np.float32))
    assert np.array_equal(m.rows(13, 34, [0, 0])[:, :, 1], a[13:34].astype(np.float32))


@pytest.mark.parametrize("n", [1, 63, 64, 16383, 16384, 1 << 22])
def test_lengths_of_runs(n):
    a = np.concatenate((np.full(n, 3), [4])).astype("u1")
    assert np.array_equal(imagine.decompressed(run_block(a, "u8"), "u8", n + 1), a)
    with pytest.raises(ValueError, match="values in place of"):
        imagine.decompressed(run_block(a, "u8"), "u8", n + 2)


def test_blocks_never_written_and_systems(tmp_path):
    a = np.arange(64, dtype="u1").reshape(8, 8)
    for missing, filled in ((None, 0), (9.0, 9)):
        f = File()
        path = f.save(tmp_path / "b.img", f.node("root", "root", b"", [finished(layer(f, "x", a, "u8", 4, absent={1}, missing=missing))]))
        m = imagine.metadata(path)
        got = imagine.Imagine(path).rows(0, 8, [0])[:, :, 0]
        assert m.nodata == missing and m.transform is None and m.crs is None
        assert (got[:4, 4:] == filled).all() and np.array_equal(got[4:], a[4:]) and np.array_equal(got[:4, :4], a[:4, :4])
    south = (0.0, 0.0, 0.0, -1.0)
    for (number, zone, datum, params), crs in {
        (0, 0, "WGS 84", ()): "EPSG:4326", (1, 33, "WGS 84", south): "EPSG:32733", (1, 17, "NAD83", ()): "EPSG:26917", (4, 0, "WGS 84", ()): None, (1, 17, "NAD27", ()): None,
    }.items():
        f = File()
        path = f.save(tmp_path / "c.img", f.node("root", "root", b"", [finished(layer(f, "x", a, "u8", 4), place(f, number, zone, datum, params))]))
        assert imagine.metadata(path).crs == crs


def test_files_that_are_refused(spark, tmp_path):
    f = File()
    path = f.save(tmp_path / "none.img", f.node("root", "root"))
    with pytest.raises(ValueError, match="no layers"):
        reader.open_raster(spark, path)
    f = File()
    own = struct.pack("<IIHHII", 4, 4, 1, CODES.index("f32"), 4, 4)
    path = f.save(tmp_path / "beside.img", f.node("root", "root", b"", [f.node("Layer_1", "Eimg_Layer", own)]))
    with pytest.raises(ValueError, match="aren't in this file"):
        reader.open_raster(spark, path)
    f = File()
    part = layer(f, "x", np.zeros((4, 4), np.float32), "f32", 4)
    path = f.save(tmp_path / "complex.img", f.node("root", "root", b"", [f.node("x", "Eimg_Layer", own[:10] + struct.pack("<HII", CODES.index("c64"), 4, 4), part[3])]))
    with pytest.raises(ValueError, match="complex"):
        reader.open_raster(spark, path)
    with pytest.raises(ValueError, match="isn't an Imagine file"):
        (tmp_path / "d.img").write_bytes(b"x" * 64)
        imagine.metadata(str(tmp_path / "d.img"))
