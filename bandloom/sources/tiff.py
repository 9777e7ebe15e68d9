"""GeoTIFF, in pure Python: strips and tiles; no compression, LZW or deflate; predictors 1 and 2; chunky or planar.

A partition is a strip of rows, for which only the blocks that it needs are decoded.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

from bandloom.plans.raster import PIXEL, BandInfo, Raster, RasterMetadata

from .envi import StripReader, scan

# Sizes of the format's field types, and its tags.
SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, MATRIX, KEYS, GDAL_META, GDAL_NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42112, 42113
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (1, 64): "u8", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (2, 64): "i8", (3, 32): "f4", (3, 64): "f8"}


def lzw(data: bytes) -> bytes:
    """The format's LZW: codes of 9 to 12 bits, most significant first, each width used up to one code early."""
    table: list[bytes] = []
    out, width, acc, held, previous = bytearray(), 9, 0, 0, b""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table = list(first)
    for byte in data:
        acc, held = (acc << 8) | byte, held + 8
        if held < width:
            continue
        code = (acc >> (held - width)) & ((1 << width) - 1)
        held -= width
        acc &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, previous = list(first), 9, b""
            continue
        entry = table[code] if code < len(table) else previous + previous[:1]
        out += entry
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw_packed(data: bytes) -> bytes:
    """Data in the format's LZW."""
    bits: list[tuple[int, int]] = []
    table = {bytes([i]): i for i in range(256)}
    nxt, width, w = 258, 9, b""
    bits.append((256, 9))
    for i in data:
        c = w + bytes([i])
        if c in table:
            w = c
            continue
        bits.append((table[w], width))
        table[c] = nxt
        nxt += 1
        if nxt > (1 << width) - 1:
            width += 1
        if nxt >= 4094:
            bits.append((256, width if width <= 12 else 12))
            table, nxt, width = {bytes([k]): k for k in range(256)}, 258, 9
        w = bytes([i])
    if w:
        bits.append((table[w], width))
        nxt += 1
        if nxt > (1 << width) - 1 and width < 12:
            width += 1
    bits.append((257, width))
    out, acc, held = bytearray(), 0, 0
    for code, n in bits:
        acc, held = (acc << n) | code, held + n
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1
    if held:
        out.append(acc << (8 - held) & 255)
    return bytes(out)


@dataclass
class Tiff:
    """The first image of a file."""

    path: str
    order: str
    tags: dict

    @staticmethod
    def of(path: str) -> Tiff:
        with open(path, "rb") as f:
            head = f.read(16)
            order = {b"II": "<", b"MM": ">"}.get(head[:2])
            if order is None:
                raise ValueError(f"{path} isn't a TIFF file")
            version = struct.unpack(order + "H", head[2:4])[0]
            big = version == 43
            if version not in (42, 43):
                raise ValueError(f"{path} isn't a TIFF file")
            f.seek(struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0])
            count = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
            size, room = (20, 8) if big else (12, 4)
            entries = f.read(count * size)
            tags = {}
            for i in range(count):
                tag, kind = struct.unpack_from(order + "HH", entries, i * size)
                n = struct.unpack_from(order + ("Q" if big else "I"), entries, i * size + 4)[0]
                if kind not in SIZES and kind not in (7, 13):
                    continue
                code = {7: "s", 13: "I"}.get(kind) or SIZES[kind]
                width = struct.calcsize("=" + code) * n
                raw = entries[i * size + size - room : i * size + size]
                if width > room:
                    f.seek(struct.unpack(order + ("Q" if big else "I"), raw)[0])
                    raw = f.read(width)
                tags[tag] = raw[:n].rstrip(b"\0").decode("utf-8", "replace") if code == "s" else struct.unpack(order + code * n if len(code) == 1 else order + code * n, raw[:width])
            return Tiff(path, order, tags)

    def one(self, tag: int, default: int | None = None) -> int:
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.one(HEIGHT), self.one(WIDTH), self.one(SAMPLES, 1)

    @property
    def dtype(self) -> np.dtype:
        kind = KINDS.get((self.one(FORMAT, 1), self.one(BITS, 8)))
        if kind is None:
            raise ValueError(f"{self.path}: sample format isn't supported")
        return np.dtype(self.order + kind)

    def block(self, f, index: int, rows: int, columns: int, samples: int) -> np.ndarray:
        offsets, sizes = (self.tags[TILES], self.tags[TILE_BYTES]) if TILES in self.tags else (self.tags[STRIPS], self.tags[STRIP_BYTES])
        f.seek(offsets[index])
        raw = f.read(sizes[index])
        how = self.one(COMPRESSION, 1)
        if how == 5:
            raw = lzw(raw)
        elif how in (8, 32946):
            raw = zlib.decompress(raw)
        elif how != 1:
            raise ValueError(f"{self.path}: compression {how} isn't supported")
        a = np.frombuffer(raw[: rows * columns * samples * self.dtype.itemsize], self.dtype).reshape(-1, columns, samples)
        predictor = self.one(PREDICTOR, 1)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=self.dtype.newbyteorder("="))
        elif predictor != 1:
            raise ValueError(f"{self.path}: predictor {predictor} isn't supported")
        return a

    def rows(self, y0: int, y1: int, chosen: list[int]) -> np.ndarray:
        """(rows, width, bands) as float32."""
        h, w, samples = self.shape
        planar = self.one(PLANAR, 1) == 2
        tiled = TILES in self.tags
        bw, bh = (self.one(TILE_W), self.one(TILE_H)) if tiled else (w, min(self.one(ROWS, h), h))
        across, down = -(-w // bw), -(-h // bh)
        out = np.empty((y1 - y0, w, len(chosen)), np.float32)
        with open(self.path, "rb") as f:
            for j in range(y0 // bh, -(-y1 // bh)):
                top = j * bh
                rows = bh if tiled else min(bh, h - top)
                for i in range(across):
                    left, cols = i * bw, min(bw, w - i * bw)
                    a, b = max(y0, top), min(y1, top + rows, h)
                    for k in range(len(chosen)) if planar else (None,):
                        plane = 0 if k is None else chosen[k]
                        block = self.block(f, plane * across * down + j * across + i, rows, bw, 1 if planar else samples)
                        part = block[a - top : b - top, :cols]
                        if k is None:
                            out[a - y0 : b - y0, left : left + cols] = part[:, :, chosen]
                        else:
                            out[a - y0 : b - y0, left : left + cols, k] = part[:, :, 0]
        return out


def metadata(path: str) -> RasterMetadata:
    t = Tiff.of(path)
    h, w, samples = t.shape
    transform = None
    if SCALE in t.tags and TIEPOINT in t.tags:
        (sx, sy, *_), (px, py, _, gx, gy, *_) = t.tags[SCALE], t.tags[TIEPOINT]
        transform = (sx, 0.0, gx - px * sx, 0.0, -sy, gy + py * sy)
    elif MATRIX in t.tags:
        m = t.tags[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    keys = t.tags.get(KEYS, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    code = found.get(3072) or found.get(2048)
    crs = f"EPSG:{code}" if code and code != 32767 else None
    nodata = None
    try:
        nodata = float(t.tags[GDAL_NODATA]) if GDAL_NODATA in t.tags else None
    except ValueError:
        pass
    items = re.findall(r'<Item name="([^"]+)" sample="(\d+)"[^>]*>([^<]*)</Item>', t.tags.get(GDAL_META, ""))
    text = {(n.lower(), int(s)): v for n, s, v in items}
    details = []
    for i in range(samples):
        try:
            wl = float(text[("wavelength", i)])
        except (KeyError, ValueError):
            wl = None
        details.append(BandInfo(i, text.get(("description", i)) or f"Band {i + 1}", wl))
    return RasterMetadata(w, h, samples, t.dtype.newbyteorder("=").name, crs, transform, "bsq", nodata, tuple(details), {})


class TiffReader(StripReader):
    def __init__(self, options: dict):
        super().__init__()
        self.tiffs = [Tiff.of(p) for p in options["path"].split(os.pathsep)]  # files of one grid follow each other as bands
        self.height = self.tiffs[0].shape[0]
        chosen = options.get("bands")
        self.chosen = [int(b) for b in chosen.split(",")] if chosen else None

    def pixels(self, y0: int, y1: int) -> np.ndarray:
        parts = [t.rows(y0, y1, self.chosen if self.chosen is not None and len(self.tiffs) == 1 else list(range(t.shape[2]))) for t in self.tiffs]
        return parts[0] if len(parts) == 1 else np.concatenate(parts, axis=2)


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXEL

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def read_tiff(spark: SparkSession, path: str, bands: list[int] | None = None) -> Raster:
    meta = metadata(path)
    options = {"path": path} | ({"bands": ",".join(map(str, bands))} if bands is not None else {})
    if bands is not None:
        meta = replace(meta, bands=len(bands), band_details=tuple(replace(meta.band_details[b], index=i) for i, b in enumerate(bands)))
    return Raster(meta, scan(spark, TiffSource, **options), os.path.basename(path))


def packed(data: bytes, compress: str) -> bytes:
    return {"none": lambda x: x, "deflate": zlib.compress, "lzw": lzw_packed}[compress](data)


def write_tiff(path: str, cube: np.ndarray, meta: RasterMetadata, compress: str = "lzw", rows_per_strip: int = 64) -> None:
    """A chunky GeoTIFF of cube (height, width, bands), in strips, from memory."""
    how = compression(compress)
    data = np.ascontiguousarray(cube, cube.dtype.newbyteorder("<"))
    strips = [packed(data[y : y + rows_per_strip].tobytes(), how) for y in range(0, len(data), rows_per_strip)]
    layout = Layout.of(cube.shape, cube.dtype, list(map(len, strips)), 0, meta, how, rows=rows_per_strip)
    with open(path, "wb") as out:
        out.truncate(layout.size)
        for at, raw in [*layout.known, *zip(layout.offsets, strips)]:
            out.seek(at)
            out.write(raw)


def compression(name: str | None) -> str:
    name = (name or "none").lower()
    if name not in ("none", "deflate", "lzw"):
        raise ValueError(f"unknown compression {name!r}")
    return name


@dataclass
class Layout:
    """Where the parts of a file stand: its blocks, one block for those that are empty, and what else it holds."""

    offsets: list[int]
    empty: int
    size: int
    known: list[tuple[int, bytes]]

    @staticmethod
    def of(shape: tuple[int, int, int], dtype: np.dtype, sizes: list[int | None], empty: int, meta: RasterMetadata, compress: str, tile: int = 0, first: int = 0, rows: int = 0) -> Layout:
        """Of a chunky file with packed blocks of the given sizes (None: empty), tiles or else strips of some rows. Offsets have
        64 bits where 32 don't reach."""
        return Layout._with(shape, dtype, sizes, empty, meta, compress, tile, first, rows, False) or Layout._with(shape, dtype, sizes, empty, meta, compress, tile, first, rows, True)

    @staticmethod
    def _with(shape, dtype, sizes, empty, meta, compress, tile, first, rows, big: bool) -> Layout | None:
        at = max(first, 16 if big else 8)
        offsets: list[int] = []
        for n in sizes:
            offsets.append(at)
            at += (n or 0) + ((n or 0) & 1)
        hole, at = at, at + empty + (empty & 1)
        offsets = [hole if n is None else o for n, o in zip(sizes, offsets)]
        entries = described(shape, np.dtype(dtype), meta, compress)
        word = "Q" if big else "I"
        counts = tuple(empty if n is None else n for n in sizes)
        if tile:
            entries += [(TILE_W, "I", (tile,)), (TILE_H, "I", (tile,)), (TILES, word, tuple(offsets)), (TILE_BYTES, word, counts)]
        else:
            entries += [(ROWS, "I", (rows,)), (STRIPS, word, tuple(offsets)), (STRIP_BYTES, word, counts)]
        head, room = ("<Q", 8) if big else ("<H", 4)
        base = at + struct.calcsize(head) + len(entries) * (20 if big else 12) + room
        directory, extra = [struct.pack(head, len(entries))], []
        codes = {v: k for k, v in SIZES.items() if len(v) == 1}
        end = base
        for tag, code, values in sorted(entries):
            raw = values[0] if code == "s" else np.array(values, "<" + {"H": "u2", "I": "u4", "Q": "u8", "d": "f8"}[code]).tobytes() if end < 1 << 32 or big else b""
            n = len(raw) if code == "s" else len(values)
            place = raw.ljust(room, b"\0")
            if len(raw) > room:
                place = struct.pack("<Q" if big else "<I", end if big else min(end, (1 << 32) - 1))
                extra.append(raw + b"\0" * (len(raw) & 1))
                end += len(extra[-1])
            directory.append(struct.pack("<HHQ" if big else "<HHI", tag, codes[code], n) + place)
        if not big and end >= 1 << 32:
            return None
        start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
        return Layout(offsets, hole, end, [(0, start), (at, b"".join([*directory, b"\0" * room, *extra]))])


def described(shape: tuple[int, int, int], dtype: np.dtype, meta: RasterMetadata, compress: str) -> list[tuple[int, str, tuple]]:
    """The directory's entries that don't depend on the layout: (tag, type code, values)."""
    h, w, b = shape
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    entries: list[tuple[int, str, tuple]] = [
        (WIDTH, "I", (w,)), (HEIGHT, "I", (h,)), (BITS, "H", (8 * dtype.itemsize,) * b), (COMPRESSION, "H", ({"none": 1, "lzw": 5, "deflate": 8}[compress],)),
        (PHOTOMETRIC, "H", (1,)), (SAMPLES, "H", (b,)), (PLANAR, "H", (1,)), (FORMAT, "H", (kind,) * b),
    ]
    if meta.transform:
        a, rb, c, rd, e, f = meta.transform[:6]
        if rb or rd:
            entries.append((MATRIX, "d", (a, rb, 0.0, c, rd, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
        else:
            entries += [(SCALE, "d", (a, -e, 0.0)), (TIEPOINT, "d", (0.0, 0.0, 0.0, c, f, 0.0))]
    if meta.crs and re.fullmatch(r"(?i)epsg:\d+", meta.crs):
        code = int(meta.crs[5:])
        geographic = code == 4326
        entries.append((KEYS, "H", (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code)))
    names = "".join(
        f'<Item name="DESCRIPTION" sample="{i}" role="description">{d.name}</Item>' + (f'<Item name="WAVELENGTH" sample="{i}">{d.wavelength}</Item>' if d.wavelength is not None else "")
        for i, d in enumerate(meta.band_details[:b])
    )
    if names:
        entries.append((GDAL_META, "s", (f"<GDALMetadata>{names}</GDALMetadata>".encode() + b"\0",)))
    if meta.nodata is not None:
        entries.append((GDAL_NODATA, "s", (f"{meta.nodata:g}".encode() + b"\0",)))
    return entries
