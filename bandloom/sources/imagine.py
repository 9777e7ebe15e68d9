"""ERDAS Imagine files, in pure Python: a tree of nodes whose records are laid out as the file's own dictionary says.

A raster is the layers of the tree that have the first one's size. Their blocks are raw or run-length coded. A partition is a
strip of rows; a task reads the places of the blocks that it needs, and these, so that neither the driver nor a task holds the
table of all blocks. Blocks that were never written are the layer's missing value, or 0. Geographic and UTM systems of WGS 84
and UTM of NAD 83 are named; of others only the transform is read. Complex pixels, pixels in a file beside this one, and
run-length coded f64 are a ValueError.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

from bandloom.plans.raster import PIXEL, BandInfo, Raster, RasterMetadata

from .envi import StripReader, scan

MAGIC = b"EHFA_HEADER_TAG\0"
# The dictionary's letters of numbers, kinds of base data in their order, kinds of pixels, systems by number.
NUMBERS = {"s": "H", "S": "h", "t": "I", "l": "I", "L": "i", "f": "f", "d": "d"}
BASE = ("u1", "u2", "u4", "u8", "s8", "u16", "s16", "u32", "s32", "f32", "f64")
KINDS = {"u1": "u1", "u2": "u1", "u4": "u1", "u8": "u1", "s8": "i1", "u16": "u2", "s16": "i2", "u32": "u4", "s32": "i4", "f32": "f4", "f64": "f8"}
BITS = {"u1": 1, "u2": 2, "u4": 4, "u8": 8, "s8": 8, "u16": 16, "s16": 16, "u32": 32, "s32": 32, "f32": 32, "f64": 64}
GEOGRAPHIC, UTM = 0, 1


@dataclass(frozen=True)
class Item:
    """An item of a record: count values of a kind, or, behind a pointer, as many as the file says."""

    name: str
    count: int
    pointer: bool
    kind: str
    names: tuple[str, ...] = ()
    record: str = ""


class Dictionary:
    """Layouts of records, read from their text."""

    def __init__(self, text: str):
        self.text, self.at, self.records = text, 0, {}
        while self.text[self.at : self.at + 1] == "{":
            self._record()

    def _until(self, mark: str) -> str:
        end = self.text.index(mark, self.at)
        found, self.at = self.text[self.at : end], end + 1
        return found

    def _record(self) -> str:
        self.at += 1
        items = []
        while self.text[self.at] != "}":
            count = int(self._until(":"))
            pointer = self.text[self.at] in "*p"
            self.at += pointer
            kind, names, record = self.text[self.at], (), ""
            self.at += 1
            if kind == "e":
                names = tuple(self._until(",") for _ in range(int(self._until(":"))))
            elif kind == "o":
                record = self._until(",")
            elif kind == "x":
                record = self._record()
            items.append(Item(self._until(","), count, pointer, "o" if kind == "x" else kind, names, record))
        self.at += 1
        name = self._until(",")
        self.records[name] = items
        return name

    def read(self, record: str, data: bytes, at: int = 0, to: str | None = None) -> tuple[dict, int]:
        """The record at a place of data, and where it ends. With to it ends at the values of that item, whose number is
        given as the item."""
        found = {}
        for item in self.records[record]:
            n = item.count
            if item.pointer:
                n = struct.unpack_from("<I", data, at)[0]
                at += 8
            if item.name == to:
                found[to] = n
                break
            found[item.name], at = self._values(item, n, data, at)
        return found, at

    def _values(self, item: Item, n: int, data: bytes, at: int) -> tuple[object, int]:
        if item.kind in "cC":
            return data[at : at + n].split(b"\0")[0].decode("latin-1"), at + n
        if item.kind == "b":
            return self._base(data, at) if n else (None, at)
        if item.kind == "o":
            values = []
            for _ in range(n):
                value, at = self.read(item.record, data, at)
                values.append(value)
        elif item.kind == "e":
            codes = struct.unpack_from(f"<{n}H", data, at)
            values, at = [item.names[c] if c < len(item.names) else "" for c in codes], at + 2 * n
        elif item.kind in NUMBERS:
            code = f"<{n}{NUMBERS[item.kind]}"
            values, at = list(struct.unpack_from(code, data, at)), at + struct.calcsize(code)
        else:
            raise ValueError(f"items of kind {item.kind} aren't supported")
        # items that may have any number of values are lists, whatever their number
        return (values[0] if n == 1 and item.count == 1 else values), at

    @staticmethod
    def _base(data: bytes, at: int) -> tuple[object, int]:
        rows, columns, kind = struct.unpack_from("<iih", data, at)
        if not 0 <= kind < len(BASE):
            raise ValueError("complex base data aren't supported")
        n, name = rows * columns, BASE[kind]
        size = -(-n * BITS[name] // 8)
        return unpacked(data[at + 12 : at + 12 + size], name, n).tolist(), at + 12 + size


def bits_of(raw: bytes, bits: int, n: int) -> np.ndarray:
    """n numbers of 1, 2 or 4 bits, the first in the lowest bits."""
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat << np.arange(bits, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)


def unpacked(raw: bytes, kind: str, n: int) -> np.ndarray:
    """n values of a kind of pixels."""
    if BITS[kind] < 8:
        return bits_of(raw, BITS[kind], n)
    return np.frombuffer(raw, "<" + KINDS[kind], n)


def decompressed(raw: bytes, kind: str, n: int) -> np.ndarray:
    """n values of a run-length coded block: a least value, the number of runs (-1: none, each value by itself), the place of
    the values, their bits; then the lengths of runs, in one to four bytes by the upper two bits of the first."""
    if kind == "f64":
        raise ValueError("run-length coded f64 isn't supported")
    least, runs, start, bits = struct.unpack_from("<IiIB", raw)
    count, start = (n, 13) if runs == -1 else (runs, start)
    if bits == 0:
        values = np.zeros(count, np.uint32)
    elif bits < 8:
        values = bits_of(raw[start:], bits, count).astype(np.uint32)
    elif bits in (8, 16, 32):
        values = np.frombuffer(raw, f">u{bits // 8}", count, start).astype(np.uint32)
    else:
        raise ValueError(f"run-length codes of {bits} bits aren't supported")
    values = values + np.uint32(least)
    if runs != -1:
        at, lengths = 13, []
        for _ in range(runs):
            more = raw[at] >> 6
            lengths.append(int.from_bytes(raw[at : at + 1 + more], "big") & (1 << (8 * more + 6)) - 1)
            at += 1 + more
        values = np.repeat(values, lengths)
    if len(values) != n:
        raise ValueError(f"a block has {len(values)} values in place of {n}")
    return values.view("<f4") if kind == "f32" else values.astype("<" + KINDS[kind])


@dataclass(frozen=True)
class Node:
    name: str
    kind: str
    next: int
    child: int
    data: int
    size: int


@dataclass(frozen=True)
class Layer:
    """A band: its size, the kind of its pixels and blocks, and where the table of its blocks begins."""

    name: str
    width: int
    height: int
    kind: str
    block_width: int
    block_height: int
    blocks: int
    table: int
    nodata: float | None


class Imagine:
    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            if f.read(16) != MAGIC:
                raise ValueError(f"{path} isn't an Imagine file")
            f.seek(struct.unpack("<I", f.read(4))[0])
            _, _, root, _, words = struct.unpack("<iIIhI", f.read(18))
            f.seek(words)
            text = bytearray()
            while b"\0" not in text:
                part = f.read(4096)
                if not part:
                    break
                text += part
            self.dictionary = Dictionary(text.split(b"\0")[0].decode("latin-1"))
            self.root = self._node(f, root)
            self.layers = [self._layer(f, n) for n in self._children(f, self.root) if n.kind == "Eimg_Layer"]
            self.layers = [x for x in self.layers if (x.width, x.height) == (self.layers[0].width, self.layers[0].height)]
            if not self.layers:
                raise ValueError(f"{path} has no layers")
            first = next(n for n in self._children(f, self.root) if n.kind == "Eimg_Layer")
            self.map, self.projection, self.datum = self._place(f, first)

    @staticmethod
    def _node(f, at: int) -> Node:
        f.seek(at)
        following, _, _, child, data, size, name, kind = struct.unpack("<5Ii64s32s", f.read(120))
        return Node(name.split(b"\0")[0].decode("latin-1"), kind.split(b"\0")[0].decode("latin-1"), following, child, data, size)

    def _children(self, f, node: Node) -> Iterator[Node]:
        at, seen = node.child, set()
        while at and at not in seen:
            seen.add(at)
            child = self._node(f, at)
            yield child
            at = child.next

    def _record(self, f, node: Node) -> dict:
        f.seek(node.data)
        return self.dictionary.read(node.kind, f.read(node.size))[0]

    def _layer(self, f, node: Node) -> Layer:
        own = self._record(f, node)
        children = {n.name: n for n in self._children(f, node)}
        state = children.get("RasterDMS")
        if state is None:
            raise ValueError(f"{self.path}: the pixels of {node.name} aren't in this file")
        if own["pixelType"] not in KINDS:
            raise ValueError(f"{self.path}: complex rasters aren't supported: the imaginary part would be lost")
        f.seek(state.data)
        found, at = self.dictionary.read(state.kind, f.read(min(state.size, 4096)), to="blockinfo")
        missing = children.get("Eimg_NonInitializedValue")
        value = self._record(f, missing).get("valueBD") if missing is not None else None
        return Layer(
            node.name, own["width"], own["height"], own["pixelType"], own["blockWidth"], own["blockHeight"], found["blockinfo"], state.data + at, float(value[0]) if value else None,
        )

    def _place(self, f, node: Node) -> tuple[dict, dict, str]:
        of = {n.kind: n for n in self._children(f, node)}
        projection = of.get("Eprj_ProParameters")
        datum = next((n for n in self._children(f, projection) if n.kind == "Eprj_Datum"), None) if projection else None
        read = lambda n: self._record(f, n) if n is not None else {}
        return read(of.get("Eprj_MapInfo")), read(projection), read(datum).get("datumname", "")

    @property
    def transform(self) -> tuple[float, ...] | None:
        if not self.map:
            return None
        # pointed-to records are lists of one
        corner, size = (x[0] if isinstance(x, list) else x for x in (self.map["upperLeftCenter"], self.map["pixelSize"]))
        w, h = size["width"], size["height"]
        return (w, 0.0, corner["x"] - w / 2, 0.0, -h, corner["y"] + h / 2)

    @property
    def crs(self) -> str | None:
        number, zone, datum = self.projection.get("proNumber"), self.projection.get("proZone", 0), self.datum.upper().replace(" ", "").replace("_", "")
        world = datum.startswith("WGS84")
        if number == GEOGRAPHIC and world:
            return "EPSG:4326"
        if number == UTM and 1 <= zone <= 60:
            south = len(self.projection.get("proParams", ())) > 3 and self.projection["proParams"][3] < 0
            if world:
                return f"EPSG:{(32700 if south else 32600) + zone}"
            if datum.startswith("NAD83") and not south and zone <= 23:
                return f"EPSG:{26900 + zone}"
        return None

    @cached_property
    def info(self) -> np.dtype:
        """The layout of a block's place, as the dictionary has it."""
        codes = {"s": "<u2", "S": "<i2", "l": "<u4", "L": "<u4", "e": "<u2"}
        items = self.dictionary.records["Edms_VirtualBlockInfo"]
        return np.dtype([(i.name, codes[i.kind]) for i in items])

    def block(self, f, layer: Layer, index: int) -> np.ndarray:
        n = layer.block_width * layer.block_height
        if not 0 <= index < layer.blocks:
            raise ValueError(f"{self.path}: {layer.name} has no block {index}")
        f.seek(layer.table + index * self.info.itemsize)
        info = np.frombuffer(f.read(self.info.itemsize), self.info)[0]
        if not info["logvalid"]:
            return np.full((layer.block_height, layer.block_width), layer.nodata or 0, np.float32)
        f.seek(int(info["offset"]))
        raw = f.read(int(info["size"]))
        values = decompressed(raw, layer.kind, n) if info["compressionType"] else unpacked(raw, layer.kind, n)
        return values.reshape(layer.block_height, layer.block_width)

    def rows(self, y0: int, y1: int, chosen: list[int]) -> np.ndarray:
        """(rows, width, bands) as float32."""
        width = self.layers[0].width
        out = np.empty((y1 - y0, width, len(chosen)), np.float32)
        with open(self.path, "rb") as f:
            for k, band in enumerate(chosen):
                layer = self.layers[band]
                bw, bh = layer.block_width, layer.block_height
                across = -(-width // bw)
                for j in range(y0 // bh, -(-y1 // bh)):
                    a, b = max(y0, j * bh), min(y1, (j + 1) * bh)
                    for i in range(across):
                        left, columns = i * bw, min(bw, width - i * bw)
                        out[a - y0 : b - y0, left : left + columns, k] = self.block(f, layer, j * across + i)[a - j * bh : b - j * bh, :columns]
        return out


def metadata(path: str) -> RasterMetadata:
    m = Imagine(path)
    first = m.layers[0]
    details = tuple(BandInfo(i, x.name) for i, x in enumerate(m.layers))
    return RasterMetadata(first.width, first.height, len(m.layers), np.dtype(KINDS[first.kind]).name, m.crs, m.transform, "bsq", first.nodata, details, {})


class ImagineReader(StripReader):
    def __init__(self, options: dict):
        super().__init__()
        self.file = Imagine(options["path"])
        self.height = self.file.layers[0].height
        self.step = min(64, max(32, self.file.layers[0].block_height))  # whole blocks, so that each is decoded once
        chosen = options.get("bands")
        self.chosen = [int(b) for b in chosen.split(",")] if chosen else list(range(len(self.file.layers)))
        if any(not 0 <= b < len(self.file.layers) for b in self.chosen):
            raise IndexError(f"bands {self.chosen} of {len(self.file.layers)}")

    def pixels(self, y0: int, y1: int) -> np.ndarray:
        return self.file.rows(y0, y1, self.chosen)


class ImagineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imagine"

    def schema(self) -> str:
        return PIXEL

    def reader(self, schema) -> ImagineReader:
        return ImagineReader(self.options)


def read_imagine(spark: SparkSession, path: str, bands: list[int] | None = None) -> Raster:
    meta = metadata(path)
    options = {"path": path} | ({"bands": ",".join(map(str, bands))} if bands is not None else {})
    if bands is not None:
        meta = replace(meta, bands=len(bands), band_details=tuple(replace(meta.band_details[b], index=i) for i, b in enumerate(bands)))
    return Raster(meta, scan(spark, ImagineSource, **options), os.path.basename(path))
