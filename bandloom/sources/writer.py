"""Raster files from pixel tables.

A raster is written by its tasks: pixels meet in tiles or strips, which are packed as the format wants them and written to
their places in the file (sink.py), so a lost task leaves no hole and a failed job no file. The target must lie in a folder
that driver and executors share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.plans.raster import Raster, RasterMetadata
from bandloom.plans.session import stored
from bandloom.plans.ship import ship

from . import envi, tiff
from .sink import write_pieces

#: Sides of a GeoTIFF's tiles; most lines, and about how many values, a strip of an ENVI file has.
TILE, STRIP, BLOCK = 256, 256, 1 << 22
#: Places of tiles that are sent to all tasks.
MAX_SENT = 1 << 20


def converted(block: np.ndarray, dtype: str, nodata: float | None) -> np.ndarray:
    """Floats as the target type: for integers what isn't finite becomes nodata (or 0), the rest is clipped and cut off."""
    kind = np.dtype(dtype)
    if kind.kind == "f":
        return block.astype(kind)
    info = np.iinfo(kind)
    wide = np.where(np.isfinite(block), block.astype(np.float64), 0.0 if nodata is None else nodata)
    return np.trunc(np.clip(wide, info.min, info.max)).astype(kind)


def header_text(meta: RasterMetadata, dtype: str, interleave: str, nodata: float | None, classes: Sequence[tuple[str, tuple[int, int, int]]] = ()) -> str:
    code = next(k for k, v in envi.DTYPES.items() if v == dtype)
    lines = ["ENVI", "description = { written by bandloom }", f"samples = {meta.width}", f"lines = {meta.height}", f"bands = {meta.bands}", "header offset = 0", "file type = ENVI Standard", f"data type = {code}", f"interleave = {interleave}", "byte order = 0"]
    if meta.transform:
        a, _, c, _, e, f = meta.transform[:6]
        if meta.crs and meta.crs.upper().startswith(("EPSG:326", "EPSG:327")):
            lines.append(f"map info = {{UTM, 1, 1, {c!r}, {f!r}, {a!r}, {abs(e)!r}, {int(meta.crs[-2:])}, {'South' if meta.crs[7] == '7' else 'North'}, WGS-84, units=Meters}}")
        else:
            lines.append(f"map info = {{{'Geographic Lat/Lon' if meta.crs == 'EPSG:4326' else meta.crs or 'Arbitrary'}, 1, 1, {c!r}, {f!r}, {a!r}, {abs(e)!r}}}")
    d = meta.band_details[: meta.bands]
    if d and all(b.wavelength is not None for b in d):
        lines += ["wavelength units = Nanometers", "wavelength = {" + ", ".join(f"{b.wavelength:g}" for b in d) + "}"]
    if d and all(b.fwhm is not None for b in d):
        lines.append("fwhm = {" + ", ".join(f"{b.fwhm:g}" for b in d) + "}")
    if d:
        lines.append("band names = {" + ", ".join(b.name.replace(",", " ") for b in d) + "}")
    if meta.default_bands and all(b < meta.bands for b in meta.default_bands):
        lines.append("default bands = {" + ", ".join(str(b + 1) for b in meta.default_bands) + "}")
    if nodata is not None:
        lines.append(f"data ignore value = {nodata:g}")
    if classes:
        lines += [f"classes = {len(classes)}", "class names = {" + ", ".join(n for n, _ in classes) + "}", "class lookup = {" + ", ".join(str(v) for _, rgb in classes for v in rgb) + "}"]
    return "\n".join(lines) + "\n"


def blocks(r: Raster, rows: int, columns: int, fill: float) -> DataFrame:
    """(ty, tx, block): float32 blocks of rows by columns by bands, for tiles that have a pixel; the rest of them is filled."""
    ship(r.df.sparkSession)
    bands = r.meta.bands

    def block(table: pa.Table) -> pa.Table:
        ty, tx = table.column("ty")[0].as_py(), table.column("tx")[0].as_py()
        y, x = table.column("y").to_numpy() - ty * rows, table.column("x").to_numpy() - tx * columns
        out = np.full((rows, columns, bands), fill, np.float32)
        out[y, x] = np.asarray(table.column("spectrum").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, bands)
        return pa.table({"ty": pa.array([ty], pa.int32()), "tx": pa.array([tx], pa.int32()), "block": pa.array([out.tobytes()], pa.binary())})

    inside = (F.col("y") >= 0) & (F.col("y") < r.meta.height) & (F.col("x") >= 0) & (F.col("x") < r.meta.width)
    x = r.df.filter(inside).select("y", "x", F.col("spectrum").cast("array<float>").alias("spectrum"), F.floor(F.col("y") / rows).cast("int").alias("ty"), F.floor(F.col("x") / columns).cast("int").alias("tx"))
    return x.groupBy("ty", "tx").applyInArrow(block, "ty int, tx int, block binary")


def export(r: Raster, path: str, format: str = "ENVI", bands: Sequence[int] | None = None, dtype: str = "float32", nodata: float | None = None, compress: str = "lzw", interleave: str = "bsq", classes: Sequence[tuple[str, tuple[int, int, int]]] = (), tile: int = TILE) -> str:
    """Writes a raster and gives the path of its data file. Tasks write it in place (sink.py); a GeoTIFF has tiles, and offsets
    of 64 bits where it needs them."""
    if bands is not None:
        if not bands:
            raise ValueError("no bands to export")
        r = r.select_bands(bands)
    fill = np.nan if nodata is None else nodata
    if format.upper() in ("GTIFF", "TIFF", "GEOTIFF"):
        export_tiff(r, path, dtype, fill, nodata, tiff.compression(compress), tile)
        return path
    if format.upper() != "ENVI":
        raise ValueError(f"unknown format {format!r}")
    target = path[:-4] + ".dat" if path.lower().endswith(".hdr") else path
    export_envi(r, target, dtype, fill, nodata, interleave)
    with open(os.path.splitext(target)[0] + ".hdr", "w", encoding="utf-8") as f:
        f.write(header_text(r.meta, dtype, interleave, nodata, classes))
    return target


def export_tiff(r: Raster, path: str, dtype: str, fill: float, nodata: float | None, how: str, tile: int, first: int = 0) -> None:
    """Tiles are packed by tasks and stored; their sizes give their places, and tasks write them there. Tiles without pixels
    share one place. first: where tiles start at the earliest."""
    if tile % 16:
        raise ValueError("tiles are multiples of 16")
    m = r.meta
    down, across = -(-m.height // tile), -(-m.width // tile)

    def bytes_of(block: np.ndarray) -> bytes:
        a = converted(block, dtype, nodata)
        return tiff.packed(np.ascontiguousarray(a, a.dtype.newbyteorder("<")).tobytes(), how)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ty, tx, raw in zip(b.column("ty").to_pylist(), b.column("tx").to_pylist(), b.column("block")):
                data = bytes_of(np.frombuffer(raw.as_buffer(), np.float32).reshape(tile, tile, m.bands))
                yield pa.RecordBatch.from_arrays([pa.array([ty * across + tx], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["i", "n", "data"])

    tiles = stored(blocks(r, tile, tile, fill).mapInArrow(pack, "i long, n long, data binary"), "tiles")
    sizes = {x.i: x.n for x in tiles.select("i", "n").collect()}  # what the file's own directory holds
    empty = bytes_of(np.full((tile, tile, m.bands), fill, np.float32)) if len(sizes) < down * across else b""
    layout = tiff.Layout.of((m.height, m.width, m.bands), np.dtype(dtype), [sizes.get(i) for i in range(down * across)], len(empty), replace(m, nodata=nodata), how, tile, first)
    spark = r.df.sparkSession
    places = spark.createDataFrame(pa.table({"i": pa.array(list(sizes), pa.int64()), "at": pa.array([layout.offsets[i] for i in sizes], pa.int64())})) if sizes else spark.createDataFrame([], "i long, at long")
    side = F.broadcast(places) if len(sizes) <= MAX_SENT else places
    known = [*layout.known, (layout.empty, empty)] if empty else layout.known
    write_pieces(tiles.join(side, "i").select("at", "data"), path, layout.size, known, len(sizes))


def export_envi(r: Raster, target: str, dtype: str, fill: float, nodata: float | None, interleave: str) -> None:
    """Strips of whole lines, whose places follow from the header. Strips without pixels are written by the tasks, too."""
    m, size = r.meta, np.dtype(dtype).itemsize
    rows = min(STRIP, max(1, BLOCK // max(1, m.width * m.bands)))
    strips = -(-m.height // rows)
    order = {"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}[interleave]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, raw in zip(b.column("ty").to_pylist(), b.column("block")):
                block = np.frombuffer(raw.as_buffer(), np.float32).reshape(rows, m.width, m.bands) if raw.is_valid else np.full((rows, m.width, m.bands), fill, np.float32)
                a = np.ascontiguousarray(converted(block[: m.height - s * rows], dtype, nodata).transpose(order))
                if interleave == "bsq":
                    at, data = [size * m.width * (i * m.height + s * rows) for i in range(m.bands)], [band.tobytes() for band in a]
                else:
                    at, data = [size * m.width * m.bands * s * rows], [a.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(data, pa.binary())], names=["at", "data"])

    every = r.df.sparkSession.range(strips).select(F.col("id").cast("int").alias("_s"))
    found = blocks(r, rows, m.width, fill).select("ty", "block")
    placed = every.join(found, F.col("_s") == F.col("ty"), "left").select(F.col("_s").alias("ty"), "block")
    write_pieces(placed.mapInArrow(place, "at long, data binary"), target, size * m.width * m.height * m.bands, (), strips * (m.bands if interleave == "bsq" else 1))


def write_png(path: str, rgb: np.ndarray) -> None:
    """An image of (height, width, 3) or (height, width) bytes."""
    import struct
    import zlib

    a = np.asarray(rgb, np.uint8)
    color = 2 if a.ndim == 3 else 0
    rows = b"".join(b"\0" + row.tobytes() for row in a)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
