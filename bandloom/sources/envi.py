"""ENVI rasters: a text header and a flat binary file, in any interleave.

The scan is a Python data source: a partition is a strip of rows, read with positioned reads of just the bands asked for
(`bands` option), and filters on `y` prune strips. Files are opened where the task runs, so they must lie in a folder
that executors share; with many queries on one raster, convert it to Parquet first.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from bandloom.plans.raster import PIXEL, BandInfo, Raster, RasterMetadata
from bandloom.plans.ship import ship

# Data type codes of the format.
DTYPES = {1: "uint8", 2: "int16", 3: "int32", 4: "float32", 5: "float64", 6: "complex64", 9: "complex128", 12: "uint16", 13: "uint32", 14: "int64", 15: "uint64"}
SUFFIXES = (".dat", ".raw", ".bsq", ".bil", ".bip", ".img", "")


def parse_header(path: str) -> dict:
    """Keys in lower case; values in braces are lists."""
    with open(path, encoding="utf-8", errors="replace") as f:
        text = f.read()
    out: dict = {}
    for m in re.finditer(r"^[ \t]*([^=\n{}]+?)[ \t]*=[ \t]*(\{[^}]*\}|[^\n]*)", text, re.M):
        key, value = m[1].strip().lower(), m[2].strip()
        if value.startswith("{"):
            out[key] = [p.strip() for p in re.split(r"[,\n]", value[1:-1]) if p.strip()]
        else:
            out[key] = value
    return out


def resolve(path: str) -> tuple[str, str]:
    """(header, data) from either of the two."""
    if path.lower().endswith(".hdr"):
        base = path[:-4]
        for s in SUFFIXES:
            for name in (base + s, base + s.upper()):
                if os.path.isfile(name):
                    return path, name
        raise FileNotFoundError(f"no data file beside {path}")
    for name in (os.path.splitext(path)[0] + ".hdr", os.path.splitext(path)[0] + ".HDR", path + ".hdr"):
        if os.path.isfile(name):
            return name, path
    raise FileNotFoundError(f"no header beside {path}")


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def nodata_of(header: dict) -> float | None:
    """The sentinel; 0 and what isn't a finite number mean none."""
    v = _number(header.get("data ignore value"))
    return v if v is not None and np.isfinite(v) and v != 0 else None


def geo_of(header: dict) -> tuple[str | None, tuple[float, ...] | None]:
    """(coordinate system, north-up transform) of the map info."""
    info = header.get("map info")
    crs, transform = None, None
    if isinstance(info, list) and len(info) >= 7:
        values = [_number(v) for v in info[1:7]]
        if all(v is not None for v in values):
            tie_x, tie_y, east, north, dx, dy = values
            dy = abs(dy)
            transform = (dx, 0.0, east - (tie_x - 1) * dx, 0.0, -dy, north + (tie_y - 1) * dy)
        name = info[0].lower()
        if name == "utm" and len(info) >= 9 and _number(info[7]) is not None:
            crs = f"EPSG:{327 if info[8].lower().startswith('s') else 326}{int(float(info[7])):02d}"
        elif "geographic" in name or "lat" in name:
            crs = "EPSG:4326"
        else:
            crs = info[0]
    text = header.get("coordinate system string")
    return (", ".join(text) if isinstance(text, list) else text) or crs, transform


def bands_of(header: dict, count: int) -> tuple[BandInfo, ...]:
    get = lambda key, i: header[key][i] if isinstance(header.get(key), list) and i < len(header[key]) else None
    micro = str(header.get("wavelength units", "")).lower().startswith("micro")
    out = []
    for i in range(count):
        wl, width = _number(get("wavelength", i)), _number(get("fwhm", i))
        scale = 1000.0 if micro else 1.0
        out.append(BandInfo(i, get("band names", i) or f"Band {i + 1}", wl and wl * scale, "nm", width and width * scale))
    return tuple(out)


def metadata(path: str) -> RasterMetadata:
    header, data = resolve(path)
    h = parse_header(header)
    bands = int(h.get("bands", 1))
    crs, transform = geo_of(h)
    interleave = str(h.get("interleave", "bsq")).lower()
    default = [int(float(v)) - 1 for v in h["default bands"]] if isinstance(h.get("default bands"), list) and all(_number(v) is not None for v in h["default bands"]) else None
    return RasterMetadata(
        int(h["samples"]), int(h["lines"]), bands, DTYPES.get(int(h.get("data type", 4)), "float32"), crs, transform,
        interleave if interleave in ("bsq", "bil", "bip") else "bsq", nodata_of(h), bands_of(h, bands), h, tuple(default) if default else None,
    )


@dataclass
class Layout:
    path: str
    width: int
    height: int
    bands: int
    dtype: str
    interleave: str
    offset: int

    @staticmethod
    def of(path: str) -> Layout:
        m, (_, data) = metadata(path), resolve(path)
        if m.dtype.startswith("complex"):
            raise ValueError("complex rasters aren't supported: the imaginary part would be lost")
        order = ">" if str(m.raw_header.get("byte order", "0")).strip() == "1" else "<"
        dtype = np.dtype(m.dtype).newbyteorder(order).str
        return Layout(data, m.width, m.height, m.bands, dtype, m.interleave, int(m.raw_header.get("header offset", 0)))

    def rows(self, y0: int, y1: int, chosen: list[int]) -> np.ndarray:
        """(rows, width, bands) of a strip as float32."""
        size, n = np.dtype(self.dtype).itemsize, y1 - y0
        with open(self.path, "rb") as f:

            def read(first: int, count: int) -> np.ndarray:
                f.seek(self.offset + first * size)
                raw = f.read(count * size)
                if len(raw) < count * size:
                    raise ValueError(f"{self.path} is shorter than its header says")
                return np.frombuffer(raw, self.dtype)

            if self.interleave == "bsq":
                parts = [read((b * self.height + y0) * self.width, n * self.width).reshape(n, self.width) for b in chosen]
                out = np.stack(parts, axis=-1) if parts else np.zeros((n, self.width, 0))
            elif self.interleave == "bil":
                out = read(y0 * self.bands * self.width, n * self.bands * self.width).reshape(n, self.bands, self.width)[:, chosen].transpose(0, 2, 1)
            else:
                out = read(y0 * self.width * self.bands, n * self.width * self.bands).reshape(n, self.width, self.bands)[:, :, chosen]
        return out.astype(np.float32)


@dataclass
class Strip(InputPartition):
    y0: int
    y1: int


def batches(y0: int, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A strip as Arrow rows of (y, x, spectrum)."""
    n, w, b = block.shape
    flat = pa.array(np.ascontiguousarray(block, np.float32).reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n * w + 1) * b, b, dtype=np.int32) if b else np.zeros(n * w + 1, np.int32)), flat)
    y, x = np.repeat(np.arange(y0, y0 + n, dtype=np.int32), w), np.tile(np.arange(w, dtype=np.int32), n)
    yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(x), lists], names=["y", "x", "spectrum"])


class StripReader(DataSourceReader):
    """Strips of a raster, pruned by filters on y. Subclasses give height, the strip's size and its pixels."""

    height: int = 0
    strip: int = 256
    step: int = 32  # rows that are read at once

    def __init__(self) -> None:
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        high = self.height
        for f in filters:
            if getattr(f, "attribute", None) == ("y",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo):
                    self.low, high = max(self.low, f.value), min(high, f.value + 1)
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                elif isinstance(f, LessThan):
                    high = min(high, f.value)
                elif isinstance(f, LessThanOrEqual):
                    high = min(high, f.value + 1)
            yield f  # Spark filters the rows of the strips that are left
        self.high = high

    def partitions(self) -> list[Strip]:
        high = self.height if self.high is None else self.high
        return [Strip(a, min(a + self.strip, high)) for a in range(self.low, high, self.strip)] or [Strip(0, 0)]

    def pixels(self, y0: int, y1: int) -> np.ndarray:
        raise NotImplementedError

    def read(self, partition: Strip) -> Iterator[pa.RecordBatch]:
        for y in range(partition.y0, partition.y1, self.step):
            end = min(y + self.step, partition.y1)
            yield from batches(y, self.pixels(y, end))


class EnviReader(StripReader):
    def __init__(self, options: dict):
        super().__init__()
        self.layout = Layout.of(options["path"])
        self.height = self.layout.height
        chosen = options.get("bands")
        self.chosen = [int(b) for b in chosen.split(",")] if chosen else list(range(self.layout.bands))
        if any(not 0 <= b < self.layout.bands for b in self.chosen):
            raise IndexError(f"bands {self.chosen} of {self.layout.bands}")

    def pixels(self, y0: int, y1: int) -> np.ndarray:
        return self.layout.rows(y0, y1, self.chosen)


class EnviSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "envi"

    def schema(self) -> str:
        return PIXEL

    def reader(self, schema) -> EnviReader:
        return EnviReader(self.options)


def scan(spark: SparkSession, source: type[DataSource], **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load()


def read_envi(spark: SparkSession, path: str, bands: list[int] | None = None) -> Raster:
    meta = metadata(path)
    options = {"path": path} | ({"bands": ",".join(map(str, bands))} if bands is not None else {})
    r = Raster(meta, scan(spark, EnviSource, **options), os.path.basename(path))
    if bands is None:
        return r
    from dataclasses import replace

    details = tuple(replace(meta.band_details[b], index=i) for i, b in enumerate(bands))
    return replace(r, meta=replace(meta, bands=len(bands), band_details=details, default_bands=None))
