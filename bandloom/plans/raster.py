"""The data model: a raster is a small metadata record and a DataFrame of pixels (y, x, spectrum)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import num

PIXEL = "y int, x int, spectrum array<float>"


@dataclass(frozen=True)
class BandInfo:
    index: int
    name: str
    wavelength: float | None = None
    wavelength_unit: str = "nm"
    fwhm: float | None = None
    mtl_band: int | None = None

    @property
    def display_name(self) -> str:
        if self.wavelength is not None:
            return f"Band {self.index + 1} ({self.wavelength:.2f} {self.wavelength_unit})"
        return f"Band {self.index + 1}: {self.name}" if self.name else f"Band {self.index + 1}"


@dataclass(frozen=True)
class RasterMetadata:
    width: int
    height: int
    bands: int
    dtype: str = "float32"
    crs: str | None = None
    transform: tuple[float, ...] | None = None
    interleave: str = "bsq"
    nodata: float | None = None
    band_details: tuple[BandInfo, ...] = ()
    raw_header: dict = field(default_factory=dict)
    default_bands: tuple[int, ...] | None = None

    @property
    def samples(self) -> int:
        return self.width

    @property
    def lines(self) -> int:
        return self.height

    def wavelengths(self) -> list[float]:
        """Of all bands in nm; where any is missing, an even axis over the solar range stands in."""
        found = [b.wavelength for b in self.band_details]
        if len(found) == self.bands and all(w is not None and np.isfinite(w) for w in found):
            return [w * 1000 if b.wavelength_unit.lower() in ("um", "µm", "micrometers") or w < 20 else w for w, b in zip(found, self.band_details)]
        return np.linspace(400, 2500, self.bands).tolist()

    def default_rgb(self) -> tuple[int, ...]:
        return self.default_bands or ((0, 1, 2) if self.bands >= 3 else (0,))


@dataclass(frozen=True)
class Raster:
    meta: RasterMetadata
    df: DataFrame
    name: str = ""
    layer_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def band(self, index: int) -> DataFrame:
        """(y, x, value) of a band."""
        if not 0 <= index < self.meta.bands:
            raise IndexError(f"band {index} of {self.meta.bands}")
        return self.df.select("y", "x", F.get("spectrum", F.lit(index)).alias("value"))

    def select_bands(self, indices: Sequence[int]) -> Raster:
        """Band selection; the order is kept."""
        spectrum = F.array(*(F.get("spectrum", F.lit(i)) for i in indices))
        details = tuple(replace(self.meta.band_details[i], index=k) for k, i in enumerate(indices)) if len(self.meta.band_details) == self.meta.bands else ()
        return replace(self, meta=replace(self.meta, bands=len(indices), band_details=details, default_bands=None), df=self.df.withColumn("spectrum", spectrum))

    def profile(self, x: int, y: int) -> list[float] | None:
        """The spectrum of one pixel; None outside. The filter reaches the scan."""
        row = self.df.filter((F.col("y") == y) & (F.col("x") == x)).select("spectrum").first()
        return list(row[0]) if row else None

    def profile_by_wavelength(self, x: int, y: int) -> list[tuple[float, float]] | None:
        """(wavelength in nm, value) of one pixel, by ascending wavelength whatever the order of the bands."""
        values = self.profile(x, y)
        return None if values is None else sorted(zip(self.meta.wavelengths(), values))

    def to_numpy(self) -> np.ndarray:
        """(bands, height, width), for tests and small rasters."""
        out = np.full((self.meta.bands, self.meta.height, self.meta.width), np.nan, np.float64)
        for r in self.df.collect():
            out[:, r.y, r.x] = r.spectrum
        return out

    @staticmethod
    def from_numpy(spark: SparkSession, cube: np.ndarray, meta: RasterMetadata | None = None, name: str = "") -> Raster:
        """From (height, width) or (bands, height, width)."""
        cube = np.asarray(cube, np.float32)
        cube = cube[None] if cube.ndim == 2 else cube
        b, h, w = cube.shape
        meta = replace(meta, width=w, height=h, bands=b) if meta else RasterMetadata(w, h, b)
        rows = [(y, x, cube[:, y, x].tolist()) for y in range(h) for x in range(w)]
        return Raster(meta, spark.createDataFrame(rows, PIXEL), name)

    @staticmethod
    def from_vectors(df: DataFrame, vector: str, key: str, width: int) -> DataFrame:
        """Rows of vectors seen as pixels, width to a line; other columns stay."""
        y, x = F.floor(F.col(key) / width).cast("int"), (F.col(key) % width).cast("int")
        return df.withColumns({"y": y, "x": x, "spectrum": num.doubles(vector)})


def pixel_to_geo(x: Column, y: Column, transform: Sequence[float]) -> tuple[Column, Column]:
    """World coordinates of a pixel's centre."""
    a, b, c, d, e, f = transform[:6]
    return a * (x + 0.5) + b * (y + 0.5) + c, d * (x + 0.5) + e * (y + 0.5) + f
