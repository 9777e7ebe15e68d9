"""Digital numbers to reflectance and radiance."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.plans.num import lit, valid
from bandloom.plans.quantile import quantiles
from bandloom.plans.raster import BandInfo, RasterMetadata

REFLECTANCE, RADIANCE = (2e-5, -0.1), (1.0, 0.0)
# Landsat 8/9 band numbers by words in a band's name, in the order in which they are tried.
BAND_WORDS = [
    (r"coastal", 1), (r"blue", 2), (r"green", 3), (r"nir|near infrared", 5), (r"swir ?1|shortwave infrared 1", 6), (r"swir ?2|shortwave infrared 2", 7),
    (r"cirrus", 9), (r"tirs 1|thermal infrared 1", 10), (r"tirs 2|thermal infrared 2", 11), (r"pan", 8), (r"thermal", 10), (r"red", 4),
]


def usable(dn: Column, nodata: float | None = 0.0) -> Column:
    return valid(dn, nodata) & (dn > 0)


def scaled(dn: Column, mult: float | Column, add: float | Column, nodata: float | None = 0.0) -> Column:
    """mult * DN + add; 0 where the number isn't usable."""
    return F.when(usable(dn, nodata), dn * mult + add).otherwise(0.0)


def reflectance(dn: Column, mult: float = REFLECTANCE[0], add: float = REFLECTANCE[1], sun_elevation: float | None = None, nodata: float | None = 0.0) -> Column:
    """Top-of-atmosphere reflectance. The sun's elevation isn't applied: the coefficients in use give final values."""
    return scaled(dn, mult, add, nodata)


def radiance(dn: Column, mult: float = RADIANCE[0], add: float = RADIANCE[1], nodata: float | None = 0.0) -> Column:
    return scaled(dn, mult, add, nodata)


def dark_object(df: DataFrame, dn: str, mult: float = REFLECTANCE[0], add: float = REFLECTANCE[1], percentile: float = 1.0, nodata: float | None = 0.0, out: str = "rho") -> DataFrame:
    """Reflectance less the path reflectance: the exact low percentile of all positive values."""
    rho = scaled(F.col(dn), mult, add, nodata)
    path = quantiles(df.select(rho.alias("r")).filter("r > 0"), "r", [percentile / 100])
    less = F.greatest(lit(0.0), rho - (path[0] if path else 0.0))
    return df.withColumn(out, F.when(usable(F.col(dn), nodata), less).otherwise(0.0))


def band_number(band: BandInfo) -> int:
    """The band's number in its metadata file: as the reader found it, else by its name, else by its place."""
    if band.mtl_band is not None:
        return band.mtl_band
    return next((n for pattern, n in BAND_WORDS if re.search(pattern, band.name.lower())), band.index + 1)


def coefficients(meta: RasterMetadata) -> dict | None:
    """Scale factors of each band from a scene's metadata; None without it."""
    mtl = (meta.raw_header or {}).get("mtl_data")
    if not mtl:
        return None
    groups = next((mtl[k] for k in ("L1_METADATA_FILE", "LANDSAT_METADATA_FILE") if k in mtl), mtl)
    scale = groups.get("RADIOMETRIC_RESCALING") or groups.get("LEVEL1_RADIOMETRIC_RESCALING") or {}
    try:
        sun = float(meta.raw_header.get("sun_elevation") or groups.get("IMAGE_ATTRIBUTES", {}).get("SUN_ELEVATION") or 0)
    except ValueError:
        sun = 0.0
    number = lambda key, default: float(scale.get(key, default))
    out: dict = {"sun_elevation": sun, "reflectance_mult": {}, "reflectance_add": {}, "radiance_mult": {}, "radiance_add": {}}
    for i, band in enumerate(meta.band_details):
        n = band_number(band)
        for kind, (mult, add) in (("reflectance", REFLECTANCE), ("radiance", RADIANCE)):
            out[f"{kind}_mult"][i] = number(f"{kind.upper()}_MULT_BAND_{n}", mult)
            out[f"{kind}_add"][i] = number(f"{kind.upper()}_ADD_BAND_{n}", add)
    return out


def calibrated_meta(meta: RasterMetadata, kind: str = "reflectance", bands: Sequence[int] | None = None) -> RasterMetadata:
    """The metadata of calibrated bands: their names tell the kind."""
    details = []
    for k, i in enumerate(range(meta.bands) if bands is None else bands):
        band = meta.band_details[i] if i < len(meta.band_details) else BandInfo(i, "")
        details.append(replace(band, index=k, name=f"{band.name or f'Band {i + 1}'} ({kind})"))
    return replace(meta, bands=len(details), band_details=tuple(details), dtype="float32", default_bands=None)


def calibrate(df: DataFrame, meta: RasterMetadata, kind: str = "reflectance", bands: Sequence[int] | None = None, mult: float | Mapping[int, float] | None = None, add: float | Mapping[int, float] | None = None) -> DataFrame:
    """df(y, x, spectrum) calibrated band by band. Given factors come before those of the metadata, and these before 1
    and 0."""
    found = coefficients(meta) or {}
    pick = lambda given, key, i, default: (given.get(i, default) if isinstance(given, Mapping) else given) if given is not None else found.get(key, {}).get(i, default)
    spectrum = F.col("spectrum").cast("array<double>")
    nodata = 0.0 if meta.nodata is None else meta.nodata
    cols = [scaled(F.get(spectrum, lit(i)), pick(mult, f"{kind}_mult", i, 1.0), pick(add, f"{kind}_add", i, 0.0), nodata) for i in (range(meta.bands) if bands is None else bands)]
    return df.withColumn("spectrum", F.array(*cols))
