"""Landsat scene packages: a metadata file of nested groups, and one GeoTIFF for each band."""

from __future__ import annotations

import glob
import os
from dataclasses import replace

from pyspark.sql import SparkSession

from bandloom.plans.raster import BandInfo, Raster, RasterMetadata

from . import tiff
from .envi import scan

# Fixed values: (band number, name, wavelength in nm) of the sensors; the panchromatic band has a grid of its own.
OLI = [
    (1, "Coastal Aerosol", 443.0), (2, "Blue", 482.0), (3, "Green", 561.0), (4, "Red", 655.0), (5, "Near Infrared (NIR)", 865.0),
    (6, "Shortwave Infrared 1 (SWIR 1)", 1609.0), (7, "Shortwave Infrared 2 (SWIR 2)", 2201.0), (9, "Cirrus", 1373.0),
    (10, "Thermal Infrared 1 (TIRS 1)", 10895.0), (11, "Thermal Infrared 2 (TIRS 2)", 12005.0),
]
TM = [
    (1, "Blue", 485.0), (2, "Green", 560.0), (3, "Red", 660.0), (4, "Near Infrared (NIR)", 830.0), (5, "Shortwave Infrared 1 (SWIR 1)", 1650.0),
    (7, "Shortwave Infrared 2 (SWIR 2)", 2215.0), (6, "Thermal Infrared", 11450.0),
]


def parse_mtl(path: str) -> dict:
    """Nested groups of strings; quotes go."""
    with open(path, encoding="utf-8", errors="replace") as f:
        lines = f.read().splitlines()
    root: dict = {}
    stack = [root]
    for line in lines:
        key, sep, value = (p.strip() for p in line.partition("="))
        if not sep:
            continue
        if key == "GROUP":
            stack.append(stack[-1].setdefault(value, {}))
        elif key == "END_GROUP":
            if len(stack) > 1:
                stack.pop()
        else:
            stack[-1][key] = value.strip('"')
    return root


def find_mtl(path: str) -> str | None:
    """The metadata file of a folder, or the path itself if it is one."""
    if os.path.isdir(path):
        found = sorted(p for p in glob.glob(os.path.join(glob.escape(path), "*")) if p.lower().endswith("mtl.txt"))
        return found[0] if found else None
    return path if path.lower().endswith("_mtl.txt") else None


def _file(folder: str, name: str) -> str | None:
    path = os.path.join(folder, name)
    if os.path.isfile(path):
        return path
    return next((os.path.join(folder, n) for n in sorted(os.listdir(folder)) if n.lower() == name.lower()), None)


def metadata(path: str) -> tuple[RasterMetadata, list[str]]:
    """The scene's metadata and the files of its bands, in order; missing bands are left out."""
    mtl = parse_mtl(path)
    groups = next((mtl[k] for k in ("L1_METADATA_FILE", "LANDSAT_METADATA_FILE") if k in mtl), mtl)
    product = groups.get("PRODUCT_METADATA") or groups.get("PRODUCT_CONTENTS") or {}
    image = groups.get("IMAGE_ATTRIBUTES", {})
    craft = (product.get("SPACECRAFT_ID") or image.get("SPACECRAFT_ID") or "").upper()
    new = any(n in craft for n in ("_8", "_9")) or not craft
    folder = os.path.dirname(os.path.abspath(path))
    bands, files = [], []
    for number, name, wl in OLI if new else TM:
        file = product.get(f"FILE_NAME_BAND_{number}")
        found = _file(folder, file) if file else None
        if found:
            bands.append(BandInfo(len(bands), name, wl, mtl_band=number))
            files.append(found)
    if not files:
        raise ValueError(f"{path}: no corresponding Landsat band files")

    def number(key: str, default: float) -> float:
        try:
            return float(image.get(key, default))
        except ValueError:
            return default

    first = tiff.metadata(files[0])
    rgb = (3, 2, 1) if new else (2, 1, 0)
    header = {"mtl_data": mtl, "sun_elevation": number("SUN_ELEVATION", 0.0), "earth_sun_distance": number("EARTH_SUN_DISTANCE", 1.0), "date_acquired": product.get("DATE_ACQUIRED") or image.get("DATE_ACQUIRED"), "spacecraft": craft}
    nodata = 0.0 if first.nodata is None else first.nodata
    meta = replace(first, bands=len(files), band_details=tuple(bands), nodata=nodata, raw_header=header, default_bands=rgb if len(files) > max(rgb) else None)
    return meta, files


def read_landsat(spark: SparkSession, path: str) -> Raster:
    """A strip's task reads that strip of every band's file, so bands are put together without a join."""
    found = find_mtl(path)
    if found is None:
        raise FileNotFoundError(f"no metadata file at {path}")
    meta, files = metadata(found)
    return Raster(meta, scan(spark, tiff.TiffSource, path=os.pathsep.join(files)), os.path.basename(found))
