"""One entry for all raster files."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from bandloom.plans.raster import Raster

from . import envi, imagine, landsat, tiff


def open_raster(spark: SparkSession, path: str) -> Raster:
    """By what the path is: a scene folder or its metadata file, an ENVI header or a file with one beside it, a TIFF, an Imagine file."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if landsat.find_mtl(path):
        return landsat.read_landsat(spark, path)
    if os.path.isdir(path):
        raise ValueError(f"{path} is a folder without a scene's metadata file")
    with open(path, "rb") as f:
        head = f.read(512)
    if path.lower().endswith(".txt"):
        if b"GROUP" in head and b"METADATA" in head:
            meta, files = landsat.metadata(path)
            return Raster(meta, envi.scan(spark, tiff.TiffSource, path=os.pathsep.join(files)), os.path.basename(path))
        raise ValueError(f"{path} isn't a scene's metadata file")
    if path.lower().endswith(".hdr"):
        return envi.read_envi(spark, path)
    if head[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        return tiff.read_tiff(spark, path)
    if head.startswith(imagine.MAGIC):
        return imagine.read_imagine(spark, path)
    try:
        return envi.read_envi(spark, path)
    except FileNotFoundError:
        raise ValueError(f"{path} isn't a raster that can be read") from None
