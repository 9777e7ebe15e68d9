"""bandloom: raster and hyperspectral analytics as Spark plans."""
