"""Sessions, rasters and the algebra that the operators are written in."""
