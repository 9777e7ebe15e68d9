"""python -m bandloom FILE: what a raster holds, and the statistics of its bands."""

from __future__ import annotations

import sys

from bandloom.operators.stats import report, spectrum_statistics
from bandloom.plans.session import session
from bandloom.sources.reader import open_raster


def main(args: list[str]) -> int:
    if len(args) != 1:
        print(__doc__)
        return 2
    spark = session()
    r = open_raster(spark, args[0])
    print(f"{r.name}: {r.meta.width} x {r.meta.height} x {r.meta.bands} {r.meta.dtype}, {r.meta.crs or 'no coordinate system'}")
    report(spectrum_statistics(r.df, r.meta.nodata).orderBy("band")).show(r.meta.bands, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
