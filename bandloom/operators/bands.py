"""Which band is which: by wavelength, else by name."""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np

from bandloom.plans.raster import RasterMetadata

# The wavelengths looked for, in nm, how far a band may be from them, and words in band names.
WANTED = {"blue": 480.0, "green": 550.0, "red": 660.0, "nir": 840.0, "swir2": 2200.0}
FARTHEST = 350.0
WORDS = {"blue": r"blue", "green": r"green", "red": r"(?<!infra)red\b", "nir": r"nir|near.?infra", "swir2": r"swir.?2|shortwave infrared 2"}


def match_bands(meta: RasterMetadata, wanted: Mapping[str, float] = WANTED) -> dict[str, int]:
    """The band of each colour, as far as there is one: the nearest wavelength within FARTHEST, the lowest of equals;
    without wavelengths, the first whose name fits."""
    wl = [b.wavelength for b in meta.band_details]
    out = {}
    for name, at in wanted.items():
        known = [(abs((w * 1000 if w < 20 else w) - at), i) for i, w in enumerate(wl) if w is not None and np.isfinite(w)]
        if known:
            gap, band = min(known)
            if gap < FARTHEST:
                out[name] = band
        elif name in WORDS:
            found = [i for i, b in enumerate(meta.band_details) if re.search(WORDS[name], b.name.lower())]
            if found:
                out[name] = found[0]
    return out
