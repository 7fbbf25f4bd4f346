"""Reproducible draws: a hash of (seed, replicate, key) instead of a random stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: six-point wild bootstrap weights, -sqrt(1.5) .. sqrt(1.5) --------
SIX_POINTS = (-(1.5**0.5), -1.0, -(0.5**0.5), 0.5**0.5, 1.0, 1.5**0.5)
# --- end of fixed values ---------------------------------------------------------------


def uniform(seed: int, *parts: Column) -> Column:
    """A double in [0, 1) from the first 32 bits of the md5 of the joined parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def six_point_weight(seed: int, *parts: Column) -> Column:
    position = F.floor(uniform(seed, *parts) * 6).cast("int")
    return F.element_at(F.array(*[F.lit(w) for w in SIX_POINTS]), position + 1)
