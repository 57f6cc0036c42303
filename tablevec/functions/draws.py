"""Repeatable random draws: an md5 of the seed and the keys, so that a re-run task draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_RANGE = 2**32


def draw(seed, *keys) -> Column:
    """A whole number in [0, 2**32) fixed by ``seed`` and ``keys``."""
    parts = [F.lit(str(seed))] + [k if isinstance(k, Column) else F.col(k) for k in keys]
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(seed, *keys) -> Column:
    """``draw`` scaled to a double in [0, 1)."""
    return draw(seed, *keys).cast("double") / F.lit(float(DRAW_RANGE))
