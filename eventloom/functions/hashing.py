"""Seeded hash buckets: the same row gets the same draw on any engine, partitioning or retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(seed: int | str, *keys: Column) -> Column:
    """First 32 bits of the md5 of ``seed:key:key…`` as a non-negative long."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bucket(seed: int | str, *keys: Column, size: int = 1_000_000) -> Column:
    return hash32(seed, *keys) % F.lit(size)


def unit_draw(seed: int | str, *keys: Column) -> Column:
    """A draw in [0, 1) with a step of one millionth."""
    return bucket(seed, *keys) / F.lit(1e6)
