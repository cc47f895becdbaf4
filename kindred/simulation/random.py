"""Portable randomness: uniform numbers as a function of a seed and keys, equal under any partitioning."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """In [0, 1): the first 32 bits of the md5 of seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))


def normal(seed: int | str, *keys: Column | str) -> Column:
    """Standard normal deviate (Box and Muller)."""
    u, v = uniform(f"{seed}/u", *keys), uniform(f"{seed}/v", *keys)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * pi * v)


def choice(n: Column, seed: int | str, *keys: Column | str) -> Column:
    """A whole number from 0 to n - 1."""
    return F.floor(uniform(seed, *keys) * n).cast("long")
