"""Deterministic stand-ins for a random generator: results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *columns: Column) -> Column:
    """A number in [0, 1) derived from the first 32 bits of an MD5 of seed and columns."""
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def integer_between(low: int, high: int, seed: int | str, *columns: Column) -> Column:
    """An integer in [low, high]."""
    return (F.lit(low) + F.floor(uniform(seed, *columns) * (high - low + 1))).cast("int")


def normal(seed: int | str, *columns: Column) -> Column:
    """A standard normal value (Box-Muller)."""
    u = 1 - uniform(f"{seed}a", *columns)
    v = uniform(f"{seed}b", *columns)
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * F.pi() * v)
