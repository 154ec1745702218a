"""Bit access on 16-bit digital words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unsigned(word: Column) -> Column:
    return word.cast("int").bitwiseAND(F.lit(0xFFFF))


def extract_bit(word: Column, bit: int) -> Column:
    """Bit `bit` of the word read as unsigned: 0 or 1."""
    return F.getbit(_unsigned(word), F.lit(bit)).cast("int")


def extract_field(word: Column, lines: Sequence[int]) -> Column:
    """The contiguous lines as one number; the lowest line is the lowest bit."""
    return F.shiftrightunsigned(_unsigned(word), min(lines)).bitwiseAND(
        F.lit((1 << len(lines)) - 1)
    )
