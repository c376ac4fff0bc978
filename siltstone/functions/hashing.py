"""Hash building blocks in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_mod(text: Column, m) -> Column:
    """The number whose base-256 digits are the text's UTF-8 bytes, modulo m; null for an empty text."""
    digits = F.regexp_extract_all(F.hex(text), F.lit("(..)"), F.lit(1))
    return F.when(F.octet_length(text) > 0, F.aggregate(digits, F.lit(0).cast("long"), lambda a, d: F.pmod(a * 256 + F.conv(d, 16, 10).cast("long"), F.lit(m))))


def trailing_zeros(h: Column) -> Column:
    """Of a value of 0, one."""
    return F.when(h == 0, 1).otherwise(F.bit_count(h.bitwiseAND(-h) - 1))
