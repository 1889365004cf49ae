"""Keyed hashes that fakes are drawn from.

Everything is a pure function of (seed, type, value, salt), so equal values get equal fakes in every row,
file and run without any shared state. md5 is used because every SQL engine has it; it is no encryption:
who knows the seed can try out values, so keep the seed secret.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x01"
SEED = "maskframe"


def digest(seed: Column | str, kind: Column | str, value: Column, salt: Column | str = "", part: int = 0) -> Column:
    """32 hex digits for a value of a type under a seed and salt."""
    columns = [F.lit(x) if isinstance(x, str | int) else x for x in (seed, kind, value, salt, part)]
    return F.md5(F.concat_ws(SEPARATOR, *(c.cast("string") for c in columns)).cast("binary"))


def number(hexes: Column, at: int = 1, width: int = 8) -> Column:
    """``width`` hex digits as an integer."""
    return F.conv(F.substring(hexes, at, width), 16, 10).cast("long")
