"""Paths of leaves: normal forms, tails, accessors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Every index becomes ``[]``."""
    return F.regexp_replace(path, r"\[\d+\]", "[]")


def tail(path: Column) -> Column:
    """The last run of word characters before indexes at the end, of a concrete or a normalized path."""
    return F.regexp_extract(path, r"([A-Za-z0-9_]+)(?:\[\d*\])*$", 1)


def snake(name: Column) -> Column:
    """camelCase to snake_case."""
    return F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")


def accessor(path: Column) -> Column:
    """A normalized path as a null-safe accessor."""
    parts = F.transform(F.split(F.regexp_replace(path, r"\[\]", ".[]"), r"\."), lambda p: F.when(p == "[]", "[0]").when(p.rlike("^[A-Za-z_$][A-Za-z0-9_$]*$"), p).otherwise(F.concat(F.lit('["'), p, F.lit('"]'))))
    return F.array_join(F.filter(parts, lambda p: (p != '[""]')), "?.")


def truncated(value: Column, width: int) -> Column:
    """At most ``width`` characters, then an ellipsis."""
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width), F.lit("…"))).otherwise(value)


def modified_lines(before: Column, after: Column) -> Column:
    """1-based numbers of the lines that differ, up to the shorter text's length."""
    a, b = F.split(before, "\n", -1), F.split(after, "\n", -1)
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x != y)
    return F.filter(F.transform(pairs, lambda changed, i: F.when(changed, i + 1)), lambda i: i.isNotNull())


def masked_name(name: Column) -> Column:
    """``a.json`` becomes ``a.obfuscated.json``; names without an extension get the suffix."""
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"^(.+)\.([^.]*)$", "$1.obfuscated.$2")).otherwise(F.concat(name, F.lit(".obfuscated")))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with an underscore before it for as long as a column has that name."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
