"""Leaves of texts as dictionaries that travel ahead of their rows.

``coded`` finds the leaves of each text and puts, before the rows of each Arrow batch, one row for each distinct leaf of
that batch: its parts in the columns ``__<part>`` and its number in ``__at``; every other column is null there. The batch's
own rows hold the numbers of their leaves in ``__refs``. Decisions and fakes are then ordinary Columns over rows, evaluated
once a distinct leaf and not once a use, in generated code and not in a lambda. ``written`` reads the dictionary rows as they pass
and writes each text again with what became of its leaves.

Both are narrow, and what lies between may only be projections, which keep the order of rows: nothing is shuffled, and a
task holds the dictionary of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from maskframe.functions.paths import free_name

HELPERS = ("__at", "__refs", "__made")


def reserved(df: DataFrame, *more: str) -> DataFrame:
    """``df``, if it has no column of the names that masking keeps for itself (all begin with two underscores)."""
    taken = {c.lower() for c in df.columns} & {*HELPERS, *more}
    if taken:
        raise ValueError(f"reserved column names: {', '.join(sorted(taken))}")
    return df


def coded(df: DataFrame, column: str, find: Callable[..., tuple[list[tuple] | None, str | list | None]], parts: tuple[str, ...], note: StructField, beside: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``__at``, ``__refs``, ``__<part>`` and the column ``note``.

    ``find(text, *values of beside)`` gives the leaves of a text, each a tuple of strings, or None, and what goes to ``note``."""
    names = [f"__{part}" for part in parts]
    reserved(df, *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, int] = {}
            refs, notes = [], []
            for row in zip(batch.column(column).to_pylist(), *(batch.column(name).to_pylist() for name in beside), strict=True):
                leaves, said = find(*row)
                refs.append(None if leaves is None else [known.setdefault(leaf, len(known)) for leaf in leaves])
                notes.append(said)
            n, m = len(known), batch.num_rows
            values = list(zip(*known, strict=True)) or [()] * len(names)
            fields = [*batch.schema.names, *names, "__at", "__refs", note.name]
            listed, kind = pa.list_(pa.int32()), pa.list_(pa.string()) if isinstance(note.dataType, ArrayType) else pa.string()
            if n:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, field.type) for field in batch.schema), *(pa.array(v, pa.string()) for v in values), pa.array(np.arange(n, dtype=np.int32)), pa.nulls(n, listed), pa.nulls(n, kind)], fields)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(m, pa.string()) for _ in names), pa.nulls(m, pa.int32()), pa.array(refs, listed), pa.array(notes, kind)], fields)

    own = [StructField(field.name, field.dataType, True, field.metadata) for field in df.schema.fields]
    made = [*(StructField(name, StringType()) for name in names), StructField("__at", IntegerType()), StructField("__refs", ArrayType(IntegerType())), note]
    return df.mapInArrow(run, StructType([*own, *made]))


def leaf(parts: tuple[str, ...]) -> dict[str, Column]:
    """The parts of a dictionary row's leaf."""
    return {part: F.col(f"__{part}") for part in parts}


def written(rows: DataFrame, columns: list[str], column: str, note: str, rebuild: Callable[[str, list], str]) -> DataFrame:
    """``columns`` and ``note`` of coded() rows, where ``column`` is ``rebuild(text, values)``; ``__made`` of the dictionary
    rows has the values. A text without leaves (None) is null."""
    chosen = rows.select(*columns, note, "__at", "__refs", "__made")
    schema = StructType([_text_field(field, column) for field in chosen.schema.fields[: len(columns) + 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list = []
        for batch in batches:
            at = batch.column("__at")
            own = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
            place, made = at.to_pylist(), batch.column("__made").to_pylist()
            texts, refs = batch.column(column).to_pylist(), batch.column("__refs").to_pylist()
            out = []
            for i in range(batch.num_rows):
                if place[i] is not None:
                    if place[i] == 0:
                        known = []
                    known.append(made[i])
                else:
                    out.append(rebuild(texts[i], [known[r] for r in refs[i]]) if refs[i] is not None else None)
            if len(own):
                kept = batch.select([*columns, note]).take(pa.array(own))
                yield kept.set_column(columns.index(column), column, pa.array(out, pa.string()))

    return chosen.mapInArrow(run, schema)


def _text_field(field: StructField, column: str) -> StructField:
    return StructField(field.name, StringType(), True, field.metadata) if field.name == column else field


def named(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it where ``df`` has a column of that name."""
    return free_name(name, df.columns)
