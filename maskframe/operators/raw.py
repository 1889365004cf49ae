"""The raw lane: payload texts of any shape, flattened and rebuilt with exact numbers and key order.

Masking needs no shuffle: find leaves (Arrow), decide and fake each distinct leaf of a batch (Columns over rows, see
``coded``), rebuild (Arrow). Formats are those of ``sources.texts``; a text is written back in its own.
A text that does not parse keeps its row with an error.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from maskframe.functions import detect, fakes
from maskframe.functions.hashing import SEED, digest, number
from maskframe.operators import coded
from maskframe.sources import texts
from maskframe.sources.texts import Number

#: A leaf's parts as Columns, by name.
Leaf = Mapping[str, Column]

LEAF = "array<struct<path:string,norm_path:string,kind:string,value:string>>"
RULES = "map<string,struct<type:string,anchor:boolean>>"


def _walk(node, path: str, leaves: list, paths: dict | None, norm: str | None = None) -> None:
    """Gather the leaves of a tree, and its paths unless ``paths`` is None; ``norm`` is the normalized path."""
    norm = re.sub(r"\[\d+\]", "[]", path) if norm is None else norm
    if isinstance(node, dict):
        for key, value in node.items():
            inner, plain = (f"{path}.{key}", f"{norm}.{key}") if path else (key, key)
            plain = re.sub(r"\[\d+\]", "[]", plain) if "[" in key else plain
            if paths is not None:
                paths[plain] = None
            _walk(value, inner, leaves, paths, plain)
    elif isinstance(node, texts.Pairs):
        for key, place, value in node:
            inner, plain = (f"{path}.{key}", f"{norm}.{key}") if path else (key, key)
            if paths is not None:
                paths[plain] = None
            _walk(value, inner if place is None else f"{inner}[{place}]", leaves, paths, plain if place is None else f"{plain}[]")
    elif isinstance(node, list):
        for i, value in enumerate(node):
            _walk(value, f"{path}[{i}]", leaves, paths, f"{norm}[]")
    elif (inner := texts.nested(node)) is not None:
        _walk(inner, path, leaves, None, norm)
    elif node is not None:
        kind = "number" if isinstance(node, Number) else "boolean" if isinstance(node, bool) else "string"
        leaves.append({"path": path, "norm_path": norm, "kind": kind, "value": str(node).lower() if kind == "boolean" else str(node)})


def flatten(payloads: DataFrame, text_col: str = "text") -> DataFrame:
    """``payloads`` with ``leaves`` in document order (those of JSON inside strings too), ``paths`` (containers
    and nulls too), ``format`` and ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                leaves, paths, error, kind = [], {}, None, None
                try:
                    parsed = texts.parse(text or "")
                    kind = parsed.format
                    for i, doc in enumerate(parsed.documents):
                        _walk(doc, f"[{i}]" if len(parsed.documents) > 1 else "", leaves, paths)
                except (ValueError, RecursionError) as problem:
                    leaves, paths, error = [], {}, str(problem)
                rows.append({"leaves": leaves, "paths": list(paths), "format": kind, "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    leaf = pa.struct([(n, pa.string()) for n in ("path", "norm_path", "kind", "value")])
    out = pa.schema([("leaves", pa.list_(leaf)), ("paths", pa.list_(pa.string())), ("format", pa.string()), ("error", pa.string())])
    return _beside(payloads, text_col, run, f"leaves {LEAF}, paths array<string>, format string, error string")


def _beside(df: DataFrame, column: str, run, schema: str) -> DataFrame:
    """``df`` with the columns that ``run`` makes of one column, batch by batch, without a join."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (made,) = run([batch.select([column])])
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.columns], [*batch.schema.names, *made.schema.names])

    return df.mapInArrow(both, StructType([*df.schema.fields, *StructType.fromDDL(schema).fields]))


_PARTS = ("path", "norm_path", "kind", "value", "rule", "anchor", "seed", "by_path")


@functools.lru_cache(1 << 16)
def by_path_type(norm_path: str) -> str | None:
    """path_type() of a path, once a path and process."""
    return detect.literal_path_type(norm_path)


def found_type(by_path: Column, leaf: Leaf) -> Column:
    """A leaf's detected type; numbers and booleans other than ids are preserved. ``by_path`` is path_type()."""
    kind, value = leaf["kind"], leaf["value"]
    number = F.when(detect.detect(by_path, value, F.lit("number")) == "id", "id").otherwise("preserve")
    return F.when(kind == "boolean", "preserve").when(kind == "number", number).otherwise(detect.detect(by_path, value, kind))


def decided_type(found: Column, leaf: Leaf, toggles: Mapping[str, bool] | None = None) -> Column:
    """The type of the rule of a leaf's path, else of ``*``, else the type ``found``; a toggle by path beats the rule."""
    ruled = F.when(leaf["rule"].isNull() | leaf["rule"].isin("auto", "nestedJson"), found).otherwise(leaf["rule"])
    if toggles:
        on = F.create_map(*(F.lit(x) for pair in toggles.items() for x in pair))[leaf["norm_path"]]
        opted = F.when(ruled != "preserve", ruled).when(found != "preserve", found).otherwise(detect.id_like(leaf["value"], leaf["kind"]))
        ruled = F.when(on.isNull(), ruled).when(on, opted).otherwise("preserve")
    return ruled


def _number(value: Column, found: Column, seed: Column | str, salt: Column) -> Column:
    """A number's text with other digits; whole numbers by the bijection of the typed lane."""
    plain = value.rlike(r"^-?\d+$")
    whole = F.when(plain, value).try_cast("long")
    mantissa, rest = F.regexp_extract(value, r"^(-?[\d.]+)", 1), F.regexp_extract(value, r"^-?[\d.]+(.*)$", 1)
    digits = F.concat(fakes.scramble(mantissa, seed, salt), rest)
    price = fakes.amount(value.try_cast("double"), seed, salt).cast("string")
    time = (whole - (number(digest(seed, "unixTimestamp", value, salt)) % 86_400_000 + 1)).cast("string")
    made = F.when(found == "priceAmount", price).when((found == "unixTimestamp") & whole.isNotNull(), time)
    return made.when(plain, fakes.whole_text(value, seed)).otherwise(digits)


_SCRAMBLED = ("id", "sku", "phone")


def masked_value(leaf: Leaf, seed: Column | str = SEED, values: Mapping[str, str] | None = None) -> Column:
    """What a leaf with its type becomes: a literal of its path, cast to its kind, or a fake. Anchored leaves
    get the same fake wherever the value stands."""
    value, found, kind = leaf["value"], leaf["type"], leaf["kind"]
    salt = F.when(leaf["anchor"], F.lit("")).otherwise(leaf["path"])
    chain = F.when(found.isin("preserve", "auto", "nestedJson"), value)
    if values:
        literal = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[leaf["norm_path"]]
        fits = F.when(kind == "number", literal.try_cast("double").isNotNull()).when(kind == "boolean", literal.isin("true", "false")).otherwise(True)
        chain = F.when(literal.isNotNull() & fits, literal).when(found.isin("preserve", "auto", "nestedJson"), value)
    chain = chain.when(kind == "boolean", F.when((found == "boolean"), F.when(value == "true", "false").otherwise("true")).otherwise(value)).when(kind == "number", _number(value, found, seed, salt))
    for name in fakes.TYPES:
        if name not in ("preserve", "auto", "null", "priceAmount", "unixTimestamp", "boolean", "nestedJson", "custom", "isoDate", "birthDate", *_SCRAMBLED):
            chain = chain.when(found == name, fakes.fake(name, value, seed, salt, F.regexp_extract(leaf["path"], r"^(.*)\.[^.]*$", 1)))
    dated = found.isin("isoDate", "birthDate") & (value != "")
    chain = chain.when(dated, fakes.iso_date(value, seed, salt, found))
    price = fakes.amount(value.try_cast("double"), seed, salt)
    chain = chain.when((found == "priceAmount") & price.isNotNull(), F.format_string("%.2f", price))
    return chain.when(found == "null", F.lit(None).cast("string")).otherwise(fakes.scramble(value, seed, salt, F.when(found.isin(*_SCRAMBLED), found).otherwise("id"), True))


def rule_maps(rules: DataFrame) -> DataFrame:
    """(endpoint_id, rules): a row an endpoint with a map of its paths, from (endpoint_id, path, type, anchor)."""
    pair = F.struct("path", F.struct("type", F.coalesce("anchor", F.lit(False)).alias("anchor")))
    return rules.groupBy("endpoint_id").agg(F.map_from_entries(F.collect_list(pair)).alias("rules"))


def mask(
    payloads: DataFrame, text_col: str = "text", seed: Column | str = SEED, rules: DataFrame | None = None, toggles: Mapping[str, bool] | None = None,
    values: Mapping[str, str] | None = None,
) -> DataFrame:
    """``payloads`` with the text masked, in its own format, and ``error`` (``_error`` where there is a column of that
    name); a text with an error is null, never passed on. With ``rules`` each payload's ``endpoint_id`` names the rules that
    apply; a literal (``values``, by path) beats a toggle, a toggle a rule, a rule generic detection."""
    rows, note = coded.reserved(payloads, "__rules", "__own_seed", "__found", "__type"), coded.named(payloads, "error")
    if rules is not None:
        maps = rule_maps(rules).select(F.col("endpoint_id").alias("__endpoint"), F.col("rules").alias("__rules"))
        rows = rows.join(maps, F.col("endpoint_id") == F.col("__endpoint"), "left").drop("__endpoint")
    else:
        rows = rows.withColumn("__rules", F.lit(None).cast(RULES))
    # A seed that differs from row to row is part of what tells leaves apart.
    own = isinstance(seed, Column)
    rows = rows.withColumn("__own_seed", seed.cast("string") if own else F.lit(None).cast("string"))

    def find(text: str | None, listed: list | None, seeded: str | None) -> tuple[list[tuple] | None, str | None]:
        leaves, by_path = [], dict(listed or ())
        try:
            parsed = texts.parse(text or "")
            for i, doc in enumerate(parsed.documents):
                _walk(doc, f"[{i}]" if len(parsed.documents) > 1 else "", leaves, None)
        except (ValueError, RecursionError) as problem:
            return None, str(problem)
        out = []
        for leaf in leaves:
            rule = by_path.get(leaf["norm_path"]) or by_path.get("*") or {}
            out.append((leaf["path"], leaf["norm_path"], leaf["kind"], leaf["value"], rule.get("type"), "true" if rule.get("anchor") else "false", seeded, by_path_type(leaf["norm_path"])))
        return out, None

    flat = coded.coded(rows, text_col, find, _PARTS, StructField(note, StringType()), ("__rules", "__own_seed"))
    leaf = coded.leaf(_PARTS) | {"anchor": F.col("__anchor") == "true", "type": F.col("__type")}
    flat = flat.withColumn("__found", found_type(F.col("__by_path"), leaf)).withColumn("__type", decided_type(F.col("__found"), leaf, toggles))
    made = masked_value(leaf, leaf["seed"] if own else seed, values)
    flat = flat.withColumn("__made", F.when(F.col("__at").isNotNull(), made))
    return coded.written(flat, payloads.columns, text_col, note, lambda text, values: None if text is None else rebuild(text, values))


def rebuild(text: str, values: list[str]) -> str:
    """The documents of ``text`` with their leaves replaced, in order; kinds, key order and format stay."""
    left = iter(values)

    def again(node):
        if isinstance(node, dict):
            return {k: again(v) for k, v in node.items()}
        if isinstance(node, texts.Pairs):
            return texts.Pairs((k, place, again(v)) for k, place, v in node)
        if isinstance(node, list):
            return list(map(again, node))
        if node is None:
            return None
        if (inner := texts.nested(node)) is not None:
            return texts.json_text(again(inner))
        value = next(left)
        return value if value is None or not isinstance(node, Number | bool) else Number(value)

    parsed = texts.parse(text)
    parsed.documents = list(map(again, parsed.documents))
    return texts.write(parsed)


def dechunk(text: Column) -> Column:
    """A body without the guard prefix ``)]}'``."""
    return F.regexp_replace(text, r"^\)\]\}'[,\s]*", "")
