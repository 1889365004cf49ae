"""Shapes of payload texts as tables of paths, checks against them, and schemas made from them.

A shape has a row for each distinct path of the data's schema, which does not grow with the rows. It is gathered as
counts by (path, kind) that add up in any order, so tasks send a row a path, not a row a leaf.

``steps`` is a path without ambiguity: ".key" for a field and "[]" for an element. Kinds are object, array, string,
integer, number, boolean and null; integer lies below number, so a path with both is of kind number.

Schemas are built on the driver, from infer_shape() or lattice(); ``LARGEST`` is checked.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.sources import texts

KINDS = ("object", "array", "string", "integer", "number", "boolean", "null")
LARGEST = 20_000
#: A shape of at most LARGEST paths and so many characters of steps is broadcast.
SMALL = 8 << 20
#: Rows and counts are handed on once their paths have so many steps in all.
HELD = 200_000
_NUMBER = re.compile(r"-?(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d{1,18}))?")


def _scalar(node) -> tuple[str, int | None]:
    """Kind of a leaf, and of an integer the digits it needs, or 400 if it is not written as digits alone."""
    if not isinstance(node, texts.Number):
        return "null" if node is None else "boolean" if isinstance(node, bool) else "string", None
    parts = _NUMBER.fullmatch(node)
    if parts is None:
        return "number", None
    whole, part, power = parts[1], (parts[2] or "").rstrip("0"), int(parts[3] or 0)
    digits = whole + part
    spare = power - len(part)
    if digits.strip("0") and spare < 0 and len(digits) - len(digits.rstrip("0")) < -spare:
        return "number", None
    return "integer", len(whole) if parts[2] is None and parts[3] is None else 400


def _nodes(document) -> Iterator[tuple]:
    """(place, steps, kind, keys, digits) of each node; the stack is our own, so depth is the parser's limit alone."""
    stack: list[tuple] = [("", (), document)]
    while stack:
        place, steps, node = stack.pop()
        if isinstance(node, texts.Pairs):
            merged: dict = {}
            for key, number, value in node:
                if number is None:
                    merged[key] = value
                else:
                    merged.setdefault(key, []).append(value)
            node = merged
        if isinstance(node, dict):
            yield place, steps, "object", list(node), None
            stack.extend((f"{place}.{k}" if place else k, (*steps, f".{k}"), v) for k, v in node.items())
        elif isinstance(node, list):
            yield place, steps, "array", None, None
            stack.extend((f"{place}[{i}]", (*steps, "[]"), v) for i, v in enumerate(node))
        else:
            kind, digits = _scalar(node)
            yield place, steps, kind, None, digits


def _documents(text: str | None) -> tuple[list, str | None]:
    """The documents of a text, or why there are none."""
    if not (text or "").strip():
        return [], "no document"
    try:
        return texts.parse(text).documents, None
    except (ValueError, RecursionError):
        return [], "does not parse"


_COUNTS = pa.schema([("steps", pa.list_(pa.string())), ("kind", pa.string()), ("n", pa.int64()), ("digits", pa.int32())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}
    size = 0

    def made() -> pa.RecordBatch:
        columns = [[list(s) for s, _ in held], [k for _, k in held], [n for n, _ in held.values()], [d for _, d in held.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for document in _documents(text)[0]:
                for _, steps, kind, _, digits in _nodes(document):
                    entry = held.get((steps, kind))
                    if entry is None:
                        entry = held[steps, kind] = [0, None]
                        size += len(steps) + 1
                    entry[0] += 1
                    if digits is not None:
                        entry[1] = max(digits, entry[1] or 0)
                    if size > HELD:
                        yield made()
                        held, size = {}, 0
    if held:
        yield made()


def counts(payloads: DataFrame, text_col: str = "text") -> DataFrame:
    """(steps, kind, n, digits) over all nodes of all payload texts, containers and nulls too. Rows of several tables or
    days add up: union them and group again. Texts that are null, blank or do not parse have no nodes."""
    rows = payloads.select(F.col(text_col).alias("text")).mapInArrow(_counted, "steps array<string>, kind string, n long, digits int")
    return merged(rows)


def merged(some: DataFrame) -> DataFrame:
    """Counts of several sources as one."""
    return some.groupBy("steps", "kind").agg(F.sum("n").alias("n"), F.max("digits").alias("digits"))


def _holder(steps: Column) -> Column:
    return F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0)))


def norm_path(steps: Column) -> Column:
    """Steps as a normalized path: ``items[].sku``; the root is empty."""
    return F.regexp_replace(F.array_join(steps, ""), r"^\.", "")


def lattice(counted: DataFrame) -> DataFrame:
    """(steps, norm_path, kinds, n, of, optional, digits) of counts(): ``of`` is how many containers could hold the path
    (objects for a field, arrays for an element, documents for the root), so a key is required at any depth if each
    object there has it. An element is never optional."""
    of_kind = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    paths = counted.groupBy("steps").agg(
        F.sum("n").alias("n"), F.max("digits").alias("digits"), F.collect_set("kind").alias("seen"), of_kind("object").alias("objects"), of_kind("array").alias("arrays")
    )  # seen has at most seven kinds
    kinds = F.filter(F.array(*map(F.lit, KINDS)), lambda k: F.array_contains("seen", k) & ~((k == "integer") & F.array_contains("seen", "number")))
    holders = paths.select(F.col("steps").alias("__holder"), "objects", "arrays")
    rows = paths.select("steps", kinds.alias("kinds"), "n", "digits").join(holders, _holder(F.col("steps")) == F.col("__holder"), "left")
    field = F.element_at("steps", -1).startswith(".")
    of = F.when(F.size("steps") == 0, F.col("n")).when(field, F.col("objects")).otherwise(F.col("arrays"))
    optional = F.when(F.size("steps") == 0, F.lit(False)).otherwise(field & (F.col("n") < F.col("objects")))
    return rows.select("steps", norm_path(F.col("steps")).alias("norm_path"), "kinds", "n", of.alias("of"), optional.alias("optional"), "digits")


def declare(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """(steps, norm_path, kinds, optional) from normalized paths and their kinds, ``{"items[].note?": "string|null"}``; a
    question mark makes a path optional. Containers on the way are added, required unless a path names them."""
    out: dict[tuple, tuple] = {}
    for path, kinds in paths.items():
        steps = tuple(p if p == "[]" else f".{p}" for p in re.findall(r"\[\]|[^.\[\]]+", path.removesuffix("?")))
        out[steps] = (kinds.split("|"), path.endswith("?"))
    for steps in list(out):
        for i in range(len(steps)):
            out.setdefault(steps[:i], (["array" if steps[i] == "[]" else "object"], False))
    rows = [(list(s), k, o) for s, (k, o) in out.items()]
    table = spark.createDataFrame(rows, "steps array<string>, kinds array<string>, optional boolean")
    return table.select("steps", norm_path(F.col("steps")).alias("norm_path"), "kinds", "optional")


_ROWS = "path string, steps array<string>, kind string, keys array<string>"


def nodes(payloads: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, path, steps, kind, keys): a row a node of each payload text, with its concrete place; ``keys`` are an
    object's own. A text without a document is one row of no steps (null) whose kind says why. Rows are handed on as
    they are found, so a long text is never one row of many nodes. Ids may be null, repeated and of any type."""
    chosen = payloads.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([chosen.schema["doc_id"], *T.StructType.fromDDL(_ROWS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def made(batch=batch) -> pa.RecordBatch:
                places, (at, *parts) = [f.type for f in _NODES], zip(*held, strict=True)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(parts, places, strict=True))], ["doc_id", *_NODES.names])

            for i, text in enumerate(batch.column(1).to_pylist()):
                documents, problem = _documents(text)
                if problem:
                    held.append((i, "", None, problem, None))
                for k, document in enumerate(documents):
                    head = f"[{k}]" if len(documents) > 1 else ""
                    for place, steps, kind, keys, _ in _nodes(document):
                        whole = head + ("." if head and place and place[0] != "[" else "") + place
                        held.append((i, whole, list(steps), kind, keys))
                        size += len(steps) + 1
                        if size > HELD:
                            yield made()
                            held, size = [], 0
            if held:
                yield made()

    return chosen.mapInArrow(run, schema)


_NODES = pa.schema([("path", pa.string()), ("steps", pa.list_(pa.string())), ("kind", pa.string()), ("keys", pa.list_(pa.string()))])


def validate(payloads: DataFrame, shape: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast: bool | None = None) -> DataFrame:
    """(doc_id, path, problem) of what ``shape`` (steps, kinds, optional) does not allow in each payload text.

    ``missing``: an object at any depth lacks a required key. ``unknown path``: it has a key that the shape has not, unless
    the shape knows no key of it at all. ``wrong kind``: a node is of another kind; nothing below it or below an unknown key
    is reported again. ``no document`` and ``does not parse``: there is nothing to check.

    A container carries its own keys, so one join with the shape's paths decides, and nodes are neither grouped nor sorted
    by document. A small shape (LARGEST, SMALL; counted first) is broadcast; a larger one is joined as a table that has each
    path once for each of the shuffle's partitions, so that a path that all documents have is dealt out."""
    spark = payloads.sparkSession
    children = shape.where(F.size("steps") > 0).where(F.element_at("steps", -1).startswith("."))
    key = F.substring(F.element_at("steps", -1), 2, 1 << 30)
    listed = children.groupBy(_holder(F.col("steps")).alias("__in")).agg(F.collect_set(key).alias("__known"), F.collect_set(F.when(~F.col("optional"), key)).alias("__needed"))
    wanted = shape.select(F.col("steps").alias("__steps"), F.col("kinds").alias("__kinds")).join(listed, F.col("__steps") == F.col("__in"), "left").drop("__in")
    if broadcast is None:
        size = shape.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.array_join("steps", ""))), F.lit(0)).alias("chars")).first()
        broadcast = size.n <= LARGEST and size.chars <= SMALL
    found = nodes(payloads, id_col, text_col)
    if broadcast:
        met = found.join(F.broadcast(wanted), F.col("steps") == F.col("__steps"), "left")
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = found.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "path"), F.lit(parts)).cast("int"))
        wanted = wanted.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = found.join(wanted, (F.col("steps") == F.col("__steps")) & (F.col("__salt") == F.col("__part")), "left")
    none = F.array().cast("array<string>")
    fits = F.array_contains("__kinds", F.col("kind")) | ((F.col("kind") == "integer") & F.array_contains("__kinds", "number"))
    inner = lambda k: F.when(F.col("path") == "", k).otherwise(F.concat("path", F.lit("."), k))
    problems = lambda keys, text: F.transform(keys, lambda k: F.struct(inner(k).alias("path"), F.lit(text).alias("problem")))
    own = lambda text: F.array(F.struct(F.col("path"), text.alias("problem")))
    opened = F.concat(
        problems(F.array_except(F.coalesce("__needed", none), "keys"), "missing"), problems(F.when(F.col("__known").isNull(), none).otherwise(F.array_except("keys", "__known")), "unknown path")
    )
    empty = F.array().cast("array<struct<path:string,problem:string>>")
    wrong = F.when(F.col("steps").isNull(), own(F.col("kind"))).when(F.col("__steps").isNull(), empty).when(~fits, own(F.lit("wrong kind"))).when(F.col("kind") == "object", opened).otherwise(empty)
    return met.select("doc_id", F.explode(wrong).alias("x")).select("doc_id", "x.path", "x.problem")


def tree(shape: DataFrame) -> dict:
    """The nested shape: {"kinds", "optional", "fields", "items", "digits"}, of lattice() or infer_shape()."""
    steps = "steps" in shape.columns
    rows = shape.orderBy("steps" if steps else "norm_path").limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"more than {LARGEST} paths")
    root: dict = {"optional": False} if steps else {"fields": {}, "optional": False}
    for row in rows:
        node = root
        for part in row.steps if steps else [p if p == "[]" else f".{p}" for p in re.findall(r"\[\]|[^.\[\]]+", row.norm_path)]:
            node = node.setdefault("items", {"optional": False}) if part == "[]" else node.setdefault("fields", {}).setdefault(part[1:], {"optional": row.optional})
        node["kinds"], node["optional"] = list(row.kinds) if steps else row.kinds.split("|"), row.optional
        if "digits" in shape.columns:
            node["digits"] = row.digits
    return root


def _kinds(node: dict) -> list[str]:
    """All kinds of a node; leaves alone do not list the containers above them."""
    found = {*node.get("kinds", ()), *(["object"] if "fields" in node else []), *(["array"] if "items" in node else [])}
    return [k for k in KINDS if k in found]


def to_json_schema(node: dict) -> dict:
    """Draft-07; of a path with several kinds each is an alternative, and no value fits two."""

    def one(kind: str) -> dict:
        if kind == "object":
            fields = node.get("fields", {})
            required = [k for k, v in fields.items() if not v["optional"]]
            return {"type": "object", "properties": {k: to_json_schema(v) for k, v in fields.items()}} | ({"required": required} if required else {})
        return {"type": kind} | ({"items": to_json_schema(node["items"])} if kind == "array" and "items" in node else {})

    kinds = [one(k) for k in _kinds(node)]
    return kinds[0] if len(kinds) == 1 else {"oneOf": kinds} if kinds else {}


def _key(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*", name) else json.dumps(name)


def to_typescript(node: dict, name: str = "Root") -> str:
    """An interface, or a type where the root is no plain object."""

    def kind(n: dict, pad: str) -> str:
        def one(k: str) -> str:
            if k == "object":
                inner = "".join(f"{pad}  {_key(f)}{'?' if v['optional'] else ''}: {kind(v, pad + '  ')};\n" for f, v in n.get("fields", {}).items())
                return "{\n" + inner + pad + "}" if inner else "Record<string, unknown>"
            if k == "array":
                inner = kind(n["items"], pad) if "items" in n else "unknown"
                return f"({inner})[]" if len(_kinds(n.get("items", {}))) > 1 else f"{inner}[]"
            return "number" if k == "integer" else k

        return " | ".join(map(one, _kinds(n))) or "unknown"

    plain = _kinds(node) == ["object"] and node.get("fields")
    return f"export interface {name} {kind(node, '')}\n" if plain else f"export type {name} = {kind(node, '')};\n"


def to_zod(node: dict, name: str = "Root") -> str:
    """A zod schema."""

    def kind(n: dict, pad: str) -> str:
        def one(k: str) -> str:
            if k == "object":
                inner = "".join(f"{pad}  {_key(f)}: {kind(v, pad + '  ')}{'.optional()' if v['optional'] else ''},\n" for f, v in n.get("fields", {}).items())
                return "z.object({\n" + inner + pad + "})" if inner else "z.record(z.string(), z.unknown())"
            if k == "array":
                return f"z.array({kind(n['items'], pad) if 'items' in n else 'z.unknown()'})"
            return f"z.{'number' if k == 'integer' else k}()"

        kinds = [one(k) for k in _kinds(n)] or ["z.unknown()"]
        return kinds[0] if len(kinds) == 1 else f"z.union([{', '.join(kinds)}])"

    return f"export const {name} = {kind(node, '')};\n"


def to_struct_type(node: dict) -> T.DataType:
    """The Spark type of a shape: integers as wide as their digits; mixed kinds, integers beyond 38 digits or not written as digits alone, and
    objects and arrays without a known inside become strings, which lose nothing."""
    kinds = [k for k in _kinds(node) if k != "null"]
    if kinds == ["object"] and node.get("fields"):
        return T.StructType([T.StructField(k, to_struct_type(v), True) for k, v in node["fields"].items()])
    if kinds == ["array"] and "items" in node:
        return T.ArrayType(to_struct_type(node["items"]))
    if kinds == ["integer"]:
        digits = node.get("digits") or 0
        return T.LongType() if digits <= 18 else T.DecimalType(38, 0) if digits <= 38 else T.StringType()
    return {"number": T.DoubleType(), "boolean": T.BooleanType()}.get(kinds[0], T.StringType()) if len(kinds) == 1 else T.StringType()
