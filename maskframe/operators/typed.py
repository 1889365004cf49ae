"""The typed lane: mask, flatten and check DataFrames of a known schema.

The schema is walked on the driver and becomes one nested Column a field: no explode, no shuffle, no
Python in the tasks. Arrays and maps are rewritten in place; the path of an element, which salts values
that are not anchored, is built from the lambda's index.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import detect, fakes
from maskframe.functions.hashing import SEED, digest, number

FORBIDDEN = ("__proto__", "constructor", "prototype")
#: A registered generator takes (value, seed, salt) and returns a Column of the value's type.
GENERATORS: dict[str, Callable[[Column, Column | str, Column], Column]] = {}


@dataclass(frozen=True)
class Rule:
    """What happens to a field; an anchored field gets the same fake wherever the value stands."""

    type: str
    anchor: bool = False


def register_generator(kind: str, make: Callable[[Column, Column | str, Column], Column]) -> None:
    """Add or replace the generator of a type."""
    GENERATORS[kind] = make


def _number(kind: str, value: Column, dtype: T.DataType, seed: Column | str, salt: Column) -> Column:
    if kind in ("preserve", "auto"):
        return value
    if isinstance(dtype, T.DecimalType) and not dtype.scale and kind not in ("priceAmount", "unixTimestamp"):
        return fakes.whole_text(value.cast("string"), seed).cast(dtype)
    if kind == "priceAmount" or isinstance(dtype, T.FractionalType):
        return fakes.amount(value.cast("double"), seed, salt).cast(dtype)
    if kind == "unixTimestamp":
        return (value - (number(digest(seed, kind, value, salt)) % 86_400_000 + 1)).cast(dtype)
    return fakes.whole_number(value.cast("long"), seed, top=_TOPS.get(dtype, (1 << 63) - 1)).cast(dtype)


_TOPS = {T.ByteType(): 127, T.ShortType(): 32767, T.IntegerType(): (1 << 31) - 1}


def _detected(path: str, value: Column, seed: Column | str, salt: Column) -> Column:
    """Generic detection of a string: the path's part is settled here, the value's in the tasks."""
    by_path = detect.literal_path_type(path)
    if by_path not in (None, "name"):
        made = fakes.fake("id" if by_path == "handle" else by_path, value, seed, salt, path.rpartition(".")[0])
        looks = detect.id_like_key_value(value, F.lit(True)) if by_path == "id" else F.lit(True)
        return F.when(~detect.is_placeholder(value) & looks, made).otherwise(value)
    tests = (detect.name_tests(value) if by_path else []) + detect.value_tests(value)
    chain = F.when(detect.is_placeholder(value), value)
    for test, kind in tests:
        chain = chain.when(test, fakes.fake(kind, value, seed, salt))
    return chain.otherwise(value)


class _Walk:
    def __init__(self, rules: Mapping[str, Rule], toggles: Mapping[str, bool], values: Mapping[str, str], seed: Column | str, generic: bool):
        self.rules, self.toggles, self.values, self.seed, self.generic = rules, toggles, values, seed, generic

    def column(self, value: Column, dtype: T.DataType, path: str, salt: Column) -> Column:
        if isinstance(dtype, T.StructType):
            inner = F.struct(*(self.column(value[f.name], f.dataType, f"{path}.{f.name}", F.concat(salt, F.lit(f".{f.name}"))).alias(f.name) for f in dtype if f.name not in FORBIDDEN))
            return F.when(value.isNotNull(), inner)
        if isinstance(dtype, T.ArrayType):
            return F.transform(value, lambda x, i: self.column(x, dtype.elementType, f"{path}[]", F.concat(salt, F.lit("["), i.cast("string"), F.lit("]"))))
        if isinstance(dtype, T.MapType):
            kept = F.map_filter(value, lambda k, _: ~k.isin(*FORBIDDEN)) if isinstance(dtype.keyType, T.StringType) else value
            return F.transform_values(kept, lambda k, v: self.column(v, dtype.valueType, f"{path}.*", F.concat(salt, F.lit("."), k.cast("string"))))
        return self.leaf(value, dtype, path, salt)

    def rule(self, path: str) -> Rule | None:
        rule = self.rules.get(path, self.rules.get("*"))
        if self.toggles.get(path) is False:
            return Rule("preserve")
        if self.toggles.get(path) and (rule is None or rule.type == "preserve"):
            return None
        return rule

    def leaf(self, value: Column, dtype: T.DataType, path: str, salt: Column) -> Column:
        if path in self.values:
            return F.when(value.isNotNull(), F.lit(self.values[path]).try_cast(dtype))
        rule = self.rule(path)
        if rule is None and not self.generic and not self.toggles.get(path):
            return value
        kind = rule.type if rule else "auto"
        used = F.lit("") if rule and rule.anchor else salt
        if kind in GENERATORS:
            return GENERATORS[kind](value, self.seed, used)
        if kind == "null":
            return F.lit(None).cast(dtype)
        if isinstance(dtype, T.BooleanType):
            return ~value if kind == "boolean" else value
        if isinstance(dtype, T.NumericType):
            if rule is None:
                made = _number("id", value, dtype, self.seed, used)
                if self.toggles.get(path):
                    return made
                return F.when(value >= 1000, made).otherwise(value) if detect.literal_path_type(path) == "id" else value
            return _number(kind, value, dtype, self.seed, used)
        if isinstance(dtype, T.DateType | T.TimestampType | T.TimestampNTZType):
            if kind in ("preserve", "auto"):
                return value
            days = (number(digest(self.seed, kind, value, used)) % 700 + 1).cast("int")
            return F.date_sub(value, days) if isinstance(dtype, T.DateType) else (value - F.make_dt_interval(days)).cast(dtype)
        if not isinstance(dtype, T.StringType):
            return value
        if rule is None or kind == "auto":
            forced = fakes.fake("id", value, self.seed, used)
            found = _detected(path, value, self.seed, used)
            return F.when(found == value, forced).otherwise(found) if self.toggles.get(path) else found
        return fakes.fake(kind, value, self.seed, used, path.rpartition(".")[0])


def mask(
    df: DataFrame, rules: Mapping[str, Rule] | None = None, toggles: Mapping[str, bool] | None = None, values: Mapping[str, str] | None = None,
    seed: Column | str = SEED, generic: bool = True,
) -> DataFrame:
    """``df`` with the same columns, types and nesting, and masked values.

    A literal (``values``, by path) beats a toggle, a toggle a rule, a rule generic detection; ``"*"`` is
    the rule of all other paths. A literal that cannot be cast to its field is an error here, not a null.
    """
    for path, literal in (values or {}).items():
        field = _field(df.schema, path)
        if field is not None and df.sparkSession.range(1).select(F.lit(literal).try_cast(field).isNull()).first()[0]:
            raise ValueError(f"{literal!r} is no {field.simpleString()} for {path}")
    walk = _Walk(rules or {}, toggles or {}, values or {}, seed, generic)
    return df.select(*(walk.column(F.col(f"`{f.name}`"), f.dataType, f.name, F.lit(f.name)).alias(f.name) for f in df.schema if f.name not in FORBIDDEN))


def _field(schema: T.DataType, path: str) -> T.DataType | None:
    for part in path.replace("[]", ".[]").split("."):
        if part == "[]" and isinstance(schema, T.ArrayType):
            schema = schema.elementType
        elif isinstance(schema, T.StructType) and part in schema.names:
            schema = schema[part].dataType
        else:
            return None
    return schema


def nested_json(value: Column, schema: T.StructType, path: str, rules: Mapping[str, Rule], seed: Column | str = SEED) -> Column:
    """A string that holds a JSON object of ``schema`` is masked inside; other strings stay."""
    parsed = F.from_json(value, schema)
    masked = _Walk(rules, {}, {}, seed, True).column(parsed, schema, path, F.lit(path))
    return F.when(value.rlike(r"^\s*[\[{]") & parsed.isNotNull(), F.to_json(masked)).otherwise(value)


def _leaves(value: Column, dtype: T.DataType, path: str, concrete: Column) -> Column:
    row = lambda kind, text: F.struct(concrete.alias("path"), F.lit(path).alias("norm_path"), F.lit(kind).alias("kind"), text.alias("value"))
    none = F.expr("CAST(array() AS array<struct<path:string,norm_path:string,kind:string,value:string>>)")
    if isinstance(dtype, T.StructType):
        parts = [_leaves(value[f.name], f.dataType, f"{path}.{f.name}", F.concat(concrete, F.lit(f".{f.name}"))) for f in dtype if f.name not in FORBIDDEN]
        return F.concat(*parts) if parts else none
    if isinstance(dtype, T.ArrayType):
        inner = F.transform(value, lambda x, i: _leaves(x, dtype.elementType, f"{path}[]", F.concat(concrete, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.coalesce(F.flatten(inner), none)
    kind = "boolean" if isinstance(dtype, T.BooleanType) else "number" if isinstance(dtype, T.NumericType) else "string"
    return F.when(value.isNull(), none).otherwise(F.array(row(kind, value.cast("string"))))


def leaves(df: DataFrame, id_col: str) -> DataFrame:
    """(doc_id, ord, path, norm_path, kind, value): scalar leaves in document order, nulls left out."""
    parts = [_leaves(F.col(f"`{f.name}`"), f.dataType, f.name, F.lit(f.name)) for f in df.schema if f.name not in FORBIDDEN]
    rows = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.concat(*parts)).alias("ord", "leaf"))
    return rows.select("doc_id", "ord", "leaf.path", "leaf.norm_path", "leaf.kind", "leaf.value")
