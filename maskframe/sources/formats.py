"""Recognise and read the text formats that payloads come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskframe.functions.hashing import SEED
from maskframe.functions.paths import masked_name
from maskframe.operators import raw
from maskframe.operators.har import dedupe_files
from maskframe.sources.texts import delimiter_of


def detect_format(text: Column) -> Column:
    """xml, ndjson, json, form, csv or null, in that order of tests."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    lines = F.filter(F.split(trimmed, r"\r?\n"), lambda x: F.trim(x) != "")
    parses = lambda i: F.try_parse_json(F.get(lines, F.lit(i))).isNotNull()
    ndjson = (F.size(lines) >= 2) & F.forall(lines, lambda x: F.trim(x).rlike(r'^[\[{"]')) & parses(0) & parses(1)
    packed = F.regexp_replace(trimmed, r"\s", "")
    base64 = (F.length(packed) > 64) & ~trimmed.contains("&") & packed.rlike(r"^[A-Za-z0-9+/]+={0,2}$")
    rows = F.filter(F.split(trimmed, r"\r?\n"), lambda x: x != "")

    def marks(i: int, mark: str) -> Column:
        bare = F.regexp_replace(F.get(rows, F.lit(i)), '"(?:[^"]|"")*"', "")
        return F.length(bare) - F.length(F.translate(bare, mark, ""))

    csv = F.lit(False)
    for mark in (",", "\t", ";"):
        csv = csv | ((marks(0, mark) >= 1) & (marks(0, mark) == marks(1, mark)))
    return (
        F.when(trimmed == "", F.lit(None).cast("string")).when(trimmed.startswith("<"), "xml").when(trimmed.rlike(r"^[\[{]") & ndjson, "ndjson").when(trimmed.rlike(r"^[\[{]"), "json")
        .when(base64 | trimmed.rlike(r"^[A-Za-z0-9_.\-+%]+="), "form").when((F.size(rows) >= 2) & csv, "csv")
    )


def parse_form(text: Column) -> Column:
    """(k, v) pairs in order; of a repeated key the last value, at its first place."""
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(text, "&"), lambda p: p != ""), lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("k"), plain(F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).alias("v")))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]
    return F.transform(F.array_distinct(F.transform(pairs, lambda p: p["k"])), lambda k: F.struct(k.alias("k"), last(k).alias("v")))


def write_form(pairs: Column) -> Column:
    """Pairs in their order, encoded."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def unwrap_base64(text: Column) -> Column:
    """The text inside a base64 wrapper, or null."""
    packed = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(text, r"(?:^|&)bt_payload=([^&]*)", 1), F.lit("")), text), r"\s|%0A", "")
    return F.try_to_binary(F.regexp_replace(F.regexp_replace(packed, "%2B", "+"), "%2F", "/"), F.lit("base64")).cast("string")


def read_ndjson(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Lines as rows; what does not parse is kept in ``_corrupt_record``."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def read_csv_export(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All strings; short rows are padded with empty strings. Without a delimiter the header's decides."""
    if delimiter is None:
        first = spark.read.text(path).limit(1).first()
        delimiter = delimiter_of(first.value if first else "")
    df = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Attributes as ``@_name``, text as ``#text``."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@_").option("valueTag", "#text").option("inferSchema", False).load(path)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, text) of the files in a folder; of files equal in name and size the first by path stays."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("content").cast("string").alias("text"))
    return dedupe_files(files, "path").select("name", "size", "text")


def mask_batch(files: DataFrame, seed: str = SEED, consistent: bool = True, rules: DataFrame | None = None) -> DataFrame:
    """(name, size, text, error, masked_name) of read_batch(): each file by itself, so that an error stays with its
    file. Seeds are shared, or one a file if not ``consistent``."""
    used = seed if consistent else F.concat(F.lit(seed), F.lit("\x01"), F.col("name"))
    return raw.mask(files, seed=used, rules=rules).withColumn("masked_name", masked_name(F.col("name")))
