"""Match documents to endpoints: by the paths they have, or by URL."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shapes(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, paths array): (doc_id, shape_id) and the distinct (shape_id, paths). Matching is done
    once a shape, of which there are few, not once a document."""
    keyed = paths.withColumn("shape_id", F.md5(F.array_join(F.array_sort("paths"), "\x01").cast("binary")))
    return keyed.select("doc_id", "shape_id"), keyed.groupBy("shape_id").agg(F.any_value("paths").alias("paths"))


def candidates(distinct: DataFrame, signatures: DataFrame, endpoints: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(shape_id, endpoint_id, ratio, score) of endpoints whose required paths are there to ``threshold``.

    signatures: (endpoint_id, path, required); endpoints without required paths never match. The score
    is ratio + 0.1 a present optional path's share + 0.001 a required path.
    """
    required = signatures.groupBy("endpoint_id").agg(F.count_if("required").alias("n_required"), F.count_if(~F.col("required")).alias("n_optional")).where("n_required > 0")
    present = distinct.select("shape_id", F.explode(F.array_distinct("paths")).alias("path")).join(signatures, "path")
    met = present.groupBy("shape_id", "endpoint_id").agg(F.count_if("required").alias("met"), F.count_if(~F.col("required")).alias("extra")).join(required, "endpoint_id")
    ratio = F.col("met") / F.col("n_required")
    extra = F.when(F.col("n_optional") > 0, F.col("extra") / F.col("n_optional")).otherwise(0.0)
    scored = met.select("shape_id", "endpoint_id", ratio.alias("ratio"), (ratio + 0.1 * extra + 0.001 * F.col("n_required")).alias("score"))
    return scored.where(F.col("ratio") >= threshold).join(endpoints.select("endpoint_id", "rank"), "endpoint_id")


def best(found: DataFrame, key: str = "shape_id") -> DataFrame:
    """The best candidate of each key; ties go to the first in catalog order."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "rank")
    return found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def match_signature(paths: DataFrame, signatures: DataFrame, endpoints: DataFrame, threshold: float = 1.0) -> DataFrame:
    """(doc_id, shape_id, endpoint_id, score); documents without a match keep nulls."""
    docs, distinct = shapes(paths)
    won = best(candidates(distinct, signatures, endpoints, threshold)).select("shape_id", "endpoint_id", "score")
    return docs.join(won, "shape_id", "left")


def template_pattern(template: Column) -> Column:
    """A path template as a pattern: ``{x}`` is one segment; it must end the path and begin at a slash."""
    literal = F.regexp_replace(template, r"([.\\+*?\[\]^$()|])", r"\\$1")
    return F.concat(F.lit("(^|/)"), F.regexp_replace(F.regexp_replace(literal, r"\{[^}]*\}", "[^/]+"), "^/", ""), F.lit(r"/?($|\?)"))


_VARIABLE = "\x01"


def _shaped(template: Column) -> tuple[Column, Column]:
    """(shape, key) of a template: which of its segments hold a variable (``lvl``), and its other segments in their places."""
    parts = F.split(F.regexp_replace(F.regexp_replace(template, r"\{[^}]*\}", _VARIABLE), "^/", ""), "/")
    held = lambda x: x.contains(_VARIABLE)
    return F.array_join(F.transform(parts, lambda x: F.when(held(x), "v").otherwise("l")), ""), F.array_join(F.transform(parts, lambda x: F.when(held(x), "").otherwise(x)), "/")


def _keys(path: Column, shapes: list[str]) -> Column:
    """(shape, key) of all ends of a path that a template of these shapes could fit: up to its end, each question mark or a
    final line break, with and without a last slash."""
    asked = F.split(path, r"\?")
    cut = F.transform(F.sequence(F.lit(1), F.size(asked)), lambda i: F.array_join(F.slice(asked, F.lit(1), i), "?"))
    cut = F.concat(cut, F.array(F.regexp_replace(path, r"(\r\n|[\n\r\x{85}\x{2028}\x{2029}])$", "")))
    ends = F.transform(F.array_distinct(F.flatten(F.transform(cut, lambda x: F.array(x, F.regexp_replace(x, "/$", ""))))), lambda x: F.split(x, "/"))

    def keyed(parts: Column) -> Column:
        found = []
        for shape in shapes:
            places = [F.get(parts, F.size(parts) - len(shape) + i) if of == "l" else F.lit("") for i, of in enumerate(shape)]
            found.append(F.when(F.size(parts) >= len(shape), F.struct(F.lit(shape).alias("shape"), F.concat_ws("/", *places).alias("key"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    return F.array_distinct(F.flatten(F.transform(ends, keyed)))


def match_url(urls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(path, endpoint_id) of the distinct ``path`` values: the first endpoint in catalog order whose template fits, webhooks left
    out; a null path has none.

    Templates are joined on their literal segments in their places: a path has a key for each shape of template (which
    segments are variables; a catalog has few, and only they are brought to the driver) and each place where it may end, and what
    meets is tested by pattern. The one shuffle is by path; any number of templates takes the same plan."""
    shape, key = _shaped(F.col("path"))
    usable = endpoints.where("(kind IS NULL OR kind <> 'webhook') AND path IS NOT NULL").select(F.struct("rank", "endpoint_id").alias("__first"), template_pattern(F.col("path")).alias("__pattern"), shape.alias("__shape"), key.alias("__key"))
    shapes = sorted(row[0] for row in usable.select("__shape").distinct().collect())
    paths = urls.select("path").distinct()
    if not shapes:
        return paths.withColumn("endpoint_id", F.lit(None).cast("string"))
    keyed = paths.select("path", F.explode_outer(_keys(F.col("path"), shapes)).alias("k"))
    fits = (F.col("k.shape") == F.col("__shape")) & (F.col("k.key") == F.col("__key")) & F.rlike("path", F.col("__pattern"))
    met = keyed.join(usable, fits, "left").groupBy("path").agg(F.min("__first").alias("__first"))
    return met.select("path", F.col("__first.endpoint_id").alias("endpoint_id"))


def attach_rules(leaves: DataFrame, rules: DataFrame) -> DataFrame:
    """``leaves`` (with endpoint_id) with the rule of their path, else the endpoint's ``*``."""
    exact = rules.where("path <> '*'").select(F.col("endpoint_id").alias("e"), F.col("path").alias("p"), F.col("type").alias("t"), F.col("anchor").alias("a"))
    star = rules.where("path = '*'").select(F.col("endpoint_id").alias("se"), F.col("type").alias("st"), F.col("anchor").alias("sa"))
    joined = leaves.join(exact, (F.col("endpoint_id") == F.col("e")) & (F.col("norm_path") == F.col("p")), "left").join(star, F.col("endpoint_id") == F.col("se"), "left")
    return joined.select(*leaves.columns, F.coalesce("t", "st").alias("rule_type"), F.coalesce("a", "sa", F.lit(False)).alias("anchor"))


def unused_rules(rules: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rules whose path never occurs under their endpoint."""
    seen = leaves.select("endpoint_id", F.col("norm_path").alias("path")).distinct()
    return rules.where("path <> '*'").join(seen, ["endpoint_id", "path"], "left_anti")


def unmatched(docs: DataFrame, matched: DataFrame) -> DataFrame:
    """Documents that no endpoint matches."""
    return docs.join(matched.where("endpoint_id IS NOT NULL").select("doc_id"), "doc_id", "left_anti")


def covered_docs(docs: DataFrame, paths: DataFrame, signatures: DataFrame, endpoint_id: str) -> DataFrame:
    """The rows of ``docs`` whose paths (doc_id, paths) have all that the signature of an endpoint requires."""
    wanted = signatures.where((F.col("endpoint_id") == endpoint_id) & F.col("required")).select("path").distinct()
    need = wanted.agg(F.count("*")).first()[0]
    met = paths.select("doc_id", F.explode(F.array_distinct("paths")).alias("path")).join(wanted, "path").groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(met.where(F.col("n") == need) if need else met.limit(0), "doc_id", "left_semi")


def resolve_endpoint(docs: DataFrame, by_url: DataFrame, by_signature: DataFrame) -> DataFrame:
    """(doc_id, endpoint_id, how): the endpoint that a document names itself (``endpoint_id`` of docs), else that of
    its URL's path (docs.url_path; by_url as of match_url()), else the one its paths match, else none."""
    url = by_url.select(F.col("path").alias("url_path"), F.col("endpoint_id").alias("u"))
    signed = by_signature.select("doc_id", F.col("endpoint_id").alias("s"))
    joined = docs.join(url, "url_path", "left").join(signed, "doc_id", "left")
    how = F.when(F.col("endpoint_id").isNotNull(), "explicit").when(F.col("u").isNotNull(), "url").when(F.col("s").isNotNull(), "signature").otherwise("none")
    return joined.select("doc_id", F.coalesce("endpoint_id", "u", "s").alias("endpoint_id"), how.alias("how"))


#: What a sample's field holds, by the type of its rule; all other types hold a text of their own.
_HELD = {"boolean": True, "priceAmount": 4242.42, "null": None}


def _sample(fields: list[tuple[str, str | None]]) -> str:
    """One document with a value at each path; a path that others go through is a container."""
    root: dict = {}
    for number, (path, kind) in enumerate(sorted(fields, key=lambda f: (f[0], f[1] or ""))):
        node = root
        for part in re.findall(r"\[\]|[^.\[\]]+", path):
            node = node.setdefault(part, {})
        inner = f"sample{number}@example.test"
        node.setdefault("", json.dumps({"email": inner}) if kind == "nestedJson" else _HELD.get(kind, f"Sample{number}Zqx"))

    def built(node: dict):
        if not node.keys() - {""}:
            return node.get("")
        items = [built(node["[]"])] if "[]" in node else None
        fields = {k: built(v) for k, v in node.items() if k not in ("", "[]")}
        return items if items is not None and not fields else fields

    return json.dumps(built(root) if root else {})


def sample_documents(rules: DataFrame, signatures: DataFrame) -> DataFrame:
    """(endpoint_id, text): a JSON document an endpoint with every path of its rules and of its signature, required or
    optional, assembled along the trie of the paths. The catalog's own test is that each is matched to its endpoint and is
    changed by masking. An endpoint without paths has none; rows without an endpoint or a path are left out; of repeated
    paths the least type counts."""
    listed = rules.where("path <> '*'").select("endpoint_id", "path", "type").unionByName(signatures.select("endpoint_id", "path", F.lit(None).cast("string").alias("type")))
    fields = listed.where("endpoint_id IS NOT NULL AND path IS NOT NULL").groupBy("endpoint_id", "path").agg(F.min("type").alias("type"))

    @F.pandas_udf("string")
    def made(rows: pd.Series) -> pd.Series:
        return rows.map(lambda fields: _sample([(f["path"], f["type"]) for f in fields]))

    return fields.groupBy("endpoint_id").agg(F.collect_list(F.struct("path", "type")).alias("fields")).select("endpoint_id", made("fields").alias("text"))  # an endpoint's rules


def samples(rules: DataFrame, signatures: DataFrame) -> DataFrame:
    """(endpoint_id, paths): the paths of a document that conforms to an endpoint, from its rules and signature; the
    catalog's own test is that each matches itself."""
    listed = rules.where("path <> '*'").select("endpoint_id", "path").union(signatures.where("required").select("endpoint_id", "path"))
    return listed.groupBy("endpoint_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))
