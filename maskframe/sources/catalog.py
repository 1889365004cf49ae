"""Rule catalogs: endpoints, their signatures and field rules, from YAML folders or from Python."""

from __future__ import annotations

import re
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions.fakes import TYPES
from maskframe.operators.typed import FORBIDDEN

#: A small catalog of our own: endpoint id, path, kind, required and optional paths, rules.
SAMPLE = (
    ("shop/order", "/orders/{id}", None, ("order_id", "customer_id"), ("total",), {"order_id": ("id", True), "customer_id": ("id", True), "total": ("priceAmount", False), "note": ("shortText", False)}),
    ("shop/customer", "/customers/{id}", None, ("customer_id", "name"), ("segment",), {"customer_id": ("id", True), "name": ("fullName", False), "email": ("email", False)}),
    ("hooks/event", "/events", "webhook", ("id", "type"), (), {"id": ("id", False), "*": ("preserve", False)}),
    ("web/en-page", "/en/{page}.html", None, (), (), {}),
    ("web/de-item", "/de/{item}", None, (), (), {}),
    ("web/any-item", "/{lang}/{item}", None, (), (), {}),
)
# ---- Fixed values: names, patterns and sizes of the format ----
MANIFEST = ("id", "name", "category", "icon", "color", "docs")
PROVIDER_ID = r"[a-z0-9][a-z0-9_-]{1,40}"
SLUG = r"[a-z0-9][a-z0-9_-]{0,80}"
COLOUR = r"#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})"
LARGEST_FILE, LARGEST_CATALOG = 200_000, 1_000_000
# ---- End of fixed values ----


def tables(spark: SparkSession, catalog: Iterable[tuple]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """endpoints (endpoint_id, path, kind, rank), signatures (endpoint_id, path, required) and rules
    (endpoint_id, path, type, anchor). The rank is the order given and decides ties."""
    catalog = list(catalog)
    string = pa.string()
    endpoints = [(e[0], e[1], e[2], rank) for rank, e in enumerate(catalog)]
    signatures = [(e[0], path, required) for e in catalog for required, listed in ((True, e[3]), (False, e[4])) for path in listed]
    rules = [(e[0], path, kind, anchor) for e in catalog for path, (kind, anchor) in e[5].items()]

    def table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> DataFrame:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return spark.createDataFrame(pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}))

    return (
        table(endpoints, ["endpoint_id", "path", "kind", "rank"], [string, string, string, pa.int32()]),
        table(signatures, ["endpoint_id", "path", "required"], [string, string, pa.bool_()]),
        table(rules, ["endpoint_id", "path", "type", "anchor"], [string, string, string, pa.bool_()]),
    )


def problems(endpoint: dict) -> list[str]:
    """What is wrong with one endpoint document; nothing if it is fine."""
    found = []
    head, fields = endpoint.get("endpoint") or {}, endpoint.get("fields")
    for key in ("method", "path"):
        if not isinstance(head.get(key), str) or not head[key]:
            found.append(f"endpoint.{key} is missing")
    if not isinstance(fields, dict) or not fields:
        found.append("fields are missing")
        return found
    for path, rule in fields.items():
        if any(part in FORBIDDEN for part in re.split(r"[.\[\]]+", str(path))):
            found.append(f"{path}: forbidden key")
        if not isinstance(rule, dict) or rule.get("type") not in TYPES:
            found.append(f"{path}: unknown type")
        elif not isinstance(rule.get("anchor", False), bool):
            found.append(f"{path}: anchor is no boolean")
    return found


def load_catalog(folder: str) -> tuple[list[tuple], list[str]]:
    """Endpoints below ``folder`` (provider/manifest.yaml, provider/endpoints/*.yaml) in order of provider
    name and path, and warnings; a bad file is left out with one."""
    import yaml

    out, warnings, total = [], [], 0
    for manifest in sorted(Path(folder).glob("*/manifest.y*ml")):
        try:
            provider = yaml.safe_load(manifest.read_text()) or {}
        except yaml.YAMLError as error:
            warnings.append(f"{manifest}: {error}")
            continue
        for file in sorted(manifest.parent.glob("endpoints/*.y*ml")):
            total += file.stat().st_size
            if file.stat().st_size > LARGEST_FILE or total > LARGEST_CATALOG:
                warnings.append(f"{file}: too large")
                continue
            try:
                doc = yaml.safe_load(file.read_text()) or {}
                wrong = problems(doc)
            except (yaml.YAMLError, AttributeError) as error:
                wrong = [str(error)]
            if wrong:
                warnings.append(f"{file}: {'; '.join(wrong)}")
                continue
            head, signature = doc["endpoint"], doc.get("signature") or {}
            rules = {path: (rule["type"], rule.get("anchor", False)) for path, rule in doc["fields"].items()}
            entry = (f"{manifest.parent.name}/{file.stem}", head["path"], head.get("kind"), tuple(signature.get("required_paths") or ()), tuple(signature.get("optional_paths") or ()), rules)
            out.append((str(provider.get("name", manifest.parent.name)), head["path"], entry))
    return [entry for *_, entry in sorted(out, key=lambda x: x[:2])], warnings


def _manifest_problems(doc) -> list[str]:
    if not isinstance(doc, dict):
        return ["no mapping"]
    found = [f"{key}: forbidden key" for key in doc if key in FORBIDDEN]
    found += [f"{key} is missing" for key in MANIFEST if not isinstance(doc.get(key), str) or not doc[key].strip()]
    for key, pattern in (("id", PROVIDER_ID), ("color", COLOUR)):
        if isinstance(doc.get(key), str) and doc[key].strip() and not re.fullmatch(pattern, doc[key] if key == "id" else doc[key].strip()):
            found.append(f"{key} is not well-formed")
    return found


def _endpoint_problems(slug: str, doc) -> list[str]:
    found = [] if re.fullmatch(SLUG, slug) else ["the file's name is no slug"]
    if not isinstance(doc, dict):
        return [*found, "no mapping"]
    head, signature = doc.get("endpoint"), doc.get("signature")
    blocks = {"": doc, "endpoint.": head, "signature.": signature}
    found += [f"{at}{key}: forbidden key" for at, block in blocks.items() if isinstance(block, dict) for key in block if key in FORBIDDEN]
    if signature is not None:
        lists = {key: signature.get(key) for key in ("required_paths", "optional_paths")} if isinstance(signature, dict) else {}
        for key, listed in lists.items():
            if not (key == "optional_paths" and listed is None) and not (isinstance(listed, list) and all(isinstance(path, str) for path in listed)):
                found.append(f"signature.{key} is no list of paths")
        if not lists:
            found.append("signature is no mapping")
    return found + problems({**doc, "endpoint": head if isinstance(head, dict) else {}})


_CHECKED = "provider string, slug string, id string, problems array<string>"


def _checked(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
    import yaml

    for frame in frames:
        rows = []
        for provider, slug, content in zip(frame["provider"], frame["slug"], frame["content"], strict=True):
            try:
                doc = yaml.safe_load(bytes(content).decode())
                found = _manifest_problems(doc) if slug is None else _endpoint_problems(slug, doc)
            except (yaml.YAMLError, ValueError, RecursionError):
                doc, found = None, ["does not parse"]
            own = doc.get("id") if slug is None and isinstance(doc, dict) else None
            rows.append((provider, slug, own if isinstance(own, str) else None, found))
        yield pd.DataFrame(rows, columns=["provider", "slug", "id", "problems"])


def validate_catalog(spark: SparkSession, folder: str, taken: Iterable[str] = ()) -> DataFrame:
    """(provider, slug, problem): everything wrong with the catalog below ``folder``, a row a problem; none if it is fine.

    Of a manifest the slug is null; of the whole catalog the provider too. Files past LARGEST_FILE are refused by their
    size and never read. An id that two manifests have or that is ``taken`` is reported at each of them."""
    path = F.regexp_replace("path", r"\.ya?ml$", "")
    part = lambda i: F.regexp_extract(path, r"/([^/]+)/(?:manifest|endpoints/([^/]+))$", i)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.where(F.col("path").rlike(r"/[^/]+/(manifest|endpoints/[^/]+)\.ya?ml$")).withColumn("provider", part(1)).withColumn("slug", F.nullif(part(2), F.lit("")))
    checked = files.where(F.col("length") <= LARGEST_FILE).select("provider", "slug", "content").mapInPandas(_checked, _CHECKED)
    sizes = files.select("provider", "slug", "length")
    row = lambda df, text: df.select("provider", "slug", F.lit(text).alias("problem"))
    ids = checked.where("slug IS NULL AND id IS NOT NULL").select("provider", "slug", "id")
    twice = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    reserved = spark.createDataFrame([(t,) for t in taken], "id string")
    alone = sizes.where("slug IS NOT NULL").join(sizes.where("slug IS NULL").select("provider"), "provider", "left_anti").select("provider").distinct().withColumn("slug", F.lit(None).cast("string"))
    whole = sizes.agg(F.sum("length").alias("length")).where(F.col("length") > LARGEST_CATALOG).select(F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("slug"))
    out = checked.select("provider", "slug", F.explode("problems").alias("problem"))
    for more in (
        row(sizes.where(F.col("length") > LARGEST_FILE), f"file of over {LARGEST_FILE} bytes"), row(whole, f"files of over {LARGEST_CATALOG} bytes in all"), row(alone, "no manifest"),
        row(ids.join(twice, "id", "left_semi"), "id of two providers"), row(ids.join(reserved, "id", "left_semi"), "id is taken"),
    ):
        out = out.unionByName(more)
    return out


def duplicate_signatures(signatures: DataFrame) -> DataFrame:
    """(required, endpoints): sets of required paths that several endpoints share, whatever their order and repeats; no
    document can tell such endpoints apart but by optional paths. Optional paths alone are no signature."""
    sets = signatures.where("required AND path IS NOT NULL").groupBy("endpoint_id").agg(F.array_sort(F.collect_set("path")).alias("required"))
    return sets.groupBy("required").agg(F.array_sort(F.collect_list("endpoint_id")).alias("endpoints")).where(F.size("endpoints") > 1)


def provider_stats(endpoints: DataFrame, signatures: DataFrame, rules: DataFrame) -> DataFrame:
    """(provider, endpoints, webhooks, unsigned, rules, anchors): the provider is what stands before an endpoint id's first
    slash; ``unsigned`` endpoints have no required path and are found by their URL alone."""
    provider = F.split_part("endpoint_id", F.lit("/"), F.lit(1)).alias("provider")
    signed = signatures.where("required").select("endpoint_id").distinct().withColumn("signed", F.lit(True))
    heads = endpoints.join(signed, "endpoint_id", "left").groupBy(provider).agg(F.count("*").alias("endpoints"), F.count_if(F.col("kind") == "webhook").alias("webhooks"), F.count_if(F.col("signed").isNull()).alias("unsigned"))
    ruled = rules.groupBy(provider).agg(F.count("*").alias("rules"), F.count_if("anchor").alias("anchors"))
    return heads.join(ruled, "provider", "left").na.fill(0, ["rules", "anchors"])
