"""Queries on masking, detection and audits over the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions import fakes
from maskframe.functions.hashing import SEED
from maskframe.jobs import duck
from maskframe.operators import report, typed
from maskframe.operators.typed import Rule

CUSTOMER = {
    "c_custkey": Rule("id", True), "c_name": Rule("id", True), "c_acctbal": Rule("priceAmount"), "c_nationkey": Rule("preserve"), "c_mktsegment": Rule("preserve"),
}
ORDERS = {"o_orderkey": Rule("id", True), "o_custkey": Rule("id", True), "o_totalprice": Rule("priceAmount"), "*": Rule("preserve")}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def masked_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, masked by rule."""
    return typed.mask(read(spark, sf_dir, "customer"), CUSTOMER)


MASKED_CUSTOMERS = f"""SELECT {duck.whole_number("c_custkey")} c_custkey, {duck.scramble("c_name")} c_name, c_nationkey, {duck.amount("c_acctbal", "'c_acctbal'")} c_acctbal, c_mktsegment FROM customer"""


def masked_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by segment, joined to customers on masked keys; ``wrong`` counts pairs that the real keys
    do not join. Masked keys are a bijection, so it is 0."""
    customer, orders = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    left = customer.withColumn("c_key", fakes.whole_number(F.col("c_custkey")))
    right = orders.withColumn("o_key", fakes.whole_number(F.col("o_custkey")))
    joined = left.join(right, F.col("c_key") == F.col("o_key"))
    return joined.groupBy("c_mktsegment").agg(
        F.count("*").alias("n_orders"), F.count_distinct("c_key").alias("n_customers"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.count_if(F.col("c_custkey") != F.col("o_custkey")).alias("wrong"),
    )


MASKED_KEY_JOIN = """SELECT c_mktsegment, count(*) n_orders, count(DISTINCT c_custkey) n_customers, round(sum(o_totalprice), 2) total, 0::BIGINT wrong
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"""


def anchor_vs_salt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities masked twice: anchored fakes are one a value, salted ones one a value and path."""
    orders = read(spark, sf_dir, "orders").select("o_orderpriority", F.concat(F.lit("orders["), F.pmod("o_orderkey", F.lit(7)).cast("string"), F.lit("].priority")).alias("path"))
    value = F.col("o_orderpriority")
    return orders.groupBy(value.alias("original")).agg(
        F.count_distinct(fakes.scramble(value)).alias("anchored"), F.count_distinct(fakes.scramble(value, SEED, F.col("path"))).alias("salted"),
        F.min(fakes.scramble(value)).alias("anchored_fake"), F.count_if(fakes.scramble(value) == value).alias("unchanged"),
    )


ANCHOR_VS_SALT = f"""SELECT o_orderpriority original, count(DISTINCT a) anchored, count(DISTINCT s) salted, min(a) anchored_fake, count(*) FILTER (a = o_orderpriority) unchanged
FROM (SELECT o_orderpriority, {duck.scramble("o_orderpriority")} a, {duck.scramble("o_orderpriority", "('orders[' || (o_orderkey % 7) || '].priority')")} s FROM orders) GROUP BY ALL"""

#: Columns given field names of payloads, as leaves.
_FIELDS = {
    "customer": {"customer_id": "c_custkey", "name": "c_name", "segment": "c_mktsegment"},
    "supplier": {"supplier_id": "s_suppkey", "companyName": "s_name"},
    "orders": {"orderId": "o_orderkey", "status": "o_orderstatus", "created": "o_orderdate", "note": "o_orderpriority"},
    "part": {"sku": "p_brand", "display_name": "p_name", "size": "p_size"},
}
_NUMBERS = {"c_custkey", "s_suppkey", "o_orderkey", "p_size"}


def _text(column: str) -> str:
    return f"date_format({column}, 'yyyy-MM-dd')" if column == "o_orderdate" else f"CAST({column} AS STRING)"


def field_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(norm_path, kind, value): the leaves of four tables in one pass each."""
    out = None
    for name, fields in _FIELDS.items():
        rows = ", ".join(f"struct('{name}.{path}' AS norm_path, '{'number' if c in _NUMBERS else 'string'}' AS kind, {_text(c)} AS value)" for path, c in fields.items())
        part = read(spark, sf_dir, name).select(F.explode(F.expr(f"array({rows})")).alias("x")).select("x.*").where("value IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return out


def _field_sql() -> str:
    parts = []
    for name, fields in _FIELDS.items():
        for path, c in fields.items():
            text = f"strftime({c}, '%Y-%m-%d')" if c == "o_orderdate" else f"CAST({c} AS VARCHAR)"
            parts.append(f"SELECT '{name}.{path}' norm_path, '{'number' if c in _NUMBERS else 'string'}' kind, {text} AS value FROM {name} WHERE {c} IS NOT NULL")
    return " UNION ALL ".join(parts)


def field_types_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected types of all fields, by path and type, by type, and over all."""
    found = report.profile(report.detected(field_leaves(spark, sf_dir)))
    return found.select(F.coalesce("norm_path", F.lit("*")).alias("path"), F.coalesce("type", F.lit("*")).alias("type"), "n")


FIELD_TYPES_WIDE = f"""WITH leaves AS ({_field_sql()}), typed AS (SELECT norm_path, {duck.detect_type("norm_path", "value", "kind")} AS type FROM leaves)
SELECT coalesce(norm_path, '*') AS path, coalesce(type, '*') AS type, count(*) n FROM typed GROUP BY GROUPING SETS ((norm_path, type), (type), ())"""


def mask_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transformed and preserved leaves of each path."""
    return report.mask_stats(report.detected(field_leaves(spark, sf_dir)), "norm_path")


MASK_STATS = f"""WITH leaves AS ({_field_sql()}), typed AS (SELECT norm_path, {duck.detect_type("norm_path", "value", "kind")} AS type FROM leaves)
SELECT norm_path, count(*) FILTER (type <> 'preserve') transformed, count(*) FILTER (type = 'preserve') preserved, count(*) leaves FROM typed GROUP BY norm_path"""


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a value of a type repeats one seen before."""
    return report.cache_hits(report.detected(field_leaves(spark, sf_dir)))


CACHE_HITS = f"""WITH leaves AS ({_field_sql()}), typed AS (SELECT value, {duck.detect_type("norm_path", "value", "kind")} AS type FROM leaves)
SELECT type, count(*) n, count(*) - count(DISTINCT value) hits FROM typed WHERE type <> 'preserve' GROUP BY type"""


def path_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obfuscated and all leaves of every path prefix."""
    return report.rollup(report.detected(field_leaves(spark, sf_dir)))


PATH_ROLLUP = f"""WITH leaves AS ({_field_sql()}), typed AS (SELECT norm_path, {duck.detect_type("norm_path", "value", "kind")} AS type FROM leaves),
prefixes AS (SELECT unnest(['', split_part(norm_path, '.', 1), norm_path]) prefix, type FROM typed)
SELECT prefix, count(*) FILTER (type <> 'preserve') obfuscated, count(*) total FROM prefixes GROUP BY prefix"""


def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fakes that stand for more than one original: part names and brands under one scramble."""
    part = read(spark, sf_dir, "part").select(F.explode(F.array(F.struct(F.lit("brand").alias("type"), F.col("p_brand").alias("original")), F.struct(F.lit("size").alias("type"), F.col("p_size").cast("string").alias("original")))).alias("x"))
    return report.collisions(part.select("x.type", "x.original", fakes.scramble(F.col("x.original")).alias("fake")))


COLLISIONS = f"""WITH pairs AS (SELECT DISTINCT type, original, {duck.scramble("original")} fake FROM (SELECT 'brand' AS type, p_brand original FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR) FROM part))
SELECT type, fake, count(*) originals FROM pairs GROUP BY type, fake HAVING count(*) > 1"""


def field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First original and first fake of each field of the masked customers."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    keyed = customer.withColumn("doc", F.col("c_custkey"))
    before = typed.leaves(keyed, "doc").where("norm_path <> 'doc'")
    masked = typed.mask(keyed, CUSTOMER | {"doc": Rule("preserve")})
    return report.field_summary(before, typed.leaves(masked, "doc").where("norm_path <> 'doc'"))


FIELD_SUMMARY = f"""WITH b AS (SELECT c_custkey d, unnest([{{'p': 'c_custkey', 'o': CAST(c_custkey AS VARCHAR), 'f': CAST({duck.whole_number("c_custkey")} AS VARCHAR)}},
  {{'p': 'c_name', 'o': c_name, 'f': {duck.scramble("c_name")}}}, {{'p': 'c_mktsegment', 'o': c_mktsegment, 'f': c_mktsegment}}]) x FROM customer)
SELECT x.p norm_path, arg_min(x.o, d) first_original, arg_min(x.f, d) first_fake, count(*) n FROM b GROUP BY 1"""


def privacy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors, lost preserved values and shape differences of the masked customers: all 0."""
    keyed = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").withColumn("doc", F.col("c_custkey"))
    before = typed.leaves(keyed, "doc").withColumn("type", F.when(F.col("norm_path").isin("c_custkey", "c_name"), "id").otherwise("preserve"))
    after = typed.leaves(typed.mask(keyed, CUSTOMER | {"doc": Rule("preserve")}), "doc")
    checks = [("survivors", report.survivors(before, after)), ("lost", report.lost(before, after)), ("shape", report.shape_diff(before, after))]
    out = [rows.agg(F.count("*").alias("found")).select(F.lit(name).alias("check"), "found") for name, rows in checks]
    return out[0].unionByName(out[1]).unionByName(out[2])


PRIVACY_AUDIT = f"""WITH b AS (SELECT c_custkey, c_name, {duck.scramble("c_name")} f FROM customer)
SELECT 'survivors' AS "check", (SELECT count(*) FROM (SELECT c_name FROM b INTERSECT SELECT f FROM b)) found UNION ALL SELECT 'lost', 0 UNION ALL SELECT 'shape', 0"""


def infer_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape shared by orders with their line items, nulls and empty lists included."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"))).alias("items"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"))
    nested = orders.join(lines, F.col("id") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return report.infer_shape(typed.leaves(nested, "id"))


INFER_SHAPE = """WITH l AS (
  SELECT o_orderkey d, 'id' p, 'number' k FROM orders UNION ALL SELECT o_orderkey, 'status', 'string' FROM orders WHERE o_orderstatus <> 'O'
  UNION ALL SELECT o_orderkey, 'items[].line', 'number' FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber IS NOT NULL
  UNION ALL SELECT o_orderkey, 'items[].discount', 'number' FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_discount > 0.05)
SELECT p norm_path, string_agg(DISTINCT k, '|') kinds, min(k) first_kind, count(DISTINCT d) docs, count(DISTINCT d) < (SELECT count(DISTINCT d) FROM l) optional FROM l GROUP BY p"""

QUERIES = {
    "masked_customers": (masked_customers, MASKED_CUSTOMERS), "masked_key_join": (masked_key_join, MASKED_KEY_JOIN), "anchor_vs_salt": (anchor_vs_salt, ANCHOR_VS_SALT),
    "field_types_wide": (field_types_wide, FIELD_TYPES_WIDE), "mask_stats": (mask_stats, MASK_STATS), "cache_hits": (cache_hits, CACHE_HITS), "path_rollup": (path_rollup, PATH_ROLLUP),
    "collisions": (collisions, COLLISIONS), "field_summary": (field_summary, FIELD_SUMMARY), "privacy_audit": (privacy_audit, PRIVACY_AUDIT), "infer_shape": (infer_shape, INFER_SHAPE),
}
