"""Queries on network logs, free text, payloads and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskframe.functions import detect, fakes, network, paths
from maskframe.jobs import duck
from maskframe.jobs.masking import read
from maskframe.operators import har, matching, report, typed
from maskframe.sources import catalog, formats

#: A log entry an event: (section, name, value) as SQL that Spark and DuckDB share.
_VALUES = (
    ("header", "'accept'", "'*/*'"),
    ("header", "'Authorization'", "concat('Bearer ', md5(CAST(user_id AS STRING)))"),
    ("header", "'X-Request-Id'", "CAST(event_id AS STRING)"),
    ("header", "'Referer'", "concat(url, CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'access_token=', md5(CAST(user_id % 20 AS STRING)), '#top')"),
    ("cookie", "'theme'", "'dark'"),
    ("cookie", "'session_id'", "md5(concat('s', CAST(user_id AS STRING)))"),
    ("param", "'page'", "CAST(event_id % 5 AS STRING)"),
    ("param", "'clientSecret'", "concat('k', CAST(user_id AS STRING))"),
    ("param", "'au'", "md5(CAST(event_id % 50 AS STRING))"),
    ("ip", "'serverIPAddress'", "concat(CASE WHEN event_id % 3 = 0 THEN '10.0.0.' ELSE '93.184.216.' END, CAST(event_id % 200 AS STRING))"),
)
_ENTRY = ("CAST(event_id % 10 AS STRING)", "event_id", "upper(event_type)")


def _exploded(joined: DataFrame) -> DataFrame:
    rows = ", ".join(f"struct('{s}' AS section, {n} AS name, {v} AS value)" for s, n, v in _VALUES)
    har_id, entry, method = _ENTRY
    return joined.select(F.expr(har_id).alias("har_id"), F.expr(entry).alias("entry"), F.expr(method).alias("method"), "url", F.explode(F.expr(f"array({rows})")).alias("x")).select(
        "har_id", "entry", "x.section", "x.name", "x.value", "method", "url"
    )


def shared(spark: SparkSession) -> str:
    """A folder that executors share."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def log_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(har_id, entry, section, name, value, method, url) of a log with an entry an event. Events are spread over all
    rows of pages by their place in the order of page_id and url: places within ranges of the order, and before each range the rows of those below it (a row a range).
    Ranges are written once, as their bounds come from a sample and may differ from one evaluation to the next."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    order = [F.asc_nulls_first("page_id"), F.asc_nulls_first("url")]
    folder = f"{shared(spark)}/maskframe/pages-{uuid.uuid4().hex}"
    pages.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).write.parquet(folder)
    ranged = spark.read.parquet(folder)
    within = ranged.withColumn("within", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    sizes = within.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select(F.col("part").alias("of"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    numbered = within.join(before, F.col("part") == F.col("of")).select(F.split_part("url", F.lit("#"), F.lit(1)).alias("url"), (F.col("before") + F.col("within")).alias("place"))
    events = read(spark, sf_dir, "events").withColumn("place", F.expr(f"pmod(event_id, nullif({ranged.count()}L, 0L))"))
    return _exploded(events.join(numbered, "place"))


#: The name that tests know it by.
all_pages_log = log_values

_LOG = "log AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT {_ENTRY[0]} har_id, {_ENTRY[1]} entry, '{s}' section, {n} AS name, {v} AS value FROM joined" for s, n, v in _VALUES
) + ")"
_JOINED = """joined AS (SELECT e.*, split_part(url, '#', 1) url
  FROM (SELECT *, (event_id % n + n) % n place FROM events, (SELECT count(*) n FROM pages)) e
  JOIN (SELECT url, row_number() OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST) - 1 place FROM pages) USING (place))"""
_DISTINCT = f"""kinds AS MATERIALIZED (SELECT section, name, value, count(*) n, min(entry) first_entry FROM log WHERE value <> '' GROUP BY ALL),
judged AS MATERIALIZED (SELECT *, {duck.target_key("section", "name", "value")} target_key, {duck.default_redact("section", "name", "value")} redact FROM kinds)"""


def har_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every redaction target of the log."""
    return har.targets(log_values(spark, sf_dir))


HAR_TARGETS = f"""WITH {_JOINED}, {_LOG}, {_DISTINCT}
SELECT target_key, section, name, value original, CASE WHEN redact THEN {duck.replacement("section", "name", "value")} ELSE value END replacement, redact, n occurrences, first_entry FROM judged"""


def har_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 entries of each target."""
    return har.locations(log_values(spark, sf_dir))


HAR_LOCATIONS = f"""WITH {_JOINED}, {_LOG}
SELECT * FROM (SELECT target_key, har_id, entry, row_number() OVER (PARTITION BY target_key ORDER BY har_id, entry) n
  FROM (SELECT DISTINCT {duck.target_key("section", "name", "value")} target_key, har_id, entry FROM log WHERE value <> '')) WHERE n <= 20"""


def har_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and redactions of each log."""
    return har.stats(log_values(spark, sf_dir))


HAR_STATS = f"""WITH {_JOINED}, {_LOG}, {_DISTINCT}
SELECT har_id, count(DISTINCT entry) entries, {", ".join(f"count(*) FILTER (redact AND log.section = '{s}') {s}s_redacted" for s in ("header", "cookie", "param", "ip"))}
FROM log JOIN judged USING (section, name, value) GROUP BY har_id"""


def har_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets by policy category."""
    return har.category_counts(har.targets(log_values(spark, sf_dir)))


HAR_CATEGORIES = f"""WITH {_JOINED}, {_LOG}, {_DISTINCT}
SELECT CASE section WHEN 'header' THEN 'headers' WHEN 'cookie' THEN 'headers' WHEN 'param' THEN 'params' ELSE 'ips' END category, count(*) targets,
  count(*) FILTER (redact) redacted, sum(n)::BIGINT occurrences FROM judged GROUP BY 1"""


def har_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by section, those with something flagged first."""
    return har.top_groups(har.targets(log_values(spark, sf_dir)))


HAR_TOP_GROUPS = f"""WITH {_JOINED}, {_LOG}, {_DISTINCT},
g AS (SELECT section, lower(name) AS name, count(*) n, count(*) FILTER (redact) flagged FROM judged GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY flagged > 0 DESC, name) place FROM g) WHERE place <= 250"""


def har_value_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of the log as a reviewer sees them, by group."""
    return har.value_tree(har.targets(log_values(spark, sf_dir)), untouched=True)


HAR_VALUE_TREE = f"""WITH {_JOINED}, {_LOG}, {_DISTINCT},
t AS (SELECT *, CASE WHEN section = 'header' THEN lower(name) ELSE name END g FROM judged),
g AS (SELECT section, g, row_number() OVER (PARTITION BY section ORDER BY bool_or(redact) DESC, any_value(name), g) place FROM t GROUP BY section, g),
v AS (SELECT *, row_number() OVER (PARTITION BY section, g ORDER BY first_entry, value, target_key) value_place FROM t)
SELECT section, name, place::INTEGER place, value_place::INTEGER value_place, target_key, value original, CASE WHEN redact THEN {duck.replacement("section", "name", "value")} ELSE value END replacement, redact, n occurrences
FROM v JOIN g USING (section, g) WHERE place <= 250 AND value_place <= 100"""


def url_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls with a secret parameter added to some: whether they hold secrets, redacted, and short."""
    url = F.concat("url", F.expr("CASE WHEN page_id % 2 = 0 AND url NOT LIKE '%#%' THEN concat(CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'sig=', md5(url)) ELSE '' END"))
    pages = read(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return pages.select("page_id", network.url_has_secrets(F.col("url")).alias("secret"), network.redact_url(F.col("url")).alias("redacted"), network.short_url(F.col("url")).alias("short"))


URL_REDACT = f"""WITH p AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 AND url NOT LIKE '%#%' THEN (CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END) || 'sig=' || md5(url) ELSE '' END AS url FROM pages)
SELECT page_id, {duck.url_has_secrets("url")} secret, {duck.redact_url("url")} redacted, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^?#]*)', 1) short FROM p"""


def url_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the endpoint whose template fits their path."""
    endpoints, _, _ = catalog.tables(spark, catalog.SAMPLE)
    urls = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1).alias("path"))
    found = matching.match_url(urls, endpoints)
    return urls.join(found, "path").groupBy(F.coalesce("endpoint_id", F.lit("none")).alias("endpoint_id")).agg(F.count("*").alias("n"))


URL_MATCH = """WITH u AS (SELECT regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) p FROM pages)
SELECT CASE WHEN regexp_matches(p, '(^|/)en/[^/]+\\.html/?($|\\?)') THEN 'web/en-page' WHEN regexp_matches(p, '(^|/)de/[^/]+/?($|\\?)') THEN 'web/de-item'
  WHEN regexp_matches(p, '(^|/)[^/]+/[^/]+/?($|\\?)') THEN 'web/any-item' ELSE 'none' END endpoint_id, count(*) n FROM u GROUP BY 1"""


def token_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the blank-separated tokens of all texts, by source: how many and how many distinct.
    Tokens are counted by (source, token) first: detection runs once a distinct token."""
    tokens = read(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "[ \n\t\r]+")).alias("token")).where("token <> ''")
    counted = tokens.groupBy("source", "token").agg(F.count("*").alias("n"))
    found = counted.withColumn("type", detect.value_type(F.col("token"))).where("type <> 'preserve'")
    return found.groupBy("source", "type").agg(F.sum("n").alias("n"), F.count("*").alias("distinct_tokens"))


TOKEN_PII = f"""WITH t AS (SELECT source, unnest(string_split_regex(text, '[ \\n\\t\\r]+')) AS tok FROM documents), c AS (SELECT source, tok, count(*) n FROM t WHERE tok <> '' GROUP BY ALL),
d AS (SELECT source, tok, n, {duck.value_type("tok")} AS type FROM c)
SELECT source, type, sum(n)::BIGINT n, count(*) distinct_tokens FROM d WHERE type <> 'preserve' GROUP BY ALL"""


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested JSON of events, masked inside: by event type, rows, changed rows, and the least text."""
    events = read(spark, sf_dir, "events")
    masked = typed.nested_json(F.col("props"), typed.T.StructType([typed.T.StructField("k", typed.T.LongType())]), "props", {"props.k": typed.Rule("id", True)})
    return events.select("event_type", "props", masked.alias("masked")).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("masked") != F.col("props")).alias("changed"), F.min("masked").alias("least"))


EVENT_PROPS = f"""WITH e AS (SELECT event_type, props, CAST(json_extract(props, '$.k') AS BIGINT) k FROM events),
m AS (SELECT event_type, props, '{{"k":' || ({duck.whole_number("k")}) || '}}' masked FROM e)
SELECT event_type, count(*) n, count(*) FILTER (masked <> props) changed, min(masked) least FROM m GROUP BY event_type"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): orders, customers, events and parts as JSON objects."""
    parts = {
        "orders": F.struct(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("total")),
        "customer": F.struct(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        "events": F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("props").alias("data")),
        "part": F.struct(F.col("p_partkey").alias("sku"), F.col("p_size").alias("size")),
    }
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id", "part": "p_partkey"}
    out = None
    for name, row in parts.items():
        part = read(spark, sf_dir, name).select(F.concat(F.lit(f"{name}-"), F.col(keys[name]).cast("string")).alias("doc_id"), F.to_json(row).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def match_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the endpoint that their paths match best; unmatched ones as ``none``."""
    endpoints, signatures, _ = catalog.tables(spark, catalog.SAMPLE)
    docs = _payloads(spark, sf_dir).select("doc_id", F.json_object_keys("text").alias("paths"))
    found = matching.match_signature(docs, signatures, endpoints)
    return found.groupBy(F.coalesce("endpoint_id", F.lit("none")).alias("endpoint_id")).agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("score"))


MATCH_PAYLOADS = """SELECT 'shop/order' endpoint_id, count(*) n, 1.102 score FROM orders UNION ALL SELECT 'shop/customer', count(*), 1.102 FROM customer
UNION ALL SELECT 'hooks/event', count(*), 1.002 FROM events UNION ALL SELECT 'none', count(*), NULL FROM part"""


def unused_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the sample catalog whose path no document has."""
    endpoints, signatures, rules = catalog.tables(spark, catalog.SAMPLE)
    docs = _payloads(spark, sf_dir).select("doc_id", F.json_object_keys("text").alias("paths"))
    found = matching.match_signature(docs, signatures, endpoints)
    leaves = found.join(docs, "doc_id").select("endpoint_id", F.explode("paths").alias("norm_path"))
    return matching.unused_rules(rules, leaves).select("endpoint_id", "path", "type")


UNUSED_RULES = "SELECT 'shop/customer' endpoint_id, 'email' path, 'email' AS type UNION ALL SELECT 'shop/order', 'note', 'shortText'"


def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by type with anchors, and how many leaves of the payload tables they cover."""
    _, _, rules = catalog.tables(spark, catalog.SAMPLE)
    keys = _payloads(spark, sf_dir).select(F.explode(F.json_object_keys("text")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    found = rules.where("path <> '*'").join(keys, "path", "left")
    return found.groupBy("type").agg(F.count("*").alias("rules"), F.count_if("anchor").alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("leaves"))


CATALOG_STATS = """WITH n AS (SELECT (SELECT count(*) FROM orders) o, (SELECT count(*) FROM customer) c, (SELECT count(*) FROM events) e)
SELECT 'id' AS type, 4::BIGINT rules, 3::BIGINT anchors, o + 2 * (o + c) + e leaves FROM n UNION ALL SELECT 'fullName', 1, 0, c FROM n UNION ALL SELECT 'priceAmount', 1, 0, o FROM n
UNION ALL SELECT 'email', 1, 0, 0 UNION ALL SELECT 'shortText', 1, 0, 0"""


def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats of texts made of the tables: JSON, NDJSON, CSV, form, XML, and prose of documents."""
    j = F.to_json(F.struct("c_custkey", "c_name"))
    made = [
        ("json", j), ("ndjson", F.concat(j, F.lit("\n"), j)), ("csv", F.concat(F.lit("id,name\n"), F.col("c_custkey").cast("string"), F.lit(',"a, b"'))),
        ("form", F.concat(F.lit("name="), F.col("c_name"), F.lit("&id=1"))), ("xml", F.concat(F.lit("  <c>"), F.col("c_name"), F.lit("</c>"))), ("blank", F.lit(" \n ")),
    ]
    texts = read(spark, sf_dir, "customer").select(F.explode(F.array(*(F.struct(F.lit(k).alias("made"), v.alias("text")) for k, v in made))).alias("x")).select("x.*")
    pages = read(spark, sf_dir, "pages").select(F.lit("page").alias("made"), F.col("html").alias("text"))
    found = texts.unionByName(pages).select("made", formats.detect_format(F.col("text")).alias("format"))
    return found.groupBy("made", F.coalesce("format", F.lit("none")).alias("format")).agg(F.count("*").alias("n"))


FORMAT_DETECT = """SELECT made, format, count(*) n FROM customer, (VALUES ('json', 'json'), ('ndjson', 'ndjson'), ('csv', 'csv'), ('form', 'form'), ('xml', 'xml'), ('blank', 'none')) t(made, format) GROUP BY ALL
UNION ALL SELECT 'page', CASE WHEN trim(html) LIKE '<%' THEN 'xml' ELSE 'other' END, count(*) FROM pages GROUP BY ALL"""


def dedupe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as files: the first of each (role, length), with its masked name."""
    files = read(spark, sf_dir, "conversations").select(F.concat("role", F.lit(".json")).alias("name"), F.length("text").alias("size"), "conv_id", "turn")
    first = har.dedupe_files(files, "conv_id", "turn")
    return first.select("name", paths.masked_name(F.col("name")).alias("masked"), F.col("size").cast("long").alias("size"), "conv_id", "turn", har.size_gate(F.col("size"), 100, 300).alias("gate"))


DEDUPE_FILES = """SELECT name, role || '.obfuscated.json' masked, size, conv_id, turn, CASE WHEN size > 300 THEN 'refuse' WHEN size > 100 THEN 'warn' ELSE 'ok' END gate
FROM (SELECT role, role || '.json' AS name, length(text) size, conv_id, turn, row_number() OVER (PARTITION BY role, length(text) ORDER BY conv_id, turn) n FROM conversations) WHERE n = 1"""


def modified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that masking of 16-digit runs changes, as counts and their first number."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_replace("text", "[0-9]{16}", fakes.REDACTED).alias("masked"))
    lines = docs.select("doc_id", paths.modified_lines(F.col("text"), F.col("masked")).alias("l"))
    return lines.where("size(l) > 0").select("doc_id", F.size("l").cast("long").alias("n"), F.element_at("l", 1).cast("long").alias("first"))


MODIFIED_LINES = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) a, string_split(regexp_replace(text, '[0-9]{16}', '[REDACTED]', 'g'), chr(10)) b FROM documents),
l AS (SELECT doc_id, list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i]) l FROM d) SELECT doc_id, len(l)::BIGINT n, l[1] AS first FROM l WHERE len(l) > 0"""

QUERIES = {
    "har_targets": (har_targets, HAR_TARGETS), "har_locations": (har_locations, HAR_LOCATIONS), "har_stats": (har_stats, HAR_STATS), "har_categories": (har_categories, HAR_CATEGORIES),
    "har_top_groups": (har_top_groups, HAR_TOP_GROUPS), "har_value_tree": (har_value_tree, HAR_VALUE_TREE),
    "url_redact": (url_redact, URL_REDACT), "url_match": (url_match, URL_MATCH), "token_pii": (token_pii, TOKEN_PII),
    "event_props": (event_props, EVENT_PROPS), "match_payloads": (match_payloads, MATCH_PAYLOADS), "unused_rules": (unused_rules, UNUSED_RULES), "catalog_stats": (catalog_stats, CATALOG_STATS),
    "format_detect": (format_detect, FORMAT_DETECT), "dedupe_files": (dedupe_files, DEDUPE_FILES), "modified_lines": (modified_lines, MODIFIED_LINES),
}
#: Names from when the five read a part of the pages only and these all of them.
QUERIES |= {f"{name}_all_pages": QUERIES[name] for name in ("har_targets", "har_locations", "har_stats", "har_categories", "har_top_groups")}
