"""Queries from payload texts to masked texts: by endpoint, by format, inside arrays, and whole log entries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions import fakes
from maskframe.jobs import duck
from maskframe.jobs.masking import read
from maskframe.jobs.network import _payloads, shared
from maskframe.operators import entries, matching, raw, report, shape, typed
from maskframe.sources import catalog, logs


def masked_payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers, events and parts as texts, matched to endpoints by their paths and masked by their rules."""
    endpoints, signatures, rules = catalog.tables(spark, catalog.SAMPLE)
    payloads = _payloads(spark, sf_dir)
    paths = raw.flatten(payloads).select("doc_id", "paths")
    found = matching.match_signature(paths, signatures, endpoints).select("doc_id", "endpoint_id")
    masked = raw.mask(payloads.join(found, "doc_id"), rules=rules)
    field = lambda name: F.get_json_object("text", f"$.{name}").alias(name)
    return masked.select(
        "doc_id", "endpoint_id", *map(field, ("order_id", "customer_id", "name", "segment", "id", "type", "size")), F.get_json_object("text", "$.total").cast("double").alias("total"),
    )


_NONE = {c: "NULL" for c in ("order_id", "customer_id", "name", "segment", "id", "type", "size", "total")}


def _masked_sql() -> str:
    number = lambda c: f"CAST({duck.whole_number(c)} AS VARCHAR)"
    total = duck.amount("o_totalprice", "'total'")
    parts = {
        "orders": ("o_orderkey", "'shop/order'", {"order_id": number("o_orderkey"), "customer_id": number("o_custkey"), "total": total}),
        "customer": ("c_custkey", "'shop/customer'", {"customer_id": number("c_custkey"), "name": duck.full_name("c_name", "'name'"), "segment": "c_mktsegment"}),
        "events": ("event_id", "'hooks/event'", {"id": number("event_id"), "type": "event_type"}),
        "part": ("p_partkey", "NULL", {"size": "CAST(p_size AS VARCHAR)"}),
    }
    kinds = {c: "DOUBLE" if c == "total" else "VARCHAR" for c in _NONE}
    return " UNION ALL ".join(
        f"SELECT '{name}-' || {key} doc_id, {endpoint}::VARCHAR endpoint_id, " + ", ".join(f"CAST({v} AS {kinds[c]}) AS {c}" for c, v in {**_NONE, **made}.items()) + f" FROM {name}"
        for name, (key, endpoint, made) in parts.items()
    )


def _log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(har_id, entry, text): an entry an event, with headers, cookies, parameters, URLs and a JSON body."""
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    user, event = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    headers = F.array(pair("accept", F.lit("*/*")), pair("Authorization", F.concat(F.lit("Bearer "), F.md5(user))))
    url = F.concat(F.lit("https://api.example.com/v1/events/"), event, F.lit("?sig="), F.md5(event))
    body = F.to_json(F.struct(F.concat(F.lit("u"), user, F.lit("@corp.test")).alias("email"), F.lit("AT").alias("countryCode"), F.col("value").alias("value")))
    request = F.struct(
        F.upper("event_type").alias("method"), url.alias("url"), F.lit("HTTP/1.1").alias("httpVersion"), headers.alias("headers"),
        F.array(pair("theme", F.lit("dark")), pair("session_id", F.md5(F.concat(F.lit("s"), user)))).alias("cookies"), F.array(pair("page", F.lit("2")), pair("clientSecret", F.concat(F.lit("k"), user))).alias("queryString"),
    )
    content = F.struct(F.when(F.col("event_id") % 7 == 0, "image/png").otherwise("application/json; charset=utf-8").alias("mimeType"), F.concat(F.lit(")]}',\n"), body).alias("text"))
    response = F.struct(F.lit(200).alias("status"), F.array(pair("Server", F.lit("x"))).alias("headers"), content.alias("content"))
    entry = F.struct(request.alias("request"), response.alias("response"), F.concat(F.lit("93.184.216."), (F.col("event_id") % 200).cast("string")).alias("serverIPAddress"), F.lit(1.5).alias("time"))
    # A log's entries cost far more than their bytes say, so they are dealt out by number as the readers of logs do.
    dealt = read(spark, sf_dir, "events").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id", "event_id")
    return dealt.select(F.concat(F.lit("log-"), (F.col("user_id")).cast("string")).alias("har_id"), F.col("event_id").alias("entry"), F.to_json(entry).alias("text"))


def har_entries_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What redaction makes of each part of an entry."""
    out = entries.redact(_log_entries(spark, sf_dir))
    part = lambda path: F.get_json_object("text", f"$.{path}")
    body = F.regexp_replace(part("response.content.text"), r"^\)\]\}',\n", "")
    return out.select(
        "har_id", "entry", part("request.headers[0].value").alias("accept"), part("request.headers[1].value").alias("auth"), part("request.cookies[0].value").alias("theme"),
        part("request.cookies[1].value").alias("session"), part("request.queryString[1].value").alias("secret"), part("request.url").alias("url"), part("serverIPAddress").alias("ip"),
        F.get_json_object(body, "$.email").alias("email"), F.get_json_object(body, "$.countryCode").alias("country"), part("response.content.text").startswith(")]}',\n").alias("framed"), F.size("errors").cast("long").alias("skipped"),
    )


def _redacted_sql() -> str:
    ip, mail = "'93.184.216.' || (event_id % 200)", "'u' || user_id || '@corp.test'"
    first, rest = duck.pick(_names(), duck.number(duck.digest("email", "mail"))), f"substr({duck.digest('email', 'mail')}, 9, 8)"
    return f"""WITH e AS (SELECT event_id AS entry, 'log-' || user_id har_id, {ip} ip, {mail} mail, md5(CAST(user_id AS VARCHAR)) tok, md5('s' || user_id) sess, 'k' || user_id k, md5(CAST(event_id AS VARCHAR)) sg, event_id % 7 = 0 png FROM events)
SELECT har_id, entry, '*/*' accept, 'Bearer ' || {duck.scramble("tok")} auth, 'dark' theme, {duck.scramble("sess")} AS "session", {duck.scramble("k")} secret,
  'https://api.example.com/v1/events/' || entry || '?sig=' || {duck.scramble("sg")} AS url, {duck.replacement("'ip'", "''", "ip")} ip,
  CASE WHEN png THEN mail ELSE lower({first}) || '.' || {rest} || '@example.com' END email, 'AT' country, true framed, CASE WHEN png THEN 1 ELSE 0 END::BIGINT skipped FROM e"""


def har_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries redacted, written as whole logs and read back: their place in their log, and parts of them."""
    made = entries.redact(_log_entries(spark, sf_dir))
    folder = f"{shared(spark)}/maskframe/logs-{uuid.uuid4().hex}"
    head = made.select("har_id").distinct().select("har_id", F.lit('{"log":{"version":"1.2","pages":[],"entries":[').alias("head"), F.lit('],"comment":"end"}}').alias("tail"))
    logs.write_har(made, folder, head)
    part = lambda path: F.get_json_object("text", f"$.{path}")
    name = F.regexp_extract("har_id", r"/[0-9a-f]{8}-([^/]*)\.obfuscated$", 1)
    back = logs.read_har(spark, folder)
    return back.where(~F.col("har_id").contains("/_manifest/")).select(name.alias("har_id"), F.col("entry").cast("long").alias("place"), part("request.url").alias("url"), part("serverIPAddress").alias("ip"), part("time").cast("double").alias("time"), "error")


def har_entry_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets over all surfaces of the entries but the plain numbers of bodies, with replacement, reason and places."""
    return _shown(entries.targets(_log_entries(spark, sf_dir)))


def har_entry_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same targets after a review: one value replaced by a literal, one redacted, one kept, and addresses switched off."""
    reviewed = [("header", "Accept", "*/*", True, "text/html"), ("cookie", "theme", "dark", True, None), ("body", "email", "u1@corp.test", False, None), ("ip", "serverIPAddress", "93.184.216.7", True, "10.0.0.1")]
    return _shown(entries.targets(_log_entries(spark, sf_dir), {**entries.POLICY, "ips": False}, reviewed))


def _shown(found: DataFrame) -> DataFrame:
    found = found.where("name <> 'value'")
    places = F.array_join(F.transform("locations", lambda x: F.concat_ws("/", x["har_id"], x["entry"].cast("string"))), " ")
    return found.select("section", "name", "original", "replacement", "redact", "reason", "occurrences", places.alias("places"))


def _targets_sql() -> str:
    mail = duck.pick(_names(), duck.number(duck.digest("email", "v")))
    made = f"""CASE s WHEN 'email' THEN lower({mail}) || '.' || substr({duck.digest("email", "v")}, 9, 8) || '@example.com' WHEN 'sig' THEN split_part(v, '=', 1) || '=' || {duck.scramble("split_part(v, '=', 2)")}
    WHEN 'auth' THEN 'Bearer ' || {duck.scramble("substr(v, 8)")} WHEN 'ip' THEN {duck.replacement("'ip'", "''", "v")} WHEN 'secret' THEN {duck.scramble("v")} ELSE v END"""
    return f"""WITH e AS (SELECT event_id AS e, 'log-' || user_id h, user_id u FROM events),
l AS (SELECT e, h, unnest([{{'s': '', 'section': 'header', 'name': 'accept', 'v': '*/*', 'r': 'standard header'}}, {{'s': '', 'section': 'header', 'name': 'Server', 'v': 'x', 'r': 'standard header'}}, {{'s': '', 'section': 'cookie', 'name': 'theme', 'v': 'dark', 'r': 'preference cookie'}},
  {{'s': '', 'section': 'param', 'name': 'page', 'v': '2', 'r': 'plain parameter'}}, {{'s': 'auth', 'section': 'header', 'name': 'Authorization', 'v': 'Bearer ' || md5(CAST(u AS VARCHAR)), 'r': 'credential header'}},
  {{'s': 'secret', 'section': 'cookie', 'name': 'session_id', 'v': md5('s' || u), 'r': 'session or token cookie'}}, {{'s': 'secret', 'section': 'param', 'name': 'clientSecret', 'v': 'k' || u, 'r': 'secret parameter'}},
  {{'s': 'sig', 'section': 'url', 'name': 'request.url', 'v': 'https://api.example.com/v1/events/' || e || '?sig=' || md5(CAST(e AS VARCHAR)), 'r': 'secrets in the URL'}},
  {{'s': 'ip', 'section': 'ip', 'name': 'serverIPAddress', 'v': '93.184.216.' || (e % 200), 'r': 'public address'}}, {{'s': 'email', 'section': 'body', 'name': 'email', 'v': 'u' || u || '@corp.test', 'r': 'email'}},
  {{'s': '', 'section': 'body', 'name': 'countryCode', 'v': 'AT', 'r': 'regional data'}}]) x FROM e),
k AS (SELECT e, h, x.* FROM l WHERE NOT (x.section = 'body' AND e % 7 = 0)),
g AS (SELECT s, section, name, v, any_value(r) r, count(*) n, list(h || '/' || e ORDER BY h, e)[1:20] p FROM k GROUP BY ALL)
SELECT section, name, v AS original, {made} AS replacement, s <> '' AS redact, r AS reason, n AS occurrences, array_to_string(p, ' ') places FROM g"""


def _overrides_sql() -> str:
    return f"""WITH t AS ({_targets_sql()}), j AS (SELECT *, section = 'header' AND name = 'accept' AS literal, section = 'cookie' AND name = 'theme' AS opted, section = 'ip' OR original = 'u1@corp.test' AS kept FROM t)
SELECT section, name, original, CASE WHEN literal THEN 'text/html' WHEN opted THEN {duck.scramble("original")} WHEN kept THEN original ELSE replacement END AS replacement,
  (redact OR literal OR opted) AND NOT kept AS redact, reason, occurrences, places FROM j"""


def field_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the fields of customers and their orders are decided under a rule, a toggle, a literal and detection."""
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    rows = read(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("doc"), F.struct(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.concat(F.lit("u"), "c_custkey", F.lit("@corp.test")).alias("email"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("n_orders")).alias("c"))
    rules = spark.createDataFrame([("c.customer_id", "id"), ("c.segment", "shortText"), ("c.balance", "priceAmount")], "path string, type string")
    leaves = typed.leaves(rows, "doc").where("norm_path <> 'doc'")
    return report.field_decisions(report.decided(leaves, rules, {"c.segment": False, "c.n_orders": True}, {"c.name": "Someone", "c.balance": "no number"}))


def _decisions_sql() -> str:
    rows = [
        ("c.customer_id", "CAST(c_custkey AS VARCHAR)", "'id'", "'id'", "'rule'"), ("c.name", "c_name", "CASE WHEN regexp_matches(c_name, ' ') THEN 'preserve' ELSE 'id' END", "'custom'", "'literal'"),
        ("c.email", "'u' || c_custkey || '@corp.test'", "'email'", "'email'", "'generic'"), ("c.segment", "c_mktsegment", "'shortText'", "'preserve'", "'toggle'"),
        ("c.balance", "CAST(c_acctbal AS VARCHAR)", "'priceAmount'", "'priceAmount'", "'rule'"), ("c.n_orders", "CAST(k AS VARCHAR)", "'preserve'", "'id'", "'toggle'"),
    ]
    each = " UNION ALL ".join(
        f"SELECT c_custkey d, '{path}' norm_path, {value} v, {default} t, {effective} f, {source} s FROM c" + (" WHERE k IS NOT NULL" if path == "c.n_orders" else "") for path, value, default, effective, source in rows
    )
    return f"""WITH c AS (SELECT * FROM customer LEFT JOIN (SELECT o_custkey, count(*) k FROM orders GROUP BY 1) ON c_custkey = o_custkey), l AS ({each})
SELECT norm_path, arg_min(t, d) default_type, arg_min(f, d) effective_type, arg_min(s, d) AS source, arg_min(s IN ('literal', 'toggle'), d) overridden, arg_min(v, d) first_original, count(*) n FROM l GROUP BY norm_path"""


def _written_sql() -> str:
    inner = _redacted_sql()
    return f"SELECT har_id, row_number() OVER (PARTITION BY har_id ORDER BY entry) - 1 AS place, url, ip, 1.5::DOUBLE AS \"time\", NULL::VARCHAR AS error FROM ({inner}) x"


def leaks_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers that still stand inside texts made from orders; every tenth text was left as it was."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.concat("c_name", F.lit("/"), "c_mktsegment").alias("tag"))
    orders = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    kept = F.when(F.col("o_orderkey") % 10 == 0, F.col("tag")).otherwise(fakes.scramble(F.col("tag")))
    texts = orders.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" for ["), kept, F.lit("] was shipped")).alias("text"))
    return report.leaks(customer, texts, value_col="c_name").select(F.col("value").alias("c_name"), "doc_id")


LEAKS_IN_TEXTS = f"""WITH t AS (SELECT o_orderkey doc_id, 'order ' || o_orderkey || ' for [' || CASE WHEN o_orderkey % 10 = 0 THEN tag ELSE {duck.scramble("tag")} END || '] was shipped' AS text
  FROM orders JOIN (SELECT c_custkey, c_name || '/' || c_mktsegment tag FROM customer) ON o_custkey = c_custkey)
SELECT DISTINCT c_name, doc_id FROM t JOIN customer ON contains(text, c_name)"""


def _names() -> tuple[str, ...]:
    from maskframe.functions.fakes import FIRST_NAMES

    return FIRST_NAMES


def har_entry_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the entries lack of the format's required fields."""
    found = _log_entries(spark, sf_dir).select(F.explode(entries.violations(F.col("text"))).alias("field"))
    return found.groupBy("field").agg(F.count("*").alias("n"))


def _violations_sql() -> str:
    """The checks by JSON functions over texts that hold what the entries do."""
    text = """json_object('request', json_object('method', upper(event_type), 'url', 'u', 'httpVersion', 'HTTP/1.1', 'headers', [{'name': 'a', 'value': 'b'}], 'cookies', [{'name': 'a', 'value': 'b'}],
      'queryString', [{'name': 'a', 'value': 'b'}]), 'response', json_object('status', 200, 'headers', [{'name': 'a', 'value': 'b'}], 'content', json_object('mimeType', 'm', 'text', props)), 'time', 1.5)"""
    kinds = {"OBJECT": "('OBJECT')", "STRING": "('VARCHAR')", "NUMBER": "('UBIGINT', 'BIGINT', 'DOUBLE')", "PAIRS": "('ARRAY')"}
    whole = lambda path: f"coalesce(json_type(j, '$.{path}') = 'OBJECT', false)"
    checks = [
        f"SELECT '{path}' AS field FROM e WHERE coalesce(json_type(j, '$.{path}'), 'NULL') NOT IN {kinds[wanted]}" + (f" AND {whole(path.rpartition('.')[0])}" if "." in path else "")
        for wanted, listed in entries.REQUIRED.items() for path in listed
    ]
    return f"WITH e AS (SELECT {text} j FROM events) SELECT field, count(*) n FROM ({' UNION ALL '.join(checks)}) x GROUP BY field"


def infer_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of orders with their line items, optional counted by element."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"))).alias("items"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("status"))
    nested = orders.join(lines, F.col("id") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return report.element_shape(typed.leaves(nested, "id"))


INFER_ELEMENTS = """WITH o AS (SELECT count(*) n, count(*) FILTER (o_orderstatus <> 'O') s FROM orders),
l AS (SELECT count(*) n, count(*) FILTER (l_discount > 0.05) d, count(DISTINCT l_orderkey) k FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT 'id' norm_path, 'number' kinds, o.n, o.n AS "of", false optional FROM o UNION ALL SELECT 'status', 'string', s, o.n, s < o.n FROM o
UNION ALL SELECT 'items', 'array', k, o.n, k < o.n FROM o, l UNION ALL SELECT 'items[]', 'object', l.n, k, false FROM l
UNION ALL SELECT 'items[].line', 'number', l.n, l.n, false FROM l UNION ALL SELECT 'items[].discount', 'number', d, l.n, d < l.n FROM l"""


def _order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): an order with its line items by number; even ids write nulls, odd ones leave them out."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("items"))
    orders = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status, priority = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
    items = F.coalesce("items", F.array().cast("array<struct<line:int,discount:double>>"))
    doc = F.struct(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_totalprice").alias("price"), priority.alias("priority"), items.alias("items"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(doc, {"ignoreNullFields": "false"})).otherwise(F.to_json(doc))
    return orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def payload_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of every node of the orders' texts, and where a key is missing from some object."""
    found = shape.lattice(shape.counts(_order_texts(spark, sf_dir)))
    return found.select("norm_path", F.array_join("kinds", "|").alias("kinds"), "n", "of", "optional")


_ORDER_PARTS = """WITH o AS (SELECT o_orderkey k, o_orderkey % 2 = 0 AS e, o_totalprice v, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END s, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END p FROM orders),
l AS (SELECT k, e, l_linenumber n, CASE WHEN l_discount > 0.05 THEN l_discount END d FROM lineitem JOIN o ON l_orderkey = k)"""

PAYLOAD_LATTICE = f"""{_ORDER_PARTS}, a AS (SELECT count(*) n FROM o), b AS (SELECT count(*) n FROM l),
f AS (SELECT 'status' p, 'string' t, s IS NOT NULL AS v, e FROM o UNION ALL SELECT 'priority', 'string', p IS NOT NULL, e FROM o UNION ALL SELECT 'items[].discount', 'number', d IS NOT NULL, e FROM l),
g AS (SELECT p, concat_ws('|', CASE WHEN bool_or(v) THEN any_value(t) END, CASE WHEN bool_or(NOT v AND e) THEN 'null' END) kinds, count(*) FILTER (v OR e) n, count(*) "of" FROM f GROUP BY p)
SELECT p norm_path, kinds, n, "of", n < "of" AS optional FROM g UNION ALL SELECT '', 'object', n, n, false FROM a UNION ALL SELECT 'id', 'integer', n, n, false FROM a
UNION ALL SELECT 'price', CASE WHEN (SELECT bool_or(v <> floor(v)) FROM o) THEN 'number' ELSE 'integer' END, n, n, false FROM a UNION ALL SELECT 'items', 'array', n, n, false FROM a
UNION ALL SELECT 'items[]', 'object', b.n, a.n, false FROM a, b UNION ALL SELECT 'items[].line', 'integer', n, n, false FROM b"""


def payload_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place of the orders' texts that a declared shape does not allow, inside line items too."""
    wanted = shape.declare(spark, {"id": "integer", "status": "string", "price": "number", "items[].line": "integer", "items[].discount": "number"})
    return shape.validate(_order_texts(spark, sf_dir), wanted)


PAYLOAD_VIOLATIONS = f"""{_ORDER_PARTS}, i AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, d NULLS FIRST) - 1 AS i FROM l)
SELECT k doc_id, 'status' AS path, CASE WHEN e THEN 'wrong kind' ELSE 'missing' END problem FROM o WHERE s IS NULL UNION ALL SELECT k, 'priority', 'unknown path' FROM o WHERE e OR p IS NOT NULL
UNION ALL SELECT k, 'items[' || i || '].discount', CASE WHEN e THEN 'wrong kind' ELSE 'missing' END FROM i WHERE d IS NULL"""


def resolved_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the endpoint that they name, that their URL or that their paths give, and how it was found."""
    endpoints, signatures, _ = catalog.tables(spark, catalog.SAMPLE)
    path = F.regexp_extract("url", "^[^:]*://[^/?#]*([^?#]*)", 1)
    named = F.when(F.col("page_id") % 5 == 0, "shop/order")
    docs = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), named.alias("endpoint_id"), path.alias("url_path"))
    paths = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("id"), F.lit("type"))).otherwise(F.array(F.lit("q"))).alias("paths"))
    found = matching.resolve_endpoint(docs, matching.match_url(docs.select(F.col("url_path").alias("path")), endpoints), matching.match_signature(paths, signatures, endpoints))
    return found.groupBy(F.coalesce("endpoint_id", F.lit("none")).alias("endpoint_id"), "how").agg(F.count("*").alias("n"))


RESOLVED_ENDPOINTS = """WITH u AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) p FROM pages),
m AS (SELECT page_id, CASE WHEN regexp_matches(p, '(^|/)en/[^/]+\\.html/?($|\\?)') THEN 'web/en-page' WHEN regexp_matches(p, '(^|/)de/[^/]+/?($|\\?)') THEN 'web/de-item'
  WHEN regexp_matches(p, '(^|/)[^/]+/[^/]+/?($|\\?)') THEN 'web/any-item' END w FROM u)
SELECT CASE WHEN page_id % 5 = 0 THEN 'shop/order' WHEN w IS NOT NULL THEN w WHEN page_id % 2 = 0 THEN 'hooks/event' ELSE 'none' END endpoint_id,
  CASE WHEN page_id % 5 = 0 THEN 'explicit' WHEN w IS NOT NULL THEN 'url' WHEN page_id % 2 = 0 THEN 'signature' ELSE 'none' END how, count(*) n FROM m GROUP BY ALL"""

QUERIES = {
    "masked_payload_fields": (masked_payload_fields, _masked_sql()), "har_entries_redacted": (har_entries_redacted, _redacted_sql()),
    "har_entry_targets": (har_entry_targets, _targets_sql()), "har_entry_overrides": (har_entry_overrides, _overrides_sql()), "field_decisions": (field_decisions, _decisions_sql()), "har_written_back": (har_written_back, _written_sql()), "leaks_in_texts": (leaks_in_texts, LEAKS_IN_TEXTS), "har_entry_violations": (har_entry_violations, _violations_sql()), "infer_elements": (infer_elements, INFER_ELEMENTS), "resolved_endpoints": (resolved_endpoints, RESOLVED_ENDPOINTS),
    "payload_lattice": (payload_lattice, PAYLOAD_LATTICE), "payload_violations": (payload_violations, PAYLOAD_VIOLATIONS),
}
