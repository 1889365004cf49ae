"""Queries by semantic type, by text format, and as streams, over the business tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions import detect
from maskframe.jobs import duck
from maskframe.jobs.masking import ORDERS, read
from maskframe.jobs.network import _payloads, shared
from maskframe.operators import matching, raw, typed
from maskframe.operators.typed import Rule
from maskframe.sources import catalog, formats
from maskframe.streaming import masking as streams

#: Column, its text in Spark and in DuckDB SQL (over customer and nation), type, anchored.
_ADDRESS = (
    ("phone", "concat('+43 (0)1 ', lpad(c_custkey, 7, '0'))", "'+43 (0)1 ' || lpad(c_custkey::VARCHAR, 7, '0')", "phone", True),
    ("street", "concat(c_custkey, ' ', c_mktsegment)", "c_custkey || ' ' || c_mktsegment", "street", False),
    ("unit", "concat('Apt ', c_nationkey)", "'Apt ' || c_nationkey", "streetSecondary", False),
    ("city", "n_name", "n_name", "city", True),
    ("state", "substr(c_mktsegment, 1, 2)", "substr(c_mktsegment, 1, 2)", "state", False),
    ("region", "lower(substr(c_mktsegment, 1, 3))", "lower(substr(c_mktsegment, 1, 3))", "stateOrProvince", False),
    (
        "country", "CASE c_custkey % 3 WHEN 0 THEN substr(c_mktsegment, 1, 2) WHEN 1 THEN lower(substr(c_mktsegment, 1, 3)) ELSE n_name END",
        "CASE c_custkey % 3 WHEN 0 THEN substr(c_mktsegment, 1, 2) WHEN 1 THEN lower(substr(c_mktsegment, 1, 3)) ELSE n_name END", "country", False,
    ),
    ("code", "CASE c_custkey % 2 WHEN 0 THEN 'at' ELSE substr(c_mktsegment, 1, 3) END", "CASE c_custkey % 2 WHEN 0 THEN 'at' ELSE substr(c_mktsegment, 1, 3) END", "countryCode", False),
    (
        "zip", "CASE c_custkey % 3 WHEN 0 THEN lpad(c_custkey, 5, '0') WHEN 1 THEN concat('D-', lpad(c_custkey, 6, '1')) ELSE concat('SW', c_nationkey, 'A ', c_custkey % 10, 'xy') END",
        "CASE c_custkey % 3 WHEN 0 THEN lpad(c_custkey::VARCHAR, 5, '0') WHEN 1 THEN 'D-' || lpad(c_custkey::VARCHAR, 6, '1') ELSE 'SW' || c_nationkey || 'A ' || (c_custkey % 10) || 'xy' END", "postalCode", False,
    ),
    ("company", "concat(c_mktsegment, ' Inc')", "c_mktsegment || ' Inc'", "company", True),
    ("first_name", "c_mktsegment", "c_mktsegment", "firstName", False),
    ("last_name", "n_name", "n_name", "lastName", False),
)
_ORDER = (
    ("token", "concat(o_orderpriority, o_orderkey)", "o_orderpriority || o_orderkey", "uuid", True),
    ("placed", "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')", "isoDate", False),
    ("seen", "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')", "isoDate", True),
    ("born", "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')", "birthDate", False),
    ("link", "concat('https://shop.test/o/', o_orderkey)", "'https://shop.test/o/' || o_orderkey", "url", False),
    ("sku", "concat('SKU-', o_orderkey)", "'SKU-' || o_orderkey", "sku", True),
    ("currency", "CASE o_orderkey % 2 WHEN 0 THEN substr(o_orderpriority, 3, 3) ELSE 'eur' END", "CASE o_orderkey % 2 WHEN 0 THEN substr(o_orderpriority, 3, 3) ELSE 'eur' END", "currency", False),
    ("note", "o_orderpriority", "o_orderpriority", "shortText", False),
    ("story", "concat(o_orderpriority, o_custkey)", "o_orderpriority || o_custkey", "longText", False),
    ("product", "concat(o_orderstatus, o_custkey)", "o_orderstatus || o_custkey", "productName", False),
)


def masked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, telephone numbers and places of customers in codes, names and patterns of several widths and cases."""
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    made = rows.select("c_custkey", *(F.expr(text).alias(name) for name, text, *_ in _ADDRESS))
    return typed.mask(made, {"c_custkey": Rule("preserve"), **{name: Rule(kind, anchor) for name, _, _, kind, anchor in _ADDRESS}})


def masked_order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' tokens, dates as texts and as dates, instants, links, codes, texts, flags and codes that belong together."""
    day, card = F.to_date("o_orderdate"), F.struct(F.col("o_orderstatus").alias("cvv_code"), F.col("o_orderpriority").alias("cvv_message"))
    made = read(spark, sf_dir, "orders").select(
        "o_orderkey", *(F.expr(text).alias(name) for name, text, *_ in _ORDER), day.alias("day"), (F.col("o_orderkey") + 1_700_000_000).alias("epoch"),
        (F.col("o_orderstatus") == "O").alias("is_open"), card.alias("card"),
    )
    rules = {name: Rule(kind, anchor) for name, _, _, kind, anchor in _ORDER} | {"day": Rule("isoDate"), "epoch": Rule("unixTimestamp", True), "is_open": Rule("boolean")}
    masked = typed.mask(made, {"o_orderkey": Rule("preserve"), **rules, "card.cvv_code": Rule("cvvCode"), "card.cvv_message": Rule("cvvMessage")})
    return masked.select("*", "card.cvv_code", "card.cvv_message").drop("card")


def _typed_sql(fields: tuple[tuple, ...], key: str, table: str, more: tuple[str, ...] = (), kept: tuple[str, ...] = ()) -> str:
    real = ", ".join((key, *kept, *(f"{text} AS {name}_" for name, _, text, *_ in fields)))
    made = [f"{duck.fake(kind, f'{name}_', duck.quoted('' if anchor else name))} AS {name}" for name, _, _, kind, anchor in fields]
    return f"WITH r AS (SELECT {real} FROM {table}) SELECT {', '.join((key, *made, *more))} FROM r"


def _order_facts_sql() -> str:
    day = duck.number(duck.digest("isoDate", "day_", "'day'"))
    epoch = duck.number(duck.digest("unixTimestamp", "epoch_"))
    more = (
        f"CAST(day_ - CAST({day} % 700 + 1 AS INT) AS DATE) AS day", f"epoch_ - ({epoch} % 86400000 + 1) AS epoch", "o_orderstatus <> 'O' AS is_open",
        f"{duck.fake('cvvCode', 'o_orderstatus', parent=duck.quoted('card'))} AS cvv_code", f"{duck.fake('cvvMessage', 'o_orderstatus', parent=duck.quoted('card'))} AS cvv_message",
    )
    return _typed_sql(_ORDER, "o_orderkey", "orders", more, ("o_orderstatus", "CAST(o_orderdate AS DATE) AS day_", "o_orderkey + 1700000000 AS epoch_"))


_XML = '<?xml version="1.0" encoding="UTF-8"?>\n<order id="<k>"><note><p></note><customer><c></customer><note>x &amp; y</note><kept a="1"/></order>'
#: Texts of an order with places for its key, priority and customer; by the key modulo their count.
_TEXTS = {
    "csv": 'id,note,customer,kept\r\n<k>,<p>,<c>,"say ""<p>"", or"\r\n<c>,x,<c>,\r\n', "ndjson": '{"id":"<k>","note":"<p>"}\n{"customer":"<c>","kept":[1.50,null,{"id":"<k>"}]}',
    "xml": _XML, "form": "id=<k>&note=<p>&customer=<c>&kept=a+%26+b&note=x", "packed": _XML,
}
_TEXT_RULES = {
    "id": ("id", "[].id", "order.@_id", "[].kept[].id", "customer", "[].customer", "order.customer"), "shortText": ("note", "[].note", "order.note[]"), "preserve": ("*",),
}


def masked_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV, NDJSON, XML, forms and packed XML, masked by one set of rules and written in the format they came in."""
    parts = {"<k>": F.concat(F.lit("o"), "o_orderkey"), "<p>": F.col("o_orderstatus"), "<c>": F.concat(F.lit("cus_"), "o_custkey")}
    which, text = F.col("o_orderkey") % len(_TEXTS), F.lit(None).cast("string")
    for i, (name, template) in enumerate(_TEXTS.items()):
        filled = F.lit(template)
        for mark, value in parts.items():
            filled = F.replace(filled, F.lit(mark), value)
        text = F.when(which == i, F.base64(filled.cast("binary")) if name == "packed" else filled).otherwise(text)
    # A text costs far more than its bytes say, so orders are dealt out by key.
    orders = read(spark, sf_dir, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")
    rules = spark.createDataFrame([("o", path, kind, True) for kind, listed in _TEXT_RULES.items() for path in listed], "endpoint_id string, path string, type string, anchor boolean")
    masked = raw.mask(orders.select("o_orderkey", F.lit("o").alias("endpoint_id"), text.alias("text")), rules=rules)
    return masked.select("o_orderkey", formats.detect_format(F.col("text")).alias("format"), "text", "error")


def _formats_sql() -> str:
    """The same texts with masked parts. Notes of one letter and two are constants; CSV's second id is the customer's."""
    branches = []
    for i, (name, template) in enumerate(_TEXTS.items()):
        joined = lambda made: f"replace({made}, ' ', '+')" if name == "form" else made  # noqa: B023, E731
        parts = {"<kept>": "p", "<k>": duck.scramble("k"), "<p>": joined(duck.fake("shortText", "p")), "<c>": duck.scramble("c"), "<x>": joined(duck.fake("shortText", "'x'")), "<x&y>": duck.fake("shortText", "'x & y'")}
        text = duck.quoted(template.replace('""<p>""', '""<kept>""').replace(",x,", ",<x>,").replace("&note=x", "&note=<x>").replace("x &amp; y", "<x&y>"))
        for mark, made in parts.items():
            text = f"replace({text}, '{mark}', {made})"
        text = f"base64(encode({text}))" if name == "packed" else text
        branches.append(f"SELECT o_orderkey, '{'form' if name == 'packed' else name}' AS format, {text} AS text, NULL::VARCHAR AS error FROM r WHERE o_orderkey % {len(_TEXTS)} = {i}")
    return f"WITH r AS (SELECT o_orderkey, 'o' || o_orderkey k, o_orderstatus p, 'cus_' || o_custkey c FROM orders) {' UNION ALL '.join(branches)}"


def _sink(spark: SparkSession, stream: DataFrame, make: Callable[[DataFrame], DataFrame] = lambda batch: batch, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and read back what its batches became: in append mode all of them, in complete mode
    the last. A batch that runs again replaces its own folder."""
    folder = f"{shared(spark)}/maskframe/stream-{uuid.uuid4().hex}"
    last: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")
        last.append(epoch)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:  # an empty table has no batch
        return spark.createDataFrame([], stream.schema)
    out = spark.read.parquet(f"{folder}/rows")
    return (out.where(F.col("epoch") == max(last)) if mode == "complete" else out).drop("epoch")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream; a pattern, as the source takes folders and patterns but no path of a single file."""
    return spark.readStream.schema(read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def streamed_masked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders masked as a stream."""
    out = _sink(spark, streams.mask_stream(_stream(spark, sf_dir, "orders"), ORDERS))
    return out.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


STREAMED_MASKED_ORDERS = f"""SELECT {duck.whole_number("o_orderkey")} o_orderkey, {duck.whole_number("o_custkey")} o_custkey, o_orderstatus, {duck.amount("o_totalprice", "'o_totalprice'")} o_totalprice, o_orderpriority FROM orders"""


def _event_values(events: DataFrame) -> DataFrame:
    """(ts, section, name, value): what the requests behind events carried."""
    row = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.alias("value"))
    user = F.col("user_id").cast("string")
    host = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("10.0.0."), (F.col("user_id") % 200).cast("string"))).otherwise(F.concat(F.lit("93.184.216."), (F.col("user_id") % 200).cast("string")))
    carried = F.array(
        row("header", "authorization", F.concat(F.lit("Bearer "), F.md5(user.cast("binary")))), row("header", "accept", F.col("event_type")), row("cookie", "theme", F.col("event_type")),
        row("param", "token", F.concat(F.lit("t"), user)), row("ip", "serverIPAddress", host),
    )
    return events.select(F.col("ts").cast("timestamp").alias("ts"), F.explode(carried).alias("x")).select("ts", "x.section", "x.name", "x.value")


_EVENT_VALUES = """v AS (SELECT ts, unnest([{'section': 'header', 'name': 'authorization', 'v': 'Bearer ' || md5(user_id::VARCHAR)}, {'section': 'header', 'name': 'accept', 'v': event_type},
  {'section': 'cookie', 'name': 'theme', 'v': event_type}, {'section': 'param', 'name': 'token', 'v': 't' || user_id},
  {'section': 'ip', 'name': 'serverIPAddress', 'v': CASE WHEN event_id % 3 = 0 THEN '10.0.0.' ELSE '93.184.216.' END || (user_id % 200)}]) x FROM events),
e AS (SELECT ts, x.section AS section, x.name AS "name", x.v AS v FROM v)"""


def streamed_event_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values and redacted values by section and hour, counted as a stream."""
    stats = streams.windowed_stats(_event_values(_stream(spark, sf_dir, "events")), "ts", "1 hour")
    return _sink(spark, stats, mode="complete").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "section", "n", "redacted")


def _event_stats_sql() -> str:
    flag = duck.default_redact("section", '"name"', "v")
    return f"WITH {_EVENT_VALUES} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS \"start\", section, count(*) n, count(*) FILTER ({flag}) redacted FROM e GROUP BY 1, 2"


def streamed_first_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every redaction target of the events once, as a stream whose watermark spans them."""
    seen = streams.first_seen_targets(_event_values(_stream(spark, sf_dir, "events")), "ts", "3650 days")
    return _sink(spark, seen).select("target_key", "section", "name", "value")


def _first_targets_sql() -> str:
    flag = duck.default_redact("section", '"name"', "v")
    return f"WITH {_EVENT_VALUES} SELECT DISTINCT {duck.target_key('section', chr(34) + 'name' + chr(34), 'v')} target_key, section, \"name\", v AS \"value\" FROM e WHERE {flag}"


def streamed_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and events as payload texts in a stream, each with the endpoint of its paths."""
    endpoints, signatures, _ = catalog.tables(spark, catalog.SAMPLE)
    order = F.struct(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("total"))
    event = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("data"))
    orders = _stream(spark, sf_dir, "orders").select(F.concat(F.lit("orders-"), F.col("o_orderkey").cast("string")).alias("doc_id"), F.to_json(order).alias("text"))
    events = _stream(spark, sf_dir, "events").select(F.concat(F.lit("events-"), F.col("event_id").cast("string")).alias("doc_id"), F.to_json(event).alias("text"))
    paths = raw.flatten(orders.unionByName(events)).select("doc_id", "paths")
    found = _sink(spark, paths, lambda batch: matching.match_signature(batch, signatures, endpoints))
    return found.select("doc_id", "endpoint_id")


STREAMED_ENDPOINTS = "SELECT 'orders-' || o_orderkey doc_id, 'shop/order' endpoint_id FROM orders UNION ALL SELECT 'events-' || event_id, 'hooks/event' FROM events"


#: Paths under which the values of events are judged.
_JUDGED = ("user.email", "card.cvv_result.code", "note", "session_id", "data.name")


def detected_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events, placeholders among them, by the type found under several paths and the type they get when opted in."""
    marks = F.array(*map(F.lit, detect.PLACEHOLDERS))
    user, at = F.col("user_id").cast("string"), (F.col("event_id") / 7).cast("long")
    value = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(" "), F.upper(F.get(marks, (at % len(detect.PLACEHOLDERS)).cast("int"))))).when(F.col("event_id") % 7 == 1, F.concat(F.lit("u"), user, F.lit("@corp.test")))
        .when(F.col("event_id") % 7 == 2, F.regexp_replace(F.md5(user.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).when(F.col("event_id") % 7 == 3, user)
        .when(F.col("event_id") % 7 == 4, F.concat(F.lit("Ab_"), user, F.lit("-x"))).when(F.col("event_id") % 7 == 5, F.col("props")).otherwise(F.col("event_type"))
    )
    # What depends on the value alone is found once a value, and what depends on the path alone once a path.
    text, judged = F.col("value"), F.array(*(F.struct(F.lit(path).alias("path"), detect.path_type(F.lit(path)).alias("by_path")) for path in _JUDGED))
    rows = read(spark, sf_dir, "events").select("event_id", value.alias("value"))
    rows = rows.select("*", detect.value_type(text).alias("shown"), detect.id_like(text, F.lit("string")).alias("opted"))
    rows = rows.select("event_id", "value", "shown", "opted", F.explode(judged).alias("x"))
    found = detect.detect(F.col("x.by_path"), text, F.lit("string"), F.col("shown"))
    return rows.select("event_id", "x.path", found.alias("found"), "opted")


def _detected_sql() -> str:
    key, at = "md5(user_id::VARCHAR)", f"event_id // 7 % {len(detect.PLACEHOLDERS)} + 1"
    parts = " || '-' || ".join(f"substr({key}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    value = f"""CASE event_id % 7 WHEN 0 THEN ' ' || upper(list_extract({duck.listed(detect.PLACEHOLDERS)}, {at})) WHEN 1 THEN 'u' || user_id || '@corp.test' WHEN 2 THEN {parts} WHEN 3 THEN user_id::VARCHAR
      WHEN 4 THEN 'Ab_' || user_id || '-x' WHEN 5 THEN props ELSE event_type END"""
    opted = "CASE WHEN regexp_full_match(v, '[0-9]+') THEN 'id' WHEN regexp_full_match(v, '[0-9a-fA-F-]{36}') THEN 'uuid' WHEN regexp_full_match(v, '[A-Za-z0-9_-]{6,}') THEN 'id' ELSE 'shortText' END"
    each = " UNION ALL ".join(f"SELECT event_id, '{path}' AS path, {duck.detect_type(duck.quoted(path), 'v', duck.quoted('string'))} AS found, {opted} AS opted FROM r" for path in _JUDGED)
    return f"WITH r AS (SELECT event_id, {value} AS v FROM events) {each}"


def covered_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads of all tables that have every path that orders must have."""
    _, signatures, _ = catalog.tables(spark, catalog.SAMPLE)
    docs = _payloads(spark, sf_dir)
    return matching.covered_docs(docs, raw.flatten(docs).select("doc_id", "paths"), signatures, "shop/order").select("doc_id")


COVERED_PAYLOADS = """WITH p AS (SELECT 'orders-' || o_orderkey doc_id, json_object('order_id', o_orderkey, 'customer_id', o_custkey, 'total', o_totalprice) j FROM orders
  UNION ALL SELECT 'customer-' || c_custkey, json_object('customer_id', c_custkey, 'name', c_name, 'segment', c_mktsegment) FROM customer
  UNION ALL SELECT 'events-' || event_id, json_object('id', event_id, 'type', event_type, 'data', props) FROM events UNION ALL SELECT 'part-' || p_partkey, json_object('sku', p_partkey, 'size', p_size) FROM part)
SELECT doc_id FROM p WHERE list_has_all(json_keys(j), ['order_id', 'customer_id'])"""

QUERIES = {
    "detected_values": (detected_values, _detected_sql()), "covered_payloads": (covered_payloads, COVERED_PAYLOADS), "masked_addresses": (masked_addresses, _typed_sql(_ADDRESS, "c_custkey", "customer JOIN nation ON c_nationkey = n_nationkey")), "masked_order_facts": (masked_order_facts, _order_facts_sql()),
    "masked_formats": (masked_formats, _formats_sql()), "streamed_masked_orders": (streamed_masked_orders, STREAMED_MASKED_ORDERS), "streamed_event_stats": (streamed_event_stats, _event_stats_sql()),
    "streamed_first_targets": (streamed_first_targets, _first_targets_sql()), "streamed_endpoints": (streamed_endpoints, STREAMED_ENDPOINTS),
}
