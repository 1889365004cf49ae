"""Formats that come back as they were, rules in the raw lane, log entries, shapes by element."""

from __future__ import annotations

import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from maskframe.functions import fakes
from maskframe.operators import entries, matching, raw, report
from maskframe.sources import catalog, formats, texts

BACK = [
    '{"a":1.50,"b":[true,null,"x"],"c":{}}', '{"a":1}\n{"a":2}', "id,note\r\n1,\"a, b\"\r\n2,\r\n", "a;b\n1;2\n", "k=v&n=a+b%26&e=",
    '<?xml version="1.0" encoding="UTF-8"?>\n<o a="1"><i>x &amp; y</i><i/><t>z</t></o>', base64.b64encode(b"<c><f>" + b"1" * 60 + b"</f></c>").decode(), "",
]


@pytest.mark.parametrize("text", BACK)
def test_texts_come_back_as_they_were(text):
    assert texts.write(texts.parse(text)) == text


def test_wrapped_xml_and_frames():
    packed = base64.b64encode(b"<c><f>1</f></c>").decode()
    parsed = texts.parse(f"bt_signature=s&bt_payload={packed.replace('=', '%3D')}")
    assert parsed.documents == [{"c": {"f": "1"}}] and "bt_payload=" in texts.write(parsed)
    assert texts.unframe(")]}',\n{}") == (")]}',\n", "{}", False)
    body = texts.frame("", '{"a":"é"}', True)
    assert texts.unframe(body) == ("", '{"a":"é"}', True) and texts.unframe("5\r\nab")[2] is False
    for bad in ("<a>", "plain words", '{"a"'):
        with pytest.raises(ValueError):
            texts.parse(bad)


def test_rules_anchors_literals_and_arrays(spark):
    text = json.dumps({"customer_ids": ["Cus_1234", "Cus_9"], "owner": "Cus_1234", "user": "日本太郎", "n": 5, "blob": json.dumps({"email": "a@b.co"}), "keep": "k"})
    df = spark.createDataFrame([(1, "e", text), (2, None, text), (3, "e", "a=1")], "doc_id int, endpoint_id string, text string")
    rules = spark.createDataFrame(
        [("e", "customer_ids[]", "id", True), ("e", "owner", "id", True), ("e", "user", "id", False), ("e", "keep", "preserve", False), ("e", "*", "auto", False)], "endpoint_id string, path string, type string, anchor boolean"
    )
    rows = {r.doc_id: r for r in raw.mask(df, rules=rules, values={"n": "7"}).collect()}
    one, two = json.loads(rows[1].text), json.loads(rows[2].text)
    assert one["customer_ids"][0] == one["owner"] != "Cus_1234" and one["n"] == 7 and one["keep"] == "k" and not set(one["user"]) & set("日本太郎")
    assert json.loads(one["blob"])["email"].endswith("@example.com") and two["customer_ids"][0] not in ("Cus_1234", one["owner"]) and rows[3].text == "a=1"


def test_bijection_beyond_nine_digits(spark):
    numbers = spark.range(20_000).select((F.col("id") * 4099 + 1_000_000_007).alias("v")).select("v", fakes.whole_number(F.col("v")).alias("f"))
    assert numbers.select("f").distinct().count() == 20_000 and numbers.where("v = f OR length(v) <> length(f)").isEmpty()
    small = spark.range(-128, 128).select(F.col("id").alias("v"), fakes.whole_number(F.col("id"), top=127).cast("tinyint").alias("f"))
    assert small.select("f").distinct().count() == 256 and small.where("v = f").isEmpty()
    long = spark.createDataFrame([("x" * 300,)], "v string").select(fakes.scramble(F.col("v"))).first()[0]
    assert len({long[k : k + 64] for k in (0, 64, 128, 192)}) == 4


ENTRY = {
    "request": {"method": "GET", "url": "https://h/?sig=abc1", "headers": [{"name": "Authorization", "value": "Bearer abcdef"}, {"name": "accept", "value": "*/*"}], "queryString": [{"name": "secret", "value": "s3cr3t"}]},
    "response": {"status": 200, "content": {"mimeType": "application/json", "text": ")]}'\n" + json.dumps({"email": "a@b.co", "country_code": "AT"})}}, "serverIPAddress": "8.8.8.8", "x": {"unknown": 1.50},
}


def test_entries(spark, tmp_path):
    picture = {"response": {"content": {"mimeType": "image/png", "text": '{"email": "a@b.co"}'}}}
    df = spark.createDataFrame([("h", 0, json.dumps(ENTRY)), ("h", 1, json.dumps(picture)), ("h", 2, "{")], "har_id string, entry long, text string")
    rows = {r.entry: r for r in entries.redact(df, overrides=[("param", "secret", "s3cr3t", True, "mine")], policy={**entries.POLICY, "ips": False}).collect()}
    out = json.loads(rows[0].text)
    assert out["request"]["headers"][0]["value"].startswith("Bearer ") and "abcdef" not in rows[0].text and out["request"]["headers"][1] == ENTRY["request"]["headers"][1]
    assert out["request"]["queryString"][0]["value"] == "mine" and out["serverIPAddress"] == "8.8.8.8" and '"unknown":1.5' in rows[0].text and "abc1" not in out["request"]["url"]
    body = out["response"]["content"]["text"]
    assert body.startswith(")]}'\n") and json.loads(body[5:])["country_code"] == "AT" and "a@b.co" not in body
    assert json.loads(rows[1].text) == picture and rows[1].errors and rows[2].text is None and rows[2].errors
    found = {(r.section, r["name"]): r for r in entries.targets(df).collect()}
    assert found["ip", "serverIPAddress"].reason == "public address" and found["header", "accept"].redact is False and found["body", "email"].redact
    assert found["param", "secret"].original == "s3cr3t" != found["param", "secret"].replacement and [(x.entry, x.method) for x in found["ip", "serverIPAddress"].locations] == [(0, "GET")]
    lacking = df.where("entry = 0").select(entries.violations(F.col("text")).alias("v")).first().v
    assert "startedDateTime" in lacking and "request.method" not in lacking
    assert found["header", "accept"].reason == "standard header" and found["body", "email"].reason == "email" and found["body", "country_code"].reason == "regional data"
    entries.write(df, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 3


def test_checks_of_entries_tell_kinds_apart(spark):
    pair = [{"name": "a", "value": "b"}]
    whole = {
        "startedDateTime": "2024-01-01T00:00:00Z", "time": 1.5, "cache": {}, "timings": {"send": 0, "wait": 1, "receive": 2.5},
        "request": {"method": "GET", "url": "u", "httpVersion": "h", "headersSize": -1, "bodySize": 0, "headers": pair, "cookies": [], "queryString": pair},
        "response": {"status": 200, "statusText": "", "httpVersion": "h", "redirectURL": "", "headersSize": -1, "bodySize": 0, "headers": pair, "cookies": [], "content": {"size": 0, "mimeType": "m"}},
    }
    spoilt = json.loads(json.dumps(whole))
    spoilt["time"], spoilt["timings"]["wait"], spoilt["request"]["method"], spoilt["response"]["content"]["text"] = "1.5", None, 5, 7
    spoilt["request"]["headers"] = [*pair, {"name": "x"}, {"name": 1, "value": "b"}, None, "x"]
    spoilt["response"]["cookies"] = {}
    del spoilt["cache"]
    bare = {**whole, "timings": [], "request": None, "response": {**whole["response"], "content": "c"}}
    texts = [json.dumps(whole), json.dumps(spoilt), json.dumps(bare), "[]", "{", "", None, '{"time": 1, "time": 2}']
    found = [sorted(r.v) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(entries.violations(F.col("text")).alias("v")).collect()]
    assert found[0] == [] and found[2] == ["request", "response.content", "timings"] and found[3:] == [["$"]] * 5
    assert found[1] == sorted(["time", "timings.wait", "request.method", "response.content.text", *(f"request.headers[{i}]" for i in range(1, 5)), "response.cookies", "cache"])


def test_shapes_reports_and_matching(spark):
    leaves = spark.createDataFrame(
        [(1, "items[0].q", "items[].q", "number"), (1, "items[0].r", "items[].r", "string"), (1, "items[1].r", "items[].r", "string"), (2, "a", "a", "string")], "doc_id long, path string, norm_path string, kind string"
    )
    rows = {r.norm_path: (r.kinds, r.n, r.of, r.optional) for r in report.element_shape(leaves).collect()}
    assert rows == {"items": ("array", 1, 2, True), "items[]": ("object", 2, 1, False), "items[].q": ("number", 1, 2, True), "items[].r": ("string", 2, 2, False), "a": ("string", 1, 2, True)}
    assert report.shape_ids(leaves).select("shape_id").distinct().count() == 2
    shape = spark.createDataFrame([("a", "string", False), ("items[].q", "string", True)], "norm_path string, kinds string, optional boolean")
    assert {tuple(r) for r in report.validate_against(shape, leaves).collect()} == {(1, "items[].q", "wrong kind"), (1, "items[].r", "unknown path"), (1, "a", "missing")}
    assert report.filter_fields(leaves, "ITEMS").count() == 3
    endpoints, signatures, rules = catalog.tables(spark, catalog.SAMPLE)
    own = matching.samples(rules, signatures).select(F.col("endpoint_id").alias("doc_id"), "paths")
    assert all(r.doc_id == r.endpoint_id for r in matching.match_signature(own, signatures, endpoints).collect())
    assert [r.doc_id for r in matching.covered_docs(own, own, signatures, "shop/order").select("doc_id").collect()] == ["shop/order"]
    paths = spark.createDataFrame([("/en/x.html",), ("/de/7",), ("/a/b/c",), ("/",)], "path string")
    one = {r.path: r.endpoint_id for r in matching.match_url(paths, endpoints).collect()}
    assert one == {r.path: r.endpoint_id for r in brute_urls(paths, endpoints).collect()}


def brute_urls(paths, endpoints):
    """Every distinct path against every template."""
    plain = endpoints.where("kind IS NULL OR kind <> 'webhook'").select(F.struct("rank", "endpoint_id").alias("e"), matching.template_pattern(F.col("path")).alias("p")).where("p IS NOT NULL")
    met = paths.distinct().join(plain, F.rlike(F.col("path"), F.col("p")), "left").groupBy("path").agg(F.min("e").alias("e"))
    return met.select("path", F.col("e.endpoint_id").alias("endpoint_id"))


@pytest.mark.parametrize("count", [0, 5, 499, 501])
def test_urls_meet_any_number_of_templates(spark, count):
    draw = random.Random(count)
    piece = lambda: draw.choice(["a", "b", "c", "{x}", "{id}.json", "v1", "a.b", "{a/b}"])
    made = [draw.choice(["/", ""]) + "/".join(piece() for _ in range(draw.randint(1, 4))) + draw.choice(["", "", "", "/", "?q={x}"]) for _ in range(count)]
    rows = [(f"e{i}", path, draw.choice([None, None, "rest", "webhook"]), i) for i, path in enumerate(made)]
    if count == 5:  # variables at the end of all
        rows = [("e0", "/{x}", None, 3), ("e1", "/{x}/{y}", None, 2), ("e2", "a/{x}", None, 1), ("e3", "", None, 0), ("e4", None, None, 4)]
    endpoints = spark.createDataFrame(rows, "endpoint_id string, path string, kind string, rank int")
    bit = lambda: draw.choice(["a", "b", "c", "v1", "a.b", "axb", "7.json", "zz", ""])
    urls = ["/".join(bit() for _ in range(draw.randint(1, 6))) + draw.choice(["", "/", "?q=1", "?a/b", "?q=1?c", "\n", "/\n", "//"]) for _ in range(400)]
    paths = spark.createDataFrame([(u,) for u in [*urls, "", "/", "?", None]], "path string")
    found = {r.path: r.endpoint_id for r in matching.match_url(paths, endpoints).collect()}
    assert found == {r.path: r.endpoint_id for r in brute_urls(paths, endpoints).collect()} and len(found) == paths.distinct().count()
    assert count < 5 or any(found.values())


def test_batches(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("x.json", '{"email":"a@b.co"}'), ("a/x.json", '{"email":"a@b.co"}'), ("bad.json", "{"), ("y.csv", "email,n\na@b.co,1\n")):
        (tmp_path / name).write_text(text)
    rows = {r.masked_name: r for r in formats.mask_batch(formats.read_batch(spark, str(tmp_path)), consistent=False).collect()}
    assert set(rows) == {"x.obfuscated.json", "bad.obfuscated.json", "y.obfuscated.csv"} and rows["bad.obfuscated.json"].error and "a@b.co" not in rows["y.obfuscated.csv"].text
    assert {(r.status, r.n) for r in report.batch_report(spark.createDataFrame([(r.error,) for r in rows.values()], "error string")).collect()} == {("done", 2), ("error", 1)}
