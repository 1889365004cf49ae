"""Order and repeats in payload texts, wide ids, name clashes, whole logs and substring leaks."""

from __future__ import annotations

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from maskframe.functions import fakes
from maskframe.operators import entries, raw, report, typed
from maskframe.sources import logs, texts

BACK = ["email,email\na@b.co,c@d.co\n", "k=1&k=2&j=3&k=", "<o><a/><b/><a/></o>", '<o x="1">t<a>1</a><a>2</a><b>3</b><a y="2">4</a></o>', "a,__proto__,a\n1,2,3\n"]


@pytest.mark.parametrize("text", BACK[:-1])
def test_order_and_repeats_come_back(text):
    assert texts.write(texts.parse(text)) == text


def test_repeated_names_are_masked_one_by_one(spark):
    rows = {r.id: r.text for r in raw.mask(spark.createDataFrame(list(enumerate(BACK)), "id int, text string")).collect()}
    one, two = rows[0].splitlines()[1].split(",")
    assert one != two and one.endswith("@example.com") and two.endswith("@example.com")
    assert [p.split("=")[0] for p in rows[1].split("&")] == ["k", "k", "j", "k"] and rows[2] == BACK[2] and rows[4].splitlines()[0] == "a,a"
    paths = [leaf.path for leaf in raw.flatten(spark.createDataFrame([(BACK[3],)], "text string")).first().leaves]
    assert paths == ["o.@_x", "o.a[0]", "o.a[1]", "o.b", "o.a[2].@_y", "o.a[2].#text", "o.#text"]


def test_wide_ids_have_one_fake(spark):
    """The same id at two paths and in the typed lane; 4 to 40 digits."""
    ids = ["7" * n for n in range(4, 41)] + ["1234567890123456789", "9223372036854775807", "9223372036854775808"]
    df = spark.createDataFrame([(i, f'{{"id": {i}, "order": {{"id": {i}}}}}') for i in ids], "v string, text string")
    rows = {r.v: json.loads(r.text, parse_int=str) for r in raw.mask(df).collect()}
    typed_rows = df.where("length(v) < 38").select("v", F.col("v").cast("decimal(38,0)").alias("id"))
    lane = {r.v: str(r.id) for r in typed.mask(typed_rows, {"id": typed.Rule("id", anchor=True), "v": typed.Rule("preserve")}).collect()}
    long = df.where("try_cast(v AS bigint) IS NOT NULL").select("v", F.col("v").cast("bigint").alias("id"))
    lane64 = {r.v: str(r.id) for r in typed.mask(long, {"id": typed.Rule("id", anchor=True), "v": typed.Rule("preserve")}).collect()}
    for i in ids:
        fake = rows[i]["id"]
        assert fake == rows[i]["order"]["id"] != i and len(fake) == len(i) and fake.lstrip("-").isdigit() and lane.get(i, fake) == lane64.get(i, fake) == fake
    assert abs(int(rows["9223372036854775807"]["id"])) < 1 << 63


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_digit_strings_are_permuted(spark, size):
    every = spark.range(10**size).select(F.lpad(F.col("id").cast("string"), size, "0").alias("v"))
    made = every.select("v", fakes.digit_string(F.col("v")).alias("f"))
    assert made.select("f").distinct().count() == 10**size and made.where(f"length(f) <> {size} OR (left(v, 1) = '0') <> (left(f, 1) = '0')").isEmpty()
    assert made.where("left(v, 1) <> '0' AND v = f").isEmpty()


def test_helper_names_clash_with_nothing(spark):
    text = '{"email": "a@b.co"}'
    df = spark.createDataFrame([(text, "mine", "kept", 1, "x")], "text string, values string, error string, leaves int, paths string")
    row = raw.mask(df).first()
    assert (row["values"], row.error, row.leaves, row.paths, row._error) == ("mine", "kept", 1, "x", None) and "a@b.co" not in row.text
    logged = entries.redact(df.withColumnRenamed("error", "errors")).first()
    assert (logged["values"], logged.errors, logged._errors) == ("mine", "kept", [])
    with pytest.raises(ValueError, match="reserved"):
        raw.mask(df.withColumn("__at", F.lit(1)))


def test_dictionaries_hold_over_batches(spark):
    """Batches of seven rows, rows without leaves, unparsable and null ones, seeds by row."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    rows = [(i, json.dumps({"id": f"Cus_{i % 5}00", "n": i}) if i % 4 else [None, "", "{", "[]"][i // 4 % 4], f"s{i % 2}") for i in range(100)]
    df = spark.createDataFrame(rows, "i int, text string, seed string").coalesce(1)
    out = {r.i: r for r in raw.mask(df, seed=F.col("seed")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    fakes_of = {}
    for i, text, seed in rows:
        if i % 4:
            made = json.loads(out[i].text)
            assert made["n"] == i and fakes_of.setdefault((json.loads(text)["id"], seed), made["id"]) == made["id"] != json.loads(text)["id"]
        else:
            assert out[i].text == {None: None, "": "", "{": None, "[]": "[]"}[text] and bool(out[i].error) == (text == "{")
    assert len(set(fakes_of.values())) == 10


def test_logs_come_back_with_their_frames(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    (source / "sub").mkdir(parents=True)
    entry = lambda i: {"request": {"method": "GET", "url": f"https://h/?sig=abc{i}", "headers": []}, "serverIPAddress": "10.0.0.1", "x": [i, None, 1.25]}
    log = {"log": {"version": "1.2", "pages": [{"id": "p"}], "entries": [entry(i) for i in range(40)], "comment": "é"}, "more": True}
    for name in ("a.har", "sub/a.har"):
        (source / name).write_text(json.dumps(log))
    (source / "empty.har").write_text('{"log":{"entries":[]}}')
    (source / "none.har").write_text('{"log":{}}')
    (source / "broken.har").write_text("{")
    (source / "large.har").write_text(json.dumps({"log": {"entries": [{}] * 9000}}))
    rows = logs.read_har(spark, str(source), silent=2000, ceiling=20_000)
    errors = {r.har_id.rsplit("/", 1)[-1]: r.error for r in rows.where("entry IS NULL").collect()}
    assert set(errors) == {"none.har", "broken.har", "large.har"} and errors["large.har"].startswith("refused") and rows.where("error = 'large file'").count() == 80
    made = logs.write_har(entries.redact(rows.where("entry IS NOT NULL").drop("error")), str(target), logs.frames(spark, str(source), 20_000)).collect()
    assert sorted((r.entries, r.file[9:]) for r in made) == [(0, "empty.obfuscated.har"), (40, "a.obfuscated.har"), (40, "a.obfuscated.har")]
    for r in made:
        text = (target / r.file).read_text()
        assert len(text.encode()) == r.bytes
        if r.entries:
            back, want = json.loads(text), json.loads(json.dumps(log))
            for i, (one, other) in enumerate(zip(back["log"]["entries"], want["log"]["entries"], strict=True)):
                assert one["request"].pop("url") != other["request"].pop("url") and one == other and one["x"][0] == i
            assert [*back["log"]] == [*log["log"]] and back == want
    assert not list(target.glob("*.tmp"))


def test_leaks_equal_all_pairs(spark):
    chance = random.Random(3)
    values = ["".join(chance.choices("abcdé#1", k=chance.randrange(6, 20))) for _ in range(60)] + [f"user{i}@corp.example.com" for i in range(40)] + [None, "", "short"]
    docs = []
    for i in range(200):
        some = chance.sample([v for v in values if v], chance.randrange(3))
        docs.append((i, " ".join([f"text @corp.example.com {i}", *some]) + "x" * chance.randrange(3)))
    docs += [(200, None), (201, ""), (202, values[70] * 300), (202, values[71]), (None, values[70])]
    found = report.leaks(spark.createDataFrame([(v,) for v in values * 2], "value string"), spark.createDataFrame(docs, "doc_id long, text string"))
    want = {(v, i) for v, (i, t) in itertools.product(values, docs) if v and len(v) >= 8 and t and i is not None and v in t}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_targets_merge_over_batches(spark):
    """Small batches in several tasks: counts add up, the first twenty entries are kept in order."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    entry = lambda i: json.dumps({"request": {"method": "GET", "url": f"/p{i}", "headers": [{"name": "Cookie" if i % 2 else "cookie", "value": "a=1"}, {"name": "x", "value": f"v{i % 3}"}]}})
    df = spark.createDataFrame([(f"log{i % 4}", i, entry(i)) for i in range(300)] + [("log0", 500, "{"), (None, None, entry(0))], "har_id string, entry long, text string").repartition(5)
    found = {(r.section, r["name"].lower(), r.original): r for r in entries.targets(df).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cookie = found["header", "cookie", "a=1"]
    order = sorted((f"log{i % 4}", i) for i in range(300))
    assert cookie.occurrences == 301 and [(x.har_id, x.entry) for x in cookie.locations] == order[:20] and cookie.redact and cookie.replacement != "a=1"
    assert {k[2]: found[k].occurrences for k in found if k[1] == "x"} == {"v0": 101, "v1": 100, "v2": 100}
    assert len(found) == 4 + 300  # the URLs stand once each, "/p0" twice


def test_decisions_by_source(spark):
    leaves = raw.flatten(spark.createDataFrame([(1, '{"a": {"id": "Cus_1234", "n": 5, "email": "a@b.co", "t": true, "z": "x"}}')], "doc_id int, text string"))
    rows = leaves.select("doc_id", F.posexplode("leaves").alias("ord", "l")).select("doc_id", "ord", "l.*")
    rules = spark.createDataFrame([("a.id", "sku"), ("a.email", "preserve"), ("a.n", "auto")], "path string, type string")
    made = report.decided(rows, rules, {"a.email": True, "a.id": False, "a.t": True}, {"a.n": "7", "a.t": "maybe", "a.z": "y"})
    got = {r.norm_path: (r.default_type, r.effective_type, r.source, r.overridden) for r in made.collect()}
    assert got == {
        "a.id": ("sku", "preserve", "toggle", True), "a.n": ("preserve", "custom", "literal", True), "a.email": ("preserve", "email", "toggle", True), "a.t": ("preserve", "boolean", "toggle", True), "a.z": ("preserve", "custom", "literal", True),
    }
    starred = report.decided(rows, rules.union(spark.createDataFrame([("*", "shortText")], rules.schema)))
    assert {r.norm_path: r.source for r in starred.collect()} == {"a.id": "rule", "a.n": "generic", "a.email": "rule", "a.t": "rule", "a.z": "rule"}
    assert report.decision_stats(made).first().asDict() == {"transformed": 4, "preserved": 1, "from_generic": 0, "overridden": 5, "leaves": 5}
