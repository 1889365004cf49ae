"""The typed lane, matching, reports and catalogs on tiny frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from maskframe.operators import har, matching, report, typed
from maskframe.operators.typed import Rule
from maskframe.sources import catalog

DDL = "id string, email string, tags array<string>, card struct<number string, name string>, items array<struct<price double, sku string>>, live boolean, n long, extra map<string,string>"
ROWS = [
    ("cus_1234", "a@b.co", ["x", None], ("4111111111111111", "Ada Koch"), [(1.5, "S-1"), (2.25, None)], True, 123456, {"note": "hello you"}),
    ("cus_1234", "a@b.co", None, None, [], None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL)


def test_mask_keeps_schema_shape_and_nulls(docs):
    masked = typed.mask(docs, {"id": Rule("id", True), "items[].price": Rule("priceAmount")})
    assert masked.columns == docs.columns and [f.dataType for f in masked.schema] == [f.dataType for f in docs.schema]
    a, b = masked.collect()
    assert a.id == b.id != "cus_1234" and a.email != "a@b.co" and a.email.endswith("@example.com")
    assert a.tags == ["x", None] and b.tags is None and b.card is None and b["items"] == []
    assert a.card.number == "[REDACTED]" and a["items"][0].price not in (1.5, 2.25) and a.live is True
    keyed = docs.withColumn("doc", F.monotonically_increasing_id())
    out = typed.mask(keyed, {"doc": Rule("preserve")})
    assert report.shape_diff(typed.leaves(keyed, "doc"), typed.leaves(out, "doc")).isEmpty()


def test_mask_does_not_depend_on_partitions(docs):
    one, many = (sorted(map(repr, typed.mask(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_overrides(docs):
    out = typed.mask(docs, {"*": Rule("id")}, toggles={"email": False}, values={"n": "7"}).first()
    assert out.email == "a@b.co" and out.n == 7 and out.id != "cus_1234"
    with pytest.raises(ValueError):
        typed.mask(docs, values={"n": "seven"})
    assert typed.mask(docs, toggles={"tags[]": True}).first().tags[0] != "x"


def test_nested_json(spark):
    df = spark.createDataFrame([('{"email":"a@b.co","kind":"k"}',), ("plain",), ("42",), (None,)], "blob string")
    schema = typed.T.StructType.fromDDL("email string, kind string")
    out = [r[0] for r in df.select(typed.nested_json(F.col("blob"), schema, "blob", {})).collect()]
    assert "a@b.co" not in out[0] and '"kind":"k"' in out[0] and out[1:] == ["plain", "42", None]


def test_registered_generator(docs):
    typed.register_generator("custom", lambda value, seed, salt: F.lit("made"))
    try:
        assert typed.mask(docs, {"email": Rule("custom")}).first().email == "made"
    finally:
        typed.GENERATORS.clear()


def test_match_signature(spark):
    listed = [("a", "/a", None, ("id", "x"), ("opt",), {}), ("b", "/b", None, ("id", "x"), (), {}), ("c", "/c", None, ("id",), (), {}), ("none", "/n", None, (), (), {})]
    endpoints, signatures, _ = catalog.tables(spark, listed)
    docs = spark.createDataFrame([("1", ["id", "x"]), ("2", ["id", "x", "opt"]), ("3", ["id"]), ("4", ["q"]), ("5", [])], "doc_id string, paths array<string>")
    found = {r.doc_id: r.endpoint_id for r in matching.match_signature(docs, signatures, endpoints).collect()}
    assert found == {"1": "a", "2": "a", "3": "c", "4": None, "5": None}


def test_match_url(spark):
    listed = [("hook", "/x/{id}", "webhook", (), (), {}), ("item", "/x/{id}", None, (), (), {}), ("any", "/{a}", None, (), (), {}), ("dot", "/a.b", None, (), (), {})]
    endpoints, _, _ = catalog.tables(spark, listed)
    urls = spark.createDataFrame([("/v1/x/5",), ("/x/5/",), ("/axb",), ("",)], "path string")
    found = {r.path: r.endpoint_id for r in matching.match_url(urls, endpoints).collect()}
    assert found == {"/v1/x/5": "item", "/x/5/": "item", "/axb": "any", "": None}


def test_attach_rules_prefers_the_path(spark):
    rules = spark.createDataFrame([("e", "a", "id", True), ("e", "*", "redact", False)], "endpoint_id string, path string, type string, anchor boolean")
    leaves = spark.createDataFrame([("e", "a"), ("e", "b"), ("f", "a")], "endpoint_id string, norm_path string")
    assert [(r.rule_type, r.anchor) for r in matching.attach_rules(leaves, rules).orderBy("endpoint_id", "norm_path").collect()] == [("id", True), ("redact", False), (None, False)]


def test_har_targets_and_locations(spark):
    rows = [("h", i, "header", n, "Bearer abcdef123456", "GET", "u") for i in range(50) for n in ("Authorization", "authorization")] + [("h", 0, "header", "accept", "", "GET", "u")]
    values = spark.createDataFrame(rows, "har_id string, entry long, section string, name string, value string, method string, url string")
    target = har.targets(values).collect()
    assert len(target) == 1 and target[0].occurrences == 100 and target[0].redact and target[0].replacement.startswith("Bearer ")
    assert [r.entry for r in har.locations(values).orderBy("n").collect()] == list(range(20))


def test_redact_values_in_row(spark):
    df = spark.createDataFrame([([("session_id", "abc"), ("theme", "dark"), ("x", "")],)], "c array<struct<name:string,value:string>>")
    out = df.select(har.redact_values(F.col("c"), "cookie")).first()[0]
    assert out[0].value != "abc" and [x.value for x in out[1:]] == ["dark", ""] and [x.name for x in out] == ["session_id", "theme", "x"]


def test_catalog_files(tmp_path):
    good = tmp_path / "acme"
    (good / "endpoints").mkdir(parents=True)
    (good / "manifest.yaml").write_text("name: Acme\n")
    (good / "endpoints" / "order.yaml").write_text("endpoint: {method: GET, path: /o}\nsignature: {required_paths: [id]}\nfields: {id: {type: id, anchor: true}}\n")
    (good / "endpoints" / "bad.yaml").write_text("endpoint: {method: GET}\nfields: {id: {type: nonsense}, __proto__: {type: id}}\n")
    entries, warnings = catalog.load_catalog(str(tmp_path))
    assert [e[0] for e in entries] == ["acme/order"] and len(warnings) == 1 and "forbidden" in warnings[0]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DDL)
    assert typed.mask(empty).count() == 0 and typed.leaves(empty, "id").count() == 0
