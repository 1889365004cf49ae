"""Checks over whole catalogs, and the reviewer's tree of a log's values."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskframe.operators import har
from maskframe.sources import catalog

MANIFEST = "{{id: {id}, name: N, category: c, icon: i, color: '{color}', docs: d}}"
ENDPOINT = "endpoint: {method: GET, path: /o}\nsignature: {required_paths: [id]}\nfields: {id: {type: id}}\n"


def test_validate_catalog(spark, tmp_path):
    files = {
        "good/manifest.yaml": MANIFEST.format(id="good", color="#a1B2c3"), "good/endpoints/order.yaml": ENDPOINT, "good/endpoints/bare.yml": "endpoint: {method: GET, path: /b}\nfields: {a: {type: id}}",
        "twin/manifest.yaml": MANIFEST.format(id="good", color="#fff"), "own/manifest.yml": MANIFEST.format(id="builtin", color="#ffff"),
        "odd/manifest.yaml": "{id: Odd, name: ' ', category: c, icon: 7, color: 'red;x', docs: d, prototype: 1}", "odd/endpoints/Big.yaml": ENDPOINT, "odd/endpoints/huge.yaml": "#" + "x" * 200_000,
        "odd/endpoints/broken.yaml": "a: [", "odd/endpoints/list.yaml": "- 1", "odd/endpoints/wrong.yaml": "endpoint: {method: 3, constructor: 1}\nsignature: {optional_paths: [1]}\nfields: {a: {type: nonsense}, b: {type: id, anchor: 1}}",
        "lost/endpoints/order.yaml": ENDPOINT, "good/notes.txt": "no yaml", "sig/manifest.yaml": MANIFEST.format(id="sig", color="#12345678"), "sig/endpoints/s.yaml": ENDPOINT.replace("{required_paths: [id]}", "[id]"),
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {(r.provider, r.slug or "", r.problem) for r in catalog.validate_catalog(spark, str(tmp_path), taken=["builtin"]).collect()}
    assert found == {
        ("good", "", "id of two providers"), ("twin", "", "id of two providers"), ("own", "", "id is taken"), ("lost", "", "no manifest"), ("sig", "s", "signature is no mapping"),
        ("odd", "", "prototype: forbidden key"), ("odd", "", "name is missing"), ("odd", "", "icon is missing"), ("odd", "", "id is not well-formed"), ("odd", "", "color is not well-formed"),
        ("odd", "Big", "the file's name is no slug"), ("odd", "huge", "file of over 200000 bytes"), ("odd", "broken", "does not parse"), ("odd", "list", "no mapping"),
        ("odd", "wrong", "endpoint.constructor: forbidden key"), ("odd", "wrong", "signature.required_paths is no list of paths"), ("odd", "wrong", "signature.optional_paths is no list of paths"),
        ("odd", "wrong", "endpoint.method is missing"), ("odd", "wrong", "endpoint.path is missing"), ("odd", "wrong", "a: unknown type"), ("odd", "wrong", "b: anchor is no boolean"),
    }
    for i in range(4):
        (tmp_path / f"sig/endpoints/pad{i}.yaml").write_text(ENDPOINT + "#" + "x" * 199_900)
    whole = [tuple(r) for r in catalog.validate_catalog(spark, str(tmp_path)).where("provider IS NULL").collect()]
    assert whole == [(None, None, "files of over 1000000 bytes in all")]


def test_signatures_and_providers(spark):
    given = (("a/x", "/x", None, ("p", "q"), (), {"p": ("id", True)}), ("a/y", "/y", "webhook", ("q", "p", "q"), ("r",), {}), ("b/z", "/z", None, ("p",), (), {"p": ("id", False), "*": ("auto", True)}), ("b/w", "/w", None, (), ("p", "q"), {}), ("c/v", "/v", None, (), (), {}))
    endpoints, signatures, rules = catalog.tables(spark, given)
    assert [(r.required, r.endpoints) for r in catalog.duplicate_signatures(signatures).collect()] == [(["p", "q"], ["a/x", "a/y"])]
    assert sorted(map(tuple, catalog.provider_stats(endpoints, signatures, rules).collect())) == [("a", 2, 1, 0, 1, 1), ("b", 2, 0, 1, 2, 1), ("c", 1, 0, 1, 0, 0)]


def test_value_tree(spark):
    rows = [
        ("k1", "header", "Accept", "*/*", "*/*", False, 9, 0), ("k2", "header", "X-Key", "abc", "xyz", True, 2, 1), ("k3", "header", "x-key", "abd", "xyw", True, 1, 0), ("k4", "header", "Zed", "q", "q", False, 1, 2),
        ("k5", "cookie", "Sid", "1", "2", True, 1, 0), ("k6", "cookie", "sid", "1", "3", True, 1, 0), ("k7", "cookie", "a", "ABC", "ABC", False, 1, 0),
    ]
    found = spark.createDataFrame(rows, "target_key string, section string, name string, original string, replacement string, redact boolean, occurrences long, first_entry long")
    tree = lambda **how: {(r.section, r.name, r.place, r.value_place, r.target_key) for r in har.value_tree(found, **how).collect()}
    flagged = {("header", "x-key", 1, 1, "k3"), ("header", "x-key", 1, 2, "k2"), ("cookie", "Sid", 1, 1, "k5"), ("cookie", "sid", 2, 1, "k6")}
    assert tree() == flagged
    assert tree(overridden=found.where("target_key = 'k4'")) == flagged | {("header", "Zed", 2, 1, "k4")}
    assert tree(untouched=True) == flagged | {("header", "Accept", 2, 1, "k1"), ("header", "Zed", 3, 1, "k4"), ("cookie", "a", 3, 1, "k7")}
    assert tree(search=" ABC ") == {("header", "X-Key", 1, 1, "k2"), ("cookie", "a", 1, 1, "k7")}
    assert tree(untouched=True, groups=1, values=1) == {("header", "x-key", 1, 1, "k3"), ("cookie", "Sid", 1, 1, "k5")}
    wide = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("target_key"), F.lit("param").alias("section"), F.concat(F.lit("n"), F.col("id") % 2).alias("name"), F.col("id").cast("string").alias("original"), F.lit("r").alias("replacement"), F.lit(True).alias("redact"), F.lit(1).alias("occurrences"), F.col("id").alias("first_entry"))
    assert har.value_tree(wide).agg(F.count("*"), F.max("value_place"), F.max(F.col("original").cast("int"))).first() == (200, 100, 199) and har.value_tree(wide.limit(0)).count() == 0
