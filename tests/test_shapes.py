"""Shapes, checks and samples against plain walks over parsed JSON."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.operators import matching, raw, shape
from maskframe.sources import catalog


def kind_of(node) -> str:
    if isinstance(node, dict | list):
        return "object" if isinstance(node, dict) else "array"
    if node is None or isinstance(node, bool):
        return "null" if node is None else "boolean"
    return "string" if isinstance(node, str) else "integer" if node == int(node) else "number"


def walk(node, steps=(), place=""):
    yield steps, place, node
    if isinstance(node, dict):
        for k, v in node.items():
            yield from walk(v, (*steps, f".{k}"), f"{place}.{k}" if place else k)
    if isinstance(node, list):
        for i, v in enumerate(node):
            yield from walk(v, (*steps, "[]"), f"{place}[{i}]")


def brute_lattice(docs):
    kinds, n = defaultdict(set), Counter()
    for doc in docs:
        for steps, _, node in walk(doc):
            kinds[steps].add(kind_of(node))
            n[steps, kind_of(node)] += 1
    out = {}
    for steps, seen in kinds.items():
        total = sum(n[steps, k] for k in seen)
        of = n[steps[:-1], "array" if steps[-1] == "[]" else "object"] if steps else total
        left = [k for k in shape.KINDS if k in seen and not (k == "integer" and "number" in seen)]
        out[steps] = (left, total, of, bool(steps) and steps[-1] != "[]" and total < of)
    return out


def brute_problems(doc, wanted):
    """(place, problem) by walking the document and the shape {steps: (kinds, optional)} together."""

    def check(node, steps, place):
        kinds, _ = wanted[steps]
        kind = kind_of(node)
        if kind not in kinds and not (kind == "integer" and "number" in kinds):
            yield place, "wrong kind"
            return
        known = {s[-1][1:]: o for s, (_, o) in wanted.items() if s and s[:-1] == steps and s[-1] != "[]"}
        if isinstance(node, dict):
            at = lambda k: f"{place}.{k}" if place else k
            yield from ((at(k), "missing") for k, o in known.items() if not o and k not in node)
            for k, v in node.items():
                if k in known:
                    yield from check(v, (*steps, f".{k}"), at(k))
                elif known:
                    yield at(k), "unknown path"
        if isinstance(node, list) and (*steps, "[]") in wanted:
            for i, v in enumerate(node):
                yield from check(v, (*steps, "[]"), f"{place}[{i}]")

    return set(check(doc, (), ""))


def made(rng, depth=0):
    pick = rng.random()
    if depth < 3 and pick < 0.5:
        return {k: made(rng, depth + 1) for k in rng.sample(["a", "b", "a.b", "[]", "x[0]", ""], rng.randint(0, 4))}
    if depth < 4 and pick < 0.7:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice([1, 1.5, -20, 2.0, 1e30, "s", "{}", True, None, 0, 10**25])


def test_lattice_and_checks_equal_plain_walks(spark):
    rng = random.Random(5)
    docs = [made(rng) for _ in range(300)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(7)
    counted = shape.counts(df)
    rows = {tuple(r.steps): (r.kinds, r.n, r.of, r.optional) for r in shape.lattice(counted).collect()}
    assert rows == brute_lattice(docs)
    halves = [shape.counts(df.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    again = {tuple(r.steps): (r.kinds, r.n, r.of, r.optional) for r in shape.lattice(shape.merged(halves[0].union(halves[1]))).collect()}
    assert again == rows
    some = shape.lattice(shape.counts(df.where("doc_id < 40")))
    wanted = {tuple(r.steps): (r.kinds, r.optional) for r in some.collect()}
    expected = {(i, *p) for i, d in enumerate(docs) for p in brute_problems(d, wanted)}
    assert expected and not any(i < 40 for i, *_ in expected)
    for broadcast in (None, False):
        assert {tuple(r) for r in shape.validate(df, some, broadcast=broadcast).collect()} == expected


def test_required_keys_at_every_depth(spark):
    text = '{"id":1,"items":[{"sku":"a","tags":[]},{"tags":[1.0]},7],"more":{"x":{"y":1}}}'
    odd = [(1, text), (1, "{broken"), (None, " "), (4, None), (5, '{"id":"1","items":{}}'), (6, '{"id":2.50,"items":[]}\n{"id":3,"items":[{"sku":null}]}'), (7, "<r><id>1</id></r>")]
    df = spark.createDataFrame([(i, t, "kept out") for i, t in odd], "path long, steps string, kind string")
    wanted = shape.declare(spark, {"id": "integer", "items[].sku": "string", "items[].tags[]": "integer", "items[].tags?": "array", "more?": "object"})
    found = sorted((r.doc_id or 0, r.path, r.problem) for r in shape.validate(df, wanted, "path", "steps").collect())
    assert found == [
        (0, "", "no document"), (1, "", "does not parse"), (1, "items[1].sku", "missing"), (1, "items[2]", "wrong kind"), (4, "", "no document"), (5, "id", "wrong kind"), (5, "items", "wrong kind"),
        (6, "[0].id", "wrong kind"), (6, "[1].items[0].sku", "wrong kind"), (7, "id", "missing"), (7, "items", "missing"), (7, "r", "unknown path"),
    ]
    none = df.limit(0)
    assert shape.validate(none, wanted, "path", "steps").count() == 0 == shape.lattice(shape.counts(none, "steps")).count()
    deep = spark.createDataFrame([(1, "[" * 900 + "]" * 900), (2, json.dumps({f"k{i}": i for i in range(100_000)}))], "doc_id long, text string")
    assert shape.counts(deep).agg(F.sum("n")).first()[0] == 900 + 100_001
    assert shape.validate(deep, wanted).groupBy("doc_id", "problem").count().orderBy("doc_id", "problem").collect() == [(1, "wrong kind", 1), (2, "missing", 2), (2, "unknown path", 100_000)]


def schema_of(spark, *docs):
    df = spark.createDataFrame([(json.dumps(d) if not isinstance(d, str) else d,) for d in docs], "text string")
    return shape.tree(shape.lattice(shape.counts(df)))


def test_schemas_of_the_lattice(spark):
    node = schema_of(spark, [{"n": 1, "m": 1, "e": [], "o": {}}, {"n": 2.5, "m": 2.0, "s": [1, "x", {"q": None}], "o": {}}], [])
    item = {"oneOf": [{"type": "object", "properties": {"q": {"type": "null"}}, "required": ["q"]}, {"type": "string"}, {"type": "integer"}]}
    inner = {"e": {"type": "array"}, "m": {"type": "integer"}, "n": {"type": "number"}, "o": {"type": "object", "properties": {}}, "s": {"type": "array", "items": item}}
    assert shape.to_json_schema(node) == {"type": "array", "items": {"type": "object", "properties": inner, "required": ["m", "n", "o"]}}
    script, zod = shape.to_typescript(node, "All"), shape.to_zod(node)
    assert script.startswith("export type All = {") and "e?: unknown[];" in script and "o: Record<string, unknown>;" in script and "} | string | number)[];" in script and script.endswith("}[];\n")
    assert "e: z.array(z.unknown()).optional()" in zod and "z.union([z.object({" in zod and zod.count("(") == zod.count(")")
    wide = schema_of(spark, f'{{"a":{10**17},"b":{10**30},"c":{10**40},"d":1e5,"e":null,"f":[[true]],"g":1.5}}')
    kinds = {f.name: f.dataType for f in shape.to_struct_type(wide)}
    assert kinds == {"a": T.LongType(), "b": T.DecimalType(38, 0), "c": T.StringType(), "d": T.StringType(), "e": T.StringType(), "f": T.ArrayType(T.ArrayType(T.BooleanType())), "g": T.DoubleType()}
    for text, kind in (("1.0", "integer"), ("1.50e1", "integer"), ("1.5e0", "number"), ("100e-2", "integer"), ("10e-2", "number"), ("0e-9", "integer"), ("-0.0", "integer"), ("1e999999999999", "integer"), ("NaN", "number")):
        assert shape.to_json_schema(schema_of(spark, text)) == {"type": kind}


def test_sample_documents_match_their_endpoints(spark):
    rules = {"a.b[].c": ("id", True), "a.b": ("shortText", False), "rows[]": ("priceAmount", False), "flag": ("boolean", False), "void": ("null", False), "inner": ("nestedJson", False), "*": ("auto", False)}
    given = (*catalog.SAMPLE, ("own/deep", None, None, ("a.b[].c", "a.d"), ("grid[][].x",), rules), ("own/bare", None, None, ("only",), (), {}))
    endpoints, signatures, fields = catalog.tables(spark, given)
    made = matching.sample_documents(fields, signatures)
    texts = {r.endpoint_id: json.loads(r.text) for r in made.collect()}
    deep = texts["own/deep"]
    assert set(texts) == {"shop/order", "shop/customer", "hooks/event", "own/deep", "own/bare"}
    assert isinstance(deep["a"]["b"][0]["c"], str) and deep["rows"] == [4242.42] and deep["flag"] is True and deep["void"] is None and "email" in json.loads(deep["inner"]) and isinstance(deep["grid"][0][0]["x"], str)
    docs = made.withColumnRenamed("endpoint_id", "doc_id")
    found = matching.match_signature(raw.flatten(docs).select("doc_id", "paths"), signatures, endpoints).collect()
    assert {r.doc_id: r.endpoint_id for r in found} == {e: e for e in texts}
    masked = {r.doc_id: json.loads(r.text) for r in raw.mask(docs.withColumn("endpoint_id", F.col("doc_id")), rules=fields).collect()}
    same = {e for e in texts if masked[e] == texts[e]}
    assert same <= {"hooks/event", "own/bare"} and masked["own/deep"]["a"]["b"][0].keys() == {"c"} and masked["own/deep"]["inner"] != deep["inner"]
