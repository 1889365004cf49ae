"""Raw payloads, inferred schemas, and streams that equal batches."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from maskframe.operators import raw, report, shape, typed
from maskframe.sources import catalog
from maskframe.streaming import masking

TEXTS = [
    '{"user":{"email":"a@b.co","id":"cus_1234","n":24.1500,"big":12345678901234567890},"tags":["x",null,true],"__proto__":{"a":1},"e":{}}',
    '{"email":"a@b.co"}\n{"email":"c@d.co"}', '{"broken"', "", None, '{"a":1,"a":2}',
]


def test_flatten_and_mask(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = raw.flatten(df).orderBy("doc_id").collect()
    assert rows[0].paths == ["user", "user.email", "user.id", "user.n", "user.big", "tags", "e"] and [x.path for x in rows[0].leaves][-2:] == ["tags[0]", "tags[2]"]
    assert rows[1].leaves[1].path == "[1].email" and rows[2].error and rows[3].error is None and rows[5].leaves[0].value == "2"
    out = {r.doc_id: r for r in raw.mask(df).collect()}
    made = json.loads(out[0].text)
    assert '"n":24.1500' in out[0].text and "12345678901234567890" in out[0].text and "a@b.co" not in out[0].text and "__proto__" not in out[0].text
    assert list(made) == ["user", "tags", "e"] and made["tags"] == ["x", None, True] and made["user"]["id"] != "cus_1234"
    assert len(out[1].text.split("\n")) == 2 and out[2].text is None and out[2].error


def test_schemas_from_shape(spark):
    docs = spark.createDataFrame([(1, "x", [(1.0, "s")]), (2, None, [])], "id long, name string, items array<struct<price double, first-name string>>".replace("first-name", "`first-name`"))
    node = shape.tree(report.infer_shape(typed.leaves(docs, "id")))
    schema = shape.to_json_schema(node)
    assert schema["required"] == ["id"] and schema["properties"]["items"]["items"]["properties"]["price"] == {"type": "number"}
    assert '"first-name"?: string;' in shape.to_typescript(node) and "z.array(z.object({" in shape.to_zod(node)
    assert shape.to_struct_type(node)["name"].dataType.simpleString() == "string"


def run(stream, tmp_path, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(repr, stream.sparkSession.table(name).collect()))


def test_streams_equal_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = spark.range(40).selectExpr(
        "timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) AS ts", "concat('cus_', 1000 + id % 7) AS id", "'header' AS section",
        "CASE WHEN id % 2 = 0 THEN 'authorization' ELSE 'accept' END AS name", "concat('Bearer abc', id % 3) AS value",
    )
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    rules = {"id": typed.Rule("id", True), "*": typed.Rule("preserve")}
    assert run(masking.mask_stream(stream, rules), tmp_path, "masked") == sorted(map(repr, typed.mask(rows, rules).collect()))
    assert len(run(masking.first_seen_targets(stream, "ts"), tmp_path, "seen")) == 3
    stats = masking.windowed_stats(stream, "ts")
    assert run(stats, tmp_path, "stats", "complete") == sorted(map(repr, masking.windowed_stats(rows, "ts").collect()))


def test_webhooks_are_routed(spark, tmp_path):
    endpoints, signatures, _ = catalog.tables(spark, catalog.SAMPLE)
    docs = spark.createDataFrame([("1", ["id", "type"]), ("2", ["q"])], "doc_id string, paths array<string>")
    docs.write.parquet(str(tmp_path / "hooks"))
    got = []
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "hooks"))
    route = masking.route_webhooks(signatures, endpoints, lambda df, _: got.extend(df.select("doc_id", F.coalesce("endpoint_id", F.lit("-"))).collect()))
    stream.writeStream.foreachBatch(route).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, got)) == [("1", "hooks/event"), ("2", "-")]
