"""How often expensive parts stand in a plan, as each use is worked out again."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from maskframe.functions import detect, fakes
from maskframe.jobs import kinds
from maskframe.operators import entries, raw, report

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_path_is_cut_a_few_times(spark):
    """It was cut once for every type that has keys, 80 times and more a leaf."""
    df = spark.range(1).select(F.uuid().alias("path"))
    assert plan(df.select(detect.path_type(F.col("path")).alias("found"))).count("regexp_extract(") <= 8


def test_a_value_is_tested_once(spark):
    df = spark.range(1).select(*(F.uuid().alias(name) for name in ("path", "value", "kind")))
    found = detect.detect(F.col("path"), F.col("value"), F.col("kind"))
    assert plan(df.select(found.alias("found"))).count("[hH][tT][tT][pP]") == 1


def test_values_are_judged_before_they_are_repeated_by_path(spark):
    below = plan(kinds.detected_values(spark, SF)).split("Generate explode", 1)
    assert len(below) == 2 and "[hH][tT][tT][pP]" not in below[0] and "[hH][tT][tT][pP]" in below[1]


PATHS = [
    "", "id", "a.customerId", "a.customer_id[3]", "items[].sku", "user.email", "User.E_Mail", "x.screenName[]", "a.name", "a.b-name", "cvvResult.code", "a.cvv_result.code", "AVS_RESULT.MESSAGE", "note\n", "a.é",
    "a.accessToken", "zipCode", "a.iso_country[0][1]", "a[٣]", "name[x]", "a.dateOfBirth\r\n", "a.id\x85", "a.id\n\n", "K.phone", "a.İd", "HANDLE", "a.store_default_currency_code",
]


def test_a_known_path_has_the_type_of_the_column(spark):
    rows = spark.createDataFrame([(path,) for path in PATHS], "path string").select("path", detect.path_type(F.col("path")).alias("found")).collect()
    assert {r.path: r.found for r in rows} == {path: detect.literal_path_type(path) for path in PATHS}


def test_a_path_of_a_log_is_judged_once_a_process(spark):
    """Each leaf of each batch had its path cut anew."""
    df = spark.range(1).select(F.lit("h").alias("har_id"), F.col("id").alias("entry"), F.uuid().alias("text"))
    rows = entries._decided(entries._coded(df, "errors"), entries.POLICY, [])
    assert r"(?:\[\d*\])*$" not in plan(rows)


def test_a_scramble_reads_no_hex_digits_one_by_one(spark):
    assert "conv(" not in plan(spark.range(1).select(fakes.scramble(F.uuid(), every=True).alias("made"))).lower()


#: Entries of usual and of odd builds.
ENTRIES = [
    '{"request":{"url":"https://a.b/c?sig=1","headers":[{"name":"Cookie","value":"a"},{"value":"{\\"name\\":\\"n\\",\\"k\\":[1,true]}","name":7},{"name":"x"},{"name":true,"value":null}],"postData":{"mimeType":"application/json","text":"{\\"id\\":\\"cus_12345\\",\\"ok\\":true,\\"n\\":1.50}","params":[{"name":"token","value":1.0}]}}}',
    '{"request":{"headers":"[{\\"name\\":\\"Cookie\\",\\"value\\":\\"secret\\"}]","url":"{\\"a\\":1}"},"serverIPAddress":"8.8.8.8"}', '{"request":"{\\"headers\\":[{\\"name\\":\\"Cookie\\",\\"value\\":\\"secret\\"}]}"}',
    '{"request.headers[0]":{"name":"Cookie","value":"secret"},"request":{"headers":[{"name":"a","valued":"b"}]}}', '{"request":{"headers[0]":{"name":"Cookie","value":"s"},"cookies":[null,"x"]},"response":[]}',
    '{"response":{"redirectURL":true,"content":{"mimeType":"application/xml","text":"<a><b x=\\"1\\">t</b><c/><b>u@v.wx</b></a>"},"headers":[{"name":"Set-Cookie","value":{"a":["b",{"name":"c"}]}}]},"request":null}',
    '{"response":{"content":{"mimeType":"image/png","text":"{\\"email\\":\\"a@b.co\\"}"},"cookies":[{"name":"sid","value":"[\\"x\\"]"}]},"other":{"request":{"headers":[{"name":"Cookie","value":"v"}]}}}',
    '{"request":{"postData":{"mimeType":"text/csv","text":"id,email\\r\\n1,a@b.co\\r\\n2,c@d.co\\r\\n"}},"response":{"content":{"mimeType":"application/json","text":"{\\"a\\":1}\\n{\\"a\\":\\"b\\"}"}}}',
]


def test_leaves_of_sections_are_those_of_a_walk():
    for text in ENTRIES:
        found, _, _ = entries._found(text)
        tree, bodies, _ = entries._read(text)
        walked = [tuple(x[field] for field in entries._FIELDS) for x in entries._walked(tree, bodies) if x["section"]]
        assert sorted(x[:-1] for x in found) == sorted(walked)
        made = {x: f"{x[entries._VALUE]}9" if x[2] == "number" else {"true": "false", "false": "true"}[x[entries._VALUE]] if x[2] == "boolean" else f"<{x[entries._VALUE]}>" for x in walked}
        assert entries.rebuild(text, [made[x[:-1]] for x in found]) == entries._rebuilt(tree, bodies, [made[x] for x in walked])


def test_a_path_of_a_payload_is_judged_once_a_process(spark):
    df = spark.range(1).select(F.uuid().alias("text"))
    assert r"(?:\[\d*\])*$" not in plan(raw.mask(df))


def test_a_number_is_not_tested_as_a_text(spark):
    """The type found stood twice, with all tests of the value."""
    leaf = {name: F.col(name) for name in ("kind", "value")}
    df = spark.range(1).select(*(F.uuid().alias(name) for name in ("by_path", "kind", "value")))
    assert plan(df.select(raw.found_type(F.col("by_path"), leaf).alias("found"))).count("[hH][tT][tT][pP]") == 1


def test_windows_of_seeds_make_no_arrays(spark):
    """Each window of four hashes was an array of its own."""
    text = spark.range(1).select(F.uuid().alias("text"))
    assert "array_min" not in plan(text.select(report._seeds(F.col("text")).alias("seeds")))


def test_seeds_of_short_and_long_texts_are_the_same(spark):
    value = "Zoë Grünwald 漢字"
    texts = [("short", f"to {value}, by mail"), ("long", f"{'word ' * 60}{value}, by mail"), ("none", "to Zoë Grunwald 漢字")]
    found = report.leaks(spark.createDataFrame([(value,)], "value string"), spark.createDataFrame(texts, "doc_id string, text string")).collect()
    assert sorted(r.doc_id for r in found) == ["long", "short"]


def test_targets_are_written_many_a_batch():
    """Each target was an Arrow batch of its own."""
    place = lambda i: {"har_id": "h", "entry": i, "method": "GET", "url": "u"}
    rows = [
        {"target_key": f"{i // 2:05}", "section": "body", "name": "n", "original": "o", "replacement": "r", "default": i % 2 == 1, "redact": False, "reason": "b" if i % 2 else "a", "n": 2, "places": [place(i + k) for k in (3, 0)]}
        for i in range(10_000)
    ]
    made = list(entries._merged(iter([pa.RecordBatch.from_pylist(rows[:4_999]), pa.RecordBatch.from_pylist(rows[4_999:])]), 3))
    assert len(made) == 3 and sum(batch.num_rows for batch in made) == 5_000
    first = made[0].to_pylist()[0]
    assert [x["entry"] for x in first["locations"]] == [0, 1, 3] and first["occurrences"] == 4 and first["default"] and first["reason"] == "b"
