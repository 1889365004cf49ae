"""Fakes, detection and name rules on hand-written values."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from maskframe.functions import detect, fakes, network, paths
from maskframe.functions.detect import path_type
from maskframe.sources import formats


def column(spark, values, make, ddl="v string"):
    rows = [(v,) if not isinstance(v, tuple) else v for v in values]
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(make).collect()]


def test_scramble_keeps_shape_and_differs(spark):
    values = ["cus_Ab12", "0123-xyz", "1", "", None, "Zé 9", "A" * 200]
    once = column(spark, values, fakes.scramble(F.col("v")))
    assert once == column(spark, values, fakes.scramble(F.col("v")))
    shape = lambda s: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", s)))
    for before, after in zip(values, once, strict=True):
        if not before:
            assert after == before
        else:
            assert shape(before) == shape(after) and before != after
    assert once != column(spark, values, fakes.scramble(F.col("v"), "other seed"))
    assert once[0] != column(spark, values[:1], fakes.scramble(F.col("v"), salt="data[0].id"))[0]


def test_whole_numbers_are_a_bijection_of_their_digit_count(spark):
    numbers = spark.range(0, 12_000).select(fakes.whole_number(F.col("id")).alias("f"), "id")
    assert numbers.select("f").distinct().count() == 12_000
    assert numbers.where("length(cast(f as string)) <> length(cast(id as string)) OR f = id").count() == 0
    assert column(spark, [-42, 12345678901234], fakes.whole_number(F.col("v")), "v long")[0] < 0


@pytest.mark.parametrize("kind", [k for k in fakes.TYPES if k not in ("priceAmount", "unixTimestamp", "boolean", "nestedJson", "custom")])
def test_every_string_type_has_a_fake(spark, kind):
    values = ["Ada Koch", "AT", "2024-02-29T10:00:00Z", "10.1.2.3", "x@y.org", "eur"]
    made = column(spark, values, fakes.fake(kind, F.col("v")))
    if kind == "null":
        assert made == [None] * len(values)
    elif kind == "redact":
        assert set(made) == {fakes.REDACTED}
    elif kind not in ("preserve", "auto") and not kind.startswith(("cvv", "avs")):
        assert all(a != b for a, b in zip(values, made, strict=True))
    assert column(spark, ["", None], fakes.fake(kind, F.col("v"))) in (["", None], [None, None], [fakes.REDACTED] * 2)


def test_places_keep_width_and_case(spark):
    shape = lambda v: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", v)))
    codes = ["97403", "01234", "SW1A 1AA", "K1A-0B1", "D-10115", "AT-1010", "12345-6789", "1010 ab"]
    made = column(spark, codes, fakes.fake("postalCode", F.col("v")))
    assert [shape(v) for v in made] == [shape(v) for v in codes] and not set(made) & set(codes)
    assert made[1][0] == "0" and made[4].startswith("D-") and made[5].startswith("AT-") and not made[3].startswith("K1A-")
    for kind in ("country", "countryCode", "state", "stateOrProvince"):
        short = ["US", "us", "USA", "usa"]
        made = column(spark, short, fakes.fake(kind, F.col("v")))
        assert [shape(v) for v in made] == [shape(v) for v in short] and not set(made) & set(short), kind
    names = ["SPRINGFIELD", "springfield", "Springfield", "12", "\u00dcBERLINGEN"]
    for kind in ("city", "country", "state", "street", "streetSecondary"):
        upper, lower, mixed, digits, accent = column(spark, names, fakes.fake(kind, F.col("v")))
        assert upper == upper.upper() and lower == lower.lower() and mixed not in (mixed.upper(), mixed.lower()) and accent == accent.upper(), kind


def test_dates_keep_their_form_and_codes_their_row(spark):
    made = column(spark, ["2024-02-29", "2024-02-29T10:11:12.5Z"], fakes.fake("isoDate", F.col("v")))
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", made[0]) and made[1].endswith("T10:11:12.5Z")
    pair = column(spark, ["x"], F.concat_ws("/", fakes.fake("cvvCode", F.col("v"), parent="card"), fakes.fake("cvvMessage", F.col("v"), parent="card")))[0]
    code, message = pair.split("/")
    assert dict(fakes.CHECK_RESULTS)[code] in fakes.CHECK_RESULTS[[c for c, _ in fakes.CHECK_RESULTS].index(code)][1] or message


@pytest.mark.parametrize(
    ("path", "value", "kind", "wanted"),
    [
        ("data[0].email", "n/a", "string", "preserve"), ("user.screenName", "x", "string", "id"), ("a.customer_id", "cus_1234", "string", "id"), ("a.customer_id", "active", "string", "preserve"),
        ("a.orderId", "5", "number", "preserve"), ("a.orderId", "5000", "number", "id"), ("a.firstName", "Bo", "string", "firstName"), ("cvv_result.code", "M", "string", "cvvCode"),
        ("x.name", "Ada Koch", "string", "fullName"), ("x.name", "ur_mama", "string", "id"), ("x.name", "Widget", "string", "preserve"), ("x.q", "a@b.co", "string", "email"),
        ("x.q", "0123456789abcdef0123456789abcdef", "string", "id"), ("x.q", "4111111111111111", "string", "redact"), ("x.q", "4111111111111112", "string", "preserve"),
        ("x.q", "+49 (30) 123-4567", "string", "phone"), ("x.q", "1234567", "string", "preserve"), ("x.q", "2024-01-02", "string", "isoDate"), ("x.dob", "2024-01-02", "string", "birthDate"),
        ("x.message", "hello there", "string", "preserve"), ("x.q", "https://a.b/c", "string", "url"), ("x.CountryCode", "AT", "string", "countryCode"),
    ],
)
def test_detection(spark, path, value, kind, wanted):
    found = spark.range(1).select(detect.detect(path_type(F.lit(path)), F.lit(value), F.lit(kind))).first()[0]
    assert found == wanted


def test_paths(spark):
    row = spark.range(1).select(
        paths.normalize(F.lit("a[0].b[12].c")), paths.tail(F.lit("a.first-name")), paths.tail(F.lit("a.b[3]")), paths.tail(F.lit("Created (UTC)")), paths.masked_name(F.lit("a.b.json")),
        paths.masked_name(F.lit(".env")), paths.masked_name(F.lit("x")), paths.modified_lines(F.lit("a\nb\nc"), F.lit("a\nx\nc\nd")), paths.accessor(F.lit("data[].first-name")),
    ).first()
    assert list(row) == ["a[].b[].c", "name", "b", "", "a.b.obfuscated.json", ".env.obfuscated", "x.obfuscated", [2], 'data?.[0]?.["first-name"]']


def test_network_names(spark):
    yes = ["https://u:p@h/x", "https://h/?access_token=abc", "https://h/?clientSecret=1#k", "https://h/a b?sig=1"]
    no = ["https://h/?country_code=de", "/x?y=1", "https://h/path"]
    assert column(spark, yes + no, network.url_has_secrets(F.col("v"))) == [True] * 4 + [False] * 3
    made = column(spark, yes + no, network.redact_url(F.col("v")))
    assert made[4:] == no and made[1].startswith("https://h/?access_token=") and made[1] != yes[1] and made[2].endswith("#k")
    assert column(spark, ["10.0.0.1", "172.31.0.1", "8.8.8.8", "::1"], network.is_private_ip(F.col("v"))) == [True, True, False, True]
    assert column(spark, ["0.6:N,1.2:B,3.4:C,5.6", "abcdefgh12345678", "https://abcdefgh12345678"], network.looks_like_token(F.col("v"))) == [False, True, False]
    assert column(spark, ["code", "country_code", "accessToken"], network.is_secret_param(F.col("v"))) == [True, False, True]
    assert column(spark, ["Bearer  abc123"], network.fake_auth(F.col("v")))[0].startswith("Bearer  ")


def test_formats(spark):
    cases = {"": None, " <a/>": "xml", '{"a":1}': "json", '{"a":1}\n{"b":2}': "ndjson", "[\n1]": "json", "a=1&b=2": "form", "A" * 70: "form", 'a,b\n1,"x,y"': "csv", "hello": None}
    assert column(spark, list(cases), formats.detect_format(F.col("v"))) == list(cases.values())
    assert column(spark, ["a=1&b=%20x&a=3"], F.to_json(formats.parse_form(F.col("v")))) == ['[{"k":"a","v":"3"},{"k":"b","v":" x"}]']
    assert column(spark, ["bt_signature=x&bt_payload=PGEvPg=="], formats.unwrap_base64(F.col("v"))) == ["<a/>"]
