"""Edge cases of predicates and scalar functions."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakframe.functions import predicates as P
from cloakframe.functions import text as X


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_text_rules(spark):
    texts = ["ok", "", " ", "  ", "a\tb", "a\u0085b", "\n", None, "​"]
    got = values(spark, texts, P.text_ok("t"), P.text_error("f", "t")["message"])
    control, empty = "f must not contain control characters", "f must not be empty"
    assert got == [
        (True, None), (False, empty), (False, empty), (False, empty), (False, control),
        (False, control), (False, empty), (None, None), (True, None),
    ]


def test_bounds_count_code_points(spark):
    got = values(spark, ["é" * 128, "😀" * 128, "a" * 129], P.bounded_text_ok("t", 128))
    assert got == [(True,), (True,), (False,)]


@pytest.mark.parametrize("value,message", [
    ("a=1;b=2", None),
    ("a", "c labels must use key=value format"),
    ("=1", "c label key must not be empty"),
    ("a=", "c label value must not be empty"),
    ("a=1=2", "c label value must not contain '='"),
    ("a b=1", "c label key contains invalid characters"),
    ("a=1;a=2", "c label keys must be unique"),
    ("a=1;", "c labels must use key=value format"),
    ("a=1;a=2;b", "c label keys must be unique"),
    ("x" * 130, "c exceeds maximum allowed length: 128"),
    (" ", "c must not be empty"),
])
def test_labels(spark, value, message):
    assert values(spark, [value], P.labels_error("c", "t")["message"], P.labels_ok("t")) == [
        (message, message is None)
    ]


def test_hex(spark):
    got = values(spark, ["", "a", "0g", "AbCd", "é"], P.hex_ok("t"), P.hex_error("h", "t")["message"])
    assert [g[0] for g in got] == [False, False, False, True, False]
    assert got[0][1] == "h must not be empty"
    assert got[1][1] == "h must have an even number of hex characters"
    assert got[2][1] == "h must contain only hexadecimal characters"


def test_json_rules(spark):
    deep_ok = "[" * 128 + "]" * 128
    texts = ['{"a": 1}', "[1]", '{"a":1,"a":2}', deep_ok, "[" + deep_ok + "]", "{",
             '{"$serde_json::private::Number": "1"}', '{"v": "$serde_json::private::x"}',
             '{"a": "' + "[" * 200 + '"}', None]
    got = [g[0] for g in values(spark, texts, P.json_shape_error("m", "t")["message"])]
    assert got == [
        None, None, "m contains invalid JSON", None, "m is nested too deeply",
        "m contains invalid JSON", "m contains a reserved JSON object key", None, None, None,
    ]
    meta = [g[0] for g in values(spark, texts[:2], P.metadata_error("t")["message"])]
    assert meta == [None, "metadata must be a JSON object when present"]


def test_base64(spark):
    texts = ["", "QQ", "QQ==", "QR", "Q", "QUI", "QUI=", "QUJD", "Q*JD", "-_-_", None]
    got = values(spark, texts, X.base64url_ok("t"), X.base64_ok("t"), X.base64url_size("t"))
    assert [g[0] for g in got] == [True, True, False, False, False, True, False, True, False, True, None]
    assert [g[1] for g in got] == [True, False, True, False, False, False, True, True, False, False, None]
    assert [g[2] for g in got][1] == 1 and [g[2] for g in got][5] == 2


def test_canonical_json(spark):
    texts = ['{ "b": "2", "a": "1", "c": { "z": "9", "y": "8" } }', '["c", "a", "b"]', "nope"]
    assert values(spark, texts, X.canonical_json("t")) == [
        ('{"a":"1","b":"2","c":{"y":"8","z":"9"}}',), ('["c","a","b"]',), (None,),
    ]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.dictionaries(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=4),
                                st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=4), max_size=4),
                min_size=1, max_size=8))
def test_canonical_json_ignores_key_order(spark, docs):
    texts = [json.dumps(d) for d in docs] + [
        json.dumps(dict(reversed(list(d.items()))), indent=1) for d in docs
    ]
    got = values(spark, texts, X.canonical_json("t"))
    assert got[: len(docs)] == got[len(docs) :]


def test_record_json_sorts_nested_fields(spark):
    df = spark.sql("select named_struct('z', 1, 'a', map('k2', 2, 'k1', 1)) as s, cast(null as int) as b")
    assert df.select(X.record_json(df, ["s", "b"])).first()[0] == (
        '{"b":null,"s":{"a":{"k1":1,"k2":2},"z":1}}'
    )


def test_sanitize_and_status(spark):
    assert values(spark, ["a\u0000b\u0085c" + "d" * 300], X.sanitize("t", 5)) == [("abcdd",)]
    got = values(spark, ["not_found", "forbidden", "storage"], X.error_status("t"))
    assert got == [(404,), (403,), (500,)]


def test_clock_saturates(spark):
    row = (0, 10, -100, 5, 50, 60, 1000, 2000, 2000)
    names = ["local_start_us", "local_end_us", "offset_us", "round_trip_us", "midpoint_us",
             "radius_us", "max_clock_skew_ms", "max_round_trip_ms", "max_radius_ms"]
    df = spark.createDataFrame([row, (*row[:2], 1_000_001, *row[3:])], ", ".join(f"{n} long" for n in names))
    assert [r[0] for r in df.select(P.clock_acceptable()).collect()] == [True, False]


def test_aad_field(spark):
    got = values(spark, ["a=1;b=2", "b=;a=3", "x"], X.aad_field("t", "a"), X.aad_field("t", "b"))
    assert got == [("1", "2"), ("3", ""), (None, None)]
