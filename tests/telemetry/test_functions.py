import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.errors import ConfigurationError, SchemaError
from tideline.functions import scalars
from tideline.session import configure


def one(spark, column):
    return configure(spark).range(1).select(column.alias("x")).first()["x"]


def test_hex(spark):
    assert one(spark, scalars.hex_text(F.lit(b"\x01" * 16))) == "01" * 16
    assert one(spark, scalars.hex_text(F.lit(b"\xde\xad"))) == "dead"
    assert one(spark, scalars.hex_text(F.lit(b""))) == ""


def test_double_text(spark):
    cases = {1.0: "1", 100.0: "100", 1.5: "1.5", 1e21: "1" + "0" * 21, 1e-7: "0.0000001", -2.5e-5: "-0.000025", 1.2345e8: "123450000",
             12345678.9: "12345678.9", 0.0: "0", float("inf"): "inf", float("-inf"): "-inf", float("nan"): "NaN"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "d double, t string").select(scalars.double_text(F.col("d")).alias("x"), "t").collect()
    for r in rows:
        assert r["x"] == r["t"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_double_text_reads_back(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "d double").select("d", scalars.double_text(F.col("d")).alias("t")).collect()
    assert all(float(r["t"]) == r["d"] and "E" not in r["t"] for r in rows)


def value(text):
    from tideline.schemas import ANY
    return F.from_json(F.lit(text), f"v {ANY}")["v"]


@pytest.mark.parametrize(("text", "want"), [
    ('{"v":{"stringValue":"a\\"b"}}', 'a"b'), ('{"v":{"intValue":"42"}}', "42"), ('{"v":{"intValue":42}}', "42"), ('{"v":{"doubleValue":1.23}}', "1.23"),
    ('{"v":{"boolValue":true}}', "true"), ('{"v":{"bytesValue":"3q0="}}', "dead"), ('{"v":{}}', ""), ("{}", None),
    ('{"v":{"arrayValue":{"values":[{"stringValue":"x"},{"intValue":"7"}]}}}', "[x,7]"), ('{"v":{"arrayValue":{}}}', "[]"),
    ('{"v":{"kvlistValue":{"values":[{"key":"b","value":{"intValue":1}},{"key":"a","value":{"arrayValue":{"values":[{}]}}}]}}}', '{"a":"[]","b":"1"}'),
])
def test_any_value(spark, text, want):
    assert one(spark, scalars.any_value_text(value(text))) == want


def test_attributes(spark):
    from tideline.schemas import ATTRIBUTES
    text = '{"v":[{"key":"z","value":{"intValue":1}},{"key":"a","value":{}},{"key":"gone"},{"key":"z","value":{"boolValue":false}}]}'
    entries = F.from_json(F.lit(text), f"v {ATTRIBUTES}")["v"]
    assert one(spark, scalars.attributes_json(entries)) == '{"a":"","z":"false"}'
    assert one(spark, scalars.attributes_json(F.from_json(F.lit("{}"), f"v {ATTRIBUTES}")["v"])) == "{}"


def test_nanos(spark):
    assert one(spark, scalars.nanos(F.lit(str(2**63 - 1)))) == 2**63 - 1
    assert one(spark, scalars.nanos(F.lit(None).cast("string"))) == 0
    with pytest.raises(Exception, match="out of range"):
        one(spark, scalars.nanos(F.lit(str(2**63))))


@pytest.mark.parametrize(("ns", "path"), [(1717891200 * 10**9, "year=2024/month=06/day=09/hour=00/"), (0, "year=1970/month=01/day=01/hour=00/"), (-1500, "year=1969/month=12/day=31/hour=23/")])
def test_partition_path(spark, ns, path):
    ts = scalars.timestamp_of(F.lit(ns).cast("long"))
    assert one(spark, scalars.partition_path(ts)) == path
    assert one(spark, scalars.partition_path(ts, scalars.Granularity.DAILY)) == path[:path.index("hour")]


def test_rename_keys_keeps_types(spark):
    assert json.loads(one(spark, scalars.rename_keys(F.lit('{"a":1,"b":[true]}'), {"a": "c"}))) == {"b": [True], "c": 1}
    rename = lambda t, rules: one(spark, scalars.rename_keys(F.lit(t).cast("string"), rules))
    assert rename('{"a":1,"c":2}', {"a": "c"}) == '{"c":1}'
    assert rename("not json {{{", {"a": "c"}) == "not json {{{" and rename(None, {"a": "c"}) is None and rename("{}", {"a": "c"}) == "{}"


def test_small_helpers(spark):
    assert scalars.WireFormat.parse("IPC") is scalars.WireFormat.IPC
    with pytest.raises(ConfigurationError):
        scalars.WireFormat.parse("avro")
    assert scalars.load_label("logs", "q", 3) == scalars.load_label("logs", "q", 3) and scalars.load_label("logs") != scalars.load_label("logs")
    with pytest.raises(SchemaError):
        scalars.require_string(spark.range(1), "id")
