import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.errors import ConfigurationError, DownstreamClosed, MissingMetadata, SchemaError
from tideline.functions.scalars import Granularity
from tideline.operators import batching, compliance, decode, layout, routing, schema_mode
from tideline.session import configure
from tideline.sources import landing


def requests(spark, signal, *trees):
    configure(spark)
    return landing.from_json_text(spark.createDataFrame([(json.dumps(t),) for t in trees], "value string"), signal)


def attr(key, text):
    return {"key": key, "value": {"stringValue": text}}


LOG = {"timeUnixNano": "1000000000", "severityNumber": 9, "severityText": "INFO", "body": {"stringValue": "test log body"}, "traceId": "01" * 16, "spanId": "02" * 8}


def test_logs(spark):
    tree = {"resourceLogs": [{"resource": {"attributes": [attr("service.name", "svc-a"), attr("service.name", "later")]},
                              "scopeLogs": [{"scope": {"name": "scope-a"}, "logRecords": [LOG]}, {"scope": {"name": "scope-b"}, "logRecords": [LOG, {}]}]},
                             {"scopeLogs": [{"logRecords": [LOG]}]}]}
    rows = decode.decode_logs(requests(spark, "logs", tree, {"resourceLogs": []}, {})).collect()
    assert len(rows) == 4 and len(rows[0]) == 13
    assert sorted(r["scope_name"] for r in rows) == ["", "scope-a", "scope-b", "scope-b"]
    assert sorted(r["service_name"] for r in rows) == ["svc-a"] * 3 + ["unknown"]
    full = next(r for r in rows if r["scope_name"] == "scope-a")
    assert full["timestamp"] == dt.datetime(1970, 1, 1, 0, 0, 1) and full["body"] == "test log body" and full["trace_id"] == "01" * 16
    empty = next(r for r in rows if r["body"] == "")
    assert all(v is not None for v in empty) and empty["attributes"] == "{}"
    with pytest.raises(Exception, match="out of range"):
        decode.decode_logs(requests(spark, "logs", {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": str(2**64 - 1)}]}]}]})).collect()


def test_traces(spark):
    span = {"name": "test-span", "kind": 1, "startTimeUnixNano": "1000000000", "endTimeUnixNano": "2000000000", "status": {"code": 2, "message": "something failed"}}
    rows = decode.decode_traces(requests(spark, "traces", {"resourceSpans": [{"scopeSpans": [{"spans": [span, {}]}]}]}), nanos_too=True).collect()
    assert len(rows) == 2 and len(rows[0]) == 17
    assert (rows[0]["status_code"], rows[0]["status_message"], rows[0]["end_time_unix_nano"]) == (2, "something failed", 2 * 10**9)
    assert (rows[1]["status_code"], rows[1]["status_message"], rows[1]["scope_name"]) == (0, "", "")


def test_metrics(spark):
    point = {"timeUnixNano": "1"}
    kinds = [{"gauge": {"dataPoints": [point | {"asDouble": 42.5}, point | {"asInt": "42"}, point]}}, {"sum": {"dataPoints": [point | {"asDouble": 100.0}]}},
             {"histogram": {"dataPoints": [point | {"count": 5, "sum": 250.0}, point | {"count": "5"}]}}, {"summary": {"dataPoints": [point]}},
             {"exponentialHistogram": {"dataPoints": [point]}}]
    tree = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": f"m{i}", "unit": "1"} | k for i, k in enumerate(kinds)]}]}]}
    rows = decode.decode_metrics(requests(spark, "metrics", tree)).collect()
    assert sorted((r["name"], r["value"]) for r in rows) == [("m0", 0.0), ("m0", 42.0), ("m0", 42.5), ("m1", 100.0), ("m2", 5.0), ("m2", 250.0)]
    assert len(rows[0]) == 10


GOOD = '{"service.name":"my-service"}'


def batch(spark, *resources, attributes="{}"):
    return spark.createDataFrame([(attributes, r) for r in resources], "attributes string, resource_attributes string")


@pytest.mark.parametrize("bad", ["{}", "not json {{{", None, "[1]"])
def test_compliance_modes(spark, bad):
    M, E, O = compliance.Mode, compliance.Engine, compliance.Outcome
    outcome, df = E(M.STRICT).assess(batch(spark, GOOD))
    assert outcome is O.COMPLIANT and E.is_tagged(df) and E.is_tagged(E.tag(df))
    assert E(M.STRICT).assess(df)[0] is O.COMPLIANT
    for rows in ((bad,), (GOOD, bad)):
        with pytest.raises(MissingMetadata):
            E(M.STRICT).assess(batch(spark, *rows))
        assert E(M.QUARANTINE).assess(batch(spark, *rows))[0] is O.QUARANTINED
    assert E(M.OFF).assess(batch(spark, bad))[0] is O.COMPLIANT
    assert E(M.STRICT).check(batch(spark, GOOD).limit(0)) and not E(M.STRICT).check(spark.range(1))


def test_remap(spark):
    engine = compliance.Engine(compliance.Mode.REMAP, {"custom_verb": "http.request.method"})
    outcome, df = engine.assess(batch(spark, GOOD, attributes='{"custom_verb":"GET","n":1}'))
    assert outcome is compliance.Outcome.REMAPPED and engine.is_tagged(df)
    assert json.loads(df.first()["attributes"]) == {"http.request.method": "GET", "n": 1}
    outcome, df = engine.assess(batch(spark, "{}", attributes='{"custom_verb":"GET"}'))
    assert outcome is compliance.Outcome.QUARANTINED and "custom_verb" not in df.first()["attributes"]
    with pytest.raises(ConfigurationError):
        compliance.Engine(compliance.Mode.REMAP, {"a": "b", "b": "c"})


def test_split_by_batch(spark):
    df = batch(spark, GOOD, GOOD, "{}", GOOD).withColumn("b", F.lit(1)).union(batch(spark, GOOD).withColumn("b", F.lit(None)))
    good, bad = compliance.Engine(compliance.Mode.QUARANTINE).split(df, "b")
    assert (good.count(), bad.count()) == (1, 4)


def table_schema():
    return StructType.fromDDL("timestamp timestamp_ntz, severity_text string, service_name string")


def test_schema_modes(spark):
    df = spark.createDataFrame([("a", "5", "x")], "service_name string, severity_text string, extra string")
    S = schema_mode.SchemaMode
    assert schema_mode.apply(df, S.AUTO, None) is df and schema_mode.apply(df, S.FIXED, table_schema()) is df
    with pytest.raises(SchemaError, match="new column extra"):
        schema_mode.apply(df, S.AUTO, table_schema())
    assert schema_mode.apply(df.drop("extra"), S.AUTO, table_schema()).columns == ["service_name", "severity_text"]
    with pytest.raises(SchemaError, match="mismatch"):
        schema_mode.apply(df.select(F.lit(1).alias("service_name")), S.AUTO, table_schema())
    out = schema_mode.apply(df, S.CATALOG, StructType.fromDDL("severity_text int, service_name int, more string"))
    assert out.columns == ["service_name", "severity_text"] and tuple(out.first()) == (None, 5)
    with pytest.raises(SchemaError):
        schema_mode.apply(df, S.FIXED, table_schema(), validate=True)


def logs(spark):
    t = dt.datetime(2024, 6, 9)
    rows = [(t, "INFO", "service-a"), (t + dt.timedelta(hours=1), "ERROR", "service-b"), (t, "WARN", "service-a")]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, severity_text string, service_name string")


def test_sort_and_partition(spark):
    assert [r["severity_text"] for r in layout.sort_signal(logs(spark), "logs").collect()] == ["INFO", "WARN", "ERROR"]
    assert layout.with_partition_path(logs(spark)).select("partition").distinct().count() == 2
    assert layout.with_partition_path(logs(spark), granularity=Granularity.DAILY).select("partition").distinct().count() == 1
    with pytest.raises(SchemaError, match="Missing name"):
        layout.sort_signal(logs(spark), "traces")
    with pytest.raises(SchemaError):
        layout.with_partition_path(logs(spark).withColumn("timestamp", F.lit("x")))
    assert layout.sort_signal(spark.range(2), "other").count() == 2


def test_flush_policy_and_replay(spark):
    p = batching.FlushPolicy(max_rows=2)
    assert p.due(3, 0, 0) and not p.due(0, 10**12, 10**6) and batching.FlushPolicy(max_bytes=1).due(1, 1, 0) and not batching.FlushPolicy().due(1, 1, 59.9)
    rows = [("t", i, 60, 10, float(i)) for i in range(6)] + [("t", 6, 1, 1, 100.0), ("u", 0, 1, 1, 0.0)]
    out = batching.replay(spark.createDataFrame(rows, "table_name string, batch long, rows long, bytes long, at double"), batching.FlushPolicy(max_rows=100, max_seconds=50))
    assert [r["flush"] for r in out.where("table_name = 't'").orderBy("batch").collect()] == [0, 0, 1, 1, 2, 2, 3]


def test_routing(spark):
    assert routing.TableMapping().table_for("logs") == "otel_logs" and routing.TableMapping(unified="t").table_for("logs") == "t"
    assert routing.TableMapping().signal_type_column is None and routing.TableMapping(unified="t").signal_type_column == "signal_type"
    empty = routing.TableMapping(unified="t").prepared(spark.range(0), "logs")
    assert empty.columns == ["id", "signal_type"]
    with pytest.raises(SchemaError):
        decode.add_signal_type(empty, "signal_type", "x")
    with pytest.raises(ConfigurationError):
        routing.TableMapping().table_for("x")
    seen = []
    routing.Fanout([lambda d, i: seen.append((d.count(), i)), lambda d, i: seen.append(d.count())])(spark.range(3), 5)
    assert seen == [(3, 5), 3]
    with pytest.raises(ConfigurationError):
        routing.Fanout([])

    def closed(df, i):
        raise BrokenPipeError

    with pytest.raises(DownstreamClosed):
        routing.Fanout([closed])(spark.range(1))
