import datetime as dt
import json
import struct

import pyarrow as pa
import pytest

from tideline import config
from tideline.errors import ConfigurationError, StorageError
from tideline.functions.scalars import Granularity, WireFormat
from tideline.operators import layout
from tideline.operators.compliance import Engine, Mode
from tideline.operators.routing import TableMapping
from tideline.session import configure
from tideline.sources import landing, wire
from tideline.streaming import sinks
from tideline.streaming.pipeline import Pipeline


def field(number, wire_type, body):
    tag = bytes([number << 3 | wire_type])
    return tag + (bytes([len(body)]) + body if wire_type == 2 else body)


def message(service="svc", body="hello"):
    value = field(1, 2, service.encode())
    resource = field(1, 2, field(1, 2, b"service.name") + field(2, 2, value))
    record = field(1, 1, struct.pack("<Q", 10**9)) + field(2, 0, b"\x09") + field(5, 2, field(1, 2, body.encode())) + field(9, 2, b"\xde\xad") + field(7, 0, b"\x01")
    return field(1, 2, field(1, 2, resource) + field(2, 2, field(2, 2, record)))


def test_binary_requests(spark):
    tree = json.loads(wire.to_json(message(), "logs"))
    record = tree["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]
    assert record == {"timeUnixNano": "1000000000", "severityNumber": 9, "body": {"stringValue": "hello"}, "traceId": "dead"}
    assert wire.to_json(b"\xff\xff garbage", "logs") is None and wire.to_json(b"", "logs") == "{}"
    bodies = spark.createDataFrame([("application/x-protobuf; v=1", message()), ("application/x-protobuf", b"\x0a\xff"), (None, b'{"resourceLogs":[]}'),
                                    ("text/plain", b"{ not valid json }"), ("application/json", None)], landing.BODIES)
    assert [r["status"] for r in landing.parse_bodies(bodies, "logs").collect()] == ["ok", "bad_request", "empty", "bad_request", "bad_request"]
    rows = landing.decoded(bodies, "logs").collect()
    assert [(r["service_name"], r["body"], r["trace_id"]) for r in rows] == [("svc", "hello", "dead")]


def test_payloads():
    table = pa.table({"id": [1, 2, 3], "name": ["a", "b", None]})
    assert sinks.payload(table, WireFormat.JSON).splitlines()[0] == b'{"id":1,"name":"a"}'
    assert sinks.payload(table, WireFormat.CSV).splitlines()[0] == b'"id","name"'
    assert pa.ipc.open_stream(sinks.payload(table, WireFormat.IPC)).read_all() == table
    with pytest.raises(StorageError):
        sinks.payload(table, WireFormat.IPC, 1)


def test_queue_messages(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "f int").coalesce(1)
    rows = sinks.QueueSink("b", "t", WireFormat.JSON).messages(df).collect()
    assert [(r["key"], bytes(r["value"])) for r in rows][0] == ("", b'{"f":1}') and len(rows) == 3
    one = sinks.QueueSink("b", "t", WireFormat.IPC, per_batch=True).messages(df).collect()
    assert pa.ipc.open_stream(bytes(one[0]["value"])).read_all().num_rows == 3
    with pytest.raises(StorageError):
        sinks.QueueSink("b", "t", WireFormat.JSON)(df)


class FolderTransport:
    """Stands in for the server: every call is a file."""

    def __init__(self, folder, fail=""):
        self.folder, self.fail = str(folder), fail

    def load(self, table, label, body):
        self.step("v1", table, label, body)

    def step(self, name, table, label, body=b""):
        import time
        with open(f"{self.folder}/{time.time_ns()}-{name}", "wb") as f:
            f.write(body)
        if name == self.fail:
            raise StorageError(name)

    def calls(self):
        import os
        return [f.split("-")[1] for f in sorted(os.listdir(self.folder))]


@pytest.mark.parametrize(("mode", "fail", "want"), [("v1", "", ["v1"]), ("v2", "", ["begin", "load", "prepare", "commit"]), ("v2", "load", ["begin", "load", "rollback"])])
def test_loads(spark, tmp_path, mode, fail, want):
    transport = FolderTransport(tmp_path, fail)
    c = sinks.LoadConfig(["http://x"], "u", database="d", mapping=TableMapping(unified="t"), transaction=sinks.TransactionMode(mode))
    sink = sinks.LoadSink(c, "logs", "q", transport)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").coalesce(1)
    if fail:
        with pytest.raises(Exception):  # noqa: B017
            sink(df)
    else:
        sink(df)
        data = max(tmp_path.iterdir(), key=lambda p: p.stat().st_size).read_bytes()
        assert pa.ipc.open_stream(data).read_all().column("signal_type").to_pylist() == ["logs", "logs"]
    assert transport.calls() == want
    sink(df.limit(0))
    assert transport.calls() == want


def test_load_config():
    for bad in ({"fe_urls": []}, {"username": " "}, {"database": ""}):
        with pytest.raises(ConfigurationError):
            sinks.LoadConfig(**({"fe_urls": ["x"], "username": "u", "database": "d"} | bad))


def test_stream_to_table_and_replay(spark, tmp_path):
    configure(spark)
    root = tmp_path / "landing"
    for signal in ("logs", "traces", "metrics"):
        (root / "v1" / signal).mkdir(parents=True)
    line = json.loads(wire.to_json(message(), "logs"))
    (root / "v1/logs/a.json").write_text("\n".join([json.dumps(line)] * 3 + ["{ broken"]))
    sink = sinks.TableSink("logs", path=str(tmp_path / "table"), query_id="q")
    quarantined = []
    run = Pipeline(spark, str(root), str(tmp_path / "cp"), {"logs": sink}, engine=Engine(Mode.QUARANTINE), quarantine=lambda d, i: quarantined.append(d.count()))
    run.run_until_drained()
    assert sinks.read_table(spark, str(tmp_path / "table")).count() == 3
    line["resourceLogs"][0].pop("resource")
    (root / "v1/logs/b.json").write_text(json.dumps(line))
    run.run_until_drained()
    assert sinks.read_table(spark, str(tmp_path / "table")).count() == 3 and quarantined == [1]
    sink(landing.decoded(landing.read_json_lines(spark, str(root), "logs"), "logs"), 0)  # a replay of batch 0 replaces it
    table = sinks.read_table(spark, str(tmp_path / "table"))
    assert table.count() == 4 and table.select("year", "hour").distinct().collect()[0] == ("1970", "00")
    found = layout.read_range(spark, f"{tmp_path}/table/batch=q-0", dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 1, 0, 0, 5))
    assert found.count() == 4
    assert sinks.TableSink("logs", dry_run=True)(table.drop("year", "month", "day", "hour", "batch")) == 4


def test_config_precedence(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('[kafka]\ntopic = "file"\nbrokers = "b"\n[iceberg]\nlogs_table = "l"\ntraces_table = "t"\npartition_granularity = "daily"\nschema_mode = "catalog"\n')
    app = config.load(str(file), {"TIDELINE_KAFKA__TOPIC": "env", "TIDELINE_ICEBERG__MAX_BATCH_RECORDS": "10"}, {"server": {"http_addr": "h"}})
    assert app.kafka.topic == "env" and app.kafka.brokers == "b" and app.server == {"grpc_addr": "0.0.0.0:4317", "http_addr": "h"}
    assert app.iceberg.policy().max_rows == 10 and app.iceberg.partition_granularity is Granularity.DAILY and app.chosen_sink() == "iceberg"
    for bad in ({"iceberg": {"logs_table": "a", "traces_table": "a"}}, {"iceberg": {"logs_table": "", "traces_table": ""}}, {"kafka": {"format": "avro"}}, {"kafka": {"nope": 1}}, {"iceberg": {"schema_mode": "x"}}):
        with pytest.raises(ConfigurationError):
            config.load(str(file), {}, bad)
    with pytest.raises(ConfigurationError):
        config.load(None, {}, {}).chosen_sink()
    assert config.load(None, {}, {"iceberg": {"dry_run": True}}).iceberg is None
    assert "lake.type" in " ".join(app.iceberg.spark_options())
    from tideline.__main__ import main
    assert main(["--config", str(file), "--check"]) == 0 and main(["--config", str(tmp_path / "none.toml"), "--check"]) == 2


def test_command_delivers_and_rehearses(spark, tmp_path):
    from tideline.__main__ import main

    for signal in ("logs", "traces", "metrics"):
        (tmp_path / "landing/v1" / signal).mkdir(parents=True)
    (tmp_path / "landing/v1/logs/a.json").write_text(wire.to_json(message(), "logs"))
    arguments = ["--landing", str(tmp_path / "landing"), "--output", str(tmp_path / "out")]
    assert main([*arguments[:3], str(tmp_path / "dry"), "--dry-run"]) == 0 and not (tmp_path / "dry/logs").exists()
    assert main(arguments) == 0
    assert [r["body"] for r in sinks.read_table(spark, str(tmp_path / "out/logs")).collect()] == ["hello"]


def test_pieces_and_quarantine(spark):
    table = pa.table({"id": list(range(500)), "name": ["x" * 40] * 500})
    for kind in WireFormat:
        pieces = list(sinks.pieces_under(table.to_batches(max_chunksize=70), kind, 4000))
        assert len(pieces) > 4 and all(len(p) <= 4000 for p in pieces)
    read = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in sinks.pieces_under(table.to_batches(), WireFormat.IPC, 4000)])
    assert read == table
    with pytest.raises(StorageError):
        list(sinks.pieces_under(table.to_batches(), WireFormat.JSON, 20))
    with pytest.raises(ConfigurationError):
        Pipeline(spark, "r", "c", {}, engine=Engine(Mode.QUARANTINE))


@pytest.mark.parametrize("signal", ["logs", "traces", "metrics"])
def test_binary_form_round_trip(signal):
    value = {"arrayValue": {"values": [{"intValue": "-5"}, {"kvlistValue": {"values": [{"key": "k", "value": {"boolValue": True}}]}}, {"bytesValue": "3q0="}]}}
    attributes = [{"key": "a", "value": value}, {"key": "d", "value": {"doubleValue": "0.1"}}]
    trees = {
        "logs": {"resourceLogs": [{"resource": {"attributes": attributes}, "scopeLogs": [{"scope": {"name": "s", "version": "1"}, "logRecords": [
            {"timeUnixNano": "18446744073709551615", "severityNumber": 9, "body": value, "flags": 1, "traceId": "ab" * 16}]}]}]},
        "traces": {"resourceSpans": [{"scopeSpans": [{"spans": [{"name": "n" * 300, "kind": 2, "status": {"message": "m", "code": 2}, "attributes": attributes}]}]}]},
        "metrics": {"resourceMetrics": [{"scopeMetrics": [{"metrics": [
            {"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "1", "asInt": "-3"}, {"timeUnixNano": "2", "asDouble": "-0.5"}]}},
            {"name": "h", "histogram": {"dataPoints": [{"timeUnixNano": "1", "count": "5", "sum": "2.5", "attributes": attributes}]}},
            {"name": "s", "summary": {"dataPoints": [{"timeUnixNano": "7"}]}}]}]}]},
    }
    assert json.loads(wire.to_json(wire.from_json(json.dumps(trees[signal]), signal), signal)) == trees[signal]
