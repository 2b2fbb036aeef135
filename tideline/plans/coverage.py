"""Registered queries for the operators around decoding: receipt, delivery, batching, settings; with SQL for the same rows."""

from __future__ import annotations

import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import config
from tideline.errors import PipelineError
from tideline.functions import scalars
from tideline.operators import batching, compliance, decode, layout, routing, schema_mode
from tideline.plans import telemetry
from tideline.plans.telemetry import _judged, _logs, _table, events, trees
from tideline.schemas import ANY, flat_schema
from tideline.session import configure, scratch_path, ship_package
from tideline.sources import landing
from tideline.streaming import folder, sinks
from tideline.streaming.pipeline import Pipeline
from tideline.streaming.telemetry import report


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _outcome(call, *errors) -> str:
    """What a call gives, or the name of its error."""
    try:
        return str(call())
    except (errors or (PipelineError,)) as e:
        return type(e).__name__


# receipt


def _receive(signal):
    def run(spark, sf_dir):
        df = trees(spark, sf_dir, signal)
        binary = landing.to_binary(df.where("event_id % 2 = 1"), signal).select(F.lit("application/x-protobuf; v=1").alias("content_type"), F.col("value").alias("body"))
        text = df.where("event_id % 2 = 0").select(F.lit(None).cast("string").alias("content_type"), F.col("value").cast("binary").alias("body"))
        return landing.decoded(binary.union(text), signal)
    return run


def reply_codes(spark, sf_dir):
    record = lambda t: f'{{"resourceLogs":[{{"scopeLogs":[{{"logRecords":[{{"timeUnixNano":"{t}"}}]}}]}}]}}'
    case = F.col("event_id") % 6
    body = (F.when(case == 0, '{"resourceLogs":[]}').when(case == 1, "{ not json").when(case == 3, record(2**64 - 1)).otherwise(record(1)))
    kind = F.when(case == 5, F.lit(landing.PROTOBUF))
    bodies = events(spark, sf_dir).select(kind.alias("content_type"), body.cast("binary").alias("body"), case.alias("case"))
    out = landing.with_replies(landing.parse_bodies(bodies, "logs"), "logs", F.col("case") == 4)
    return out.groupBy("status", "http", "grpc").agg(F.count("*").alias("n"))


def routes(spark, sf_dir):
    paths = F.array(*[F.lit(p) for p in (*landing.ROUTES, "/v1/other")])
    df = events(spark, sf_dir).select(F.get(paths, (F.col("event_id") % 4).cast("int")).alias("path"))
    return df.groupBy("path", landing.signal_of(F.col("path")).alias("signal")).agg(F.count("*").alias("n"))


def decode_logs_tree(spark, sf_dir):
    named = lambda key, text: f"named_struct('key', '{key}', 'value', named_struct('stringValue', {text}))"
    record = lambda sev, text, number: (
        f"named_struct('severityText', {sev}, 'body', if({text} is null and {number} is null, null, named_struct('stringValue', {text}, 'intValue', {number})))")
    none = "cast(null as string)"
    scope = lambda name, version: f"named_struct('name', {name}, 'version', {version})"
    resource = f"named_struct('attributes', array({named('service.name', "concat('user-', cast(user_id as string))")}, {named('service.name', "'later'")}))"
    part = lambda s, *records: f"named_struct('scope', {s}, 'logRecords', array({', '.join(records)}))"
    first = (f"named_struct('resource', {resource}, 'scopeLogs', array({part(scope("'a'", none), record("'one'", "event_type", none), record("'two'", none, "cast(event_id as string)"))}, "
             f"{part(f'if(true, null, {scope(none, none)})', record("'three'", none, none))}))")
    second = f"named_struct('resource', if(true, null, {resource}), 'scopeLogs', array({part(scope("'b'", "'2'"), record(none, none, none))}))"
    tree = f"to_json(named_struct('resourceLogs', array({first}, {second})))"
    return decode.decode_logs(landing.from_json_text(events(spark, sf_dir).select(F.expr(tree).alias("value")), "logs"))


def dropped_points(spark, sf_dir):
    point = "named_struct('timeUnixNano', '1')"
    kind = lambda k, i, n: f"'{k}', if(event_id % 3 = {i}, named_struct('dataPoints', array({', '.join([point] * n)})), null)"
    metric = f"named_struct({kind('gauge', 0, 1)}, {kind('summary', 1, 2)}, {kind('exponentialHistogram', 2, 1)})"
    tree = f"to_json(named_struct('resourceMetrics', array(named_struct('scopeMetrics', array(named_struct('metrics', array({metric})))))))"
    return decode.dropped_points(landing.from_json_text(events(spark, sf_dir).select(F.expr(tree).alias("value")), "metrics"))


def nested_values(spark, sf_dir):
    id_text = F.col("event_id").cast("string")
    listed = F.concat(F.lit('{"v":{"arrayValue":{"values":[{"intValue":"'), id_text, F.lit('"},{"stringValue":"a"},{"arrayValue":{"values":[{"boolValue":true}]}},{}]}}}'))
    mapped = F.concat(F.lit('{"v":{"kvlistValue":{"values":[{"key":"z","value":{"doubleValue":0.5}},{"key":"id","value":{"intValue":"'), id_text, F.lit('"}},{"key":"gone"}]}}}'))
    case = F.col("event_id") % 4
    text = F.when(case == 0, listed).when(case == 1, mapped).when(case == 2, F.lit('{"v":{"bytesValue":"3q0="}}')).otherwise(F.lit('{"v":{}}'))
    value = F.from_json(text, f"v {ANY}")["v"]
    return events(spark, sf_dir).select("event_id", scalars.any_value_text(value).alias("text"))


# rules on columns and batches


def string_columns(spark, sf_dir):
    df = events(spark, sf_dir)
    checked = lambda c: _outcome(lambda: scalars.require_string(df, c) or "ok")
    return _rows(spark, [(c, checked(c)) for c in ("event_id", "event_type", "nowhere")], "name string, outcome string")


def compliance_modes(spark, sf_dir):
    df = _judged(spark, sf_dir)
    good = df.where("event_id % 50 <> 0 and event_id % 77 <> 0")
    M, E, out = compliance.Mode, compliance.Engine, []
    for mode in M:
        for name, part in (("good", good), ("mixed", df), ("none", df.limit(0)), ("tagged", E.tag(df)), ("bare", df.drop("resource_attributes"))):
            try:
                outcome, rows = E(mode, {"a": "b"}).assess(part)
                out.append((mode.value, name, outcome.value, E.is_tagged(rows)))
            except PipelineError as e:
                out.append((mode.value, name, type(e).__name__, False))
    return _rows(spark, out, "mode string, name string, outcome string, tagged boolean")


def compliance_remap(spark, sf_dir):
    key = F.when(F.col("event_id") % 25 < 20, F.lit("svc")).otherwise(F.lit("service.name"))
    resource = F.when(F.col("event_id") % 50 == 3, F.lit("{}")).otherwise(F.concat(F.lit('{"'), key, F.lit('":"user-'), F.col("user_id").cast("string"), F.lit('"}')))
    df = events(spark, sf_dir).select("event_id", (F.col("event_id") / 25).cast("long").alias("batch"), resource.alias("resource_attributes"))
    good, bad = compliance.Engine(compliance.Mode.REMAP, {"svc": "service.name"}).split(df, "batch")
    side = lambda part, name: part.select("event_id", "resource_attributes", F.lit(name).alias("side"))
    return side(good, "remapped").union(side(bad, "quarantined"))


def schema_of_table(spark, sf_dir):
    _table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("event_type")).createOrReplaceTempView("tideline_known")
    df = events(spark, sf_dir).select("event_id", "event_type")
    known = schema_mode.table_schema(spark, "tideline_known")
    absent = schema_mode.table_schema(spark, "tideline_absent")
    kept = schema_mode.apply(df, schema_mode.SchemaMode.CATALOG, known, log_dropped=True)
    untouched = schema_mode.apply(df, schema_mode.SchemaMode.CATALOG, absent)
    return routing.union_all([kept, untouched.select("event_type")]).groupBy("event_type").agg(
        F.count("*").alias("n"), F.lit(",".join(schema_mode.dropped_columns(df, known))).alias("dropped"))


def layout_checks(spark, sf_dir):
    df = _logs(spark, sf_dir)
    checks = {
        "sort without a key": lambda: layout.sort_signal(df.drop("severity_text"), "logs"),
        "unknown signal": lambda: layout.sort_signal(df, "other") is df,
        "partition without time": lambda: layout.with_partition_path(df.drop("timestamp")),
        "partition by text": lambda: layout.with_partition_path(df, ts="severity_text"),
        "default granularity": lambda: ",".join(layout.partition_names(config.IcebergConfig(logs_table="l", traces_table="t").partition_granularity)),
    }
    return _rows(spark, [(k, _outcome(v)) for k, v in checks.items()], "name string, outcome string")


# batching and routing


def flush_replay(spark, sf_dir):
    batch = F.floor(F.col("event_id") / 50)
    sizes = events(spark, sf_dir).groupBy(F.concat(F.lit("t"), (batch % 3).cast("string")).alias("table_name"), batch.alias("batch")).agg(
        F.count("*").alias("rows"), F.sum(F.length("event_type")).alias("bytes"))
    policy = batching.FlushPolicy(max_bytes=1000, max_seconds=40.0, max_rows=120)
    return batching.replay(sizes.withColumn("at", (F.col("batch") * 7 + F.col("batch") % 5 * 6).cast("double")), policy)


def routing_tables(spark, sf_dir):
    out = []
    for name, mapping in (("own", routing.TableMapping()), ("one", routing.TableMapping(unified="all", column="kind"))):
        for signal in ("logs", "traces", "metrics", "other"):
            table = _outcome(lambda m=mapping, s=signal: m.table_for(s))
            out.append((name, signal, table, str(mapping.signal_type_column)))
    fallback = config.IcebergConfig(table_identifier="rest", logs_table="l", traces_table="t")
    out += [("fallback", s, fallback.table_for(s), "None") for s in ("logs", "traces", "metrics")]
    return _rows(spark, out, "mapping string, signal string, table_name string, kind string")


# delivery


def _streamed(spark, sf_dir, query_id):
    configure(spark)
    root, table = scratch_path(spark, "landing"), scratch_path(spark, "table")
    trees(spark, sf_dir, "logs").select("value").write.text(landing.folder(root, "logs"))
    sink = sinks.TableSink("logs", path=table, query_id=query_id)
    Pipeline(spark, root, scratch_path(spark, "checkpoints"), {"logs": sink}, max_files=2).run_until_drained()
    return sinks.read_table(spark, table)


def landing_to_table(spark, sf_dir):
    return _streamed(spark, sf_dir, "q").select(*flat_schema("logs").names)


def stream_reports(spark, sf_dir):
    reports = report(spark)
    try:
        _streamed(spark, sf_dir, "r")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        found = [(name, c.rows, c.failures) for name, c in reports.by_query.items()]
    finally:
        spark.streams.removeListener(reports)
    return _rows(spark, found, "query string, rows long, failures long")


def dry_run(spark, sf_dir):
    sink = sinks.TableSink("logs", path="nowhere", dry_run=True)
    df = _logs(spark, sf_dir)
    return _rows(spark, [("all", sink(df)), ("none", sink(df.limit(0)))], "name string, rows long")


def _lines(df: DataFrame, kind: scalars.WireFormat) -> DataFrame:
    ship_package(df.sparkSession)

    def run(batches):
        for batch in batches:
            body = sinks.payload(pa.Table.from_batches([batch]), kind).decode()
            yield pa.RecordBatch.from_arrays([pa.array(body.splitlines(), pa.string())], names=["line"])

    return df.mapInArrow(run, "line string")


def _small(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "event_type", "user_id")


def payload_json_rows(spark, sf_dir):
    return _lines(_small(spark, sf_dir), scalars.WireFormat.JSON)


def payload_csv_rows(spark, sf_dir):
    return _lines(_small(spark, sf_dir), scalars.WireFormat.CSV).where("line <> '\"event_id\",\"event_type\",\"user_id\"'")


def payload_ipc_rows(spark, sf_dir):
    ship_package(spark)

    def run(batches):
        for batch in batches:
            yield from pa.ipc.open_stream(sinks.payload(pa.Table.from_batches([batch]), scalars.WireFormat.IPC)).read_all().to_batches()

    return _small(spark, sf_dir).mapInArrow(run, "event_id long, event_type string, user_id long")


def payload_pieces(spark, sf_dir):
    ship_package(spark)

    def run(batches):
        import json

        for body in sinks.pieces_under(batches, scalars.WireFormat.JSON, 2000):
            ids = [json.loads(line)["event_id"] for line in body.splitlines()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(body) <= 2000] * len(ids))], names=["event_id", "fits"])

    return _small(spark, sf_dir).mapInArrow(run, "event_id long, fits boolean")


def queue_messages(spark, sf_dir):
    found = sinks.QueueSink("b", "t", scalars.WireFormat.JSON).messages(_small(spark, sf_dir))
    return found.select("key", F.col("value").cast("string").alias("value"))


def queue_batches(spark, sf_dir):
    found = sinks.QueueSink("b", "t", scalars.WireFormat.JSON, per_batch=True).messages(_small(spark, sf_dir))
    lines = F.split(F.rtrim(F.col("value").cast("string"), F.lit("\n")), "\n")
    return found.select("key", F.explode(lines).alias("value"))


def _load(two_phase):
    def run(spark, sf_dir):
        mode = sinks.TransactionMode.V2 if two_phase else sinks.TransactionMode.V1
        root = scratch_path(spark, "loads")
        settings = sinks.LoadConfig(["http://unused"], "u", database="d", mapping=routing.TableMapping(unified="t"), transaction=mode, max_payload_bytes=100_000)
        sinks.LoadSink(settings, "logs", "q", folder.FolderTransport(root))(_small(spark, sf_dir))
        return folder.loaded_rows(spark, root, "event_id long, event_type string, user_id long, signal_type string", two_phase)
    return run


# names and settings


def load_labels(spark, sf_dir):
    own = scalars.load_label("logs") != scalars.load_label("logs")
    return _rows(spark, [(s, scalars.load_label(s, "q", 7), own) for s in ("logs", "traces", "metrics")], "signal string, label string, fresh boolean")


def formats(spark, sf_dir):
    names = [(t, _outcome(lambda t=t: scalars.WireFormat.parse(t).value)) for t in ("ipc", "JSON", "Csv", "avro")]
    names.append(("csv in a queue", _outcome(lambda: config.KafkaConfig(format="csv"))))
    names += [(f"mode {m.name}", m.value) for m in (*sinks.TransactionMode, *schema_mode.SchemaMode, *schema_mode.CatalogType, *scalars.Granularity)]
    return _rows(spark, names, "name string, outcome string")


def settings_values(spark, sf_dir):
    """Built-in values, file, environment and arguments in that order, and what they make of sinks and sessions."""
    with tempfile.TemporaryDirectory() as at:
        file = Path(at) / "c.toml"
        file.write_text('[kafka]\ntopic = "file"\nbrokers = "b"\n[kafka.options]\nacks = "all"\n[iceberg]\nlogs_table = "l"\ntraces_table = "t"\ncatalog_uri = "u"\nwarehouse = "w"\n')
        app = config.load(str(file), {"TIDELINE_KAFKA__TOPIC": "env", "TIDELINE_ICEBERG__MAX_BATCH_RECORDS": "10"}, {"server": {"http_addr": "h"}})
        args = config.parser().parse_args(["--dry-run", "--verbose", "--grpc-addr", "g"])
        asked = config.load(str(file), {}, config.arguments_of(args))
    load, policy, plain = sinks.LoadConfig(["x"], "u", database="d"), batching.FlushPolicy(), config.IcebergConfig(logs_table="l", traces_table="t")
    glue, s3 = (config.IcebergConfig(logs_table="l", traces_table="t", catalog_type=c, warehouse="w") for c in ("glue", "s3tables"))
    found = {
        "kafka.topic": app.kafka.topic, "kafka.brokers": app.kafka.brokers, "kafka.options": app.kafka.options, "kafka.format": app.kafka.format.value,
        "server.grpc": app.server["grpc_addr"], "server.http": app.server["http_addr"], "sink": app.chosen_sink(),
        "max rows": app.iceberg.policy().max_rows, "asked dry run": asked.iceberg.dry_run, "asked level": asked.telemetry["log_level"],
        "asked grpc": asked.server["grpc_addr"], "level": app.telemetry["log_level"], "flush bytes": policy.max_bytes, "flush seconds": policy.max_seconds,
        "flush rows": policy.max_rows, "load bytes": load.max_payload_bytes, "load connect": load.connect_timeout_s, "load timeout": load.timeout_s,
        "load retries": load.max_retries, "load delay": load.retry_delay_s, "load format": load.format.value, "load mode": load.transaction.value,
        "drop log": plain.log_dropped_fields, "schema mode": plain.schema_mode.value, "rest type": app.iceberg.spark_options()["spark.sql.catalog.lake.type"],
        "rest uri": app.iceberg.spark_options()["spark.sql.catalog.lake.uri"], "rest warehouse": app.iceberg.spark_options()["spark.sql.catalog.lake.warehouse"],
        "glue warehouse": glue.spark_options()["spark.sql.catalog.lake.warehouse"], "s3 warehouse": "spark.sql.catalog.lake.warehouse" in s3.spark_options(),
    }
    return _rows(spark, [(k, str(v)) for k, v in found.items()], "name string, outcome string")


def settings_refused(spark, sf_dir):
    from tideline.__main__ import main

    ice = lambda **k: config.load(None, {}, {"iceberg": k})
    load = lambda **k: sinks.LoadConfig(**({"fe_urls": ["x"], "username": "u", "database": "d"} | k)) and "ok"
    with tempfile.TemporaryDirectory() as at:
        file = Path(at) / "c.toml"
        file.write_text('[kafka]\ntopic = "t"\n')
        absent = str(Path(at) / "none.toml")
        checks = {
            "three blank tables": ice, "two alike": lambda: ice(logs_table="a", traces_table="a", metrics_table="b"),
            "one like the rest": lambda: ice(table_identifier="r", logs_table="r", traces_table="b"),
            "three tables": lambda: ice(logs_table="a", traces_table="b", metrics_table="c").chosen_sink(),
            "no sink": lambda: config.load(None, {}, {}).chosen_sink(), "unknown setting": lambda: ice(nope=1),
            "sink without section": lambda: config.load(None, {}, {"sink": "kafka"}).chosen_sink(),
            "load": load, "no url": lambda: load(fe_urls=[]), "blank user": lambda: load(username=" "), "no database": lambda: load(database=""),
            "no outputs": lambda: routing.Fanout([]), "rules in a chain": lambda: compliance.Engine(compliance.Mode.REMAP, {"a": "b", "b": "c"}),
            "no quarantine": lambda: Pipeline(spark, "r", "c", {}, engine=compliance.Engine(compliance.Mode.QUARANTINE)),
            "check": lambda: main(["--config", str(file), "--check"]), "check without a file": lambda: main(["--config", absent, "--check"]),
        }
        return _rows(spark, [(k, _outcome(v)) for k, v in checks.items()], "name string, outcome string")


def queries() -> dict:
    out = {f.__name__: f for f in (
        reply_codes, routes, decode_logs_tree, dropped_points, nested_values, string_columns, compliance_modes, compliance_remap, schema_of_table,
        layout_checks, flush_replay, routing_tables, landing_to_table, stream_reports, dry_run, payload_json_rows, payload_csv_rows, payload_ipc_rows,
        payload_pieces, queue_messages, queue_batches, load_labels, formats, settings_values, settings_refused)}
    out |= {f"receive_{s}": _receive(s) for s in telemetry.RECORDS}
    return out | {"table_load": _load(False), "table_load_two_phase": _load(True)}


def _values(columns: str, *rows: tuple) -> str:
    def text(v):
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::bigint" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) x({columns})"


def _pairs(found: dict) -> str:
    return _values("name, outcome", *found.items())


_REFUSED = "ConfigurationError"


def oracle_sql() -> dict[str, str]:
    plain = telemetry.oracle_sql()
    one = lambda cols: f"select {cols} from events"
    line = "'{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}'"
    tree = lambda sev, body, service, resource, scope, version: (
        f"select timestamp '1970-01-01' as timestamp, timestamp '1970-01-01' as observed_timestamp, 0::int as severity_number, {sev} as severity_text, {body} as body, "
        f"'' as trace_id, '' as span_id, 0::bigint as flags, '{{}}' as attributes, {service} as service_name, {resource} as resource_attributes, "
        f"{scope} as scope_name, {version} as scope_version from events")
    user, later = "'user-' || user_id", "'{\"service.name\":\"later\"}'"
    modes = [(m, n, {"strict": "MissingMetadata", "quarantine": "quarantined", "remap": "quarantined", "off": "compliant"}[m] if n in ("mixed", "bare") else
              "remapped" if m == "remap" and n in ("good", "none") else "compliant", n == "tagged" or (m != "off" and n in ("good", "none")))
             for m in ("strict", "quarantine", "remap", "off") for n in ("good", "mixed", "none", "tagged", "bare")]
    loaded = one("event_id, event_type, user_id, 'logs' as signal_type")
    remapped = "case when event_id % 50 = 3 then '{}' else '{\"service.name\":\"user-' || user_id || '\"}' end"
    return {f"receive_{s}": plain[f"decode_{s}"] for s in telemetry.RECORDS} | {
        "reply_codes": """select s.status, s.http, s.grpc, count(*) as n from events join (values (0, 'empty', 200, 'OK'), (1, 'bad_request', 400, 'INVALID_ARGUMENT'),
            (2, 'ok', 200, 'OK'), (3, 'internal', 500, 'INTERNAL'), (4, 'closed', 503, 'UNAVAILABLE'), (5, 'bad_request', 400, 'INVALID_ARGUMENT')) s(c, status, http, grpc)
            on event_id % 6 = s.c group by all""",
        "routes": """select r.path, r.signal, count(*) as n from events join (values (0, '/v1/logs', 'logs'), (1, '/v1/traces', 'traces'), (2, '/v1/metrics', 'metrics'),
            (3, '/v1/other', null)) r(c, path, signal) on event_id % 4 = r.c group by all""",
        "decode_logs_tree": " union all ".join((
            tree("'one'", "event_type", user, later, "'a'", "''"), tree("'two'", "event_id::varchar", user, later, "'a'", "''"),
            tree("'three'", "''", user, later, "''", "''"), tree("''", "''", "'unknown'", "'{}'", "'b'", "'2'"))),
        "dropped_points": "select k.kind, k.n * count(*) as points from events join (values (1, 'summary', 2), (2, 'exponentialHistogram', 1)) k(c, kind, n) on event_id % 3 = k.c group by k.kind, k.n",
        "nested_values": """select event_id, case event_id % 4 when 0 then '[' || event_id || ',a,[true],]' when 1 then '{"id":"' || event_id || '","z":"0.5"}'
            when 2 then 'dead' else '' end as text from events""",
        "string_columns": _pairs({"event_id": "SchemaError", "event_type": "ok", "nowhere": "SchemaError"}),
        "compliance_modes": _values("mode, name, outcome, tagged", *modes),
        "compliance_remap": f"""select event_id, {remapped} as resource_attributes,
            case when bool_or(event_id % 50 = 3) over (partition by event_id // 25) then 'quarantined' else 'remapped' end as side from events""",
        "schema_of_table": "select event_type, 2 * count(*) as n, 'event_id' as dropped from events group by event_type",
        "layout_checks": _pairs({"sort without a key": "SchemaError", "unknown signal": "True", "partition without time": "SchemaError",
                                 "partition by text": "SchemaError", "default granularity": "year,month,day,hour"}),
        "flush_replay": """with recursive b as (
              select 't' || (event_id // 50) % 3 as table_name, event_id // 50 as batch, count(*) as rows, sum(length(event_type))::bigint as bytes,
                ((event_id // 50) * 7 + (event_id // 50) % 5 * 6)::double as "at" from events group by all),
            o as (select *, row_number() over (partition by table_name order by "at", batch) as i from b),
            -- held and since: the buffer after the batch, emptied if the batch filled it
            f as (
              select o.*, 0::bigint as flush, o.rows as held, o.bytes as size, o."at" as since, (o.rows >= 120 or o.bytes >= 1000) as full_now from o where i = 1
              union all
              select o.table_name, o.batch, o.rows, o.bytes, o."at", o.i,
                f.flush + (f.full_now or o."at" - f.since >= 40)::bigint,
                o.rows + case when f.full_now or o."at" - f.since >= 40 then 0 else f.held end,
                o.bytes + case when f.full_now or o."at" - f.since >= 40 then 0 else f.size end,
                case when f.full_now then f."at" when o."at" - f.since >= 40 then o."at" else f.since end,
                o.rows + case when f.full_now or o."at" - f.since >= 40 then 0 else f.held end >= 120
                  or o.bytes + case when f.full_now or o."at" - f.since >= 40 then 0 else f.size end >= 1000
                  or o."at" - case when f.full_now then f."at" when o."at" - f.since >= 40 then o."at" else f.since end >= 40
              from f join o on o.table_name = f.table_name and o.i = f.i + 1)
            select table_name, batch, rows, bytes, "at", flush from f""",
        "routing_tables": _values("mapping, signal, table_name, kind", *[("own", s, f"otel_{s}", "None") for s in ("logs", "traces", "metrics")],
                                  ("own", "other", _REFUSED, "None"), *[("one", s, "all", "kind") for s in ("logs", "traces", "metrics", "other")],
                                  ("fallback", "logs", "l", "None"), ("fallback", "traces", "t", "None"), ("fallback", "metrics", "rest", "None")),
        "landing_to_table": plain["decode_logs"],
        "stream_reports": "select 'tideline-logs' as query, count(*) as rows, 0::bigint as failures from events",
        "dry_run": "select 'all' as name, count(*) as rows from events union all select 'none', 0",
        "payload_json_rows": one(f"{line} as line"),
        "payload_csv_rows": one("event_id || ',\"' || event_type || '\",' || user_id as line"),
        "payload_ipc_rows": one("event_id, event_type, user_id"),
        "payload_pieces": one("event_id, true as fits"),
        "queue_messages": one(f"'' as key, {line} as value"),
        "queue_batches": one(f"'' as key, {line} as value"),
        "table_load": loaded, "table_load_two_phase": loaded,
        "load_labels": _values("signal, label, fresh", *[(s, f"otel-{s}-q-7", True) for s in ("logs", "traces", "metrics")]),
        "formats": _pairs({"ipc": "ipc", "JSON": "json", "Csv": "csv", "avro": _REFUSED, "csv in a queue": _REFUSED, "mode V1": "v1", "mode V2": "v2",
                           "mode FIXED": "fixed", "mode AUTO": "auto", "mode CATALOG": "catalog", "mode REST": "rest", "mode GLUE": "glue",
                           "mode S3TABLES": "s3tables", "mode HOURLY": "hourly", "mode DAILY": "daily"}),
        "settings_values": _pairs({
            "kafka.topic": "env", "kafka.brokers": "b", "kafka.options": "{'acks': 'all'}", "kafka.format": "ipc", "server.grpc": "0.0.0.0:4317", "server.http": "h",
            "sink": "iceberg", "max rows": "10", "asked dry run": "True", "asked level": "debug", "asked grpc": "g", "level": "info",
            "flush bytes": "134217728", "flush seconds": "60.0", "flush rows": "None", "load bytes": "104857600", "load connect": "10", "load timeout": "600",
            "load retries": "3", "load delay": "1.0", "load format": "ipc", "load mode": "v1", "drop log": "True", "schema mode": "fixed",
            "rest type": "rest", "rest uri": "u", "rest warehouse": "w", "glue warehouse": "w", "s3 warehouse": "False"}),
        "settings_refused": _pairs({
            "three blank tables": _REFUSED, "two alike": _REFUSED, "one like the rest": _REFUSED, "three tables": "iceberg", "no sink": _REFUSED,
            "unknown setting": _REFUSED, "sink without section": _REFUSED, "load": "ok", "no url": _REFUSED, "blank user": _REFUSED, "no database": _REFUSED,
            "no outputs": _REFUSED, "rules in a chain": _REFUSED, "no quarantine": _REFUSED, "check": "0", "check without a file": "2"}),
    }
