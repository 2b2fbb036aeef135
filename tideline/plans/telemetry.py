"""Registered queries: every operator over ``events`` (and other tables) read as telemetry, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StringType, StructField, StructType

from tideline.functions import scalars
from tideline.operators import compliance, decode, layout, routing, schema_mode
from tideline.operators.batching import FlushPolicy, replay
from tideline.plans import views
from tideline.session import configure, scratch_path
from tideline.sources import landing
from tideline.streaming import sinks

_NS = "cast(unix_micros(cast(ts as timestamp)) * 1000 as string)"
_KV = "array(named_struct('key', 'k', 'value', named_struct('intValue', cast(k as string))))"
_SERVICE = "array(named_struct('key', 'service.name', 'value', named_struct('stringValue', concat('user-', cast(user_id as string)))))"
RESOURCE = f"named_struct('attributes', {_SERVICE})"
SCOPE = "named_struct('name', 'app', 'version', '1')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``k``, the number in its properties."""
    return _table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


_POINT = f"named_struct('timeUnixNano', {_NS}, 'asInt', if(event_id % 2 = 0, cast(event_id as string), null), 'attributes', {_KV})"
_HISTOGRAM = f"named_struct('timeUnixNano', {_NS}, 'count', cast(event_id as string), 'sum', if(event_id % 5 = 0, '2.5', null), 'attributes', {_KV})"
#: A record of each signal for an event.
RECORDS = {
    "logs": f"named_struct('timeUnixNano', {_NS}, 'severityNumber', cast(event_id % 24 as int), 'severityText', event_type, "
            f"'body', named_struct('stringValue', concat('event ', cast(event_id as string))), 'attributes', {_KV}, 'flags', 1, "
            "'traceId', upper(lpad(hex(event_id), 32, '0')), 'spanId', lpad(hex(user_id), 16, '0'))",
    "traces": f"named_struct('traceId', lpad(hex(event_id), 32, '0'), 'spanId', lpad(hex(user_id), 16, '0'), 'name', event_type, 'kind', 1, "
              f"'startTimeUnixNano', {_NS}, 'endTimeUnixNano', {_NS}, 'attributes', {_KV}, "
              "'status', if(event_id % 3 = 0, named_struct('code', 2, 'message', 'failed'), null))",
    "metrics": f"named_struct('name', event_type, 'unit', '1', 'gauge', if(event_id % 3 = 0, named_struct('dataPoints', array({_POINT})), null), "
               f"'sum', if(event_id % 3 = 1, named_struct('dataPoints', array({_POINT})), null), "
               f"'histogram', if(event_id % 3 = 2, named_struct('dataPoints', array({_HISTOGRAM})), null))",
}
_LEVELS = {"logs": ("resourceLogs", "scopeLogs", "logRecords"), "traces": ("resourceSpans", "scopeSpans", "spans"),
           "metrics": ("resourceMetrics", "scopeMetrics", "metrics")}


def trees(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    """``(event_id, value)``: a JSON request for each event."""
    outer, scopes, records = _LEVELS[signal]
    tree = (f"to_json(named_struct('{outer}', array(named_struct('resource', {RESOURCE}, '{scopes}', "
            f"array(named_struct('scope', {SCOPE}, '{records}', array({RECORDS[signal]})))))))")
    return events(spark, sf_dir).select("event_id", F.expr(tree).alias("value"))


def _decode(signal):
    def run(spark, sf_dir):
        return decode.DECODERS[signal](landing.from_json_text(trees(spark, sf_dir, signal), signal))
    return run


def _value_struct() -> Column:
    fields = {"stringValue": "if(event_id % 4 = 0, event_type, null)", "intValue": "if(event_id % 4 = 1, cast(event_id as string), null)",
              "doubleValue": "if(event_id % 4 = 2, cast((event_id % 1000) / 4 as string), null)", "boolValue": "if(event_id % 4 = 3, 'true', null)",
              "bytesValue": "cast(null as string)", "arrayValue": "cast(null as string)", "kvlistValue": "cast(null as string)"}
    return F.expr("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")")


def any_value_text(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", scalars.any_value_text(_value_struct()).alias("text"))


def attributes_json(spark, sf_dir):
    entries = F.array(F.struct(F.lit("z").alias("key"), _value_struct().alias("value")), F.struct(F.lit("a").alias("key"), _value_struct().alias("value")),
                      F.struct(F.lit("gone").alias("key"), F.when(F.lit(False), _value_struct()).alias("value")))
    return events(spark, sf_dir).select("event_id", scalars.attributes_json(entries).alias("attributes"))


def hex_ids(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", scalars.hex_text(F.col("event_type").cast("binary")).alias("hex_id"))


def ts_guard(spark, sf_dir):
    ns = F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise((F.col("event_id") * 1000000007).cast("string"))
    return events(spark, sf_dir).select("event_id", scalars.nanos(ns).alias("nanos"))


def _logs(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id", F.col("ts").alias("timestamp"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("service_name"),
        F.col("event_type").alias("severity_text"), F.col("event_type").alias("name"), "value", F.col("props").alias("attributes"))


def _partition(granularity):
    def run(spark, sf_dir):
        rows = layout.with_partition_path(_logs(spark, sf_dir), granularity=granularity)
        return rows.groupBy("partition").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return run


def _sorted(signal):
    def run(spark, sf_dir):
        # the sort itself, then each row's place in its service; rows that tie in all keys are alike
        df = layout.sort_signal(_logs(spark, sf_dir), signal).withColumn("at", F.monotonically_increasing_id())
        keys = layout.SORT_KEYS[signal]
        return df.select(*keys, F.row_number().over(Window.partitionBy("service_name").orderBy("at")).cast("long").alias("place"))
    return run


def schema_catalog(spark, sf_dir):
    table = StructType.fromDDL("value INT, event_id STRING, name STRING, extra STRING, timestamp TIMESTAMP_NTZ")
    return schema_mode.apply(_logs(spark, sf_dir), schema_mode.SchemaMode.CATALOG, table, log_dropped=False)


def schema_auto(spark, sf_dir):
    df = _logs(spark, sf_dir).select("event_id", "timestamp", "name")
    return schema_mode.apply(df, schema_mode.SchemaMode.AUTO, StructType([*df.schema.fields, StructField("only_in_table", StringType())]))


def schema_fixed(spark, sf_dir):
    df = _logs(spark, sf_dir).select("event_id", "service_name")
    return schema_mode.apply(df, schema_mode.SchemaMode.FIXED, df.schema, validate=True)


def _judged(spark, sf_dir) -> DataFrame:
    resource = F.when(F.col("event_id") % 50 == 0, F.lit("{}")).when(F.col("event_id") % 77 == 0, F.lit("not json")).otherwise(
        F.concat(F.lit('{"service.name":"user-'), F.col("user_id").cast("string"), F.lit('"}')))
    return events(spark, sf_dir).select("event_id", (F.col("event_id") / 25).cast("long").alias("batch"), resource.alias("resource_attributes"))


def compliance_verdict(spark, sf_dir):
    return compliance.Engine(compliance.Mode.STRICT).verdicts(_judged(spark, sf_dir), "batch").select("event_id", "batch", "batch_ok")


def compliance_quarantine(spark, sf_dir):
    good, bad = compliance.Engine(compliance.Mode.QUARANTINE).split(_judged(spark, sf_dir), "batch")
    side = lambda df, name: df.select("event_id", F.lit(name).alias("side"))
    return side(good, "compliant").union(side(bad, "quarantined"))


def remap_attributes(spark, sf_dir):
    df = events(spark, sf_dir).select("event_id", F.to_json(F.struct(F.col("event_type").alias("custom_verb"), F.lit("x").alias("other"))).alias("attributes"))
    return compliance.Engine(compliance.Mode.REMAP, {"custom_verb": "http.request.method"}).remap(df)


def unified_union(spark, sf_dir):
    signals = {"logs": events(spark, sf_dir).select(F.col("event_id").alias("id"), "event_type"),
               "traces": _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"),
               "metrics": _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand")}
    return routing.unified(signals)


def union_all(spark, sf_dir):
    df = events(spark, sf_dir)
    return routing.union_all([df.select("event_id", "value"), df.select("value", "event_id")]).groupBy("event_id").agg(F.count("*").alias("n"))


def flush_assignment(spark, sf_dir):
    size = F.lit(100)
    batches = events(spark, sf_dir).groupBy(F.floor(F.col("event_id") / size).alias("batch")).agg(F.count("*").alias("rows"))
    batches = batches.select(F.lit("logs").alias("table_name"), "batch", "rows", F.lit(0).cast("long").alias("bytes"), F.lit(0.0).alias("at"))
    return replay(batches, FlushPolicy(max_rows=250)).groupBy("flush").agg(F.sum("rows").alias("n"))


def fanout_counts(spark, sf_dir):
    df, root = _logs(spark, sf_dir), scratch_path(spark, "fanout")
    output = lambda name: lambda part, n: part.groupBy("severity_text").agg(F.count("*").alias("n")).write.parquet(f"{root}/{name}/{n}")
    routing.Fanout([output("a"), output("b")])(df.transform(routing.passthrough), 7)
    side = lambda name: spark.read.parquet(f"{root}/{name}/7").select(F.lit(name).alias("output"), "severity_text", "n")
    return side("a").union(side("b"))


def payload_json(spark, sf_dir):
    return sinks.json_lines(events(spark, sf_dir).select("event_id", "event_type", "user_id"), "line")


def payload_csv(spark, sf_dir):
    return sinks.csv_lines(events(spark, sf_dir).select("event_id", "event_type", "user_id"), "line")


def request_status(spark, sf_dir):
    body = F.when(F.col("event_id") % 4 == 0, F.lit('{"resourceLogs":[]}')).when(F.col("event_id") % 4 == 1, F.lit("{ not json")).otherwise(
        F.lit('{"resourceLogs":[{"scopeLogs":[]}]}'))
    kind = F.when(F.col("event_id") % 4 == 3, F.lit("application/x-protobuf")).otherwise(F.lit("application/json"))
    bodies = events(spark, sf_dir).select("event_id", kind.alias("content_type"), body.cast("binary").alias("body"))
    return landing.parse_bodies(bodies, "logs").groupBy("status").agg(F.count("*").alias("n"))


def view_error_logs(spark, sf_dir):
    return views.error_logs(_logs(spark, sf_dir), ("purchase", "error"))


def view_metric_rollup(spark, sf_dir):
    return views.metric_rollup(_logs(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def view_trace_range(spark, sf_dir):
    return views.trace_range(_logs(spark, sf_dir), "user-7", "2024-01-01 00:00:00", "2024-06-01 00:00:00").select("event_id", "name", "timestamp")


def queries() -> dict:
    out = {f.__name__: f for f in (
        any_value_text, attributes_json, hex_ids, ts_guard, schema_catalog, schema_auto, schema_fixed,
        compliance_verdict, compliance_quarantine, remap_attributes, unified_union, union_all, flush_assignment, fanout_counts, payload_json,
        payload_csv, request_status, view_error_logs, view_metric_rollup, view_trace_range)}
    out |= {f"decode_{s}": _decode(s) for s in RECORDS}
    out |= {f"partition_{g.value}": _partition(g) for g in scalars.Granularity}
    return out | {f"sort_{s}": _sorted(s) for s in layout.SORT_KEYS}


def oracle_sql() -> dict[str, str]:
    service = "'user-' || user_id"
    resource = f"'{{\"service.name\":\"' || {service} || '\"}}'"
    attributes = "'{\"k\":\"' || json_extract_string(props, '$.k') || '\"}'"
    trace, span = "lower(lpad(to_hex(event_id), 32, '0'))", "lower(lpad(to_hex(user_id), 16, '0'))"
    text = ("case event_id % 4 when 0 then event_type when 1 then event_id::varchar "
            "when 2 then regexp_replace(((event_id % 1000) / 4.0)::double::varchar, '\\.0$', '') else 'true' end")
    logs = f"(select event_id, ts as timestamp, {service} as service_name, event_type as severity_text, event_type as name, value, props as attributes from events)"
    bad = "case when event_id % 50 = 0 or event_id % 77 = 0 then false else true end"
    judged = f"(select event_id, event_id // 25 as batch, bool_and({bad}) over (partition by event_id // 25) as batch_ok from events)"
    order = {"logs": "severity_text, timestamp", "metrics": "name, attributes, timestamp", "traces": "name, timestamp"}
    path = {"hourly": "year=%Y/month=%m/day=%d/hour=%H/", "daily": "year=%Y/month=%m/day=%d/"}
    out = {
        "decode_logs": f"""select ts as timestamp, timestamp '1970-01-01 00:00:00' as observed_timestamp, (event_id % 24)::int as severity_number,
            event_type as severity_text, 'event ' || event_id as body, {trace} as trace_id, {span} as span_id, 1::bigint as flags,
            {attributes} as attributes, {service} as service_name, {resource} as resource_attributes, 'app' as scope_name, '1' as scope_version from events""",
        "decode_traces": f"""select {trace} as trace_id, {span} as span_id, '' as trace_state, '' as parent_span_id, event_type as name, 1::int as kind,
            ts as timestamp, ts as end_time, {attributes} as attributes, {service} as service_name, {resource} as resource_attributes,
            'app' as scope_name, '1' as scope_version, case when event_id % 3 = 0 then 2 else 0 end::int as status_code,
            case when event_id % 3 = 0 then 'failed' else '' end as status_message from events""",
        "decode_metrics": f"""select event_type as name, '' as description, '1' as unit, ts as timestamp,
            case when event_id % 3 = 2 then case when event_id % 5 = 0 then 2.5 else event_id end
                 when event_id % 2 = 0 then event_id else 0 end::double as value,
            {attributes} as attributes, {service} as service_name, {resource} as resource_attributes, 'app' as scope_name, '1' as scope_version from events""",
        "any_value_text": f"select event_id, {text} as text from events",
        "attributes_json": f"select event_id, '{{\"a\":\"' || {text} || '\",\"z\":\"' || {text} || '\"}}' as attributes from events",
        "hex_ids": "select event_id, lower(hex(event_type)) as hex_id from events",
        "ts_guard": "select event_id, case when event_id % 10 = 0 then 0 else event_id * 1000000007 end::bigint as nanos from events",
        "schema_catalog": f"select event_id::varchar as event_id, timestamp, name, try_cast(trunc(value) as integer) as value from {logs}",
        "schema_auto": f"select event_id, timestamp, name from {logs}",
        "schema_fixed": f"select event_id, service_name from {logs}",
        "compliance_verdict": f"select event_id, batch, batch_ok from {judged}",
        "compliance_quarantine": f"select event_id, case when batch_ok then 'compliant' else 'quarantined' end as side from {judged}",
        "remap_attributes": "select event_id, '{\"http.request.method\":\"' || event_type || '\",\"other\":\"x\"}' as attributes from events",
        "unified_union": """select event_id as id, event_type, 'logs' as signal_type, null::varchar as o_orderstatus, null::varchar as p_brand from events
            union all select o_orderkey, null, 'traces', o_orderstatus, null from orders
            union all select p_partkey, null, 'metrics', null, p_brand from part""",
        "union_all": "select event_id, 2 * count(*) as n from events group by event_id",
        "flush_assignment": "select event_id // 300 as flush, count(*) as n from events group by 1",
        "fanout_counts": "select o.output, event_type as severity_text, count(*) as n from events, (values ('a'), ('b')) o(output) group by all",
        "payload_json": "select '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' as line from events",
        "payload_csv": "select event_id || ',' || event_type || ',' || user_id as line from events",
        "request_status": "select case event_id % 4 when 0 then 'empty' when 2 then 'ok' else 'bad_request' end as status, count(*) as n from events group by 1",
        "view_error_logs": f"select service_name, date_trunc('hour', timestamp) as hour, count(*) as n from {logs} where severity_text in ('purchase', 'error') group by all",
        "view_metric_rollup": f"select name, attributes, timestamp::date::varchar as day, count(*) as n, round(sum(value), 4) as total, min(value) as low, max(value) as high from {logs} group by all",
        "view_trace_range": f"select event_id, name, timestamp from {logs} where service_name = 'user-7' and timestamp >= timestamp '2024-01-01' and timestamp < timestamp '2024-06-01'",
    }
    out |= {f"partition_{g}": f"select strftime(timestamp, '{p}') as partition, count(*) as n, min(event_id) as first_id from {logs} group by 1" for g, p in path.items()}
    return out | {f"sort_{s}": f"select service_name, {k}, row_number() over (partition by service_name order by {k}) as place from {logs}" for s, k in order.items()}
