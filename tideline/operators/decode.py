"""Flattening: nested telemetry requests to the flat signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.errors import SchemaError
from tideline.functions.scalars import any_value_text, attributes_json, json_object, nanos, pairs_of, timestamp_of
from tideline.schemas import flat_schema

#: What may travel along with the records, e.g. the number of the request.
_CARRY = "_batch_id"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def service_name(pairs: Column) -> Column:
    """The first of ``pairs`` (key, value text) called ``service.name``; ``unknown`` without one or without its value."""
    return F.coalesce(F.get(F.filter(pairs, lambda a: a["key"] == "service.name"), F.lit(0))["value"], F.lit("unknown"))


def _scopes(requests: DataFrame, outer: str, scopes: str) -> DataFrame:
    """One row per resource and scope; what belongs to the resource is computed once per resource."""
    carry = [c for c in (_CARRY,) if c in requests.columns]
    resources = requests.select(*carry, F.explode(outer).alias("r"))
    resources = resources.select(*carry, pairs_of(F.col("r.resource.attributes")).alias("pairs"), F.col(f"r.{scopes}").alias("inner"))
    named = resources.select(
        *carry, service_name(F.col("pairs")).alias("service_name"), json_object(F.col("pairs")).alias("resource_attributes"),
        F.explode("inner").alias("s"))
    return named.withColumns({"scope_name": _text(F.col("s.scope.name")), "scope_version": _text(F.col("s.scope.version"))})


def _flat(rows: DataFrame, signal: str, **columns: Column) -> DataFrame:
    names = [f.name for f in flat_schema(signal).fields]
    carry = [c for c in (_CARRY,) if c in rows.columns]
    made = rows.withColumns(columns)
    extra = [c for c in columns if c.endswith("_unix_nano")]
    return made.select(*carry, *[F.col(c).cast(flat_schema(signal)[c].dataType).alias(c) for c in names], *extra)


def _times(keep: bool, **sources: Column) -> dict[str, Column]:
    out = {name: timestamp_of(ns) for name, ns in sources.items()}
    return out | {f"{name}_unix_nano": ns for name, ns in sources.items()} if keep else out


def decode_logs(requests: DataFrame, nanos_too: bool = False) -> DataFrame:
    """``resourceLogs`` trees to the 13 columns of logs; ``nanos_too`` adds exact nanoseconds beside the timestamps."""
    rows = _scopes(requests, "resourceLogs", "scopeLogs").withColumn("x", F.explode("s.logRecords"))
    x = F.col("x")
    return _flat(
        rows, "logs", **_times(nanos_too, timestamp=nanos(x["timeUnixNano"]), observed_timestamp=nanos(x["observedTimeUnixNano"])),
        severity_number=F.coalesce(x["severityNumber"], F.lit(0)), severity_text=_text(x["severityText"]),
        body=_text(any_value_text(x["body"])), trace_id=F.lower(_text(x["traceId"])), span_id=F.lower(_text(x["spanId"])),
        flags=F.coalesce(x["flags"], F.lit(0)), attributes=attributes_json(x["attributes"]))


def decode_traces(requests: DataFrame, nanos_too: bool = False) -> DataFrame:
    """``resourceSpans`` trees to the 15 columns of traces."""
    rows = _scopes(requests, "resourceSpans", "scopeSpans").withColumn("x", F.explode("s.spans"))
    x = F.col("x")
    return _flat(
        rows, "traces", **_times(nanos_too, timestamp=nanos(x["startTimeUnixNano"]), end_time=nanos(x["endTimeUnixNano"])),
        trace_id=F.lower(_text(x["traceId"])), span_id=F.lower(_text(x["spanId"])), trace_state=_text(x["traceState"]),
        parent_span_id=F.lower(_text(x["parentSpanId"])), name=_text(x["name"]), kind=F.coalesce(x["kind"], F.lit(0)),
        attributes=attributes_json(x["attributes"]), status_code=F.coalesce(x["status"]["code"], F.lit(0)),
        status_message=_text(x["status"]["message"]))


def number_value(point: Column) -> Column:
    """Of a gauge or a sum: the double, else the integer as a double, else 0."""
    return F.coalesce(point["asDouble"].cast("double"), point["asInt"].cast("decimal(20,0)").cast("double"), F.lit(0.0))


def histogram_value(point: Column) -> Column:
    """The sum of a histogram, else its count; buckets don't count."""
    return F.coalesce(point["sum"].cast("double"), point["count"].cast("decimal(20,0)").cast("double"), F.lit(0.0))


def decode_metrics(requests: DataFrame, nanos_too: bool = False) -> DataFrame:
    """``resourceMetrics`` trees to the 10 columns of metrics; kinds other than gauge, sum and histogram give no rows
    (:func:`dropped_points` counts them)."""
    rows = _scopes(requests, "resourceMetrics", "scopeMetrics").withColumn("m", F.explode("s.metrics"))
    point = lambda p, value: F.named_struct(F.lit("t"), p["timeUnixNano"], F.lit("v"), value(p), F.lit("a"), p["attributes"])
    points = F.coalesce(
        F.transform(F.col("m.gauge.dataPoints"), lambda p: point(p, number_value)),
        F.transform(F.col("m.sum.dataPoints"), lambda p: point(p, number_value)),
        F.transform(F.col("m.histogram.dataPoints"), lambda p: point(p, histogram_value)))
    rows = rows.withColumn("x", F.explode(points))
    x = F.col("x")
    return _flat(
        rows, "metrics", **_times(nanos_too, timestamp=nanos(x["t"])), name=_text(F.col("m.name")),
        description=_text(F.col("m.description")), unit=_text(F.col("m.unit")), value=x["v"], attributes=attributes_json(x["a"]))


#: Kinds of metrics that have no rows.
DROPPED = ("exponentialHistogram", "summary")


def dropped_points(requests: DataFrame) -> DataFrame:
    """``(kind, points)``: data points that :func:`decode_metrics` leaves out."""
    metrics = requests.select(F.explode("resourceMetrics").alias("r")).select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m"))
    sizes = F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.size(f"m.{k}.dataPoints"), F.lit(0)).alias("n")) for k in DROPPED])
    each = metrics.select(F.explode(sizes).alias("x")).where("x.n > 0")
    return each.groupBy(F.col("x.kind").alias("kind")).agg(F.sum("x.n").alias("points"))


DECODERS = {"logs": decode_logs, "traces": decode_traces, "metrics": decode_metrics}


def add_signal_type(df: DataFrame, column: str, signal: str) -> DataFrame:
    """``df`` with a constant last column, also where it has no rows."""
    if column in df.columns:
        raise SchemaError(f"column {column} is there already")
    return df.withColumn(column, F.lit(signal))
