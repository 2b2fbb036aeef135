"""Schemas: the nested telemetry requests in, the flat signals out."""

from __future__ import annotations

from pyspark.sql.types import StructType

SIGNALS = ("logs", "traces", "metrics")

# Field names of the public telemetry JSON encoding.  64-bit numbers may be quoted, so they are strings.
ANY = "STRUCT<stringValue:STRING,intValue:STRING,doubleValue:STRING,boolValue:STRING,bytesValue:STRING,arrayValue:STRING,kvlistValue:STRING>"
ATTRIBUTES = f"ARRAY<STRUCT<key:STRING,value:{ANY}>>"
RESOURCE = f"STRUCT<attributes:{ATTRIBUTES}>"
SCOPE = "STRUCT<name:STRING,version:STRING>"
_NUMBER = f"STRUCT<timeUnixNano:STRING,asDouble:STRING,asInt:STRING,attributes:{ATTRIBUTES}>"
_HISTOGRAM = f"STRUCT<timeUnixNano:STRING,count:STRING,sum:STRING,attributes:{ATTRIBUTES}>"
_LOG = (f"STRUCT<timeUnixNano:STRING,observedTimeUnixNano:STRING,severityNumber:INT,severityText:STRING,body:{ANY},"
        f"attributes:{ATTRIBUTES},flags:BIGINT,traceId:STRING,spanId:STRING>")
_SPAN = (f"STRUCT<traceId:STRING,spanId:STRING,traceState:STRING,parentSpanId:STRING,name:STRING,kind:INT,"
         f"startTimeUnixNano:STRING,endTimeUnixNano:STRING,attributes:{ATTRIBUTES},status:STRUCT<code:INT,message:STRING>>")
_METRIC = (f"STRUCT<name:STRING,description:STRING,unit:STRING,gauge:STRUCT<dataPoints:ARRAY<{_NUMBER}>>,"
           f"sum:STRUCT<dataPoints:ARRAY<{_NUMBER}>>,histogram:STRUCT<dataPoints:ARRAY<{_HISTOGRAM}>>,"
           "exponentialHistogram:STRUCT<dataPoints:ARRAY<STRUCT<timeUnixNano:STRING>>>,summary:STRUCT<dataPoints:ARRAY<STRUCT<timeUnixNano:STRING>>>>")
REQUEST = {
    "logs": f"resourceLogs ARRAY<STRUCT<resource:{RESOURCE},scopeLogs:ARRAY<STRUCT<scope:{SCOPE},logRecords:ARRAY<{_LOG}>>>>>",
    "traces": f"resourceSpans ARRAY<STRUCT<resource:{RESOURCE},scopeSpans:ARRAY<STRUCT<scope:{SCOPE},spans:ARRAY<{_SPAN}>>>>>",
    "metrics": f"resourceMetrics ARRAY<STRUCT<resource:{RESOURCE},scopeMetrics:ARRAY<STRUCT<scope:{SCOPE},metrics:ARRAY<{_METRIC}>>>>>",
}

#: The flat signals, columns in order.  Every column always has a value.
FLAT = {
    "logs": "timestamp TIMESTAMP_NTZ, observed_timestamp TIMESTAMP_NTZ, severity_number INT, severity_text STRING, body STRING, "
            "trace_id STRING, span_id STRING, flags BIGINT, attributes STRING, service_name STRING, resource_attributes STRING, "
            "scope_name STRING, scope_version STRING",
    "traces": "trace_id STRING, span_id STRING, trace_state STRING, parent_span_id STRING, name STRING, kind INT, "
              "timestamp TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ, attributes STRING, service_name STRING, resource_attributes STRING, "
              "scope_name STRING, scope_version STRING, status_code INT, status_message STRING",
    "metrics": "name STRING, description STRING, unit STRING, timestamp TIMESTAMP_NTZ, value DOUBLE, attributes STRING, "
               "service_name STRING, resource_attributes STRING, scope_name STRING, scope_version STRING",
}


def flat_schema(signal: str) -> StructType:
    return StructType.fromDDL(FLAT[signal])
