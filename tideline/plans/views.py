"""Analytical views that the layout of the signals serves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_logs(logs: DataFrame, levels=("ERROR", "CRITICAL")) -> DataFrame:
    """Log records of the given levels per service and hour."""
    hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
    return logs.where(F.col("severity_text").isin(*levels)).groupBy("service_name", hour.alias("hour")).agg(F.count("*").alias("n"))


def metric_rollup(metrics: DataFrame) -> DataFrame:
    """Count, sum, least and largest value by name, attributes and day."""
    return metrics.groupBy("name", "attributes", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


def trace_range(traces: DataFrame, service: str, start: str, stop: str) -> DataFrame:
    """Spans of a service in a time range, by name."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return traces.where((F.col("service_name") == service) & (F.col("timestamp") >= at(start)) & (F.col("timestamp") < at(stop)))


def logs_of_traces(logs: DataFrame, traces: DataFrame) -> DataFrame:
    """Log records beside the span they belong to."""
    spans = traces.select("trace_id", "span_id", F.col("name").alias("span_name"))
    return logs.join(spans, ["trace_id", "span_id"], "left")
