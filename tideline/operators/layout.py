"""Layout of a signal: sort keys, time partitions and reads that use them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from tideline.errors import SchemaError
from tideline.functions.scalars import Granularity, partition_path

SORT_KEYS = {
    "logs": ("service_name", "severity_text", "timestamp"),
    "metrics": ("service_name", "name", "attributes", "timestamp"),
    "traces": ("service_name", "name", "timestamp"),
}


def sort_columns(df: DataFrame, signal: str) -> list[Column]:
    """Ascending, nulls first; exact nanoseconds break ties where they are kept.  None for an unknown signal."""
    keys = SORT_KEYS.get(signal, ())
    for k in keys:
        if k not in df.columns:
            raise SchemaError(f"Missing {k}")
    return [F.col("timestamp_unix_nano" if k == "timestamp" and "timestamp_unix_nano" in df.columns else k).asc_nulls_first() for k in keys]


def sort_signal(df: DataFrame, signal: str, total: bool = True) -> DataFrame:
    """Sorted over the whole table, or inside each partition only (``total=False``, for writing: no shuffle)."""
    keys = sort_columns(df, signal)
    return df if not keys else df.orderBy(*keys) if total else df.sortWithinPartitions(*keys)


def partition_columns(df: DataFrame, ts: str = "timestamp", granularity: Granularity = Granularity.HOURLY) -> DataFrame:
    """``df`` with text columns ``year, month, day`` and, hourly, ``hour``."""
    _check(df, ts)
    parts = {"year": "yyyy", "month": "MM", "day": "dd"} | ({"hour": "HH"} if granularity is Granularity.HOURLY else {})
    return df.withColumns({name: F.date_format(ts, p) for name, p in parts.items()})


def partition_names(granularity: Granularity) -> list[str]:
    return ["year", "month", "day"] + (["hour"] if granularity is Granularity.HOURLY else [])


def with_partition_path(df: DataFrame, ts: str = "timestamp", granularity: Granularity = Granularity.HOURLY, name: str = "partition") -> DataFrame:
    _check(df, ts)
    return df.withColumn(name, partition_path(F.col(ts), granularity))


def _check(df: DataFrame, ts: str) -> None:
    if ts not in df.columns:
        raise SchemaError(f"Missing {ts}")
    if not isinstance(df.schema[ts].dataType, (TimestampNTZType, TimestampType)):
        raise SchemaError(f"{ts} is not a timestamp")


def laid_out(df: DataFrame, signal: str, granularity: Granularity = Granularity.HOURLY, ts: str = "timestamp") -> DataFrame:
    """Partition columns added, rows rebalanced by them (adaptive execution splits a hot hour) and sorted for writing."""
    names = partition_names(granularity)
    out = partition_columns(df, ts, granularity).hint("rebalance", *names)
    return out.sortWithinPartitions(*[F.col(n) for n in names], *sort_columns(df, signal))


def read_range(spark: SparkSession, path: str, start: dt.datetime, stop: dt.datetime, granularity: Granularity = Granularity.HOURLY, ts: str = "timestamp") -> DataFrame:
    """Rows with ``start <= ts < stop`` of a partitioned table; only partitions of that range are read."""
    table = spark.read.parquet(path)
    key = F.concat(*[F.col(n).cast("string") for n in partition_names(granularity)])
    form = "%Y%m%d%H" if granularity is Granularity.HOURLY else "%Y%m%d"
    return table.where((key >= start.strftime(form)) & (key <= stop.strftime(form))).where(
        (F.col(ts) >= F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")) & (F.col(ts) < F.lit(stop.isoformat(sep=" ")).cast("timestamp_ntz")))
