"""Landing zone: telemetry requests as files, one folder per signal, in batch or as a stream."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.decode import DECODERS
from tideline.schemas import REQUEST, SIGNALS
from tideline.session import ship_package
from tideline.sources import wire

PROTOBUF = "application/x-protobuf"
ROUTES = {f"/v1/{signal}": signal for signal in SIGNALS}
BODIES = "content_type string, body binary"


def folder(root: str, signal: str) -> str:
    return f"{root.rstrip('/')}/v1/{signal}"


def read_json_lines(spark: SparkSession, root: str, signal: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Requests as lines of JSON text, as ``(content_type, body)``."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.format("text").load(folder(root, signal))
    return lines.select(F.lit("application/json").alias("content_type"), F.col("value").cast("binary").alias("body"))


def read_protobuf_files(spark: SparkSession, root: str, signal: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Requests as ``.pb`` files of one message each."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("pathGlobFilter", "*.pb")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
        reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    return reader.load(folder(root, signal)).select(F.lit(PROTOBUF).alias("content_type"), F.col("content").alias("body"))


def is_protobuf(content_type: Column) -> Column:
    return F.coalesce(content_type.contains(PROTOBUF), F.lit(False))


def signal_of(path: Column) -> Column:
    """The signal of a route; null for any other path."""
    return F.coalesce(*[F.when(path == route, F.lit(signal)) for route, signal in ROUTES.items()])


def parse_bodies(bodies: DataFrame, signal: str) -> DataFrame:
    """``bodies`` with the request tree and ``status``: ``ok``, ``empty`` (nothing to store) or ``bad_request``.

    A content type that mentions protobuf means a binary body; any other, or none, means JSON.
    """
    ship_package(bodies.sparkSession)

    @F.arrow_udf("string")
    def binary_to_json(column: pa.Array) -> pa.Array:
        return pa.array([None if v is None else wire.to_json(v, signal) for v in column.to_pylist()], pa.string())

    binary = is_protobuf(F.col("content_type"))
    text = F.coalesce(binary_to_json(F.when(binary, F.col("body"))), F.when(~binary, F.decode("body", "UTF-8")))
    outer = REQUEST[signal].split(" ")[0]
    broken = "_broken"
    parsed = F.from_json(text, f"{REQUEST[signal]}, {broken} STRING", {"columnNameOfCorruptRecord": broken, "mode": "PERMISSIVE"})
    out = bodies.withColumn("_p", parsed)
    bad = F.col("_p").isNull() | F.col(f"_p.{broken}").isNotNull()
    return out.select(
        *bodies.columns, F.when(~bad, F.col(f"_p.{outer}")).alias(outer),
        F.when(bad, "bad_request").when(F.coalesce(F.size(F.col(f"_p.{outer}")), F.lit(0)) <= 0, "empty").otherwise("ok").alias("status"))


# The replies to a request, over HTTP and over gRPC.
REPLIES = {"ok": (200, "OK"), "empty": (200, "OK"), "bad_request": (400, "INVALID_ARGUMENT"), "internal": (500, "INTERNAL"), "closed": (503, "UNAVAILABLE")}
_TIMED = {"logs": ("scopeLogs", "logRecords", ("timeUnixNano", "observedTimeUnixNano")),
          "traces": ("scopeSpans", "spans", ("startTimeUnixNano", "endTimeUnixNano"))}


def _undecodable(signal: str) -> Column:
    """Whether a time of a request doesn't fit a long, for which :func:`tideline.functions.scalars.nanos` raises."""
    late = lambda t: F.coalesce(t.cast("decimal(20,0)") > F.lit(2**63 - 1).cast("decimal(20,0)"), F.lit(False))
    outer = REQUEST[signal].split(" ")[0]
    if signal == "metrics":
        points = lambda m: F.concat(*[F.coalesce(m[k]["dataPoints"]["timeUnixNano"], F.array().cast("array<string>")) for k in ("gauge", "sum", "histogram")])
        inside = lambda s: F.exists(s["metrics"], lambda m: F.exists(points(m), late))
        scopes = "scopeMetrics"
    else:
        scopes, records, times = _TIMED[signal]
        inside = lambda s: F.exists(s[records], lambda x: late(x[times[0]]) | late(x[times[1]]))
    return F.coalesce(F.exists(outer, lambda r: F.exists(r[scopes], inside)), F.lit(False))


def with_replies(parsed: DataFrame, signal: str, closed: Column | None = None) -> DataFrame:
    """``parsed`` with the final ``status`` and its ``http`` and ``grpc`` replies.

    A readable request whose times don't fit is ``internal``; one that finds the pipeline ``closed`` says so; an empty
    request is acknowledged in any case, since nothing of it is sent on.
    """
    status = F.when((F.col("status") == "ok") & _undecodable(signal), "internal")
    if closed is not None:
        status = status.when((F.col("status") == "ok") & closed, "closed")
    out = parsed.withColumn("status", status.otherwise(F.col("status")))
    reply = lambda i: F.coalesce(*[F.when(F.col("status") == k, F.lit(v[i])) for k, v in REPLIES.items()])
    return out.withColumns({"http": reply(0), "grpc": reply(1)})


def decoded(bodies: DataFrame, signal: str, nanos_too: bool = False) -> DataFrame:
    """The flat rows of all readable requests."""
    return DECODERS[signal](parse_bodies(bodies, signal), nanos_too)


def to_binary(requests: DataFrame, signal: str, column: str = "value") -> DataFrame:
    """A column of JSON requests as binary ones."""
    ship_package(requests.sparkSession)

    @F.arrow_udf("binary")
    def encoded(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else wire.from_json(t, signal) for t in texts.to_pylist()], pa.binary())

    return requests.withColumn(column, encoded(column))


def from_json_text(requests: DataFrame, signal: str, column: str = "value") -> DataFrame:
    """Request trees from a column of JSON text; other columns stay."""
    return requests.withColumn("_p", F.from_json(F.col(column), REQUEST[signal])).select(*[c for c in requests.columns if c != column], "_p.*")
