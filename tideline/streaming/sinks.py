"""Sinks: partitioned tables, message queues and table loads, once per micro-batch."""

from __future__ import annotations

import io
import logging
from dataclasses import dataclass, field
from enum import Enum

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tideline.errors import ConfigurationError, StorageError
from tideline.functions.scalars import Granularity, WireFormat, load_label
from tideline.operators import layout, schema_mode
from tideline.operators.routing import TableMapping
from tideline.session import ship_package

log = logging.getLogger(__name__)
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def json_lines(df: DataFrame, name: str = "value") -> DataFrame:
    """One JSON object a row, times to the microsecond."""
    return df.select(F.to_json(F.struct(*df.columns), _TIMES).alias(name))


def csv_lines(df: DataFrame, name: str = "value") -> DataFrame:
    """One CSV line a row, without the header."""
    return df.select(F.to_csv(F.struct(*df.columns), _TIMES).alias(name))


@dataclass
class TableSink:
    """Appends a signal to a directory of Parquet files by time, or to a catalogue table.

    A flush applies the schema policy, rebalances rows by partition, sorts them and commits all files at once.  A
    micro-batch is recorded with its query, so a replayed one isn't written twice.  Without a catalogue the commit is
    that of Spark's job, file by file: readers during a flush may see part of it.  A call returns the rows it wrote;
    an empty batch leaves nothing.
    """

    signal: str
    path: str | None = None
    table: str | None = None
    mode: schema_mode.SchemaMode = schema_mode.SchemaMode.FIXED
    granularity: Granularity = Granularity.HOURLY
    log_dropped: bool = True
    dry_run: bool = False
    max_records_per_file: int = 0
    query_id: str = "batch"

    def __call__(self, df: DataFrame, batch_id: int = 0) -> int:
        spark = df.sparkSession
        known = schema_mode.table_schema(spark, self.table) if self.table else None
        df = schema_mode.apply(df, self.mode, known, self.log_dropped)
        if self.dry_run:
            n = df.count()
            log.info("dry run: %d rows of %s", n, self.signal)
            return n
        if not self.table and not self.path:
            raise ConfigurationError("a table sink needs a path or a table")
        seen = Observation()
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"))  # counted on the way, so the source is read once
        if self.table:
            layout.sort_signal(df, self.signal, total=False).writeTo(self.table).append()
            return seen.get["rows"]
        out = layout.laid_out(df, self.signal, self.granularity)
        # the batch is one directory level: overwriting it makes a replay idempotent
        target = f"{self.path.rstrip('/')}/batch={self.query_id}-{batch_id}"
        names = layout.partition_names(self.granularity)
        out.write.mode("overwrite").option("maxRecordsPerFile", self.max_records_per_file).partitionBy(*names).parquet(target)
        if not seen.get["rows"]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(target)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        return seen.get["rows"]


def read_table(spark, path: str) -> DataFrame:
    """All batches of a table that :class:`TableSink` wrote."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/batch=*")


@dataclass
class QueueSink:
    """Writes a signal to a message queue: a record a row, or one message a batch as the payload formats define it."""

    brokers: str
    topic: str
    format: WireFormat = WireFormat.IPC
    options: dict = field(default_factory=dict)
    per_batch: bool = False

    def messages(self, df: DataFrame) -> DataFrame:
        """``(key, value)`` with the empty key.  ``per_batch`` makes a message of each task's rows, of bounded size."""
        if self.format is WireFormat.JSON and not self.per_batch:
            return json_lines(df).select(F.lit("").alias("key"), F.col("value").cast("binary").alias("value"))
        ship_package(df.sparkSession)
        kind = self.format

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    body = payload(pa.Table.from_batches([batch]), kind)
                    yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([body], pa.binary())], names=["key", "value"])

        return df.mapInArrow(run, "key string, value binary")

    def __call__(self, df: DataFrame, batch_id: int = 0) -> None:
        if df.isEmpty():
            return
        options = {f"kafka.{k}": v for k, v in self.options.items()}
        try:
            self.messages(df).write.format("kafka").options(**options).option("kafka.bootstrap.servers", self.brokers).option("topic", self.topic).save()
        except Exception as e:
            raise StorageError(f"queue {self.topic}: {e}") from e


def payload(table: pa.Table, kind: WireFormat, limit: int | None = None) -> bytes:
    """The rows as an Arrow stream, JSON lines or CSV with a header; more than ``limit`` bytes are an error."""
    out = io.BytesIO()
    if kind is WireFormat.IPC:
        with pa.ipc.new_stream(out, table.schema) as writer:
            writer.write_table(table)
    elif kind is WireFormat.CSV:
        from pyarrow import csv

        csv.write_csv(table, out)
    else:
        import json

        for row in table.to_pylist():
            out.write(json.dumps({k: v for k, v in row.items() if v is not None}, default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v),
                                 separators=(",", ":"), ensure_ascii=False).encode() + b"\n")
    data = out.getvalue()
    if limit is not None and len(data) > limit:
        raise StorageError(f"payload of {len(data)} bytes exceeds {limit}")
    return data


class TransactionMode(Enum):
    V1 = "v1"
    V2 = "v2"


@dataclass
class LoadConfig:
    """Settings of a table-load sink."""

    fe_urls: list[str]
    username: str
    password: str = ""
    database: str = ""
    mapping: TableMapping = field(default_factory=TableMapping)
    format: WireFormat = WireFormat.IPC
    transaction: TransactionMode = TransactionMode.V1
    max_payload_bytes: int = 100 * 1024 * 1024
    connect_timeout_s: int = 10
    timeout_s: int = 600
    max_retries: int = 3
    retry_delay_s: float = 1.0

    def __post_init__(self):
        if not self.fe_urls:
            raise ConfigurationError("at least one frontend url is needed")
        if not self.username.strip() or not self.database.strip():
            raise ConfigurationError("username and database may not be blank")


class HttpTransport:
    """The stream-load calls over HTTP.  ``load`` and the transaction steps raise StorageError unless they succeed."""

    def __init__(self, config: LoadConfig):
        self.config = config

    def _call(self, path: str, method: str, label: str, table: str, body: bytes = b"", extra: dict | None = None) -> dict:
        import base64
        import json
        import time
        import urllib.error
        import urllib.request

        c = self.config
        secret = base64.b64encode(f"{c.username}:{c.password}".encode()).decode()
        kinds = {WireFormat.IPC: "arrow", WireFormat.JSON: "json", WireFormat.CSV: "csv"}
        headers = {"Authorization": f"Basic {secret}", "label": label, "db": c.database, "table": table, "format": kinds[c.format], "Expect": "100-continue"}
        last: Exception | None = None
        for attempt in range(c.max_retries + 1):
            url = f"{c.fe_urls[attempt % len(c.fe_urls)].rstrip('/')}{path}"
            request = urllib.request.Request(url, data=body, method=method, headers=headers | (extra or {}))
            try:
                with urllib.request.urlopen(request, timeout=c.timeout_s) as reply:
                    answer = json.loads(reply.read() or b"{}")
                if str(answer.get("Status", "OK")).lower() in ("ok", "success", "label already exists"):
                    return answer
                raise StorageError(f"{path}: {answer}")
            except urllib.error.URLError as e:
                last = e
                time.sleep(c.retry_delay_s)
        raise StorageError(f"{path}: {last}")

    def load(self, table: str, label: str, body: bytes) -> None:
        self._call(f"/api/{self.config.database}/{table}/_stream_load", "PUT", label, table, body)

    def step(self, name: str, table: str, label: str, body: bytes = b"") -> None:
        self._call(f"/api/transaction/{name}", "PUT" if name == "load" else "POST", label, table, body)


@dataclass
class Loaded(WriterCommitMessage):
    labels: list


def pieces_under(batches, kind: WireFormat, limit: int):
    """Payloads of at most ``limit`` bytes that hold the rows of ``batches`` in order; a single larger row is an error.

    Rows are gathered up to about half the limit in memory, so a task never holds more than one payload and its rows.
    """
    def cut(table: pa.Table):
        body = payload(table, kind)
        if len(body) <= limit:
            yield body
        elif table.num_rows == 1:
            raise StorageError(f"payload of {len(body)} bytes exceeds {limit}")
        else:
            half = table.num_rows // 2
            yield from cut(table.slice(0, half))
            yield from cut(table.slice(half))

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if 2 * size >= limit:
            yield from cut(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from cut(pa.Table.from_batches(held))


class LoadWriter(DataSourceArrowWriter):
    """Loads of at most ``limit`` bytes, numbered in each task.

    V1 loads at once: a task that fails after some loads leaves them, and its next attempt repeats their labels, which
    the server knows (at least once, should labels have expired).  V2 prepares in the task and commits on the driver
    when all tasks are done.
    """

    def __init__(self, transport, table: str, label: str, kind: WireFormat, mode: TransactionMode, limit: int):
        self.transport, self.table, self.label, self.kind, self.mode, self.limit = transport, table, label, kind, mode, limit

    def write(self, batches):
        from pyspark import TaskContext

        labels = []
        try:
            for n, body in enumerate(pieces_under(batches, self.kind, self.limit)):
                label = f"{self.label}-{TaskContext.get().partitionId()}" + (f"-{n}" if n else "")
                if self.mode is TransactionMode.V1:
                    self.transport.load(self.table, label, body)
                    labels.append(label)
                    continue
                self.transport.step("begin", self.table, label)
                labels.append(label)
                self.transport.step("load", self.table, label, body)
                self.transport.step("prepare", self.table, label)
        except StorageError:
            if self.mode is TransactionMode.V2:
                for label in labels:
                    self._rollback(label)
            raise
        return Loaded(labels)

    def commit(self, messages):
        if self.mode is TransactionMode.V2:
            for label in self._labels(messages):
                self.transport.step("commit", self.table, label)

    def abort(self, messages):
        if self.mode is TransactionMode.V2:
            for label in self._labels(messages):
                self._rollback(label)

    @staticmethod
    def _labels(messages):
        return [label for m in messages if m is not None for label in m.labels]

    def _rollback(self, label):
        try:
            self.transport.step("rollback", self.table, label)
        except StorageError as e:
            log.warning("rollback of %s failed: %s", label, e)


def load_source(config: LoadConfig, table: str, label: str, transport=None) -> type[DataSource]:
    """A data source that loads into ``table``; ``transport`` stands in for HTTP in tests."""
    sender = transport or HttpTransport(config)

    class TableLoad(DataSource):
        @classmethod
        def name(cls):
            return "table_load"

        def writer(self, schema, overwrite):
            return LoadWriter(sender, table, label, config.format, config.transaction, config.max_payload_bytes)

    return TableLoad


@dataclass
class LoadSink:
    config: LoadConfig
    signal: str
    query_id: str | None = None
    transport: object = None

    def __call__(self, df: DataFrame, batch_id: int = 0) -> None:
        if df.isEmpty():
            return
        ship_package(df.sparkSession)
        mapping = self.config.mapping
        source = load_source(self.config, mapping.table_for(self.signal), load_label(self.signal, self.query_id, batch_id), self.transport)
        df.sparkSession.dataSource.register(source)
        mapping.prepared(df, self.signal).write.format("table_load").mode("append").save()
