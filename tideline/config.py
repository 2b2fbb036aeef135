"""Configuration: built-in values, then a TOML file, then the environment, then arguments."""

from __future__ import annotations

import argparse
import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from tideline.errors import ConfigurationError
from tideline.functions.scalars import Granularity, WireFormat
from tideline.operators.batching import FlushPolicy
from tideline.operators.routing import TableMapping
from tideline.operators.schema_mode import CatalogType, SchemaMode

#: Of environment variables; a parameter of :func:`load`, for those who have others.
PREFIX = "TIDELINE_"
SINKS = ("iceberg", "kafka", "starrocks")
DEFAULTS = {
    "pipeline": {"batch_size": 1000},
    "server": {"grpc_addr": "0.0.0.0:4317", "http_addr": "0.0.0.0:4318"},
    "telemetry": {"otlp_endpoint": "", "region": "", "log_level": "info"},
}


@dataclass
class IcebergConfig:
    table_identifier: str = "default.otel"
    catalog_type: CatalogType = CatalogType.REST
    catalog_uri: str = ""
    warehouse: str = ""
    catalog_properties: dict = field(default_factory=dict)
    logs_table: str = ""
    traces_table: str = ""
    metrics_table: str = ""
    schema_mode: SchemaMode = SchemaMode.FIXED
    partition_granularity: Granularity = Granularity.HOURLY
    log_dropped_fields: bool = True
    max_batch_size_bytes: int = 128 * 1024 * 1024
    max_batch_interval_sec: int = 60
    max_batch_records: int | None = None
    dry_run: bool = False

    def table_for(self, signal: str) -> str:
        return getattr(self, f"{signal}_table") or self.table_identifier

    def __post_init__(self):
        self.catalog_type, self.schema_mode = CatalogType(self.catalog_type), SchemaMode(self.schema_mode)
        self.partition_granularity = Granularity(self.partition_granularity)
        tables = [self.table_for(s) for s in ("logs", "traces", "metrics")]
        if len(set(tables)) != 3:
            raise ConfigurationError(f"the tables of the signals must differ: {tables}")

    def policy(self) -> FlushPolicy:
        return FlushPolicy(self.max_batch_size_bytes, self.max_batch_interval_sec, self.max_batch_records)

    def spark_options(self, name: str = "lake") -> dict[str, str]:
        """Settings of the session that open the catalogue (its connector must be on the class path)."""
        base = f"spark.sql.catalog.{name}"
        kinds = {CatalogType.REST: {f"{base}.type": "rest", f"{base}.uri": self.catalog_uri},
                 CatalogType.GLUE: {f"{base}.catalog-impl": "org.apache.iceberg.aws.glue.GlueCatalog"},
                 CatalogType.S3TABLES: {f"{base}.catalog-impl": "software.amazon.s3tables.iceberg.S3TablesCatalog"}}
        out = {base: "org.apache.iceberg.spark.SparkCatalog"} | kinds[self.catalog_type]
        if self.warehouse and self.catalog_type is not CatalogType.S3TABLES:
            out[f"{base}.warehouse"] = self.warehouse
        return out | {f"{base}.{k}": str(v) for k, v in self.catalog_properties.items()}


@dataclass
class KafkaConfig:
    brokers: str = "localhost:9092"
    topic: str = "otel"
    format: WireFormat = WireFormat.IPC
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if isinstance(self.format, str):
            self.format = WireFormat.parse(self.format, ("ipc", "json"))


@dataclass
class StarRocksConfig:
    fe_urls: list = field(default_factory=list)
    username: str = ""
    password: str = ""
    database: str = ""
    unified_table: str = ""
    signal_type_column: str = "signal_type"
    logs_table: str = "otel_logs"
    traces_table: str = "otel_traces"
    metrics_table: str = "otel_metrics"
    format: str = "ipc"
    transaction: str = "v1"

    def load_config(self):
        from tideline.streaming.sinks import LoadConfig, TransactionMode

        mapping = TableMapping(self.unified_table or None, self.signal_type_column, self.logs_table, self.traces_table, self.metrics_table)
        return LoadConfig(self.fe_urls, self.username, self.password, self.database, mapping, WireFormat.parse(self.format), TransactionMode(self.transaction))


@dataclass
class AppConfig:
    pipeline: dict = field(default_factory=dict)
    server: dict = field(default_factory=dict)
    telemetry: dict = field(default_factory=dict)
    iceberg: IcebergConfig | None = None
    kafka: KafkaConfig | None = None
    starrocks: StarRocksConfig | None = None
    sink: str | None = None

    def chosen_sink(self) -> str:
        """The one asked for by ``sink``, else the first configured one."""
        there = [s for s in SINKS if getattr(self, s) is not None]
        if self.sink:
            if self.sink not in there:
                raise ConfigurationError(f"sink {self.sink} has no section")
            return self.sink
        if not there:
            raise ConfigurationError("no sink is configured")
        return there[0]


def merge(low: dict, high: dict) -> dict:
    out = dict(low)
    for k, v in high.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def from_environment(environ: dict[str, str], prefix: str = PREFIX) -> dict:
    """``TIDELINE_KAFKA__TOPIC=x`` is ``[kafka] topic``; values are read as TOML where they are."""
    out: dict = {}
    for name, text in environ.items():
        if not name.startswith(prefix):
            continue
        try:
            value = tomllib.loads(f"v = {text}")["v"]
        except tomllib.TOMLDecodeError:
            value = text
        *path, last = name[len(prefix):].lower().split("__")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def _section(kind, values):
    if values is None:
        return None
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ConfigurationError(f"unknown settings: {sorted(unknown)}")
    try:
        return kind(**values)
    except ValueError as e:
        raise ConfigurationError(str(e)) from e


def load(path: str | None = None, environ: dict[str, str] | None = None, arguments: dict | None = None,
         prefix: str = PREFIX) -> AppConfig:
    values = DEFAULTS
    file = Path(path) if path else Path("config.toml")
    if file.exists():
        try:
            values = merge(values, tomllib.loads(file.read_text()))
        except tomllib.TOMLDecodeError as e:
            raise ConfigurationError(f"{file}: {e}") from e
    elif path:
        raise ConfigurationError(f"no such file: {path}")
    values = merge(values, from_environment(os.environ if environ is None else environ, prefix))
    # a dry run is asked of tables that are configured; it doesn't configure any
    values = merge(values, {k: v for k, v in (arguments or {}).items() if k in values or v != {"dry_run": True}})
    return AppConfig(values["pipeline"], values["server"], values["telemetry"], _section(IcebergConfig, values.get("iceberg")),
                     _section(KafkaConfig, values.get("kafka")), _section(StarRocksConfig, values.get("starrocks")), values.get("sink"))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("tideline", description="Telemetry from a landing folder to a sink")
    out.add_argument("--config")
    out.add_argument("--verbose", action="store_true")
    out.add_argument("--check", action="store_true", help="check the configuration and stop")
    out.add_argument("--grpc-addr")
    out.add_argument("--http-addr")
    out.add_argument("--dry-run", action="store_true")
    out.add_argument("--landing", help="folder with v1/logs, v1/traces and v1/metrics")
    out.add_argument("--output", help="folder of the tables")
    return out


def arguments_of(args: argparse.Namespace) -> dict:
    server = {k: v for k, v in (("grpc_addr", args.grpc_addr), ("http_addr", args.http_addr)) if v}
    out: dict = {"server": server} if server else {}
    if args.dry_run:
        out["iceberg"] = {"dry_run": True}
    if args.verbose:
        out["telemetry"] = {"log_level": "debug"}
    return out
