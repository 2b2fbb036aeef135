"""``python -m tideline --landing DIR --output DIR``: deliver what has landed."""

from __future__ import annotations

import logging
import sys

from tideline import config
from tideline.errors import PipelineError


def main(argv: list[str] | None = None) -> int:
    args = config.parser().parse_args(argv)
    try:
        app = config.load(args.config, arguments=config.arguments_of(args))
        sink = app.chosen_sink() if not args.output else "files"
    except PipelineError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    logging.basicConfig(level=app.telemetry["log_level"].upper())
    if args.check:
        print(f"configuration is fine; sink: {sink}")
        return 0
    if not args.landing:
        print("--landing is needed", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from tideline.schemas import SIGNALS
    from tideline.streaming.pipeline import Pipeline
    from tideline.streaming.sinks import LoadSink, QueueSink, TableSink
    from tideline.streaming.telemetry import Settings, report

    spark = SparkSession.builder.appName("tideline").getOrCreate()
    lake = app.iceberg or config.IcebergConfig(logs_table="logs", traces_table="traces", metrics_table="metrics")
    report(spark, Settings(**{k: v for k, v in app.telemetry.items() if k in Settings.__dataclass_fields__}))
    make = {
        "files": lambda s: TableSink(s, path=f"{args.output}/{s}", granularity=lake.partition_granularity, dry_run=args.dry_run),
        "iceberg": lambda s: TableSink(s, table=lake.table_for(s), mode=lake.schema_mode, dry_run=lake.dry_run, log_dropped=lake.log_dropped_fields),
        "kafka": lambda s: QueueSink(app.kafka.brokers, app.kafka.topic, app.kafka.format, app.kafka.options, per_batch=True),
        "starrocks": lambda s: LoadSink(app.starrocks.load_config(), s, "tideline"),
    }[sink]
    root = args.output or args.landing
    Pipeline(spark, args.landing, f"{root}/_checkpoints", {s: make(s) for s in SIGNALS}, lake.policy()).run_until_drained()
    return 0


if __name__ == "__main__":
    sys.exit(main())
