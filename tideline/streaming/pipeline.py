"""Streams from the landing zone to the sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tideline.errors import ConfigurationError
from tideline.operators.batching import FlushPolicy
from tideline.operators.compliance import Engine, Mode, Outcome
from tideline.operators.routing import passthrough
from tideline.schemas import SIGNALS
from tideline.session import configure
from tideline.sources import landing

Sink = Callable[[DataFrame, int], object]


@dataclass
class Pipeline:
    """One streaming query per signal: read, decode, transform, judge, deliver.

    The landing file is the durable record; a failed flush is replayed from the checkpoint.
    """

    spark: SparkSession
    root: str
    checkpoints: str
    sinks: dict[str, Sink]
    policy: FlushPolicy = field(default_factory=FlushPolicy)
    transform: Callable[[DataFrame], DataFrame] = passthrough
    engine: Engine = field(default_factory=Engine)
    quarantine: Sink | None = None
    protobuf: bool = False
    max_files: int | None = None

    def __post_init__(self):
        if self.engine.mode in (Mode.QUARANTINE, Mode.REMAP) and self.quarantine is None:
            raise ConfigurationError(f"mode {self.engine.mode.value} needs a sink for quarantined batches")

    def build(self, signal: str) -> DataFrame:
        read = landing.read_protobuf_files if self.protobuf else landing.read_json_lines
        return landing.decoded(read(self.spark, self.root, signal, stream=True, max_files=self.max_files), signal).transform(self.transform)

    def flush(self, signal: str) -> Sink:
        def run(df: DataFrame, batch_id: int) -> None:
            if self.engine.mode is not Mode.OFF:
                outcome, df = self.engine.assess(df)
                if outcome is Outcome.QUARANTINED:
                    self.quarantine(df, batch_id)
                    return
            self.sinks[signal](df, batch_id)

        return run

    def start(self, drain: bool = False) -> list[StreamingQuery]:
        """Start the queries; with ``drain`` they stop once all that has landed is delivered."""
        configure(self.spark)
        queries = []
        for signal in (s for s in SIGNALS if s in self.sinks):
            writer = self.build(signal).writeStream.queryName(f"tideline-{signal}").option("checkpointLocation", f"{self.checkpoints}/{signal}")
            trigger = {"availableNow": True} if drain else self.policy.trigger()
            queries.append(writer.trigger(**trigger).foreachBatch(self.flush(signal)).start())
        return queries

    def run_until_drained(self) -> None:
        for query in self.start(drain=True):
            query.awaitTermination()


def stop(queries: list[StreamingQuery]) -> None:
    """Finish what has been read, then stop."""
    for query in queries:
        query.processAllAvailable()
        query.stop()
