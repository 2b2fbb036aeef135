"""Self-telemetry: what the streams of a session report about themselves."""

from __future__ import annotations

import json
import logging
import threading
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger(__name__)


@dataclass
class Settings:
    """Where reports go besides the log: nowhere without an endpoint."""

    otlp_endpoint: str = ""
    region: str = ""
    log_level: str = "info"


@dataclass
class Counters:
    batches: int = 0
    rows: int = 0
    failures: int = 0


class Reports(StreamingQueryListener):
    """Logs each micro-batch as a line of JSON and keeps counters by the name of the query."""

    def __init__(self, settings: Settings | None = None):
        self.settings, self.by_query, self.names, self._lock = settings or Settings(), {}, {}, threading.Lock()
        log.setLevel(self.settings.log_level.upper())

    def counters(self, name: str) -> Counters:
        with self._lock:
            return self.by_query.setdefault(name, Counters())

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name
        log.info("started %s", event.name)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        mine = self.counters(p.name)
        with self._lock:
            mine.batches += 1
            mine.rows += p.numInputRows
        log.info(json.dumps({"query": p.name, "batch": p.batchId, "rows": p.numInputRows, "region": self.settings.region, "ms": dict(p.durationMs)}))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        name = self.names.get(str(event.id))
        if event.exception:
            self.counters(name).failures += 1
            log.error("%s failed: %s", name, event.exception)


def report(spark: SparkSession, settings: Settings | None = None) -> Reports:
    """Listen to all streams of the session."""
    out = Reports(settings)
    spark.streams.addListener(out)
    return out
