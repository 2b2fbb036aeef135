"""Routing of signals to tables and outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tideline.errors import ConfigurationError, DownstreamClosed
from tideline.operators.decode import add_signal_type
from tideline.schemas import SIGNALS


@dataclass(frozen=True)
class TableMapping:
    """One table for all signals with a column that tells them apart, or a table for each signal."""

    unified: str | None = None
    column: str = "signal_type"
    logs: str = "otel_logs"
    traces: str = "otel_traces"
    metrics: str = "otel_metrics"

    def table_for(self, signal: str) -> str:
        if self.unified:
            return self.unified
        if signal not in SIGNALS:
            raise ConfigurationError(f"unknown signal {signal}")
        return getattr(self, signal)

    @property
    def signal_type_column(self) -> str | None:
        return self.column if self.unified else None

    def prepared(self, df: DataFrame, signal: str) -> DataFrame:
        return add_signal_type(df, self.column, signal) if self.unified else df


def unified(signals: dict[str, DataFrame], column: str = "signal_type") -> DataFrame:
    """All signals in one frame; columns that a signal lacks are null."""
    out = None
    for name, df in signals.items():
        part = add_signal_type(df, column, name)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ConfigurationError("no signals")
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    """The rows of frames of one schema."""
    if not frames:
        raise ConfigurationError("nothing to join")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def passthrough(df: DataFrame) -> DataFrame:
    return df


class Fanout:
    """Delivers each batch to every output in turn."""

    def __init__(self, outputs: list[Callable[[DataFrame, int], None]]):
        if not outputs:
            raise ConfigurationError("at least one output is needed")
        self.outputs = list(outputs)

    def __call__(self, df: DataFrame, batch_id: int = 0) -> None:
        df = df.persist()
        try:
            for n, output in enumerate(self.outputs):
                try:
                    output(df, batch_id)
                except (ConnectionError, BrokenPipeError) as e:
                    raise DownstreamClosed(f"output {n} takes no more") from e
        finally:
            df.unpersist()
