"""When buffered batches are flushed, and the replay of that rule over recorded batches."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FlushPolicy:
    """A non-empty buffer is flushed once it has the rows or the bytes, or the interval is over."""

    max_bytes: int = 128 * 1024 * 1024
    max_seconds: float = 60.0
    max_rows: int | None = None

    def due(self, rows: int, size: int, seconds: float) -> bool:
        return rows > 0 and ((self.max_rows is not None and rows >= self.max_rows) or size >= self.max_bytes or seconds >= self.max_seconds)

    def trigger(self) -> dict:
        """Arguments of ``writeStream.trigger``."""
        return {"processingTime": f"{max(1, round(self.max_seconds))} seconds"}


def replay(batches: DataFrame, policy: FlushPolicy, table: str = "table_name") -> DataFrame:
    """``(table_name, batch, rows, bytes, at)`` (seconds) -> the same with ``flush``: the number of the flush it lands in.

    The rule is applied after each batch is added, so a flush can overshoot; a table's batches are one ordered state,
    hence a group each.  Tables are few and a row is a batch, not a record.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at", "batch"], kind="stable")
        rows = size = flush = 0
        since = float(frame["at"].iloc[0]) if len(frame) else 0.0
        numbers = []
        for r, b, t in zip(frame["rows"], frame["bytes"], frame["at"]):
            if policy.due(rows, size, t - since):  # the clock ran out before this batch came
                flush, rows, size, since = flush + 1, 0, 0, t
            rows, size = rows + r, size + b
            numbers.append(flush)
            if policy.due(rows, size, t - since):
                flush, rows, size, since = flush + 1, 0, 0, t
        return frame.assign(flush=numbers)

    schema = f"{table} string, batch long, rows long, bytes long, at double, flush long"
    return batches.select(table, "batch", "rows", "bytes", "at").groupBy(table).applyInPandas(run, schema)

