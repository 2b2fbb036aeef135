"""Compliance with the naming rules of resources: strict, quarantine, remap or off."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.errors import ConfigurationError, MissingMetadata
from tideline.functions.scalars import has_key, rename_keys, require_string

STATUS_KEY = "otel::compliance::status"
VERIFIED = "verified"
RESOURCE = "resource_attributes"


class Mode(Enum):
    STRICT = "strict"
    QUARANTINE = "quarantine"
    REMAP = "remap"
    OFF = "off"


class Outcome(Enum):
    COMPLIANT = "compliant"
    REMAPPED = "remapped"
    QUARANTINED = "quarantined"


@dataclass
class Engine:
    """Judges whole batches: one bad row makes its batch bad."""

    mode: Mode = Mode.OFF
    rules: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if chained := set(self.rules) & set(self.rules.values()):
            raise ConfigurationError(f"rules feed each other: {sorted(chained)}")

    @staticmethod
    def is_tagged(df: DataFrame) -> bool:
        return RESOURCE in df.columns and df.schema[RESOURCE].metadata.get(STATUS_KEY) == VERIFIED

    @staticmethod
    def tag(df: DataFrame) -> DataFrame:
        if RESOURCE not in df.columns:
            return df
        return df.withMetadata(RESOURCE, {**df.schema[RESOURCE].metadata, STATUS_KEY: VERIFIED})

    @staticmethod
    def row_ok() -> Column:
        return has_key(F.col(RESOURCE), "service.name")

    def check(self, df: DataFrame) -> bool:
        """Whether all rows comply; true for no rows, false without the column."""
        if RESOURCE not in df.columns:
            return False
        require_string(df, RESOURCE)
        return not df.where(~self.row_ok()).take(1)

    def remap(self, df: DataFrame) -> DataFrame:
        present = [c for c in ("attributes", RESOURCE) if c in df.columns]
        for c in present:
            require_string(df, c)
        return df.withColumns({c: rename_keys(F.col(c), self.rules) for c in present}) if self.rules else df

    def assess(self, df: DataFrame) -> tuple[Outcome, DataFrame]:
        """The outcome for ``df`` as one batch, and the rows to go on with."""
        if self.mode is Mode.OFF or self.is_tagged(df):
            return Outcome.COMPLIANT, df
        if self.mode is Mode.REMAP:
            mapped = self.remap(df)
            return (Outcome.REMAPPED, self.tag(mapped)) if self.check(mapped) else (Outcome.QUARANTINED, mapped)
        if self.check(df):
            return Outcome.COMPLIANT, self.tag(df)
        if self.mode is Mode.STRICT:
            raise MissingMetadata("a row lacks service.name in its resource attributes")
        return Outcome.QUARANTINED, df

    def verdicts(self, df: DataFrame, batch: str, name: str = "batch_ok") -> DataFrame:
        """``df`` with the verdict of the batch that each row belongs to, for many batches at once.

        The verdict is a partial aggregate per batch, joined back; no batch is gathered in a task.
        """
        if RESOURCE not in df.columns:
            return df.withColumn(name, F.lit(False))
        require_string(df, RESOURCE)
        bad = df.groupBy(batch).agg(F.bool_and(self.row_ok()).alias(name))
        return df.join(bad, df[batch].eqNullSafe(bad[batch])).drop(bad[batch])

    def split(self, df: DataFrame, batch: str) -> tuple[DataFrame, DataFrame]:
        """(rows of good batches, rows for quarantine); remapped first in that mode; strict raises on a bad batch."""
        if self.mode is Mode.OFF or self.is_tagged(df):
            return df, df.limit(0)
        judged = self.verdicts(self.remap(df) if self.mode is Mode.REMAP else df, batch, "_ok")
        if self.mode is Mode.STRICT and judged.where(~F.col("_ok")).take(1):
            raise MissingMetadata("a batch lacks service.name in its resource attributes")
        return self.tag(judged.where("_ok").drop("_ok")), judged.where(~F.col("_ok")).drop("_ok")

