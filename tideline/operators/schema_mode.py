"""Policies for the schema of a destination table."""

from __future__ import annotations

import logging
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.errors import SchemaError

log = logging.getLogger(__name__)


class SchemaMode(Enum):
    FIXED = "fixed"
    AUTO = "auto"
    CATALOG = "catalog"


class CatalogType(Enum):
    REST = "rest"
    GLUE = "glue"
    S3TABLES = "s3tables"


def table_schema(spark: SparkSession, name: str) -> StructType | None:
    """The schema of a catalogue table, or None where there is no such table."""
    return spark.table(name).schema if spark.catalog.tableExists(name) else None


def apply(df: DataFrame, mode: SchemaMode, table: StructType | None, log_dropped: bool = True, validate: bool = False) -> DataFrame:
    """``df`` as the policy wants it; unchanged where the table isn't known.

    ``fixed`` passes everything (with ``validate``, columns must equal the table's).  ``auto`` refuses new columns
    and other types.  ``catalog`` keeps the table's columns in the order of ``df``, cast where types differ (what
    can't be cast becomes null), and drops the rest; columns that only the table has are not added.
    """
    if table is None:
        return df
    known = {f.name: f.dataType for f in table.fields}
    if mode is SchemaMode.FIXED:
        if validate and [(f.name, f.dataType) for f in df.schema.fields] != list(known.items()):
            raise SchemaError("columns differ from the table's")
        return df
    if mode is SchemaMode.AUTO:
        for f in df.schema.fields:
            if f.name not in known:
                raise SchemaError(f"new column {f.name} detected")
            if f.dataType != known[f.name]:
                raise SchemaError(f"Schema mismatch for field {f.name}: {f.dataType.simpleString()}, not {known[f.name].simpleString()}")
        return df
    if log_dropped and (dropped := dropped_columns(df, table)):
        log.warning("columns not in the table are dropped: %s", ", ".join(dropped))
    return df.select([
        F.col(f"`{f.name}`") if f.dataType == known[f.name] else F.col(f"`{f.name}`").try_cast(known[f.name]).alias(f.name)
        for f in df.schema.fields if f.name in known])


def dropped_columns(df: DataFrame, table: StructType) -> list[str]:
    return [c for c in df.columns if c not in set(table.names)]
