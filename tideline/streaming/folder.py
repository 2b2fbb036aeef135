"""A folder in place of a load server: what would have been sent, for rehearsals."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FolderTransport:
    """Each call becomes a file ``step/label.id`` under a folder that all executors reach."""

    def __init__(self, root: str):
        self.root = root

    def load(self, table: str, label: str, body: bytes) -> None:
        self.step("stream_load", table, label, body)

    def step(self, name: str, table: str, label: str, body: bytes = b"") -> None:
        from pyarrow import fs

        filesystem, base = fs.FileSystem.from_uri(self.root)
        filesystem.create_dir(f"{base}/{name}", recursive=True)
        with filesystem.open_output_stream(f"{base}/{name}/{label}.{uuid.uuid4().hex}") as out:
            out.write(body or label.encode())  # readers pass over empty files


def loaded_rows(spark: SparkSession, root: str, schema: str, two_phase: bool) -> DataFrame:
    """The rows of Arrow payloads that were loaded; of two-phase loads, those whose labels were committed."""
    label = F.regexp_extract("path", r"/([^/]+)\.[^./]+$", 1).alias("label")
    step = "load" if two_phase else "stream_load"
    found = spark.read.format("binaryFile").load(f"{root}/{step}").select(label, "content")
    if two_phase:
        found = found.join(spark.read.format("binaryFile").load(f"{root}/commit").select(label).distinct(), "label")

    def run(batches):
        for batch in batches:
            for body in batch.column(0).to_pylist():
                yield from pa.ipc.open_stream(body).read_all().to_batches()

    return found.select("content").mapInArrow(run, schema)
