"""Helpers shared by the operators of this package: table access and durable intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import scratch_path, ship_package

#: Rows of a few numbers each that may be broadcast: some 30 MB in memory.  Beyond it, tables are joined by shuffles.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tideline_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`durable` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._tideline_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def only_chosen(docs: DataFrame, rows: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and text are in ``chosen(doc_id, th)``, each once, with their columns as they were.

    ``rows(doc_id, th)`` are all rows of ``docs``, ``th`` their :func:`text_digest`.  Documents are sought by what goes,
    and only rows that repeat both id and text are ever compared, so texts are shuffled only where more goes than may
    be broadcast.
    """
    keys = ["doc_id", "th"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("times"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    marked_ids = chosen.select(*keys, F.lit(True).alias("stays"))
    judged = counts.join(marked_ids, same(counts, marked_ids), "left").select(counts["doc_id"], counts["th"], "times", "stays")
    judged = durable(judged.where("stays is null or times > 1"), "near-judged")
    mark = "_" + uuid.uuid4().hex
    named = docs.withColumn(mark, F.struct(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("th")))
    hit = lambda df: named[mark]["doc_id"].eqNullSafe(df["doc_id"]) & (named[mark]["th"] == df["th"])
    odd = small(judged)
    out = named.join(odd, hit(odd), "left_anti").select(*docs.columns)
    again = judged.where("stays")
    if again.isEmpty():
        return out
    again = small(again)
    more = named.join(again, hit(again), "left_semi").dropDuplicates([mark]).select(*docs.columns)
    return out.union(more)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
