"""SimHash near-duplicates: fingerprints, pivot distance tables and linked classes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm._shared import durable, only_chosen, text_digest
from tideline.llm.components import connected_components
from tideline.session import ship_package

HASH_SEED = 42
LOW_BITS = np.uint64(0x0101010101010101)


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """64 majority bits over the XXH64 values of all word shingles (repeats counted).

    ``bytes.lower`` and ``bytes.split`` touch exactly A-Z and 0x20, 0x09-0x0D.
    A text of fewer words is one shingle; a text without words has fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = (xxh64_intdigest(b" ".join(s), HASH_SEED) for s in zip(*(words[k:] for k in range(shingle)))) \
        if len(words) >= shingle else iter([xxh64_intdigest(b" ".join(words), HASH_SEED)])
    return majority(np.fromiter(hashes, dtype=np.uint64, count=n))


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit values."""
    n = len(values)
    counts = np.zeros((8, 8), dtype=np.int64)
    padded = np.zeros(-(-n // 255) * 255, dtype=np.uint64)
    padded[:n] = values
    for bit in range(8):
        # eight counters of a byte each per word: sums over 255 rows can't overflow
        lanes = ((padded >> np.uint64(bit)) & LOW_BITS).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts.reshape(64) > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, th, fp)`` with the fingerprint as a signed long; null texts count as empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            out = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["doc_id", "th", "fp"])

    ship_package(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text).alias("th"), text.cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def pivots(count: int = 16, seed: int = 7) -> list[int]:
    """Reference fingerprints, drawn once from a seeded generator."""
    return [int(x) for x in np.random.default_rng(seed).integers(-(2**63), 2**63, size=count, dtype=np.int64)]


def pivot_distances(fp: Column, refs: list[int]) -> Column:
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("byte") for r in refs])


def within(pa: Column, pb: Column, a: Column, b: Column, max_bits: int, n_pivots: int) -> Column:
    """Whether two fingerprints differ in ``max_bits`` bits at most.

    By the triangle inequality a pair is discarded as soon as its distances to one reference fingerprint differ by
    more; the survivors are verified bit by bit.
    """
    near = F.lit(True)
    for i in range(n_pivots):
        near = near & (F.abs(pa[i].cast("int") - pb[i].cast("int")) <= max_bits)
    return near & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)


def close_pairs(distinct: DataFrame, max_bits: int = 2, n_pivots: int = 16, block_limit: int = 512) -> DataFrame:
    """``(a, b)``: links whose closure equals that of all pairs of ``distinct.fp`` within ``max_bits`` <= 2 bits.

    Two fingerprints at two bits or fewer agree on two of four 16-bit quarters: rows meet under six 32-bit keys.
    Within a key, pairs are discarded as soon as the Hamming distances to one reference fingerprint differ by more
    than ``max_bits``; survivors are verified bit by bit.  A key that holds more than ``block_limit``
    fingerprints goes another, equally exact way without pairs: every member points at the 65 values one bit
    away or less, and members that share such a value are linked to the smallest of them (all within two bits).
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    refs = pivots(n_pivots)
    fp = F.col("fp")
    quarter = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = [
        F.shiftleft(F.lit(n).cast("long"), 32).bitwiseOR(F.shiftleft(quarter[i], 16)).bitwiseOR(quarter[j])
        for n, (i, j) in enumerate(combinations(range(4), 2))
    ]
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = keyed.groupBy("key").count().where("count > 1")
    keyed = durable(keyed.join(sizes, "key"), "simhash-keys").withColumn("pd", pivot_distances(fp, refs))

    small = keyed.where(F.col("count") <= block_limit)
    left = small.select("key", F.col("fp").alias("a"), F.col("pd").alias("pa"))
    right = small.select("key", F.col("fp").alias("b"), F.col("pd").alias("pb"))
    near = (F.col("a") < F.col("b")) & within(F.col("pa"), F.col("pb"), F.col("a"), F.col("b"), max_bits, n_pivots)
    pairs = left.join(right, (left["key"] == right["key"]) & near).select("a", "b")

    crowded = keyed.where(F.col("count") > block_limit).select("fp").distinct()
    if max_bits == 2:
        around = F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(_one(i))))
    else:  # an unordered pair of neighbours shares exactly the edge (value without the bit, bit)
        around = F.transform(
            F.sequence(F.lit(0), F.lit(63)),
            lambda i: F.xxhash64(fp.bitwiseAND(F.bitwise_not(_one(i))), i),
        )
    hubs = crowded.select("fp", F.explode(around).alias("hub"))
    least = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = hubs.join(least, "hub").select("a", F.col("fp").alias("b"))
    if max_bits == 0:
        return pairs.limit(0)
    return pairs.union(stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).where("a <> b")


def _one(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, th, fp)`` of all documents, and ``(fp, root, component_id)`` of the different fingerprints."""
    rows = durable(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprint-classes")
    links = connected_components(close_pairs(classes.select("fp"), max_bits))
    member = classes.join(links, classes["fp"] == links["node"], "left").select(
        classes["fp"].alias("fp"), F.coalesce("root", classes["fp"]).alias("root"), "least_id")
    ids = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows, durable(member.join(ids, "root").select("fp", "root", "component_id"), "fingerprint-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id`` (smallest doc_id reachable over links).

    Documents of one fingerprint are one class and are never paired with each other.  Empty and null texts all have
    fingerprint 0 and link like any other.  Rows with a null doc_id keep it and get their class's smallest known id.
    Repeated rows come out as often as they went in; very long texts are read whole; extra columns are ignored; an
    empty table gives no rows.
    """
    rows, labelled = _classes(docs, id_col, text_col, shingle, max_bits)
    return rows.join(labelled, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
               max_bits: int = 2) -> DataFrame:
    """The document of the smallest id of each near-duplicate class, with its columns as it was.

    Identical repeated rows are one document and one of them stays.  Where an id is carried by different texts, each
    is judged by its own text.  A class in which no row has an id keeps one of its rows.
    """
    rows, labelled = _classes(docs, id_col, text_col, shingle, max_bits)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("best")
    chosen = rows.join(labelled, "fp").groupBy("root").agg(best).select("best.doc_id", "best.th")
    return only_chosen(docs, rows, chosen, id_col, text_col)
