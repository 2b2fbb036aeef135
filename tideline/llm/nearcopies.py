"""Near copies by word shingles: MinHash bands find candidates, fingerprints discard, the shingle sets decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm._shared import durable, only_chosen, release, small, text_digest
from tideline.llm.components import connected_components
from tideline.llm.simhash import majority, pivot_distances, pivots, within
from tideline.session import ship_package

SHINGLE = 5
SIMILARITY = 0.8
#: A pair at similarity s shares no band with probability (1 - s^6)^24: 7e-4 at 0.8, 1e-5 at 0.85, less above.
BANDS, DEPTH = 24, 6
#: At similarity 0.8 fingerprints of 64 bits differ in 9.7 bits on average with a deviation of 2.9; over 24: below 1e-6.
MAX_BITS, PIVOTS = 24, 16
_P = np.uint64(0x9E3779B97F4A7C15)
_DRAWN = np.random.default_rng(19).integers(0, 2**64, size=(2, BANDS * DEPTH, 1), dtype=np.uint64)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Different 64-bit hashes of all runs of ``size`` words; fewer words are one shingle, none are none."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = h * _P + each[k:len(words) - size + 1 + k]
    return np.unique(_mixed(h))


def bands(h: np.ndarray) -> np.ndarray:
    """One key a band, from the least values of ``DEPTH`` permutations each."""
    least = np.full(BANDS * DEPTH, ~np.uint64(0))
    for low in range(0, len(h), 512):
        np.minimum(least, ((h[None, low:low + 512] ^ _XOR) * _TIMES).min(axis=1), out=least)
    least = least.reshape(BANDS, DEPTH)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(DEPTH):
        key = _mixed(key * _P + least[:, k])
    return key


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.uint64).view(np.int64))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _signed(np.concatenate(values) if values else []))


SIGNATURES = "doc_id long, th long, node long, n long, fp long, keys array<long>"


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of each row: digests of the text and of its words, its different shingles, their fingerprint, its band keys."""

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            nodes, sizes, fps, keys = [], [], [], []
            for t in batch.column(2).cast(pa.binary()):
                words = t.as_py().lower().split()
                h = shingles(words)
                nodes.append(xxh64_intdigest(b" ".join(words)))
                sizes.append(len(h))
                fps.append(majority(h) if len(h) else 0)
                keys.append(bands(h) if len(h) else h)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _signed(nodes), pa.array(sizes, pa.int64()), _signed(fps), _lists(keys)],
                names=[c.split()[0] for c in SIGNATURES.split(", ")])

    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, SIGNATURES)


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(node, sh)`` with the shingles of the texts of ``nodes(node, doc_id, th)``."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py().lower().split()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["node", "sh"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("th"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    nodes = small(nodes.select("node", "doc_id", "th"))
    same = texts["doc_id"].eqNullSafe(nodes["doc_id"]) & (texts["th"] == nodes["th"])
    return texts.join(nodes, same).select("node", "text").mapInArrow(run, "node long, sh array<long>")


def _possible(similarity: float) -> Column:
    """Whether ``a`` and ``b`` can be near copies at all.

    No more shingles than ``live``, those of a text that any other text has, can be common; a similarity of s asks for
    s / (1 + s) of the shingles of both.  Both sides follow from the definition, so no near copy is lost to them.
    """
    needed = F.lit(similarity / (1 + similarity)) * (F.col("an") + F.col("bn")) - 1e-9
    near = within(F.col("apd"), F.col("bpd"), F.col("afp"), F.col("bfp"), MAX_BITS, PIVOTS)
    return (F.least("alive", "blive") >= needed) & near


def _side(rows: DataFrame, name: str, *more: str) -> DataFrame:
    return rows.select("key", F.col("node").alias(name), *[F.col(c).alias(name + c) for c in ("n", "live", "fp", "pd", *more)])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    pairs = durable(pairs.distinct(), "near-pairs")
    left, right = (sets.select(F.col("node").alias(c), F.col("sh").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    enough = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both) - 1e-9
    found = durable(pairs.join(left, "a").join(right, "b").where(enough).select("a", "b"), "near-links")
    release(pairs)
    return found


def _rare_partners(apart: DataFrame, sets: DataFrame, each: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: texts of different classes that may be near copies, by the rarest shingles of each.

    A pair at similarity s has s of the shingles of either text in common, so in one order of all shingles, the rare
    ones first, the first common shingle is among the first (1 - s) n + 1 of both, and leaves enough behind it on both
    sides.  Families of edited copies differ in rare shingles, so hardly any pair is left.  Texts of the class that is
    most frequent under a shingle are only compared with those of others.
    """
    own = sets.join(apart.select("node"), "node", "left_semi").select("node", F.explode("sh").alias("s"))
    ranked = own.join(each.where("df > 1").select("s", "df"), "s", "left").select("node", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s").alias("x"))
    ranked = ranked.groupBy("node").agg(F.array_sort(F.collect_set("x")).alias("x"))  # at most a text's own shingles
    room = F.floor((1 - similarity) * F.col("n") + 1e-9) + 1
    first = apart.join(ranked, "node").withColumn("x", F.slice("x", F.lit(1), room.cast("int")))
    first = first.select("node", "n", "live", "fp", "pd", "root", F.posexplode("x").alias("place", "x")).withColumn("key", F.col("x.s"))
    first = durable(first.where("x.df > 1").drop("x"), "near-rare")
    of_class = first.groupBy("key", "root").agg(F.count("*").alias("many")).groupBy("key")
    most = of_class.agg(F.max(F.struct("many", "root")).alias("most"), F.count("*").alias("classes")).where("classes > 1")
    most = durable(most.select("key", F.col("most.root").alias("most")), "near-most")
    first = durable(first.join(most, "key"), "near-shared-rare")
    left, right = (_side(rows, c, "root", "place") for rows, c in ((first.where("root <> most"), "a"), (first, "b")))
    needed = F.lit(similarity / (1 + similarity)) * (F.col("an") + F.col("bn")) - 1e-9
    left_over = F.least(F.col("an") - F.col("aplace"), F.col("bn") - F.col("bplace")) >= needed
    rest = left.join(right, "key").where((F.col("aroot") != F.col("broot")) & left_over & _possible(similarity))
    return rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """``(node, root)`` of the closure of all verified pairs that share a band.

    The texts of a band key are first compared with one of them alone, the one with the largest share of shingles that
    others have too: of a family of edited copies, the original.  Pairs that this leaves in different classes are
    compared after that, unless counting or the fingerprints rule them out; the closure is that of all of them.
    """
    keyed = classes.select("node", F.explode("keys").alias("key"))
    crowd = durable(keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key"), "near-crowd")
    shared = durable(keyed.join(crowd, "key"), "near-shared")
    nodes = classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "n", "fp", "best.doc_id", "best.th")
    nodes = durable(nodes, "near-nodes")
    sets = durable(_sets(docs, nodes, id_col, text_col), "near-sets")
    each = sets.select("node", F.explode("sh").alias("s")).groupBy("s").agg(F.count("*").alias("df"), F.min("node").alias("node"), F.max("node").alias("other"))
    each = durable(each, "near-shingles")
    alone = each.where("node = other").groupBy("node").agg(F.count("*").alias("alone"))
    live = (F.col("n") - F.coalesce("alone", F.lit(0))).alias("live")
    nodes = nodes.join(alone, "node", "left").select("node", "n", "fp", live, pivot_distances(F.col("fp"), pivots(PIVOTS)).alias("pd"))
    # a text of which too much is its own has no near copy
    shared = durable(shared.join(durable(nodes.where(live >= F.lit(similarity) * F.col("n") - 1e-9), "near-live"), "node"), "near-able")

    best = F.min(F.struct((-F.col("live") / F.col("n")).alias("own"), "node")).alias("lead")
    heads = durable(shared.groupBy("key").agg(best).select("key", F.col("lead.node").alias("node")), "near-heads")
    lead = _side(durable(shared.join(heads, ["key", "node"]), "near-leads"), "a")
    stars = lead.join(_side(shared, "b"), "key").where((F.col("a") != F.col("b")) & _possible(similarity))
    first = _verified(stars.select("a", "b"), sets, similarity)
    roots = connected_components(first)

    rooted = durable(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-rooted")
    split = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    apart = durable(rooted.join(durable(split, "near-split"), "key").drop("key").distinct(), "near-apart")
    rest = _rare_partners(apart, sets, each, similarity)
    second = _verified(rest.select("a", "b"), sets, similarity)
    return roots if second.isEmpty() else connected_components(first.union(second))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class of near copies, that of the smallest id, with its columns as it was.

    Two texts are near copies if the Jaccard similarity of their sets of five-word shingles (bytes, A-Z as a-z) is
    ``similarity`` or more; classes are the closure.  Texts without words are one class.  A class without ids keeps
    one row.  Where an id is carried by different texts, each is judged by its own text.  Repeated rows are one
    document; extra columns stay; very long texts are judged whole; an empty table gives no rows.
    """
    rows = durable(signatures(docs, id_col, text_col), "near-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")).alias("best")
    classes = rows.groupBy("node").agg(best, *[F.any_value(c).alias(c) for c in ("n", "fp", "keys")])
    classes = durable(classes, "near-classes")
    found = links(docs, classes, id_col, text_col, similarity)
    member = classes.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "best")
    chosen = member.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.th")
    return only_chosen(docs, rows, durable(chosen, "near-chosen"), id_col, text_col)
