"""Quality classifier: learned vectors of hashed words and character n-grams, averaged, under a softmax."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import ship_package

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[9, 10, 11, 12, 13, 32]] = True
_PLACES = np.random.default_rng(17).integers(1, 2**32, size=64, dtype=np.uint64).astype(np.uint32) | 1

_REPEAT = np.array([0x52455045], dtype=np.uint32)


def _mix(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - bits)


def buckets(raw: bytes, bits: int = 16, sizes: tuple[int, ...] = (3, 4, 5)):
    """Yield arrays of bucket numbers: the n-grams of each size inside words, word borders as blanks, then the words, and a
    fixed one for every byte of a word that is the same as the one before it."""
    b = np.frombuffer(b" " + raw + b" ", dtype=np.uint8)
    gap = _BREAKS[b]
    b = np.where(gap, np.uint8(32), b).astype(np.uint32) + np.uint32(1)
    inner = np.concatenate([[0], np.cumsum(gap)])  # breaks before each position
    h = b
    for n in range(2, max(sizes) + 1):
        if len(b) < n:
            return
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1:]
        if n in sizes:
            m = len(b) - n + 1
            whole = inner[n - 1: n - 1 + m] - inner[1: 1 + m] == 0  # no break strictly inside
            yield _mix(h[whole] + np.uint32(n), bits)
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, stops = edges[::2], edges[1::2]
    if len(starts):
        at = np.arange(len(b)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(b)]])))
        value = np.where(gap, np.uint32(0), b * _PLACES[at & 63])
        words = np.add.reduceat(value, starts, dtype=np.uint32) + (stops - starts).astype(np.uint32)
        yield _mix(words, bits)
        again = int((stops - starts)[1:][words[1:] == words[:-1]].sum())
        if again:
            yield np.full(again, _mix(_REPEAT, bits)[0])


def bag(raw: bytes, bits: int = 16) -> np.ndarray:
    """Occurrences of every bucket in a whole text."""
    counts = np.zeros(1 << bits, dtype=np.int64)
    for part in buckets(raw, bits):
        counts += np.bincount(part, minlength=1 << bits)
    return counts


@dataclass
class Embeddings:
    """``vectors`` of the buckets, and the softmax layer above their average."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    bits: int = 16

    def __post_init__(self):
        # the score is linear in the average: each bucket's share of (logit of 1) - (logit of 0), for fast scoring
        self.share = (self.vectors @ (self.output[:, 1] - self.output[:, 0])).astype(np.float32)

    def score(self, raw: bytes | None) -> float:
        total, n = 0.0, 0
        for part in buckets(raw or b"", self.bits):
            total += float(self.share[part].sum(dtype=np.float64))
            n += len(part)
        z = (total / n if n else 0.0) + float(self.bias[1] - self.bias[0])
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, bits: int = 16, dim: int = 10, epochs: int = 12,
          rate: float = 0.1, seed: int = 3) -> Embeddings:
    """Stochastic gradient descent, one document a step, with step sizes that shrink where gradients were large."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, size=(1 << bits, dim)).astype(np.float32)
    output, bias = np.zeros((dim, 2), dtype=np.float64), np.zeros(2)
    past_v, past_o, past_b = np.full(1 << bits, 1e-8, dtype=np.float32), np.full((dim, 2), 1e-8), np.full(2, 1e-8)
    output += rng.normal(0, 0.1, size=output.shape)
    y = np.asarray(labels, dtype=np.int64)
    share = np.bincount(y, minlength=2) / max(len(y), 1)
    cost = 0.5 / np.maximum(share, 1e-3)  # both classes weigh the same in sum
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            where, weight = bags[i]
            hidden = weight @ vectors[where] if len(where) else np.zeros(dim)
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = p * cost[y[i]]
            g[y[i]] -= cost[y[i]]
            back = output @ g
            step = np.outer(hidden, g)
            past_o += step * step
            output -= rate * step / np.sqrt(past_o)
            past_b += g * g
            bias -= rate * g / np.sqrt(past_b)
            if len(where):
                size = (weight * np.linalg.norm(back)).astype(np.float32)
                past_v[where] += size * size
                vectors[where] -= (rate * weight / np.sqrt(past_v[where]))[:, None].astype(np.float32) * back.astype(np.float32)
    return Embeddings(vectors, output, bias, bits)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, bits: int = 16, id_col: str = "doc_id",
        text_col: str = "text", **options) -> Embeddings:
    """Train on at most ``sample`` labelled documents that aren't held out, those whose hashed ids are smallest.

    An id with null or contradicting labels is left out.
    """
    ship_package(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y"))
    known = known.dropna().where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("m"))
    chosen = known.where("_y = m").select("_id", "_y").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    picked = chosen.collect()  # bounded by `sample`
    small = docs.sparkSession.createDataFrame(picked, chosen.schema) if picked else chosen.limit(0)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(small), "_id").select("_id", "_y", "text")

    def run(batches):
        for batch in batches:
            where, weight = [], []
            for t in batch.column(2).cast(pa.binary()):
                counts = bag(t.as_py() or b"", bits)
                at = np.flatnonzero(counts)
                where.append(at.astype(np.uint32).tobytes())
                weight.append((counts[at] / max(counts.sum(), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(where, pa.binary()),
                                              pa.array(weight, pa.binary())], names=["_id", "_y", "at", "weight"])

    got = rows.mapInArrow(run, "_id long, _y int, at binary, weight binary").collect()  # a bounded sample, 2**bits buckets
    got = sorted(got, key=lambda r: (r["_id"], bytes(r["at"])))
    bags = [(np.frombuffer(bytes(r["at"]), np.uint32), np.frombuffer(bytes(r["weight"]), np.float32)) for r in got]
    return train(bags, np.array([r["_y"] for r in got], dtype=np.int64), bits, **options)


def score(docs: DataFrame, model: Embeddings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted``: the chance of label 1 from the whole text alone.

    A null or empty text gets the model's bias as its score.  Every row is scored, repeated rows too; ids may be
    null (then ``held_out`` is false); extra columns are ignored; an empty table gives no rows.
    """

    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
