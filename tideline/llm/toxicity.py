"""Toxicity: a chain of sparse linear classifiers over whole texts."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import ship_package

#: ASCII bytes other than letters end a word; bytes of other scripts belong to it.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_UPPER = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
N_SURFACE = 3
STEMS = (4, 5, 6)


def word_ids(raw: bytes) -> np.ndarray:
    """Sorted CRC-32 values of the distinct lower-case words of a whole text and of their stems.

    A stem is the first 4, 5 or 6 bytes of a word, marked by ``~``, so endings don't hide a word.
    """
    words = set(raw.lower().translate(_WORD_BYTES).split())
    for size in STEMS:
        words |= {w[:size] + b"~" for w in words if len(w) >= size and w[-1] != 126}
    return np.unique(np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)))


def surface(raw: bytes) -> list[float]:
    """Shares of capitals and marks, and whether the text is empty."""
    n = len(raw)
    if not n:
        return [0.0, 0.0, 1.0]
    return [(n - len(raw.translate(None, _UPPER))) / n, (n - len(raw.translate(None, _MARKS))) / n, 0.0]


@dataclass
class Link:
    """One category of the chain: weights over its words, the surface features and all earlier categories."""

    name: str
    words: np.ndarray
    weights: np.ndarray
    dense_weights: np.ndarray
    bias: float
    held_out: dict = field(default_factory=dict)

    def score(self, ids: np.ndarray, dense: list[float]) -> float:
        at = np.searchsorted(self.words, ids)
        at[at == len(self.words)] = 0
        hit = at[self.words[at] == ids] if len(self.words) else at[:0]
        z = self.bias + float(self.weights[hit].sum()) + float(np.dot(self.dense_weights, dense))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


@dataclass
class Chain:
    links: list[Link]

    @property
    def names(self) -> list[str]:
        return [link.name for link in self.links]

    def predict(self, raw: bytes | None) -> list[float]:
        raw = raw or b""
        ids, dense, out = word_ids(raw), surface(raw), []
        for link in self.links:
            out.append(link.score(ids, [*dense, *out]))
        return out


def _select(bags: list[np.ndarray], y: np.ndarray, most: int, least_df: int) -> np.ndarray:
    """The words whose document frequency differs most between the classes, by the z-score of two proportions."""
    flat = np.concatenate(bags) if bags else np.zeros(0, np.uint32)
    labels = np.repeat(y, [len(b) for b in bags])
    words, where = np.unique(flat, return_inverse=True)
    df, pos = np.bincount(where, minlength=len(words)), np.bincount(where, weights=labels, minlength=len(words))
    n, p = len(y), y.mean() if len(y) else 0.0
    z = np.abs(pos - df * p) / np.sqrt(np.maximum(df * p * (1 - p) * (1 - df / max(n, 1)), 1e-9))
    keep = np.flatnonzero((df >= least_df) & (df < n) & (z >= 3.0))
    return np.sort(words[keep[np.argsort(-z[keep], kind="stable")[:most]]])


def _matrix(bags: list[np.ndarray], dense: np.ndarray, words: np.ndarray) -> np.ndarray:
    x = np.zeros((len(bags), len(words) + dense.shape[1]), dtype=np.float32)
    for i, bag in enumerate(bags):
        x[i, :len(words)] = np.isin(words, bag, assume_unique=True)
    x[:, len(words):] = dense
    return x


def _fit(x: np.ndarray, y: np.ndarray, n_words: int, l1: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated proximal gradient; the absolute penalty is on word weights only."""
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (n + 1)
        return np.zeros(d), float(np.log(p / (1 - p)))
    x = np.hstack([x, np.ones((n, 1), np.float32)])
    v = np.ones(d + 1) / np.sqrt(d + 1)
    for _ in range(20):
        v = x.T @ (x @ v)
        size = np.linalg.norm(v)
        v = v / size
    rate = 4.0 * n / (size * 1.02)
    penalty = np.zeros(d + 1)
    penalty[:n_words] = l1
    penalty[n_words:d] = l1 / 50
    w = z = np.zeros(d + 1)
    t = 1.0
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ z, -30, 30)))
        step = z - rate * (x.T @ (p - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0.0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:d], float(w[d])


def train_chain(bags: list[np.ndarray], surfaces: list[list[float]], labels: dict[str, np.ndarray], folds: int = 3,
                most_words: int = 256, least_df: int = 4, l1: float = 5e-4, steps: int = 400) -> Chain:
    """Fit the categories of ``labels`` in their order.

    A later category sees each earlier one's probability as given out-of-fold, by models of the other folds, so that it
    doesn't learn to trust scores the earlier model has memorised; the final models use all rows.
    """
    base = np.asarray(surfaces, dtype=np.float64).reshape(len(bags), N_SURFACE)
    fold = np.arange(len(bags)) % folds
    dense, links = base, []
    for name, y in labels.items():
        y = np.asarray(y, dtype=np.float64)
        oof = np.zeros(len(bags))
        for f in [*range(folds), None]:
            rows = np.flatnonzero(fold != f) if f is not None else np.arange(len(bags))
            some = [bags[i] for i in rows]
            words = _select(some, y[rows], most_words, least_df)
            w, bias = _fit(_matrix(some, dense[rows], words), y[rows], len(words), l1, steps)
            link = Link(name, words, w[:len(words)], w[len(words):], bias)
            if f is not None:
                for i in np.flatnonzero(fold == f):
                    oof[i] = link.score(bags[i], dense[i].tolist())
        link.held_out = {"accuracy": float(((oof >= 0.5) == (y > 0)).mean()) if len(y) else None}
        links.append(link)
        dense = np.hstack([dense, oof.reshape(-1, 1)])
    return Chain(links)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = 6000, id_col: str = "doc_id",
        text_col: str = "text", **options) -> Chain:
    """Train on at most ``sample`` labelled documents, those whose hashed ids are smallest.

    ``categories`` maps names, in chain order, to SQL expressions over ``labels``.  Labels null in a category or
    given twice for one id with different values are left out.
    """
    ship_package(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"),
                          *[F.expr(e).cast("int").alias(f"_y{i}") for i, e in enumerate(categories.values())])
    known = known.dropna().distinct()
    ys = [c for c in known.columns if c != "_id"]
    known = known.groupBy("_id").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in ys]).where("n = 1").drop("n")
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    spark = docs.sparkSession
    picked = chosen.collect()  # bounded by `sample`
    small = spark.createDataFrame(picked, chosen.schema) if picked else chosen.limit(0)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(small), "_id").select("_id", *ys, "text")

    def run(batches):
        for batch in batches:
            raw = [t.as_py() or b"" for t in batch.column(len(ys) + 1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(ys) + 1)],
                 pa.array([word_ids(t).tobytes() for t in raw], pa.binary()),
                 pa.array([surface(t) for t in raw], pa.list_(pa.float64()))],
                names=["_id", *ys, "bag", "surface"])

    schema = ", ".join(["_id long", *[f"{c} int" for c in ys], "bag binary", "surface array<double>"])
    got = sorted(rows.mapInArrow(run, schema).collect(), key=lambda r: (r["_id"], bytes(r["bag"])))
    bags = [np.frombuffer(bytes(r["bag"]), dtype=np.uint32) for r in got]
    return train_chain(bags, [list(r["surface"]) for r in got],
                       {name: np.array([r[y] for r in got]) for name, y in zip(categories, ys)}, **options)


#: The chain of the registered query: poor text first, then toxic text.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id``, one probability per category and ``rejected`` (the last category reaches ``threshold``).

    Null texts are scored as empty, very long ones whole; every row gets a score; repeated rows stay; ids may be null;
    extra columns are ignored; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    names = [f"p_{n}" for n in chain.names]

    def run(batches):
        for batch in batches:
            found = [chain.predict(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            columns = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, ", ".join(["doc_id long", *[f"{n} double" for n in names]]))
    return out.withColumn("rejected", F.col(names[-1]) >= threshold)


def drop_toxic(docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that the last category doesn't reject, with their columns as they were."""

    ship_package(docs.sparkSession)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([chain.predict(t.as_py())[-1] < threshold for t in texts.cast(pa.binary())], pa.bool_())

    return docs.where(clean(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
