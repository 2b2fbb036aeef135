"""Approximate nearest neighbours: balanced posting lists with replicated boundaries under a graph of centroids."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm._shared import durable


@dataclass
class Lists:
    """Centroids of the posting lists (at most ``max_lists`` of them, whatever the table) and their neighbour graph."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    norm: float  # the largest norm of the table

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """To a space where the largest inner product is the smallest distance: one more coordinate fills norms up."""
        n2 = (x * x).sum(axis=1)
        if query:  # the length of a query doesn't change the order
            return np.hstack([x * (self.norm / np.sqrt(np.maximum(n2, 1e-300)))[:, None], np.zeros((len(x), 1))]).astype(np.float32)
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - n2, 0))[:, None]]).astype(np.float32)

    def nearest(self, q: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found by best-first search in the graph, with squared distances."""
        c, n = self.centroids, len(self.centroids)
        width = min(width, n)
        m = len(q)
        rows = np.arange(m)[:, None]
        c2, q2 = (c * c).sum(axis=1), (q * q).sum(axis=1)[:, None]
        seen = np.zeros((m, n), dtype=bool)
        ids = np.tile(self.entries, (m, 1))
        seen[:, self.entries] = True
        dist = q2 - 2 * q @ c[self.entries].T + c2[self.entries]
        todo = np.ones_like(ids, dtype=bool)
        while True:
            rank = np.where(todo, dist, np.inf)
            k = min(at_once, rank.shape[1])
            pick = np.argpartition(rank, k - 1, axis=1)[:, :k]
            live = np.isfinite(np.take_along_axis(rank, pick, 1))
            if not live.any():
                break
            todo[rows, pick] = False
            near = self.graph[np.take_along_axis(ids, pick, 1)].reshape(m, -1)
            new = np.repeat(live, self.graph.shape[1], axis=1) & ~seen[rows, near]
            seen[rows, near] |= new
            d = q2 - 2 * np.einsum("md,mkd->mk", q, c[near]) + c2[near]
            d = np.where(new, d, np.inf)
            # a centroid met twice in one step counts once
            order = np.argsort(near, axis=1, kind="stable")
            sorted_near = np.take_along_axis(near, order, 1)
            twice = np.zeros_like(new)
            np.put_along_axis(twice, order[:, 1:], (sorted_near[:, 1:] == sorted_near[:, :-1]) & np.take_along_axis(new, order[:, :-1], 1), 1)
            d = np.where(twice, np.inf, d)
            ids, dist = np.hstack([ids, near]), np.hstack([dist, d])
            todo = np.hstack([todo, np.isfinite(d)])
            if dist.shape[1] > width:
                best = np.argpartition(dist, width - 1, axis=1)[:, :width]
                ids, dist, todo = (np.take_along_axis(x, best, 1) for x in (ids, dist, todo))
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(dist, order, 1), 0)

    def lists_of_vectors(self, x: np.ndarray, replicas: int, slack: float):
        """The lists of each vector: the nearest, and others hardly further unless a chosen one is nearer to them."""
        ids, d2 = self.nearest(self.lift(x, False), max(4 * replicas, 16))
        d = np.sqrt(d2)
        keep = np.zeros(ids.shape, dtype=bool)
        keep[:, 0] = True
        for j in range(1, ids.shape[1]):
            ok = (d[:, j] <= (1 + slack) * d[:, 0] + 1e-12) & (keep.sum(axis=1) < replicas) & np.isfinite(d[:, j])
            for i in range(j):
                gap = self.centroids[ids[:, i]] - self.centroids[ids[:, j]]
                ok &= ~(keep[:, i] & ((gap * gap).sum(axis=1) < 0.5 * d2[:, j]))
            keep[:, j] = ok
        return ids, keep

    def lists_of_queries(self, q: np.ndarray, probes: int, ratio: float, least: int):
        """The lists to search: those within ``1 + ratio`` times the distance of the nearest, ``least`` in any case.

        The graph gives ``probes`` of them; where even the furthest of these is within the ratio, all centroids are measured.
        """
        x, n = self.lift(q, True), len(self.centroids)
        ids, d2 = self.nearest(x, probes)
        d = np.sqrt(d2)
        wide = (d[:, -1] <= (1 + ratio) * d[:, 0] + 1e-12) & (ids.shape[1] < n)
        if wide.any():
            c, y = self.centroids, x[wide]
            every = np.sqrt(np.maximum((y * y).sum(axis=1)[:, None] - 2 * y @ c.T + (c * c).sum(axis=1), 0))
            order = np.argsort(every, axis=1, kind="stable")
            gap = n - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, gap)))
            d = np.pad(d, ((0, 0), (0, gap)), constant_values=np.inf)
            ids[wide], d[wide] = order, np.take_along_axis(every, order, 1)
        keep = (d <= (1 + ratio) * d[:, :1] + 1e-12) & np.isfinite(d)
        keep[:, :least] |= np.isfinite(d[:, :least])
        return ids, keep


def build_lists(sample: np.ndarray, n_lists: int, norm: float, degree: int = 16, seed: int = 5) -> Lists:
    """Balanced clustering: halve the largest cluster at the median between its two means, then refine the means."""
    rng = np.random.default_rng(seed)
    lists = Lists(np.zeros((1, 1), np.float32), np.zeros((1, 1), np.int64), np.zeros(1, np.int64), norm)
    x = lists.lift(sample, False)
    parts = [np.arange(len(x))]
    while len(parts) < min(n_lists, len(x)):
        parts.sort(key=len)
        part = parts.pop()
        y = x[part]
        a, b = y[rng.integers(len(y))], y[rng.integers(len(y))]
        for _ in range(4):
            side = ((y - a) ** 2).sum(axis=1) < ((y - b) ** 2).sum(axis=1)
            if side.all() or not side.any():
                break
            a, b = y[side].mean(axis=0), y[~side].mean(axis=0)
        order = np.argsort(y @ (a - b), kind="stable")
        parts += [part[order[:len(part) // 2]], part[order[len(part) // 2:]]]
    c = np.array([x[p].mean(axis=0) for p in parts if len(p)], dtype=np.float32)
    for _ in range(3):
        owner = np.concatenate([((c * c).sum(axis=1) - 2 * x[i:i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)])
        count = np.bincount(owner, minlength=len(c))
        total = np.zeros(c.shape, dtype=np.float64)
        np.add.at(total, owner, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c).astype(np.float32)
    n = len(c)
    k = min(degree, n)
    graph = np.zeros((n, k + 4), dtype=np.int64)
    c2 = (c * c).sum(axis=1)
    for i in range(0, n, 1024):
        d = c2 - 2 * c[i:i + 1024] @ c.T
        graph[i:i + 1024, :k] = np.argpartition(d, k - 1, axis=1)[:, :k]
    ring = rng.permutation(n)  # every centroid can be reached over a ring, near ones and chance links make it short
    graph[ring, k] = np.roll(ring, 1)
    graph[:, k + 1:] = rng.integers(0, n, size=(n, 3))
    lists.centroids, lists.graph = c, graph
    lists.entries = np.unique(rng.choice(n, size=min(n, 16), replace=False))
    return lists


def fitted_ratio(lists: Lists, sample: np.ndarray, k: int, replicas: int, slack: float, recall: float,
                 least: int, queries: int = 256) -> float:
    """The distance ratio under which ``recall`` of the sample's own neighbours lie in a list that is searched.

    For up to ``queries`` vectors of the sample and their ``k`` nearest in it: how much further than the nearest list
    is the nearest of the lists that hold the neighbour.  Of a sample, ``k`` is that share of the wanted neighbours.
    """
    if len(sample) < 2:
        return 0.0
    at = np.unique(np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int))
    near = sample[at] @ sample.T
    near[np.arange(len(at)), at] = -np.inf
    k = min(k, len(sample) - 1)
    near = np.argpartition(-near, k - 1, axis=1)[:, :k]
    found, where = np.unique(near, return_inverse=True)
    where = where.reshape(near.shape)
    parts = [lists.lists_of_vectors(sample[found[i:i + 512]], replicas, slack) for i in range(0, len(found), 512)]
    ids, keep = (np.concatenate(x) for x in zip(*parts))
    x, c = lists.lift(sample[at], True), lists.centroids
    d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0))
    best = np.maximum(d.min(axis=1), 1e-12)
    d[d <= np.sort(d, axis=1)[:, min(least, d.shape[1]) - 1:][:, :1]] = 0  # searched in any case
    far = np.array([np.where(keep[where[i]], d[i][ids[where[i]]], np.inf).min(axis=1) / best[i] for i in range(len(at))])
    return max(0.0, float(np.quantile(far, recall)) - 1)


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in doubles, summed from the first component to the last: the same wherever computed."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """``(v, ids)``: each different vector once, with the smallest ``keep`` of its ids (as bytes of longs).

    Batches send at most ``keep`` ids of a vector on, twice, so the copies of one vector never meet in a task.
    """

    def first(batches):
        for batch in batches:
            out: dict[bytes, list] = {}
            flat = np.asarray(batch.column(1).flatten()) + 0.0
            dim = len(flat) // max(batch.num_rows, 1)
            ids = np.asarray(batch.column(0))
            for i in np.argsort(ids, kind="stable").tolist():
                got = out.setdefault(flat[i * dim:(i + 1) * dim].tobytes(), [])
                if len(got) < keep:
                    got.append(int(ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.list_(pa.int64()))], names=["v", "ids"])

    least = lambda: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    some = rows.mapInArrow(first, "v binary, ids array<long>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
    return some.groupBy("v", "part").agg(least()).groupBy("v").agg(least())


def _bundles(held: dict[int, int], n_lists: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each list, and the row blocks of each bundle: lists in a row up to ``block`` vectors together, a
    longer list alone in several blocks."""
    of, blocks, room = np.zeros(n_lists, dtype=np.int64), [], 0
    for i in range(n_lists):
        n = held.get(i, 0)
        if not blocks or n > room:
            blocks.append(max(-(-n // block), 1))
            room = max(block - n, 0) if n <= block else 0
        else:
            room -= n
        of[i] = len(blocks) - 1
    return of, np.array(blocks)


def search(vectors: DataFrame, k: int = 20, every: int = 20, per_list: int = 96, max_lists: int = 2048, per_sample: int = 32,
           replicas: int = 6, slack: float = 0.25, probes: int = 64, ratio: float | None = None, recall: float = 0.96, least: int = 16,
           block: int = 8192, query_block: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest by inner product of each row whose id is divisible by ``every``, found among all rows.

    Returns ``query_id, rank, vec_id, score``; ties go to the smaller id; a query never finds itself.  Centroids are
    fitted on at most ``per_sample * max_lists`` vectors; every vector is in a list.  Equal vectors are searched and
    stored once.  Lists are searched in bundles of about ``block`` vectors, a longer list in several blocks; with the
    queries, in blocks of ``query_block``, each is a group of its own, so neither a large list nor a popular one is
    gathered whole, and a query sends on ``k`` vectors a bundle.  Vectors that are null, zero, of a
    length other than the table's most frequent one, or hold null or non-finite components take no part, nor do
    rows without id.  Repeated rows count once; rows that share an id are that id's own, so none is found by it, and
    each of their vectors is a query.  Extra columns are ignored.  An empty table gives no rows.

    Without ``ratio``, it is the one that :func:`fitted_ratio` finds for ``recall`` on the sample, so the share of
    lists that is searched follows from how far the vectors form clusters (figures in the README).
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = _usable(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], result)
    dim = sizes["dim"]
    rows = rows.where(F.size("v") == dim)
    classes = durable(_classes(rows, k + 1).withColumn("rep", F.xxhash64("v")), "ann-classes")
    norm2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    n = classes.count()
    n_lists = int(min(max(n // per_list, 1), max_lists))
    picked = classes.select("rep", "v").orderBy(F.xxhash64("rep"), "v").limit(per_sample * n_lists).select("v").collect()
    sample = np.frombuffer(b"".join(bytes(r[0]) for r in picked), dtype=np.float64).reshape(-1, dim)
    lists = build_lists(sample, n_lists, float(np.sqrt(norm2)))
    if ratio is None:
        ratio = fitted_ratio(lists, sample, -(-k * len(sample) // n), replicas, slack, recall, least)
    shared = spark.sparkContext.broadcast(vars(lists))  # bounded by max_lists

    def into_lists(batches):
        known = Lists(**shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids, keep = known.lists_of_vectors(_matrix(part.column(1), dim), replicas, slack)
                at, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at, j], pa.int64()), *[part.column(c).take(pa.array(at)) for c in (1, 2)]],
                                                 names=["list", "v", "ids"])

    posts = durable(classes.select("rep", "v", "ids").mapInArrow(into_lists, "list long, v binary, ids array<long>"), "ann-lists")
    held = {r["list"]: r["n"] for r in posts.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most max_lists
    of, blocks = _bundles(held, len(lists.centroids), block)

    def ask(batches):
        known = Lists(**shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                ids, keep = known.lists_of_queries(_matrix(part.column(1), dim), probes, ratio, least)
                at, j = np.nonzero(keep)
                chosen = ids[at, j]
                order = np.lexsort((chosen, of[chosen], at))
                at, chosen = at[order], chosen[order]
                bundle = of[chosen]
                first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (bundle[1:] != bundle[:-1])])
                asked_lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)], pa.int32()), pa.array(chosen, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bundle[first], pa.int64()), asked_lists, *[part.column(c).take(pa.array(at[first])) for c in (0, 1)]],
                    names=["bundle", "lists", "rep", "v"])

    asked = durable(_queries(rows, every), "ann-queries")
    wanted = asked.select("rep", "v").dropDuplicates(["rep"])
    asks = durable(wanted.mapInArrow(ask, "bundle long, lists array<long>, rep long, v binary"), "ann-probes")
    popular = {r["bundle"]: r["n"] for r in asks.groupBy("bundle").agg(F.count("*").alias("n")).collect()}  # at most max_lists
    cells = F.broadcast(spark.createDataFrame(
        [(i, int(g), int(blocks[g]), -(-popular[g] // query_block)) for i, g in enumerate(of.tolist()) if g in popular],
        "list long, bundle long, nb int, nq int"))
    one_of = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(F.broadcast(cells.drop("list").distinct()), "bundle").withColumn("i", one_of("nq", "rep", F.lit(1))).select(
        "bundle", "i", all_of("nb").alias("j"), "lists", "rep", "v")
    right = posts.join(cells, "list").withColumn("j", one_of("nb", "v", F.lit(2))).select(
        "bundle", all_of("nq").alias("i"), "j", "list", "v", "ids")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out = ([], [], [])
        if a.num_rows and b.num_rows:
            b = b.sort_by("list")
            q, x = _matrix(a.column("v"), dim), _matrix(b.column("v"), dim)
            ids, reps = b.column("ids").to_pylist(), a.column("rep").to_pylist()
            names, starts = np.unique(b.column("list").to_numpy(), return_index=True)
            stops = np.r_[starts[1:], len(x)]
            wants = np.zeros((len(q), len(names)), dtype=bool)
            who = np.repeat(np.arange(len(q)), [len(w) for w in a.column("lists").to_pylist()])
            what = np.concatenate([np.asarray(w, dtype=np.int64) for w in a.column("lists").to_pylist()])
            known = np.isin(what, names)
            wants[who[known], np.searchsorted(names, what[known])] = True
            top = (k + 4) * replicas  # a vector can be in so many lists of the bundle
            for low in range(0, len(q), 256):
                part = q[low:low + 256]
                near = np.full((len(part), top), -np.inf)
                where = np.full((len(part), top), -1)
                for n, (lo, hi) in enumerate(zip(starts, stops)):
                    rows_of = np.flatnonzero(wants[low:low + 256, n])
                    if not len(rows_of):
                        continue
                    rough = part[rows_of] @ x[lo:hi].T
                    m = min(k + 4, hi - lo)
                    best = np.argpartition(-rough, m - 1, axis=1)[:, :m]
                    score = np.hstack([near[rows_of], np.take_along_axis(rough, best, 1)])
                    place = np.hstack([where[rows_of], best + lo])
                    stay = np.argpartition(-score, top - 1, axis=1)[:, :top]
                    near[rows_of], where[rows_of] = np.take_along_axis(score, stay, 1), np.take_along_axis(place, stay, 1)
                exact = exact_scores(np.repeat(part, top, axis=0), x[where.reshape(-1)]).reshape(-1, top)
                for i in range(len(part)):
                    found = sorted({(-s, v) for s, c in zip(exact[i].tolist(), where[i].tolist()) if c >= 0 for v in ids[c]})[:k + 1]
                    out[0].extend([reps[low + i]] * len(found))
                    out[1].extend(v for _, v in found)
                    out[2].extend(-s for s, _ in found)
        return pa.table({"rep": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["bundle", "i", "j"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "rep long, vec_id long, score double")
    ranked = met.groupBy("rep", "vec_id").agg(F.max("score").alias("score")).groupBy("rep").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("best"))
    ranked = durable(ranked, "ann-ranked")
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = asked.select(F.col("vec_id").alias("query_id"), "rep").distinct().join(ranked, "rep").select("query_id", F.posexplode(own).alias("p", "b"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score"))


def _queries(rows: DataFrame, every: int) -> DataFrame:
    """The query rows with their vectors as bytes and the class key."""

    def run(batches):
        for batch in batches:
            flat = np.asarray(batch.column(1).flatten()) + 0.0
            dim = len(flat) // max(batch.num_rows, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([flat[i * dim:(i + 1) * dim].tobytes() for i in range(batch.num_rows)], pa.binary())], names=["vec_id", "v"])

    picked = rows.where(F.col("vec_id") % every == 0).mapInArrow(run, "vec_id long, v binary")
    return picked.withColumn("rep", F.xxhash64("v"))
