import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(np.array(ids) % every == 0):
        s = ann.exact_scores(np.repeat(x[i:i + 1], len(x), 0), x)
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out[ids[i]] = [(v, -d) for d, v in order]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hit = sum(len({v for v, _ in w} & {v for v, _ in found.get(q, {}).values()}) for q, w in want.items())
    return hit / sum(map(len, want.values())), found


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_exact_scores(spark, scaled):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    if scaled:
        x *= rng.uniform(0.5, 2, size=(3000, 1)).astype(np.float32)
    x[500:1500] = x[500]  # a third of the rows share a vector
    ids = list(range(3000))
    docs = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    want = brute(ids, x.astype(np.float64))
    share, found = recall(ann.search(docs, per_list=40, block=64).collect(), want)
    assert share >= 0.9
    for q, rows in found.items():
        assert sorted(rows) == list(range(1, 21))
        listed = [rows[r] for r in sorted(rows)]
        assert listed == sorted(listed, key=lambda p: (-p[1], p[0])) and q not in [v for v, _ in listed]
        assert all(s == ann.exact_scores(x[q:q + 1].astype(float), x[v:v + 1].astype(float))[0] for v, s in listed)
    copies = [v for v, _ in (found[500][r] for r in range(1, 21)) if 500 < v < 1500]
    assert len(copies) > 5 and copies == list(range(501, 501 + len(copies)))


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (20, [inf, 1.0], 1),
            (40, [None, 1.0], 1), (60, [1.0], 1), (None, [1.0, 1.0], 1), (80, [-1.0, 2.0], None), (80, [-1.0, 2.0], None), (5, [], 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("rep", "v", "list", "ids", "score", "rank")})
    got = sorted(map(tuple, ann.search(docs).collect()))
    assert got == [(0, 1, 1, 0.5), (0, 2, 80, -1.0), (80, 1, 1, 0.5), (80, 2, 0, -1.0)]


def test_empty_table(spark):
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 8))
    lists = ann.build_lists(x, 200, float(np.sqrt((x * x).sum(axis=1).max())))
    q = lists.lift(x[:300], False)
    ids, _ = lists.nearest(q, 16)
    true = ((q[:, None, :] - lists.centroids[None]) ** 2).sum(axis=2).argsort(axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(true.tolist(), ids.tolist())]) > 0.97
    sizes = np.bincount(lists.nearest(lists.lift(x, False), 4)[0][:, 0], minlength=200)
    assert sizes.max() <= 5 * sizes.mean()


def test_recall_holds_without_clusters_and_with_more_lists_than_probes(spark):
    x = np.random.default_rng(2).normal(size=(4000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    docs = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    want = brute(list(range(4000)), x.astype(np.float64))
    got = ann.search(docs, per_list=20, probes=16, least=4, block=300, query_block=50).collect()
    assert recall(got, want)[0] >= 0.9 and len(got) == sum(map(len, want.values()))


def test_bundles_keep_every_list_and_cut_long_ones():
    of, blocks = ann._bundles({0: 5, 1: 4, 2: 30, 4: 3}, 5, 10)
    assert of.tolist() == [0, 0, 1, 1, 2] and blocks.tolist() == [1, 3, 1]
