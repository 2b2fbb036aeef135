import os
import random

import pytest
from pyspark.sql import functions as F
from tests.llm.cases import awkward, frame

from tideline.llm import mixing


def cells(spark, seed=1):
    rng = random.Random(seed)
    rows = [(f"s{i % 7}", f"l{i % 3}", f"t{i % 4}", rng.randrange(1, 9000)) for i in range(84)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def test_marginals_reach_given_targets(spark):
    targets = {"source": {f"s{i}": i + 1 for i in range(7)}, "lang": {"l0": 5, "l1": 3, "l2": 2}, "topic": 0.5}
    out = mixing.rake(cells(spark), targets, rounds=40)
    total = out.agg(F.sum("weight")).first()[0]
    for dim, value, share in (("source", "s6", 7 / 28), ("lang", "l0", 0.5), ("lang", "l2", 0.2)):
        got = out.where(F.col(dim) == value).agg(F.sum("weight")).first()[0] / total
        assert abs(got - share) < 1e-3


def test_driver_and_dataframe_rounds_agree(spark):
    targets = {"source": {"s0": 1, "s3": 2}, "lang": 0.3, "topic": {}}
    for t in (targets, dict.fromkeys(mixing.DIMENSIONS, 0.5)):
        a = {r[:3]: r[4] for r in map(tuple, mixing.rake(cells(spark), t, 4).collect())}
        b = {r[:3]: r[4] for r in map(tuple, mixing.rake(cells(spark), t, 4, driver_cells=0).collect())}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-6 * max(1, a[k]) for k in a)


def test_every_row_gets_a_probability_and_sampling_follows_it(spark):
    docs = frame(spark, clashes=True)
    rows = mixing.calibrated(docs).collect()
    assert len(rows) == len(awkward()) and all(0 <= r["_p"] <= 1 for r in rows)
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["_kept"] for r in rows)
    assert mixing.sample(frame(spark, [])).count() == 0


def test_sampled_share_is_near_the_probability(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"),
                                    F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"), F.lit("en").alias("lang"))
    hot = mixing.calibrated(docs).where("source = 'hot'").agg(F.avg("_p"), F.avg(F.col("_kept").cast("int"))).first()
    assert hot[0] < 0.6 and abs(hot[0] - hot[1]) < 0.05


def marginals(rows, dim):
    sums = {}
    for r in rows:
        sums[r[dim]] = sums.get(r[dim], 0.0) + r["tokens"] * r["p"]
    return {k: v / sum(sums.values()) for k, v in sums.items()}


def test_bounded_fit_meets_targets_within_reach_and_keeps_the_total(spark):
    rng = random.Random(3)
    # t0 is scarce: its target can't be met by sampling it whole
    rows = [(f"s{i % 7}", f"l{i % 3}", f"t{i % 4}", rng.randrange(20, 60) if i % 4 == 0 else rng.randrange(2000, 9000)) for i in range(84)]
    table = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": 0.5, "lang": {"l0": 0.38, "l1": 0.32, "l2": 0.3}, "topic": {"t0": 1, "t1": 3, "t2": 3, "t3": 3}}
    got = mixing.fit_probabilities(table, targets).collect()
    total = sum(r["tokens"] for r in got)
    assert all(0 <= r["p"] <= 1 for r in got) and all(r["p"] == 1 for r in got if r["topic"] == "t0")
    assert abs(sum(r["tokens"] * r["p"] for r in got) - 0.75 * total) < 1e-4 * total
    lang, topic = marginals(got, "lang"), marginals(got, "topic")
    assert abs(lang["l0"] - 0.38) < 1e-4 and abs(topic["t1"] - topic["t3"]) < 1e-4
    capped = [min(1.0, 0.75 * r["weight"] / r["tokens"]) * r["tokens"] for r in mixing.rake(table, targets).collect()]
    assert sum(capped) < 0.74 * total  # what the bound takes away without the fit


def test_bounded_driver_and_dataframe_rounds_agree(spark):
    for t in ({"source": {"s0": 1, "s3": 2}, "lang": 0.3, "topic": {}}, dict.fromkeys(mixing.DIMENSIONS, 0.5)):
        a = {r[:3]: r[4] for r in map(tuple, mixing.fit_probabilities(cells(spark), t, rounds=2).collect())}
        b = {r[:3]: r[4] for r in map(tuple, mixing.fit_probabilities(cells(spark), t, rounds=2, driver_cells=0).collect())}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-9 for k in a)


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_sample_meets_what_is_within_reach(spark):
    """Tokens that are really sampled, value by value, beside the goals."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    goals = {(r["dimension"], r["value"]): r for r in mixing.report(docs).collect()}
    rows = mixing.calibrated(docs)
    for d in mixing.DIMENSIONS:
        got = {r[0]: (r[1], r[2]) for r in rows.groupBy(f"_{d}").agg(
            F.sum(F.when(F.col("_kept"), F.col("_tokens"))), F.sum(F.col("_tokens") * F.col("_p"))).collect()}
        kept, expected = (sum(v[i] or 0 for v in got.values()) for i in range(2))
        for value, (n, e) in got.items():
            goal = goals[d, value]
            assert abs(goal["expected"] - e / expected) < 1e-6
            assert abs(goal["expected"] - goal["goal"]) < 0.01, (d, value)
            assert abs(n / kept - goal["goal"]) < 0.02  # and the noise of drawing whole documents
            if goal["within_reach"] and all(g["within_reach"] for k, g in goals.items() if k[0] == d):
                assert abs(goal["goal"] - goal["target"]) < 1e-9


def test_columns_called_like_added_ones(spark):
    docs = frame(spark).withColumns({c: F.lit("mine") for c in mixing.ADDED})
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns and {r["_p"] for r in kept.collect()} == {"mine"}
    assert kept.count() == mixing.sample(frame(spark)).count()
    assert mixing.calibrated(docs).where("_p <= 1").count() == docs.count()
