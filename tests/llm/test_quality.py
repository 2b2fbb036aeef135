import random
import zlib

import numpy as np
from tests.llm.cases import frame, words

from tideline.llm import quality


def corpus(n=700, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = words(rng, rng.randrange(20, 160))
        good = i % 4 != 0
        if not good:
            text = " | ".join(text.split()) if i % 8 else "!! ".join(text.upper().split())
        docs.append((i, text, "en", "s", 1))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_rows(spark):
    docs, labels = corpus()
    extra = [(5000, None, None, None, None), (5001, "", None, None, None), (None, "x " * 40000, None, None, None), docs[3], docs[3]]
    table = frame(spark, docs + extra, clashes=True)
    model = quality.fit(table, spark.createDataFrame(labels + [(9, None, 0)], "doc_id long, quality int, toxic int"), sample=400)
    got = quality.score(table, model).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {r[0]: r[1] for r in labels}
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert len(held) > 150 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[5000] == by_id[5001]
    assert quality.score(frame(spark, []), model).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs, labels = corpus(200)
    table = frame(spark, docs)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a = quality.fit(table, spark.createDataFrame(labels, schema))
    b = quality.fit(table, spark.createDataFrame(flipped, schema))
    assert np.array_equal(a.vectors, b.vectors) and np.array_equal(a.bias, b.bias)


def test_share_of_buckets_equals_the_softmax_over_averaged_vectors():
    rng = random.Random(1)
    texts = [words(rng, 30) for _ in range(40)]
    bags = []
    for t in texts:
        c = quality.bag(t.encode())
        at = np.flatnonzero(c)
        bags.append((at, (c[at] / c.sum()).astype(np.float32)))
    model = quality.train(bags, np.arange(40) % 2, epochs=3)
    for t, (at, w) in zip(texts, bags):
        z = (w @ model.vectors[at]) @ model.output + model.bias
        p = np.exp(z[1]) / np.exp(z).sum()
        assert abs(p - model.score(t.encode())) < 1e-4


def test_buckets_are_those_of_a_plain_loop():
    text = "ab  cde\tfghij é x".encode()
    n = sum(len(p) for p in quality.buckets(text))
    padded = b" " + text.replace(b"\t", b" ") + b" "
    grams = [padded[i:i + k] for k in (3, 4, 5) for i in range(len(padded) - k + 1) if b" " not in padded[i + 1:i + k - 1]]
    assert n == len(grams) + len(text.split())
    a = np.concatenate(list(quality.buckets(b"same words here")))
    b = np.concatenate(list(quality.buckets(b" same\nwords  here ")))
    assert sorted(a) == sorted(np.concatenate(list(quality.buckets(b"same words here")))) and set(a) <= set(b)


def test_a_repeated_word_counts_once_for_each_of_its_bytes():
    once, thrice = (list(quality.buckets(t)) for t in (b"word other", b"word word word other other"))
    repeat = quality._mix(quality._REPEAT, 16)[0]
    assert sum((p == repeat).sum() for p in once) == 0
    assert sum((p == repeat).sum() for p in thrice) == 2 * len(b"word") + len(b"other")
