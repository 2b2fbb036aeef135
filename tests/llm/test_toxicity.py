import math
import random
import zlib

from tests.llm.cases import frame, words

from tideline.llm import queries, toxicity

BAD = ("vileword", "nastyword", "rudeword")


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = words(rng, rng.randrange(20, 200))
        toxic = i % 7 == 0
        low = i % 5 == 0
        if toxic:
            at = text.split()
            for _ in range(2):
                at.insert(rng.randrange(len(at)), rng.choice(BAD))
            text = " ".join(at)
        if low:
            text = text.upper() + "!!!!!"
        docs.append((i, text, "en", "s", 1))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_chain_learns_both_categories_and_scores_all_rows(spark):
    docs, labels = corpus()
    known = spark.createDataFrame(labels[:600] + [(601, None, 1), (3, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows = docs + [(5000, None, None, None, None), (5001, "", None, None, None), (None, "vileword " * 3000, None, None, None), docs[7], docs[7]]
    table = frame(spark, rows, clashes=True)
    chain = toxicity.fit(table, known, toxicity.CATEGORIES, sample=500)
    assert chain.names == ["low_quality", "toxic"]
    assert len(chain.links[1].dense_weights) == toxicity.N_SURFACE + 1
    got = toxicity.score(table, chain).collect()
    assert len(got) == len(rows)
    truth = {d[0]: y[2] for d, y in zip(docs, labels)}
    held = [r for r in got if r["doc_id"] is not None and 600 <= r["doc_id"] < 900]
    assert sum(r["rejected"] == bool(truth[r["doc_id"]]) for r in held) / len(held) > 0.97
    assert all(not r["rejected"] for r in got if r["doc_id"] in (5000, 5001))
    kept = toxicity.drop_toxic(table, chain)
    assert kept.columns == table.columns
    assert kept.count() == sum(not r["rejected"] for r in got)


def test_out_of_fold_features_and_no_labels(spark):
    docs, labels = corpus(60)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(frame(spark, docs), none, toxicity.CATEGORIES)
    assert all(not r["rejected"] or r["p_toxic"] >= 0.5 for r in toxicity.score(frame(spark, docs), chain).collect())
    assert toxicity.score(frame(spark, []), chain).count() == 0


def plain_scores(chain, text):
    """The chain from its stored weights, word by word."""
    raw = (text or "").encode()
    words = set("".join(chr(b) if b >= 128 or chr(b).isalpha() else " " for b in raw.lower()).encode("latin-1").split())
    for size in (4, 5, 6):
        words |= {w[:size] + b"~" for w in words if len(w) >= size and not w.endswith(b"~")}
    ids = {zlib.crc32(w) for w in words}
    n = len(raw)
    dense = [sum(65 <= b <= 90 for b in raw) / n, sum(33 <= b < 127 and not chr(b).isalnum() for b in raw) / n, 0.0] if n else [0.0, 0.0, 1.0]
    out = []
    for link in chain.links:
        z = link.bias + sum(w for i, w in zip(link.words.tolist(), link.weights.tolist()) if i in ids)
        z += sum(w * x for w, x in zip(link.dense_weights.tolist(), [*dense, *out]))
        out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return out


def test_query_matches_a_plain_version(spark, tmp_path):
    docs, labels = corpus(500)
    docs += [(5000, None, None, None, None), (5001, "", None, None, None), (None, "vileword " * 3000, None, None, None), docs[7], docs[7]]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((str(r["doc_id"]), r["p_low_quality"], r["p_toxic"], r["rejected"]) for r in queries.op5_toxicity(spark, str(tmp_path)).collect())
    chain = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), toxicity.CATEGORIES)
    want = sorted((str(d[0]), *plain_scores(chain, d[1])) for d in docs)
    assert len(got) == len(want)
    for ours, plain in zip(got, want):
        assert ours[0] == plain[0] and abs(ours[1] - plain[1]) < 1e-9 and abs(ours[2] - plain[2]) < 1e-9 and ours[3] == (plain[2] >= 0.5)
    assert 40 < sum(r[3] for r in got) < 120
