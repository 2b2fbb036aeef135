"""The pipeline's stages against plain Python versions on a small corpus."""

import hashlib
import random

import corpus_pipeline
import numpy as np
from tests.llm.cases import frame, words
from tests.llm.test_simhash import expected
from tokenizers import Tokenizer

from tideline.llm import mixing, secrets, toxicity
from tideline.llm.queries import token_files


def corpus():
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(220):
        text = words(rng, rng.randrange(30, 160))
        toxic = i % 8 == 0
        if toxic:
            at = text.split()
            at.insert(5, "vileword")
            at.insert(9, "nastyword")
            text = " ".join(at)
        if i % 9 == 1:
            text += " token = abcdefghij0123456789 end"
        rows.append((i, text, "en" if i % 3 else "fr", "hot" if i % 3 == 0 else f"s{i % 5}", len(text)))
        labels.append((i, int(i % 5 != 0), int(toxic)))
    rows += [(300 + i, rows[3][1], "en", "hot", 1) for i in range(5)] + [(400, None, None, None, None), (401, "", "en", "s1", 0)]
    return rows, labels


def test_stages_and_run(spark, tmp_path):
    rows, labels = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    chain = toxicity.fit(docs, known, toxicity.CATEGORIES)
    left = [r for r in rows if chain.predict((r[1] or "").encode())[-1] < 0.5]
    gone = {r[0] for r in rows} - {r[0] for r in left}
    assert gone == {i for i, _, t in labels if t}

    def written(df, name):
        """As the pipeline does: each stage's result is a table that the next one reads."""
        df.write.parquet(f"{tmp_path}/stage-{name}")
        return spark.read.parquet(f"{tmp_path}/stage-{name}")

    stages = {name: lambda *a, name=name, f=f: written(f(*a), name) for name, f in corpus_pipeline.STAGES}
    assert list(stages) == ["toxicity", "simhash", "secrets", "mixing", "packing"]
    docs = stages["toxicity"](spark, docs, str(tmp_path))
    assert sorted(r[0] for r in docs.collect()) == sorted(r[0] for r in left)

    first = {c for _, _, c in expected(left)}
    left = [r for r in left if r[0] in first]
    docs = stages["simhash"](spark, docs, str(tmp_path))
    assert sorted(r[0] for r in docs.collect()) == sorted(first)
    assert not first & set(range(300, 305)) and len(first & {400, 401}) == 1

    docs = stages["secrets"](spark, docs, str(tmp_path))
    clean = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in left:
        assert clean[r[0]] == (r[1] and r[1].replace("token = abcdefghij0123456789", "[SECRET]"))
    assert secrets.scan(docs).where("spans <> ''").count() == 0

    draw = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / 2**52
    kept = {r["doc_id"] for r in mixing.calibrated(docs).collect() if draw(r["doc_id"]) < r["_p"]}
    docs = stages["mixing"](spark, docs, str(tmp_path))
    assert {r[0] for r in docs.collect()} == kept and 0 < len(kept) < len(left)
    assert all(d == frame(spark, []).columns for d in (docs.columns,))

    full = Tokenizer.from_file(token_files()["vocab"])
    sizes = {i: len(full.encode(clean[i] or "", add_special_tokens=False).ids) + 1 for i in kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == kept
    for i, n in sizes.items():
        covered = np.zeros(n, dtype=int)
        for r in got:
            if r["doc_id"] == i:
                covered[r["start"]:r["start"] + r["length"]] += 1
        assert (covered == 1).all()
