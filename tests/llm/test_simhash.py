import random

import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.cases import awkward, frame, words

from tideline.llm import simhash
from tideline.llm.components import connected_components


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    out = 0
    for bit in range(64):
        ones = sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles)
        out |= (2 * ones > len(shingles)) << bit
    return out


def plain_components(fps, limit=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def expected(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(fps)
    least = {}
    for r, c in zip(rows, roots):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    return sorted((str(r[0]), f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, roots))


@pytest.mark.parametrize("clashes", [False, True])
def test_matches_brute_force(spark, clashes):
    rng = random.Random(3)
    rows = awkward()
    long = words(rng, 900).split()
    for i in range(60):  # near copies of a long text
        near = list(long)
        near[rng.randrange(900)] = "changed"
        rows.append((1000 - i, " ".join(near), "en", "s0", 1))
    got = simhash.near_duplicates(frame(spark, rows, clashes)).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == expected(rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.keep_first(frame(spark, [])).count() == 0


@pytest.mark.parametrize("block_limit", [2, 5, 512])
@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_close_pairs_have_the_closure_of_all_pairs(spark, block_limit, max_bits):
    rng = random.Random(block_limit)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = set(centres)
    for c in centres:
        for _ in range(40):
            x = c
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(20)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bits, 8, block_limit)
    roots = {r["node"]: r["root"] for r in connected_components(pairs).collect()}
    ours = [roots.get(x, x) for x in signed]
    plain = plain_components(fps, max_bits)
    assert len({*zip(ours, plain)}) == len(set(ours)) == len(set(plain))


def test_keep_first_keeps_one_row_and_all_columns(spark):
    docs = frame(spark, clashes=True)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 30 not in ids and 43 not in ids and 40 in ids


def test_keep_first_keeps_one_row_of_a_class_without_ids(spark):
    rng = random.Random(8)
    a, b, c = (words(rng, 400) for _ in range(3))
    rows = [(None, a, "en", "s", 1), (None, a, "fr", "s", 1), (None, b, "en", "s", 1), (7, b, "en", "s", 1), (9, c, "en", "s", 1), (None, None, None, None, None)]
    kept = simhash.keep_first(frame(spark, rows, clashes=True)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(0, a), (7, b), (9, c), (0, "")])


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in connected_components(edges).collect()} == {0}


def test_keep_first_judges_each_text_of_an_id(spark):
    rng = random.Random(5)
    a, b = (words(rng, 400) for _ in range(2))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (1, a, "en", "s", 1)]
    kept = simhash.keep_first(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b)])
