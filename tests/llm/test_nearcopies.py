import random
from itertools import combinations

import corpus_pipeline
import pytest
from tests.llm.cases import awkward, frame, words

from tideline.llm import nearcopies


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_first(rows, least=0.8):
    sets = [plain_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if similarity(sets[i], sets[j]) >= least:
            parent[find(i)] = find(j)
    first = {}
    for i, r in enumerate(rows):
        first.setdefault(find(i), []).append(r[0])
    return sorted(str(min((x for x in ids if x is not None), default=None)) for ids in first.values())


def planted():
    """Near copies at a similarity of 0.8 to 0.95, each with its original, and pairs just below."""
    rng, rows, near, below = random.Random(4), [], [], []
    for size in (60, 100, 300, 1000):
        for share in (0.005, 0.012, 0.018, 0.03):
            for _ in range(6):
                a = [f"{w}{rng.randrange(99)}" for w in words(rng, size).split()]
                b = list(a)
                for at in rng.sample(range(size), max(1, round(share * size))):
                    b[at] = "changed"
                i = 2 * len(rows)
                s = similarity(plain_set(" ".join(a)), plain_set(" ".join(b)))
                (near if s >= 0.8 else below).append(i + 1)
                rows.append([(i, " ".join(a), "en", "s", 1), (i + 1, " ".join(b), "en", "s", 1)])
    return [r for pair in rows for r in pair], near, below


def test_stage_drops_planted_near_copies(spark):
    rows, near, below = planted()
    assert len(near) > 40 and len(below) > 10
    left = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "").collect()}
    assert not left & set(near) and left >= set(below)


@pytest.mark.parametrize("clashes", [False, True])
def test_classes_match_brute_force(spark, clashes):
    rng = random.Random(6)
    rows = awkward()
    chain = [f"{w}{rng.randrange(99)}" for w in words(rng, 120).split()]
    for i in range(40):  # each a near copy of the one before, the ends unlike each other
        chain[rng.randrange(120)] = f"edit{i}"
        rows.append((600 - i, " ".join(chain), "en", "s0", 1))
    got = nearcopies.keep_first(frame(spark, rows, clashes))
    assert got.columns == frame(spark, rows, clashes).columns
    assert sorted(str(r["doc_id"]) for r in got.collect()) == plain_first(rows)


def test_ids_of_several_texts_and_empty_tables(spark):
    rng = random.Random(8)
    a, b = (words(rng, 200) for _ in range(2))
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, b, "en", "s", 1), (1, a, "en", "s", 1), (None, None, None, None, None), (None, " ", None, None, None)]
    got = nearcopies.keep_first(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "").strip()) for r in got) == sorted([(1, a), (1, b), (0, "")])
    assert nearcopies.keep_first(frame(spark, [])).count() == 0
