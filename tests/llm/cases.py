"""Small documents with the awkward cases that every operator must bear."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use for columns of their own
CLASHES = ("fp", "key", "count", "base", "every", "tokens", "weight", "root", "rejected", "fold", "spans", "rule", "digest")


def words(rng, n, syllables=("the", "re", "an", "ti", "on", "er", "é", "ü", "st", "ou")):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def awkward(seed=5):
    rng = random.Random(seed)
    base = [words(rng, rng.randrange(20, 300)) for _ in range(25)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(30, base[0], "en", "s0", 1), (31, base[0] + " end", None, None, None), (32, base[1].upper(), "fr", "s0", 2)]
    rows += [(40, "", "en", "s1", 0), (41, None, None, None, None), (42, " \t\n ", "en", "s1", 4), (43, "", "en", "s1", 0)]
    rows += [(50, words(rng, 6000), "de", "s2", 9), (51, "a" * 3000, "de", "s2", 9), (52, "x", "de", "s2", 1)]
    rows += [(0, base[0], "en", "s0", len(base[0]))] * 2  # repeated rows
    rows += [(None, base[2], "en", "s0", 3)]
    return rows


def frame(spark, rows=None, clashes=False):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(awkward() if rows is None else rows, DOC)
    if clashes:
        docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
    return docs
