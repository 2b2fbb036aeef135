import itertools

import pytest
from pyspark.sql import functions as F

from tideline.llm import urlrules

URLS = [
    ("http://Blog.Example.ORG/es/1?x", "blog.example.org", "/es/1", "example.org/es/", "block"),
    ("http://example.org/en/12.html#t", "example.org", "/en/12.html", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("https://example.org", "example.org", "", None, "allow"),
    ("https://example.org?/es/", "example.org", "", None, "allow"),
    ("http://a.com/fr/9#/de/", "a.com", "/fr/9", "com/fr/", "allow"),
    ("http://com/de/", "com", "/de/", "com/de/", "block"),
    ("http://a.xcom/de/", "a.xcom", "/de/", None, "allow"),
    ("no url", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("x://y://z.com/de/q", "y:", "//z.com/de/q", None, "allow"),
    ("://İK.com/fr/", "İk.com", "/fr/", "com/fr/", "allow"),
]


@pytest.mark.parametrize("clashes", [False, True])
def test_fixed_rules(spark, clashes):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)] + [(0, URLS[0][0]), (None, None)], "page_id long, url string")
    if clashes:
        pages = pages.withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "item", "items", "count", "_x")})
    none = spark.createDataFrame([], "rule_id long, items array<string>, confidence double, support double")
    got = urlrules.judge(pages, none).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        u = URLS[r["page_id"]] if r["page_id"] is not None else URLS[10]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == u[1:], u


def make(spark, n=400):
    pages, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        host = f"h{i % 7}.pills-shop.net" if bad else f"h{i % 11}.news.net"
        pages.append((i, f"https://{host}/a{i % 3}/{i}?ref={'spam' if i % 2 else 'x'}&utm=1"))
        if i % 3:
            labels.append((i, int(not bad), 0))
    return (spark.createDataFrame(pages, "page_id long, url string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), pages, labels)


def test_mined_rules_match_brute_force(spark):
    pages, labels, rows, known = make(spark)
    rules = urlrules.mine(pages, labels, min_support=0.05, min_confidence=0.8).collect()
    sets = {r[0]: frozenset(r[1]) for r in pages.select("page_id", urlrules.tokens(F.col("url"))).collect()}
    bad = {i: q == 0 for i, q, _ in known}
    low = max(0.05, 8 / len(bad)) * len(bad)
    found = {}
    items = set().union(*(sets[i] for i in bad))
    for size in (1, 2):
        for combo in itertools.combinations(sorted(items), size):
            hit = [i for i in bad if set(combo) <= sets[i]]
            good = sum(bad[i] for i in hit)
            if good >= low and good / len(hit) >= 0.8:
                found[frozenset(combo)] = good / len(hit)
    kept = {c: v for c, v in found.items() if not any(d < c and found[d] >= v for d in found)}
    ours = {frozenset(r["items"]): r["confidence"] for r in rules if len(r["items"]) <= 2}
    assert ours.keys() == kept.keys() and all(abs(ours[c] - kept[c]) < 1e-9 for c in kept)
    verdicts = {r["page_id"]: r["verdict"] for r in urlrules.judge(pages, spark.createDataFrame(rules)).collect()}
    for i, _ in rows:
        assert verdicts[i] == ("block" if any(set(r["items"]) <= sets[i] for r in rules) else "allow")
    assert verdicts[0] == "block" and verdicts[1] == "allow"


def test_no_labels_and_empty_tables(spark):
    pages, labels, _, _ = make(spark, 20)
    assert urlrules.mine(pages, labels.limit(0)).count() == 0
    assert urlrules.judge(pages.limit(0), urlrules.mine(pages.limit(0), labels)).count() == 0
