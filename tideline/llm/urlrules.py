"""URL filters: fixed host rules first, then association rules mined by FP-growth, matched by an inverted index."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm._shared import durable

# Host rules as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "label=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without ``://``; only A-Z are lower-cased, in the host."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, text.substr(at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, _UPPER, _LOWER), path


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, host words, path parts, file ending and query keys, each with its kind."""
    host, path = host_and_path(url)
    text = F.coalesce(url, F.lit(""))
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(kind), p))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "[&;]"), lambda p: F.regexp_extract(p, "^[^=]*", 0))
    words = F.filter(F.split(host, "[.-]"), lambda p: F.length(p) > 1)
    parts = F.filter(F.split(path, "/"), lambda p: ~p.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$"))
    numbers = F.transform(F.filter(F.split(path, "/"), lambda p: p.rlike("^[0-9]+$")), lambda p: F.concat(F.lit("digits"), F.length(p)))
    return F.array_distinct(F.concat(
        tag("s:", F.array(F.lower(F.regexp_extract(text, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))),
        tag("h:", F.split(host, r"\.")), tag("w:", words), tag("p:", F.concat(parts, numbers)),
        tag("e:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1))), tag("q:", keys)))


def mine(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6,
         least_rows: int = 8, partitions: int = 24) -> DataFrame:
    """``(rule_id, items, confidence, support)``: token combinations that call for a block.

    A page is an example if its id is labelled; poor or toxic ones count as blocked.  FP-growth finds combinations
    in at least ``min_support`` of the examples (and ``least_rows`` of them); rules need ``min_confidence``.
    A rule is pruned if a part of it already has the same confidence or a higher one.
    """
    known = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("_bad"))
    urls = pages.select("page_id", F.col("url").alias("url"))
    examples = urls.join(known, "page_id").select(
        F.concat(tokens(F.col("url")), F.when(F.col("_bad") == 1, F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items"))
    examples = durable(examples, "url-examples")
    n = examples.count()
    support = max(min_support, (least_rows - 0.5) / n) if n else 1.0  # the half keeps rounding from asking for one row more
    schema = "rule_id long, items array<string>, confidence double, support double"
    if not n or support > 1:
        return pages.sparkSession.createDataFrame([], schema)
    growth = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence, numPartitions=partitions)
    rules = growth.fit(examples).associationRules
    rules = rules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK)).select(
        F.array_sort("antecedent").alias("items"), "confidence", "support")
    rules = durable(rules.select(F.xxhash64("items").alias("rule_id"), "items", "confidence", "support"), "url-rules")
    part = rules.select(F.col("items").alias("_i"), F.col("confidence").alias("_c"), F.col("items")[0].alias("_first"))
    # an index on the first item: a part's first item is one of the whole rule's items
    whole = rules.select("rule_id", "items", "confidence", F.explode("items").alias("_first"))
    beaten = whole.join(part, "_first").where(
        (F.size("_i") < F.size("items")) & (F.size(F.array_except("_i", "items")) == 0) & (F.col("_c") >= F.col("confidence"))
    ).select("rule_id").distinct()
    return rules.join(beaten, "rule_id", "left_anti").select("rule_id", "items", "confidence", "support")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(_key, confidence)``: the best rule whose items are all among the row's ``_tokens``.

    The inverted index lists each rule once, under its rarest item; a url looks up its own tokens there.
    """
    rarity = rules.select(F.explode("items").alias("item")).groupBy("item").count()
    index = rules.select("rule_id", "items", "confidence", F.explode("items").alias("item")).join(rarity, "item")
    index = index.groupBy("rule_id", "items", "confidence").agg(F.min(F.struct("count", "item")).alias("_low")).select(
        "rule_id", "items", "confidence", F.col("_low.item").alias("item"))
    posts = urls.select("_key", "_tokens", F.explode("_tokens").alias("item"))
    hits = posts.join(index, "item").where(F.size(F.array_except("items", "_tokens")) == 0)
    return hits.groupBy("_key").agg(F.max("confidence").alias("_confidence"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, confidence``.

    A fixed rule decides where one fits; else the page is blocked if a mined rule matches.  Null urls and those
    without ``://`` have empty host and path and are allowed unless a mined rule matches.  Repeated rows stay;
    ids may be null; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "_fixed": verdict, "_key": F.coalesce("url", F.lit(""))})
    open_urls = rows.where("_fixed is null").select("_key").distinct().withColumn("_tokens", tokens(F.col("_key")))
    found = match(open_urls, rules)
    out = rows.join(found, "_key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_fixed", F.when(F.col("_confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                      F.when(F.col("_fixed").isNull(), F.col("_confidence")).alias("confidence"))
