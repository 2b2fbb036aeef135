"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm._shared import durable

DIMENSIONS = ("source", "lang", "topic")
#: Above this many cells the fitting runs as DataFrame rounds instead of on the driver, and cells are not broadcast.
DRIVER_CELLS = 100_000


def text_form(text: Column) -> Column:
    """The topic used where no column gives one: the shape of a text."""
    return (F.when(text.contains(" | "), F.lit("table")).when(text.contains("!!"), F.lit("shout"))
            .when(F.octet_length(text) < 400, F.lit("note")).otherwise(F.lit("prose")))


def token_weight(text: Column) -> Column:
    """Tokens of a text for weighing: a fourth of its bytes, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def prepared(docs: DataFrame, text_col: str = "text", topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """``docs`` with ``_source, _lang, _topic, _tokens``; nulls are the value ``unknown``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({
        "_source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")),
        "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")),
        "_topic": text_form(text) if topic is None else F.coalesce(topic, F.lit("unknown")),
        "_tokens": token_weight(text) if tokens is None else F.greatest(tokens, F.lit(1)).cast("long")})


def _targets(cells: DataFrame, dim: str, target: dict | float) -> DataFrame:
    """Share of each value of ``dim``: given ones normalised over the values present, or tokens to a power."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    if isinstance(target, dict):
        pairs = [(k, float(v)) for k, v in target.items()] or [("", 0.0)]
        given = cells.sparkSession.createDataFrame(pairs, f"{dim} string, g double")
        sums = sums.join(given, dim, "left").select(dim, F.coalesce("g", F.lit(0.0)).alias("t"))
    else:
        sums = sums.select(dim, F.pow("t", F.lit(float(target))).alias("t"))
    whole = sums.agg(F.sum("t").alias("whole"))
    return sums.join(F.broadcast(whole)).select(
        dim, F.coalesce(F.try_divide("t", "whole"), F.lit(0.0)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, dict | float], rounds: int = 12, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``(source, lang, topic, tokens)`` -> the same with ``weight``, whose marginal shares approach the targets.

    Each round scales the weights to the target share of every source, then language, then topic; the sum stays the
    number of tokens.  Up to ``driver_cells`` cells this is numpy on the driver; more stay DataFrames, one written
    table a round.  Both give the same weights to rounding.
    """
    cells = durable(cells.select(*DIMENSIONS, F.col("tokens").cast("long")), "mix-cells")
    if cells.count() <= driver_cells:
        return _rake_on_driver(cells, targets, rounds)
    total = cells.agg(F.sum("tokens")).first()[0]
    shares = {d: durable(_targets(cells, d, targets[d]), "mix-targets") for d in DIMENSIONS}
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = state.groupBy(d).agg(F.sum("weight").alias("_now"))
            factor = F.coalesce(F.try_divide(F.col("share") * F.lit(float(total)), F.col("_now")), F.lit(0.0))
            scale = shares[d].join(now, d).select(d, factor.alias("_f"))
            state = state.join(scale, d).select(*DIMENSIONS, "tokens", (F.col("weight") * F.col("_f")).alias("weight"))
        state = durable(state, "mix-round")
    return state


def _rake_on_driver(cells: DataFrame, targets: dict[str, dict | float], rounds: int) -> DataFrame:
    rows = sorted(cells.collect(), key=lambda r: (r["source"], r["lang"], r["topic"]))  # bounded by driver_cells
    schema = "source string, lang string, topic string, tokens long, weight double"
    if not rows:
        return cells.sparkSession.createDataFrame([], schema)
    tokens = np.array([r["tokens"] for r in rows], dtype=np.float64)
    weight, plan = tokens.copy(), []
    for d in DIMENSIONS:
        values, at = np.unique([r[d] for r in rows], return_inverse=True)
        target = targets[d]
        share = np.array([float(target.get(v, 0.0)) for v in values.tolist()]) if isinstance(target, dict) \
            else np.bincount(at, weights=tokens) ** float(target)
        plan.append((at, share / share.sum() if share.sum() else share))
    for _ in range(rounds):
        for at, share in plan:
            now = np.bincount(at, weights=weight, minlength=len(share))
            weight = weight * np.divide(share * tokens.sum(), now, out=np.zeros_like(now), where=now > 0)[at]
    out = [(r["source"], r["lang"], r["topic"], r["tokens"], float(w)) for r, w in zip(rows, weight)]
    return cells.sparkSession.createDataFrame(out, schema)


#: A multiplier that stands for no bound: cells of values that are sampled whole.
_WHOLE = 1e9


def _goals(share: np.ndarray, tokens: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens to sample of each value, and which values are sampled whole because their target is out of reach.

    What such values lack is spread over the others in proportion to their targets.
    """
    whole = np.zeros(len(share), dtype=bool)
    while True:
        free = ~whole & (share > 0)
        left = wanted - tokens[whole].sum()
        goal = np.where(whole, tokens, share * (left / share[free].sum() if free.any() else 0.0))
        over = free & (goal >= tokens)
        if not over.any():
            return goal, whole
        whole |= over


def fit_probabilities(cells: DataFrame, targets: dict[str, dict | float], keep: float = 0.75, rounds: int = 12,
                      driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``(source, lang, topic, tokens)`` -> the same with ``p`` in [0, 1]: raking under the bound that no token is sampled twice.

    The sample is to hold ``keep`` of the tokens in the target shares.  ``p`` is the product of one factor a value, cut
    at 1; each step sets the factors of a dimension so that cells below 1 make up for those at 1.  A target that all
    tokens of a value can't meet is out of reach: the value is sampled whole and the others of its dimension take the
    rest.  Targets that only contradict each other across dimensions are approached.
    """
    cells = durable(cells.select(*DIMENSIONS, F.col("tokens").cast("long")), "mix-cells")
    if cells.count() <= driver_cells:
        return _fit_on_driver(cells, targets, keep, rounds)
    wanted = keep * cells.agg(F.sum("tokens")).first()[0]
    goals = {d: durable(_goal_table(cells, d, targets[d], wanted), "mix-goals") for d in DIMENSIONS}
    state = cells.withColumn("m", F.lit(float(keep)))
    at_one, below = F.when(F.col("m") >= 1, F.col("tokens")), F.when(F.col("m") < 1, F.col("tokens") * F.col("m"))
    for _ in range(rounds):
        for d in DIMENSIONS * 2:
            now = state.groupBy(d).agg(F.coalesce(F.sum(at_one), F.lit(0)).cast("double").alias("_at_one"),
                                       F.coalesce(F.sum(below), F.lit(0.0)).alias("_below"))
            factor = (F.when(F.col("whole"), F.lit(_WHOLE))
                      .when(F.col("_at_one") + F.col("_below") > F.col("goal"), F.col("goal") / (F.col("_at_one") + F.col("_below")))
                      .when(F.col("_below") > 0, (F.col("goal") - F.col("_at_one")) / F.col("_below")).otherwise(F.lit(1.0)))
            scale = goals[d].join(now, d).select(d, factor.alias("_f"))
            state = state.join(scale, d).select(*DIMENSIONS, "tokens", F.least(F.col("m") * F.col("_f"), F.lit(_WHOLE)).alias("m"))
            state = durable(state, "mix-round")
    return state.select(*DIMENSIONS, "tokens", F.least("m", F.lit(1.0)).alias("p"))


def _goal_table(cells: DataFrame, dim: str, target: dict | float, wanted: float) -> DataFrame:
    """:func:`_goals` as DataFrame steps: the level of the free values rises until no more values are out of reach."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    values = durable(sums.join(_targets(cells, dim, target), dim), "mix-values")
    level = 0.0
    whole = (F.col("share") > 0) & (F.col("share") * F.lit(level) >= F.col("t"))
    while True:
        row = values.agg(F.sum(F.when(whole, F.col("t"))), F.sum(F.when(~whole, F.col("share")))).first()
        now = (wanted - (row[0] or 0.0)) / row[1] if row[1] else level
        if now <= level:
            break
        level = now
        whole = (F.col("share") > 0) & (F.col("share") * F.lit(level) >= F.col("t"))
    return values.select(dim, F.when(whole, F.col("t")).otherwise(F.col("share") * F.lit(level)).alias("goal"), whole.alias("whole"))


def _fit_on_driver(cells: DataFrame, targets: dict[str, dict | float], keep: float, rounds: int) -> DataFrame:
    rows = sorted(cells.collect(), key=lambda r: (r["source"], r["lang"], r["topic"]))  # bounded by driver_cells
    schema = "source string, lang string, topic string, tokens long, p double"
    if not rows:
        return cells.sparkSession.createDataFrame([], schema)
    tokens = np.array([r["tokens"] for r in rows], dtype=np.float64)
    m, plan = np.full(len(rows), float(keep)), []
    for d in DIMENSIONS:
        values, at = np.unique([r[d] for r in rows], return_inverse=True)
        target, sums = targets[d], np.bincount(at, weights=tokens)
        share = np.array([float(target.get(v, 0.0)) for v in values.tolist()]) if isinstance(target, dict) else sums ** float(target)
        plan.append((at, *_goals(share / share.sum() if share.sum() else share, sums, keep * tokens.sum())))
    for _ in range(rounds):
        for at, goal, whole in plan * 2:
            at_one = np.bincount(at, weights=np.where(m >= 1, tokens, 0.0), minlength=len(goal))
            below = np.bincount(at, weights=np.where(m < 1, tokens * m, 0.0), minlength=len(goal))
            now = at_one + below
            up = np.divide(goal - at_one, below, out=np.ones_like(goal), where=below > 0)
            down = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            m = np.minimum(m * np.where(whole, _WHOLE, np.where(now > goal, down, up))[at], _WHOLE)
    out = [(r["source"], r["lang"], r["topic"], r["tokens"], float(min(1.0, x))) for r, x in zip(rows, m)]
    return cells.sparkSession.createDataFrame(out, schema)


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the id: 52 bits of an MD5 value."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


#: Columns that :func:`calibrated` adds.
ADDED = ("_source", "_lang", "_topic", "_tokens", "_p", "_kept")


def calibrated(docs: DataFrame, targets: dict[str, dict | float] | None = None, keep: float = 0.75, rounds: int = 12,
               seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None,
               tokens: Column | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``docs`` with ``_source, _lang, _topic, _tokens, _p`` (probability) and ``_kept``.

    Cells (source, language, topic) are sampled with the probabilities of :func:`fit_probabilities`.  The default target
    of each dimension is its token shares to the power 0.5, which flattens them.  A document's draw depends on its id
    alone, so repeated rows share it.  Nulls in source, language or topic are the value ``unknown``; null text is empty
    text, which weighs one token, as does a null id's; very long texts weigh by their length; columns of ``docs`` that
    are called like an added one give way to it; an empty table gives no rows.
    """
    targets = targets or dict.fromkeys(DIMENSIONS, 0.5)
    rows = prepared(docs.drop(*ADDED), text_col, topic, tokens)
    fitted = fit_probabilities(_cells(rows), targets, keep, rounds, driver_cells)
    fitted = fitted.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"),
                           F.col("p").alias("_p"))
    fitted = durable(fitted, "mix-probabilities")
    few = F.broadcast(fitted) if fitted.count() <= driver_cells else fitted
    out = rows.join(few, ["_source", "_lang", "_topic"])
    return out.withColumn("_kept", uniform(F.col(id_col), seed) < F.col("_p"))


def _cells(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")
                        ).agg(F.sum("_tokens").alias("tokens"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "mix", **options) -> DataFrame:
    """The sampled documents of :func:`calibrated`, with their columns, whatever their names, as they were."""
    own = f"_{uuid.uuid4().hex}"
    rows = docs.select(F.struct("*").alias(own), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "source", "lang")
    return calibrated(rows, seed=seed, **options).where("_kept").select(f"{own}.*")


def report(docs: DataFrame, targets: dict[str, dict | float] | None = None, keep: float = 0.75, rounds: int = 12,
           topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """``(dimension, value, target, goal, expected, within_reach)``: shares of the sample's tokens.

    ``goal`` is the target where all targets are within reach; else values out of reach are sampled whole and the rest
    is dealt to the others.  ``expected`` is what the fitted probabilities give.
    """
    targets = targets or dict.fromkeys(DIMENSIONS, 0.5)
    cells = durable(_cells(prepared(docs.drop(*ADDED), topic=topic, tokens=tokens)), "mix-cells")
    fitted = durable(fit_probabilities(cells, targets, keep, rounds), "mix-probabilities")
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    kept = fitted.agg(F.sum(F.col("tokens") * F.col("p"))).first()[0] or 0.0
    out = None
    for d in DIMENSIONS:
        goals = _goal_table(cells, d, targets[d], keep * whole).join(_targets(cells, d, targets[d]), d)
        got = fitted.groupBy(d).agg(F.sum(F.col("tokens") * F.col("p")).alias("got"))
        part = goals.join(got, d).select(
            F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col("share").alias("target"),
            F.try_divide(F.col("goal"), F.lit(keep * float(whole))).alias("goal"),
            F.try_divide(F.col("got"), F.lit(float(kept))).alias("expected"), (~F.col("whole")).alias("within_reach"))
        out = part if out is None else out.union(part)
    return out
