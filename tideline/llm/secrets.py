"""Secret scans: fixed patterns and character Markov models, all in JVM expressions."""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.  `[0-9a-f]{16,}` and `AKIA[A-Z0-9]{14,}` find the same spans as the open-ended
# patterns with a length test, since a greedy run is maximal and a dropped run holds no longer one.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN_VALUE = 12

#: Candidates of the Markov models: unbroken runs of these characters, with a digit and a letter in them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20  # characters of a run that are judged together where runs are judged by their parts
ALPHABET = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "+/_=-"

WORDS = (
    "account address array batch buffer build cache client column commit config context counter cursor data default "
    "delete device document element encode error event export factory field file filter format frame function group "
    "handler header image import index input insert instance item iterator key label language layer length level "
    "library line list local logger manager map message method model module name network node number object offset "
    "option order output package page parameter parse partition path pattern payload pipeline pointer policy port "
    "prefix process profile project property protocol query queue range record reference region register release "
    "report request resource response result root row sample scanner schema search section select sequence server "
    "service session setting shard signal size source stack stage start state status storage stream string submit "
    "subject suffix summary symbol system table target task template text thread time timeout token topic trace track "
    "transform tree trigger type union unit update upload user utility value variable vector version view visitor "
    "watch width window word worker write zone"
).split()


def default_samples(count: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled samples: 1 for random strings, 0 for identifiers, paths and slugs made of ordinary words."""
    rng = random.Random(seed)
    out = []
    for n in range(count):
        size = rng.randrange(20, 48)
        letters = (ALPHABET[:62], ALPHABET[:36], ALPHABET[10:62], ALPHABET)[n % 4]
        out.append(("".join(rng.choice(letters) for _ in range(size)), 1))
        parts = [rng.choice(WORDS) for _ in range(rng.randrange(2, 6))]
        if rng.random() < 0.5:
            parts.append(str(rng.randrange(10_000)))
        style = n % 4
        if style == 0:
            text = parts[0] + "".join(p.capitalize() for p in parts[1:])
        elif style == 3:
            text = "".join(p.capitalize() for p in parts)
        else:
            text = ("_" if style == 1 else "-" if n % 8 < 4 else "/").join(parts)
        out.append((text, 0))
    return out


class MarkovModel:
    """Two first-order character chains; ``table[a * len(ALPHABET) + b]`` is log P(b|a, random) - log P(b|a, ordinary)."""

    def __init__(self, table: list[float], threshold: float):
        self.table = table
        self.threshold = threshold

    @classmethod
    def train(cls, samples: Iterable[tuple[str, int]], threshold: float = 1.0, smoothing: float = 0.5) -> MarkovModel:
        size = len(ALPHABET)
        place = {c: i for i, c in enumerate(ALPHABET)}
        counts = [[smoothing] * (size * size), [smoothing] * (size * size)]
        for text, label in samples:
            known = [place[c] for c in text if c in place]
            for a, b in zip(known, known[1:]):
                counts[label][a * size + b] += 1
        table = []
        for a in range(size):
            rows = [c[a * size:(a + 1) * size] for c in counts]
            totals = [sum(r) for r in rows]
            table += [math.log(rows[1][b] / totals[1]) - math.log(rows[0][b] / totals[0]) for b in range(size)]
        return cls(table, threshold)

    def ratio(self, text: str) -> float:
        """Mean log-likelihood ratio per transition; the plain form of :meth:`column`."""
        size = len(ALPHABET)
        known = [ALPHABET.index(c) for c in text]
        steps = [self.table[a * size + b] for a, b in zip(known, known[1:])]
        return sum(steps) / len(steps) if steps else 0.0

    def column(self, value: Column) -> Column:
        table = F.lit([float(x) for x in self.table])
        size = len(ALPHABET)
        codes = F.transform(F.split(value, ""), _place)
        steps = F.zip_with(
            F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1),
            lambda a, b: F.get(table, (a - 1) * size + b - 1))
        return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.size(steps)


    def best_ratio(self, text: str) -> float:
        """Largest :meth:`ratio` of any ``WINDOW`` characters; the plain form of :meth:`best_column`."""
        return max((self.ratio(text[i:i + WINDOW]) for i in range(len(text) - WINDOW + 1)), default=0.0)

    def best_column(self, value: Column) -> Column:
        """For values of ``WINDOW`` characters at least."""
        table, size, width = F.lit([float(x) for x in self.table]), len(ALPHABET), WINDOW - 1
        codes = F.transform(F.split(value, ""), _place)
        steps = F.zip_with(
            F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1),
            lambda a, b: F.coalesce(F.get(table, (a - 1) * size + b - 1), F.lit(0.0)))
        moves = lambda x: F.zip_with(
            F.slice(x, F.lit(width + 1), F.size(x) - width), F.slice(x, F.lit(1), F.size(x) - width), lambda new, old: new - old)
        first = lambda x: F.aggregate(F.slice(x, 1, width), F.lit(0.0), lambda s, y: s + y)
        walked = lambda x: F.aggregate(
            moves(x), F.struct(first(x).alias("now"), first(x).alias("best")),
            lambda acc, d: F.struct((acc["now"] + d).alias("now"), F.greatest(acc["best"], acc["now"] + d).alias("best")))["best"]
        # the array of one element makes the steps a variable, computed once
        return F.get(F.transform(F.array(steps), walked), F.lit(0)) / width


def _place(char: Column) -> Column:
    return F.call_function("locate", char, F.lit(ALPHABET))


_SPANS = "array<struct<start:int,stop:int,rank:int,kind:string,value:string>>"
_BLOCK = 64


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the element of an array is a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(_BLOCK)),
                       lambda i: F.slice(items, i + 1, F.lit(_BLOCK)))


def _before(items: Column, value, combine) -> Column:
    """For each item, ``combine`` over the values of all items before it, from 0 on.

    A fold that appends to an array copies it at each step, so folds run inside blocks; a text of very many spans
    takes time in proportion to them.
    """
    step = lambda acc, x: F.struct(combine(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
    start = lambda now: F.struct(now.alias("now"), F.array().cast("array<int>").alias("out"))

    def of(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: combine(acc, value(x))))
        first = F.aggregate(whole, start(F.lit(0)), step)["out"]
        return F.flatten(F.zip_with(blocks, first, lambda b, now: F.aggregate(b, start(now), lambda acc, x: step(acc, value(x)))["out"]))

    return _once(_blocks(items), of)


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, stop, rank, kind, value): leftmost, non-overlapping; code points, stop exclusive."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), found, lambda g, m: F.struct(
        F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    span = lambda x, at: F.struct(
        (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("stop"),
        F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x["value"].alias("value"))
    placed = _once(parts, lambda p: F.zip_with(p, _before(p, lambda x: x["gap"] + x["size"], lambda a, b: a + b), span))
    return F.when(F.size(gaps) > 1, placed).otherwise(F.array().cast(_SPANS))


def _replaced(text: Column, spans: Column, fill) -> Column:
    """``text`` with what the spans (ordered by start) cover replaced by ``fill(span, at)``, ``at`` being the furthest
    stop before the span."""
    cut = lambda whole, low, high: whole.substr(low + 1, F.greatest(high - low, F.lit(0)))

    def of(items: Column) -> Column:
        # a place in a string is found by walking there, so each block of spans gets its own part of the text
        def block(b: Column) -> Column:
            low, high = b[0]["at"], F.array_max(F.transform(b, lambda x: F.greatest(x["s"]["start"], x["at"])))
            piece = lambda part, x: F.concat(cut(part, x["at"] - low, x["s"]["start"] - low), fill(x["s"], x["at"]))
            return _once(cut(text, low, high), lambda part: F.array_join(F.transform(b, lambda x: piece(part, x)), ""))

        end = F.aggregate(items, F.lit(0), lambda acc, x: F.greatest(acc, x["s"]["stop"]))
        return F.concat(F.array_join(F.transform(_blocks(items), block), ""), text.substr(end + 1, F.length(text)))

    at = lambda s: _before(s, lambda x: x["stop"], F.greatest)
    items = _once(spans, lambda s: F.zip_with(s, at(s), lambda x, now: F.struct(x.alias("s"), now.alias("at"))))
    return F.when(F.size(spans) > 0, _once(items, of)).otherwise(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, text_col: str = "text", model: MarkovModel | None = None,
                 base: str = "_base_spans", every: str = "_all_spans") -> DataFrame:
    """Add two columns of spans (start, stop, rank, kind, value): the fixed patterns' and those with the models'.

    Spans are ordered by start, then kind.  A Markov span is an unbroken run of 20 or more characters outside the base
    spans, with a digit and a letter, of which all together or the best ``WINDOW`` neighbours have a mean
    log-likelihood ratio above the model's threshold: ordinary words before or after a secret don't hide it.  Null text
    is empty text and has no spans; repeated rows stay; very long texts and very many spans are judged whole; other
    columns pass through untouched.
    """
    model = model or MarkovModel.train(default_samples())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mark = f"_{uuid.uuid4().hex}"
    out = docs.withColumns({f"{mark}{i}": _matches(text, p, k) for i, (p, k) in enumerate(zip((ASSIGN, ACCESS, HEX), KINDS))})
    value = lambda s: F.regexp_extract(s["value"], ASSIGN, 1)
    kept = F.array_sort(F.concat(
        F.filter(f"{mark}0", lambda s: F.length(value(s)) >= MIN_ASSIGN_VALUE), F.col(f"{mark}1"), F.col(f"{mark}2")))
    out = out.withColumn(base, kept).drop(*(f"{mark}{i}" for i in range(3)))
    # as many characters that end a run stand for what the base spans cover
    blank = lambda s, at: F.repeat(F.lit("\0"), F.greatest(s["stop"] - F.greatest(s["start"], at), F.lit(0)))
    out = out.withColumn(f"{mark}t", _replaced(text, F.col(base), blank))
    out = out.withColumn(f"{mark}r", _matches(F.col(f"{mark}t"), CANDIDATE, "markov"))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    out = out.withColumn(f"{mark}r", F.filter(f"{mark}r", mixed))
    likely = lambda s: (model.best_column(s["value"]) > model.threshold) | (model.column(s["value"]) > model.threshold)
    added = F.when(F.size(f"{mark}r") > 0, F.filter(f"{mark}r", likely)).otherwise(F.col(f"{mark}r"))
    return out.withColumn(every, F.array_sort(F.concat(F.col(base), added))).drop(f"{mark}t", f"{mark}r")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: MarkovModel | None = None) -> DataFrame:
    """One row per document with span counts and digests; see :func:`find_secrets`.

    Ids may be null or repeated; extra columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = find_secrets(rows, "text", model, "base", "every").select("doc_id", "base", "every")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", model: MarkovModel | None = None) -> DataFrame:
    """Replace every span of :func:`find_secrets` (overlapping ones together) by ``mark``; columns, whatever their
    names, and row count stay as they are, null text too."""
    names = docs.columns
    base, every = (f"_{uuid.uuid4().hex}" for _ in range(2))
    rows = find_secrets(docs, text_col, model, base, every)
    fill = lambda s, at: F.when(s["start"] >= at, F.lit(mark)).otherwise(F.lit(""))
    rows = rows.withColumn(text_col, _replaced(F.col(text_col), F.col(every), fill))
    return rows.select(*names)
