"""Scalar functions as Column expressions."""

from __future__ import annotations

import uuid
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tideline.errors import ConfigurationError, SchemaError
from tideline.schemas import ANY

_CASES = [f.split(":")[0] for f in ANY[len("STRUCT<"):-1].split(",")]

#: Levels of lists and maps inside a value; each adds as much to the plan as the value itself.
MAX_DEPTH = 2


def hex_text(raw: Column) -> Column:
    """Bytes as lower-case hex text."""
    return F.lower(F.hex(raw))


# The functions below are made as SQL text, which is parsed at once: built call by call, a decoding plan took seconds.


def _each(items: Column, name: str, body: str) -> Column:
    """``items`` with ``body``, SQL over the variable ``name``, for each."""
    return F.call_function("transform", items, F.expr(f"{name} -> {body}"))


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` over a variable that stands for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _double_sql(value: str) -> str:
    # "-1.5E-7" is split into what stands before the point, behind it, and the power of ten
    parts = ("named_struct('sign', if(startswith(s[0], '-'), '-', ''), 'whole', trim(LEADING '-' FROM s[0]), "
             "'tail', trim(TRAILING '0' FROM s[1]), 'power', coalesce(cast(get(s, 2) AS INT), 0))")
    moved = ("concat(d.sign, CASE WHEN d.power < 0 THEN concat('0.', repeat('0', -d.power - 1), d.whole, d.tail) "
             "WHEN d.power >= length(d.tail) THEN concat(d.whole, d.tail, repeat('0', d.power - length(d.tail))) "
             "ELSE concat(d.whole, substring(d.tail, 1, d.power), '.', substring(d.tail, d.power + 1, length(d.tail))) END)")
    finite = _let("split(t, '[.E]')", "s", _let(parts, "d", moved))
    return _let(f"cast({value} AS STRING)", "t",
                f"CASE WHEN t = 'NaN' THEN t WHEN endswith(t, 'Infinity') THEN replace(t, 'Infinity', 'inf') ELSE {finite} END")


def double_text(value: Column) -> Column:
    """A double in positional form: ``1``, ``0.00001``, ``1000000000``, ``inf``, ``NaN``, ``-0``."""
    return F.get(_each(F.array(value), "v", _double_sql("v")), F.lit(0))


#: Items of a list are values, entries of a map have a key beside one: both are read alike.
_NESTED = f"values ARRAY<{ANY[:-1]},key:STRING,value:{ANY}>>"


def _value_sql(v: str, depth: int) -> str:
    listed, names = f"{v}.arrayValue IS NOT NULL", [f"{x}{depth}" for x in "ipeu"]
    if depth:
        i, p, e, u = names
        as_value = "named_struct(" + ", ".join(f"'{c}', {i}.{c}" for c in _CASES) + ")"
        inner = _let(f"if({listed}, {as_value}, {i}.value)", u, _value_sql(u, depth - 1))
        items = f"coalesce(from_json(coalesce({v}.arrayValue, {v}.kvlistValue), '{_NESTED}').`values`, array())"
        pairs = f"transform({items}, {i} -> named_struct('key', coalesce({i}.key, ''), 'value', {inner}))"
        joined = f"concat('[', array_join(transform({p}, {e} -> coalesce({e}.value, '')), ','), ']')"
        nested = _let(pairs, p, f"if({listed}, {joined}, {_object_sql(p)})")
    else:
        nested = "cast(raise_error('value nested too deeply') AS STRING)"
    return (f"CASE WHEN {v} IS NULL THEN NULL WHEN {v}.stringValue IS NOT NULL THEN {v}.stringValue "
            f"WHEN {v}.intValue IS NOT NULL THEN cast(cast({v}.intValue AS DECIMAL(20, 0)) AS STRING) "
            f"WHEN {v}.doubleValue IS NOT NULL THEN {_double_sql(f'cast({v}.doubleValue AS DOUBLE)')} "
            f"WHEN {v}.boolValue IS NOT NULL THEN lower({v}.boolValue) WHEN {listed} OR {v}.kvlistValue IS NOT NULL THEN {nested} "
            f"WHEN {v}.bytesValue IS NOT NULL THEN lower(hex(unbase64({v}.bytesValue))) ELSE '' END")


def _object_sql(pairs: str) -> str:
    by_key = f"map_from_entries(filter({pairs}, f -> f.value IS NOT NULL))"
    return f"coalesce(to_json(map_from_entries(array_sort(map_entries({by_key})))), '{{}}')"


def any_value_text(value: Column, depth: int = MAX_DEPTH) -> Column:
    """A typed value as text: null for an absent value, ``""`` for one without a case.

    Lists become ``[a,b]`` without quotes, maps a JSON object, bytes hex text.  Nesting below ``depth`` is an error,
    never cut off in silence.
    """
    return F.get(_each(F.array(value), "v", _value_sql("v", depth)), F.lit(0))


def pairs_of(entries: Column, depth: int = MAX_DEPTH) -> Column:
    """Attributes as an array of (key, value text)."""
    return _each(entries, "a", f"named_struct('key', coalesce(a.key, ''), 'value', {_value_sql('a.value', depth)})")


def json_object(pairs: Column) -> Column:
    """A JSON object of strings, ordered by key.  Absent values are left out; the last of a repeated key counts
    (by the map setting of ``tideline.session.SETTINGS``)."""
    return F.get(_each(F.array(pairs), "p", _object_sql("p")), F.lit(0))


def attributes_json(entries: Column, depth: int = MAX_DEPTH) -> Column:
    """Attributes as the text of :func:`json_object`."""
    return json_object(pairs_of(entries, depth))


def nanos(text: Column) -> Column:
    """Unsigned 64-bit nanoseconds as a long; what doesn't fit is an error.  Absent is 0."""
    value = F.coalesce(text.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    limit = F.lit(2**63 - 1).cast("decimal(20,0)")
    return F.when(value > limit, F.raise_error(F.concat(F.lit("timestamp out of range: "), value.cast("string"))).cast("long")).otherwise(value.cast("long"))


def timestamp_of(ns: Column) -> Column:
    """Timestamp without zone, to the microsecond below."""
    return F.timestamp_micros(F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))).cast("timestamp_ntz")


class Granularity(Enum):
    HOURLY = "hourly"
    DAILY = "daily"


def partition_path(ts: Column, granularity: Granularity = Granularity.HOURLY) -> Column:
    """``year=2024/month=06/day=09/hour=00/`` for a timestamp without zone."""
    hour = "'/hour='HH" if granularity is Granularity.HOURLY else ""
    return F.date_format(ts, f"'year='yyyy'/month='MM'/day='dd{hour}'/'")


def has_key(json_text: Column, key: str) -> Column:
    """Whether the text is a JSON object with ``key``; false for nulls and for other text."""
    return F.coalesce(F.array_contains(F.json_object_keys(json_text), key), F.lit(False))


def rename_keys(json_text: Column, rules: dict[str, str]) -> Column:
    """Move values of a JSON object to other keys, keeping their types; text that is no JSON stays as it is."""
    parsed = F.try_parse_json(json_text)
    entries = F.map_entries(F.try_variant_get(parsed, "$", "map<string,variant>"))
    renamed = entries
    for source, target in rules.items():
        renamed = _moved(renamed, source, target)
    return F.when(parsed.isNull() | entries.isNull(), json_text).otherwise(F.to_json(F.map_from_entries(renamed)))


def _moved(entries: Column, source: str, target: str) -> Column:
    """The value of ``source`` under ``target``, in place of what was there; unchanged without ``source``."""
    if source == target:
        return entries
    others = F.filter(entries, lambda e: e["key"] != target)
    moved = F.transform(others, lambda e: F.named_struct(
        F.lit("key"), F.when(e["key"] == source, target).otherwise(e["key"]), F.lit("value"), e["value"]))
    return F.when(F.exists(entries, lambda e: e["key"] == source), moved).otherwise(entries)


def require_string(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise SchemaError(f"Missing {column}")
    if not isinstance(df.schema[column].dataType, StringType):
        raise SchemaError(f"{column} is not a string column")


class WireFormat(Enum):
    """Payload formats of the sinks."""

    IPC = "ipc"
    JSON = "json"
    CSV = "csv"

    @classmethod
    def parse(cls, text: str, allowed=("ipc", "json", "csv")) -> WireFormat:
        name = text.lower()
        if name not in allowed:
            raise ConfigurationError(f"unknown format: {text}")
        return cls(name)


def load_label(signal: str, query_id: str | None = None, batch_id: int | None = None) -> str:
    """A label that repeats for the same micro-batch, so a retried load is recognised."""
    tail = uuid.uuid4().hex if query_id is None else f"{query_id}-{batch_id}"
    return f"otel-{signal}-{tail}"
