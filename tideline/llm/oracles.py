"""SQL for the same rows as the registered queries, for the operators that SQL can express.

Each is written from the contract of its query, not from the operator: plain grouping of all 400-byte strings for
``op2``, level-wise counting of token sets for ``op7``.  They are for checking, at small scale.
"""

from __future__ import annotations

from tideline.llm import mixing, secrets, urlrules

REPEATS = """
with d as (
  select row_number() over () as rid, doc_id, encode(coalesce(text, '')) as raw from documents),
pieces as (
  select rid, low, raw[low + 1:low + 1399] as piece
  from (select rid, raw, unnest(range(0, octet_length(raw) - 399, 1000)) as low from d)),
windows as (
  select rid, low + o as pos, md5(piece[o + 1:o + 400]) as w
  from (select rid, low, piece, unnest(range(0, octet_length(piece) - 399)) as o from pieces)),
repeated as (select w from windows group by w having count(*) > 1),
hits as (select rid, pos from windows where w in (select w from repeated)),
breaks as (
  select rid, pos, (pos <= lag(pos) over (partition by rid order by pos) + 400) is not true as fresh from hits),
runs as (select rid, pos, sum(fresh::int) over (partition by rid order by pos) as run from breaks),
spans as (select rid, min(pos) as low, max(pos) + 400 as high from runs group by rid, run),
gaps as (select rid, low, high, coalesce(lag(high) over (partition by rid order by low), 0) as since from spans),
removed as (
  select rid, sum(high - low)::bigint as n_removed, count(*)::bigint as n_spans, max(high) as last,
    string_agg(hex(raw[since + 1:low]), '' order by low) as kept
  from gaps join d using (rid) group by rid)
select doc_id, octet_length(raw)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed,
  coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept, '') || hex(raw[coalesce(last, 0) + 1:octet_length(raw)]))) as kept_sha256
from d left join removed using (rid)"""


def mix(keep: float = 0.75, rounds: int = 12) -> str:
    """Raking under the bound p <= 1 as a chain of windows, one a step.

    The values of a dimension are put in the order in which they run out of tokens as the sample's level rises; the
    first level that the next value can bear is the one at which the others share what is left.
    """
    goals = ",\n".join(f"""
t_{d} as (select {d}, sum(tokens)::double as t, pow(sum(tokens)::double, 0.5) / sum(pow(sum(tokens)::double, 0.5)) over () as share from cells group by {d}),
o_{d} as (
  select *, (wanted - coalesce(sum(t) over before, 0)) / (1 - coalesce(sum(share) over before, 0)) as level, row_number() over (order by t / share, {d}) as i
  from t_{d}, (select {keep}::double * sum(tokens) as wanted from cells)
  window before as (order by t / share, {d} rows between unbounded preceding and 1 preceding)),
l_{d} as (select min(i) as i, min_by(level, i) as level from o_{d} where t / share > level),
g_{d} as (select {d}, case when o.i < l.i then t else share * l.level end as goal, o.i < l.i as whole from o_{d} o, l_{d} l)""" for d in mixing.DIMENSIONS)
    steps = [f"s0 as (select source, lang, topic, tokens, {keep}::double as m from cells)"]
    for n in range(rounds * 2 * len(mixing.DIMENSIONS)):
        d = mixing.DIMENSIONS[n % len(mixing.DIMENSIONS)]
        steps.append(f"""s{n + 1} as (
  select source, lang, topic, tokens, least(1e9::double, m * case when whole then 1e9::double when one + below > goal then goal / (one + below)
    when below > 0 then (goal - one) / below else 1.0::double end) as m
  from (select s.*, goal, whole, sum(case when m >= 1 then tokens else 0 end) over (partition by s.{d})::double as one,
      sum(case when m < 1 then tokens * m else 0.0::double end) over (partition by s.{d}) as below
    from s{n} s join g_{d} g on g.{d} = s.{d}))""")
    chain = ",\n".join(steps)
    return f"""
with d as (
  select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang,
    case when contains(coalesce(text, ''), ' | ') then 'table' when contains(coalesce(text, ''), '!!') then 'shout'
         when strlen(coalesce(text, '')) < 400 then 'note' else 'prose' end as topic,
    greatest(1, ceil(strlen(coalesce(text, '')) / 4.0))::bigint as tokens
  from documents),
cells as (select source, lang, topic, sum(tokens)::bigint as tokens from d group by all),
{goals},
{chain},
p as materialized (select source, lang, topic, least(1.0::double, m) as p from s{len(steps) - 1})
select d.doc_id, d.source, d.lang, d.topic, d.tokens, round(p.p, 9) as probability,
  (('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double) < p.p as kept
from d join p on d.source = p.source and d.lang = p.lang and d.topic = p.topic"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def urls(min_support: float = 0.002, min_confidence: float = 0.6, least_rows: int = 8) -> str:
    """Fixed rules by a table; token sets that call for a block grown one token a level.

    A url's confidence is that of its best set: pruning sets that a part of them matches or beats can't change it.
    """
    fixed = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in urlrules.RULES)
    tag = lambda kind, parts: f"[{_quoted(kind)} || p for p in {parts} if p <> '']"
    path_parts = "string_split(path, '/')"
    return rf"""
with recursive rest as (
  select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parsed as (
  select row_number() over () as rid, page_id, coalesce(url, '') as url,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) as path
  from (select page_id, url, coalesce(rest, '') as rest from rest)),
tokens as (
  select rid, page_id, list_distinct(list_concat(
    {tag('s:', "[lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))]")},
    {tag('h:', "string_split(host, '.')")},
    ['w:' || p for p in regexp_split_to_array(host, '[.-]') if length(p) > 1],
    ['p:' || p for p in {path_parts} if p <> '' and not regexp_matches(p, '^[0-9]+(\.[A-Za-z0-9]+)?$')],
    ['p:digits' || length(p) for p in {path_parts} if regexp_matches(p, '^[0-9]+$')],
    {tag('e:', r"[regexp_extract(path, '\.([A-Za-z0-9]{1,5})$', 1)]")},
    {tag('q:', r"[regexp_extract(k, '^[^=]*') for k in regexp_split_to_array(regexp_extract(url, '\?([^#]*)', 1), '[&;]')]")})) as toks
  from parsed),
known as (
  select doc_id, max((coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1)::int) as bad
  from labels where quality is not null or toxic is not null group by doc_id),
examples as (select toks, bad from tokens join known on page_id = doc_id),
least as (select ceil(greatest({min_support}::double, ({least_rows} - 0.5)::double / nullif(count(*), 0)) * count(*)) as n from examples),
sets(items) as (
  select [t] from (select unnest(toks) as t from examples where bad = 1) group by t having count(*) >= (select n from least)
  union all
  select list_append(items, t) from (
    select items, unnest(toks) as t from sets join examples on bad = 1 and list_has_all(toks, items))
  where t > items[-1] group by items, t having count(*) >= (select n from least)),
rules as (
  select items, sum(bad)::double / count(*) as confidence from sets join examples on list_has_all(toks, items)
  group by items having sum(bad)::double / count(*) >= {min_confidence}),
found as (select rid, max(confidence) as confidence from tokens join rules on list_has_all(toks, items) group by rid),
fits as (
  select rid, first(h || p order by length(h || p) desc) as rule, first(v order by length(h || p) desc) as verdict
  from parsed join (values {fixed}) r(h, p, v) on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rid)
select page_id, host, path, rule, coalesce(verdict, case when confidence is null then 'allow' else 'block' end) as verdict,
  case when verdict is null then confidence end as confidence
from parsed left join fits using (rid) left join found using (rid)"""


def _spans(kind: str, pattern: str, group: int = 0) -> str:
    """Leftmost, non-overlapping matches: their places follow from the lengths of matches and of the gaps between."""
    return f"""{kind}_found as (
  select rid, regexp_split_to_array(text, {_quoted(pattern)}) as gaps, regexp_extract_all(text, {_quoted(pattern)}, 0) as hits,
    regexp_extract_all(text, {_quoted(pattern)}, {group}) as shown
  from d),
{kind}_each as (
  select rid, unnest(range(1, len(hits) + 1)) as i, unnest(gaps[1:len(hits)]) as gap, unnest(hits) as hit, unnest(shown) as shown
  from {kind}_found),
{kind}_spans as (
  select rid, hit, shown, sum(length(gap) + length(hit)) over (partition by rid order by i)::bigint as stop from {kind}_each)"""


def secret_spans() -> str:
    """The three patterns as the contract has them, and the trained table of the Markov models as a list."""
    model = secrets.MarkovModel.train(secrets.default_samples())
    either = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
    words = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
    assign = rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    place = lambda c: f"strpos({_quoted(secrets.ALPHABET)}, {c})"
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
{_spans("assign", assign, 2)},
{_spans("access", "AKIA[A-Z0-9]+")},
{_spans("hex", "[0-9a-f]+")},
{_spans("run", "[A-Za-z0-9+/_=-]{20,}")},
base as (
  select rid, 0 as rank, 'assign' as kind, stop - length(hit) as start, stop from assign_spans where length(shown) >= 12
  union all select rid, 1, 'access', stop - length(hit), stop from access_spans where length(hit) >= 18
  union all select rid, 2, 'hex', stop - length(hit), stop from hex_spans where length(hit) >= 16),
chars as (
  select rid, stop - length(hit) + i - 1 as pos, hit[i] as c from (select rid, hit, stop, unnest(range(1, length(hit) + 1)) as i from run_spans)),
bare as (
  select rid, pos, c, pos - row_number() over (partition by rid order by pos) as isle from chars x
  where not exists (select 1 from base b where b.rid = x.rid and b.start <= x.pos and x.pos < b.stop)),
weights as (select [{",".join(map(repr, model.table))}] as w),
steps as (
  select rid, isle, pos, c, w[({place("lag(c) over same")} - 1) * {len(secrets.ALPHABET)} + {place("c")}] as x
  from bare, weights window same as (partition by rid, isle order by pos)),
judged as (
  select rid, isle, pos, c, x, avg(x) over (partition by rid, isle order by pos rows {secrets.WINDOW - 2} preceding) as near,
    row_number() over (partition by rid, isle order by pos) as i
  from steps),
markov as (
  select rid, 3 as rank, 'markov' as kind, min(pos) as start, max(pos) + 1 as stop from judged group by rid, isle
  having count(*) >= 20 and bool_or(regexp_matches(c, '[0-9]')) and bool_or(regexp_matches(c, '[A-Za-z]'))
    and (avg(x) > {model.threshold!r} or max(near) filter (i >= {secrets.WINDOW}) > {model.threshold!r})),
named as (
  select rid, rank, start, kind || ':' || start || ':' || stop as name from (select * from base union all select * from markov)),
told as (
  select rid, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
    string_agg(name, ',' order by start, rank) filter (rank < 3) as base, string_agg(name, ',' order by start, rank) as spans
  from named group by rid)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told using (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffixes": REPEATS, "op4_mixing": mix(), "op7_urls": urls(), "op10_secrets": secret_spans()}
