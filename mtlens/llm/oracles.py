"""DuckDB SQL of the queries that SQL can express.

The language, toxicity and language-model scores, the sampling keys, the token ids and the periodic runs have none: they are
tested against brute force, an exact round trip or held-out rows.
"""

from __future__ import annotations

from .chat import CONTROL
from .host_rules import LIMIT, RULES
from .secret_scan import ACCESS, ASSIGN, BASE, HEX, KINDS, OPAQUE, OWNERS, PLACEHOLDER, REPOS, VENDOR
from .vector_codes import ENTRIES, ROUNDS


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets() -> str:
    patterns = [ASSIGN, ACCESS, HEX, VENDOR, OPAQUE]
    parts = []
    for k, p in enumerate(patterns):
        q = _quoted(p)
        value = f"regexp_extract_all(t, {q}, 2)" if k == 0 else f"regexp_extract_all(t, {q})"
        parts.append(
            f"select doc_id, source, {k} as kind, unnest(range(len(regexp_extract_all(t, {q})))) as i, unnest(regexp_extract_all(t, {q})) as m, "
            f"unnest({value}) as v, unnest(list_slice(string_split_regex(t, {q}), 1, len(regexp_extract_all(t, {q})))) as p from d"
        )
    names = "[" + ", ".join(_quoted(n) for n, _ in KINDS) + "]"
    last = len(KINDS) - 1

    def joined(where: str) -> str:
        return f"coalesce(string_agg({names}[kind + 1] || ':' || s || ':' || e, ',' order by s, kind) filter (where {where}), '')"

    return f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
c as ({" union all ".join(parts)}),
placed as (select *, sum(length(p) + length(m)) over (partition by doc_id, kind order by i) as e from c),
spans as (select doc_id, source, kind, v, e - length(m) as s, e from placed where kind <> 0 or length(v) >= 8),
owners as (select v, count(distinct coalesce(source, chr(1))) as n, count(distinct (coalesce(source, chr(1)), coalesce(doc_id, -1))) as repos from spans group by v),
judged as (select x.*, n >= {OWNERS} or repos >= {REPOS} as copied, not copied and regexp_matches(x.v, '[0-9]') and regexp_matches(x.v, '[A-Za-z]')
  and len(list_distinct(string_split(x.v, ''))) >= 8 and not regexp_matches(x.v, {_quoted(PLACEHOLDER)}) as live from spans x join owners using (v)),
kept as (select * from judged a where kind < {last} or (live and not exists (
  select 1 from judged b where b.doc_id = a.doc_id and b.kind < {last} and b.s < a.e and a.s < b.e))),
per as (select doc_id, {", ".join(f"count(*) filter (where kind = {k}) as n_{KINDS[k][0]}" for k in range(BASE))},
  {joined(f"kind < {BASE}")} as base, {joined("true")} as spans, count(*) filter (where copied) as n_example, count(*) filter (where live) as n_live from kept group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{KINDS[k][0]}, 0) as n_{KINDS[k][0]}" for k in range(BASE))}, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_example, 0) as n_example, coalesce(n_live, 0) as n_live
from d left join per using (doc_id)"""


def _chat() -> str:
    def escaped(col: str) -> str:
        out = f"replace({col}, '^', '^^')"
        for s in CONTROL:
            out = f"replace({out}, {_quoted(s)}, {_quoted(s[0] + '^' + s[1:])})"
        return out

    return f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r as (select *, row_number() over w as i, count(*) over (partition by conv_id) as n,
  sum({len("<|im_start|>")} + length(replace({escaped("role")}, chr(10), '^n')) + 1 + length({escaped("text")}) + {len("<|im_end|>") + 1}) over w as upto
  from c window w as (partition by conv_id order by turn, role, text rows unbounded preceding))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(upto) filter (where role = 'assistant' or i = n)::bigint as formatted_chars, count(*) filter (where role = 'assistant' or i = n) as n_examples
from r group by conv_id"""


def _rules() -> str:
    spaces = r"[ \x09-\x0D]"
    rates = []
    for name, _ in RULES:
        weight = f"greatest(1.0, least(1e6, case when v_{name} > 0 then m_{name} * (1 - m_{name}) / v_{name} - 1 else 1e6 end))"
        rates.append(f"(f_{name} + m_{name} * {weight}) / (docs + {weight})")
    return rf"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '{spaces}+'), lambda x: x <> '') as ws from d),
g as (select doc_id, len(ws) as n, unnest(range(1, len(ws) - 1)) as i, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) as x from w where len(ws) >= 3),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as k from g) where k >= 2),
covered as (select doc_id, count(distinct i + o)::bigint as n_repeat_words from twice, (select unnest([0, 1, 2]) as o) group by doc_id),
c as (select doc_id, source, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \x09-\x0D]')))) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words from w left join covered using (doc_id)),
h as (select source, count(*) as docs, {", ".join(f"sum(({rule})::int) as f_{name}" for name, rule in RULES)} from c group by source),
prior as (select {", ".join(f"avg(f_{name} / docs) as m_{name}, var_pop(f_{name} / docs) as v_{name}" for name, _ in RULES)} from h),
verdict as (select source, greatest({", ".join(rates)}) > {LIMIT} as host_failed from h, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({RULES[0][1]} or {RULES[1][1]}) as base_failed, host_failed,
  not ({RULES[0][1]} or {RULES[1][1]}) and not host_failed as kept
from c join verdict on c.source is not distinct from verdict.source"""


_JOIN = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [ws] else list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) end) as sh from w),
x as (select doc_id, len(sh) as n, unnest(sh) as t from s),
pairs as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as n1, any_value(b.n) as n2, count(*) as k from x a join x b on a.t = b.t and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs where 100 * k >= 75 * (n1 + n2 - k)),
edges as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from edges union select r.a, e.b from reach r join edges e on r.b = e.a)
select doc_id, len(sh) as n_shingles, least(doc_id, coalesce((select min(b) from reach where a = doc_id), doc_id)) as component_id from s"""


def _codes(rounds: int, entries: int) -> str:
    def nearest(t: int) -> str:
        return f"""
a{t} as materialized (select r, k, min((list_inner_product(c, c) - 2 * list_inner_product(x, c))::bigint * {entries} + e) as best from p join b{t} using (k) group by r, k),
n{t} as materialized (select r, k, x, pmod_e as e, ((best - pmod_e) // {entries} + list_inner_product(x, x))::bigint as d
  from (select *, ((best % {entries}) + {entries}) % {entries} as pmod_e from a{t}) join p using (r, k))"""

    steps = [nearest(0)]
    for t in range(1, rounds + 1):
        steps.append(f"""
m{t} as (select k, e, i, floor(sum(x[i]) / count(*)) as y from n{t - 1}, (select unnest(range(1, 1 + (select max(len(x)) from p))) as i) group by k, e, i),
b{t} as materialized (select k, e, coalesce(y, c) as c from b{t - 1} left join (select k, e, list(y order by i) as y from m{t} group by k, e) using (k, e))""")
        steps.append(nearest(t))
    last = f"{rounds}"
    return f"""
with v as materialized (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as z
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select r, k, z[k * (len(z) // 4) + 1:(k + 1) * (len(z) // 4)] as x from v, (select unnest(range(4)) as k)),
b0 as (select k, r - 1 as e, x as c from p where r <= {entries}),{",".join(steps)},
coded as (select r, string_agg(printf('%02x', e), '' order by k) as code, sum(d)::bigint as error from n{last} group by r),
out as (select vec_id, label, code, error from coded join v using (r)),
book as (select sha256(string_agg(array_to_string(list_transform(c, lambda x: x::bigint::varchar), ','), ',' order by k, e)) as h from b{last})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, h as codebooks_sha256 from out, book"""


_COPIES = """
select doc_id, max(doc_id) over c as keep_id, count(*) over c as group_size, doc_id = max(doc_id) over c as kept, sha256(coalesce(text, '')) as text_sha256
from documents window c as (partition by coalesce(text, ''))"""

ORACLE = {
    "op2_secret_scan": _secrets(),
    "op6_chat_formatting": _chat(),
    "op7_host_rules": _rules(),
    "op9_ngram_jaccard_join": _JOIN,
    "op12_vector_codes": _codes(ROUNDS, ENTRIES),
    "op13_radix_dedup": _COPIES,
}
