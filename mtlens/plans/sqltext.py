"""DuckDB SQL for the correctness oracle: fixture CTEs and text expressions.

The oracle side is written independently of the Spark plans (list
functions, self joins, recursive CTEs) so a match means more than a
transcription. Every statement is a single SELECT with CTEs.
"""

from __future__ import annotations

from ..functions.text import NEG_CONTRA, NEG_PARA, SIMILAR_CATEGORIES
from ..sources.fixtures import CATEGORIES, FX_ANTO, FX_NEG, ROW_STRIDE

WS = (
    r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def tokens_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def tokens_word(x: str) -> str:
    s = f"lower({x})"
    s = f"""regexp_replace({s}, '([;?!@#$%&*()\\[\\]{{}}<>"])', ' \\1 ', 'g')"""
    s = f"regexp_replace({s}, '([,:])([^0-9]|$)', ' \\1 \\2', 'g')"
    s = f"regexp_replace({s}, '(\\.\\.+|--)', ' \\1 ', 'g')"
    s = f"regexp_replace({s}, '([^.])\\.({WS}|$)', '\\1 .\\2', 'g')"
    return tokens_ws(s)


def neg_count(toks: str, words=FX_NEG) -> str:
    return f"len(list_filter({toks}, lambda t: list_contains({str_list(words)}, t)))"


def is_p(label: str = "label") -> str:
    return f"coalesce({strip(label)} = 'P', false)"


def is_np(label: str = "label") -> str:
    return f"coalesce({strip(label)} = 'NP', false)"


def unit(row_id: str, mult: int) -> str:
    return f"cast((({row_id} % 10007) * {mult}) % 10007 as double) / 10006"


CAT_LIST = str_list(CATEGORIES)

LINE_PAIRS = f"""
lp0 as (select doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lp1 as (select doc_id, source, lang, ls, unnest(generate_series(0, greatest(len(ls) - 2, 0))) as i from lp0),
lp as (select doc_id, source, lang, i, ls[i + 1] as ref, ls[least(i + 2, len(ls))] as mt from lp1)"""

FX_PAIRS = LINE_PAIRS + f""",
fx_pairs as (
  select p.doc_id * {ROW_STRIDE} + p.i as row_id,
         'doc' || cast(p.doc_id as varchar) as src, p.ref, p.mt, p.source as model,
         case when l.quality = 1 then case when p.i % 10 = 0 then ' P ' else 'P' end
              when l.quality = 0 then 'NP' end as label,
         {CAT_LIST}[((p.doc_id * {ROW_STRIDE} + p.i) % 17) + 1] as category,
         {unit('(p.doc_id * %d + p.i)' % ROW_STRIDE, 7919)} as m_comet,
         {unit('(p.doc_id * %d + p.i)' % ROW_STRIDE, 104729)} as m_bertscore,
         case when (p.doc_id * {ROW_STRIDE} + p.i) % 23 <> 0
              then {unit('(p.doc_id * %d + p.i)' % ROW_STRIDE, 1299709)} end as m_bleurt,
         cast(case (p.doc_id * {ROW_STRIDE} + p.i) % 5 when 0 then 0 when 1 then 1 end as integer) as d_rule,
         {unit('(p.doc_id * %d + p.i)' % ROW_STRIDE, 611953)} as d_contra,
         {unit('(p.doc_id * %d + p.i)' % ROW_STRIDE, 15485863)} as d_para
  from lp p left join labels l on l.doc_id = p.doc_id)"""

FX_HUMAN = """,
fx_human as (select ref, mt, cast(min(row_id % 26) as double) as human_score from fx_pairs group by ref, mt)"""

FX_ANTO_ROWS = "fx_anto_rows as (select * from (values " + ", ".join(
    f"({i}, {q(w)}, {q(a)})" for i, (w, a) in enumerate(FX_ANTO)
) + ") t(seq, word, antonym))"

# Bidirectional lexicon with positions: 2*seq for word->antonym, 2*seq+1 back.
FX_LEX = FX_ANTO_ROWS + """,
lex_e as (select trim(word) as word, trim(antonym) as antonym, 2 * seq as anto_pos from fx_anto_rows
          union all select trim(antonym), trim(word), 2 * seq + 1 from fx_anto_rows),
fx_lex as (select e.word, e.antonym, f.word_pos, e.anto_pos from lex_e e
           join (select word, min(anto_pos) as word_pos from lex_e group by word) f using (word))"""


def select_decision(d_rule="d_rule", d_contra="d_contra", d_para="d_para") -> str:
    return (f"case when {d_rule} is not null then cast({d_rule} as double) "
            f"when {d_contra} > 0.5 then {d_para} else {d_contra} end")


def adjust(s: str, d: str, tau: float = 0.6) -> str:
    t = repr(float(tau))
    moved = (f"case when {d} >= 0.5 and {s} < {t} then {t} + ({t} - {s}) * {d} "
             f"when {d} < 0.5 and {s} > {t} then {t} - ({s} - {t}) * (1.0 - {d}) else {s} end")
    return f"case when {s} is not null then greatest(0.0, least(1.0, {moved})) end"


FX_METRICS = ("m_comet", "m_bertscore", "m_bleurt")

EVALUATED = FX_PAIRS + """,
ev0 as (select *, """ + select_decision() + """ as d_score from fx_pairs),
ev as (select *, """ + ", ".join(f"round({adjust(m, 'd_score')}, 4) as {m}_adj" for m in FX_METRICS) + " from ev0)"

FX_SCORES = """
fx_scores as (select l_orderkey, l_linenumber, l_returnflag || l_linestatus as model,
  cast(l_discount * 10 as double) as m_disc, cast(l_tax * 12.5 as double) as m_tax,
  cast(l_quantity / 50 as double) as m_qty, cast(floor(l_extendedprice / 5000) as double) as human_score
  from lineitem)"""

FX_EVENTS = """
fx_events as (select event_type as model, cast(value as double) as x,
  cast(((event_id % 1000) * 7919) % 1000 as double) as y from events)"""


def macro_sql(n11="n11", n10="n10", n01="n01", n00="n00") -> dict[str, str]:
    def r(a, b):
        return f"(case when ({b}) > 0 then cast({a} as double) / ({b}) else 0.0 end)"

    p1, r1, f1 = r(n11, f"{n11} + {n01}"), r(n11, f"{n11} + {n10}"), r(f"2 * {n11}", f"2 * {n11} + {n01} + {n10}")
    p0, r0, f0 = r(n00, f"{n00} + {n10}"), r(n00, f"{n00} + {n01}"), r(f"2 * {n00}", f"2 * {n00} + {n01} + {n10}")
    h1 = f"({n11} + {n01} + {n10} > 0)"
    h0 = f"({n00} + {n10} + {n01} > 0)"
    k = f"(cast({h1} as int) + cast({h0} as int))"

    def avg(a, b):
        return (f"(case when {k} > 0 then ((case when {h1} then {a} else 0.0 end) + "
                f"(case when {h0} then {b} else 0.0 end)) / {k} else 0.0 end)")

    return {"precision": avg(p1, p0), "recall": avg(r1, r0), "f1": avg(f1, f0),
            "p1": p1, "r1": r1, "f1_1": f1, "p0": p0, "r0": r0, "f1_0": f0}


def pearson_sql(x: str, y: str) -> str:
    """Guarded Pearson as an aggregate over pairwise-complete rows (x, y already non-null filtered by FILTER)."""
    f = f"filter (where {x} is not null and {y} is not null)"
    ok = (f"count(*) {f} >= 2 and min({x}) {f} < max({x}) {f} and min({y}) {f} < max({y}) {f}")
    r = f"covar_pop({x}, {y}) {f} / (stddev_pop({x}) {f} * stddev_pop({y}) {f})"
    return f"case when {ok} then greatest(-1.0, least(1.0, {r})) end"


SIMILAR = str_list(SIMILAR_CATEGORIES)
NEG_C = NEG_CONTRA
NEG_P = NEG_PARA


# ---------------------------------------------------------------- n-gram metrics
P13A = r"[\x{20}-\x{26}\x{28}-\x{2B}\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}]"
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tok13a(x: str) -> str:
    s = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    s = f"replace(replace(replace(replace({s}, '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')"
    s = f"regexp_replace({s}, '({P13A})', ' \\1 ', 'g')"
    s = f"regexp_replace({s}, '([^0-9])([.,])', '\\1 \\2 ', 'g')"
    s = f"regexp_replace({s}, '([.,])([^0-9])', ' \\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return tokens_ws(s)


def chrf_words(x: str) -> str:
    pl = str_list(list(PUNCT))
    return (f"flatten(list_transform({tokens_ws(x)}, lambda w: case when length(w) = 1 then [w] "
            f"when list_contains({pl}, right(w, 1)) then [left(w, length(w) - 1), right(w, 1)] "
            f"when list_contains({pl}, left(w, 1)) then [left(w, 1), substring(w, 2)] else [w] end))")


def ngram_stats_sql(src: str, key: str, hyp: str, ref: str, kinds: str) -> str:
    """CTEs ending in ``st``: one row per key with {kind}{n}_{h,r,m} columns."""
    nows = lambda x: f"regexp_replace({x}, '{WS}+', '', 'g')"
    toks = (f"gtk as (select {key} as k, {tok13a(hyp)} as hb, {tok13a(ref)} as rb, {nows(hyp)} as hc, {nows(ref)} as rc, "
            f"{chrf_words(hyp)} as hw, {chrf_words(ref)} as rw from {src})")
    parts = []
    spec = {"b": (4, "hb", "rb", "w"), "c": (6, "hc", "rc", "c"), "w": (2, "hw", "rw", "w")}
    for kind in kinds:
        top, h, r, typ = spec[kind]
        for side, col in ((0, h), (1, r)):
            if typ == "w":
                expr = f"list_transform(generate_series(1, len({col}) - o.n + 1), lambda i: array_to_string({col}[i:i + o.n - 1], ' '))"
            else:
                expr = f"list_transform(generate_series(1, length({col}) - o.n + 1), lambda i: substring({col}, i, o.n))"
            parts.append(f"select k, '{kind}' as kind, o.n, {side} as side, unnest({expr}) as gram "
                         f"from gtk, (select unnest(generate_series(1, {top})) as n) o")
    grams = "gr as (" + " union all ".join(parts) + ")"
    cnt = ("gc as (select k, kind, n, gram, count(*) filter (where side = 0) as hc, "
           "count(*) filter (where side = 1) as rc from gr group by all)")
    ordc = "go as (select k, kind, n, sum(hc) as h, sum(rc) as r, sum(least(hc, rc)) as m from gc group by all)"
    cols = []
    for kind in kinds:
        top = spec[kind][0]
        for n in range(1, top + 1):
            for s in ("h", "r", "m"):
                cols.append(f"cast(coalesce(sum({s}) filter (where kind = '{kind}' and n = {n}), 0) as bigint) as {kind}{n}_{s}")
    st = f"st as (select t.k, {', '.join(cols)} from gtk t left join go using (k) group by t.k)"
    return ",\n".join([toks, grams, cnt, ordc, st])


def bleu_sql() -> str:
    eff = "least(4, b1_h)"
    terms, zeros = [], "0"
    for n in range(1, 5):
        zeros = f"({zeros} + case when b{n}_m = 0 and b{n}_h > 0 then 1 else 0 end)"
        p = (f"case when b{n}_m = 0 then 100.0 / (pow(2.0, {zeros}) * b{n}_h) "
             f"else 100.0 * b{n}_m / b{n}_h end")
        terms.append(f"case when {n} <= {eff} then ln({p}) else 0.0 end")
    bp = "case when b1_h >= b1_r then 1.0 when b1_h > 0 then exp(1.0 - b1_r / b1_h) else 0.0 end"
    score = (f"case when b1_m + b2_m + b3_m + b4_m > 0 and {eff} > 0 then {bp} * exp(({' + '.join(terms)}) / {eff}) "
             f"else 0.0 end")
    return f"round({score} / 100.0, 4)"


def chrf_sql(word_order: int = 0) -> str:
    names = [f"c{n}" for n in range(1, 7)] + [f"w{n}" for n in range(1, word_order + 1)]
    both = {p: f"({p}_h > 0 and {p}_r > 0)" for p in names}
    sp = " + ".join(f"case when {both[p]} then {p}_m / {p}_h else 0.0 end" for p in names)
    sr = " + ".join(f"case when {both[p]} then {p}_m / {p}_r else 0.0 end" for p in names)
    k = " + ".join(f"case when {both[p]} then 1 else 0 end" for p in names)
    ap = f"(case when ({k}) > 0 then ({sp}) / ({k}) else 0.0 end)"
    ar = f"(case when ({k}) > 0 then ({sr}) / ({k}) else 0.0 end)"
    return f"round(case when {ap} + {ar} > 0 then 5.0 * {ap} * {ar} / (4.0 * {ap} + {ar}) else 0.0 end, 4)"

FX_CORPUS = LINE_PAIRS + f""",
fx_corpus as (select doc_id * {ROW_STRIDE} + i as pair_id, ref as s1, mt as s2 from lp)"""
