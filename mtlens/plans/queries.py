"""Registered queries: one per operator, each (spark, sf_dir) -> DataFrame,
with the matching DuckDB oracle SQL in ``ORACLE``.

Doubles in query outputs are rounded to 6 decimals on both sides so the
order-insensitive value hash does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import adjust as A
from ..operators import report as R
from ..operators import rules
from ..sources import fixtures as fx
from . import sqltext as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_pairs + d_score + <metric>_adj: the table the reports read."""
    p = fx.pairs(spark, sf_dir).withColumn("d_score", A.select_decision())
    return A.adjust_all(p, fx.FX_METRICS)


def fx_lexicon(spark: SparkSession) -> DataFrame:
    return rules.antonym_lexicon(fx.antonym_table(spark))


# ---------------------------------------------------------------- text scalars

@register("tokens_ws", f"""with {S.FX_PAIRS}
select row_id, array_to_string({S.tokens_ws('ref')}, ' ') as ref_tokens,
       cast(len({S.tokens_ws('ref')}) as bigint) as n_ref,
       array_to_string({S.tokens_ws('mt')}, ' ') as mt_tokens,
       cast(len({S.tokens_ws('mt')}) as bigint) as n_mt
from fx_pairs""")
def q_tokens_ws(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    rt, mt = T.tokens_ws("ref"), T.tokens_ws("mt")
    return p.select("row_id", F.array_join(rt, " ").alias("ref_tokens"), F.size(rt).cast("bigint").alias("n_ref"),
                    F.array_join(mt, " ").alias("mt_tokens"), F.size(mt).cast("bigint").alias("n_mt"))


@register("tokens_word", f"""with {S.FX_PAIRS}
select row_id, array_to_string({S.tokens_word('ref')}, ' ') as ref_tokens,
       cast(len({S.tokens_word('ref')}) as bigint) as n_ref,
       array_to_string({S.tokens_word('mt')}, ' ') as mt_tokens,
       cast(len({S.tokens_word('mt')}) as bigint) as n_mt
from fx_pairs""")
def q_tokens_word(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    rt, mt = T.tokens_word("ref"), T.tokens_word("mt")
    return p.select("row_id", F.array_join(rt, " ").alias("ref_tokens"), F.size(rt).cast("bigint").alias("n_ref"),
                    F.array_join(mt, " ").alias("mt_tokens"), F.size(mt).cast("bigint").alias("n_mt"))


@register("neg_count", f"""with {S.FX_PAIRS}
select row_id, cast({S.neg_count(S.tokens_word('ref'))} as bigint) as n_ref,
       cast({S.neg_count(S.tokens_word('mt'))} as bigint) as n_mt
from fx_pairs""")
def q_neg_count(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return p.select("row_id", T.neg_count(T.tokens_word("ref"), fx.FX_NEG).cast("bigint").alias("n_ref"),
                    T.neg_count(T.tokens_word("mt"), fx.FX_NEG).cast("bigint").alias("n_mt"))


@register("neg_parity", f"""with {S.FX_PAIRS}
select row_id, cast(({S.neg_count(S.tokens_word('ref'))} + {S.neg_count(S.tokens_word('mt'))}) % 2 as double) as neg_parity
from fx_pairs""")
def q_neg_parity(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return p.select("row_id", T.neg_parity(T.tokens_word("ref"), T.tokens_word("mt"), fx.FX_NEG).alias("neg_parity"))


@register("encode_label", f"""with {S.FX_PAIRS}
select row_id, cast(case when {S.is_p()} then 0 else 1 end as integer) as y_contra,
       cast(case when {S.is_p()} then 1 else 0 end as integer) as y_para
from fx_pairs""")
def q_encode_label(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    e = R.encode_label("label")
    return p.select("row_id", e["y_contra"].alias("y_contra"), e["y_para"].alias("y_para"))


# ---------------------------------------------------------------- lexicon / rule

HITS_SQL = f"""with {S.FX_PAIRS}, {S.FX_LEX},
tk as (select row_id, {S.tokens_word('ref')} as rt, {S.tokens_word('mt')} as mtk from fx_pairs),
tn as (select *, {S.neg_count('rt')} as n_ref, {S.neg_count('mtk')} as n_mt from tk),
rw as (select row_id, rt, mtk, n_ref, n_mt, unnest(list_distinct(rt)) as word from tn),
hits as (
  select rw.row_id, rw.word, l.antonym, l.word_pos, l.anto_pos, rw.rt, rw.mtk, rw.n_ref, rw.n_mt
  from rw join fx_lex l on l.word = rw.word where list_contains(rw.mtk, l.antonym)),
adj as (
  select h.*,
    (list_position(mtk, antonym) is not null and
       len(list_filter(mtk[greatest(list_position(mtk, antonym) - 2, 1):list_position(mtk, antonym) - 1]
                       || mtk[list_position(mtk, antonym) + 1:list_position(mtk, antonym) + 2],
                       lambda t: list_contains({S.str_list(S.FX_NEG)}, t))) > 0)
    or (list_position(mtk, word) is not null and
       len(list_filter(mtk[greatest(list_position(mtk, word) - 2, 1):list_position(mtk, word) - 1]
                       || mtk[list_position(mtk, word) + 1:list_position(mtk, word) + 2],
                       lambda t: list_contains({S.str_list(S.FX_NEG)}, t))) > 0) as mt_has,
    (list_position(rt, word) is not null and
       len(list_filter(rt[greatest(list_position(rt, word) - 2, 1):list_position(rt, word) - 1]
                       || rt[list_position(rt, word) + 1:list_position(rt, word) + 2],
                       lambda t: list_contains({S.str_list(S.FX_NEG)}, t))) > 0)
    or (list_position(rt, antonym) is not null and
       len(list_filter(rt[greatest(list_position(rt, antonym) - 2, 1):list_position(rt, antonym) - 1]
                       || rt[list_position(rt, antonym) + 1:list_position(rt, antonym) + 2],
                       lambda t: list_contains({S.str_list(S.FX_NEG)}, t))) > 0) as ref_has,
    exists (select 1 from fx_lex x where x.word = h.word
            and list_contains(h.mtk, x.antonym) and list_contains(h.rt, x.antonym)) as cross_antonym
  from hits h),
hv as (select *, mt_has <> ref_has as neg_adjacent,
         cast(case when cross_antonym then 1 when n_mt = n_ref then 0 when mt_has <> ref_has then 1 end as integer) as v
       from adj)"""

# the same, words and antonyms also met by their lemmas
LEMMA_HITS_SQL = HITS_SQL.replace("tk as (", """dw as (select distinct w from (select unnest(""" + S.tokens_word("text") + """) as w from documents where text is not null) where length(w) >= 2),
lem as (select w as word, min(w) over (partition by left(w, 2)) as lemma from dw),
lx as (select l.*, coalesce(a.lemma, l.word) as wl, coalesce(b.lemma, l.antonym) as al
  from fx_lex l left join lem a on a.word = l.word left join lem b on b.word = l.antonym),
tk as (""", 1).replace("""  from rw join fx_lex l on l.word = rw.word where list_contains(rw.mtk, l.antonym)),""", """  from tn rw join lx l on (list_contains(rw.rt, l.word) or list_contains(rw.rt, l.wl)) and (list_contains(rw.mtk, l.antonym) or list_contains(rw.mtk, l.al))),""").replace(
    "select rw.row_id, rw.word, l.antonym", "select rw.row_id, l.word, l.antonym").replace(
    "and list_contains(h.mtk, x.antonym) and list_contains(h.rt, x.antonym))",
    "and list_contains(h.mtk, x.antonym) and list_contains(h.rt, x.antonym)\n            and len(list_filter((select list(y.antonym) from fx_lex y where y.word = x.antonym), lambda r: list_contains(h.rt, r))) > 0)")


def _hits(spark, sf_dir):
    return rules.antonym_hits(fx.pairs(spark, sf_dir), fx_lexicon(spark), fx.FX_NEG)


@register("antonym_hits", HITS_SQL + "\nselect row_id, word, antonym, cast(word_pos as bigint) as word_pos, "
          "cast(anto_pos as bigint) as anto_pos from hv")
def q_antonym_hits(spark, sf_dir):
    return _hits(spark, sf_dir).select("row_id", "word", "antonym", "word_pos", "anto_pos")


@register("neg_adjacent", HITS_SQL + "\nselect row_id, word, antonym, neg_adjacent from hv")
def q_neg_adjacent(spark, sf_dir):
    return _hits(spark, sf_dir).select("row_id", "word", "antonym", "neg_adjacent")


@register("cross_antonym", HITS_SQL + "\nselect row_id, word, antonym, cross_antonym from hv")
def q_cross_antonym(spark, sf_dir):
    return _hits(spark, sf_dir).select("row_id", "word", "antonym", "cross_antonym")


LAST_HIT_SQL = """,
last_hit as (select row_id, list(v order by word_pos, anto_pos)[-1] as hv from hv where v is not null group by row_id),
rule as (select t.row_id, cast(coalesce(lh.hv, case when t.n_mt <> t.n_ref then 0 end) as integer) as d_rule
         from tn t left join last_hit lh using (row_id))"""
RULE_SQL = HITS_SQL + LAST_HIT_SQL


@register("rule_decision", RULE_SQL + "\nselect row_id, d_rule from rule")
def q_rule_decision(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).drop("d_rule")
    return rules.rule_decision(p, fx_lexicon(spark), fx.FX_NEG).select("row_id", "d_rule")


@register("rule_decision_lemma", LEMMA_HITS_SQL + LAST_HIT_SQL + "\nselect row_id, d_rule from rule")
def q_rule_decision_lemma(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).drop("d_rule")
    return rules.rule_decision(p, fx_lexicon(spark), fx.FX_NEG, lemmas=fx.lemma_table(spark, sf_dir)).select("row_id", "d_rule")


# ---------------------------------------------------------------- cascade / adjust

@register("select_decision", f"""with {S.FX_PAIRS}
select row_id, round({S.select_decision()}, 6) as d_score from fx_pairs""")
def q_select_decision(spark, sf_dir):
    return fx.pairs(spark, sf_dir).select("row_id", r6(A.select_decision()).alias("d_score"))


@register("adjust_score", f"""with {S.FX_PAIRS}
select row_id, round({S.adjust('m_bleurt', S.select_decision())}, 6) as m_bleurt_adj from fx_pairs""")
def q_adjust_score(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return p.select("row_id", r6(A.adjust_score("m_bleurt", A.select_decision())).alias("m_bleurt_adj"))


@register("adjust_all", f"""with {S.EVALUATED}
select row_id, round(m_comet_adj, 6) as m_comet_adj, round(m_bertscore_adj, 6) as m_bertscore_adj,
       round(m_bleurt_adj, 6) as m_bleurt_adj from ev""")
def q_adjust_all(spark, sf_dir):
    return round_doubles(evaluated(spark, sf_dir).select("row_id", "m_comet_adj", "m_bertscore_adj", "m_bleurt_adj"))


@register("direction", f"""with {S.EVALUATED},
lg as (select row_id, 'm_comet' as metric, m_comet as raw, m_comet_adj as adj from ev
       union all select row_id, 'm_bertscore', m_bertscore, m_bertscore_adj from ev
       union all select row_id, 'm_bleurt', m_bleurt, m_bleurt_adj from ev)
select row_id, metric, case when adj > raw then 'reward' when adj < raw then 'penalty'
  when adj is not null and raw is not null then 'unchanged' end as direction from lg""")
def q_direction(spark, sf_dir):
    lg = R.long_scores(evaluated(spark, sf_dir), fx.FX_METRICS, keep=["row_id"])
    return lg.select("row_id", "metric", A.direction("raw", "adj").alias("direction"))


REFINE_SQL = RULE_SQL + """,
ref0 as (select p.row_id, r.d_rule, p.d_contra, p.d_para, p.m_comet, p.m_bertscore, p.m_bleurt,
         """ + S.select_decision("r.d_rule", "p.d_contra", "p.d_para") + """ as d_score
         from fx_pairs p join rule r using (row_id))
select row_id, d_rule, round(d_contra, 4) as d_contra, round(d_para, 4) as d_para, round(d_score, 4) as d_score,
  case when d_rule is not null then 'rule' when d_contra > 0.5 then 'paraphrase' else 'contradiction' end as stage_resolved,
  """ + ",\n  ".join(f"round({S.adjust(m, 'd_score')}, 4) as {m}_adj" for m in S.FX_METRICS) + " from ref0"


def refine_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pipeline import refine

    p = fx.pairs(spark, sf_dir).drop("d_rule")
    out = refine(p, fx_lexicon(spark), metrics=fx.FX_METRICS, negations=fx.FX_NEG)
    return out.select("row_id", "d_rule", "d_contra", "d_para", "d_score", "stage_resolved",
                      *[f"{m}_adj" for m in fx.FX_METRICS])


@register("refine", REFINE_SQL)
def q_refine(spark, sf_dir):
    return round_doubles(refine_fixture(spark, sf_dir))


# ---------------------------------------------------------------- reports

def _long_sql(with_adj=True) -> str:
    parts = []
    for m in S.FX_METRICS:
        parts.append(f"select row_id, label, '{m}' as metric, {m} as raw, {m}_adj as adj from ev")
    return "lg as (" + " union all ".join(parts) + ")"


@register("metric_means", f"""with {S.EVALUATED}, {_long_sql()}
select metric, round(avg(raw), 6) as mean_raw, round(avg(adj), 6) as mean_adj from lg group by metric""")
def q_metric_means(spark, sf_dir):
    return round_doubles(R.metric_means(evaluated(spark, sf_dir), fx.FX_METRICS))


@register("threshold_sweep", f"""with {S.FX_PAIRS},
rm as (select label, (coalesce(m_comet, 0) + coalesce(m_bertscore, 0) + coalesce(m_bleurt, 0))
          / nullif((m_comet is not null)::int + (m_bertscore is not null)::int + (m_bleurt is not null)::int, 0) as ms
       from fx_pairs),
taus as (select * from (values (0.5), (0.6), (0.7)) t(tau)),
acc as (select t.tau,
   case when count(*) filter (where {S.is_p()}) > 0 then
     cast(count(*) filter (where {S.is_p()} and ms > t.tau) as double) / count(*) filter (where {S.is_p()}) else 0.0 end as p_acc,
   case when count(*) filter (where {S.is_np()}) > 0 then
     cast(count(*) filter (where {S.is_np()} and ms <= t.tau) as double) / count(*) filter (where {S.is_np()}) else 0.0 end as np_acc
   from taus t, rm group by t.tau),
b as (select tau, p_acc, np_acc, (p_acc + np_acc) / 2 as bal_acc from acc)
select cast(tau as double) as tau, round(p_acc, 6) as p_acc, round(np_acc, 6) as np_acc, round(bal_acc, 6) as bal_acc,
  tau = (select min(tau) from b where bal_acc = (select max(bal_acc) from b)) as best from b""")
def q_threshold_sweep(spark, sf_dir):
    return round_doubles(R.threshold_sweep(fx.pairs(spark, sf_dir), fx.FX_METRICS))


def _conf_sql(t: str, p: str) -> str:
    return (f"count(*) filter (where ({t}) and ({p})) as n11, count(*) filter (where ({t}) and not ({p})) as n10, "
            f"count(*) filter (where not ({t}) and ({p})) as n01, count(*) filter (where not ({t}) and not ({p})) as n00")


_M = S.macro_sql()
_PRF_COLS = f"round({_M['precision']}, 6) as precision, round({_M['recall']}, 6) as recall, round({_M['f1']}, 6) as f1"


def _component_sql() -> str:
    rule = "coalesce(d_rule = 1, false)"
    contra = "not coalesce((1.0 - d_contra) >= 0.5, false)"
    para = "coalesce(d_para >= 0.5, false)"
    full = "coalesce(d_score >= 0.5, false)"
    comps = [
        ("Rule-Based", rule), ("Contra. Detection", contra), ("Paraphrase Detection", para),
        ("Rule + Contradiction", f"case when d_rule is not null then {rule} else {contra} end"),
        ("Rule + Paraphrase", f"case when d_rule is not null then {rule} else {para} end"),
        ("Full Framework", full),
    ]
    sel = " union all ".join(
        f"select '{n}' as component, {_conf_sql(S.is_p(), p)} from ev" for n, p in comps
    )
    return f"with {S.EVALUATED}, c as ({sel})\nselect component, {_PRF_COLS} from c"


@register("component_prf", _component_sql())
def q_component_prf(spark, sf_dir):
    return round_doubles(R.component_prf(evaluated(spark, sf_dir)))


@register("category_prf", f"""with {S.EVALUATED},
c as (select category, {_conf_sql(S.is_p(), 'coalesce(d_score >= 0.5, false)')}, count(*) as support from ev group by category
      union all
      select 'Macro Avg', {_conf_sql(S.is_p(), 'coalesce(d_score >= 0.5, false)')}, count(*) from ev)
select category, {_PRF_COLS}, cast(support as bigint) as support,
  case when category = 'Macro Avg' then null when list_contains({S.SIMILAR}, category) then 'P' else 'NP' end as grp
from c""")
def q_category_prf(spark, sf_dir):
    return round_doubles(R.category_prf(evaluated(spark, sf_dir)))


@register("classification_report", f"""with {S.EVALUATED},
c as (select {_conf_sql("coalesce(d_score >= 0.5, false)", "coalesce(d_para >= 0.5, false)")} from ev),
s as (select *, n11 + n10 as sup1, n00 + n01 as sup0, n11 + n10 + n00 + n01 as tot from c)
select '0' as "row", round({_M['p0']}, 6) as precision, round({_M['r0']}, 6) as recall, round({_M['f1_0']}, 6) as f1,
       cast(sup0 as bigint) as support from s
union all select '1', round({_M['p1']}, 6), round({_M['r1']}, 6), round({_M['f1_1']}, 6), cast(sup1 as bigint) from s
union all select 'accuracy', null, null, round(case when tot > 0 then cast(n11 + n00 as double) / tot else 0.0 end, 6),
       cast(tot as bigint) from s
union all select 'macro avg', round({_M['precision']}, 6), round({_M['recall']}, 6), round({_M['f1']}, 6), cast(tot as bigint) from s
union all select 'weighted avg',
  round(case when tot > 0 then ({_M['p1']} * sup1 + {_M['p0']} * sup0) / tot else 0.0 end, 6),
  round(case when tot > 0 then ({_M['r1']} * sup1 + {_M['r0']} * sup0) / tot else 0.0 end, 6),
  round(case when tot > 0 then ({_M['f1_1']} * sup1 + {_M['f1_0']} * sup0) / tot else 0.0 end, 6), cast(tot as bigint) from s""")
def q_classification_report(spark, sf_dir):
    ev = evaluated(spark, sf_dir)
    t = F.coalesce(F.col("d_score") >= 0.5, F.lit(False)).cast("int")
    p = F.coalesce(F.col("d_para") >= 0.5, F.lit(False)).cast("int")
    return round_doubles(R.classification_report(ev, t, p))


@register("good_score_pct", f"""with {S.EVALUATED}, {_long_sql()},
g as (select metric,
  case when count(*) filter (where {S.is_p()}) > 0 then 100.0 * count(*) filter (where {S.is_p()} and raw > 0.6)
       / count(*) filter (where {S.is_p()}) end as orig_p,
  case when count(*) filter (where {S.is_np()}) > 0 then 100.0 * count(*) filter (where {S.is_np()} and raw <= 0.6)
       / count(*) filter (where {S.is_np()}) end as orig_np,
  case when count(*) filter (where {S.is_p()}) > 0 then 100.0 * count(*) filter (where {S.is_p()} and adj > 0.6)
       / count(*) filter (where {S.is_p()}) end as adj_p,
  case when count(*) filter (where {S.is_np()}) > 0 then 100.0 * count(*) filter (where {S.is_np()} and adj <= 0.6)
       / count(*) filter (where {S.is_np()}) end as adj_np
  from lg group by metric)
select metric, round(orig_p, 6) as orig_p, round(orig_np, 6) as orig_np, round(adj_p, 6) as adj_p,
       round(adj_np, 6) as adj_np from g""")
def q_good_score_pct(spark, sf_dir):
    return round_doubles(R.good_score_pct(evaluated(spark, sf_dir), fx.FX_METRICS))


@register("label_pearson", f"""with {S.EVALUATED}, {_long_sql()},
z as (select metric, coalesce(raw, 0.0) as xr, coalesce(adj, 0.0) as xa,
        cast({S.is_p()} as double) as y, raw, adj, {S.is_p()} as isp, {S.is_np()} as isn from lg)
select metric, round({S.pearson_sql('xr', 'y')}, 6) as orig_corr, round({S.pearson_sql('xa', 'y')}, 6) as adj_corr,
  round(avg(raw) filter (where isp) - avg(raw) filter (where isn), 6) as orig_gap,
  round(avg(adj) filter (where isp) - avg(adj) filter (where isn), 6) as adj_gap
from z group by metric""")
def q_label_pearson(spark, sf_dir):
    return round_doubles(R.label_pearson(evaluated(spark, sf_dir), fx.FX_METRICS))


@register("human_join", f"""with {S.FX_PAIRS} {S.FX_HUMAN}
select p.row_id, h.human_score from fx_pairs p join fx_human h
  on p.ref is not distinct from h.ref and p.mt is not distinct from h.mt""")
def q_human_join(spark, sf_dir):
    return R.human_join(fx.pairs(spark, sf_dir), fx.human(spark, sf_dir)).select("row_id", "human_score")


@register("human_pearson", f"""with {S.EVALUATED} {S.FX_HUMAN}, {_long_sql()},
j as (select lg.*, h.human_score as h from lg join ev using (row_id)
      join fx_human h on ev.ref is not distinct from h.ref and ev.mt is not distinct from h.mt),
z as (select metric, coalesce(raw, 0.0) as xr, coalesce(adj, 0.0) as xa, h from j)
select metric, round({S.pearson_sql('xr', 'h')}, 6) as orig_r, round({S.pearson_sql('xa', 'h')}, 6) as adj_r,
  cast(count(*) as bigint) as n from z group by metric""")
def q_human_pearson(spark, sf_dir):
    return round_doubles(R.human_pearson(evaluated(spark, sf_dir), fx.human(spark, sf_dir), fx.FX_METRICS))


@register("class_weights", f"""with {S.FX_PAIRS},
c as (select cast(case when {S.is_p()} then 1 else 0 end as integer) as y, cast(count(*) as bigint) as n
      from fx_pairs group by 1)
select y, n, round(cast((select sum(n) from c) as double) / n, 6) as weight,
  round(greatest(1.0, cast((select sum(n) from c where y = 0) as double) / nullif((select sum(n) from c where y = 1), 0)), 6)
    as pos_weight
from c""")
def q_class_weights(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).select(R.encode_label("label")["y_para"].alias("y"))
    return round_doubles(R.class_weights(p, "y"))


# ---------------------------------------------------------------- n-gram metrics
from ..operators import learn as LE  # noqa: E402
from ..operators import ngram as NG  # noqa: E402


NGRAM_METHOD = "vectorized"


def _metric_query(col: str, **kw):
    def run(spark, sf_dir):
        p = fx.pairs(spark, sf_dir).select("row_id", "ref", "mt")
        return NG.sentence_metrics(p, "row_id", "mt", "ref", method=NGRAM_METHOD, **kw).select("row_id", col)

    return run


register("sentence_bleu", f"""with {S.FX_PAIRS}, {S.ngram_stats_sql('fx_pairs', 'row_id', 'mt', 'ref', 'b')}
select k as row_id, {S.bleu_sql()} as BLEU from st""")(_metric_query("BLEU", bleu="BLEU", chrf=None, chrfpp=None))
register("sentence_chrf", f"""with {S.FX_PAIRS}, {S.ngram_stats_sql('fx_pairs', 'row_id', 'mt', 'ref', 'c')}
select k as row_id, {S.chrf_sql(0)} as ChrF from st""")(_metric_query("ChrF", bleu=None, chrf="ChrF", chrfpp=None))
register("sentence_chrfpp", f"""with {S.FX_PAIRS}, {S.ngram_stats_sql('fx_pairs', 'row_id', 'mt', 'ref', 'cw')}
select k as row_id, {S.chrf_sql(2)} as "ChrF++" from st""")(_metric_query("ChrF++", bleu=None, chrf=None, chrfpp="ChrF++"))


OVERLAP_SCORE_SQL = f"""round(greatest(0.0, least(1.0,
  len(list_distinct(list_filter(list_distinct({S.tokens_ws('mt')}), lambda t: list_contains({S.tokens_ws('ref')}, t))))
  / greatest(len(list_distinct({S.tokens_ws('mt')})), len(list_distinct({S.tokens_ws('ref')})), 1))), 4)"""

COMPUTED = ("BLEU", "ChrF", "ChrF++")
# the SQL rounds a double's shortest digits, as Spark does; a product with 10,000 would move some across the half


def _adjusted(m: str) -> str:
    adjusted = S.adjust(f'"{m}"', "d_score")
    return f"""\"{m}\", cast(round(cast(cast({adjusted} as varchar) as decimal(30, 22)), 4) as double) as \"{m}_adj\" """


@register("refine_metrics", RULE_SQL + ",\n" + S.ngram_stats_sql("fx_pairs", "row_id", "mt", "ref", "bcw") + f""",
sc as (select k as row_id, {S.bleu_sql()} as "BLEU", {S.chrf_sql(0)} as "ChrF", {S.chrf_sql(2)} as "ChrF++" from st),
ov as (select row_id, {OVERLAP_SCORE_SQL} as score from fx_pairs),
ref0 as (select p.row_id, r.d_rule, case when r.d_rule is null then 1 - ov.score end as d_contra, case when r.d_rule is null then ov.score end as d_para, sc.* exclude (row_id)
  from fx_pairs p join rule r using (row_id) join sc using (row_id) join ov using (row_id)),
ref1 as (select *, {S.select_decision()} as d_score from ref0)
select row_id, d_rule, round(d_contra, 4) as d_contra, round(d_para, 4) as d_para, round(d_score, 4) as d_score,
  case when d_rule is not null then 'rule' when d_contra > 0.5 then 'paraphrase' else 'contradiction' end as stage_resolved,
  """ + ",\n  ".join(map(_adjusted, COMPUTED)) + " from ref1")
def q_refine_metrics(spark, sf_dir):
    """The whole evaluation in one run: computed metrics, models on the rows that the rule leaves open, refined scores."""
    from .pipeline import refine

    pairs = fx.pairs(spark, sf_dir).select("row_id", "ref", "mt")
    scored = NG.sentence_metrics(pairs, "row_id", "mt", "ref", *COMPUTED, method=NGRAM_METHOD)

    def overlap(still: Column) -> Column:
        return LE.score_with_model(LE.overlap_scorer, "mt", "ref", only=still)

    scorers = {"d_contra": lambda still: 1 - overlap(still), "d_para": overlap}
    out = refine(scored, fx_lexicon(spark), COMPUTED, fx.FX_NEG, lean=True, scorers=scorers)
    columns = [c for m in COMPUTED for c in (m, f"{m}_adj")]
    return round_doubles(out.select("row_id", "d_rule", "d_contra", "d_para", "d_score", "stage_resolved", *columns))


# ---------------------------------------------------------------- correlation
from ..operators import corr as C  # noqa: E402

SC_METRICS = ("m_disc", "m_tax", "m_qty")


def _kendall_cells_sql(src: str, g: str, x: str, y: str) -> str:
    """CTEs ending in ``kt(g, kendall_tau, n)``: tau-b by a self join on weighted cells."""
    return f"""kc as (select {g} as g, {x} as x, {y} as y, count(*) as w from {src}
         where {x} is not null and {y} is not null and not isnan({x}) and not isnan({y}) group by all),
kd as (select a.g, sum(cast(a.w as hugeint) * b.w) as d from kc a join kc b on a.g = b.g and a.x < b.x and a.y > b.y group by a.g),
k1 as (select g, sum(cast(t as hugeint) * (t - 1) / 2) as n1, count(*) as nx from (select g, x, sum(w) as t from kc group by all) group by g),
k2 as (select g, sum(cast(t as hugeint) * (t - 1) / 2) as n2, count(*) as ny from (select g, y, sum(w) as t from kc group by all) group by g),
k3 as (select g, sum(w) as n, sum(cast(w as hugeint) * (w - 1) / 2) as n3 from kc group by g),
kt as (select g, case when n >= 2 and nx > 1 and ny > 1 then
   greatest(-1.0, least(1.0, cast(cast(n as hugeint) * (n - 1) / 2 - n1 - n2 + n3 - 2 * coalesce(d, 0) as double)
     / sqrt(cast(cast(n as hugeint) * (n - 1) / 2 - n1 as double) * cast(cast(n as hugeint) * (n - 1) / 2 - n2 as double)))) end
   as kendall_tau, n
   from k3 join k1 using (g) join k2 using (g) left join kd using (g))"""


def _long_sql_scores(src: str, metrics, human: str, extra: str = "") -> str:
    parts = [f"select {extra}'{m}' as metric, cast({m} as double) as x, cast({human} as double) as y from {src}" for m in metrics]
    return "ln as (" + " union all ".join(parts) + ")"


def _corr_sql(src: str, metrics, human: str, digits: int) -> str:
    """CTEs ending in ``cr(metric, pearson, kendall_tau, n)``."""
    return f"""{_long_sql_scores(src, metrics, human)},
pr as (select metric, {S.pearson_sql('x', 'y')} as pearson,
       cast(count(*) filter (where x is not null and y is not null) as bigint) as n from ln group by metric),
{_kendall_cells_sql('ln', 'metric', 'x', 'y')},
cr as (select pr.metric, round(pr.pearson, {digits}) as pearson,
       case when pr.pearson is not null then round(kt.kendall_tau, {digits}) end as kendall_tau, pr.n
       from pr left join kt on kt.g = pr.metric)"""


@register("pearson", f"""with {S.FX_SCORES}, {_long_sql_scores('fx_scores', SC_METRICS, 'human_score')}
select metric, round({S.pearson_sql('x', 'y')}, 6) as pearson,
  cast(count(*) filter (where x is not null and y is not null) as bigint) as n from ln group by metric""")
def q_pearson(spark, sf_dir):
    from ..operators.stats import pair_count, safe_pearson

    lg = C.long_pairs(fx.scores(spark, sf_dir), SC_METRICS, "human_score")
    return round_doubles(lg.groupBy("metric").agg(safe_pearson("x", "y").alias("pearson"),
                                                  pair_count("x", "y").cast("bigint").alias("n")))


@register("kendall_tau_b", f"""with {S.FX_EVENTS}, {_kendall_cells_sql('fx_events', 'model', 'x', 'y')}
select g as model, round(kendall_tau, 6) as kendall_tau, cast(n as bigint) as n from kt""")
def q_kendall(spark, sf_dir):
    return round_doubles(C.kendall_tau_b(fx.events(spark, sf_dir), "x", "y", ["model"]))


@register("segment_corr", f"""with {S.FX_SCORES}, {_corr_sql('fx_scores', SC_METRICS, 'human_score', 3)}
select metric, pearson, kendall_tau, n from cr""")
def q_segment_corr(spark, sf_dir):
    return round_doubles(C.segment_corr(fx.scores(spark, sf_dir), SC_METRICS, "human_score"))


@register("system_means", f"""with {S.FX_SCORES}
select model, round(avg(m_disc), 6) as m_disc, round(avg(m_tax), 6) as m_tax, round(avg(m_qty), 6) as m_qty,
  round(avg(human_score), 6) as human_score from fx_scores where model is not null group by model""")
def q_system_means(spark, sf_dir):
    return round_doubles(C.system_means(fx.scores(spark, sf_dir), SC_METRICS, "human_score"))


_SYS_MEANS_SQL = """sm as (select model, avg(m_disc) as m_disc, avg(m_tax) as m_tax, avg(m_qty) as m_qty,
  avg(human_score) as human_score from fx_scores where model is not null group by model)"""


@register("system_corr", f"""with {S.FX_SCORES}, {_SYS_MEANS_SQL}, {_corr_sql('sm', SC_METRICS, 'human_score', 3)}
select metric, pearson, kendall_tau, n from cr""")
def q_system_corr(spark, sf_dir):
    return round_doubles(C.system_corr(fx.scores(spark, sf_dir), SC_METRICS, "human_score"))


@register("corr_table", f"""with {S.FX_SCORES}, {_SYS_MEANS_SQL},
seg as (select * from (with {_corr_sql('fx_scores', SC_METRICS, 'human_score', 4)} select * from cr)),
sys as (select * from (with {_corr_sql('sm', SC_METRICS, 'human_score', 4)} select * from cr))
select 'segment' as level, metric, 'human_score' as human, n, pearson, kendall_tau from seg
union all select 'system', metric, 'human_score', n, pearson, kendall_tau from sys""")
def q_corr_table(spark, sf_dir):
    return round_doubles(C.corr_table(fx.scores(spark, sf_dir), SC_METRICS, "human_score"))


# ---------------------------------------------------------------- pair features
from ..operators import corpus as CO  # noqa: E402
from ..operators import features as FE  # noqa: E402
from ..operators import folds as FO  # noqa: E402
from ..operators import selection as SL  # noqa: E402
from ..operators import sets as SE  # noqa: E402
from ..operators import vectors as VE  # noqa: E402
from ..sources import io as IO  # noqa: E402


def _ints(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


OVERLAP_SQL = f"""with {S.FX_PAIRS},
tk as (select row_id, {S.tokens_word('mt')} as t1, {S.tokens_word('ref')} as t2 from fx_pairs),
cm as (select *, list_distinct(list_filter(t1, lambda t: list_contains(t2, t))) as common from tk),
ov as (select row_id, t1, t2, common,
  list_filter(list_transform(generate_series(1, len(t1)), lambda i: case when list_contains(common, t1[i]) then i - 1 else -1 end), lambda x: x >= 0) as pos1,
  list_filter(list_transform(generate_series(1, len(t2)), lambda i: case when list_contains(common, t2[i]) then i - 1 else -1 end), lambda x: x >= 0) as pos2,
  list_filter(t1, lambda t: not list_contains(common, t)) as un1,
  list_filter(t2, lambda t: not list_contains(common, t)) as un2 from cm)"""


@register("token_overlap", OVERLAP_SQL + """
select row_id, cast(len(common) as bigint) as n_common, array_to_string(pos1, ' ') as pos1, array_to_string(pos2, ' ') as pos2,
  array_to_string(un1, ' ') as un1, array_to_string(un2, ' ') as un2 from ov""")
def q_token_overlap(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).select("row_id", T.tokens_word("mt").alias("t1"), T.tokens_word("ref").alias("t2"))
    o = FE.token_overlap(p, "t1", "t2")
    return o.select("row_id", F.size("common").cast("bigint").alias("n_common"), _ints(F.col("pos1")).alias("pos1"),
                    _ints(F.col("pos2")).alias("pos2"), F.array_join("un1", " ").alias("un1"),
                    F.array_join("un2", " ").alias("un2"))


@register("contra_features", OVERLAP_SQL + f"""
select row_id, cast(({S.neg_count('t1')} + {S.neg_count('t2')}) % 2 as double) as f_neg,
  round(case when len(pos1) > 0 and len(pos1) = len(pos2) then
     list_sum(list_transform(generate_series(1, len(pos1)), lambda i: abs(pos1[i] - pos2[i]))) / len(pos1) else 0.0 end, 6) as f_wod,
  round((len(un1) + len(un2)) / 2.0, 6) as f_unaligned from ov""")
def q_contra_features(spark, sf_dir):
    p = FE.contra_features(fx.pairs(spark, sf_dir), negations=fx.FX_NEG)
    f = F.col("contra_f")
    return round_doubles(p.select("row_id", f[0].alias("f_neg"), f[1].alias("f_wod"), f[2].alias("f_unaligned")))


@register("para_features", f"""with {S.FX_PAIRS}, {S.FX_LEX},
tk as (select row_id, {S.tokens_ws('mt')} as t1, {S.tokens_ws('ref')} as t2 from fx_pairs),
am as (select word, list(antonym) as antos from fx_lex group by word),
j0 as (select row_id, t1, t2, array_to_string(t1, ' ') as j1, array_to_string(t2, ' ') as j2 from tk),
j1 as (select *, list_distinct(regexp_extract_all(j1 || j2, '(?s).')) as al from j0),
j as (select *, array_to_string(al, '') as al_from,
        array_to_string(list_transform(generate_series(1, len(al)), lambda i: chr(cast(i as integer))), '') as al_to from j1),
an as (select u.row_id, count(*) as hits from (select row_id, t2, unnest(t1) as w from j) u
       join am on am.word = u.w where len(list_filter(am.antos, lambda a: list_contains(u.t2, a))) > 0 group by u.row_id)
select j.row_id,
  round(len(list_distinct(list_filter(t1, lambda t: list_contains(t2, t)))) / greatest(len(t1), len(t2), 1), 6) as overlap,
  round(1.0 - levenshtein(translate(j1, al_from, al_to), translate(j2, al_from, al_to)) / greatest(length(j1), length(j2), 1), 6) as ed_sim,
  cast((len(list_filter(t1, lambda t: list_contains({S.str_list(fx.FX_NEG)}, t))) > 0)
       <> (len(list_filter(t2, lambda t: list_contains({S.str_list(fx.FX_NEG)}, t))) > 0) as double) as neg_diff,
  round(coalesce(an.hits, 0) / greatest(len(t1), 1), 6) as ant_ratio
from j left join an using (row_id)""")
def q_para_features(spark, sf_dir):
    p = FE.para_features(fx.pairs(spark, sf_dir), fx_lexicon(spark), negations=fx.FX_NEG)
    f = F.col("para_f")
    return round_doubles(p.select("row_id", f[0].alias("overlap"), f[1].alias("ed_sim"), f[2].alias("neg_diff"),
                                  f[3].alias("ant_ratio")))


@register("score_with_model", f"with {S.FX_PAIRS}\nselect row_id, {OVERLAP_SCORE_SQL} as score from fx_pairs")
def q_score_with_model(spark, sf_dir):
    p = fx.pairs(spark, sf_dir)
    return p.select("row_id", LE.score_with_model(LE.overlap_scorer, "mt", "ref").alias("score"))


# ---------------------------------------------------------------- corpus / vocabulary

def corpus(spark, sf_dir) -> DataFrame:
    lp = fx.line_pairs(spark, sf_dir)
    return lp.select((F.col("doc_id") * fx.ROW_STRIDE + F.col("i")).alias("pair_id"),
                     F.col("ref").alias("s1"), F.col("mt").alias("s2"))


CLEAN_SQL = f"""{S.FX_CORPUS},
ln as (select pair_id, s1 || chr(9) || s2 as line from fx_corpus),
cl as (select pair_id, string_split({S.strip('line')}, chr(9)) as parts, line from ln
       where {S.strip('line')} <> '' and len(string_split({S.strip('line')}, chr(9))) >= 2),
cp as (select pair_id, {S.strip('parts[1]')} as s1, {S.strip('parts[2]')} as s2 from cl),
pp as (select pair_id, s1, s2 from cp where len({S.tokens_ws('s1')}) <= 7 and len({S.tokens_ws('s2')}) <= 7)"""


@register("length_filter", f"""with {S.FX_CORPUS}
select pair_id, s1, s2 from fx_corpus where len({S.tokens_ws('s1')}) <= 7 and len({S.tokens_ws('s2')}) <= 7""")
def q_length_filter(spark, sf_dir):
    return CO.length_filter(corpus(spark, sf_dir))


@register("paraphrase_pairs", f"with {CLEAN_SQL}\nselect pair_id, s1, s2, 1 as label from pp")
def q_paraphrase_pairs(spark, sf_dir):
    return CO.paraphrase_pairs(CO.pair_lines(corpus(spark, sf_dir))).select(
        "pair_id", "s1", "s2", F.col("label").cast("int").alias("label"))


@register("contradiction_pairs", f"""with {CLEAN_SQL}, {S.FX_LEX},
best as (select word, min(antonym) as ant from fx_lex group by word),
tk as (select pair_id, s1, s2, {S.tokens_ws('s1')} as a, {S.tokens_ws('s2')} as b from pp),
lx as (select list(word) as ws from best),
ix as (select tk.*,
  list_position(list_transform(a, lambda t: list_contains(lx.ws, lower(t))), true) as ia,
  list_position(list_transform(b, lambda t: list_contains(lx.ws, lower(t))), true) as ib from tk, lx)
select pair_id,
  case when ia is not null then array_to_string(a[1:ia - 1] || [(select ant from best where word = lower(a[ia]))] || a[ia + 1:], ' ')
       else array_to_string(b[1:ib - 1] || [(select ant from best where word = lower(b[ib]))] || b[ib + 1:], ' ') end as s1,
  case when ia is not null then s2 else s1 end as s2,
  0 as label
from ix where ia is not null or ib is not null""")
def q_contradiction_pairs(spark, sf_dir):
    pp = CO.paraphrase_pairs(CO.pair_lines(corpus(spark, sf_dir)))
    return CO.contradiction_pairs(pp, fx_lexicon(spark)).select(
        "pair_id", "s1", "s2", F.col("label").cast("int").alias("label"))


VOCAB_SQL = f"""{S.FX_CORPUS},
words as (select word from (select distinct unnest({S.tokens_ws('s1')}) as word from fx_corpus
          union select distinct unnest({S.tokens_ws('s2')}) from fx_corpus) where word not in ('<PAD>', '<UNK>')),
vocab as (select '<PAD>' as word, 0 as idx union all select '<UNK>', 1
          union all select word, cast(row_number() over (order by word) + 1 as bigint) from words)"""


@register("build_vocab", f"with {VOCAB_SQL}\nselect word, cast(idx as bigint) as idx from vocab")
def q_build_vocab(spark, sf_dir):
    return CO.build_vocab(corpus(spark, sf_dir))


@register("encode_tokens", OVERLAP_SQL + f""",
words as (select word from (select distinct unnest({S.tokens_ws('ref')}) as word from fx_pairs
          union select distinct unnest({S.tokens_ws('mt')}) from fx_pairs) where word not in ('<PAD>', '<UNK>')),
vocab as (select '<PAD>' as word, 0 as idx union all select '<UNK>', 1
          union all select word, cast(row_number() over (order by word) + 1 as bigint) from words),
seqs as (select row_id, 't1' as seq, t1 as toks from ov union all select row_id, 't2', t2 from ov
         union all select row_id, 'u1', un1 from ov union all select row_id, 'u2', un2 from ov),
ex as (select row_id, seq, unnest(generate_series(1, least(len(toks), 70))) as pos, toks from seqs),
en as (select ex.row_id, ex.seq, list(coalesce(v.idx, 1) order by ex.pos) as ids
       from ex left join vocab v on v.word = ex.toks[ex.pos] group by ex.row_id, ex.seq),
al as (select s.row_id, s.seq, coalesce(en.ids, []) as ids from seqs s left join en using (row_id, seq))
select row_id, seq, array_to_string(list_concat(ids, list_transform(generate_series(1, 70 - len(ids)), lambda x: 0)), ' ') as ids
from al""")
def q_encode_tokens(spark, sf_dir):
    vocab = CO.build_vocab(corpus(spark, sf_dir))
    p = fx.pairs(spark, sf_dir).select("row_id", T.tokens_word("mt").alias("t1"), T.tokens_word("ref").alias("t2"))
    o = FE.token_overlap(p, "t1", "t2")
    enc = CO.encode_tokens(o, vocab, "row_id", {"t1": F.col("t1"), "t2": F.col("t2"), "u1": F.col("un1"),
                                                "u2": F.col("un2")})
    return enc.select("row_id", "seq", _ints(F.col("ids")).alias("ids"))


# ---------------------------------------------------------------- vectors

PIECES_SQL = """fx_pieces as (select 'w' || cast(vec_id // 5 as varchar) as word, cast(vec_id % 5 as integer) as pos,
  embedding as vec from embeddings),
pool as (select word, d.dim, avg(vec[d.dim]) as value from fx_pieces, (select unnest(generate_series(1, 64)) as dim) d
  where pos > 0 and pos < 4 group by word, d.dim)"""


@register("mean_pool", f"""with {PIECES_SQL}
select word, cast(dim as bigint) as dim, round(value, 6) as value from pool""")
def q_mean_pool(spark, sf_dir):
    pooled = VE.mean_pool(fx.pieces(spark, sf_dir))
    return round_doubles(pooled.select("word", F.posexplode("vec").alias("dim", "value")).select(
        "word", (F.col("dim") + 1).cast("bigint").alias("dim"), "value"))


@register("reduce_dims")
def q_reduce_dims(spark, sf_dir):
    pooled = VE.mean_pool(fx.pieces(spark, sf_dir))
    red = VE.reduce_dims(pooled, 8)
    return round_doubles(red.select("word", F.posexplode("vec_k").alias("dim", "value")))


@register("embedding_table", f"""with {PIECES_SQL},
vocab as (select '<PAD>' as word, 0 as idx union all select '<UNK>', 1
          union all select word, row_number() over (order by word) + 1 from (select distinct word from fx_pieces)),
unk as (select unnest(generate_series(1, 64)) as dim)
select cast(0 as bigint) as idx, '<PAD>' as word, cast(dim as bigint) as dim, 0.0 as value from unk
union all select 1, '<UNK>', dim, round((((1 + dim - 1) * 7919) % 10007) / 10006 * 0.5 - 0.25, 6) from unk
union all select v.idx, v.word, p.dim, round(p.value, 6) from vocab v join pool p using (word)""")
def q_embedding_table(spark, sf_dir):
    pieces = fx.pieces(spark, sf_dir)
    pooled = VE.mean_pool(pieces)
    vocab = CO.build_vocab(pieces.select(F.col("word").alias("s1")), cols=("s1",))
    tab = VE.embedding_table(vocab, pooled, 64)
    return round_doubles(tab.select("idx", "word", F.posexplode("vec").alias("dim", "value")).select(
        F.col("idx").cast("bigint").alias("idx"), "word", (F.col("dim") + 1).cast("bigint").alias("dim"), "value"))


# ---------------------------------------------------------------- folds

def folded(spark, sf_dir) -> DataFrame:
    return FO.group_kfold(fx.pairs(spark, sf_dir), "src", 3)


FOLDS_SQL = f"""{S.FX_PAIRS},
gs as (select src, count(*) as sz from fx_pairs group by src),
go as (select src, sz, row_number() over (order by sz desc, src) as rn from gs),
walk as (
  select 0::bigint as rn, -1 as f, 0::bigint as l0, 0::bigint as l1, 0::bigint as l2
  union all
  select w.rn + 1,
    case when w.l0 <= w.l1 and w.l0 <= w.l2 then 0 when w.l1 <= w.l2 then 1 else 2 end,
    w.l0 + case when w.l0 <= w.l1 and w.l0 <= w.l2 then g.sz else 0 end,
    w.l1 + case when not (w.l0 <= w.l1 and w.l0 <= w.l2) and w.l1 <= w.l2 then g.sz else 0 end,
    w.l2 + case when not (w.l0 <= w.l1 and w.l0 <= w.l2) and not (w.l1 <= w.l2) then g.sz else 0 end
  from walk w join go g on g.rn = w.rn + 1),
gf as (select g.src, w.f + 1 as fold from go g join walk w on w.rn = g.rn),
fp as (select p.*, gf.fold from fx_pairs p join gf using (src))"""


@register("group_kfold", f"with recursive {FOLDS_SQL}\nselect row_id, cast(fold as integer) as fold from fp")
def q_group_kfold(spark, sf_dir):
    return folded(spark, sf_dir).select("row_id", F.col("fold").cast("int").alias("fold"))


@register("fold_split", f"""with recursive {FOLDS_SQL}
select cast(s.k as integer) as split_fold, case when s.k = fp.fold then 'val' else 'train' end as role, fp.row_id
from fp, (select unnest([1, 2, 3]) as k) s""")
def q_fold_split(spark, sf_dir):
    return FO.fold_split(folded(spark, sf_dir)).select(F.col("split_fold").cast("int").alias("split_fold"), "role", "row_id")


@register("oof_scores", f"""with recursive {FOLDS_SQL},
best as (select src, mt, ref, list(d_para order by fold, row_id)[-1] as oof_score from fp group by src, mt, ref)
select p.row_id, round(b.oof_score, 6) as oof_score from fp p join best b
  on p.src is not distinct from b.src and p.mt is not distinct from b.mt and p.ref is not distinct from b.ref""")
def q_oof_scores(spark, sf_dir):
    fp = folded(spark, sf_dir)
    val = fp.select("src", "mt", "ref", "fold", F.col("row_id").alias("row"), F.col("d_para").alias("score"))
    return round_doubles(FO.oof_scores(fp, val).select("row_id", "oof_score"))


@register("pick_best", f"""with recursive {FOLDS_SQL},
rm as (select fold, label, (coalesce(m_comet, 0) + coalesce(m_bertscore, 0) + coalesce(m_bleurt, 0))
          / nullif((m_comet is not null)::int + (m_bertscore is not null)::int + (m_bleurt is not null)::int, 0) as ms
       from fp),
runs as (select fold, t.tau, t.ord,
   (case when count(*) filter (where {S.is_p()}) > 0 then
     cast(count(*) filter (where {S.is_p()} and ms > t.tau) as double) / count(*) filter (where {S.is_p()}) else 0.0 end +
    case when count(*) filter (where {S.is_np()}) > 0 then
     cast(count(*) filter (where {S.is_np()} and ms <= t.tau) as double) / count(*) filter (where {S.is_np()}) else 0.0 end) / 2
   as bal_acc
   from rm, (select * from (values (0.5, 0), (0.6, 1), (0.7, 2)) v(tau, ord)) t group by fold, t.tau, t.ord)
select cast(fold as integer) as fold, cast(arg_max(tau, bal_acc * 10 - ord * 1e-9) as double) as best_tau,
  round(max(bal_acc), 6) as best_bal_acc from runs group by fold""")
def q_pick_best(spark, sf_dir):
    fp = folded(spark, sf_dir).persist()
    runs = None
    for i in (1, 2, 3):
        sw = R.threshold_sweep(FO.val_split(fp, i), fx.FX_METRICS).select(
            F.lit(i).alias("fold"), "tau", "bal_acc", ((F.col("tau") * 10).cast("int")).alias("ord"))
        runs = sw if runs is None else runs.unionByName(sw)
    best = FO.pick_best(runs, "tau", "bal_acc", "ord", ["fold"])
    return round_doubles(best.select(F.col("fold").cast("int").alias("fold"), F.col("best_tau").cast("double"),
                                     "best_bal_acc"))


@register("reduce_dims_norms", f"""with {PIECES_SQL},
mu as (select dim, avg(value) as m from pool group by dim)
select word, round(sum((value - m) * (value - m)), 6) as norm2 from pool join mu using (dim) group by word""")
def q_reduce_dims_norms(spark, sf_dir):
    """At full rank the projection keeps the length of every centred vector, whatever the signs."""
    red = VE.reduce_dims(VE.mean_pool(fx.pieces(spark, sf_dir)), 64)
    norm = F.aggregate("vec_k", F.lit(0.0), lambda acc, v: acc + v * v)
    return round_doubles(red.select("word", norm.alias("norm2")))


@register("fold_class_weights", f"""with recursive {FOLDS_SQL},
lab as (select fold, case when {S.is_p()} then 1 when {S.is_np()} then 0 end as y from fp),
per as (select f.fold, l.y, count(*) as n_train from (select distinct fold from lab) f join lab l on l.fold <> f.fold where l.y is not null group by f.fold, l.y)
select cast(fold as integer) as fold, cast(y as integer) as y, cast(n_train as bigint) as n_train,
  round(sum(n_train) over (partition by fold) / n_train, 6) as weight from per""")
def q_fold_class_weights(spark, sf_dir):
    label = T.strip("label")
    y = F.when(label == "P", 1).when(label == "NP", 0)
    return round_doubles(LE.fold_class_weights(folded(spark, sf_dir).withColumn("y", y)).select("fold", "y", F.col("n_train").cast("bigint"), "weight"))


def pair_features(spark, sf_dir) -> DataFrame:
    """row_id, fold, the labels of both targets (null where unlabelled) and p0..p3, c0..c2."""
    pairs = fx.pairs(spark, sf_dir).select("row_id", "src", "label", "ref", "mt")
    feats = FE.contra_features(FE.para_features(pairs, fx_lexicon(spark), negations=fx.FX_NEG), negations=fx.FX_NEG)
    label = T.strip("label")
    flat = feats.select("row_id", "src",
                        F.when(label == "P", 1).when(label == "NP", 0).alias("y"), F.when(label == "NP", 1).when(label == "P", 0).alias("y_contra"),
                        *[F.col("para_f")[i].alias(f"p{i}") for i in range(4)],
                        *[F.col("contra_f")[i].alias(f"c{i}") for i in range(3)])
    flat = FO.group_kfold(flat, "src", 3)  # numbers move to their fold, no texts
    return flat.select("row_id", "fold", *[c for c in flat.columns if c not in ("row_id", "src", "fold")])


PAIR_FEATURES = tuple(f"p{i}" for i in range(4)) + tuple(f"c{i}" for i in range(3))
#: the contradiction model keeps its best accuracy, the paraphrase model its best macro F1
TARGETS = (SL.Target("contradiction", ("c0", "c1", "c2"), "y_contra", "accuracy"), SL.Target("paraphrase", ("p0", "p1", "p2", "p3"), "y", "macro_f1"))


@register("train_pair_classifier")
def q_train_pair_classifier(spark, sf_dir):
    flat = pair_features(spark, sf_dir).drop("y_contra")  # unlabelled rows are scored, not learnt from
    out = LE.train_pair_classifier(flat, list(PAIR_FEATURES), "y", "fold", "d_para_pred")
    return round_doubles(out.select("row_id", "fold", "d_para_pred"))


@register("select_pair_classifier")
def q_select_pair_classifier(spark, sf_dir):
    """Scores of every (target, fold, penalty), the chosen penalty marked."""
    features = pair_features(spark, sf_dir).checkpoint()  # read by the fits and the scores of both targets
    return round_doubles(SL.select_classifiers(features, TARGETS)[0])


# ---------------------------------------------------------------- set operations

def conversation_pairs(spark, sf_dir) -> DataFrame:
    c = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    a, b = c.alias("a"), c.alias("b")
    j = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return j.select((-(F.col("a.conv_id") * fx.ROW_STRIDE + F.col("a.turn")) - 1).alias("row_id"),
                    F.concat(F.lit("conv"), F.col("a.conv_id").cast("string")).alias("src"),
                    F.col("a.text").alias("ref"), F.col("b.text").alias("mt"))


@register("union_samples", f"""with {S.FX_PAIRS},
cv as (select -(a.conv_id * {fx.ROW_STRIDE} + a.turn) - 1 as row_id, 'conv' || cast(a.conv_id as varchar) as src,
  a.text as ref, b.text as mt from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1)
select row_id, src, ref, mt, label, category from fx_pairs
union all select row_id, src, ref, mt, null, null from cv""")
def q_union_samples(spark, sf_dir):
    docs = fx.pairs(spark, sf_dir).select("row_id", "src", "ref", "mt", "label", "category")
    return SE.union_samples(docs, conversation_pairs(spark, sf_dir))


@register("dedup_first", f"""with {S.FX_PAIRS},
r as (select row_id, src, ref, mt, row_number() over (partition by src, mt, ref order by row_id) as rn from fx_pairs)
select row_id, src, ref, mt from r where rn = 1""")
def q_dedup_first(spark, sf_dir):
    p = fx.pairs(spark, sf_dir).select("row_id", "src", "ref", "mt")
    return SE.dedup_first(p, ("src", "mt", "ref"), "row_id")


# ---------------------------------------------------------------- sources / sinks (round trips)

@register("scan_samples", f"""with {S.FX_PAIRS}
select src, ref, mt, model, category, label from fx_pairs""")
def q_scan_samples(spark, sf_dir):
    path = IO.scratch_dir(spark, "samples")
    p = fx.pairs(spark, sf_dir).select("src", "ref", "mt", "model", "category", "label")
    IO.write_results(p, path, "csv")
    return IO.scan_samples(spark, path)


@register("scan_human_jsonl", f"""with {S.FX_PAIRS}
select {S.strip('src')} as src, {S.strip('mt')} as mt, {S.strip('ref')} as ref,
  cast(row_id % 101 as double) / 4 as human_da, cast(row_id % 7 as double) as human_mqm,
  cast(row_id % 5 as double) as adequacy_score, cast(row_id % 3 as double) as fluency_score,
  cast(row_id % 11 as double) as full_score, cast(row_id % 26 as double) as human_scores,
  model, row_id from fx_pairs""")
def q_scan_human_jsonl(spark, sf_dir):
    path = IO.scratch_dir(spark, "human")
    p = fx.pairs(spark, sf_dir)
    rid = F.col("row_id")
    js = p.select(
        "src", F.col("mt").alias("translation"), "ref",
        # numbers as JSON strings on some rows, as numbers on others
        F.when(rid % 2 == 0, (F.pmod(rid, F.lit(101)) / 4).cast("string")).alias("da_norm_score"),
        F.when(rid % 2 == 1, (F.pmod(rid, F.lit(101)) / 4).cast("double")).alias("da_num"),
        F.pmod(rid, F.lit(7)).cast("double").alias("mqm_norm_score"),
        F.pmod(rid, F.lit(5)).cast("string").alias("adequacy_score"),
        F.pmod(rid, F.lit(3)).cast("double").alias("fluency_score"),
        F.pmod(rid, F.lit(11)).cast("double").alias("full_score"),
        F.pmod(rid, F.lit(26)).cast("double").alias("Human_scores"),
        # the system name sits in `model` on some rows and only in `system` (model empty or absent) on others
        F.when(rid % 3 == 0, F.col("model")).when(rid % 3 == 1, F.lit("")).alias("model"),
        F.when(rid % 3 != 0, F.col("model")).alias("system"),
        "row_id",
    ).withColumn("da_norm_score", F.coalesce("da_norm_score", F.col("da_num").cast("string"))).drop("da_num")
    IO.write_results(js, path, "json")
    out = IO.scan_human_jsonl(spark, path, extra=("row_id",))
    return out.select("src", "mt", "ref", "human_da", "human_mqm", "adequacy_score", "fluency_score", "full_score",
                      "human_scores", "model", F.col("row_id").cast("bigint").alias("row_id"))


@register("scan_pair_tsv", f"""with {CLEAN_SQL.replace('pp as (', 'pp_unused as (')}
select s1, s2 from cp""")
def q_scan_pair_tsv(spark, sf_dir):
    path = IO.scratch_dir(spark, "pairs")
    CO.pair_lines(corpus(spark, sf_dir)).select("line").write.text(path)
    return IO.scan_pair_tsv(spark, path).select("s1", "s2")


@register("scan_labelled_tsv", f"""with {S.FX_CORPUS},
ln as (select {S.strip("s1 || chr(9) || s2 || chr(9) || cast(pair_id % 2 as varchar)")} as line from fx_corpus)
select string_split(line, chr(9))[1] as s1, string_split(line, chr(9))[2] as s2, string_split(line, chr(9))[3] as label
from ln where line <> '' and len(string_split(line, chr(9))) = 3""")
def q_scan_labelled_tsv(spark, sf_dir):
    path = IO.scratch_dir(spark, "labelled")
    c = corpus(spark, sf_dir)
    c.select(F.concat_ws("\t", "s1", "s2", F.pmod("pair_id", F.lit(2)).cast("string")).alias("line")).write.text(path)
    good, _rejects = IO.scan_labelled_tsv(spark, path)
    return good


@register("write_results", f"""with {S.EVALUATED}
select row_id, category, round(d_score, 6) as d_score, round(m_comet_adj, 6) as m_comet_adj from ev""")
def q_write_results(spark, sf_dir):
    path = IO.scratch_dir(spark, "results")
    ev = evaluated(spark, sf_dir).select("row_id", "category", "d_score", "m_comet_adj")
    IO.write_results(ev, path, "parquet", partition_by=("category",))
    return round_doubles(spark.read.parquet(path).select("row_id", "category", "d_score", "m_comet_adj"))


@register("resumable_map", f"""with {S.FX_CORPUS}
select pair_id, lower(s1) as s1, lower(s2) as s2 from fx_corpus""")
def q_resumable_map(spark, sf_dir):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from ..streaming.resumable import read_batches, resumable_map

    base = IO.scratch_dir(spark, "resumable")
    src, out, ck = f"{base}/in", f"{base}/out", f"{base}/ck"
    corpus(spark, sf_dir).write.json(src)
    schema = StructType([StructField("pair_id", LongType()), StructField("s1", StringType()),
                         StructField("s2", StringType())])
    resumable_map(spark, src, schema, ["s1", "s2"], lambda s: s.str.lower(), out, ck)
    resumable_map(spark, src, schema, ["s1", "s2"], lambda s: s.str.lower(), out, ck)  # a rerun adds nothing
    return read_batches(spark, out, schema)


@register("resumable_rejects", f"""with {S.FX_CORPUS},
ln as (select pair_id, s1 || chr(9) || s2 || case when pair_id % 3 = 0 then '' else chr(9) || cast(pair_id % 2 as varchar) end as line from fx_corpus),
st as (select pair_id, {S.strip('line')} as line from ln),
pt as (select pair_id, line, string_split(line, chr(9)) as parts from st where line <> '')
select pair_id, case when len(parts) = 3 then lower(parts[1]) else parts[1] end as first_part, len(parts) = 3 as done from pt""")
def q_resumable_rejects(spark, sf_dir):
    """Lines of three parts are mapped; the others, a third of the pairs among them, are found in the reject folder."""
    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

    from ..streaming.resumable import read_batches, resumable_map

    base = IO.scratch_dir(spark, "rejects")
    line = F.concat_ws("\t", "s1", "s2", F.when(F.col("pair_id") % 3 != 0, (F.col("pair_id") % 2).cast("string")))
    corpus(spark, sf_dir).select("pair_id", line.alias("line")).write.json(f"{base}/in")

    def parts(rows):
        rows = rows.select("pair_id", F.split(T.strip("line"), "\t", -1).alias("p")).where(F.array_join("p", "") != "")
        return rows.select("pair_id", F.col("p")[0].alias("first_part"), F.size("p").alias("n_parts"))

    read = StructType([StructField("pair_id", LongType()), StructField("line", StringType())])
    wrote = StructType([StructField("pair_id", LongType()), StructField("first_part", StringType()), StructField("n_parts", IntegerType())])
    resumable_map(spark, f"{base}/in", read, ["first_part"], lambda s: s.str.lower(), f"{base}/out", f"{base}/ck",
                  valid=F.col("n_parts") == 3, rejects=f"{base}/bad", files_per_batch=4, prepare=parts)
    done, bad = read_batches(spark, f"{base}/out", wrote), read_batches(spark, f"{base}/bad", wrote)
    return done.select("pair_id", "first_part", F.lit(True).alias("done")).unionByName(bad.select("pair_id", "first_part", F.lit(False).alias("done")))
