"""Quality reports over an evaluated table. Every report is one aggregation
(partial aggregation map-side, a tiny shuffle of partial states) and
returns a small table; nothing is collected to the driver."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SIMILAR_CATEGORIES, label_is_np, label_is_p
from .adjust import TAU, clean_score
from .stats import confusion, macro, pair_count, safe_pearson

DEFAULT_TAUS = (0.5, 0.6, 0.7)


def _present(df: DataFrame, metrics: Iterable[str]) -> list[str]:
    return [m for m in metrics if m in df.columns]


def long_scores(df: DataFrame, metrics: Sequence[str], suffix: str = "_adj", keep: Sequence[str] = ()) -> DataFrame:
    """Wide -> long: (keep..., metric, raw, adj) with one row per row and metric (a Generate, no shuffle)."""
    present = _present(df, metrics)
    items = [
        F.struct(
            F.lit(m).alias("metric"),
            clean_score(m).cast("double").alias("raw"),
            (clean_score(f"{m}{suffix}") if f"{m}{suffix}" in df.columns else F.lit(None)).cast("double").alias("adj"),
        )
        for m in present
    ]
    return df.select(*keep, F.inline(F.array(*items)))


def metric_means(df: DataFrame, metrics: Sequence[str], suffix: str = "_adj") -> DataFrame:
    """(metric, mean_raw, mean_adj): means skipping nulls."""
    return (
        long_scores(df, metrics, suffix)
        .groupBy("metric")
        .agg(F.avg("raw").alias("mean_raw"), F.avg("adj").alias("mean_adj"))
    )


def row_mean(metrics: Sequence[str]) -> Column:
    """Mean of the non-null metric columns of a row; null when all are null."""
    cols = [clean_score(m) for m in metrics]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    cnt = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return F.when(cnt > 0, total / cnt)


def threshold_sweep(df: DataFrame, metrics: Sequence[str], taus: Sequence[float] = DEFAULT_TAUS,
                    label: str = "label") -> DataFrame:
    """(tau, p_acc, np_acc, bal_acc, best) in one pass; best = max balanced, the earliest in ``taus`` on ties.

    Rows fall into the interval of their mean score (a binary search in the sorted thresholds), one
    histogram by interval is shuffled, and sums over it give every threshold: the work per row
    hardly depends on the number of thresholds. Means that are null or NaN count in neither hit.
    """
    from pyspark.ml.feature import Bucketizer

    present = _present(df, metrics)
    if not present:
        raise ValueError(f"none of the metric columns {list(metrics)} is in the table")
    taus = [float(t) for t in taus]
    if not taus or not all(map(math.isfinite, taus)):
        raise ValueError("thresholds must be finite numbers, one at least")
    # Intervals are closed below, a score at the threshold counts as below it: both are mirrored.
    cuts = sorted({0.0 - t for t in taus})
    mean = row_mean(present)
    scored = df.select((F.lit(0.0) - F.when(~F.isnan(mean), mean)).alias("__m"), label_is_p(label).alias("__p"), label_is_np(label).alias("__np"))
    binned = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__m", outputCol="__b", handleInvalid="keep").transform(scored)
    hist = binned.groupBy(F.col("__b").cast("int").alias("at")).agg(F.sum(F.col("__p").cast("long")).alias("p"), F.sum(F.col("__np").cast("long")).alias("np"))

    # The thresholds as rows: as many as the caller listed, beside as many rows of the histogram.
    rank = {c: i + 1 for i, c in enumerate(cuts)}
    listed = F.split(F.lit(",".join(f"{t!r};{rank[0.0 - t]}" for t in taus)), ",")
    given = df.sparkSession.range(1).select(F.posexplode(listed).alias("ord", "x")).select(
        "ord", F.split("x", ";")[0].cast("double").alias("tau"), F.split("x", ";")[1].cast("int").alias("at"))
    zero = F.lit(0).cast("long")
    cells = hist.select("at", "p", "np", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("double").alias("tau")).unionByName(
        given.select("at", zero.alias("p"), zero.alias("np"), "ord", "tau"))
    every = Window.partitionBy()
    below = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    seen = F.col("at").isNotNull()

    def total(c: str, on: Column | None = None) -> Column:
        return F.coalesce(F.sum(F.col(c) if on is None else F.when(on, F.col(c))).over(every), zero)

    def acc(hits: Column, n: Column) -> Column:
        return F.when(n > 0, hits.cast("double") / n).otherwise(F.lit(0.0))

    sums = cells.select(
        "ord", "tau", total("p").alias("n_p"), total("np").alias("n_np"), total("np", seen).alias("np_scored"),
        F.coalesce(F.sum(F.when(seen, F.col("p"))).over(below), zero).alias("p_over"), F.coalesce(F.sum(F.when(seen, F.col("np"))).over(below), zero).alias("np_over"))
    rows = sums.where(F.col("ord").isNotNull()).select(
        "tau", "ord", acc(F.col("p_over"), F.col("n_p")).alias("p_acc"), acc(F.col("np_scored") - F.col("np_over"), F.col("n_np")).alias("np_acc"),
    ).withColumn("bal_acc", (F.col("p_acc") + F.col("np_acc")) / 2.0)
    w = Window.orderBy(F.col("bal_acc").desc(), F.col("ord").asc())
    return rows.withColumn("best", F.row_number().over(w) == 1).drop("ord")


def _predictions(d_rule: Column, d_contra: Column, d_para: Column, d_score: Column) -> list[tuple[str, Column]]:
    rule = F.coalesce(d_rule == 1, F.lit(False))
    contra = ~F.coalesce((1.0 - d_contra) >= 0.5, F.lit(False))
    para = F.coalesce(d_para >= 0.5, F.lit(False))
    full = F.coalesce(d_score >= 0.5, F.lit(False))
    has_rule = d_rule.isNotNull()
    return [
        ("Rule-Based", rule),
        ("Contra. Detection", contra),
        ("Paraphrase Detection", para),
        ("Rule + Contradiction", F.when(has_rule, rule).otherwise(contra)),
        ("Rule + Paraphrase", F.when(has_rule, rule).otherwise(para)),
        ("Full Framework", full),
    ]


def component_prf(df: DataFrame, label: str = "label") -> DataFrame:
    """(component, precision, recall, f1): macro scores of six predictors, one pass."""
    preds = _predictions(F.col("d_rule"), clean_score("d_contra"), clean_score("d_para"), clean_score("d_score"))
    truth = label_is_p(label)
    long = df.select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("component"), p.alias("pred"))
                           for i, (n, p) in enumerate(preds)])),
        truth.alias("truth"),
    )
    conf = long.groupBy("ord", "component").agg(*[c.alias(k) for k, c in confusion(F.col("truth"), F.col("pred")).items()])
    m = macro(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00"))
    return conf.select("component", *[v.alias(k) for k, v in m.items()])


def category_prf(df: DataFrame, label: str = "label", category: str = "category",
                 similar: Iterable[str] = SIMILAR_CATEGORIES) -> DataFrame:
    """(category, precision, recall, f1, support, grp) per category plus a 'Macro Avg' row.

    One rollup aggregation; the overall row is computed over all rows, not
    averaged from the category rows.
    """
    truth = label_is_p(label)
    pred = F.coalesce(clean_score("d_score") >= 0.5, F.lit(False))
    base = df.select(F.col(category).alias("category"), truth.alias("truth"), pred.alias("pred"))
    agg = base.rollup("category").agg(
        *[c.alias(k) for k, c in confusion(F.col("truth"), F.col("pred")).items()],
        F.count(F.lit(1)).alias("support"),
        F.grouping("category").alias("g"),
    )
    m = macro(F.col("n11"), F.col("n10"), F.col("n01"), F.col("n00"))
    sim = F.array(*[F.lit(s) for s in similar])
    return agg.select(
        F.when(F.col("g") == 1, F.lit("Macro Avg")).otherwise(F.col("category")).alias("category"),
        *[v.alias(k) for k, v in m.items()],
        F.col("support").cast("bigint").alias("support"),
        F.when(F.col("g") == 1, F.lit(None).cast("string"))
        .when(F.array_contains(sim, F.col("category")), F.lit("P"))
        .otherwise(F.lit("NP"))
        .alias("grp"),
    )


def classification_report(df: DataFrame, truth: Column | str, pred: Column | str) -> DataFrame:
    """sklearn-style report rows: class 0, class 1, accuracy, macro avg, weighted avg.

    Columns (row, precision, recall, f1, support); accuracy puts the accuracy in f1.
    """
    t = F.col(truth) if isinstance(truth, str) else truth
    p = F.col(pred) if isinstance(pred, str) else pred
    conf = df.agg(*[c.alias(k) for k, c in confusion(t == 1, p == 1).items()])
    n11, n10, n01, n00 = (F.col(k) for k in ("n11", "n10", "n01", "n00"))
    from .stats import class_scores

    s = class_scores(n11, n10, n01, n00)
    sup1, sup0 = n11 + n10, n00 + n01
    tot = sup1 + sup0
    m = macro(n11, n10, n01, n00)

    def wavg(a: Column, b: Column) -> Column:
        return F.when(tot > 0, (a * sup1 + b * sup0) / tot).otherwise(F.lit(0.0))

    rows = [
        F.struct(F.lit("0").alias("row"), s["p0"].alias("precision"), s["r0"].alias("recall"), s["f0"].alias("f1"),
                 sup0.alias("support")),
        F.struct(F.lit("1").alias("row"), s["p1"].alias("precision"), s["r1"].alias("recall"), s["f1"].alias("f1"),
                 sup1.alias("support")),
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"),
                 F.when(tot > 0, (n11 + n00).cast("double") / tot).otherwise(0.0).alias("f1"), tot.alias("support")),
        F.struct(F.lit("macro avg").alias("row"), m["precision"].alias("precision"), m["recall"].alias("recall"),
                 m["f1"].alias("f1"), tot.alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), wavg(s["p1"], s["p0"]).alias("precision"),
                 wavg(s["r1"], s["r0"]).alias("recall"), wavg(s["f1"], s["f0"]).alias("f1"), tot.alias("support")),
    ]
    return conf.select(F.inline(F.array(*rows))).withColumn("support", F.col("support").cast("bigint"))


def good_score_pct(df: DataFrame, metrics: Sequence[str], tau: float = TAU, label: str = "label",
                   suffix: str = "_adj") -> DataFrame:
    """(metric, orig_p, orig_np, adj_p, adj_np): % of P rows above tau / NP rows at or below.

    A null score is never good but stays in the denominator; an empty class gives null.
    """
    long = long_scores(df, metrics, suffix, keep=[label_is_p(label).alias("is_p"), label_is_np(label).alias("is_np")])
    t = F.lit(float(tau))

    def pct(cls: str, col: str, good: Column) -> Column:
        n = F.sum(F.col(cls).cast("int"))
        hit = F.sum((F.col(cls) & F.coalesce(good, F.lit(False))).cast("int"))
        return F.when(n > 0, hit * 100.0 / n)

    return long.groupBy("metric").agg(
        pct("is_p", "raw", F.col("raw") > t).alias("orig_p"),
        pct("is_np", "raw", F.col("raw") <= t).alias("orig_np"),
        pct("is_p", "adj", F.col("adj") > t).alias("adj_p"),
        pct("is_np", "adj", F.col("adj") <= t).alias("adj_np"),
    )


def label_pearson(df: DataFrame, metrics: Sequence[str], label: str = "label", suffix: str = "_adj") -> DataFrame:
    """(metric, orig_corr, adj_corr, orig_gap, adj_gap): Pearson with P=1/else 0 (null score -> 0),
    and the mean gap P - NP (nulls skipped)."""
    long = long_scores(df, metrics, suffix, keep=[label_is_p(label).alias("is_p"), label_is_np(label).alias("is_np")])
    y = F.col("is_p").cast("double")

    def gap(c: str) -> Column:
        return F.avg(F.when(F.col("is_p"), F.col(c))) - F.avg(F.when(F.col("is_np"), F.col(c)))

    return long.groupBy("metric").agg(
        safe_pearson(F.coalesce(F.col("raw"), F.lit(0.0)), y).alias("orig_corr"),
        safe_pearson(F.coalesce(F.col("adj"), F.lit(0.0)), y).alias("adj_corr"),
        gap("raw").alias("orig_gap"),
        gap("adj").alias("adj_gap"),
    )


def human_join(df: DataFrame, human: DataFrame, keys: Sequence[str] = ("ref", "mt"),
               score: str = "human_score") -> DataFrame:
    """Inner join on (ref, mt), null keys matching each other as in pandas.

    The planner picks a broadcast for a small human table (AQE re-plans at
    run time) and a shuffle join otherwise; AQE splits a hot key.
    """
    h = human.select(*[F.col(k).alias(f"__h_{k}") for k in keys], F.col(score).cast("double").alias(score))
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(h[f"__h_{k}"])
        cond = c if cond is None else cond & c
    return df.join(h, cond, "inner").drop(*[f"__h_{k}" for k in keys])


def human_pearson(df: DataFrame, human: DataFrame, metrics: Sequence[str], suffix: str = "_adj",
                  score: str = "human_score") -> DataFrame:
    """(metric, orig_r, adj_r, n): Pearson of score (null -> 0) with the human score on matched rows."""
    joined = human_join(df, human, score=score)
    long = long_scores(joined, metrics, suffix, keep=[F.col(score).alias("h")])
    return long.groupBy("metric").agg(
        safe_pearson(F.coalesce(F.col("raw"), F.lit(0.0)), F.col("h")).alias("orig_r"),
        safe_pearson(F.coalesce(F.col("adj"), F.lit(0.0)), F.col("h")).alias("adj_r"),
        F.count(F.lit(1)).cast("bigint").alias("n"),
    )


def encode_label(label: Column | str = "label") -> dict[str, Column]:
    """Contradiction target (P -> 0, else 1) and paraphrase target (P -> 1, else 0)."""
    is_p = label_is_p(label)
    return {
        "y_contra": F.when(is_p, F.lit(0)).otherwise(F.lit(1)).cast("int"),
        "y_para": F.when(is_p, F.lit(1)).otherwise(F.lit(0)).cast("int"),
    }


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """(y, n, weight, pos_weight): N / count per class, and max(1, neg/pos) for the positive class."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    w = Window.partitionBy()  # over at most two rows
    total = F.sum("n").over(w)
    pos = F.sum(F.when(F.col(y) == 1, F.col("n")).otherwise(0)).over(w)
    return counts.select(
        y, "n",
        (total.cast("double") / F.col("n")).alias("weight"),
        F.greatest(F.lit(1.0), F.try_divide((total - pos).cast("double"), pos)).alias("pos_weight"),
    )
