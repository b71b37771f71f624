"""Aggregate expressions shared by the reports: guarded Pearson and macro P/R/F1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson r as an aggregate; null when n < 2 or either side is constant.

    Pairs with a null on either side are dropped (pairwise complete).
    Built from moments because ``corr`` raises on a constant column under ANSI.
    """
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x), F.when(both, y)
    n = F.count(xx)
    ok = (n >= 2) & (F.min(xx) < F.max(xx)) & (F.min(yy) < F.max(yy))
    r = F.try_divide(F.covar_pop(xx, yy), F.stddev_pop(xx) * F.stddev_pop(yy))
    return F.when(ok & r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def pair_count(x: Column | str, y: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    return F.count(F.when(x.isNotNull() & y.isNotNull(), F.lit(1)))


def confusion(truth: Column, pred: Column) -> dict[str, Column]:
    """Aggregates n11 (t=1,p=1), n10, n01, n00 over boolean truth/prediction."""
    t, p = truth.cast("int"), pred.cast("int")
    return {
        "n11": F.sum(F.when((t == 1) & (p == 1), 1).otherwise(0)).cast("bigint"),
        "n10": F.sum(F.when((t == 1) & (p == 0), 1).otherwise(0)).cast("bigint"),
        "n01": F.sum(F.when((t == 0) & (p == 1), 1).otherwise(0)).cast("bigint"),
        "n00": F.sum(F.when((t == 0) & (p == 0), 1).otherwise(0)).cast("bigint"),
    }


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def class_scores(n11: Column, n10: Column, n01: Column, n00: Column) -> dict[str, Column]:
    """Per-class precision/recall/F1 (zero_division = 0) and presence flags."""
    p1, r1 = _ratio(n11, n11 + n01), _ratio(n11, n11 + n10)
    p0, r0 = _ratio(n00, n00 + n10), _ratio(n00, n00 + n01)
    f1 = _ratio(2 * n11, 2 * n11 + n01 + n10)
    f0 = _ratio(2 * n00, 2 * n00 + n01 + n10)
    has1 = (n11 + n01 + n10) > 0
    has0 = (n00 + n10 + n01) > 0
    return {"p1": p1, "r1": r1, "f1": f1, "p0": p0, "r0": r0, "f0": f0, "has1": has1, "has0": has0}


def macro(n11: Column, n10: Column, n01: Column, n00: Column) -> dict[str, Column]:
    """Macro precision/recall/F1 over the labels present in truth or prediction."""
    s = class_scores(n11, n10, n01, n00)
    k = s["has1"].cast("int") + s["has0"].cast("int")

    def avg(a: Column, b: Column) -> Column:
        total = F.when(s["has1"], a).otherwise(0.0) + F.when(s["has0"], b).otherwise(0.0)
        return F.when(k > 0, total / k).otherwise(F.lit(0.0))

    return {
        "precision": avg(s["p1"], s["p0"]),
        "recall": avg(s["r1"], s["r0"]),
        "f1": avg(s["f1"], s["f0"]),
    }
