"""Decision cascade and threshold-based score adjustment (pure projections)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TAU = 0.6


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_score(c: Column | str) -> Column:
    """NaN -> null, so a missing score never compares as large."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def select_decision(d_rule: Column | str = "d_rule", d_contra: Column | str = "d_contra",
                    d_para: Column | str = "d_para") -> Column:
    """Rule value if set; else the paraphrase score when d_contra > 0.5; else d_contra."""
    d_rule, d_contra, d_para = _c(d_rule), _c(d_contra), _c(d_para)
    return (
        F.when(d_rule.isNotNull(), d_rule.cast("double"))
        .when(d_contra > 0.5, d_para.cast("double"))
        .otherwise(d_contra.cast("double"))
    )


def stage_resolved(d_rule: Column | str = "d_rule", d_contra: Column | str = "d_contra") -> Column:
    return (
        F.when(_c(d_rule).isNotNull(), F.lit("rule"))
        .when(_c(d_contra) > 0.5, F.lit("paraphrase"))
        .otherwise(F.lit("contradiction"))
    )


def adjust_score(s: Column | str, d: Column | str, tau: float = TAU) -> Column:
    """Lift an under-scored paraphrase, pull down an over-scored contradiction, clip to [0, 1].

    A null (or NaN) score stays null; a null decision leaves the score unchanged.
    """
    s, d = clean_score(s), _c(d)
    t = F.lit(float(tau))
    moved = (
        F.when((d >= 0.5) & (s < t), t + (t - s) * d)
        .when((d < 0.5) & (s > t), t - (s - t) * (1.0 - d))
        .otherwise(s)
    )
    return F.when(s.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)))


def adjust_all(df: DataFrame, metrics: Iterable[str], d: str = "d_score", tau: float = TAU,
               suffix: str = "_adj", digits: int = 4) -> DataFrame:
    """Add ``<metric>_adj`` for every metric present, in one projection."""
    present = [m for m in metrics if m in df.columns]
    return df.withColumns({f"{m}{suffix}": F.round(adjust_score(m, d, tau), digits) for m in present})


def direction(raw: Column | str, adj: Column | str) -> Column:
    raw, adj = _c(raw), _c(adj)
    return (
        F.when(adj > raw, F.lit("reward"))
        .when(adj < raw, F.lit("penalty"))
        .when(adj.isNotNull() & raw.isNotNull(), F.lit("unchanged"))
    )
