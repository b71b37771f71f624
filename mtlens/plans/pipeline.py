"""``refine``: the full evaluation pipeline as one lazy plan.

pairs -> rule decision (in-row lexicon rule) -> contradiction / paraphrase
signals (columns, or any scorer added with ``score_with_model``) -> cascade
-> score adjustment. All stage columns stay computable for every row; the
reports prune what they do not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NEG_RULE
from ..operators import adjust as A
from ..operators import rules
from ..sources.io import require_columns

REQUIRED = ("ref", "mt")


def refine(
    df: DataFrame,
    lexicon: DataFrame,
    metrics: Sequence[str],
    negations: Iterable[str] = NEG_RULE,
    tau: float = A.TAU,
    d_contra: str = "d_contra",
    d_para: str = "d_para",
    lean: bool = False,
    scorers: dict[str, Column | Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Add d_rule, d_contra, d_para, d_score (rounded to 4), stage_resolved and <metric>_adj.

    The adjustment uses the unrounded decision; only stored columns are rounded.
    ``scorers`` compute ``d_contra`` / ``d_para`` where the table does not hold them: a column, or a function from a
    flag to a column (``lambda open: score_with_model(load, "mt", "ref", only=open)``). With ``lean=True`` the flag
    marks the rows that the rule left open (the short-circuit of the cascade), so that models see those alone, in the
    same pass over the table; decided rows hold null. A plain column is masked: its own Python code would see all rows.
    """
    scorers = scorers or {}
    require_columns(df, [*REQUIRED, *[c for c in (d_contra, d_para) if c not in scorers]])
    out = rules.rule_decision(df, lexicon, negations)
    if scorers:
        undecided = F.col("d_rule").isNull() if lean else F.lit(True)
        made = {name: s(undecided) if callable(s) else F.when(undecided, s) for name, s in scorers.items()}
        out = out.withColumns(made)
    out = out.withColumn("__d", A.select_decision("d_rule", d_contra, d_para))
    out = A.adjust_all(out, metrics, d="__d", tau=tau)
    return out.withColumns(
        {
            "stage_resolved": A.stage_resolved("d_rule", d_contra),
            d_contra: F.round(A.clean_score(d_contra), 4),
            d_para: F.round(A.clean_score(d_para), 4),
            "d_score": F.round(F.col("__d"), 4),
        }
    ).drop("__d")
