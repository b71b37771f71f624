"""Leakage-free group folds, fold splits, out-of-fold scores and run selection.

``group_kfold`` reproduces GroupKFold without shuffling: groups by size
descending (ties: group key ascending), each to the currently lightest fold
(lowest fold index on ties). The greedy walk is inherently sequential, but
all groups of one size behave alike, so it runs on the *histogram of group
sizes* (at most sqrt(2N) distinct sizes) on the driver and emits a short run
table per size class: ranks [lo, hi) of that class cycle through a list of
folds. Each group then finds its fold from its rank within its size class.
No group is ever collected; the largest group is one histogram row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adjust import clean_score
from .rank import row_number

N_SPLITS = 3
RUNS_BROADCAST_LIMIT = 1_000_000


def _runs_for_class(size: int, count: int, loads: list[int], start_pos: int = 0) -> list[tuple[int, int, list[int]]]:
    """Simulate the greedy for ``count`` groups of ``size``; return runs (lo, hi, fold cycle)
    and update ``loads`` in place. O(k^2) steps per class regardless of ``count``."""
    k = len(loads)
    runs: list[tuple[int, int, list[int]]] = []
    pos, left = 0, count
    while left > 0:
        order = sorted(range(k), key=lambda f: (loads[f], f))
        f1 = order[0]
        # the "level" set: folds that rotate round-robin (each, after +size, goes behind all of them)
        j = 1
        while j < k and (loads[order[j]], order[j]) < (loads[f1] + size, f1):
            j += 1
        level = order[:j]
        nxt = order[j] if j < k else None
        last = level[-1]
        if nxt is None:
            rounds = left // j
        else:
            d = loads[nxt] - loads[last]
            # full rounds t where (loads[last] + t*size, last) < (loads[nxt], nxt)
            rounds = -(-d // size) if d % size else d // size + (1 if last < nxt else 0)
            rounds = min(rounds, left // j)
        if rounds > 0:
            runs.append((pos, pos + rounds * j, list(level)))
            for f in level:
                loads[f] += rounds * size
            pos += rounds * j
            left -= rounds * j
            continue
        # a partial round (or a single step): assign one group to the current minimum
        runs.append((pos, pos + 1, [f1]))
        loads[f1] += size
        pos += 1
        left -= 1
    return runs


def fold_runs(histogram: Sequence[tuple[int, int]], k: int = N_SPLITS) -> list[tuple[int, int, int, list[int]]]:
    """(size, lo, hi, folds) for a histogram [(size, n_groups)] processed by size descending."""
    loads = [0] * k
    out = []
    for size, count in sorted(histogram, key=lambda t: -t[0]):
        for lo, hi, folds in _runs_for_class(size, count, loads):
            out.append((size, lo, hi, folds))
    return out


def group_kfold(df: DataFrame, group: str = "src", k: int = N_SPLITS, out: str = "fold") -> DataFrame:
    """Add ``out`` in 1..k; a group never spans two folds; fold sizes balanced greedily."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    hist = [(r["__size"], r["n"]) for r in sizes.groupBy("__size").agg(F.count(F.lit(1)).alias("n")).collect()]
    n_groups = sum(n for _, n in hist)
    if n_groups < k:
        raise ValueError(f"{n_groups} distinct groups cannot fill {k} folds")
    runs = fold_runs(hist, k)
    spark = df.sparkSession
    run_df = spark.createDataFrame(
        [(s, lo, hi, folds) for s, lo, hi, folds in runs], "__size long, __lo long, __hi long, __folds array<int>")
    if len(runs) <= RUNS_BROADCAST_LIMIT:
        run_df = F.broadcast(run_df)
    # rank of each group within its size class, by group key
    ranked = row_number(sizes, [group], ["__size"], "__r")
    assigned = ranked.join(run_df, "__size").where((F.col("__r") >= F.col("__lo")) & (F.col("__r") < F.col("__hi")))
    fold = F.element_at(F.col("__folds"), (F.pmod(F.col("__r") - F.col("__lo"), F.size("__folds")) + 1).cast("int")) + 1
    per_group = assigned.select(F.col(group).alias("__group"), fold.cast("int").alias(out))
    return df.join(per_group, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")  # null is a group


def fold_split(df: DataFrame, k: int = N_SPLITS, fold: str = "fold") -> DataFrame:
    """(split_fold, role, ...): every row once per split: 'val' in its own fold, 'train' in the others.
    A Generate over 1..k, no join."""
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("split_fold")).withColumn(
        "role", F.when(F.col("split_fold") == F.col(fold), F.lit("val")).otherwise(F.lit("train")))


def train_split(df: DataFrame, i: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) != i)


def val_split(df: DataFrame, i: int, fold: str = "fold") -> DataFrame:
    return df.where(F.col(fold) == i)


def oof_scores(df: DataFrame, val_scores: DataFrame, keys: Sequence[str] = ("src", "mt", "ref"),
               score: str = "score", order: Sequence[str] = ("fold", "row"), out: str = "oof_score",
               check: bool = True) -> DataFrame:
    """Attach out-of-fold scores by key: the later fold wins, then the later row.
    A row without a score is an error of the job that reads the column (the check is part of the plan, not a pass of its own)."""
    best = val_scores.groupBy(*keys).agg(F.max_by(score, F.struct(*order)).alias(out))
    cond = None
    renamed = best.select(*[F.col(k).alias(f"__k_{k}") for k in keys], out)
    for k in keys:
        c = df[k].eqNullSafe(renamed[f"__k_{k}"])
        cond = c if cond is None else cond & c
    res = df.join(renamed, cond, "left").drop(*[f"__k_{k}" for k in keys])
    if check:
        failed = F.raise_error(F.lit("a row did not receive an out-of-fold score")).cast("double")
        res = res.withColumn(out, F.when(F.col(out).isNull(), failed).otherwise(F.col(out).cast("double")))
    return res


def pick_best(runs: DataFrame, run: str, score: str, order: str, groups: Sequence[str] = ()) -> DataFrame:
    """The run with the highest score per group; the first (lowest ``order``) wins ties.

    A failed run (null or NaN score) never wins; a group in which all failed has null in both columns.
    """
    s = clean_score(score)
    return runs.groupBy(*groups).agg(
        F.max_by(run, F.when(s.isNotNull(), F.struct(s.alias("s"), (-F.col(order)).alias("o")))).alias(f"best_{run}"),
        F.max(s).alias(f"best_{score}"),
    )
