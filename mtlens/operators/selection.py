"""Choosing the parameters of a pair classifier by its scores on folds.

A target (contradiction, paraphrase) names features, a 0/1 label and the criterion it is chosen by. For every fold and
every strength of the penalty a class-weighted logistic model is fitted on the labelled rows of the other folds. All
these models advance together: one pass over the table per Newton round, in which each task adds up every model's
gradient and curvature; the sums of a few numbers per model reach the driver, never rows. A model whose loss rose goes half its
step back. The held-out rows of each fold are then scored by all its models in one aggregation, and the
penalty with the best mean over the folds wins (ties: the first of the grid).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .learn import fold_class_weights
from .stats import confusion, macro

GRID = (0.001, 0.1, 10.0)  # strengths of the L2 penalty on standardized features
ROUNDS = 30
TOLERANCE = 1e-8
CRITERIA = ("macro_f1", "accuracy")


@dataclass(frozen=True)
class Target:
    name: str
    features: tuple[str, ...]
    label: str
    criterion: str = "macro_f1"


@dataclass
class Fits:
    """Per (fold, penalty) the weights of the standardized features, the intercept last; None without two classes."""

    target: Target
    grid: tuple[float, ...]
    mean: list[float]
    scale: list[float]
    weights: dict[tuple[int, float], np.ndarray | None] = field(default_factory=dict)

    def margin(self, fold: int, penalty: float) -> Column:
        """Log-odds of label 1; null where nothing could be learnt."""
        w = self.weights[fold, penalty]
        if w is None:
            return F.lit(None).cast("double")
        total = F.lit(float(w[-1]))
        for f, m, s, b in zip(self.target.features, self.mean, self.scale, w[:-1], strict=True):
            total = total + (_known(f, m) - m) * float(b / s)
        return total

    def probability(self, penalty: float, fold: Column) -> Column:
        """Out-of-fold P(label = 1): each fold by the model that did not see it."""
        out = F.lit(None).cast("double")
        for i in sorted({f for f, _ in self.weights}):
            out = F.when(fold == i, 1.0 / (1.0 + F.exp(-self.margin(i, penalty)))).otherwise(out)
        return out


def _known(feature: str, mean: float) -> Column:
    """A missing value counts as the mean."""
    c = F.col(feature).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c), c).otherwise(F.lit(mean))


def _sums(rows: DataFrame, models: list[tuple[int, float]], points: np.ndarray, class_weight: dict[int, tuple[float, float]], d: int) -> dict[int, np.ndarray]:
    """model -> (loss, gradient, curvature) summed over the rows of other folds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 1 + d + d * d))
        for batch in batches:
            x = np.column_stack([*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, d + 1)), np.ones(batch.num_rows)])
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            for k, (i, _) in enumerate(models):
                w0, w1 = class_weight[i]
                w = np.where(fold != i, np.where(y == 1, w1, w0), 0.0)
                z = x @ points[k]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                total[k, 0] += (w * (np.logaddexp(0, z) - y * z)).sum()
                total[k, 1 : 1 + d] += x.T @ (w * (p - y))
                total[k, 1 + d :] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["model", "s"])

    parts = rows.mapInArrow(task, "model int, s array<double>")
    got = parts.groupBy("model").agg(*(F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(1 + d + d * d)))
    return {r[0]: np.array(r[1:], float) for r in got.collect()}


def fit_folds(df: DataFrame, target: Target, grid: Sequence[float] = GRID, fold: str = "fold", rounds: int = ROUNDS) -> Fits:
    """The models of all folds and penalties. Labels other than 0 and 1 (null among them) are not learnt from."""
    if target.criterion not in CRITERIA:
        raise ValueError(f"criterion of {target.name}: {target.criterion!r} is none of {CRITERIA}")
    y = F.col(target.label)
    labelled = df.where(y.isin(0, 1) & F.col(fold).isNotNull())
    clean = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")) for f in target.features]
    row = labelled.agg(*(F.avg(c) for c in clean), *(F.stddev_pop(c) for c in clean)).first()
    n = len(target.features)
    fits = Fits(target, tuple(grid), [m or 0.0 for m in row[:n]], [s or 1.0 for s in row[n:]])
    standard = [((_known(f, m) - m) / s).alias(f"x{k}") for k, (f, m, s) in enumerate(zip(target.features, fits.mean, fits.scale, strict=True))]
    ensure_checkpoint_dir(df.sparkSession)
    rows = labelled.select(F.col(fold).cast("int").alias("fold"), y.cast("int").alias("y"), *standard).checkpoint()

    counts: dict[int, dict[int, tuple[int, float]]] = {}
    for r in fold_class_weights(df.select(F.col(fold).alias("fold"), F.when(y.isin(0, 1), y).alias("y")), "y", "fold").collect():  # folds x classes
        counts.setdefault(r["fold"], {})
        if r["weight"] is not None:
            counts[r["fold"]][r["y"]] = r["n_train"], r["weight"]
    counts.pop(None, None)
    class_weight = {i: (c[0][1], c[1][1]) for i, c in counts.items() if len(c) == 2}
    fits.weights = {(i, g): None for i in counts for g in fits.grid}
    d = n + 1
    models = [(i, g) for i in sorted(class_weight) for g in fits.grid]
    mass = np.array([sum(k * w for k, w in counts[i].values()) for i, _ in models])
    penalty = np.array([[g] * n + [0.0] for _, g in models]).reshape(len(models), d)
    points, safe = np.zeros((len(models), d)), np.zeros((len(models), d))
    lowest = np.full(len(models), np.inf)
    running = set(range(len(models)))
    for _ in range(rounds):
        if not running:
            break
        order = sorted(running)
        sums = _sums(rows, [models[k] for k in order], points[order], class_weight, d)
        for at, k in enumerate(order):
            s = sums[at] / mass[k]
            loss = s[0] + (penalty[k] * points[k] ** 2).sum() / 2
            if loss > lowest[k] + 1e-12:
                points[k] = (points[k] + safe[k]) / 2
                continue
            lowest[k], safe[k] = loss, points[k]
            slope = s[1 : 1 + d] + penalty[k] * points[k]
            if np.abs(slope).max() < TOLERANCE:
                running.discard(k)
                continue
            curve = s[1 + d :].reshape(d, d) + np.diag(penalty[k] + 1e-9)
            points[k] = points[k] - np.linalg.solve(curve, slope)
    for k, model in enumerate(models):
        fits.weights[model] = safe[k]
    return fits


def fold_scores(df: DataFrame, fits: Fits, fold: str = "fold") -> DataFrame:
    """(target, fold, penalty, n, accuracy, macro_f1) on the labelled held-out rows, by one aggregation.

    A model is right when its log-odds and the label agree (0 counts as 1). Without a model the scores are null.
    """
    y = F.col(fits.target.label)
    rows = None
    held = F.lit(None).cast("array<struct<penalty:double,ord:int,margin:double>>")
    for i in sorted({f for f, _ in fits.weights}):
        scored = F.array(*(F.struct(F.lit(float(g)).alias("penalty"), F.lit(k).alias("ord"), fits.margin(i, g).alias("margin")) for k, g in enumerate(fits.grid)))
        held = F.when(F.col(fold) == i, scored).otherwise(held)
    rows = df.where(y.isin(0, 1)).select(F.col(fold).cast("int").alias("fold"), y.alias("y"), F.inline(held))
    counts = rows.groupBy("fold", "penalty", "ord").agg(F.count("margin").alias("scored"), *(c.alias(k) for k, c in confusion(F.col("y") == 1, F.col("margin") >= 0).items()))
    cells = [F.col(k) for k in ("n11", "n10", "n01", "n00")]
    n = sum(cells[1:], cells[0])
    known = F.col("scored") > 0
    return counts.select(
        F.lit(fits.target.name).alias("target"), "fold", "penalty", "ord", n.alias("n"),
        F.when(known, (F.col("n11") + F.col("n00")) / n).alias("accuracy"), F.when(known, macro(*cells)["f1"]).alias("macro_f1"),
    )


def select_classifiers(df: DataFrame, targets: Sequence[Target], grid: Sequence[float] = GRID, fold: str = "fold") -> tuple[DataFrame, dict[str, tuple[Fits, float]]]:
    """(table of all scores with the winner marked, target -> (its models, the chosen penalty)).

    The table has target, fold, penalty, n, accuracy, macro_f1, selected. A target without two classes in any
    training part has null scores and no winner.
    """
    rows, chosen = [], {}
    for target in targets:
        fits = fit_folds(df, target, grid, fold)
        scores = fold_scores(df, fits, fold).collect()  # folds x penalties
        means = []
        for k, g in enumerate(fits.grid):
            got = [s[target.criterion] for s in scores if s["ord"] == k and s[target.criterion] is not None]
            means.append((sum(got) / len(got), -k, g) if got else None)
        best = max((m for m in means if m is not None), default=None)
        if best is not None:
            chosen[target.name] = fits, best[2]
        rows += [(s["target"], s["fold"], s["penalty"], s["n"], s["accuracy"], s["macro_f1"], best is not None and s["ord"] == -best[1]) for s in scores]
    schema = "target string, fold int, penalty double, n long, accuracy double, macro_f1 double, selected boolean"
    return df.sparkSession.createDataFrame(rows, schema), chosen
