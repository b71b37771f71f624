import math
import random

import numpy as np
import pytest

from mtlens.operators import selection as SE

SCHEMA = "row_id long, fold int, a double, b double, y int, z int"


def rows(n=900):
    rng = random.Random(8)
    out = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(3, 20)
        y = int(a + 0.05 * b + rng.gauss(0, 0.5) > 0.4)
        out.append((i, 1 + i % 3, a, b if i % 31 else None, y if i % 7 else None, int(b > 0) if i % 5 else 2))
    return [*out, (n, None, 1.0, 1.0, 1, 1), (n + 1, 2, math.nan, 0.0, None, 0)]


def plain_fit(x, y, penalty, steps=40000):
    """Gradient descent on the same loss."""
    w = np.where(y == 1, len(y) / (y == 1).sum(), len(y) / (y == 0).sum())
    b = np.zeros(x.shape[1] + 1)
    x = np.column_stack([x, np.ones(len(x))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ b)))
        g = x.T @ (w * (p - y)) / w.sum() + penalty * np.append(b[:-1], 0)
        b -= g
        if np.abs(g).max() < 1e-9:
            break
    return b


def recount(data, fits, label, penalty, fold):
    cells = [0, 0, 0, 0]
    weights = fits.weights[fold, penalty]
    for r in data:
        y = r[label]
        if r[1] != fold or y not in (0, 1):
            continue
        x = [m if v is None or math.isnan(v) else v for v, m in zip(r[2:4], fits.mean)]
        margin = weights[-1] + sum((v - m) / s * w for v, m, s, w in zip(x, fits.mean, fits.scale, weights[:-1]))
        cells[(0 if margin >= 0 else 1) if y else (2 if margin >= 0 else 3)] += 1
    n11, n10, n01, n00 = cells
    f1, f0 = 2 * n11 / (2 * n11 + n01 + n10), 2 * n00 / (2 * n00 + n01 + n10)
    return sum(cells), (n11 + n00) / sum(cells), (f1 + f0) / 2


def test_models_winner_and_probabilities_equal_a_recount(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    targets = [SE.Target("para", ("a", "b"), "y"), SE.Target("contra", ("a", "b"), "z", "accuracy")]
    grid = (0.01, 1.0, 100.0)
    table, chosen = SE.select_classifiers(df, targets, grid)
    got = {(r.target, r.fold, r.penalty): r for r in table.collect()}
    assert len(got) == 2 * 3 * 3
    for target, label in zip(targets, (4, 5), strict=True):
        fits, winner = chosen[target.name]
        means = []
        for g in grid:
            scores = [recount(data, fits, label, g, i) for i in (1, 2, 3)]
            for i, (n, accuracy, macro_f1) in zip((1, 2, 3), scores, strict=True):
                r = got[target.name, i, g]
                assert (r.n, r.selected) == (n, g == winner) and math.isclose(r.accuracy, accuracy) and math.isclose(r.macro_f1, macro_f1)
            means.append(sum(s[1 if target.criterion == "accuracy" else 2] for s in scores))
        assert winner == grid[means.index(max(means))]
    fits, winner = chosen["para"]
    train = [r for r in data if r[1] in (1, 3) and r[4] in (0, 1)]
    x = np.array([[(m if v is None else v) for v, m in zip(r[2:4], fits.mean)] for r in train])
    expected = plain_fit((x - fits.mean) / fits.scale, np.array([r[4] for r in train]), 0.01)
    assert np.allclose(fits.weights[2, 0.01], expected, atol=1e-5)
    probability = {r.row_id: r.p for r in df.select("row_id", fits.probability(winner, df.fold).alias("p")).collect()}
    assert probability[900] is None and 0 < probability[901] < 1 and all(p is not None for i, p in probability.items() if i < 900)


def test_one_class_and_empty_tables_have_no_winner(spark):
    target = SE.Target("t", ("a",), "y")
    same = spark.createDataFrame([(i, 1 + i % 2, 1.0, 1.0, 1, 0) for i in range(6)], SCHEMA)
    table, chosen = SE.select_classifiers(same, [target], (1.0,))
    assert chosen == {} and [(r.n, r.macro_f1, r.selected) for r in table.orderBy("fold").collect()] == [(0, None, False)] * 2
    table, chosen = SE.select_classifiers(same.limit(0), [target], (1.0,))
    assert chosen == {} and table.count() == 0
    with pytest.raises(ValueError, match="criterion"):
        SE.fit_folds(same, SE.Target("t", ("a",), "y", "auc"))


def test_separable_classes_converge(spark):
    df = spark.createDataFrame([(i, 1 + i % 3, float(i - 30), 0.0, int(i >= 30), 0) for i in range(60)], SCHEMA)
    table, chosen = SE.select_classifiers(df, [SE.Target("t", ("a",), "y")], (1e-4, 1.0))
    assert all(np.isfinite(w).all() for w in chosen["t"][0].weights.values())
    assert all(r.accuracy > 0.9 for r in table.collect())
