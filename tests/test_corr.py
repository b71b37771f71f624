"""Distributed Kendall tau-b against a brute-force O(n^2) count; Pearson guards."""

import math
import random

from mtlens.operators import corr as C


def tau_b(x, y):
    n = len(x)
    c = d = tx = ty = 0
    for i in range(n):
        for j in range(i + 1, n):
            dx, dy = x[i] - x[j], y[i] - y[j]
            if dx == 0 and dy == 0:
                continue
            if dx == 0:
                tx += 1
            elif dy == 0:
                ty += 1
            elif dx * dy > 0:
                c += 1
            else:
                d += 1
    den = math.sqrt((c + d + tx) * (c + d + ty))
    return (c - d) / den if den else None


def test_kendall_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    expect = {}
    for g in range(6):
        n = rng.randint(2, 80)
        xs = [rng.randint(0, 6) for _ in range(n)]
        ys = [rng.randint(0, 9) * (1 if g % 2 else -1) for _ in range(n)]
        rows += [(f"g{g}", float(a), float(b)) for a, b in zip(xs, ys)]
        expect[f"g{g}"] = tau_b(xs, ys) if len(set(xs)) > 1 and len(set(ys)) > 1 else None
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r.kendall_tau for r in C.kendall_tau_b(df, "x", "y", ["g"]).collect()}
    for g, e in expect.items():
        if e is None:
            assert got[g] is None
        else:
            assert math.isclose(got[g], e, abs_tol=1e-12), g
    swapped = {r.g: r.kendall_tau for r in C.kendall_tau_b(df, "y", "x", ["g"]).collect()}
    for g in expect:
        assert (got[g] is None and swapped[g] is None) or math.isclose(got[g], swapped[g], abs_tol=1e-12)


def test_constant_and_short(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 1.0)], "metric string, x double, y double")
    res = {r.metric: r for r in C.correlate(df, ["metric"]).collect()}
    assert res["a"].pearson is None and res["a"].kendall_tau is None
    assert res["b"].pearson is None and res["b"].n == 1
