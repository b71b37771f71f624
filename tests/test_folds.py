import random

from pyspark.sql import functions as F

from mtlens.operators import folds as FO


def naive(sizes, k=3):
    loads = [0] * k
    out = {}
    for g, s in sorted(sizes.items(), key=lambda t: (-t[1], t[0])):
        f = min(range(k), key=lambda i: (loads[i], i))
        loads[f] += s
        out[g] = f + 1
    return out


def test_runs_match_greedy():
    rng = random.Random(3)
    for _ in range(40):
        sizes = {f"s{i:04d}": rng.choice([1, 1, 1, 2, 3, 5, rng.randint(1, 60)]) for i in range(rng.randint(3, 300))}
        hist = {}
        for s in sizes.values():
            hist[s] = hist.get(s, 0) + 1
        runs = FO.fold_runs(list(hist.items()))
        got = {}
        by_size = {}
        for g, s in sorted(sizes.items(), key=lambda t: t[0]):
            by_size.setdefault(s, []).append(g)
        for s, lo, hi, folds in runs:
            for r in range(lo, hi):
                got[by_size[s][r]] = folds[(r - lo) % len(folds)] + 1
        assert got == naive(sizes)


def test_group_kfold_disjoint(spark):
    rows = [(i, f"g{i % 37 if i % 5 else 0}") for i in range(600)]  # group g0 is hot
    df = spark.createDataFrame(rows, "row_id long, src string")
    out = FO.group_kfold(df, "src", 3)
    per = out.groupBy("src").agg(F.countDistinct("fold").alias("k")).where("k > 1").count()
    assert per == 0
    assert out.count() == 600
    sizes = {r.src: r.n for r in df.groupBy("src").agg(F.count("*").alias("n")).collect()}
    expect = naive(sizes)
    assert {r.src: r.fold for r in out.select("src", "fold").distinct().collect()} == expect


def test_failed_runs_never_win(spark):
    nan = float("nan")
    rows = [(1, "a", 0.5, 0), (1, "b", nan, 1), (1, "c", 0.9, 2), (1, "d", 0.9, 3), (2, "a", nan, 0), (2, "b", -1.0, 1), (3, "a", None, 0), (3, "b", nan, 1)]
    got = FO.pick_best(spark.createDataFrame(rows, "g int, run string, score double, o int"), "run", "score", "o", ["g"])
    assert {(r.g, r.best_run, r.best_score) for r in got.collect()} == {(1, "c", 0.9), (2, "b", -1.0), (3, None, None)}


def test_out_of_fold_scores_by_key(spark):
    import pytest

    df = spark.createDataFrame([(1, "s", "m", None), (2, "s", "m", "r"), (3, "s", "m", "r")], "row_id int, src string, mt string, ref string")
    val = spark.createDataFrame([("s", "m", None, 1, 1, 0.1), ("s", "m", "r", 1, 9, 0.2), ("s", "m", "r", 2, 1, 0.3), ("s", "m", "r", 2, 0, 0.4)],
                                "src string, mt string, ref string, fold int, row int, score double")
    assert {r.row_id: r.oof_score for r in FO.oof_scores(df, val).collect()} == {1: 0.1, 2: 0.3, 3: 0.3}
    with pytest.raises(Exception, match="out-of-fold"):
        FO.oof_scores(df, val.where("ref is not null")).collect()
    assert FO.oof_scores(df, val.where("ref is not null"), check=False).where("oof_score is null").count() == 1
