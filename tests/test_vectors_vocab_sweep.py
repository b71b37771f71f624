"""Threshold sweep, token encoding, principal axes and the embedding table against brute force."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from mtlens.operators import corpus, report, vectors


def _brute_sweep(rows, taus):
    out = []
    means = []
    for label, *xs in rows:
        xs = [x for x in xs if x is not None and not math.isnan(x)]
        means.append((label.strip() if label else label, sum(xs) / len(xs) if xs else None))
    p, np_ = [m for y, m in means if y == "P"], [m for y, m in means if y == "NP"]
    for t in taus:
        a = sum(m is not None and m > t for m in p) / len(p) if p else 0.0
        b = sum(m is not None and m <= t for m in np_) / len(np_) if np_ else 0.0
        out.append((t, a, b, (a + b) / 2))
    top = max(o[3] for o in out)
    first = next(i for i, o in enumerate(out) if o[3] == top)
    return [(*o, i == first) for i, o in enumerate(out)]


def _sweep(spark, rows, taus):
    df = spark.createDataFrame(rows, "label string, m1 double, m2 double")
    return [tuple(r) for r in report.threshold_sweep(df, ["m1", "m2", "absent"], taus).collect()]


def test_threshold_sweep_is_exact(spark):
    rnd = random.Random(5)
    grid = [None, float("nan"), -1.0, -0.0, 0.0, 0.25, 0.5, 0.75, 1.0]
    rows = [(rnd.choice(["P", " NP ", "NP", "x", None]), rnd.choice(grid), rnd.choice(grid)) for _ in range(400)]
    taus = [0.5, 0.0, -0.0, 0.25, 0.5, 2.0, -2.0, 0.125, 0.375]  # unsorted, repeated, at and between the scores
    assert sorted(_sweep(spark, rows, taus)) == sorted(_brute_sweep(rows, taus))


def test_threshold_sweep_of_nothing(spark):
    for rows in ([], [(None, 0.5, 0.5)], [("P", None, None)]):
        assert sorted(_sweep(spark, rows, [0.5, 0.6])) == [(0.5, 0.0, 0.0, 0.0, True), (0.6, 0.0, 0.0, 0.0, False)]
    df = spark.createDataFrame([], "label string, m1 double")
    for bad in ([], [float("nan")], [0.5, float("inf")]):
        with pytest.raises(ValueError):
            report.threshold_sweep(df, ["m1"], bad)


def test_ten_thousand_thresholds(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["P", "NP"]), rnd.random(), rnd.random()) for _ in range(300)]
    taus = [i / 10_000 for i in range(10_000)]
    df = spark.createDataFrame(rows, "label string, m1 double, m2 double")
    took = []
    for _ in range(3):  # the first run loads classes
        began = time.perf_counter()
        res = report.threshold_sweep(df, ["m1", "m2"], taus)
        res._jdf.queryExecution().executedPlan()
        took.append(time.perf_counter() - began)
    assert min(took) < 2
    assert sorted(tuple(r) for r in res.collect()) == _brute_sweep(rows, taus)


def _encoding_case(spark):
    rnd = random.Random(7)
    long_ = "z" * 500
    words = ["the"] * 50 + [long_] * 20 + [f"w{i}" for i in range(40)] + ["w" + "z" * 64]
    rows = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 9))], None if i % 7 == 0 else [rnd.choice(words)]) for i in range(300)]
    known = ["the", long_, *[f"w{i}" for i in range(0, 40, 2)]]
    df = spark.createDataFrame(rows, "row_id long, a array<string>, b array<string>")
    vocab = spark.createDataFrame([(w, i + 2) for i, w in enumerate(known)], "word string, idx long")
    ids = {w: i + 2 for i, w in enumerate(known)}
    brute = {}
    for i, a, b in rows:
        for seq, toks in (("a", a), ("b", b)):
            if toks is not None:
                got = [ids.get(t, 1) for t in toks[:5]]
                brute[i, seq] = got + [0] * (5 - len(got))
    return df, vocab, brute


@pytest.mark.parametrize("limits", [(1000, 20_000), (0, 20_000), (0, 20), (0, 1)])
def test_encoding_is_the_same_in_every_plan(spark, limits):
    df, vocab, brute = _encoding_case(spark)
    enc = corpus.encode_tokens(df, vocab, "row_id", {"a": F.col("a"), "b": F.col("b")}, 5, *limits)
    got = {(r.row_id, r.seq): r.ids for r in enc.collect()}
    assert {k: v for k, v in got.items() if k in brute} == brute
    assert all(v == [0] * 5 for k, v in got.items() if k not in brute) and len(got) == 600


def test_no_frequent_word_meets_the_vocabulary_in_one_partition(spark):
    rows = [(i, ["the"] * 9 + [f"r{i}"]) for i in range(800)]
    df = spark.createDataFrame(rows, "row_id long, a array<string>")
    vocab = spark.createDataFrame([("the", 2)] + [(f"r{i}", i + 3) for i in range(800)], "word string, idx long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        enc = corpus.encode_tokens(df, vocab, "row_id", {"a": F.col("a")}, 10, 10, 100)
        assert enc.where((F.col("ids")[0] == 2) & (F.col("ids")[9] == F.col("row_id") + 3)).count() == 800
        # The keys that go to the shuffle join: as the operator makes them, spread over its partitions.
        keys = enc._jdf.queryExecution().optimizedPlan().toString()
        assert "xxhash64" in keys
        ex = df.select("row_id", F.posexplode("a").alias("pos", "w"))
        spread = ex.select(F.when(F.col("w") == "the", F.concat(F.lit("-"), F.xxhash64("row_id", F.lit("a"), "pos").cast("string"))).otherwise(F.concat(F.lit("w"), "w")).alias("k"))
        sizes = [r[1] for r in spread.repartition(8, "k").groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 1.2 * 8000 / 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def _pca_brute(x, k):
    c = x - x.mean(axis=0)
    _, s, axes = np.linalg.svd(c, full_matrices=False)
    axes = axes[:k]
    lead = np.argmax(np.abs(axes), axis=1)
    axes = axes * np.sign(axes[np.arange(k), lead])[:, None]
    return c @ axes.T


def test_reduced_vectors_equal_a_brute_force_pca(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 12)) * np.linspace(9, 1, 12) @ rng.normal(size=(12, 12)) + 1e4  # far from the origin
    rows = [(i, [float(a) for a in v], "kept") for i, v in enumerate(x)]
    odd = [(900, None, "k"), (901, [], "k"), (902, [1.0, None] + [0.0] * 10, "k"), (903, [float("nan")] * 12, "k"), (904, [float("inf")] * 12, "k")]
    df = spark.createDataFrame(rows + odd, "i long, vec array<double>, __idx string")
    for parts in (1, 5):
        red = vectors.reduce_dims(df.repartition(parts), 4)
        assert red.columns == ["i", "vec", "__idx", "vec_k"]
        got = {r.i: r.vec_k for r in red.collect()}
        assert all(got.pop(i) is None for i in range(900, 905))
        assert np.allclose([got[i] for i in range(500)], _pca_brute(x, 4), atol=1e-6)


def test_reduce_dims_of_odd_tables(spark):
    empty = spark.createDataFrame([(1, None)], "i long, vec array<double>")
    assert [r.vec_k for r in vectors.reduce_dims(empty, 2).collect()] == [None]
    with pytest.raises(ValueError):
        vectors.reduce_dims(spark.createDataFrame([(1, [1.0])], "i long, vec array<double>"), 2)
    with pytest.raises(Exception, match="components"):
        vectors.reduce_dims(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "i long, vec array<double>").coalesce(1), 1).collect()
    one = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "i long, vec array<float>")
    assert all(np.allclose(r.vec_k, [0, 0]) for r in vectors.reduce_dims(one, 2).collect())


def test_embedding_table_gives_every_word_a_row(spark):
    vocab = corpus.build_vocab(spark.createDataFrame([("b a", "c <PAD>")], "s1 string, s2 string"))
    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("c", [3.0, 4.0]), ("other", [5.0, 6.0])], "word string, vec array<double>")
    got = {r.idx: (r.word, r.vec) for r in vectors.embedding_table(vocab, vecs, 2).collect()}
    assert got[0] == ("<PAD>", [0.0, 0.0]) and got[1][0] == "<UNK>" and all(abs(v) <= 0.25 for v in got[1][1])
    assert got[2] == ("a", [1.0, 2.0]) and got[3] == ("b", [0.0, 0.0]) and got[4] == ("c", [3.0, 4.0]) and len(got) == 5
