"""Null groups, failed scores, unlabelled rows: what the oracle data does not hold."""

import math

import pandas as pd
from pyspark.sql import functions as F

from mtlens.operators import corpus, corr, folds, learn, sets, vectors
from mtlens.operators.rank import dense_rank
from mtlens.plans.pipeline import refine
from mtlens.sources import fixtures, io


def test_null_groups_are_groups(spark):
    rows = [(None if i % 10 == 0 else f"g{i % 7}", float(i % 13), float(i * i % 11)) for i in range(100)]
    df = spark.createDataFrame(rows, "src string, x double, y double")
    assert folds.group_kfold(df).count() == 100
    got = {r.src: r.n for r in corr.kendall_tau_b(df, "x", "y", ["src"]).collect()}
    assert got[None] == 10 and sum(got.values()) == 100
    assert dense_rank(df, "x", ["src"]).where("src is null").count() == df.where("src is null").select("x").distinct().count()


def test_binary_x_is_no_hot_bucket(spark):
    """Equal x spreads over the range partitions, and the answer stays that of the pair count."""
    rows = [(float(i % 2), float((i * 7919) % 251)) for i in range(600)]
    df = spark.createDataFrame(rows, "x double, y double")
    conc = disc = tx = ty = 0
    for i, (a, b) in enumerate(rows):
        for c, d in rows[:i]:
            s = (a - c) * (b - d)
            conc, disc, tx, ty = conc + (s > 0), disc + (s < 0), tx + (a != c), ty + (b != d)
    assert math.isclose(corr.kendall_tau_b(df, "x", "y").first().kendall_tau, (conc - disc) / math.sqrt(tx * ty), rel_tol=1e-9)
    sizes = df.repartitionByRange(8, "x", "y").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 200


def test_failed_scores_stay_missing(spark):
    def load():
        return lambda a, b: pd.Series([float("nan") if x == "bad" else 2.0 for x in a])

    df = spark.createDataFrame([("bad", "x"), ("ok", "x")], "a string, b string")
    assert [r.s for r in df.select(learn.score_with_model(load, "a", "b").alias("s")).collect()] == [None, 1.0]


def test_lean_scores_undecided_rows_alone(spark):
    count = spark.sparkContext.accumulator(0)

    def load():
        def run(a, b):
            count.add(len(a))
            return pd.Series([0.25] * len(a))

        return run

    df = spark.createDataFrame([(i, "good" if i % 5 else "x", "bad" if i % 5 else "x", 0.5) for i in range(50)], "row_id long, ref string, mt string, m double")
    from mtlens.operators.rules import antonym_lexicon

    lex = antonym_lexicon(fixtures.antonym_table(spark, [("good", "bad")]))
    scorer = lambda still: learn.score_with_model(load, "mt", "ref", only=still)
    out = refine(df, lex, ["m"], ["not"], lean=True, scorers={"d_contra": scorer, "d_para": F.lit(0.9)}).collect()
    assert len(out) == 50 and count.value == 10
    assert all((r.d_contra is None) == (r.d_rule is not None) for r in out)
    full = refine(df, lex, ["m"], ["not"], scorers={"d_contra": scorer, "d_para": F.lit(0.9)}).collect()
    assert sorted((r.row_id, r.d_score) for r in out) == sorted((r.row_id, r.d_score) for r in full)


def test_lean_reads_its_input_once(spark, tmp_path):
    spark.createDataFrame([(i, "good x", "bad" if i % 2 else "x") for i in range(40)], "row_id long, ref string, mt string").write.parquet(str(tmp_path / "t"))
    from mtlens.operators.rules import antonym_lexicon

    lex = antonym_lexicon(fixtures.antonym_table(spark, [("good", "bad")]))
    scorers = {"d_contra": lambda still: learn.score_with_model(learn.overlap_scorer, "mt", "ref", only=still), "d_para": F.lit(0.4)}
    out = refine(spark.read.parquet(str(tmp_path / "t")), lex, [], ["not"], lean=True, scorers=scorers)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("ArrowEvalPython") == 1
    assert {(r.d_rule, r.d_contra, r.d_score) for r in out.collect()} == {(0, None, 0.0), (None, 0.5, 0.5)}


def test_failed_and_missing_scores_in_a_masked_batch(spark):
    def load():
        return lambda a, b: pd.Series([float("nan") if x == "bad" else 2.0 for x in a])

    df = spark.createDataFrame([("bad", True), ("ok", True), ("ok", False), (None, None)], "a string, f boolean")
    assert [r.s for r in df.select(learn.score_with_model(load, "a", "a", only=F.col("f")).alias("s")).collect()] == [None, 1.0, None, None]


def test_special_words_and_null_order(spark):
    t = spark.createDataFrame([("<UNK> a", "b <PAD>")], "s1 string, s2 string")
    assert sorted((r.idx, r.word) for r in corpus.build_vocab(t).collect()) == [(0, "<PAD>"), (1, "<UNK>"), (2, "a"), (3, "b")]
    df = spark.createDataFrame([("k", None, "x"), ("k", 2, "y"), ("n", None, "z")], "src string, row_id int, v string")
    assert sorted((r.src, r.v) for r in sets.dedup_first(df, ["src"]).collect()) == [("k", "y"), ("n", "z")]


def test_classifier_learns_from_labelled_rows(spark):
    rows = [(i, i % 3 + 1, float(i % 2), None if i % 5 == 0 else i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, fold int, f double, y int")
    got = {r.row_id: r.p for r in learn.train_pair_classifier(df, ["f"], out="p").collect()}
    assert len(got) == 90 and all((got[i] > 0.5) == bool(i % 2) for i in got)
    weights = learn.fold_class_weights(df).collect()
    assert len(weights) == 6 and all(r.n_train == sum(1 for _, f, _, y in rows if f != r.fold and y == r.y) for r in weights)


def test_pca_truncates_to_the_largest_variances(spark):
    rows = [(f"w{i}", [float(i % 7) * 5, float(i % 5), float(i % 3) / 9, 1.0]) for i in range(60)]
    red = vectors.reduce_dims(spark.createDataFrame(rows, "word string, vec array<double>"), 2)
    v = red.select(F.col("vec_k")[0].alias("a"), F.col("vec_k")[1].alias("b")).agg(F.var_pop("a"), F.var_pop("b"), F.covar_pop("a", "b")).first()
    assert v[0] > v[1] > 0 and abs(v[2]) < 1e-9


def test_mean_pool_leaves_out_both_ends(spark):
    rows = [("w", i, [float(i), 1.0]) for i in range(5)] + [("s", 0, [1.0, 1.0])] + [("e", i, [1.0, 2.0]) for i in (0, 0, 1, 1)]
    got = {r.word: r.vec for r in vectors.mean_pool(spark.createDataFrame(rows, "word string, pos int, vec array<double>")).collect()}
    assert got["w"] == [2.0, 1.0] and got["e"] == [0.0, 0.0] and all(abs(x) <= 0.25 for x in got["s"])


def test_every_document_has_a_pair(spark, tmp_path):
    rows = [(1, "one line", "en", "s"), (2, "a\nb\nc", "en", "s"), (3, None, "en", "s"), (4, "", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.ref, r.mt) for r in fixtures.line_pairs(spark, str(tmp_path)).collect()]
    assert sorted(got) == [(1, "one line", "one line"), (2, "a", "b"), (2, "b", "c"), (3, "", ""), (4, "", "")]


def test_readers_and_tsv(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"Source": " s ", "Translation": "t", "Reference": "r", "da": "1.5"}\n{"Source": "s2", "Translation": "t", "Reference": "r", "da": 2}\n')
    got = io.scan_train_jsonl(spark, str(tmp_path / "t.jsonl"), "da")
    assert [(r.src, r.score) for r in got.orderBy("row_order").collect()] == [("s", 1.5), ("s2", 2.0)]
    (tmp_path / "a.csv").write_text("word_hi,antonym_hi\nup,down\nhot,cold\n")
    assert sorted(map(tuple, io.scan_antonyms(spark, str(tmp_path / "a.csv")).collect())) == [(0, "up", "down"), (1, "hot", "cold")]
    (tmp_path / "h.csv").write_text('ref,mt,human_score\n" a ","b, c",7\nx,y,bad\n')
    assert [tuple(r) for r in io.scan_human_csv(spark, str(tmp_path / "h.csv")).collect()] == [("a", "b, c", 7.0), ("x", "y", None)]
    io.write_results(spark.createDataFrame([('say "hi"', "b", 1)], "s1 string, s2 string, label int"), str(tmp_path / "out"), "tsv")
    assert [tuple(r) for r in io.scan_labelled_tsv(spark, str(tmp_path / "out"))[0].collect()] == [('say "hi"', "b", "1")]


def test_lines_of_one_part_are_dropped_before_substitution(spark):
    """A side without text leaves one part; the filter for antonyms reads the second one of every line."""
    from mtlens.operators import rules

    lexicon = rules.antonym_lexicon(fixtures.antonym_table(spark))
    rows = [(1, "The cat", "x y"), (2, "", "the y"), (3, "the y", " "), (4, None, "the y"), (5, None, None), (6, "\t", "the"), (7, "a", "b the"), (8, "a", "b")]
    pairs = spark.createDataFrame(rows, "pair_id long, s1 string, s2 string")
    for limit in (None, 0):
        got = corpus.contradiction_pairs(corpus.paraphrase_pairs(corpus.pair_lines(pairs)), lexicon, limit=limit).collect()
        assert sorted(tuple(r) for r in got) == [(1, "that cat", "x y", 0), (7, "b that", "a", 0)]
