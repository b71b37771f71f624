"""Cheaper plans of the line-pair queries, with the results of the plain ones."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from mtlens.functions import text as T
from mtlens.operators import distance, ngram, rules
from mtlens.sources import fixtures as fx

ODD = ["", " ", "a", ".", "..", "a..", ",,..b", ",..5", "x,--y", "a ,.. b", "(a) b!c", "a\u00a0b\u2028c d", "a\tb  c\n", "1,2:3 a:b", ",,,..", "--,-", "a. b.", "x.\u3000y", "...,--.;"]


def made(n, letters="ab,.:;-!( )\t\u00a0é", seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_word_tokens_are_those_of_four_replacements_and_one_split(spark):
    df = spark.createDataFrame([(s,) for s in ODD + made(400)] + [(None,)], "s string")
    s = F.lower("s")
    s = F.regexp_replace(s, r'([;?!@#$%&*()\[\]{}<>"])', " $1 ")
    s = F.regexp_replace(s, r"([,:])([^0-9]|$)", " $1 $2")
    s = F.regexp_replace(s, r"(\.\.+|--)", " $1 ")
    s = F.regexp_replace(s, rf"([^.])\.({T.WS_CLASS}|$)", "$1 .$2")
    plain = lambda c: F.filter(F.split(c, T.WS_RUN), lambda t: t != "")
    for r in df.select("s", plain(s).alias("w"), T.tokens_word("s").alias("g"), plain("s").alias("v"), T.tokens_ws("s").alias("h")).collect():
        assert (r.w, r.v) == (r.g, r.h), r.s
    # a text without whitespace but blanks meets no regular expression in the split
    assert "CASE WHEN RLIKE" in df.select(T.tokens_ws("s"))._jdf.queryExecution().toString().upper()


def test_chrf_words_split_one_mark(spark):
    marks = set(ngram._PUNCT)

    def split(w):
        if len(w) > 1 and w[-1] in marks:
            return [w[:-1], w[-1]]
        return [w[0], w[1:]] if len(w) > 1 and w[0] in marks else [w]

    rows = ODD + made(400)
    for r in spark.createDataFrame([(s,) for s in rows], "s string").select("s", ngram.chrf_words(F.col("s")).alias("g"), T.tokens_ws("s").alias("t")).collect():
        assert r.g == [x for w in r.t for x in split(w)], r.s


def test_words_are_numbered_from_joined_texts():
    a, an, b, bn = ngram._words(pd.Series(["x y x", "", None]), pd.Series(["y", "z", "x"]))
    assert (a.tolist(), an.tolist(), b.tolist(), bn.tolist()) == ([0, 1, 0], [3, 0, 0], [1, 2, 0], [1, 1, 1])


def test_hits_of_an_embedded_lexicon_are_exploded_from_the_row(spark):
    rows = [(1, "the cat is no good", "that cat was good"), (1, "the cat is no good", "that cat was good"), (2, None, "the"), (None, "and for and", "for the and"), (3, "was it", "is it no")]
    df = spark.createDataFrame(rows, "row_id long, ref string, mt string")
    lexicon = rules.antonym_lexicon(fx.antonym_table(spark))
    quick, joined = (rules.antonym_hits(df, lexicon, fx.FX_NEG, limit=n) for n in (None, 0))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(quick.collect(), key=key) == sorted(joined.collect(), key=key) and quick.count() > 3
    plan = quick._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(re.findall("Generate", plan)) == 1


def test_lemmas_read_the_texts_once(spark, tmp_path):
    spark.createDataFrame([("thanks the they b",), ("is it",)], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    table = fx.lemma_table(spark, str(tmp_path))
    assert {(r.word, r.lemma) for r in table.collect()} == {("thanks", "thanks"), ("the", "thanks"), ("they", "thanks"), ("is", "is"), ("it", "it")}
    assert len(re.findall("Relation", table._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_distances_side_by_side():
    r = random.Random(2)
    pairs = [tuple("".join(r.choice(letters) for _ in range(r.choice([0, 1, 63, 64, 65, 130]))) for _ in "ab") for letters in ("ab", "日x😀 ") for _ in range(200)]
    assert distance.distances(pairs).tolist() == [distance.distance(a, b) for a, b in pairs]
    assert len(distance.distances([])) == 0
    some = sorted([p for p in pairs if 0 < len(p[1]) <= len(p[0]) <= 64], key=lambda p: -len(p[1]))
    assert np.array_equal(distance._side_by_side(some, 1), [distance.distance(a, b) for a, b in some])


def test_blank_ascii_texts_meet_no_wide_class(spark):
    """Whitespace beyond ASCII is looked for in texts that hold more bytes than characters alone; tokens are Python's."""
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [f"a{c}b {c}" for c in spaces] + ["a​b c", " ", "é x", "日　本", "a b"]
    for r in spark.createDataFrame([(s,) for s in texts], "s string").select("s", T.tokens_ws("s").alias("t"), T.tokens_word("s").alias("w")).collect():
        assert r.t == r.s.split() and r.w == r.s.lower().split()
    plan = spark.range(1).select(T.tokens_ws(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "octet_length" in plan.lower()


def test_adjacency_is_for_unequal_negation_counts_alone(spark):
    """Equal counts decide without it; the hits still show it."""
    rows = [(1, "the cat", "that cat"), (2, "the cat is no good", "that no cat"), (3, "no the cat", "that cat"), (4, "the cat a b no", "that cat")]
    df = spark.createDataFrame(rows, "row_id long, ref string, mt string")
    lexicon = rules.antonym_lexicon(fx.antonym_table(spark))
    out = rules.rule_decision(df, lexicon, fx.FX_NEG)
    assert {r.row_id: r.d_rule for r in out.collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    assert {r.row_id: r.d_rule for r in rules.rule_decision(df, lexicon, fx.FX_NEG, limit=0).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    assert {r.row_id: r.neg_adjacent for r in rules.antonym_hits(df, lexicon, fx.FX_NEG).collect()} == {1: False, 2: True, 3: True, 4: False}
    plan = lambda d: d._jdf.queryExecution().analyzed().toString()
    assert "NOT (__n_ref" in plan(out) and "NOT (__n_ref" not in plan(rules.antonym_hits(df, lexicon, fx.FX_NEG))
