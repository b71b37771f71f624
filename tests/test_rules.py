"""Hand cases for the negation/antonym rule (each branch, last hit wins, XOR adjacency)."""

from mtlens.operators import rules
from mtlens.sources.fixtures import antonym_table


def _decide(spark, pairs, lex_rows, negations=None, join_path=False):
    lex = rules.antonym_lexicon(antonym_table(spark, lex_rows))
    df = spark.createDataFrame([(i, r, m) for i, (r, m) in enumerate(pairs)], "row_id long, ref string, mt string")
    kw = {} if negations is None else {"negations": negations}
    if join_path:
        out = rules.rule_decision(df, lex, **kw, limit=0)
    else:
        out = rules.rule_decision(df, lex, **kw)
    return [r.d_rule for r in out.orderBy("row_id").collect()]


HINDI = [("अच्छा", "बुरा")]


def test_hindi_frames(spark):
    pairs = [
        ("यह अच्छा है", "यह बुरा नहीं है"),   # antonym, one side negated next to it -> reward
        ("यह अच्छा है", "यह बुरा है"),        # antonym, equal negation counts -> penalty
        ("यह अच्छा है", "यह अच्छा नहीं है"),   # no antonym hit, counts differ -> penalty
        ("यह अच्छा है", "यह अच्छा है"),       # identical -> no trigger
    ]
    assert _decide(spark, pairs, HINDI) == [1, 0, 0, None]
    assert _decide(spark, pairs, HINDI, join_path=True) == [1, 0, 0, None]


def test_cross_antonym_and_far_negation(spark):
    lex = [("good", "bad")]
    neg = ["not"]
    pairs = [
        ("good and bad", "bad"),                  # antonym bad in both -> cross -> 1
        ("good x x x x", "not y y y bad"),        # counts differ, negation far from bad -> no write; start 0
        ("good", "bad not"),                      # negation right after -> 1
    ]
    assert _decide(spark, pairs, lex, neg) == [1, 0, 1]
    assert _decide(spark, pairs, lex, neg, join_path=True) == [1, 0, 1]


def test_last_hit_wins(spark):
    # hits in dictionary order: (up -> down) writes 0 (equal counts), (hot -> cold) also 0;
    # then make the last hit a cross hit writing 1.
    lex = [("up", "down"), ("hot", "cold")]
    pairs = [("up hot", "down cold"), ("up hot cold", "down cold")]
    assert _decide(spark, pairs, lex, ["not"]) == [0, 1]
    assert _decide(spark, pairs, lex, ["not"], join_path=True) == [0, 1]


def test_lexicon_positions(spark):
    lex = rules.antonym_lexicon(antonym_table(spark, [("a", "b"), ("a", "c"), (" b ", "d")]))
    rows = {(r.word, r.antonym): (r.word_pos, r.anto_pos) for r in lex.collect()}
    assert rows[("a", "b")] == (0, 0)
    assert rows[("b", "a")] == (1, 1)
    assert rows[("a", "c")] == (0, 2)
    assert rows[("b", "d")] == (1, 4)   # stripped, same key as before
    assert rows[("d", "b")] == (5, 5)


def test_plans_agree_without_and_with_repeated_ids(spark):
    """The size of the lexicon picks the plan, never the answer."""
    import random

    from mtlens.operators import corpus, features

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["not"] * 3
    lex = rules.antonym_lexicon(antonym_table(spark, [(f"w{i}", f"w{(i * 7 + 1) % 30}") for i in range(25)]))
    rows = [(i // 2, " ".join(rng.choices(vocabulary, k=rng.randint(0, 9))), " ".join(rng.choices(vocabulary, k=rng.randint(0, 9)))) for i in range(120)]
    rows += [rows[0], (7, None, "w1"), (7, "w1  w2", "x   y")]
    df = spark.createDataFrame(rows, "row_id long, ref string, mt string")

    def same(f):
        a, b = (sorted(map(str, f(limit).collect())) for limit in (None, 0))
        assert a == b and a

    for frame in (df, df.drop("row_id")):
        same(lambda limit, frame=frame: rules.rule_decision(frame, lex, ["not"], limit=limit))
        same(lambda limit, frame=frame: features.para_features(frame.dropna(), lex, negations=["not"], limit=limit))
    pairs = df.select(df.row_id.alias("pair_id"), df.ref.alias("s1"), df.mt.alias("s2"))
    same(lambda limit: corpus.contradiction_pairs(pairs, lex, limit=limit))
    got = corpus.contradiction_pairs(spark.createDataFrame([(1, "a w1", "x   y")], "pair_id long, s1 string, s2 string"), lex).first()
    assert got.s2 == "x   y"


def test_large_lexicon_plans_quickly(spark):
    import time

    rows = [(f"a{i}", f"b{i}") for i in range(4000)]
    lex = rules.antonym_lexicon(antonym_table(spark, rows))
    df = spark.createDataFrame([("a7 x", "b7 y"), ("a1", "c")], "ref string, mt string")
    start = time.time()
    out = rules.rule_decision(df, lex, ["not"])
    assert [r.d_rule for r in out.collect()] == [0, None] and time.time() - start < 30


def brute_decision(ref, mt, antonyms, lemma, negations):
    """The rule over a dictionary, forms and lemmas, read off its definition."""
    r, m = ref.split(), mt.split()
    n_ref, n_mt = (sum(t in negations for t in x) for x in (r, m))
    decision = 0 if n_ref != n_mt else None

    def near(word, tokens):
        if word not in tokens:
            return False
        i = tokens.index(word)
        return any(t in negations for t in tokens[max(0, i - 2) : i] + tokens[i + 1 : i + 3])

    for word, others in antonyms.items():
        for other in others:
            if not ((word in r or lemma.get(word, word) in r) and (other in m or lemma.get(other, other) in m)):
                continue
            if n_ref == n_mt:
                decision = 0
            elif (near(other, m) or near(word, m)) != (near(word, r) or near(other, r)):
                decision = 1
            if any(a in m and a in r and any(b in r for b in antonyms[a]) for a in others):
                decision = 1
    return decision


def test_lemmas_meet_forms_in_both_plans(spark):
    import random

    rng = random.Random(6)
    words = [f"{stem}{end}" for stem in "abcdefgh" for end in ("", "s", "t")]
    lemma = {w: w[0] for w in words if len(w) == 2 and w != "gs"}
    csv = [(rng.choice(words), rng.choice(words)) for _ in range(14)]
    antonyms = {}
    for w, a in csv:
        antonyms.setdefault(w, []).append(a)
        antonyms.setdefault(a, []).append(w)
    lex = rules.antonym_lexicon(antonym_table(spark, csv))
    lemmas = spark.createDataFrame([*lemma.items(), ("as", "z"), (None, "x"), ("bs", None)], "word string, lemma string")
    text = lambda: " ".join(rng.choices([*words, "not", "x", "y"], k=rng.randint(0, 8)))
    rows = [(i, text(), text()) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, ref string, mt string")
    expected = {i: brute_decision(r, m, antonyms, lemma, ["not"]) for i, r, m in rows}
    surface = {i: brute_decision(r, m, antonyms, {}, ["not"]) for i, r, m in rows}
    assert expected != surface
    for limit in (None, 1):
        got = rules.rule_decision(df, lex, ["not"], limit=limit, lemmas=lemmas).collect()
        assert {r.row_id: r.d_rule for r in got} == expected
        got = rules.rule_decision(df, lex, ["not"], limit=limit).collect()
        assert {r.row_id: r.d_rule for r in got} == surface
