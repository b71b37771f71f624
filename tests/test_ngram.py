"""BLEU / chrF against small pure-Python brute-force versions of the public definitions."""

import math
import re
from collections import Counter

from mtlens.operators import ngram as NG


def _tok13a(s):
    s = s.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = s.replace(a, b)
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", s)
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
    return s.split()


def _grams(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def bleu(h, r):
    h, r = _tok13a(h), _tok13a(r)
    correct = [sum((_grams(h, n) & _grams(r, n)).values()) for n in range(1, 5)]
    total = [max(0, len(h) - n + 1) for n in range(1, 5)]
    if not any(correct):
        return 0.0
    bp = 1.0 if len(h) >= len(r) else (math.exp(1 - len(r) / len(h)) if h else 0.0)
    prec, smooth, eff = [], 1.0, 4
    for n in range(4):
        if total[n] == 0:
            break
        eff = n + 1
        if correct[n] == 0:
            smooth *= 2
            prec.append(100.0 / (smooth * total[n]))
        else:
            prec.append(100.0 * correct[n] / total[n])
    return round(bp * math.exp(sum(math.log(p) for p in prec[:eff]) / eff) / 100, 4)


def chrf(h, r, word_order=0):
    def words(s):
        out = []
        for w in s.split():
            if len(w) == 1:
                out.append(w)
            elif w[-1] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                out += [w[:-1], w[-1]]
            elif w[0] in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return out

    hs, rs = "".join(h.split()), "".join(r.split())
    stats = []
    for n in range(1, 7):
        a, b = Counter(hs[i:i + n] for i in range(len(hs) - n + 1)), Counter(rs[i:i + n] for i in range(len(rs) - n + 1))
        stats.append((sum(a.values()), sum(b.values()), sum((a & b).values())))
    hw, rw = words(h), words(r)
    for n in range(1, word_order + 1):
        a, b = _grams(hw, n), _grams(rw, n)
        stats.append((sum(a.values()), sum(b.values()), sum((a & b).values())))
    p = [m / x for x, y, m in stats if x > 0 and y > 0]
    rr = [m / y for x, y, m in stats if x > 0 and y > 0]
    if not p:
        return 0.0
    ap, ar = sum(p) / len(p), sum(rr) / len(rr)
    return round(5 * ap * ar / (4 * ap + ar), 4) if ap + ar else 0.0


CASES = [
    ("the cat sat on the mat.", "the cat sat on the mat."),
    ("the cat", "a dog barked loudly"),
    ("", "something here"),
    ("a b", "a b c d e"),
    ("It costs 1,000.50 dollars - really!", "It costs 1,000.50 dollars, really."),
    ("(hi) there, friend", "hi there friend!"),
    ("x", ""),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(CASES)], "row_id long, mt string, ref string")
    for method in ("explode", "vectorized"):
        _check(NG.sentence_metrics(df, method=method).collect())


def _check(rows):
    got = {r.row_id: r for r in rows}
    for i, (h, r) in enumerate(CASES):
        assert got[i]["BLEU"] == bleu(h, r), (h, r)
        assert got[i]["ChrF"] == chrf(h, r), (h, r)
        assert got[i]["ChrF++"] == chrf(h, r, 2), (h, r)
    assert got[0]["BLEU"] == 1.0 and got[0]["ChrF"] == 1.0


def _made(n, seed=7):
    import random

    rng = random.Random(seed)
    letters = "ab,.:;-!( )\t é1290.,.,-& 　日😀'\"_\x85\x1c"
    odd = ["<skipped>a.b", "x-\ny 5.", "&quot;a&amp;lt; b", "1..2", "..5", ".5", "5.", "a..", "5,,a", "-5 3-4 a-b", ".", "...,,,5", "", None, "\n", "a\n", "-"]
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 22))) for _ in range(n)]


def _cut_by(texts, split):
    import numpy as np

    cut = NG._cut(texts)
    at = [*np.flatnonzero(split(cut)).tolist(), len(cut.dense)]
    words = iter(["".join(map(chr, cut.dense[a:b])) for a, b in zip(at, at[1:])])
    return [[next(words) for _ in range(n)] for n in np.diff(np.searchsorted(at[:-1], cut.ends), prepend=0)]


def test_tokens_cut_in_numpy_are_those_of_the_expressions(spark):
    texts = _made(3000)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string").selectExpr("i", "s")
    got = dict(enumerate(zip(_cut_by(NG._unescaped(texts), NG._split_13a), _cut_by(texts, NG._split_mark))))
    for r in df.select("i", "s", NG.tok13a(df.s).alias("b"), NG.chrf_words(df.s).alias("w")).collect():
        assert got[r.i] == (r.b or [], r.w or []), r.s
        assert r.s is None or r.b == _tok13a(r.s)


def test_grams_counted_by_a_sort_are_those_counted_by_hashes():
    import random

    import numpy as np

    rng = random.Random(3)
    flat = lambda lists: (np.array([x for one in lists for x in one], np.uint32), np.array([len(one) for one in lists]))
    for top, symbols, packed in ((6, 5, True), (2, 9, True), (4, 5000, True), (6, 5000, False)):
        hyp = [[rng.randrange(symbols) for _ in range(rng.randint(0, 40))] for _ in range(200)]
        ref = [one[::-1] if rng.random() < 0.3 else one[3:] + one[:2] for one in hyp]
        expected = [[[max(len(a) - n + 1, 0), max(len(b) - n + 1, 0), sum((_grams(a, n) & _grams(b, n)).values())] for n in range(1, top + 1)] for a, b in zip(hyp, ref)]
        sides = *flat(hyp), *flat(ref), top
        assert NG._order_counts(*sides).tolist() == NG._hashed_counts(*sides).tolist() == expected
        assert (NG._packed_counts(*sides) is not None) == packed


def test_the_texts_alone_cross_to_python(spark):
    """No token is made in the JVM: its regular expressions took most of the time."""
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(CASES)] + [(9, None, "a b")], "row_id long, mt string, ref string")
    out = NG.sentence_metrics(df, method="vectorized")
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    key = lambda r: r.row_id
    assert sorted(out.collect(), key=key) == sorted(NG.sentence_metrics(df, method="explode").select(*out.columns).collect(), key=key)
