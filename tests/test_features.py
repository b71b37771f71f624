import random
import time

from pyspark.sql import functions as F

from mtlens.operators.distance import distance, edit_distance
from mtlens.operators.features import SMALL, contra_features, para_features, token_overlap


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distance_equals_the_full_matrix():
    rng = random.Random(2)
    for _ in range(1500):
        letters = "abé\U0001f600x yz"[: rng.choice([1, 2, 4, 8])]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
        b = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
        near = a[: len(a) // 3] + b[:3] + a[len(a) // 2 :]
        for x, y in ((a, b), (a, near), (near, a)):
            assert distance(x, y) == brute_distance(x, y), (x, y)


def test_distance_of_near_long_texts_costs_little():
    rng = random.Random(3)
    a = "".join(rng.choice("abcdefgh ") for _ in range(2_000_000))
    b = a[:900_000] + "x" + a[900_001:1_500_000] + a[1_500_002:]
    start = time.time()
    assert distance(a[:1_000_000], a[:999_990] + "zz" + a[999_990:1_000_000]) == 2
    assert distance(a, a) == 0 and distance(a, "") == len(a)
    assert time.time() - start < 5
    c, d = a[:40_000], b[899_000:901_000]
    assert distance(a[899_000:901_000], d) == 1 and distance(c, c[5:]) == 5


def test_edit_distance_column_keeps_nulls_and_matches_the_builtin(spark):
    rng = random.Random(4)
    rows = [(None, "a"), ("a", None), ("", ""), ("", "abc"), ("éé", "é"), ("\U0001f600a", "a")]
    rows += [("".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))), "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(edit_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("e")).collect()
    assert all(r.d == r.e for r in got) and got[0].d is None


def overlap(a, b):
    s = set(a) & set(b)
    return ([i for i, t in enumerate(a) if t in s], [i for i, t in enumerate(b) if t in s], [t for t in a if t not in s], [t for t in b if t not in s])


def test_overlap_of_any_size_equals_sets(spark):
    rng = random.Random(5)
    rows = []
    for n in (0, 1, SMALL, SMALL + 1, 300, 4000):
        vocabulary = [f"t{i}" for i in range(max(1, n))] + [""]
        rows.append(([rng.choice(vocabulary) for _ in range(n)], [rng.choice(vocabulary[n // 3 :]) for _ in range(n)]))
        rows.append(([f"t{i}" for i in range(n)], [f"t{i}" for i in range(n)]))
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = token_overlap(df, "a", "b").collect()
    for r in got:
        assert (r.pos1, r.pos2, r.un1, r.un2) == overlap(r.a, r.b) and set(r.common) == set(r.a) & set(r.b)
    assert len(got) == len(rows)


def test_overlap_grows_with_the_tokens_not_their_square(spark):
    def seconds(n, *columns):
        words = lambda k: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), (i * k).cast("string")))
        df = spark.range(1).select(words(3).alias("a"), words(5).alias("b")).repartition(1).cache()
        df.count()
        took = []
        for _ in range(3):
            start = time.time()
            token_overlap(df, "a", "b").select(*columns).write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        return min(took)

    for columns in (["*"], ["un1"]):  # a single column must not move the index into the look-up
        assert seconds(80_000, *columns) < 10 * (seconds(10_000, *columns) + 0.2)  # 8 times the tokens; the square would be 64


def test_long_pairs_through_both_feature_sets(spark):
    a = [f"w{i % 900}" for i in range(3000)]
    b = [f"w{i % 1100}" for i in range(200, 3200)]
    lexicon = spark.createDataFrame([("w5", "w1000", 0, 0), ("w7", "w7777", 1, 1)], "word string, antonym string, word_pos long, anto_pos long")
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "mt string, ref string")
    got = para_features(contra_features(df, negations=["w3"]), lexicon, negations=["w3"]).collect()[0]
    p1, p2, u1, u2 = overlap(a, b)
    wod = sum(abs(x - y) for x, y in zip(p1, p2, strict=True)) / len(p1) if p1 and len(p1) == len(p2) else 0.0
    negations = (a.count("w3") + b.count("w3")) % 2
    assert got.contra_f == [negations, wod, (len(u1) + len(u2)) / 2]
    assert got.para_f[0] == len(set(a) & set(b)) / 3000 and got.para_f[3] == a.count("w5") / 3000
