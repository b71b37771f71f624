import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from .conftest import DOCS
from pyspark.sql import functions as F

from mtlens.llm import ngram_join
from mtlens.llm.common import shingle_sets, words

A_TO_Z = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_TO_Z))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_force(rows):
    """{(doc_id, n): component} by all pairs that share a shingle."""
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, (_, s) in enumerate(sets):
        for j, k in Counter(j for x in s for j in where[x] if j > i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j][1]) - k):
                parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def corpus(prose, edge_rows):
    rng = random.Random(1)
    rows, passage = [], prose(60)
    for i in range(60):
        rows.append((i, prose(rng.randint(6, 120))))
    base = prose(80).split()
    for i in range(100, 160):  # a chain of near copies: neighbours link, the ends don't
        k = rng.randrange(len(base))
        base[k : k + 1] = [f"edit{i}"]
        rows.append((i, " ".join(base)))
    big = prose(300).split()
    for i in range(200, 240):  # a large group with a few edits each
        mine = list(big)
        for _ in range(rng.randint(1, 12)):
            mine[rng.randrange(300)] = f"x{rng.randrange(999)}"
        rows.append((i, " ".join(mine).upper() if i % 2 else " ".join(mine)))
    rows += [(i, prose(100) + " " + passage) for i in range(300, 340)]  # a shared passage links nothing
    rows += [(i, "the same few words again") for i in range(400, 440)]
    return rows + [(r[0], r[1]) for r in edge_rows]


def test_words_are_split_at_ascii_white_space_only():
    texts = [None, "", "  A b\tÇ ", "x"]
    offsets, codes, vocabulary = words(pa.array(texts))
    assert [[vocabulary[c].as_py() for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [[], [], ["a b", "Ç"], ["x"]]
    assert [len(s) for s in shingle_sets(pa.array(["a b c d e f", "a b c d", "", "a b c d"]))] == [2, 1, 0, 1]


def test_components_equal_brute_force(spark, prose, edge_rows, monkeypatch):
    rows = corpus(prose, edge_rows)
    monkeypatch.setattr(ngram_join, "CHUNK", 2_000)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string").repartition(5)
    got = sorted((tuple(r) for r in ngram_join.link_documents(docs).collect()), key=str)
    assert got == brute_force(rows)


def subset_pairs(prose, n=60):
    """Texts and their copies cut off, or extended, to 4:3 to 5:4 of the size, around the threshold; some cuts in a group of three."""
    rng = random.Random(11)
    rows = []
    for i in range(n):
        whole = prose(rng.randint(60, 240)).split()
        cut = -(-(len(whole) - 4) * rng.randint(74, 81) // 100) + 4
        rows += [(1000 + 10 * i, " ".join(whole)), (1001 + 10 * i, " ".join(whole[:cut]))]
        if i % 3 == 0:
            rows.append((1002 + 10 * i, " ".join(whole[len(whole) - cut :])))
        if i % 3 == 1:
            rows.append((1003 + 10 * i, " ".join(whole) + " " + prose(len(whole) * rng.randint(26, 34) // 100)))
    return rows


def test_copies_cut_off_or_extended_equal_brute_force(spark, prose):
    rows = subset_pairs(prose)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in ngram_join.link_documents(docs).collect()), key=str)
    expected = brute_force(rows)
    assert got == expected and sum(d != c for d, _, c in expected) > 50


def test_filters_keep_every_pair_that_links(spark):
    """Random sets of 2 to 40 tokens, posted as the join does: all pairs within the threshold pass each filter."""
    rng = random.Random(13)
    sets = []
    for _ in range(60):
        x = rng.sample(range(400), rng.randint(4, 40))
        sets.append(sorted(x))
        sets.append(sorted(x[: -(-len(x) * rng.randint(70, 100) // 100)]))  # a part of it
        sets.append(sorted({*x, *rng.sample(range(400), len(x) * rng.randint(0, 40) // 100)}))  # and more than it
    sets = sorted({tuple(x) for x in sets})
    posted = [(t, i, len(x), p) for i, x in enumerate(sets) for p, t in enumerate(x[: ngram_join.prefix_length(len(x), 75)])]
    many = Counter(t for t, *_ in posted)
    lists = spark.createDataFrame([r for r in posted if many[r[0]] > 1], "token long, node long, n int, pos int")
    lists = ngram_join._ranked(lists, 75).cache()
    linked = {(i, j) for i, x in enumerate(sets) for j in range(i + 1, len(sets)) if 100 * (k := len({*x} & {*sets[j]})) >= 75 * (len(x) + len(sets[j]) - k)}
    assert len(linked) > 60
    first = {(r.a, r.b) for r in ngram_join._met_first(lists.withColumn("label", F.col("node")), 75).collect()}
    assert linked <= first
    pairs = spark.createDataFrame(sorted(linked), "a long, b long")
    assert {(r.a, r.b) for r in ngram_join._may_link_by_prefix(pairs, lists, 75).collect()} == linked


def test_no_rows(spark):
    assert ngram_join.link_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_lists_stream_over_batches():
    """Posting lists cut anywhere give the same rows."""
    rng = random.Random(2)
    rows = sorted((rng.randrange(30), rng.randrange(4), rng.randrange(5)) for _ in range(200))
    rows = [(t, t * 10 + n * 5 + v, n, 0) for t, n, v in rows]
    rows.sort(key=lambda r: (r[0], r[2], r[1]))
    distinct = sorted(set(rows), key=lambda r: (r[0], r[2], r[1]))
    many = Counter(r[0] for r in distinct)
    expected = [r for r in distinct if many[r[0]] > 1]
    names = ["token", "node", "n", "pos"]
    for step in (1, 2, 3, 7, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + step], strict=True)], names=names) for i in range(0, len(rows), step)]
        got = [tuple(r[n] for n in names) for b in ngram_join._lists(iter(batches)) for r in b.to_pylist()]
        assert got == expected


def test_labels_of_a_long_chain(spark):
    links = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = ngram_join.components(links).collect()
    assert len(got) == 201 and {r.label for r in got} == {0}


def test_no_further_order_drops_a_pair_that_links():
    rng = np.random.default_rng(11)
    dropped = 0
    for _ in range(1500):
        n, percent = int(rng.integers(1, 200)), int(rng.choice([50, 75, 90]))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[: int(rng.integers(0, n + 1))], rng.integers(0, 2**63, int(rng.integers(0, n // 2 + 1))).astype(np.uint64)])
        x, y = np.unique(x), np.unique(y)
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        links = 100 * both >= percent * (len(x) + len(y) - both)
        rows = [ngram_join.order_prefixes(t, percent).view(np.uint8) for t in (x, y)]
        met = ngram_join._meet_in_orders(*rows, percent)
        assert met or not links
        assert met == ngram_join._meet_in_orders(*rows[::-1], percent)
        assert ngram_join._links_exactly(x.view(np.uint8), y.view(np.uint8), percent) == links
        dropped += not met
    assert dropped > 300  # a filter, not a formality
