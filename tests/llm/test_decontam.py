import random
from collections import Counter

from mtlens.llm import decontam

from .conftest import DOCS


def bag(ws, width):
    w = min(width, len(ws))
    return Counter(tuple(ws[i : i + w]) for i in range(len(ws) - w + 1))


def brute_force(docs, items, percent=75):
    """{(doc_id, item_id): best similarity} over all windows."""
    out = {}
    for d, text in docs:
        ws = (text or "").lower().split()
        for i, t in items:
            it = (t or "").lower().split()
            if not it:
                continue
            width = min(5, len(it))
            b, n = bag(it, 5), min(len(it), len(ws))
            for s in range(len(ws) - n + 1):
                if n < width:
                    break
                x = Counter(tuple(ws[s + k : s + k + width]) for k in range(n - width + 1))
                both = sum((x & b).values())
                either = sum(x.values()) + sum(b.values()) - both
                if 100 * both >= percent * either:
                    out[d, i] = max(out.get((d, i), 0), both / either)
    return out


def corpus(prose):
    rng = random.Random(3)
    items = [(i, prose(rng.randint(14, 59))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "only three words"), (93, "again and again and again and again and again and again and again"), (94, items[0][1])]
    docs = [(i, prose(rng.randint(20, 150))) for i in range(40)]
    for k in range(100, 170):  # whole, upper case, edited, cut, glued
        words = items[k % 25][1].split()
        if k % 5 == 1:
            words = [w.upper() for w in words]
        if k % 5 == 2:
            words[len(words) // 2] = "changed"
        if k % 5 == 3:
            words = words[: int(len(words) * 0.9)]
        if k % 5 == 4:
            words[-1] += "&&&"
        docs.append((k, prose(30) + " " + "\n".join(words) + " " + prose(30)))
    docs += [(200, items[3][1]), (201, " ".join(items[4][1].split()[:-2])), (202, "x only three words y"), (203, "again and " * 40), (204, None), (205, " ")]
    docs += [(206, prose(10) + " " + items[5][1] + " " + items[6][1])] * 2
    return docs, items


def test_leaks_equal_brute_force(spark, prose):
    docs, items = corpus(prose)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, words int").repartition(4)
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, h int")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(frame, bench).collect()}
    expected = brute_force(docs, items)
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    left = decontam.decontaminate(frame, bench)
    bad = {d for d, _ in expected}
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in bad) and left.columns == frame.columns


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some, item = spark.createDataFrame([(1, "a b c d e f", "", "", 1)], DOCS), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.leaks(docs, item).collect() == [] and decontam.leaks(some, bench).collect() == []
    assert decontam.decontaminate(some, bench).count() == 1


def test_blocks_cover_the_radius(spark):
    """Fingerprints that differ in ``radius`` bits share a block."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        x = rng.getrandbits(64) - (1 << 63)
        y = x
        for b in rng.sample(range(64), decontam.RADIUS):
            y ^= (1 << b) if b < 63 else -(1 << 63)
        pairs.append((x, y))
    df = spark.createDataFrame(pairs, "x long, y long")
    same = F.arrays_overlap(decontam.blocks(F.col("x"), decontam.RADIUS), decontam.blocks(F.col("y"), decontam.RADIUS))
    assert df.where(same & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) == decontam.RADIUS)).count() == len(pairs)


def test_simhash_is_the_majority_of_bits(spark):
    rng = random.Random(6)
    bags = [[rng.getrandbits(64) - (1 << 63) for _ in range(rng.randint(1, 9))] for _ in range(50)]
    got = {r.k: r.simhash for r in decontam.simhash(spark.createDataFrame(list(enumerate(bags)), "k long, h_ array<long>"), ["k"], "h_").collect()}
    for k, b in enumerate(bags):
        bits = sum(1 << i for i in range(64) if 2 * sum((x >> i) & 1 for x in b) > len(b))
        assert got[k] & ((1 << 64) - 1) == bits


def test_items_without_and_with_a_shared_id(spark, prose):
    """A null item_id leaks like any other; two texts of equal length under one id are found apart."""
    texts = [prose(30), prose(30), prose(30)]
    bench = spark.createDataFrame([(None, texts[0]), (7, texts[1]), (7, texts[2]), (7, texts[2])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{prose(9)} {t} {prose(9)}", "", "", 1) for i, t in enumerate([*texts, prose(40)])], DOCS)
    got = sorted((r.doc_id, r.item_id, r.start, r.similarity) for r in decontam.leaks(docs, bench).collect())
    assert got == [(0, None, 9, 1.0), (1, 7, 9, 1.0), (2, 7, 9, 1.0)]
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [3]
