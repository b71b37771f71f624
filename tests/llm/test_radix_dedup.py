import hashlib
from collections import Counter, defaultdict

import pytest

from mtlens.llm.radix_dedup import classes, drop_copies

from .conftest import DOCS


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        elected = False
        for i in ids:
            kept = i == top and not elected
            elected |= kept
            out[i, top, len(ids), kept, sha] += 1
    return out


@pytest.fixture(scope="module")
def rows(prose, edge_rows):
    base = [prose(n) for n in (1, 3, 12, 13, 90, 800, 9000)]
    texts = []
    for b in base:
        texts += [b, b, b + " ", b[:-1], b[:64], b[:65], b, "é" + b, b + "\0"]
    texts += ["same"] * 60 + ["", "", "\0", "é", "é", "a" * 64, "a" * 64, "a" * 65, "a" * 128]
    made = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    return made + [(7, "same", "en", "s", 4), (7, "same", "en", "s", 4), (10_000, "tie", "en", "s", 3), (10_000, "tie", "fr", "s", 3), (None, "none", "en", "s", 4), (None, "none", "en", "s", 4)] + edge_rows


@pytest.mark.parametrize("first,growth,widest,hot", [(64, 16, 1 << 20, 20_000), (1, 3, 40_000, 5)])
def test_classes_equal_brute_force(spark, rows, first, growth, widest, hot):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", kept string").repartition(5)
    got = classes(docs, first=first, growth=growth, widest=widest, hot_rows=hot)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_each_class_keeps_one_row_with_all_columns(spark, rows):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", kept string").repartition(3)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r.text or "" for r in left.collect()) == Counter({r[1] or "" for r in rows})


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert classes(docs).count() == 0 and drop_copies(docs).count() == 0
