import math
import re

from mtlens.llm import mixing

from .conftest import DOCS


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_share_what_full_sources_leave():
    got = mixing.targets([("b", 100), ("a", 10), (None, 1000)], (5, 2, 1), 150, 2)
    assert got["a"] == 20 and got["b"] == 200 and math.isclose(got[None], 1445)
    assert mixing.targets([("a", 0)], (5,), 150, 2) == {"a": 0.0} and mixing.targets([], (5,), 150, 2) == {}


def test_mix_equals_a_full_sort(spark, prose, edge_rows):
    rows = [(i, prose(5 + i % 90) + (" # $ %" if i % 7 == 0 else ""), "en", f"s{i % 5 if i % 3 else 0}", 0) for i in range(400)] + edge_rows
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", taken int").repartition(6)
    shares = mixing.plan(docs, bins=16)
    decided = mixing.decide(docs, shares)
    got = decided.collect()
    assert len(got) == len(rows) and decided.columns.count("taken") == 1
    keyed = mixing._keyed(docs, 11).select("doc_id", "source", "__size", "__key").collect()
    sizes = {}
    for r in got:
        assert r["size"] == size(r["text"]) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    expected = mixing.targets(list(sizes.items()), (5, 2, 1), 150, 2)
    for source, total in sizes.items():
        mine = [r for r in got if r.source == source]
        assert all(r.source_size == total and math.isclose(r.target, expected[source]) for r in mine)
        # brute force: all keys of the source sorted, prefix sums, the nearer end
        epochs = min(2, int(expected[source] // total)) if total else 0
        rest, upto, cut = expected[source] - epochs * total, 0, -1.0
        steps = {}
        for k in keyed:
            if k.source == source:
                steps[k["__key"]] = steps.get(k["__key"], 0) + k["__size"]
        for key in sorted(steps) if epochs < 2 else []:
            if upto + steps[key] > rest and abs(upto + steps[key] - rest) > abs(upto - rest):
                break
            upto, cut = upto + steps[key], key
            if upto >= rest:
                break
        assert sum(r.taken for r in mine) == epochs * total + upto
    again = mixing.decide(docs.repartition(3), mixing.plan(docs.repartition(3), bins=16)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in again) == sorted((str(r.doc_id), r.taken) for r in got)
    mixed = mixing.mix(docs, bins=16)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got if r["size"])


def test_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    assert mixing.plan(docs) == [] and mixing.mix(docs).collect() == []
