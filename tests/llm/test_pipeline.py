import random
from collections import Counter

import corpus_pipeline

from .conftest import DOCS


def test_stages_on_a_small_corpus(spark, prose, edge_rows, tmp_path):
    rng = random.Random(12)
    rows, items = [], [(i, prose(40)) for i in range(3)]
    for i in range(120):
        rows.append([i, prose(rng.randint(40, 90)), "en", f"s{i % 4}", 0])
    for i in range(0, 120, 5):
        rows[i][1] += " moron idiot"
    for i in range(120, 130):
        rows.append([i, rows[i - 119][1], "en", "s9", 0])  # exact copies of 1 to 10
    rows.append([130, items[1][1] + " " + prose(20), "en", "s1", 0])
    rows += [list(r) for r in edge_rows[:6]]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(r[0], 1, int(r[0] % 5 == 0)) for r in rows[:120]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = corpus_pipeline.queries.table(spark, str(tmp_path), "documents")
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append([r.doc_id for r in docs.select("doc_id").collect()])
    toxic, single, clean, mixed, tokens = ids
    everything = {r[0] for r in rows}
    assert len(everything - set(toxic) ^ set(range(0, 120, 5)) - {0}) <= 6
    copies = {i for i in range(120, 130) if i - 119 in toxic}
    assert set(single) == set(toxic) - copies - {904}
    assert set(clean) == set(single) - {130}
    assert set(mixed) <= set(clean) and all(mixed.count(i) <= 2 for i in mixed) and len(mixed) > len(clean) / 2
    assert sorted(tokens) == sorted(mixed)
    assert docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_copies_cut_off_or_extended_go_once(spark, prose):
    """Of a text of 200 shingles and its copy the second goes, down to 150 of them and up to 266; beyond that both stay."""
    rows, gone = [], set()
    for i in range(40):
        whole = prose(204)
        for k, shingles in enumerate((160, 150, 149, 264, 267)):
            mine = " ".join([f"d{i}k{k}w{j}-{w}" for j, w in enumerate(whole.split())])
            other = " ".join(mine.split()[: shingles + 4]) + (" " + prose(shingles - 200) if shingles > 200 else "")
            rows += [(100 * i + 10 * k, mine, "en", "s", 0), (100 * i + 10 * k + 1, other, "en", "s", 0)]
            gone |= {100 * i + 10 * k + 1} if shingles in (160, 150, 264) else set()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert left == {r[0] for r in rows} - gone


def test_repeated_and_missing_ids_lose_no_other_text(spark, prose):
    """One row of each group stays, whatever its ids; compared as a multiset of whole rows."""
    a, b, c, d = (prose(60) for _ in range(4))
    rows = [
        (1, a, "en", "s", 0), (2, a + " more", "en", "s", 0), (2, b, "en", "s", 0),  # id 2: a near copy and a clean text
        (3, c, "en", "s", 0), (3, c, "en", "s", 0), (3, c, "fr", "s", 0),  # one row three times
        (None, d, "en", "s", 0), (None, d, "en", "s", 0), (9, d, "en", "s", 0), (None, prose(30), "en", "s", 0),
        (4, "", "en", "s", 0), (4, "", "en", "s", 0), (None, None, "en", "s", 0), (5, " \n", "en", "s", 0),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", component string").repartition(4)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert got == Counter([(1, a), (2, b), (3, c), (9, d), (None, rows[9][1]), (4, ""), (4, ""), (None, None), (5, " \n")])


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns)
