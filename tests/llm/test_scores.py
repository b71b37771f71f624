"""Toxicity, language id and the class language model."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mtlens.llm import brown, langid, toxicity
from mtlens.llm.common import word_hashes

from .conftest import DOCS

INSULTS = ("idiot", "moron", "scum")


def labelled(prose, n=600):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        text, bad = prose(rng.randint(5, 80)).split(), i % 5 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            text.insert(rng.randint(0, len(text)), rng.choice(INSULTS) + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(text), "en" if i % 2 else "de", "s", int(bad)))
    return rows


def test_toxicity_finds_held_out_rows(spark, prose, edge_rows):
    rows = labelled(prose)
    docs = spark.createDataFrame([(*r[:4], 0, "x") for r in rows] + [(*r, "x") for r in edge_rows], DOCS + ", score string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 3] + [(900, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    got = scored.collect()
    assert len(got) == len(rows) + len(edge_rows) and set(docs.columns) <= set(scored.columns)
    by = {r.doc_id: r for r in got}
    held = [r for r in rows if r[0] % 3 == 0]
    wrong = sum((by[r[0]].score >= 0.3) != bool(r[4]) for r in held)
    assert wrong <= 0.03 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert by[900].score == by[901].score == by[902].score < 0.3
    assert set(model.thresholds) <= {"en", "de"} and by[1].threshold == model.thresholds.get("en", model.threshold)


def test_toxicity_learns_from_every_label(spark, prose):
    """Beyond a shard all rows count: the insult that only some documents have is learnt, as by one shard of all."""
    rows = [(i, f"{t} {'zonk ' * 3 if bad and i % 2 else ''}", lang, s, bad) for i, t, lang, s, bad in labelled(prose, 900)]
    docs = spark.createDataFrame([(*r[:4], 0) for r in rows], DOCS).repartition(3)
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 3], "doc_id long, toxic int")
    whole, dealt = toxicity.fit(docs, labels), toxicity.fit(docs, labels, shard=100)
    assert len(dealt.keys) >= 0.9 * len(whole.keys)  # counts are of all shards
    got = {r.doc_id: r for r in toxicity.score(docs, dealt).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert sum((got[r[0]].score >= 0.3) != bool(r[4]) for r in held) <= 0.03 * len(held)
    again = toxicity.fit(docs.repartition(5), labels, shard=100)
    assert np.allclose(again.emb, dealt.emb, atol=1e-5) and again.thresholds == dealt.thresholds


def test_toxicity_shards_copy_their_own_words_only():
    rows, before = np.array([9, 1, 4, 9, 0, 7], np.int32), [9, 1, 4, 9, 0, 7]
    used, own = toxicity._own_rows(rows, 50)
    assert used.tolist() == [0, 1, 4, 7, 9]
    assert used[own].tolist() == before
    # a part of the table learns what the whole one does
    rng = np.random.default_rng(3)
    n, words = 40, 3000
    offsets = np.arange(n + 1) * 20
    rows = rng.integers(1, 90, 20 * n).astype(np.int32) * 31
    labels = (np.arange(n) % 3 == 0).astype(np.float32)

    def net(emb):
        r = np.random.default_rng(5)
        conv = [r.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
        size = len(toxicity.WIDTHS) * toxicity.FILTERS
        return toxicity.TextCnn(np.empty(0, np.uint32), emb, conv, np.zeros(size, np.float32), np.full(size, 0.3, np.float32), 0.0)

    emb = rng.normal(size=(words, toxicity.DIM)).astype(np.float32)
    whole, used_own = net(emb.copy()), toxicity._own_rows(rows.copy(), words)
    part = net(emb[used_own[0]])
    for model, at in ((whole, rows), (part, used_own[1])):
        memory = [np.full_like(p, 1e-3) for p in [model.emb, *model.conv, model.bias, model.out]]
        toxicity._epoch(model, memory, 1e-3, at, offsets, labels, np.arange(n), 16, 0.05, words)
    assert np.allclose(whole.emb[used_own[0]], part.emb, atol=1e-5) and np.isclose(whole.out_bias, part.out_bias)
    assert not np.allclose(whole.emb, emb)


def test_toxicity_shards_are_read_document_by_document(spark, prose, monkeypatch, tmp_path):
    """No cell holds a shard; a shard that comes in parts is an error, as its changes are averaged as a whole."""
    docs = spark.createDataFrame([(k, " ".join(prose(20)) + (" idiot" if k % 4 == 0 else ""), "en", "s", 1) for k in range(200)], DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id long, toxic int")
    longest = docs.agg(F.max(F.size(F.split("text", r"\s+")))).first()[0]
    folders, path = [], str(tmp_path)
    monkeypatch.setattr(toxicity, "scratch_path", lambda _, name: folders.append(f"{path}/{name}") or folders[-1])
    toxicity.fit(docs, labels, shard=60)
    got = spark.read.parquet(folders[0])
    assert got.count() == 200 and got.agg(F.max(F.octet_length("words"))).first()[0] <= 4 * longest
    assert got.select("shard").distinct().count() == len(got.inputFiles()) > 1

    split = f"{path}/split"
    monkeypatch.setattr(toxicity, "scratch_path", lambda _, name: split)
    got.drop("docs").withColumn("docs", F.lit(1_000).cast("long")).write.partitionBy("shard").parquet(split)
    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", lambda *a, **k: None)
    one = docs.select("doc_id", F.lit(0).alias("toxic"), "lang", F.lit(b"").alias("words"))
    with pytest.raises(Exception, match="came in parts"):
        toxicity._train_shards(one, 3, 7)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 1)], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0.0]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).collect() == []


def test_convolution_equals_a_loop():
    rng = np.random.default_rng(3)
    model = toxicity.TextCnn(
        np.arange(5, dtype=np.uint64), rng.normal(size=(7, toxicity.DIM)).astype(np.float32),
        [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], np.zeros(1), np.zeros(1), 0.0,
    )
    model.emb[0] = 0
    rows, offsets = rng.integers(1, 7, 12), np.array([0, 5, 5, 6, 12])
    got = model.pooled(rows, offsets)
    for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        seq = [0, *rows[a:b], 0, 0]
        want = np.concatenate([np.max([sum(model.emb[seq[i + j]] @ model.conv[k][j] for j in range(w)) for i in range(len(seq) - 2)], axis=0) for k, w in enumerate(toxicity.WIDTHS)])
        assert np.allclose(got[d], want, atol=1e-5)


def test_language_prototypes(spark, edge_rows):
    rng = random.Random(4)
    parts = {"aa": "the ing and tion er st", "bb": "der sch ung ein keit ö", "cc": "que les é eau pas tr"}
    rows = [(i, " ".join("".join(rng.choice(parts[x].split()) for _ in range(3)).title() for _ in range(rng.randint(3, 60))), x, "s", 0) for i, x in enumerate(list(parts) * 60)]
    docs = spark.createDataFrame([(*r, 1) for r in rows] + [(*r, 1) for r in edge_rows], DOCS + ", lang_pred int").repartition(4)
    known = docs.where("doc_id % 2 = 0 and doc_id < 900")
    prototypes = langid.train(known)
    got = {r.doc_id: r for r in langid.predict(docs, prototypes).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in rows) >= 0.98 * len(rows)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903].lang_pred in parts and all(0 <= r.score <= 1 for r in got.values())
    # brute force of one row
    space, text = langid.Space(), " " + re.sub(r"\W+", " ", rows[0][1].lower()) + " "

    def letter(c):
        return space._vector(ord(c) if c != " " else 32).astype(int)

    vector = sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(text, text[1:], text[2:]))
    cosine = {x: vector @ p / np.linalg.norm(vector) / np.linalg.norm(p) for x, p in prototypes.items()}
    assert got[0].lang_pred == max(cosine, key=cosine.get) and math.isclose(got[0].score, max(cosine.values()), rel_tol=1e-6)
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.train(docs.limit(0)) == {}


def test_language_grams_over_chunks():
    """Table and sorted forms, and small product steps, give the same bundles."""
    texts = ["", "Ab cd", "中文 한 текст " * 3, "x"]
    space = langid.Space(64)
    keys, offsets = space.ngrams(texts)
    whole = space.bundle(keys, offsets)
    step, langid.STEP = langid.STEP, 3
    try:
        assert np.array_equal(space.bundle(keys, offsets), whole)
    finally:
        langid.STEP = step
    assert np.diff(offsets).tolist()[0] == 0 and np.diff(offsets).tolist()[3] == 1


def brute_base(rows, train):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for t in rows]
    counts = Counter(x for t, use in zip(tokens, train, strict=True) if use for x in t)
    n, v = sum(counts.values()), len(counts)
    return n, [(len(t), sum(counts[x] > 0 for x in t), sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for t in tokens]


def test_class_model(spark, prose, edge_rows, monkeypatch):
    rows = [(i, prose(i % 70), "en", "s", 0) for i in range(200)] + [r for r in edge_rows if r[1] is None or r[1].isascii()]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", score int").repartition(4)
    results = []
    for known in (10**6, 60, 25):
        monkeypatch.setattr(brown, "KNOWN", known)
        model = brown.train(docs.where("doc_id % 3 <> 0"), words_=20, classes=8)
        got = brown.score(docs, model, ["doc_id", "text"]).collect()
        results.append(sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got))
    assert results[0] == results[1] == results[2] and len(results[0]) == len(rows)
    n, expected = brute_base([r[1] for r in rows], [r[0] is not None and r[0] % 3 != 0 for r in rows])
    assert model.total == n
    assert sorted((str(r[0]), a, b, round(c, 6)) for r, (a, b, c) in zip(rows, expected, strict=True)) == [r[:4] for r in results[0]]
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    # emissions of each class, its unknown word included, sum to one
    k = len(model.transition)
    mass, kinds = np.zeros(k), np.zeros(k)
    for r in model.counts.collect():
        c = model.classes[brown._items(np.array([r.word], np.int64).view(np.uint64), np.array([r["shape"]]), model.lexicon)[0]]
        mass[c] += r.c + 0.5
        kinds[c] += 1
    assert np.allclose(mass + 0.5, 10**model.denominator)


def test_class_score_is_the_sum_over_tokens(spark, prose):
    rows = [(i, prose(i % 40), "en", "s", 0) for i in range(80)] + [(900, None, "", "", 0), (901, "never seen wordzz prose", "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    model = brown.train(docs.where("doc_id < 60"), words_=10, classes=6)
    counts = {r.word: (r["shape"], r.c) for r in model.counts.collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), ""] for i, t, *_ in rows}
    lexicon = {int(h): 1 + i for i, h in enumerate(model.lexicon.tolist())}
    seen = Counter(x for i, t in tokens.items() if i < 60 for x in t)
    assert len(lexicon) == sum(c >= brown.LEAST for w, c in seen.items() if w)  # every word above the count, however many

    def class_of(word):
        if word == "":
            return 0
        h = xxhash.xxh64_intdigest(word, 0)
        return int(model.classes[lexicon.get(h, 1 + len(lexicon) + xxhash.xxh32_intdigest(word[-2:]) % brown.SHAPES)])

    pair = Counter()
    for i in range(60):
        classes = [0, *map(class_of, tokens[i])]
        pair.update(zip(classes, classes[1:], strict=False))
    k = len(model.transition)
    grid = np.array([[pair[a, b] for b in range(k)] for a in range(k)], float)
    unigram = (grid.sum(axis=0) + 0.5) / (grid.sum() + 0.5 * k)
    mass, kinds = np.zeros(k), np.zeros(k)
    for w, c in seen.items():
        mass[class_of(w)] += c
        kinds[class_of(w)] += 1
    for r in brown.score(docs, model, ["doc_id"]).collect():
        classes = [0, *map(class_of, tokens[r.doc_id])]
        total = 0.0
        for w, a, b in zip(tokens[r.doc_id], classes, classes[1:], strict=False):
            total += math.log10((grid[a, b] + brown.SMOOTH * unigram[b]) / (grid[a].sum() + brown.SMOOTH))
            total += math.log10((seen[w] + 0.5) / (mass[b] + 0.5 * (kinds[b] + 1)))
        assert math.isclose(r.score, total, rel_tol=1e-9)
    assert len(counts) == len(seen)


def test_words_beyond_the_bound_on_classes_keep_their_bundle(spark, prose, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i), "en", "s", 0) for i in range(50)], DOCS)
    whole = brown.train(docs, classes=6)
    bound = len(whole.lexicon) - 1
    monkeypatch.setattr(brown, "LEARNT", bound)
    few = brown.train(docs, classes=6)
    assert len(few.lexicon) <= bound and set(few.lexicon.tolist()) < set(whole.lexicon.tolist()) and few.total == whole.total
    assert all(math.isfinite(r.score) for r in brown.score(docs, few, ["doc_id"]).collect())


def test_gain_is_the_change_of_the_likelihood():
    rng = np.random.default_rng(4)
    cls = rng.integers(1, 5, 12)
    cls[0] = 0
    n = rng.integers(0, 9, (12, 12)).astype(float)
    member = lambda c: np.eye(5)[c]
    for item in range(1, 12):
        rest = n.copy()
        rest[item, :] = rest[:, item] = 0
        m = member(cls)
        out, into = n[item] @ m, m.T @ n[:, item]
        out[cls[item]] -= n[item, item]
        into[cls[item]] -= n[item, item]
        gain = brown.gains(m.T @ rest @ m, out, into, n[item, item])
        whole = []
        for to in range(1, 5):
            moved = cls.copy()
            moved[item] = to
            m2 = member(moved)
            whole.append(brown.likelihood(m2.T @ n @ m2))
        assert np.allclose(gain[1:] - gain[1], np.array(whole) - whole[0])


def test_gains_of_many_items_equal_those_of_each():
    rng = np.random.default_rng(8)
    n = rng.integers(0, 4, (60, 60)).astype(float) * (rng.random((60, 60)) < 0.3)
    cls = rng.integers(1, 7, 60)
    cls[0] = 0
    m = np.eye(7)[cls]
    grid = m.T @ n @ m
    items = np.arange(1, 60)
    out, into, self_ = (n @ m)[items], (m.T @ n).T[items], n.diagonal()[items]
    out[np.arange(59), cls[items]] -= self_
    into[np.arange(59), cls[items]] -= self_
    got = brown.batch_gains(grid, cls[items], out, into, self_)
    for w, own in enumerate(cls[items]):
        bare = grid.copy()
        bare[own, :] -= out[w]
        bare[:, own] -= into[w]
        bare[own, own] -= self_[w]
        expected = brown.gains(bare, out[w], into[w], self_[w])
        assert np.allclose(got[w], expected)


def test_class_model_without_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    model = brown.train(docs)
    assert brown.score(docs, model, ["doc_id"]).collect() == []
    one = brown.score(spark.createDataFrame([(1, "a b", "", "", 0)], DOCS), model, ["doc_id"]).first()
    assert (one.n_tokens, one.n_known, one.base_score) == (3, 0, 0.0) and math.isfinite(one.score)


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(2)
    n = np.zeros((21, 21))
    for i in range(1, 21):
        for j in range(1, 21):
            n[i, j] = rng.integers(80, 120) if (i % 2) != (j % 2) else rng.integers(0, 3)
    n[0, 1:] = n[1:, 0] = 5
    cls = brown.exchange(n, 3)
    assert cls[0] == 0 and len(set(cls[1::2])) == 1 and len(set(cls[2::2])) == 1 and cls[1] != cls[2]


def test_word_hashes_are_those_of_the_library():
    rng = random.Random(3)
    some = ["".join(rng.choice("abcé😀ß z") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for array in (pa.array(some), pa.array(some).slice(7, 900), pa.array([""]), pa.array([], pa.string())):
        for seed in (0, 7):
            assert word_hashes(array, seed).tolist() == [xxhash.xxh64_intdigest(w, seed) for w in array.to_pylist()]


def test_contexts_are_counted_once_however_they_are_held(monkeypatch):
    class Shared:
        pass

    rng = np.random.default_rng(6)
    k, items = 5, 40
    cls = rng.integers(1, k, 1 + items).astype(np.int32)
    cls[0] = 0
    seqs = [np.append(rng.integers(1, 1 + items, n), 0).astype(np.int32) for n in (0, 1, 300, 50, 700)]
    batches = [pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary())], names=["seq"]) for s in seqs]
    expected, grid = np.zeros((1 + items, 2 * k + 1)), np.zeros((k, k))
    for s in seqs:
        for x, y in zip([0, *s.tolist()], s.tolist(), strict=False):
            grid[cls[x], cls[y]] += 1
            expected[x, 2 * k if x == y else cls[y]] += 1
            if x != y:
                expected[y, k + cls[x]] += 1
    for held, often in ((1, 0), (10**6, 0), (100, 7), (10**6, items)):
        monkeypatch.setattr(brown, "HELD", held)
        shared = Shared()
        top = np.full(1 + items, -1, np.int32)
        top[1 + rng.permutation(items)[:often]] = np.arange(often)
        shared.value = (cls, top)
        rows = pa.Table.from_batches(brown._bigrams(shared, k, items)(iter(batches))).sort_by("item")
        for size in (1, 3, 1000):
            got, seen = np.zeros((1 + items, 2 * k + 1)), np.zeros((k, k))
            for batch in brown._added(2 * k + 1)(iter(rows.combine_chunks().to_batches(max_chunksize=size))):
                for item, row in zip(batch.column("item").to_pylist(), brown._dense(batch.column("cells"), np.arange(batch.num_rows), 2 * k + 1), strict=True):
                    table, at = (seen, -1 - item) if item < 0 else (got, item)
                    assert not table[at].any()  # one row an item
                    table[at] = row[: table.shape[1]]
            assert np.array_equal(got[1:], expected[1:]) and np.array_equal(seen, grid)
