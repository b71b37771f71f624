import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

from mtlens.llm.periodic_runs import periodic_runs, planted_words, runs_of, stretches

from .conftest import DOCS


def brute_runs(seq, min_words=24, min_periods=3):
    n, out = len(seq), []
    for q in range(1, n // min_periods + 1):
        i = q
        while i < n:
            if seq[i] != seq[i - q]:
                i += 1
                continue
            j = i
            while j < n and seq[j] == seq[j - q]:
                j += 1
            run = seq[i - q : j]
            smallest = not any(all(run[k] == run[k - p] for k in range(p, len(run))) for p in range(1, q))
            if len(run) >= max(min_words, min_periods * q) and smallest:
                out.append((i - q, len(run), q))
            i = j
    return sorted(out)


def brute_row(text, doc_id=None):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(ws)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = ws[:a] + [ws[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(ws)
    best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(ws) if i not in drop)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    s, length, q = best or (None, None, None)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), s, length, q, best and 1000 * length // q, *digests)


def random_sequence(rng):
    k, n = rng.choice([1, 2, 3, 6]), rng.randint(0, 80)
    seq = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a = rng.randrange(n)
        p, e = 1 + rng.randrange((n - a) // 3 + 1), rng.randint(a, n)
        seq[a:e] = [seq[a + i % p] for i in range(e - a)]
    return seq


def test_runs_of_small_alphabets_equal_brute_force():
    rng = random.Random(11)
    for _ in range(600):
        seq = random_sequence(rng)
        for limits in ((24, 3), (2, 2), (6, 4)):
            assert runs_of(seq, *limits) == brute_runs(seq, *limits), (seq, limits)


def test_stretches_hold_whole_runs():
    rng = random.Random(12)
    seqs = [random_sequence(rng) for _ in range(400)]
    offsets = np.cumsum([0, *map(len, seqs)])
    codes = np.concatenate([np.array(s, np.int32) for s in seqs])
    found = [[] for _ in seqs]
    for row, a, b in stretches(offsets, codes):
        found[row] += [(a - int(offsets[row]) + s, length, q) for s, length, q in runs_of(codes[a:b].tolist())]
    assert [sorted(f) for f in found] == [brute_runs(s) for s in seqs]
    assert sum(map(len, found)) > 100


def test_access_is_cheap_on_a_path_as_deep_as_the_text():
    assert runs_of([0] * 30_000) == [(0, 30_000, 1)]
    assert runs_of([i % 5_000 for i in range(20_000)]) == [(0, 20_000, 5_000)]


def test_rows_equal_brute_force(spark, prose, edge_rows):
    rng = random.Random(13)
    texts = []
    for i in range(250):
        parts = [prose(rng.randint(0, 60)), " ".join([prose(rng.randint(1, 9))] * rng.randint(1, 12)), prose(rng.randint(0, 40))]
        texts.append((i, rng.choice([" ", "\n", "\t "]).join(parts), "en", "s", 0))
    texts += [(1000, "A a " * 14, "en", "s", 0), (1001, "x" * 70_000, "en", "s", 0), (1002, "\U0001f600 é " * 12, "en", "s", 0)]
    rows = texts + [r for r in edge_rows if r[0] != 906]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", n_runs string").repartition(5)
    got = periodic_runs(docs, planted_words)
    assert Counter(map(tuple, got.collect())) == Counter(brute_row(r[1], r[0]) for r in rows)
    plain = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert plain[1000].n_runs == 1 and plain[1000].period == 2 and plain[1000].exponent_milli == 14_000


def test_long_periodic_text_and_empty_table(spark, edge_rows):
    docs = spark.createDataFrame([r for r in edge_rows if r[0] == 906], DOCS)
    got = periodic_runs(docs).collect()
    assert [(r.n_runs, r.start, r.length, r.period) for r in got] == [(1, 0, 60_000, 1)] * 2
    assert got[0].collapsed_sha256 == hashlib.sha256(b"word").hexdigest()
    assert periodic_runs(docs.limit(0)).count() == 0
