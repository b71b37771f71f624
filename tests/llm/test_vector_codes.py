import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np

from mtlens.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, rounds=4, entries=256):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    fit = [r for r in kept if len(r[1]) == width]
    cut = [width * k // 4 for k in range(5)]
    books = [[r[1][cut[k] : cut[k + 1]] for r in fit[:entries]] for k in range(4)]

    def nearest(k, v):
        part = v[cut[k] : cut[k + 1]]
        return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(books[k]))

    for _ in range(rounds):
        moved = []
        for k in range(4):
            members = defaultdict(list)
            for r in fit:
                members[nearest(k, r[1])[1]].append(r[1][cut[k] : cut[k + 1]])
            moved.append([[sum(x) // len(members[e]) for x in zip(*members[e], strict=True)] if e in members else c for e, c in enumerate(books[k])])
        books = moved
    out, labels = [], defaultdict(int)
    for i, v, label in kept:
        if len(v) != width:
            out.append((i, label, None, None))
            continue
        found = [nearest(k, v) for k in range(4)]
        error = sum(d for d, _ in found)
        labels[label] += error
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), error))
    numbers = ",".join(str(x) for book in books for c in book for x in c)
    return Counter((*r, labels.get(r[1])) for r in out), hashlib.sha256(numbers.encode()).hexdigest()


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], rng.choice([None, 1, 2, 3])) for i in range(700)]
    rows += [(i, [0.0] * 12, 9) for i in range(2000, 2040)] + [rows[5], rows[5], (None, [0.5] * 12, 1)]
    rows += [(3000, None, 1), (3001, [1.0] * 11 + [None], 1), (3002, [math.nan] * 12, 1), (3003, [math.inf] * 12, 1), (3004, [1.0] * 7, 8), (3005, [], 1)]
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", code int").repartition(4)
    coded, books = V.compress(table, entries=64)
    expected, digest = brute(rows, entries=64)
    assert Counter(map(tuple, V.with_label_errors(coded).collect())) == expected
    assert V.codebooks_digest(books) == digest


def test_small_empty_uneven_and_wide_tables(spark):
    for rows in (
        [(1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 1), (2, [0.1, -0.2, 0.3, 0.4, 0.5, 9.5], None)],
        [(1, [], None), (2, [], 1)],
        [(i, [x * 3.0e5 + 0.001, -x * 1e5 - 0.0003, float(x), 2.0**29], 1) for i, x in enumerate([1, 2, 5, 7, 7, 3])],
    ):
        coded, books = V.compress(spark.createDataFrame(rows, SCHEMA), entries=4)
        expected, digest = brute(rows, entries=4)
        assert Counter(map(tuple, V.with_label_errors(coded).collect())) == expected and V.codebooks_digest(books) == digest
    coded, _ = V.compress(spark.createDataFrame([(1, None, 1)], SCHEMA))
    assert V.with_label_errors(coded).collect() == []


def lloyd(x, rounds, entries):
    """(scanned share, books) by round, each assignment held against all distances."""
    books, state, shares = [x[:entries].copy()], None, []
    for _ in range(rounds):
        code, low, stamps, d, scanned = V.Codebooks(books).assign(x, state)
        every = ((x[:, None, :] - books[-1][None]) ** 2).sum(-1)
        assert (every.argmin(1) == code).all() and (every.min(1) == d).all()
        state = code.astype(np.uint8), low, stamps
        shares.append(scanned / (len(x) * V.GROUPS))
        books.append(np.array([np.floor(x[code == e].sum(0) / (code == e).sum()) if (code == e).any() else c for e, c in enumerate(books[-1])]))
    return shares, books


def test_bounds_spare_scans_and_lose_nothing():
    rng = np.random.default_rng(4)
    for spread, scale in ((0.1, 1024), (0.5, 1024), (0.5, 3)):  # the last has many ties
        centres = rng.normal(size=(40, 8))
        x = np.floor((centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 8)) * spread) * scale)
        shares, _ = lloyd(x, 6, 100)
        assert shares[0] == 1 and max(shares[2:]) < 0.6


def test_bounds_fall_by_the_net_move_of_an_entry():
    there, back = np.array([[0.0, 0.0], [100.0, 0.0]]), np.array([[0.0, 30.0], [100.0, 0.0]])
    book = V.Codebooks([there, back, there])
    assert book.moves[0].max() == 0 and book.moves[1].max() == 30  # it went and came back: the sum of moves would be 60
