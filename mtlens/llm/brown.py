"""Language-model scores from Brown classes.

Words (A-Z lower-cased) and one end mark a text are grouped into classes by exchange
clustering in two steps. A seed on the driver moves the most frequent ``words_`` and, for all others, one bundle of
words per hash of the last two letters between classes as long as the likelihood of the class bigrams
rises. Then every word that occurs ``LEAST`` times or more moves by its own contexts: each round
counts (word, class of the neighbour) by a shuffle of one packed row a word and step, moves all words in Spark against the grid of class bigrams, and is
kept only if the likelihood rose. Only the grid and the words' classes reach the driver. Rarer and unseen words keep their
bundle. A text's probability is the product of smoothed class transitions and word emissions within the class.

All counts cover the whole training corpus: word counts are a distributed table as
large as the vocabulary. The classes of at most ``LEARNT`` words (18 bytes each; of a larger vocabulary the most frequent)
and the ``KNOWN`` most frequent counts travel to the tasks (bounds in rows); the counts of all
other words are met by a shuffle join on the word's 64-bit hash; no frequent word is among
them, so no key is hot. Both bounds are found from the histogram of counts, so no task sorts the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count as counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, materialize, slices, word_hashes, words

WORDS = 511
SHAPES = 128
CLASSES = 64
LEAST = 3  # a word that occurs so often has a class of its own contexts
LEARNT = 2_000_000
ROUNDS = 2
KNOWN = 400_000
HELD = 1_500_000  # words (distinct ones) or contexts a task holds before it counts them and hands them on
OFTEN = 4096  # words whose contexts a task counts in one table, handed on once
SMOOTH = 20.0  # weight of the class unigram in a transition
END_WORD = np.uint64(xxhash.xxh64_intdigest("", 0))  # no word is empty


def coded(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, codes, hashes, shapes): each row's words and its end mark, as codes of distinct words."""
    offsets, codes, vocabulary = words(text)
    hashes = np.append(word_hashes(vocabulary), END_WORD)
    tails = pc.utf8_slice_codeunits(vocabulary, -2).dictionary_encode()
    shapes = np.fromiter((xxhash.xxh32_intdigest(w) % SHAPES for w in tails.dictionary.to_pylist()), np.int32, len(tails.dictionary))[tails.indices.to_numpy()]
    n = len(offsets) - 1
    out = np.full(len(codes) + n, len(vocabulary), np.int64)
    ends = offsets[1:] + np.arange(n)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = codes
    return np.concatenate([[0], ends + 1]), out, hashes, np.append(shapes, 0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def put() -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _, _ in held])
        distinct, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([c for _, _, c in held])).astype(np.int64)
        shapes = np.concatenate([s for _, s, _ in held])[first]
        return pa.RecordBatch.from_arrays([pa.array(distinct.view(np.int64)), pa.array(shapes, pa.int32()), pa.array(total)], names=["word", "shape", "c"])

    for batch in slices(batches):
        _, codes, hashes, shapes = coded(batch.column("text"))
        counts = np.bincount(codes, minlength=len(hashes))
        held.append((hashes[counts > 0], shapes[counts > 0], counts[counts > 0]))
        size += len(held[-1][0])
        if size >= HELD:
            yield put()
            held, size = [], 0
    if held:
        yield put()


def _place(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted ``lexicon``, -1 if it is not there."""
    if not len(lexicon):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, at, -1)


def _items(hashes: np.ndarray, shapes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Item of each word: 0 the end, then the words of the lexicon, then the bundles."""
    at = _place(hashes, lexicon)
    return np.where(hashes == END_WORD, 0, np.where(at >= 0, 1 + at, 1 + len(lexicon) + shapes))


def _coder(lexicon):
    """Each slice of texts as one row of items; a text starts where the one before has its end mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, codes, hashes, shapes = coded(batch.column("text"))
            seq = _items(hashes, shapes, lexicon.value)[codes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([seq.tobytes()], pa.binary())], names=["seq"])

    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for row in batch.column("seq"):
            seq = np.frombuffer(row.as_buffer(), np.int32)
            yield np.concatenate([[0], seq[:-1]]).astype(np.int64), seq.astype(np.int64)


CELL = np.dtype([("cell", "<i4"), ("c", "<i8")])  # a row of counts is stored as its cells that are not 0
CELLS = "item int, cells binary"


def _packed(items: np.ndarray, cell: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    """A row per item with its cells; the cells of an item are consecutive."""
    cells = np.empty(len(items), CELL)
    cells["cell"], cells["c"] = cell, c
    first = np.flatnonzero(np.diff(items, prepend=items[:1] - 1))
    offsets = (np.append(first, len(items)) * CELL.itemsize).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(cells.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(items[first].astype(np.int32)), packed], names=["item", "cells"])


def _dense(packed: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """Counts of ``packed`` as a table, summed over the values that share a row of it; ``rows`` ascend from 0."""
    size = pc.binary_length(packed).to_numpy() // CELL.itemsize
    start = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset]
    cells = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[start : start + size.sum() * CELL.itemsize].view(CELL)
    at = np.repeat(rows * width, size) + cells["cell"]
    return np.bincount(at, weights=cells["c"], minlength=(int(rows[-1]) + 1) * width).reshape(-1, width)


def _bigrams(shared, k: int, contexts: int):
    """Packed rows of counts. Item -1 - c: the classes after class c. Items 1 to ``contexts``: the classes of the item's neighbours;
    cell c a follower of class c, k + c a word before, 2 * k a follower that is the item itself. An item may have several rows;
    those that ``shared`` numbers as the most frequent have one a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (cls, top), width = shared.value, 2 * k + 1
        ranked = np.flatnonzero(top >= 0)
        ranked = ranked[np.argsort(top[ranked])]
        grid, often = np.zeros(k * k, np.int64), np.zeros(len(ranked) * width, np.int64)
        held, size = [], 0

        def put() -> pa.RecordBatch:
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            return _packed(keys // width, keys % width, c)

        for before, seq in _sequences(batches):
            left, right = cls[before].astype(np.int64), cls[seq].astype(np.int64)
            grid += np.bincount(left * k + right, minlength=k * k)
            if not contexts:
                continue
            same = before == seq
            for items, cells in ((before, np.where(same, 2 * k, right)), (seq[~same], k + left[~same])):
                rank = top[items]
                hot = rank >= 0
                often += np.bincount(rank[hot] * width + cells[hot], minlength=len(often))
                rest = ~hot & (items > 0) & (items <= contexts)
                held.append(items[rest] * width + cells[rest])
                size += len(held[-1])
            if size >= HELD:
                yield put()
                held, size = [], 0
        if size:
            yield put()
        for counts, step, items in ((often, width, ranked), (grid, k, -1 - np.arange(k))):
            cells = np.flatnonzero(counts)
            if len(cells):
                yield _packed(items[cells // step], cells % step, counts[cells])

    return run


def _added(width: int):
    """Sums of the packed rows of each item, from rows sorted by item: streams, an item may have rows in any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(items: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
            row, cell = np.nonzero(table)
            return _packed(items[row], cell, table[row, cell])

        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            items = batch.column("item").to_numpy()
            new = np.concatenate([[False], items[1:] != items[:-1]])
            table = _dense(batch.column("cells"), np.cumsum(new), width)
            items = items[np.concatenate([[0], np.flatnonzero(new)])]
            if last == items[0]:
                table[0] += held
            elif last is not None:
                yield put(np.array([last]), held[None, :])
            last, held = items[-1], table[-1].copy()
            if len(items) > 1:
                yield put(items[:-1], table[:-1])
        if last is not None:
            yield put(np.array([last]), held[None, :])

    return run


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(grid: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, but for what no class changes."""
    return float(_xlogx(grid).sum() - _xlogx(grid.sum(axis=1)).sum() - _xlogx(grid.sum(axis=0)).sum())


def gains(grid: np.ndarray, out: np.ndarray, into: np.ndarray, self_: float) -> np.ndarray:
    """Likelihood for each class that takes an item, which ``grid`` lacks, up to a constant.

    ``out``, ``into``: counts of the item before and after each class, ``self_`` before itself.
    """
    f, diag = _xlogx, np.arange(len(grid))
    rows, cols = grid.sum(axis=1) + into, grid.sum(axis=0) + out  # whichever class takes the item
    r, c = out.sum() + self_, into.sum() + self_
    o, i = np.flatnonzero(out), np.flatnonzero(into)  # no other cell changes
    a = (f(grid[:, o] + out[o]) - f(grid[:, o])).sum(axis=1) - (f(grid[diag, diag] + out) - f(grid[diag, diag]))
    b = (f(grid[i] + into[i, None]) - f(grid[i])).sum(axis=0) - (f(grid[diag, diag] + into) - f(grid[diag, diag]))
    corner = f(grid[diag, diag] + out + into + self_) - f(grid[diag, diag])
    gain = a + b + corner - (f(rows + r) - f(rows)) - (f(cols + c) - f(cols))
    gain[0] = -np.inf  # the end mark's own class
    return gain


def best_class(gain: np.ndarray, own: int) -> int:
    """The class of the highest gain, the lower one of equals; ``own`` unless another is better."""
    best = int(np.argmax(gain > gain.max() - 1e-9 * max(1.0, abs(gain.max()))))
    return best if gain[best] > gain[own] + 1e-9 * max(1.0, abs(gain[own])) else int(own)


ENTRIES = 20_000  # cells of contexts that one numpy step holds against all classes


def _side(grid, w, j, count, own, other, self_):
    """Sums over the contexts ``j`` (class bigrams of the item with class ``j``) of the change of x log x, per item and class that
    takes it; cells of a class with itself are left out. ``grid[c, j]`` is the cell of class ``c``, ``other`` the item's counts on its other side."""
    cells = grid[:, j].T.copy()
    home = j == own[w]
    cells[home] -= other[w[home]]  # the item itself still lies in these cells
    at = np.arange(len(j))
    cells[at, own[w]] -= count + home * self_[w]
    change = _xlogx(cells + count[:, None]) - _xlogx(cells)
    change[at, j] = 0
    total = np.zeros(other.shape)
    first = np.flatnonzero(np.diff(w, prepend=-1))
    if len(first):
        total[w[first]] = np.add.reduceat(change, first)
    return total


def batch_gains(grid: np.ndarray, own: np.ndarray, out: np.ndarray, into: np.ndarray, self_: np.ndarray) -> np.ndarray:
    """``gains`` of many items (rows of ``out`` and ``into``) at once, each against the others, from the grid that holds them all in their classes ``own``."""
    f, at = _xlogx, np.arange(len(own))
    diag = np.repeat(grid.diagonal()[None, :], len(own), axis=0)
    diag[at, own] -= out[at, own] + into[at, own] + self_
    gain = f(diag + out + into + self_[:, None]) - f(diag)
    for cells, here, other in ((grid, out, into), (grid.T, into, out)):
        w, j = np.nonzero(here)
        gain += _side(cells, w, j, here[w, j], own, other, self_)
        sums = np.repeat(cells.sum(axis=1)[None, :], len(own), axis=0)
        mine = here.sum(axis=1) + self_
        sums[at, own] -= mine
        gain -= f(sums + mine[:, None]) - f(sums)
    gain[:, 0] = -np.inf  # the end mark's own class
    return gain


def _moves(shared):
    """Each item's best class against the shared grid, all others staying."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, grid = shared.value
        k = len(grid)
        step = max(1, ENTRIES // (2 * k))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                items = batch.column("item").to_numpy()
                counts = _dense(batch.column("cells"), np.arange(len(items)), 2 * k + 1)
                own = cls[items]
                gain = batch_gains(grid, own, counts[:, :k], counts[:, k : 2 * k], counts[:, 2 * k])
                top, mine = gain.max(axis=1, keepdims=True), gain[np.arange(len(own)), own]
                best = np.argmax(gain > top - 1e-9 * np.maximum(1.0, np.abs(top)), axis=1)
                better = gain[np.arange(len(own)), best] > mine + 1e-9 * np.maximum(1.0, np.abs(mine))
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(np.where(better, best, own).astype(np.int32))], names=["item", "class"])

    return run


def exchange(n: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Class of each item from the item bigram counts ``n``; item 0 keeps class 0 to itself.

    Items start in turn by frequency and move to the class that raises the class bigram likelihood most;
    ties go to the lower class, so the result is a function of the counts.
    """
    size = len(n)
    k = max(2, min(classes, size))

    n = n.astype(np.float64)
    order = [i for i in np.argsort(-n.sum(axis=1), kind="stable") if i]
    cls = np.zeros(size, np.int64)
    for r, i in enumerate(order):
        cls[i] = 1 + r % (k - 1)
    member = np.zeros((size, k))
    member[np.arange(size), cls] = 1
    grid = member.T @ n @ member
    for _ in range(rounds):
        moved = 0
        for i in order:
            own = cls[i]
            out, into, self_ = n[i] @ member, member.T @ n[:, i], n[i, i]
            out[own] -= self_
            into[own] -= self_
            grid[own, :] -= out
            grid[:, own] -= into
            grid[own, own] -= self_
            best = best_class(gains(grid, out, into, self_), own)
            grid[best, :] += out
            grid[:, best] += into
            grid[best, best] += self_
            if best != own:
                member[i, own], member[i, best], cls[i] = 0, 1, best
                moved += 1
        if not moved:
            break
    return cls


@dataclass
class BrownModel:
    """``classes`` of the items (see ``_items``); ``known``, ``known_counts``: the most frequent words; ``transition`` and
    ``denominator`` are log10."""

    counts: DataFrame  # (word, shape, c), the whole vocabulary
    total: int
    distinct: int
    lexicon: np.ndarray
    classes: np.ndarray
    transition: np.ndarray
    denominator: np.ndarray
    known: np.ndarray
    known_counts: np.ndarray
    cut: int  # every word that occurs so often is known


def _cut(counts: DataFrame, rows: int) -> int:
    """The least count that at most ``rows`` words reach."""
    sizes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))  # at most some sqrt(2 * tokens) rows
    upto = sizes.select("c", F.sum("n").over(Window.orderBy(F.desc("c"))).alias("upto"))
    least, most = upto.agg(F.min(F.when(F.col("upto") <= rows, F.col("c"))), F.max("c")).first()
    return int(least) if least is not None else int(most or 0) + 1


def train(docs: DataFrame, words_: int = WORDS, classes: int = CLASSES, rounds: int = ROUNDS) -> BrownModel:
    """Counts, classes and transitions of ``docs`` (text); null texts are empty: one end mark.

    Words of equal count are told apart by their hash, equal classes by their number: reruns agree.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("text").cast("string").alias("text"))
    counts = texts.mapInArrow(_count, "word long, shape int, c long").groupBy("word").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))
    counts = materialize(counts, "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    cut, least = _cut(counts, KNOWN), max(LEAST, _cut(counts, LEARNT))
    frequent = counts.where(F.col("c") >= min(cut, least)).toArrow()
    hashes, cs, shapes = frequent.column("word").to_numpy().view(np.uint64), frequent.column("c").to_numpy(), frequent.column("shape").to_numpy()
    order = np.argsort(hashes)
    hashes, cs, shapes = hashes[order], cs[order], shapes[order]
    own = (cs >= least) & (hashes != END_WORD)
    lexicon, lex_counts, lex_shapes = hashes[own], cs[own], shapes[own]

    shared = sc.broadcast(lexicon)
    codes = materialize(texts.mapInArrow(_coder(shared), "seq binary"), "codes")

    order = np.lexsort((lexicon.view(np.int64), -lex_counts))
    often = np.full(1 + len(lexicon) + SHAPES, -1, np.int32)
    often[1 + order[:OFTEN]] = np.arange(len(order[:OFTEN]))

    def bigrams(cls: np.ndarray, k: int, contexts: int = 0) -> tuple[np.ndarray, DataFrame]:
        """Grid of class bigrams; contexts of the items."""
        top = often if contexts else np.full(len(often), -1, np.int32)
        cells = codes.mapInArrow(_bigrams(sc.broadcast((cls.astype(np.int32), top)), k, contexts), CELLS)
        cells = materialize(cells.repartition("item").sortWithinPartitions("item").mapInArrow(_added(2 * k + 1), CELLS), "cells")
        got = cells.where("item < 0").toArrow().combine_chunks()
        grid = np.zeros((k, k))
        if got.num_rows:
            packed = got.column("cells").chunk(0)
            grid[-1 - got.column("item").to_numpy()] = _dense(packed, np.arange(len(packed)), k)
        return grid, cells

    # the seed: the most frequent words and the bundles, all rarer words in theirs
    top = order[:words_]
    seed = np.concatenate([[0], 1 + len(top) + lex_shapes, 1 + len(top) + np.arange(SHAPES)])
    seed[1 + top] = 1 + np.arange(len(top))
    grid, cells = bigrams(seed, 1 + len(top) + SHAPES)
    free(cells)
    cls = exchange(grid, classes)[seed]

    # every word of the lexicon by its own contexts
    k = int(cls.max()) + 1
    kept = None
    for r in range(rounds + 1):
        grid, cells = bigrams(cls, k, len(lexicon) if r < rounds else 0)
        if kept is not None and likelihood(grid) <= likelihood(kept[1]):
            free(cells)
            break
        kept = cls, grid
        if r < rounds and len(lexicon):
            moved = cells.where("item > 0").mapInArrow(_moves(sc.broadcast((cls, grid))), "item int, class int").toArrow()
            cls = cls.copy()
            cls[moved.column("item").to_numpy()] = moved.column("class").to_numpy()
        free(cells)
    free(codes)
    cls, pair = kept

    # smoothed transitions and the emissions' denominators
    seen = pair.sum(axis=0)
    unigram = (seen + 0.5) / (seen.sum() + 0.5 * k)
    transition = np.log10((pair + SMOOTH * unigram) / (pair.sum(axis=1, keepdims=True) + SMOOTH))
    mass, kinds = np.zeros(len(cls)), np.zeros(len(cls))
    bundles = 1 + len(lexicon)
    for row in counts.where(F.col("word") != int(END_WORD.astype(np.int64))).groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        mass[bundles + row["shape"]], kinds[bundles + row["shape"]] = row["c"], row["v"]
    mass[bundles:] -= np.bincount(lex_shapes, weights=lex_counts, minlength=SHAPES)
    kinds[bundles:] -= np.bincount(lex_shapes, minlength=SHAPES)
    mass[1:bundles], kinds[1:bundles] = lex_counts, 1
    if total:
        mass[0], kinds[0] = pair.sum(axis=0)[0], 1
    denominator = np.log10(np.bincount(cls, mass, k) + 0.5 * (np.bincount(cls, kinds, k) + 1))
    known = (cs >= cut) | (hashes == END_WORD)
    return BrownModel(counts, int(total), int(distinct), lexicon, cls, transition, denominator, hashes[known], cs[known], cut)


def score(docs: DataFrame, model: BrownModel, keep: list[str]) -> DataFrame:
    """``docs`` (columns ``keep``, text) with n_tokens, n_known, base_score and score.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` the class model's. Null and empty texts are one end mark.
    Repeated rows stay apart, texts of any length are one sequence each. Columns of ``docs`` with these names are replaced.
    """
    made = ("n_tokens", "n_known", "base_score", "score")
    keep = [c for c in keep if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(
        {"lexicon": model.lexicon, "cls": model.classes, "transition": model.transition, "denominator": model.denominator, "known": model.known, "counts": model.known_counts, "all": model.cut <= 1}
    )
    rows = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    schema = rows.drop("__text").schema
    for name, kind in (("__row", "long"), ("n_tokens", "long"), ("__known", "long"), ("__counts", "double"), ("__model", "double"), ("__rare", T.ArrayType(T.LongType())), ("__times", T.ArrayType(T.IntegerType()))):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        ids = counter(TaskContext.get().partitionId() << 33)
        known, known_counts = m["known"], m["counts"]
        for batch in slices(batches, "__text"):
            offsets, codes, hashes, shapes = coded(batch.column("__text"))
            at = _place(hashes, known)
            c = np.zeros(len(hashes), np.int64)
            c[at >= 0] = known_counts[at[at >= 0]]
            open_ = (c == 0) & (not m["all"])  # in the distributed table, or nowhere
            cls = m["cls"][_items(hashes, shapes, m["lexicon"])]
            seq = cls[codes]
            before = np.concatenate([[0], seq[:-1]])
            first, last = offsets[:-1], offsets[1:]

            def add(x: np.ndarray, first=first, last=last) -> np.ndarray:
                upto = np.concatenate([[0], np.cumsum(x)])
                return upto[last] - upto[first]

            logs = np.where(open_, 0.0, np.log10(c + 0.5))
            part = m["transition"][before, seq] - m["denominator"][seq]
            rare, times, ends = [], [], [0]
            far = open_[codes]
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                w, k = np.unique(codes[a:b][far[a:b]], return_counts=True)
                rare.append(w)
                times.append(k)
                ends.append(ends[-1] + len(w))
            rare, times = np.concatenate(rare), np.concatenate(times)
            yield pa.RecordBatch.from_pydict(
                {x: batch.column(x) for x in keep}
                | {
                    "__row": pa.array([next(ids) for _ in first], pa.int64()), "n_tokens": pa.array(last - first), "__known": pa.array(add((c > 0)[codes]), pa.int64()),
                    "__counts": pa.array(add(logs[codes])), "__model": pa.array(add(part)),
                    "__rare": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[rare].view(np.int64))),
                    "__times": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times.astype(np.int32))),
                }
            )

    rows = materialize(rows.mapInArrow(run, schema), "scored")
    if model.cut <= 1:  # every count was known to the tasks
        out = rows.select(*keep, "n_tokens", F.col("__known").alias("n_known"), F.col("__counts").alias("logs"), "__model")
    else:
        other = model.counts.where(F.col("c") < model.cut).select("word", "c")
        words_ = rows.select("__row", F.explode(F.arrays_zip("__rare", "__times")).alias("x")).select("__row", F.col("x.__rare").alias("word"), F.col("x.__times").alias("k"))
        met = words_.join(other, "word", "left").groupBy("__row").agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("k"))).alias("more"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs")
        )
        out = rows.drop("__rare", "__times").join(met, "__row", "left").select(
            *keep, "n_tokens", (F.col("__known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("__counts") + F.coalesce("logs", F.lit(0.0))).alias("logs"), "__model"
        )
    base = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return out.select(*keep, "n_tokens", "n_known", (F.col("logs") - F.col("n_tokens") * base).alias("base_score"), (F.col("logs") + F.col("__model")).alias("score"))
