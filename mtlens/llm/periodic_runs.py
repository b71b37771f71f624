"""Periodic runs of words: stretches that repeat with a period, found by a suffix automaton with link-cut access.

The words of a text are appended one by one. The suffix links of the automaton form a tree in which the path from
the state of the text so far to the root stands for all its suffixes. Each state on it occurred last at some
earlier end; the path falls into segments of equal last ends. The access of a link-cut tree visits one node per
segment and recolours the whole path with the new end. A segment with the previous end e, the new end i and
longest string l tells that the texts up to e and up to i share exactly their last l words: with d = i - e <= l
they close with a square of period d, and the stretch of period d that ends at i has l + d words. It
grows to its run as further words are appended. Why no run is missed: at each word i of a run of
period q, from its 2q-th word on, the last q words occurred last at i - q exactly, as a later occurrence
would give the run a smaller period.

The automaton runs where a run can be: a run of at least 24 words and 3 periods consists of 8-word grams that
stand in the text again within a third of the stretch of such grams. Sorted gram hashes find these stretches in
whole batches; a run lies in one stretch with all its words, and a collision of hashes only adds words to look at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import bound_batches, mix, shingle_hashes, slices, words

MIN_WORDS = 24
MIN_PERIODS = 3
GRAM = 8  # words; a run of MIN_WORDS words and MIN_PERIODS periods has each such gram twice

SCHEMA = "doc_id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _automaton(seq: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest string, suffix link, state of each prefix) of the suffix automaton; states from 1, the root, 0 for none."""
    longest, link, step = [0, 0], [0, 0], [{}, {}]
    last, ends = 1, []
    for i, c in enumerate(seq):
        new = len(longest)
        longest.append(i + 1)
        link.append(1)
        step.append({})
        p = last
        while p and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                copy = len(longest)
                longest.append(longest[p] + 1)
                link.append(link[q])
                step.append(dict(step[q]))
                link[q] = link[new] = copy
                while p and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
        last = new
        ends.append(new)
    return longest, link, ends


class _Paths:
    """The link tree as preferred paths in splay trees, deeper states to the right; each path has one last end."""

    def __init__(self, parent: list[int]):
        self.up = list(parent)
        self.left, self.right = [0] * len(parent), [0] * len(parent)
        self.end = [-1] * len(parent)  # of the path, kept at the root of its splay tree

    def _splay(self, x: int) -> None:
        up, left, right, end = self.up, self.left, self.right, self.end
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            inner = g and (left[g] == p or right[g] == p)
            turns = (p, x) if inner and (left[g] == p) == (left[p] == x) else (x, x)
            for y in turns if inner else (x,):
                z = up[y]
                above = up[z]
                if left[z] == y:
                    child = right[y]
                    left[z], right[y] = child, z
                else:
                    child = left[y]
                    right[z], left[y] = child, z
                if child:
                    up[child] = z
                up[z], up[y] = y, above
                if above and left[above] == z:
                    left[above] = y
                elif above and right[above] == z:
                    right[above] = y
                else:
                    end[y] = end[z]

    def access(self, v: int, i: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from the root to ``v`` with ``i``; yields (deepest state, last end) of its segments before."""
        up, right, end = self.up, self.right, self.end
        x, below = v, 0
        while x:
            self._splay(x)
            if end[x] >= 0:
                yield x, end[x]
            if right[x]:
                end[right[x]] = end[x]
            right[x] = below
            below, x = x, up[x]
        self._splay(v)
        end[v] = i


def runs_of(seq: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs with ``max(min_words, min_periods * period)`` words or more, sorted.

    ``min_periods`` is at least 2.
    """
    longest, link, ends = _automaton(seq)
    paths = _Paths(link)
    found: dict[tuple[int, int], int] = {}
    for i, v in enumerate(ends):
        for state, e in paths.access(v, i):
            d, shared = i - e, longest[state]
            if shared >= d and shared + d >= max(min_words, min_periods * d):
                found[i - d - shared + 1, d] = i
    return sorted((s, e - s + 1, d) for (s, d), e in found.items())


def stretches(offsets: np.ndarray, codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first word, end) of the stretches that can hold a run, positions counted over all rows."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return []
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grams = shingle_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), GRAM) ^ mix(row[:n].astype(np.uint64))
    at = np.flatnonzero(row[:n] == row[GRAM - 1 :])
    at = at[np.argsort(grams[at], kind="stable")]
    again = grams[at[1:]] == grams[at[:-1]]
    apart = np.diff(at)[again]
    nearest = np.full(n, np.iinfo(np.int64).max)
    nearest[at[:-1][again]] = apart
    nearest[at[1:][again]] = np.minimum(nearest[at[1:][again]], apart)
    live = nearest < len(codes)
    while True:
        edge = np.diff(np.concatenate([[0], live.view(np.int8), [0]]))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = end - first + GRAM - 1
        enough = live.copy()
        spot = np.flatnonzero(live)
        room = np.repeat(size, end - first)
        enough[spot] = (room >= MIN_WORDS) & (nearest[spot] * MIN_PERIODS <= room)
        if (enough == live).all():
            return [(int(row[a]), int(a), int(b) + GRAM - 1) for a, b in zip(first, end, strict=True)]
        live = enough


def _sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def _digests(offsets: np.ndarray, codes: np.ndarray, vocabulary: pa.Array) -> dict[str, list]:
    found: dict[int, list[tuple[int, int, int]]] = {}
    dropped = np.zeros(len(codes), bool)
    for row, a, b in stretches(offsets, codes):
        for s, length, q in runs_of(codes[a:b].tolist()):
            dropped[a + s + q : a + s + length] = True
            found.setdefault(row, []).append((a + s - int(offsets[row]), length, q))
    kept = ~dropped
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
    text = vocabulary.cast(pa.large_string()).take(pa.array(codes[kept]))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), text), pa.scalar(" ", text.type))
    out: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    for row, collapsed in enumerate(joined):
        runs = sorted(found.get(row, []), key=lambda r: (r[0], r[2]))
        best = None
        for run in runs:  # in order of start and period: only a greater exponent wins
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        start, length, period = best or (None, None, None)
        values = (len(runs), start, length, period, best and 1000 * length // period)
        for name, value in zip(("n_runs", "start", "length", "period", "exponent_milli"), values, strict=True):
            out[name].append(value)
        out["runs_sha256"].append(_sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()))
        out["collapsed_sha256"].append(_sha(collapsed.as_buffer().to_pybytes() if collapsed.is_valid else b""))
    return out


def planted_words(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first, period) of the words that the query replaces in a document of ``n`` words, by a rule on the id's crc32."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def periodic_runs(docs: DataFrame, plant: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """Per document its runs: n_runs, the one of the greatest exponent, and digests of all runs and of the text without them.

    A run is a maximal stretch of words of smallest period q with ``max(24, 3 q)`` words or more; the collapsed text
    keeps each run's first period. Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. Null, empty and blank texts
    have no words, no run and an empty collapsed text. Ties in exponent go to the smallest start, then period. Repeated rows and
    ids are rows of their own; an empty table gives none; other columns, whatever their names, are not read.
    Memory grows with the longest stretch (about 1 KB a word), not with the text. With ``plant``, the words of a
    row from ``first`` on repeat the first ``period`` of them: ``plant(doc_id, number of words) -> (first, period)``.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, codes, vocabulary = words(part.column("text"), lower=False)
            ids = part.column("doc_id")
            if plant is not None:
                codes = codes.copy()
                for row, doc_id in enumerate(ids.to_pylist()):
                    o, n = int(offsets[row]), int(offsets[row + 1] - offsets[row])
                    rule = plant(doc_id, n)
                    if rule:
                        a, p = rule
                        codes[o + a : o + n] = codes[o + a + np.arange(n - a) % p]
            out = _digests(offsets, codes, vocabulary)
            longs = [pa.array(out[k], pa.int64()) for k in ("n_runs", "start", "length", "period", "exponent_milli")]
            texts = [pa.array(out[k], pa.string()) for k in ("runs_sha256", "collapsed_sha256")]
            yield pa.RecordBatch.from_arrays([ids, *longs, *texts], ["doc_id", *out])

    return docs.mapInArrow(task, SCHEMA.format(id=id_type))
