"""Exact edit distance whose cost falls with what the texts share.

Equal ends are stripped first. What is left goes through the bit-parallel form of the dynamic program (Myers 1999,
Hyyrö 2003): a column of the matrix is two integers, the rises and the falls from cell to cell, so a step costs one pass
over the machine words of the longer text instead of one operation per cell. The JVM's ``levenshtein`` computes
every cell, and its threshold form helps only where texts are close; unrelated sentences differ in three quarters of
their characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def distance(a: str, b: str) -> int:
    """Least number of inserted, deleted and replaced characters."""
    k = _shared(a, b)
    a, b = a[k:], b[k:]
    k = _shared(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    cells = {c: bytearray(len(a) // 8 + 1) for c in set(b)}
    for i, c in enumerate(a):
        if c in cells:
            cells[c][i >> 3] |= 1 << (i & 7)
    places = {c: int.from_bytes(x, "little") for c, x in cells.items()}
    full = (1 << len(a)) - 1
    rises, falls = full, 0
    for c in b:
        same = places[c]
        across = (((same & rises) + rises) ^ rises) | same
        up = falls | ((across | rises) ^ full)  # a carry beyond the text is cut off below
        down = rises & across
        up, down = (up << 1 | 1) & full, (down << 1) & full
        inside = same | falls
        rises, falls = down | ((inside | up) ^ full), up & inside
    return len(b) + rises.bit_count() - falls.bit_count()


GROUP_BYTES = 16 << 20  # places of characters that pairs worked on together may take
LEAST = 24  # pairs for each word of the longer text that are worth it
WIDTHS = np.unique(np.ceil(1.25 ** np.arange(32)).astype(np.int64))  # words that the longer texts of a group are filled up to


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """``distance`` of each pair. Pairs of about one length go through the dynamic program side by side, a character a step:
    64 cells of the longer text a machine word, carries and shifts passed from word to word."""
    out = np.zeros(len(pairs), np.int64)
    ordered = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    words = np.array([-(-len(a) // 64) for a, _ in ordered], np.int64)
    words = WIDTHS[np.minimum(np.searchsorted(WIDTHS, words), len(WIDTHS) - 1)]
    short = np.array([len(b) for _, b in ordered], np.int64)
    order = np.lexsort((-short, words))
    start = 0
    while start < len(order):
        width = int(words[order[start]])
        same_width = int(np.searchsorted(words[order], width, side="right"))
        end = min(same_width, start + max(1, GROUP_BYTES // (8 * 96 * max(width, 1))))
        some = order[start:end]
        start = end
        worth = len(some) >= LEAST * width and width < WIDTHS[-1] and short[some].all()
        got = _side_by_side([ordered[i] for i in some], width) if worth else None
        out[some] = [distance(*ordered[i]) for i in some] if got is None else got
    return out


def _codes(texts: list[str], number: np.ndarray, blank: int) -> np.ndarray:
    """(position, text) -> number of the character, ``blank`` beyond a text's end."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    cells = np.full((len(texts), int(size.max())), blank, np.int64)
    cells[np.arange(cells.shape[1]) < size[:, None]] = number[_points(texts)]
    return np.ascontiguousarray(cells.T)


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _side_by_side(pairs: list[tuple[str, str]], width: int) -> np.ndarray | None:
    """Distances of pairs whose longer texts take ``width`` words, the shorter ones in falling length; None for too many different characters."""
    longer, shorter = [a for a, _ in pairs], [b for _, b in pairs]
    points = _points(longer + shorter)
    number = np.zeros(int(points.max()) + 1, np.int64)
    number[points] = 1
    number = np.cumsum(number) - 1
    n, kinds = len(pairs), int(number[-1]) + 1
    if n * (kinds + 1) * width * 8 > 2 * GROUP_BYTES:
        return None
    a, b = _codes(longer, number, kinds), _codes(shorter, number, kinds)
    every, one = np.arange(n), np.uint64(1)
    places = np.zeros((n, kinds + 1, width), np.uint64)
    for i, c in enumerate(a):
        places[every, c, i >> 6] |= one << np.uint64(i & 63)
    rises, falls = np.full((width, n), ~np.uint64(0)), np.zeros((width, n), np.uint64)
    size = np.fromiter(map(len, shorter), np.int64, n)
    last = np.uint64(63)
    for j, c in enumerate(b):
        k = int(np.searchsorted(-size, -j, side="left"))  # texts longer than j
        met = places[every[:k], c[:k]].T
        carry, up_in, down_in = np.zeros(k, bool), one, np.uint64(0)
        for w in range(width):
            same, rise, fall = met[w], rises[w, :k], falls[w, :k]
            total = same & rise
            total += rise
            over = total < rise
            total += carry
            carry = over | (total < carry)
            across = (total ^ rise) | same
            up = fall | ~(across | rise)
            down = rise & across
            up_shifted, down_shifted = (up << one) | up_in, (down << one) | down_in
            up_in, down_in = up >> last, down >> last
            inside = same | fall
            rises[w, :k] = down_shifted | ~(inside | up_shifted)
            falls[w, :k] = up_shifted & inside
    rest = np.clip(np.fromiter(map(len, longer), np.int64, n) - 64 * np.arange(width)[:, None], 0, 64)
    mask = np.where(rest > 0, ~np.uint64(0) >> np.minimum(64 - rest, 63).astype(np.uint64), np.uint64(0))
    rises &= mask
    falls &= mask
    return size + np.bitwise_count(rises).sum(axis=0, dtype=np.int64) - np.bitwise_count(falls).sum(axis=0, dtype=np.int64)


@pandas_udf(IntegerType())
def _distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        there = np.flatnonzero((a.notna() & b.notna()).to_numpy())
        got = pd.Series(pd.NA, index=range(len(a)), dtype="Int32")
        got.iloc[there] = distances(list(zip(a.iloc[there], b.iloc[there], strict=True))).astype(np.int32)
        yield got


def edit_distance(a: Column | str, b: Column | str) -> Column:
    """Levenshtein distance in code points; null if a side is null. Equal texts and an empty side never leave the JVM."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    trivial = (a == b) | (a == "") | (b == "") | a.isNull() | b.isNull()
    null = F.lit(None).cast("string")
    hard = _distances(F.when(~trivial, a).otherwise(null), F.when(~trivial, b).otherwise(null))
    return F.when(a == b, F.lit(0)).when((a == "") | (b == ""), F.length(a) + F.length(b)).otherwise(hard)
