"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point). An
n-gram is bound by permuting its letters' vectors by their place and multiplying
them; a text bundles (adds) the vectors of all its n-grams, a language those of
all its training texts. A text has the language of the nearest prototype by cosine.

Texts are lower-cased; every run of other characters counts as one blank.
Prototypes are sums of whole numbers, so they do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, slices

DIM = 1024
ORDER = 3
GROUP = 200_000  # characters in one matrix product
KEPT = 1 << 15  # n-gram vectors a task keeps
STEP = 1 << 13  # n-grams in one product


class Space:
    """Vectors of letters and n-grams; a cache a task, the same vectors everywhere."""

    def __init__(self, dim: int = DIM, order: int = ORDER):
        self.dim, self.order = dim, order
        self.symbol = np.full(0x110000, -1, np.int32)  # number of each code point seen; 0: no letter
        self.points = [32]
        self.letters = self._vector(32)[None]
        self.rows: dict[int, int] = {}
        self.grams = np.empty((0, dim), np.int8)

    def _vector(self, point: int) -> np.ndarray:
        return (np.random.default_rng([99, point]).integers(0, 2, self.dim, np.int8) * 2 - 1).astype(np.int8)

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.symbol[points]
        if (out < 0).any():
            for p in np.unique(points[out < 0]).tolist():
                if chr(p).isalpha():
                    self.symbol[p] = len(self.points)
                    self.points.append(p)
                    self.letters = np.concatenate([self.letters, self._vector(p)[None]])
                else:
                    self.symbol[p] = 0
            out = self.symbol[points]
        return out

    def ngrams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(keys, offsets) of all n-grams; a key packs symbol numbers, 21 bits each."""
        parts = [" " + t.lower() + " " for t in texts]
        symbols = self.symbols("".join(parts))
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        starts = np.cumsum(lengths) - lengths
        keep = symbols > 0
        keep[1:] |= symbols[:-1] > 0
        keep[starts] = True
        upto = np.concatenate([[0], np.cumsum(keep)])
        first = upto[np.append(starts, len(symbols))]
        symbols = symbols[keep].astype(np.int64)
        n = len(symbols) - self.order + 1
        if n <= 0:
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        keys = symbols[:n].copy()
        for k in range(1, self.order):
            keys = (keys << 21) | symbols[k : k + n]
        whole = np.ones(n, bool)  # not across two texts
        for k in range(1, self.order):
            cut = first[1:-1] - k
            whole[cut[(cut >= 0) & (cut < n)]] = False
        upto = np.concatenate([[0], np.cumsum(whole)])
        return keys[whole], upto[np.minimum(first, n)]

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """The n-gram vectors of distinct keys."""
        new = [k for k in keys.tolist() if k not in self.rows]
        if new:
            if len(self.rows) + len(new) > KEPT:
                self.rows, self.grams, new = {}, np.empty((0, self.dim), np.int8), keys.tolist()
            made = np.array(new, np.int64)
            out = np.ones((len(new), self.dim), np.int8)
            for place in range(self.order):
                letter = (made >> (21 * (self.order - 1 - place))) & ((1 << 21) - 1)
                out *= np.roll(self.letters, self.order - 1 - place, axis=1)[letter]
            self.rows |= zip(new, range(len(self.grams), len(self.grams) + len(new)), strict=True)
            self.grams = np.concatenate([self.grams, out])
        return self.grams[[self.rows[k] for k in keys.tolist()]]

    def bundle(self, keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One vector a row of ``offsets``: the sum of its n-grams' vectors."""
        n = len(offsets) - 1
        out = np.zeros((n, self.dim), np.float32 if len(keys) < 1 << 22 else np.float64)
        distinct, at = _distinct(keys, len(self.points), self.order)
        doc = np.repeat(np.arange(n), np.diff(offsets))
        for a in range(0, len(distinct), STEP):
            b = min(a + STEP, len(distinct))
            mine = slice(None) if b - a == len(distinct) else (at >= a) & (at < b)
            counts = np.bincount(doc[mine] * (b - a) + at[mine] - a, minlength=n * (b - a)).reshape(n, b - a)
            out += counts.astype(out.dtype) @ self.vectors(distinct[a:b]).astype(out.dtype)
        return out


def _distinct(keys: np.ndarray, symbols: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse; by a table where the alphabet is small."""
    if symbols**order > 1 << 21 or order != 3:
        return np.unique(keys, return_inverse=True)
    mask = (1 << 21) - 1
    packed = ((keys >> 42) * symbols + ((keys >> 21) & mask)) * symbols + (keys & mask)
    seen = np.zeros(symbols**3, bool)
    seen[packed] = True
    used = np.flatnonzero(seen)
    table = np.zeros(len(seen), np.int64)
    table[used] = np.arange(len(used))
    a, rest = np.divmod(used, symbols * symbols)
    b, c = np.divmod(rest, symbols)
    return (a << 42) | (b << 21) | c, table[packed]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from slices(batches, limit=GROUP)


def train(docs: DataFrame, dim: int = DIM, order: int = ORDER) -> dict[str, np.ndarray]:
    """Prototypes from ``docs`` (text, lang); null texts and languages are left out.

    Each task bundles what it reads, so a row per task, language and dimension moves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(dim, order), {}
        for batch in _groups(batches):
            langs = batch.column("lang").to_pylist()
            keys, offsets = space.ngrams(plain(batch.column("text")).to_pylist())
            names = sorted(set(langs))
            number = {x: i for i, x in enumerate(names)}
            lang = np.array([number[x] for x in langs])
            # one bundle a language: its n-grams next to each other
            by = np.argsort(lang, kind="stable")
            lengths = np.diff(offsets)
            keys = np.concatenate([keys[offsets[i] : offsets[i + 1]] for i in by]) if len(keys) else keys
            ends = np.concatenate([[0], np.cumsum(np.bincount(lang, weights=lengths, minlength=len(names)).astype(np.int64))])
            for name, vector in zip(names, space.bundle(keys, ends), strict=True):
                sums[name] = sums.get(name, 0) + vector.astype(np.float64)
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dim), pa.array(np.arange(dim), pa.int32()), pa.array(vector)], names=["lang", "at", "value"])

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(run, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    got = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).collect()
    return {r.lang: np.array([x.value for x in r.v]) for r in sorted(got, key=lambda r: r.lang)}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, order: int = ORDER, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (columns ``keep``, default all) with lang_pred and score, the cosine with its prototype (below 0: 0).

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learnt; of equally near
    languages the first by name. Columns of ``docs`` with these names are replaced.
    """
    names = list(prototypes)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    matrix = np.stack([prototypes[x] for x in names]) if names else np.empty((0, dim))
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = (matrix / np.where(lengths > 0, lengths, 1)).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space(dim, order)
        for batch in slices(batches, "__text", GROUP):
            keys, offsets = space.ngrams(plain(batch.column("__text")).to_pylist())
            vectors = space.bundle(keys, offsets).astype(np.float64)
            size = np.linalg.norm(vectors, axis=1)
            known = (np.diff(offsets) > 0) & (len(names) > 0)
            cosine = vectors @ matrix / np.where(size > 0, size, 1)[:, None]
            best = cosine.argmax(axis=1) if names else np.zeros(len(size), int)
            score = np.where(known, np.clip(cosine.max(axis=1), 0, 1) if names else 0.0, 0.0)
            pred = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in keep} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score)})

    out = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)
