"""A checked lexicon as one constant of the plan.

Rows become a JSON literal that the optimizer folds once into an array of hash buckets, each a small map;
a lookup hashes the token, picks its bucket and compares a handful of keys. Building the plan costs the same for
six entries and for thousands. Lexicons beyond the bound are not embedded: callers join them instead.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LITERAL_LEXICON_LIMIT = 20_000  # rows
LITERAL_LEXICON_BYTES = 4 << 20


def embedded(rows: DataFrame, word: str, fields: Sequence[tuple[str, str]], order: Sequence[str], limit: int | None = None) -> Callable[[Column], Column] | None:
    """token -> array<struct<fields>> (null for an unknown token), or None beyond ``limit`` rows or the byte bound.

    ``fields`` are (column, type); entries of a word stand in ``order``.
    """
    limit = LITERAL_LEXICON_LIMIT if limit is None else limit
    names = [f for f, _ in fields]
    columns = list(dict.fromkeys([word, *names, *order]))
    got = rows.where(F.col(word).isNotNull()).select(*columns, F.xxhash64(word).alias("__h")).limit(limit + 1).collect()
    if len(got) > limit:
        return None
    got = sorted(got, key=lambda r: [(r[o] is not None, r[o]) for o in order])
    size = max(1, len({r[word] for r in got}))
    buckets: list[dict] = [{} for _ in range(size)]
    for r in got:
        buckets[r["__h"] % size].setdefault(r[word], []).append({f: r[f] for f in names})
    text = json.dumps(buckets, ensure_ascii=False)
    if len(text.encode()) > LITERAL_LEXICON_BYTES:
        return None
    kind = "array<map<string,array<struct<" + ",".join(f"{f}:{t}" for f, t in fields) + ">>>>"
    table = F.from_json(F.lit(text), kind)

    def lookup(token: Column) -> Column:
        bucket = F.get(table, F.pmod(F.xxhash64(token), F.lit(size)).cast("int"))
        return F.element_at(bucket, token)

    lookup.words = sorted({r[word] for r in got})
    return lookup


def text_key(*columns: str) -> Column:
    """Two 64-bit hashes of the texts: joins by text without moving it."""
    return F.struct(F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(1), *reversed(columns)).alias("h2"))
