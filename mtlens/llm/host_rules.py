"""Quality rules at host level.

Each document is held against a few rules. Failures are added up by host, the
hosts' failure rates are shrunk towards an empirical beta prior (fitted to the
spread of the rates over all hosts), and a host whose shrunk rate of a rule is above
``limit`` is rejected as a whole: its documents go, whatever they are themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain, slices, words

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
LIMIT = 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_IS_SYMBOL, _IS_CHAR = np.zeros(256, np.int64), np.ones(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_IS_CHAR[list(SPACES)] = 0
_IS_CHAR[0x80:0xC0] = 0  # later bytes of a UTF-8 character


def _per_row(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(marks)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def repeated_words(codes: np.ndarray, offsets: np.ndarray, distinct: int) -> np.ndarray:
    """Per row the words inside 3-word windows that occur twice or more in it, first occurrences too."""
    out = np.zeros(len(offsets) - 1, np.int64)
    n = len(codes) - 2
    if n <= 0:
        return out
    codes = codes.astype(np.int64)
    if distinct < 1 << 21:
        keys = (codes[:n] << 42) | (codes[1 : n + 1] << 21) | codes[2:]
    else:  # number the pairs first, so that three words still fit 63 bits
        pairs = np.unique(codes[: n + 1] * distinct + codes[1:], return_inverse=True)[1]
        keys = pairs[:n] * distinct + codes[2:]
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a < 4:
            continue
        mine = keys[a : b - 2]
        ordered = np.sort(mine)
        same = ordered[1:] == ordered[:-1]
        if same.any():
            twice = np.isin(mine, ordered[1:][same])
            covered = np.zeros(b - a, bool)
            for k in range(3):
                covered[k : b - a - 2 + k] |= twice
            out[i] = covered.sum()
    return out


def duplicate_lines(text: pa.Array) -> np.ndarray:
    """Per row the lines with a word that equal an earlier line of it."""
    lists = pc.split_pattern(text, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    blank = pc.equal(pc.binary_length(pc.ascii_trim(coded.dictionary, characters=SPACES.decode())), 0).to_numpy(zero_copy_only=False).astype(bool)
    codes = coded.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(text)), np.diff(offsets))
    full = ~blank[codes]
    lines = doc[full] * max(1, len(blank)) + codes[full]
    return np.bincount(doc[full], minlength=len(text)) - np.bincount(np.unique(lines) // max(1, len(blank)), minlength=len(text))


def text_counts(text: pa.Array) -> dict[str, np.ndarray]:
    text = plain(text)
    offsets, codes, vocabulary = words(text, lower=False)
    raw, at = text_bytes(text)
    return {
        "n_words": np.diff(offsets), "word_chars": _per_row(_IS_CHAR[raw], at), "n_symbols": _per_row(_IS_SYMBOL[raw], at),
        "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeated_words(codes, offsets, len(vocabulary)),
    }


#: (name, condition that fails): rules whose failures are added up by host
RULES = (
    ("short", "n_words < 50"),
    ("repetitive", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > n_words"),
)


def measure(docs: DataFrame, host: str) -> DataFrame:
    """(doc_id, host, the counts, base_failed) per row; texts do not move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = text_counts(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "host": batch.column("host")} | {k: pa.array(counts[k], pa.int64()) for k in COUNTS})

    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    schema = rows.drop("text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return rows.mapInArrow(run, schema).withColumn("base_failed", F.expr(f"{RULES[0][1]} or {RULES[1][1]}"))


def host_verdicts(measured: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(host, docs, rate_<rule>..., host_failed): shrunk failure rates by host; null is a host of its own.

    The prior of a rule has the mean m and variance v of the hosts' rates: a + b = m (1 - m) / v - 1, at least 1
    and at most a million (equal rates everywhere); one host or none leaves its own mean as the prior.
    """
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(F.expr(f"cast({rule} as long)")).alias(name) for name, rule in RULES])
    hosts = materialize(hosts, "hosts")
    prior = hosts.agg(*[f(F.col(name) / F.col("docs")).alias(f"{k}_{name}") for name, _ in RULES for k, f in (("m", F.avg), ("v", F.var_pop))]).first()
    shrunk = []
    for name, _ in RULES:
        m, v = (prior[f"{k}_{name}"] or 0.0 for k in "mv")
        weight = float(np.clip(m * (1 - m) / v - 1 if v > 0 else 1e6, 1.0, 1e6))
        shrunk.append(((F.col(name) + m * weight) / (F.col("docs") + weight)).alias(f"rate_{name}"))
    hosts = hosts.select("host", "docs", *shrunk)
    return hosts.withColumn("host_failed", F.greatest(*[F.col(f"rate_{name}") for name, _ in RULES]) > limit)


def apply_rules(docs: DataFrame, host: str = "source", limit: float = LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, the host column): the counts, base_failed, host_failed, kept.

    Null and empty texts have no words and fail; a null host is a host. Repeated rows count as often as they occur.
    """
    measured = materialize(measure(docs, host), "measured")
    hosts = host_verdicts(measured, limit).select(F.col("host").alias("__host"), "host_failed")
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("__host")))
    return joined.select("doc_id", *COUNTS, "base_failed", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))
