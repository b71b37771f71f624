"""Sentence-level BLEU, chrF and chrF++ as one distributed n-gram count.

Plan (one hash exchange on the narrow pair rows, none on the n-grams):

1. ``repartition(key)`` the pair table.
2. ``explode`` every n-gram of both sides as (key, kind, n, gram, side).
   kind: ``b`` BLEU words (13a tokens, n=1..4), ``c`` characters with
   whitespace removed (n=1..6), ``w`` chrF++ words (n=1..2).
   Every pair also emits one sentinel row so pairs without grams survive.
3. ``groupBy(key, kind, n, gram)`` -> hyp/ref counts, then
   ``groupBy(key, kind, n)`` -> totals and clipped matches, then
   ``groupBy(key)`` -> one row of per-order statistics. All three are
   satisfied by hash(key), so the planner adds no exchange between them.
4. Scores are column expressions over the statistics.

No per-row O(L^2) work: grams are built with ``transform(sequence(..))``
and counted by the aggregation, so a 30k-character line costs O(L).
Scores follow the public sacrebleu defaults (BLEU: 13a tokens, exp
smoothing, effective order; chrF: char order 6, beta 2; chrF++: plus word
order 2), divided by 100 and rounded to 4 as the evaluation script stores them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import WS_CLASS, WS_RUN, tokens_ws

BLEU_ORDER = 4
CHAR_ORDER = 6
WORD_ORDER = 2
BETA = 2.0

# ASCII punctuation except ' , - . (the 13a "punctuation" class, whose blank needs no blanks around it), in hex.
_P13A = r"[\x{21}-\x{26}\x{28}-\x{2B}\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7E}]"
_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
# string.punctuation
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tok13a(c: Column) -> Column:
    """13a tokens of a segment."""
    s = F.replace(c, F.lit("<skipped>"), F.lit(""))
    s = F.replace(s, F.lit("-\n"), F.lit(""))
    s = F.replace(s, F.lit("\n"), F.lit(" "))
    for a, b in _ENTITIES:
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.regexp_replace(s, f"({_P13A})", " $1 ")
    s = F.regexp_replace(s, r"([^0-9])([.,])", "$1 $2 ")
    s = F.regexp_replace(s, r"([.,])([^0-9])", " $1 $2")
    s = F.regexp_replace(s, r"([0-9])(-)", "$1 $2 ")
    return tokens_ws(s)


def chrf_words(c: Column) -> Column:
    """Whitespace words with one punctuation mark split off (trailing first, else leading)."""
    ws, mark = WS_CLASS[1:-1], "".join(f"\\x{{{ord(ch):02X}}}" for ch in _PUNCT)
    # first the leading mark of words that end in none: a word split at its end is not looked at again
    s = F.regexp_replace(c, rf"([{mark}])(?<![^{ws}][{mark}])(?=[^{ws}]*[^{ws}{mark}](?:[{ws}]|\z))", "$1 ")
    return tokens_ws(F.regexp_replace(s, rf"([{mark}])(?<=[^{ws}][{mark}])(?=[{ws}]|\z)", " $1"))


def _char_ngrams(s: Column, n: int) -> Column:
    """All overlapping n-character substrings (code points), in one regex pass:
    a lookahead capture matches at every position."""
    return F.regexp_extract_all(s, F.lit("(?s)(?=(.{%d}))" % n), 1)


def _word_ngrams(toks: Column, n: int) -> Column:
    """All contiguous n-token grams joined by one space, from the space-joined tokens:
    a capture that starts at every token start (tokens hold no whitespace)."""
    joined = F.array_join(toks, " ")
    tail = "(?: \\S+){%d}" % (n - 1) if n > 1 else ""
    return F.when(F.size(toks) >= n, F.regexp_extract_all(joined, F.lit("(?<!\\S)(?=(\\S+%s))" % tail), 1)).otherwise(
        F.array().cast("array<string>"))


def ngram_stats(df: DataFrame, key: str, hyp: str, ref: str, kinds: str = "bcw") -> DataFrame:
    """One row per key with columns ``{kind}{n}_{h|r|m}`` (hyp total, ref total, clipped matches).

    ``df`` should be hash-partitioned on ``key`` (``sentence_metrics`` does it);
    otherwise the first aggregation adds the exchange itself.
    """
    h, r = F.col(hyp), F.col(ref)
    nows = lambda c: F.regexp_replace(c, WS_RUN, "")
    empty = F.array().cast("array<string>")
    # Token arrays / stripped strings are projected once; the gram builders reference them.
    staged = df.select(
        key,
        (tok13a(h) if "b" in kinds else empty).alias("_hb"), (tok13a(r) if "b" in kinds else empty).alias("_rb"),
        (nows(h) if "c" in kinds else F.lit("")).alias("_hc"), (nows(r) if "c" in kinds else F.lit("")).alias("_rc"),
        (chrf_words(h) if "w" in kinds else empty).alias("_hw"), (chrf_words(r) if "w" in kinds else empty).alias("_rw"),
    )
    spec = {"b": (BLEU_ORDER, "_hb", "_rb", _word_ngrams), "c": (CHAR_ORDER, "_hc", "_rc", _char_ngrams),
            "w": (WORD_ORDER, "_hw", "_rw", _word_ngrams)}
    items = [F.struct(F.lit("_").alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("side"),
                      F.array(F.lit("")).alias("grams"))]  # sentinel: every key survives
    for kind in kinds:
        top, hcol, rcol, make = spec[kind]
        for side, col in ((0, hcol), (1, rcol)):
            items += [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n"), F.lit(side).alias("side"),
                               make(F.col(col), n).alias("grams")) for n in range(1, top + 1)]
    per_item = staged.select(key, F.inline(F.array(*items)))
    grams = per_item.select(key, "kind", "n", "side", F.explode("grams").alias("gram"))
    counts = grams.groupBy(key, "kind", "n", "gram").agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("hc"),
        F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("rc"),
    )
    orders = counts.groupBy(key, "kind", "n").agg(
        F.sum("hc").alias("h"), F.sum("rc").alias("r"), F.sum(F.least("hc", "rc")).alias("m")
    )
    aggs = []
    spec = [("b", BLEU_ORDER), ("c", CHAR_ORDER), ("w", WORD_ORDER)]
    for kind, top in spec:
        if kind not in kinds:
            continue
        for n in range(1, top + 1):
            sel = (F.col("kind") == kind) & (F.col("n") == n)
            for s in ("h", "r", "m"):
                aggs.append(F.coalesce(F.sum(F.when(sel, F.col(s))), F.lit(0)).cast("long").alias(f"{kind}{n}_{s}"))
    return orders.groupBy(key).agg(*aggs)


def bleu_from_stats() -> Column:
    """Sentence BLEU / 100 from ``b{n}_{h,r,m}`` columns.

    It walks over the orders: written out, they make a method that the JVM finds too long to compile.
    """
    orders = F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"b{n}_h").alias("h"), F.col(f"b{n}_m").alias("m")) for n in range(1, BLEU_ORDER + 1)])
    sys_len, ref_len = F.col("b1_h"), F.col("b1_r")
    eff = F.least(F.lit(BLEU_ORDER), sys_len)

    def add(acc: Column, o: Column) -> Column:
        zeros = acc["zeros"] + F.when((o["m"] == 0) & (o["h"] > 0), 1).otherwise(0)
        p = F.when(o["h"] > 0, F.when(o["m"] == 0, 100.0 / (F.pow(F.lit(2.0), zeros) * o["h"])).otherwise(100.0 * o["m"] / o["h"]))
        return F.struct(
            zeros.alias("zeros"), (acc["log_sum"] + F.when(o["n"] <= eff, F.log(p)).otherwise(F.lit(0.0))).alias("log_sum"), (acc["met"] + o["m"]).alias("met"))

    start = F.struct(F.lit(0).alias("zeros"), F.lit(0.0).alias("log_sum"), F.lit(0).cast("long").alias("met"))
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len > 0, F.exp(1.0 - ref_len / sys_len)).otherwise(F.lit(0.0))

    def finish(acc: Column) -> Column:
        return F.when((acc["met"] > 0) & (eff > 0), bp * F.exp(acc["log_sum"] / eff)).otherwise(F.lit(0.0))

    return F.round(F.aggregate(orders, start, add, finish) / 100.0, 4)


def with_chrf(stats: DataFrame, chrf: str | None, chrfpp: str | None) -> DataFrame:
    """Add sentence chrF / 100 from ``c{n}_*`` and chrF++ / 100 from ``c{n}_*`` and ``w{n}_*`` columns (each optional).

    An order that a side lacks has no match, so it adds nothing. The sums are columns of their own, and chrF++ goes on
    from those of chrF: in one expression they make a method that the JVM finds too long to compile.
    """
    names = {chrf: [f"c{n}" for n in range(1, CHAR_ORDER + 1)], chrfpp: [f"w{n}" for n in range(1, WORD_ORDER + 1)]}
    sp, sr, k, made, f2 = F.lit(0.0), F.lit(0.0), F.lit(0).cast("long"), [], BETA * BETA
    if not chrf:
        names = {chrfpp: [f"c{n}" for n in range(1, CHAR_ORDER + 1)] + [f"w{n}" for n in range(1, WORD_ORDER + 1)]}
    for i, (out, orders) in enumerate(names.items()):
        if not out:
            continue
        for p in orders:
            h, r, m = (F.col(f"{p}_{x}") for x in "hrm")
            sp, sr, k = sp + m / F.greatest(h, F.lit(1)), sr + m / F.greatest(r, F.lit(1)), k + F.least(h, r, F.lit(1))
        stats = stats.withColumns({f"__sp{i}": sp, f"__sr{i}": sr, f"__k{i}": k})
        sp, sr, k = F.col(f"__sp{i}"), F.col(f"__sr{i}"), F.col(f"__k{i}")
        stats = stats.withColumns({f"__ap{i}": sp / F.greatest(k, F.lit(1)), f"__ar{i}": sr / F.greatest(k, F.lit(1))})
        ap, ar = F.col(f"__ap{i}"), F.col(f"__ar{i}")
        score = F.when(ap + ar > 0, (1 + f2) * ap * ar / (f2 * ap + ar)).otherwise(F.lit(0.0))
        stats = stats.withColumn(out, F.round(score, 4))
        made += [f"__{x}{i}" for x in ("sp", "sr", "k", "ap", "ar")]
    return stats.drop(*made)


def sentence_metrics(df: DataFrame, key: str = "row_id", hyp: str = "mt", ref: str = "ref",
                     bleu: str | None = "BLEU", chrf: str | None = "ChrF", chrfpp: str | None = "ChrF++",
                     method: str = "explode") -> DataFrame:
    """Add BLEU / chrF / chrF++ columns (each optional) computed in one n-gram pass.

    ``method="explode"``: grams exploded and counted by Spark aggregations
    (one exchange on the narrow pair rows; ``key`` must be unique; the
    statistics join back on the same partitioning without another exchange).
    ``method="vectorized"``: per-pair counting in an Arrow-batched pandas UDF,
    no exchange at all; same statistics, same formulas.
    """
    kinds = ("b" if bleu else "") + ("c" if chrf or chrfpp else "") + ("w" if chrfpp else "")

    def scored(stats: DataFrame) -> DataFrame:
        return with_chrf(stats.withColumn(bleu, bleu_from_stats()) if bleu else stats, chrf, chrfpp)

    if method == "vectorized":
        stats = ngram_stats_vectorized(df, key, hyp, ref, kinds)
        return scored(stats).drop(*[c for c in stats.columns if c not in df.columns])
    staged = df.repartition(key)
    stats = scored(ngram_stats(staged, key, hyp, ref, kinds))
    return staged.join(stats.select(key, *[c for c in (bleu, chrf, chrfpp) if c]), key, "left")


BLOCK_SYMBOLS = 100_000  # characters of the pairs in one numpy step; a longer pair is a step of its own
FEW_SYMBOLS = 4_096  # fewer are counted by hashes if their grams do not fit in 64 bits

# What a character is to the tokenizers, by code point; all beyond the table are plain.
_WS, _13A, _DIGIT, _STOP, _DASH, _MARK, _PLAIN = 1, 2, 4, 8, 16, 32, 0x3001
_KIND = np.zeros(_PLAIN + 1, np.uint8)
for _kind, _members in (
    (_WS, [chr(_c) for _c in range(_PLAIN) if chr(_c).isspace()]), (_13A, set(_PUNCT) - set("',-.")), (_DIGIT, "0123456789"),
    (_STOP, ".,"), (_DASH, "-"), (_MARK, _PUNCT),
):
    _KIND[[ord(_c) for _c in _members]] |= _kind


class _Cut(NamedTuple):
    """Texts one after another as code points, and the same without whitespace."""

    kind: np.ndarray  # of every character
    first: np.ndarray  # whether a character is the first of its text, and the last
    last: np.ndarray
    begins: np.ndarray  # whether it follows whitespace or is the first of its text
    kept: np.ndarray  # characters that are no whitespace
    dense: np.ndarray  # the code points of these
    ends: np.ndarray  # where each text ends among these

    def starts(self) -> np.ndarray:
        """Whether a kept character is the first of a whitespace word."""
        return self.begins[self.kept]


def _chars(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points one after another, number per text)."""
    parts = [t if isinstance(t, str) else "" for t in texts]
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts))


def _cut(texts: Sequence[str | None]) -> _Cut:
    flat, lengths = _chars(texts)
    ends = np.cumsum(lengths)
    kind = _KIND[np.minimum(flat, _PLAIN)]
    blank = (kind & _WS).astype(bool)
    first, last, begins = np.zeros(len(flat), bool), np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    first[(ends - lengths)[lengths > 0]] = True
    last[ends[lengths > 0] - 1] = True
    begins[1:] = blank[:-1]
    begins |= first
    return _Cut(kind, first, last, begins, ~blank, flat[~blank], ends - np.searchsorted(np.flatnonzero(blank), ends))


def _split_13a(cut: _Cut) -> np.ndarray:
    """Whether a kept character is the first of a 13a token (``tok13a``, entities replaced before).

    Its marks stand alone, a dash after a digit too. In a run of dots and commas every other one is taken with the character
    before it, which may be no digit (from the first on, or from the second if the run follows a digit or begins the text), and stands
    alone; the others do unless a digit or the end of the text follows.
    """
    kind, size = cut.kind, len(cut.kind)
    dashes, stops = np.flatnonzero(kind & _DASH), np.flatnonzero(kind & _STOP)
    dashes = dashes[~cut.first[dashes] & ((kind[dashes - 1] & _DIGIT) > 0)]
    apart = cut.first[stops] | ((kind[stops - 1] & _DIGIT) > 0)
    of_run = np.arange(len(stops))
    head = cut.first[stops]
    head[1:] |= np.diff(stops) > 1
    head[:1] = True
    run = np.maximum.accumulate(np.where(head, of_run, 0))
    taken = ((of_run - run) & 1) == apart[run]
    held = cut.last[stops] | ((kind[np.minimum(stops + 1, size - 1)] & _DIGIT) > 0)
    out = cut.begins.copy()
    for alone in (np.flatnonzero(kind & _13A), dashes, stops[taken | ~held]):
        out[alone] = True
        out[alone[alone < size - 1] + 1] = True
    return out[cut.kept]


def _split_mark(cut: _Cut) -> np.ndarray:
    """Whether a kept character is the first of a chrF word (``chrf_words``)."""
    out = cut.starts()
    start = np.flatnonzero(out)
    end = np.append(start[1:], len(out)) - 1
    mark = (cut.kind[cut.kept] & _MARK) > 0
    long = end > start
    out[end[long & mark[end]]] = True
    out[start[long & ~mark[end] & mark[start]] + 1] = True
    return out


def _words(hyp: Sequence[str | None], ref: Sequence[str | None], split: Callable[[_Cut], np.ndarray] = _Cut.starts,
           cut: _Cut | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both sides' words as numbers of one numbering, and their counts; ``cut``: the two sides cut before."""
    cut = cut or _cut([*hyp, *ref])
    at = np.flatnonzero(split(cut))
    offsets = np.append(at, len(cut.dense)) * 4
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(cut.dense)])
    codes = words.dictionary_encode().indices.to_numpy()
    counts = np.diff(np.searchsorted(at, cut.ends), prepend=0)
    middle = int(counts[: len(hyp)].sum())
    return codes[:middle], counts[: len(hyp)], codes[middle:], counts[len(hyp) :]


def _hashed_counts(hyp: np.ndarray, hyp_n: np.ndarray, ref: np.ndarray, ref_n: np.ndarray, top: int) -> np.ndarray:
    """``_order_counts`` by numbers of grams.

    A gram's number comes from its prefix's number and its next symbol; order 0 is the pair
    itself, so numbers are exact and never shared by two pairs.
    """
    n = len(hyp_n)
    flat, lengths = np.concatenate([hyp, ref]).astype(np.int64), np.concatenate([hyp_n, ref_n])
    pair = np.repeat(np.tile(np.arange(n), 2), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
    of_hyp = np.arange(len(flat)) < len(hyp)
    base = int(flat.max()) + 1 if len(flat) else 1
    out, number = np.zeros((n, top, 3), np.int64), pair.copy()
    for k in range(1, top + 1):
        at = np.flatnonzero(left >= k)
        if not len(at):
            break
        gram, grams = pd.factorize(number[at] * base + flat[at + k - 1])  # hashed: no order is needed
        owner = np.empty(len(grams), np.int64)
        owner[gram] = pair[at]
        h = np.bincount(gram[of_hyp[at]], minlength=len(grams))
        r = np.bincount(gram[~of_hyp[at]], minlength=len(grams))
        for j, c in enumerate((h, r, np.minimum(h, r))):
            out[:, k - 1, j] = np.bincount(owner, weights=c, minlength=n)
        number[at] = gram
    return out


def _packed_counts(hyp: np.ndarray, hyp_n: np.ndarray, ref: np.ndarray, ref_n: np.ndarray, top: int) -> np.ndarray | None:
    """``_order_counts`` by one sort, or None if pair, longest gram and side do not fit in 64 bits.

    The symbols are numbered from 1 and packed with the first ones on top, so that equal grams of every order are neighbours. Grams that
    run over the end of their text hold a symbol that only their side has: they meet none of the other side.
    """
    n = len(hyp_n)
    flat, lengths = np.concatenate([hyp, ref]), np.concatenate([hyp_n, ref_n])
    out = np.zeros((n, top, 3), np.int64)
    if not len(flat):
        return out
    seen = np.zeros(int(flat.max()) + 1, bool)
    seen[flat] = True
    symbols = int(np.count_nonzero(seen))
    bits = (symbols + 1).bit_length()
    if bits * top + (n - 1).bit_length() + 1 > 64:
        return None
    number = np.zeros(len(seen), np.uint32)
    number[seen] = np.arange(1, symbols + 1)
    pads = top - 1
    at = np.arange(len(flat)) + np.repeat(pads * np.arange(2 * n), lengths)
    cells = np.zeros(len(flat) + pads * 2 * n, np.uint64)
    cells[len(hyp) + pads * n :] = symbols + 1
    cells[at] = number[flat]
    gram = cells
    for k in range(1, top):
        gram = gram[:-1] << bits | cells[k:]
    key = np.repeat(np.tile(np.arange(n, dtype=np.uint64) << (bits * top), 2), lengths)
    key = (key | gram[at]) << 1
    key[len(hyp) :] |= 1
    key.sort()
    refs = np.zeros(len(key) + 1, np.int64)
    np.cumsum(key & 1, out=refs[1:])
    key >>= 1
    change = key[1:] ^ key[:-1]
    ends = np.cumsum(hyp_n + ref_n)
    for k in range(1, top + 1):
        bounds = np.concatenate([[0], np.flatnonzero(change >= 1 << bits * (top - k)) + 1, [len(key)]])
        r = np.diff(refs[bounds])
        met = np.cumsum(np.minimum(r, np.diff(bounds) - r))
        out[:, k - 1, 0], out[:, k - 1, 1] = np.maximum(hyp_n - k + 1, 0), np.maximum(ref_n - k + 1, 0)
        out[:, k - 1, 2] = np.diff(np.append(0, met)[np.searchsorted(bounds, ends)], prepend=0)
    return out


def _order_counts(hyp: np.ndarray, hyp_n: np.ndarray, ref: np.ndarray, ref_n: np.ndarray, top: int) -> np.ndarray:
    """(pairs, top, 3): hypothesis total, reference total and clipped matches of each order."""
    counts = _packed_counts(hyp, hyp_n, ref, ref_n, top)
    if counts is not None:
        return counts
    half = len(hyp_n) // 2
    if not half or len(hyp) + len(ref) < FEW_SYMBOLS:
        return _hashed_counts(hyp, hyp_n, ref, ref_n, top)
    h, r = int(hyp_n[:half].sum()), int(ref_n[:half].sum())  # fewer pairs have fewer symbols
    return np.concatenate([_order_counts(hyp[:h], hyp_n[:half], ref[:r], ref_n[:half], top), _order_counts(hyp[h:], hyp_n[half:], ref[r:], ref_n[half:], top)])


def _unescaped(texts: Sequence[str | None]) -> list[str | None]:
    """The texts as 13a replaces entities and joins lines; a newline is whitespace either way."""
    out = []
    for t in texts:
        if isinstance(t, str) and ("&" in t or "<skipped>" in t or "-\n" in t):
            t = t.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
            for a, b in _ENTITIES:
                t = t.replace(a, b)
        out.append(t)
    return out


def _block_counts(hyp: list[str | None], ref: list[str | None], kinds: str) -> np.ndarray:
    """(pairs, statistics of the kinds one after another)."""
    parts, cut = [], _cut([*hyp, *ref])
    if "b" in kinds:
        plain = _unescaped(hyp), _unescaped(ref)
        parts.append(_order_counts(*_words(*plain, _split_13a, cut if plain == (hyp, ref) else None), BLEU_ORDER))
    if "c" in kinds:
        lengths = np.diff(cut.ends, prepend=0)
        middle = int(lengths[: len(hyp)].sum())
        parts.append(_order_counts(cut.dense[:middle], lengths[: len(hyp)], cut.dense[middle:], lengths[len(hyp) :], CHAR_ORDER))
    if "w" in kinds:
        parts.append(_order_counts(*_words(hyp, ref, _split_mark, cut), WORD_ORDER))
    return np.concatenate([p.reshape(len(hyp), -1) for p in parts], axis=1)


def _blocks(hyp: list[str | None], ref: list[str | None]) -> Iterator[slice]:
    """Runs of whole pairs of at most ``BLOCK_SYMBOLS`` characters."""
    sizes = [sum(len(t) for t in pair if isinstance(t, str)) for pair in zip(hyp, ref)]
    total, a = np.cumsum([0, *sizes]), 0
    while a < len(hyp):
        b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK_SYMBOLS, side="right")) - 1)
        yield slice(a, b)
        a = b


def ngram_stats_vectorized(df: DataFrame, key: str, hyp: str, ref: str, kinds: str = "bcw") -> DataFrame:
    """``df`` plus the ``ngram_stats`` columns, without any exchange: an Arrow-batched pandas UDF takes the two texts, cuts
    the tokens and numbers and counts the grams of whole blocks of pairs in numpy (no loop over rows)."""

    @pandas_udf("array<long>")
    def count(h: pd.Series, r: pd.Series) -> pd.Series:
        h, r = h.tolist(), r.tolist()
        return pd.Series([row for at in _blocks(h, r) for row in _block_counts(h[at], r[at], kinds)], dtype=object)

    st = df.withColumn("__st", count(F.col(hyp), F.col(ref)))
    names = []
    spec = [("b", BLEU_ORDER), ("c", CHAR_ORDER), ("w", WORD_ORDER)]
    for kind, top in spec:
        if kind in kinds:
            names += [f"{kind}{n}_{s}" for n in range(1, top + 1) for s in ("h", "r", "m")]
    return st.withColumns({nm: F.col("__st")[i] for i, nm in enumerate(names)}).drop("__st")
