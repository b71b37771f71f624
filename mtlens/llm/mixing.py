"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / weight, u a hash of its id and
text and the weight its quality; taking the smallest keys of a source samples it
without replacement in proportion to the weights. Each source has a target in
words. The complete epochs that fit take all its documents, the rest of the
target is filled in ascending key order up to a cut.

A source is never sorted as a whole: sums per (source, key bin) give, by running
totals over the bins, the bin in which the target is met; only that bin's documents
are ordered. What remains is one small row per source, so that the decision for a
document is local to its row: no document moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

SYMBOLS = r"[#*$%&|<>]"
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, words: Column) -> Column:
    """1 for prose, down to 0.1 as symbols come to equal the words; 1 without words."""
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)) / F.greatest(words, F.lit(1)))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a hash; smaller keys are taken first."""
    u = (F.pmod(F.xxhash64(doc_id, text, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], percent: int, epochs: int) -> dict[str | None, float]:
    """Targets of the sources: ``percent`` of all sizes shared by weight, none above ``epochs`` times its size.

    Sources take the weights in turn, by code point, null last. What a full source can't take is shared again.
    """
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = dict(sizes)
    left, open_, out = percent * sum(size.values()) / 100, set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in order if s in open_ and left * weight[s] / total > epochs * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(epochs * size[s])
            open_.discard(s)
        left -= sum(out[s] for s in full)
    return out


@dataclass
class Share:
    """What a source gives: its target, whole passes, and the largest key of the last, partial pass."""

    source: str | None
    size: int
    target: float
    epochs: int
    cut: float


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    words = docs.select("*", word_count(F.col("text")).alias("__size"))
    return words.withColumn("__key", sampling_key(F.col("doc_id"), F.col("text"), quality(F.col("text"), F.col("__size")), seed))


def plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, epochs: int = 2, bins: int = BINS, seed: int = 11) -> list[Share]:
    """One Share per source of ``docs`` (doc_id, text, source). The number of sources is taken to fit the driver."""
    rows = materialize(_keyed(docs.select("doc_id", "text", "source"), seed).select("source", "__size", "__key"), "keys")
    # 1 - exp(-key) grows with the key and stays in [0, 1)
    rows = rows.withColumn("bin", F.floor((1 - F.exp(-F.col("__key"))) * bins))
    sums = materialize(rows.groupBy("source", "bin").agg(F.sum("__size").alias("words")), "bins")
    sizes = [(r.source, int(r.words)) for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()]
    target = targets(sizes, weights, percent, epochs)
    shares = {}
    for source, size in sizes:
        whole = min(epochs, int(target[source] // size)) if size else 0
        shares[source] = Share(source, size, target[source], whole, -1.0)
    rest = [(s.source, s.target - s.epochs * s.size) for s in shares.values() if s.epochs < epochs and s.target > s.epochs * s.size]
    if not rest:
        return list(shares.values())
    spark = docs.sparkSession
    rest = F.broadcast(spark.createDataFrame(rest, "src string, rest double"))
    running = Window.partitionBy("source").orderBy("bin")
    at = (
        sums.withColumn("upto", F.sum("words").over(running))
        .join(rest, F.col("source").eqNullSafe(F.col("src")))
        .where((F.col("upto") - F.col("words") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        .select("src", "rest", F.col("bin").alias("last"), (F.col("upto") - F.col("words")).alias("before"))
    ).collect()
    # the documents of that bin, in key order; rows of one key are taken together
    near = F.broadcast(spark.createDataFrame([tuple(r) for r in at], "src string, rest double, last long, before long"))
    inside = rows.join(near, F.col("source").eqNullSafe(F.col("src")) & (F.col("bin") == F.col("last")))
    steps = inside.groupBy("src", "rest", "before", "__key").agg(F.sum("__size").alias("words"))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy("src").orderBy("__key"))
    steps = steps.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("words"))
    fits = F.abs(F.col("upto") - F.col("rest")) <= F.abs(F.col("from") - F.col("rest"))  # nearer with it than without
    cuts = {r.src: r for r in steps.groupBy("src").agg(F.max(F.when(fits, F.col("__key"))).alias("cut"), F.min("__key").alias("first")).collect()}
    for r in at:
        got = cuts[r.src]
        # without a document of that bin the cut lies below it: bins before are taken whole
        shares[r.src].cut = got.cut if got.cut is not None else float.fromhex("0x1p-1074") if r.before == 0 else _below(got.first)
    return list(shares.values())


def _below(x: float) -> float:
    import math

    return math.nextafter(x, -1.0)


def decide(docs: DataFrame, shares: list[Share], seed: int = 11) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (long), decided row by row.

    ``taken`` = size * copies. Null and empty texts have size 0 and one or more copies that count nothing;
    null sources are a source of their own. Rows with equal id and text are taken or left together.
    Columns of ``docs`` with the new names are replaced.
    """
    made = ("size", "source_size", "target", "copies", "taken", "__src")
    keep = [c for c in docs.columns if c not in made]
    spark = docs.sparkSession
    rows = [(s.source, s.size, s.target, s.epochs, s.cut) for s in shares]
    table = F.broadcast(spark.createDataFrame(rows, "__src string, source_size long, target double, __epochs int, __cut double"))
    joined = _keyed(docs.select(*keep), seed).join(table, F.col("source").eqNullSafe(F.col("__src")), "left")
    copies = F.col("__epochs") + F.when(F.col("__key") <= F.col("__cut"), 1).otherwise(0)
    return joined.select(*keep, F.col("__size").alias("size"), "source_size", "target", copies.cast("long").alias("copies"), (F.col("__size") * copies).cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document of ``docs`` as many times as it is taken; those without words are not."""
    seed = options.get("seed", 11)
    decided = decide(docs, plan(docs, **options), seed).where((F.col("copies") > 0) & (F.col("size") > 0))
    return decided.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)
