"""Lexical pair features for the contradiction and paraphrase stages.

Token arrays are projected first and referenced as columns: an array
expression used inside a lambda would otherwise be re-evaluated per element.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import NEG_CONTRA, NEG_PARA, has_negation, neg_count, tokens_word, tokens_ws
from .distance import edit_distance
from .lexmap import embedded, text_key


SMALL = 32  # up to so many tokens a scan is the quickest look-up


def token_index(tokens: Column) -> Column:
    """Hash buckets of an array's tokens, or null where it is small: look-ups cost the same however many there are.

    One sorted array holds the tokens by bucket, each bucket behind a mark of its own; ``marks`` are their positions.
    """
    n = F.size(tokens)
    entry = lambda bucket, kind, token: F.struct(bucket.cast("int").alias("bucket"), F.lit(kind).alias("kind"), token.alias("token"))
    none = F.lit(None).cast("string")
    rows = F.array_sort(F.concat(
        F.transform(tokens, lambda t: entry(F.pmod(F.xxhash64(t), n), 1, t)),
        F.transform(F.sequence(F.lit(0), n), lambda b: entry(b, 0, none)),
    ))
    return F.when(n > SMALL, rows)


def index_marks(index: Column) -> Column:
    return F.filter(F.transform(index, lambda x, i: F.when(x["kind"] == 0, i)), lambda i: i.isNotNull())


def indexed(df: DataFrame, tokens: str, name: str) -> DataFrame:
    """Add the index of the array column ``tokens`` as the columns ``name`` and ``name_marks``."""
    return df.withColumn(name, token_index(F.col(tokens))).withColumn(f"{name}_marks", index_marks(F.col(name)))


def holds(tokens: Column, name: str, token: Column) -> Column:
    """Whether ``token`` is among ``tokens``, whose index stands in the columns ``name`` and ``name_marks``."""
    index, marks = F.col(name), F.col(f"{name}_marks")
    bucket = F.pmod(F.xxhash64(token), F.size(tokens)).cast("int")
    first = F.get(marks, bucket)
    found = F.exists(F.slice(index, first + 2, F.get(marks, bucket + 1) - first - 1), lambda x: x["token"] == token)
    # the index is named twice: the optimizer would move a column that is read once into the lambda, and build it per token
    return F.when(index.isNull(), F.array_contains(tokens, token)).otherwise(found)


def token_overlap(df: DataFrame, t1: str, t2: str, prefix: str = "") -> DataFrame:
    """Add shared tokens, positions of shared tokens on both sides and the unaligned remainders.

    The time of a row grows with its tokens (and the sort of the shared ones), not with their square.
    """
    common, index = f"{prefix}common", "__shared"
    df = indexed(df.withColumn(common, F.array_intersect(F.col(t1), F.col(t2))), common, index)

    def shared(t: Column) -> Column:
        return holds(F.col(common), index, t)

    flags = {f"__in_{t}": F.transform(F.col(t), shared) for t in (t1, t2)}  # each token is looked up once
    df = df.withColumns(flags)

    def positions(t: str) -> Column:
        return F.filter(F.transform(f"__in_{t}", lambda x, i: F.when(x, i).otherwise(F.lit(-1))), lambda i: i >= 0)

    def rest(t: str) -> Column:
        flagged = F.zip_with(t, f"__in_{t}", lambda x, shared: F.struct(x.alias("x"), shared.alias("shared")))
        return F.transform(F.filter(flagged, lambda f: ~f["shared"]), lambda f: f["x"])

    return df.withColumns({f"{prefix}pos1": positions(t1), f"{prefix}pos2": positions(t2), f"{prefix}un1": rest(t1), f"{prefix}un2": rest(t2)}).drop(
        index, f"{index}_marks", *flags)


def contra_features(df: DataFrame, mt: str = "mt", ref: str = "ref", negations: Iterable[str] = NEG_CONTRA,
                    out: str = "contra_f") -> DataFrame:
    """Add ``out`` = [negation parity, mean |pos1 - pos2| of shared tokens (0 unless both
    position lists have the same non-zero length), (unaligned1 + unaligned2) / 2]."""
    negations = list(negations)
    df = df.withColumns({"__t1": tokens_word(mt), "__t2": tokens_word(ref)})
    df = token_overlap(df, "__t1", "__t2", "__o_")
    p1, p2 = F.col("__o_pos1"), F.col("__o_pos2")
    parity = ((neg_count("__t1", negations) + neg_count("__t2", negations)) % 2).cast("double")
    same = (F.size(p1) > 0) & (F.size(p1) == F.size(p2))
    diffs = F.zip_with(p1, p2, lambda a, b: F.abs(a - b).cast("double"))
    wod = F.when(same, F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x) / F.size(p1)).otherwise(F.lit(0.0))
    un = (F.size("__o_un1") + F.size("__o_un2")).cast("double") / 2.0
    return df.withColumn(out, F.array(parity, wod, un)).drop(
        "__t1", "__t2", "__o_common", "__o_pos1", "__o_pos2", "__o_un1", "__o_un2")


def para_features(df: DataFrame, lexicon: DataFrame | None, mt: str = "mt", ref: str = "ref",
                  negations: Iterable[str] = NEG_PARA, out: str = "para_f", limit: int | None = None) -> DataFrame:
    """Add ``out`` = [distinct shared tokens / max(len1, len2, 1),
    1 - edit distance(joined) / max(joined lengths, 1), negation presence mismatch,
    share of mt tokens (with repeats) having an antonym among the ref tokens].

    Tokens are whitespace tokens, case kept. The edit distance (``distance``) counts
    code points of the whole joined strings. A lexicon beyond ``limit`` rows is
    joined on the tokens instead of embedded; the answer is the same.
    """
    negations = list(negations)
    df = df.withColumns({"__s1": tokens_ws(mt), "__s2": tokens_ws(ref)})
    t1, t2 = F.col("__s1"), F.col("__s2")
    j1, j2 = F.array_join(t1, " "), F.array_join(t2, " ")
    overlap = F.size(F.array_intersect(t1, t2)) / F.greatest(F.size(t1), F.size(t2), F.lit(1))
    ed = 1.0 - edit_distance(j1, j2) / F.greatest(F.length(j1), F.length(j2), F.lit(1))
    neg = (has_negation(t1, negations) != has_negation(t2, negations)).cast("double")
    lookup = None if lexicon is None else embedded(lexicon, "word", [("antonym", "string")], ["word_pos", "anto_pos"], limit)
    if lexicon is None:
        ant = F.lit(0.0)
    elif lookup is not None:
        df = indexed(df.withColumn("__d2", F.array_distinct("__s2")), "__d2", "__i2")
        hit = F.filter(t1, lambda w: F.coalesce(F.exists(lookup(w), lambda e: holds(F.col("__d2"), "__i2", e["antonym"])), F.lit(False)))
        ant = F.size(hit) / F.greatest(F.size(t1), F.lit(1))
    else:
        df = df.withColumn("__k", text_key(mt, ref))
        texts = df.select("__k", "__s1", "__s2").dropDuplicates(["__k"])
        mine = texts.select("__k", F.explode("__s1").alias("word")).groupBy("__k", "word").agg(F.count(F.lit(1)).alias("c"))
        theirs = texts.select("__k", F.explode(F.array_distinct("__s2")).alias("antonym"))
        met = mine.join(lexicon.select("word", "antonym").distinct(), "word").join(theirs, ["__k", "antonym"], "left_semi")
        hits = met.select("__k", "word", "c").distinct().groupBy("__k").agg(F.sum("c").alias("__hits"))
        df = df.join(hits.withColumnRenamed("__k", "__k2"), F.col("__k") == F.col("__k2"), "left")
        ant = F.coalesce("__hits", F.lit(0)) / F.greatest(F.size(t1), F.lit(1))
    return df.withColumn(out, F.array(overlap.cast("double"), ed.cast("double"), neg, ant.cast("double"))).drop(
        "__s1", "__s2", "__k", "__k2", "__hits", "__d2", "__i2", "__i2_marks")
