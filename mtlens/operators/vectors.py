"""Word vectors: mean pooling of piece vectors, PCA reduction, the embedding table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .corpus import PAD, PAD_ID, UNK, UNK_ID


def mean_pool(pieces: DataFrame, word: str = "word", pos: str = "pos", vec: str = "vec", seed: int = 0) -> DataFrame:
    """(word, vec array<double>): mean of the piece vectors leaving out the first and last position.

    Both aggregations are partial on the map side (first the range of positions, then one sum
    per word and dimension), so a word with any number of pieces is collected nowhere. Words with at most
    two pieces get a seeded pseudo-random uniform(-0.25, 0.25) vector.
    """
    rows = pieces.select(F.col(word).alias(word), F.col(pos).alias("p"), F.col(vec).cast("array<double>").alias("v"))
    g = rows.groupBy(word).agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"))
    inner = rows.join(g.select(F.col(word).alias("__w"), "lo", "hi"), F.col(word).eqNullSafe(F.col("__w"))).where((F.col("p") > F.col("lo")) & (F.col("p") < F.col("hi")))
    means = inner.select(word, F.posexplode("v").alias("i", "x")).groupBy(word, "i").agg(F.avg("x").alias("x"))
    mean = means.groupBy(F.col(word).alias("__w")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    rnd = F.transform(F.sequence(F.lit(1), F.col("dim")),
                      lambda i: (F.pmod(F.xxhash64(F.col(word), i, F.lit(seed)), F.lit(1_000_003)) / 1_000_002.0) * 0.5 - 0.25)
    zero = F.array_repeat(F.lit(0.0), F.col("dim"))
    joined = g.join(mean, F.col(word).eqNullSafe(F.col("__w")), "left")
    return joined.select(word, F.when(F.col("n") > 2, F.coalesce("mean", zero)).otherwise(rnd).alias("vec"))


def _moments(shift: np.ndarray):
    """Per task: the number of vectors, and sums and products about ``shift`` as one row a dimension (upper triangle)."""
    d = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column("v"), d) - shift
            n += len(x)
            first += x.sum(axis=0)
            second += x.T @ x
        if n:
            rows = [np.concatenate([[float(n), first[i]], second[i, i:]]) for i in range(d)]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "v": pa.array(rows, pa.list_(pa.float64()))})

    return run


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    if len(column) and not bool((np.diff(column.offsets.to_numpy()) == d).all()):
        raise ValueError(f"all vectors must have {d} components")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def principal_axes(vectors: DataFrame, k: int, vec: str = "vec") -> tuple[np.ndarray, np.ndarray]:
    """(mean, k x d axes) of the usable vectors, largest variance first.

    Mean and covariance come from one pass of sums about the first vector; only the d x d result reaches the driver.
    Of each axis the loading of largest size is positive (the first one of equal ones), so the axes are a function of the data
    wherever variances differ.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = vectors.select(F.col(vec).cast("array<double>").alias("v")).where(usable("v"))
    pilot = v.first()
    if pilot is None:
        return np.zeros(0), np.zeros((k, 0))
    shift = np.asarray(pilot["v"])
    d = len(shift)
    if not 1 <= k <= d:
        raise ValueError(f"cannot reduce {d} dimensions to {k}")
    sums = v.mapInArrow(_moments(shift), "i int, v array<double>").groupBy("i").agg(Summarizer.sum(array_to_vector("v")).alias("s"))
    first, second, n = np.zeros(d), np.zeros((d, d)), 1.0
    for r in sums.select("i", vector_to_array("s").alias("s")).toLocalIterator():
        n, first[r["i"]] = r["s"][0], r["s"][1]
        second[r["i"], r["i"]:] = second[r["i"]:, r["i"]] = r["s"][2:]
    off = first / n
    _, axes = np.linalg.eigh(second / n - np.outer(off, off))
    axes = axes[:, ::-1].T[:k]
    size = np.abs(axes)
    lead = np.argmax(size >= size.max(axis=1, keepdims=True) - 1e-9, axis=1)
    return shift + off, axes * np.where(axes[np.arange(k), lead] < 0, -1.0, 1.0)[:, None]


def usable(vec: str) -> Column:
    """The vector and all its components are there and finite, and it has some."""
    bad = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad, F.lit(False))


def reduce_dims(df: DataFrame, k: int, vec: str = "vec", out: str = "vec_k") -> DataFrame:
    """``df`` with ``out``: PCA to ``k`` dimensions of the mean-centred vectors, axes signed as in ``principal_axes``.

    A vector that is null or empty or holds a null or non-finite component takes no part in the fit and has null in ``out``;
    usable vectors of different lengths fail the job.
    """
    mean, axes = principal_axes(df, k, vec)

    @pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        res = np.full(len(v), None, dtype=object)
        there = np.flatnonzero(v.notna())
        if len(there):
            for i, x in zip(there, (np.stack(v.iloc[there].to_list()) - mean) @ axes.T, strict=True):
                res[i] = x
        return pd.Series(res)

    staged = F.when(usable("__v"), F.col("__v"))
    return df.withColumn("__v", F.col(vec).cast("array<double>")).withColumn("__v", staged).withColumn(out, project("__v")).drop("__v")


def seeded_uniform(dim: int, seed: int = 1) -> Column:
    """A reproducible uniform(-0.25, 0.25) vector (the UNK row)."""
    return F.array(*[F.lit((((seed + i) * 7919) % 10007) / 10006 * 0.5 - 0.25) for i in range(dim)])


def embedding_table(vocab: DataFrame, vectors: DataFrame, dim: int, vec: str = "vec", seed: int = 1) -> DataFrame:
    """(idx, word, vec): zero PAD vector, seeded uniform UNK vector, then every vocabulary word
    with its vector (a word without a vector gets zeros)."""
    words = vocab.where(~F.col("word").isin(PAD, UNK)).join(vectors.select("word", vec), "word", "left")
    words = words.select("idx", "word", F.coalesce(F.col(vec).cast("array<double>"),
                                                   F.array_repeat(F.lit(0.0), dim)).alias("vec"))
    spark = vocab.sparkSession
    specials = spark.createDataFrame([(PAD_ID, PAD), (UNK_ID, UNK)], "idx long, word string").select(
        "idx", "word",
        F.when(F.col("idx") == PAD_ID, F.array_repeat(F.lit(0.0), dim)).otherwise(seeded_uniform(dim, seed)).alias("vec"))
    return specials.unionByName(words)
