"""Distributed dense rank without a global single-partition window.

``Window.orderBy`` with no partition puts every row in one task. Instead:
range-partition the distinct values, sort within partitions, cut lineage with
a reliable ``checkpoint`` (range bounds are sampled, so a recomputation could
move rows between partitions), count rows per (partition, group), turn the
counts into offsets with a window over that small table, and add the local
row index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1


def _with_offsets(indexed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``indexed`` with the number of rows of its group in lower partitions (__off) and its first index here (__start); a null group is a group."""
    counts = indexed.groupBy("__pid", *groups).agg(F.count(F.lit(1)).alias("__n"), F.min("__idx").alias("__start"))
    w = Window.partitionBy(*groups).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).withColumnRenamed("__pid", "__p")
    offsets = offsets.select("__p", "__start", "__off", *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)])
    same = F.col("__pid") == F.col("__p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return indexed.join(offsets, same).drop("__p", *[f"__g{i}" for i in range(len(groups))])


def dense_rank(df: DataFrame, value: str, groups: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """(groups..., value, out): 0-based dense rank of ``value`` within each group."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [*groups, value]
    distinct = df.select(*keys).where(F.col(value).isNotNull()).distinct()
    ranged = distinct.repartitionByRange(*keys).sortWithinPartitions(*keys)
    pinned = ranged.checkpoint(eager=True)
    indexed = pinned.select(
        *keys,
        F.spark_partition_id().alias("__pid"),
        F.expr(f"monotonically_increasing_id() & {_LOW33}").alias("__idx"),
    )
    return _with_offsets(indexed, groups).select(
        *keys, (F.col("__off") + F.col("__idx") - F.col("__start")).alias(out)
    )


def row_number(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (), out: str = "rn") -> DataFrame:
    """0-based row number by ``order`` (must be unique within a group), distributed like ``dense_rank``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [*groups, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    pinned = ranged.checkpoint(eager=True)
    indexed = pinned.select(
        "*",
        F.spark_partition_id().alias("__pid"),
        F.expr(f"monotonically_increasing_id() & {_LOW33}").alias("__idx"),
    )
    return _with_offsets(indexed, groups).withColumn(
        out, F.col("__off") + F.col("__idx") - F.col("__start")
    ).drop("__pid", "__idx", "__start", "__off")
