"""Set operations on sample tables: union of splits and first-row deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_samples(*tables: DataFrame) -> DataFrame:
    """Concatenate tables by column name; a column missing from a table is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def dedup_first(df: DataFrame, keys: Sequence[str] = ("src", "mt", "ref"), order: str = "row_id") -> DataFrame:
    """Keep the first row (smallest ``order``, null last) per key; null keys group together.

    ``min_by`` aggregates partially on the map side, so a hot key costs one
    partial row per task, not a skewed shuffle.
    """
    cols = [c for c in df.columns]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("o"))).alias("__r"))
    return kept.select("__r.*")
