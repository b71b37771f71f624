"""Segment- and system-level correlation: guarded Pearson and distributed Kendall tau-b.

Kendall tau-b (with ties, the scipy default) without the O(n^2) self join:

* rows -> weighted cells ``(g, x, y, w)`` (scores are rounded, so cells << rows);
* ties n1 (x), n2 (y), n3 (both) by group-bys;
* discordant pairs D by a radix decomposition over the dense rank of y: for
  bit b, cells sharing the rank prefix above b and differing at b form pairs
  whose y order is decided by b. In (x, y) order, each bit-0 cell adds
  w * (weight of earlier bit-1 cells in its prefix group). Same-x cells
  sorted by y add nothing, so only strict discordance counts.
* the top bits' prefix groups hold every cell, so the cells are range partitioned by
  (x, y) and each partition is a bucket: a small table gives the bit-1 weight
  of all lower buckets, and the running sum only spans one bucket. A cut may fall between
  cells of equal x, so a tied x is no hot bucket, and the number of buckets follows the session's partitions.

Groups travel as one struct, so a null group is a group.

tau_b = (n0 - n1 - n2 + n3 - 2 D) / sqrt((n0 - n1)(n0 - n2)), sums in decimal(38,0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .rank import dense_rank
from .stats import pair_count, safe_pearson

DEC = "decimal(38,0)"


def _pairs(c: Column) -> Column:
    c = c.cast(DEC)
    return c * (c - 1) / 2


def kendall_tau_b(df: DataFrame, x: str, y: str, groups: Sequence[str] = (), out: str = "kendall_tau") -> DataFrame:
    """(groups..., out, n): Kendall tau-b per group over pairwise-complete rows;
    null when n < 2 or either side is constant."""
    ensure_checkpoint_dir(df.sparkSession)
    names = list(groups)
    key_ = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(names)]) if names else F.struct(F.lit(0).alias("g0"))
    rows = df.select(key_.alias("__g"), F.col(x).alias("__x"), F.col(y).alias("__y"))
    x, y, g = "__x", "__y", ["__g"]
    clean = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    cells = clean.groupBy(*g, x, y).agg(F.count(F.lit(1)).alias("w")).checkpoint()
    tx = cells.groupBy(*g, x).agg(F.sum("w").alias("t")).groupBy(*g).agg(
        F.sum(_pairs(F.col("t"))).alias("n1"), F.count(F.lit(1)).alias("nx"))
    ty = cells.groupBy(*g, y).agg(F.sum("w").alias("t")).groupBy(*g).agg(
        F.sum(_pairs(F.col("t"))).alias("n2"), F.count(F.lit(1)).alias("ny"))
    tot = cells.groupBy(*g).agg(F.sum("w").alias("n"), F.sum(_pairs(F.col("w"))).alias("n3"))

    ry = dense_rank(cells, y, g, "ry")
    # the partitions of the checkpoint are the buckets
    ranked = cells.join(ry, [*g, y]).repartitionByRange(*g, x, y).checkpoint().withColumn("bucket", F.spark_partition_id())
    top = ranked.agg(F.max("ry")).first()[0]
    nbits = max(1, int(top or 0).bit_length())
    exploded = ranked.select(
        *g, x, y, "w", "bucket", "ry", F.explode(F.sequence(F.lit(0), F.lit(nbits - 1))).alias("b")
    ).select(
        *g, x, y, "w", "bucket", "b",
        F.expr("shiftright(ry, b + 1)").alias("grp"),
        F.expr("shiftright(ry, b) & 1").alias("bit"),
    )
    key = [*g, "b", "grp"]
    ones = exploded.groupBy(*key, "bucket").agg(F.sum(F.when(F.col("bit") == 1, F.col("w")).otherwise(0)).alias("s1"))
    wb = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = ones.select(*key, "bucket", F.coalesce(F.sum("s1").over(wb), F.lit(0)).alias("lower"))
    wr = Window.partitionBy(*key, "bucket").orderBy(x, y).rowsBetween(Window.unboundedPreceding, 0)
    running = exploded.join(before, [*key, "bucket"]).withColumn(
        "run", F.sum(F.when(F.col("bit") == 1, F.col("w")).otherwise(0)).over(wr) + F.col("lower")
    )
    disc = running.where(F.col("bit") == 0).groupBy(*g).agg(
        F.sum(F.col("w").cast(DEC) * F.col("run").cast(DEC)).alias("d"))

    stats = tot.join(tx, g).join(ty, g).join(disc, g, "left")
    n = F.col("n").cast(DEC)
    n0 = n * (n - 1) / 2
    num = (n0 - F.col("n1") - F.col("n2") + F.col("n3") - 2 * F.coalesce(F.col("d"), F.lit(0).cast(DEC))).cast("double")
    den = F.sqrt((n0 - F.col("n1")).cast("double") * (n0 - F.col("n2")).cast("double"))
    ok = (F.col("n") >= 2) & (F.col("nx") > 1) & (F.col("ny") > 1)
    tau = F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), num / den)))
    return stats.select(*[F.col(f"__g.g{i}").alias(c) for i, c in enumerate(names)], tau.alias(out), F.col("n").cast("bigint").alias("n"))


def long_pairs(df: DataFrame, metrics: Sequence[str], human: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., metric, x, y): one row per row and metric (NaN -> null)."""
    def clean(c):
        return F.when(~F.isnan(F.col(c)), F.col(c).cast("double"))

    items = [F.struct(F.lit(m).alias("metric"), clean(m).alias("x"), clean(human).alias("y")) for m in metrics]
    return df.select(*keep, F.inline(F.array(*items)))


def correlate(long: DataFrame, groups: Sequence[str] = ("metric",), digits: int | None = 3) -> DataFrame:
    """(groups..., pearson, kendall_tau, n) from a long (x, y) table."""
    g = list(groups)
    pear = long.groupBy(*g).agg(safe_pearson("x", "y").alias("pearson"), pair_count("x", "y").cast("bigint").alias("n"))
    kend = kendall_tau_b(long, "x", "y", g).drop("n")
    kend = kend.select(*[F.col(c).alias(f"__{c}") for c in g], "kendall_tau")
    same = F.lit(True)
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    res = pear.join(kend, same, "left")
    ok = F.col("pearson").isNotNull()
    p, k = F.col("pearson"), F.when(ok, F.col("kendall_tau"))
    if digits is not None:
        p, k = F.round(p, digits), F.round(k, digits)
    return res.select(*g, p.alias("pearson"), k.alias("kendall_tau"), "n")


def segment_corr(df: DataFrame, metrics: Sequence[str], human: str, digits: int = 3) -> DataFrame:
    """(metric, pearson, kendall_tau, n): one row per metric over all segments."""
    return correlate(long_pairs(df, metrics, human), ["metric"], digits)


def system_means(df: DataFrame, metrics: Sequence[str], human: str, model: str = "model") -> DataFrame:
    """Mean of every metric and the human score per system; rows without a system are dropped."""
    def clean(c):
        return F.when(~F.isnan(F.col(c)), F.col(c))

    return df.where(F.col(model).isNotNull()).groupBy(model).agg(
        *[F.avg(clean(c)).alias(c) for c in [*metrics, human]]
    )


def system_corr(df: DataFrame, metrics: Sequence[str], human: str, model: str = "model", digits: int = 3) -> DataFrame:
    """Correlations over the per-system means."""
    return segment_corr(system_means(df, metrics, human, model), metrics, human, digits)


def corr_table(df: DataFrame, metrics: Sequence[str], human: str, model: str = "model", digits: int = 4) -> DataFrame:
    """(level, metric, human, n, pearson, kendall_tau): segment rows, plus system rows
    when some row has a system."""
    levels = long_pairs(df, metrics, human).withColumn("level", F.lit("segment"))
    if model in df.columns:
        # without any system the means are empty and give no row
        means = long_pairs(system_means(df, metrics, human, model), metrics, human)
        levels = levels.unionByName(means.withColumn("level", F.lit("system")))
    out = correlate(levels, ["level", "metric"], digits)
    return out.select("level", "metric", F.lit(human).alias("human"), "n", "pearson", "kendall_tau")
