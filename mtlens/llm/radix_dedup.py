"""Exact dedup by distributed MSD radix partitioning.

All texts start in one group. Each round splits every open group by the next bytes of its texts: the digit of a
round is a run of bytes, and later digits are wider, so that texts of any length end after few rounds. A group
with one text is a class of its own; a group whose texts ended within the digit is a class of equal texts;
only the texts of the other groups go into the next round, without the bytes already compared. Bytes are
compared with bytes: no digest decides what is equal.

A group's size and largest id come from an aggregate with map-side combine (one row per task for a group of any
size). The rows of large groups meet their group over several salted keys, so a group that holds a third of
all rows is spread over many tasks. Each round's rows are written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

FIRST_DIGIT = 64  # bytes
GROWTH = 16  # each digit is so many times wider than the one before,
WIDEST_DIGIT = 1 << 20  # up to this
HOT_ROWS = 20_000  # rows of a group that meet it over one key


def _salted(rows: DataFrame, groups: DataFrame, key: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join on ``key`` with a column ``salt``: 0 but for groups of more than ``hot_rows`` rows.

    The list of hot groups has at most (all rows / ``hot_rows``) rows. The 64-bit hash places rows, nothing else:
    groups that share it get the same number of salts on both sides.
    """
    place = F.xxhash64(*key)
    hot = groups.where(F.col("n") > hot_rows).groupBy(place.alias("place")).agg(F.max(F.ceil(F.col("n") / hot_rows)).cast("int").alias("salts"))
    if hot.isEmpty():
        return rows.withColumn("salt", F.lit(0)), groups.withColumn("salt", F.lit(0))
    hot = small(materialize(hot, "hot"))

    def met(side: DataFrame) -> DataFrame:
        return side.withColumn("place", place).join(hot, "place", "left").drop("place").withColumn("salts", F.coalesce("salts", F.lit(1)))

    spread = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.col("salts")).cast("int")
    return (
        met(rows).withColumn("salt", spread).drop("salts"),
        met(groups).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts"),
    )


def classes(docs: DataFrame, keep: list[str] | None = None, first: int = FIRST_DIGIT, growth: int = GROWTH, widest: int = WIDEST_DIGIT, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty. ``keep_id`` is the largest id of the
    class (null if all its ids are null), ``kept`` is true for exactly one row of each class: the row with that id,
    and if several rows have it, one of them. Repeated rows, ties, empty and very long texts and an
    empty table need no special care: an empty text ends in the first digit, a long one takes more rounds. Of the
    other columns of ``docs``, whatever their names, those in ``keep`` come back in a struct ``row``. The
    results do not depend on the digits' widths or on ``hot_rows``.
    """
    kept = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")] if keep else []
    extra = ["row"] if keep else []
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.sha2(body, 256).alias("text_sha256"), *kept, F.lit(0).cast("long").alias("group"), body.alias("rest"))
    width, closed = first, []
    while True:
        rows = rows.withColumn("digit", F.substring("rest", 1, width))
        key = ["group", "digit"]
        groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id")).where(F.col("n") > 1)
        groups = materialize(groups.withColumn("next", F.monotonically_increasing_id()), "groups")
        left, right = _salted(rows, groups, key, hot_rows)
        ended = F.col("n").isNull() | (F.length("digit") < width)
        # never a broadcast: the groups grow with the table
        split = left.join(right.hint("merge"), [*key, "salt"], "left").select(
            "doc_id", "text_sha256", *extra, F.lit(len(closed)).alias("round"), F.col("next").alias("group"), "n", "keep_id",
            F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"), F.monotonically_increasing_id().alias("place"),
        )
        split = materialize(split, f"round-{len(closed)}")
        closed.append(split.where(F.col("rest").isNull()).drop("rest"))
        rows = split.where(F.col("rest").isNotNull()).select("doc_id", "text_sha256", *extra, "group", "rest")
        if rows.isEmpty():
            break
        width = min(width * growth, widest)
    return _elect(reduce(DataFrame.union, closed), extra)


def _elect(rows: DataFrame, extra: list[str]) -> DataFrame:
    """One kept row per class. Only classes whose largest id stands in several rows need the rows' places."""
    single: Column = F.col("n").isNull()
    top = single | F.col("doc_id").eqNullSafe(F.col("keep_id"))
    ties = rows.where(~single & top).groupBy("round", "group").agg(F.min("place").alias("elected"), F.count(F.lit(1)).alias("rivals"))
    ties = small(materialize(ties.where(F.col("rivals") > 1).drop("rivals"), "ties"))
    wins = F.col("elected").isNull() | (F.col("place") == F.col("elected"))
    return rows.join(ties, ["round", "group"], "left").select(
        "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (top & wins).alias("kept"), "text_sha256", *extra,
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return classes(docs, keep=docs.columns).where("kept").select("row.*")
