"""Test inputs derived by Spark from the given tables.

The reference ships no data. These builders turn the generated tables into
sample-shaped DataFrames; all work grows with the input tables (no subsets,
no prefixes, no row caps).

* ``pairs``   -- one row per pair of consecutive lines of a document
  (``ref`` = line i, ``mt`` = line i+1), the line with itself if there is only one.
  Built inside each row with ``zip_with`` on the split lines: no shuffle, no window.
* ``human``   -- human scores keyed by (ref, mt), unique per key.
* ``scores``  -- one row per lineitem with three metric-like columns.
* ``events``  -- continuous scores for Kendall.
* ``pieces``  -- word-piece vectors from ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import DISSIMILAR_CATEGORIES, SIMILAR_CATEGORIES, tokens_word

CATEGORIES = SIMILAR_CATEGORIES + DISSIMILAR_CATEGORIES

# Fixture lexicons for the invented en/fr/de/es prose (fixed values).
FX_NEG = ("nicht", "pas", "no", "with")
FX_ANTO = (("le", "la"), ("der", "die"), ("el", "los"), ("the", "that"), ("and", "for"), ("is", "was"))

FX_METRICS = ("m_comet", "m_bertscore", "m_bleurt")

ROW_STRIDE = 1 << 31  # row_id = doc_id * ROW_STRIDE + line index; an array has fewer lines, an id too large raises


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit(row_id: Column, mult: int) -> Column:
    """A stand-in score in [0, 1]; reduce first so the product never overflows."""
    return (F.pmod(F.pmod(row_id, F.lit(10007)) * mult, F.lit(10007))).cast("double") / 10006


def spread(spark: SparkSession, df: DataFrame, *keys: str) -> DataFrame:
    """Hash-distribute a scan over ``spark.mtlens.spread`` partitions, or else those of a shuffle, one per core at least.

    A file has as few tasks as row groups, whatever its size, and they would run every per-row text function. Each document
    moves once, before its lines are made out of it.
    """
    shuffled = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(int(spark.conf.get("spark.mtlens.spread", "0")) or shuffled, *keys)


def line_pairs(spark: SparkSession, sf_dir: str, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, i, source, lang, ref, mt): consecutive lines of each document; with ``labels`` (doc_id, quality) also quality."""
    docs = spread(spark, table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    more = []
    if labels is not None:  # met by document: joined to the lines, a large table of labels would shuffle and sort every text twice
        docs, more = docs.join(labels, "doc_id", "left"), ["quality"]
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    n = F.size(lines)
    zipped = F.zip_with(
        F.slice(lines, 1, F.greatest(n - 1, F.lit(1))),
        F.slice(lines, F.least(n, F.lit(2)), F.greatest(n - 1, F.lit(1))),
        lambda a, b: F.struct(a.alias("ref"), b.alias("mt")),
    )
    return docs.select("doc_id", "source", "lang", *more, F.posexplode(zipped).alias("i", "p")).select(
        "doc_id", "i", "source", "lang", *more, F.col("p.ref").alias("ref"), F.col("p.mt").alias("mt")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table: src, ref, mt, model, label, category, metric and decision columns."""
    lp = line_pairs(spark, sf_dir, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    row_id = F.col("doc_id") * ROW_STRIDE + F.col("i")
    cat = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.pmod(row_id, F.lit(17)) + 1).cast("int"))
    return (
        lp.select(
            row_id.alias("row_id"),
            F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("src"),
            "ref",
            "mt",
            F.col("source").alias("model"),
            F.when(F.col("quality") == 1, F.when(F.col("i") % 10 == 0, F.lit(" P ")).otherwise(F.lit("P")))
            .when(F.col("quality") == 0, F.lit("NP"))
            .alias("label"),
            cat.alias("category"),
            _unit(row_id, 7919).alias("m_comet"),
            _unit(row_id, 104729).alias("m_bertscore"),
            F.when(F.pmod(row_id, F.lit(23)) != 0, _unit(row_id, 1299709)).alias("m_bleurt"),
            F.when(F.pmod(row_id, F.lit(5)) == 0, F.lit(0))
            .when(F.pmod(row_id, F.lit(5)) == 1, F.lit(1))
            .cast("int")
            .alias("d_rule"),
            _unit(row_id, 611953).alias("d_contra"),
            _unit(row_id, 15485863).alias("d_para"),
        )
    )


def human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human scores 0..25 keyed by (ref, mt); one row per key."""
    return (
        pairs(spark, sf_dir)
        .groupBy("ref", "mt")
        .agg(F.min(F.pmod(F.col("row_id"), F.lit(26))).cast("double").alias("human_score"))
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-lineitem metric-like scores with heavy ties and a 0..20 human score."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        (F.col("l_discount") * 10).cast("double").alias("m_disc"),
        (F.col("l_tax") * 12.5).cast("double").alias("m_tax"),
        (F.col("l_quantity") / 50).cast("double").alias("m_qty"),
        F.floor(F.col("l_extendedprice") / 5000).cast("double").alias("human_score"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous scores: x = value, y = (event_id * 7919) mod 1000."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("model"),
        F.col("value").cast("double").alias("x"),
        F.pmod(F.pmod(F.col("event_id"), F.lit(1000)) * 7919, F.lit(1000)).cast("double").alias("y"),
    )


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, pos, vec): five pieces per word from the embeddings table."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.concat(F.lit("w"), F.expr("vec_id div 5").cast("string")).alias("word"),
        F.pmod(F.col("vec_id"), F.lit(5)).cast("int").alias("pos"),
        F.col("embedding").alias("vec"),
    )


def antonym_table(spark: SparkSession, rows=FX_ANTO) -> DataFrame:
    """(seq, word, antonym) lexicon rows as read from an antonym CSV."""
    return spark.createDataFrame(
        [(i, w, a) for i, (w, a) in enumerate(rows)], "seq long, word string, antonym string"
    )


def lemma_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, lemma) of the words of all documents: the smallest word with the same first two letters."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(tokens_word("text"))).alias("word")).distinct()
    words = words.where(F.length("word") >= 2).withColumn("stem", F.substring("word", 1, 2))
    # a window, not a join with its own groups: the texts are read once
    return words.select("word", F.min("word").over(Window.partitionBy("stem")).alias("lemma"))
