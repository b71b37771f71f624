"""The corpus pipeline: toxicity, near duplicates, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back as
the next one's documents. All but the last return the columns of ``docs``; rows with null or empty texts pass
the filters (mixing takes none of them, as they hold no words).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mtlens.llm import decontam, mixing, ngram_join, queries, toxicity
from mtlens.llm.common import materialize, small


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    model = queries.toxicity_model(spark, docs, sf_dir)
    kept = docs.columns
    return toxicity.score(docs, model, keep=kept).where(~F.col("toxic")).select(*kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row: that with the smallest id (nulls last), then the smallest hash of its text.

    Rows are told apart by a hash of id and text, so an id on several texts makes no text go with another. Of rows
    equal in both one stays. Documents without words are linked with nothing: all of them stay.
    """
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    linked = ngram_join.link_documents(docs.select(key.alias("doc_id"), "text")).where(F.col("n_shingles") > 0)
    linked = materialize(linked.select(F.col("doc_id").alias("__key"), F.col("component_id").alias("component")), "linked")
    members = linked.groupBy("__key").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("rows"))
    ids = docs.select(key.alias("__key"), "doc_id").dropDuplicates(["__key"])
    first = members.join(ids, "__key").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key"))["__key"].alias("__key"))
    gone = materialize(members.join(first, "__key", "left_anti").select("__key"), "duplicates")
    left = docs.withColumn("__key", key).join(small(gone), "__key", "left_anti")
    repeated = materialize(members.where(F.col("rows") > 1).select("__key"), "repeated")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(small(repeated), "__key", "left_semi").dropDuplicates(["__key"])
    return left.join(small(repeated), "__key", "left_anti").unionByName(once).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontam.decontaminate(docs, queries.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per document what they hold: doc_id, start, n_tokens, ids_crc32."""
    return queries.written_tokens(spark, docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("bitplane_tokens", write_tokens),
]

ORACLE_SQL = None  # scores, sampling keys and token ids are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
