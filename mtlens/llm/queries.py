"""One registered query per operator over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, brown, chat, decontam, host_rules, langid, mixing, periodic_runs, radix_dedup, secret_scan, toxicity, vector_codes
from .common import fold, scratch_path
from .ngram_join import link_documents
from .oracles import ORACLE  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_file() -> str:
    """The vocabulary file of the token query; it lies beside the installed tokenizers, not in the repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = langid.train(docs.where(fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return langid.predict(rows, prototypes, keep=["doc_id", "held_out"])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("row_key")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.TextCnn:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold("doc_id", 4) != 2)
    return toxicity.fit(docs.select("doc_id", "text", "lang"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir), keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic")


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 1).alias("held_out"))
    model = brown.train(docs.where(~F.col("held_out")))
    return brown.score(docs, model, ["doc_id", "held_out"]).withColumn("train_tokens", F.lit(model.total).cast("long"))


#: a conversation whose texts are control strings of a chat template
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string"))
    path = scratch_path(spark, "examples")
    examples = chat.expand(rows)
    examples.write.option("compression", "zstd").parquet(path)
    return chat.digests(spark.read.schema(examples.schema).parquet(path))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.decide(docs, mixing.plan(docs)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bitplane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_tokens(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def written_tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
    bitplane.write_tokens(docs, path, token_file())
    return bitplane.read_digests(spark, path)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), periodic_runs.planted_words)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256")
    return vector_codes.with_label_errors(coded).select("vec_id", "code", "error", "label_error", digest)


def op13_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.classes(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_secret_scan, op3_benchmark_decontamination, op4_toxicity, op5_brown_lm,
        op6_chat_formatting, op7_host_rules, op8_source_mixing, op9_ngram_jaccard_join, op10_bitplane_tokens,
        op11_periodic_runs, op12_vector_codes, op13_radix_dedup,
    )
}
