"""Resumable batch text jobs (e.g. translating a pair corpus) on Structured Streaming.

A file-source stream over the input folder in batches of files, a vectorised pandas UDF for the
per-row function, ``trigger(availableNow=True)`` with a checkpoint. Each batch writes folders of its own
(``batch=<id>``) and overwrites them, so a batch that stopped half-way and is run again leaves
every row once; batches that ended are not run again. Rows that are not valid go to a reject folder, unmapped.
``resumable_map_batch`` is the batch variant: a ``left_anti`` join against the ids already written.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StructType

from ..session import bound_batches


def series_udf(fn: Callable[[pd.Series], pd.Series]):
    """Wrap a batch text function (Series -> Series) as an Arrow-batched pandas UDF."""
    @pandas_udf("string")
    def apply(s: pd.Series) -> pd.Series:
        mapped = fn(s.copy(deep=False))
        gc.collect(1)  # accessors (``.str``) and their Series hold each other, and so the batch, until some later collection
        return mapped

    return apply


def resumable_map(spark: SparkSession, src: str, schema: StructType, cols: list[str],
                  fn: Callable[[pd.Series], pd.Series], out: str, checkpoint: str, fmt: str = "json",
                  valid: Column | None = None, rejects: str | None = None, files_per_batch: int = 1000,
                  prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Apply ``fn`` to ``cols`` of every row in the files under ``src``, into ``out``; read it with ``read_batches``.

    ``prepare`` makes the rows out of those read (e.g. the parts of a line). Rows for which ``valid`` is not true (null included) are left
    out of ``out`` and, if ``rejects`` names a folder, written there as they are. A stop loses at most the running batch, which a
    rerun does over.
    """
    udf = series_udf(fn)
    bound_batches(spark)  # a worker holds some MB of text at once, however long the rows are
    if rejects is not None and valid is None:
        raise ValueError("rejects need a condition that tells valid rows")
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(src)
    stream = stream if prepare is None else prepare(stream)

    def put(rows: DataFrame, folder: str, batch_id: int) -> None:
        rows.write.mode("overwrite").format("json" if fmt == "text" else fmt).save(f"{folder.rstrip('/')}/batch={batch_id}")

    def commit(batch: DataFrame, batch_id: int) -> None:
        good = batch if valid is None else batch.where(valid)
        put(good.select(*[udf(F.col(c)).alias(c) if c in cols else F.col(c) for c in batch.columns]), out, batch_id)
        if rejects is not None:
            put(batch.where(~F.coalesce(valid, F.lit(False))), rejects, batch_id)

    q = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_batches(spark: SparkSession, folder: str, schema: StructType, fmt: str = "json") -> DataFrame:
    """The rows that ``resumable_map`` wrote to ``folder``, of all batches."""
    return spark.read.schema(schema).format(fmt).load(folder).select(*schema.names)


def resumable_map_batch(df: DataFrame, key: str, cols: list[str], fn: Callable[[pd.Series], pd.Series],
                        done: DataFrame | None) -> DataFrame:
    """Rows of ``df`` not yet in ``done`` (by ``key``), with ``fn`` applied to ``cols``."""
    bound_batches(df.sparkSession)
    todo = df.join(done.select(key), key, "left_anti") if done is not None else df
    udf = series_udf(fn)
    return todo.select(*[udf(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
