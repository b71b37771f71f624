"""Helpers shared by the operators of this package.

Words are always ``[^\\x20\\x09-\\x0D]+``: runs of anything but ASCII white space.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20  # text per numpy step; a longer single text is one step of its own


def fold(col: str, buckets: int) -> Column:
    """crc32 of the id written as text, modulo ``buckets`` (null id: null)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(buckets))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint directory, deleted when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/mtlens-llm-{uuid.uuid4().hex}/{name}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath.getParent())
    return path


GROUP_BYTES = 8 << 20  # of a Parquet row group that ``materialize`` writes


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, a lost executor costs nothing.

    A task holds the row group that it writes in the heap, and one that reads holds a group's columns. So groups are small.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", str(GROUP_BYTES)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1_000_000  # of narrow rows (ids), some 16 MB


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted), else as it is: a shuffle join then."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


BATCH_BYTES = 4 << 20
READ_ROWS = 512  # that a Parquet reader decodes at once; 4,096 by default


def bound_batches(spark: SparkSession) -> None:
    """Let no Arrow batch between the JVM and Python hold much more than ``BATCH_BYTES`` (one row at least), no Parquet reader's more than ``READ_ROWS``.

    Texts are long, so a bound in rows alone is none. Session settings that stay; those made elsewhere are kept.
    """
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if key not in spark.conf.getAll:
            spark.conf.set(key, str(value))


def hand_back() -> None:
    """Give memory that is free in this process back to the system: Arrow's pool and, where there is glibc, the C heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


KEPT: dict[str, dict] = {}  # what a worker process keeps between tasks, by the operator that uses it


def drop_kept(keeps: str) -> None:
    """Let go of what operators other than ``keeps`` have left in this process."""
    for other in [x for x in KEPT if x != keeps]:
        del KEPT[other]


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at its end the worker, which waits for further tasks, hands its free memory back.

    What operators other than ``keeps`` have left in ``KEPT`` goes before it starts.
    """

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept(keeps)
        try:
            yield from run(batches)
        finally:
            hand_back()

    return ran


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows with at most ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size.astype(np.int64))
        start = 0
        while start < n:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def plain(text: pa.Array) -> pa.Array:
    """A string array without nulls (null: empty)."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    return pc.fill_null(text, "")


def words(text: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, vocabulary): row i has the words vocabulary[codes[offsets[i]:offsets[i + 1]]].

    ``lower`` lower-cases A-Z only.
    """
    text = plain(text)
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes, vocabulary = coded.indices.to_numpy(), coded.dictionary
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py() if len(vocabulary) else -1
    if empty >= 0:  # white space at either end of a text leaves an empty piece
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return offsets, codes, vocabulary


_X = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # fixed values of XXH64


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def word_hashes(vocabulary: pa.Array, seed: int = 0) -> np.ndarray:
    """XXH64 of distinct words, for all words below 32 bytes at once in numpy."""
    n = len(vocabulary)
    if not n:
        return np.empty(0, np.uint64)
    raw = vocabulary.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + n + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(raw.buffers()[2] or b"", np.uint8)[: offsets[-1]], np.zeros(8, np.uint8)])
    size, at = np.diff(offsets), offsets[:-1].copy()
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from any byte on
    a, b, c, d, e = _X
    with np.errstate(over="ignore"):
        h = np.uint64(seed) + e + size.astype(np.uint64)
        for step in range(3):
            w = np.flatnonzero(size >= 8 * step + 8)
            if not len(w):
                break
            h[w] = _turn(h[w] ^ (_turn(eight[at[w]] * b, 31) * a), 27) * a + d
            at[w] += 8
        w = np.flatnonzero(size & 4)
        h[w] = _turn(h[w] ^ ((eight[at[w]] & np.uint64(0xFFFFFFFF)) * a), 23) * b + c
        at[w] += 4
        for step in range(3):
            w = np.flatnonzero((size & 3) > step)
            h[w] = _turn(h[w] ^ (data[at[w]] * e), 11) * a
            at[w] += 1
        h = (h ^ (h >> np.uint64(33))) * b
        h = (h ^ (h >> np.uint64(29))) * c
        h ^= h >> np.uint64(32)
    for w in np.flatnonzero(size >= 32):
        h[w] = xxhash.xxh64_intdigest(raw[int(w)].as_py(), seed)
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` consecutive words, given the words' hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _PRIME
        out += hashes[k : k + n]
    return mix(out)


def shingle_sets(text: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles.

    A text with 1 to ``width - 1`` words has its whole sequence as its only shingle; one without words has none.
    """
    offsets, codes, vocabulary = words(text)
    hashes = word_hashes(vocabulary)[codes]
    runs = shingle_hashes(hashes, width)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield shingle_hashes(hashes[a:b], b - a) + np.uint64(b - a)
        else:
            yield np.empty(0, np.uint64)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def free(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/mtlens-llm-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
