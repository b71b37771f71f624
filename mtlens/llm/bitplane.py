"""Token ids in bit-plane shuffled binary form.

Documents in ascending id order are cut into shards by range; a shard's ids form
one stream, cut into blocks of ``BLOCK`` ids. A block's ids are transposed into
byte planes (4) or bit planes (32) and each plane is compressed by itself: the
high planes are almost constant and vanish. Under the given folder stand

* ``chunks``: per block its place (shard, block, first id, number of ids), the
  compressed planes and the documents it touches (id, first id, number of ids);
* ``index``: per block its global start and the plane sizes, so that a reader
  can seek without touching a plane.

Both are written by Spark's committed Parquet writer (planes stay opaque binary cells),
so any storage Spark reaches works and a lost executor leaves no half-written block.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import KEPT, bound_batches, lean, slices, words

BLOCK = 1 << 16
END = 1
SLICE = 2 << 20
SHARD_BYTES = 64 << 20  # of text
KNOWN_BYTES = 48 << 20  # of the table of known words in a worker, with
WORD_COST = 200  # bytes of Python objects and table rows a word
PUNCTUATION = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
CHUNK_SCHEMA = "shard int, block int, first long, n int, planes array<binary>, doc array<struct<id: long, first: long, n: long>>"


# ---- planes


def to_planes(ids: np.ndarray, bits: bool = False, level: int = 3) -> list[bytes]:
    """The compressed byte planes (lowest byte first), or bit planes (lowest bit first), of uint32 ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = raw.T
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids again; the number of planes tells their kind."""
    unpack = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(unpack.decompress(p), np.uint8) for p in planes])
    if len(planes) == 32:
        raw = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    else:
        raw = rows.T
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)[:n]


# ---- crc32 of joined parts

_POLY = 0xEDB88320  # fixed value: the reflected CRC-32 polynomial


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC polynomial; the highest bit is x^0."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = (a << 1) & 0xFFFFFFFF
        b = (b >> 1) ^ (_POLY if b & 1 else 0)
    return out


def crc_join(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings one after the other, from theirs and the second's length."""
    power, square, n = 0x80000000, 0x40000000, 8 * length
    while n:
        if n & 1:
            power = _times(square, power)
        square = _times(square, square)
        n >>= 1
    return _times(power, first) ^ second


# ---- encoding


def _strings(column: pa.Array) -> list[str]:
    """``to_pylist`` without a scalar object per value."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Token ids of whole texts with the tokenizers library, each distinct word encoded once.

    The tokenizer drops white space and never merges across it, nor between a letter and the
    ASCII punctuation after it, so a text's ids are those of its words one after another. Words that may hold a
    special token (``<|``) go to the library as they are; letter words go to it many at a
    time and are told apart by their last token (the one that ends a word).

    The ids of known words lie in one array; a table of at most ``KNOWN_BYTES`` tells their places. Words beyond it are
    encoded again in each step.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.place: dict[str, int] = {}  # word -> its row in the two tables below
        self.room = KNOWN_BYTES
        self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, stems: list[str]) -> list[bytes]:
        """The ids of each string, as bytes of uint32."""
        got: list[bytes | None] = [None] * len(stems)
        joined = [i for i, s in enumerate(stems) if s.isalpha()]
        for a in range(0, len(joined), 256 * 64):
            part = joined[a : a + 256 * 64]
            groups = [part[g : g + 256] for g in range(0, len(part), 256)]
            for group, ids in zip(groups, self._encode([" ".join([stems[i] for i in g]) for g in groups]), strict=True):
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(group) and cuts[-1] == len(ids):
                    raw, at = ids.tobytes(), 0
                    for i, cut in zip(group, (4 * cuts).tolist(), strict=True):
                        got[i], at = raw[at:cut], cut
        single = [i for i, g in enumerate(got) if g is None]
        for a in range(0, len(single), 4096):
            part = single[a : a + 4096]
            for i, ids in zip(part, self._encode([stems[i] for i in part]), strict=True):
                got[i] = ids.tobytes()
        return got

    def _distinct(self, whole: pa.Array) -> list[bytes]:
        """The ids of distinct lower-cased words: those before their ASCII punctuation, and those of the punctuation."""
        stem = pc.if_else(pc.match_substring(whole, "<|"), whole, pc.ascii_rtrim(whole, characters=PUNCTUATION))
        names, stems = _strings(whole), _strings(stem)
        tail = [""] * len(names)
        for i in np.flatnonzero(pc.not_equal(pc.binary_length(stem), pc.binary_length(whole)).to_numpy(zero_copy_only=False)).tolist():
            s = stems[i]
            if s[-1:].lower()[-1:].isalpha():  # a letter that stays one when lower-cased
                tail[i] = names[i][len(s) :]
            else:
                stems[i] = names[i]
        coded, tails = pa.array(stems, pa.string()).dictionary_encode(), sorted(set(tail) - {""})
        ids = self.pieces(_strings(coded.dictionary))
        tail_ids = {"": b"", **dict(zip(tails, self.pieces(tails), strict=True))}
        return [ids[c] + tail_ids[t] for c, t in zip(coded.indices.to_numpy().tolist(), tail, strict=True)]

    def _places(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, ids): the ids of word i are ids[start[i] : start[i] + length[i]]."""
        lowered = pc.if_else(pc.match_substring(vocabulary, "<|"), vocabulary, pc.ascii_lower(vocabulary))
        names = _strings(lowered)
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.start[at], self.length[at], self.flat
        coded = lowered.take(pa.array(new)).dictionary_encode()
        words_ = coded.dictionary
        ids = self._distinct(words_)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = len(self.flat) + np.cumsum(length) - length
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
        starts, lengths = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        at[new] = len(self.start) + coded.indices.to_numpy()
        if self.room > 0:
            cost = np.cumsum(pc.binary_length(words_).to_numpy() + 4 * length + WORD_COST)
            k = int(np.searchsorted(cost, self.room, side="right"))
            self.place.update(zip(_strings(words_.slice(0, k)), range(len(self.start), len(self.start) + k), strict=True))
            self.room = 0 if k < len(cost) else self.room - int(cost[-1])
            self.start, self.length = starts[: len(self.start) + k], lengths[: len(self.length) + k]
            self.flat = flat[: int(start[k])] if k < len(start) else flat
        return starts[at], lengths[at], flat

    def __call__(self, text: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): all rows' ids, ``end`` after each row."""
        offsets, codes, vocabulary = words(text, lower=False)
        starts, lengths, flat = self._places(vocabulary)
        # word lengths in reading order, with the end of each row as one more word
        n_rows = len(offsets) - 1
        run = lengths[codes]
        sizes = np.concatenate([[0], np.cumsum(run)])
        out_offsets = sizes[offsets] + np.arange(n_rows + 1)
        take = np.repeat(starts[codes] - sizes[:-1], run)
        take += np.arange(len(take))
        out = np.full(out_offsets[-1], end, np.uint32)
        where = np.ones(len(out), bool)
        where[out_offsets[1:] - 1] = False
        out[where] = flat[take]
        return out, out_offsets


ENCODERS = "token encoders"


def encoder(path: str) -> Encoder:
    """One encoder a worker process, until another operator's task runs in it."""
    found = KEPT.setdefault(ENCODERS, {})
    if path not in found:
        found[path] = Encoder(path)
    return found[path]


# ---- writing


def _blocks(tokenizer: str, block: int, bits: bool, end: int):
    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("planes", pa.list_(pa.binary())),
         ("doc", pa.list_(pa.struct([("id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        held = np.empty(0, np.uint32)  # ids not given out yet; stream position ``first``
        docs: list[tuple] = []  # (id, first, n) of documents that reach into ``held``, or beyond

        def put(ids: np.ndarray) -> pa.RecordBatch:
            inside = [d for d in docs if d[1] < first + len(ids)]
            row = {"shard": shard, "block": number, "first": first, "n": len(ids), "planes": to_planes(ids, bits), "doc": [dict(zip(("id", "first", "n"), d, strict=True)) for d in inside]}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in slices(batches, limit=SLICE):
            ids, offsets = encoder(tokenizer)(batch.column("text"), end)
            base = first + len(held)
            docs += zip(batch.column("doc_id").to_pylist(), (base + offsets[:-1]).tolist(), np.diff(offsets).tolist(), strict=True)
            held = np.concatenate([held, ids])
            at = 0
            while len(held) - at >= block:
                yield put(held[at : at + block])
                at, first, number = at + block, first + block, number + 1
                docs = [d for d in docs if d[1] + d[2] > first]
            held = held[at:].copy()
        if len(held):
            yield put(held)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, block: int = BLOCK, bits: bool = False) -> None:
    """Encode ``docs`` (doc_id, text) and write them under ``path`` in ascending doc_id order.

    Null texts are empty and hold the end id alone. Rows that repeat an id stand together, by text; null ids come first.
    Long texts run over as many blocks as they need; other columns of ``docs``, whatever their names, are not read. A
    shard holds about ``SHARD_BYTES`` of text, so that a task's work does not grow with the table.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16).alias("bytes")).first()["bytes"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lean(_blocks(tokenizer, block, bits, end), ENCODERS), CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    index = chunks.join(_starts(chunks), "shard").select("shard", "block", (F.col("start") + F.col("first")).alias("start"), "n", F.transform("planes", F.length).alias("plane_bytes"))
    index.write.parquet(f"{path}/index")


def _starts(chunks: DataFrame) -> DataFrame:
    """(shard, start): ids in all shards before; one row per shard."""
    sizes = chunks.groupBy("shard").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))


# ---- reading


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: the part of each document in it, with its crc32."""
    names = ("shard", "doc_first", "doc_id", "n_tokens", "block", "n", "crc")
    for batch in batches:
        for row in batch.to_pylist():
            ids = from_planes(row["planes"], row["n"]).astype("<u4")
            raw, first = memoryview(ids.tobytes()), row["first"]
            out: list[tuple] = []
            for d in row["doc"]:
                a, b = max(d["first"], first) - first, min(d["first"] + d["n"], first + row["n"]) - first
                out.append((row["shard"], d["first"], d["id"], d["n"], row["block"], b - a, zlib.crc32(raw[4 * a : 4 * b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=list(names))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The crc32 of documents that stand in several blocks."""
    for batch in batches:
        crcs = []
        for parts in batch.column("parts").to_pylist():
            crc = 0
            for p in parts:
                crc = crc_join(crc, p["crc"], 4 * p["n"])
            crcs.append(crc)
        columns = [batch.column(c) for c in ("shard", "doc_first", "doc_id", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(crcs, pa.int64())], names=["shard", "doc_first", "doc_id", "n_tokens", "crc"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian uint32)."""
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    index = spark.read.parquet(f"{path}/index")
    parts = chunks.mapInArrow(lean(_parts, ENCODERS), "shard long, doc_first long, doc_id long, n_tokens long, block long, n long, crc long")
    alone = parts.where("n = n_tokens").select("shard", "doc_first", "doc_id", "n_tokens", "crc")
    several = (
        parts.where("n < n_tokens").groupBy("shard", "doc_first", "doc_id", "n_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("parts"))
        .mapInArrow(lean(_joined, ENCODERS), "shard long, doc_first long, doc_id long, n_tokens long, crc long")
    )
    starts = index.groupBy("shard").agg(F.min("start").alias("start"))
    return alone.unionAll(several).join(starts, "shard").select("doc_id", (F.col("start") + F.col("doc_first")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(start, ids): every block's global start and its decoded ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [from_planes(p, n).tolist() for p, n in zip(batch.column("planes").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["start", "ids"])

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")
    index = spark.read.parquet(f"{path}/index").select("shard", "block", "start")
    return chunks.join(index, ["shard", "block"]).select("start", "n", "planes").mapInArrow(decode, "start long, ids array<long>")
