"""Pair-corpus building, vocabulary and token encoding.

The corpus jobs are narrow (scan, split, filter, in-row substitution); shuffles are the
``distinct`` of the vocabulary and, of encoded tokens, each block's distinct words and its lists as numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, tokens_ws
from ..session import bound_batches, ensure_checkpoint_dir
from .lexmap import embedded, text_key
from .rank import dense_rank

MAX_TOKENS = 7
MAX_LEN = 70
PAD, UNK = "<PAD>", "<UNK>"
PAD_ID, UNK_ID = 0, 1


def pair_lines(df: DataFrame, s1: str = "s1", s2: str = "s2", key: str = "pair_id") -> DataFrame:
    """(key, line): the tab-separated line a pair file would hold."""
    return df.select(key, F.concat_ws("\t", F.col(s1), F.col(s2)).alias("line"))


def clean_pairs(lines: DataFrame, line: str = "line", key: str = "pair_id") -> DataFrame:
    """(key, s1, s2) from raw lines: strip, drop blank and single-part lines; extra parts ignored.
    Undecodable lines (U+FFFD after decoding) are dropped. The second part is read with ``get``: a filter that
    is not compiled with its neighbours evaluates shared expressions first, also for lines that have no such part."""
    stripped = strip(F.col(line))
    parts = F.split(stripped, "\t", -1)
    return lines.where(
        (stripped != "") & (F.size(parts) >= 2) & ~F.col(line).contains("�")
    ).select(key, strip(parts[0]).alias("s1"), strip(F.get(parts, F.lit(1))).alias("s2"))


def length_filter(df: DataFrame, s1: str = "s1", s2: str = "s2", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Keep pairs where neither side has more than ``max_tokens`` whitespace tokens."""
    return df.where((F.size(tokens_ws(s1)) <= max_tokens) & (F.size(tokens_ws(s2)) <= max_tokens))


def paraphrase_pairs(lines: DataFrame, line: str = "line", key: str = "pair_id",
                     max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(key, s1, s2, label=1): cleaned, length-filtered pairs."""
    return length_filter(clean_pairs(lines, line, key), max_tokens=max_tokens).withColumn("label", F.lit(1))


def contradiction_pairs(pairs: DataFrame, lexicon: DataFrame, key: str = "pair_id", s1: str = "s1", s2: str = "s2",
                        limit: int | None = None) -> DataFrame:
    """(key, s1, s2, label=0): replace the first token (lowercased lookup) that has an antonym,
    trying s1 then s2; emit (changed side, other side as it is). At most one row per pair.

    The antonym is chosen deterministically: the smallest one (the reference
    draws at random from an unordered set). The lexicon is embedded up to ``limit`` rows and
    joined on the tokens beyond; the answer is the same.
    """
    best = lexicon.where(F.col("word").isNotNull()).groupBy("word").agg(F.min("antonym").alias("antonym"))
    staged = pairs.select(key, F.col(s1).alias("__s1"), F.col(s2).alias("__s2"), tokens_ws(s1).alias("__a"), tokens_ws(s2).alias("__b"))
    lookup = embedded(best, "word", [("antonym", "string")], [], limit)
    if lookup is not None:

        def first_hit(toks: str) -> Column:
            found = F.transform(toks, lambda t: lookup(F.lower(t)))
            i = F.array_position(F.transform(found, lambda f: f.isNotNull()), F.lit(True)).cast("int")
            return F.when(i > 0, F.struct(i.alias("i"), F.get(F.get(found, i - 1), F.lit(0))["antonym"].alias("antonym")))

        staged = staged.withColumns({"__ha": first_hit("__a"), "__hb": first_hit("__b")})
    else:
        staged = staged.withColumn("__t", text_key("__s1", "__s2"))
        texts = staged.dropDuplicates(["__t"])
        hits = None
        for side, toks in (("__ha", "__a"), ("__hb", "__b")):
            spots = texts.select("__t", F.posexplode(F.transform(toks, lambda t: F.lower(t))).alias("pos", "word")).join(best, "word")
            one = spots.groupBy("__t").agg(F.min(F.struct((F.col("pos") + 1).alias("i"), "antonym")).alias(side))
            hits = one if hits is None else hits.join(one, "__t", "full")
        staged = staged.join(hits.withColumnRenamed("__t", "__t2"), F.col("__t") == F.col("__t2"), "left")

    def substituted(toks: str, hit: str) -> Column:
        i = F.col(hit)["i"]
        rest = F.slice(toks, i + 1, F.greatest(F.size(toks) - i, F.lit(0)))
        return F.array_join(F.concat(F.slice(toks, F.lit(1), i - 1), F.array(F.col(hit)["antonym"]), rest), " ")

    ha, hb = F.col("__ha").isNotNull(), F.col("__hb").isNotNull()
    return staged.where(ha | hb).select(
        key,
        F.when(ha, substituted("__a", "__ha")).otherwise(substituted("__b", "__hb")).alias("s1"),
        F.when(ha, F.col("__s2")).otherwise(F.col("__s1")).alias("s2"),
        F.lit(0).alias("label"),
    )


def build_vocab(*tables: DataFrame, cols=("s1", "s2")) -> DataFrame:
    """(word, idx): distinct whitespace tokens in code-point order, ids from 2; <PAD>=0, <UNK>=1
    (also where a text holds these words). One pass per table."""
    toks = None
    for t in tables:
        part = t.select(F.explode(F.concat(*[F.coalesce(tokens_ws(c), F.array().cast("array<string>")) for c in cols])).alias("word"))
        toks = part if toks is None else toks.unionByName(part)
    toks = toks.where(~F.col("word").isin(PAD, UNK))
    ranked = dense_rank(toks, "word", (), "r").select("word", (F.col("r") + 2).alias("idx"))
    spark = ranked.sparkSession
    specials = spark.createDataFrame([(PAD, PAD_ID), (UNK, UNK_ID)], "word string, idx long")
    return specials.unionByName(ranked)


KEY_BYTES = 64
SHARE = 20_000
BLOCK_TOKENS = 2_000_000  # tokens that share one dictionary


def word_key(word: Column) -> Column:
    """A word as a join key of at most 65 bytes: itself, or its SHA-256 if it is longer than ``KEY_BYTES``."""
    return F.when(F.octet_length(word) <= KEY_BYTES, F.concat(F.lit("w"), word)).otherwise(F.concat(F.lit("h"), F.sha2(word, 256)))


def _packed(lists: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, lists of tokens) -> blocks (block, words, keys, payload); the payload holds the lists as numbers of the words, row by row."""

    def block(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        keys, *columns = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
        lengths = np.stack([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.int64)
        encoded = pa.concat_arrays([pc.list_flatten(c) for c in columns]).dictionary_encode()
        codes = pc.fill_null(encoded.indices, len(encoded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int32)  # a null token is no word
        per_list = lengths.T.ravel()
        starts = (np.cumsum(per_list) - per_list).reshape(lists, -1).T.ravel()
        flat = lengths.ravel()
        ends = np.cumsum(flat)
        by_row = codes[np.repeat(starts - (ends - flat), flat) + np.arange(len(codes))]
        cells = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(by_row, pa.int32()))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("codes", cells.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(pa.record_batch([cells], ["codes"]))
        one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (encoded.dictionary, keys)]
        return pa.record_batch([pa.array([number], pa.int64()), *one, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "words", "keys", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, number = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                tokens += batch.num_rows + sum(len(pc.list_flatten(c)) for c in batch.columns[1:])
            if tokens >= BLOCK_TOKENS:
                yield block(held, number)
                held, tokens, number = [], 0, number + 1
        if held:
            yield block(held, number)

    return run


def _unpacked(seqs: list[str], key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (keys, payload, codes and ids of the known words) -> rows (key, seq, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, payload, known, ids = batch.columns
            for i in range(batch.num_rows):
                cells = pa.ipc.open_stream(payload[i].as_py()).read_next_batch().column(0)
                offsets, codes = cells.offsets.to_numpy(), cells.values.to_numpy()
                size = int(codes.max()) + 1 if len(codes) else 0
                at, to = (x[i].values.to_numpy() if x[i].is_valid else np.zeros(0, np.int64) for x in (known, ids))
                at, to = at[at < size], to[at < size]
                missing = np.setdiff1d(np.arange(size), at)
                at, to = np.concatenate([at, missing]), np.concatenate([to, np.full(len(missing), UNK_ID)])
                order = np.lexsort((to, at))
                at, to, counts = at[order], to[order], np.bincount(at, minlength=size)
                many = counts[codes]  # a word that stands in the vocabulary several times has all its ids
                ends = np.concatenate([[0], np.cumsum(many)])
                out = to[np.repeat((np.cumsum(counts) - counts)[codes] - ends[:-1], many) + np.arange(ends[-1])]
                mine = keys[i].values
                yield pa.record_batch([
                    mine.take(pa.array(np.repeat(np.arange(len(mine)), len(seqs)))), pa.array(seqs * len(mine), pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends[offsets], pa.int32()), pa.array(out, pa.int64()))], [key, "seq", "ids"])

    return run


def encode_tokens(df: DataFrame, vocab: DataFrame, key: str, arrays: dict[str, Column], max_len: int = MAX_LEN,
                  broadcast_limit: int = 1_000_000, share: int = SHARE) -> DataFrame:
    """(key, seq, ids): token -> index (UNK for unknown), truncated / padded with PAD to ``max_len``.

    Only the first ``max_len`` tokens count (that is the encoder's truncation). Tokens neither explode nor move as words: each
    task numbers the words of some ``BLOCK_TOKENS`` tokens and writes the lists as numbers. Each block asks the vocabulary
    for each of its words once, so that a frequent word has a row a block, whatever its ``share`` of the tokens. The ids go back
    to their block. A vocabulary of at most ``broadcast_limit`` words travels to the tasks, its keys bounded in bytes;
    a larger one meets the blocks' words in a shuffle. Rows of one key are merged by position.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    bound_batches(spark)
    rows = df.select(F.col(key).alias("key"), *[F.slice(v, 1, max_len).cast("array<string>").alias(f"a{i}") for i, v in enumerate(arrays.values())])
    kind = df.select(key).schema[0].dataType.simpleString()
    path = f"{base}/mtlens-blocks-{uuid.uuid4().hex}"
    packed = rows.mapInArrow(_packed(len(arrays)), f"block long, words array<string>, keys array<{kind}>, payload binary")
    packed.write.parquet(path)
    blocks = spark.read.schema(packed.schema).parquet(path)

    def keyed(df: DataFrame, *columns: str) -> DataFrame:
        named = df.select(word_key(F.col("word")).alias("__w"), *columns)
        return named.withColumn("__h", F.xxhash64("__w"))  # compared first: a number sorts faster than a word

    voc = keyed(vocab, "idx")
    if voc.limit(broadcast_limit + 1).count() <= broadcast_limit:
        voc = F.broadcast(voc)
    words = keyed(blocks.select("block", F.posexplode("words").alias("code", "word")), "block", "code")
    known = words.join(voc, ["__h", "__w"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct(F.col("code").cast("long").alias("code"), F.col("idx").cast("long").alias("idx")))).alias("known"))
    met = blocks.select("block", "keys", "payload").join(known, "block", "left").select("keys", "payload", "known.code", "known.idx")
    out = met.mapInArrow(_unpacked(list(arrays), key), f"{key} {kind}, seq string, ids array<bigint>")
    if blocks.select(F.explode("keys").alias("k")).groupBy("k").count().where("count > 1").limit(1).count():
        placed = F.transform("ids", lambda x, i: F.struct(i.alias("pos"), x.alias("idx")))
        merged = out.groupBy(key, "seq").agg(F.array_sort(F.flatten(F.collect_list(placed))).alias("p"))
        out = merged.select(key, "seq", F.transform("p", lambda s: s["idx"]).alias("ids"))
    padding = F.array_repeat(F.lit(PAD_ID).cast("long"), F.greatest(F.lit(max_len) - F.size("ids"), F.lit(0)))
    return out.select(key, "seq", F.concat("ids", padding).alias("ids"))
