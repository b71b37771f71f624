"""Toxicity by a convolutional text classifier.

Words (A-Z lower-cased, ASCII punctuation trimmed) are hashed into buckets with
small embeddings; filters of several widths slide over the whole text, the
largest response of each filter is kept and a logistic layer turns them into a
score. The network is trained in numpy on all labelled rows. They are dealt by
hash of the id into shards of some ``SHARD`` documents; one shard is trained on the driver,
several in tasks: counts of words are summed over all shards, and in each epoch every shard
starts from the common weights, whose changes are then averaged (iterative parameter mixing; a
word's over the shards that moved it). Scoring runs over all rows in Arrow batches and never moves a text.

Scores are put on the probability scale with a held-back fifth of the labelled rows, and
a decision threshold is calibrated for each language on the same part. The
language only selects the threshold, it is no input of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, materialize, scratch_path, slices, small, word_hashes, words

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BUCKETS = 1 << 24
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
MIN_DOCS = 3  # training documents in which a bucket must occur to get an embedding of its own
SHARD = 8_000  # documents trained on in one piece, and their words
SHARD_WORDS = 8_000_000
LABELS = 8_000_000  # ids that travel to the texts, 16 bytes each; more meet them in a shuffle
CELL = 256  # parts of a unit of the log-odds in which several shards count their held-back rows
SLICE = 2 << 20
STEP = 1 << 17  # words looked up at once
HELD_STEP = 1 << 17  # words of held-back documents that go through the filters at once


@dataclass
class TextCnn:
    """``keys`` are the buckets with embeddings 2, 3, ...; row 0 is the padding, row 1 any other word."""

    keys: np.ndarray
    emb: np.ndarray
    conv: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3
    constant: float | None = None  # the score of everything, if there was nothing to learn

    def index(self, codes: np.ndarray, vocabulary: pa.Array) -> np.ndarray:
        """Embedding rows of coded words."""
        return self.rows(buckets(vocabulary))[codes]

    def rows(self, bucket: np.ndarray) -> np.ndarray:
        """Embedding rows of words' buckets."""
        if not len(self.keys):
            return np.ones(len(bucket), np.int32)
        at = np.minimum(np.searchsorted(self.keys, bucket), len(self.keys) - 1).astype(np.int32)
        return np.where(self.keys[at] == bucket, at + 2, 1).astype(np.int32)

    def pooled(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest responses (documents, widths * filters) before the bias."""
        flat, starts, first = padded(rows, offsets)
        return np.concatenate([np.maximum.reduceat(self.responses(k, flat, starts), first, axis=0) for k in range(len(WIDTHS))], axis=1)

    def responses(self, k: int, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        act = np.take(self.emb @ self.conv[k][0], flat[starts], axis=0)
        for j in range(1, WIDTHS[k]):
            act += np.take(self.emb @ self.conv[k][j], flat[starts + j], axis=0)
        return act

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias

    def score(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        z = self.scale[0] * self.logits(self.pooled(rows, offsets)).astype(np.float64) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def score_texts(self, text: pa.Array) -> np.ndarray:
        offsets, codes, vocabulary = words(text)
        return self.score(self.index(codes, vocabulary), offsets)


def buckets(vocabulary: pa.Array) -> np.ndarray:
    return (word_hashes(pc.ascii_trim(vocabulary, characters=PUNCTUATION)) % np.uint64(BUCKETS)).astype(np.uint32)


def padded(rows: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, starts, first): documents one after another as pad, words, pads; where windows start; each document's first start."""
    tail = max(WIDTHS) - 1
    lengths = np.diff(offsets)
    base = np.concatenate([[0], np.cumsum(lengths + 1 + tail)])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    flat = np.zeros(base[-1], np.int64)
    flat[np.arange(len(rows)) - offsets[doc] + base[doc] + 1] = rows
    first = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    many = np.repeat(np.arange(len(lengths)), lengths + 1)
    starts = np.arange(len(many)) - first[many] + base[many]
    return flat, starts, first


def train(bucket: np.ndarray, offsets: np.ndarray, labels: np.ndarray, langs: list, epochs: int = 5, batch: int = 64, rate: float = 0.05, seed: int = 7) -> TextCnn:
    """Fit the network on four fifths of the rows, its scale and thresholds on the rest.

    Row i has the words ``bucket[offsets[i] : offsets[i + 1]]``, as hash buckets.
    """
    rng = np.random.default_rng(seed)
    n = len(labels)
    held = np.arange(n) % 5 == 4
    if n < 10 or len(set(labels[~held].tolist())) < 2:
        return _constant(float(labels.mean()) if n else 0.0)
    model = _start(*_word_counts(bucket, offsets, labels, held), labels[~held].sum(), (1 - labels[~held]).sum(), rng)
    rows = _all_rows(model, bucket)
    parts = [model.emb, *model.conv, model.bias, model.out]
    memory = [np.full_like(p, 1e-3) for p in parts]
    bias_memory = 1e-3
    order = np.flatnonzero(~held)
    for _ in range(epochs):
        rng.shuffle(order)
        bias_memory = _epoch(model, memory, bias_memory, rows, offsets, labels, order, batch, rate)
    z = _held_logits(model, rows, offsets, np.flatnonzero(held))
    _calibrate(model, z, labels[held].astype(np.float64), np.array([langs[i] or "" for i in np.flatnonzero(held)]), np.ones(len(z)))
    return model


def _constant(score: float) -> TextCnn:
    return TextCnn(np.empty(0, np.uint32), np.zeros((2, DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0, constant=score)


def _word_counts(bucket: np.ndarray, offsets: np.ndarray, labels: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, toxic training documents that have them, all that have them)."""
    none = np.empty(0, np.uint32)
    distinct = [[np.unique(bucket[offsets[i] : offsets[i + 1]]) for i in np.flatnonzero(~held & some)] for some in (labels != 0, labels == 0)]
    marked, weight = np.concatenate([none, *distinct[0]]), None
    if not np.isin(labels, (0, 1)).all():
        weight = np.repeat(labels[~held & (labels != 0)], [len(d) for d in distinct[0]])
    keys, all_ = np.unique(np.concatenate([marked, *distinct[1]]), return_counts=True)
    pos = np.bincount(np.searchsorted(keys, marked), weights=weight, minlength=len(keys)).astype(np.float64)
    return keys, pos, all_


def _start(keys: np.ndarray, pos: np.ndarray, all_: np.ndarray, n_pos: float, n_neg: float, rng: np.random.Generator) -> TextCnn:
    """Buckets in enough training documents, and how much likelier each is in toxic ones (a warm start)."""
    model = _constant(0.0)
    model.constant = None
    known = all_ >= MIN_DOCS
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((all_ - pos + 0.5) / (n_neg + 1))
    model.keys = keys[known]
    model.emb = np.concatenate([np.zeros((2, DIM)), rng.normal(0, 0.05, (known.sum(), DIM))]).astype(np.float32)
    model.emb[2:, 0] = np.clip(odds[known] / 4, -1, 1) * np.minimum(1, pos[known] / 5)
    model.conv = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for c in model.conv:
        c[:, 0, :] = np.abs(c[:, 0, :]) + 0.3
    size = len(WIDTHS) * FILTERS
    model.bias = np.zeros(size, np.float32)
    model.out = np.full(size, 0.3, np.float32)
    model.out_bias = float(np.log(n_pos / n_neg))
    return model


def _all_rows(model: TextCnn, bucket: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """Embedding rows of words' buckets, a step at a time; ``rows`` may be the memory of ``bucket`` itself."""
    rows = np.empty(len(bucket), np.int32) if rows is None else rows
    for a in range(0, len(bucket), STEP):
        rows[a : a + STEP] = model.rows(bucket[a : a + STEP])
    return rows


def _own_rows(rows: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table of ``words`` embeddings that occur, the first two always; ``rows`` renumbered among them, in place)."""
    used = np.zeros(words, bool)
    used[:2] = True
    for a in range(0, len(rows), STEP):
        used[rows[a : a + STEP]] = True
    number = np.cumsum(used, dtype=np.int32) - 1
    for a in range(0, len(rows), STEP):
        rows[a : a + STEP] = number[rows[a : a + STEP]]
    return np.flatnonzero(used), rows


def _epoch(model: TextCnn, memory: list[np.ndarray], bias_memory: float, rows, offsets, labels, order, batch: int, rate: float, words: int | None = None) -> float:
    """One pass over the documents ``order``; the model and the memory of its steps change in place.

    ``words`` is the size of the whole table of embeddings, if ``model`` holds a part of it."""
    words = len(model.emb) if words is None else words
    parts = [model.emb, *model.conv, model.bias, model.out]
    for s in range(0, len(order), batch):
        ids = order[s : s + batch]
        lengths = offsets[ids + 1] - offsets[ids]
        local = np.concatenate([[0], np.cumsum(lengths)])
        grads = [np.zeros_like(p) for p in parts[1:]]
        flat, starts, first = padded(np.concatenate([rows[offsets[i] : offsets[i + 1]] for i in ids]), local)
        ends = np.append(first[1:], len(starts))
        view, at_row = model, flat
        if words > 4 * len(flat):  # only the batch's words go through the filters
            used, at_row = np.unique(flat, return_inverse=True)
            view = TextCnn(model.keys, model.emb[used], model.conv, model.bias, model.out, model.out_bias)
        feats, at = [], []
        for k in range(len(WIDTHS)):
            act = view.responses(k, at_row, starts)
            best = np.stack([a + act[a:b].argmax(axis=0) for a, b in zip(first, ends, strict=True)])
            at.append(starts[best])
            feats.append(np.take_along_axis(act, best, axis=0))
        pooled = np.concatenate(feats, axis=1) + model.bias
        live = np.maximum(pooled, 0)
        z = live @ model.out + model.out_bias
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[ids]).astype(np.float32) / len(ids)
        back = err[:, None] * model.out * (pooled > 0)
        grads[-1] = err @ live + 1e-4 * model.out
        grads[-2] = back.sum(axis=0)
        touched, moved = [], []
        for k, w in enumerate(WIDTHS):
            mine = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                word = flat[at[k] + j]  # (documents, filters)
                grads[k][j] += np.einsum("df,dfe->ef", mine, model.emb[word])
                touched.append(word.ravel())
                moved.append((mine[:, :, None] * model.conv[k][j].T[None]).reshape(-1, DIM))
        touched = np.concatenate(touched)
        uniq, inv = np.unique(touched, return_inverse=True)
        g = np.zeros((len(uniq), DIM), np.float32)
        np.add.at(g, inv, np.concatenate(moved))
        g[uniq < 2] = 0  # padding and unknown words stay at zero
        memory[0][uniq] += g * g
        model.emb[uniq] -= rate * g / np.sqrt(memory[0][uniq])
        for p, m, g in zip(parts[1:], memory[1:], grads, strict=True):
            m += g * g
            p -= rate * g / np.sqrt(m)
        bias_memory += float(err.sum()) ** 2
        model.out_bias -= rate * float(err.sum()) / bias_memory**0.5
    return bias_memory


def _held_logits(model: TextCnn, rows, offsets, ids) -> np.ndarray:
    """Logits of the documents ``ids``, whose words go through the filters some ``HELD_STEP`` at a time."""
    got, lengths = [], offsets[ids + 1] - offsets[ids]
    for some in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(np.cumsum(lengths) // HELD_STEP)) + 1):
        if len(some):
            local = np.concatenate([[0], np.cumsum(lengths[some])])
            pooled = model.pooled(np.concatenate([rows[offsets[i] : offsets[i + 1]] for i in ids[some]]), local)
            got += [model.logits(pooled[k : k + 1]) for k in range(len(some))]
    return np.concatenate([np.zeros(0), *got]).astype(np.float64)


def _calibrate(model: TextCnn, z: np.ndarray, y: np.ndarray, names: np.ndarray, n: np.ndarray) -> None:
    """Scale of the logits (Newton steps of a two-parameter logistic fit) and a threshold per language; ``n`` rows stand for each."""
    a, b = 1.0, 0.0
    pos, neg = (n * y).sum(), (n * (1 - y)).sum()
    if pos and neg:
        target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = n * (p * (1 - p) + 1e-9)
            grad = np.array([(n * (p - target) * z).sum() + 1e-3 * (a - 1), (n * (p - target)).sum() + 1e-3 * b])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, grad), -2, 2)
    model.scale = (float(max(a, 1e-3)), float(b))
    p = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + model.scale[1], -40, 40)))

    def best(mask: np.ndarray, default: float) -> float:
        m, t = n[mask], y[mask]
        if (m * t).sum() < 5 or (m * (1 - t)).sum() < 5:
            return default
        cuts = np.linspace(0.05, 0.95, 19)
        f1 = [2 * (m * t * (p[mask] >= c)).sum() / max(1, (m * t).sum() + (m * (p[mask] >= c)).sum()) for c in cuts]
        top = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
        return float(cuts[top[len(top) // 2]])  # the middle of the best range

    model.threshold = best(np.ones(len(z), bool), 0.3)
    model.thresholds = {str(x): best(names == x, model.threshold) for x in np.unique(names) if x}


def fit(docs: DataFrame, labels: DataFrame, shard: int = SHARD, seed: int = 7) -> TextCnn:
    """Learn from all rows of ``labels`` (doc_id, toxic) and their texts.

    Null labels and labels without a text are left out. An id that stands in several rows
    of ``docs`` gives one of them (the smallest by the text's hash, then lang). Words are hashed where the
    texts are, 4 bytes a word. Of several shards only counts, weights and their changes reach the driver (a row a word that
    occurs in ``MIN_DOCS`` documents, at most ``BUCKETS``), no document.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    bound_batches(docs.sparkSession)
    met = docs.select("doc_id", "text", "lang").join(small(known, LABELS), "doc_id")
    hashed = met.select("doc_id", "toxic", "lang", F.xxhash64("text").alias("of"), "text").mapInArrow(lean(_hashed), "doc_id long, toxic int, lang string, of long, words binary")
    one = hashed.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("lang", "words"), F.struct("of", "lang")).alias("x"))
    one = materialize(one.select("doc_id", "toxic", "x.lang", "x.words"), "labelled")
    size = one.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    shards = max(-(-size[0] // shard), -(-size[1] // (4 * SHARD_WORDS)), 1)
    if shards == 1:
        bucket, offsets, toxic, langs = _documents(one.toArrow(), seed)
        return train(bucket, offsets, toxic, langs, seed=seed)
    return _train_shards(one, shards, seed)


def _order(got: pa.Table, seed: int) -> np.ndarray:
    """An order that follows from the ids alone."""
    by_id = pc.sort_indices(got.select(["doc_id"]), [("doc_id", "ascending")]).to_numpy()
    return by_id[np.argsort(np.random.default_rng(seed).random(got.num_rows))]


def _documents(got: pa.Table, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(words' buckets, offsets, labels, langs) in an order that follows from the ids alone."""
    order = _order(got, seed)
    lengths = pc.binary_length(got.column("words")).to_numpy()[order] // 4
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    bucket, place = np.empty(offsets[-1], np.uint32), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for to, cell in zip(place.tolist(), (c for part in got.column("words").chunks for c in part), strict=True):  # the words are copied once
        bucket[offsets[to] : offsets[to + 1]] = np.frombuffer(cell.as_buffer(), np.uint32)
    rest = got.select(["toxic", "lang"]).take(pa.array(order))
    return bucket, offsets, rest.column("toxic").to_numpy().astype(np.float32), rest.column("lang").to_pylist()


def _piece(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words' buckets, offsets, labels, held) of some documents of a shard; the words stay where they are."""
    words = piece.column("words").cast(pa.binary())
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    bucket = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(np.uint32)
    return bucket, (offsets - offsets[0]) // 4, piece.column("toxic").to_numpy().astype(np.float32), piece.column("held").to_numpy(zero_copy_only=False)


def _training(model: TextCnn, pieces: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(embedding rows of the words, offsets, labels, documents to learn from) of a shard; held-back documents bring no words."""
    rows, done, lengths, labels, held = None, 0, [], [], []
    for piece in pieces:
        if rows is None:
            rows = np.empty(piece.column("total")[0].as_py(), np.int32)  # pages that no word reaches take no memory
        held.append(piece.column("held").to_numpy(zero_copy_only=False))
        labels.append(piece.column("toxic").to_numpy().astype(np.float32))
        bucket, offsets, _, _ = _piece(piece.filter(pc.invert(piece.column("held"))))
        _all_rows(model, bucket, rows[done : done + len(bucket)])
        done += len(bucket)
        lengths.append(np.zeros(piece.num_rows, np.int64))
        lengths[-1][~held[-1]] = np.diff(offsets)
    return rows[:done], np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), np.concatenate(labels), np.flatnonzero(~np.concatenate(held))


def _train_shards(one: DataFrame, shards: int, seed: int, epochs: int = 5, batch: int = 64, rate: float = 0.05) -> TextCnn:
    """``train`` over documents (doc_id, toxic, lang, words) that stay in the tasks, a shard a file."""
    sc = one.sparkSession.sparkContext
    width = 2 * DIM

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's documents in the order in which they are learnt from."""
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        order, n = _order(table, seed), table.num_rows
        size = pc.binary_length(table.column("words")).to_numpy()[order].astype(np.int64)
        shard, total = table.column("shard")[0].as_py(), int(size.sum()) // 4
        held = np.arange(n) % 5 == 4
        table = table.select(["toxic", "lang", "words"])
        for some in np.split(np.arange(n), np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1):
            part = table.take(pa.array(order[some])).combine_chunks()
            same = {"shard": shard, "docs": n, "total": total}
            columns = {k: pa.array(np.full(len(some), v, np.int64)) for k, v in same.items()} | {"held": pa.array(held[some])}
            yield from pa.table(columns | {c: part.column(c) for c in part.column_names}).to_batches()

    # dealt out once, a file a shard, and then only read: a row a document, so that no cell and no batch grows with the shard
    dealt = one.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards))).repartition(shards, "shard")
    schema = "docs long, total long, held boolean, toxic int, lang string, words binary"
    path = scratch_path(one.sparkSession, "shards")
    # one row group a file, which one task reads whole
    whole = {"maxRecordsPerFile": 0, "parquet.block.size": 1 << 30}
    dealt.groupBy("shard").applyInArrow(deal, f"shard long, {schema}").write.partitionBy("shard").options(**whole).parquet(path)
    packed = one.sparkSession.read.schema(f"{schema}, shard long").parquet(path)

    def each(work, schema: str) -> DataFrame:
        """``work(shard, pieces)`` of every shard: tables of ``schema``. Pieces are runs of its documents, some MB each."""

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
            for part in slices(batches, "words"):
                number = part.column("shard").to_numpy()
                ends = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
                for a, b in pairwise(ends):
                    yield int(number[a]), part.slice(a, b - a)

        def complete(pieces: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
            seen = docs = 0
            for number, piece in pieces:
                seen, docs = seen + piece.num_rows, piece.column("docs")[0].as_py()
                yield piece
            if seen != docs:
                raise RuntimeError(f"shard {number} came in parts: {seen} of {docs} documents")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, pieces in groupby(cut(batches), key=itemgetter(0)):
                for table in work(number, complete(pieces)):
                    yield from pa.table(table).to_batches()

        return packed.mapInArrow(lean(run), schema)

    def count(_, pieces) -> Iterator[dict]:
        for piece in pieces:
            bucket, offsets, labels, held = _piece(piece)
            keys, pos, all_ = _word_counts(bucket, offsets, labels, held)
            mine = labels[~held]
            yield {"bucket": np.append(keys.astype(np.int64), -1), "pos": np.append(pos, mine.sum()).astype(np.int64), "n": np.append(all_, len(mine)).astype(np.int64)}

    counts = each(count, "bucket long, pos long, n long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    got = counts.where((F.col("n") >= MIN_DOCS) | (F.col("bucket") < 0)).toArrow().sort_by("bucket")
    keys, pos, all_ = (got.column(c).to_numpy() for c in ("bucket", "pos", "n"))
    if not 0 < pos[0] < all_[0]:
        return _constant(float(pos[0] / all_[0]) if all_[0] else 0.0)
    model = _start(keys[1:].astype(np.uint32), pos[1:], all_[1:], float(pos[0]), float(all_[0] - pos[0]), np.random.default_rng(seed))
    steps = [np.full_like(p, 1e-3) for p in [model.emb, *model.conv, model.bias, model.out]], 1e-3

    def dense(net: TextCnn, memory: list[np.ndarray], bias_memory: float) -> np.ndarray:
        flat = np.concatenate([*(p.ravel() for p in (*net.conv, net.bias, net.out)), [net.out_bias], *(m.ravel() for m in memory[1:]), [bias_memory]])
        return np.concatenate([flat, np.zeros(-len(flat) % width)]).astype(np.float32).reshape(-1, width)

    for epoch in range(epochs):
        shared = sc.broadcast((model, *steps))

        def learn(number, pieces, epoch=epoch, shared=shared) -> Iterator[dict]:
            start, memory, bias_memory = shared.value
            rows, offsets, labels, order = _training(start, pieces)
            used, rows = _own_rows(rows, len(start.emb))  # only the shard's own words are copied and change
            net = TextCnn(start.keys, start.emb[used], [c.copy() for c in start.conv], start.bias.copy(), start.out.copy(), start.out_bias)
            memory = [memory[0][used], *(m.copy() for m in memory[1:])]
            before = memory[0].copy()
            np.random.default_rng([seed, epoch, number]).shuffle(order)
            bias_memory = _epoch(net, memory, bias_memory, rows, offsets, labels, order, batch, rate, len(start.emb))
            moved = np.flatnonzero((memory[0] != before).any(axis=1))
            rest = dense(net, memory, bias_memory)
            values = np.concatenate([np.concatenate([net.emb[moved], memory[0][moved]], axis=1), rest]).astype(np.float32)
            cells = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), width).cast(pa.list_(pa.float32()))
            yield {"at": np.concatenate([used[moved], -1 - np.arange(len(rest))]).astype(np.int64), "v": cells}

        mixed = each(learn, "at long, v array<float>").groupBy("at").agg(F.array(*(F.avg(F.get("v", F.lit(j))).cast("float") for j in range(width))).alias("v"))
        got = mixed.toArrow().sort_by("at")
        at, values = got.column("at").to_numpy(), got.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)
        words_at, memory = at >= 0, steps[0]
        model.emb[at[words_at]], memory[0][at[words_at]] = values[words_at][:, :DIM], values[words_at][:, DIM:]
        flat, done = values[~words_at][::-1].ravel(), 0
        for p in (*model.conv, model.bias, model.out):
            p[...] = flat[done : done + p.size].reshape(p.shape)
            done += p.size
        model.out_bias, done = float(flat[done]), done + 1
        for m in memory[1:]:
            m[...] = flat[done : done + m.size].reshape(m.shape)
            done += m.size
        steps = memory, float(flat[done])
        shared.unpersist()

    shared = sc.broadcast(model)

    def held_back(_, pieces) -> Iterator[dict]:
        net = shared.value
        for piece in pieces:
            piece = piece.filter(piece.column("held"))
            if piece.num_rows:
                bucket, offsets, labels, _ = _piece(piece)
                z = _held_logits(net, _all_rows(net, bucket), offsets, np.arange(len(labels)))
                yield {"lang": pc.fill_null(piece.column("lang"), ""), "y": labels.astype(np.int32), "cell": np.round(np.clip(z, -60, 60) * CELL).astype(np.int64)}

    cells = each(held_back, "lang string, y int, cell long").groupBy("lang", "y", "cell").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("lang", "ascending"), ("y", "ascending"), ("cell", "ascending")])
    lang, y, cell, n = (cells.column(c).to_numpy() for c in ("lang", "y", "cell", "n"))
    _calibrate(model, cell / CELL, y.astype(np.float64), lang, n.astype(np.float64))
    return model


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, limit=SLICE):
        offsets, codes, vocabulary = words(part.column("text"))
        bucket = buckets(vocabulary)[codes]
        cells = [bucket[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "toxic", "lang", "of")), pa.array(cells, pa.binary())], ["doc_id", "toxic", "lang", "of", "words"])


def score(docs: DataFrame, model: TextCnn, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (text, lang and the columns ``keep``; all by default) with score, threshold and toxic.

    Null and empty texts are scored as a text without words. ``toxic`` holds where the score
    reaches the threshold of the row's language (the overall one for null or new languages).
    Columns of ``docs`` named score, threshold or toxic are replaced.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "threshold", "toxic")]
    base = docs.select(*keep, F.coalesce(F.col("lang"), F.lit("")).alias("__lang"), F.col("text").alias("__text"))
    out = docs.select(*keep).schema.add("score", "double").add("threshold", "double").add("toxic", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in slices(batches, "__text", SLICE):
            got = net.score_texts(batch.column("__text"))
            cut = np.array([net.thresholds.get(x, net.threshold) for x in batch.column("__lang").to_pylist()], np.float64)
            columns = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(got), "threshold": pa.array(cut), "toxic": pa.array(got >= cut)})

    return base.mapInArrow(lean(run), out)
