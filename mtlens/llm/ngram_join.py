"""N-gram Jaccard join by multiple global orders.

Two documents link when their sets of distinct word shingles have a Jaccard
similarity of ``percent`` or more (100 * intersection >= percent * union, in whole numbers).

A pair that links must share a token in its prefixes under *every* total order
of the tokens, so a candidate must be one under each of three orders before its sets are read:

1. One pass gives each document its set size and a 64-bit key of its set;
   equal sets share a key and are one node from here on. The same pass counts
   shingles per task and keeps those frequent within a task.
2. First order: shingles not known to be frequent by hash, then the frequent
   ones by count. A second pass emits each set's prefix under it; one shuffle
   by token brings the posting lists together. Lists of one node end there.
3. Every node of a list is paired with the list's hub, if the size and position
   filters pass: rows linear in the lists, not quadratic. The first hub is the node
   with the fewest tokens of its own, in a second round a random one a list.
4. Of the pairs that the lists give, those stay whose whole prefixes under the
   first order can belong to a link (number and last position of shared tokens), and
   of these those whose prefixes meet under the second and the third order too (seeded
   permutations; the number of shared tokens is bounded likewise). Only then whole sets are
   compared: on 16 bits a token, then in full.
5. Components of the links (min-label propagation). Then the lists are read
   again: pairs of nodes that are still in *different* components and were not
   tried are candidates too (filters as before), are verified and added.
   Pairs within one component need no check, so groups of copies are never
   expanded into all pairs, and no link between components is lost.

Any consistent order is correct, so the bounded table of frequent shingles only
steers the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_long, bound_batches, lean, materialize, mix, shingle_sets, slices, small

FREQUENT_IN_CHUNK = 2  # a shingle in so many different sets of a chunk is reported
FREQUENT_IN_ALL = 4  # and known to the first order if the reports come to so many
FREQUENT_KEPT = 500_000  # at most; the most frequent ones
CHUNK = 2_000_000  # shingles that a task counts at once
STEP_BYTES = 1 << 20  # of text that a task takes apart at once; its words and hashes take some ten times that
FILTER_BITS = 1 << 27  # bound of the bitmap that spares the set pass most documents
ORDERS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))  # seeds of the second and the third order


def prefix_length(n: int, percent: int) -> int:
    """Tokens in the prefix of a set of ``n``: n - ceil(t n) + 1."""
    return n - -(-n * percent // 100) + 1


def set_key(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def _survey(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("token", pa.int64()), ("count", pa.int64())])

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        tokens, counts = tokens[counts >= FREQUENT_IN_CHUNK], counts[counts >= FREQUENT_IN_CHUNK]
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, as_long(tokens), pa.array(counts, pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in slices(batches, limit=STEP_BYTES):
            ns, nodes = [], []
            for tokens in shingle_sets(batch.column("text"), width):
                ns.append(len(tokens))
                nodes.append(set_key(tokens) if len(tokens) else None)
                if len(tokens) and nodes[-1] not in seen:
                    seen.add(nodes[-1])
                    held.append(tokens)
                    size += len(tokens)
            none = pa.nulls(len(ns), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), none, none], schema=schema)
            if size >= CHUNK:
                yield frequent(held)
                held, size, seen = [], 0, set()
        if held:
            yield frequent(held)

    return run


def _first_order(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of ``tokens`` (sorted) in the first order: others by hash, then the frequent ones by rank."""
    if not len(frequent):
        return np.arange(len(tokens))
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    known = frequent[at] == tokens
    if not known.any():
        return np.arange(len(tokens))
    rare = np.flatnonzero(~known)
    hot = np.flatnonzero(known)
    return np.concatenate([rare, hot[np.argsort(rank[at[hot]], kind="stable")]])


def _postings(width: int, percent: int, frequent: np.ndarray, rank: np.ndarray):
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # nodes that this task has posted: copies in its part of the input post once
        for batch in slices(batches, limit=STEP_BYTES):
            parts, nodes, ns, lengths = [], [], [], []
            for tokens in shingle_sets(batch.column("text"), width):
                if len(tokens) and (node := set_key(tokens)) not in seen:
                    seen.add(node)
                    p = prefix_length(len(tokens), percent)
                    parts.append(tokens[_first_order(tokens, frequent, rank)[:p]])
                    nodes.append(node)
                    ns.append(len(tokens))
                    lengths.append(p)
            if parts:
                lengths = np.array(lengths)
                pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        as_long(np.concatenate(parts)),
                        pa.array(np.repeat(np.array(nodes, np.int64), lengths)),
                        pa.array(np.repeat(np.array(ns, np.int32), lengths)),
                        pa.array(pos.astype(np.int32)),
                    ],
                    schema=schema,
                )

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by (token, n, node): those of lists with two nodes or more, once per node.

    Streams: a list may run over any number of batches, only its last row is held back.
    """
    last, given = None, False  # the last distinct row so far; whether it was given out
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if last is not None:
            table = pa.concat_tables([last, table])
        token = table.column("token").to_numpy()
        node = table.column("node").to_numpy()
        new_token = np.concatenate([[True], token[1:] != token[:-1]])
        rows = np.flatnonzero(new_token | np.concatenate([[True], node[1:] != node[:-1]]))
        shared = ~new_token[rows]
        shared[:-1] |= ~new_token[rows[1:]]
        out = shared.copy()
        out[0] &= not given
        yield from table.take(pa.array(rows[out])).to_batches()
        given = bool(shared[-1]) or (len(rows) == 1 and given)
        last = table.slice(int(rows[-1]), 1).combine_chunks()


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Bits (hash of id mod ``bits``) that are set, as bytes; its size is bounded, not the number of ids."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    rows = ids.select(slot.alias("s")).selectExpr("s div 32 as w", "shiftleft(1L, cast(s % 32 as int)) as b")
    got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy().astype(np.uint32)
    return out


def _sets(width: int, percent: int, bitmap: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("orders", pa.binary()), ("short", pa.binary()), ("tokens", pa.binary())])
    bits = np.uint64(len(bitmap) * 32)

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy().astype(np.uint64) % bits
            hit = (bitmap[(slot >> np.uint64(5)).astype(np.int64)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(wanted(batches), limit=STEP_BYTES):
            ids, nodes, orders, shorts, sets = [], [], [], [], []
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), width), strict=True):
                if len(tokens) and (doc_id, node := set_key(tokens)) not in seen:
                    seen.add((doc_id, node))
                    ids.append(doc_id)
                    nodes.append(node)
                    orders.append(order_prefixes(tokens, percent).tobytes())
                    shorts.append(tokens.astype(np.uint16).tobytes())
                    sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, nodes, orders, shorts, sets), schema, strict=True)], schema=schema)

    return run


def order_prefixes(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The set's size, then its prefix under each further order: the upper halves of the order keys, ascending."""
    p = prefix_length(len(tokens), percent)
    parts = [np.sort(np.partition(mix(tokens ^ seed), p - 1)[:p]) >> np.uint64(32) for seed in ORDERS]
    return np.concatenate([[len(tokens)], *parts]).astype(np.uint32)


def _enough(both: int, n1: int, n2: int, percent: int) -> bool:
    return 100 * both >= percent * (n1 + n2 - both)


def _meet_in_orders(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two rows of ``order_prefixes`` can belong to a link under each of the further orders.

    Up to the end of the prefix that ends first both sets lie open: what they share there, and at most the smaller rest behind it,
    is all they can share. Halves of keys that agree by chance only raise the bound, so no link is lost.
    """
    x, y = x.view(np.uint32), y.view(np.uint32)
    n1, n2 = int(x[0]), int(y[0])
    for a, b in zip(np.split(x[1:], len(ORDERS)), np.split(y[1:], len(ORDERS)), strict=True):
        there = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
        if not there.any():
            return False
        end = min(a[-1], b[-1])
        upto1, upto2 = int(np.searchsorted(a, end)), int(np.searchsorted(b, end))
        if not _enough(min(int(there[:upto1].sum()) + min(n1 - upto1, n2 - upto2), n1, n2), n1, n2, percent):
            return False
    return True


def _may_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """On the tokens' low 16 bits: tokens that meet in full meet here too, so no link is lost."""
    x, y = x.view(np.uint16), y.view(np.uint16)
    there = np.zeros(1 << 16, bool)
    there[y] = True
    return _enough(min(int(there[x].sum()), len(y)), len(x), len(y), percent)


def _links_exactly(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = x.view(np.uint64), y.view(np.uint64)
    return _enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)


def _kept(test, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
            keep = [test(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8), percent) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Each round every component so far takes the smallest label next to any of its nodes, so
    whole components merge at once and a chain needs about a logarithm of its length.
    """
    edges = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"))
    while True:
        now = materialize(now, "labels")
        near = edges.join(now, edges.b == now.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = materialize(now.join(near, "node").select("node", "label", F.least("label", "near").alias("new")), "step")
        if step.where("label != new").isEmpty():
            return now
        became = step.groupBy("label").agg(F.min("new").alias("to"))
        now = step.join(became, "label").select("node", F.col("to").alias("label"))


KEPT = ("node", "n", "rank", "pos", "alone")


def _ranked(lists: DataFrame, percent: int) -> DataFrame:
    """``lists`` with rank, the number of a node's tokens up to this one that are in lists, and alone, that of its prefix tokens in none.

    A token in no list may still be shared: the other node can hold it behind its prefix. Only those before a token that two
    nodes meet on are not, as the other one would have them before it too. So ``alone`` steers and bounds nothing.
    """
    own = Window.partitionBy("node")
    lists = lists.withColumn("rank", F.row_number().over(own.orderBy("pos")))
    return lists.withColumn("alone", _prefix(F.col("n"), percent) - F.count(F.lit(1)).over(own))


def _prefix(n: Column, percent: int) -> Column:
    n = n.cast("long")
    return n - F.ceil(n * percent / F.lit(100)) + 1


def _passes(percent: int, shared: Column, left: Column):
    """Size filter, and whether ``shared`` tokens and ``left`` more can be enough."""
    n1, n2 = F.col("n1").cast("long"), F.col("n2").cast("long")
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * (shared + left) >= percent * (n1 + n2))


def _behind() -> Column:
    """The tokens two nodes can share behind those of pos1 and pos2."""
    return F.least(F.col("n1") - F.col("pos1") - 1, F.col("n2") - F.col("pos2") - 1).cast("long")


def _hub_pairs(marked: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node of a list with the list's hub, if they are in different components.

    The hub is the node with the smallest share of tokens of its own: of a group of edited copies, the least edited. There is
    one per size class; a node stands in two classes, so that any two sizes within the threshold share one.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)))
    classes = marked.withColumn("class", F.explode(F.array(size, size + 1)))
    columns = (*KEPT, "label")
    first = F.struct((F.col("alone") / F.col("n")).alias("order"), *columns)
    hub = classes.groupBy("token", "class").agg(F.min(first).alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1")
    met = classes.join(hub, ["token", "class"]).select(*[F.col(c).alias(f"{c}1") for c in columns], *[F.col(f"hub.{c}").alias(f"{c}2") for c in columns])
    met = met.where((F.col("label1") != F.col("label2")) & _passes(percent, F.least("rank1", "rank2"), _behind()))
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def _apart(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that hold nodes of different components, with the nodes' components."""
    marked = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = marked.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    return materialize(marked.join(apart, "token", "left_semi"), "apart")


def _met_first(marked: DataFrame, percent: int) -> DataFrame:
    """(a, b): all nodes of one list in different components that can link if it is the list of the first token they share.

    Two nodes that link both stand in that list, and nothing is shared before it; in the others the pair is not repeated.
    """
    x = marked.select("token", *[F.col(c).alias(f"{c}1") for c in ("node", "n", "pos", "label")])
    y = marked.select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "label")])
    met = x.join(y, "token").where((F.col("node1") < F.col("node2")) & (F.col("label1") != F.col("label2")) & _passes(percent, F.lit(1), _behind()))
    return met.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()


def _may_link_by_prefix(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` that can link by their whole prefixes under the first order: k shared tokens, the last at pos1, pos2.

    Of all other shared tokens none is in both prefixes, so all lie behind the prefix that ends first in the order. Which one
    that is is not known here: the larger of both bounds holds.
    """
    x = lists.select("token", F.col("node").alias("a"), F.col("n").alias("n1"), F.col("pos").alias("pos1"))
    y = lists.select("token", F.col("node").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("pos2"))
    last = [F.max(c).alias(c) for c in ("n1", "n2", "pos1", "pos2")]
    met = pairs.join(x, "a").join(y, ["b", "token"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), *last)
    behind = [F.col(f"n{i}") - F.col(f"pos{i}") - 1 for i in (1, 2)]
    beyond = [F.col(f"n{i}") - _prefix(F.col(f"n{i}"), percent) for i in (1, 2)]
    left = F.greatest(F.least(beyond[0], behind[1]), F.least(behind[0], beyond[1]))
    return met.where(_passes(percent, F.col("k"), left)).select("a", "b")


def _links(docs: DataFrame, nodes: DataFrame, lists: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link.

    First by the whole prefixes under the first order, then by those under each further order. One pass over the texts,
    spared most of them by a bitmap of ids, writes further prefixes and sets; no text moves. The sets are read for pairs only that all orders left.
    """
    pairs = materialize(_may_link_by_prefix(pairs, lists, percent), "pairs")

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    involved = materialize(nodes.join(ends, "node", "left_semi"), "involved")
    bits = min(FILTER_BITS, max(1 << 20, 1 << int(16 * involved.count()).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    sets = docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(lean(_sets(width, percent, _bitmap(involved, bits))), "doc_id long, node long, orders binary, short binary, tokens binary")
    chosen = small(involved.select(F.col("doc_id").alias("id"), F.col("node").alias("of")))
    sets = materialize(sets.join(chosen, (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "orders", "short", "tokens"), "sets")

    for column, test in (("orders", _meet_in_orders), ("short", _may_link), ("tokens", _links_exactly)):
        ends = small(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        left = sets.select("node", column).join(ends, "node", "left_semi")
        a = left.select(F.col("node").alias("a"), F.col(column).alias("set_a"))
        b = left.select(F.col("node").alias("b"), F.col(column).alias("set_b"))
        kept = pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(lean(_kept(test, percent)), "a long, b long")
        pairs = materialize(kept.distinct(), column)
    return pairs


def link_documents(docs: DataFrame, percent: int = 75, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null, empty and white-space texts have no shingles, link with nothing and are their own component.
    Rows with equal sets link whatever their ids; a repeated doc_id gives a row each time. A row
    without id takes part in no link of different texts and gets the smallest id of its equal texts, or null.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = materialize(docs.mapInArrow(lean(_survey(width)), "doc_id long, n long, node long, token long, count long"), "survey")
    rows = survey.where(F.col("n").isNotNull()).select("doc_id", "n", "node")
    top = (
        survey.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("count"))
        .where(F.col("count") >= FREQUENT_IN_ALL).orderBy(F.desc("count"), "token").limit(FREQUENT_KEPT).toArrow()
    )
    frequent = top.column("token").to_numpy().view(np.uint64)
    rank = np.argsort(np.argsort(top.column("count").to_numpy(), kind="stable"), kind="stable")
    by_hash = np.argsort(frequent)
    frequent, rank = frequent[by_hash], rank[by_hash]

    postings = docs.mapInArrow(lean(_postings(width, percent, frequent, rank)), "token long, node long, n int, pos int")
    lists = materialize(
        postings.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(lean(_lists), "token long, node long, n int, pos int"), "lists"
    )
    lists = materialize(_ranked(lists, percent), "ranked")
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    tried = materialize(_hub_pairs(lists.withColumn("label", F.col("node")), percent), "tried")
    links = _links(docs, nodes, lists, tried, width, percent)
    labels = components(links)

    # what hubs left
    rest = _met_first(_apart(lists, labels), percent).join(tried, ["a", "b"], "left_anti")
    more = _links(docs, nodes, lists, rest, width, percent)
    if not more.isEmpty():
        labels = components(links.unionAll(more))

    named = nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "doc_id")
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id")
    return rows.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
