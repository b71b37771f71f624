"""Benchmark decontamination by SimHash over item-sized windows, verified exactly.

A document leaks an item if one of its windows of as many words as the item has
(the whole text, if shorter) is similar to it: weighted Jaccard of word shingles,
each shingle weighing its number of occurrences, of ``percent`` or more. Words are
lower-cased and split at white space.

Everything is DataFrame expressions:

1. positions of the documents whose shingle occurs in the benchmark at all (one pass,
   a join with the distinct shingles of the benchmark, which are small enough to count and broadcast or else shuffled);
2. for the (document, item) pairs that meet on a shingle of the item's prefix (its
   rarest shingles, more than 1 - t of its weight: every leak meets there), the
   windows that hold enough positions of that item; any other window stays below
   the threshold whatever the rest of it is;
3. 64-bit SimHash of these windows and of the items; fingerprints are cut into
   ``radius + 1`` blocks, so that all pairs within the radius agree on a block
   whole (pigeonhole): an equality join on (words, block number, block) finds them;
4. pairs within the radius are verified by the exact similarity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

RADIUS = 20  # of 64 bits; unrelated fingerprints differ in 32 +- 4, a similarity of 0.75 gives 11 +- 3
BITS = 64
SPACE = r"[\x20\x09-\x0D]+"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def shingles(words: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words, in order; none if there are fewer words."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<bigint>"))


def counted(hashes: Column) -> Column:
    """Shingles with their occurrence number hashed in, so that plain set operations respect multiplicity."""
    again = F.transform(hashes, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(hashes, 1, i), lambda y: y == x))))
    once = F.transform(hashes, lambda x: F.xxhash64(x, F.lit(0)))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), once).otherwise(again)


def simhash(df: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """(keys..., simhash): per row the bits that more than half of its shingles have set."""
    exploded = df.select(*keys, F.explode(hashes).alias("h"))
    # two counters of 32 bits in each sum: bits k and k + 32
    sums = [F.expr(f"sum(shiftrightunsigned(h, {k}) & 4294967297L)").alias(f"s{k}") for k in range(32)]
    counts = exploded.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *sums)
    bits = []
    for k in range(32):
        bits.append(f"if(2 * (s{k} & 4294967295L) > m, shiftleft(1L, {k}), 0L)")
        bits.append(f"if(2 * shiftrightunsigned(s{k}, 32) > m, shiftleft(1L, {k + 32}), 0L)")
    # the m counted shingles fit 32 bits, so the lower counter never carries into the upper
    return counts.select(*keys, F.expr(" | ".join(bits)).alias("simhash"))


def blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 runs of bits that cover the fingerprint: at most ``radius`` differing bits leave one run equal."""
    n = min(radius + 1, BITS)
    edges = [BITS * i // n for i in range(n + 1)]
    parts = [
        F.struct(F.lit(i).alias("at"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))
    ]
    return F.array(*parts)


def items_of(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, words, w, bag): one row per distinct item and text that has words; w: its shingle width."""
    split = benchmark.select(F.col("item_id").cast("long").alias("item_id"), split_words(F.col("text")).alias("ws"))
    split = split.where(F.size("ws") > 0).distinct().withColumn("w", F.least(F.size("ws"), F.lit(width)))
    # the width differs by row only for items shorter than it: their whole sequence is their shingle
    bag = F.when(F.col("w") == width, shingles(F.col("ws"), width)).otherwise(F.array(F.xxhash64("ws")))
    return split.select("item_id", F.size("ws").alias("words"), "w", bag.alias("bag"))


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 75, width: int = 5, radius: int = RADIUS) -> DataFrame:
    """(row_key, doc_id, item_id, start, words, similarity, distance): the best window of every leaked item in every document.

    Null, empty and white-space texts leak nothing, such items are never leaked. An item of fewer than ``width``
    words has its whole sequence as its only shingle. Repeated document rows give one row, repeated item rows one
    each. ``row_key`` hashes id and text and tells rows that share an id apart; a null id stays null. Items that share
    an id, or have none, are told apart by their texts: each leaked text gives its own row with that id. Texts
    may be of any length; of equally similar windows the first counts. Other columns, whatever their names, are ignored. ``start`` counts words from 0, ``distance`` is the Hamming distance.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    benchmark = benchmark.select("item_id", "text").withColumn("key", F.xxhash64(F.col("item_id"), F.col("text").cast("string")))
    names = benchmark.select("key", "item_id").distinct()
    items = materialize(items_of(benchmark.select(F.col("key").alias("item_id"), "text").dropDuplicates(["item_id"]), width), "items")
    widths = sorted(r.w for r in items.select("w").distinct().collect())  # at most ``width`` values
    found = [_leaks(docs, items.where(F.col("w") == w), percent, w, radius) for w in widths]
    if not found:
        empty = "row_key long, doc_id long, item_id long, start int, words int, similarity double, distance int"
        return docs.sparkSession.createDataFrame([], empty)
    found = reduce(DataFrame.unionAll, found).withColumnRenamed("item_id", "key")
    return found.join(small(names), "key").select("row_key", "doc_id", "item_id", "start", "words", "similarity", "distance")


def _leaks(docs: DataFrame, items: DataFrame, percent: int, width: int, radius: int) -> DataFrame:
    # the items' shingles with multiplicity; the prefix: rarest first, until more than 1 - t of the weight
    bags = items.select("item_id", "words", F.explode("bag").alias("h")).groupBy("item_id", "words", "h").agg(F.count(F.lit(1)).alias("c"))
    bags = materialize(bags, "bags")
    spread = bags.groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    ranked = bags.join(spread, "h").groupBy("item_id", "words").agg(F.sort_array(F.collect_list(F.struct("items", "h", "c"))).alias("list"), F.sum("c").alias("m"))
    need = F.ceil(F.col("m") * percent / F.lit(100))
    upto = F.aggregate("list", F.struct(F.lit(0).cast("long").alias("got"), F.array().cast("array<bigint>").alias("hs")), lambda acc, x: F.when(
        acc["got"] >= F.col("m") - need + 1, acc).otherwise(F.struct((acc["got"] + x["c"]).alias("got"), F.concat(acc["hs"], F.array(x["h"])).alias("hs"))))
    prefix = materialize(ranked.select("item_id", F.explode(upto["hs"]).alias("h")), "prefix")

    # 1. positions that occur in the benchmark
    hashed = docs.select("row_key", "doc_id", split_words(F.col("text")).alias("ws"))
    hashed = hashed.select("row_key", "doc_id", F.size("ws").alias("n"), shingles(F.col("ws"), width).alias("hs"))
    # outer: else the optimizer infers a filter on the array's size, below the projection that splits the text,
    # where each shingle would split it again; rows without shingles have no hash and meet nothing
    spots = hashed.select("row_key", "doc_id", "n", F.posexplode_outer("hs").alias("pos", "h"))
    hits = materialize(spots.join(small(spread.select("h")), "h", "left_semi").distinct(), "hits")

    # 2. windows of an item's words with enough of its positions
    pairs = hits.join(small(prefix), "h").select("row_key", "item_id").distinct()
    near = hits.join(pairs, "row_key").join(small(bags.select("item_id", "h", "words")), ["item_id", "h"])
    spans = near.groupBy("row_key", "doc_id", "n", "item_id", "words").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    length = F.least("words", "n")  # of the window, in words
    m, k = F.col("words") - width + 1, length - width + 1  # shingles of the item and of the window
    least = F.ceil((m + k) * percent / F.lit(100 + percent)).cast("int")
    spans = spans.select("row_key", "doc_id", "n", "item_id", "words", "at", length.alias("length"), least.alias("least"), k.alias("k")).where(F.size("at") >= F.col("least"))
    reach = F.transform(
        F.sequence(F.lit(1), F.size("at") - F.col("least") + 1),
        lambda i: F.struct(
            F.greatest(F.element_at("at", (i + F.col("least") - 1).cast("int")) - F.col("k") + 1, F.lit(0)).alias("lo"),
            F.least(F.element_at("at", i.cast("int")), F.col("n") - F.col("length")).alias("hi"),
        ),
    )
    starts = F.array_distinct(F.flatten(F.transform(F.filter(reach, lambda r: r["lo"] <= r["hi"]), lambda r: F.sequence(r["lo"], r["hi"]))))
    windows = spans.select("row_key", "doc_id", "words", "length", F.explode(starts).alias("start")).distinct()
    windows = materialize(windows, "windows")

    # 3. their fingerprints
    texts = hashed.join(small(windows.select("row_key").distinct()), "row_key", "left_semi").select("row_key", "hs").dropDuplicates(["row_key"])
    windows = windows.join(texts, "row_key").select("row_key", "doc_id", "start", "length", "words", F.slice("hs", F.col("start") + 1, F.col("length") - width + 1).alias("bag"))
    windows = materialize(windows, "bags_of_windows")
    marks = simhash(windows, ["row_key", "start", "length", "words"], "bag")
    cut = marks.withColumn("block", F.explode(blocks(F.col("simhash"), radius)))
    item_marks = simhash(items, ["item_id", "words"], "bag").withColumnRenamed("simhash", "item_simhash")
    item_cut = item_marks.withColumn("block", F.explode(blocks(F.col("item_simhash"), radius)))
    distance = F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_simhash")))
    met = cut.join(item_cut, ["words", "block"]).where(distance <= radius)
    met = met.select("row_key", "start", "length", "words", "item_id", distance.alias("distance")).distinct()

    # 4. exactly
    item_bags = items.select("item_id", "words", counted(F.col("bag")).alias("item_bag"))
    window_bags = windows.select("row_key", "doc_id", "start", "length", "words", counted(F.col("bag")).alias("bag"))
    both = F.size(F.array_intersect("bag", "item_bag"))
    checked = met.join(window_bags, ["row_key", "start", "length", "words"]).join(item_bags, ["item_id", "words"])
    checked = checked.select("row_key", "doc_id", "item_id", "start", "length", "distance", both.alias("both"), (F.size("bag") + F.size("item_bag") - both).alias("either"))
    checked = checked.where(100 * F.col("both") >= percent * F.col("either"))
    best = F.max_by(F.struct("start", "length", "both", "either", "distance"), F.struct(F.col("both") / F.col("either"), -F.col("start")))
    return checked.groupBy("row_key", "doc_id", "item_id").agg(best.alias("b")).select(
        "row_key", "doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.length").alias("words"),
        (F.col("b.both") / F.col("b.either")).alias("similarity"), F.col("b.distance").cast("int").alias("distance"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that leak an item; its columns stay."""
    bad = small(materialize(leaks(docs, benchmark, **options).select(F.col("row_key").alias("__leak")).distinct(), "leaks"))
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.join(bad, key == F.col("__leak"), "left_anti")
