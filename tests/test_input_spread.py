"""How the line pairs are laid out for the per-row text work, and what the classifiers read again."""

from pyspark.sql import functions as F

from mtlens.operators import corpus, learn
from mtlens.plans import queries as Q
from mtlens.sources import fixtures
from mtlens.streaming import resumable

DOCS = [(i, f"line a{i}\nline b, {i}\nline c{i}", "en", "web") for i in range(200)]


def tables(spark, path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 200, 2)] + [(4, 1)], "doc_id long, quality int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_one_row_group_fills_every_task(spark, tmp_path):
    path = tables(spark, tmp_path)
    before = spark.conf.get("spark.mtlens.spread")
    spark.conf.set("spark.mtlens.spread", "0")  # nothing asked for, as on a cluster
    try:
        pairs = fixtures.pairs(spark, path)
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.mtlens.spread", before)
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 2
    assert sum(sizes) == 402  # two pairs a document; document 4 has two labels
    got = {(r.src, r.label) for r in pairs.where("src in ('doc3', 'doc4')").select("src", "label").collect()}
    assert got == {("doc3", None), ("doc4", "NP"), ("doc4", " P "), ("doc4", "P")}


def test_texts_do_not_move_to_their_fold(spark, tmp_path):
    flat = Q.pair_features(spark, tables(spark, tmp_path))
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("ArrowEvalPython")]
    assert "Join" in joined and "ref#" not in joined.split("Join", 1)[0]


def test_the_classifier_pins_its_rows(spark):
    seen = spark.sparkContext.accumulator(0)

    def costly(x):
        seen.add(1)
        return x

    rows = [(i, i % 3 + 1, i % 2, float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "row_id long, fold int, y int, f double").withColumn("f", F.udf(costly, "double")("f"))
    out = learn.train_pair_classifier(df, ["f"], out="p")
    assert out.where("p is not null").count() == 90
    assert seen.value <= 180  # a checkpoint may read its rows twice, not once a fold and step


def test_encoding_moves_each_word_once_a_block(spark):
    """Not a row a token; repeated and null keys are merged by position, null tokens and lists are kept apart from words."""
    rows = [(i, ["the", "the", f"w{i % 3}", None] * 20, None) for i in range(50)] + [(7, ["b", "a"], ["a"]), (None, ["a"], [])]
    df = spark.createDataFrame(rows, "row_id long, a array<string>, b array<string>")
    vocab = spark.createDataFrame([("the", 2), ("a", 3), ("w1", 4)], "word string, idx long")
    for limit in (0, 100):
        enc = corpus.encode_tokens(df, vocab, "row_id", {"a": F.col("a"), "b": F.col("b")}, 5, limit)
        got = {(r.row_id, r.seq): r.ids for r in enc.collect()}
        assert len(got) == 2 * 51 and got[1, "a"] == [2, 2, 4, 1, 2] and got[1, "b"] == [0] * 5
        assert got[7, "a"] == [1, 2, 2, 3, 4, 1, 2] and got[7, "b"] == [3, 0, 0, 0, 0] and got[None, "a"] == [3, 0, 0, 0, 0]
    assert "posexplode(words" in enc._jdf.queryExecution().analyzed().toString() and "posexplode_outer" not in enc._jdf.queryExecution().analyzed().toString()


def test_a_mapped_batch_is_bounded_in_bytes(spark, tmp_path):
    """A worker never sees 10,000 long rows at once."""
    text = "x" * 100_000
    rows = spark.createDataFrame([(i,) for i in range(300)], "id long").coalesce(1).withColumn("s", F.lit(text))
    rows.write.json(str(tmp_path / "in"))

    def small_only(s):
        if s.str.len().sum() > 8 << 20:
            raise ValueError("too much text in a batch")
        return s.str.upper()

    resumable.resumable_map(spark, str(tmp_path / "in"), rows.schema, ["s"], small_only, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = resumable.read_batches(spark, str(tmp_path / "out"), rows.schema)
    assert got.where(F.col("s") == text.upper()).count() == 300
