import gc
import weakref

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mtlens.operators import rank, report, sets
from mtlens.session import ensure_checkpoint_dir
from mtlens.sources import io as IO
from mtlens.streaming import resumable


def test_require_columns(spark):
    df = spark.createDataFrame([(1, "a")], "ref long, mt string")
    IO.require_columns(df, ["ref", "mt"])
    with pytest.raises(ValueError, match="label"):
        IO.require_columns(df, ["ref", "label"])


def test_labelled_tsv_rejects(spark, tmp_path):
    p = tmp_path / "l.tsv"
    p.write_text("a\tb\t1\n\nonly\none\ttwo\na\tb\tc\td\n x \t y \t0 \n", encoding="utf-8")
    good, bad = IO.scan_labelled_tsv(spark, str(p))
    assert sorted(tuple(r) for r in good.collect()) == [("a", "b", "1"), ("x ", " y ", "0")]
    assert bad.count() == 4


def test_pair_tsv(spark, tmp_path):
    p = tmp_path / "p.tsv"
    p.write_text("a\tb\textra\n\n  \nsolo\n c \t d \n", encoding="utf-8")
    got = sorted((r.s1, r.s2) for r in IO.scan_pair_tsv(spark, str(p)).collect())
    assert got == [("a", "b"), ("c", "d")]


def test_human_jsonl_fallback(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    base = '"src": " s ", "translation": "t", "ref": "r", "da_norm_score": "1.5", "mqm_norm_score": 2, ' \
           '"adequacy_score": 1, "fluency_score": 1, "full_score": 1, "Human_scores": 3'
    p.write_text("{" + base + ', "model": "m1"}\n{' + base + ', "model": "", "system": "s2"}\n{' + base
                 + ', "system": "s3"}\n', encoding="utf-8")
    rows = IO.scan_human_jsonl(spark, str(p)).collect()
    assert sorted(r.model for r in rows) == ["m1", "s2", "s3"]
    assert all(r.human_da == 1.5 and r.src == "s" for r in rows)
    p.write_text("{" + base.replace('"1.5"', '"oops"') + "}\n", encoding="utf-8")
    read = IO.scan_human_jsonl(spark, str(p))
    for job in (read.collect, read.count, read.select("ref").collect):
        with pytest.raises(Exception, match="h.jsonl has no valid value in: human_da"):
            job()
    assert IO.scan_human_jsonl(spark, str(p), check=False).first().human_da is None


def test_human_jsonl_keeps_the_first_of_several_files(spark, tmp_path):
    base = '"translation": "t", "ref": "r", "da_norm_score": %d, "mqm_norm_score": 2, "adequacy_score": 1, "fluency_score": 1, "full_score": 1, "Human_scores": 3'
    for f in (0, 1):
        lines = ['{"src": "s%d", %s}' % (i % 3, base % (10 * f + i)) for i in range(6)]
        (tmp_path / f"part{f}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rows = IO.scan_human_jsonl(spark, str(tmp_path))
    first = sets.dedup_first(rows, ["src", "mt", "ref"], "row_order")
    assert sorted((r.src, r.human_da) for r in first.collect()) == [("s0", 0.0), ("s1", 1.0), ("s2", 2.0)]


def test_dense_rank_partition_invariance(spark):
    ensure_checkpoint_dir(spark)
    vals = [(g, float(v)) for g in ("a", "b") for v in (5, 1, 3, 3, 9, 1, 7)]
    df = spark.createDataFrame(vals, "g string, v double")
    for parts in (1, 7):
        got = {(r.g, r.v): r.rank for r in rank.dense_rank(df.repartition(parts), "v", ["g"]).collect()}
        assert got[("a", 1.0)] == 0 and got[("a", 3.0)] == 1 and got[("b", 9.0)] == 4


def test_dedup_first_and_union(spark):
    df = spark.createDataFrame([(3, "s", "m", "r"), (1, "s", "m", "r"), (2, None, "m", "r"), (4, None, "m", "r")],
                               "row_id long, src string, mt string, ref string")
    kept = sorted(r.row_id for r in sets.dedup_first(df).collect())
    assert kept == [1, 2]
    u = sets.union_samples(df, spark.createDataFrame([(9, "x")], "row_id long, extra string"))
    assert u.count() == 5 and "extra" in u.columns


def test_macro_single_class(spark):
    df = spark.createDataFrame([("A", "P", 0.9), ("A", "P", 0.8), ("B", "P", 0.9), ("B", "NP", 0.9)],
                               "category string, label string, d_score double")
    res = {r.category: r for r in report.category_prf(df).collect()}
    assert res["A"].f1 == 1.0 and res["A"].precision == 1.0
    assert res["B"].precision == 0.25  # classes 0 and 1 both present
    assert res["Macro Avg"].support == 4


LINES = "pair_id long, s1 string, s2 string"


def _resumable_input(spark, path, files=6):
    rows = [(i, f"A{i}", None if i % 5 == 0 else f"B{i}") for i in range(60)]
    spark.createDataFrame(rows, LINES).repartition(files).write.json(str(path))
    return T.StructType.fromDDL(LINES)


def test_resumable_twice_is_once(spark, tmp_path):
    schema = _resumable_input(spark, tmp_path / "in")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):
        resumable.resumable_map(spark, str(tmp_path / "in"), schema, ["s1", "s2"], lambda s: s.str.lower(), out, ck)
    res = resumable.read_batches(spark, out, schema)
    assert res.columns == ["pair_id", "s1", "s2"]
    assert sorted((r.pair_id, r.s1) for r in res.collect()) == [(i, f"a{i}") for i in range(60)]


def test_resumable_stops_half_way_and_goes_on(spark, tmp_path):
    schema = _resumable_input(spark, tmp_path / "in")
    out, bad, ck, flag = (str(tmp_path / n) for n in ("out", "bad", "ck", "flag"))
    (tmp_path / "flag").write_text("stop")

    def fails(s):
        if open(flag).read() == "stop" and s.isin(["A7"]).any():
            raise RuntimeError("stopped")
        return s.str.lower()

    def run():
        resumable.resumable_map(spark, str(tmp_path / "in"), schema, ["s1"], fails, out, ck, valid=F.col("s2").isNotNull(), rejects=bad, files_per_batch=1)

    with pytest.raises(Exception, match="stopped"):
        run()
    before = len([p for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit()])
    assert before < 6  # the batch of A7 is open
    (tmp_path / "flag").write_text("go")
    run()
    run()  # nothing is left to do
    done, rejected = resumable.read_batches(spark, out, schema).collect(), resumable.read_batches(spark, bad, schema).collect()
    assert sorted((r.pair_id, r.s1, r.s2) for r in done) == [(i, f"a{i}", f"B{i}") for i in range(60) if i % 5]
    assert sorted((r.pair_id, r.s1) for r in rejected) == [(i, f"A{i}") for i in range(0, 60, 5)]


def test_resumable_overwrites_a_batch_that_was_written_but_not_committed(spark, tmp_path):
    schema = _resumable_input(spark, tmp_path / "in")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame([(99, "left", "over")], LINES).write.json(f"{out}/batch=0")
    resumable.resumable_map(spark, str(tmp_path / "in"), schema, ["s1"], lambda s: s.str.lower(), out, ck, files_per_batch=2)
    assert sorted(r.pair_id for r in resumable.read_batches(spark, out, schema).collect()) == list(range(60))


def test_resumable_batch_leaves_out_what_is_done(spark):
    df = spark.createDataFrame([(i, f"A{i}") for i in range(5)], "k long, s string")
    done = spark.createDataFrame([(1,), (3,)], "k long")
    got = resumable.resumable_map_batch(df, "k", ["s"], lambda s: s.str.lower(), done)
    assert sorted(map(tuple, got.collect())) == [(0, "a0"), (2, "a2"), (4, "a4")]
    assert resumable.resumable_map_batch(df, "k", ["s"], lambda s: s.str.lower(), None).count() == 5


def test_a_mapped_batch_is_let_go(spark):
    """Not kept until a collection of garbage happens to come."""
    seen = []

    def lower(s):
        seen.append(weakref.ref(s))
        return s.str.lower()

    apply = resumable.series_udf(lower).func
    gc.disable()
    try:
        got = [apply(pd.Series(["A", None])).tolist() for _ in range(5)]
    finally:
        gc.enable()
    assert got == [["a", None]] * 5 and len(seen) == 5 and all(ref() is None for ref in seen)
