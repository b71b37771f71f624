"""What a task and an idle worker hold on to."""

import os
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from mtlens.llm import common, ngram_join
from mtlens.session import PACKAGE_ROOT

HELD = """
import re
import sys
import numpy as np
import pyarrow as pa
from mtlens.llm.common import lean

def resident():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def run(batches):
    for batch in batches:
        small = [np.ones(6_000) for _ in range(4_000)]  # 190 MB of the C heap
        keep = small[::400]
        del small
        yield batch
        held.append(keep)

held, batch = [], pa.RecordBatch.from_pydict({"x": pa.array([1, 2])})
before = resident()
got = list(lean(run)(iter([batch])) if sys.argv[1] == "lean" else run(iter([batch])))
assert got == [batch]
print(resident() - before)
"""


def test_an_idle_worker_holds_no_free_memory():
    env = os.environ | {"PYTHONPATH": PACKAGE_ROOT, "MALLOC_TRIM_THRESHOLD_": str(1 << 30), "MALLOC_MMAP_THRESHOLD_": str(1 << 25)}
    plain, lean = (float(subprocess.run([sys.executable, "-c", HELD, how], env=env, capture_output=True, check=True).stdout) for how in ("plain", "lean"))
    assert plain > 150 and lean < 40


def test_lean_gives_the_same_batches_and_errors():
    batches = [pa.RecordBatch.from_pydict({"x": pa.array([i])}) for i in range(3)]
    assert list(common.lean(lambda b: (x for x in b))(iter(batches))) == batches

    def fails(batches):
        yield next(batches)
        raise ValueError("no")

    got = common.lean(fails)(iter(batches))
    assert next(got) == batches[0]
    try:
        next(got)
    except ValueError as e:
        assert str(e) == "no"
    else:
        raise AssertionError("the error was lost")


def test_written_row_groups_are_small(spark):
    """Beyond the bound a task holds one group, not all that it writes: 40 MB of random bytes are several groups, the rows the same."""
    rows = spark.range(0, 4_000, numPartitions=1).select("id", F.rand(3).alias("r"))

    def wide(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                cell = np.random.default_rng(i).bytes(10_000)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([cell], pa.binary())], ["id", "cell"])

    out = common.materialize(rows.select("id").mapInArrow(wide, "id long, cell binary"), "wide")
    sizes = []
    for name in out.inputFiles():
        meta = pq.ParquetFile(re.sub("^file:/*", "/", name)).metadata
        sizes += [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert len(sizes) > 2 and max(sizes) < 2 * common.GROUP_BYTES
    assert out.count() == 4_000 and out.agg(F.sum("id"), F.sum(F.length("cell"))).first()[:] == (4_000 * 3_999 // 2, 40_000_000)


def test_readers_of_texts_decode_few_rows_at_once(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    now = spark.newSession()
    common.bound_batches(now)
    assert now.conf.get(key) == str(common.READ_ROWS)
    own = spark.newSession()
    own.conf.set(key, "7")
    common.bound_batches(own)
    assert own.conf.get(key) == "7"


def test_texts_are_taken_apart_in_small_steps(monkeypatch):
    """A batch of 3 MB is several steps; the rows are those of one."""
    texts = [" ".join(f"w{i}x{j}" for j in range(150)) for i in range(3_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    steps = []
    real = ngram_join.shingle_sets

    def seen(text, width):
        steps.append(text.nbytes)
        return real(text, width)

    monkeypatch.setattr(ngram_join, "shingle_sets", seen)
    got = pa.Table.from_batches(list(ngram_join._survey(5)(iter([batch]))))
    assert len(steps) > 2 and max(steps) < 1.2 * ngram_join.STEP_BYTES
    rows = got.filter(pa.compute.is_valid(got.column("n")))
    assert rows.column("doc_id").to_pylist() == list(range(len(texts))) and set(rows.column("n").to_pylist()) == {146}


def test_a_worker_drops_what_other_operators_kept(monkeypatch):
    monkeypatch.setattr(common, "KEPT", {"token encoders": {"file": object()}, "others": {}})
    list(common.lean(iter, "token encoders")(iter([])))
    assert list(common.KEPT) == ["token encoders"]
    list(common.lean(iter)(iter([])))
    assert common.KEPT == {}
