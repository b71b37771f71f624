import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mtlens.operators import adjust as A


def _adj(spark, rows, tau=0.6):
    df = spark.createDataFrame(rows, "s double, d double")
    return [r[0] for r in df.select(A.adjust_score("s", "d", tau)).collect()]


def test_edges(spark):
    out = _adj(spark, [(0.6, 1.0), (0.3, 0.5), (0.0, 1.0), (None, 1.0), (float("nan"), 0.2), (0.9, 0.0), (0.7, None)])
    assert out[0] == 0.6                      # s = tau: unchanged
    assert math.isclose(out[1], 0.6 + 0.3 * 0.5)
    assert out[2] == 1.0                      # 1.2 clipped
    assert out[3] is None and out[4] is None  # null / NaN score stay null
    assert math.isclose(out[5], 0.3)          # 0.6 - 0.3 * 1
    assert out[6] == 0.7                      # null decision leaves the score


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1)), min_size=1, max_size=20))
def test_properties(spark, rows):
    out = _adj(spark, rows)
    for (s, d), a in zip(rows, out):
        assert 0.0 <= a <= 1.0
        if d >= 0.5:
            assert a >= s - 1e-12
        else:
            assert a <= s + 1e-12


def test_select_decision(spark):
    df = spark.createDataFrame([(1, 0.2, 0.9), (None, 0.7, 0.4), (None, 0.5, 0.9), (None, 0.3, 0.9)],
                               "d_rule int, d_contra double, d_para double")
    got = [r[0] for r in df.select(A.select_decision()).collect()]
    assert got == [1.0, 0.4, 0.5, 0.3]
