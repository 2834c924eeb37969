"""The staged transform against numpy, and its plan."""

import numpy as np
import pytest

import weir
from weir.operators.project import radices


@pytest.mark.parametrize("n", [1, 2, 24, 37, 67, 360])
def test_long_series(spark, n):
    x = np.random.default_rng(n).normal(size=(2, n))
    x[1, n // 2 + 1:] = 0
    rows = [(k, i, str(x[k, i])) for k in range(2) for i in range(n) if k == 0 or i <= n // 2]
    rows += [(0, n, "5"), (0, -1, "5"), (0, 0, "none"), (0, 0, None)]
    df = spark.createDataFrame(rows, "key int, idx int, value string")
    got = {(r.key, r.k): complex(r.re, r.im) for r in weir.dft_by_key(df, "key", "idx", "value", n).collect()}
    want = np.fft.fft(x)
    assert len(got) == 2 * n
    assert all(got[k, i] == pytest.approx(want[k, i], abs=1e-9) for k in range(2) for i in range(n))


def test_radices():
    for n in (1, 2, 97, 720, 1 << 20, 10_007):
        assert int(np.prod(radices(n))) == n
    assert max(radices(1 << 20)) == 8 and len(radices(1 << 20)) == 7


def test_no_row_is_multiplied_before_a_shuffle(spark):
    """Of a smooth length, each step shuffles the n points once, and nothing is exploded to n times n rows."""
    df = spark.range(4096).selectExpr("0 AS key", "id AS idx", "1.0 AS value")
    text = weir.dft_by_key(df, "key", "idx", "value", 4096)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 1 + len(radices(4096))
    assert "explode" not in text


def test_array_form(spark):
    for n in (1, 2, 12, 13, 64):
        x = np.random.default_rng(n).normal(size=n)
        df = spark.createDataFrame([([(0.0, float(v)) for v in x],), ([],), (None,)], "s array<struct<timestamp:double,value:double>>")
        got = [r.fft for r in weir.fft(df, "s").collect()]
        assert [complex(*c) for c in got[0]] == pytest.approx(list(np.fft.fft(x)), abs=1e-9)
        assert got[1:] == [[], None]
