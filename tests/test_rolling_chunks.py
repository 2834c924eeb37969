"""Chunks that go through Python are small, unless the window asks for larger ones."""

import pytest
from pyspark.sql import functions as F

import weir
from weir.plans import rolling


@pytest.mark.parametrize("window,chunks", [(10, [10]), (3000, [10, 2])])
def test_chunks(spark, monkeypatch, window, chunks):
    asked, cuts = [], rolling._cuts
    monkeypatch.setattr(rolling, "_cuts", lambda rows, n, c: (asked.append(c), cuts(rows, n, c))[1])
    monkeypatch.setattr(rolling, "FRAME_ROWS", 1000, raising=False)
    monkeypatch.setattr(rolling, "ROWS_PER_CHUNK", 5000)
    monkeypatch.setattr(rolling, "MIN_ROWS_PER_CHUNK", 5000)
    df = spark.range(10_000).select("id", F.timestamp_seconds("id").alias("ts"))
    got = weir.rolling_count(df, f"{window}s").select("id", "Count").collect()
    assert asked == chunks
    assert {r.id: r.Count for r in got} == {i: float(min(i, window) + 1) for i in range(10_000)}
