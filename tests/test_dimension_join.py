"""Joins with dimensions too large for a broadcast: copies only for keys with many rows."""

import io
from contextlib import redirect_stdout

import pytest

from tracewell import session
from tracewell.operators.sweep import sweep


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_a_dimension_is_copied_for_hot_keys_only(spark, monkeypatch, how):
    big = spark.createDataFrame([(k % 7 if k % 2 else 3, k) for k in range(200)], "key long, at long")
    small = spark.createDataFrame([(k, float(k)) for k in range(2, 40)], "key long, value double")
    want = sorted(map(tuple, big.join(small, ["key"], how).collect()), key=str)

    def joined(**more):
        return session.join_dimension(big, small, ["key"], how, max_rows=10, spread="at", stage=False, **more)

    even = joined()
    assert "Generate" not in plan(even)
    monkeypatch.setattr(session, "SALTED", 20)
    hot = joined()
    assert "Generate" in plan(hot) and "Generate" not in plan(joined(largest=5))
    for found in (even, hot, joined(largest=150)):
        assert found.columns == big.join(small, ["key"], how).columns
        assert sorted(map(tuple, found.collect()), key=str) == want


def test_a_sweep_of_many_targets_copies_no_grid(spark, monkeypatch):
    seen = []
    real = session.join_dimension
    few = {"max_rows": 3}

    def watched(*args, **kwargs):
        out = real(*args, **{**kwargs, **few})
        seen.append(plan(out))
        return out

    monkeypatch.setattr("tracewell.operators.sweep.join_dimension", watched)
    monkeypatch.setattr("tracewell.operators.quantiles.join_dimension", watched)
    peaks = spark.createDataFrame([(t, 10 * i, float((7 * i + t) % 23)) for t in range(9) for i in range(30)], "target long, sample long, score double")
    truth = spark.createDataFrame([(t, 30 * i + 1) for t in range(9) for i in range(9)], "target long, spike_time long")

    def curve():
        return sorted(map(tuple, sweep(peaks, truth, ["target"], 2).collect()))

    got = curve()
    assert len(seen) == 3 and not any("_salt" in p for p in seen)
    few["max_rows"] = 20_000
    assert got == curve()
