"""Blocked scans, peaks, matching, edges and windows against sequential versions, for
several block widths: the result must not depend on how a recording is cut."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import reference_steps as ref
from tracewell import blocks
from tracewell.functions.digital import extract_bit, extract_field
from tracewell.operators import edges, intervals, matching, peaks, quantiles, sweep, windows

K = ["recording_id"]
WIDTHS = [7, 64, 100_000]


def series(spark, values, name="a", column="score"):
    rows = [(name, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"recording_id string, sample bigint, {column} double")


def points(spark, values, column, name="a"):
    return spark.createDataFrame([(name, int(v)) for v in values], f"recording_id string, {column} bigint")


def samples(df, column="sample"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(8).integers(0, 12, 400)


@pytest.mark.parametrize("width", WIDTHS)
def test_scan_kinds(spark, noise, width):
    df = series(spark, noise)
    value = F.when(F.col("score") > 5, F.col("score"))
    out = blocks.scan(
        df, K, "sample",
        {
            "total": blocks.Running("sum", F.col("score")),
            "top": blocks.Running("max", F.col("score"), False),
            "last": blocks.Running("last", value),
            "before": blocks.Running("last", F.col("score"), False),
        },
        width,
    ).orderBy("sample").collect()
    seen = None
    for i, r in enumerate(out):
        seen = noise[i] if noise[i] > 5 else seen
        assert r.total == noise[: i + 1].sum() and r.last == seen
        assert r.top == (noise[:i].max() if i else None)
        assert r.before == (noise[i - 1] if i else None)
    lead = blocks.scan(df, K, "sample", {"n": blocks.Running("last", F.col("score"), False)}, width, reverse=True)
    assert [r.n for r in lead.orderBy("sample").collect()][:-1] == noise[1:].tolist()


@pytest.mark.parametrize("width", WIDTHS)
def test_runs(spark, width):
    values = [0, 0, 1, 1, 1, 0, 2, 2, 0, 0, 0, 0, 1]
    found = blocks.runs(series(spark, values), K, "sample", "score", width).collect()
    assert sorted((r.run_start, r.run_length, r.score) for r in found) == [
        (0, 2, 0.0), (2, 3, 1.0), (5, 1, 0.0), (6, 2, 2.0), (8, 4, 0.0), (12, 1, 1.0)
    ]


@pytest.mark.parametrize("width", WIDTHS)
def test_peaks(spark, noise, width):
    df = series(spark, noise)
    assert samples(peaks.local_maxima(df, K, block=width)) == ref.local_maxima(noise)
    assert samples(peaks.window_peaks(df, K, 4, block=width)) == ref.window_peaks(noise, 4)
    early = [n for n in ref.window_peaks(noise, 4) if n + 4 <= len(noise) - 1]
    assert samples(peaks.window_peaks(df, K, 4, complete=False, block=width)) == early
    tall = [n for n in ref.window_peaks(noise, 4) if noise[n] > 9]
    assert samples(peaks.window_peaks(df, K, 4, threshold=9.0, block=width)) == tall
    found = peaks.run_peaks(df, K, 6, block=width)
    want, i = [], 0
    while i < len(noise):
        j = i
        while j < len(noise) and noise[j] > 6:
            j += 1
        if j > i:
            want.append(i + int(np.argmax(noise[i:j])))
        i = max(j, i + 1)
    assert samples(found) == want


@pytest.mark.parametrize("width,halo", [(16, 0), (50, 10), (100_000, None)])
def test_priority_suppression_equals_sequential(spark, noise, width, halo):
    tops = peaks.local_maxima(series(spark, noise), K)
    at = np.array(ref.local_maxima(noise))
    got = samples(peaks.priority_peaks(tops, K, 9, block=width, halo=halo))
    assert got == ref.priority(at, noise[at], 9)
    high = [i for i in at if noise[i] >= 8]
    got = samples(peaks.priority_peaks(tops, K, 9, min_height=8.0, block=width, halo=halo))
    assert got == ref.priority(high, noise[high], 9)


def test_long_suppression_chain_over_blocks(spark):
    # Ever higher peaks: each is removed only because the next one is kept or not.
    rising = series(spark, range(0, 300))
    got = samples(peaks.priority_peaks(rising, K, 3, block=10, halo=3))
    assert got == ref.priority(list(range(300)), list(range(300)), 3)


def test_distance_29_30_31(spark):
    at = [100, 129, 300, 330, 500, 531]
    df = spark.createDataFrame([("a", a, float(i)) for i, a in enumerate(at)], "recording_id string, sample bigint, score double")
    assert samples(peaks.priority_peaks(df, K, 30, block=64)) == [129, 300, 330, 500, 531]
    assert samples(peaks.window_peaks(df, K, 30, block=64)) == [129, 330, 500, 531]


@pytest.mark.parametrize("w", [0, 1, 5, 40])
def test_matching(spark, w):
    rng = np.random.default_rng(w)
    q, r = rng.integers(0, 1000, 120), rng.integers(0, 1000, 40)
    Q, R = points(spark, q, "q"), points(spark, r, "r")
    near = [x for x in q if any(abs(x - y) <= w for y in r)]
    assert samples(matching.match_within(Q, R, K, "q", "r", w), "q") == sorted(near)
    far = [x for x in q if not any(abs(x - y) <= w for y in r)]
    assert samples(matching.unmatched(Q, R, K, "q", "r", w), "q") == sorted(far)
    lop = matching.mark_near(Q, R, K, "q", "r", w, 2 * w + 3, "hit").where("hit")
    assert samples(lop, "q") == sorted(x for x in q if any(x - w <= y <= x + 2 * w + 3 for y in r))


def test_matching_borders_and_empty_sides(spark):
    Q, R = points(spark, [0, 15, 16, 100], "q"), points(spark, [0, 85, 84], "r")
    assert samples(matching.match_within(Q, R, K, "q", "r", 15), "q") == [0, 15, 100]
    none = points(spark, [], "r")
    assert matching.match_within(Q, none, K, "q", "r", 15).count() == 0
    assert matching.unmatched(Q, none, K, "q", "r", 15).count() == 4


def test_attribution_counts_a_detection_once_per_unit(spark):
    D = points(spark, [10, 50], "sample")
    others = spark.createDataFrame(
        [("a", 9, 1), ("a", 10, 1), ("a", 11, 1), ("a", 12, 2), ("a", 70, 2)], "recording_id string, t bigint, unit bigint"
    )
    got = matching.attribute(D, others, K, "sample", "t", "unit", 2).collect()
    assert sorted((r.sample, r.unit) for r in got) == [(10, 1), (10, 2)]


@pytest.mark.parametrize("width", [8, 100_000])
def test_best_nearby(spark, noise, width):
    trace = series(spark, noise)
    q = [0, 3, 50, 50, 399, 700]
    got = matching.best_nearby(points(spark, q, "q"), trace, K, "q", "sample", "score", 6, block=width)
    want = [(x, float(noise[max(x - 6, 0) : x + 7].max()) if x < 406 else None) for x in q]
    assert sorted((r.q, r.best) for r in got.collect() if r.best is not None) == sorted(w for w in want if w[1] is not None)
    assert got.count() == len(q)


def test_sweep_equals_the_loop(spark, noise):
    at = np.array(ref.window_peaks(noise, 2))
    truth = np.array([3, 40, 41, 90, 133, 250, 251, 360])
    rivals = {1: [5, 91, 200], 2: [134, 300, 301]}
    peaks_df = spark.createDataFrame([("a", int(i), float(noise[i])) for i in at], "recording_id string, sample bigint, score double")
    others = spark.createDataFrame([("a", t, u) for u, ts in rivals.items() for t in ts], "recording_id string, spike_time bigint, unit_id bigint")
    curve = sweep.sweep(peaks_df, points(spark, truth, "spike_time"), K, 3, others, duration_s=4.0).orderBy("idx").collect()
    lo, hi = np.percentile(noise[at], [50, 99.99])
    assert len(curve) == 60
    for i, row in enumerate(curve):
        th = lo + (hi - lo) * i / 59
        det = at[noise[at] > th]
        hits = sum(any(abs(t - d) <= 3 for d in det) for t in truth)
        fps = [d for d in det if not any(abs(t - d) <= 3 for t in truth)]
        assert np.isclose(row.threshold, th)
        assert (row.hits, row.total_fp, row.n_detections, row.misses) == (hits, len(fps), len(det), len(truth) - hits)
        by = {u: sum(any(abs(t - d) <= 3 for t in ts) for d in fps) for u, ts in rivals.items()}
        assert row.fp_by_interferer == by
        assert row.fp_rate_hz == len(fps) / 4.0


def test_operating_points(spark):
    rows = [("a", 0, 0.9, 3.0, 0.6), ("a", 1, 0.8, 0.9, 0.7), ("a", 2, 0.8, 0.5, 0.7), ("b", 0, 0.4, 9.0, 0.1), ("b", 1, 0.3, 8.0, 0.1)]
    curve = spark.createDataFrame(rows, "recording_id string, idx int, recall double, fp_rate_hz double, f1 double")
    assert sorted((r.recording_id, r.idx) for r in sweep.best_f1(curve, K).collect()) == [("a", 1), ("b", 0)]
    assert sorted((r.recording_id, r.idx) for r in sweep.best_recall(curve, K, 1.0).collect()) == [("a", 1), ("b", 1)]
    assert [r.recording_id for r in sweep.best_recall(curve, K, 1.0, fallback=False).collect()] == ["a"]


@pytest.mark.parametrize("n", [1, 2, 7, 400_000])
def test_exact_quantiles(spark, n):
    values = np.round(np.random.default_rng(n).normal(size=n), 2)
    df = spark.createDataFrame(pd.DataFrame({"recording_id": "a", "v": values}))
    got = quantiles.exact_quantiles(df, K, F.col("v"), {"mid": 0.5, "top": 0.9999}).first()
    assert np.allclose([got.mid, got.top], np.percentile(values, [50, 99.99]))
    near = quantiles.exact_quantiles(df, K, F.col("v"), {"q": 0.9999}, "nearest").first()
    assert near.q == np.sort(values)[int(0.9999 * (n - 1) + 0.5)]


def test_quantiles_when_one_value_dominates(spark):
    df = spark.range(900_000).selectExpr("'a' as recording_id", "case when id % 3 = 0 then 1.5 else cast(id as double) end as v")
    values = np.array([1.5 if i % 3 == 0 else i for i in range(900_000)])
    got = quantiles.exact_quantiles(df, K, F.col("v"), {"p": 0.3, "q": 0.34}).first()
    assert np.allclose([got.p, got.q], np.percentile(values, [30, 34]))


WORDS = [64, 0, 64, 64, 0, 0x8000 - 65536, 32, 32, 32, 0, 32, 32, 96, 96, 0, 0, 32 + 64, 32 + 64, 160, 160, 160]


@pytest.mark.parametrize("width", [3, 1000])
def test_words(spark, width):
    df = spark.createDataFrame([("a", i, w) for i, w in enumerate(WORDS)], "recording_id string, sample bigint, word int")
    edge = edges.rising_edges(df, K, extract_bit(F.col("word"), 6), block=width)
    bits = [(w & 0xFFFF) >> 6 & 1 for w in WORDS]
    want = [i for i in range(1, len(bits)) if bits[i - 1] == 0 and bits[i]]
    assert [(r.sample, r.edge_seq) for r in edge.orderBy("sample").collect()] == [(s, i + 1) for i, s in enumerate(want)]
    codes = [(w & 0xFFFF) >> 5 & 7 for w in WORDS]
    for hold in (1, 2, 3):
        got = edges.code_onsets(df, K, extract_field(F.col("word"), [5, 6, 7]), hold, block=width)
        assert sorted((r.sample, r.code) for r in got.collect()) == ref.onsets(codes, hold)
    assert df.select(extract_bit(F.col("word"), 15).alias("b")).where("b = 1").count() == 1


@pytest.mark.parametrize("width", [4, 1000])
def test_as_of_edge(spark, width):
    edge = spark.createDataFrame([("a", 10, 1), ("a", 20, 2)], "recording_id string, sample bigint, edge_seq bigint")
    got = edges.last_edge(points(spark, [5, 10, 19, 20, 99], "sample"), edge, K, fs=10.0, block=width).orderBy("sample").collect()
    assert [(r.edge_sample, r.edge_seq, r.time_rel_s) for r in got] == [
        (None, None, None), (10, 1, 0.0), (10, 1, 0.9), (20, 2, 0.0), (20, 2, 7.9)
    ]


@pytest.mark.parametrize("width", [4, 1000])
def test_toggles(spark, noise, width):
    got = edges.level_toggles(series(spark, noise), K, 9, 4, value="score", block=width)
    assert sorted((r.chunk_id, r.level) for r in got.collect()) == ref.toggles(noise, 9, 4)


@pytest.mark.parametrize("width", [4, 1000])
def test_windows(spark, width):
    anchors = points(spark, [0, 10, 11, 100, 200], "sample")
    at = [0, 3, 10, 12, 20, 21, 100, 101, 102, 103, 199, 210, 211]
    got = windows.window_counts(anchors, points(spark, at, "s"), K, "sample", "s", 0, 10, 3, width)
    for r in got.collect():
        inside = [t for t in at if 0 <= t - r.sample <= 10]
        assert r.n_events == len(inside)
        assert r.trigger_sample == (inside[2] if len(inside) >= 3 else None)
    pairs = windows.interval_join(anchors, points(spark, at, "s"), K, "sample", "s", 2, 10)
    assert sorted((r.sample, r.s) for r in pairs.collect()) == sorted((a, t) for a in [0, 10, 11, 100, 200] for t in at if 2 <= t - a <= 10)
    made = windows.decisions(anchors, points(spark, at, "s"), K, "sample", "s", 0, 10, 3, width)
    assert {r.sample: (r.outcome, r.n_events) for r in made.collect()}[100] == ("TRIGGER", 3)


@pytest.mark.parametrize("width", [4, 1000])
def test_intervals(spark, width):
    t = [0, 5, 6, 30, 33, 60, 95]
    lens = spark.createDataFrame([("a", 100), ("empty", 50)], "recording_id string, n_samples bigint")
    busy = {i for x in t for i in range(max(x - 2, 0), min(x + 4, 100))}
    free, i = [], 0
    while i < 100:
        j = i
        while j < 100 and j not in busy:
            j += 1
        if j - i >= 5:
            free.append((i, j))
        i = max(j, i + 1)
    got = intervals.free_segments(points(spark, t, "p"), K, "p", 2, 4, lens, 5, width).collect()
    assert sorted((r.start, r.end) for r in got if r.recording_id == "a") == free
    assert [(r.start, r.end) for r in got if r.recording_id == "empty"] == [(0, 50)]
    high = intervals.pulse_intervals(points(spark, [1, 5, 11, 40, 41, 90], "t"), K, "t", 6, width)
    assert sorted((r.start, r.end) for r in high.collect()) == [(1, 17), (40, 47), (90, 96)]


def test_hot_recording_is_cut_into_blocks(spark):
    """All rows in one recording still spread over many (recording, block) groups."""
    df = spark.range(100_000).selectExpr("'hot' as recording_id", "id as sample", "cast(id % 7 as double) as score")
    spread = blocks.with_halo(df, "sample", 5, 5, 1000)
    sizes = [r["count"] for r in spread.groupBy("_block").count().collect()]
    # The first and last block see one neighbour, negative and trailing ones only replicas.
    assert len(sizes) == 102 and max(sizes) <= 1010


@pytest.mark.parametrize("band", [3, 40])
def test_wide_bands_are_narrowed_in_rounds(spark, band):
    import random

    from tracewell.operators import quantiles

    rng = random.Random(band)
    rows = [("a", rng.gauss(0, 1) ** 5) for _ in range(3000)] + [("b", float(rng.randint(0, 9))) for _ in range(900)]
    rows += [("c", 1e300), ("c", -1e300), ("c", 5.0), ("d", 7.0)] + [("e", 2.0 + k * 2**-51) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    asked = {"low": 0.001, "mid": 0.5, "high": 0.937}
    for r in quantiles.exact_quantiles(df, ["g"], F.col("v"), asked, accuracy=100, band=band).collect():
        values = np.array([v for g, v in rows if g == r.g])
        want = [np.quantile(values, p) for p in asked.values()]
        assert [r.low, r.mid, r.high] == pytest.approx(want, rel=1e-12)


def test_blocks_are_settled_together():
    # many small blocks are one call, with few rows a batch; a block is never cut
    keys, block = ["a"] * 5 + [None] * 4 + ["b"] * 40_000, [0, 0, 1, 1, 1, 0, 0, 0, 2] + [k // 10 for k in range(40_000)]
    table = pa.table({"k": pa.array(keys), "b": pa.array(block)})
    parts = list(peaks.whole_blocks(iter(table.to_batches(max_chunksize=7)), ["k", "b"]))
    assert pa.concat_tables(parts).equals(table) and 2 <= len(parts) <= 3
    assert all(parts[i].slice(parts[i].num_rows - 1).to_pylist() != parts[i + 1].slice(0, 1).to_pylist() for i in range(len(parts) - 1))
    assert list(np.flatnonzero(peaks.block_changes(table.slice(0, 12), ["k", "b"])) + 1) == [2, 5, 8, 9]


def test_scores_are_made_once_for_a_robust_threshold(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    trace = series(spark, range(500)).mapInArrow(counted, "recording_id string, sample bigint, score double")
    spikes = spark.createDataFrame([("a", 100), ("a", 250)], "recording_id string, spike_time bigint")
    assert sweep.robust_threshold(trace, K, spikes, 5, 2).count() == 1
    assert made.value == 500
