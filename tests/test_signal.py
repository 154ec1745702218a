import numpy as np
import pytest

import fixture_recording as fx
import reference_steps as ref
from tracewell.functions import kernels as kn
from tracewell.operators import edges, signal as sg
from tracewell.operators.signal import Cleaning
from tracewell.sources import chunks as ch


def dense(df, width):
    rows = df.orderBy("sample", "channel").collect()
    return np.array([r.value for r in rows], dtype=float).reshape(-1, width)


@pytest.fixture(scope="module")
def made(spark):
    x, _ = fx.recording()
    x = x[:700]
    return x, fx.long_frame(spark, x).persist()


def one_filter(spark, taps, channels, left, threshold=0.0):
    flat = [float(v) for v in np.asarray(taps).ravel()]
    return spark.createDataFrame(
        [("r", 5, channels, flat, left, threshold)],
        "recording_id string, target_id bigint, channels array<int>, taps array<double>, left_margin int, threshold double",
    )


@pytest.mark.parametrize("length", [23, 128, 5000])
def test_cleaning_does_not_depend_on_chunks(spark, made, length):
    x, long = made
    chunks = ch.pack(long, length)
    assert np.array_equal(dense(ch.unpack(chunks), fx.C), x)
    b, a = kn.highpass_coefficients(300, fx.FS)
    want = ref.biquad(x, b, a)[0]
    got = dense(ch.unpack(sg.clean(chunks, length, Cleaning(fx.FS, 300, "causal", False))), fx.C)
    assert np.allclose(got, want, atol=1e-9)
    got = dense(ch.unpack(sg.highpass_carried(chunks, length, 300, fx.FS)), fx.C)
    assert np.allclose(got, want, atol=1e-9)
    both = kn.median_reference(kn.zero_phase_filter(x.astype(float), b, a, True, True))
    got = dense(ch.unpack(sg.clean(chunks, length, Cleaning(fx.FS, 300, "zero_phase", True, (4, 1)))), 2)
    # Long rows come back in channel order.
    assert np.allclose(got, both[:, [1, 4]], atol=1e-8)


@pytest.mark.parametrize("length", [23, 5000])
def test_scores_and_detections(spark, made, length):
    x, long = made
    taps = np.random.default_rng(2).integers(-3, 4, (7, 2))
    filters = one_filter(spark, taps, [3, 0], 3, 30.0)
    chunks = ch.pack(long, length)
    want = sum(np.convolve(x[:, c], taps[::-1, i], mode="same") for i, c in enumerate([3, 0]))
    got = sg.score_trace(chunks, length, filters, 7).orderBy("sample").collect()
    assert np.allclose([r.score for r in got], want)
    valid = sg.score_trace(chunks, length, filters, 7, edge="valid").orderBy("sample").collect()
    assert [r.sample for r in valid] == list(range(3, 697))
    found = sg.detect(chunks, length, filters, 7, suppress=5, edge="zero").orderBy("sample").collect()
    assert [r.sample for r in found] == [n for n in ref.window_peaks(want, 5) if want[n] > 30]
    live = sg.detect(chunks, length, filters, 7, suppress=5, complete=False).orderBy("sample").collect()
    inner = want[3:697]
    assert [r.sample for r in live] == [n + 3 for n in ref.window_peaks(inner, 5) if inner[n] > 30 and n + 5 <= 693]


def test_a_gap_restarts_the_filter(spark, made):
    x, long = made
    chunks = ch.pack(long.where("sample < 200 or sample >= 300"), 100)
    b, a = kn.highpass_coefficients(300, fx.FS)
    want = np.concatenate([ref.biquad(x[:200], b, a)[0], ref.biquad(x[300:], b, a)[0]])
    for got in (sg.clean(chunks, 100, Cleaning(fx.FS, 300, "causal", False)), sg.highpass_carried(chunks, 100, 300, fx.FS)):
        assert np.allclose(dense(ch.unpack(got), fx.C), want, atol=1e-9)
    missing = edges.continuity(chunks, ["recording_id"]).collect()
    assert [(r.expected, r.found) for r in missing] == [(200, 300)]


def test_pack_rejects_holes_and_filters_reject_unknown_channels(spark, made):
    _, long = made
    with pytest.raises(Exception, match="hole inside a chunk"):
        ch.pack(long.where("sample <> 5 or channel <> 2"), 100).collect()
    with pytest.raises(Exception, match="not in the recording"):
        sg.score_trace(ch.pack(long, 100), 100, one_filter(spark, np.ones((3, 1)), [77], 1), 3).collect()


def test_detection_moves_no_chunk_payload_on_a_bucketed_table(spark, made):
    _, long = made
    ch.write_bucketed(ch.pack(long, 100), "bucketed_chunks", 4)
    table = spark.table("bucketed_chunks")
    found = sg.detect(table, 100, one_filter(spark, np.ones((3, 1)), [0], 1), 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    for line in plan.splitlines():
        # Whatever is shuffled, it is not a row that carries the chunk's values.
        assert not ("Exchange hashpartitioning(recording_id" in line and "values" in line)
    assert found.count() > 0
    spark.sql("drop table bucketed_chunks")


def test_haloed_scan_needs_no_shuffle(spark, tmp_path):
    from tracewell.sources.raw import register

    x, _ = fx.recording()
    x[:700].astype("<i2").tofile(tmp_path / "r.bin")
    scan = (
        register(spark).read.format("interleaved16").option("n_channels", fx.C).option("chunk_samples", 100)
        .option("halo_before", 8).option("halo_after", 8).load(str(tmp_path))
    )
    filters = one_filter(spark, np.array([[1], [2], [-1]]), [2], 1, -1e9)
    found = sg.detect(scan, 100, filters, 3, suppress=4, edge="zero", haloed=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    top = plan.split("BroadcastExchange")[0]
    assert "Exchange hashpartitioning" not in top
    d = np.convolve(x[:700, 2], [-1, 2, 1], mode="same")
    assert sorted(r.sample for r in found.collect()) == ref.window_peaks(d, 4)


def test_candidates_are_the_local_maxima_of_the_trace(spark):
    import numpy as np

    from tracewell.operators import peaks, signal as sg
    from tracewell.sources import chunks as ch

    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (900, 2))
    x[130:330] = 1  # flat over several chunks
    x[500:520] = 0
    rows = [("r", s, c, float(x[s, c])) for s in range(900) for c in (0, 1) if not 700 <= s < 750]
    chunks = ch.pack(spark.createDataFrame(rows, "recording_id string, sample bigint, channel int, value double"), 50)
    taps = rng.integers(-2, 3, (7, 2)).astype(float).ravel().tolist()
    filters = spark.createDataFrame(
        [("r", 1, [0, 1], taps, 3, 0.0, None), ("r", 2, [1, 0], taps, 2, 0.0, None), ("r", 3, [0, 1], taps, 3, 0.0, 260)],
        "recording_id string, target_id bigint, channels array<int>, taps array<double>, left_margin int, threshold double, from_sample bigint",
    )
    keys = ["recording_id", "target_id"]
    got = sorted(tuple(r) for r in sg.candidates(chunks, 50, filters, 7).select(*keys, "sample", "score").collect())
    plain = filters.drop("from_sample")
    want = peaks.local_maxima(sg.score_trace(chunks, 50, plain.where("target_id < 3"), 7), keys)
    late = ch.pack(spark.createDataFrame([r for r in rows if r[1] >= 260], "recording_id string, sample bigint, channel int, value double"), 50)
    want = want.union(peaks.local_maxima(sg.score_trace(late, 50, plain.where("target_id = 3"), 7), keys))
    want = sorted(tuple(r) for r in want.select(*keys, "sample", "score").collect())
    assert got == want and len(got) > 100
    high = sg.candidates(chunks, 50, filters, 7, minimum=5.0).select(*keys, "sample", "score").collect()
    assert sorted(map(tuple, high)) == [r for r in want if r[3] >= 5]


@pytest.mark.parametrize("recordings,bank_bytes", [(2, 64 << 20), (600, 64 << 20), (40, 1500)])
def test_filters_come_to_the_signal(spark, recordings, bank_bytes):
    from tracewell.operators import signal as sg

    chunks = spark.range(recordings).selectExpr(
        "concat('r', id) as recording_id", "0L as chunk_id", "0L as start_sample", "2 as n_samples", "array(0) as channels",
        "array(double(id), 1D) as values",
    )
    bank = spark.range(recordings - 1).selectExpr(
        "concat('r', id) as recording_id", "id as target_id", "array(0) as channels", "array(double(id), 2D) as taps",
        "0 as left_margin", "0D as threshold",
    )
    joined = sg.with_filters(chunks, bank, bank_bytes)
    assert "ShuffleExchange" not in joined._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    got = sorted((r.recording_id, r["values"][0], r.filters[0].taps[0], len(r.filters)) for r in joined.collect())
    assert got == sorted((f"r{k}", float(k), float(k), 1) for k in range(recordings - 1))
