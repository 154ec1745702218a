import numpy as np
import pytest
from pyspark.sql import functions as F

import fixture_recording as fx
from tracewell.operators import signal as sg, windows
from tracewell.operators.signal import CHUNK_SCHEMA, Cleaning
from tracewell.sources import chunks as ch
from tracewell.streaming import chunks as st, processors


def write_each(parts, folder):
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_across_a_gap_and_out_of_order_chunks(spark, tmp_path):
    x, _ = fx.recording()
    x = x[:1500]
    long = fx.long_frame(spark, x).where("sample < 600 or sample >= 800")
    taps = np.random.default_rng(9).integers(-3, 4, (7, 2))
    filters = spark.createDataFrame(
        [("r", 1, [2, 4], [float(v) for v in taps.ravel()], 3, 20.0)],
        "recording_id string, target_id bigint, channels array<int>, taps array<double>, left_margin int, threshold double",
    )
    cleaning = Cleaning(fx.FS, 300.0, "causal", True)
    pieces = ch.pack(long, 100).persist()
    folder = str(tmp_path / "in")
    write_each([pieces.where("chunk_id < 3"), pieces.where("chunk_id between 3 and 9").orderBy(F.desc("chunk_id")), pieces.where("chunk_id > 9")], folder)
    stream = processors.detect_stream(st.read_stream(spark, folder, CHUNK_SCHEMA, 1), filters, 7, cleaning, suppress=3)
    got = sorted((r.sample, round(r.score, 6)) for r in st.run_available(stream).collect())
    batch = sg.detect(ch.pack(long, 100), 100, filters, 7, cleaning, suppress=3)
    # A live stream cannot decide the last samples before a gap or the end.
    open_ends = {s for end in (600, 1500) for s in range(end - 3 - 3, end)}
    want = sorted((r.sample, round(r.score, 6)) for r in batch.collect() if r.sample not in open_ends)
    assert [s for s, _ in got] == [s for s, _ in want] and got == want


def test_late_chunks_are_held_or_put_out_with_a_tag(spark, tmp_path):
    x, _ = fx.recording()
    long = fx.long_frame(spark, x[:1500])
    taps = np.random.default_rng(9).integers(-3, 4, (7, 2))
    filters = spark.createDataFrame(
        [("r", 1, [2, 4], [float(v) for v in taps.ravel()], 3, 20.0)],
        "recording_id string, target_id bigint, channels array<int>, taps array<double>, left_margin int, threshold double",
    )
    cleaning = Cleaning(fx.FS, 300.0, "causal", True)
    pieces = ch.pack(long, 100).persist()
    folder = str(tmp_path / "in")
    write_each([pieces.where(c) for c in ("chunk_id < 3", "chunk_id between 5 and 8", "chunk_id in (3, 4)", "chunk_id > 8")], folder)

    def found(lateness):
        stream = processors.detect_stream(
            st.read_stream(spark, folder, CHUNK_SCHEMA, 1), filters, 7, cleaning, suppress=3, lateness=lateness
        )
        return [tuple(r) for r in st.run_available(stream).select("target_id", "sample", "score").collect()]

    batch = sg.detect(ch.pack(long, 100), 100, filters, 7, cleaning, suppress=3)
    want = sorted((r.sample, round(r.score, 6)) for r in batch.collect() if r.sample < 1500 - 3 - 3)
    assert sorted((s, round(v, 6)) for _, s, v in found(1000)) == want
    assert sorted(s for t, s, v in found(0) if t is None and v is None) == [300, 400]


def test_decisions_with_events_before_their_anchor(spark, tmp_path):
    rows = [("r", "event", 105, 0), ("r", "anchor", 100, 4), ("r", "event", 101, 0)]
    later = [("r", "event", 110, 0), ("r", "anchor", 300, 2), ("r", "event", 310, 0)]
    end = [("r", "clock", 5000, 0)]
    schema = "recording_id string, kind string, sample bigint, code int"
    folder = str(tmp_path / "rows")
    write_each([spark.createDataFrame(p, schema) for p in (rows, later, end)], folder)
    out = processors.decide_stream(st.read_stream(spark, folder, schema, 1), 0, 10, 3, 100.0, "2 seconds")
    got = sorted(tuple(r) for r in st.run_available(out).collect())
    assert got == [("r", 100, 4, "TRIGGER", 3, 110), ("r", 300, 2, "NO_TRIGGER", 1, None)]


def test_zero_phase_is_refused_in_a_stream():
    from tracewell.operators.signal import Cleaning
    from tracewell.streaming import processors

    with pytest.raises(ValueError, match="zero phase"):
        processors.detect_stream(None, None, 5, Cleaning(30_000.0, 300.0, "zero_phase", True))
