"""Sources, sinks, late rows and the two-stream decision of live queries."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixture_recording as fx
from tracewell.operators import signal as sg
from tracewell.operators.signal import CHUNK_SCHEMA, Cleaning
from tracewell.sources import chunks as ch
from tracewell.sources.raw import RawStreamReader, register
from tracewell.streaming import chunks as st, processors, sinks

ROWS = "recording_id string, kind string, sample bigint, code int"
FILTER = "recording_id string, target_id bigint, channels array<int>, taps array<double>, left_margin int, threshold double"


def write_parts(folder, name, x, starts):
    os.makedirs(f"{folder}/{name}", exist_ok=True)
    for a, b in starts:
        x[a:b].astype("<i2").tofile(f"{folder}/{name}/part-{a}.bin")


def write_each(spark, parts, schema, folder):
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(folder)


def offsets(reader, before):
    after = reader.latestOffset()
    got = [(b["recording_id"][0].as_py(), b["start_sample"][0].as_py(), b["n_samples"][0].as_py())
           for part in reader.partitions(before, after) for b in reader.read(part)]
    return after, sorted(got)


def test_source_offsets_errors_gaps_and_bounds(tmp_path):
    x = np.arange(1000).reshape(-1, 2)
    folder = str(tmp_path / "raw")
    write_parts(folder, "a", x, [(0, 100), (100, 150)])
    reader = RawStreamReader({"path": folder, "n_channels": "2", "fetch_samples": "60", "max_samples": "120"})
    at, got = offsets(reader, reader.initialOffset())
    assert at == {"a": 120} and got == [("a", 0, 60), ("a", 60, 40), ("a", 100, 20)]
    at, got = offsets(reader, at)
    assert at == {"a": 150} and got == [("a", 120, 30)]
    assert offsets(reader, at) == ({"a": 150}, [])  # an empty poll
    reader.raw.path, kept = "/nowhere", reader.raw.path
    assert reader.latestOffset() == {"a": 150}  # an error: the same offset again
    reader.raw.path = kept
    # old parts went, the next one begins later; a second recording appears
    for part in os.listdir(f"{folder}/a"):
        os.remove(f"{folder}/a/{part}")
    write_parts(folder, "a", x, [(200, 230)])
    write_parts(folder, "b", x, [(0, 10)])
    at, got = offsets(reader, at)
    assert at == {"a": 230, "b": 10} and got == [("a", 200, 30), ("b", 0, 10)]
    # a recording starts anew: its head is behind the offset
    os.remove(f"{folder}/a/part-200.bin")
    write_parts(folder, "a", x, [(0, 40)])
    at, got = offsets(reader, at)
    assert at["a"] == 40 and got == []
    assert RawStreamReader({"path": folder, "n_channels": "2", "start": "head"}).initialOffset() == {"a": 40, "b": 10}


def test_growing_recording_is_read_once(spark, tmp_path):
    x = np.arange(800).reshape(-1, 2) % 300
    folder, out, check = (str(tmp_path / n) for n in ("raw", "out", "check"))
    write_parts(folder, "a", x, [(0, 100)])
    stream = register(spark).readStream.format("interleaved16").options(n_channels=2, chunk_samples=50, max_samples=70).load(folder)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
        .trigger(processingTime="200 milliseconds").start()
    )

    def wait_for(n):
        deadline = time.time() + 60
        while time.time() < deadline:
            time.sleep(0.5)
            if os.path.isdir(f"{out}/_spark_metadata"):
                if spark.read.schema(stream.schema).parquet(out).agg(F.sum("n_samples")).first()[0] == n:
                    return

    wait_for(100)
    write_parts(folder, "a", x, [(100, 400)])
    wait_for(400)
    batches = query.lastProgress.batchId
    query.stop()
    rows = spark.read.parquet(out).orderBy("start_sample").collect()
    assert np.concatenate([r["values"] for r in rows]).tolist() == x.ravel().tolist()
    assert batches >= 3  # the bound cuts what waits into several batches


def lines_of(spark, folder):
    return sorted(r.value for r in sinks.read_lines(spark, folder).collect())


def test_each_line_once_whatever_fails(spark, tmp_path):
    folder, check, rows, flag = (str(tmp_path / n) for n in ("lines", "check", "rows", "flag"))
    write_each(spark, [[(k,) for k in range(lo, lo + 20)] for lo in (0, 20, 40)], "sample long", rows)

    def fail_once(batches):
        for batch in batches:
            yield batch
            if int(batch.column(0)[0].as_py()) >= 20 and not os.path.exists(flag):
                open(flag, "w").close()
                raise RuntimeError("planted")

    stream = sinks.spike_lines(st.read_stream(spark, rows, "sample long", 1)).mapInArrow(fail_once, "value string")
    with pytest.raises(Exception, match="planted"):
        sinks.start_lines(stream, folder, check).awaitTermination()
    sinks.start_lines(stream, folder, check).awaitTermination()
    assert lines_of(spark, folder) == sorted(map(str, range(60)))
    sinks.start_lines(stream, folder, check).awaitTermination()  # nothing new
    assert len(lines_of(spark, folder)) == 60
    assert sinks.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_a_batch_that_runs_again_replaces_its_lines(spark, tmp_path):
    import pyarrow as pa

    writer = sinks.LineWriter(str(tmp_path / "lines"))
    batch = pa.record_batch([pa.array(["1,20", None, "2,40"])], ["value"])
    writer.commit([writer.write(iter([batch])), writer.write(iter([])), None], 0)
    writer.abort([writer.write(iter([batch])), None], 1)
    writer.commit([writer.write(iter([batch]))], 0)
    assert lines_of(spark, str(tmp_path / "lines")) == ["1,20", "2,40"]


def test_late_rows_and_the_rest_are_all_rows(spark, tmp_path):
    first = [("r", "anchor", 100, 4), ("r", "event", 101, 0), ("r", "clock", 150, 0)]
    later = [("r", "event", 105, 0), ("r", "anchor", 104, 7), ("r", "event", 131, 0), ("r", "clock", 190, 0), ("s", "event", 3, 0)]
    last = [("r", "event", 132, 0), ("r", "anchor", 185, 2), ("r", "clock", 400, 0), ("s", "anchor", 1, 9), ("s", "clock", 90, 0)]
    folder = str(tmp_path / "rows")
    write_each(spark, [first, later, last], ROWS, folder)
    out = st.run_available(processors.decide_stream(st.read_stream(spark, folder, ROWS, 1), 0, 30, 2, 100.0, 20))
    late = sorted(tuple(r) for r in processors.late_rows(out).collect())
    assert late == [("r", 104, 7), ("r", 105, 0), ("r", 132, 0)]
    got = sorted(tuple(r) for r in processors.decided(out).collect())
    # 100 .. 130 holds 101 only: 105 was late; s has no time of its own before 90
    assert got == [("r", 100, 4, "NO_TRIGGER", 1, None), ("r", 185, 2, "NO_TRIGGER", 0, None), ("s", 1, 9, "NO_TRIGGER", 1, None)]
    anchors = [r for part in (first, later, last) for r in part if r[1] == "anchor"]
    assert len(anchors) == len(got) + sum(code in (4, 7, 2, 9) for _, _, code in late)


def test_silent_recordings_close_their_windows(spark, tmp_path):
    folder, out = str(tmp_path / "rows"), str(tmp_path / "out")
    write_each(spark, [[("r", "anchor", 100, 4), ("r", "event", 101, 0)]], ROWS, folder)
    found = processors.decide_stream(st.read_stream(spark, folder, ROWS), 0, 30, 2, 100.0, 20, idle_ms=500)
    query = (
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check"))
        .trigger(processingTime="300 milliseconds").start()
    )
    deadline, got = time.time() + 60, []
    while time.time() < deadline and not got:
        time.sleep(1)
        if os.path.isdir(f"{out}/_spark_metadata"):
            got = [tuple(r) for r in spark.read.schema(processors.DECISIONS).parquet(out).collect()]
    query.stop()
    assert got == [("r", 100, 4, "NO_TRIGGER", 1, None)]


def test_two_clocks(spark, tmp_path):
    """Onsets wait for their edge, and one whose edge is forgotten is late."""
    row = lambda kind, sample, code, source, clock, seq: ("r", kind, sample, code, source, clock, seq)
    parts = [
        [row("onset", 5, 3, 1, None, 2), row("edge", 100, None, 0, 90, 1), row("event", 207, None, 0, 207, 2)],
        [row("edge", 200, None, 0, 190, 2), row("event", 209, None, 0, 209, 2), row("mark", 0, None, 1, None, 2)],
        [row("edge", 300, None, 0, 290, 3), row("edge", 900, None, 0, 890, 4), row("mark", 0, None, 1, None, 4)],
        [row("onset", 1, 8, 1, None, 1), row("onset", 2, 6, 1, None, 4), row("clock", None, None, 0, 5000, None)],
        [row("clock", None, None, 1, 5000, None)],
    ]
    folder = str(tmp_path / "rows")
    write_each(spark, parts, processors.LIVE_ROWS, folder)
    stream = st.read_stream(spark, folder, processors.LIVE_ROWS, 1)
    out = st.run_available(processors.decide_aligned_stream(stream, 0, 10, 2, 100.0, 50))
    got = sorted((tuple(r)[1:] for r in out.collect()), key=str)
    assert got == [(205, 3, "TRIGGER", 2, 209), (902, 6, "NO_TRIGGER", 0, None), (None, 8, "LATE", None, None)]


def test_stamps_and_held_chunks(spark, tmp_path):
    x, _ = fx.recording()
    x = x[:1500]
    rng = np.random.default_rng(3)
    bits = (rng.random(1500) < 0.5).astype(int)
    bits[:90] = 0
    long = fx.long_frame(spark, x)
    taps = rng.integers(-3, 4, (7, 2))
    filters = spark.createDataFrame([("r", 1, [2, 4], [float(v) for v in taps.ravel()], 3, -50.0)], FILTER)
    cleaning = Cleaning(fx.FS, 300.0, "causal", True)
    sync = spark.createDataFrame([(k, bits[k * 100 : (k + 1) * 100].tolist()) for k in range(15)], "chunk_id bigint, sync array<int>")
    pieces = ch.pack(long, 100).join(sync, "chunk_id").select("recording_id", "chunk_id", "start_sample", "n_samples", "channels", "values", "sync").persist()
    folder = str(tmp_path / "in")
    for part in ("chunk_id < 3", "chunk_id between 5 and 8", "chunk_id in (3, 4)", "chunk_id > 8"):
        pieces.where(part).coalesce(1).write.mode("append").parquet(folder)
    stream = st.read_stream(spark, folder, CHUNK_SCHEMA + ", sync array<int>", 1)
    out = st.run_available(processors.detect_stream(stream, filters, 7, cleaning, suppress=3, lateness=1000, sync=True)).collect()
    edges = np.flatnonzero((bits[1:] == 1) & (bits[:-1] == 0)) + 1
    assert sorted((r.sample, r.edge_seq) for r in out if r.kind == "edge") == [(int(s), k) for k, s in enumerate(edges, 1)]
    peaks = sorted((r.sample, r.edge_sample, r.edge_seq) for r in out if r.kind == "peak")
    batch = sg.detect(ch.pack(long, 100), 100, filters, 7, cleaning, suppress=3).collect()
    want = []
    for s in sorted(r.sample for r in batch if r.sample < 1500 - 6):
        k = int(np.searchsorted(edges, s, side="right"))
        want.append((s, int(edges[k - 1]) if k else None, k or None))
    assert peaks == want and any(k is None for *_, k in want)


def test_held_chunks_go_on_when_nothing_comes(spark, tmp_path):
    x, _ = fx.recording()
    long = fx.long_frame(spark, x[:900])
    filters = spark.createDataFrame([("r", 1, [2], [1.0, 2.0, 1.0], 1, -1e9)], FILTER)
    pieces = ch.pack(long, 100).where("chunk_id != 4")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    pieces.coalesce(1).write.parquet(folder)
    found = processors.detect_stream(
        st.read_stream(spark, folder, CHUNK_SCHEMA), filters, 3, Cleaning(highpass=None, reference=False), suppress=1,
        lateness=10_000, idle_ms=500,
    )
    query = (
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check"))
        .trigger(processingTime="300 milliseconds").start()
    )
    batch = sg.detect(pieces, 100, filters, 3, Cleaning(highpass=None, reference=False), suppress=1).collect()
    ends = {400 - 1, 400 - 2, 900 - 1, 900 - 2}
    want = sorted(r.sample for r in batch if r.sample not in ends)
    deadline, got = time.time() + 60, []
    while time.time() < deadline and len(got) < len(want):
        time.sleep(1)
        if os.path.isdir(f"{out}/_spark_metadata"):
            got = sorted(r.sample for r in spark.read.schema(found.schema).parquet(out).collect())
    query.stop()
    assert got == want




def test_many_short_recordings_are_few_tasks(tmp_path):
    folder = str(tmp_path / "raw")
    x = np.arange(24).reshape(-1, 2)
    for k in range(200):
        write_parts(folder, f"r{k:03}", x + k, [(0, 5), (5, 12)])
    reader = RawStreamReader({"path": folder, "n_channels": "2", "fetch_samples": "4"})
    parts = reader.partitions(start := reader.initialOffset(), reader.latestOffset())
    assert len(parts) <= 10
    got = [(b["recording_id"][0].as_py(), b["start_sample"][0].as_py(), b["values"][0].as_py()) for p in parts for b in reader.read(p)]
    want = [(f"r{k:03}", a, (x + k)[a:b].ravel().tolist()) for k in range(200) for a, b in ((0, 4), (4, 5), (5, 9), (9, 12))]
    assert sorted(got) == want and start == {}


def test_consecutive_chunks_are_one_raw_part(spark, tmp_path):
    from catalog.files import write_raw

    folder = str(tmp_path / "raw")
    rows = [("a", k, 10 * k, 10, [0], [float(v) for v in range(10 * k, 10 * k + 10)]) for k in (0, 1, 2, 5, 6, 64, 65)]
    schema = "recording_id string, chunk_id bigint, start_sample bigint, n_samples int, channels array<int>, values array<double>"
    write_raw(spark.createDataFrame(rows, schema).repartition(4), folder)
    read = {name: np.fromfile(f"{folder}/a/{name}", "<i2").tolist() for name in os.listdir(f"{folder}/a")}
    assert read == {
        "part-0.bin": [*range(30)], "part-50.bin": [*range(50, 70)], "part-640.bin": [*range(640, 660)],
    }
