"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Besides the table queries it scans one generated raw recording (96 channels, 30 kHz) and
reports how many seconds of signal one wall-clock second cleans, filters and searches.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog.all  # noqa: E402,F401
from catalog.registry import QUERIES  # noqa: E402
from tracewell.functions.kernels import highpass_coefficients, settling_samples  # noqa: E402
from tracewell.operators import signal  # noqa: E402
from tracewell.session import build_session, scratch_path  # noqa: E402
from tracewell.sources.files import resolve  # noqa: E402
from tracewell.sources.raw import register  # noqa: E402

HEADLINE = [
    "detector_eval",
    "threshold_sweep",
    "best_f1",
    "nms_window",
    "nms_priority",
    "run_peaks",
    "match_hits",
    "mad_threshold",
    "score_percentiles",
    "edge_asof",
    "debounce_onsets",
    "window_counts",
    "free_segments",
    "car_median",
    "highpass_causal",
    "clean_pipeline",
    "fir_trace",
    "snippet_average",
    "select_channels",
    "lag_covariance",
    "lcmv_gain",
]
FS, CHANNELS, SECONDS, CHUNK, TAPS = 30_000, 96, 60, 16_384, 61


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def generate(spark, folder: str) -> None:
    """One recording as raw int16 parts, each written by the task that made it."""

    def write(batches):
        import numpy as np

        system, inner = resolve(folder)
        system.create_dir(f"{inner}/probe", recursive=True)
        for batch in batches:
            for second in batch.column(0).to_pylist():
                x = np.random.default_rng(second).normal(0, 15, (FS, CHANNELS)).astype("<i2")
                with system.open_output_stream(f"{inner}/probe/part-{second * FS}.bin") as out:
                    out.write(x.tobytes())
        yield from ()

    spark.range(0, SECONDS, numPartitions=2 * SECONDS).mapInArrow(write, "done int").count()


def raw_detection(spark) -> float:
    folder = scratch_path(spark, "bench")
    generate(spark, folder)
    settle = settling_samples(highpass_coefficients(300.0, FS)[1])
    reach = TAPS - 1 + TAPS // 2
    reader = (
        register(spark).read.format("interleaved16")
        .option("n_channels", CHANNELS).option("chunk_samples", CHUNK).option("payload", "int16")
        .option("halo_before", settle + reach).option("halo_after", reach).option("chunks_per_task", 4)
    )
    taps = [((k * 7 + c * 3) % 11 - 5) / 50 for k in range(TAPS) for c in range(5)]
    filters = spark.createDataFrame(
        [("probe", 1, [10, 11, 12, 13, 14], taps, 30, 8.0)],
        "recording_id string, target_id bigint, channels array<int>, taps array<double>, left_margin int, threshold double",
    )
    cleaning = signal.Cleaning(float(FS), 300.0, "causal", True)
    # start the workers of the scan with its first chunks, read to their end
    run(reader.option("to_sample", 8 * CHUNK).load(folder))
    start = time.perf_counter()
    run(signal.detect(reader.option("to_sample", SECONDS * FS).load(folder), CHUNK, filters, TAPS, cleaning, haloed=True))
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus)
    run(QUERIES["detector_eval"](spark, sf_dir))  # start JVM and Python workers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
    raw = raw_detection(spark)
    seconds["detect_raw_recording"] = round(raw, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cpus,
                "signal_seconds_per_second": round(SECONDS / raw, 2),
                "signal_channels": CHANNELS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
