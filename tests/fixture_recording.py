"""A small deterministic recording with planted spikes of one target and two interferers."""

import numpy as np

FS, N, C, T, OFF = 2000.0, 6000, 6, 13, 4


def shapes():
    k = np.arange(T) - OFF
    pulse = np.exp(-0.5 * (k / 1.5) ** 2) - 0.5 * np.exp(-0.5 * ((k - 4) / 2.0) ** 2)
    broad = np.exp(-0.5 * ((k - 1) / 2.5) ** 2)
    late = np.exp(-0.5 * ((k - 3) / 1.2) ** 2) - 0.6 * np.exp(-0.5 * ((k + 1) / 1.5) ** 2)
    place = lambda centre: np.exp(-0.5 * ((np.arange(C) - centre) / 1.0) ** 2)
    return {0: -60 * np.outer(pulse, place(1)), 1: -200 * np.outer(broad, place(2.5)), 2: 180 * np.outer(late, place(4))}


def recording():
    """(samples x channels) int values and {unit: spike times}."""
    rng = np.random.default_rng(4)
    x = rng.normal(0, 4, (N, C))
    x[1:] += 0.4 * x[:-1]
    x[:, 1:] += 0.3 * x[:, :-1]
    grid = rng.permutation(np.arange(30, N - 40, 37))
    times = {0: np.sort(grid[:40]), 1: np.sort(grid[40:75]), 2: np.sort(grid[75:105])}
    for unit, shape in shapes().items():
        for t in times[unit]:
            x[t - OFF : t - OFF + T] += shape
    # Spikes too close to the ends, to be left out of every average.
    times[0] = np.concatenate([[0], times[0], [N - 1]])
    return np.round(x).astype(int), times


def long_frame(spark, x, name="r", start=0):
    rows = [(name, start + n, c, int(x[n, c])) for n in range(x.shape[0]) for c in range(x.shape[1])]
    return spark.createDataFrame(rows, "recording_id string, sample bigint, channel int, value int")


def spike_frame(spark, times, name="r"):
    rows = [(name, int(t), u) for u, ts in times.items() for t in ts]
    return spark.createDataFrame(rows, "recording_id string, spike_time bigint, unit_id bigint")
