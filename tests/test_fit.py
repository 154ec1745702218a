import numpy as np
import pytest
from pyspark.sql import functions as F

import fixture_recording as fx
import reference_steps as ref
from tracewell.operators import learned, signal as sg, solve, sweep, templates as tp
from tracewell.plans import fit as plans
from tracewell.sources import chunks as ch

L = 300
SETTINGS = plans.FitSettings(fx.T, fx.OFF, 3)


@pytest.fixture(scope="module")
def made(spark):
    x, times = fx.recording()
    chunks = ch.pack(fx.long_frame(spark, x), L).persist()
    spikes = fx.spike_frame(spark, times).persist()
    targets = spark.createDataFrame([("r", 0)], "recording_id string, target_id bigint")
    rivals = spark.createDataFrame([("r", 0, 1), ("r", 0, 2)], "recording_id string, target_id bigint, unit_id bigint")
    return x, times, chunks, spikes, targets, rivals


def direct_fit(x, times, n_channels=3, ridge=1e-3):
    """The same fit written out sequentially."""
    n = len(x)
    wf = {}
    for u, ts in times.items():
        ok = [t for t in ts if fx.OFF < t < n - fx.T + fx.OFF]
        wf[u] = np.mean([x[t - fx.OFF : t - fx.OFF + fx.T] for t in ok], axis=0)
    e = {u: (w**2).sum(axis=0) for u, w in wf.items()}
    ratio = np.where(e[0] >= 0.05 * e[0].max(), e[0] / (np.maximum(e[1], e[2]) + 1e-9), -np.inf)
    chans = sorted(range(fx.C), key=lambda c: (-ratio[c], c))[:n_channels]
    busy = np.zeros(n, dtype=bool)
    for ts in times.values():
        for t in ts:
            busy[max(0, t - fx.OFF) : min(n, t + fx.T - 1 + fx.OFF)] = True
    segments, i = [], 0
    while i < n:
        j = i
        while j < n and not busy[j]:
            j += 1
        if j - i >= 2 * fx.T:
            segments.append((i, j))
        i = max(j, i + 1)
    stats = np.array([[[ref.cross_covariance(x[:, l].astype(float), x[:, a].astype(float), lag, segments) for l in chans] for a in chans] for lag in range(fx.T)])
    R = solve.assemble(stats, "reference")
    C = np.array([wf[u][:, chans].T.ravel() for u in (0, 1, 2)]).T
    f = solve.constrained_filter(R, C, ridge)
    return chans, stats, f.reshape(n_channels, fx.T).T


def test_fit_equals_the_sequential_one(spark, made):
    x, times, chunks, spikes, targets, rivals = made
    result = plans.fit(chunks, L, spikes, targets, rivals, SETTINGS)
    chans, stats, taps = direct_fit(x, times)
    row = result.filters.first()
    assert row.channels == chans and row.left_margin == 6
    got = np.zeros_like(stats)
    for r in result.products.collect():
        got[r.lag, chans.index(r.early), chans.index(r.late)] = r.value
    assert np.allclose(got, stats, rtol=1e-9, atol=1e-9)
    assert np.allclose(np.array(row.taps).reshape(fx.T, 3), taps, rtol=1e-6, atol=1e-9)
    gains = {r.unit_id: r.gain for r in solve.gains(result.filters, result.waveforms, rivals).collect()}
    assert np.isclose(gains[0], 1) and abs(gains[1]) < 1e-9 and abs(gains[2]) < 1e-9


def test_targets_that_cannot_be_fitted_are_named(spark, made):
    x, times, chunks, spikes, targets, rivals = made
    asked = targets.unionByName(spark.createDataFrame([("r", 9), ("r", 8)], "recording_id string, target_id bigint"))
    edge_only = spikes.unionByName(spark.createDataFrame([("r", 0, 8)], "recording_id string, spike_time bigint, unit_id bigint"))
    result = plans.fit(chunks, L, edge_only, asked, rivals, SETTINGS)
    got = {r.target_id: r.reason for r in plans.problems(result, asked, edge_only).collect()}
    assert got == {8: "no usable spikes", 9: "no spikes"}
    with pytest.raises(ValueError, match="no usable spikes"):
        plans.require_filters(result, asked, edge_only)


def test_chunk_length_does_not_change_the_fit(spark, made):
    x, _, chunks, spikes, targets, rivals = made
    a = plans.fit(chunks, L, spikes, targets, rivals, SETTINGS).filters.first()
    other = ch.pack(fx.long_frame(spark, x), 57)
    b = plans.fit(other, 57, spikes, targets, rivals, SETTINGS).filters.first()
    assert a.channels == b.channels and np.allclose(a.taps, b.taps, rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("suppression", ["window", "priority"])
def test_calibration_finds_the_planted_spikes(spark, made, suppression):
    x, times, chunks, spikes, targets, rivals = made
    inner = spikes.where(f"spike_time > {fx.T} and spike_time < {fx.N - fx.T}")
    asked = targets.unionByName(targets.withColumn("target_id", F.lit(99).cast("bigint")))
    filters, curve, failed = plans.calibrate(chunks, L, inner, asked, rivals, fx.FS, SETTINGS, suppression=suppression)
    assert [(r.target_id, r.reason) for r in failed.collect()] == [(99, "no spikes")]
    best = curve.orderBy(F.desc("f1")).first()
    assert best.recall >= 0.95 and best.precision >= 0.95
    assert filters.first().threshold is not None and curve.count() == 60


def test_data_fractions(spark, made):
    _, _, chunks, spikes, targets, rivals = made
    out = plans.data_fractions(chunks, L, spikes, targets, rivals, fx.FS, 0.6, (0.4, 0.6), SETTINGS).collect()
    assert sorted(r.train_fraction for r in out) == [0.4, 0.6]
    assert all(r.recall >= 0.9 for r in out)
    assert {r.train_fraction: round(r.test_s, 3) for r in out} == {0.4: 1.8, 0.6: 1.2}


def test_cap_keeps_exactly_n_of_a_hot_unit(spark):
    spikes = spark.range(6003).selectExpr("'r' as recording_id", "id as spike_time", "case when id < 2001 then 1 else 2 + id % 3 end as unit_id")
    capped = tp.cap_per_group(spikes, ["recording_id", "unit_id"], 2000, tp.hash_order(0, "spike_time"))
    counts = {r.unit_id: r["count"] for r in capped.groupBy("unit_id").count().collect()}
    assert counts[1] == 2000 and counts[2] == 1334
    again = tp.cap_per_group(spikes.repartition(7), ["recording_id", "unit_id"], 2000, tp.hash_order(0, "spike_time"))
    assert capped.exceptAll(again).count() == 0


def test_learned_filter_separates_the_units(spark, made):
    x, times, chunks, spikes, targets, rivals = made
    cut = tp.snippets(chunks, L, spikes, fx.T, fx.OFF).persist()
    noise = tp.snippets(chunks, L, learned.noise_centres(spikes, tp.lengths_of(chunks), fx.T, fx.OFF, 200), fx.T, fx.OFF)
    pos, rival = cut.where("unit_id = 0"), cut.where("unit_id > 0")
    more = learned.augment(pos, 30, fx.T, seed=1, noise_std=1.0).select("values")
    mixed = learned.overlay(pos, rival, 30, fx.T, seed=2, max_shift=3)
    assert more.count() == 30 and mixed.count() == 30
    model = learned.train_with_mining(pos.select("values").union(more), rival.select("values").union(noise.select("values")), rival, rounds=2, reg=0.01, max_iter=40)
    rows = pos.withColumn("label", F.lit(1.0)).unionByName(rival.withColumn("label", F.lit(0.0)))
    shares = {r.label: r.share_above_0 for r in learned.diagnostics(rows, model.coefficients.toArray(), model.intercept).collect()}
    assert shares[1.0] >= 0.9 and shares[0.0] <= 0.1


def test_roll_is_a_wrapped_shift(spark):
    df = spark.createDataFrame([(list(map(float, range(8))), s) for s in (-5, -1, 0, 2, 4)], "v array<double>, s int")
    for r in df.withColumn("o", learned.roll(F.col("v"), 4, F.col("s"))).collect():
        assert r.o == np.roll(np.array(r.v).reshape(2, 4), r.s, axis=1).ravel().tolist()


def test_robust_threshold_falls_back_to_all_samples(spark):
    trace = spark.createDataFrame([("r", i, float(i)) for i in range(6)], "recording_id string, sample bigint, score double")
    everywhere = spark.createDataFrame([("r", 3)], "recording_id string, spike_time bigint")
    row = sweep.robust_threshold(trace, ["recording_id"], everywhere, 20, 4).first()
    assert row["median"] == 2.5 and row["mad"] == 1.5


def test_noise_centres_of_a_day_without_spikes(spark):
    from tracewell.operators.learned import noise_centres

    spikes = spark.createDataFrame([("a", 1_000_000_000, 1), ("b", 50, 1)], "recording_id string, spike_time bigint, unit_id bigint")
    lengths = spark.createDataFrame([("a", 2_600_000_000), ("b", 120)], "recording_id string, n_samples bigint")
    got = noise_centres(spikes, lengths, 10, 3, 1000).collect()
    a = sorted(r.spike_time for r in got if r.recording_id == "a")
    assert len(a) == len(set(a)) == 1000 and a[0] > 3 and a[-1] < 2_600_000_000 - 7
    assert not any(1_000_000_000 - 13 <= t < 1_000_000_000 + 13 for t in a)
    # fewer free samples than wanted: all of them
    assert sorted(r.spike_time for r in got if r.recording_id == "b") == [t for t in range(4, 113) if not 37 <= t < 63]


def test_fractions_keep_any_recording_id(spark, made):
    _, _, chunks, spikes, targets, rivals = made
    rename = lambda df: df.withColumn("recording_id", F.lit("1:lab@r"))
    out = plans.data_fractions(*(chunks.transform(rename), L, *map(rename, (spikes, targets, rivals))), fx.FS, 0.6, (0.5,), SETTINGS)
    assert {r.recording_id for r in out.collect()} == {"1:lab@r"}


def test_nearest_units_sees_quiet_neighbours(spark):
    from tracewell.operators import templates

    ranked = spark.createDataFrame([("r", u, 100 - u, u + 1) for u in range(60)], "recording_id string, unit_id bigint, n_spikes bigint, activity_rank int")
    peaks = spark.createDataFrame([("r", u, 0 if u in (0, 59) else u) for u in range(60)], "recording_id string, unit_id bigint, channel int")
    sites = spark.createDataFrame([("r", c, 0.0, 20.0 * c) for c in range(60)], "recording_id string, channel int, x double, y double")
    target = spark.createDataFrame([("r", 0)], "recording_id string, target_id bigint")
    assert [r.unit_id for r in templates.nearest_units(ranked, target, peaks, sites, 1).collect()] == [59]
    assert [r.unit_id for r in templates.nearest_units(ranked, target, peaks, sites, 1, pool=10).collect()] == [1]


def test_hinge_fit_reaches_the_optimum_from_any_start(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 12))
    y = np.where(x @ rng.normal(size=12) + 0.3 * rng.normal(size=400) > 0, 1.0, 0.0)
    weight = np.where(y == 1, 2.0, 1.0)
    rows = spark.createDataFrame(
        [(v.tolist(), float(a), float(w)) for v, a, w in zip(x, y, weight)], "values array<double>, label double, weight double"
    ).repartition(5)
    cold = learned.fit_hinge(rows, 12, reg=0.01)

    def loss_and_slope(p):
        sign = 2 * y - 1
        short = np.maximum(0, 1 - sign * (x @ p[:12] + p[12]))
        slope = -2 * weight * sign * short / weight.sum()
        return (weight * short**2).sum() / weight.sum() + 0.005 * p[:12] @ p[:12], np.append(slope @ x + 0.01 * p[:12], slope.sum())

    at = np.append(cold.weights, cold.bias)
    loss, slope = loss_and_slope(at)
    assert cold.loss == pytest.approx(loss) and np.abs(slope).max() < 1e-5
    # any other point is worse: the loss is convex
    assert all(loss_and_slope(at + 0.01 * rng.normal(size=13))[0] > loss for _ in range(20))
    taps = (cold.weights * 1.02).reshape(3, 4).T.ravel()
    warm = learned.fit_hinge(rows, 12, reg=0.01, start=(learned.weights_from_taps(taps, 3, 4), cold.bias))
    assert warm.loss == pytest.approx(cold.loss, abs=1e-9) and warm.rounds < cold.rounds
    bounded = learned.fit_hinge(rows, 12, reg=0.01, max_rounds=3)
    assert bounded.rounds == 3 and bounded.loss > cold.loss


def lag_products(taps, width, n=6000, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) @ rng.normal(size=(width, width))
    for k in range(1, 4):
        x[k:] += 0.5**k * x[:-k]
    return np.array([x[: n - m].T @ x[m:] / n for m in range(taps)]), rng


@pytest.mark.parametrize("orientation", ["reference", "flattened"])
@pytest.mark.parametrize("taps,width", [(1, 3), (2, 1), (15, 5), (31, 12)])
def test_block_toeplitz_solve_equals_the_dense_one(taps, width, orientation):
    from tracewell.operators import solve

    products, rng = lag_products(taps, width)
    R = solve.assemble(products, orientation)
    loaded = R + np.eye(len(R)) * (1e-3 * np.trace(R) / len(R))
    v = rng.normal(size=(len(R), min(3, len(R))))
    blocks = solve.BlockToeplitz(products, orientation, 1e-3)
    assert np.allclose(blocks @ v, loaded @ v, rtol=1e-11, atol=1e-9 * np.abs(loaded).max())
    C = rng.normal(size=(len(R), min(2, len(R))))
    want = solve.constrained_filter(R, C, 1e-3)
    assert np.allclose(solve.constrained_filter_of(products, C, 1e-3, orientation, dense=0), want, rtol=1e-8, atol=1e-10 * np.abs(want).max())


def test_wide_probe_within_a_fixed_memory():
    import tracemalloc

    from tracewell.operators import solve

    products, rng = lag_products(61, 96, n=9000)
    C = rng.normal(size=(61 * 96, 3))
    tracemalloc.start()
    found = solve.constrained_filter_of(products, C, 1e-3, "flattened")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(C.T @ found, [1, 0, 0], atol=1e-8)
    assert peak < 100e6 < (61 * 96) ** 2 * 8


def test_an_indefinite_matrix_is_still_solved():
    from tracewell.operators import solve

    products, rng = lag_products(9, 3)
    products[0] -= 3 * np.eye(3) * products[0].max()
    C = rng.normal(size=(27, 2))
    want = solve.constrained_filter(solve.assemble(products, "reference"), C, 0.0)
    assert np.allclose(solve.constrained_filter_of(products, C, 0.0, "reference", dense=0), want)
