import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import reference_steps as ref
from tracewell.functions import kernels as kn
from tracewell.operators.peaks import settle
from tracewell.operators.solve import assemble, constrained_filter


@pytest.mark.parametrize("n", [1, 127, 128, 129, 700])
def test_recursive_filter_equals_sample_by_sample(n):
    x = np.random.default_rng(n).normal(size=(n, 3)) * 100
    b, a = kn.highpass_coefficients(300, 30000)
    start = np.random.default_rng(1).normal(size=(2, 3))
    y, state = kn.recursive_filter(x, b, a, start)
    want, end = ref.biquad(x, b, a, start)
    assert np.allclose(y, want, atol=1e-9) and np.allclose(state, end, atol=1e-9)


def test_state_carries_over_any_split():
    x = np.random.default_rng(0).normal(size=(1000, 2))
    b, a = kn.highpass_coefficients(300, 30000)
    whole, _ = kn.recursive_filter(x, b, a)
    for cut in (1, 128, 333, 999):
        first, state = kn.recursive_filter(x[:cut], b, a)
        second, _ = kn.recursive_filter(x[cut:], b, a, state)
        assert np.allclose(np.concatenate([first, second]), whole, atol=1e-12)


def test_highpass_removes_a_constant_and_keeps_high_frequencies():
    b, a = kn.highpass_coefficients(300, 30000)
    y, _ = kn.recursive_filter(np.ones((5000, 1)), b, a)
    assert abs(y[-1, 0]) < 1e-12
    tone = np.sin(np.arange(5000) * 2 * np.pi * 6000 / 30000)[:, None]
    y, _ = kn.recursive_filter(tone, b, a)
    assert np.allclose(y[2000:], tone[2000:], atol=0.1)
    zero, _ = kn.zero_phase_filter(tone, b, a, True, True), None
    assert np.allclose(zero[500:-500], tone[500:-500], atol=0.02)


def test_settling_time_is_enough():
    b, a = kn.highpass_coefficients(300, 30000)
    n = kn.settling_samples(a)
    assert 800 < n < 1000
    y, _ = kn.recursive_filter(np.zeros((n, 1)), b, a, np.ones((2, 1)))
    assert abs(y[-1, 0]) < 1e-15


def test_correlate_matches_convolution():
    rng = np.random.default_rng(3)
    x, f = rng.normal(size=(200, 2)), rng.normal(size=(7, 2))
    want = sum(np.convolve(x[:, c], f[::-1, c], mode="same") for c in range(2))
    assert np.allclose(kn.correlate(x, f, 3), want)


@given(st.lists(st.integers(0, 6), min_size=1, max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_window_mask(values, m):
    mask = kn.window_peak_mask(np.array(values, dtype=float), m)
    assert np.flatnonzero(mask).tolist() == ref.window_peaks(values, m)


@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_settle_decides_everything_it_can_see(scores, distance):
    at = np.arange(len(scores)) * 2
    state = settle(at, np.array(scores, dtype=float), -100, 1000, distance)
    assert at[state == 1].tolist() == ref.priority(at, scores, distance)


def test_assembled_matrix_and_constraints():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 2))
    x[1:, 1] += 0.7 * x[:-1, 0]
    T, segments = 4, [(0, 900), (1000, 2500), (3000, 4000)]
    stats = np.array([[[ref.cross_covariance(x[:, l], x[:, e], lag, segments) for l in range(2)] for e in range(2)] for lag in range(T)])
    for orientation, sign in (("reference", 1), ("flattened", -1)):
        R = assemble(stats, orientation)
        for a in range(T):
            for b in range(T):
                want = ref.cross_covariance(x[:, 1], x[:, 0], sign * (b - a), segments)
                assert np.isclose(R[T + a, b], want), (orientation, a, b)
        assert np.allclose(R, R.T)
    C = rng.normal(size=(2 * T, 3))
    f = constrained_filter(R, C, 1e-3)
    assert np.allclose(C.T @ f, [1, 0, 0], atol=1e-9)


@pytest.mark.parametrize("n,length,left", [(1, 1, 0), (50, 7, 3), (5000, 61, 20), (3001, 61, 60), (2048, 5, 0), (0, 5, 2)])
def test_shared_correlation_equals_the_direct_one(n, length, left):
    from tracewell.functions.kernels import SharedCorrelation, correlate

    rng = np.random.default_rng(n + length)
    x = rng.normal(size=(n, 6))
    shared = SharedCorrelation(x, length)
    for columns in ([0], [4, 1, 2]):
        taps = rng.normal(size=(length, len(columns)))
        assert np.allclose(shared(np.array(columns), taps, left), correlate(x[:, columns], taps, left) if n else [], atol=1e-10)
