"""Small NumPy kernels applied to the (samples, channels) block of one chunk row."""

from __future__ import annotations

import math

import numpy as np

STEP = 64


def highpass_coefficients(fc: float, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth high-pass (bilinear transform, Q = 1/sqrt(2))."""
    w = 2 * math.pi * fc / fs
    slope = math.sin(w) / math.sqrt(2)
    scale = 1 / (1 + slope)
    gain = (1 + math.cos(w)) / 2 * scale
    b = np.array([gain, -2 * gain, gain])
    a = np.array([1.0, -2 * math.cos(w) * scale, (1 - slope) * scale])
    return b, a


def settling_samples(a: np.ndarray, tolerance: float = 1e-17) -> int:
    """Samples after which the influence of a past state is below the tolerance."""
    radius = max(abs(np.roots(a)))
    return int(math.ceil(math.log(tolerance) / math.log(radius)))


def recursive_filter(x, b, a, state=None):
    """Second-order recursion down the rows of x; returns (y, end state).

    Works on stretches of STEP rows as matrix products, so only one tiny state update per
    stretch is sequential. Any incoming state is carried exactly.
    """
    move = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    push = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    n, width = x.shape
    state = np.zeros((2, width)) if state is None else state
    powers = [np.eye(2)]
    for _ in range(STEP):
        powers.append(powers[-1] @ move)
    from_state = np.array([p[0] for p in powers[:STEP]])
    impulse = np.r_[b[0], [p[0] @ push for p in powers[: STEP - 1]]]
    lag = np.subtract.outer(np.arange(STEP), np.arange(STEP))
    spread = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
    gather = np.array([p @ push for p in powers[STEP - 1 :: -1]]).T
    y = np.empty((n, width))
    full = n // STEP
    if full:
        blocks = x[: full * STEP].reshape(full, STEP, width)
        local = np.matmul(spread, blocks)
        inflow = np.matmul(gather, blocks)
        states = np.empty((full, 2, width))
        for i in range(full):
            states[i] = state
            state = powers[STEP] @ state + inflow[i]
        y[: full * STEP] = (local + np.matmul(from_state, states)).reshape(-1, width)
    rest = n - full * STEP
    if rest:
        tail = x[full * STEP :]
        y[full * STEP :] = spread[:rest, :rest] @ tail + from_state[:rest] @ state
        state = powers[rest] @ state + gather[:, STEP - rest :] @ tail
    return y, state


def zero_phase_filter(x, b, a, starts: bool, ends: bool):
    """Forward and backward pass; true recording ends get odd extension by 9 samples."""
    pad = 9  # fixed value: three times the number of coefficients
    head = 2 * x[0] - x[pad:0:-1] if starts else x[:0]
    tail = 2 * x[-1] - x[-2 : -pad - 2 : -1] if ends else x[:0]
    whole = np.concatenate([head, x, tail])
    rest = np.array([-b[0], b[2]])[:, None]
    y, _ = recursive_filter(whole, b, a, rest * whole[0])
    y, _ = recursive_filter(y[::-1], b, a, rest * y[-1])
    y = y[::-1]
    return y[len(head) : len(y) - len(tail)]


def median_reference(x):
    """Subtract the median over channels (mean of the middle two) from every sample.

    Rows are short, so a full sort beats partial selection.
    """
    ranked = np.sort(x, axis=1)
    upper = x.shape[1] // 2
    lower = (x.shape[1] - 1) // 2
    return x - (ranked[:, lower : lower + 1] + ranked[:, upper : upper + 1]) / 2


def correlate(x, taps, left: int):
    """score[n] = sum of x[n - left + k] * taps[k] over k and channels; zeros outside."""
    length = taps.shape[0]
    padded = np.zeros((x.shape[0] + length - 1, x.shape[1]))
    padded[left : left + x.shape[0]] = x
    return sum(
        np.correlate(padded[:, c], taps[:, c], "valid") for c in range(taps.shape[1])
    )


class SharedCorrelation:
    """`correlate` for many filters of one stretch: overlapping frames whose transforms they share.

    The forward transforms are made once per channel; a filter costs one product and one inverse
    transform. Results are those of `correlate` up to rounding, so equal neighbours need not stay equal.
    """

    def __init__(self, x, length: int):
        self.n, self.length = len(x), length
        self.frame = max(1024, 1 << (8 * length - 1).bit_length())
        self.step = self.frame - length + 1
        count = -(-max(self.n, 1) // self.step)
        padded = np.zeros((length - 1 + count * self.step + length - 1, x.shape[1]))
        padded[length - 1 : length - 1 + self.n] = x
        starts = np.arange(count) * self.step
        frames = np.stack([padded[a : a + self.frame] for a in starts])
        self.spectra = np.fft.rfft(frames, axis=1)

    def __call__(self, columns, taps, left: int):
        """score[n] = sum of x[n - left + k, columns] * taps[k]; zeros outside."""
        response = np.fft.rfft(taps, self.frame, axis=0).conj()
        together = np.einsum("fwc,wc->fw", self.spectra[:, :, columns], response)
        valid = np.fft.irfft(together, self.frame, axis=1)[:, : self.step].ravel()
        # valid[i] is the sum that starts at sample i - (length - 1)
        first = self.length - 1 - left
        out = np.zeros(self.n)
        part = valid[first : first + self.n]
        out[: len(part)] = part
        return out


def trailing_max(v, reach: int):
    """max(v[n - reach : n]) for every n, -inf where empty; log2(reach) passes."""
    out = np.full(len(v), -np.inf)
    if reach == 0 or len(v) == 0:
        return out
    best = v.copy()
    span = 1
    while span * 2 <= reach:
        shifted = np.full(len(v), -np.inf)
        shifted[span:] = best[:-span] if span < len(v) else best[:0]
        best = np.maximum(best, shifted)
        span *= 2
    rest = reach - span
    if rest:
        shifted = np.full(len(v), -np.inf)
        shifted[rest:] = best[:-rest] if rest < len(v) else best[:0]
        best = np.maximum(best, shifted)
    out[1:] = best[:-1]
    return out


def window_peak_mask(v, reach: int):
    """True where v is strictly greater than every other value within `reach`."""
    return (v > trailing_max(v, reach)) & (v > trailing_max(v[::-1], reach)[::-1])
