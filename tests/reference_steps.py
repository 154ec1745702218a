"""Sequential, obviously-correct versions of the ordered procedures, for comparison only."""

import numpy as np


def biquad(x, b, a, state=None):
    z = np.zeros((2, x.shape[1])) if state is None else np.array(state, dtype=float)
    y = np.empty(x.shape)
    for n in range(len(x)):
        y[n] = b[0] * x[n] + z[0]
        z = np.array([b[1] * x[n] - a[1] * y[n] + z[1], b[2] * x[n] - a[2] * y[n]])
    return y, z


def window_peaks(v, m):
    return [
        n for n in range(len(v))
        if all(v[n] > v[j] for j in range(max(n - m, 0), min(n + m + 1, len(v))) if j != n)
    ]


def local_maxima(v):
    out, i = [], 1
    while i < len(v) - 1:
        if v[i] > v[i - 1]:
            j = i
            while j + 1 < len(v) and v[j + 1] == v[i]:
                j += 1
            if j + 1 < len(v) and v[j + 1] < v[i]:
                out.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    return out


def priority(at, score, distance):
    kept = []
    for i in sorted(range(len(at)), key=lambda i: (-score[i], -at[i])):
        if all(abs(at[i] - at[j]) >= distance for j in kept):
            kept.append(i)
    return sorted(at[i] for i in kept)


def onsets(codes, debounce):
    """(start, code) of debounced onsets, sample by sample."""
    cand, count, start, last, out = 0, 0, 0, 0, []
    for n, c in enumerate(codes):
        if c == cand:
            count += 1
        else:
            cand, count, start = c, 1, n
        if count == debounce and cand != last:
            if cand != 0:
                out.append((start, cand))
            last = cand
    return out


def toggles(v, chunk, threshold):
    high, out = False, []
    for c in range(0, len(v), chunk):
        part = v[c : c + chunk]
        if len(part) < 2:
            continue
        d = part[-1] - part[0]
        if not high and d > threshold:
            high = True
            out.append((c // chunk, 1))
        elif high and d < -threshold:
            high = False
            out.append((c // chunk, 0))
    return out


def cross_covariance(x, y, lag, segments):
    """Length-weighted biased cross-covariance E[x(n + lag) y(n)] over segments."""
    total = sum(e - s for s, e in segments)
    acc = 0.0
    for s, e in segments:
        a, b = x[s:e] - x[s:e].mean(), y[s:e] - y[s:e].mean()
        n = e - s
        acc += sum(a[i + lag] * b[i] for i in range(max(0, -lag), min(n, n - lag)))
    return acc / total
