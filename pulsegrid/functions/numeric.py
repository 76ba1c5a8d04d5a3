"""Numeric routines for one recording at a time, used in grouped pandas UDFs."""

from __future__ import annotations

import re

import numpy as np

def align(ref: list[str], hyp: list[str]) -> tuple[int, list[tuple[int, int]]]:
    """Word edit distance and the aligned index pairs (-1 for none); on ties insertion, then deletion, then the diagonal."""
    (r, h), n, m = _codes(ref, hyp), len(ref), len(hyp)
    # costs less the column: insertions don't change them, so the least of any way in is a running minimum
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0] = np.arange(n + 1)
    same = (r[:, None] == h).astype(np.int32)
    for i in range(1, n + 1):
        np.minimum(cost[i - 1, :-1] - same[i - 1], cost[i - 1, 1:] + 1, out=cost[i, 1:])
        np.minimum.accumulate(cost[i], out=cost[i])
    pairs, i, j = [], n, m
    row, above = cost[n].tolist(), cost[n - 1].tolist() if n else []
    while i or j:
        if j and row[j] == row[j - 1]:
            j -= 1
            pairs.append((-1, j))
            continue
        if not (i and row[j] == above[j] + 1):
            j -= 1
            pairs.append((i - 1, j))
        else:
            pairs.append((i - 1, -1))
        i -= 1
        row, above = above, cost[i - 1].tolist() if i else []
    return int(cost[n, m]) + m, pairs[::-1]


def _codes(ref: list[str], hyp: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for words, equal where the words are."""
    number: dict[str, int] = {}
    return tuple(np.fromiter((number.setdefault(w, len(number)) for w in x), np.int32, len(x)) for x in (ref, hyp))


def aligned_words(ref: list[str], hyp: list[str]) -> tuple[int, int]:
    """The cost and the number of pairs of words of ``align``; for long texts from two rows at a time, so that memory grows with one text, not with both."""
    if len(ref) * len(hyp) <= 1 << 20:
        cost, pairs = align(ref, hyp)
        return cost, sum(i >= 0 and j >= 0 for i, j in pairs)
    return _aligned_by_rows(ref, hyp)


def _aligned_by_rows(ref: list[str], hyp: list[str]) -> tuple[int, int]:
    r, h = _codes(ref, hyp)
    at = np.arange(len(h) + 1, dtype=np.int32)
    cost, pairs = np.zeros(len(h) + 1, np.int32), np.zeros(len(h) + 1, np.int32)
    for i, word in enumerate(r, 1):
        down = cost + 1
        new = np.empty_like(cost)
        new[0] = i
        np.minimum(cost[:-1] - (h == word), down[1:], out=new[1:])
        np.minimum.accumulate(new, out=new)
        found = pairs.copy()
        found[1:] = np.where(new[1:] == down[1:], pairs[1:], pairs[:-1] + 1)
        way = at.copy()
        way[1:][new[1:] == new[:-1]] = 0
        pairs, cost = found[np.maximum.accumulate(way)], new
    return int(cost[-1]) + len(h), int(pairs[-1])


def transferred_speakers(ref: list[str], ref_speakers: list[int], hyp: list[str], hyp_speakers: list[int]) -> list[int]:
    """The reference's speakers on the hypothesis' words, in the naming of the hypothesis: the better of both permutations."""
    got = [-1] * len(hyp)
    for i, j in align(ref, hyp)[1]:
        if i >= 0 and j >= 0:
            got[j] = ref_speakers[i]
    names = sorted({*ref_speakers, *hyp_speakers})
    if len(names) > 2:
        raise ValueError("two speakers at most")
    swap = {names[0]: names[-1], names[-1]: names[0]} if names else {}
    same = sum(a == b for a, b in zip(got, hyp_speakers, strict=True) if a >= 0)
    other = sum(swap[a] == b for a, b in zip(got, hyp_speakers, strict=True) if a >= 0)
    return [h if g < 0 else (swap[g] if other > same else g) for g, h in zip(got, hyp_speakers, strict=True)]


def peaks(y: np.ndarray, prominence: float = 2.0, width: float = 0.01) -> list[tuple[int, float, float]]:
    """(peak, left, right) of the local maxima with enough prominence and width; bounds at half prominence, interpolated."""
    out = []
    for i in range(1, len(y) - 1):
        if not (y[i] > y[i - 1] and y[i] > y[i + 1]):
            continue
        lo = i - 1
        while lo > 0 and y[lo] <= y[i]:
            lo -= 1
        hi = i + 1
        while hi < len(y) - 1 and y[hi] <= y[i]:
            hi += 1
        prom = y[i] - max(y[lo : i + 1].min(), y[i : hi + 1].min())
        if prom < prominence:
            continue
        level, a, b = y[i] - prom / 2, i, i
        while a > 0 and y[a] > level:
            a -= 1
        while b < len(y) - 1 and y[b] > level:
            b += 1
        left = a + (level - y[a]) / (y[a + 1] - y[a]) if y[a] < level else float(a)
        right = b - (level - y[b]) / (y[b - 1] - y[b]) if y[b] < level else float(b)
        if right - left >= width:
            out.append((i, left, right))
    return out


def gaussian_mixture(x: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Probability of the component with the higher mean in a mixture of two normals, by EM from the quartiles."""
    ok = np.isfinite(x)
    out = np.full(len(x), np.nan)
    v = x[ok]
    if len(v) < 2:
        return out
    mean, var, share = np.quantile(v, [0.25, 0.75]), np.full(2, v.var() + 1e-6), np.full(2, 0.5)
    for _ in range(rounds):
        logs = np.log(share + 1e-300) - 0.5 * np.log(2 * np.pi * var) - (v[:, None] - mean) ** 2 / (2 * var)
        p = np.exp(logs - logs.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        n = p.sum(0) + 1e-12
        new = (p * v[:, None]).sum(0) / n
        var, share = (p * (v[:, None] - new) ** 2).sum(0) / n + 1e-6, n / len(v)
        done, mean = np.abs(new - mean).max() < 1e-9, new
        if done:
            break
    out[ok] = p[:, int(mean.argmax())]
    return out


def gaussian_mixtures(x: np.ndarray, sizes: np.ndarray, rounds: int = 100) -> np.ndarray:
    """``gaussian_mixture`` of each of many short series, laid end to end: all go through a round at once; equal but for the last digits."""
    out, of = np.full(len(x), np.nan), np.repeat(np.arange(len(sizes)), sizes)
    ok = np.isfinite(x)
    ok &= (np.bincount(of[ok], minlength=len(sizes)) >= 2)[of]
    at, v = np.flatnonzero(ok), x[ok]
    n = np.bincount(of[ok], minlength=len(sizes))
    n = n[n > 0]
    if not len(n):
        return out
    each = np.split(v, np.cumsum(n)[:-1])
    mean, var, share = np.array([np.quantile(e, [0.25, 0.75]) for e in each]), np.array([np.full(2, e.var() + 1e-6) for e in each]), np.full((len(n), 2), 0.5)
    for k in range(rounds):
        first, one = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
        logs = (np.log(share + 1e-300) - 0.5 * np.log(2 * np.pi * var))[one] - (v[:, None] - mean[one]) ** 2 / (2 * var)[one]
        p = np.exp(logs - logs.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = np.add.reduceat(p, first) + 1e-12
        new = np.add.reduceat(p * v[:, None], first) / weight
        var, share = np.add.reduceat(p * (v[:, None] - new[one]) ** 2, first) / weight + 1e-6, weight / n[:, None]
        done, mean = np.abs(new - mean).max(1) < 1e-9, new
        if k == rounds - 1:
            done[:] = True
        if done.any():
            ends = done[one]
            out[at[ends]] = p[ends, mean.argmax(1)[one[ends]]]
            v, at, n, mean, var, share = v[~ends], at[~ends], n[~done], mean[~done], var[~done], share[~done]
            if not len(n):
                break
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Cluster numbers; centres start from the farthest points, so the result is the same on every run."""
    if len(x) <= k:
        return np.arange(len(x))
    centres = [x[0]]
    for _ in range(k - 1):
        centres.append(x[np.min([((x - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    c = np.array(centres)
    for _ in range(rounds):
        own = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
        if np.allclose(new, c):
            break
        c = new
    return own


def kalman(z: np.ndarray, q: float = 300.0, t: float = 0.1, r: float = 0.25, first_zero: bool = True) -> np.ndarray:
    """Constant-velocity Kalman filter with backward smoothing of one channel; the first sample stays 0 by default."""
    n = len(z)
    if not n:
        return z.copy()
    a = np.array([[1, t], [0, 1]])
    noise = q * np.array([[t**4 / 4, t**3 / 2], [t**3 / 2, t**2]])
    x, p = np.array([z[0], 0.0]), np.eye(2)
    xs, ps, xp, pp = np.zeros((n, 2)), np.zeros((n, 2, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
    for i in range(n):
        xp[i], pp[i] = a @ x, a @ p @ a.T + noise
        gain = pp[i][:, 0] / (pp[i][0, 0] + r)
        x, p = xp[i] + gain * (z[i] - xp[i][0]), pp[i] - np.outer(gain, pp[i][0])
        xs[i], ps[i] = x, p
    out = xs.copy()
    for i in range(n - 2, -1, -1):
        g = ps[i] @ a.T @ np.linalg.inv(pp[i + 1])
        out[i] = xs[i] + g @ (out[i + 1] - xp[i + 1])
    smooth = out[:, 0]
    if first_zero:
        smooth[0] = 0
    return smooth


def coordination(x: np.ndarray, delays: int = 15, step: int = 7) -> list[float]:
    """Mean eigenvalues of three bands of the time-delay correlation matrix of channels x samples."""
    span = (delays - 1) * step
    rows = np.vstack([c[i * step : len(c) - span + i * step] for c in x for i in range(delays)])
    if rows.shape[1] < 2:
        return [float("nan")] * 3
    eig = np.sort(np.linalg.eigvalsh(np.nan_to_num(np.corrcoef(rows))))[::-1]
    mid = len(eig) // 2
    return [float(eig[:5].mean()), float(eig[mid - 3 : mid + 2].mean()), float(eig[-5:].mean())]


def cepstral_peak(x: np.ndarray, rate: int, window: float = 0.04, hop: float = 0.01) -> np.ndarray:
    """Cepstral peak prominence of each frame, in dB above the regression line of the cepstrum."""
    n, step = int(window * rate), int(hop * rate)
    out = []
    for i in range(0, len(x) - n + 1, step):
        spectrum = 20 * np.log10(np.abs(np.fft.rfft(x[i : i + n] * np.hanning(n))) + 1e-12)
        cep = 20 * np.log10(np.abs(np.fft.irfft(spectrum))[: n // 2] + 1e-12)
        lo, hi = int(rate / 300), min(int(rate / 60), n // 2)
        at = np.arange(lo, hi)
        slope, base = np.polyfit(at, cep[lo:hi], 1)
        k = lo + int(cep[lo:hi].argmax())
        out.append(cep[k] - (slope * k + base))
    return np.array(out)


def low_high_ratio(x: np.ndarray, rate: int, edge: float = 4000.0, window: float = 0.02, overlap: float = 0.75) -> np.ndarray:
    """Magnitude below over above ``edge`` hertz for each short-time frame."""
    n = int(window * rate)
    step = max(1, int(n * (1 - overlap)))
    f = np.fft.rfftfreq(n, 1 / rate)
    frames = [np.abs(np.fft.rfft(x[i : i + n] * np.hanning(n))) for i in range(0, len(x) - n + 1, step)]
    return np.array([m[f < edge].sum() / max(m[f >= edge].sum(), 1e-12) for m in frames])


def tree_scores(bracketed: str) -> tuple[int, int]:
    """Sums over leaves of depth with right siblings counted, and of depth with non-first children counted."""
    tokens = re.findall(r"\(|\)|[^\s()]+", bracketed)
    at = 0

    def read():
        nonlocal at
        at += 1
        label, children = tokens[at], []
        at += 1
        while tokens[at] != ")":
            if tokens[at] == "(":
                children.append(read())
            else:
                children.append(tokens[at])
                at += 1
        at += 1
        return label, children

    def score(node, right, left):
        if isinstance(node, str):
            return right, left
        kids = node[1]
        parts = [score(c, right + len(kids) - 1 - i, left + (i > 0)) for i, c in enumerate(kids)]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)

    return score(read(), 0, 0)
