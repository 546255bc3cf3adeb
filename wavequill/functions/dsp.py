"""Numerical kernels in numpy over panels: arrays whose last axis is time, and the axis before it channels or offsets."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def next_pow2(n: float) -> int:
    """1 up to 1, else the least power of two that isn't smaller."""
    return 1 if n <= 1 else 1 << math.ceil(math.log2(n))


# Windows and filters


def tukey(n: int, alpha: float) -> np.ndarray:
    """Symmetric tapered cosine window; alpha up to 0 is flat, from 1 a Hann window."""
    if n <= 1 or alpha <= 0:
        return np.ones(max(n, 0))
    alpha = min(alpha, 1.0)
    edge = alpha * (n - 1) / 2
    near = np.minimum(np.arange(n), n - 1 - np.arange(n))
    return np.where(near < edge, 0.5 * (1 + np.cos(np.pi * (near / edge - 1))), 1.0)


def _bilinear(zeros, poles, gain, fs2):
    """Zeros, poles and gain of a digital filter from an analog one; zeros at infinity come to -1."""
    degree = len(poles) - len(zeros)
    z = np.concatenate([(fs2 + zeros) / (fs2 - zeros), -np.ones(degree)])
    gain = gain * np.real(np.prod(fs2 - zeros) / np.prod(fs2 - poles))
    return z, (fs2 + poles) / (fs2 - poles), gain


def _band(poles, gain, low, high):
    """An analog lowpass prototype moved to a pass band (either edge may be None), frequencies warped already."""
    n = len(poles)
    if low is None:
        return np.zeros(0, complex), poles * high, gain * high**n
    if high is None:
        return np.zeros(n, complex), low / poles, gain * np.real(1 / np.prod(-poles))
    width, centre = high - low, math.sqrt(low * high)
    half = poles * width / 2
    root = np.sqrt(half**2 - centre**2 + 0j)
    return np.zeros(n, complex), np.concatenate([half + root, half - root]), gain * width**n


def _sections(z, p, gain) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2): conjugate poles together, those nearest the circle last."""
    order = [x for x in sorted(p, key=lambda x: (abs(x), x.real)) if x.imag > 1e-12]
    real = sorted(x.real for x in p if abs(x.imag) <= 1e-12)
    pairs = [(-2 * x.real, abs(x) ** 2) for x in order] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2], strict=False)]
    if len(real) % 2:
        pairs.insert(0, (-real[-1], 0.0))
    zeros = sorted(np.real(z))
    sos = []
    for i, (a1, a2) in enumerate(pairs):
        left, mine = len(pairs) - i, 2 if a2 else 1
        # Zeros are 1 or -1: one of each where there are both, so that sections stay near unit gain.
        take = [zeros.pop(0), zeros.pop()] if mine == 2 and len(zeros) >= 2 else [zeros.pop(0)] if zeros else []
        del left
        b = np.poly(take) if take else np.ones(1)
        sos.append([*b, *[0.0] * (3 - len(b)), 1.0, a1, a2])
    out = np.array(sos, float)
    out[0, :3] *= gain
    return out


@lru_cache(maxsize=256)
def butterworth(fs: float, low: float | None, high: float | None, order: int = 4) -> np.ndarray:
    """Sections of a Butterworth filter: bandpass, or low- or highpass where the other edge is None."""
    if low is None and high is None:
        raise ValueError("a band needs an edge")
    for f in (low, high):
        if f is not None and not 0 < f < fs / 2:
            raise ValueError(f"{f} Hz isn't between 0 and the Nyquist frequency {fs / 2} Hz")
    if low is not None and high is not None and low >= high:
        raise ValueError(f"the band's edges are out of order: {low}, {high}")
    warped = [None if f is None else 4 * math.tan(math.pi * f / fs) for f in (low, high)]
    angle = np.pi * (2 * np.arange(order) + order + 1) / (2 * order)
    return _sections(*_bilinear(*_band(np.exp(1j * angle), 1.0, *warped), 4.0))


@lru_cache(maxsize=64)
def chebyshev_low(order: int, ripple_db: float, cut: float) -> np.ndarray:
    """Sections of a Chebyshev type I lowpass; cut is a share of the Nyquist frequency."""
    eps = math.sqrt(10 ** (ripple_db / 10) - 1)
    mu = math.asinh(1 / eps) / order
    angle = np.pi * (2 * np.arange(order) + 1 - order) / (2 * order)
    poles = -np.sinh(mu + 1j * angle)
    gain = np.real(np.prod(-poles)) / (1 if order % 2 else math.sqrt(1 + eps**2))
    return _sections(*_bilinear(*_band(poles, gain, None, 4 * math.tan(math.pi * cut / 2)), 4.0))


def _settled(sos: np.ndarray) -> np.ndarray:
    """The states of the sections after a step of 1 has gone on for ever."""
    states, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        after = level * (b0 + b1 + b2) / (1 + a1 + a2)
        second = b2 * level - a2 * after
        states.append([b1 * level - a1 * after + second, second])
        level = after
    return np.array(states)


def _filtered(sos: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Transposed direct form II, all traces at once, from the settled state of their first sample."""
    y = np.moveaxis(x, -1, 0).copy()
    for (b0, b1, b2, _, a1, a2), (s1, s2) in zip(sos, _settled(sos), strict=True):
        one, two = s1 * first, s2 * first
        for t in range(len(y)):
            v = y[t]
            w = b0 * v + one
            one = b1 * v - a1 * w + two
            two = b2 * v - a2 * w
            y[t] = w
    return np.moveaxis(y, 0, -1)


def filtfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, so without delay; ends are continued by their point reflection."""
    pad = 3 * (2 * len(sos) + 1 - min(int((sos[:, 2] == 0).sum()), int((sos[:, 5] == 0).sum())))
    if x.shape[-1] <= pad:
        raise ValueError(f"a trace needs more than {pad} samples, this one has {x.shape[-1]}")
    left = 2 * x[..., :1] - x[..., pad:0:-1]
    right = 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]
    y = np.concatenate([left, x, right], axis=-1)
    for _ in range(2):
        y = _filtered(sos, y, y[..., 0])[..., ::-1]
    return y[..., pad:-pad]


def bandpass(x: np.ndarray, fs: float, low: float | None, high: float | None, alpha: float | None = 0.05, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band; alpha tapers the ends first (None: not)."""
    x = np.asarray(x, float)
    if alpha is not None:
        x = x * tukey(x.shape[-1], alpha)
    return filtfilt(butterworth(float(fs), low, high, order), x)


def band_mask(freqs: np.ndarray, fs: float, low: float | None, high: float | None, order: int = 4) -> np.ndarray:
    """Squared magnitude of the Butterworth filter, which is the gain of its pass forward and backward."""
    if low is None and high is None:
        raise ValueError("a band needs an edge")
    warped = np.tan(np.pi * np.minimum(np.abs(freqs) / fs, 0.5 - 1e-12))
    a, b = (None if f is None else math.tan(math.pi * f / fs) for f in (low, high))
    with np.errstate(divide="ignore", over="ignore"):
        if a is None:
            return 1 / (1 + (warped / b) ** (2 * order))
        if b is None:
            return 1 / (1 + (a / warped) ** (2 * order))
        mask = 1 / (1 + ((warped**2 - a * b) / (warped * (b - a))) ** (2 * order))
    mask[(freqs == 0) | (np.abs(freqs) >= fs / 2)] = 0
    return mask


def spectral_bandpass(x: np.ndarray, fs: float, low: float | None, high: float | None, alpha: float = 0.05, order: int = 4) -> np.ndarray:
    """The same band by its mask on the spectrum of the tapered trace; circular."""
    n = x.shape[-1]
    mask = band_mask(np.fft.rfftfreq(n, 1 / fs), fs, low, high, order)
    return np.fft.irfft(np.fft.rfft(x * tukey(n, alpha)) * mask, n)


# Maps of traces


def detrend(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    t = np.arange(n) - (n - 1) / 2
    slope = (x * t).sum(-1, keepdims=True) / max((t * t).sum(), 1e-300)
    return x - x.mean(-1, keepdims=True) - slope * t


def running_absolute_mean(x: np.ndarray, n: int) -> np.ndarray:
    """x over the mean magnitude of n samples around each, ends continued by their sample; n up to 1: the sign."""
    if n <= 1:
        return np.sign(x)
    size = np.abs(x)
    padded = np.concatenate([np.repeat(size[..., :1], n // 2, -1), size, np.repeat(size[..., -1:], n - 1 - n // 2, -1)], -1)
    sums = np.cumsum(np.concatenate([np.zeros((*x.shape[:-1], 1)), padded], -1), -1)
    level = (sums[..., n:] - sums[..., :-n]) / n
    return np.divide(x, level, out=np.zeros_like(x, float), where=level > 1e-15)


def decimate(x: np.ndarray, fs: float, q: int, highest: float | None = None) -> np.ndarray:
    """Every q-th sample after a zero-phase lowpass; highest: a frequency that must stay below the new Nyquist."""
    if q < 1:
        raise ValueError(f"a factor of at least 1 is needed, not {q}")
    if q == 1:
        return np.asarray(x, float)
    if highest is not None and highest >= fs / (2 * q):
        raise ValueError(f"{highest} Hz is lost at {fs / q} samples a second")
    return filtfilt(chebyshev_low(8, 0.05, 0.8 / q), np.asarray(x, float))[..., ::q]


def resample(x: np.ndarray, n: int) -> np.ndarray:
    """x on n samples by cutting or padding its spectrum."""
    old = x.shape[-1]
    spectrum = np.fft.rfft(x)
    keep = min(n, old) // 2 + 1
    out = np.zeros((*x.shape[:-1], n // 2 + 1), complex)
    out[..., :keep] = spectrum[..., :keep]
    if min(n, old) % 2 == 0 and n != old:
        # The Nyquist bin of the shorter one stands for two of the longer one's.
        out[..., keep - 1] *= 0.5 if n > old else 2.0
        if n < old:
            out[..., keep - 1] = out[..., keep - 1].real
    return np.fft.irfft(out, n) * (n / old)


def envelope(x: np.ndarray) -> np.ndarray:
    n = x.shape[-1]
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * weight))


def whiten_spectrum(spectrum: np.ndarray, df: float, window_hz: float, low: float, high: float) -> np.ndarray:
    """Amplitudes levelled (each by itself, or by their mean in window_hz around), with cosine tapers on all that is out of band."""
    n = spectrum.shape[-1]
    a, b = int(low / df), min(n, math.ceil(high / df))
    if b <= a:
        return np.zeros_like(spectrum)
    size = np.abs(spectrum)
    if window_hz > 0:
        width = max(1, int(round(window_hz / df)))
        width += 1 - width % 2
        sums = np.cumsum(np.pad(size, [(0, 0)] * (size.ndim - 1) + [(width // 2 + 1, width // 2)]), -1)
        size = (sums[..., width:] - sums[..., :-width]) / width
    weight = np.ones(n)
    weight[:a] = np.cos(np.linspace(np.pi / 2, np.pi, a)) ** 2
    weight[b:] = np.cos(np.linspace(np.pi, np.pi / 2, n - b)) ** 2
    return spectrum / np.maximum(size, 1e-10) * weight


def whiten(x: np.ndarray, fs: float, low: float, high: float, window_hz: float = 0.0, nfft: int | None = None) -> np.ndarray:
    n = x.shape[-1]
    nfft = nfft or n
    return np.fft.irfft(whiten_spectrum(np.fft.rfft(x, nfft), fs / nfft, window_hz, low, high), nfft)[..., :n]


def whiten_segments(x: np.ndarray, fs: float, size: int, low: float, high: float, window_hz: float = 0.0) -> np.ndarray:
    if x.shape[-1] % size:
        raise ValueError(f"{x.shape[-1]} samples aren't whole segments of {size}")
    return whiten(x.reshape(*x.shape[:-1], -1, size), fs, low, high, window_hz).reshape(x.shape)


def preprocess(x: np.ndarray, fs: float, low: float | None, high: float | None, ram_seconds: float = 0.0, mode: str = "exact") -> np.ndarray:
    """Detrend, band, median over channels taken out, normalised in time. mode: exact or spectral band."""
    if x.ndim != 2:
        raise ValueError("a panel has channels and samples")
    band = {"exact": bandpass, "spectral": spectral_bandpass}[mode]
    y = band(detrend(np.asarray(x, float)), fs, low, high)
    y = y - np.median(y, axis=0)
    return running_absolute_mean(y, max(round(fs * ram_seconds), 1) if ram_seconds > 0 else 1)


# Correlation: r(m) = sum of x(n) y(n + m), so positive lags run from the source x to the receiver y


def correlate_spectra(x: np.ndarray, y: np.ndarray, lags: int) -> np.ndarray:
    """Sources x (source, segment, time) against receivers y (receiver, segment, time): (source, receiver, 2 lags + 1).

    The mean over segments; spectra are summed before the one inverse transform of each pair.
    """
    n, segments = x.shape[-1], x.shape[-2]
    if lags > n - 1:
        raise ValueError(f"lags of {lags} samples need longer segments than {n}")
    nfft = next_pow2(2 * n - 1)
    fx, fy = np.fft.rfft(x, nfft), np.fft.rfft(y, nfft)
    r = np.fft.irfft(np.einsum("ask,bsk->abk", np.conj(fx), fy), nfft)
    return np.concatenate([r[..., nfft - lags :], r[..., : lags + 1]], -1) / segments


def block_size(lags: int, snap: bool = True) -> tuple[int, int]:
    """(samples of a block, FFT length) that cost least for correlations of short lags: the minus-one Lambert branch."""
    if lags <= 0:
        raise ValueError(f"lags must be positive, not {lags}")
    z = -1 / (4 * math.e * lags)
    w = math.log(-z) - math.log(-math.log(-z))
    for _ in range(50):
        e = math.exp(w)
        step = (w * e - z) / (e * (w + 1))
        w -= step
        if abs(step) < 1e-14 * abs(w):
            break
    grow = next_pow2 if snap else int
    length = grow(max(1, round(2 * lags * (-w - 1))) + 2 * lags)
    if length < 3 * lags + 1:
        length = grow(3 * lags + 1)
    return length - 2 * lags, length


def correlate_blocks(x: np.ndarray, y: np.ndarray, lags: int, block: int | None = None) -> np.ndarray:
    """correlate_spectra() by blocks with lags samples around, for lags much shorter than segments."""
    n, segments = x.shape[-1], x.shape[-2]
    block, nfft = (block, block + 2 * lags) if block else block_size(lags)
    blocks = -(-n // block)
    total = 0
    whole = lambda a: np.pad(a, [(0, 0)] * (a.ndim - 1) + [(lags, blocks * block - n + lags)])
    px, py = whole(x), whole(y)
    for b in range(blocks):
        cut = slice(b * block, b * block + nfft)
        centre = np.zeros((*y.shape[:-1], nfft))
        centre[..., lags : lags + block] = py[..., cut][..., lags : lags + block]
        total = total + np.einsum("ask,bsk->abk", np.conj(np.fft.rfft(px[..., cut])), np.fft.rfft(centre))
    r = np.fft.irfft(total, nfft)
    return np.concatenate([r[..., nfft - lags :], r[..., : lags + 1]], -1) / segments


def autocorrelate(x: np.ndarray, lags: int) -> np.ndarray:
    """(traces, 2 lags + 1): each trace of x (traces, segments, samples) with itself, the mean over segments."""
    nfft = next_pow2(x.shape[-1] + lags)
    r = np.fft.irfft((np.abs(np.fft.rfft(x, nfft)) ** 2).mean(-2), nfft)
    return np.concatenate([r[..., nfft - lags :], r[..., : lags + 1]], -1)


def best_shift(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(traces, 2): the lag by which y follows x most, and their sum of products there; lags of a crop of n about the middle of
    all 2 n - 1, of equal ones the first."""
    n = x.shape[-1]
    nfft, first = next_pow2(2 * n - 1), -(n // 2)
    r = np.fft.irfft(np.conj(np.fft.rfft(x, nfft)) * np.fft.rfft(y, nfft), nfft)
    r = r[:, np.arange(first, first + n) % nfft]
    at = r.argmax(-1)
    return np.stack([at + first, r[np.arange(len(r)), at]], -1)


def stretched(x: np.ndarray, references: np.ndarray, most: float, steps: int) -> np.ndarray:
    """(traces, 2): the stretch in percent, from the traces' start, that makes each one's reference most like it, and how like.

    Every different reference is stretched once a step, whatever number of traces it serves; of equal steps the first wins.
    """
    refs, which = np.unique(references, axis=0, return_inverse=True)
    which, n = which.ravel(), references.shape[-1]
    size, i = (x * x).sum(-1), np.arange(x.shape[-1])
    best = np.full((len(x), 2), -np.inf)
    for k in range(steps):
        eps = -most + k * (2 * most / (steps - 1))
        u = i * (1 + eps)
        inside = (u >= 0) & (u <= n - 1)
        j = np.clip(np.floor(u).astype(int), 0, n - 1)
        moved = np.where(inside, refs[:, j] + (u - j) * (refs[:, np.minimum(j + 1, n - 1)] - refs[:, j]), 0.0)
        norm = np.sqrt((moved * moved).sum(-1)[which] * size)
        dots = (moved[which] * x).sum(-1)
        cc = np.divide(dots, norm, out=np.zeros(len(x)), where=norm > 0)
        better = cc > best[:, 1]
        best[better] = np.stack([np.full(better.sum(), eps * 100), cc[better]], -1)
    return best


# Wavefields


def fk(x: np.ndarray, dt: float, dx: float, pad: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, wavenumbers, centred spectrum (wavenumber, frequency))."""
    rows, cols = pad or x.shape
    spectrum = np.fft.fftshift(np.fft.fft2(x, s=(rows, cols)))
    return np.fft.fftshift(np.fft.fftfreq(cols, dt)), np.fft.fftshift(np.fft.fftfreq(rows, dx)), spectrum


def fk_back(spectrum: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.real(np.fft.ifft2(np.fft.ifftshift(spectrum)))[: shape[0], : shape[1]]


def _reflected(x: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    widths = [(0, 0)] * x.ndim
    widths[axis] = (before, after)
    return np.pad(x, widths, mode="symmetric")


def gaussian_blur(x: np.ndarray, sigma: float, truncate: float = 4.0, axes: tuple[int, ...] | None = None) -> np.ndarray:
    if sigma <= 0:
        return x
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in axes if axes is not None else range(x.ndim):
        windows = np.lib.stride_tricks.sliding_window_view(_reflected(x, r, r, axis), 2 * r + 1, axis)
        x = windows @ k
    return x


def box_blur(x: np.ndarray, size: int) -> np.ndarray:
    for axis in range(x.ndim):
        x = np.lib.stride_tricks.sliding_window_view(_reflected(x, size // 2, size - 1 - size // 2, axis), size, axis).mean(-1)
    return x


def fk_filter(x, dt, dx, vmin, vmax, mode="eliminate", direction="both", pad=None, smooth="gaussian", sigma=1.0, size=3):
    """Takes a fan of velocities out of a panel, or leaves only that. direction spares the other side's wavenumbers."""
    if mode not in ("eliminate", "extract"):
        raise ValueError(f"no such mode: {mode}")
    if smooth not in ("no", "gaussian", "uniform"):
        raise ValueError(f"no such smoothing: {smooth}")
    f, k, spectrum = fk(x, dt, dx, pad)
    speed = np.abs(np.divide(f[None, :], k[:, None], out=np.full((len(k), len(f)), np.inf), where=k[:, None] != 0))
    keep = np.where((speed >= vmin) & (speed <= vmax), 0.0, 1.0)
    if direction in ("right", "left"):
        keep[k < 0 if direction == "right" else k > 0] = 1.0
    keep = gaussian_blur(keep, sigma) if smooth == "gaussian" else box_blur(keep, size) if smooth == "uniform" else keep
    # The mask belongs to the spectrum with its wavenumber axis turned round.
    return fk_back(spectrum * (keep if mode == "eliminate" else 1 - keep)[::-1], x.shape)


def phase_velocity_image(x, offsets, dt, vmin, vmax, dv, fmin, fmax, normalise=True):
    """(image (velocity, frequency), frequencies, velocities) of a gather, by stacking its phases along each velocity's moveout."""
    x, offsets = np.asarray(x, float), np.asarray(offsets, float)
    if x.ndim != 2 or offsets.shape != (len(x),):
        raise ValueError("a gather has traces and samples, and an offset a trace")
    if dt <= 0 or dv <= 0 or vmax <= vmin or x.shape[1] < 2:
        raise ValueError("dt and dv must be positive, vmax above vmin, and traces have two samples")
    nfft = next_pow2(x.shape[1])
    f = np.fft.rfftfreq(nfft, dt)
    inside = (f >= fmin) & (f <= fmax)
    f = f[inside]
    if len(f) < 2:
        raise ValueError("fewer than two frequencies in the band")
    v = np.arange(vmin, vmax + dv, dv)
    spectrum = np.fft.rfft(x, nfft)[:, inside]
    phase = spectrum / (np.abs(spectrum) + 1e-8)
    image, turn = np.empty((len(v), len(f))), 2j * np.pi * offsets[:, None] * f
    for k, speed in enumerate(v):  # one velocity at a time: memory of a gather's spectrum
        image[k] = np.abs((phase * np.exp(turn / speed)).sum(0))
    if normalise:
        top = image.max(axis=0)
        image = image / np.where(top == 0, 1, top)
    return image, f, v


def _bracket(column: np.ndarray, at: int, step: int) -> int:
    """The best of a column near a place: steps to either side as long as they go up, and one more."""
    ends = []
    for move in (-step, step):
        here = at
        while True:
            there = min(max(here + move, 0), len(column) - 1)
            up, here = column[here] < column[there], there
            if not up:
                break
        ends.append(here)
    return ends[0] + int(np.argmax(column[ends[0] : ends[1] + 1]))


def follow_ridge(image: np.ndarray, seeds: list[tuple[int, int]], step: int = 5) -> np.ndarray:
    """For each column of image the row of a ridge through seeds (column, row): on from the last seed, then back over all."""
    seeds = sorted(seeds)
    out, (first, row) = np.zeros(image.shape[1], int), seeds[-1]
    at = row
    for i in range(first, image.shape[1]):
        at = out[i] = _bracket(image[:, i], at, step)
    # Back: a single seed's own column stays as found; with more, each seed's column starts from the seed anew.
    at, inner = out[first], dict(seeds[:-1])
    for i in range(first if len(seeds) > 1 else first - 1, -1, -1):
        at = out[i] = _bracket(image[:, i], inner.get(i, at), step)
    return out


def pick_curve(image, f, v, references: list[float], limits: list[float], step: int = 5) -> np.ndarray:
    """A velocity for each frequency: the ridge from the best below limits at references."""
    seeds = []
    for f_ref, top in zip(references, limits, strict=True):
        column = int(np.argmax(f >= f_ref))
        rows = np.flatnonzero(v < top)
        seeds.append((column, int(rows[np.argmax(image[rows, column])])))
    return v[follow_ridge(image, seeds, step)]


# Delays, similarity, spectra


def pair_spectra(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(spectra of z-scores with n - 1, FFT length) for best_lags()."""
    z = (x - x.mean(-1, keepdims=True)) / (x.std(-1, ddof=1, keepdims=True) + 1e-12)
    nfft = smooth_length(2 * x.shape[-1] - 1)
    return np.fft.rfft(z, nfft), nfft


def smooth_length(n: int) -> int:
    """The least product of 2, 3 and 5 from n on."""
    twos = [next_pow2(-(-n // (a * b))) * a * b for a in (1, 3, 9, 27, 81) for b in (1, 5, 25)]
    return min(twos)


def best_lags(one: np.ndarray, others: np.ndarray, n: int, nfft: int) -> tuple[np.ndarray, np.ndarray]:
    """(highest correlation over n, lag in samples) of a trace of n samples with others, by pair_spectra()."""
    r = np.fft.irfft(one * np.conj(others), nfft)
    r = np.concatenate([r[:, nfft - n + 1 :], r[:, :n]], -1)
    at = r.argmax(-1)
    return r[np.arange(len(r)), at] / n, at - (n - 1)


def pair_basis(x: np.ndarray, spectra: np.ndarray, nfft: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(coefficients of z-scores, spectra of their basis), or None if that has so many traces that transforms cost less. Filtered and
    resampled traces need few; what is left out is less than rounding."""
    z = np.fft.irfft(spectra, nfft)[:, : x.shape[-1]]
    _, size, basis = np.linalg.svd(z, full_matrices=False)
    basis = basis[size > 1e-14 * size[0]]
    return (z @ basis.T, np.fft.rfft(basis, nfft)) if len(basis) and len(basis) * 8 < x.shape[-1] else None


def best_lags_in_basis(one: np.ndarray, coefficients: np.ndarray, basis: np.ndarray, n: int, nfft: int) -> tuple[np.ndarray, np.ndarray]:
    """best_lags() with traces given by pair_basis(): the correlations with the basis, multiplied."""
    r = np.fft.irfft(one * np.conj(basis), nfft)
    r = np.concatenate([r[:, nfft - n + 1 :], r[:, :n]], -1)
    best, at = np.empty(len(coefficients)), np.empty(len(coefficients), int)
    for k in range(0, len(coefficients), 256):
        found = coefficients[k : k + 256] @ r
        at[k : k + 256] = top = found.argmax(-1)
        best[k : k + 256] = found[np.arange(len(found)), top]
    return best / n, at - (n - 1)


def pair_delays(x: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """(highest correlation, lag in seconds) of all pairs of traces; z-scores with n - 1, correlations over n."""
    spectra, nfft = pair_spectra(x)
    found = [best_lags(one, spectra, x.shape[-1], nfft) for one in spectra]
    return np.stack([cc for cc, _ in found]), np.stack([lag for _, lag in found]) * dt


def solve_delays(i: np.ndarray, j: np.ndarray, lag: np.ndarray, n: int, damp: float = 0.0) -> np.ndarray:
    """Delays of n traces, of sum 0, from the lags of pairs i < j; damp weighs their differences between neighbours.

    By the normal equations, which have n rows however many pairs there are; of several solutions the least.
    """
    g, d = np.ones((n, n)), np.zeros(n)
    near = np.arange(n - 1)
    for a, b, w in ((i, j, 1.0), (near, near + 1, damp**2)):
        for x, y, sign in ((a, a, w), (b, b, w), (a, b, -w), (b, a, -w)):
            np.add.at(g, (x, y), sign)
    np.add.at(d, i, lag)
    np.add.at(d, j, -np.asarray(lag))
    return np.linalg.lstsq(g, d, rcond=None)[0]


def solve_blocks(n: int, d: np.ndarray, degree: np.ndarray, blocks: list, damp: float = 0.0) -> np.ndarray:
    """solve_delays() without its n x n matrix, by conjugate gradients. d: the right side; degree: pairs of each trace; blocks:
    (rows, columns, function that returns which of rows x columns are pairs), with each pair once."""

    def neighbours(x):
        out = np.zeros(n)
        for i, j, met in blocks:
            m = met().astype(float)
            out[i] += m @ x[j]
            out[j] += m.T @ x[i]
        return out

    def product(x):
        step = np.diff(x) * damp**2
        out = degree * x - neighbours(x)
        out[:-1] -= step
        out[1:] += step
        return out

    ends = np.zeros(n)
    ends[:-1] += damp**2
    ends[1:] += damp**2
    scale = np.where(degree + ends > 0, degree + ends, 1.0)
    x, r = np.zeros(n), d.copy()
    z = r / scale
    p, rz, least = z.copy(), float(r @ z), 1e-26 * float(d @ (d / scale))
    for _ in range(20 * n):
        if rz <= least:
            break
        q = product(p)
        step = rz / float(p @ q)
        x, r = x + step * p, r - step * q
        z = r / scale
        rz, before = float(r @ z), rz
        p = z + rz / before * p
    # What no pair tells: each connected part has sum 0.
    part, change = np.arange(n), not damp
    while change:
        new = part.copy()
        for i, j, met in blocks:
            m = met()
            new[i] = np.minimum(new[i], np.where(m, part[j], n).min(1))
            new[j] = np.minimum(new[j], np.where(m, part[i][:, None], n).min(0))
        part, change = new, (new != part).any()
    if damp:
        part[:] = 0
    return x - (np.bincount(part, x, n) / np.maximum(np.bincount(part, minlength=n), 1))[part]


def clip_scale(x: np.ndarray, percentile: float = 99.5) -> np.ndarray:
    top = np.percentile(np.abs(x), percentile)
    return np.clip(x, -top, top) / top if top > 0 else np.zeros_like(x)


def ssim(a: np.ndarray, b: np.ndarray, percentile: float = 99.5) -> float:
    """Structural similarity of two panels, each clipped and scaled to a range of 2; Gaussian weights of 11 x 11."""
    if a.shape != b.shape:
        raise ValueError("panels of one shape are needed")
    a, b = clip_scale(np.asarray(a, float), percentile), clip_scale(np.asarray(b, float), percentile)
    blur = lambda x: gaussian_blur(x, 1.5, 3.5)
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = (0.01 * 2) ** 2, (0.03 * 2) ** 2
    score = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))
    inner = score[5:-5, 5:-5] if min(a.shape) > 10 else score
    return float(np.clip(inner.mean(), -1, 1))


def welch(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power density): Hann segments that overlap by half, their means taken out."""
    size = min(size, x.shape[-1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return _periodograms(x, fs, window, size - size // 2, mean=True)


def spectrogram(x: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power density (.., time, frequency)): Tukey segments that overlap by an eighth."""
    size = min(size, x.shape[-1])
    return _periodograms(x, fs, tukey(size + 1, 0.25)[:-1], size - size // 8, mean=False)


def _periodograms(x, fs, window, hop, mean):
    size = len(window)
    pieces = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), size, -1)[..., ::hop, :]
    power = np.abs(np.fft.rfft((pieces - pieces.mean(-1, keepdims=True)) * window)) ** 2 / (fs * (window**2).sum())
    power[..., 1 : -1 if size % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(size, 1 / fs), power.mean(-2) if mean else power


def attenuation(x: np.ndarray, offsets: np.ndarray, f: np.ndarray, inside: np.ndarray, speed: np.ndarray, width: int) -> tuple[float, float]:
    """(Q, R squared) of traces by offset, nearest first, by spectral ratios to the first."""
    size = np.abs(np.fft.rfft(x))
    sums = np.cumsum(np.pad(size, [(0, 0), (width // 2 + 1, width - 1 - width // 2)]), -1)
    smooth = ((sums[:, width:] - sums[:, :-width]) / width)[:, inside]
    y = np.log((smooth[:1] + 1e-15) / (smooth + 1e-15)).ravel()
    t = (-np.pi * (offsets[0] - offsets[:, None]) * f[inside] / speed).ravel()
    slope, level = np.polyfit(t, y, 1)
    total = ((y - y.mean()) ** 2).sum()
    r2 = 1 - ((y - level - slope * t) ** 2).sum() / total if total > 0 else math.nan
    return (1 / slope if slope > 0 else math.nan), r2


def stretch(reference: np.ndarray, current: np.ndarray, t: np.ndarray, begin: float, end: float, most: float, steps: int) -> tuple[float, float]:
    """(percent, similarity): how far the reference must be stretched to look most like current, in a window of time."""
    inside = (t >= begin) & (t <= end)
    if not inside.any():
        return math.nan, 0.0
    t, a, b = t[inside], reference[inside], current[inside]
    best = (-math.inf, 0.0)
    for eps in np.linspace(-most, most, steps):
        s = np.interp(t * (1 + eps), t, a, left=0.0, right=0.0)
        norm = math.sqrt(float((s * s).sum() * (b * b).sum()))
        cc = float((s * b).sum()) / norm if norm > 0 else 0.0
        if cc > best[0]:
            best = (cc, eps)
    return best[1] * 100, best[0]
