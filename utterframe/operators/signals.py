"""Signals as arrays: time warp, band-pass, spectral subtraction, random augmentation, quiet cuts.

Each is a function of one signal (see `functions.registry` for their composition) that runs over
batches of rows; a signal is held whole, as every one of them needs its own spectrum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _frames(x: np.ndarray, n: int, hop: int) -> np.ndarray:
    """Spectra of overlapping windows; the signal is extended by half a window on both sides."""
    padded = np.pad(x, (n // 2, n // 2 + (-len(x)) % hop))
    at = np.arange(0, len(padded) - n + 1, hop)[:, None] + np.arange(n)
    return np.fft.rfft(padded[at] * np.hanning(n + 1)[:-1], axis=1)


def _joined(spectra: np.ndarray, n: int, hop: int, length: int) -> np.ndarray:
    window = np.hanning(n + 1)[:-1]
    out, weight = np.zeros((len(spectra) - 1) * hop + n), np.zeros((len(spectra) - 1) * hop + n)
    for i, part in enumerate(np.fft.irfft(spectra, n, axis=1) * window):
        out[i * hop : i * hop + n] += part
        weight[i * hop : i * hop + n] += window**2
    out = (out / np.maximum(weight, 1e-9))[n // 2 :]
    return np.pad(out, (0, max(0, length - len(out))))[:length]


def time_warp(x: np.ndarray, rate: float, n: int = 512) -> np.ndarray:
    """The signal `rate` times as fast at the same pitch: spectra are read at other places in time and
    their phases go on at the speed at which they turned there."""
    if rate <= 0:
        raise ValueError("the rate must be positive")
    x, hop = np.asarray(x, float), n // 4
    if abs(rate - 1) < 1e-5 or not len(x):
        return x.copy()
    spectra = _frames(np.pad(x, (0, max(0, n - len(x)))), n, hop)
    place = np.arange(0, len(spectra) - 1, rate)
    low, part = place.astype(int), place % 1
    size = (1 - part)[:, None] * abs(spectra[low]) + part[:, None] * abs(spectra[low + 1])
    steady = 2 * np.pi * hop * np.arange(n // 2 + 1) / n
    turn = np.angle(spectra[low + 1]) - np.angle(spectra[low]) - steady
    turn = steady + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
    phase = np.angle(spectra[0]) + np.vstack([np.zeros(n // 2 + 1), np.cumsum(turn, axis=0)[:-1]])
    return _joined(size * np.exp(1j * phase), n, hop, round(len(x) / rate))


def band_pass(x: np.ndarray, sample_rate: float, low: float = 300.0, high: float = 3400.0, order: int = 4) -> np.ndarray:
    """A Butterworth band-pass. Its response (with the bilinear transform's frequencies) multiplies the
    spectrum of the signal, which is extended by silence of its own length."""
    if not 0 < low < high:
        raise ValueError("the edges must be positive and in order")
    x = np.asarray(x, float)
    if not len(x):
        return x
    warped = lambda f: 2 * sample_rate * np.tan(np.pi * min(f, 0.499 * sample_rate) / sample_rate)
    a, b = warped(low), warped(high)
    s = 2j * sample_rate * np.tan(np.pi * np.fft.rfftfreq(2 * len(x)) * 0.999999)
    s[0] = 1e-9j
    prototype = (s * s + a * b) / (s * (b - a))
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    response = np.prod([1 / (1 - prototype / p) for p in poles], axis=0)
    return np.fft.irfft(np.fft.rfft(x, 2 * len(x)) * response)[: len(x)]


def denoise(x: np.ndarray, noise: np.ndarray, alpha: float = 2.0, beta: float = 0.02, n: int = 512) -> np.ndarray:
    """Spectral subtraction: `alpha` times the noise's mean spectrum is taken away, down to `beta` of
    what was there."""
    x, n = np.asarray(x, float), min(n, 1 << max(3, len(x).bit_length()))
    mean = abs(_frames(np.asarray(noise, float), n, n // 2)).mean(axis=0)
    spectra = _frames(x, n, n // 2)
    size = abs(spectra)
    kept = np.maximum(size - alpha * mean, beta * size)
    return _joined(spectra * kept / np.maximum(size, 1e-12), n, n // 2, len(x))


def augmented(x: np.ndarray, seed: int, chance: float = 0.3, rates: tuple[float, float] = (0.85, 1.15), semitones: tuple[float, float] = (-2.0, 2.0), amplitude: tuple[float, float] = (0.001, 0.015), n: int = 512) -> np.ndarray:
    """Stretched, shifted in pitch and made noisy, each with a chance; the same for one seed. A pitch is
    shifted by a warp that reading at another speed undoes."""
    rng, x = np.random.default_rng(seed), np.asarray(x, float)
    stretch, shift, noisy = rng.random(3) < chance
    rate, pitch, loud = rng.uniform(*rates), 2 ** (rng.uniform(*semitones) / 12), rng.uniform(*amplitude)
    if stretch:
        x = time_warp(x, rate, n)
    if shift and len(x):
        longer = time_warp(x, 1 / pitch, n)
        x = np.interp(np.arange(len(x)) * (len(longer) - 1) / max(1, len(x) - 1), np.arange(len(longer)), longer)
    return x + loud * rng.standard_normal(len(x)) if noisy else x


def quiet_parts(level: np.ndarray, longest: int, overlap: int = 0, quiet: Sequence[float] = tuple(range(-45, -14, 5)), least: Sequence[int] = (50, 40, 30, 20, 10, 5), window: int = 10) -> list[tuple[int, int]]:
    """(first, end) of parts of a level profile (dB per step) that are no longer than `longest`.

    A part that is longer is cut at its silent runs by the strictest pair of run length and level that
    leaves no part too long; without one, in the middle of the quietest window of its middle two
    fifths, where both halves take `overlap` steps more.
    """
    if longest < 1 or 5 * overlap >= longest:
        raise ValueError("the overlap must be less than a fifth of the longest part")
    level, out, left = np.asarray(level, float), [], [(0, len(level))]
    while left:
        a, b = left.pop()
        if b - a <= longest:
            out += [(a, b)] if b > a else []
            continue
        parts = next((p for run in least for db in quiet if len(p := _sounding(level[a:b] < db, run)) > 1 and max(j - i for i, j in p) <= longest), None)
        if parts is None:
            i, j = a + int(0.3 * (b - a)), a + int(0.7 * (b - a))
            power = np.convolve(10 ** (level[i:j] / 10), np.ones(window), "valid") if j - i > window else np.zeros(0)
            at = i + int(power.argmin()) + window // 2 if len(power) else (a + b) // 2
            parts = [(0, min(b, at + overlap) - a), (max(a, at - overlap) - a, b - a)]
        left += [(a + i, a + j) for i, j in reversed(parts)]
    return out


def _sounding(silent: np.ndarray, run: int) -> list[tuple[int, int]]:
    """What silent runs of at least `run` steps leave."""
    edge = np.flatnonzero(np.diff(np.r_[0, silent.astype(int), 0]))
    holes = [(i, j) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()) if j - i >= run]
    bounds = [0, *(x for hole in holes for x in hole), len(silent)]
    return [(i, j) for i, j in zip(bounds[::2], bounds[1::2]) if j > i]
