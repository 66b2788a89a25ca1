"""What neural stages take in: resampled audio cut into the mel patches, segments, chunks and windows of each model. Fixed sizes are the models' own.

Each function takes the samples of one recording and its rate and returns one array with a row for each call of the model; models.run_model() hosts the
model itself. Too short a recording gives no row. Memory is bounded by the recording, a few arrays of its length; columns hand over a few recordings at a
time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.operators.models import CUTTERS
from sonolith.operators.signal import _samples, loudness, mel_filters

#: Fixed values of the models: rate, frame, hop, bands and highest frequency.
EFFNET = (16_000, 512, 256, 96, 8000.0)
DCLAP = (48_000, 2048, 480, 128, 14_000.0)
GATE = (16_000, 512, 160, 64, 8000.0)
LEAST_CHUNK = 100
STEM_LUFS = -12.0
#: Samples of the recordings whose tables are handed over together, unless a single recording has more.
TOGETHER = 1 << 18


def resampled(mono: np.ndarray, rate: int, to: int) -> np.ndarray:
    """The band-limited signal at another rate, by its spectrum; a pad of silence at the end keeps the ends apart."""
    if rate == to or not len(mono):
        return mono
    step = rate // math.gcd(rate, to)
    n = -(-(len(mono) + rate // 10) // step) * step
    m = n // step * (to // math.gcd(rate, to))
    spectrum = np.fft.rfft(mono, n)
    cut = np.zeros(m // 2 + 1, complex)
    kept = min(len(cut), len(spectrum))
    cut[:kept] = spectrum[:kept]
    return np.fft.irfft(cut, m)[: -(-len(mono) * to // rate)] * (m / n)


def powers(cut: np.ndarray) -> np.ndarray:
    """Power spectra of frames under a periodic Hann window."""
    size = cut.shape[1]
    window = 0.5 - 0.5 * np.cos(2 * math.pi * np.arange(size) / size)
    return np.abs(np.fft.rfft(cut * window, axis=1)) ** 2


def unit_area(filters: np.ndarray, rate: int, top: float) -> np.ndarray:
    """Slaney's normalisation: each triangle has an area of one."""
    step = math.log(6.4) / 27
    top = min(top, rate / 2 - 1)
    mels = np.linspace(0, top * 3 / 200 if top < 1000 else 15 + math.log(top / 1000) / step, len(filters) + 2)
    hz = np.where(mels < 15, mels * 200 / 3, 1000 * np.exp(step * (mels - 15)))
    return filters * (2 / (hz[2:] - hz[:-2]))[:, None]


@lru_cache(maxsize=8)
def mel_weights(rate: int, size: int, bands: int, top: float) -> np.ndarray:
    """[size // 2 + 1, bands]: the filters of one model."""
    return unit_area(mel_filters(rate, size, bands, top), rate, top).T


def mel_frames(mono: np.ndarray, spec: tuple[int, int, int, int, float], mode: str) -> np.ndarray:
    """Mel power of frames centred on every hop, the ends padded by `mode`. A frame of zeros has no power, so only the others are transformed."""
    rate, size, hop, bands, top = spec
    padded = np.pad(mono, size // 2, mode=mode)
    filters = mel_weights(rate, size, bands, top)
    cut = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    sounding, starts = np.flatnonzero(padded), np.arange(len(cut)) * hop
    live = np.flatnonzero(np.searchsorted(sounding, starts + size) > np.searchsorted(sounding, starts))
    out = np.zeros((len(cut), bands))
    for a in range(0, len(live), 1024):
        out[live[a : a + 1024]] = powers(cut[live[a : a + 1024]]) @ filters
    return out


def effnet_patches(mono: np.ndarray, rate: int) -> np.ndarray:
    """[patches, 128, 96]: log10(1 + 10,000 times the mel power), patches of 128 frames every 62, the rest left out."""
    size, hop = CUTTERS["effnet_patch"]
    audio = resampled(mono, rate, EFFNET[0])
    bands = np.log10(1 + 1e4 * mel_frames(audio, EFFNET, "constant")) if len(audio) else np.zeros((0, EFFNET[3]))
    if len(bands) < size:
        return np.zeros((0, size, EFFNET[3]), np.float32)
    return np.stack([bands[a : a + size] for a in range(0, len(bands) - size + 1, hop)]).astype(np.float32)


def dclap_segments(mono: np.ndarray, rate: int) -> np.ndarray:
    """[segments, 128, frames]: ten seconds every five, a last one that ends with the recording, a short recording padded with silence; samples are rounded
    towards zero to 16 bits and the mel power is in decibels."""
    length, hop = CUTTERS["dclap"]
    audio = np.trunc(np.clip(resampled(mono, rate, DCLAP[0]), -1, 1) * 32767) / 32767
    frames = 1 + length // DCLAP[2]
    if not len(audio):
        return np.zeros((0, DCLAP[3], frames), np.float32)
    if len(audio) <= length:
        parts = [np.pad(audio, (0, length - len(audio)))]
    else:
        parts = [audio[a : a + length] for a in range(0, len(audio) - length + 1, hop)]
        if len(parts) * hop < len(audio):
            parts.append(audio[-length:])
    return np.stack([10 * np.log10(np.maximum(mel_frames(p, DCLAP, "reflect"), 1e-10)).T for p in parts]).astype(np.float32)


@lru_cache(maxsize=8)
def gate_weights(rate: int, size: int, bands: int, top: float) -> np.ndarray:
    """[size // 2 + 1, bands]: triangles evenly spaced on the scale 1127 ln(1 + f / 700)."""
    mel = lambda f: 1127 * np.log1p(f / 700)
    edges = np.linspace(0, mel(top), bands + 2)
    at = mel(np.fft.rfftfreq(size, 1 / rate))
    up = (at - edges[:-2, None]) / (edges[1] - edges[0])
    down = (edges[2:, None] - at) / (edges[1] - edges[0])
    return np.maximum(0, np.minimum(up, down)).T


def gate_chunks(mono: np.ndarray, rate: int) -> list[np.ndarray]:
    """Tables of 64 bands by at most 1,000 frames: power on the scale 1127 ln(1 + f / 700), frames of 32 ms every 10 ms with the ends mirrored; a last
    chunk of less than 100 frames is left out unless it is the only one."""
    fs, size, hop, n_bands, top = GATE
    audio = resampled(mono, rate, fs)
    n = (len(audio) + hop // 2) // hop
    if not n:
        return []
    filters = gate_weights(fs, size, n_bands, top)
    before = size // 2 - hop // 2
    padded = np.pad(audio, (before, max(0, (n - 1) * hop + size - before - len(audio))), mode="symmetric")
    cut = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][:n]
    most = CUTTERS["content_gate"][0]
    chunks = [cut[a : a + most] for a in range(0, n, most)]
    return [(powers(c) @ filters).T.astype(np.float32) for i, c in enumerate(chunks) if i == 0 or len(c) >= LEAST_CHUNK]


def stem_windows(mono: np.ndarray, rate: int) -> np.ndarray:
    """[windows, 16,000]: whole seconds, each brought to -12 LUFS as one channel; silent ones stay as they are."""
    size = CUTTERS["stem_instrument"][0]
    audio = resampled(mono, rate, 16_000)
    parts = audio[: len(audio) // size * size].reshape(-1, size).astype(np.float64)
    for part in parts:
        measured, _ = loudness(part, part, 16_000)
        if measured is not None:
            part *= 10 ** ((STEM_LUFS - (measured - 10 * math.log10(2))) / 20)
    return parts


FRONTENDS = {"effnet_patch": effnet_patches, "dclap": dclap_segments, "content_gate": gate_chunks, "stem_instrument": stem_windows}


def _few(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[list[tuple[np.ndarray | None, int]]]:
    """Recordings in order, up to TOGETHER samples of them at a time; None for one that gives no call."""
    for monos, rates in batches:
        held, size = [], 0
        for m, r in zip(monos, rates, strict=True):
            fine = not pd.isna(r) and r > 0
            seconds = len(m) / r if fine and m is not None else 0
            if held and size + seconds * DCLAP[0] > TOGETHER:
                yield held
                held, size = [], 0
            held.append((_samples(m), int(r)) if fine else (None, 0))
            size += seconds * DCLAP[0]
        if held:
            yield held


def _calls(kind: str, mono: np.ndarray | None, rate: int) -> list[np.ndarray]:
    return [] if mono is None else [np.asarray(c, np.float32).ravel() for c in FRONTENDS[kind](mono, rate)]


def model_inputs(kind: str) -> Callable[..., Column]:
    """A function of the columns (samples, rate) that gives array<array<float>>: one flat table for each call of the model of that kind. Null samples
    and rates that aren't positive give no call."""

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for held in _few(batches):
            yield pd.Series([_calls(kind, m, r) for m, r in held], dtype=object)

    return run


def all_model_inputs(kinds: dict[str, str]) -> Callable[..., Column]:
    """model_inputs() of several kinds in one pass over the recordings: a struct with a field for each name."""

    @F.pandas_udf(T.StructType([T.StructField(n, T.ArrayType(T.ArrayType(T.FloatType()))) for n in kinds]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for held in _few(batches):
            yield pd.DataFrame({n: pd.Series([_calls(kind, m, r) for m, r in held], dtype=object) for n, kind in kinds.items()})

    return run
