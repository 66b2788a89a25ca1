"""Frame features of decoded audio, in one pass of a file's samples: RMS gates, spectral descriptors, onset envelopes and rendered takes.

Each function takes the samples of one recording; the UDFs run them over Arrow batches of files.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME, HOP = 2048, 1024
ONSET_HOP, MEL_BANDS, MEL_TOP = 256, 128, 11_000.0
SUB_BAND = (20.0, 80.0)


def _samples(x: object) -> np.ndarray:
    return np.asarray([] if x is None else x, np.float64)


def frames(mono: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Whole frames of a signal."""
    if len(mono) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(mono, size)[::hop]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def frame_rms(mono: pd.Series) -> pd.Series:
    """RMS of each frame."""
    return pd.Series([np.sqrt((frames(_samples(m)) ** 2).mean(axis=1)).tolist() for m in mono])


def spectra(mono: np.ndarray, size: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Magnitude spectra of Hann-windowed frames."""
    return np.abs(np.fft.rfft(frames(mono, size, hop) * np.hanning(size), axis=1))


DESCRIPTORS = ["spectral_centroid_hz", "spectral_flatness", "sub_ratio", "flux_mean", "flux_stddev", "crest_factor", "peak_db", "frame_count", "integrated_lufs", "loudness_range", "true_peak_db", "attack_seconds", "harmonicity", "mfcc", "chroma"]
MFCC_BANDS, MFCC_SIZE, CHROMA_SIZE = 40, 13, 12


def k_weighted(channel: np.ndarray, rate: int) -> np.ndarray:
    """A channel through the two filters of ITU-R BS.1770 (a shelf of 4 dB above some 1.7 kHz, a high pass at 38 Hz), by their response at each frequency."""

    def biquad(f0: float, q: float, gain: float | None) -> tuple[np.ndarray, np.ndarray]:
        k = math.tan(math.pi * f0 / rate)
        a0 = 1 + k / q + k * k
        down = np.array([1.0, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
        if gain is None:
            return np.array([1.0, -2.0, 1.0]), down
        high = 10 ** (gain / 20)
        mid = high**0.4996667741545416
        return np.array([high + mid * k / q + k * k, 2 * (k * k - high), high - mid * k / q + k * k]) / a0, down

    n = 1 << (2 * len(channel) - 1).bit_length()
    z = np.exp(-2j * math.pi * np.fft.rfftfreq(n))
    response = np.ones(len(z), complex)
    for f0, q, gain in ((1681.974450955533, 0.7071752369554196, 3.999843853973347), (38.13547087602444, 0.5003270373238773, None)):
        up, down = biquad(f0, q, gain)
        response *= (up[0] + up[1] * z + up[2] * z * z) / (down[0] + down[1] * z + down[2] * z * z)
    return np.fft.irfft(np.fft.rfft(channel, n) * response, n)[: len(channel)]


def block_powers(channels: list[np.ndarray], rate: int, seconds: float, hop: float) -> np.ndarray:
    """Summed mean squares of the weighted channels in blocks."""
    size, step = int(seconds * rate), max(1, int(hop * rate))
    total = np.concatenate([[0.0], np.cumsum(sum(c * c for c in channels))])
    starts = np.arange(0, len(total) - size, step) if len(total) > size else np.zeros(0, int)
    return (total[starts + size] - total[starts]) / size


def loudness(left: np.ndarray, right: np.ndarray, rate: int) -> tuple[float | None, float | None]:
    """Integrated loudness (gated at -70 LUFS and 10 LU below the mean) and loudness range (EBU Tech 3342: 10th to 95th percentile of blocks of three
    seconds, gated at -70 LUFS and 20 LU below the mean); null where no block passes."""
    if not len(left) or rate <= 0:
        return None, None
    first = k_weighted(left, rate)
    channels = [first, first if right is left else k_weighted(right, rate)]
    level = lambda p: -0.691 + 10 * np.log10(np.maximum(p, 1e-20))

    def gated(powers: np.ndarray, below: float) -> np.ndarray:
        loud = powers[level(powers) > -70]
        return loud[level(loud) > level(loud.mean()) - below] if len(loud) else loud

    short = gated(block_powers(channels, rate, 0.4, 0.1), 10)
    long = gated(block_powers(channels, rate, 3.0, 1.0), 20)
    spread = np.percentile(level(long), [10, 95]) if len(long) else None
    return float(level(short.mean())) if len(short) else None, float(spread[1] - spread[0]) if spread is not None else None


def true_peak(mono: np.ndarray) -> float:
    """Highest magnitude of the signal at twice its rate."""
    n = len(mono)
    return float(max(np.abs(mono).max(), np.abs(np.fft.irfft(np.fft.rfft(mono), 2 * n)).max() * 2)) if n > 1 else float(np.abs(mono).max(initial=0.0))


def attack(mono: np.ndarray, rate: int) -> float | None:
    """Seconds from 20 % to 90 % of the envelope's maximum; the envelope takes each millisecond's peak and falls by a time constant of 1.5 s."""
    step = max(1, rate // 1000)
    peaks = np.abs(mono[: len(mono) // step * step]).reshape(-1, step).max(axis=1) if len(mono) >= step else np.zeros(0)
    if not len(peaks) or peaks.max() <= 0:
        return None
    t = np.arange(len(peaks)) * (step / rate) / 1.5
    envelope = np.exp(np.maximum.accumulate(np.log(np.maximum(peaks, 1e-12)) + t) - t)
    begin, end = (int(np.argmax(envelope >= share * envelope.max())) for share in (0.2, 0.9))
    return float((end - begin) * step / rate)


def harmonic_share(table: np.ndarray, hz: np.ndarray) -> float | None:
    """Mean over frames of the share of energy at the first eight multiples (a bin to either side) of the frame's pitch, from 50 Hz to 1 kHz, which is the one
    with the largest share."""
    step = hz[1]
    energy = table**2
    pitches = np.arange(max(2, int(50 / step)), int(1000 / step) + 1)
    if not len(pitches):
        return None
    sums = np.concatenate([np.zeros((len(energy), 1)), np.cumsum(energy, axis=1)], axis=1)
    best = np.zeros(len(energy))
    for p in pitches:
        at = np.arange(1, 9) * p
        at = at[at + 2 < sums.shape[1]]
        best = np.maximum(best, (sums[:, at + 2] - sums[:, at - 1]).sum(axis=1))
    return float((best / energy.sum(axis=1)).mean())


def cepstrum(table: np.ndarray, rate: int) -> np.ndarray:
    """Mean MFCC of magnitude spectra."""
    bands = np.log(np.maximum(table**2 @ mel_filters(rate, FRAME, MFCC_BANDS).T, 1e-10))
    turn = np.cos(math.pi / MFCC_BANDS * (np.arange(MFCC_BANDS) + 0.5)[None, :] * np.arange(MFCC_SIZE)[:, None])
    return (bands @ turn.T).mean(axis=0)


def pitch_classes(table: np.ndarray, hz: np.ndarray) -> np.ndarray:
    """Mean share of each pitch class (from A) in the energy of spectral peaks from 40 Hz to 5 kHz."""
    inner = table[:, 1:-1]
    top = (inner > table[:, :-2]) & (inner >= table[:, 2:]) & (hz[1:-1] >= 40) & (hz[1:-1] <= 5000)
    of = np.floor(12 * np.log2(np.maximum(hz[1:-1], 1e-9) / 440.0) + 0.5).astype(int) % CHROMA_SIZE
    out = np.stack([np.where(top & (of == c), inner**2, 0.0).sum(axis=1) for c in range(CHROMA_SIZE)], axis=1)
    return (out / np.maximum(out.sum(axis=1, keepdims=True), 1e-20)).mean(axis=0)


def describe(mono: np.ndarray, rate: int, left: np.ndarray | None = None, right: np.ndarray | None = None) -> dict:
    """Averages over frames: centroid, flatness (geometric over arithmetic mean), share of energy from 20 to 80 Hz, change from frame to frame of the
    normalised spectrum; crest factor and peak of the samples. Null for silence or too short a signal."""
    out: dict = dict.fromkeys(DESCRIPTORS)
    size = np.abs(mono)
    if len(mono) and size.max() > 0:
        integrated, spread = loudness(mono if left is None else left, mono if right is None else right, rate)
        out |= {"crest_factor": float(size.max() / size.mean()), "peak_db": float(20 * math.log10(size.max())), "integrated_lufs": integrated, "loudness_range": spread}
        out |= {"true_peak_db": 20 * math.log10(true_peak(mono)), "attack_seconds": attack(mono, rate)}
    table = spectra(mono)
    out["frame_count"] = len(table)
    sums = table.sum(axis=1)
    loud = table[sums > 0]
    if not len(loud):
        return out
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    energy = loud**2
    norm = loud / np.linalg.norm(loud, axis=1, keepdims=True)
    flux = np.concatenate([[1.0], np.linalg.norm(np.diff(norm, axis=0), axis=1)])
    return out | {
        "spectral_centroid_hz": float((loud @ hz / loud.sum(axis=1)).mean()),
        "spectral_flatness": float((np.exp(np.log(energy + 1e-20).mean(axis=1)) / energy.mean(axis=1)).mean()),
        "sub_ratio": float((energy[:, (hz >= SUB_BAND[0]) & (hz <= SUB_BAND[1])].sum(axis=1) / energy.sum(axis=1)).mean()),
        "flux_mean": float(flux.mean()),
        "flux_stddev": float(flux.std()),
        "harmonicity": harmonic_share(loud, hz),
        "mfcc": cepstrum(loud, rate).tolist(),
        "chroma": pitch_classes(loud, hz).tolist(),
    }


_KINDS = {"frame_count": T.LongType(), "mfcc": T.ArrayType(T.DoubleType()), "chroma": T.ArrayType(T.DoubleType())}


@F.pandas_udf(T.StructType([T.StructField(n, _KINDS.get(n, T.DoubleType())) for n in DESCRIPTORS]))
def descriptors(mono: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """Descriptors of each recording, of which the mono mix counts as both channels."""
    found = pd.DataFrame([describe(_samples(m), int(r)) for m, r in zip(mono, rate, strict=True)], columns=DESCRIPTORS)
    return found.astype({n: "float64" for n in DESCRIPTORS if n not in _KINDS})


def mel_filters(rate: int, size: int = FRAME, bands: int = MEL_BANDS, top: float = MEL_TOP) -> np.ndarray:
    """Triangular filters, evenly spaced on Slaney's scale up to `top` or half the rate."""
    step = math.log(6.4) / 27
    to_mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / step
    mels = np.linspace(0, to_mel(min(top, rate / 2 - 1)), bands + 2)
    hz = np.where(mels < 15, mels * 200 / 3, 1000 * np.exp(step * (mels - 15)))
    at = np.fft.rfftfreq(size, 1 / rate)
    up = (at - hz[:-2, None]) / (hz[1:-1] - hz[:-2])[:, None]
    down = (hz[2:, None] - at) / (hz[2:] - hz[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def onset_envelope(mono: np.ndarray, rate: int) -> np.ndarray:
    """Half-wave rectified change of the log-mel spectrum, the mean over bands; frames are centred by reflection."""
    if len(mono) < FRAME or rate <= 0:
        return np.zeros(0)
    padded = np.pad(mono, FRAME // 2, mode="reflect")
    db = 10 * np.log10(np.maximum(spectra(padded, FRAME, ONSET_HOP) @ mel_filters(rate).T, 1e-10))
    return np.concatenate([[0.0], np.maximum(0, np.diff(db, axis=0)).mean(axis=1)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def envelopes(mono: pd.Series, rate: pd.Series) -> pd.Series:
    """Onset envelope of each file, for rhythm.onset_times with a hop of 256 / rate."""
    return pd.Series([onset_envelope(_samples(m), int(r)).tolist() for m, r in zip(mono, rate, strict=True)])


def render_take(channels: np.ndarray, rate: int, start: float, end: float, gain_db: float, fade_in: float, fade_out: float) -> tuple[np.ndarray, float]:
    """A take cut, amplified and faded, and its peak. An end that isn't after the start means the whole; fades that don't fit shrink in proportion."""
    total = channels.shape[1]
    first = min(max(0, int(start * rate + 0.5)), total)
    last = min(max(first, int(end * rate + 0.5) if end > start else total), total)
    out = channels[:, first:last] * (10 ** (gain_db / 20) if gain_db > -100 else 0.0)
    n = last - first
    if not n:
        return out, 0.0
    fade_in, fade_out = max(0.0, fade_in), max(0.0, fade_out)
    if fade_in + fade_out > n / rate:
        fade_in, fade_out = (x * n / rate / (fade_in + fade_out) for x in (fade_in, fade_out))
    a, b = int(fade_in * rate + 0.5), int(fade_out * rate + 0.5)
    at = np.arange(n)
    curve = np.where(at < a, at / max(a, 1), 1.0) * np.where(at >= n - b, (n - at) / max(b, 1), 1.0)
    out = out * curve
    return out, float(np.abs(out).max())


RENDERED = T.StructType().add("wav", T.BinaryType()).add("n_frames", T.LongType()).add("peak", T.DoubleType()).add("clipped", T.BooleanType())


@F.pandas_udf(RENDERED)
def rendered(content: pd.Series, edit: pd.DataFrame) -> pd.DataFrame:
    """edit: start, end, gain_db, fade_in, fade_out. The take as WAV, with peak and whether it clips; nulls if it can't be read or nothing is left."""
    from sonolith.sources.files import decode_wav, encode_wav

    rows = []
    for c, e in zip(content, edit.to_dict("records"), strict=True):
        d = decode_wav(c)
        if d is None:
            rows.append((None, None, None, None))
            continue
        table = np.stack([d["left"], d["right"]][: min(2, d["channels"])])
        out, peak = render_take(table, d["rate"], *(e[k] or 0.0 for k in ("start", "end", "gain_db", "fade_in", "fade_out")))
        rows.append((encode_wav(out[0], out[1] if len(out) > 1 else None, d["rate"]), out.shape[1], peak, peak > 1.0) if out.shape[1] else (None, 0, None, None))
    return pd.DataFrame(rows, columns=["wav", "n_frames", "peak", "clipped"])
