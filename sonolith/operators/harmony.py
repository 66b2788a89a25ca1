"""Key and chords of decoded audio by published methods: pitch-class profiles of probe tones for the key (Krumhansl 1990), triad templates and a
Viterbi path for chords (Fujishima 1999; Sheh and Ellis 2003). Names are those of functions.scalars, so codes, slugs and chord roots follow from them.

The results are estimates of their own and needn't agree with another detector's on a given recording.

Odd input: null or empty samples, or a rate that isn't positive, give a null key and no chords; silence gives the key "silence" with empty codes and
the one chord N. A recording is read in blocks of frames, so memory beyond its own samples doesn't grow with its length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.functions.scalars import KEYS
from sonolith.operators.signal import _samples

FRAME_SECONDS, BLOCK = 0.37, 256
LOWEST_HZ, HIGHEST_HZ, FALL = 65.0, 2100.0, 0.6
#: Probe-tone ratings of the twelve pitch classes from the tonic up (Krumhansl 1990, major and minor).
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]
#: Pitch classes from C, in the spelling of key names and in that of chords.
KEY_ROOTS = ["C", "D flat", "D", "E flat", "E", "F", "G flat", "G", "A flat", "A", "B flat", "B"]
CHORD_ROOTS = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
NO_CHORD, SWITCH, NO_CHORD_LIKENESS = "N", 0.35, 0.6
QUIET = 1e-4


def frame_size(rate: int) -> int:
    """The power of two nearest to FRAME_SECONDS."""
    return 1 << max(6, round(np.log2(FRAME_SECONDS * rate)))


def chroma(mono: np.ndarray, rate: int) -> np.ndarray:
    """Pitch classes from C of each half-overlapped frame, the last one padded: peaks of the magnitude spectrum, placed between bins by a parabola and
    weighed less the higher they stand; frames of a unit length, or all zero where the signal is quiet."""
    size = frame_size(rate)
    hop = size // 2
    n = max(1, -(-max(0, len(mono) - size) // hop) + 1)
    window = np.hanning(size)
    bins = np.arange(1, size // 2)
    out = np.zeros((n, 12))
    for first in range(0, n, BLOCK):
        last = min(n, first + BLOCK)
        part = mono[first * hop : (last - 1) * hop + size]
        part = np.pad(part, (0, (last - 1 - first) * hop + size - len(part)))
        cut = np.lib.stride_tricks.sliding_window_view(part, size)[::hop]
        table = np.abs(np.fft.rfft(cut * window, axis=1))
        low, mid, high = table[:, :-2], table[:, 1:-1], table[:, 2:]
        bend = low - 2 * mid + high
        shift = np.where(bend < 0, 0.5 * (low - high) / np.where(bend < 0, bend, -1.0), 0.0)
        hz = (bins + np.clip(shift, -0.5, 0.5)) * (rate / size)
        loudest = table.max(axis=1, keepdims=True)
        peak = (mid > low) & (mid >= high) & (hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ) & (mid > 0.01 * loudest) & (loudest > QUIET * size / 4)
        row, at = np.nonzero(peak)
        note = 12 * np.log2(hz[row, at] / 440.0) + 69
        weight = mid[row, at] * FALL ** ((note - 48) / 12)
        np.add.at(out, (first + row, np.round(note).astype(np.int64) % 12), weight)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def key_of(mono: np.ndarray, rate: int) -> tuple[str | None, str | None, str | None]:
    """Name, Camelot and Open Key code: the major or minor profile that correlates best with the mean of all frames, of equal ones the first from C."""
    if not len(mono) or rate <= 0:
        return None, None, None
    mean = chroma(mono, rate).mean(axis=0)
    if not mean.any():
        return "silence", "", ""
    codes = {name: (camelot, open_key) for name, camelot, open_key in KEYS}
    best = (-2.0, "")
    for root in range(12):
        for profile, mode in ((MAJOR, "major"), (MINOR, "minor")):
            fit = float(np.corrcoef(mean, np.roll(profile, root))[0, 1]) if mean.std() > 0 else 0.0
            if fit > best[0] + 1e-12:
                best = (fit, f"{KEY_ROOTS[root]} {mode}")
    return (best[1], *codes[best[1]])


def chord_templates() -> tuple[list[str], np.ndarray]:
    """Labels of 24 triads, and a unit vector for each."""
    labels, rows = [], []
    for third, mode in ((4, ""), (3, "m")):
        for root in range(12):
            row = np.zeros(12)
            row[[root, (root + third) % 12, (root + 7) % 12]] = 3**-0.5
            labels.append(CHORD_ROOTS[root] + mode)
            rows.append(row)
    return labels, np.array(rows)


def chords_in(mono: np.ndarray, rate: int) -> list[tuple[float, str]]:
    """Changes of chord, as time (of the frame's middle; the first is 0) and label: the path through 24 triads and no chord with the greatest likeness,
    less SWITCH for each change; no chord counts as NO_CHORD_LIKENESS, and wholly where a frame is quiet."""
    if not len(mono) or rate <= 0:
        return []
    labels, templates = chord_templates()
    frames = chroma(mono, rate)
    quiet = ~frames.any(axis=1)
    likeness = np.concatenate([frames @ templates.T, np.where(quiet, 1.0, NO_CHORD_LIKENESS)[:, None]], axis=1)
    score, back = likeness[0], np.empty(likeness.shape, np.int8)
    for i in range(1, len(likeness)):
        top = int(np.argmax(score))
        stay = score >= score[top] - SWITCH
        back[i] = np.where(stay, np.arange(len(score)), top)
        score = np.where(stay, score, score[top] - SWITCH) + likeness[i]
    path = np.empty(len(likeness), np.int64)
    path[-1] = int(np.argmax(score))
    for i in range(len(likeness) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    changes = np.flatnonzero(np.diff(path, prepend=-1))
    size = frame_size(rate)
    names = [*labels, NO_CHORD]
    return [(0.0 if i == 0 else float((i * (size // 2) + size / 2) / rate), names[path[i]]) for i in changes]


@F.pandas_udf(T.StructType().add("key", T.StringType()).add("camelot", T.StringType()).add("open_key", T.StringType()))
def detected_key(mono: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """Key of each recording, with its codes."""
    return pd.DataFrame([key_of(_samples(m), 0 if pd.isna(r) else int(r)) for m, r in zip(mono, rate, strict=True)], columns=["key", "camelot", "open_key"], dtype=object)


CHANGE = T.StructType().add("t", T.DoubleType()).add("chord", T.StringType())


@F.pandas_udf(T.ArrayType(CHANGE))
def detected_chords(mono: pd.Series, rate: pd.Series) -> pd.Series:
    """Chord changes of each recording, as a document's `chords`."""
    return pd.Series([[{"t": t, "chord": c} for t, c in chords_in(_samples(m), 0 if pd.isna(r) else int(r))] for m, r in zip(mono, rate, strict=True)], dtype=object)
