"""Beat-grid, groove, meter and onset statistics.

A file is one row with its beats, onsets or frames in arrays, whose length is bounded by the file's. What a fold or a sort of one
array expresses stays in SQL array functions; sweeps and arbitration, which don't, are Arrow UDFs over batches of files.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.functions.arrays import let
from sonolith.operators.aggregates import median_mid, median_upper

BINS = 16
LEAST_ONSETS = 80
LEAST_STRENGTH = 1.50
PERIODS = (0.28, 1.20, 0.0005)
GRID_LEAST_BEATS = 12
#: Stability below which the second beat track is looked at.
GRID_CROSS_CHECK = 0.90


def intervals(beats: Column) -> Column:
    """Differences of neighbours."""
    n = F.greatest(F.size(beats) - 1, F.lit(0))
    return F.zip_with(F.slice(beats, 2, n), F.slice(beats, 1, n), lambda b, a: b - a)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _stddev(values: Column) -> Column:
    """Population standard deviation of an array."""
    return let(values, lambda v: let(_mean(v), lambda mean: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(v))))


def median_bpm(beats: Column) -> Column:
    """60 over the median interval; 0 without one."""
    m = median_mid(intervals(beats))
    return F.when(m > 0, 60 / m).otherwise(0.0)


def jitter(beats: Column, least_beats: int = 16, sane: float = 2.0) -> Column:
    """Deviation of the intervals over their mean; null with few beats, with beats out of order, or beyond what a player does."""
    def of(steps: Column) -> Column:
        value = let(_stddev(steps) / _mean(steps), lambda v: F.when(v <= sane, v))
        return F.when((F.size(steps) >= least_beats - 1) & F.forall(steps, lambda x: x > 0), value)

    return let(intervals(beats), of)


def grid_stability(beats: Column, tolerance: float = 0.25) -> Column:
    """Share of intervals within the tolerance of the upper median; 0 with fewer than two."""
    def share(steps: Column) -> Column:
        even = lambda m: F.size(F.filter(steps, lambda x: F.abs(x - m) <= tolerance * m))
        return let(median_upper(steps), lambda m: F.when((F.size(steps) >= 2) & (m > 0), even(m) / F.size(steps)).otherwise(0.0))

    return let(intervals(beats), share)


def grid_source(dbn: Column, minimal: Column, below: float = 0.90) -> Column:
    """Which of two beat tracks to use: the first, unless it is unstable and the second is steadier and long enough."""
    a, b = grid_stability(dbn), grid_stability(minimal)
    return F.when((a < below) & (b > a) & (F.size(minimal) >= GRID_LEAST_BEATS), "minimal").otherwise("dbn")


def tempo_windows(beats: Column, width: float = 60.0) -> Column:
    """Tempo of each window of `width` seconds with two beats or more. Beats ascend, so a window is a run of them and one pass finds all."""

    def of(b: Column) -> Column:
        window = lambda i: F.floor(F.get(b, i) / width)
        starts = F.array_compact(F.transform(b, lambda x, i: F.when((x >= 0) & ((i == 0) | ~window(i - 1).eqNullSafe(window(i))), i)))
        ends = F.array_compact(F.transform(b, lambda x, i: F.when((x >= 0) & ((i == F.size(b) - 1) | ~window(i + 1).eqNullSafe(window(i))), i)))
        runs = F.arrays_zip(starts.alias("a"), ends.alias("e"))
        means = F.transform(F.filter(runs, lambda r: r["e"] > r["a"]), lambda r: (F.get(b, r["e"]) - F.get(b, r["a"])) / (r["e"] - r["a"]))
        return F.transform(F.filter(means, lambda m: m > 0), lambda m: 60 / m)

    return let(beats, of)


def tempo_stability(beats: Column) -> Column:
    """Struct of window_count, stddev_bpm, range_bpm and unstable; all zero with fewer than three windows."""
    def of(w: Column) -> Column:
        enough = F.size(w) >= 3
        return let(
            _stddev(w),
            lambda stddev: F.struct(
                F.when(enough, F.size(w)).otherwise(0).alias("window_count"),
                F.when(enough, stddev).otherwise(0.0).alias("stddev_bpm"),
                F.when(enough, F.array_max(w) - F.array_min(w)).otherwise(0.0).alias("range_bpm"),
                F.coalesce(enough & (stddev > 10.0), F.lit(False)).alias("unstable"),
            ),
        )

    return let(tempo_windows(beats), of)


def rhythm_stage(files: DataFrame, recheck: Column | None = None) -> DataFrame:
    """The rhythm stage of files(id, dbn_beats, dbn_downbeats, minimal_beats, minimal_downbeats, second_bpm): which of two beat tracks is used, its
    stability (that of the second is -1 where it isn't looked at), median and fitted tempo, tempo windows, a second estimator's tempo (if `recheck`
    holds) and its ratio to the first, and whether either found a tempo."""
    recheck = F.lit(True) if recheck is None else recheck
    rows = files.withColumns({"_dbn": grid_stability(F.col("dbn_beats")), "_other": grid_stability(F.col("minimal_beats"))})
    crossed = F.col("_dbn") < GRID_CROSS_CHECK
    minimal = F.coalesce(crossed & (F.col("_other") > F.col("_dbn")) & (F.size("minimal_beats") >= GRID_LEAST_BEATS), F.lit(False))
    rows = rows.select(
        "id",
        F.when(minimal, "minimal").otherwise("dbn").alias("grid_source"),
        F.when(minimal, F.col("_other")).otherwise(F.col("_dbn")).alias("stability"),
        F.col("_dbn").alias("stability_dbn"),
        F.when(crossed, F.col("_other")).otherwise(-1.0).alias("stability_minimal"),
        F.when(minimal, F.col("minimal_beats")).otherwise(F.col("dbn_beats")).alias("beats"),
        F.when(minimal, F.col("minimal_downbeats")).otherwise(F.col("dbn_downbeats")).alias("downbeats"),
        F.when(recheck, F.coalesce("second_bpm", F.lit(0.0))).otherwise(0.0).alias("second_bpm"),
    )
    rows = rows.withColumns({"bpm": F.coalesce(median_bpm(F.col("beats")), F.lit(0.0)), "_period": fitted_period(F.col("beats")), "tempo": tempo_stability(F.col("beats"))})
    fitted = F.when(F.col("_period") > 0, 60 / F.col("_period")).otherwise(0.0)
    ratio = F.when((F.col("bpm") > 0) & (F.col("second_bpm") > 0), F.col("second_bpm") / F.col("bpm"))
    return rows.withColumns({"fitted_bpm": fitted, "bpm_ratio": ratio, "ok": (F.col("bpm") > 0) | (F.col("second_bpm") > 0)}).drop("_period")


def fit_period(beats: np.ndarray) -> float:
    """Slope of beat times over beat numbers; see fitted_period()."""
    steps = np.diff(beats)
    if len(steps) < GRID_LEAST_BEATS:
        return 0.0
    middle = np.sort(steps)[len(steps) // 2]
    if middle <= 0:
        return 0.0
    folded = steps[steps > 0]
    for _ in range(4):
        folded = np.where(folded < middle * 0.75, folded * 2, folded)
    for _ in range(4):
        folded = np.where(folded > middle * 1.5, folded * 0.5, folded)
    if len(folded) < GRID_LEAST_BEATS:
        return 0.0
    raw = steps / np.sort(folded)[len(folded) // 2]
    whole = np.sign(raw) * np.floor(np.abs(raw) + 0.5)
    usable = np.concatenate([[True], (whole >= 1) & (np.abs(raw - whole) < 0.25)])
    x, y = np.concatenate([[0.0], np.cumsum(whole)])[usable], beats[usable]
    if len(x) < GRID_LEAST_BEATS:
        return 0.0
    denominator = len(x) * (x * x).sum() - x.sum() ** 2
    return max(0.0, float((len(x) * (x * y).sum() - x.sum() * y.sum()) / denominator)) if abs(denominator) >= 1e-12 else 0.0


def _floats(values: object) -> np.ndarray:
    return np.asarray([] if values is None else values, np.float64)


@F.pandas_udf(T.DoubleType())
def fitted_period(beats: pd.Series) -> pd.Series:
    """Slope of beat times over beat numbers: intervals are folded by octaves to their median, each step is rounded to whole periods, steps off by
    a quarter or more are left out. 0 with fewer than twelve usable beats."""
    return pd.Series([fit_period(_floats(b)) for b in beats], dtype="float64")


def phases_between(onsets: np.ndarray, beats: np.ndarray, at_beat_is_zero: bool) -> np.ndarray:
    """Phase (0 to 1) of each onset between the beats around it; onsets outside the grid are left out. An onset on a beat has phase 0 of the
    interval that begins there, or phase 1 of the one that ends."""
    after = np.searchsorted(beats, onsets, side="right" if at_beat_is_zero else "left")
    inside = (after > 0) & (after < len(beats))
    after, onsets = after[inside], onsets[inside]
    width = beats[after] - beats[after - 1]
    fine = width > 0
    return (onsets[fine] - beats[after[fine] - 1]) / width[fine]


def crowding(phases: np.ndarray) -> float:
    """Highest of the phase bins over a uniform one."""
    bins = np.clip((phases * BINS).astype(np.int64), 0, BINS - 1)
    return float(np.bincount(bins, minlength=BINS).max() * BINS / len(phases)) if len(phases) else 0.0


@F.pandas_udf(T.DoubleType())
def grid_concentration(onsets: pd.Series, beats: pd.Series) -> pd.Series:
    """How much onsets crowd one phase of the beat: 1 is even, 16 is one bin; 0 with too few of either."""
    out = []
    for o, b in zip(onsets, beats, strict=True):
        o, b = _floats(o), _floats(b)
        phases = phases_between(o, b, False) if len(o) >= 8 and len(b) >= 4 else np.zeros(0)
        out.append(crowding(phases) if len(phases) >= 8 else 0.0)
    return pd.Series(out, dtype="float64")


def grid_supported(score: Column, fitted: Column) -> Column:
    return (score > 1.15) & (score >= 0.75 * fitted)


GROOVE_FIELDS = ["omitted", "bpm", "strength", "resultant", "onsets_per_beat", "swing", "pocket", "syncopation"]
GROOVE = T.StructType([T.StructField(n, T.StringType() if n == "omitted" else T.DoubleType()) for n in GROOVE_FIELDS])


def groove_offsets(phases: np.ndarray) -> dict:
    """Swing (mean phase of off-beats), pocket (mean distance to the nearest sixteenth) and syncopation (share of onsets off the beat)."""
    off = phases[(phases > 0.25) & (phases < 0.75)]
    whole = np.floor(phases * 4 + 0.5)
    return {"swing": float(off.mean()) if len(off) >= LEAST_ONSETS // 4 else None, "pocket": float(((phases * 4 - whole) / 4).mean()), "syncopation": float((whole.astype(int) % 4 != 0).mean())}


def groove_against(onsets: np.ndarray, beats: np.ndarray) -> dict:
    """Groove against detected beats; see groove_on_beats()."""
    out: dict = dict.fromkeys(GROOVE_FIELDS)
    if len(onsets) < LEAST_ONSETS:
        return out | {"omitted": "too few onsets"}
    if len(beats) < 4:
        return out | {"omitted": "no beat grid"}
    phases = phases_between(np.sort(onsets), beats, True)
    if len(phases) < LEAST_ONSETS:
        return out | {"omitted": "too few onsets inside the beat grid"}
    steps = np.sort(np.diff(beats))
    middle = float(steps[len(steps) // 2])
    turn = 2 * math.pi * phases
    out |= {"bpm": 60 / middle if middle > 0 else 0.0, "strength": crowding(phases), "resultant": float(np.hypot(np.sin(turn).sum(), np.cos(turn).sum()) / len(phases)), "onsets_per_beat": len(phases) / (len(beats) - 1)}
    if out["strength"] < LEAST_STRENGTH:
        return out | {"omitted": "no grid lock"}
    return out | {"omitted": ""} | groove_offsets(phases)


@F.pandas_udf(GROOVE)
def groove_on_beats(onsets: pd.Series, beats: pd.Series) -> pd.DataFrame:
    """Groove against detected beats: omitted (why, empty if it isn't), bpm, strength, resultant, onsets_per_beat, swing, pocket, syncopation."""
    return pd.DataFrame([groove_against(_floats(o), _floats(b)) for o, b in zip(onsets, beats, strict=True)], columns=GROOVE_FIELDS)


def _resultant(onsets: np.ndarray, periods: np.ndarray) -> np.ndarray:
    angle = 2 * math.pi / periods[:, None] * onsets
    return np.hypot(np.cos(angle).sum(axis=1), np.sin(angle).sum(axis=1)) / len(onsets)


def fit_groove(onsets: np.ndarray, first_bpm: float | None, second_bpm: float | None) -> dict:
    """Groove against a period fitted to the onsets; see fitted_groove()."""
    out: dict = {"omitted": "", "bpm": None, "strength": None, "resultant": None, "source": None, "swing": None, "pocket": None, "syncopation": None}
    if len(onsets) < LEAST_ONSETS:
        return out | {"omitted": "too few onsets"}
    onsets = np.sort(onsets)
    low, high, step = PERIODS
    sweep = np.cumsum(np.concatenate([[low], np.full(int((high - low) / step) + 2, step)]))
    sweep = sweep[sweep <= high]
    fitted = sweep[np.argmax(np.concatenate([_resultant(onsets, part) for part in np.array_split(sweep, 16)]))]
    octaves = [fitted * x for x in (0.5, 2 / 3, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0) if 55.0 <= 60 / (fitted * x) <= 200.0]
    period, source = fitted, "onsets"
    if octaves:
        away = lambda p, bpm: abs(math.log2(60 / p / bpm))
        period, source = min(octaves, key=lambda p: away(p, 110.0)), "uncorroborated"
        for bpm, name in ((second_bpm, "second"), (first_bpm, "first")):
            if bpm and bpm > 0:
                near = min(octaves, key=lambda p: away(p, bpm))  # noqa: B023
                if away(near, bpm) < 0.0431:
                    period, source = near, name
    angle = 2 * math.pi / period * onsets
    turned = math.atan2(np.sin(angle).sum(), np.cos(angle).sum()) % (2 * math.pi)
    phases = np.mod(onsets - turned / (2 * math.pi) * period, period) / period
    strength = crowding(phases)
    out |= {"bpm": 60 / period, "strength": strength, "resultant": float(_resultant(onsets, np.array([period]))[0]), "source": source}
    if strength < LEAST_STRENGTH:
        return out | {"omitted": "no grid lock"}
    if source == "uncorroborated":
        return out | {"omitted": "grid not corroborated by any tempo estimate"}
    return out | groove_offsets(phases)


FITTED_FIELDS = ["omitted", "bpm", "strength", "resultant", "source", "swing", "pocket", "syncopation"]
FITTED = T.StructType([T.StructField(n, T.StringType() if n in {"omitted", "source"} else T.DoubleType()) for n in FITTED_FIELDS])


@F.pandas_udf(FITTED)
def fitted_groove(onsets: pd.Series, first_bpm: pd.Series, second_bpm: pd.Series) -> pd.DataFrame:
    """Groove without beats: the period from 0.28 to 1.2 s on which the onsets agree best, moved to the octave that a tempo estimate confirms within 3 %,
    the first estimate before the second."""
    some = lambda x: None if x is None or pd.isna(x) else float(x)
    rows = [fit_groove(np.asarray([] if o is None else o, float), some(a), some(b)) for o, a, b in zip(onsets, first_bpm, second_bpm, strict=True)]
    return pd.DataFrame(rows, columns=FITTED_FIELDS)


# onsets, meter, bars --------------------------------------------------------------------------------------------------


def pick_peaks(envelope: np.ndarray, hop: float) -> list[int]:
    """Frames that top their surroundings (30 ms) and the local mean (100 ms) by 0.3 deviations, at least 30 ms apart."""
    n = len(envelope)
    if n < 3 or hop <= 0:
        return []
    frames = lambda ms: max(1, int(ms / 1000 / hop + 0.5))
    top, mean, wait = frames(30), frames(100), frames(30)
    delta = 0.30 * envelope.std()
    padded = np.pad(envelope, top, constant_values=-np.inf)
    highest = np.lib.stride_tricks.sliding_window_view(padded, 2 * top + 1).max(axis=1)
    sums = np.concatenate([[0.0], np.cumsum(envelope, dtype=np.float64)])
    low, high = np.maximum(np.arange(n) - mean, 0), np.minimum(np.arange(n) + mean + 1, n)
    local = (sums[high] - sums[low]) / (high - low)
    out: list[int] = []
    for i in np.flatnonzero((envelope >= highest) & (envelope >= local + delta)):
        if not out or i - out[-1] > wait:
            out.append(int(i))
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def onset_times(envelope: pd.Series, hop: pd.Series) -> pd.Series:
    """Times of the peaks of an onset envelope, half a hop back."""
    return pd.Series([[max(0.0, i * h - h / 2) for i in pick_peaks(np.asarray([] if e is None else e, float), h)] for e, h in zip(envelope, hop, strict=True)])


def self_similarity(features: np.ndarray, most: int = 16) -> np.ndarray:
    """Mean cosine of beat vectors `lag` apart, for lags from 1."""
    unit = features / np.maximum(np.linalg.norm(features, axis=1, keepdims=True), 1e-12)
    out = np.full(most, -np.inf)
    for lag in range(1, min(most, len(unit) - 1) + 1):
        out[lag - 1] = (unit[:-lag] * unit[lag:]).sum(axis=1).mean()
    return out


def beat_means(frames: np.ndarray, beats: np.ndarray, hop: float) -> np.ndarray:
    """Mean frame vector from each beat to the next."""
    at = np.clip(np.floor(beats / hop).astype(int), 0, len(frames) - 1)
    sums = np.concatenate([np.zeros((1, frames.shape[1])), np.cumsum(frames, axis=0)])
    a, b = at[:-1], np.minimum(np.maximum(at[1:], at[:-1] + 1), len(frames))
    return (sums[b] - sums[a]) / np.maximum(b - a, 1)[:, None]


def accents_at(envelope: np.ndarray, beats: np.ndarray, hop: float) -> np.ndarray:
    """The envelope at each beat, over its maximum there."""
    if not len(envelope):
        return np.zeros(0)
    found = envelope[np.clip((beats / hop + 0.5).astype(int), 0, len(envelope) - 1)].astype(float)
    return found / found.max() if len(found) and found.max() > 0 else found


def accent_f(accents: np.ndarray, period: int) -> float:
    """ANOVA F of accents by position in a period; NaN if it can't be told."""
    n = len(accents)
    if period < 2 or n - period <= 0:
        return math.nan
    pos = np.arange(n) % period
    count = np.bincount(pos, minlength=period)
    means = np.bincount(pos, accents, minlength=period) / np.maximum(count, 1)
    within = ((accents - means[pos]) ** 2).sum()
    between = (count * (means - accents.mean()) ** 2).sum()
    return (between / (period - 1)) / (within / (n - period)) if within > 0 else math.nan


def find_meter(features: list[np.ndarray], envelope: np.ndarray, beats: np.ndarray, hop: float) -> dict:
    """Beats in a bar: each feature votes by its self-similarity peak (lags from 4, four bars at least); a split among 3, 4, 6, 8 and 12 is decided by accents; 8 and 16
    count as 4, 12 as 6."""
    out = {"meter": 0, "raw": 0, "votes": [], "arbitrated": False, "accent_f": None, "bar_count": 0, "bar_spread": None, "reason": ""}
    if not features or len(beats) < 12 or hop <= 0:
        return out | {"reason": "too few beats"}
    votes, best, strongest = [], -math.inf, 0
    for frames in features:
        acf = self_similarity(beat_means(frames, beats, hop))
        able = [i for i in range(3, len(acf)) if len(beats) // (i + 1) >= 4 and np.isfinite(acf[i])]
        if not able:
            continue
        top = max(able, key=lambda i: (acf[i], -i))  # noqa: B023
        votes.append(top + 1)
        if acf[top] > best:
            best, strongest = acf[top], len(votes) - 1
    if not votes:
        return out | {"reason": "too few bars to judge a meter"}
    meter = votes[strongest]
    different = sorted(set(votes))
    able = [d for d in different if d >= 3 and len(beats) // d >= 4]
    arbitrated, top_f = False, None
    if len(different) > 1 and {3, 4, 6, 8, 12} & set(different) and len(able) >= 2:
        accents = accents_at(envelope, beats, hop)
        scored = sorted(((accent_f(accents, c), c) for c in able if math.isfinite(accent_f(accents, c))), reverse=True)
        if scored:
            (top_f, meter), arbitrated = scored[0], True
    snapped = {8: 4, 16: 4, 12: 6}.get(meter, meter)
    bars = [beats[i + snapped] - beats[i] for i in range(0, len(beats) - snapped, snapped)] if snapped >= 2 else []
    spread = max(bars) / min(bars) if len(bars) >= 2 and min(bars) > 0 else None
    reason = f"all features agree on {different[0]}" if len(different) == 1 else "features split " + " ".join(map(str, different))
    return out | {"meter": snapped, "raw": meter, "votes": votes, "arbitrated": arbitrated, "accent_f": top_f, "bar_count": len(bars) if len(bars) >= 2 else 0, "bar_spread": spread, "reason": reason}


METER = (
    T.StructType().add("meter", T.IntegerType()).add("raw", T.IntegerType()).add("votes", T.ArrayType(T.IntegerType())).add("arbitrated", T.BooleanType())
    .add("accent_f", T.DoubleType()).add("bar_count", T.IntegerType()).add("bar_spread", T.DoubleType()).add("reason", T.StringType())
)


@F.pandas_udf(METER)
def meter(features: pd.Series, envelope: pd.Series, beats: pd.Series, hop: pd.Series) -> pd.DataFrame:
    """Meter of each file; features are arrays of frame matrices (array<array<array<double>>>)."""
    rows = []
    for f, e, b, h in zip(features, envelope, beats, hop, strict=True):
        tables = [np.stack([np.asarray(x, float) for x in m]) for m in f] if f is not None else []
        rows.append(find_meter(tables, np.asarray([] if e is None else e, float), np.asarray([] if b is None else b, float), h))
    return pd.DataFrame(rows)


def find_phase(beats: np.ndarray, downbeats: np.ndarray, envelope: np.ndarray, hop: float, meter_: int) -> dict:
    """Which beat begins a bar: the downbeats' position if they agree, accents among popular positions, else accents alone."""
    if meter_ < 2 or len(beats) < 2 * meter_:
        return {"phase": None, "agreement": None, "source": None, "bar_lines": []}
    counts: dict[int, int] = {}
    if len(downbeats) >= 3:
        for d in downbeats:
            p = int(np.argmin(np.abs(beats - d))) % meter_
            counts[p] = counts.get(p, 0) + 1
    total = sum(counts.values())
    accents = accents_at(envelope, beats, hop)
    mean = lambda p: accents[p::meter_].mean() if len(accents[p::meter_]) else -1.0
    agreement = max(counts.values()) / total if total else 0.0
    popular = [p for p in sorted(counts) if counts[p] / total >= 0.15]
    if len(popular) > 1:
        phase, source = max(popular, key=lambda p: (mean(p), -p)), "accent among downbeat residues"
    elif len(popular) == 1 and agreement >= 0.5:
        phase, source = popular[0], "downbeats"
    else:
        phase, source = max(range(meter_), key=lambda p: (mean(p), -p)), "accent fold (downbeats unusable)"
    return {"phase": phase, "agreement": agreement, "source": source, "bar_lines": [float(x) for x in beats[phase::meter_]]}


def bar_lines(beats: Column, downbeats: Column, per_bar: Column) -> Column:
    """Every per_bar-th beat from the one nearest to the first downbeat (the first one of a tie), backwards too."""
    away = F.transform(beats, lambda b, i: F.struct(F.abs(b - F.element_at(downbeats, 1)).alias("d"), i.alias("i")))
    return let(F.coalesce(F.array_min(away)["i"], F.lit(0)), lambda phase: F.filter(beats, lambda _, i: F.pmod(i - phase, per_bar) == 0))


@F.pandas_udf(T.DoubleType())
def on_grid_share(onsets: pd.Series, beats: pd.Series) -> pd.Series:
    """Share of onsets within 0.18 of a sixteenth; null without any inside the grid."""
    out = []
    for o, b in zip(onsets, beats, strict=True):
        phases = phases_between(_floats(o), _floats(b), True)
        out.append(float((np.abs(phases * 4 - np.floor(phases * 4 + 0.5)) <= 0.18).mean()) if len(phases) else None)
    return pd.Series(out, dtype="float64")


def tempo_parts(beats: Column, parts: int = 4) -> Column:
    """Tempo of equal counts of intervals (the last part takes the rest), by upper medians."""
    def of(steps: Column) -> Column:
        size = F.floor(F.size(steps) / parts).cast("int")
        part = lambda i: F.slice(steps, i * size + 1, F.when(i == parts - 1, F.size(steps) - (parts - 1) * size).otherwise(size))
        return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: 60 / median_upper(part(i))))

    return let(intervals(beats), of)


def fold_octave(bpm: Column, target: Column) -> Column:
    """A tempo moved by octaves next to another one."""
    return bpm * F.pow(F.lit(2.0), -F.floor(F.log2(bpm / target) + 0.5))


def beat_grid(first: Column, period: Column, end: Column) -> Column:
    n = F.floor((end - first) / period).cast("int")
    return F.when((period > 0) & (n >= 0), F.transform(F.sequence(F.lit(0), n), lambda i: first + i * period))


def halve_grid(beats: Column, downbeat: Column) -> Column:
    """Every second beat, those that hold the beat nearest the downbeat."""
    return bar_lines(beats, F.array(downbeat), F.lit(2))


def double_grid(beats: Column) -> Column:
    """Beats and the middles between them."""
    middles = F.zip_with(beats, F.slice(beats, 2, F.size(beats)), lambda a, b: F.when(b.isNotNull(), (a + b) / 2))
    return F.array_sort(F.concat(beats, F.filter(middles, lambda x: x.isNotNull())))


def snap(t: Column, beats: Column, division: int, reach: Column) -> Column:
    """The nearest subdivision of the grid within reach, else the time itself."""
    steps = F.arrays_zip(F.slice(beats, 1, F.greatest(F.size(beats) - 1, F.lit(0))).alias("b"), intervals(beats).alias("w"))
    lines = F.concat(F.flatten(F.transform(steps, lambda s: F.transform(F.sequence(F.lit(0), F.lit(division - 1)), lambda i: s["b"] + s["w"] * i / division))), F.slice(beats, -1, 1))
    near = F.array_min(F.transform(lines, lambda x: F.struct(F.abs(x - t).alias("d"), x.alias("x"))))
    return F.when(near["d"] <= reach, near["x"]).otherwise(t)
