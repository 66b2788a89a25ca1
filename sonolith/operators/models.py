"""What surrounds the neural stages: frame cutters, gates, pooling, typed readers of stored documents, and notes from activations.

Model weights are not part of this package. run_model() hosts any callable over Arrow batches, so weights are loaded once
for each worker; the rest works on what models return.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rate, window and hop in samples (or frames for patches) of each cutter.
CUTTERS = {"effnet_patch": (128, 62), "dclap": (480_000, 240_000), "stem_instrument": (16_000, 16_000), "content_gate": (1000, 1000)}
MUSIC_SCORE = 0.30
ONSET_LEVEL, FRAME_LEVEL, LEAST_NOTE, TOLERANCE, LOWEST_NOTE = 0.5, 0.3, 11, 11, 21


def windows(n: Column, window: int, hop: int, tail: str = "drop", least_tail: int = 0) -> Column:
    """Starts of the windows of a sequence of n: whole ones by hop; `drop` leaves the rest, `align` adds one that ends at the end (a short sequence
    gets one padded window), `keep` adds the rest if it has `least_tail` or is the only one."""
    whole = F.floor((n - window) / hop)
    starts = F.when(n >= window, F.sequence(F.lit(0).cast("long"), whole.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    starts = F.transform(starts, lambda i: i * hop)
    if tail == "align":
        last = n - window
        return F.when(n <= 0, F.array().cast("array<bigint>")).when(n < window, F.array(F.lit(0).cast("long"))).when(last > F.element_at(starts, -1), F.concat(starts, F.array(last.cast("long")))).otherwise(starts)
    if tail == "keep":
        done = F.size(starts) * hop
        rest = n - done
        return F.when((rest > 0) & ((rest >= least_tail) | (F.size(starts) == 0)), F.concat(starts, F.array(done.cast("long")))).otherwise(starts)
    return starts


def run_model(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Runs a model over batches of rows; load() is called once for each task and returns the model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


def classes(scores: Column, labels: list[str]) -> Column:
    """A model's vector as a map of labels; empty if it hasn't one score for each."""
    named = F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), F.transform(scores, lambda x: x.cast("double")))
    return F.when(F.size(scores) == len(labels), named).otherwise(F.create_map().cast("map<string,double>"))


def gate(chunk_scores: DataFrame, music: str = "Music") -> DataFrame:
    """chunk_scores(file_id, chunk, class, score) -> music_score (of the best chunk) and is_music."""
    top = chunk_scores.where(F.col("class") == music).groupBy("file_id").agg(F.max("score").alias("music_score"))
    return top.withColumn("is_music", F.col("music_score") > MUSIC_SCORE)


def gain_to_loudness(lufs: Column, target: float = -12.0, mono: bool = True) -> Column:
    """Linear gain that brings a measured loudness to the target. One channel that was measured as two reads 3.01 dB too loud, which is taken off first."""
    return F.pow(F.lit(10.0), (target - (lufs - (10 * math.log10(2) if mono else 0.0))) / 20)


def sanitized(document: Column) -> Column:
    """Stored documents may hold bare -inf or nan where a number stands; JSON has null for that."""
    return F.regexp_replace(document, r"(?<=[:,\[])\s*-?(?:inf|nan)(?:inity)?(?=\s*[,}\]])", "null")


def number_at(document: Column, path: str) -> Column:
    """A number of a JSON document; true and false count as 1 and 0."""
    text = F.get_json_object(document, path)
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))


def spans_of(document: Column) -> Column:
    """[[s, e], ...] as array<struct<start, end>>; incomplete pairs are left out."""
    pairs = F.from_json(document, "array<array<double>>")
    full = F.filter(pairs, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    return F.transform(full, lambda p: F.struct(p[0].alias("start"), p[1].alias("end")))


def chords_of(machine: Column) -> Column:
    """The chord changes of a document; those without time or name are left out."""
    rows = F.from_json(F.get_json_object(machine, "$.chords"), "array<struct<t: double, chord: string>>")
    return F.filter(rows, lambda x: x["t"].isNotNull() & x["chord"].isNotNull())


def notes_of(machine: Column) -> Column:
    """The notes of a document; incomplete ones are left out, a missing amplitude is 1."""
    rows = F.from_json(F.get_json_object(machine, "$.notes"), "array<struct<start: double, end: double, pitch: int, amplitude: double>>")
    full = F.filter(rows, lambda x: x["start"].isNotNull() & x["end"].isNotNull() & x["pitch"].isNotNull())
    return F.transform(full, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["pitch"].alias("pitch"), F.coalesce(x["amplitude"], F.lit(1.0)).alias("amplitude")))


def strings_of(human: Column, path: str) -> Column:
    """An array of strings of a document, nulls left out; null where there is no array."""
    return F.filter(F.from_json(F.get_json_object(human, path), "array<string>"), lambda x: x.isNotNull())


def _walk(energy: np.ndarray, at: int, f: int, step: int, level: float, stop: int) -> tuple[int, int]:
    """Follows a note from a frame until the energy is low for TOLERANCE frames, clearing it and its neighbours."""
    i, low = at + step, 0
    while (i < stop if step > 0 else i > stop) and low < TOLERANCE:
        low = low + 1 if energy[i, f] < level else 0
        energy[i, max(f - 1, 0) : f + 2] = 0
        i += step
    return i, low


def find_notes(frames: np.ndarray, onsets: np.ndarray, onset_level: float = ONSET_LEVEL, level: float = FRAME_LEVEL, least: int = LEAST_NOTE) -> list[tuple[int, int, int, float]]:
    """Notes (first frame, last frame, pitch, amplitude) of activations: from each onset peak, latest first, as long as energy lasts; then, strongest first, from
    what energy is left on either side of its maximum."""
    n = len(frames)
    energy = frames.astype(np.float64).copy()
    notes = []
    if n >= 3:
        inner = onsets[1:-1]
        peaks = np.argwhere((inner > onset_level) & (inner > onsets[:-2]) & (inner > onsets[2:]))
        for t, f in peaks[::-1]:
            t += 1
            if t >= n - 1:
                continue
            i, low = t + 1, 0
            while i < n - 1 and low < TOLERANCE:
                low = low + 1 if energy[i, f] < level else 0
                i += 1
            end = i - low
            if end - t <= least:
                continue
            energy[t:end, max(f - 1, 0) : f + 2] = 0
            notes.append((int(t), int(end), int(f) + LOWEST_NOTE, float(frames[t:end, f].mean())))
    while energy.size and energy.max() > level:
        t, f = np.unravel_index(energy.argmax(), energy.shape)
        energy[t, f] = 0
        i, low = _walk(energy, t, f, 1, level, n - 1)
        end = i - 1 - low
        i, low = _walk(energy, t, f, -1, level, 0)
        start = i + 1 + low
        if end - start > least:
            notes.append((int(start), int(end), int(f) + LOWEST_NOTE, float(frames[start:end, f].mean())))
    return sorted(notes)


NOTE = T.StructType().add("first", T.IntegerType()).add("last", T.IntegerType()).add("pitch", T.IntegerType()).add("amplitude", T.DoubleType())


@F.pandas_udf(T.ArrayType(NOTE))
def note_events(frames: pd.Series, onsets: pd.Series) -> pd.Series:
    """Notes of each file's activations, array<array<double>> by frame and pitch."""
    table = lambda m: np.stack([np.asarray(r, float) for r in m]) if m is not None and len(m) else np.zeros((0, 1))
    return pd.Series([[{"first": a, "last": b, "pitch": p, "amplitude": v} for a, b, p, v in find_notes(table(f), table(o))] for f, o in zip(frames, onsets, strict=True)])


def drop_overlapping_bends(notes: DataFrame) -> DataFrame:
    """notes(file_id, id, start, end, pitch, bend): a bend is dropped where another note sounds at the same time."""
    from sonolith.operators.intervals import range_join

    spans = notes.select("file_id", "id", "start", "end")
    clash = range_join(spans, spans, ["file_id"], 10.0).where("id != r_id").select("id").distinct().withColumn("_clash", F.lit(True))
    return notes.join(clash, "id", "left").withColumn("bend", F.when(F.col("_clash").isNull(), F.col("bend"))).drop("_clash")
