"""Scalar functions on columns: text, names, time codes, music theory and curves. All run inside Catalyst."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key name, Camelot code, Open Key code.
KEYS = [
    ("A major", "11B", "4d"), ("A minor", "8A", "1m"), ("B flat major", "6B", "11d"), ("B flat minor", "3A", "8m"),
    ("B major", "1B", "6d"), ("B minor", "10A", "3m"), ("C major", "8B", "1d"), ("C minor", "5A", "10m"),
    ("D flat major", "3B", "8d"), ("D flat minor", "12A", "5m"), ("D major", "10B", "3d"), ("D minor", "7A", "12m"),
    ("E flat major", "5B", "10d"), ("E flat minor", "2A", "7m"), ("E major", "12B", "5d"), ("E minor", "9A", "2m"),
    ("F major", "7B", "12d"), ("F minor", "4A", "9m"), ("G flat major", "2B", "7d"), ("G flat minor", "11A", "4m"),
    ("G major", "9B", "2d"), ("G minor", "6A", "11m"), ("A flat major", "4B", "9d"), ("A flat minor", "1A", "6m"),
]


def _lookup(column: Column, pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])[column]


def camelot(key: Column) -> Column:
    """Camelot code of a key name; null for an unknown one."""
    return _lookup(key, {k: c for k, c, _ in KEYS})


def open_key(key: Column) -> Column:
    """Open Key code of a key name; null for an unknown one."""
    return _lookup(key, {k: o for k, _, o in KEYS})


def round_half_away(x: Column) -> Column:
    """Rounds halves away from zero, as a long."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(F.ceil(x - 0.5)).cast("long")


def bucketed(value: Column, low_max: float, high_min: float, low: str, mid: str, high: str) -> Column:
    """Three-way bucket: below low_max, from high_min on, between; null stays null."""
    return F.when(value < low_max, low).when(value >= high_min, high).when(value.isNotNull(), mid)


def duration_text(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from one hour on."""
    whole = F.floor(seconds + 0.5).cast("long")
    minutes = F.floor(whole % 3600 / 60).cast("string")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(whole / 3600)
    return F.when(hours > 0, F.concat_ws(":", hours.cast("string"), two(F.floor(whole % 3600 / 60)), two(whole % 60))).otherwise(F.concat_ws(":", minutes, two(whole % 60)))


def nominal_rate(fps: float) -> int:
    return max(1, math.floor(fps + 0.5))


def drop_frame_possible(fps: float) -> bool:
    return abs(fps - 29.97) < 0.05 or abs(fps - 59.94) < 0.06


def timecode(seconds: Column, fps: float = 25.0, drop_frame: bool = False, start_seconds: float = 0.0) -> Column:
    """SMPTE time code of an elapsed time. Drop-frame counts skip frame numbers at 30 and 60 and write `;` before the frames."""
    nominal = nominal_rate(fps)
    frames = F.greatest(F.lit(0).cast("long"), round_half_away(F.lit(start_seconds * nominal)) + round_half_away(seconds * fps))
    separator = ":"
    if drop_frame and nominal in (30, 60):
        skipped = nominal // 15
        ten_minutes, minute = nominal * 600 - 9 * skipped, nominal * 60 - skipped
        rest = frames % ten_minutes
        extra = F.when(rest >= skipped, skipped * F.floor((rest - skipped) / minute)).otherwise(0)
        frames = frames + skipped * 9 * F.floor(frames / ten_minutes) + extra
        separator = ";"
    two = lambda x: F.lpad(x.cast("string"), F.greatest(F.length(x.cast("string")), F.lit(2)), F.lit("0"))
    whole = F.floor(frames / nominal)
    return F.concat(two(F.floor(whole / 3600)), F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60), F.lit(separator), two(frames % nominal))


def parse_timecode(text: Column, nominal: int = 25) -> Column:
    """Seconds of a time code of two to four parts; -1 for anything else, or more frames than a second has."""
    parts = F.filter(F.split(F.translate(F.trim(text), ";.,", ":::"), ":"), lambda p: p != "")
    fine = F.size(parts).between(2, 4) & F.forall(parts, lambda p: p.rlike("^[0-9]+$"))
    digits = F.when(fine, F.concat(F.array_repeat(F.lit("0"), 4 - F.size(parts)), parts))
    value = lambda i: F.element_at(digits, i).cast("double")
    seconds = value(1) * 3600 + value(2) * 60 + value(3) + value(4) / nominal
    return F.when(text.isNotNull(), F.when(fine & (value(4) < nominal), seconds).otherwise(F.lit(-1.0)))


def slugify(text: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))


def key_slug(key: Column) -> Column:
    """Tonic as written, mode shortened: "F# minor" gives "F#min"."""
    trimmed = F.trim(key)
    tonic = F.substring_index(trimmed, " ", 1)
    mode = F.lower(F.trim(F.substring(trimmed, F.length(tonic) + F.lit(2), F.length(trimmed))))
    return F.when(trimmed == "", "").otherwise(F.concat(tonic, F.when(mode.startswith("min"), "min").when(mode.startswith("maj"), "maj").otherwise(F.substring(mode, 1, 3))))


def delivery_name(project: Column, cue: Column, bpm: Column, key: Column, version: Column) -> Column:
    """project_cue_120bpm_Amin_v2.wav; absent parts are left out, and "export.wav" is what remains of nothing."""
    some = lambda x: F.when(x != "", x)
    tempo = F.when(bpm > 0, F.concat(round_half_away(bpm).cast("string"), F.lit("bpm")))
    number = F.when(version > 0, F.concat(F.lit("v"), version.cast("string")))
    name = F.concat_ws("_", some(slugify(project)), some(slugify(cue)), tempo, some(key_slug(key)), number)
    return F.concat(F.when(name == "", "export").otherwise(name), F.lit(".wav"))


def version_from_name(name: Column) -> Column:
    """The number after the last "_v" before the extension; 0 without one."""
    return F.coalesce(F.regexp_extract(name, r"_v([0-9]+)\.[^.]*$", 1).try_cast("int"), F.lit(0))


def comma_list(text: Column) -> Column:
    """Items of a comma-separated list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def safe_name(text: Column) -> Column:
    """A name for files: letters, digits and #; spaces, - and _ become single underscores, inside only."""
    kept = F.regexp_replace(F.regexp_replace(text, r"[ \-_]", "_"), r"[^\p{L}\p{Nd}#_]", "")
    return F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_|_$", "")


def chord_root(label: Column) -> Column:
    """Pitch class 0 to 11 of a chord's root; -1 for no chord."""
    natural = _lookup(F.substring(label, 1, 1), {"A": "9", "B": "11", "C": "0", "D": "2", "E": "4", "F": "5", "G": "7"}).cast("int")
    accidental = F.substring(label, 2, 1)
    shift = F.when(accidental == "#", 1).when(accidental == "b", -1).otherwise(0)
    return F.when(natural.isNull(), -1).otherwise((natural + shift + 12) % 12)


def genre_name(raw: Column) -> Column:
    """"Electronic---Techno" gives "Electronic: Techno" (the first separator only)."""
    at = F.instr(raw, "---")
    return F.when(at > 0, F.concat(F.substring(raw, F.lit(1), at - 1), F.lit(": "), F.substring(raw, at + 3, F.length(raw)))).otherwise(raw)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def json_escape(text: Column) -> Column:
    r"""Escapes quotes, backslashes, \n, \r and \t as JSON does."""
    out = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def gain_from_db(db: Column) -> Column:
    return F.when(db > -100, F.pow(F.lit(10.0), db / 20)).otherwise(F.lit(0.0))


def db_from_gain(gain: Column, floor: float = -100.0) -> Column:
    return F.when(gain > 0, F.greatest(F.lit(floor), 20 * F.log10(gain))).otherwise(F.lit(floor))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hz_to_mel(hz: Column) -> Column:
    """Slaney's scale: linear to 1 kHz, logarithmic above."""
    return F.when(hz < 1000, hz * 3 / 200).otherwise(15 + F.log(hz / 1000) / (math.log(6.4) / 27))


def mel_to_hz(mel: Column) -> Column:
    return F.when(mel < 15, mel * 200 / 3).otherwise(1000 * F.exp((math.log(6.4) / 27) * (mel - 15)))


def midi_to_hz(note: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (note - 69) / 12)


def hz_to_midi(hz: Column) -> Column:
    return 12 * F.log2(hz / 440) + 69


def fade_gain(t: Column, shape: str = "linear") -> Column:
    """Gain of a fade at 0 to 1: linear, equal_power or exponential."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return {"linear": t, "equal_power": F.sin(t * (math.pi / 2)), "exponential": t * t}[shape]


def squeezed_fades(fade_in: Column, fade_out: Column, span: Column) -> tuple[Column, Column]:
    """Fades that don't fit the span together shrink in proportion."""
    a, b = F.greatest(F.lit(0.0), fade_in), F.greatest(F.lit(0.0), fade_out)
    ratio = F.when((a + b > span) & (a + b > 0), span / (a + b)).otherwise(1.0)
    return a * ratio, b * ratio


def catmull_rom(y0: Column, y1: Column, y2: Column, y3: Column, t: Column) -> Column:
    """Cubic through y1 (t = 0) and y2 (t = 1) with tangents from the outer two."""
    a = y2 - y0
    b = 2 * y0 - 5 * y1 + 4 * y2 - y3
    c = 3 * (y1 - y2) + y3 - y0
    return y1 + 0.5 * t * (a + t * (b + t * c))


def spectrum_point(centroid: Column, flatness: Column) -> Column:
    """The two-dimensional spectrum vector: log-normalised centroid and flatness."""
    return F.array(F.log1p(centroid) / math.log1p(11000), flatness)
