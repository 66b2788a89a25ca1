"""Predicates and routing: the filter language, tag search, file-name hints, content types and gates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field of the filter language, promoted column, numeric or not.
FIELDS = {
    "content_type": ("content_type", False),
    "key": ("key", False),
    "bpm": ("bpm", True),
    "tempo": ("bpm", True),
    "duration": ("duration_seconds", True),
    "loudness": ("loudness", True),
    "danceable": ("danceable", True),
    "harmonicity": ("harmonicity", True),
    "centroid": ("centroid", True),
    "crest": ("crest", True),
    "music_score": ("music_score", True),
    "voice_probability": ("voice_probability", True),
}
#: Maps of label to score that a tag condition searches, and the score that it must exceed.
TAG_MAPS = ("genre", "instrument", "stem_instrument", "mood")
TAG_SCORE = 0.2
#: Part of a file name, instrument it stands for; the first that occurs counts.
FILENAME_HINTS = [
    ("vox", "voice"), ("vocal", "voice"), ("voice", "voice"), ("choir", "voice"), ("kick", "drums"), ("snare", "drums"),
    ("hihat", "drums"), ("hi-hat", "drums"), ("drum", "drums"), ("perc", "percussion"), ("shaker", "percussion"),
    ("tabla", "percussion"), ("bass", "bass"), ("gtr", "electric guitar"), ("guitar", "electric guitar"), ("rhtm", "drums"),
    ("rhythm", "drums"), ("string", "strings"), ("brass", "brass"), ("horn", "brass"), ("trumpet", "trumpet"),
    ("trombone", "brass"), ("sax", "saxophone"), ("flute", "flute"), ("cello", "cello"), ("violin", "violin"),
    ("harp", "harp"), ("organ", "organ"), ("piano", "piano"), ("rhodes", "electric piano"), ("keys", "keyboard"),
    ("synth", "synthesizer"), ("pad", "synthesizer"),
]
#: Words of a controlled vocabulary for folders.
VOCABULARY = {
    "material": ["score", "song", "beat", "sound-design", "live-set"],
    "world": ["fantasy", "sci-fi", "noir", "heist", "chase", "horror", "western", "war", "post-apocalyptic", "superhero", "survival", "club", "basement", "arena", "lo-fi", "industrial", "psychedelic", "spiritual"],
    "harmonic": ["heroic", "lament", "menace", "alien", "static-drone", "modal-folk", "blues-pentatonic", "jazz-extended", "atonal"],
    "signature": ["glitch-swing", "boom-bap", "broken-beat", "wall-of-noise", "wide-rubato"],
}
MOST_WORLDS = 2
AUDIO_EXTENSIONS = ("wav", "aiff", "aif", "flac", "ogg", "mp3", "m4a", "caf")


class FilterError(ValueError):
    """A condition that can't be parsed."""


def tag_condition(word: str, maps: tuple[str, ...] = TAG_MAPS, least: float = TAG_SCORE) -> Column:
    """Any of the score maps has a label that contains the word, whatever its case, with a score above the least."""
    word = word.lower()
    found = [F.coalesce(F.exists(F.map_entries(m), lambda e: F.lower(e["key"]).contains(word) & (e["value"] > least)), F.lit(False)) for m in maps]
    return reduce(lambda a, b: a | b, found)


def compile_filter(text: str, maps: tuple[str, ...] = TAG_MAPS) -> Column:
    """Compiles `bpm>120,genre:Flamenco` to a predicate. Commas join by AND. A condition is `field OP value`, or `anything:word`, whose part
    before the colon says nothing. Values of numeric fields must be numbers. Raises FilterError for an empty condition, an unknown field or a missing operator."""
    out = []
    for condition in text.split(","):
        if not condition:
            raise FilterError(f"could not parse an empty condition in {text!r}")
        if ":" in condition and not re.search("[<>=!]", condition):
            out.append(tag_condition(condition.split(":", 1)[1], maps))
            continue
        op = next((o for o in (">=", "<=", "!=", ">", "<", "=") if o in condition), None)
        if op is None:
            raise FilterError(f"could not parse {condition!r}: no operator")
        field, value = condition.split(op, 1)
        if field not in FIELDS:
            raise FilterError(f"could not parse {condition!r}: unknown field")
        name, numeric = FIELDS[field]
        if numeric:
            try:
                value = float(value)
            except ValueError:
                raise FilterError(f"could not parse {condition!r}: not a number") from None
        column = F.col(name)
        out.append({">=": column >= value, "<=": column <= value, "!=": column != value, ">": column > value, "<": column < value, "=": column == value}[op])
    return reduce(lambda a, b: a & b, out)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem_name(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def under_folder(path: Column, folder: Column) -> Column:
    """The folder itself or anything below it; a folder of a similar name is another one."""
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def in_directory(path: Column, folder: Column) -> Column:
    """Directly in the folder."""
    return parent_dir(path) == folder


def instrument_hint(path: Column) -> Column:
    name = F.lower(basename(path))
    return F.coalesce(*[F.when(name.contains(part), F.lit(label)) for part, label in FILENAME_HINTS])


def is_full_mix(path: Column) -> Column:
    name = F.lower(basename(path))
    return name.rlike("mix|master|bounce") & ~name.contains("fx") & instrument_hint(path).isNull()


def routed_type(duration: Column) -> Column:
    """one_shot to 3 s, loop to 30 s, else track."""
    return F.when(duration <= 3, "one_shot").when(duration <= 30, "loop").when(duration.isNotNull(), "track")


def final_type(path: Column, duration: Column, has_siblings: Column, declared_stem: Column) -> Column:
    """A full mix is a track; siblings or a declaration make a stem, then a path with "stem", then the router decides."""
    return F.when(is_full_mix(path), "track").when(has_siblings | declared_stem | F.lower(path).contains("stem"), "stem").otherwise(routed_type(duration))


def bpm_from_token(text: Column) -> Column:
    """40 to 300 from "120bpm" or "120 BPM"."""
    found = F.regexp_extract(text, r"(?i)(\d{2,3})\s?bpm", 1).try_cast("int")
    return F.when(found.between(40, 300), found)


def bpm_from_leading_number(name: Column) -> Column:
    """60 to 200 from a bare number among the first two tokens of a name."""
    tokens = F.filter(F.split(name, r"[ _.\-]"), lambda t: t != "")
    found = F.filter(F.transform(F.filter(F.slice(tokens, 1, 2), lambda t: t.rlike(r"^\d{2,3}$")), lambda t: t.cast("int")), lambda n: n.between(60, 200))
    return F.get(found, F.lit(0))


def bpm_from_ancestors(path: Column, depth: int = 4) -> Column:
    """The nearest of the folders above that names a tempo."""
    folders = F.reverse(F.split(parent_dir(path), "/"))
    found = F.filter(F.transform(F.slice(folders, 1, depth), bpm_from_token), lambda b: b.isNotNull())
    return F.get(found, F.lit(0))


def filename_bpm(path: Column) -> Column:
    """Struct of bpm and certain: an explicit tempo in the name, then in a folder's, then a bare leading number as a guess."""
    name = stem_name(path)
    certain = F.coalesce(bpm_from_token(name), bpm_from_ancestors(path))
    return F.struct(F.coalesce(certain, bpm_from_leading_number(name)).alias("bpm"), certain.isNotNull().alias("certain"))


def filename_key(path: Column) -> Column:
    """"Am" gives "A min", "F#maj" gives "F# maj": the first such token."""
    pattern = "(?i)^([A-G])([#b]?)(maj|min|m)$"
    token = F.get(F.filter(F.split(stem_name(path), r"[ _.\-]"), lambda t: t.rlike(pattern)), F.lit(0))
    quality = F.lower(F.regexp_extract(token, pattern, 3))
    return F.when(token.isNotNull(), F.concat(F.upper(F.regexp_extract(token, pattern, 1)), F.regexp_extract(token, pattern, 2), F.when(quality == "maj", " maj").otherwise(" min")))


def for_analysis(files: DataFrame, force: bool = False, content_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Files that wait for analysis: those without one (all, if forced), of a type, at most `limit`, smallest ids first."""
    rows = files if force else files.where(F.col("analyzed_at").isNull())
    rows = rows if content_type is None else rows.where(F.col("content_type") == content_type)
    return rows if limit is None else rows.orderBy("id").limit(limit)


def gates() -> dict[str, Column]:
    """Which stages run: heads need an embedding and music, keys a harmonic sound, rhythm anything but a one-shot, regions a stem or five minutes."""
    return {
        "run_heads": F.coalesce(F.col("has_embedding") & (F.col("music_score") > 0.30), F.lit(False)),
        "run_key": F.coalesce((F.col("harmonicity") >= 0.5) & (F.col("harmonicity_frames") > 0), F.lit(False)),
        "run_rhythm": F.coalesce(F.col("content_type") != "one_shot", F.lit(True)),
        "run_regions": F.coalesce((F.col("content_type") == "stem") | (F.col("duration_seconds") > 300), F.lit(False)),
    }


def criteria(bpm: tuple[float, float] | None = None, key: str | None = None, genre: str | None = None, instrument: str | None = None, mood: str | None = None, terms: str = "") -> Column:
    """The list's filter on columns bpm, key, genres, instruments, moods (arrays) and haystack (lower case): all given ones hold; a null tempo fails a range."""
    tests = [F.lit(True)]
    if bpm:
        tests.append(F.coalesce(F.col("bpm").between(*bpm), F.lit(False)))
    if key:
        tests.append(F.coalesce(F.lower("key") == key.lower(), F.lit(False)))
    for value, column in ((genre, "genres"), (instrument, "instruments"), (mood, "moods")):
        if value:
            tests.append(F.coalesce(F.array_contains(F.transform(column, F.lower), value.lower()), F.lit(False)))
    tests += [F.coalesce(F.col("haystack").contains(t), F.lit(False)) for t in terms.lower().split()]
    return reduce(lambda a, b: a & b, tests)


def files_or_segments(files: DataFrame, segments: DataFrame, file_test: Column, segment_test: Column | None) -> DataFrame:
    """files(id, ...) that match themselves or through a segment(file_id, ...), with the number of segments shown: the matching ones if any, else all."""
    matching = F.count_if(segment_test) if segment_test is not None else F.lit(0).cast("long")
    per_file = segments.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_segments"), matching.alias("n_matching"))
    joined = files.withColumn("matches", F.coalesce(file_test, F.lit(False))).join(per_file, F.col("id") == F.col("file_id"), "left")
    joined = joined.withColumn("n_matching", F.coalesce("n_matching", F.lit(0))).withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
    return joined.where("matches or n_matching > 0").withColumn("n_visible", F.when(F.col("n_matching") > 0, F.col("n_matching")).otherwise(F.col("n_segments"))).drop("file_id")


def target(text: Column) -> Column:
    """How a target is addressed: a pipe makes it a group, digits an id, all else a path."""
    return F.when(text.contains("|"), "group").when(text.rlike("^[0-9]+$"), "id").otherwise("path")


def resolve_target(files: DataFrame, text: str) -> DataFrame:
    """The files that a target names; digits that are no id are tried as a path."""
    if "|" in text:
        return files.where(F.col("group_id") == text)
    if text.isdigit():
        return files.where((F.col("id") == int(text)) | (F.col("path") == text)).orderBy((F.col("id") == int(text)).desc()).limit(1)
    return files.where(F.col("path") == text)


def invalid_words(tags: DataFrame) -> DataFrame:
    """tags(folder, field, value) that break the vocabulary: unknown words, and worlds beyond the second of a folder. Callers write only if this is empty."""
    known = tags.sparkSession.createDataFrame([(f, v) for f, vs in VOCABULARY.items() for v in vs], "field string, value string")
    unknown = tags.join(F.broadcast(known), ["field", "value"], "left_anti").select("folder", "field", "value", F.lit("unknown word").alias("problem"))
    worlds = tags.where("field = 'world'").groupBy("folder").agg(F.countDistinct("value").alias("n")).where(F.col("n") > MOST_WORLDS)
    return unknown.unionByName(worlds.select("folder", F.lit("world").alias("field"), F.col("n").cast("string").alias("value"), F.lit("too many").alias("problem")))
