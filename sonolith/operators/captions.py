"""Captions: the layered record of a file or segment, and its rendering as prose, tags and sidecars.

A record is built as columns: measured values, then folder defaults from the outermost folder in, then the file's own tags; a segment
starts from the finished file record, takes its own measurements if it is music, then its own tags. Lists replace, keywords add
up to eight. Everything is a projection or an equality join, so the whole library is captioned in one plan.

Expected columns of a file: id, path, content_type, duration_seconds, bpm, second_bpm, tempo_window_count, tempo_unstable, groove
(a struct as from fitted_groove), key, genre, genre_raw, instrument, instrument_raw, stem_instrument, mood (maps),
voice_probability, onset_rate, loudness_range, flatness, sub_ratio, flux_mean, beat_jitter, human (a HUMAN struct). Missing ones count as null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.functions.scalars import bucketed, json_escape, round_half_away, word_count
from sonolith.operators.aggregates import electronic_share
from sonolith.operators.predicates import instrument_hint
from sonolith.operators.topk import by_score, top_entries, top_genres, top_scored

LABELS = "array<struct<label: string, score: double>>"
MAP = "map<string, double>"
LISTS, WORDS = ("genre", "instruments", "moods"), ("rhythm", "dynamics", "texture", "palette", "timing", "groove", "swing", "low_end", "motion", "key")
HUMAN = "struct<" + ", ".join([*(f"{c}: array<string>" for c in LISTS), "keywords: array<string>", *(f"{c}: string" for c in WORDS), "bpm: double", "is_instrumental: boolean"]) + ">"
LEAST_SCORE, STEM_FLOOR, VOICE = 0.10, 0.30, 0.5
MOST_GENRES, MOST_INSTRUMENTS, MOST_MOODS, MOST_KEYWORDS, MOST_WORDS = 3, 8, 3, 8, 45
#: Low bound, high bound and the three words of each shape field.
SHAPES = {
    "rhythm": ("onset_rate", 0.8, 2.0, "sparse", "moderate", "driving"),
    "dynamics": ("loudness_range", 4.0, 13.0, "compressed", "moderate", "wide"),
    "texture": ("flatness", 0.03, 0.06, "tonal", "mixed", "noisy"),
    "palette": ("electronic_share", 0.15, 0.35, "acoustic", "hybrid", "electronic"),
    "timing": ("beat_jitter", 0.08, 0.20, "tight", "human", "loose"),
    "low_end": ("sub_ratio", 0.20, 0.34, "light", "balanced", "heavy"),
    "motion": ("flux_mean", 0.14, 0.20, "static", "shifting", "morphing"),
    "groove": ("groove_strength", 1.90, 2.45, "organic", "steady", "programmed"),
    "swing": ("groove_swing", 0.51, 0.55, "straight", "light swing", "swung"),
}
#: Instrument codes of the stem model.
STEM_CODES = {
    "cel": "cello", "cla": "clarinet", "flu": "flute", "gac": "acoustic guitar", "gel": "electric guitar", "org": "organ",
    "pia": "piano", "sax": "saxophone", "tru": "trumpet", "vio": "violin", "voi": "voice",
}
FILE_ONLY = ("rhythm", "timing", "groove", "swing")
_TYPES = {
    "groove": "struct<omitted: string, bpm: double, strength: double, swing: double>", "genre": MAP, "genre_raw": MAP, "instrument": MAP, "instrument_raw": MAP,
    "stem_instrument": MAP, "mood": MAP, "human": HUMAN, "content_type": "string", "path": "string", "key": "string", "tempo_unstable": "boolean",
}
INPUT = ("content_type", "path", "duration_seconds", "bpm", "tempo_window_count", "tempo_unstable", "groove", "key", "genre", "genre_raw", "instrument", "instrument_raw", "stem_instrument", "mood", "voice_probability", "onset_rate", "loudness_range", "flatness", "sub_ratio", "flux_mean", "beat_jitter", "human")


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds or replaces a column that is computed once for each row however often its fields are used: a projection would be merged into those above it, and its
    expressions repeated for each use; a generator isn't."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name))


def with_input(df: DataFrame) -> DataFrame:
    """Adds the expected columns that a table lacks, as nulls."""
    return df.select("*", *[F.lit(None).cast(_TYPES.get(c, "double")).alias(c) for c in INPUT if c not in df.columns])


def _no_map(c: Column) -> Column:
    return F.coalesce(c, F.create_map().cast(MAP))


def instruments(prefix: str = "") -> Column:
    """All instruments found: on a stem the file name leads, then the stem model unless the full mix hears drums; full-mix labels from 0.1 on a mix,
    0.3 on a stem (there only drums and percussion beside the stem model); a voice from 0.5 on. The best score of a label counts."""
    c = lambda n: F.col(prefix + n)
    full = F.when(F.size(_no_map(c("instrument"))) > 0, c("instrument")).otherwise(_no_map(c("instrument_raw")))
    mix = top_entries(full, MOST_INSTRUMENTS * 4)
    stem = F.coalesce(F.col("content_type") == "stem", F.lit(False))
    drums = ["drums", "percussion"]
    top = F.get(mix, F.lit(0))
    use_stem_model = stem & ~F.coalesce(top["label"].isin(drums) & (top["score"] >= STEM_FLOOR), F.lit(False))
    floor = F.when(stem, STEM_FLOOR).otherwise(LEAST_SCORE)
    from_mix = F.filter(mix, lambda e: (e["score"] >= floor) & (~use_stem_model | e["label"].isin(drums)))
    named = F.create_map(*[F.lit(x) for kv in STEM_CODES.items() for x in kv])
    codes = F.transform(F.filter(F.map_entries(_no_map(c("stem_instrument"))), lambda e: F.map_contains_key(named, e["key"])), lambda e: F.struct(F.element_at(named, e["key"]).alias("key"), e["value"].alias("value")))
    from_stem = F.slice(F.filter(by_score(codes), lambda e: e["score"] >= LEAST_SCORE), 1, MOST_INSTRUMENTS)
    none = F.array().cast(LABELS)
    hint = instrument_hint(F.col("path"))
    one = lambda label, score: F.array(F.struct(label.alias("label"), score.cast("double").alias("score"))).cast(LABELS)
    every = F.concat(
        F.when(stem & hint.isNotNull(), one(hint, F.lit(0.99))).otherwise(none),
        F.when(use_stem_model, from_stem.cast(LABELS)).otherwise(none),
        from_mix.cast(LABELS),
        F.when(c("voice_probability") >= VOICE, one(F.lit("voice"), c("voice_probability"))).otherwise(none),
    )
    labels = F.array_distinct(F.transform(every, lambda e: e["label"]))
    best = F.transform(labels, lambda n: F.struct(n.alias("key"), F.array_max(F.transform(F.filter(every, lambda e: e["label"] == n), lambda e: e["score"])).alias("value")))
    return F.slice(by_score(best), 1, MOST_INSTRUMENTS)


def primary_instruments(full_mix: Column, stem: Column, is_stem: Column) -> Column:
    """Entries to show first, best first: the stem model's on a stem, unless it has none or the full mix's top is drums or percussion from STEM_FLOOR on."""
    mix, own = by_score(F.map_entries(_no_map(full_mix))), by_score(F.map_entries(_no_map(stem)))
    top = F.get(mix, F.lit(0))
    drums = F.coalesce(top["label"].isin("drums", "percussion") & (top["score"] >= STEM_FLOOR), F.lit(False))
    return F.when(is_stem & (F.size(own) > 0) & ~drums, own).otherwise(mix)


def shown_instruments(entries: Column, hint: Column, floor: Column) -> Column:
    """Labels of a list's column: the file name's hint, then entries from the floor on; without a hint the best entry is always shown."""
    fine = F.filter(entries, lambda e, i: (e["score"] >= floor) | ((i == 0) & hint.isNull()))
    names = F.concat(F.when(hint.isNotNull(), F.array(hint)).otherwise(F.array().cast("array<string>")), F.transform(fine, lambda e: e["label"]))
    lowered = F.transform(names, F.lower)
    return F.filter(names, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def instrument_column(files: DataFrame) -> DataFrame:
    """files(id, path, content_type, instrument, stem_instrument) -> id, labels: from 0.1 on for tracks, else from 0.3; a stem's name leads."""
    stem = F.coalesce(F.col("content_type") == "stem", F.lit(False))
    floor = F.when(F.col("content_type") == "track", LEAST_SCORE).otherwise(STEM_FLOOR)
    hint = F.when(stem, instrument_hint(F.col("path")))
    return files.select("id", shown_instruments(primary_instruments(F.col("instrument"), F.col("stem_instrument"), stem), hint, floor).alias("labels"))


def segment_instrument_column(segments: DataFrame) -> DataFrame:
    """The same for segments(id, path, content_type, instrument, stem_instrument): from 0.3 on for segments of stems, else from 0.1."""
    stem = F.coalesce(F.col("content_type") == "stem", F.lit(False))
    floor = F.when(stem, STEM_FLOOR).otherwise(LEAST_SCORE)
    hint = F.when(stem, instrument_hint(F.col("path")))
    return segments.select("id", shown_instruments(primary_instruments(F.col("instrument"), F.col("stem_instrument"), stem), hint, floor).alias("labels"))


def _names(labels: Column) -> Column:
    return F.transform(labels, lambda e: e["label"])


def _shape(name: str, source: Column) -> Column:
    _, *bounds = SHAPES[name]
    return bucketed(source, *bounds)


def measured(files: DataFrame) -> DataFrame:
    """Adds a struct `record` of what was measured."""
    one_shot = F.coalesce(F.col("content_type") == "one_shot", F.lit(False))
    groove_fits = F.coalesce(F.col("groove.omitted") == "", F.lit(False))
    steady = ~((F.coalesce("tempo_window_count", F.lit(0)) >= 3) & F.coalesce("tempo_unstable", F.lit(False)))
    tempo = F.when(~one_shot, F.coalesce(F.when(groove_fits & (F.col("groove.bpm") > 0), F.col("groove.bpm")), F.when((F.col("bpm") > 0) & steady, F.col("bpm"))))
    raw = F.when(F.size(_no_map(F.col("instrument_raw"))) > 0, F.col("instrument_raw")).otherwise(_no_map(F.col("instrument")))
    sources = {n: F.col(s[0]) for n, s in SHAPES.items() if s[0] not in {"electronic_share", "groove_strength", "groove_swing"}}
    sources |= {"palette": electronic_share(raw), "groove": F.when(groove_fits, F.col("groove.strength")), "swing": F.when(groove_fits, F.col("groove.swing"))}
    fields = [
        F.coalesce("duration_seconds", F.lit(0.0)).alias("seconds"),
        _names(top_genres(F.col("genre"), F.col("genre_raw"), LEAST_SCORE, MOST_GENRES)).alias("genre"),
        _names(instruments()).alias("instruments"),
        _names(top_scored(_no_map(F.col("mood")), LEAST_SCORE, MOST_MOODS)).alias("moods"),
        F.array().cast("array<string>").alias("keywords"),
        tempo.alias("bpm"),
        F.col("key").alias("key"),
        (F.col("voice_probability") < VOICE).alias("is_instrumental"),
        *[F.when(~one_shot, _shape(n, s)).alias(n) for n, s in sources.items()],
    ]
    return pinned(files, "record", F.struct(*fields))


def overridden(record: Column, human: Column) -> Column:
    """The record under a person's tags: what they give replaces, keywords add up to eight."""
    fields = []
    for name in ("seconds", *LISTS, "keywords", "bpm", "is_instrumental", *WORDS):
        if name == "seconds":
            value = record["seconds"]
        elif name == "keywords":
            value = F.when(human["keywords"].isNotNull(), F.slice(F.concat(record["keywords"], human["keywords"]), 1, MOST_KEYWORDS)).otherwise(record["keywords"])
        else:
            value = F.coalesce(human[name], record[name])
        fields.append(value.alias(name))
    return F.when(human.isNotNull(), F.struct(*fields)).otherwise(F.struct(*[record[n].alias(n) for n in ("seconds", *LISTS, "keywords", "bpm", "is_instrumental", *WORDS)]))


def folder_layers(files: DataFrame, defaults: DataFrame) -> DataFrame:
    """id -> `layers`, the defaults of the folders above a file (or of itself), outermost first: each path is taken apart into its ancestors and joined
    by equality, never by prefix."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    steps = files.select("id", F.posexplode(above).alias("depth", "folder_path"))
    found = steps.join(defaults.select("folder_path", F.col("human").alias("layer")), "folder_path")
    return found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "layer"))), lambda x: x["layer"]).alias("layers"))


def merged_layers(layers: Column) -> Column:
    """Defaults folded into one: the innermost value of a field counts, keywords add up."""
    last = lambda n: F.element_at(F.filter(F.transform(layers, lambda x: x[n]), lambda v: v.isNotNull()), -1)
    safe = lambda n: F.when(F.exists(layers, lambda x: x[n].isNotNull()), last(n))
    words = F.slice(F.flatten(F.transform(F.filter(layers, lambda x: x["keywords"].isNotNull()), lambda x: x["keywords"])), 1, MOST_KEYWORDS)
    return F.when(
        F.size(layers) > 0,
        F.struct(*[safe(n).alias(n) for n in LISTS], F.when(F.exists(layers, lambda x: x["keywords"].isNotNull()), words).alias("keywords"), *[safe(n).alias(n) for n in WORDS], safe("bpm").alias("bpm"), safe("is_instrumental").alias("is_instrumental")),
    )


def file_records(files: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """Files with their finished `record`."""
    out = measured(with_input(files))
    if defaults is not None:
        out = out.join(folder_layers(files, defaults), "id", "left").withColumn("_folder", merged_layers(F.coalesce("layers", F.array().cast(f"array<{HUMAN}>")))).drop("layers")
        out = pinned(out, "record", overridden(F.col("record"), F.col("_folder"))).drop("_folder")
    return pinned(out, "record", overridden(F.col("record"), F.col("human")))


def segment_records(records: DataFrame, segments: DataFrame) -> DataFrame:
    """records (as from file_records), segments(segment_id, file_id, start, end, is_music, s_* measurements, s_human). A segment that is music has
    its own genre, instruments, moods, voice and shape (but no rhythm, timing, groove or swing), which beat even the file's tags; its own tags come last."""
    wanted = {f"s_{c}" for c in ("genre", "genre_raw", "instrument", "instrument_raw", "stem_instrument", "mood", "voice_probability", "loudness_range", "flatness", "sub_ratio", "flux_mean", "human")}
    seg = segments.select("*", *[F.lit(None).cast(_TYPES.get(c[2:], "double")).alias(c) for c in sorted(wanted - set(segments.columns))])
    both = seg.join(records.select(F.col("id").alias("file_id"), "path", "content_type", "record"), "file_id")
    raw = F.when(F.size(_no_map(F.col("s_instrument_raw"))) > 0, F.col("s_instrument_raw")).otherwise(_no_map(F.col("s_instrument")))
    own = {
        "genre": _names(top_genres(F.col("s_genre"), F.col("s_genre_raw"), LEAST_SCORE, MOST_GENRES)),
        "instruments": _names(instruments("s_")),
        "moods": _names(top_scored(_no_map(F.col("s_mood")), LEAST_SCORE, MOST_MOODS)),
    }
    maybe = {n: _shape(n, F.col(f"s_{SHAPES[n][0]}")) for n in SHAPES if n not in FILE_ONLY and n != "palette"}
    maybe |= {"palette": _shape("palette", electronic_share(raw)), "is_instrumental": F.col("s_voice_probability") < VOICE}
    music = F.coalesce("is_music", F.lit(False))
    fields = []
    for n in ("seconds", *LISTS, "keywords", "bpm", "is_instrumental", *WORDS):
        base = F.col(f"record.{n}")
        value = F.col("end") - F.col("start") if n == "seconds" else F.when(music, own[n]).otherwise(base) if n in own else F.when(music, F.coalesce(maybe[n], base)).otherwise(base) if n in maybe else base
        fields.append(value.alias(n))
    layered = pinned(both, "record", F.struct(*fields))
    return pinned(layered, "record", overridden(F.col("record"), F.col("s_human")))


def prose(record: Column, content_type: Column, trigger: str = "") -> Column:
    """The caption: type, genre, instruments and mood, then tempo and length. Beyond 45 words the moods go, then all instruments but the first."""
    r = record
    some = lambda a: F.size(a) > 0
    listed = lambda a: F.array_join(a, ", ")
    one_shot, stem = F.coalesce(content_type == "one_shot", F.lit(False)), F.coalesce(content_type == "stem", F.lit(False))
    vocal = F.when(r["is_instrumental"].isNotNull(), F.concat(F.lit("VocalType: "), F.when(r["is_instrumental"], "Instrumental").otherwise("Vocal"), F.lit(", "))).otherwise("")
    prefix = F.when(one_shot, "").when(stem, "TrackType: Instrument, ").otherwise(F.concat(F.lit("TrackType: Music, "), vocal))
    tail = F.concat(
        F.when(r["bpm"].isNotNull(), F.concat(F.lit("BPM: "), round_half_away(r["bpm"]).cast("string"), F.lit(". "))).otherwise(""),
        F.lit("Length: "), round_half_away(r["seconds"]).cast("string"), F.lit(" seconds"),
    )

    def version(most: int | None, with_moods: bool) -> Column:
        names = r["instruments"] if most is None else F.slice(r["instruments"], 1, most)
        has_genre = some(r["genre"])
        played = F.when(one_shot, F.concat(listed(names), F.lit(" one-shot"))).when(stem, F.concat(listed(names), F.lit(" stem"))).otherwise(F.concat(F.lit("featuring "), listed(names)))
        bare = F.when(one_shot, "one-shot").when(stem, "stem").when(~has_genre, "instrumental track")
        body = F.concat_ws(" ", F.when(has_genre, listed(r["genre"])), F.when(some(names), played).otherwise(bare))
        words = F.concat(r["keywords"], r["moods"]) if with_moods else r["keywords"]
        mood = F.when(some(words), F.concat(F.lit(" with a "), listed(words), F.lit(" mood"))).otherwise("")
        return F.concat(F.lit(f"{trigger}, " if trigger else ""), prefix, body, mood, F.lit(". "), tail)

    long = lambda text: word_count(text) > MOST_WORDS
    full, plain, short = version(None, True), version(None, False), version(1, False)
    return F.when(~long(full), full).when(~long(plain) | (F.size(r["instruments"]) <= 1), plain).otherwise(short)


def tags(record: Column, content_type: Column, trigger: str = "", text: Column | None = None) -> Column:
    """array<struct<k, v>> in fixed order; absent values are left out."""
    r = record
    joined = lambda n: F.when(F.size(r[n]) > 0, F.array_join(r[n], ", "))
    one_shot, stem = F.coalesce(content_type == "one_shot", F.lit(False)), F.coalesce(content_type == "stem", F.lit(False))
    pairs = [
        ("trigger", F.lit(trigger or None).cast("string")),
        ("TrackType", F.when(stem, "Instrument").when(~one_shot, "Music")),
        ("VocalType", F.when(~stem & ~one_shot & r["is_instrumental"].isNotNull(), F.when(r["is_instrumental"], "Instrumental").otherwise("Vocal"))),
        *[(n, joined(n)) for n in ("genre", "instruments", "moods", "keywords")],
        *[(n, r[n]) for n in ("rhythm", "dynamics", "texture", "palette", "timing", "groove", "swing", "low_end", "motion")],
        ("bpm", round_half_away(r["bpm"]).cast("string")),
        ("keyscale", r["key"]),
        ("length_seconds", round_half_away(r["seconds"]).cast("string")),
        ("prompt", prose(r, content_type, trigger) if text is None else text),
    ]
    return F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs]), lambda x: x["v"].isNotNull())


def sidecar(tag_list: Column) -> Column:
    """The tags as a flat JSON object, in their order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(tag_list, lambda t: F.concat(F.lit('"'), json_escape(t["k"]), F.lit('":"'), json_escape(t["v"]), F.lit('"'))), ","), F.lit("}"))


def captions(files: DataFrame, defaults: DataFrame | None = None, trigger: str = "") -> DataFrame:
    """id, prose and sidecar of every file."""
    done = file_records(files, defaults)
    told = pinned(done, "prose", prose(F.col("record"), F.col("content_type"), trigger))
    return told.select("id", "prose", sidecar(tags(F.col("record"), F.col("content_type"), trigger, F.col("prose"))).alias("sidecar"))


def retag(old: Column, fresh: Column, kept: list[str]) -> Column:
    """A sidecar map with the kept keys of the old one and all else from the fresh one."""
    rest = F.map_filter(fresh, lambda k, _: ~k.isin(kept))
    return F.map_concat(F.map_filter(old, lambda k, _: k.isin(kept)), rest)


def prompt(fields: Column) -> Column:
    """"Key: value" parts of array<struct<k, v>>, joined by commas, empty values left out."""
    return F.array_join(F.transform(F.filter(fields, lambda x: F.coalesce(x["v"] != "", F.lit(False))), lambda x: F.concat_ws(": ", x["k"], x["v"])), ", ")


def random_prompts(choices: DataFrame, seed: int = 0) -> DataFrame:
    """choices(prompt_id, position, key, value, n): for each prompt and key one value, drawn in proportion to n by a hash of seed, prompt and key, joined
    in order of position."""
    from sonolith.operators.aggregates import weighted_choice

    point = F.pmod(F.xxhash64(F.lit(seed), "prompt_id", "key"), F.lit(1 << 30)) / float(1 << 30)
    drawn = weighted_choice(choices, ["prompt_id", "position", "key"], point)
    rows = drawn.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("key").alias("k"), F.col("value").alias("v")))).alias("_f"))
    return rows.select("prompt_id", prompt(F.transform("_f", lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))).alias("prompt"))
