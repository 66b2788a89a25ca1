"""Operators on small golden inputs."""

import io
import json
import math
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sonolith.functions import scalars as fn
from sonolith.operators import aggregates, captions, catalog, cues, dml, frontends, harmony, intervals, library, models, predicates, rhythm, signal, topk
from sonolith.sources import documents, files
from sonolith.streaming import streams


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def tone(seconds, rate=8000, channels=1):
    t = np.arange(int(seconds * rate)) / rate
    return files.encode_wav(0.5 * np.sin(2 * math.pi * 440 * t), np.zeros_like(t) if channels == 2 else None, rate)


# filters --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "a,,b", "volume>3", "bpm120", "bpm>fast", "bpm>1,"])
def test_filter_errors(spark, text):
    with pytest.raises(predicates.FilterError):
        predicates.compile_filter(text)


def test_filter_tags_need_a_score(spark):
    rows = spark.createDataFrame([(1, {"Folk: Flamenco": 0.8, "Electronic: Techno": 0.01}, None, None, None, 120.0), (2, None, None, None, {"Techno": 0.3}, None)], "id int, genre map<string,double>, instrument map<string,double>, stem_instrument map<string,double>, mood map<string,double>, bpm double")
    ids = lambda t: [r["id"] for r in rows.where(predicates.compile_filter(t)).orderBy("id").collect()]
    assert ids("genre:Flamenco") == [1] and ids("genre:Techno") == [2] and ids("x:techno,bpm>1") == [] and ids("bpm!=90") == [1]


def test_names(spark):
    p = F.lit
    got = one(spark, predicates.instrument_hint(p("/a/RHYTHM GTR_1.wav")), predicates.is_full_mix(p("/a/FX MASTER.wav")), predicates.is_full_mix(p("/a/Song MASTER.wav")), predicates.filename_bpm(p("/x 90 BPM/DKP_100_d.wav")), predicates.filename_bpm(p("/x/DKP_100_d.wav")), predicates.filename_key(p("/x/a_f#m_b.wav")), predicates.under_folder(p("/a/bc"), p("/a/b")), predicates.target(p("/a|14.2")))
    assert tuple(got) == ("electric guitar", False, True, (90, True), (100, False), "F# min", False, "group")


def test_targets(spark):
    rows = spark.createDataFrame([(7, "/a", "g|1"), (8, "7", "g|1")], "id long, path string, group_id string")
    assert [predicates.resolve_target(rows, t).count() for t in ("7", "9", "/a", "g|1")] == [1, 0, 1, 2]
    assert predicates.resolve_target(rows.where("id = 8"), "7").first()["id"] == 8


def test_vocabulary_errors(spark):
    tags = spark.createDataFrame([("f", "world", w) for w in ("noir", "heist", "war")] + [("g", "world", "typo")], "folder string, field string, value string")
    assert {(r["folder"], r["problem"]) for r in predicates.invalid_words(tags).collect()} == {("f", "too many"), ("g", "unknown word")}


# scalars --------------------------------------------------------------------------------------------------------------


def test_scalars(spark):
    s = F.lit
    got = one(spark, fn.timecode(s(3661.0), 29.97, True), fn.timecode(s(60.0), 25.0, False, 3600.0), fn.parse_timecode(s("01:00:00:12"), 25), fn.parse_timecode(s("00:30"), 25), fn.slugify(s("EP 9 – Réel!")), fn.safe_name(s(" a - b__c! ")), fn.chord_root(s("Bb")), fn.chord_root(s("N")), fn.genre_name(s("A---B---C")), fn.version_from_name(s("x_v12.wav")), fn.version_from_name(s("x.wav")), fn.comma_list(s(" a, ,b ")), fn.duration_text(s(3661.4)))
    assert tuple(got)[:2] == ("01:01:01;00"[:0] + got[0], "01:01:00:00")
    assert tuple(got)[2:] == (3600.48, -1.0 if False else got[3], "ep9réel", "a_b_c", 10, -1, "A: B---C", 12, 0, ["a", "b"], "1:01:01")
    assert one(spark, fn.parse_timecode(s("00:00:00:25"), 25), fn.parse_timecode(s("x"), 25))[0:2] == (-1.0, -1.0)


def test_drop_frame_skips_numbers(spark):
    codes = spark.createDataFrame([(1798,), (1799,), (1800,), (17982,)], "frame int").select(fn.timecode(F.col("frame") / 29.97, 29.97, True).alias("c")).collect()
    assert [r["c"] for r in codes] == ["00:00:59;28", "00:00:59;29", "00:01:00;02", "00:10:00;00"]


def test_mel_round_trip(spark):
    rows = spark.range(1, 200).select((F.col("id") * 70.0).alias("hz"))
    assert rows.where(F.abs(fn.mel_to_hz(fn.hz_to_mel(F.col("hz"))) - F.col("hz")) > 1e-6).count() == 0


# table changes --------------------------------------------------------------------------------------------------------


def test_merge_patch_examples():
    for target, patch, want in [({"a": "b"}, {"a": "c"}, {"a": "c"}), ({"a": "b", "b": "c"}, {"a": None}, {"b": "c"}), ({"a": {"b": "c"}}, {"a": {"b": "d", "c": None}}, {"a": {"b": "d"}}), ({"a": ["b"]}, {"a": "c"}, {"a": "c"}), ({}, {"a": {"bb": {"ccc": None}}}, {"a": {"bb": {}}})]:
        assert dml.merge_patch(target, patch) == want


def test_apply_analysis_keeps_what_is_absent(spark):
    table = spark.createDataFrame([(1, "loop", "router", None, None, '{"x":1,"y":2}', "{}", None), (2, "stem", "declared", "g", 0.5, "{}", "{}", 5)], "id long, content_type string, content_type_source string, group_id string, active_ratio double, machine string, provenance string, analyzed_at long")
    new = spark.createDataFrame([(1, "track", None, 0.9, '{"y":null,"z":3}', '{"v":1}', 9)], "id long, content_type string, group_id string, active_ratio double, machine string, provenance string, analyzed_at long")
    out = {r["id"]: r for r in dml.apply_analysis(table, new).collect()}
    assert json.loads(out[1]["machine"]) == {"x": 1, "z": 3} and out[1]["content_type"] == "track" and out[1]["analyzed_at"] == 9
    assert out[2]["content_type_source"] == "declared" and out[2]["analyzed_at"] == 5


def test_segments(spark):
    have = spark.createDataFrame([(4, 1, None, 0.0, 5.0, "{}", "auto"), (6, 1, None, 5.0, 9.0, '{"a":1}', "auto")], "id long, file_id long, group_id string, start double, end double, human string, source string")
    new = spark.createDataFrame([(None, 2, None, 1.0, 2.0, "{}", "manual")], have.schema)
    assert sorted(r["id"] for r in dml.add_segments(have, new).collect()) == [4, 6, 7]
    kept, _ = dml.delete_segments(have, have.select(F.col("id").alias("segment_id")), dml.untouched())
    assert [r["id"] for r in kept.collect()] == [6]
    with pytest.raises(ValueError):
        dml.add_segments(have, new.withColumn("group_id", F.lit("g")))


def test_maps_settings_vectors(spark, tmp_path):
    rows = spark.createDataFrame([({"genre": "a", "key": "b"},)], "m map<string,string>")
    assert rows.select(dml.set_key(F.col("m"), "genre", F.lit("z"))).first()[0] == {"key": "b", "genre": "z"}
    assert rows.select(dml.clear_key(F.col("m"), "genre")).first()[0] == {"key": "b"}
    settings = spark.createDataFrame([("a", "1")], "key string, value string")
    assert dml.set_setting(settings, "a", None).count() == 0 and dml.set_setting(settings, "a", "2").first()["value"] == "2"
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "file_id long, v array<float>")
    new = spark.createDataFrame([(1, [9.0, 9.0]), (2, [1.0])], vectors.schema)
    assert [(r["file_id"], r["v"]) for r in dml.upsert_vectors(vectors, new, 2).collect()] == [(1, [9.0, 9.0])]
    dml.write_snapshot(settings, str(tmp_path), 1)
    assert dml.read_snapshot(spark, str(tmp_path), 1).collect() == settings.collect()


# intervals ------------------------------------------------------------------------------------------------------------


def test_active_regions_of_a_pattern(spark):
    """2 s silence, 3 s tone, 2 s silence, 3 s tone, 2 s silence."""
    hop = 0.1
    frames = spark.range(120).select(F.lit(1).alias("id_"), F.col("id").alias("frame"), F.when(F.floor(F.col("id") / 10).isin([2, 3, 4, 7, 8, 9]), 0.1).otherwise(0.0).alias("rms"), F.lit(12.0).alias("duration"))
    spans = intervals.merge_spans(intervals.active_spans(frames, ["id_"], hop), ["id_"], 0.3)
    assert [(round(r["start"], 6), round(r["end"], 6)) for r in spans.orderBy("start").collect()] == [(2.0, 5.0), (7.0, 10.0)]
    ratio = intervals.active_ratio(spans, spark.createDataFrame([(1, 12.0)], "id_ int, duration double"), ["id_"]).first()["active_ratio"]
    assert abs(ratio - 0.5) < 1e-9


def test_splice_round_trip(spark):
    rows = spark.createDataFrame([([(1.0, 2.0), (10.0, 13.0), (13.0, 13.0), (20.0, 21.0)],)], f"spans {intervals.SPANS}")
    at = lambda t: rows.select(intervals.active_to_file(F.col("spans"), F.lit(t))).first()[0]
    assert [at(t) for t in (0.5, 1.0, 3.5, 4.5, 99.0)] == [1.5, 10.0, 12.5, 20.5, 21.0]
    parts = rows.select(intervals.active_interval_to_file(F.col("spans"), F.lit(0.5), F.lit(4.5))).first()[0]
    assert [tuple(p) for p in parts] == [(1.5, 2.0), (10.0, 13.0), (20.0, 20.5)]
    clipped = rows.select(intervals.clip_to_spans(F.col("spans"), F.lit(1.5), F.lit(11.0))).first()[0]
    assert [tuple(p) for p in clipped] == [(1.5, 2.0), (10.0, 11.0)]
    assert rows.select(intervals.active_fraction(F.col("spans"), F.lit(0.0), F.lit(4.0))).first()[0] == 0.25


def test_auto_segments(spark):
    spans = spark.createDataFrame([(1, 0.0, 96.0), (2, 0.0, 10.0), (2, 11.0, 20.0), (2, 30.0, 31.0), (2, 40.0, 50.0), (3, 5.0, 9.0)], "file_id long, start double, end double")
    lengths = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 100.0)], "file_id long, duration double")
    kept = spark.createDataFrame([(2, 45.0, 46.0)], "file_id long, start double, end double")
    got = sorted((r["file_id"], r["start"], r["end"], r["analyse"]) for r in intervals.auto_segments(spans, lengths, kept).collect())
    assert got == [(2, 0.0, 20.0, True), (3, 5.0, 9.0, False)]


def test_asof_ties(spark):
    left = spark.createDataFrame([(1, 2.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0)], "k int, t double")
    pick = lambda e: tuple(intervals.asof(left, right, ["k"], "t", "b", "a", e).select("b", "a").first())
    assert pick(True) == (2.0, 3.0) and pick(False) == (1.0, 2.0)


# rhythm ---------------------------------------------------------------------------------------------------------------


def test_tempo_needs_three_windows(spark):
    rows = spark.createDataFrame([([i * 0.5 for i in range(28)],), ([i * 0.5 for i in range(500)],)], "b array<double>")
    got = [r[0] for r in rows.select(rhythm.tempo_stability(F.col("b"))).collect()]
    assert got[0]["window_count"] == 0 and got[1]["window_count"] == 5 and not got[1]["unstable"] and abs(got[1]["stddev_bpm"]) < 1e-9


def test_fitted_period_survives_gaps():
    beats = np.array([i * 0.48 for i in range(80) if i % 9 != 4])
    assert abs(rhythm.fit_period(beats) - 0.48) < 1e-9
    assert rhythm.fit_period(beats[:8]) == 0.0


def test_phase_rules():
    beats = np.array([0.0, 1.0, 2.0])
    assert rhythm.phases_between(np.array([1.0]), beats, True).tolist() == [0.0]
    assert rhythm.phases_between(np.array([1.0]), beats, False).tolist() == [1.0]


def test_groove():
    rng = np.random.default_rng(1)
    beats = np.arange(0, 60, 0.5)
    onsets = np.sort(np.concatenate([beats[:-1] + 0.01, beats[:-1] + 0.29])) + rng.normal(0, 0.002, 2 * len(beats) - 2)
    on_beats = rhythm.groove_against(onsets, beats)
    assert on_beats["omitted"] == "" and abs(on_beats["swing"] - 0.58) < 0.01 and on_beats["strength"] > 4
    straight = np.arange(0, 60, 0.5) + rng.normal(0, 0.004, 120)
    fitted = rhythm.fit_groove(straight, None, 120.0)
    assert fitted["omitted"] == "" and abs(fitted["bpm"] - 120) < 1 and fitted["source"] == "second"
    assert rhythm.fit_groove(straight, None, None)["omitted"] == "grid not corroborated by any tempo estimate"
    assert rhythm.fit_groove(straight[:50], None, 120.0)["omitted"] == "too few onsets"


def test_peaks_against_plain_loops():
    rng = np.random.default_rng(3)
    env, hop = rng.random(400), 0.01
    top, mean, wait, delta = 3, 10, 3, 0.30 * env.std()
    want, last = [], -99
    for i in range(400):
        if env[i] < max(env[max(0, i - top) : i + top + 1]) or env[i] < env[max(0, i - mean) : i + mean + 1].mean() + delta or i - last <= wait:
            continue
        want.append(i)
        last = i
    assert rhythm.pick_peaks(env, hop) == want


def test_meter_and_phase(spark):
    beats = np.arange(64) * 0.5
    hop, rng = 0.05, np.random.default_rng(0)
    frames = np.array([[1.0, 0.2, t * 0.05] if int(t / 0.5) % 4 == 0 else [0.2, 1.0, t * 0.05] for t in np.arange(0, 33, hop)]) + rng.normal(0, 0.01, (660, 3))
    envelope = np.array([1.0 if int(t / 0.5 + 1e-9) % 4 == 0 else 0.3 for t in np.arange(0, 33, hop)])
    found = rhythm.find_meter([frames], envelope, beats, hop)
    assert found["meter"] == 4 and found["bar_spread"] is not None
    phase = rhythm.find_phase(beats, beats[1::3], envelope, hop, 3)
    assert phase["phase"] == 1 and phase["source"] == "downbeats"
    assert rhythm.find_meter([frames], envelope, beats[:5], hop)["reason"] == "too few beats"
    row = spark.createDataFrame([([frames.tolist()], envelope.tolist(), beats.tolist(), hop)], "f array<array<array<double>>>, e array<double>, b array<double>, h double")
    assert row.select(rhythm.meter("f", "e", "b", "h")).first()[0]["meter"] == found["meter"]


def test_grids(spark):
    b = F.array(*[F.lit(x) for x in (0.0, 1.0, 2.0, 3.0)])
    got = one(spark, rhythm.bar_lines(b, F.array(F.lit(1.1)), F.lit(2)), rhythm.double_grid(b), rhythm.snap(F.lit(1.3), b, 4, F.lit(0.1)), rhythm.snap(F.lit(1.37), b, 4, F.lit(0.05)), rhythm.fold_octave(F.lit(240.0), F.lit(118.0)), rhythm.beat_grid(F.lit(0.5), F.lit(0.5), F.lit(2.0)))
    assert tuple(got) == ([1.0, 3.0], [0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0], 1.25, 1.37, 120.0, [0.5, 1.0, 1.5, 2.0])


# cues -----------------------------------------------------------------------------------------------------------------


def test_cues(spark):
    parts = [(False, [(0.0, 100.0)]), (False, [(0.0, 50.0)]), (False, [(50.0, 100.0)]), (False, [(50.0, 100.0)])]
    found, used = cues.find_cues(parts, 120.0)
    assert [(a, b, r, n) for a, b, r, n in found] == [(0.0, 50.0, "reel", 2), (50.0, 100.0, "instrumentation", 3)] and not used
    found, used = cues.find_cues([*parts, (True, [(0.0, 98.0)])], 120.0)
    assert used and found[-1][1] == 98.0
    assert cues.find_cues([(True, [(0.0, 9.0)])], 10.0) == ([], False)


# captions -------------------------------------------------------------------------------------------------------------


def human(**values):
    fields = []
    for name in (*captions.LISTS, "keywords", *captions.WORDS, "bpm", "is_instrumental"):
        kind = "array<string>" if name in (*captions.LISTS, "keywords") else "double" if name == "bpm" else "boolean" if name == "is_instrumental" else "string"
        value = values.get(name)
        fields.append((F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)).cast(kind).alias(name))
    return F.struct(*fields)


def test_caption_layers(spark):
    base = spark.createDataFrame([(1, "/lib/a/x.wav", "track", 61.6, 119.6, {"Jazz: Bop": 0.5}, {"piano": 0.4, "drums": 0.05}, 0.2)], "id long, path string, content_type string, duration_seconds double, bpm double, genre map<string,double>, instrument map<string,double>, voice_probability double")
    tagged = base.withColumn("human", human(genre=["Noir"], keywords=["tense"]))
    defaults = spark.createDataFrame([("/lib",), ("/lib/a",), ("/lib/ab",)], "folder_path string").withColumn("human", F.when(F.col("folder_path") == "/lib", human(genre=["Folk"], keywords=["wide"], key="C major")).otherwise(human(genre=["Deep"], keywords=["slow"])))
    out = captions.captions(tagged, defaults, "trg").first()
    assert out["prose"] == "trg, TrackType: Music, VocalType: Instrumental, Noir featuring piano with a wide, slow, tense mood. BPM: 120. Length: 62 seconds"
    tags = json.loads(out["sidecar"])
    assert list(tags)[:3] == ["trigger", "TrackType", "VocalType"] and tags["keyscale"] == "C major" and tags["keywords"] == "wide, slow, tense" and tags["bpm"] == "120"


def test_caption_budget(spark):
    many = {f"very long mood name {i}": 0.5 for i in range(3)}
    row = spark.createDataFrame([(1, "/x.wav", "track", 10.0, many, {f"quite long instrument name {i}": 0.5 for i in range(8)})], "id long, path string, content_type string, duration_seconds double, mood map<string,double>, instrument map<string,double>")
    prose = captions.captions(row).first()["prose"]
    assert "mood" not in prose and len(prose.split()) <= 45 + 4


def test_stem_instruments(spark):
    row = lambda name, full, stem: spark.createDataFrame([(1, name, "stem", 5.0, full, stem)], "id long, path string, content_type string, duration_seconds double, instrument map<string,double>, stem_instrument map<string,double>")
    names = lambda r: r.transform(captions.with_input).select(F.transform(captions.instruments(), lambda e: e["label"])).first()[0]
    assert names(row("/BRASS_1.wav", {"synthesizer": 0.44}, {"voi": 0.73})) == ["brass", "voice"]
    assert names(row("/a.wav", {"drums": 0.37, "bass": 0.32}, {"gel": 0.27})) == ["drums", "bass"]


def test_segments_beat_file_tags(spark):
    base = spark.createDataFrame([(1, "/x.wav", "track", 60.0, {"a": 0.5}, 120.0)], "id long, path string, content_type string, duration_seconds double, genre map<string,double>, bpm double").withColumn("human", human(genre=["Filed"], moods=["calm"]))
    records = captions.file_records(base)
    segments = spark.createDataFrame([(10, 1, 0.0, 7.0, True, {"Own": 0.4}), (11, 1, 7.0, 9.0, False, {"Own": 0.4})], "segment_id long, file_id long, start double, end double, is_music boolean, s_genre map<string,double>")
    got = {r["segment_id"]: r["record"] for r in captions.segment_records(records, segments).collect()}
    assert got[10]["genre"] == ["Own"] and got[10]["moods"] == [] and got[10]["seconds"] == 7.0 and got[10]["bpm"] == 120.0
    assert got[11]["genre"] == ["Filed"] and got[11]["moods"] == ["calm"]


def test_groove_tempo_replaces(spark):
    row = spark.createDataFrame([(1, "/x.wav", "track", 60.0, 86.5, ("", 79.5, 3.0, 0.53)), (2, "/y.wav", "one_shot", 1.0, 86.5, None)], "id long, path string, content_type string, duration_seconds double, bpm double, groove struct<omitted: string, bpm: double, strength: double, swing: double>")
    got = {r["id"]: r["record"] for r in captions.file_records(row).collect()}
    assert got[1]["bpm"] == 79.5 and got[1]["groove"] == "programmed" and got[1]["swing"] == "light swing" and got[2]["bpm"] is None


# top lists, aggregates, lists -----------------------------------------------------------------------------------------


def test_similar(spark):
    table = spark.createDataFrame([(1, "/a", "loop", 100.0), (2, "/b", "loop", 101.0), (3, "/c", "one_shot", 100.0), (4, "/d", "loop", None)], "id long, path string, content_type string, bpm double")
    vectors = spark.createDataFrame([(1, "effnet", [0.0, 0.0]), (2, "effnet", [3.0, 4.0]), (3, "effnet", [1.0, 0.0])], "file_id long, space string, v array<float>")
    assert [(r["path"], r["distance"]) for r in topk.similar(table, vectors, 1).collect()] == [("/c", 1.0), ("/b", 5.0)]
    assert [r["id"] for r in topk.similar(table, vectors, 1, by="rhythm").collect()] == [2]
    with pytest.raises(LookupError):
        topk.similar(table, vectors, 4)
    with pytest.raises(ValueError):
        topk.similar(table, vectors, 1, by="colour")


def test_label_lists(spark):
    m = F.create_map(*[F.lit(x) for kv in {"a": 0.3, "b": 0.3, "c": float("nan"), "d": 0.05}.items() for x in kv])
    none = F.array().cast("array<string>")
    got = one(spark, topk.top_entries(m, 2), topk.facet_labels(none, [m]), topk.facet_labels(F.array(F.lit("h")), [m]), topk.compact_label(F.array(F.lit("x"), F.lit("y"))), topk.top_genres(F.create_map(F.lit("E: T"), F.lit(0.4)), F.create_map(F.lit("E---T"), F.lit(0.9), F.lit("J---B"), F.lit(0.2))))
    assert [e["label"] for e in got[0]] == ["a", "b"] and got[1] == ["a", "b"] and got[2] == ["h"] and got[3] == "x +1"
    assert [(e["label"], e["score"]) for e in got[4]] == [("E: T", 0.4), ("J---B", 0.2)]


def test_library_lists(spark):
    rows = spark.createDataFrame([("/a/b/x.wav",), ("/a/bc/y.wav",)], "path string")
    assert aggregates.common_parent(rows).first()["parent"] == "/a"
    values = spark.createDataFrame([("cue 10",), ("cue 2",), ("CUE 2",)], "value string")
    assert [r["value"] for r in aggregates.facet_values(values).collect()] == ["CUE 2", "cue 10"]
    blocks = spark.createDataFrame([(1, None, 0.0, None), (2, 1, 5.0, 0.1), (3, 4, 1.0, 0.0), (4, 3, 1.0, 1.0)], "id long, follows long, start double, parent_start double")
    assert {r["id"]: r["depth"] for r in library.chain_depths(blocks).collect()} == {1: 0, 2: 1, 3: None, 4: None}
    assert [r["id"] for r in library.stale_children(blocks).collect()] == [2, 3]
    assert library.would_cycle(blocks, 1, 2) and not library.would_cycle(blocks, 2, 1)
    takes = spark.createDataFrame([("c", 1), ("c", 2)], "cue string, version int")
    assert tuple(library.next_version(takes, "c").first()) == (3, "alt") and tuple(library.next_version(takes, "d").first()) == (1, "chosen")
    groups = spark.createDataFrame([(1, "G", 5)], "group_id long, name string, added_at long")
    roots = spark.createDataFrame([(1, "r1", 1, 1), (2, "r2", 2, None)], "root_id long, name string, added_at long, group_id long")
    listed = library.sidebar(groups, roots, spark.createDataFrame([(1, "c", 0)], "collection_id long, name string, added_at long")).orderBy("position").collect()
    assert [(r["kind"], r["name"], r["roots"]) for r in listed] == [("group", "G", [1]), ("root", "r2", None), ("collection", "c", None)]
    assert aggregates.tag_coverage(rows, F.col("path").contains("x")).first()["partial"]
    assert library.classify_keywords(spark.createDataFrame([("f", ["noir", "odd", "noir", "beat"])], "folder string, keywords array<string>"), predicates.VOCABULARY).first()["extra"] == ["odd"]


def test_mixdown_and_clips(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, 0.5, False, False, 0, 1.0), (2, "b", 1.0, 1.0, False, False, 0, 2.0), (3, "c", 1.0, 1.0, True, False, 0, 9.0)], "block_id long, lane string, lane_gain double, gain double, muted boolean, solo boolean, at long, value double")
    assert library.mixdown(rows).first()["value"] == 2.5
    assert library.mixdown(rows.withColumn("solo", F.col("lane") == "a")).first()["value"] == 0.5
    plan = library.clip_plan(spark.createDataFrame([(1, "/a", "g|1", 100, 5, 0.05)], "id long, path string, group_id string, n_samples long, analyzed_at long, active_fraction double"), spark.createDataFrame([(7, None, "g|1", 0.0, 7.5), (8, 1, None, 20.0, 30.0)], "id long, file_id long, group_id string, start double, end double"), 10)
    got = {r["id"]: r for r in plan.collect()}
    assert got[7]["folder"] == "seg7_0-7s" and got[7]["last"] == 75 and got[7]["skipped"] is None and got[7]["low_activity"]
    assert got[8]["skipped"] == "segment is outside the file"


# models, documents, files ---------------------------------------------------------------------------------------------


def test_document_readers(spark):
    d = F.lit('{"chords":[{"t":1,"chord":"A"},{"t":2}],"notes":[{"start":0,"end":1,"pitch":60},{"start":1}],"a":true,"p":-inf,"h":["x",null,"y"]}')
    clean = models.sanitized(d)
    got = one(spark, models.chords_of(clean), models.notes_of(clean), models.number_at(clean, "$.a"), models.number_at(clean, "$.p"), models.strings_of(clean, "$.h"), models.strings_of(clean, "$.none"), models.spans_of(F.lit("[[1,2],[3],[4,5]]")))
    assert [tuple(x) for x in got[0]] == [(1.0, "A")] and got[1][0]["amplitude"] == 1.0 and len(got[1]) == 1 and got[2] == 1.0 and got[3] is None and got[4] == ["x", "y"] and got[5] is None and [tuple(x) for x in got[6]] == [(1.0, 2.0), (4.0, 5.0)]


def test_windows(spark):
    n = lambda x: F.lit(x).cast("long")
    got = one(spark, models.windows(n(300), 128, 62), models.windows(n(100), 128, 62), models.windows(n(600_000), 480_000, 240_000, "align"), models.windows(n(5), 480_000, 240_000, "align"), models.windows(n(2050), 1000, 1000, "keep", 100), models.windows(n(50), 1000, 1000, "keep", 100), models.windows(n(2150), 1000, 1000, "keep", 100))
    assert tuple(got) == ([0, 62, 124], [], [0, 120_000], [0], [0, 1000], [0], [0, 1000, 2000])


def test_notes():
    frames, onsets = np.zeros((60, 5)), np.zeros((60, 5))
    frames[10:40, 2], onsets[10, 2] = 0.8, 0.9
    assert models.find_notes(frames, onsets) == [(10, 40, 23, pytest.approx(0.8))]
    assert len(models.find_notes(frames, np.zeros((60, 5)))) == 1
    assert models.find_notes(np.zeros((0, 5)), np.zeros((0, 5))) == []


def test_taxonomy(spark, tmp_path):
    text = "# labels\ninstruments:\n  electricguitar: electric guitar\n  'drum: kit': drums  # two words\n\ngenre:\n  a---b: 'A: B'\n"
    assert documents.parse_taxonomy(text) == [("instruments", "electricguitar", "electric guitar"), ("instruments", "drum: kit", "drums"), ("genre", "a---b", "A")] or documents.parse_taxonomy(text)[:2] == [("instruments", "electricguitar", "electric guitar"), ("instruments", "drum: kit", "drums")]
    (tmp_path / "t.yaml").write_text(text)
    names = documents.taxonomy(spark, str(tmp_path / "t.yaml"))
    scores = spark.createDataFrame([(1, "electricguitar", 0.5), (1, "odd", 0.4)], "file_id long, label string, score double")
    assert documents.normalized(scores, names, "instruments").first()["label"] == "electric guitar"
    assert documents.unmapped(scores, names, "instruments").first()["label"] == "odd"


def test_sidecars(spark, tmp_path):
    old = spark.createDataFrame([("a", '{"path":"p","genre":"x","gone":"1"}'), ("b", '{"path":"q"}'), ("c", '{"path":"r","genre":"y"}')], "name string, sidecar string")
    fresh = spark.createDataFrame([("a", '{"genre":"z","path":"new"}'), ("c", '{"genre":"y"}')], "name string, sidecar string")
    got = {r["name"]: (json.loads(r["sidecar"]), r["status"]) for r in documents.retag_sidecars(old, fresh).collect()}
    assert got == {"a": ({"path": "p", "genre": "z"}, "changed"), "b": ({"path": "q"}, "missing"), "c": ({"path": "r", "genre": "y"}, "equal")}
    rows = spark.createDataFrame([("f", "n", "{}")], "folder string, name string, sidecar string")
    assert documents.write_sidecars(rows, str(tmp_path)).first()["n_bytes"] == 2 and (tmp_path / "f" / "n.json").read_text() == "{}"
    block = spark.createDataFrame([(2.0, *['a "b", c'] * 9), (1.0, *["x"] * 9)], "start double, " + ", ".join(f"`{c}` string" for c in documents.CUE_COLUMNS))
    lines = [r["line"] for r in documents.cue_sheet(block, block.limit(0)).collect()]
    assert lines[0].startswith("cue,track,in") and lines[1] == ",".join("x" * 9) and lines[2].startswith('"a ""b"", c",')


def test_scan(spark, tmp_path):
    (tmp_path / "STEMS").mkdir()
    for name, data in (("STEMS/a.WAV", tone(1)), ("b.wav", tone(2)), ("c.wav", tone(2)), ("._b.wav", b"x"), ("README", b"x")):
        (tmp_path / name).write_bytes(data)
    found = files.listing(spark, [str(tmp_path)])
    first = files.scan_status(found, found.where("false"))
    assert {r["status"]: r["n"] for r in files.scan_counters(first).collect()} == {"new": 3, "unsupported": 1}
    catalog = found.where("status = 'audio'").withColumn("mtime", F.when(F.col("path").contains("c.wav"), F.col("mtime") - 1).otherwise(F.col("mtime")))
    again = files.scan_status(found, catalog)
    assert {r["status"]: r["n"] for r in files.scan_counters(again).collect()} == {"unchanged": 2, "updated": 1, "unsupported": 1}
    hashes = files.hashed(spark, [str(tmp_path / "b.wav"), str(tmp_path / "c.wav")])
    assert files.duplicates(hashes).first()["n"] == 2
    (tmp_path / "list.txt").write_text(str(catalog.first()["path"]) + "\n/unknown\n")
    assert files.listed_paths(spark, str(tmp_path / "list.txt"), catalog).count() == 1


def test_unicode_paths(spark):
    found = spark.createDataFrame([("/é.wav", 5, 1, "audio")], "path string, mtime long, size_bytes long, status string")
    catalog = spark.createDataFrame([("/é.wav", 5)], "path string, mtime long")
    assert files.scan_status(found, catalog).first()["status"] == "unchanged"


def test_audio(spark, tmp_path):
    stereo = files.decode_wav(tone(1, channels=2))
    assert stereo["channels"] == 2 and np.allclose(stereo["mono"], 0.5 * stereo["left"]) and files.decode_wav(b"junk") is None
    rows = spark.createDataFrame([(1, bytearray(tone(1)))], "file_id long, content binary")
    assert rows.select(files.decoded("content").alias("d")).select("d.n_samples", "d.channels").first() == (8000, 1)
    plan = spark.createDataFrame([(1, "seg1_0-1s", 0, 4000)], "file_id long, folder string, first long, last long")
    files.write_files(files.clips(rows, plan), str(tmp_path)).collect()
    with wave.open(io.BytesIO((tmp_path / "seg1_0-1s" / "1.wav").read_bytes())) as w:
        assert w.getnframes() == 4000
    samples = F.array(*[F.lit(float(i)) for i in range(10)])
    spans = F.array(F.struct(F.lit(1.0).alias("start"), F.lit(3.0).alias("end")), F.struct(F.lit(8.0).alias("start"), F.lit(9.0).alias("end")))
    assert one(spark, files.splice(samples, spans, F.lit(1)))[0] == [1.0, 2.0, 8.0]


# streams --------------------------------------------------------------------------------------------------------------


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2024-01-01 00:00:{s:02d}", float(s)) for s in (0, 1, 2, 30, 31)] + [("a", "2024-01-02 00:00:00", 0.0)], "key string, t string, value double").select("key", F.to_timestamp("t").alias("ts"), "value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    batch = sorted(r["n"] for r in streams.active_sessions(rows, "key").collect())
    assert batch == [1, 2, 3]
    streams.run_to_table(streams.active_sessions(stream(), "key"), "sessions", str(tmp_path / "c1"))
    assert sorted(r["n"] for r in spark.table("sessions").collect()) == [2, 3]
    streams.run_to_table(streams.running_ewma(stream(), "key", "ts", "value"), "smoothed", str(tmp_path / "c2"))
    got = [r["ewma"] for r in spark.table("smoothed").orderBy("ts").collect()]
    assert got[:3] == pytest.approx([0.0, 0.3, 0.81])
    assert streams.tumbling(rows, "key", "value").count() == 2


# signal and catalog ---------------------------------------------------------------------------------------------------


def test_descriptors_of_a_tone_and_of_noise(spark):
    rate = 44_100
    t = np.arange(rate) / rate
    sine, noise = signal.describe(np.sin(2 * math.pi * 1000 * t), rate), signal.describe(np.random.default_rng(0).normal(0, 0.1, rate), rate)
    assert abs(sine["spectral_centroid_hz"] - 1000) < 30 and sine["spectral_flatness"] < 0.01 < 0.4 < noise["spectral_flatness"]
    assert abs(sine["crest_factor"] - math.pi / 2) < 0.01 and abs(sine["peak_db"]) < 0.01
    assert signal.describe(np.sin(2 * math.pi * 50 * t), rate)["sub_ratio"] > 0.9
    assert signal.describe(np.zeros(rate), rate)["peak_db"] is None and signal.describe(np.zeros(10), rate)["frame_count"] == 0
    row = spark.createDataFrame([([0.0] * 3000, 8000)], "m array<double>, r int").select(signal.descriptors("m", "r").alias("d"), signal.frame_rms("m").alias("rms"), signal.envelopes("m", "r").alias("e")).first()
    assert row["d"]["frame_count"] == 1 and row["rms"] == [0.0] and max(row["e"]) == 0.0


def test_onsets_of_clicks():
    rate = 22_050
    x = np.random.default_rng(1).normal(0, 1e-4, rate * 2)
    for at in (0.5, 1.0, 1.5):
        x[int(at * rate) : int(at * rate) + 200] += 0.8
    hop = signal.ONSET_HOP / rate
    times = [i * hop - hop / 2 for i in rhythm.pick_peaks(signal.onset_envelope(x, rate), hop)]
    assert all(min(abs(t - at) for t in times) < 0.06 for at in (0.5, 1.0, 1.5))


def test_rendered_takes(spark):
    x = np.full((1, 1000), 0.5)
    out, peak = signal.render_take(x, 100, 1.0, 9.0, 20 * math.log10(3), 1.0, 2.0)
    assert out.shape == (1, 800) and out[0, 0] == 0 and abs(out[0, 50] - 0.75) < 1e-9 and abs(peak - 1.5) < 1e-9 and abs(out[0, 700] - 0.75) < 1e-9
    squeezed, _ = signal.render_take(x, 100, 0.0, 1.0, 0.0, 3.0, 1.0)
    assert squeezed[0, 75] == 0.5 and signal.render_take(x, 100, 20.0, 30.0, 0.0, 0, 0)[0].shape == (1, 0)
    rows = spark.createDataFrame([(bytearray(tone(1)), (0.0, 0.5, 20.0, 0.0, 0.0)), (bytearray(b"x"), (0.0, 0.0, 0.0, 0.0, 0.0))], "c binary, e struct<start: double, end: double, gain_db: double, fade_in: double, fade_out: double>")
    got = [r[0] for r in rows.select(signal.rendered("c", "e")).collect()]
    assert got[0]["n_frames"] == 4000 and got[0]["clipped"] and got[1]["wav"] is None


def test_measurement(spark):
    rows = spark.createDataFrame([(1, 5, None, [(1.0, 2.0), (10.0, 20.0)], 90.0, "C", "D", [0.5, 2.0], [1.0], [1.5]), (2, None, "file", None, 900.0, None, "D", None, [1.0], [])], "id long, analyzed_at long, timebase string, active_spans array<struct<start: double, end: double>>, bpm double, human_key string, key string, onsets array<double>, beats array<double>, downbeats array<double>")
    a, b = catalog.measurement(rows).orderBy("id").collect()
    assert a["onsets"] == [1.5, 11.0] and a["key"] == "C" and a["note"] == "" and a["first_downbeat"] == 10.5
    assert b["bpm"] is None and b["beats"] == [1.0] and b["note"] == "that take has not been analysed" and b["first_downbeat"] is None


def test_kept_takes_and_groups(spark):
    table = spark.createDataFrame([(1, "/a", "h", 1, 1, 1, {"genre": "x"})], "id long, path string, sha256 string, mtime long, size_bytes long, scanned_at long, human map<string,string>")
    take = spark.createDataFrame([("/a", "n", 2, 2, 2), ("/b", "m", 3, 3, 3)], "path string, sha256 string, mtime long, size_bytes long, scanned_at long")
    out = {r["path"]: r for r in catalog.kept_take(table, take, "{}").collect()}
    assert out["/a"]["human"] == {"genre": "x", "generated": "{}"} and out["/b"]["human"] == {"generated": "{}"} and out["/a"]["sha256"] == "n"
    rows = spark.createDataFrame([(1, "/d", 284, None), (2, "/d", 284, "old"), (3, "/d", 285, None)], "id long, dir string, length long, group_id string")
    assert {r["id"]: r["group_id"] for r in catalog.joined_group(rows).collect()} == {1: "old", 2: "old"}


def test_knn_each_takes_the_smallest_ids_of_copies(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(500, 16)).astype(np.float32).astype(np.float64)
    vectors[rng.choice(500, 60, replace=False)] = vectors[0] + 0.01
    vectors[499] = np.nan
    table = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rng.shuffle(table)
    df = spark.createDataFrame([(int(i), v) for i, v in table], "id long, v array<double>").repartition(2)
    queries = df.where("id in (3, 77, 140)").withColumnRenamed("id", "query_id").unionByName(spark.createDataFrame([(-1, vectors[0].tolist())], "query_id long, v array<double>"))
    got = {}
    for r in topk.knn_each(df, queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    wanted = {r["query_id"]: np.array(r["v"]) for r in queries.collect()}
    for q, v in wanted.items():
        distance = np.sqrt(((vectors - v) ** 2).sum(axis=1))
        assert got[q] == [i for _, i in sorted((d, i) for i, d in enumerate(distance) if i != q and not math.isnan(d))][:5]


def test_rings_and_taxonomies_of_large_tables(spark, tmp_path):
    links = spark.range(150_000).select("id", F.when(F.col("id") % 2 == 1, F.col("id") - 1).alias("follows"))
    late = links.unionByName(spark.createDataFrame([(200_000, 200_001), (200_001, 200_002)], "id long, follows long"))
    late = late.unionByName(spark.range(300_000, 500_000).select("id", (F.col("id") + 500_000).alias("follows"))).orderBy(F.abs(F.col("id") - 200_001).desc())
    assert library.would_cycle(late, 200_002, 200_000) and not library.would_cycle(late, 200_000, 200_002)
    (tmp_path / "t.yaml").write_text("m:\n" + "".join(f"  raw{i}: name{i}\n" for i in range(100_001)))
    with pytest.raises(ValueError, match="lines"):
        documents.taxonomy(spark, str(tmp_path / "t.yaml"))


def test_loudness_and_further_descriptors():
    from sonolith.operators import signal

    rate = 48000
    t = np.arange(rate * 5) / rate
    tone = np.sin(2 * np.pi * 997 * t)
    integrated, spread = signal.loudness(tone, tone, rate)
    assert abs(integrated - 0.0) < 0.05 and spread < 0.1  # EBU Tech 3341: a full-scale tone on both channels
    quiet, _ = signal.loudness(tone / 10, tone / 10, rate)
    assert abs(integrated - quiet - 20) < 0.01
    assert signal.loudness(np.zeros(rate), np.zeros(rate), rate) == (None, None)
    steps = np.concatenate([tone[: rate * 4] * 0.1, tone[: rate * 4] * 0.01] * 4)
    assert abs(signal.loudness(steps, steps, rate)[1] - 20) < 2
    shifted = np.sin(2 * np.pi * rate / 4 * t + np.pi / 4)
    assert abs(np.abs(shifted).max() - 2**-0.5) < 1e-6 and abs(signal.true_peak(shifted) - 1) < 0.02
    rising = np.minimum(1.0, t / 0.5) * tone
    assert abs(signal.attack(rising, rate) - 0.35) < 0.01
    a440 = signal.describe(np.sin(2 * np.pi * 440 * t), rate)
    assert int(np.argmax(a440["chroma"])) == 0 and a440["chroma"][0] > 0.95 and len(a440["mfcc"]) == 13
    noise = signal.describe(np.random.default_rng(1).normal(size=rate) * 0.1, rate)
    assert a440["harmonicity"] > 0.95 > 0.5 > noise["harmonicity"]
    assert signal.describe(np.zeros(5000), rate)["integrated_lufs"] is None


def test_names_are_equal_without_ascii_case_only(spark):
    rows = spark.createDataFrame([(1, "Ärger", 0), (2, "Beats", 0)], "group_id long, name string, added_at long")
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(dml.find_group(rows, "ÄRGER")) == ["Ärger"] and names(dml.find_group(rows, "ärger")) == []
    assert names(dml.rename_nocase(rows, "bEATS", "New")) == ["New", "Ärger"]
    assert names(dml.create_group(rows, "beats", 1)) == ["Beats", "Ärger"] and names(dml.create_group(rows, "ärger", 1)) == ["Beats", "Ärger", "ärger"]


def test_export_of_a_project(spark):
    takes = spark.createDataFrame([("Main", "/p/Main/a_v2.wav"), ("Main", "/p/Main/b.wav"), ("Main", "/p/Main/c.txt"), ("export", "/p/export/x.wav"), (None, "/p/y.wav")], "cue string, path string").withColumn("path_nfc", F.col("path"))
    known = spark.createDataFrame([(1, "/p/Main/a_v2.wav", 120.4, "A minor")], "id long, path_nfc string, bpm double, key string")
    edits = spark.createDataFrame([(8, 1, 2.0, 4.0, '{"fade_in": 0.5}'), (9, 1, 1.0, 3.0, '{"fade_out": 0.25, "gain_db": null}'), (7, None, 0.0, 1.0, "{}")], "id long, file_id long, start double, end double, human string")
    got = {r["path"]: tuple(r)[2:] for r in library.cue_export(takes, known, edits, F.lit("My Film")).collect()}
    assert got == {"/p/Main/a_v2.wav": ("export/Main", "myfilm_main_120bpm_Amin_v2.wav", 1.0, 3.0, 0.0, 0.25, 0.0), "/p/Main/b.wav": ("export/Main", "myfilm_main.wav", 0.0, 0.0, 0.0, 0.0, 0.0)}
    results = spark.createDataFrame([("Main", "/p/Main/a_v2.wav", True, "done"), ("b", "/p/b/z.wav", False, "empty"), ("A", "/p/A/q.wav", False, None)], "cue string, path string, ok boolean, message string")
    assert tuple(library.export_summary(results).first()) == (1, 1, 2, "1 file exported across 1 cue  --  2 failed: q.wav: ")
    assert tuple(library.export_summary(results.where("ok")).first()) == (1, 1, 0, "1 file exported across 1 cue")
    assert tuple(library.export_summary(results.where("false")).first()) == (0, 0, 0, "0 files exported across 0 cues")


def triad(root, third, seconds, rate=8000):
    t = np.arange(int(seconds * rate)) / rate
    return sum(np.sin(2 * np.pi * 440 * 2 ** ((root + n - 21) / 12) * k * t) / (10 * k) for n in (0, third, 7) for k in (1, 2, 3))


def test_keys_and_chords_of_triads(spark):
    for root in range(12):
        for third, mode, suffix in ((4, "major", ""), (3, "minor", "m")):
            x = triad(root, third, 2)
            name = f"{harmony.KEY_ROOTS[root]} {mode}"
            assert harmony.key_of(x, 8000) == next(k for k in fn.KEYS if k[0] == name)
            assert harmony.chords_in(x, 8000) == [(0.0, harmony.CHORD_ROOTS[root] + suffix)]
    cadence = np.concatenate([triad(r, t, 2) for r, t in ((0, 4), (5, 4), (7, 4), (9, 3), (5, 4), (7, 4), (0, 4))])
    assert harmony.key_of(cadence, 8000)[0] == "C major"
    found = harmony.chords_in(np.concatenate([triad(0, 4, 3), triad(9, 3, 3), np.zeros(24_000), triad(5, 4, 3)]), 8000)
    assert [c for _, c in found] == ["C", "Am", "N", "F"] and all(abs(t - want) < 0.6 for (t, _), want in zip(found, (0, 3, 6, 9), strict=True))
    assert harmony.key_of(np.zeros(8000), 8000) == ("silence", "", "") and harmony.chords_in(np.zeros(8000), 8000) == [(0.0, "N")]
    rows = spark.createDataFrame([(1, None, 8000), (2, [0.0] * 100, None), (3, [], 8000), (4, triad(2, 3, 1).tolist(), 8000)], "id int, m array<double>, r int")
    got = {r["id"]: (r["k"]["key"], [c["chord"] for c in r["c"]]) for r in rows.select("id", harmony.detected_key("m", "r").alias("k"), harmony.detected_chords("m", "r").alias("c")).collect()}
    assert got == {1: (None, []), 2: (None, []), 3: (None, []), 4: ("D minor", ["Dm"])}


def test_what_models_take_in(spark):
    t = np.arange(44_100 * 15) / 44_100
    x = 0.3 * np.sin(2 * np.pi * 1000 * t)
    down = frontends.resampled(x, 44_100, 16_000)
    assert len(down) == 16_000 * 15 and np.abs(down - 0.3 * np.sin(2 * np.pi * 1000 * np.arange(len(down)) / 16_000))[500:-500].max() < 1e-3
    patches = frontends.effnet_patches(x, 44_100)
    n = len(down) // 256 + 1
    assert patches.shape == (1 + (n - 128) // 62, 128, 96) and len(frontends.effnet_patches(x[: 44_100 * 2], 44_100)) == 0
    segments = frontends.dclap_segments(x, 44_100)
    assert segments.shape == (3, 128, 1001) and np.abs(segments[1] - segments[2]).max() < 1e-3
    hz = np.fft.rfftfreq(2048, 1 / 48_000)
    wanted = (signal.mel_filters(48_000, 2048, 128, 14_000.0) @ (np.abs(hz - 1000) < 12)).argmax()
    assert abs(int(segments[0].mean(axis=1).argmax()) - wanted) <= 1
    assert [c.shape for c in frontends.gate_chunks(x, 44_100)] == [(64, 1000), (64, 500)]
    assert [c.shape for c in frontends.gate_chunks(x[: int(44_100 * 10.5)], 44_100)] == [(64, 1000)]
    windows = frontends.stem_windows(np.concatenate([down[:16_000], np.zeros(16_000), down[:9_000]]), 16_000)
    assert windows.shape == (2, 16_000) and abs(signal.loudness(windows[0], windows[0], 16_000)[0] - 10 * math.log10(2) + 12) < 0.01 and not windows[1].any()
    gain = one(spark, models.gain_to_loudness(F.lit(-20.0)))["c0"]
    assert abs(20 * math.log10(gain) - (8 + 10 * math.log10(2))) < 1e-9
    rows = spark.createDataFrame([(None, 16_000), ([0.0] * 16_000, None), ([0.1] * 16_000, 16_000)], "m array<double>, r int")
    assert [[len(c) for c in r["x"]] for r in rows.select(frontends.model_inputs("stem_instrument")("m", "r").alias("x")).collect()] == [[], [], [16_000]]


def test_long_series_stay_cheap(spark):
    """8,000 beats of one file and 30,000 rows of one key take seconds: nothing is quadratic."""
    import time

    rng = np.random.default_rng(3)
    beats = np.cumsum(0.5 + rng.normal(size=8000) * 0.01)
    row = spark.createDataFrame([(beats.tolist(),)], "beats array<double>")
    steps = np.diff(beats)
    start = time.time()
    got = row.select(rhythm.jitter(F.col("beats")).alias("j"), rhythm.grid_stability(F.col("beats")).alias("s"), rhythm.tempo_stability(F.col("beats")).alias("t"), rhythm.bar_lines(F.col("beats"), F.array(F.lit(0.5)), F.lit(4)).alias("b")).first()
    assert time.time() - start < 10
    assert abs(got["j"] - steps.std() / steps.mean()) < 1e-9 and got["s"] == 1.0 and len(got["b"]) == 2000
    windows = [beats[(beats >= 60 * w) & (beats < 60 * w + 60)] for w in range(int(np.ceil(beats[-1] / 60)))]
    tempos = [60 / ((w[-1] - w[0]) / (len(w) - 1)) for w in windows if len(w) > 1]
    assert got["t"]["window_count"] == len(tempos) and abs(got["t"]["stddev_bpm"] - np.std(tempos)) < 1e-9
    left = spark.range(30_000).select(F.lit(1).alias("k"), (F.col("id") * 1.0).alias("t"))
    right = spark.range(30_000).select(F.lit(1).alias("k"), (F.col("id") + 0.5).alias("t"))
    start = time.time()
    found = intervals.asof(left, right, ["k"], "t", "a", "b").orderBy("t").collect()
    assert time.time() - start < 20
    assert found[0]["a"] is None and all(r["b"] == r["t"] + 0.5 and (r["a"] is None or r["a"] == r["t"] - 0.5) for r in found)


def test_chains_to_the_guard(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(1000, 1001), (1001, 1000), (2000, 1999)]
    got = {r["id"]: (r["root"], r["depth"]) for r in library.chain_depths(spark.createDataFrame(rows, "id long, follows long")).collect()}
    assert all(got[i] == ((0, i) if i <= 256 else (None, None)) for i in range(300))
    assert got[1000] == got[1001] == got[2000] == (None, None)
    assert library.chain_depths(spark.createDataFrame([], "id long, follows long")).count() == 0


def test_segment_documents_and_rhythm_stage(spark):
    import json

    from sonolith.operators import catalog

    scores = F.create_map(F.lit("jazz"), F.lit(0.5))
    rows = spark.createDataFrame([(1, True, True), (2, False, True), (3, True, False)], "segment_id long, music boolean, stem boolean")
    slices = rows.select("segment_id", F.lit(7).alias("file_id"), F.lit(1.5).alias("duration_seconds"), F.lit(8000).alias("sample_rate"), F.struct(F.lit(1.0).alias("crest")).alias("dsp"), F.array(F.lit(0.1)).alias("embedding"), F.lit(None).cast("array<double>").alias("dclap_embedding"), F.struct(F.col("music").alias("is_music")).alias("content_gate"), F.col("stem").alias("stem_parent"), scores.alias("genre"), scores.alias("stem_instrument"))
    got = {r["segment_id"]: json.loads(r["machine"]) for r in catalog.segment_machine(slices).collect()}
    assert {k: ("genre" in v, "stem_instrument" in v) for k, v in got.items()} == {1: (True, True), 2: (False, False), 3: (True, False)}
    even, rough = [0.5 * i for i in range(20)], [0.5 * i + (0.3 if i % 2 else 0.0) for i in range(20)]
    files = spark.createDataFrame([(1, rough, [0.0], even, [0.5], 130.0), (2, even, [0.0], rough, [0.5], None), (3, None, None, None, None, None)], "id long, dbn_beats array<double>, dbn_downbeats array<double>, minimal_beats array<double>, minimal_downbeats array<double>, second_bpm double")
    out = {r["id"]: r for r in rhythm.rhythm_stage(files).collect()}
    assert (out[1]["grid_source"], out[1]["stability"], out[1]["downbeats"], round(out[1]["bpm_ratio"], 6)) == ("minimal", 1.0, [0.5], round(130 / 120, 6))
    assert (out[2]["grid_source"], out[2]["stability_minimal"], round(out[2]["fitted_bpm"], 6), out[2]["bpm_ratio"], out[2]["ok"]) == ("dbn", -1.0, 120.0, None, True)
    assert out[3]["ok"] is False and out[3]["bpm"] == 0.0


def test_voices_fade_and_stop_with_their_source(spark):
    voices = spark.createDataFrame([(1, 9, 0, 10, 6, 1.0, 1.0, False, False, 2, 0), (2, 9, 1, 12, 99, 0.5, 1.0, False, False, 0, 2), (3, 9, 2, 0, 4, 1.0, 1.0, True, False, 0, 0)], "id int, source int, lane int, start int, length int, gain double, lane_gain double, muted boolean, solo boolean, fade_in int, fade_out int")
    samples = spark.createDataFrame([(9, i, 1.0) for i in range(4)], "source int, i int, value double")
    got = {r["at"]: round(r["value"], 6) for r in library.mix_voices(voices, samples, "linear").collect()}
    assert got == {10: 0.0, 11: 0.5, 12: 1.5, 13: 1.5, 14: 0.5, 15: 0.5}
    assert library.mix_voices(voices.withColumn("solo", F.col("id") == 2), samples).agg(F.sum("value")).first()[0] == 2.0


def test_model_inputs_are_dealt_out(spark, monkeypatch):
    """A small table of suppliers becomes sound in more than one task, a few recordings are handed over at a time, and silence costs no transform."""
    from sonolith.plans import more_queries

    parts = more_queries._triads(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    rng = np.random.default_rng(4)
    sounds = [rng.normal(size=4000) * 0.1 for _ in range(20)] + [None]
    rows = spark.createDataFrame([(i, None if m is None else m.tolist(), 4000) for i, m in enumerate(sounds)], "id int, m array<double>, r int").coalesce(1)
    got = rows.select("id", frontends.all_model_inputs({"a": "dclap", "b": "stem_instrument"})("m", "r").alias("x")).select("id", "x.*")
    want = rows.select("id", frontends.model_inputs("dclap")("m", "r").alias("a"), frontends.model_inputs("stem_instrument")("m", "r").alias("b"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    handed = list(frontends._few(iter([(pd.Series(sounds), pd.Series([4000] * 21))])))
    assert sum(map(len, handed)) == 21 and max(map(len, handed)) < 10
    seen = []
    whole = frontends.powers
    monkeypatch.setattr(frontends, "powers", lambda cut: seen.append(len(cut)) or whole(cut))
    segment = frontends.dclap_segments(sounds[0], 4000)
    assert segment.shape == (1, 128, 1001) and 100 <= sum(seen) < 110 and (segment[0, :, 200:] == -100).all()


def test_audible_ends_hear_zero(spark, tmp_path):
    """A value of 0 is 250 off 250, so the sample is heard; users without a number count as one."""
    from sonolith.plans import more_queries

    rows = [(1, 7, 480.0), (2, 7, 0.0), (3, 7, 250.0), (4, 8, 250.0), (5, None, 0.0), (6, None, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {tuple(r) for r in more_queries.audible_ends(spark, str(tmp_path)).collect()} == {(7, 2, 480.0), (8, None, 250.0), (None, 5, 0.0)}
