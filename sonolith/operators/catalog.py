"""Catalog joins and reports: collections, groups, segments with their analyses, earlier siblings, and one file's report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.operators.aggregates import sibling_key
from sonolith.operators.intervals import active_to_file
from sonolith.operators.predicates import parent_dir


def collection_files(members: DataFrame, files: DataFrame, collection_id: int) -> DataFrame:
    """Files of a collection in the order they were added."""
    return members.where(F.col("collection_id") == collection_id).join(files, F.col("file_id") == F.col("id")).orderBy("added_at", "id")


def group_files(files: DataFrame, group_id: str) -> DataFrame:
    return files.where(F.col("group_id") == group_id).orderBy("path")


def segment_documents(segments: DataFrame, analyses: DataFrame, files: DataFrame) -> DataFrame:
    """segments(id, file_id), analyses(segment_id, file_id, machine), files(id, machine): each segment with its own document, or the file's, and which."""
    own = analyses.select("segment_id", F.col("file_id").alias("_f"), F.col("machine").alias("own"))
    both = segments.join(own, (F.col("id") == F.col("segment_id")) & (F.col("file_id") == F.col("_f")), "left").drop("segment_id", "_f")
    whole = files.select(F.col("id").alias("_id"), F.col("machine").alias("whole"))
    out = both.join(whole, F.col("file_id") == F.col("_id"), "left").drop("_id")
    return out.withColumn("machine", F.coalesce("own", "whole")).withColumn("from_segment", F.col("own").isNotNull()).drop("own", "whole")


def earlier_siblings(candidates: DataFrame, analysed: DataFrame) -> DataFrame:
    """candidates(path, duration_seconds) of a run and analysed(id, path, duration_seconds, group_id) before it: pairs of one folder and length, the
    candidate's own row left out."""
    keyed = lambda df: df.withColumn("dir", parent_dir(F.col("path"))).withColumn("length", sibling_key(F.col("duration_seconds")))
    run = keyed(candidates).select("dir", "length", F.col("path").alias("candidate"))
    before = keyed(analysed).select("dir", "length", F.col("id").alias("sibling_id"), F.col("path").alias("sibling"), "group_id")
    others = before.join(candidates.select(F.col("path").alias("sibling")), "sibling", "left_anti")
    return run.join(others, ["dir", "length"])


def joined_group(files: DataFrame) -> DataFrame:
    """files(id, dir, length, group_id) -> id, group_id: a set of two or more takes the smallest group id that it already has."""
    by = Window.partitionBy("dir", "length")
    key = F.concat_ws("|", "dir", (F.col("length") / 20).cast("string"))
    return files.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_g", F.min("group_id").over(by)).where("_n >= 2").select("id", F.coalesce("_g", key).alias("group_id"))


def warnings() -> Column:
    """What a report warns of, on columns active_ratio, bpm_ratio, tempo_unstable, tempo_window_count."""
    told = F.array(
        F.when(F.col("active_ratio") < 0.5, "mostly silence"),
        F.when(F.abs(F.col("bpm_ratio") - 1) > 0.05, "tempo estimates disagree"),
        F.when(F.coalesce("tempo_unstable", F.lit(False)) & (F.col("tempo_window_count") >= 3), "tempo is not stable"),
    )
    return F.array_compact(told)


def report(files: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each field that a file has, as text, and its warnings as rows of their own."""
    present = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    warned = F.transform(warnings(), lambda w: F.struct(F.lit("warning").alias("field"), w.alias("value")))
    rows = F.filter(F.concat(F.array(*present), warned), lambda x: x["value"].isNotNull())
    return files.select("id", F.explode(rows).alias("r")).select("id", "r.field", "r.value")


def measurement(files: DataFrame) -> DataFrame:
    """What an arrangement takes from a file: tempo from 20 to 400, a person's key before the measured one, times moved from spliced to file time in old
    documents (timebase other than "file"), and a note where something is missing. files(id, analyzed_at, timebase, active_spans, bpm, human_key, key, onsets, beats, downbeats)."""
    old = F.coalesce(F.col("timebase") != "file", F.lit(True))
    moved = lambda c: F.transform(c, lambda t: F.when(old, active_to_file(F.coalesce("active_spans", F.array().cast("array<struct<start:double,end:double>>")), t)).otherwise(t))
    bpm = F.when(F.col("bpm").between(20, 400), F.col("bpm"))
    note = F.when(F.col("analyzed_at").isNull(), "that take has not been analysed").when(bpm.isNull(), "analysed, but no usable tempo came out of it").otherwise("")
    out = files.select("id", bpm.alias("bpm"), F.coalesce("human_key", "key").alias("key"), moved("onsets").alias("onsets"), moved("beats").alias("beats"), moved("downbeats").alias("downbeats"), note.alias("note"))
    return out.withColumn("first_downbeat", F.get("downbeats", F.lit(0)))


def kept_take(files: DataFrame, take: DataFrame, recipe: str) -> DataFrame:
    """Registers takes(path, sha256, mtime, size_bytes, scanned_at) and writes the recipe into their `human` map as `generated`."""
    from sonolith.operators.dml import set_key, upsert_scanned

    out = upsert_scanned(files, take)
    empty = F.create_map().cast("map<string,string>")
    new = out.join(take.select(F.col("path").alias("_taken")), F.col("path") == F.col("_taken"), "left")
    human = F.when(F.col("_taken").isNotNull(), set_key(F.coalesce("human", empty), "generated", F.lit(recipe))).otherwise(F.col("human"))
    return new.withColumn("human", human).drop("_taken")


#: Parts of a segment's document that need music, in order; the stem model's also need a stem.
HEADS = ["moodtheme", "instrument", "instrument_normalized", "stem_instrument", "stem_instrument_normalized", "danceability_head", "genre", "genre_normalized", "voice_instrumental"]


def segment_machine(slices: DataFrame) -> DataFrame:
    """The stored document of each analysed segment. slices(segment_id, file_id, duration_seconds, sample_rate, dsp, embedding, dclap_embedding, content_gate (with
    is_music), stem_parent, and what the heads gave, each null if it failed) -> segment_id, file_id, machine (JSON without the null parts). Heads count only
    with an embedding and a gate that says music, the stem model's only for segments of stems. There is no rhythm and no key."""
    music = F.col("embedding").isNotNull() & F.coalesce(F.col("content_gate.is_music"), F.lit(False))
    part = lambda c: F.when(music & (F.coalesce("stem_parent", F.lit(False)) if c.startswith("stem_") else F.lit(True)), F.col(c)).alias(c)
    first = ["duration_seconds", "sample_rate", "dsp", "embedding", "dclap_embedding", "content_gate"]
    document = F.struct(*first, *[part(c) for c in HEADS if c in slices.columns])
    return slices.select("segment_id", "file_id", F.to_json(document).alias("machine"))
