"""Lists, trees and bookkeeping of a library: folders, collections, takes, thumbnails, arrangement blocks and clip export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.functions.scalars import delivery_name, fade_gain, round_half_away, version_from_name
from sonolith.operators.dml import numbered_rows
from sonolith.operators.intervals import range_join
from sonolith.operators.predicates import basename, parent_dir
from sonolith.sources.scratch import materialize

FLOOR = 0.001


def sidebar(groups: DataFrame, roots: DataFrame, collections: DataFrame) -> DataFrame:
    """kind, id, name, position: groups with their roots, then roots of no group, then collections, each by added_at."""
    tops = groups.select(F.lit(0).alias("k"), "added_at", F.col("group_id").alias("id"), "name").unionByName(roots.where("group_id is null").select(F.lit(1).alias("k"), "added_at", F.col("root_id").alias("id"), "name")).unionByName(collections.select(F.lit(2).alias("k"), "added_at", F.col("collection_id").alias("id"), "name"))
    kinds = F.element_at(F.array(F.lit("group"), F.lit("root"), F.lit("collection")), F.col("k") + 1)
    members = roots.where("group_id is not null").groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("added_at", "root_id"))), lambda x: x["root_id"]).alias("roots"))
    listed = numbered_rows(tops, F.struct("k", F.floor(F.col("added_at") / 3600).alias("hour")), "position", "k", "added_at", "id").withColumn("kind", kinds)
    return listed.join(members, (F.col("kind") == "group") & (F.col("id") == F.col("group_id")), "left").select("position", "kind", "id", "name", "roots")


def folders_with_audio(files: DataFrame, depth: int = 6) -> DataFrame:
    """Folders that hold a file at most `depth` levels below."""
    parts = F.split(parent_dir(F.col("path")), "/")
    above = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - depth), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n_files"))


def ewma(samples: DataFrame, keys: list[str], order: str, value: str, weight: float = 0.3) -> DataFrame:
    """k = 0.7 k + 0.3 x in order, the first value taken as it is. A key's samples are one short series."""
    rows = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_s"))
    start = F.col("_s")[0][value].cast("double")
    return rows.select(*keys, F.aggregate(F.slice("_s", 2, F.size("_s")), start, lambda k, x: k * (1 - weight) + x[value] * weight).alias("ewma"))


def take_counts(takes: DataFrame) -> DataFrame:
    """takes(block_id, created_at, state): pending ones but for the newest undecided, kept and discarded ones."""
    newest = F.max(F.when(F.col("state") == "pending", F.col("created_at"))).over(Window.partitionBy("block_id"))
    is_now = (F.col("state") == "pending") & (F.col("created_at") == newest)
    marked = takes.withColumn("_now", is_now)
    return marked.groupBy("block_id").agg(F.count_if((F.col("state") == "pending") & ~F.col("_now")).alias("pending"), F.count_if(F.col("state") == "kept").alias("kept"), F.count_if(F.col("state") == "discarded").alias("discarded"))


def stem_density(spans: DataFrame, bin_seconds: float) -> DataFrame:
    """spans(group_id, stem, is_mix, start, end) -> stems that play in each time bin (half-open), the mix not counted. Bins come from the spans themselves, so there is no range join."""
    first = F.floor(F.col("start") / bin_seconds)
    last = F.ceil(F.col("end") / bin_seconds) - 1
    parts = spans.where("not is_mix and end > start").select("group_id", "stem", F.explode(F.sequence(first, F.greatest(first, last))).alias("bin"))
    return parts.groupBy("group_id", "bin").agg(F.countDistinct("stem").alias("n_stems"))


def thumbnail(samples: DataFrame, keys: list[str], per_point: int = 512) -> DataFrame:
    """Least and greatest sample of each run of `per_point`."""
    return samples.groupBy(*keys, F.floor(F.col("i") / per_point).alias("point")).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def bounded_log(lines: DataFrame, keys: list[str], most: int = 4000) -> DataFrame:
    """The last `most` lines of each log."""
    by = Window.partitionBy(*keys).orderBy(F.desc("seq"))
    return lines.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def datasets(entries: DataFrame) -> DataFrame:
    """entries(folder, name, trigger) -> folder, its first trigger that isn't empty, and its number of .npy files."""
    first = F.min(F.when(F.col("trigger") != "", F.struct("name", "trigger")))
    return entries.groupBy("folder").agg(first.alias("_t"), F.count_if(F.col("name").endswith(".npy")).alias("n_latents")).select("folder", F.col("_t.trigger").alias("trigger"), "n_latents")


def checkpoints(entries: DataFrame) -> DataFrame:
    """Runs by name, their steps from the last."""
    return entries.orderBy(F.asc("run"), F.desc("step"))


def first_segments(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Each file with the bounds of its first segment, its edit; null without one."""
    first = segments.groupBy("file_id").agg(F.min(F.struct("start", "end", "id")).alias("_s"))
    return files.join(first, F.col("id") == F.col("file_id"), "left").select("id", "path", F.col("_s.start").alias("edit_start"), F.col("_s.end").alias("edit_end"))


#: Folders of a project that are no cue.
NO_CUES = ["takes", "discarded", "export"]


def cue_export(takes: DataFrame, files: DataFrame, segments: DataFrame, project: Column) -> DataFrame:
    """takes(cue, path, path_nfc), files(id, path_nfc, bpm, key) as captions give them, segments(id, file_id, start, end, human) -> cue, path, folder, name and the edit
    (start, end, fade_in, fade_out, gain_db) of each WAV to render. A file's first segment is its edit; without one, or without a catalog row, all of it is
    taken as it is. Takes that share a name in a folder keep it, so the later one replaces the other."""
    number = lambda k: F.coalesce(F.get_json_object("human", f"$.{k}").try_cast("double"), F.lit(0.0)).alias(k)
    edit = F.struct("start", "end", "id", number("fade_in"), number("fade_out"), number("gain_db"))
    first = segments.where("file_id is not null").groupBy(F.col("file_id").alias("_of")).agg(F.min_by(edit, F.struct("start", "end", "id")).alias("_e"))
    known = files.select(F.col("id").alias("_id"), F.col("path_nfc").alias("_path"), F.col("bpm").alias("_bpm"), F.col("key").alias("_key"))
    wavs = takes.where(~F.col("cue").isin(NO_CUES) & F.lower("path").endswith(".wav")).select("cue", "path", "path_nfc")
    both = wavs.join(known, F.col("path_nfc") == F.col("_path"), "left").join(first, F.col("_id") == F.col("_of"), "left")
    name = delivery_name(project, F.col("cue"), F.col("_bpm"), F.col("_key"), version_from_name(basename(F.col("path"))))
    part = lambda k: F.coalesce(F.col(f"_e.{k}"), F.lit(0.0)).alias(k)
    return both.select("cue", "path", F.concat(F.lit("export/"), "cue").alias("folder"), name.alias("name"), *[part(k) for k in ("start", "end", "fade_in", "fade_out", "gain_db")])


def export_summary(results: DataFrame) -> DataFrame:
    """results(cue, path, ok, message) -> n_files, n_cues, n_failed, message: what a project's export says, with its first problem in order of cue and file."""
    order = F.struct(F.lower("cue"), "cue", "path")
    problem = F.concat(basename(F.col("path")), F.lit(": "), F.coalesce("message", F.lit("")))
    done = results.agg(
        F.count_if("ok").alias("n_files"),
        F.count_distinct(F.when(F.col("ok"), F.col("cue"))).alias("n_cues"),
        F.count_if(~F.col("ok")).alias("n_failed"),
        F.min_by(F.when(~F.col("ok"), problem), F.when(~F.col("ok"), order)).alias("_first"),
    )
    many = lambda n, word: F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, f" {word}").otherwise(f" {word}s"))
    failed = F.when(F.col("n_failed") > 0, F.concat(F.lit("  --  "), F.col("n_failed").cast("string"), F.lit(" failed: "), "_first")).otherwise("")
    return done.select("n_files", "n_cues", "n_failed", F.concat(many("n_files", "file"), F.lit(" exported across "), many("n_cues", "cue"), failed).alias("message"))


def next_version(takes: DataFrame, cue: str) -> DataFrame:
    """Version and status of a cue's next take: 1 is chosen, others are alternatives."""
    top = takes.where(F.col("cue") == cue).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return top.withColumn("status", F.when(F.col("version") == 1, "chosen").otherwise("alt"))


def unused_takes(files: DataFrame, used: DataFrame) -> DataFrame:
    """files(path, size_bytes) that no block refers to by path_nfc."""
    return files.join(used.select(F.col("path_nfc")).distinct(), "path_nfc", "left_anti")


def takes_of(takes: DataFrame, block_id: int) -> DataFrame:
    return takes.where(F.col("block_id") == block_id).orderBy(F.desc("mtime"), "path")


def click_track(beats: DataFrame, rate: int, per_bar: int = 4) -> DataFrame:
    """beats(id, i, t) -> samples and accents on the first beat of each bar."""
    return beats.select("id", "i", round_half_away(F.col("t") * rate).alias("sample"), (F.col("i") % per_bar == 0).alias("accent"))


def effective(human: Column, machine: Column) -> Column:
    return F.coalesce(human, machine)


def classify_keywords(tags: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """tags(folder, keywords) -> one list for each vocabulary, and the words of none; repeated words once."""
    words = F.array_distinct("keywords")
    out = [F.array_intersect(words, F.array(*[F.lit(v) for v in vs])).alias(f) for f, vs in vocabulary.items()]
    known = F.array(*[F.lit(v) for vs in vocabulary.values() for v in vs])
    return tags.select("folder", *out, F.array_except(words, known).alias("extra"))


def row_list(files: DataFrame, segments: DataFrame) -> DataFrame:
    """File rows, each followed by its segments in order of start."""
    a = files.select(F.col("id").alias("file_id"), F.lit(0).alias("seq"), F.lit(None).cast("long").alias("segment_id"), F.col("path").alias("label"))
    order = F.row_number().over(Window.partitionBy("file_id").orderBy("start", "id"))
    b = segments.select("file_id", order.alias("seq"), F.col("id").alias("segment_id"), F.concat_ws("-", F.format_number("start", 1), F.format_number("end", 1)).alias("label"))
    return a.unionByName(b.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi"))


# arrangement ----------------------------------------------------------------------------------------------------------


def mixdown(samples: DataFrame) -> DataFrame:
    """samples(block_id, lane, lane_gain, gain, muted, solo, at, value): sum of sounding voices at each time; a soloed lane silences the others."""
    any_solo = samples.agg(F.coalesce(F.max("solo"), F.lit(False)).alias("_any"))
    heard = samples.join(F.broadcast(any_solo)).where("not muted and (solo or not _any)")
    return heard.groupBy("at").agg(F.sum(F.col("value") * F.col("gain") * F.col("lane_gain")).alias("value"))


def mix_voices(voices: DataFrame, samples: DataFrame, shape: str = "equal_power", master: float = 1.0) -> DataFrame:
    """voices(id, lane, start, length, gain, lane_gain, muted, solo, fade_in, fade_out; times in samples), samples(source, i, value) by voices.source -> at,
    value: the sum of what sounds at each time. A voice sounds for its length, or until its source ends; it fades over its first and last samples;
    a soloed lane silences the others."""
    any_solo = voices.agg(F.coalesce(F.max("solo"), F.lit(False)).alias("any")).first()["any"]
    heard = voices.where(~F.col("muted") & (F.col("solo") | F.lit(not any_solo)))
    both = heard.join(samples, "source").where(F.col("i").between(0, F.col("length") - 1))
    rising = F.when(F.col("i") < F.col("fade_in"), fade_gain(F.col("i") / F.col("fade_in"), shape)).otherwise(1.0)
    left = F.col("length") - F.col("i")
    falling = F.when(left <= F.col("fade_out"), fade_gain(left / F.col("fade_out"), shape)).otherwise(1.0)
    part = F.col("value") * F.col("gain") * F.col("lane_gain") * rising * falling
    return both.select((F.col("start") + F.col("i")).alias("at"), part.alias("part")).groupBy("at").agg((F.sum("part") * master).alias("value"))


def by_file_name(files: DataFrame) -> DataFrame:
    """Files in order of their names without regard to case, then of their paths."""
    return files.orderBy(F.lower(basename(F.col("path"))), "path")


def dataset(files: DataFrame, folder: str, defaults: DataFrame | None = None, trigger: str = "") -> DataFrame:
    """What a training set of a folder's analysed files holds: id, folder, name, prose and sidecar, for documents.write_sidecars()."""
    from sonolith.operators.captions import captions
    from sonolith.operators.predicates import stem_name, under_folder

    chosen = files.where(under_folder(F.col("path"), F.lit(folder)) & F.col("analyzed_at").isNotNull())
    told = captions(chosen, defaults, trigger)
    return told.join(chosen.select("id", parent_dir(F.col("path")).alias("folder"), stem_name(F.col("path")).alias("name")), "id").select("id", "folder", "name", "prose", "sidecar")


def dataset_coverage(files: DataFrame, prepared: DataFrame, folder: str) -> DataFrame:
    """Of a folder's files: all, analysed ones, those with a sidecar, and whether the set is complete."""
    from sonolith.operators.predicates import under_folder

    inside = files.where(under_folder(F.col("path"), F.lit(folder))).join(prepared.select(F.col("id").alias("_told")), F.col("id") == F.col("_told"), "left")
    one = inside.agg(F.count(F.lit(1)).alias("n_files"), F.count("analyzed_at").alias("n_analyzed"), F.count("_told").alias("n_told"))
    return one.withColumn("complete", F.col("n_told") == F.col("n_files"))


def voices_in_window(blocks: DataFrame, windows: DataFrame) -> DataFrame:
    """blocks(arrangement, id, start, end) that sound in windows(arrangement, w, start, end), with the overlap."""
    hit = range_join(windows, blocks, ["arrangement"], 30.0)
    return hit.select("arrangement", "w", F.col("r_id").alias("id"), (F.least("end", "r_end") - F.greatest("start", "r_start")).alias("overlap"))


def loop_position(t: Column, start: Column, end: Column) -> Column:
    """Source time of a looped region: before its end as is, then modulo its length."""
    return F.when((end > start) & (t >= end), start + F.pmod(t - start, end - start)).otherwise(t)


def stale_children(blocks: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Blocks whose stored parent start is no longer the parent's start."""
    parents = blocks.select(F.col("id").alias("follows"), F.col("start").alias("now"))
    return blocks.join(parents, "follows").where(F.abs(F.col("parent_start") - F.col("now")) > tolerance).select("id", "follows", (F.col("now") - F.col("parent_start")).alias("drift"))


def chain_depths(blocks: DataFrame, guard: int = 256) -> DataFrame:
    """id, root, depth in the forest of blocks that follow each other; blocks on a cycle, below a missing one or deeper than the guard come with a null root.
    Pointers double: after n joins every block knows its ancestor 2^n steps up, and each round is a written table."""
    first = blocks.select("id", F.coalesce("follows", "id").alias("at"), F.when(F.col("follows").isNull(), 0).otherwise(1).alias("depth"), F.col("follows").isNotNull().alias("open"))
    state = materialize(first, "chains")
    for _ in range(max(1, guard).bit_length() + 1):
        if state.where("open").isEmpty():
            break
        up = state.select(F.col("id").alias("_at"), F.col("at").alias("_up"), F.col("depth").alias("_more"), F.col("open").alias("_open"))
        both = state.join(up, F.col("open") & (F.col("at") == F.col("_at")), "left")
        lost = F.col("open") & F.col("_at").isNull()
        state = both.select(
            "id",
            F.when(F.col("open"), F.col("_up")).otherwise(F.col("at")).alias("at"),
            F.when(F.col("open") & ~lost, F.least(F.col("depth") + F.col("_more"), F.lit(4 * guard + 4))).otherwise(F.col("depth")).alias("depth"),
            F.coalesce(F.col("_open") & F.col("open"), F.lit(False)).alias("open"),
        )
        state = materialize(state, "chains")
    found = ~F.col("open") & F.col("at").isNotNull() & (F.col("depth") <= guard)
    return state.select("id", F.when(found, F.col("at")).alias("root"), F.when(found, F.col("depth")).alias("depth"))


def would_cycle(chains: DataFrame, child: int, parent: int) -> bool:
    """True if making `child` follow `parent` closes a ring: the parent is the child or follows it. chains(id, follows); one lookup by id a step, up to the guard of 256."""
    at, seen = parent, set()
    links = chains.where("follows is not null").select("id", "follows")
    while at is not None and at not in seen and len(seen) <= 256:
        if at == child:
            return True
        seen.add(at)
        found = links.where(F.col("id") == at).first()
        at = found["follows"] if found else None
    return False


def shift_tempo(bpm: Column, octaves: Column) -> Column:
    """A tempo moved by at most two octaves; null outside 20 to 400."""
    moved = bpm * F.pow(F.lit(2.0), F.least(F.lit(2), F.greatest(F.lit(-2), octaves)))
    return F.when(moved.between(20, 400), moved)


def stretch_ratio(source_bpm: Column, target_bpm: Column) -> Column:
    return F.when((source_bpm > 0) & (target_bpm > 0), source_bpm / target_bpm)


def clip_plan(files: DataFrame, segments: DataFrame, rate: int) -> DataFrame:
    """Every clip that an export writes: each segment on its file, or on each file of its group; samples clamped to the file, the folder it goes to,
    and why it is skipped (or null). files(id, path, group_id, n_samples, analyzed_at, active_fraction)."""
    own = segments.where("file_id is not null").join(files.withColumnRenamed("id", "_id"), F.col("file_id") == F.col("_id")).drop("_id", "group_id")
    of_group = segments.where("file_id is null").drop("file_id").join(files.withColumnRenamed("id", "file_id"), "group_id").drop("group_id")
    every = own.unionByName(of_group.select(*own.columns))
    clamp = lambda c: F.greatest(F.lit(0).cast("long"), F.least(F.col("n_samples"), F.floor(F.col(c) * rate)))
    out = every.withColumn("first", clamp("start")).withColumn("last", clamp("end"))
    skip = F.when(F.col("n_samples").isNull(), "file can't be decoded").when(F.col("end") <= F.col("start"), "segment is empty").when(F.col("last") <= F.col("first"), "segment is outside the file").when(F.col("analyzed_at").isNull(), "file isn't analysed")
    name = F.concat(F.lit("seg"), F.col("id").cast("string"), F.lit("_"), F.floor("start").cast("string"), F.lit("-"), F.floor("end").cast("string"), F.lit("s"))
    return out.select("id", "file_id", "path", "first", "last", name.alias("folder"), skip.alias("skipped"), (F.col("active_fraction") < 0.10).alias("low_activity"))


def audible_end(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Number of the last sample above the floor; null for silence."""
    return samples.groupBy(*keys).agg(F.max(F.when(F.abs("value") > FLOOR, F.col("i"))).alias("last"))


def lane_peaks(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.max(F.abs("value")).alias("peak"))
