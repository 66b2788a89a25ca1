"""Aggregations: library statistics, facets, vocabularies, pooling and circular statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.functions.arrays import let
from sonolith.operators.predicates import is_full_mix, parent_dir

#: Instrument labels by the way their sound is made; others count for neither.
ELECTRONIC = ["synthesizer", "drummachine", "sampler", "computer", "pad", "electricpiano", "rhodes", "keyboard"]
ACOUSTIC = [
    "accordion", "acousticbassguitar", "acousticguitar", "bell", "bongo", "brass", "cello", "clarinet", "classicalguitar", "doublebass",
    "drums", "flute", "harmonica", "harp", "horn", "oboe", "orchestra", "percussion", "piano", "pipeorgan", "saxophone",
    "strings", "trombone", "trumpet", "viola", "violin", "voice",
]


def counts(files: DataFrame) -> DataFrame:
    """Number of files and of analysed ones."""
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.count("analyzed_at").alias("n_analyzed"))


def by_type(files: DataFrame) -> DataFrame:
    return files.groupBy("content_type").agg(F.count(F.lit(1)).alias("n")).orderBy("content_type")


def coverage(files: DataFrame, columns: list[str]) -> DataFrame:
    """Per promoted column the number and percentage of files that have it, in one pass over the table."""
    one = files.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns]))
    return one.select("_n", rows.alias("r")).select("r.field", "r.n", F.when(F.col("_n") > 0, F.round(100.0 * F.col("r.n") / F.col("_n"), 4)).alias("percent"))


def collection_counts(collections: DataFrame, members: DataFrame) -> DataFrame:
    """collections(collection_id, name) with the number of files of each, 0 for an empty one."""
    n = members.groupBy("collection_id").agg(F.count("file_id").alias("n_files"))
    return collections.join(n, "collection_id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))


def sibling_key(duration: Column) -> Column:
    """Length rounded to 50 ms, halves up, as a number of twentieths."""
    return F.floor(duration * 20 + 0.5).cast("long")


def sibling_groups(files: DataFrame) -> DataFrame:
    """files(id, path, duration_seconds, group_id) -> id, group_key, n, group_id: files of one folder and one length, two or more (a full mix counts, too); the
    smallest group id that one of them has goes to all, else the key does."""
    keyed = files.where("duration_seconds is not null").withColumn("dir", parent_dir(F.col("path"))).withColumn("length", sibling_key(F.col("duration_seconds")))
    found = keyed.groupBy("dir", "length").agg(F.count(F.lit(1)).alias("n"), F.min("group_id").alias("known")).where("n >= 2")
    key = F.concat(F.col("dir"), F.lit("|"), (F.col("length") / 20).cast("string"))
    return keyed.join(found, ["dir", "length"]).select("id", "dir", "length", "n", F.coalesce("known", key).alias("group_id"), is_full_mix(F.col("path")).alias("is_mix"))


def scope_summary(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("duration_seconds").alias("seconds"), F.count_if(F.col("duration_seconds").isNull()).alias("n_unknown"))


def natural_key(text: Column) -> Column:
    """Sort key under which "cue 2" precedes "cue 10": every number is padded to twelve digits."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 12, "0")).otherwise(p)), "")


def facet_values(*values: DataFrame) -> DataFrame:
    """Distinct values of some tables(value) without regard to case, in natural order; the smallest spelling stands for each."""
    rows = reduce(DataFrame.unionByName, [v.select("value") for v in values]).where("value is not null and trim(value) != ''")
    return rows.groupBy(F.lower("value").alias("folded")).agg(F.min("value").alias("value")).select("value", natural_key(F.col("value")).alias("sort_key")).orderBy("sort_key", "value")


def vocabulary(tags: DataFrame, list_fields: list[str], by_trigger: bool = False) -> DataFrame:
    """tags(trigger, field, value) -> field, value, n: list fields are split at commas first."""
    items = F.when(F.col("field").isin(list_fields), F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array("value"))
    keys = ["trigger", "field", "value"] if by_trigger else ["field", "value"]
    return tags.withColumn("value", F.explode(items)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def weighted_choice(values: DataFrame, keys: list[str], point: Column) -> DataFrame:
    """values(keys, value, n): the value at a point (0 to 1) of the cumulative frequencies, most frequent first."""
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), "value")
    running = values.withColumn("_upto", F.sum("n").over(by)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    first = running.where(F.col("_upto") > point * F.col("_all")).groupBy(*keys).agg(F.min(F.struct("_upto", "value")).alias("_pick"))
    return first.select(*keys, F.col("_pick.value").alias("value"))


def mean_pool(vectors: DataFrame, keys: list[str], vector: str = "v", normalise: bool = False) -> DataFrame:
    """Mean of a key's vectors, by position; normalised to length 1 (plus 1e-9) if asked for."""
    means = vectors.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pooled = means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(vector))
    if normalise:
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)) + 1e-9
        pooled = pooled.withColumn(vector, F.transform(vector, lambda x: x / norm))
    return pooled


def max_pool_top(scores: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """scores(keys, chunk, class, score): each class's best chunk, and the k best classes of a key."""
    best = scores.groupBy(*keys, "class").agg(F.max("score").alias("score"))
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "class")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"))


def peak_levels(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Crest factor (peak over mean magnitude) and peak in dB; null for silence."""
    size = F.abs(value)
    return samples.groupBy(*keys).agg(F.max(size).alias("peak"), F.avg(size).alias("_mean")).select(
        *keys, "peak", F.when(F.col("_mean") > 0, F.col("peak") / F.col("_mean")).alias("crest_factor"), F.when(F.col("peak") > 0, 20 * F.log10("peak")).alias("peak_db")
    )


def phase_bin(phase: Column, bins: int = 16) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(phase * bins).cast("int")))


def phase_strength(phases: DataFrame, keys: list[str], bins: int = 16) -> DataFrame:
    """phases(keys, phase): highest bin of the phase histogram over a uniform one."""
    per = phases.groupBy(*keys, phase_bin(F.col("phase"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg((F.max("n") * bins / F.sum("n")).alias("strength"), F.sum("n").alias("n"))


def resultant(phases: DataFrame, keys: list[str]) -> DataFrame:
    """Length (0 to 1) and mean phase (0 to 1) of the circular mean."""
    turn = 2 * math.pi * F.col("phase")
    sums = phases.groupBy(*keys).agg(F.sum(F.cos(turn)).alias("_c"), F.sum(F.sin(turn)).alias("_s"), F.count(F.lit(1)).alias("n"))
    angle = F.atan2("_s", "_c") / (2 * math.pi)
    return sums.select(*keys, "n", (F.hypot("_c", "_s") / F.col("n")).alias("resultant"), F.when(angle < 0, angle + 1).otherwise(angle).alias("mean_phase"))


def anova_f(accents: DataFrame, keys: list[str], period: int) -> DataFrame:
    """accents(keys, i, accent): F of the accents by position modulo a period; null with too few beats or no variance inside positions."""
    per = accents.groupBy(*keys, (F.col("i") % period).alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.sum("accent").alias("s"), F.sum(F.col("accent") ** 2).alias("q"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") ** 2 / F.col("n")).alias("b"))
    between, within = F.col("b") - F.col("s") ** 2 / F.col("n"), F.col("q") - F.col("b")
    return out.select(*keys, F.when((F.col("n") > period) & (within > 1e-12), (between / (period - 1)) / (within / (F.col("n") - period))).alias("f"))


def electronic_share(scores: Column, least_mass: float = 0.05) -> Column:
    """Electronic over electronic plus acoustic mass of an instrument map; null if there is almost none."""
    mass = lambda labels: F.aggregate(F.map_values(F.map_filter(scores, lambda k, _: k.isin(labels))), F.lit(0.0), lambda s, x: s + x)
    a, b = mass(ELECTRONIC), mass(ACOUSTIC)
    return F.when(a + b > least_mass, a / (a + b))


def median_mid(values: Column) -> Column:
    """Median of an array, the mean of the middle two for an even number."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    middle = lambda s: F.when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)
    return F.when(n > 0, let(F.array_sort(values), middle))


def median_upper(values: Column) -> Column:
    """Median of an array, the upper of the middle two."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def tag_coverage(files: DataFrame, tagged: Column) -> DataFrame:
    """Tagged and all files, and whether only some are tagged."""
    one = files.agg(F.count_if(tagged).alias("tagged"), F.count(F.lit(1)).alias("total"))
    return one.withColumn("partial", (F.col("tagged") > 0) & (F.col("tagged") < F.col("total")))


def mixed_value(rows: DataFrame, column: str) -> DataFrame:
    """The value that all rows share, else null, and the number of different ones (null counts as one)."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("\0"))
    return rows.agg(F.when(F.countDistinct(value) == 1, F.min(column)).alias("value"), F.countDistinct(value).alias("n_different"))


def common_parent(rows: DataFrame, path: str = "path") -> DataFrame:
    """Longest common folder of all paths: that of the smallest and the largest path."""
    ends = rows.agg(F.min(parent_dir(F.col(path))).alias("a"), F.max(parent_dir(F.col(path))).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: z["x"].eqNullSafe(z["y"]))
    first = F.array_position(same, F.lit(False))
    n = F.when(first > 0, first - 1).otherwise(F.size(same))
    return ends.select(F.array_join(F.slice(a, F.lit(1), n.cast("int")), "/").alias("parent"))
