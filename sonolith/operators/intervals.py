"""Interval algebra over long tables (key, start, end) and over arrays of spans, and joins on time.

Long-table operators partition by the key (a file or group, whose spans are bounded by its length) and never sort a whole
table in one task. Joins on ranges explode both sides into time buckets, join on (key, bucket) by hash, and refine; a pair
that shares several buckets is kept in the first one only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPANS = "array<struct<start: double, end: double>>"


def merge_spans(spans: DataFrame, keys: list[str], bridge: float, inclusive: bool = False) -> DataFrame:
    """Merges a key's spans whose gap is below the bridge (or equal to it, if inclusive); empty and reversed spans are dropped."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("start") - reach
    apart = gap > bridge if inclusive else gap >= bridge
    marked = spans.where("end > start").withColumn("_new", F.when(reach.isNull() | apart, 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def active_spans(frames: DataFrame, keys: list[str], hop: float, threshold_db: float = -60.0) -> DataFrame:
    """Spans of frames(keys, frame, rms) louder than the threshold: gaps and islands over frame numbers. The last span of a file whose last frame is
    active ends at `duration`."""
    by = Window.partitionBy(*keys)
    loud = frames.where(F.col("rms") > 10 ** (threshold_db / 20))
    island = loud.withColumn("_island", F.col("frame") - F.row_number().over(by.orderBy("frame")))
    last = frames.groupBy(*keys).agg(F.max("frame").alias("_last"), F.max("duration").alias("_duration"))
    spans = island.groupBy(*keys, "_island").agg(F.min("frame").alias("_a"), F.max("frame").alias("_b")).join(last, keys)
    return spans.select(*keys, (F.col("_a") * hop).alias("start"), F.when(F.col("_b") == F.col("_last"), F.col("_duration")).otherwise((F.col("_b") + 1) * hop).alias("end"))


def active_ratio(spans: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each duration that spans cover."""
    total = spans.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("active"))
    return durations.join(total, keys, "left").withColumn("active_ratio", F.when(F.col("duration") > 0, F.coalesce("active", F.lit(0.0)) / F.col("duration"))).drop("active")


def auto_segments(spans: DataFrame, durations: DataFrame, kept: DataFrame, gap: float = 1.5, least: float = 2.0, whole: float = 0.95) -> DataFrame:
    """New segments of spans(file_id, start, end): merged below the gap, at least `least` long, none if a single one covers the
    file, none that overlaps kept(file_id, start, end). `analyse` says that a file has two usable ones or more."""
    usable = merge_spans(spans, ["file_id"], gap).where(F.col("end") - F.col("start") >= least)
    counted = usable.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file_id"))).join(durations, "file_id")
    useful = counted.where(~((F.col("n") == 1) & (F.col("duration") > 0) & (F.col("end") - F.col("start") >= whole * F.col("duration"))))
    free = without_overlap(useful.select("file_id", "start", "end", "n"), kept, ["file_id"])
    return free.select("file_id", "start", "end", (F.col("n") >= 2).alias("analyse"))


def _bucketed(df: DataFrame, start: str, end: str, width: float) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return df.withColumn("_first", first).withColumn("_bucket", F.explode(F.sequence(first, F.greatest(first, last))))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], width: float = 60.0, how: str = "inner") -> DataFrame:
    """Pairs of left(keys, start, end, ...) and right(keys, start, end, ...) that overlap by more than a point. Columns of the
    right side come prefixed r_; how is inner, left_semi or left_anti."""
    if how != "inner":
        marked = left.withColumn("_row", F.monotonically_increasing_id())
        hit = range_join(marked, right, keys, width).select("_row").distinct()
        return marked.join(hit, "_row", how).drop("_row")
    a = _bucketed(left, "start", "end", width)
    b = _bucketed(right, "start", "end", width)
    b = b.select(*[F.col(c).alias(c if c in {*keys, "_bucket"} else f"r_{c}") for c in b.columns])
    both = a.join(b, [*keys, "_bucket"])
    return both.where((F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start")) & (F.col("_bucket") == F.greatest("_first", "r__first"))).drop("_bucket", "_first", "r__first")


def without_overlap(new: DataFrame, kept: DataFrame, keys: list[str], width: float = 60.0) -> DataFrame:
    """The new spans that overlap no kept one."""
    return range_join(new, kept, keys, width, "left_anti")


def point_in_span(points: DataFrame, spans: DataFrame, keys: list[str], point: str) -> DataFrame:
    """For each point the first span in start order that holds it (start included, end not): columns r_start and r_end, null without one.
    Spans of a key may overlap."""
    marked = points.withColumn("_row", F.monotonically_increasing_id())
    probe = marked.select("_row", *keys, F.col(point).alias("start"), F.col(point).alias("end"))
    a = _bucketed(probe, "start", "end", 60.0).drop("_first")
    b = _bucketed(spans.select(*keys, "start", "end"), "start", "end", 60.0).select(*keys, "_bucket", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    hit = a.join(b, [*keys, "_bucket"]).where("start >= r_start and start < r_end").groupBy("_row").agg(F.min(F.struct("r_start", "r_end")).alias("_hit"))
    return marked.join(hit, "_row", "left").select(*points.columns, F.col("_hit.r_start").alias("r_start"), F.col("_hit.r_end").alias("r_end"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], time: str, before: str, after: str, equal_is_before: bool = True) -> DataFrame:
    """For each left time the last right time at or before it and the first one after it, by one sort of both: no range join. With
    equal_is_before false, a right time that equals the left one counts as the one after."""
    rank = F.lit(0 if equal_is_before else 2)
    a = left.withColumn("_side", F.lit(1)).withColumn("_mark", F.lit(None).cast("double"))
    b = right.select(*keys, time).distinct()
    b = b.select(*keys, time, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in {*keys, time}], rank.alias("_side"), F.col(time).cast("double").alias("_mark"))
    by = Window.partitionBy(*keys).orderBy(time, "_side")
    back = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc("_side"))
    both = a.unionByName(b)
    both = both.withColumn(before, F.last("_mark", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    # running frames in both directions: one that ended ahead would be built anew for each row
    both = both.withColumn(after, F.last("_mark", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    return both.where("_side = 1").drop("_side", "_mark")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, out: str = "nearest") -> DataFrame:
    """For each left time the nearest right time of its key; the earlier one wins a tie."""
    both = asof(left, right, keys, time, "_before", "_after")
    pick = F.when(F.col("_after").isNull() | (F.col(time) - F.col("_before") <= F.col("_after") - F.col(time)), F.col("_before")).otherwise(F.col("_after"))
    return both.withColumn(out, pick).drop("_before", "_after")


def chord_intervals(chords: DataFrame, ends: DataFrame) -> DataFrame:
    """chords(file_id, t, chord) -> start, end: a chord lasts to the next change, the last one to ends(file_id, end)."""
    following = F.lead("t").over(Window.partitionBy("file_id").orderBy("t"))
    return chords.withColumn("_next", following).join(ends, "file_id", "left").select("file_id", F.col("t").alias("start"), F.coalesce("_next", "end").alias("end"), "chord")


def partition_bounds(cues: DataFrame, keys: list[str]) -> DataFrame:
    """Keeps cues a partition: each ends where the next one starts."""
    return cues.withColumn("end", F.coalesce(F.lead("start").over(Window.partitionBy(*keys).orderBy("start")), F.col("end")))


def crossfades(blocks: DataFrame) -> DataFrame:
    """blocks(lane, id, start, length): overlap of a block with the next one of its lane, which becomes an equal-power crossfade."""
    by = Window.partitionBy("lane").orderBy("start", "id")
    ahead = F.lead("start").over(by)
    overlap = F.col("start") + F.col("length") - ahead
    return blocks.withColumn("next_id", F.lead("id").over(by)).withColumn("crossfade", F.when(overlap > 0, F.least(overlap, F.col("length"), F.lead("length").over(by))).otherwise(F.lit(0.0)))


# spans held as an array in one row ------------------------------------------------------------------------------------


def total_active(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), x["end"] - x["start"]))


def active_fraction(spans: Column, start: Column, end: Column) -> Column:
    """Share of [start, end) that spans cover; null without spans or length."""
    covered = F.aggregate(spans, F.lit(0.0), lambda s, x: s + F.greatest(F.lit(0.0), F.least(x["end"], end) - F.greatest(x["start"], start)))
    return F.when((F.size(spans) > 0) & (end > start), covered / (end - start))


def clip_to_spans(spans: Column, start: Column, end: Column) -> Column:
    """Parts of [start, end) inside the spans; the whole interval without spans, nothing if it is empty."""
    whole = F.array(F.struct(start.alias("start"), end.alias("end")))
    parts = F.filter(F.transform(spans, lambda x: F.struct(F.greatest(start, x["start"]).alias("start"), F.least(end, x["end"]).alias("end"))), lambda x: x["end"] > x["start"])
    return F.when(end <= start, F.array().cast(SPANS)).when(F.size(spans) == 0, whole.cast(SPANS)).otherwise(parts)


def _spliced(spans: Column) -> Column:
    """Spans of positive length with `at`, the active time at which each begins."""
    fine = F.filter(spans, lambda x: x["end"] > x["start"])
    return F.transform(fine, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), total_active(F.slice(fine, 1, i)).alias("at")))


def active_to_file(spans: Column, active: Column) -> Column:
    """File time of an instant in spliced active time; past the end, the end of the last span."""
    inside = F.get(F.filter(_spliced(spans), lambda x: active < x["at"] + x["end"] - x["start"]), F.lit(0))
    return F.when(F.size(spans) == 0, active).otherwise(F.coalesce(inside["start"] + (active - inside["at"]), F.element_at(spans, -1)["end"]))


def active_interval_to_file(spans: Column, start: Column, end: Column) -> Column:
    """File intervals of an interval in spliced active time."""
    parts = F.transform(
        _spliced(spans),
        lambda x: F.struct((x["start"] + F.greatest(start, x["at"]) - x["at"]).alias("start"), (x["start"] + F.least(end, x["at"] + x["end"] - x["start"]) - x["at"]).alias("end")),
    )
    whole = F.array(F.struct(start.alias("start"), end.alias("end")))
    return F.when(end <= start, F.array().cast(SPANS)).when(F.size(spans) == 0, whole.cast(SPANS)).otherwise(F.filter(parts, lambda x: x["end"] > x["start"]))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
