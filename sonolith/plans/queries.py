"""Registered queries over the library views, each with the SQL that an oracle runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.functions import scalars as fn
from sonolith.operators import aggregates, captions, catalog, cues, dml, intervals, library, models, predicates, rhythm, topk
from sonolith.plans import views
from sonolith.plans.views import oracle, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *names: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql, *names)
        return f

    return add


def r6(c):  # noqa: ANN001, ANN201
    return F.round(c, 6)


# filters, routing, names ----------------------------------------------------------------------------------------------


@query(
    """select id, content_type from files f where bpm > 90 and duration_seconds <= 50 and loudness < -12 and content_type != 'one_shot'
    and exists (select 1 from scores s where s.file_id = f.id and lower(label) like '%techno%' and score > 0.2)""",
    "files", "scores",
)
def filter_search(spark: SparkSession, sf: str) -> DataFrame:
    return views.library(spark, sf).where(predicates.compile_filter("bpm>90,duration<=50,loudness<-12,content_type!=one_shot,genre:Techno")).select("id", "content_type")


@query("select content_type, count(*) as n from files where key = 'A minor' and harmonicity >= 0.5 group by 1", "files")
def filter_key_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.by_type(view(spark, sf, "files").where(predicates.compile_filter("key=A minor,harmonicity>=0.5")))


_HINT = "case " + " ".join(f"when contains(lower(regexp_extract(path, '[^/]*$')), '{p}') then '{v}'" for p, v in predicates.FILENAME_HINTS) + " end"
_MIX = f"(regexp_matches(lower(regexp_extract(path, '[^/]*$')), 'mix|master|bounce') and not contains(lower(regexp_extract(path, '[^/]*$')), 'fx') and {_HINT} is null)"


@query(
    f"""select id, {_HINT} as hint, {_MIX} as full_mix, case when duration_seconds <= 3 then 'one_shot' when duration_seconds <= 30 then 'loop' else 'track' end as routed,
    case when {_MIX} then 'track' when id % 10 = 0 or contains(lower(path), 'stem') then 'stem' when duration_seconds <= 3 then 'one_shot' when duration_seconds <= 30 then 'loop' else 'track' end as final from files""",
    "files",
)
def file_routing(spark: SparkSession, sf: str) -> DataFrame:
    path, seconds = F.col("path"), F.col("duration_seconds")
    return view(spark, sf, "files").select(
        "id", predicates.instrument_hint(path).alias("hint"), predicates.is_full_mix(path).alias("full_mix"), predicates.routed_type(seconds).alias("routed"), predicates.final_type(path, seconds, F.col("id") % 10 == 0, F.lit(False)).alias("final")
    )


@query(
    """select id, case when path like '%120bpm%' then 120 end as bpm, path like '%120bpm%' as certain,
    case when path like '%\\_Am\\_%' escape '\\' then 'A min' when path like '%F#maj%' then 'F# maj' end as key from files""",
    "files",
)
def filename_tempo_key(spark: SparkSession, sf: str) -> DataFrame:
    found = view(spark, sf, "files").withColumn("t", predicates.filename_bpm(F.col("path")))
    return found.select("id", F.when(F.col("t.certain"), F.col("t.bpm")).alias("bpm"), "t.certain", predicates.filename_key(F.col("path")).alias("key"))


@query(
    """select regexp_replace(path, '/[^/]*$', '') as dir, count(*) as n, count(*) filter (where path like '/lib/Brand1/%') as below from files group by 1""", "files"
)
def folder_predicates(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files")
    return files.groupBy(predicates.parent_dir(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n"), F.count_if(predicates.under_folder(F.col("path"), F.lit("/lib/Brand1"))).alias("below"))


@query(
    """select id, (music_score > 0.3 and id % 2 = 0) as run_heads, (harmonicity >= 0.5 and id % 3 > 0) as run_key, content_type <> 'one_shot' as run_rhythm,
    (content_type = 'stem' or duration_seconds > 300) as run_regions from files""",
    "files",
)
def stage_gates(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files").withColumn("has_embedding", F.col("id") % 2 == 0).withColumn("harmonicity_frames", F.col("id") % 3)
    return files.select("id", *[c.alias(n) for n, c in predicates.gates().items()])


@query(
    """, per as (select file_id, count(*) as n_segments, count(*) filter (where "end" - "start" > 15) as n_matching from segments group by 1)
    select id, coalesce(n_segments, 0) as n_segments, coalesce(n_matching, 0) as n_matching, case when coalesce(n_matching, 0) > 0 then n_matching else coalesce(n_segments, 0) end as n_visible
    from files left join per on id = file_id where content_type = 'loop' or coalesce(n_matching, 0) > 0""",
    "files", "segments",
)
def files_or_segments(spark: SparkSession, sf: str) -> DataFrame:
    found = predicates.files_or_segments(view(spark, sf, "files"), view(spark, sf, "segments"), F.col("content_type") == "loop", F.col("end") - F.col("start") > 15)
    return found.select("id", "n_segments", "n_matching", "n_visible")


@query(
    """select id from files where bpm between 80 and 110 and lower(key) = 'f major' and contains(lower(path), 'takes') and contains(lower(path), 'bolt')""",
    "files",
)
def list_criteria(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files").withColumn("haystack", F.lower("path")).where(predicates.criteria(bpm=(80, 110), key="F Major", terms="takes BOLT")).select("id")


# scalar functions -----------------------------------------------------------------------------------------------------


@query(
    """select id, key, case key when 'A minor' then '8A' when 'D flat major' then '3B' when 'F major' then '7B' end as camelot,
    case key when 'A minor' then '1m' when 'D flat major' then '8d' when 'F major' then '12d' end as open_key,
    case key when 'A minor' then 'Amin' when 'D flat major' then 'Dfla' when 'F major' then 'Fmaj' end as slug,
    round(440 * pow(2, (id % 128 - 69) / 12.0), 6) as hz from files""",
    "files",
)
def music_theory(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("key")
    return view(spark, sf, "files").select("id", "key", fn.camelot(key).alias("camelot"), fn.open_key(key).alias("open_key"), fn.key_slug(key).alias("slug"), r6(fn.midi_to_hz(F.col("id") % 128)).alias("hz"))


@query(
    """, x as (select id, id * 7.5e0 as s, cast(floor(id * 7.5e0 + 0.5) as bigint) as w, cast(floor(id * 7.5e0 * 25 + 0.5) as bigint) as f from files)
    select id, case when w // 3600 > 0 then (w // 3600) || ':' || lpad(cast(w % 3600 // 60 as string), 2, '0') else cast(w % 3600 // 60 as string) end || ':' || lpad(cast(w % 60 as string), 2, '0') as text,
    lpad(cast(f // 90000 as string), 2, '0') || ':' || lpad(cast(f // 1500 % 60 as string), 2, '0') || ':' || lpad(cast(f // 25 % 60 as string), 2, '0') || ':' || lpad(cast(f % 25 as string), 2, '0') as code,
    round(f / 25.0, 6) as parsed from x""",
    "files",
)
def time_texts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("id") * 7.5
    code = fn.timecode(s, 25.0)
    return view(spark, sf, "files").select("id", fn.duration_text(s).alias("text"), code.alias("code"), r6(fn.parse_timecode(code, 25)).alias("parsed"))


@query(
    """select p_partkey as id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '_' || regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') ||
    case when p_size > 20 then '_' || cast(floor(p_size * 2.3e0 + 0.5) as bigint) || 'bpm' else '' end || '_Amin' || case when p_size % 3 > 0 then '_v' || (p_size % 3) else '' end || '.wav' as name,
    p_size % 3 as version from part"""
)
def delivery_names(spark: SparkSession, sf: str) -> DataFrame:
    bpm = F.when(F.col("p_size") > 20, F.col("p_size") * 2.3)
    name = fn.delivery_name(F.col("p_name"), F.col("p_type"), bpm, F.lit("A minor"), F.col("p_size") % 3)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), fn.version_from_name(name).alias("version"))


@query(
    """select id, round(least(1, greatest(0, duration_seconds / 40)), 6) as linear, round(sin(least(1, greatest(0, duration_seconds / 40)) * pi() / 2), 6) as power, round(pow(10, loudness / 20), 6) as gain,
    round(1 / (1 + exp(-loudness / 10)), 6) as sig, round(case when centroid < 1000 then centroid * 3 / 200 else 15 + ln(centroid / 1000) / (ln(6.4) / 27) end, 6) as mel,
    round(ln(1 + centroid) / ln(1 + 11000), 6) as spectrum from files""",
    "files",
)
def curves(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("duration_seconds") / 40
    return view(spark, sf, "files").select(
        "id", r6(fn.fade_gain(t)).alias("linear"), r6(fn.fade_gain(t, "equal_power")).alias("power"), r6(fn.gain_from_db(F.col("loudness"))).alias("gain"), r6(fn.sigmoid(F.col("loudness") / 10)).alias("sig"),
        r6(fn.hz_to_mel(F.col("centroid"))).alias("mel"), r6(fn.spectrum_point(F.col("centroid"), F.col("flatness"))[0]).alias("spectrum"),
    )


@query(
    """select id, case when onset_rate < 0.8 then 'sparse' when onset_rate >= 2.0 then 'driving' else 'moderate' end as rhythm,
    case when loudness_range < 4 then 'compressed' when loudness_range >= 13 then 'wide' when loudness_range is not null then 'moderate' end as dynamics,
    case when flatness < 0.03 then 'tonal' when flatness >= 0.06 then 'noisy' else 'mixed' end as texture from files""",
    "files",
)
def shape_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files").select("id", *[captions._shape(n, F.col(captions.SHAPES[n][0])).alias(n) for n in ("rhythm", "dynamics", "texture")])


# table changes --------------------------------------------------------------------------------------------------------


@query(
    """, cat as (select path, 'h' || id as sha256, id as mtime, id * 10 as size_bytes, 1 as scanned_at, '{}' as machine from files where id % 2 = 0),
    new as (select path, 'n' || id as sha256, id + 1 as mtime, id * 20 as size_bytes, 2 as scanned_at from files where id % 3 = 0)
    select coalesce(cat.path, new.path) as path, case when new.path is not null then new.sha256 else cat.sha256 end as sha256, coalesce(new.mtime, cat.mtime) as mtime, machine
    from cat full join new on cat.path = new.path""",
    "files",
)
def upsert_scanned(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files")
    text = F.col("id").cast("string")
    have = files.where("id % 2 = 0").select("path", F.concat(F.lit("h"), text).alias("sha256"), F.col("id").alias("mtime"), (F.col("id") * 10).alias("size_bytes"), F.lit(1).cast("long").alias("scanned_at"), F.lit("{}").alias("machine"))
    scan = files.where("id % 3 = 0").select("path", F.concat(F.lit("n"), text).alias("sha256"), (F.col("id") + 1).alias("mtime"), (F.col("id") * 20).alias("size_bytes"), F.lit(2).cast("long").alias("scanned_at"))
    return dml.upsert_scanned(have, scan).select("path", "sha256", "mtime", "machine")


@query("""select file_id, id, "end" from (select *, row_number() over (partition by file_id order by id desc) as n from segments) as x where n = 1""", "segments")
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return dml.latest(view(spark, sf, "segments"), ["file_id"], "id").select("file_id", "id", "end")


@query("select source, human, count(*) as n from segments where not (source = 'auto' and human = '{}') group by 1, 2", "segments")
def delete_untouched(spark: SparkSession, sf: str) -> DataFrame:
    segments = view(spark, sf, "segments")
    kept, _ = dml.delete_segments(segments, segments.select(F.col("id").alias("segment_id")), dml.untouched())
    return kept.groupBy("source", "human").agg(F.count(F.lit(1)).alias("n"))


@query(
    """, a as (select id, content_type, bpm from files where id % 4 <> 0), b as (select id, case when id % 5 = 0 then 'stem' else content_type end as content_type, bpm from files where id % 4 <> 1)
    select coalesce(a.id, b.id) as id, case when a.id is null then 'added' when b.id is null then 'removed' else 'changed' end as status from a full join b on a.id = b.id
    where a.id is null or b.id is null or a.content_type <> b.content_type""",
    "files",
)
def undo_diff(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files").select("id", "content_type", "bpm")
    after = files.where("id % 4 <> 1").withColumn("content_type", F.when(F.col("id") % 5 == 0, "stem").otherwise(F.col("content_type")))
    return dml.changed_rows(files.where("id % 4 <> 0"), after, "id")


@query("select sha256(text) as sha256, count(*) as n, cast(min(doc_id) as string) as first_path from (select text, doc_id from documents) as x group by 1 having count(*) > 1")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").cast("string").alias("first_path"))
    return docs.where("n > 1")


# joins ----------------------------------------------------------------------------------------------------------------


@query(
    """select id, genre from (select f.id, d.genre, row_number() over (partition by f.id order by length(folder_path) desc) as n from files f join defaults d
    on f.path = d.folder_path or starts_with(f.path, d.folder_path || '/')) as x where n = 1""",
    "files", "defaults",
)
def folder_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """The innermost default of each file, by joins on its ancestors."""
    defaults = view(spark, sf, "defaults")
    human = F.struct(*[(F.array("genre") if c == "genre" else F.lit(None).cast("array<string>")).alias(c) for c in captions.LISTS], F.lit(None).cast("array<string>").alias("keywords"), *[F.lit(None).cast("string").alias(c) for c in captions.WORDS], F.lit(None).cast("double").alias("bpm"), F.lit(None).cast("boolean").alias("is_instrumental"))
    layers = captions.folder_layers(view(spark, sf, "files"), defaults.select("folder_path", human.alias("human")))
    return layers.select("id", captions.merged_layers(F.col("layers"))["genre"][0].alias("genre"))


@query(
    """select label, count(distinct file_id) as n_files from scores where label not in ('drums', 'piano', 'violin', 'voice') group by 1""", "scores"
)
def unmapped_labels(spark: SparkSession, sf: str) -> DataFrame:
    from sonolith.sources.documents import unmapped

    names = spark.createDataFrame([("m", x, x) for x in ("drums", "piano", "violin", "voice")], "model string, raw string, canonical string")
    return unmapped(view(spark, sf, "scores"), names, "m")


@query(
    """, a as (select file_id, id, "start", "end" from segments where source = 'auto'), b as (select file_id, "start" as s, "end" as e from segments where source = 'manual')
    select a.id, a."start" as from_s from a where not exists (select 1 from b where b.file_id = a.file_id and a."start" < b.e and a."end" > b.s)""",
    "segments",
)
def interval_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "segments")
    new = s.where("source = 'auto'").select("file_id", "id", "start", "end")
    return intervals.without_overlap(new, s.where("source = 'manual'").select("file_id", "start", "end"), ["file_id"]).select("id", F.col("start").alias("from_s"))


@query(
    """, a as (select * from segments where source = 'auto'), b as (select * from segments where source = 'manual')
    select a.id, b.id as other, round(least(a."end", b."end") - greatest(a."start", b."start"), 6) as overlap from a join b on a.file_id = b.file_id and a."start" < b."end" and a."end" > b."start" """,
    "segments",
)
def interval_join(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "segments").select("file_id", "id", "start", "end", "source")
    both = intervals.range_join(s.where("source = 'auto'"), s.where("source = 'manual'"), ["file_id"])
    return both.select("id", F.col("r_id").alias("other"), r6(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("overlap"))


@query(
    """, p as (select id, file_id, ("start" + "end") / 2 as mid from segments where source = 'auto'), b as (select file_id, "start" as s, "end" as e from segments where source = 'manual')
    select p.id, min(b.s) as cue_start from p left join b on b.file_id = p.file_id and p.mid >= b.s and p.mid < b.e group by 1""",
    "segments",
)
def containing_cue(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "segments")
    points = s.where("source = 'auto'").select("id", "file_id", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    return intervals.point_in_span(points, s.where("source = 'manual'").select("file_id", "start", "end"), ["file_id"], "mid").select("id", F.col("r_start").alias("cue_start"))


# aggregation ----------------------------------------------------------------------------------------------------------


@query("select count(*) as n_files, count(analyzed_at) as n_analyzed, round(sum(duration_seconds), 4) as seconds, count(*) - count(duration_seconds) as n_unknown from files", "files")
def library_stats(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files")
    both = aggregates.counts(files).withColumn("k", F.lit(1)).join(aggregates.scope_summary(files).drop("n_files").withColumn("k", F.lit(1)), "k")
    return both.select("n_files", "n_analyzed", F.round("seconds", 4).alias("seconds"), "n_unknown")


@query(
    """select 'bpm' as field, count(bpm) as n, round(100.0 * count(bpm) / count(*), 4) as percent from files union all select 'key', count(key), round(100.0 * count(key) / count(*), 4) from files
    union all select 'loudness_range', count(loudness_range), round(100.0 * count(loudness_range) / count(*), 4) from files""",
    "files",
)
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.coverage(view(spark, sf, "files"), ["bpm", "key", "loudness_range"])


@query(
    """select c.c_custkey as collection_id, count(o_orderkey) as n_files from customer c left join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1"""
)
def collection_counts(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "customer").select(F.col("c_custkey").alias("collection_id"))
    members = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("file_id"))
    return aggregates.collection_counts(own, members)


@query(
    """, k as (select id, regexp_replace(path, '/[^/]*$', '') as dir, cast(floor(duration_seconds * 20 + 0.5) as bigint) as len from files)
    select id, dir, len, n from (select *, count(*) over (partition by dir, len) as n from k) as x where n >= 2""",
    "files",
)
def sibling_groups(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files").withColumn("group_id", F.lit(None).cast("string"))
    return aggregates.sibling_groups(files).select("id", "dir", F.col("length").alias("len"), "n")


@query(
    """select trig, field, v as value, count(*) as n from (select p_type as trig, 'words' as field, unnest(string_split(p_name, ' ')) as v from part union all select p_type, 'brand', p_brand from part) as x group by 1, 2, 3"""
)
def vocabulary_counts(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    tags = part.select(F.col("p_type").alias("trigger"), F.lit("words").alias("field"), F.replace("p_name", F.lit(" "), F.lit(", ")).alias("value")).unionByName(part.select(F.col("p_type").alias("trigger"), F.lit("brand").alias("field"), F.col("p_brand").alias("value")))
    return aggregates.vocabulary(tags, ["words"], by_trigger=True).withColumnRenamed("trigger", "trig")


@query(
    """, f as (select p_type as k, p_brand as value, count(*) as n from part group by 1, 2), r as (select *, sum(n) over (partition by k order by n desc, value) as upto, sum(n) over (partition by k) as total from f)
    select k, value from (select *, row_number() over (partition by k order by upto) as i from r where upto > 0.37 * total) as x where i = 1""".replace(", f as", "with f as", 1)
)
def weighted_choice(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").groupBy(F.col("p_type").alias("k"), F.col("p_brand").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return aggregates.weighted_choice(n, ["k"], F.lit(0.37))


@query(
    """select label, pos, round(avg(x), 6) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings) as e group by 1, 2"""
)
def mean_pooling(spark: SparkSession, sf: str) -> DataFrame:
    pooled = aggregates.mean_pool(table(spark, sf, "embeddings").withColumnRenamed("embedding", "v"), ["label"])
    return pooled.select("label", F.posexplode("v").alias("pos", "x")).select("label", (F.col("pos") + 1).cast("long").alias("pos"), r6("x").alias("x"))


@query(
    """, b as (select l_orderkey as file_id, 'c' || (l_suppkey % 9) as class, max(l_discount) as score from lineitem group by 1, 2)
    select file_id, class, score, rank from (select *, row_number() over (partition by file_id order by score desc, class) as rank from b) as x where rank <= 5""".replace(", b as", "with b as", 1)
)
def max_pooling(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.concat(F.lit("c"), (F.col("l_suppkey") % 9).cast("string")).alias("class"), F.col("l_discount").alias("score"))
    return aggregates.max_pool_top(rows, ["file_id"])


@query(
    """select user_id, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as stddev, round(max(abs(value)) / avg(abs(value)), 6) as crest_factor, round(20 * log10(max(abs(value))), 6) as peak_db from events group by 1"""
)
def frame_statistics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    m = aggregates.moments(e, ["user_id"], "value")
    p = aggregates.peak_levels(e, ["user_id"], "value")
    return m.join(p, "user_id").select("user_id", r6("mean").alias("mean"), r6("stddev").alias("stddev"), r6("crest_factor").alias("crest_factor"), r6("peak_db").alias("peak_db"))


@query(
    """, p as (select user_id as k, value / 10 - floor(value / 10) as phase from events)
    , h as (select k, least(15, cast(floor(phase * 16) as int)) as bin, count(*) as n from p group by 1, 2), s as (select k, max(n) * 16.0 / sum(n) as strength from h group by 1)
    select p.k, round(max(strength), 6) as strength, round(sqrt(pow(sum(cos(2 * pi() * phase)), 2) + pow(sum(sin(2 * pi() * phase)), 2)) / count(*), 6) as resultant from p join s on p.k = s.k group by 1""".replace(", p as", "with p as", 1)
)
def circular_statistics(spark: SparkSession, sf: str) -> DataFrame:
    phases = table(spark, sf, "events").select(F.col("user_id").alias("k"), (F.col("value") / 10 - F.floor(F.col("value") / 10)).alias("phase"))
    both = aggregates.phase_strength(phases, ["k"]).drop("n").join(aggregates.resultant(phases, ["k"]), "k")
    return both.select("k", r6("strength").alias("strength"), r6("resultant").alias("resultant"))


@query(
    """, m as (select file_id, i % 4 as pos, count(*) as n, avg(value) as m from beats group by 1, 2), g as (select file_id, count(*) as n, avg(value) as g from beats group by 1),
    w as (select b.file_id, sum(pow(value - m.m, 2)) as within from beats b join m on b.file_id = m.file_id and b.i % 4 = m.pos group by 1),
    s as (select m.file_id, sum(m.n * pow(m.m - g.g, 2)) as between_, max(g.n) as n from m join g on m.file_id = g.file_id group by 1)
    select s.file_id, round((between_ / 3) / (within / (n - 4)), 4) as f from s join w on s.file_id = w.file_id""",
    "beats",
)
def accent_anova(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "beats").withColumnRenamed("value", "accent")
    return aggregates.anova_f(rows, ["file_id"], 4).select("file_id", F.round("f", 4).alias("f"))


@query(
    """select file_id, round(sum(case when label in ('synthesizer', 'pad') then score else 0 end) / sum(case when label in ('synthesizer', 'pad', 'drums', 'piano', 'violin', 'percussion', 'voice') then score else 0 end), 6) as share
    from scores where kind = 'instrument' group by 1 having sum(case when label in ('synthesizer', 'pad', 'drums', 'piano', 'violin', 'percussion', 'voice') then score else 0 end) > 0.05""",
    "scores",
)
def electronic_share(spark: SparkSession, sf: str) -> DataFrame:
    return views.library(spark, sf).select(F.col("id").alias("file_id"), r6(aggregates.electronic_share(F.col("instrument"))).alias("share")).where("share is not null")


@query(
    """select p_type, case when count(distinct p_size % 2) = 1 then min(p_size % 2) end as v, count(distinct p_brand) as brands from part group by 1"""
)
def mixed_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_type").agg(F.when(F.countDistinct(F.col("p_size") % 2) == 1, F.min(F.col("p_size") % 2)).alias("v"), F.countDistinct("p_brand").alias("brands"))


# nearest neighbours and top lists -------------------------------------------------------------------------------------


@query(
    """, q as (select embedding::double[] as v from embeddings where vec_id = 7)
    select vec_id as id, round(list_distance(embedding::double[], (select v from q)), 6) as distance from embeddings where vec_id <> 7 order by list_distance(embedding::double[], (select v from q)), vec_id limit 20""".replace(", q as", "with q as", 1)
)
def knn_overall(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    own = list(e.where("vec_id = 7").select("embedding").first()[0])
    return topk.knn(e, own, 20, exclude=7, id_col="vec_id", vector_col="embedding").select("id", r6("distance").alias("distance"))


@query(
    """select query_id, id, round(d, 6) as distance, rank from (select q.vec_id as query_id, e.vec_id as id, list_distance(e.embedding::double[], q.embedding::double[]) as d,
    row_number() over (partition by q.vec_id order by list_distance(e.embedding::double[], q.embedding::double[]), e.vec_id) as rank from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 50 = 0) as x where rank <= 5"""
)
def knn_each(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return topk.knn_each(e, e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 5).select("query_id", "id", r6("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(
    """select id, round(abs(bpm - 100), 6) as distance from files where content_type <> 'one_shot' and bpm > 0 and id <> 3 order by abs(bpm - 100), id limit 15""", "files"
)
def knn_tempo(spark: SparkSession, sf: str) -> DataFrame:
    return topk.nearest_tempo(view(spark, sf, "files"), 100.0, 15, exclude=3).select("id", r6("distance").alias("distance"))


@query(
    """select file_id, string_agg(label, ',' order by score desc, label) as labels from (select *, row_number() over (partition by file_id order by score desc, label) as n from scores where kind = 'mood' and score >= 0.1) as x where n <= 3 group by 1""",
    "scores",
)
def top_moods(spark: SparkSession, sf: str) -> DataFrame:
    top = topk.top_scored(F.col("mood"), 0.1, 3)
    return views.library(spark, sf).select(F.col("id").alias("file_id"), F.array_join(F.transform(top, lambda e: e["label"]), ",").alias("labels")).where("labels != ''")


# intervals ------------------------------------------------------------------------------------------------------------

_MERGE = """, o as (select *, max("end") over (partition by file_id order by "start", "end" rows between unbounded preceding and 1 preceding) as reach from spans),
    g as (select *, sum(case when reach is null or "start" - reach {op} {b} then 1 else 0 end) over (partition by file_id order by "start", "end" rows unbounded preceding) as island from o)"""


@query(_MERGE.format(op=">=", b="0.3") + """ select file_id, round(min("start"), 6) as s, round(max("end"), 6) as e from g group by file_id, island""", "spans")
def merge_spans(spark: SparkSession, sf: str) -> DataFrame:
    merged = intervals.merge_spans(view(spark, sf, "spans"), ["file_id"], 0.3)
    return merged.select("file_id", r6("start").alias("s"), r6("end").alias("e"))


@query(_MERGE.format(op=">", b="1.5") + """ select file_id, round(min("start"), 6) as s, round(max("end"), 6) as e from g group by file_id, island""", "spans")
def merge_spans_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    merged = intervals.merge_spans(view(spark, sf, "spans"), ["file_id"], 1.5, inclusive=True)
    return merged.select("file_id", r6("start").alias("s"), r6("end").alias("e"))


@query(
    _MERGE.format(op=">=", b="1.5")
    + """, u as (select file_id, min("start") as s, max("end") as e from g group by file_id, island having max("end") - min("start") >= 2.0), c as (select *, count(*) over (partition by file_id) as n from u)
    select file_id, round(s, 6) as s, round(e, 6) as e, n >= 2 as analyse from c where not (n = 1 and e - s >= 0.95 * 110.0) and not exists (select 1 from segments k where k.file_id = c.file_id and k.source = 'manual' and c.s < k."end" and c.e > k."start")""",
    "spans", "segments",
)
def auto_segments(spark: SparkSession, sf: str) -> DataFrame:
    spans = view(spark, sf, "spans")
    lengths = spans.select("file_id").distinct().withColumn("duration", F.lit(110.0))
    kept = view(spark, sf, "segments").where("source = 'manual'").select("file_id", "start", "end")
    return intervals.auto_segments(spans, lengths, kept).select("file_id", r6("start").alias("s"), r6("end").alias("e"), "analyse")


@query(
    """select s.id, round(sum(greatest(0, least(p."end", s."end") - greatest(p."start", s."start"))) / max(s."end" - s."start"), 6) as fraction from segments s join spans p on p.file_id = s.file_id group by 1""",
    "segments", "spans",
)
def active_fraction(spark: SparkSession, sf: str) -> DataFrame:
    spans = view(spark, sf, "spans").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return view(spark, sf, "segments").join(spans, "file_id").select("id", r6(intervals.active_fraction(F.col("spans"), F.col("start"), F.col("end"))).alias("fraction"))


@query(
    _MERGE.format(op=">=", b="0.3")
    + """, m as (select file_id, min("start") as s, max("end") as e from g group by file_id, island), a as (select *, sum(e - s) over (partition by file_id order by s) - (e - s) as at, max(e) over (partition by file_id) as fin from m),
    q as (select distinct file_id, 5.03e0 as t from m) select q.file_id, round(coalesce(min(a.s + (q.t - a.at)) filter (where q.t >= a.at and q.t < a.at + a.e - a.s), max(a.fin)), 6) as file_time from q join a on a.file_id = q.file_id group by 1""",
    "spans",
)
def splice_map(spark: SparkSession, sf: str) -> DataFrame:
    merged = intervals.merge_spans(view(spark, sf, "spans"), ["file_id"], 0.3).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    return merged.select("file_id", r6(intervals.active_to_file(F.col("spans"), F.lit(5.03))).alias("file_time"))


@query(
    """select file_id, round(t, 6) as s, round(coalesce(lead(t) over (partition by file_id order by t), 1000e0), 6) as e, i % 12 as chord from beats""", "beats"
)
def chord_intervals(spark: SparkSession, sf: str) -> DataFrame:
    beats = view(spark, sf, "beats")
    ends = beats.select("file_id").distinct().withColumn("end", F.lit(1000.0))
    return intervals.chord_intervals(beats.select("file_id", "t", (F.col("i") % 12).alias("chord")), ends).select("file_id", r6("start").alias("s"), r6("end").alias("e"), "chord")


@query(
    """, b as (select file_id as lane, id, "start", "end" - "start" as len from segments), n as (select *, lead("start") over w as ns, lead(len) over w as nl from b window w as (partition by lane order by "start", id))
    select id, round(case when "start" + len - ns > 0 then least("start" + len - ns, len, nl) else 0 end, 6) as crossfade from n""",
    "segments",
)
def crossfades(spark: SparkSession, sf: str) -> DataFrame:
    blocks = view(spark, sf, "segments").select(F.col("file_id").alias("lane"), "id", "start", (F.col("end") - F.col("start")).alias("length"))
    return intervals.crossfades(blocks).select("id", r6("crossfade").alias("crossfade"))


@query(
    """, p as (select file_id, stem, "end", unnest(generate_series(cast(floor("start" / 5) as bigint), greatest(cast(floor("start" / 5) as bigint), cast(ceil("end" / 5) as bigint) - 1))) as bin from spans)
    select file_id as group_id, bin, count(distinct stem) as n_stems from p group by 1, 2""",
    "spans",
)
def stem_density(spark: SparkSession, sf: str) -> DataFrame:
    spans = view(spark, sf, "spans").select(F.col("file_id").alias("group_id"), "stem", F.lit(False).alias("is_mix"), "start", "end")
    return library.stem_density(spans, 5.0)


# rhythm ---------------------------------------------------------------------------------------------------------------

_STEPS = """, d as (select file_id, i, t, t - lag(t) over (partition by file_id order by t) as step from beats)"""


@query(
    _STEPS
    + """, s as (select file_id, count(step) as n, stddev_pop(step) / avg(step) as j, list_sort(list(step) filter (where step is not null)) as v, min(step) as least from d group by 1)
    select file_id, round(60 / quantile, 6) as bpm, round(case when n >= 15 and least > 0 and j <= 2 then j end, 6) as jitter, round(list_count(list_filter(v, lambda x: abs(x - v[n // 2 + 1]) <= 0.25 * v[n // 2 + 1])) / n, 6) as stability
    from (select *, (v[(n + 1) // 2] + v[n // 2 + 1]) / 2 as quantile from s) as x""",
    "beats",
)
def beat_statistics(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("beats")
    return views.rhythm(spark, sf).select("file_id", r6(rhythm.median_bpm(b)).alias("bpm"), r6(rhythm.jitter(b)).alias("jitter"), r6(rhythm.grid_stability(b)).alias("stability"))


@query(
    """, w as (select file_id, floor(t / 5) as w, count(*) as n, 60 / ((max(t) - min(t)) / (count(*) - 1)) as bpm from beats b where t < 1e9 group by 1, 2 having count(*) >= 2)
    , l as (select file_id, max(t) as last from beats group by 1), x as (select w.* from w join l on w.file_id = l.file_id where w.w * 5 < last)
    select file_id, count(*) as window_count, round(stddev_pop(bpm), 6) as stddev_bpm, round(max(bpm) - min(bpm), 6) as range_bpm from x group by 1 having count(*) >= 3""",
    "beats",
)
def tempo_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = rhythm.tempo_windows(F.col("beats"), 5.0)
    rows = views.rhythm(spark, sf).select("file_id", w.alias("w")).where(F.size("w") >= 3)
    return rows.select("file_id", F.size("w").cast("long").alias("window_count"), r6(rhythm._stddev(F.col("w"))).alias("stddev_bpm"), r6(F.array_max("w") - F.array_min("w")).alias("range_bpm"))


_PHASES = """, n as (select file_id, t as b, lead(t) over (partition by file_id order by t) as nb from beats), p as (select o.file_id, (o.t - n.b) / (n.nb - n.b) as phase from onsets o join n on n.file_id = o.file_id and {cond} where n.nb > n.b)"""


@query(
    _PHASES.format(cond="o.t > n.b and o.t <= n.nb")
    + """, h as (select file_id, greatest(0, least(15, cast(floor(phase * 16) as int))) as bin, count(*) as n from p group by 1, 2)
    select file_id, round(case when sum(n) >= 8 then max(n) * 16.0 / sum(n) else 0 end, 6) as concentration from h group by 1""",
    "beats", "onsets",
)
def grid_concentration(spark: SparkSession, sf: str) -> DataFrame:
    return views.rhythm(spark, sf).select("file_id", r6(rhythm.grid_concentration(F.col("onsets"), F.col("beats"))).alias("concentration"))


@query(
    _PHASES.format(cond="o.t >= n.b and o.t < n.nb")
    + """, h as (select file_id, greatest(0, least(15, cast(floor(phase * 16) as int))) as bin, count(*) as n from p group by 1, 2), s as (select file_id, max(n) * 16.0 / sum(n) as strength, sum(n) as total from h group by 1)
    select p.file_id, round(max(strength), 6) as strength, round(sqrt(pow(sum(sin(2 * pi() * phase)), 2) + pow(sum(cos(2 * pi() * phase)), 2)) / count(*), 6) as resultant,
    case when max(strength) >= 1.5 then round(sum((phase * 4 - floor(phase * 4 + 0.5)) / 4) / count(*), 6) end as pocket,
    case when max(strength) >= 1.5 then round(avg(case when cast(floor(phase * 4 + 0.5) as int) % 4 <> 0 then 1.0 else 0.0 end), 6) end as syncopation
    from p join s on s.file_id = p.file_id where total >= 80 group by 1""",
    "beats", "onsets",
)
def groove_on_beats(spark: SparkSession, sf: str) -> DataFrame:
    g = views.rhythm(spark, sf).select("file_id", rhythm.groove_on_beats(F.col("onsets"), F.col("beats")).alias("g")).where("g.strength is not null")
    return g.select("file_id", r6("g.strength").alias("strength"), r6("g.resultant").alias("resultant"), r6("g.pocket").alias("pocket"), r6("g.syncopation").alias("syncopation"))


@query(
    _PHASES.format(cond="o.t >= n.b and o.t < n.nb") + """ select file_id, round(avg(case when abs(phase * 4 - floor(phase * 4 + 0.5)) <= 0.18 then 1.0 else 0.0 end), 6) as share from p group by 1""",
    "beats", "onsets",
)
def on_grid_share(spark: SparkSession, sf: str) -> DataFrame:
    return views.rhythm(spark, sf).select("file_id", r6(rhythm.on_grid_share(F.col("onsets"), F.col("beats"))).alias("share")).where("share is not null")


@query()
def beat_period_fit(spark: SparkSession, sf: str) -> DataFrame:
    return views.rhythm(spark, sf).select("file_id", r6(rhythm.fitted_period(F.col("beats"))).alias("period"), rhythm.tempo_stability(F.col("beats")).alias("stability"), rhythm.tempo_parts(F.col("beats")).alias("parts"))


@query()
def groove_fitted(spark: SparkSession, sf: str) -> DataFrame:
    return views.rhythm(spark, sf).select("file_id", rhythm.fitted_groove("onsets", F.lit(120.0), F.lit(60.0)).alias("groove"))


@query()
def cue_detection(spark: SparkSession, sf: str) -> DataFrame:
    spans = view(spark, sf, "spans").select(F.floor(F.col("file_id") / 20).cast("string").alias("group_id"), "stem", (F.col("stem") % 10 == 0).alias("is_mix"), F.lit(120.0).alias("length"), "start", "end")
    return cues.detect_cues(spans)


# captions and lists ---------------------------------------------------------------------------------------------------


@query()
def caption_all(spark: SparkSession, sf: str) -> DataFrame:
    """Captions of the whole library, with folder defaults."""
    none = {"array<string>": [*captions.LISTS[1:], "keywords"], "string": list(captions.WORDS), "double": ["bpm"], "boolean": ["is_instrumental"]}
    human = F.struct(F.array("genre").alias("genre"), *[F.lit(None).cast(kind).alias(c) for kind, names in none.items() for c in names])
    fixed = F.struct(*[F.col(f"h.{c}").alias(c) for c in (*captions.LISTS, "keywords", *captions.WORDS, "bpm", "is_instrumental")])
    defaults = view(spark, sf, "defaults").withColumn("h", human).select("folder_path", fixed.alias("human"))
    return captions.captions(views.library(spark, sf), defaults, trigger="lib")


@query(
    """, x as (select *, case when voice_probability is null then '' when voice_probability < 0.5 then 'VocalType: Instrumental, ' else 'VocalType: Vocal, ' end as vocal from files where content_type in ('track', 'loop'))
    , y as (select id, 'TrackType: Music, ' || vocal || case when voice_probability >= 0.5 then 'featuring voice' else 'instrumental track' end || '. ' || case when bpm > 0 then 'BPM: ' || cast(floor(bpm + 0.5) as bigint) || '. ' else '' end || 'Length: ' || cast(floor(duration_seconds + 0.5) as bigint) || ' seconds' as prose from x) select * from y""",
    "files",
)
def caption_plain(spark: SparkSession, sf: str) -> DataFrame:
    """Captions from the measured columns alone, without score maps."""
    return captions.captions(view(spark, sf, "files").where("content_type in ('track', 'loop')")).select("id", "prose")


@query(
    """, r as (select user_id, list(value order by event_id) as v from events group by 1)
    select user_id, round(list_reduce(v, lambda k, x: k * 0.7 + x * 0.3), 6) as ewma from r""".replace(", r as", "with r as", 1)
)
def ewma(spark: SparkSession, sf: str) -> DataFrame:
    return library.ewma(table(spark, sf, "events"), ["user_id"], "event_id", "value").select("user_id", r6("ewma").alias("ewma"))


@query(
    """, t as (select o_custkey as block_id, o_orderkey as created, case o_orderstatus when 'F' then 'kept' when 'O' then 'pending' else 'discarded' end as state from orders), m as (select *, max(case when state = 'pending' then created end) over (partition by block_id) as newest from t)
    select block_id, count(*) filter (where state = 'pending' and created <> newest) as pending, count(*) filter (where state = 'kept') as kept, count(*) filter (where state = 'discarded') as discarded from m group by 1""".replace(", t as", "with t as", 1)
)
def take_counts(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "kept").when(F.col("o_orderstatus") == "O", "pending").otherwise("discarded")
    return library.take_counts(table(spark, sf, "orders").select(F.col("o_custkey").alias("block_id"), F.col("o_orderkey").alias("created_at"), state.alias("state")))


@query("select user_id, cast(floor(n / 16) as bigint) as point, min(value) as low, max(value) as high from (select user_id, value, row_number() over (partition by user_id order by event_id) - 1 as n from events) as x group by 1, 2")
def thumbnails(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return library.thumbnail(table(spark, sf, "events").select("user_id", "value", i.alias("i")), ["user_id"], 16)


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as n from events) as x where n <= 25")
def bounded_log(spark: SparkSession, sf: str) -> DataFrame:
    return library.bounded_log(table(spark, sf, "events").withColumn("seq", F.col("event_id")), ["user_id"], 25).select("user_id", "event_id")


@query("""select id, path, s."start" as edit_start, s."end" as edit_end from files left join (select *, row_number() over (partition by file_id order by "start", "end", id) as n from (select file_id, "start", "end", id from segments) as y) as s on s.file_id = files.id and n = 1""".replace("select id, path", "select files.id, path"), "files", "segments")
def first_segments(spark: SparkSession, sf: str) -> DataFrame:
    return library.first_segments(view(spark, sf, "files"), view(spark, sf, "segments"))


@query(
    """select folder, count(*) as n_files from (select unnest([regexp_replace(path, '/[^/]*$', ''), regexp_replace(path, '/[^/]*/[^/]*$', ''), '/lib', '']) as folder from files) as x group by 1""", "files"
)
def folders_with_audio(spark: SparkSession, sf: str) -> DataFrame:
    return library.folders_with_audio(view(spark, sf, "files"))


@query(
    """, b as (select o_orderkey as id, case when o_orderkey % 5 = 0 then null else o_orderkey - 1 end as follows from orders) select id, (id - id % 5) as root, cast(id % 5 as int) as depth from b""".replace(", b as", "with b as", 1)
)
def chain_depths(spark: SparkSession, sf: str) -> DataFrame:
    blocks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") - 1).alias("follows"))
    return library.chain_depths(blocks).select("id", "root", "depth")


@query(
    """select s.id, f.id as file_id, cast(greatest(0, least(floor(duration_seconds * 100), floor("start" * 100))) as bigint) as first, cast(greatest(0, least(floor(duration_seconds * 100), floor("end" * 100))) as bigint) as last,
    'seg' || s.id || '_' || cast(floor("start") as bigint) || '-' || cast(floor("end") as bigint) || 's' as folder,
    case when greatest(0, least(floor(duration_seconds * 100), floor("end" * 100))) <= greatest(0, least(floor(duration_seconds * 100), floor("start" * 100))) then 'segment is outside the file' when analyzed_at is null then 'file isn''t analysed' end as skipped
    from segments s join files f on f.id = s.file_id""",
    "segments", "files",
)
def clip_plan(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files").select("id", "path", F.lit(None).cast("string").alias("group_id"), F.floor(F.col("duration_seconds") * 100).alias("n_samples"), "analyzed_at", F.lit(1.0).alias("active_fraction"))
    segments = view(spark, sf, "segments").withColumn("group_id", F.lit(None).cast("string"))
    return library.clip_plan(files, segments.select("id", "file_id", "group_id", "start", "end"), 100).select("id", "file_id", "first", "last", "folder", "skipped")


@query(
    """select p_partkey as id, len(list_transform(generate_series(0, greatest(-1, (p_size * 10 - 128) // 62)), lambda i: i)) as n_patches from part where p_size * 10 >= 128 union all select p_partkey, 0 from part where p_size * 10 < 128"""
)
def patch_windows(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_size").cast("long") * 10
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.size(models.windows(n, *models.CUTTERS["effnet_patch"])).cast("long").alias("n_patches"))


@query("select event_id, cast(json_extract(props, '$.k') as double) as k, case when value > 250 then null else value end as v from events")
def json_numbers(spark: SparkSession, sf: str) -> DataFrame:
    document = F.concat(F.lit('{"v":'), F.when(F.col("value") > 250, "-inf").otherwise(F.col("value").cast("string")), F.lit("}"))
    return table(spark, sf, "events").select("event_id", models.number_at(F.col("props"), "$.k").alias("k"), models.number_at(models.sanitized(document), "$.v").alias("v"))


@query(
    """, c as (select l_partkey as file_id, max(l_discount * 10) as music_score from lineitem where l_suppkey % 3 = 0 group by 1) select file_id, round(music_score, 6) as music_score, music_score > 0.30 as is_music from c""".replace(", c as", "with c as", 1)
)
def music_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_linenumber").alias("chunk"), F.when(F.col("l_suppkey") % 3 == 0, "Music").otherwise("Speech").alias("class"), (F.col("l_discount") * 10).alias("score"))
    return models.gate(rows).select("file_id", r6("music_score").alias("music_score"), "is_music")


# catalog --------------------------------------------------------------------------------------------------------------


@query(
    """select s.id, s.file_id, case when s.id % 3 = 0 then 's' || s.id else 'f' || s.file_id end as machine, s.id % 3 = 0 as from_segment from segments s""", "segments"
)
def segment_documents(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "segments").select("id", "file_id")
    own = s.where("id % 3 = 0").select(F.col("id").alias("segment_id"), "file_id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("machine"))
    whole = s.select(F.col("file_id").alias("id"), F.concat(F.lit("f"), F.col("file_id").cast("string")).alias("machine")).distinct()
    return catalog.segment_documents(s, own, whole)


@query(
    """, k as (select id, path, regexp_replace(path, '/[^/]*$', '') as dir, cast(floor(duration_seconds * 20 + 0.5) as bigint) as len from files)
    select a.path as candidate, b.id as sibling_id from k a join k b on a.dir = b.dir and a.len = b.len where a.id % 4 = 0 and b.id % 4 <> 0""",
    "files",
)
def earlier_siblings(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files").withColumn("group_id", F.lit(None).cast("string"))
    return catalog.earlier_siblings(files.where("id % 4 = 0").select("path", "duration_seconds"), files).select("candidate", "sibling_id")


@query(
    """select id, 'key' as field, key as value from files where key is not null union all select id, 'content_type', content_type from files
    union all select id, 'warning', 'mostly silence' from files where harmonicity < 0.5 union all select id, 'warning', 'tempo estimates disagree' from files where abs(danceable + 0.5e0 - 1) > 0.05""",
    "files",
)
def file_report(spark: SparkSession, sf: str) -> DataFrame:
    files = view(spark, sf, "files").withColumns({"active_ratio": F.col("harmonicity"), "bpm_ratio": F.col("danceable") + 0.5, "tempo_unstable": F.lit(False), "tempo_window_count": F.lit(0)})
    return catalog.report(files, ["key", "content_type"])


@query(
    """select o.file_id, round(o.t, 6) as t, round(max(b.t) filter (where b.t <= o.t), 6) as before, round(min(b.t) filter (where b.t > o.t), 6) as after
    from onsets o join beats b on b.file_id = o.file_id group by o.file_id, o.t""",
    "onsets", "beats",
)
def asof_beats(spark: SparkSession, sf: str) -> DataFrame:
    found = intervals.asof(view(spark, sf, "onsets").distinct(), view(spark, sf, "beats"), ["file_id"], "t", "before", "after")
    return found.select("file_id", r6("t").alias("t"), r6("before").alias("before"), r6("after").alias("after"))


@query(
    """select file_id, round(t, 6) as t, round(n, 6) as nearest from (select o.file_id, o.t, b.t as n, row_number() over (partition by o.file_id, o.t order by abs(b.t - o.t), b.t) as k
    from (select distinct file_id, t + 0.003e0 as t from onsets) o join beats b on b.file_id = o.file_id) as x where k = 1""",
    "onsets", "beats",
)
def nearest_beat(spark: SparkSession, sf: str) -> DataFrame:
    onsets = view(spark, sf, "onsets").select("file_id", (F.col("t") + 0.003).alias("t")).distinct()
    return intervals.nearest(onsets, view(spark, sf, "beats"), ["file_id"], "t").select("file_id", r6("t").alias("t"), r6("nearest").alias("nearest"))


@query(
    """select l_suppkey as k, quantile_cont(l_quantity, 0.5) as mid, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] as upper from lineitem group by 1"""
)
def medians(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_list("l_quantity").alias("v"))
    return rows.select("k", aggregates.median_mid(F.col("v")).alias("mid"), aggregates.median_upper(F.col("v")).alias("upper"))


@query("""select p_name as folder, 'world' as field, p_type as value, 'unknown word' as problem from part group by 1, 2, 3""")
def vocabulary_errors(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "part").select(F.col("p_name").alias("folder"), F.lit("world").alias("field"), F.col("p_type").alias("value")).distinct()
    return predicates.invalid_words(tags).where("problem = 'unknown word'")


@query("""select l_suppkey as collection_id, l_partkey as file_id, min(l_linenumber) as seq from lineitem group by 1, 2""")
def insert_or_ignore(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("collection_id"), F.col("l_partkey").alias("file_id"), F.col("l_linenumber").alias("seq"))
    first = rows.groupBy("collection_id", "file_id").agg(F.min("seq").alias("seq")).where("file_id % 2 = 0")
    return dml.insert_or_ignore(first, rows, ["collection_id", "file_id"])


@query("""select id, o_orderkey as added_at, path from orders join files on o_custkey = id""", "files")
def collection_files(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "orders").select(F.lit(1).alias("collection_id"), F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("added_at"))
    return catalog.collection_files(members, view(spark, sf, "files"), 1).select("id", "added_at", "path")


@query("""select lower(v) as folded, min(v) as value from (select p_name as v from part union all select upper(p_name) from part) as x group by 1""")
def facet_values(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return aggregates.facet_values(part.select(F.col("p_name").alias("value")), part.select(F.upper("p_name").alias("value"))).select(F.lower("value").alias("folded"), "value")
