"""Further registered queries with their oracles: table changes, lists, labels, grids, arrangements, documents and streams' forms on tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.operators import aggregates, captions, catalog, dml, frontends, harmony, intervals, library, models, predicates, rhythm, signal, topk
from sonolith.plans import views
from sonolith.plans.queries import query, r6
from sonolith.plans.views import table, view
from sonolith.sources import documents, files
from sonolith.streaming import streams

_DIR = "regexp_replace(path, '/[^/]*$', '')"
_BASE = "regexp_extract(path, '[^/]*$')"


def _named(df: DataFrame, **columns: str | Column) -> DataFrame:
    return df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


# sources and targets --------------------------------------------------------------------------------------------------


@query(
    """, f as (select path, id % 7 as mtime from files), c as (select path, case when id % 5 = 0 then id % 7 + 1 else id % 7 end as mtime from files where id % 4 <> 0)
    select f.path, case when c.path is null then 'new' when c.mtime <> f.mtime then 'updated' else 'unchanged' end as status from f left join c on c.path = f.path""",
    "files",
)
def scan_statuses(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "files")
    found = _named(rows, path="path", mtime="id % 7", size_bytes="id", status="'audio'")
    known = _named(rows.where("id % 4 != 0"), path="path", mtime="case when id % 5 = 0 then id % 7 + 1 else id % 7 end")
    return files.scan_status(found, known).select("path", "status")


@query("""select case when bpm is null then 'skipped' else content_type end as status, count(*) as n from files group by 1""", "files")
def scan_counts(spark: SparkSession, sf: str) -> DataFrame:
    return files.scan_counters(_named(view(spark, sf, "files"), status="case when bpm is null then 'skipped' else content_type end"))


@query("""select id, nfc_normalize(path || chr(101) || chr(769)) as nfc from files""", "files")
def path_forms(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files").select("id", files.path_nfc(F.concat("path", F.lit("é"))).alias("nfc"))


@query("""select id, case when contains(t, '|') then 'group' when regexp_full_match(t, '[0-9]+') then 'id' else 'path' end as kind from (select id, case id % 3 when 0 then path when 1 then cast(id as varchar) else 'a|1.5' end as t from files) as x""", "files")
def target_kinds(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("case id % 3 when 0 then path when 1 then cast(id as string) else 'a|1.5' end")
    return view(spark, sf, "files").select("id", predicates.target(text).alias("kind"))


@query("select id, path from files where id = 17", "files")
def target_rows(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.resolve_target(view(spark, sf, "files").withColumn("group_id", F.lit(None).cast("string")), "17").select("id", "path")


@query("select id from files where analyzed_at is null and content_type = 'loop'", "files")
def waiting_files(spark: SparkSession, sf: str) -> DataFrame:
    return predicates.for_analysis(view(spark, sf, "files"), content_type="loop").select("id")


@query("select x.p as path, size_bytes, size_bytes is not null as exists from (select '/lib/none.onnx' as p union all select min(path) from files) as x left join (select path, id as size_bytes from files) as f on f.path = x.p", "files")
def model_files(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(view(spark, sf, "files"), path="path", size_bytes="id")
    return files.missing_models(["/lib/none.onnx", rows.agg(F.min("path")).first()[0]], rows)


@query(f"select row_number() over (order by lower({_BASE}), path) as place, id from files", "files")
def files_by_name(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    return library.by_file_name(view(spark, sf, "files")).withColumn("place", F.row_number().over(Window.orderBy(F.lower(predicates.basename(F.col("path"))), "path"))).select(F.col("place").cast("long").alias("place"), "id")


# table changes --------------------------------------------------------------------------------------------------------


@query(
    """select id, case when id % 2 = 0 then 'loop' else content_type end as content_type, case when id % 2 = 0 and id % 3 <> 0 then 'router' when id % 3 = 0 then 'declared' else 'scan' end as content_type_source,
    case when id % 2 = 0 then '{"a":1,"c":' || id || '}' else '{"a":1,"b":2}' end as machine, case when id % 4 = 0 then id else analyzed_at end as analyzed_at from files""",
    "files",
)
def analysis_applied(spark: SparkSession, sf: str) -> DataFrame:
    source = F.expr("case when id % 3 = 0 then 'declared' else 'scan' end")
    rows = view(spark, sf, "files").select("id", "content_type", source.alias("content_type_source"), F.lit(None).cast("string").alias("group_id"), F.lit(0.5).alias("active_ratio"), F.lit('{"a":1,"b":2}').alias("machine"), F.lit("p").alias("provenance"), F.col("analyzed_at").cast("long").alias("analyzed_at"))
    patch = F.concat(F.lit('{"b":null,"c":'), F.col("id").cast("string"), F.lit("}"))
    new = rows.where("id % 2 = 0").select("id", F.lit("loop").alias("content_type"), F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("double").alias("active_ratio"), patch.alias("machine"), F.lit(None).cast("string").alias("provenance"), F.expr("case when id % 4 = 0 then id end").alias("analyzed_at"))
    return dml.apply_analysis(rows, new).select("id", "content_type", "content_type_source", "machine", "analyzed_at")


@query("""select id, 'genre=' || 'x' || ';key=' || coalesce(key, '') as kept, 'key=' || coalesce(key, '') as cleared from files""", "files")
def document_keys(spark: SparkSession, sf: str) -> DataFrame:
    document = F.create_map(F.lit("key"), F.coalesce("key", F.lit("")), F.lit("genre"), F.col("content_type"))
    listed = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return view(spark, sf, "files").select("id", listed(dml.set_key(document, "genre", F.lit("x"))).alias("kept"), listed(dml.clear_key(document, "genre")).alias("cleared"))


@query("""select id, case when id % 5 = 0 then 'stem' else content_type end as content_type, case when id % 5 = 0 then 'declared' else 'router' end as content_type_source, case when path like '/lib/Brand13/%' then '/new' || substr(path, 13) else path end as path from files""", "files")
def stems_declared(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "files").select("id", "path", "content_type", F.lit("router").alias("content_type_source"))
    return dml.move_paths(dml.declare_stem(rows, F.col("id") % 5 == 0), "/lib/Brand13", "/new").select("id", "content_type", "content_type_source", "path")


@query(
    """, n as (select file_id, "start", "end", row_number() over (order by floor("start" / 60), "start", "end", file_id, id) as k from segments where id % 3 = 0)
    select id, file_id, round("start", 6) as s from segments where id % 3 <> 0 union all select (select max(id) from segments where id % 3 <> 0) + k, file_id, round("start", 6) from n""",
    "segments",
)
def segments_added(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "segments").select("id", "file_id", F.lit(None).cast("long").alias("group_id"), "start", "end")
    new = rows.where("id % 3 = 0").orderBy("id").withColumn("id", F.lit(None).cast("long"))
    return dml.add_segments(rows.where("id % 3 != 0"), new).select("id", "file_id", r6("start").alias("s"))


@query("""select count(*) as n_segments, count(*) filter (where id % 2 = 0) as n_analyses from segments where file_id % 4 <> 0""", "segments")
def segments_deleted(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "segments")
    analyses = rows.where("id % 2 = 0").select(F.col("id").alias("segment_id"))
    left, kept = dml.delete_segments(rows, analyses, F.col("file_id") % 4 == 0)
    return left.agg(F.count(F.lit(1)).alias("n_segments")).withColumn("k", F.lit(1)).join(kept.agg(F.count(F.lit(1)).alias("n_analyses")).withColumn("k", F.lit(1)), "k").drop("k")


@query("""select vec_id as id, round(list_sum(list_transform(embedding, lambda x: cast(x as double))) * case when vec_id % 3 = 0 then 2 else 1 end, 4) as total from embeddings""")
def vectors_replaced(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("file_id"), F.col("embedding").cast("array<double>").alias("v"))
    size = rows.agg(F.max(F.size("v"))).first()[0]
    doubled = rows.where("file_id % 3 = 0").withColumn("v", F.transform("v", lambda x: x * 2))
    wrong = rows.where("file_id % 3 = 1").withColumn("v", F.slice("v", 1, 3))
    out = dml.upsert_vectors(rows, doubled.unionByName(wrong), size or 0)
    return out.select(F.col("file_id").alias("id"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("""select n_name as key, case when n_name = 'FRANCE' then 'new' else 'old' end as value from nation where n_name <> 'CHINA' union select 'FRANCE', 'new'""")
def settings_changed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.lit("old").alias("value"))
    return dml.set_setting(dml.set_setting(rows, "FRANCE", "new"), "CHINA", None)


@query("""select n_nationkey as group_id, case when lower(n_name) = 'france' then 'Gaul' else n_name end as name from nation where n_nationkey <> 3 union all select (select max(n_nationkey) from nation) + 1, 'Atlantis'""")
def groups_changed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"), F.col("n_name").alias("name"), F.lit(0).cast("long").alias("added_at"))
    made = dml.create_group(dml.create_group(rows, "Atlantis", 9), "ATLANTIS", 9)
    left, _ = dml.ungroup(dml.rename_nocase(made, "France", "Gaul"), rows.select("group_id"), 3)
    return left.select("group_id", "name")


@query("""select c_custkey as root_id, nullif(c_nationkey, 3) as group_id from customer""")
def roots_ungrouped(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "nation").select(F.col("n_nationkey").alias("group_id"))
    return dml.ungroup(groups, table(spark, sf, "customer").select(F.col("c_custkey").alias("root_id"), F.col("c_nationkey").alias("group_id")), 3)[1]


@query(
    """select collection_id, file_id, min(added_at) as added_at from (select o_custkey as collection_id, o_orderkey as file_id, 1 as added_at from orders where o_orderkey % 2 = 0 union all select o_custkey, o_orderkey, 2 from orders where o_orderkey % 3 = 0) as x
    where file_id % 5 <> 0 group by 1, 2"""
)
def members_changed(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda n, t: _named(table(spark, sf, "orders").where(f"o_orderkey % {n} = 0"), collection_id="o_custkey", file_id="o_orderkey", added_at=str(t))
    return dml.remove_members(dml.add_members(at(2, 1), at(3, 2)), at(5, 0))


# catalog and lists ----------------------------------------------------------------------------------------------------


@query(f"select id, path from files where {_DIR} || '|1' = '/lib/Brand13/takes|1'", "files")
def group_siblings(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "files").withColumn("group_id", F.concat(predicates.parent_dir(F.col("path")), F.lit("|1")))
    return catalog.group_files(rows, "/lib/Brand13/takes|1").select("id", "path")


@query(
    """, q as (select bpm from files where id = 8) select f.id, f.path, round(abs(f.bpm - q.bpm), 6) as distance from files f, q where content_type <> 'one_shot' and f.bpm > 0 and f.id <> 8 order by abs(f.bpm - q.bpm), f.id limit 10""",
    "files",
)
def similar_by_tempo(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "files")
    none = spark.createDataFrame([], "file_id long, space string, v array<double>")
    return topk.similar(rows, none, 8, by="rhythm", k=10).select("id", "path", r6("distance").alias("distance"))


@query(
    """, q as (select embedding as v from embeddings where vec_id = 3) select e.vec_id as id, f.path, round(list_distance(cast(e.embedding as double[]), cast(q.v as double[])), 5) as distance
    from embeddings e left join files f on f.id = e.vec_id, q where e.vec_id <> 3 order by list_distance(cast(e.embedding as double[]), cast(q.v as double[])), e.vec_id limit 10""",
    "files",
)
def similar_by_vector(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("file_id"), F.lit("effnet").alias("space"), F.col("embedding").cast("array<double>").alias("v"))
    return topk.similar(view(spark, sf, "files"), vectors, 3).select("id", "path", F.round("distance", 5).alias("distance"))


@query(
    """, l as (select file_id, label, score, row_number() over (partition by file_id order by score desc, label) as n from scores where kind = 'mood')
    select file_id, string_agg(label, ',' order by score desc, label) as labels from l where n <= 12 and (n = 1 or score >= 0.1) group by 1""",
    "scores",
)
def facet_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.library(spark, sf).where("size(mood) > 0")
    none = F.array().cast("array<string>")
    return rows.select(F.col("id").alias("file_id"), F.array_join(topk.facet_labels(none, [F.col("mood"), F.col("instrument")]), ",").alias("labels"))


@query(
    """, l as (select file_id, label, row_number() over (partition by file_id order by score desc, label) as n, count(*) over (partition by file_id) as m from scores where kind = 'instrument')
    select file_id, label || case when m > 1 then ' +' || (m - 1) else '' end as label from l where n = 1""",
    "scores",
)
def compact_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.library(spark, sf).where("size(instrument) > 0")
    labels = F.transform(topk.top_entries(F.col("instrument"), 100), lambda e: e["label"])
    return rows.select(F.col("id").alias("file_id"), topk.compact_label(labels).alias("label"))


@query(
    """, n as (select file_id, regexp_replace(label, '---', ': ') as label, score, true as fine from scores where kind = 'genre' and file_id % 2 = 0 union all select file_id, label, score, false from scores where kind = 'genre'),
    m as (select * from n where fine or not exists (select 1 from n as x where x.fine and x.file_id = n.file_id and x.label = regexp_replace(n.label, '---', ': '))),
    o as (select *, row_number() over (partition by file_id order by score desc, label) as k from m where score >= 0.1)
    select file_id, string_agg(label, ',' order by score desc, label) as genres from o where k <= 3 group by 1""",
    "scores",
)
def top_genre_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.library(spark, sf).where("size(genre) > 0")
    fine = F.when(F.col("id") % 2 == 0, F.transform_keys("genre", lambda k, _: F.regexp_replace(k, "---", ": ")))
    return rows.select(F.col("id").alias("file_id"), F.array_join(F.transform(topk.top_genres(fine, F.col("genre")), lambda e: e["label"]), ",").alias("genres")).where("genres != ''")


_HINTS = "case " + " ".join(f"when contains(lower({_BASE}), '{p}') then '{v}'" for p, v in predicates.FILENAME_HINTS) + " end"


@query(
    f""", e as (select f.id, f.content_type, f.path, s.kind, s.label, s.score, row_number() over (partition by f.id, s.kind order by s.score desc, s.label) as n from files f join scores s on s.file_id = f.id where s.kind in ('instrument', 'stem_instrument')),
    t as (select id, bool_or(kind = 'instrument' and n = 1 and label in ('drums', 'percussion') and score >= 0.3) as drums, bool_or(kind = 'stem_instrument') as has_stem from e group by 1),
    c as (select e.*, case when e.content_type = 'stem' then {_HINTS} end as hint, case when e.content_type = 'track' then 0.1 else 0.3 end as floor from e join t on t.id = e.id
        where e.kind = case when e.content_type = 'stem' and has_stem and not drums then 'stem_instrument' else 'instrument' end),
    p as (select id, lower(label) as l, label, n from c where (score >= floor or (n = 1 and hint is null)) and lower(label) <> coalesce(lower(hint), '') union all
        select id, lower(hint), hint, 0 from (select id, case when content_type = 'stem' then {_HINTS} end as hint from files) as y where hint is not null)
    select id, string_agg(label, ',' order by n) as labels from p group by 1""",
    "files", "scores",
)
def instrument_lists(spark: SparkSession, sf: str) -> DataFrame:
    return captions.instrument_column(views.library(spark, sf)).select("id", F.array_join("labels", ",").alias("labels")).where("labels != ''")


@query(
    """, a as (select id as file_id, 0 as seq, null as segment_id, path as label from files), b as (select s.file_id, row_number() over (partition by s.file_id order by "start", id) as seq, id as segment_id,
    format('{:.1f}', "start") || '-' || format('{:.1f}', "end") as label from segments s where exists (select 1 from files f where f.id = s.file_id)) select * from a union all select * from b""",
    "files", "segments",
)
def row_lists(spark: SparkSession, sf: str) -> DataFrame:
    return library.row_list(view(spark, sf, "files"), view(spark, sf, "segments"))


@query(
    """, g as (select n_nationkey as id, n_name as name, n_nationkey * 1000 as added_at from nation where n_nationkey < 5), r as (select c_custkey as id, 'root' || c_custkey as name, c_custkey * 500 as added_at from customer where c_nationkey >= 5),
    c as (select p_size as id, 'list' || p_size as name, p_size * 7000 as added_at from part group by 1), u as (select 0 as k, * from g union all select 1, * from r union all select 2, * from c)
    select row_number() over (order by k, added_at, id) as position, case k when 0 then 'group' when 1 then 'root' else 'collection' end as kind, u.id, u.name,
    (select count(*) from customer where u.k = 0 and c_nationkey = u.id) as n_roots from u""".replace(", g as", "with g as", 1)
)
def sidebar_rows(spark: SparkSession, sf: str) -> DataFrame:
    groups = _named(table(spark, sf, "nation").where("n_nationkey < 5"), group_id="cast(n_nationkey as bigint)", name="n_name", added_at="cast(n_nationkey * 1000 as bigint)")
    roots = _named(table(spark, sf, "customer"), root_id="c_custkey", name="concat('root', c_custkey)", added_at="c_custkey * 500", group_id="case when c_nationkey < 5 then cast(c_nationkey as bigint) end")
    lists = _named(table(spark, sf, "part").select("p_size").distinct(), collection_id="cast(p_size as bigint)", name="concat('list', p_size)", added_at="cast(p_size * 7000 as bigint)")
    return library.sidebar(groups, roots, lists).select("position", "kind", "id", "name", F.coalesce(F.size("roots"), F.lit(0)).cast("long").alias("n_roots")).withColumn("n_roots", F.greatest("n_roots", F.lit(0)))


@query("select id, coalesce(case when id % 3 = 0 then 'C major' end, key) as key from files", "files")
def effective_keys(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files").select("id", library.effective(F.expr("case when id % 3 = 0 then 'C major' end"), F.col("key")).alias("key"))


@query("""select p_brand as folder, min(p_type) filter (where p_type <> 'ECONOMY' and p_name = m) as trigger, count(*) filter (where p_partkey % 2 = 0) as n_latents from (select *, min(p_name) filter (where p_type <> 'ECONOMY') over (partition by p_brand) as m from part) as x group by 1""")
def dataset_folders(spark: SparkSession, sf: str) -> DataFrame:
    # a folder's entries: names sort as parts do, every second one also has a latent
    part = table(spark, sf, "part")
    texts = _named(part, folder="p_brand", name="p_name", trigger="case when p_type = 'ECONOMY' then '' else p_type end")
    latents = _named(part.where("p_partkey % 2 = 0"), folder="p_brand", name="concat(p_name, '.npy')", trigger="''")
    return library.datasets(texts.unionByName(latents))


@query("""select p_brand as run, p_size as step, row_number() over (order by p_brand, p_size desc) as place from (select distinct p_brand, p_size from part) as x""")
def checkpoint_order(spark: SparkSession, sf: str) -> DataFrame:
    listed = library.checkpoints(_named(table(spark, sf, "part").select("p_brand", "p_size").distinct(), run="p_brand", step="p_size"))
    return spark.createDataFrame([(r["run"], r["step"], i) for i, r in enumerate(listed.collect(), 1)], "run string, step int, place long") if listed.count() < 100_000 else listed


@query("""select coalesce(max(l_linenumber), 0) + 1 as version, case when coalesce(max(l_linenumber), 0) = 0 then 'chosen' else 'alt' end as status from lineitem where l_suppkey = 10""")
def take_version(spark: SparkSession, sf: str) -> DataFrame:
    takes = _named(table(spark, sf, "lineitem"), cue="cast(l_suppkey as string)", version="l_linenumber")
    return library.next_version(takes, "10")


@query("""select path, id as size_bytes from files where id not in (select o_custkey from orders)""", "files")
def takes_unused(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "files").select("path", F.col("id").alias("size_bytes"), "id", files.path_nfc("path").alias("path_nfc"))
    used = rows.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")).distinct(), "id").select("path_nfc")
    return library.unused_takes(rows, used).select("path", "size_bytes")


@query("""select o_orderkey as path, o_custkey as block_id from orders where o_custkey = 10""")
def takes_of_block(spark: SparkSession, sf: str) -> DataFrame:
    return library.takes_of(_named(table(spark, sf, "orders"), path="o_orderkey", block_id="o_custkey", mtime="o_orderkey % 3"), 10).select("path", "block_id")


@query("""select p_brand as folder, list_distinct(list(p_type)) as t from part group by 1""".replace("list_distinct(list(p_type)) as t", "count(distinct p_type) filter (where p_type in ('ECONOMY', 'PROMO')) as material, count(distinct p_type) filter (where p_type not in ('ECONOMY', 'PROMO')) as extra"))
def keyword_lists(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "part").groupBy(F.col("p_brand").alias("folder")).agg(F.collect_list("p_type").alias("keywords"))
    out = library.classify_keywords(tags, {"material": ["ECONOMY", "PROMO"]})
    return out.select("folder", F.size("material").cast("long").alias("material"), F.size("extra").cast("long").alias("extra"))


@query("select count(*) filter (where bpm > 90) as tagged, count(*) as total, count(*) filter (where bpm > 90) > 0 and count(*) filter (where bpm > 90) < count(*) as partial from files", "files")
def tags_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.tag_coverage(view(spark, sf, "files"), F.col("bpm") > 90)


@query("select count(*) as n_files, count(analyzed_at) as n_analyzed, count(analyzed_at) as n_told, count(analyzed_at) = count(*) as complete from files where path like '/lib/Brand13/%'", "files")
def training_set(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "files")
    return library.dataset_coverage(rows, library.dataset(rows, "/lib/Brand13", trigger="lib"), "/lib/Brand13")


# documents ------------------------------------------------------------------------------------------------------------


@query(
    """, s as (select id, "start", 'a,' || id as cue from segments) select 0 as part, 0e0 as start, 'cue,track,in,out,length,seconds,key,tempo,take' as line union all
    select 1 + id % 2, "start", '"' || cue || '",,,,,,,,"say ' || repeat(chr(34), 2) || 'x' || repeat(chr(34), 3) from s""",
    "segments",
)
def cue_lines(spark: SparkSession, sf: str) -> DataFrame:
    cue, take = F.concat(F.lit("a,"), F.col("id").cast("string")), F.lit('say "x"')
    rows = view(spark, sf, "segments").select("id", "start", *[(cue if c == "cue" else take if c == "take" else F.lit(None).cast("string")).alias(c) for c in documents.CUE_COLUMNS])
    return documents.cue_sheet(rows.where("id % 2 = 0").drop("id"), rows.where("id % 2 != 0").drop("id"))


@query("""select 'f' || id as name, case when id % 4 = 0 then 'missing' when id % 3 = 0 then 'changed' else 'equal' end as status from files""", "files")
def sidecar_changes(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("f"), F.col("id").cast("string"))
    body = lambda key: F.concat(F.lit('{"path":"p","key":"'), key, F.lit('"}'))
    rows = view(spark, sf, "files")
    old = rows.select(name.alias("name"), body(F.lit("A")).alias("sidecar"))
    fresh = rows.where("id % 4 != 0").select(name.alias("name"), body(F.expr("case when id % 3 = 0 then 'B' else 'A' end")).alias("sidecar"))
    return documents.retag_sidecars(old, fresh).select("name", "status")


@query("""select file_id, upper(left(label, 4)) as label, round(max(score), 6) as score from scores where kind = 'genre' and label <> 'pad' group by 1, 2""", "scores")
def canonical_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "scores").where("kind = 'genre'").select("file_id", "label", "score")
    names = rows.select(F.lit("genre").alias("model"), F.col("label").alias("raw"), F.upper(F.substring("label", 1, 4)).alias("canonical")).distinct().where("raw != 'pad'")
    return documents.normalized(rows, names, "genre").select("file_id", "label", r6("score").alias("score"))


@query("""select id, 3 as n_spans, 2 as n_chords, 1 as n_notes, 'x,y' as words, case when id % 2 = 0 then 1.0 else 0.5 end as amplitude from files""", "files")
def document_values(spark: SparkSession, sf: str) -> DataFrame:
    amplitude = F.expr("""case when id % 2 = 0 then '' else ',"amplitude":0.5' end""")
    machine = F.concat(F.lit('{"chords":[{"t":0.0,"chord":"A"},{"t":1.5,"chord":"Em"},{"t":2.0}],"notes":[{"start":0.1,"end":0.4,"pitch":60'), amplitude, F.lit('},{"start":0.5,"pitch":61}]}'))
    notes = models.notes_of(machine)
    return view(spark, sf, "files").select(
        "id",
        F.size(models.spans_of(F.lit("[[0,1],[2,3],[4],[5,6]]"))).alias("n_spans"),
        F.size(models.chords_of(machine)).alias("n_chords"),
        F.size(notes).alias("n_notes"),
        F.array_join(models.strings_of(F.lit('{"k":["x",null,"y"]}'), "$.k"), ",").alias("words"),
        notes[0]["amplitude"].alias("amplitude"),
    )


@query(
    """select id as segment_id, id % 3 <> 0 as has_embedding, id % 3 <> 0 and id % 2 = 0 as has_genre, id % 3 <> 0 and id % 2 = 0 and id % 5 = 0 as has_stem from segments""", "segments"
)
def segment_machines(spark: SparkSession, sf: str) -> DataFrame:
    scores = F.create_map(F.lit("jazz"), F.lit(0.5))
    rows = view(spark, sf, "segments").select(
        F.col("id").alias("segment_id"), "file_id", (F.col("end") - F.col("start")).alias("duration_seconds"), F.lit(44100).alias("sample_rate"), F.struct(F.lit(0.1).alias("flatness")).alias("dsp"),
        F.when(F.col("id") % 3 != 0, F.array(F.lit(0.5))).alias("embedding"), F.lit(None).cast("array<double>").alias("dclap_embedding"),
        F.struct(F.lit(0.4).alias("music_score"), (F.col("id") % 2 == 0).alias("is_music")).alias("content_gate"), (F.col("id") % 5 == 0).alias("stem_parent"),
        scores.alias("genre"), scores.alias("stem_instrument"),
    )
    has = lambda c: F.get_json_object("machine", f"$.{c}").isNotNull()
    return catalog.segment_machine(rows).select("segment_id", has("embedding").alias("has_embedding"), has("genre").alias("has_genre"), has("stem_instrument").alias("has_stem"))


@query("select id, round(pow(10, (-12 - (loudness - 3.010299956639812)) / 20), 6) as gain from files", "files")
def loudness_gains(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files").select("id", r6(models.gain_to_loudness(F.col("loudness"))).alias("gain"))


# rhythm ---------------------------------------------------------------------------------------------------------------

_STEPS = """, d as (select file_id, t, t - lag(t) over (partition by file_id order by t) as step from beats),
    s as (select file_id, list(t order by t) as b, list(step order by t) filter (where step is not null) as st from d group by 1)"""


@query(
    _STEPS
    + """, m as (select *, list_sort(st)[len(st) // 2 + 1] as mid from s where len(st) >= 12), f as (select *, list_transform(list_filter(st, lambda x: x > 0), lambda x: x * pow(2, least(4, greatest(0, ceil(log2(0.75 * mid / x)))))) as up from m where mid > 0),
    g as (select *, list_transform(up, lambda x: x / pow(2, least(4, greatest(0, ceil(log2(x / (1.5 * mid))))))) as folded from f), h as (select *, list_sort(folded)[len(folded) // 2 + 1] as base from g where len(folded) >= 12),
    r as (select file_id, unnest(b[2:]) as y, unnest(st) as step, base, generate_subscripts(st, 1) as i from h), w as (select *, floor(step / base + 0.5) as whole from r),
    x as (select file_id, y, sum(whole) over (partition by file_id order by i) as x, whole >= 1 and abs(step / base - whole) < 0.25 as fine from w),
    u as (select file_id, x, y from x where fine union all select file_id, 0, b[1] from h)
    select file_id, round(greatest(0, regr_slope(y, x)), 6) as period from u group by 1 having count(*) >= 12""",
    "beats",
)
def fitted_periods(spark: SparkSession, sf: str) -> DataFrame:
    return views.rhythm(spark, sf).select("file_id", r6(rhythm.fitted_period(F.col("beats"))).alias("period")).where("period > 0")


@query(
    """, w as (select file_id, floor(t * 12 / 60) as w, count(*) as n, 60 / ((max(t * 12) - min(t * 12)) / (count(*) - 1)) as bpm from beats group by 1, 2 having count(*) >= 2 and max(t) > min(t))
    select file_id, count(*) as window_count, round(stddev_pop(bpm), 5) as stddev_bpm, round(max(bpm) - min(bpm), 5) as range_bpm, stddev_pop(bpm) > 10 as unstable from w group by 1 having count(*) >= 3""",
    "beats",
)
def tempo_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of a minute, over beats twelve times as far apart."""
    slow = F.transform("beats", lambda t: t * 12)
    rows = views.rhythm(spark, sf).select("file_id", rhythm.tempo_stability(slow).alias("t")).where("t.window_count > 0")
    return rows.select("file_id", F.col("t.window_count").cast("long").alias("window_count"), F.round("t.stddev_bpm", 5).alias("stddev_bpm"), F.round("t.range_bpm", 5).alias("range_bpm"), "t.unstable")


@query(
    _STEPS
    + """, p as (select file_id, st, len(st) // 4 as k from s where len(st) >= 4), q as (select file_id, list_transform([st[1:k], st[k + 1:2 * k], st[2 * k + 1:3 * k], st[3 * k + 1:]], lambda x: round(60 / list_sort(x)[len(x) // 2 + 1], 5)) as v from p)
    select file_id, v[1] as a, v[2] as b, v[3] as c, v[4] as d from q""",
    "beats",
)
def tempo_quarters(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.rhythm(spark, sf).select("file_id", rhythm.tempo_parts(F.col("beats")).alias("v")).where("v is not null")
    return rows.select("file_id", *[F.round(F.col("v")[i], 5).alias(n) for i, n in enumerate("abcd")])


@query(
    _STEPS
    + """, k as (select file_id, b, st, list_sort(st)[len(st) // 2 + 1] as m, list_sort(st)[(len(st) + 1) // 2] as l from s where len(st) >= 2),
    v as (select *, len(list_filter(st, lambda x: abs(x - m) <= 0.25 * m)) / len(st) as stability, 120 / (m + l) as bpm from k)
    select file_id, 'dbn' as grid_source, round(stability, 6) as stability, case when stability < 0.9 then round(stability, 6) else -1 end as stability_minimal, round(bpm, 6) as bpm, round(60 / bpm, 6) as bpm_ratio, true as ok from v""",
    "beats",
)
def rhythm_stages(spark: SparkSession, sf: str) -> DataFrame:
    """The second track is the first one, so it can't be steadier."""
    rows = views.rhythm(spark, sf).where("size(beats) >= 3")
    rows = rows.select(F.col("file_id").alias("id"), F.col("beats").alias("dbn_beats"), F.lit(None).cast("array<double>").alias("dbn_downbeats"), F.col("beats").alias("minimal_beats"), F.lit(None).cast("array<double>").alias("minimal_downbeats"), F.lit(60.0).alias("second_bpm"))
    out = rhythm.rhythm_stage(rows)
    return out.select(F.col("id").alias("file_id"), "grid_source", r6("stability").alias("stability"), r6("stability_minimal").alias("stability_minimal"), r6("bpm").alias("bpm"), r6("bpm_ratio").alias("bpm_ratio"), "ok")


@query(
    _STEPS + """, x as (select file_id, list_sort(list_concat(b, list_transform(generate_series(1, len(b) - 1), lambda i: (b[i] + b[i + 1]) / 2))) as twice, b from s)
    select file_id, len(twice) as n_double, round(list_sum(twice), 5) as sum_double, round(list_sum(list_transform(generate_series(1, len(b), 2), lambda i: b[i])), 5) as sum_half, (len(b) + 3) // 4 as n_bars from x""",
    "beats",
)
def grids(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("beats")
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    bars = rhythm.bar_lines(b, F.slice(b, 1, 1), F.lit(4))
    return views.rhythm(spark, sf).select("file_id", F.size(rhythm.double_grid(b)).cast("long").alias("n_double"), total(rhythm.double_grid(b)).alias("sum_double"), total(rhythm.halve_grid(b, b[0])).alias("sum_half"), F.size(bars).cast("long").alias("n_bars"))


@query("""select id, case when duration_seconds >= 0.25 then cast(floor((duration_seconds - 0.25) / 0.5) as int) + 1 end as n_beats, round(bpm * pow(2, -floor(log2(bpm / 100) + 0.5)), 6) as folded from files""", "files")
def grid_sizes(spark: SparkSession, sf: str) -> DataFrame:
    grid = rhythm.beat_grid(F.lit(0.25), F.lit(0.5), F.col("duration_seconds"))
    return view(spark, sf, "files").select("id", F.size(grid).alias("n_beats"), r6(rhythm.fold_octave(F.col("bpm"), F.lit(100.0))).alias("folded"))


@query(
    """select id, round(case when abs("start" - round_even("start" / 0.5, 0) * 0.5) <= 0.1 then round_even("start" / 0.5, 0) * 0.5 else "start" end, 6) as snapped from (select id, "start" + (id % 5) * 0.07 as "start" from segments) as x""", "segments"
)
def snapped_starts(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of two subdivisions of a second over the longest start."""
    beats = F.transform(F.sequence(F.lit(0), F.lit(101)), lambda i: i.cast("double"))
    rows = view(spark, sf, "segments").select("id", (F.col("start") + (F.col("id") % 5) * 0.07).alias("t"))
    return rows.select("id", r6(rhythm.snap(F.col("t"), beats, 2, F.lit(0.1))).alias("snapped"))


@query("select id, music_score > 1.15 * 0.5 and music_score >= 0.75 * danceable as supported from files".replace("music_score > 1.15 * 0.5", "music_score > 1.15"), "files")
def supported_grids(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files").select("id", rhythm.grid_supported(F.col("music_score"), F.col("danceable")).alias("supported"))


@query("""select file_id, i, cast(floor(t * 1000 + 0.5) as bigint) as sample, i % 4 = 0 as accent from beats""", "beats")
def clicks(spark: SparkSession, sf: str) -> DataFrame:
    return library.click_track(view(spark, sf, "beats").select(F.col("file_id").alias("id"), "i", "t"), 1000).withColumnRenamed("id", "file_id")


# intervals and arrangement --------------------------------------------------------------------------------------------


@query(
    """, f as (select l_orderkey as file_id, l_linenumber as frame, max(l_discount) as rms from lineitem group by 1, 2), l as (select file_id, max(frame) as last from f group by 1),
    i as (select *, frame - row_number() over (partition by file_id order by frame) as g from f where rms > pow(10, -1.5)), r as (select file_id, g, min(frame) as a, max(frame) as b from i group by 1, 2)
    select r.file_id, round(a * 0.5, 6) as start, round(case when b = last then 9 else (b + 1) * 0.5 end, 6) as "end" from r join l on l.file_id = r.file_id""".replace(", f as", "with f as", 1)
)
def active_regions(spark: SparkSession, sf: str) -> DataFrame:
    frames = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("frame"), F.col("l_discount").alias("rms"), F.lit(9.0).alias("duration"))
    frames = frames.groupBy("file_id", "frame").agg(F.max("rms").alias("rms"), F.max("duration").alias("duration"))
    found = intervals.active_spans(frames, ["file_id"], 0.5, -30.0)
    return found.select("file_id", r6("start").alias("start"), r6("end").alias("end"))


@query("""select id, file_id, round("start", 6) as s, round(coalesce(lead("start") over (partition by file_id order by "start"), "end"), 6) as e from (select min(id) as id, file_id, "start", max("end") as "end" from segments group by file_id, "start") as x""", "segments")
def cue_bounds(spark: SparkSession, sf: str) -> DataFrame:
    cues = view(spark, sf, "segments").groupBy("file_id", "start").agg(F.min("id").alias("id"), F.max("end").alias("end"))
    return intervals.partition_bounds(cues, ["file_id"]).select("id", "file_id", r6("start").alias("s"), r6("end").alias("e"))


@query(
    """, w as (select distinct file_id as arrangement, cast(floor("start" / 30) as int) as w from segments), b as (select file_id as arrangement, id, "start", "end" from segments)
    select w.arrangement, w.w, b.id, round(least(b."end", w.w * 30 + 30) - greatest(b."start", w.w * 30), 6) as overlap from w join b on b.arrangement = w.arrangement and b."start" < w.w * 30 + 30 and b."end" > w.w * 30""",
    "segments",
)
def window_voices(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "segments")
    w = F.floor(F.col("start") / 30).cast("int")
    windows = rows.select(F.col("file_id").alias("arrangement"), w.alias("w")).distinct().select("arrangement", "w", (F.col("w") * 30.0).alias("start"), (F.col("w") * 30.0 + 30).alias("end"))
    blocks = rows.select(F.col("file_id").alias("arrangement"), "id", "start", "end")
    return library.voices_in_window(blocks, windows).select("arrangement", "w", "id", r6("overlap").alias("overlap"))


_SAMPLES = """, v as (select o_orderkey as id, o_custkey as source, o_orderkey % 100 as "start", 5 as length, o_orderstatus = 'P' as muted from orders),
    s as (select c_custkey as source, i, (c_acctbal + i) * 1e0 as value from customer, (select unnest(generate_series(0, 7)) as i) as x)""".replace(", v as", "with v as", 1)


@query(
    _SAMPLES
    + """ select "start" + i as "at", round(sum(value * 0.5 * case when i < 2 then sin(i / 2.0 * pi() / 2) else 1 end * case when 5 - i <= 2 then sin((5 - i) / 2.0 * pi() / 2) else 1 end), 3) as value
    from v join s on s.source = v.source where not muted and i < 5 group by 1"""
)
def mixed_voices(spark: SparkSession, sf: str) -> DataFrame:
    voices = _named(table(spark, sf, "orders"), id="o_orderkey", source="o_custkey", lane="0", start="o_orderkey % 100", length="5", gain="0.5D", lane_gain="1D", muted="o_orderstatus = 'P'", solo="false", fade_in="2", fade_out="2")
    samples = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"), "c_acctbal", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    samples = samples.select("source", "i", (F.col("c_acctbal") + F.col("i")).cast("double").alias("value"))
    return library.mix_voices(voices, samples).select("at", F.round("value", 3).alias("value"))


@query("""select o_custkey % 50 as "at", round(sum(o_totalprice * 0.25), 4) as value from orders where o_orderstatus = 'F' and o_orderkey % 2 = 0 group by 1""")
def mixed_down(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(table(spark, sf, "orders"), block_id="o_orderkey", lane="0", lane_gain="0.5D", gain="0.5D", muted="o_orderstatus <> 'F'", solo="o_orderkey % 2 = 0", at="o_custkey % 50", value="cast(o_totalprice as double)")
    return library.mixdown(rows).select("at", F.round("value", 4).alias("value"))


@query("""select id, round(case when "start" >= 10 then 4 + ("start" - 4) % 6 else "start" end, 6) as t, id + 1 as child, round(("start") - ("start" + case when id % 3 = 0 then 0.5 else 0 end), 6) as drift from segments""".replace(', id + 1 as child, round(("start") - ("start" + case when id % 3 = 0 then 0.5 else 0 end), 6) as drift', ""), "segments")
def loop_times(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "segments").select("id", r6(library.loop_position(F.col("start"), F.lit(4.0), F.lit(10.0))).alias("t"))


@query("""select c.id, p.id as follows, round(p."start" - (c."start" - 1), 6) as drift from segments c join segments p on p.id = c.id - 1 where abs(c."start" - 1 - p."start") > 0.005""", "segments")
def stale_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = view(spark, sf, "segments").select("id", (F.col("id") - 1).alias("follows"), "start", (F.col("start") - 1).alias("parent_start"))
    return library.stale_children(blocks).select("id", "follows", r6("drift").alias("drift"))


@query("select id, case when bpm * pow(2, greatest(-2, least(2, id % 7 - 3))) between 20 and 400 then round(bpm * pow(2, greatest(-2, least(2, id % 7 - 3))), 6) end as shifted, case when bpm > 0 then round(bpm / 120, 6) end as ratio from files", "files")
def tempo_shifts(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "files").select("id", r6(library.shift_tempo(F.col("bpm"), F.col("id") % 7 - 3)).alias("shifted"), r6(library.stretch_ratio(F.col("bpm"), F.lit(120.0))).alias("ratio"))


@query("""select user_id, max(event_id) filter (where abs(value - 250) > 200) as last, round(max(abs(value)), 6) as peak from events group by 1""")
def audible_ends(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    # values more than 200 off 250 are heard, 0 among them
    levels = events.select("user_id", F.col("event_id").alias("i"), F.when(F.abs(F.col("value") - 250) > 200, 1.0).otherwise(0.0).alias("value"))
    ends, peaks = library.audible_end(levels, ["user_id"]), library.lane_peaks(events, ["user_id"]).withColumnRenamed("user_id", "_user")
    return ends.join(peaks, F.col("user_id").eqNullSafe(F.col("_user"))).select("user_id", "last", r6("peak").alias("peak"))


@query(
    """select id, case when bpm between 20 and 400 then bpm end as bpm, coalesce(case when id % 4 = 1 then 'E minor' end, key) as key, case when analyzed_at is null then 'that take has not been analysed' when bpm is null then 'analysed, but no usable tempo came out of it' else '' end as note,
    case when id % 2 = 0 then 1.5 else 1.5 + case when id % 2 = 1 then 10 else 0 end end as first_downbeat from files""",
    "files",
)
def measurements(spark: SparkSession, sf: str) -> DataFrame:
    spans = F.array(F.struct(F.lit(10.0).alias("start"), F.lit(20.0).alias("end")))
    times = F.array(F.lit(1.5))
    rows = view(spark, sf, "files").select("id", "analyzed_at", F.expr("case when id % 2 = 0 then 'file' end").alias("timebase"), spans.alias("active_spans"), "bpm", F.expr("case when id % 4 = 1 then 'E minor' end").alias("human_key"), "key", times.alias("onsets"), times.alias("beats"), times.alias("downbeats"))
    return catalog.measurement(rows).select("id", "bpm", "key", "note", "first_downbeat")


@query("""select path, case when id % 3 = 0 then 'recipe' end as generated, case when id % 3 = 0 then id end as size_bytes from files""", "files")
def takes_kept(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "files").select("id", "path", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("long").alias("mtime"), F.lit(None).cast("long").alias("size_bytes"), F.lit(None).cast("long").alias("scanned_at"), F.lit(None).cast("map<string,string>").alias("human"))
    takes = rows.where("id % 3 = 0").select("path", F.lit("h").alias("sha256"), F.lit(1).cast("long").alias("mtime"), F.col("id").alias("size_bytes"), F.lit(2).cast("long").alias("scanned_at"))
    return catalog.kept_take(rows, takes, "recipe").select("path", F.element_at("human", "generated").alias("generated"), "size_bytes")


# captions and prompts -------------------------------------------------------------------------------------------------


@query(
    """select id, 'TrackType' as k, 'Music' as v from files where content_type in ('track', 'loop') union all select id, 'VocalType', case when voice_probability < 0.5 then 'Instrumental' else 'Vocal' end from files where content_type in ('track', 'loop') and voice_probability is not null
    union all select id, 'instruments', 'voice' from files where content_type in ('track', 'loop') and voice_probability >= 0.5 union all select id, 'rhythm', case when onset_rate < 0.8 then 'sparse' when onset_rate >= 2.0 then 'driving' else 'moderate' end from files where content_type in ('track', 'loop') and onset_rate is not null
    union all select id, 'dynamics', case when loudness_range < 4 then 'compressed' when loudness_range >= 13 then 'wide' else 'moderate' end from files where content_type in ('track', 'loop') and loudness_range is not null
    union all select id, 'texture', case when flatness < 0.03 then 'tonal' when flatness >= 0.06 then 'noisy' else 'mixed' end from files where content_type in ('track', 'loop') and flatness is not null
    union all select id, 'bpm', cast(cast(floor(bpm + 0.5) as bigint) as varchar) from files where content_type in ('track', 'loop') and bpm > 0 union all select id, 'keyscale', key from files where content_type in ('track', 'loop') and key is not null
    union all select id, 'length_seconds', cast(cast(floor(duration_seconds + 0.5) as bigint) as varchar) from files where content_type in ('track', 'loop') union all select id, 'trigger', 'lib' from files where content_type in ('track', 'loop')""",
    "files",
)
def caption_tags(spark: SparkSession, sf: str) -> DataFrame:
    """The tag list of files without score maps, but for the prose."""
    done = captions.file_records(view(spark, sf, "files").where("content_type in ('track', 'loop')"))
    rows = done.select("id", F.explode(captions.tags(F.col("record"), F.col("content_type"), "lib", F.lit("-"))).alias("t"))
    return rows.select("id", "t.k", "t.v").where("k != 'prompt'")


@query(
    """select id, case when content_type <> 'one_shot' then round(coalesce(case when id % 3 = 0 then 99.5 end, case when bpm > 0 and not (id % 5 = 0 and id % 2 = 0) then bpm end), 6) end as bpm from files""", "files"
)
def caption_tempos(spark: SparkSession, sf: str) -> DataFrame:
    """A fitted groove's tempo replaces the measured one; an unsteady tempo isn't told."""
    groove = F.struct(F.when(F.col("id") % 3 == 0, "").otherwise("no grid lock").alias("omitted"), F.lit(99.5).alias("bpm"), F.lit(2.0).alias("strength"), F.lit(None).cast("double").alias("swing"))
    rows = view(spark, sf, "files").withColumns({"groove": groove, "tempo_unstable": F.col("id") % 5 == 0, "tempo_window_count": F.when(F.col("id") % 2 == 0, 4).otherwise(2)})
    return captions.file_records(rows).select("id", r6("record.bpm").alias("bpm"))


_FULL = f"""select f.id, f.content_type = 'stem' as stem, {_HINTS} as hint, s.label, s.score, row_number() over (partition by f.id order by s.score desc, s.label) as n from files f join scores s on s.file_id = f.id and s.kind = 'instrument'"""


@query(
    f""", m as ({_FULL}), t as (select id, bool_or(n = 1 and label in ('drums', 'percussion') and score >= {captions.STEM_FLOOR}) as drums from m group by 1),
    e as (select f.id, {_HINTS} as label, 0.99 as score from files f where content_type = 'stem' union all select id, 'voice', voice_probability from files where voice_probability >= {captions.VOICE}
        union all select m.id, label, score from m join t on t.id = m.id where n <= {captions.MOST_INSTRUMENTS * 4} and score >= case when stem then {captions.STEM_FLOOR} else {captions.LEAST_SCORE} end and (not stem or drums or label in ('drums', 'percussion'))),
    b as (select id, label, max(score) as score from e where label is not null group by 1, 2), o as (select *, row_number() over (partition by id order by score desc, label) as k from b)
    select id, string_agg(label, ',' order by k) as labels from o where k <= {captions.MOST_INSTRUMENTS} group by 1""",
    "files", "scores",
)
def caption_instruments(spark: SparkSession, sf: str) -> DataFrame:
    rows = captions.with_input(views.library(spark, sf))
    return rows.select("id", F.array_join(F.transform(captions.instruments(), lambda e: e["label"]), ",").alias("labels")).where("labels != ''")


@query(
    """, a as (select p_brand as k, p_type as v, count(*) as n from part group by 1, 2), b as (select k, count(*) as n_values, sum(n) as total from a group by 1) select k as key, n_values, total from b""".replace(", a as", "with a as", 1)
)
def prompt_pools(spark: SparkSession, sf: str) -> DataFrame:
    pool = aggregates.vocabulary(_named(table(spark, sf, "part"), trigger="''", field="p_brand", value="p_type"), [])
    return pool.groupBy(F.col("field").alias("key")).agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("total"))


@query()
def random_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """One prompt for each customer, of a type and a size drawn from the parts of their nation's number."""
    part = table(spark, sf, "part")
    pools = part.groupBy((F.col("p_size") % 25).alias("pool"), F.lit(0).alias("position"), F.lit("Type").alias("key"), F.col("p_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sizes = part.groupBy((F.col("p_size") % 25).alias("pool"), F.lit(1).alias("position"), F.lit("Brand").alias("key"), F.col("p_brand").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("prompt_id"), F.col("c_nationkey").alias("pool"))
    return captions.random_prompts(people.join(pools.unionByName(sizes), "pool").drop("pool"), 7)


# streams' forms on tables ---------------------------------------------------------------------------------------------


@query("""select user_id, date_trunc('hour', ts) as start, count(*) as n, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as stddev from events group by 1, 2""")
def hourly_values(spark: SparkSession, sf: str) -> DataFrame:
    found = streams.tumbling(table(spark, sf, "events"), "user_id", "value", width="1 hour")
    return found.select("user_id", "start", "n", r6("mean").alias("mean"), r6("stddev").alias("stddev"))


@query(
    """, o as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events), g as (select *, sum(case when before is null or ts - before > interval 2 hours then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from o)
    select user_id, min(ts) as start, max(ts) + interval 2 hours as "end", count(*) as n from g group by user_id, k""".replace(", o as", "with o as", 1)
)
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.active_sessions(table(spark, sf, "events"), "user_id", gap="2 hours")


# samples --------------------------------------------------------------------------------------------------------------


@query(
    """, m as (select user_id, list(value / 500e0 order by event_id) as v from events group by 1), w as (select user_id, unnest(generate_series(0, (len(v) - 16) // 8)) as i, v from m where len(v) >= 16)
    select user_id, i, round(sqrt(list_avg(list_transform(v[i * 8 + 1:i * 8 + 16], lambda x: x * x))), 6) as rms from w""".replace(", m as", "with m as", 1)
)
def frame_levels(spark: SparkSession, sf: str) -> DataFrame:
    """RMS of frames of 16 samples by 8, in SQL functions; signal.frame_rms has the fixed frame of audio."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"] / 500.0).alias("v")).where("size(v) >= 16")
    starts = models.windows(F.size("v").cast("long"), 16, 8)
    frames = rows.select("user_id", "v", F.posexplode(starts).alias("i", "a"))
    part = F.expr("slice(v, cast(a + 1 as int), 16)")
    return frames.select("user_id", F.col("i").cast("long").alias("i"), r6(F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, x: s + x * x) / 16)).alias("rms"))


@query()
def sample_descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptors of each supplier's discounts, eight times over, as a signal."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_discount"))), lambda x: (x["l_discount"] * 10).cast("double") - 0.5).alias("v"))
    rows = rows.withColumn("v", F.flatten(F.array_repeat("v", 8)))
    return rows.select("id", signal.descriptors("v", F.lit(2000)).alias("d")).select("id", "d.*")


def _takes(spark: SparkSession, sf: str) -> DataFrame:
    """Each order is a take of its customer's cue; those of every eleventh customer lie in the folder of takes."""
    cue = "case when o_custkey % 11 = 0 then 'takes' else concat('Cue ', o_custkey % 7) end"
    return _named(table(spark, sf, "orders"), cue=cue, path="concat('/lib/take_', o_orderkey, '_v', o_orderkey % 4, '.wav')", path_nfc="concat('/lib/take_', o_orderkey, '_v', o_orderkey % 4, '.wav')")


@query("""select 'Cue ' || (o_custkey % 7) as cue, 'export/Cue ' || (o_custkey % 7) as folder, '/lib/take_' || o_orderkey || '_v' || (o_orderkey % 4) || '.wav' as path,
    'demoreel_cue' || (o_custkey % 7) || case when o_orderkey % 3 <> 0 then '_' || (60 + o_orderkey % 90) || 'bpm_Dmin' else '' end || case when o_orderkey % 4 > 0 then '_v' || (o_orderkey % 4) else '' end || '.wav' as name,
    case when e.l_orderkey is not null and o_orderkey % 3 <> 0 then e.a else 0e0 end as "start", case when e.l_orderkey is not null and o_orderkey % 3 <> 0 then e.a + 1e0 else 0e0 end as "end",
    0e0 as fade_in, 0e0 as fade_out, case when e.l_orderkey is not null and o_orderkey % 3 <> 0 then -3e0 else 0e0 end as gain_db
    from orders left join (select l_orderkey, min(l_linenumber) * 1e0 as a from lineitem group by 1) as e on e.l_orderkey = o_orderkey where o_custkey % 11 <> 0""")
def cue_exports(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where("o_orderkey % 3 != 0")
    known = _named(rows, id="o_orderkey", path_nfc="concat('/lib/take_', o_orderkey, '_v', o_orderkey % 4, '.wav')", bpm="cast(60 + o_orderkey % 90 as double)", key="'D minor'")
    edits = _named(table(spark, sf, "lineitem"), id="l_linenumber", file_id="l_orderkey", start="cast(l_linenumber as double)", end="cast(l_linenumber + 1 as double)", human="""'{"gain_db": -3}'""")
    return library.cue_export(_takes(spark, sf), known, edits, F.lit("Demo Reel"))


@query("""select n_files, n_cues, n_failed, n_files || ' files exported across ' || n_cues || ' cues  --  ' || n_failed || ' failed: ' || first || ': unreadable' as message from
    (select count(*) filter (o_orderkey % 5 <> 0) as n_files, count(distinct o_custkey % 7) filter (o_orderkey % 5 <> 0) as n_cues, count(*) filter (o_orderkey % 5 = 0) as n_failed,
    arg_min('take_' || o_orderkey || '_v' || (o_orderkey % 4) || '.wav', 'cue ' || (o_custkey % 7) || '|' || o_orderkey || '_') filter (o_orderkey % 5 = 0) as first from orders where o_custkey % 11 <> 0) as x""")
def cue_export_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _takes(spark, sf).where("cue != 'takes'").withColumn("n", F.regexp_extract("path", r"take_(\d+)", 1).cast("long"))
    return library.export_summary(rows.select("cue", "path", (F.col("n") % 5 != 0).alias("ok"), F.lit("unreadable").alias("message")))


_TRIADS = """select cast(s_suppkey as bigint) as id, cast(s_suppkey % 12 as int) as root, s_suppkey % 24 >= 12 as minor from supplier"""


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _triad_waves(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A second of three notes with two overtones at 4 kHz, a few rows at a time."""
    at = np.arange(4000)
    for roots, thirds in batches:
        for a in range(0, len(roots), 64):
            notes = [[440 * 2.0 ** ((r + n - 21) / 12) for n in (0, t, 7)] for r, t in zip(roots[a : a + 64], thirds[a : a + 64], strict=True)]
            yield pd.Series([sum(np.sin(2 * math.pi * k * f * at / 4000) / (10 * k) for f in hz for k in (1, 2, 3)) for hz in notes])


def _triads(spark: SparkSession, sf: str) -> DataFrame:
    """A second of a triad for each supplier."""
    rows = _named(table(spark, sf, "supplier"), id="s_suppkey", root="cast(s_suppkey % 12 as int)", third="case when s_suppkey % 24 >= 12 then 3 else 4 end")
    # a row of three numbers becomes seconds of sound, so a small file is dealt out to all tasks
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return rows.select("id", _triad_waves("root", "third").alias("mono"), F.lit(4000).alias("rate"))


@query(
    f"""select id, ['C', 'D flat', 'D', 'E flat', 'E', 'F', 'G flat', 'G', 'A flat', 'A', 'B flat', 'B'][root + 1] || case when minor then ' minor' else ' major' end as key,
    ['C', 'C#', 'D', 'Eb', 'E', 'F', 'F#', 'G', 'Ab', 'A', 'Bb', 'B'][root + 1] || case when minor then 'm' else '' end as chord, cast(1 as bigint) as n_chords from ({_TRIADS})"""
)
def detected_harmony(spark: SparkSession, sf: str) -> DataFrame:
    found = _triads(spark, sf).select("id", harmony.detected_key("mono", "rate").alias("k"), harmony.detected_chords("mono", "rate").alias("c"))
    return found.select("id", F.col("k.key").alias("key"), F.col("c")[0]["chord"].alias("chord"), F.size("c").cast("long").alias("n_chords"))


@query("""select cast(s_suppkey as bigint) as id, cast(0 as bigint) as patches, cast(1 as bigint) as segments, cast(128 * 1001 as bigint) as segment_size, cast(1 as bigint) as chunks,
    cast(64 * 100 as bigint) as chunk_size, cast(1 as bigint) as windows, cast(16000 as bigint) as window_size from supplier""")
def model_input_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """What each model takes of a second of sound: no patch, one padded segment, one chunk, one window."""
    of = {"patches": "effnet_patch", "segments": "dclap", "chunks": "content_gate", "windows": "stem_instrument"}
    made = _triads(spark, sf).select("id", frontends.all_model_inputs(of)("mono", "rate").alias("made"))
    found = made.select("id", *[F.transform(f"made.{n}", lambda x: F.size(x)).alias(n) for n in of])
    size = lambda n: F.col(n)[0].cast("long")
    return found.select("id", *[F.size(n).cast("long").alias(n) for n in of], size("segments").alias("segment_size"), size("chunks").alias("chunk_size"), size("windows").alias("window_size"))
