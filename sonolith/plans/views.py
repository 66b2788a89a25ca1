"""A media library laid over the driver's tables. Each view is one SQL text that Spark and the oracle both read, so queries and their oracles start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "files": """
select cast(p_partkey as bigint) as id,
  concat('/lib/', replace(p_brand, '#', ''), case when p_partkey % 6 = 0 then '/STEMS/' else '/takes/' end, replace(p_name, ' ', '_'),
    case p_partkey % 5 when 0 then '_120bpm_Am' when 1 then '_MIX' when 2 then '_vox_F#maj' when 3 then '_bass' else '' end,
    '_', cast(p_partkey as string), '.wav') as path,
  case p_type when 'ECONOMY' then 'one_shot' when 'PROMO' then 'loop' when 'STANDARD' then 'stem' when 'LARGE' then 'stem' else 'track' end as content_type,
  p_size * 1.25e0 as duration_seconds,
  case when p_partkey % 7 = 0 then null else 60e0 + p_partkey % 80 + p_size * 0.25e0 end as bpm,
  case p_partkey % 4 when 0 then 'A minor' when 1 then 'D flat major' when 2 then null else 'F major' end as key,
  -8e0 - p_size * 0.5e0 as loudness,
  (p_partkey % 100) * 0.01e0 as danceable,
  (p_partkey % 50) * 0.02e0 as harmonicity,
  p_retailprice * 3e0 as centroid,
  (p_partkey % 13) * 0.5e0 as crest,
  (p_partkey % 20) * 0.05e0 as music_score,
  case when p_partkey % 3 = 0 then null else (p_partkey % 10) * 0.1e0 end as voice_probability,
  (p_partkey % 30) * 0.1e0 as onset_rate,
  case when p_partkey % 11 = 0 then null else (p_partkey % 17) * 1e0 end as loudness_range,
  (p_size % 10) * 0.01e0 as flatness,
  case when p_partkey % 9 = 0 then null else 1700000000 + p_partkey end as analyzed_at
from {part}""",
    "scores": """
select l_partkey as file_id,
  case l_linenumber % 4 when 0 then 'genre' when 1 then 'instrument' when 2 then 'stem_instrument' else 'mood' end as kind,
  case l_suppkey % 10 when 0 then 'drums' when 1 then 'piano' when 2 then 'synthesizer' when 3 then 'violin' when 4 then 'Electronic---Techno'
    when 5 then 'Jazz---Bop' when 6 then 'pad' when 7 then 'percussion' when 8 then 'dark' else 'voice' end as label,
  max(l_discount * 5e0) as score
from {lineitem} group by 1, 2, 3""",
    "segments": """
select o_orderkey as id, o_custkey as file_id, (o_orderkey % 40) * 2.5e0 as "start", (o_orderkey % 40) * 2.5e0 + 1e0 + (o_orderkey % 7) * 3.5e0 as "end",
  case when o_orderstatus = 'F' then 'manual' else 'auto' end as source,
  case when o_orderpriority = '5-LOW' then '{{}}' else '{{"genre":["x"]}}' end as human
from {orders}""",
    "spans": """
select l_partkey as file_id, l_suppkey as stem, l_quantity * 2e0 + l_linenumber * 0.25e0 as "start",
  l_quantity * 2e0 + l_linenumber * 0.25e0 + 0.5e0 + l_tax * 40e0 as "end"
from {lineitem}""",
    "beats": """
select user_id as file_id, cast(n as bigint) as i, n * 0.5e0 + (event_id % 7) * 0.01e0 as t, value
from (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from {events}) as x""",
    "onsets": """
select user_id as file_id, n * 0.25e0 + (event_id % 4) * 0.02e0 + d as t
from (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from {events}) as x
cross join (select 0.51e0 as d union all select 0.64e0 as d) as y""",
    "defaults": """
select concat('/lib/Brand', cast(p_size as string), case when p_size % 2 = 0 then '/STEMS' else '' end) as folder_path, min(p_name) as genre
from {part} where p_size < 26 group by 1""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    places = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(VIEWS[name].replace('"start"', "`start`").replace('"end"', "`end`").format(**places))


def oracle(body: str, *names: str) -> str:
    """Oracle SQL over some views."""
    places = {t: t for t in TABLES}
    heads = ", ".join(f"{n} as ({VIEWS[n].format(**places)})" for n in names)
    return f"with {heads} {body}" if names else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their score maps genre, instrument, stem_instrument and mood."""
    scores = view(spark, sf_dir, "scores")
    maps = scores.groupBy("file_id").pivot("kind", ["genre", "instrument", "stem_instrument", "mood"]).agg(F.map_from_entries(F.collect_list(F.struct("label", "score"))))
    return view(spark, sf_dir, "files").join(maps, F.col("id") == F.col("file_id"), "left").drop("file_id")


def rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, beats, onsets as arrays."""
    beats = view(spark, sf_dir, "beats").groupBy("file_id").agg(F.array_sort(F.collect_list("t")).alias("beats"))
    onsets = view(spark, sf_dir, "onsets").groupBy("file_id").agg(F.array_sort(F.collect_list("t")).alias("onsets"))
    return beats.join(onsets, "file_id")
