"""Changes to tables as new snapshots: upserts, JSON merge patches, segment edits, set-like inserts and undo.

Parquet tables are immutable, so each operator returns the table as it is after the change; write_snapshot() stores it in a
numbered folder and moves a pointer, so readers see the old or the new one and undo is a move back.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order value; of several, the one whose other columns, as JSON, come last."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    by = Window.partitionBy(*keys).orderBy(F.desc(order), *([F.to_json(F.struct(*rest)).desc()] if rest else []))
    return rows.withColumn("_at", F.row_number().over(by)).where("_at = 1").drop("_at")


def numbered_rows(rows: DataFrame, bucket: Column, name: str, *order: str) -> DataFrame:
    """Numbers rows from 1 in an order whose first part is the bucket: inside each bucket, after the sums of the buckets before. Only the table of
    buckets, one row for each, is ordered as a whole."""
    marked = rows.withColumn("_bucket", bucket)
    inside = marked.withColumn(name, F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(F.col("_bucket").alias("_of")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_bucket", F.col("_of"))
    sums = sums.withColumn("_skip", F.coalesce(F.sum("_rows").over(before), F.lit(0))).select("_of", "_skip")
    both = inside.join(sums, F.col("_bucket").eqNullSafe(F.col("_of")))
    return both.withColumn(name, F.col(name) + F.col("_skip")).drop("_bucket", "_of", "_skip")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Inserts new keys and sets `columns` of known ones; other columns of known rows stay, those of new rows are null."""
    marked = changes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_changed"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    both = table.withColumn("_known", F.lit(True)).join(marked, on, "full_outer")
    out = []
    for c in table.columns:
        if c in keys:
            out.append(F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_k_{c}")).alias(c))
        elif c in columns:
            out.append(F.when(F.col("_changed"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def upsert_scanned(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """A scan sets hash, time, size and scan time by path, and touches no document."""
    return upsert(files, scanned, ["path"], ["sha256", "mtime", "size_bytes", "scanned_at"])


def merge_patch(target: dict | None, patch: object) -> object:
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = merge_patch(out.get(key), value)
    return out


@F.pandas_udf(T.StringType())
def json_merge_patch(target: pd.Series, patch: pd.Series) -> pd.Series:
    """RFC 7396 on JSON texts; a null patch changes nothing."""
    return pd.Series([t if p is None else json.dumps(merge_patch(json.loads(t) if t else {}, json.loads(p)), separators=(",", ":"), ensure_ascii=False) for t, p in zip(target, patch, strict=True)])


def patch_map(target: Column, patch: Column) -> Column:
    """The same for one level of MAP columns: null values of the patch delete."""
    kept = F.map_filter(target, lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, F.map_filter(patch, lambda _, v: v.isNotNull()))


def apply_analysis(files: DataFrame, results: DataFrame) -> DataFrame:
    """results(id, content_type, group_id, active_ratio, machine, provenance, analyzed_at): values that aren't null replace, `machine` is merged,
    provenance is replaced; a declared type keeps its source, a routed one becomes router's."""
    new = results.select(*[F.col(c).alias(f"_n_{c}") for c in results.columns])
    both = files.join(new, F.col("id") == F.col("_n_id"), "left")
    pick = lambda c: F.coalesce(f"_n_{c}", c).alias(c)
    found = F.col("_n_id").isNotNull()
    own = {
        "content_type": pick("content_type"),
        "content_type_source": F.when(found & F.col("_n_content_type").isNotNull() & (F.col("content_type_source") != "declared"), "router").otherwise(F.col("content_type_source")).alias("content_type_source"),
        "group_id": pick("group_id"),
        "active_ratio": pick("active_ratio"),
        "machine": F.when(found, json_merge_patch("machine", "_n_machine")).otherwise(F.col("machine")).alias("machine"),
        "provenance": pick("provenance"),
        "analyzed_at": pick("analyzed_at"),
    }
    return both.select(*[own.get(c, F.col(c)) for c in files.columns])


def set_key(document: Column, key: str, value: Column) -> Column:
    """Sets one key of a MAP; the others stay."""
    return F.map_concat(F.map_filter(document, lambda k, _: k != key), F.create_map(F.lit(key), value))


def clear_key(document: Column, key: str) -> Column:
    return F.map_filter(document, lambda k, _: k != key)


def declare_stem(files: DataFrame, chosen: Column) -> DataFrame:
    return files.withColumn("content_type", F.when(chosen, "stem").otherwise(F.col("content_type"))).withColumn("content_type_source", F.when(chosen, "declared").otherwise(F.col("content_type_source")))


def move_paths(files: DataFrame, old: str, new: str) -> DataFrame:
    """Moves a folder: paths below it get the new prefix."""
    inside = (F.col("path") == old) | F.startswith("path", F.lit(old + "/"))
    return files.withColumn("path", F.when(inside, F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 20))).otherwise(F.col("path")))


def add_segments(segments: DataFrame, new: DataFrame) -> DataFrame:
    """Adds segments; rows without an id get the next ids in order of start. Just one of file and group must be given."""
    wrong = new.where(F.col("file_id").isNull() == F.col("group_id").isNull())
    if not wrong.isEmpty():
        raise ValueError("a segment belongs to a file or to a group")
    top = segments.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first()["top"]
    minute = F.floor(F.col("start") / 60)
    placed = numbered_rows(new.where("id is null"), minute, "_n", "start", "end", "file_id", "group_id")
    numbered = placed.withColumn("id", F.col("_n") + F.lit(top).cast("long")).drop("_n")
    return segments.unionByName(new.where("id is not null")).unionByName(numbered)


def delete_segments(segments: DataFrame, analysis: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Segments without the deleted ones, and analyses without theirs."""
    dead = segments.where(gone).select(F.col("id").alias("segment_id"))
    return segments.where(~F.coalesce(gone, F.lit(False))), analysis.join(dead, "segment_id", "left_anti")


def untouched() -> Column:
    """Automatic segments that nobody has tagged."""
    return (F.col("source") == "auto") & (F.regexp_replace("human", r"\s", "") == "{}")


def insert_or_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rows whose key is new; of several with one key the smallest."""
    columns = [c for c in table.columns if c not in keys]
    rows = new.groupBy(*keys).agg(F.min(F.struct(*columns)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in columns]) if columns else new.select(*keys).distinct()
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti"))


def upsert_vectors(vectors: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """Replaces vectors by file; those of another length are left out silently."""
    fine = new.where(F.size("v") == dimension)
    return vectors.join(fine.select("file_id"), "file_id", "left_anti").unionByName(fine.select(*vectors.columns))


def set_setting(settings: DataFrame, key: str, value: str | None) -> DataFrame:
    """Sets a setting; null erases it."""
    rest = settings.where(F.col("key") != key)
    if value is None:
        return rest
    return rest.unionByName(settings.sparkSession.createDataFrame([(key, value)], "key string, value string"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def same_name(column: str, name: str) -> Column:
    """Equality without regard to ASCII case; other letters must be the same."""
    return F.translate(F.col(column), UPPER, LOWER) == name.translate(str.maketrans(UPPER, LOWER))


def rename_nocase(groups: DataFrame, old: str, new: str) -> DataFrame:
    """Renames a group found without regard to ASCII case."""
    return groups.withColumn("name", F.when(same_name("name", old), new).otherwise(F.col("name")))


def create_group(groups: DataFrame, name: str, added_at: int) -> DataFrame:
    """Adds a group with the next id, unless one of that name is there (without regard to ASCII case)."""
    if not groups.where(same_name("name", name)).isEmpty():
        return groups
    top = groups.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("top")).first()["top"]
    return groups.unionByName(groups.sparkSession.createDataFrame([(top + 1, name, added_at)], "group_id long, name string, added_at long"))


def find_group(groups: DataFrame, name: str) -> DataFrame:
    return groups.where(same_name("name", name))


def add_members(members: DataFrame, new: DataFrame) -> DataFrame:
    """Adds (collection_id, file_id, added_at); who is a member stays as they are."""
    return insert_or_ignore(members, new.select(*members.columns), ["collection_id", "file_id"])


def remove_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone.select("collection_id", "file_id"), ["collection_id", "file_id"], "left_anti")


def ungroup(groups: DataFrame, roots: DataFrame, group_id: int) -> tuple[DataFrame, DataFrame]:
    """Deletes a group; its roots stay, ungrouped."""
    return groups.where(F.col("group_id") != group_id), roots.withColumn("group_id", F.when(F.col("group_id") != group_id, F.col("group_id")))


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What undo has to restore: key and whether it was added, removed or changed."""
    digest = lambda df: df.select(F.col(key), F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).alias("_h"))
    a, b = digest(before), digest(after).withColumnsRenamed({key: "_k", "_h": "_g"})
    both = a.join(b, a[key] == b["_k"], "full_outer")
    status = F.when(F.col(key).isNull(), "added").when(F.col("_k").isNull(), "removed").when(F.col("_h") != F.col("_g"), "changed")
    return both.select(F.coalesce(key, "_k").alias(key), status.alias("status")).where("status is not null")


def write_snapshot(table: DataFrame, root: str, version: int) -> str:
    """Writes a version of a table beside the others."""
    path = f"{root}/v{version:08d}"
    table.write.parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/v{version:08d}")
