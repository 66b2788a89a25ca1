"""Exact nearest neighbours and top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions of the vector spaces.
DIMENSIONS = {"effnet": 1280, "dclap": 512, "timbre": 13, "spectrum": 2}


def distances(vectors: DataFrame, query: list[float], id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """Euclidean distance of each vector to one query, in double precision, by Arrow batches. Vectors of another length are dropped."""
    wanted = np.asarray(query, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # all vectors have one length, so the batch's flat values are the matrix
            table = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(wanted))
            yield pa.record_batch([batch.column(0), pa.array(np.sqrt(((table - wanted) ** 2).sum(axis=1)))], ["id", "distance"])

    rows = vectors.where(F.size(vector_col) == len(query)).select(F.col(id_col).alias("id"), vector_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, distance double")


def knn(vectors: DataFrame, query: list[float], k: int = 10, exclude: int | None = None, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """The k nearest, nearest first, ties by id; `exclude` leaves one id (the query's own) out before the limit."""
    rows = vectors if exclude is None else vectors.where(F.col(id_col) != exclude)
    return distances(rows, query, id_col, vector_col).orderBy("distance", "id").limit(k)


def knn_each(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """For each of a few queries(query_id, v) the k nearest others: each Arrow batch keeps its k best for each query, ties by id, by one matrix
    product and exact distances of what its rounding can't tell apart; only those are shuffled. The queries travel with the tasks; their bytes are checked against 64 MB."""
    room = queries.agg(F.coalesce(F.sum(F.size(vector_col).cast("long")), F.lit(0)).alias("n")).first()["n"]
    if room * 8 > 64 << 20:
        raise ValueError("too many queries for one pass; give them in blocks")
    found = queries.select("query_id", vector_col).toPandas()
    ids = found["query_id"].to_numpy(np.int64)
    wanted = np.stack(found[vector_col].to_numpy()).astype(np.float64) if len(found) else np.zeros((0, 1))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        norms = (wanted**2).sum(axis=1)
        for batch in batches:
            if not len(batch) or not len(ids):
                continue
            own = batch["id"].to_numpy(np.int64)
            table = np.stack(batch["v"].to_numpy()).astype(np.float64)
            sizes = (table**2).sum(axis=1)
            square = norms[:, None] + sizes - 2 * wanted @ table.T
            square[(ids[:, None] == own[None, :]) | ~np.isfinite(square)] = np.inf
            top = min(k, len(own))
            last = np.partition(square, top - 1, axis=1)[:, top - 1]
            # the product's rounding moves a square by less than this, so no vector beyond it can be among the k best
            margin = 16 * (table.shape[1] + 4) * np.finfo(np.float64).eps * (norms + sizes.max(where=np.isfinite(sizes), initial=0.0))
            found = []
            for q in range(len(ids)):
                near = np.flatnonzero((square[q] <= last[q] + margin[q]) & np.isfinite(square[q]))
                exact = np.sqrt(((wanted[q] - table[near]) ** 2).sum(axis=1))
                best = np.lexsort((own[near], exact))[:k]
                found.append((np.repeat(ids[q], len(best)), own[near][best], exact[best]))
            yield pd.DataFrame(dict(zip(["query_id", "id", "distance"], map(np.concatenate, zip(*found, strict=True)), strict=True)))

    rows = vectors.where(F.size(vector_col) == wanted.shape[1]).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    return rows.mapInPandas(run, "query_id long, id long, distance double").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def nearest_tempo(files: DataFrame, bpm: float, k: int = 10, exclude: int | None = None) -> DataFrame:
    """The k files nearest in tempo; one-shots and files without one are left out."""
    rows = files.where((F.col("content_type") != "one_shot") & (F.col("bpm") > 0))
    if exclude is not None:
        rows = rows.where(F.col("id") != exclude)
    return rows.select("id", F.abs(F.col("bpm") - bpm).alias("distance")).orderBy("distance", "id").limit(k)


def similar(files: DataFrame, vectors: DataFrame, file_id: int, by: str = "overall", space: str = "effnet", k: int = 10) -> DataFrame:
    """Files like one file, with their paths: by overall (effnet or dclap), timbre, spectrum or rhythm. Raises LookupError without a stored vector or tempo."""
    if by not in {"overall", "timbre", "spectrum", "rhythm"} or space not in {"effnet", "dclap"}:
        raise ValueError(f"unknown space: {by} {space}")
    if by == "rhythm":
        own = files.where(F.col("id") == file_id).select("bpm").first()
        if not own or not own["bpm"]:
            raise LookupError("no stored tempo")
        near = nearest_tempo(files, own["bpm"], k, file_id)
    else:
        table = vectors.where(F.col("space") == (space if by == "overall" else by))
        own = table.where(F.col("file_id") == file_id).select("v").first()
        if not own:
            raise LookupError("no stored embedding")
        near = knn(table, list(own["v"]), k, file_id, "file_id")
    return near.join(files.select("id", "path"), "id", "left").orderBy("distance", "id")


# labels with scores ---------------------------------------------------------------------------------------------------


def by_score(entries: Column) -> Column:
    """Entries (key, value) by descending value, ties by key; null and NaN values are dropped."""
    fine = F.filter(entries, lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]))
    turned = F.transform(fine, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key")))
    return F.transform(F.array_sort(turned), lambda e: F.struct(e["key"].alias("label"), (-e["n"]).alias("score")))


def top_entries(scores: Column, n: int) -> Column:
    """The n best entries of a map as array<struct<label, score>>."""
    return F.slice(by_score(F.map_entries(scores)), 1, n)


def top_scored(scores: Column, least: float, most: int) -> Column:
    """Entries from a score on, best first, at most `most`."""
    return F.slice(F.filter(by_score(F.map_entries(scores)), lambda e: e["score"] >= least), 1, most)


def top_genres(normalized: Column, raw: Column, least: float = 0.10, most: int = 3) -> Column:
    """Per label the normalised score if there is one, else the raw one under the raw name."""
    from sonolith.functions.scalars import genre_name

    empty = F.create_map().cast("map<string,double>")
    fallback = F.map_filter(F.coalesce(raw, empty), lambda k, _: F.element_at(F.coalesce(normalized, empty), genre_name(k)).isNull())
    return top_scored(F.map_concat(F.coalesce(normalized, empty), F.map_filter(fallback, lambda k, _: ~F.map_contains_key(F.coalesce(normalized, empty), k))), least, most)


def facet_labels(human: Column, candidates: list[Column], limit: int = 12, least: float = 0.10) -> Column:
    """A person's labels if there are any, else of the first map with entries the top one and others from `least` on."""
    chosen = F.coalesce(*[F.when(F.size(m) > 0, m) for m in candidates])
    top = top_entries(chosen, limit)
    kept = F.filter(top, lambda e, i: (i == 0) | (e["score"] >= least))
    return F.when(F.size(human) > 0, human).otherwise(F.coalesce(F.transform(kept, lambda e: e["label"]), F.array().cast("array<string>")))


def compact_label(labels: Column) -> Column:
    """"drums +2"."""
    return F.when(F.size(labels) > 1, F.concat(labels[0], F.lit(" +"), (F.size(labels) - 1).cast("string"))).when(F.size(labels) == 1, labels[0])


def top_per_key(rows: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
