"""The corpus pipeline over `documents`: each stage is written as Parquet and read again as the next one's documents.

Language ID rejects texts without a language (no letters) or without a majority language; line dedup cuts later copies of passages out of the
texts and drops a document only if nothing of it is left; near-dedup keeps one document of each group; decontamination
drops documents that hold a benchmark item; mixing gives each document its number of copies and drops those without one.
Rows that share a doc_id share its fate. Further columns pass
through; `copies` and, in line dedup, `line_dedup` are the stages' own and replace a column of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.llm import decontaminate, langid, linededup, mixing, neardup
from sonolith.llm.common import materialize, table

#: Least share of a document's words that its language must have.
MAJORITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep(docs, langid.fit(docs), MAJORITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.dedup_runs(docs.drop("line_dedup")).where("line_dedup.n_removed_lines = 0 or line_dedup.n_removed_lines < line_dedup.n_lines")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*[c for c in docs.columns if c != "line_dedup"])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = neardup.groups(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0").withColumnRenamed("doc_id", "mixed_id")
    docs = docs.drop("copies")
    return docs.join(mixed, docs["doc_id"].eqNullSafe(mixed["mixed_id"])).select(*[docs[c] for c in docs.columns], mixed["copies"])


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture)]
#: Language ID is a trained model; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
