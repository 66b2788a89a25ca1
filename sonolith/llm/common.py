"""Helpers that the corpus operators share: tables, scratch tables in the shared folder, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session without one (tests) gets a temporary folder; a
    cluster without one is refused, because executors would write to disks of their own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='sonolith-')}")
        shared = _own[0]
    return shared.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/sonolith/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the scratch table that materialize() gave, when what was made from it has been written."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/sonolith/" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def words(text: Column) -> Column:
    """The words of a text, an empty array for null, empty and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    blank = lambda i: F.when(F.element_at(parts, i) == "", 1).otherwise(0)
    ends = F.when(F.size(parts) == 1, blank(1)).otherwise(blank(1) + blank(-1))
    return (F.size(parts) - ends).cast("long")


def with_defaults(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, cast to the given types: extra columns of the caller can't clash with the operator's own."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()])
