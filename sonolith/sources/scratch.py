"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one gets a temporary folder; a cluster without one is refused."""
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
    """Writes df as Parquet there and reads it back: a cut in the lineage that survives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/sonolith/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
