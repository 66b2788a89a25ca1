"""Small text formats: taxonomies, cue sheets, sidecars and tokenizers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a sidecar that a re-tag leaves alone.
LATENT_KEYS = ["path", "relpath", "src_relpath", "seconds_total", "seconds_start", "audio_samples", "latent_shape", "padding_mask"]
CUE_COLUMNS = ["cue", "track", "in", "out", "length", "seconds", "key", "tempo", "take"]
PROMPT = "This is a sound of {}."
MOST_TOKENS = 512


def parse_taxonomy(text: str) -> list[tuple[str, str, str]]:
    """(model, raw, canonical) of a two-level mapping; comments and blank lines are skipped."""
    rows, model = [], None
    for line in text.splitlines():
        body = line.split(" #", 1)[0].rstrip() if not line.lstrip().startswith("#") else ""
        if not body.strip() or ":" not in body:
            continue
        unquote = lambda s: s.strip().strip("\"'")
        if not body[0].isspace():
            model = unquote(body.rsplit(":", 1)[0])
        elif model:
            raw, canonical = body.rsplit(": ", 1) if ": " in body else body.rsplit(":", 1)
            rows.append((model, unquote(raw), unquote(canonical)))
    return rows


#: Lines of a taxonomy, which is gathered and broadcast.
MOST_LINES = 100_000


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """model, raw, canonical of a taxonomy file. A raw label that has two canonical ones is an error, and so are more than MOST_LINES lines."""
    lines = spark.read.text(path).take(MOST_LINES + 1)
    if len(lines) > MOST_LINES:
        raise ValueError(f"a taxonomy has {MOST_LINES} lines at most")
    rows = parse_taxonomy("\n".join(r["value"] for r in lines))
    if len({r[:2] for r in rows}) < len(rows):
        raise ValueError("a raw label is mapped twice")
    return spark.createDataFrame(rows, "model string, raw string, canonical string")


def normalized(scores: DataFrame, names: DataFrame, model: str) -> DataFrame:
    """scores(file_id, label, score) under canonical labels, the best score of each; labels without one are dropped."""
    own = F.broadcast(names.where(F.col("model") == model).select(F.col("raw").alias("label"), "canonical"))
    return scores.join(own, "label").groupBy("file_id", "canonical").agg(F.max("score").alias("score")).withColumnRenamed("canonical", "label")


def unmapped(scores: DataFrame, names: DataFrame, model: str) -> DataFrame:
    """Labels in use without a canonical one, with their number of files."""
    own = names.where(F.col("model") == model).select(F.col("raw").alias("label"))
    return scores.join(F.broadcast(own), "label", "left_anti").groupBy("label").agg(F.countDistinct("file_id").alias("n_files"))


def quoted(text: Column) -> Column:
    """A CSV field: quoted where it has a comma, quote or line break, quotes doubled."""
    return F.when(text.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def cue_sheet(blocks: DataFrame, markers: DataFrame) -> DataFrame:
    """position, line of the sheet: header, blocks by start, then markers by start. Both have `start` and the sheet's columns as strings. Positions come from a
    sort of one document's rows."""
    body = F.concat_ws(",", *[quoted(F.col(c)) for c in CUE_COLUMNS])
    spark = blocks.sparkSession
    head = spark.createDataFrame([(0, 0.0, ",".join(CUE_COLUMNS))], "part int, start double, line string")
    rows = head.unionByName(blocks.select(F.lit(1).alias("part"), "start", body.alias("line"))).unionByName(markers.select(F.lit(2).alias("part"), "start", body.alias("line")))
    return rows.orderBy("part", "start", "line")


def write_sidecars(rows: DataFrame, root: str) -> DataFrame:
    """rows(folder, name, sidecar): one .json for each."""
    from sonolith.sources.files import write_files

    return write_files(rows.withColumn("name", F.concat("name", F.lit(".json"))), root, body="sidecar")


def retag_sidecars(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """old(name, sidecar), fresh(name, sidecar) -> name, sidecar (a map), status: changed, equal, or missing where there is no fresh one."""
    from sonolith.operators.captions import retag

    as_map = lambda c: F.from_json(c, "map<string,string>")
    both = old.select("name", as_map("sidecar").alias("o")).join(fresh.select("name", as_map("sidecar").alias("f")), "name", "left")
    merged = F.when(F.col("f").isNull(), F.col("o")).otherwise(retag(F.col("o"), F.col("f"), LATENT_KEYS))
    sorted_entries = lambda m: F.array_sort(F.map_entries(m))
    status = F.when(F.col("f").isNull(), "missing").when(sorted_entries(F.col("m")) == sorted_entries(F.col("o")), "equal").otherwise("changed")
    return both.withColumn("m", merged).select("name", F.to_json("m").alias("sidecar"), status.alias("status"))


def token_ids(texts: DataFrame, vocabulary: str, column: str = "text") -> DataFrame:
    """Adds `ids` of a byte-level BPE: prompts are made of labels by the fixed sentence, and cut at 512 tokens (the text tower's input length)."""

    @F.pandas_udf("array<int>")
    def encode(labels: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        found = tokenizer.encode_batch([PROMPT.format(x or "") for x in labels], add_special_tokens=False)
        return pd.Series([f.ids[:MOST_TOKENS] for f in found])

    return texts.withColumn("ids", encode(column))
