"""File sources: recursive scans, incremental status, content hashes, path lists, and audio decoding."""

from __future__ import annotations

import io
import unicodedata
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonolith.operators.predicates import AUDIO_EXTENSIONS, basename

GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in AUDIO_EXTENSIONS) + "}"


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """path, mtime (seconds), size_bytes, status of every file below the roots: audio, appledouble or unsupported. The bytes are not read.
    Spark's listing leaves out hidden files, so sidecars named ._* are skipped before they are counted; a listing from elsewhere may still have them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    name = basename(F.col("path"))
    kind = F.when(name.startswith("._"), "appledouble").when(F.lower(name).rlike(r"\.(" + "|".join(AUDIO_EXTENSIONS) + ")$"), "audio").otherwise("unsupported")
    return found.select("path", F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"), kind.alias("status"))


@F.pandas_udf(T.StringType())
def path_nfc(path: pd.Series) -> pd.Series:
    """A path in Unicode normal form C: the key under which spellings of one path are equal."""
    return path.map(lambda p: None if p is None else unicodedata.normalize("NFC", p))


def scan_status(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """The listing with audio files marked new, updated or unchanged against catalog(path, mtime). Exact paths come first, then normal forms."""
    known = catalog.select(F.col("path").alias("known_path"), F.col("mtime").alias("known_mtime"), path_nfc("path").alias("nfc"))
    exact = found.withColumn("nfc", path_nfc("path")).join(known.drop("nfc"), F.col("path") == F.col("known_path"), "left")
    loose = known.groupBy("nfc").agg(F.min(F.struct("known_path", "known_mtime")).alias("other"))
    both = exact.join(loose, "nfc", "left")
    stored = F.coalesce("known_mtime", "other.known_mtime")
    status = F.when(F.col("status") != "audio", F.col("status")).when(stored.isNull(), "new").when(stored == F.col("mtime"), "unchanged").otherwise("updated")
    return both.select("path", "mtime", "size_bytes", status.alias("status"))


def scan_counters(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def hashed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256 of the given files; only new and updated ones need be given."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def duplicates(files: DataFrame) -> DataFrame:
    """Hashes that several files share, with their number and first path."""
    return files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")


def listed_paths(spark: SparkSession, path: str, catalog: DataFrame) -> DataFrame:
    """Catalog rows named in a text file, one path a line; unknown ones are skipped."""
    wanted = spark.read.text(path).select(F.trim("value").alias("path")).where("path != ''").distinct()
    return catalog.join(wanted, "path", "left_semi")


def decode_wav(content: bytes) -> dict | None:
    """Left, right and mono samples (-1 to 1) of a PCM WAV; one channel counts as both. None if it can't be read."""
    try:
        with wave.open(io.BytesIO(content)) as w:
            width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    except (wave.Error, EOFError):
        return None
    if width == 3:
        raw = b"".join(b"\0" + raw[i : i + 3] for i in range(0, len(raw) - 2, 3))
        width = 4
    if width not in (1, 2, 4):
        return None
    flat = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    flat = (flat - 128) / 128 if width == 1 else flat / float(1 << (8 * width - 1))
    table = flat[: len(flat) // channels * channels].reshape(-1, channels)
    left, right = table[:, 0], table[:, min(1, channels - 1)]
    return {"rate": rate, "channels": channels, "left": left, "right": right, "mono": 0.5 * (left + right)}


_FLOATS = T.ArrayType(T.FloatType())
DECODED = T.StructType().add("rate", T.IntegerType()).add("channels", T.IntegerType()).add("n_samples", T.LongType()).add("left", _FLOATS).add("right", _FLOATS).add("mono", _FLOATS)


@F.pandas_udf(DECODED)
def decoded(content: pd.Series) -> pd.DataFrame:
    rows = []
    for c in content:
        d = decode_wav(c) if c is not None else None
        rows.append((d["rate"], d["channels"], len(d["mono"]), *(d[k].astype(np.float32) for k in ("left", "right", "mono"))) if d else (None,) * 6)
    return pd.DataFrame(rows, columns=["rate", "channels", "n_samples", "left", "right", "mono"])


def encode_wav(left: np.ndarray, right: np.ndarray | None, rate: int) -> bytes:
    """A 16-bit PCM WAV, stereo if there is a right channel."""
    channels = [left] if right is None else [left, right]
    table = np.clip(np.stack(channels, axis=1), -1, 1)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(channels))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(table * 32767).astype("<i2").tobytes())
    return out.getvalue()


def clips(audio: DataFrame, plan: DataFrame) -> DataFrame:
    """audio(file_id, content), plan(file_id, folder, first, last) -> folder, name, wav: the bytes of each clip. The plan is grouped by file, so a file is
    moved and decoded once, however many clips it gives."""

    @F.pandas_udf("array<struct<folder: string, wav: binary>>")
    def cut(content: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for c, wanted in zip(content, parts, strict=True):
            d = decode_wav(c)
            body = lambda a, b: encode_wav(d["left"][a:b], d["right"][a:b] if d["channels"] > 1 else None, d["rate"])  # noqa: B023, E731
            out.append([{"folder": w["folder"], "wav": body(w["first"], w["last"]) if d else None} for w in wanted])
        return pd.Series(out)

    wanted = plan.groupBy("file_id").agg(F.collect_list(F.struct("folder", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))).alias("_parts"))
    found = audio.join(wanted, "file_id").select("file_id", F.explode(cut("content", "_parts")).alias("_clip"))
    return found.select("_clip.folder", F.concat(F.col("file_id").cast("string"), F.lit(".wav")).alias("name"), "_clip.wav")


def write_files(rows: DataFrame, root: str, name: str = "name", body: str = "wav") -> DataFrame:
    """Writes one file for each row below a root that all executors share, and returns the names and sizes. Files are written under a temporary name and moved, so
    a task that runs again leaves the same file. The driver leaves a mark in the root; a task that doesn't see it fails, so a root on one machine's own disk is refused."""
    import uuid
    from pathlib import Path

    mark = Path(root, f".shared-{uuid.uuid4().hex}")
    mark.parent.mkdir(parents=True, exist_ok=True)
    mark.touch()

    @F.pandas_udf("long")
    def put(folders: pd.Series, names: pd.Series, bodies: pd.Series) -> pd.Series:
        import os
        import uuid
        from pathlib import Path

        if not mark.exists():
            raise OSError(f"{root} is not a folder that all executors share")
        sizes = []
        for f, n, b in zip(folders, names, bodies, strict=True):
            b = b.encode() if isinstance(b, str) else b
            target = Path(root, f, n)
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(f".{n}.{uuid.uuid4().hex}")
            part.write_bytes(b)
            os.replace(part, target)
            sizes.append(len(b))
        return pd.Series(sizes, dtype="int64")

    return rows.select("folder", name, put("folder", name, body).alias("n_bytes"))


def splice(samples: Column, spans: Column, rate: Column) -> Column:
    """Samples inside the spans, joined."""
    return F.flatten(F.transform(spans, lambda s: F.slice(samples, F.floor(s["start"] * rate).cast("int") + 1, F.greatest(F.lit(0), (F.floor(s["end"] * rate) - F.floor(s["start"] * rate)).cast("int")))))


def missing_models(expected: list[str], found: DataFrame) -> DataFrame:
    """Expected paths with their size, null where the listing hasn't them."""
    wanted = found.sparkSession.createDataFrame([(p,) for p in expected], "path string")
    return wanted.join(found.select("path", "size_bytes"), "path", "left").withColumn("exists", F.col("size_bytes").isNotNull())
