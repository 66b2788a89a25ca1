"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes ends a piece wherever it is -1 modulo the block size; each piece gives one of 64
signs, so an edit changes only the signs of the pieces that it touches. Block sizes are 1, 3, 6, 12 and so on. A fingerprint is
"block:signs:signs of the next larger block": block 1 (a sign for each byte) up to 64 bytes, else the smallest that gives
at most about 64 signs, halved while there are fewer than 32. Two fingerprints are
compared at a block size that both have, by edit distance without substitutions, 1 - distance / (signs of both); signs
that share no run (of a quarter of the shorter, four at most) score 0, for then they agree by chance.

neighbours() pairs each document with the next one by ascending doc_id without a global sort into one task: bounds that are
themselves doc_ids cut the ids into ranges, a range's first document also goes to the range before, and each range
is read in order with one document held back.

Nulls and odd input: a null text is empty; an empty text has no signs ("1::"), and two fingerprints without signs are alike (1.0);
a null doc_id comes first; rows that share a doc_id follow by text; a single document is its own next one. Empty input
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import with_defaults
from sonolith.llm.textvec import mix, powers, stream

SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LENGTH, LEAST_BLOCK, WINDOW = 64, 3, 7
#: Documents in a range of neighbours(), and the most ranges that the plan carries as bounds (half a MB).
RANGE_ROWS, MOST_RANGES = 2000, 65536
_SIGN = np.array(list(SIGNS))
_BYTE = stream(7, 256)
_ROLL = (stream(8, WINDOW) >> np.uint64(33)).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def larger(block: int) -> int:
    """The next block size."""
    return 2 * block if block > 1 else LEAST_BLOCK


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of some texts at once; memory follows the sum of their lengths."""
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    roll = np.zeros(len(data), np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    wide[data == 0] = 0
    for j in range(WINDOW):
        roll[WINDOW:] += wide[WINDOW - j : len(wide) - j] * _ROLL[j]
    roll ^= roll >> np.uint32(15)
    roll *= np.uint32(0x2C1B3C6D)
    roll ^= roll >> np.uint32(13)
    at_least = np.flatnonzero(roll % np.uint32(LEAST_BLOCK) == LEAST_BLOCK - 1)
    rolls = roll[at_least].astype(np.int64)
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    starts = np.cumsum([WINDOW] + [len(t) + WINDOW for t in texts])
    bounds = np.searchsorted(at_least, np.stack([starts[:-1], starts[1:] - WINDOW]))
    out = []
    for i, text in enumerate(texts):
        begin, end = int(starts[i]), int(starts[i]) + len(text)
        places, values = at_least[bounds[0, i] : bounds[1, i]], rolls[bounds[0, i] : bounds[1, i]]
        block = LEAST_BLOCK if len(text) > LENGTH else 1
        while block * LENGTH < len(text):
            block *= 2
        while True:
            ends = places[values % block == block - 1] if block > 1 else np.arange(begin, end)
            if len(ends) >= LENGTH // 2 or block <= LEAST_BLOCK:
                break
            block //= 2

        def signs(ends: np.ndarray, begin: int = begin, end: int = end) -> str:
            cuts = ends[: LENGTH - 1] + 1
            if not len(cuts) or cuts[-1] < end:
                cuts = np.append(cuts, end)
            if begin == end:
                return ""
            first = np.concatenate([[begin], cuts[:-1]])
            spans = mix((sums[cuts] - sums[first]) * inverse[first])
            return "".join(_SIGN[(spans >> np.uint64(58)).astype(np.int64)])

        out.append(f"{block}:{signs(ends)}:{signs(places[values % larger(block) == larger(block) - 1])}")
    return out


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def alike(a: str, b: str) -> float:
    """Likeness of two strings of signs, 0 to 1."""
    if a == b:
        return 1.0
    shorter = min(len(a), len(b))
    if not shorter:
        return 0.0
    run = min(4, shorter // 4 + 1)
    if {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 0 where they have no block size in common."""
    if a == b:
        return 1.0
    block_a, one_a, two_a = a.split(":")
    block_b, one_b, two_b = b.split(":")
    x, y = int(block_a), int(block_b)
    if x == y:
        return max(alike(one_a, one_b), alike(two_a, two_b) if min(len(two_a), len(two_b)) >= 8 else 0.0)
    if x == larger(y):
        return alike(one_a, two_b)
    if y == larger(x):
        return alike(two_a, one_b)
    return 0.0


def fingerprint_column(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(fingerprints(texts), pa.string())], ["doc_id", "fingerprint"])

    return with_defaults(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fingerprint string")


def neighbours(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in ranges: part, ahead, doc_id, text. Read by part, ahead, doc_id and text, each part is a run of documents
    followed by the one (ahead) that comes next."""
    rows = with_defaults(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    found = rows.agg(F.min(order).alias("least"), F.percentile_approx(order, [i / ranges for i in range(1, ranges)] or [0.5], 100_000).alias("cuts")).first()
    bounds = np.array(sorted({found["least"], *(found["cuts"] if ranges > 1 else [])}) if n else [0], np.int64)

    @F.pandas_udf("array<struct<part: int, ahead: boolean>>")
    def place(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        ids = ids.to_numpy(np.int64)
        part = np.maximum(np.searchsorted(bounds, ids, side="right") - 1, 0)
        first = bounds[part] == ids
        return pd.Series([[{"part": int(p), "ahead": False}] + ([{"part": (int(p) - 1) % len(bounds), "ahead": True}] if f else []) for p, f in zip(part, first, strict=True)])

    return rows.select("doc_id", "text", F.explode(place(order)).alias("at")).select("at.part", "at.ahead", "doc_id", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> for each document the fingerprint of its text and of its edited text, whose last quarter is replaced by the
    next document's beginning, the likeness of the two, and that to the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(rows: list[tuple[int, str]], follower: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [follower]
        edited = [(t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode() for t, after in zip(texts, texts[1:], strict=False)]
        own = fingerprints([t.encode() for t in texts])
        changed = fingerprints(edited)
        return pa.record_batch(
            [
                pa.array([i for i, _ in rows], pa.int64()),
                pa.array([len(t) for _, t in rows], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array(own[:-1], pa.string()),
                pa.array(changed, pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        size = 0
        for batch in batches:
            for _, ahead, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ahead:
                    if held:  # a second row with the first document's id is not the next one
                        yield compare(held, text)
                    held, size = [], 0
                    continue
                if size > 1 << 20:
                    yield compare(held, text)
                    held, size = [], 0
                held.append((doc, text))
                size += len(text)

    placed = neighbours(docs)
    return placed.repartition("part").sortWithinPartitions("part", "ahead", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, schema)
