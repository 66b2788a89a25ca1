"""Suffix-array dedup: removes every byte covered by a LENGTH-byte string that also starts anywhere else.

Suffixes are sorted at anchors only. The anchor of a window of LENGTH bytes is the place of the smallest hash of GRAM bytes
among the window's first SPAN places; it depends on the window's bytes alone, so equal windows have their anchors at the same offset. An anchor
stands for the run of windows that choose it, and two windows are equal exactly if the texts to the right of
their anchors agree as far as the windows reach, and those to the left. Sorting the suffixes at anchors (about one byte in 90)
therefore finds what a sort of all suffixes would find.

1. Each different text posts a hash of the LENGTH - SPAN + 1 bytes at its anchors. Anchors whose hash no other anchor has are
   done; only texts with others go on. Texts that occur more than once are wholly repeated, and go on once.
2. Texts are cut into runs. A run's suffixes are sorted, equal contexts combined (with their places), and the run is exchanged
   front-coded: the length shared with the suffix before, and the rest. Ranges of the sort order hold about RANGE_BYTES and are bounded by sampled
   96-byte prefixes, so suffixes that share more stay together.
3. Each range merges its runs with a loser tree whose entries know their common prefix with the last output. Two entries with
   different common prefixes are ordered without a look at their bytes; equal ones are compared from that byte on. The
   tree so gives the common prefix of neighbours too.
4. Neighbours that share LENGTH - SPAN + 1 bytes or more make a group; from the common prefixes to the right and the common
   suffixes to the left follow the offsets at which a window occurs in two entries, and from them the bytes to remove.
5. A passage in a large part of all documents gives a hot key (more than HOT anchors), which no range could hold. Equal windows have equal keys,
   so hot keys are closed: their occurrences are counted by context (a 128-bit hash; a context that occurs twice is repeated whole), the
   different contexts' windows by a 128-bit hash each, with sums before every shuffle, and what is repeated goes back to the occurrences by a join that
   Spark can split. So no task holds more than HOT suffixes of one passage.

Nulls and odd input: a null text is empty; a text shorter than LENGTH is kept whole; repeated rows count as other
places, so both are removed; null doc_ids come out row for row; a very long text is held whole by its task, with some 60 bytes of working
arrays for each of its bytes. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import materialize, with_defaults
from sonolith.llm.textvec import _BYTE, Piece, pieces

LENGTH, SPAN, GRAM = 400, 184, 16
SHARED = LENGTH - SPAN + 1
PREFIX = 96
#: Occurrences beyond which an anchor's key is hot: its windows are counted by their hashes instead of merged in one range.
HOT = 50_000
BROADCAST_BYTES = 32 << 20
#: Bytes of contexts in a range, and the most ranges (their bounds travel with the tasks).
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 16
#: Bytes of context in a run.
RUN_BYTES = 16 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a piece: place, first and last window start that chooses it, and the hash of SHARED bytes at it."""
    n = len(piece.data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    sums = piece.prefix(_BYTE[piece.data])
    at = np.arange(n - GRAM + 1)
    bits = np.uint64(32)  # of the hash as many in every piece, whatever its length; ties go by place, as they do wherever the window stands
    best = (piece.spans(sums, at, at + GRAM) >> bits << bits) | at.astype(np.uint64)
    width = 1
    while width * 2 <= SPAN:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < SPAN:
        best = np.minimum(best[: -(SPAN - width)], best[SPAN - width :])
    count = np.maximum(np.diff(piece.offs) - LENGTH + 1, 0)
    starts = np.repeat(piece.offs[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    chosen = (best[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    cut = np.flatnonzero(np.diff(chosen)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(chosen) - 1]])
    place = chosen[first]
    return place, starts[first], starts[last], piece.spans(sums, place, place + SHARED)


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> row, doc_id, n_bytes, sha, keys (of its anchors), sample (a prefix of a suffix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                place, _, _, keys = anchors(piece)
                bounds = np.searchsorted(place, piece.offs)
                raw = piece.data.tobytes()
                shas, samples = [], []
                for i in range(piece.n):
                    a, b = int(piece.offs[i]), int(piece.offs[i + 1])
                    shas.append(hashlib.sha256(raw[a:b]).hexdigest())
                    mid = int(place[(bounds[i] + bounds[i + 1]) // 2]) if bounds[i] < bounds[i + 1] else None
                    samples.append(None if mid is None else raw[mid : mid + PREFIX])
                own = [batch.column(i).slice(piece.first, piece.n) for i in (0, 1)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(keys.view(np.int64)))
                yield pa.record_batch([*own, pa.array(np.diff(piece.offs)), pa.array(shas), lists, pa.array(samples, pa.binary())], ["row", "doc_id", "n_bytes", "sha", "keys", "sample"])

    rows = with_defaults(docs, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, "row long, doc_id long, n_bytes long, sha string, keys array<bigint>, sample binary")


def common_prefixes(sorted_rights: list[bytes]) -> np.ndarray:
    """Common prefix of each string with the one before."""
    out = np.zeros(len(sorted_rights), np.int64)
    for a in range(0, len(sorted_rights), 4096):
        part = sorted_rights[max(a - 1, 0) : a + 4096]
        size = np.array([len(x) for x in part])
        table = np.frombuffer(b"".join(x.ljust(LENGTH, b"\0") for x in part), np.uint8).reshape(len(part), LENGTH)
        differ = table[1:] != table[:-1]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
        out[max(a, 1) : max(a - 1, 0) + len(part)] = np.minimum(lcp, np.minimum(size[1:], size[:-1]))
    return out


def front_coded(entries: dict[tuple[bytes, bytes, int], list[tuple[int, int]]], cuts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """Sorts a run's entries (right, left, least offset -> places) and yields (range, front-coded block)."""
    order = sorted(entries)
    lcps = common_prefixes([e[0] for e in order])
    ranges = [bisect_right(cuts, e[0][:PREFIX]) for e in order]
    begin = 0
    while begin < len(order):
        end = bisect_right(ranges, ranges[begin], begin)
        heads, bodies, places = [], [], []
        for i in range(begin, end):
            right, left, least = order[i]
            shared = int(lcps[i]) if i > begin else 0
            own = entries[order[i]]
            heads.append((shared, len(right) - shared, len(left), least, len(own)))
            bodies += [right[shared:], left]
            places += own
        head = np.array(heads, np.int32).tobytes()
        place = np.array(places, np.int64).tobytes()
        yield ranges[begin], b"".join([np.array([end - begin, len(places)], np.int64).tobytes(), head, place, *bodies])
        begin = end


class Run:
    """Reads a front-coded block suffix by suffix."""

    def __init__(self, block: bytes):
        self.block = block
        n, many = np.frombuffer(block, np.int64, 2)
        self.heads = np.frombuffer(block, np.int32, n * 5, 16).reshape(n, 5).tolist()
        self.places = np.frombuffer(block, np.int64, many * 2, 16 + int(n) * 20).reshape(many, 2)
        self.at = 16 + int(n) * 20 + int(many) * 16
        self.next, self.first_place, self.right = 0, 0, b""

    def advance(self) -> int:
        """Moves to the next suffix; its common prefix with the one before, or -1 at the end."""
        if self.next == len(self.heads):
            return -1
        shared, rest, left, self.least, many = self.heads[self.next]
        at = self.at
        self.right = self.right[:shared] + self.block[at : at + rest]
        self.left = self.block[at + rest : at + rest + left]
        self.at = at + rest + left
        self.own = self.places[self.first_place : self.first_place + many]
        self.first_place += many
        self.next += 1
        return shared


def common_from(a: bytes, b: bytes, start: int) -> int:
    """Common prefix of a and b, which agree up to start."""
    n = min(len(a), len(b))
    if start >= n or a[start] != b[start]:
        return start
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge(blocks: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int, np.ndarray]]:
    """Merges runs by a loser tree: common prefix with the output before, right, left, least offset, places."""
    runs = [Run(b) for b in blocks]
    size = 1 << max(len(runs) - 1, 0).bit_length()
    known = [0] * size  # common prefix of each run's suffix with the last output
    live = [i < len(runs) and runs[i].advance() >= 0 for i in range(size)]
    tree = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser keeps its common prefix with the winner."""
        if not live[b]:
            return a, b
        if not live[a]:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a].right, runs[b].right
        shared = common_from(x, y, known[a])
        if shared == len(x) or (shared < len(y) and x[shared] < y[shared]):
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    winners = list(range(size))
    for level in range(size.bit_length() - 1):
        nodes = []
        for i in range(0, len(winners), 2):
            w, loser = play(winners[i], winners[i + 1])
            tree[(size >> (level + 1)) + i // 2] = loser
            nodes.append(w)
        winners = nodes
    top = winners[0]
    while live[top]:
        run = runs[top]
        yield known[top], run.right, run.left, run.least, run.own
        shared = run.advance()
        live[top] = shared >= 0
        known[top] = shared
        at = (size + top) >> 1
        while at:
            top, tree[at] = play(top, tree[at])
            at >>= 1


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if not n:
        return 0
    x = int.from_bytes(a[len(a) - n :], "little") ^ int.from_bytes(b[len(b) - n :], "little")
    return n - (x.bit_length() + 7) // 8


def repeats(group: list[tuple[int, bytes, bytes, int, np.ndarray]]) -> Iterator[tuple[np.ndarray, int, int]]:
    """Of a group in sort order: (places, least offset, largest offset) of windows that occur more than once."""
    g = len(group)
    least = [e[3] for e in group]
    most = [len(e[2]) for e in group]
    valid = [np.zeros(SPAN, bool) for _ in group]
    for i, e in enumerate(group):
        if len(e[4]) > 1:
            valid[i][least[i] : most[i] + 1] = True
    if g <= 6:
        for i in range(g):
            right = LENGTH
            for j in range(i + 1, g):
                right = min(right, group[j][0])
                low, high = max(LENGTH - right, least[i], least[j]), min(common_suffix(group[i][2], group[j][2]), most[i], most[j])
                if low <= high:
                    valid[i][low : high + 1] = True
                    valid[j][low : high + 1] = True
    else:
        rights = np.array([e[0] for e in group])
        rights[0] = 0
        turned = [e[2][::-1] for e in group]
        order = sorted(range(g), key=turned.__getitem__)
        lefts = np.array([0] + [common_from(turned[a], turned[b], 0) for a, b in zip(order, order[1:], strict=False)])
        low, high = np.array(least), np.array(most)
        table = np.array(valid)
        left_class = np.empty(g, np.int64)
        for o in range(int(low.min()), int(high.max()) + 1):
            inside = np.flatnonzero((low <= o) & (high >= o))
            if len(inside) < 2:
                continue
            left_class[order] = np.cumsum(lefts < o)
            both = np.cumsum(rights < LENGTH - o)[inside] * (g + 1) + left_class[inside]
            _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
            table[inside[count[inverse] > 1], o] = True
        valid = list(table)
    for i, e in enumerate(group):
        flips = np.flatnonzero(np.diff(np.concatenate([[False], valid[i], [False]]).astype(np.int8)))
        for a, b in zip(flips[::2], flips[1::2], strict=True):
            yield e[4], int(a), int(b) - 1


def sorted_runs(texts: DataFrame, cuts: list[bytes]) -> DataFrame:
    """texts(node, text, keys: the repeated ones) -> part, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict[tuple[bytes, bytes, int], list[tuple[int, int]]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for part, block in front_coded(entries, cuts):
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([block], pa.binary())], ["part", "block"])
            entries.clear()

        for batch in batches:
            nodes, wanted = batch.column(0).to_pylist(), batch.column(2)
            for piece in pieces(batch.column(1)):
                place, first, last, keys = anchors(piece)
                raw = piece.data.tobytes()
                bounds = np.searchsorted(place, piece.offs)
                for i in range(piece.n):
                    own = np.asarray(wanted[piece.first + i].values, np.int64)
                    base = int(piece.offs[i])
                    for j in np.flatnonzero(np.isin(keys[bounds[i] : bounds[i + 1]].view(np.int64), own)) + bounds[i]:
                        a, low = int(place[j]), int(place[j] - last[j])
                        key = (raw[a : a + LENGTH - low], raw[int(first[j]) : a], low)
                        found = entries.get(key)
                        if found is None:
                            entries[key] = [(nodes[piece.first + i], a - base)]
                            held += len(key[0]) + len(key[1])
                        else:
                            found.append((nodes[piece.first + i], a - base))
                    if held > RUN_BYTES:
                        yield from flush()
                        held = 0
        yield from flush()

    return texts.select("node", "text", "keys").mapInArrow(run, "part int, block binary")


_SECOND = _BYTE[::-1] ^ np.uint64(0x9E3779B97F4A7C15)


def hot_occurrences(texts: DataFrame) -> DataFrame:
    """texts(node, text, hot) -> node, at, one, two (hash of the context), low, high, body (the context's bytes; null where a task has given them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for batch in batches:
            nodes, wanted = batch.column(0).to_numpy(), batch.column(2)
            for piece in pieces(batch.column(1)):
                place, first, last, keys = anchors(piece)
                sums = [piece.prefix(table[piece.data]) for table in (_BYTE, _SECOND)]
                raw = piece.data.tobytes()
                bounds = np.searchsorted(place, piece.offs)
                for i in range(piece.n):
                    own = np.asarray(wanted[piece.first + i].values, np.int64)
                    pick = np.flatnonzero(np.isin(keys[bounds[i] : bounds[i + 1]].view(np.int64), own)) + bounds[i]
                    if not len(pick):
                        continue
                    low, high = place[pick] - last[pick], place[pick] - first[pick]
                    begin, end = first[pick], last[pick] + LENGTH
                    salt = (low * 512 + high).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
                    one, two = ((piece.spans(x, begin, end) ^ salt).view(np.int64) for x in sums)
                    bodies = []
                    for j, key in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                        bodies.append(None if key in given else raw[begin[j] : end[j]])
                        given.add(key)
                    if len(given) > 100_000:
                        given.clear()
                    node = np.full(len(pick), nodes[piece.first + i])
                    columns = [node, place[pick] - piece.offs[i], one, two, low, high]
                    yield pa.record_batch([*(pa.array(x.astype(np.int64)) for x in columns), pa.array(bodies, pa.binary())], ["node", "at", "one", "two", "low", "high", "body"])

    return texts.select("node", "text", "hot").mapInArrow(run, "node long, at long, one long, two long, low long, high long, body binary")


def hot_windows(contexts: DataFrame) -> DataFrame:
    """contexts(one, two, low, high, body) -> one, two, offset, w1, w2: the hash of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, low, high, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(body, np.uint8)
                piece = Piece(0, data, np.array([0, len(data)]))
                offset = np.arange(low, high + 1)
                begin = high - offset
                hashes = [piece.spans(piece.prefix(table[data]), begin, begin + LENGTH).view(np.int64) for table in (_BYTE, _SECOND)]
                same = [pa.array(np.full(len(offset), x, np.int64)) for x in (one, two)]
                yield pa.record_batch([*same, pa.array(offset), *map(pa.array, hashes)], ["one", "two", "offset", "w1", "w2"])

    return contexts.select("one", "two", "low", "high", "body").mapInArrow(run, "one long, two long, offset long, w1 long, w2 long")


def hot_repeats(texts: DataFrame) -> DataFrame:
    """texts(node, text, hot: hot keys) -> node, first, last: bytes to remove."""
    found = materialize(hot_occurrences(texts), "hot-occurrences")
    contexts = found.groupBy("one", "two", "low", "high").agg(F.count(F.lit(1)).alias("n"), F.first("body", ignorenulls=True).alias("body"))
    contexts = materialize(contexts, "hot-contexts")
    windows = materialize(hot_windows(contexts), "hot-windows")
    twice = materialize(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "hot-twice")
    offsets = windows.join(twice, ["w1", "w2"]).groupBy("one", "two").agg(F.array_sort(F.collect_list("offset")).alias("offsets"))
    begin = F.filter("offsets", lambda x, i: (i == 0) | (F.get("offsets", i - 1) != x - 1))
    end = F.filter("offsets", lambda x, i: (i == F.size("offsets") - 1) | (F.get("offsets", i + 1) != x + 1))
    parts = offsets.select("one", "two", F.arrays_zip(begin.alias("a"), end.alias("b")).alias("runs"))
    whole = F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("b")))
    runs = contexts.join(parts, ["one", "two"], "left").select("one", "two", F.when(F.col("n") > 1, whole).otherwise(F.col("runs")).alias("runs")).where("runs is not null")
    runs = materialize(runs, "hot-runs")
    # a few runs of some 16 bytes a context: broadcast below the measured bound, else a join whose hot contexts Spark splits
    small = (runs.agg(F.sum(F.size("runs") * 16 + 48)).first()[0] or 0) <= BROADCAST_BYTES
    spans = found.select("node", "at", "one", "two").join(F.broadcast(runs) if small else runs, ["one", "two"]).select("node", "at", F.explode("runs").alias("r"))
    return spans.select("node", (F.col("at") - F.col("r.b")).alias("first"), (F.col("at") - F.col("r.a") + LENGTH).alias("last"))


def merged_repeats(runs: DataFrame) -> DataFrame:
    """part, block -> node, first, last: bytes to remove."""

    def one(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []

        def close(group: list[tuple[int, bytes, bytes, int, np.ndarray]]) -> None:
            if len(group) > 1 or len(group[0][4]) > 1:
                for places, low, high in repeats(group):
                    out.append(np.stack([places[:, 0], places[:, 1] - high, places[:, 1] - low + LENGTH]))

        def batch() -> pa.RecordBatch:
            rows = np.concatenate(out, axis=1)
            out.clear()
            return pa.record_batch([pa.array(x) for x in rows], ["node", "first", "last"])

        group: list[tuple[int, bytes, bytes, int, np.ndarray]] = []
        for entry in merge(blocks):
            if group and entry[0] < SHARED:
                close(group)
                group = []
                if len(out) > 20_000:
                    yield batch()
            group.append(entry)
        if group:
            close(group)
        if out:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks = None, []
        for batch in batches:
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part and blocks:
                    yield from one(blocks)
                    blocks = []
                part = p
                blocks.append(block)
        if blocks:
            yield from one(blocks)

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "node long, first long, last long")


def cut_texts(texts: DataFrame) -> DataFrame:
    """texts(node, text, spans) -> node, n_removed, n_spans, kept (the remaining bytes), kept_sha256, removed (spans, merged)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode()
                removed: list[list[int]] = []
                for s in sorted((s["first"], s["last"]) for s in spans):
                    if removed and s[0] <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], s[1])
                    else:
                        removed.append(list(s))
                kept, at = [], 0
                for a, b in removed:
                    kept.append(raw[at:a])
                    at = b
                rest = b"".join([*kept, raw[at:]])
                out.append({"node": node, "n_removed": len(raw) - len(rest), "n_spans": len(removed), "kept_sha256": hashlib.sha256(rest).hexdigest(), "removed": [{"first": a, "last": b} for a, b in removed]})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("node", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]))

    return texts.select("node", "text", "spans").mapInArrow(run, "node long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<first: bigint, last: bigint>>")


def dedup(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of first byte, last byte + 1)."""
    spark = docs.sparkSession
    found = materialize(scan(docs), "anchors")
    texts = found.groupBy("sha").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    named = materialize(texts.join(found.select("row", "doc_id", "n_bytes", "keys"), F.col("node") == F.col("row")).drop("row"), "texts")
    posted = named.select("node", F.explode("keys").alias("key"))
    often = materialize(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    sums = often.agg(F.max("n"), F.sum(F.when(F.col("n") <= HOT, F.col("n")))).first()
    is_hot = F.col("n") > HOT
    wanted = posted.join(often, "key").groupBy("node").agg(F.collect_set(F.when(~is_hot, F.col("key"))).alias("keys"), F.collect_set(F.when(is_hot, F.col("key"))).alias("hot"))
    wanted = named.drop("keys").join(wanted, "node")
    source = with_defaults(docs, doc_id="long", text="string").withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    source = source.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    wanted = wanted.withColumn("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).select("sha", "doc_id", "node", "keys", "hot", "copies")
    chosen = source.join(wanted, ["sha", "doc_id"]).select("node", "text", "keys", "hot", "copies")
    chosen = materialize(chosen, "candidates")
    # rows that repeat both id and text come twice; each text is a source of suffixes once
    single = chosen.where("copies = 1").unionByName(chosen.where("copies > 1").dropDuplicates(["node"]))
    contexts = (sums[1] or 0) * (LENGTH + SPAN)
    parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 2, 8, -(-contexts // RANGE_BYTES)))
    n = max(named.count(), 1)
    share = min(1.0, max(16 * parts, min(64 * parts, 1 << 18)) / n)
    sample = sorted(bytes(r["sample"]) for r in found.where("sample is not null").where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("sample").collect())
    cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    spans = merged_repeats(sorted_runs(single.where(F.size("keys") > 0), cuts))
    if (sums[0] or 0) > HOT:
        spans = spans.unionByName(hot_repeats(single.where(F.size("hot") > 0)))
    listed = spans.groupBy("node").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    cut = cut_texts(chosen.where("copies = 1").select("node", "text").join(listed, "node").select("node", "text", "spans"))
    by_text = named.select("sha", "node", "copies").join(cut, "node", "left")
    rows = found.select("doc_id", "n_bytes", "sha").join(by_text, "sha")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    none = F.array().cast("array<struct<first: bigint, last: bigint>>")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_bytes").alias("last")))).otherwise(F.coalesce("removed", none)).alias("removed"),
    )
