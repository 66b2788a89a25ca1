"""Near-duplicate groups by a signature-coordinate inverted join.

1. Every document gets the number of its distinct word shingles, a 128-bit fingerprint of that set and a MinHash
   signature of COORDINATES values. Documents of one set are one node from here on, so copies cost nothing more.
2. Each node is posted under its coordinate-value pairs; a pair that no other node has is dropped. Two sets at the
   similarity share at least MATCHES coordinates (all but 4 pairs in 10^5 at exactly 0.8, fewer above), so a node
   with fewer shared coordinates has no partner, and partners of a node with m of them meet in the m - MATCHES + 1 rarest: its
   prefix. Only prefixes are merged; the long lists of frequent values are skipped, and looked up by comparing signatures.
3. Short lists (SHORT nodes at most) give all their pairs; those with MATCHES collisions or more are confirmed on full sets.
   Longer lists are never multiplied out. Each names its most typical node (most shared coordinates) as leader, and every
   member's collisions with the leader are counted, and the two compared on full sets, which gives a link (MATCHES collisions and the
   similarity) or none, and the member's difference from the leader.
4. Members linked with the leader are one component. What remains are links with a member s that isn't. With d the difference of
   two sets and q = (1 - J) / (1 + J), a link of s and x means d(s, x) <= q(|s| + |x|), while d(s, leader) > q(|s| + |leader|). As
   d(s, x) = d(s) + d(x) - 2 |common differences|, the two must share more than half (but for sizes) of x's differences from the leader, and,
   taking x as the one with fewer, all but q(|s| + |x|) / 2 of them. So s and x meet in a prefix of x's differences, rarest first; what the
   whole list has in common is no difference, and the leader's own peculiarities come last. Pairs of different components that
      meet there, with enough differences to come and MATCHES collisions, are confirmed on full sets. So one threshold of collisions decides in
   lists of every length; no list, however long, is emitted as all its pairs.

Components come from minimum labels with pointer jumping, all in tables; nothing of the graph goes to the driver.

Nulls and odd input: a document without words (null, empty or blank) has no shingles and is linked with nothing; rows that share a doc_id are
documents of their own that share the id; a null doc_id is never the smallest of its component unless all are null. An empty
table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import discard, materialize, with_defaults
from sonolith.llm.textvec import Piece, mix, pieces, stream

COORDINATES, MATCHES = 64, 38
SIMILARITY = 80  # percent
#: Nodes in a list whose pairs are all compared.
SHORT = 6
_A, _B, _SALT = stream(21, COORDINATES) | np.uint64(1), stream(22, COORDINATES), stream(23, COORDINATES)


def set_marks(hashes: np.ndarray, docs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each document's shingles, which mark the set."""
    out = []
    for salt in (np.uint64(0x632BE59BD9B4E019), np.uint64(0x1B873593CC9E2D51)):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ salt), dtype=np.uint64)])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, text) -> row, doc_id, n_shingles, mark1, mark2, signature (null without shingles): keys of coordinate and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                piece.words()
                of, hashes, bounds = piece.shingles(shingle)
                count = np.diff(bounds)
                full = np.flatnonzero(count)
                one, two = set_marks(hashes, of, bounds)
                keys = np.empty((len(full), COORDINATES), np.uint64)
                for k in range(COORDINATES if len(full) else 0):
                    keys[:, k] = np.minimum.reduceat(hashes * _A[k] ^ _B[k], bounds[:-1][full])
                keys = mix(keys ^ _SALT) if len(full) else keys
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(count > 0, COORDINATES, 0))]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(piece.first, piece.n), batch.column(1).slice(piece.first, piece.n), pa.array(count.astype(np.int64)), pa.array(one), pa.array(two), lists], ["row", "doc_id", "n_shingles", "mark1", "mark2", "signature"])

    rows = with_defaults(docs, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(run, "row long, doc_id long, n_shingles long, mark1 long, mark2 long, signature array<bigint>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The full sets of wanted(node, doc_id, mark1, mark2): node, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(3)):
                piece.words()
                of, hashes, bounds = piece.shingles(shingle)
                one, two = set_marks(hashes, of, bounds)
                own = [batch.column(i).slice(piece.first, piece.n) for i in range(3)]
                same = pa.array((own[1].to_numpy() == one) & (own[2].to_numpy() == two))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.record_batch([own[0], lists], ["node", "shingles"]).filter(same)

    texts = with_defaults(docs, doc_id="long", text="string")
    joined = wanted.alias("w").join(texts.alias("d"), F.col("w.doc_id").eqNullSafe(F.col("d.doc_id"))).select("node", "mark1", "mark2", "text")
    return joined.mapInArrow(run, "node long, shingles array<bigint>").dropDuplicates(["node"])


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, label: the smallest node that is reachable. Minimum labels with pointer jumping, until nothing changes."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = labels.join(near, labels["node"] == near["at"]).select("node", "label", F.least("label", "near").alias("next"))
        step = materialize(step.join(jump, step["next"] == jump["via"], "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        discard(labels)
        labels = step.select("node", F.col("next").alias("label"))
        if step.where("label != next").isEmpty():
            return labels


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Of pairs(a, b) those whose full sets reach the similarity."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    sized = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return sized.where(100 * shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def groups(docs: DataFrame, shingle: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (smallest doc_id of the group), kept."""
    marked = materialize(signatures(docs, shingle), "signatures")
    sets = marked.where("n_shingles > 0").groupBy("mark1", "mark2").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"))
    sets = materialize(sets, "sets")
    nodes = marked.join(sets.select("node"), marked["row"] == F.col("node")).select("node", "doc_id", "mark1", "mark2", "n_shingles", "signature")
    posted = nodes.select("node", F.explode("signature").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = posted.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"), F.sum("df").alias("weight")).where(F.size("keys") >= MATCHES)
    prefixes = materialize(listed.select("node", "weight", F.expr(f"transform(slice(keys, 1, size(keys) - {MATCHES - 1}), k -> k.key)").alias("prefix")), "prefixes")
    posts = prefixes.select("node", "weight", F.explode("prefix").alias("key"))
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", F.struct("weight", -F.col("node"))).alias("leader")).where("n > 1")
    posts = materialize(posts.join(lists, "key").select("key", "node", "n", "leader"), "posts")
    wanted = materialize(nodes.join(posts.select("node").distinct(), "node", "left_semi"), "candidates")
    full = shingle_sets(docs, wanted.select("node", "doc_id", "mark1", "mark2"), shingle)
    full = materialize(full.join(wanted.select("node", "signature"), "node"), "shingle-sets")
    links = confirmed(colliding(short_pairs(posts), wanted, similarity), full, similarity)
    led = materialize(against_leaders(posts, full, similarity), "against-leaders")
    links = materialize(links.union(led.where("linked").select(F.col("node").alias("a"), F.col("leader").alias("b"))), "confirmed")
    labels = components(links)
    far = materialize(far_pairs(led, labels, similarity), "far-pairs")
    rest = materialize(confirmed(colliding(far, wanted, similarity), full, similarity), "far-links")
    if not rest.isEmpty():
        labels = components(links.union(rest))
    named = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    member = named.join(least, "label").select("mark1", "mark2", "component_id")
    alone = marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = marked.where("n_shingles > 0").join(member, ["mark1", "mark2"]).select("doc_id", "n_shingles", "component_id")
    return grouped.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def short_pairs(posts: DataFrame) -> DataFrame:
    """All pairs of the short lists; each list is a row, so its pairs are a bounded array."""
    short = posts.where(F.col("n") <= SHORT).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, SHORT), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return short.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def colliding(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Of pairs(a, b) those whose sizes allow the similarity and whose signatures share MATCHES coordinates."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("signature").alias(f"k{x}"), F.col("n_shingles").alias(f"n{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    return sized.where((100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")) & (F.size(F.array_intersect("ka", "kb")) >= MATCHES)).select("a", "b")


def against_leaders(posts: DataFrame, full: DataFrame, similarity: int) -> DataFrame:
    """Members of long lists against their leaders: node, leader, n, leader_n, linked (by collisions and full sets), differences. full(node, shingles,
    signature) is a written table, so that the members of one leader can be split."""
    edges = posts.where((F.col("n") > SHORT) & (F.col("node") != F.col("leader"))).select("node", "leader").distinct()
    heads = full.select(F.col("node").alias("leader"), F.col("shingles").alias("leader_set"), F.col("signature").alias("leader_signature"))
    members = edges.join(full, "node").select("node", "leader", "shingles", "signature")
    both = members.join(heads, "leader")
    collisions = F.size(F.array_intersect("signature", "leader_signature"))
    shared = F.size(F.array_intersect("shingles", "leader_set"))
    return both.select(
        "node",
        "leader",
        F.size("shingles").alias("n"),
        F.size("leader_set").alias("leader_n"),
        ((collisions >= MATCHES) & (100 * shared >= similarity * (F.size("shingles") + F.size("leader_set") - shared))).alias("linked"),
        F.concat(F.array_except("shingles", "leader_set"), F.array_except("leader_set", "shingles")).alias("differences"),
    )


def far_pairs(led: DataFrame, labels: DataFrame, similarity: int) -> DataFrame:
    """Pairs of different components in one list that may be linked though one isn't linked with the leader: a, b."""
    q = (100 - similarity) / (100 + similarity)
    found = led.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = labels.select(F.col("node").alias("leader"), F.col("label").alias("leader_label"))
    found = found.join(heads, "leader", "left").withColumn("leader_label", F.coalesce("leader_label", "leader"))
    mixed = found.groupBy("leader").agg(F.count_if(F.col("label") != F.col("leader_label")).alias("apart")).where("apart > 0").select("leader")
    d = F.size("differences")
    half = F.floor((d + q * (F.col("leader_n") - F.col("n"))) / 2)
    prefix_any = F.greatest(F.lit(0), F.least(d, d - half))
    prefix_fewer = F.least(prefix_any, F.floor(q * F.col("n") * (1 + 100 / similarity) / 2 + 1e-9) + 1)
    open_ = materialize(found.join(mixed, "leader").select("leader", "node", "label", "n", "linked", "differences", d.alias("d"), prefix_any.alias("prefix_any"), prefix_fewer.alias("prefix_fewer")), "open-groups")
    often = open_.select("leader", F.explode("differences").alias("e")).groupBy("leader", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    element = open_.select("leader", "node", F.explode("differences").alias("e")).join(often, ["leader", "e"])
    by_node = element.groupBy("leader", "node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("common"))
    # elements that only one node has come first in the order and lead nowhere
    ranked = open_.drop("differences").join(by_node, ["leader", "node"]).withColumn("skipped", F.col("d") - F.size("common"))
    reach = F.when(F.col("linked"), F.col("prefix_any")).otherwise(F.col("prefix_fewer")) - F.col("skipped")
    head = ranked.where(reach > 0).select("leader", "label", "n", "d", "linked", F.col("node").alias("x"), "prefix_any", "prefix_fewer", "skipped", F.posexplode(F.slice("common", F.lit(1), reach.cast("int"))).alias("pos", "c"))
    at = F.col("pos") + F.col("skipped")
    head = head.select("leader", F.col("c.e").alias("e"), "x", F.col("label").alias("x_label"), F.col("n").alias("x_n"), F.col("d").alias("x_d"), at.alias("x_at"), (at < F.col("prefix_fewer")).alias("early"), F.col("linked").alias("x_linked"))
    rest = ranked.where("not linked").select("leader", F.posexplode("common").alias("pos", "c"), "skipped", F.col("node").alias("s"), F.col("label").alias("s_label"), F.col("n").alias("s_n"), F.col("d").alias("s_d"))
    rest = rest.select("leader", F.col("c.e").alias("e"), "s", "s_label", "s_n", "s_d", at.alias("s_at"))
    meets = (F.col("early") & (F.col("s_d") >= F.col("x_d"))) | (F.col("x_linked") & (F.col("s_d") < F.col("x_d")))
    sizes = (100 * F.least("x_n", "s_n") >= similarity * F.greatest("x_n", "s_n")) & (F.abs(F.col("s_d") - F.col("x_d")) <= q * (F.col("s_n") + F.col("x_n")) + 1e-9)
    # from a pair's first common difference on, both sides must have as many left as the pair needs
    needed = (F.col("s_d") + F.col("x_d") - q * (F.col("s_n") + F.col("x_n"))) / 2
    left = F.least(F.col("x_d") - F.col("x_at"), F.col("s_d") - F.col("s_at")) >= needed - 1e-9
    pairs = head.join(rest, ["leader", "e"]).where((F.col("x_label") != F.col("s_label")) & meets & sizes & left)
    return pairs.select(F.least("x", "s").alias("a"), F.greatest("x", "s").alias("b")).distinct()
