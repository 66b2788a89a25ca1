"""Line dedup: passages of two lines or more that occur more than once in the corpus stay only where they occur first.

A text is split at newlines, and every two neighbouring lines are a pair, so no boundary can split a repeated passage. A pair
stays at its first place: the smallest doc_id that has it, and the first place there. Both lines of each later copy go, so
every line of a repeated passage goes from its later copies, however the text around it runs and wherever it is cut. (A copy
that begins with the second line of its own first place, as in three equal lines, takes its second line only.) What
goes is decided on the given texts, so a line that goes always stays at some earlier place. A blank pair (no line with a word)
takes nothing, so of three blank lines or more inside a passage the middle ones stay; a line that repeats alone stays, too.

Pairs are known by the SHA-256 of their bytes; only digests and places are grouped and joined, as tables, and copies combine before the shuffle.

Nulls and odd input: a null text stays null, with no lines; an empty text has one empty line; null doc_ids come after all
others in the choice of the first document; rows that share a doc_id count as one document for that choice. Empty input
gives an empty result. Extra columns pass through untouched,
but for one named line_dedup, which the result replaces.

Only DataFrame functions are used; array functions cut a text's lines, so a row is never spread over a group.

dedup_runs() is this. dedup() is an older rule that finds less: it cuts a text after the second of two lines wherever a hash of both is 0
modulo DIVISOR and removes only whole chunks, so passages that share a chunk with other text stay. No query uses it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import materialize

DIVISOR = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: array functions evaluate an argument anew wherever it is written."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunk_starts(lines: Column, divisor: int = DIVISOR) -> Column:
    """Places (from 1) of the lines that begin a chunk, and one past the last line."""
    n = F.size(lines)

    def places(hashes: Column) -> Column:
        rolled = F.transform(hashes, lambda h, i: F.when((i > 0) & (i < n - 1) & (F.pmod(F.shiftleft(F.get(hashes, i - 1), 7).bitwiseXOR(h), F.lit(divisor)) == 0), i + 2))
        return F.concat(F.array(F.lit(1)), F.array_compact(rolled), F.array(n + 1))

    return let(F.transform(lines, lambda x: F.xxhash64(x)), places)


def chunks(text: Column, divisor: int = DIVISOR) -> Column:
    """array<struct<first: int, n_lines: int, body: string>> of a text; null for null."""

    def cut(lines: Column) -> Column:
        def bodies(starts: Column) -> Column:
            ends = F.slice(starts, 2, F.size(starts) - 1)
            return F.transform(ends, lambda b, i: let(F.get(starts, i), lambda a: F.struct(a.alias("first"), (b - a).alias("n_lines"), F.array_join(F.slice(lines, a, b - a), "\n").alias("body"))))

        return let(chunk_starts(lines, divisor), bodies)

    return F.when(text.isNotNull(), let(F.split(text, "\n", -1), cut))


def eligible(chunk: Column) -> Column:
    return (chunk["n_lines"] >= 2) & chunk["body"].rlike(r"[^\x20\x09-\x0D]")


def repeated_chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """docs(doc_id, text) -> digest, first_doc, n_copies, n_lines of each multi-line chunk that occurs twice or more."""
    found = docs.select("doc_id", F.explode(F.filter(chunks(F.col("text"), divisor), eligible)).alias("chunk"))
    groups = found.groupBy(F.col("chunk.body").alias("body")).agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_copies"), F.min("chunk.n_lines").alias("n_lines"))
    by_digest = groups.select(F.unhex(F.sha2("body", 256)).alias("digest"), "first_doc", "n_copies", "n_lines")
    proved = by_digest.groupBy("digest").agg(F.min("first_doc").alias("first_doc"), F.sum("n_copies").alias("n_copies"), F.min("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("bodies"))
    return proved.where("n_copies > 1 and bodies = 1").drop("bodies")


def dedup(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """docs(doc_id, text, ...) -> all its columns with `text` cleaned, and a struct `line_dedup` of n_lines, n_removed_lines,
    n_removed_chunks and the removed spans (first line from 1, lines)."""
    docs = docs.drop("line_dedup", "__hits", "__chunks", "__digests", "__chosen")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = materialize(repeated_chunks(slim, divisor), "chunks")
    places = slim.select("doc_id", "text").where(F.col("text").contains("\n"))
    places = places.select("doc_id", F.explode(F.filter(chunks(F.col("text"), divisor), eligible)).alias("chunk"))
    occurrences = places.select("doc_id", F.unhex(F.sha2(F.col("chunk.body"), 256)).alias("digest"))
    hits = occurrences.join(repeated, "digest").groupBy("doc_id").agg(F.collect_set(F.struct("digest", F.col("doc_id").eqNullSafe(F.col("first_doc")).alias("own"))).alias("hits"))
    joined = docs.alias("d").join(hits.alias("h"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("h.doc_id")), "left").select("d.*", F.col("h.hits").alias("__hits"))
    body = chunks(F.col("text").cast("string"), divisor)
    marked = F.transform(body, lambda c: F.struct(c["first"].alias("first"), c["n_lines"].alias("n_lines"), c["body"].alias("body"), F.when(eligible(c), F.unhex(F.sha2(c["body"], 256))).alias("digest")))
    digests = F.transform(F.col("__chunks"), lambda c: c["digest"])
    goes = lambda c, i: F.exists(
        F.col("__hits"), lambda h: (h["digest"] == c["digest"]) & (~h["own"] | (F.array_position(F.col("__digests"), c["digest"]) != i + 1))
    )
    chosen = F.when(
        F.col("__hits").isNotNull() & F.col("text").isNotNull(),
        F.transform(F.col("__chunks"), lambda c, i: F.struct(c["first"].alias("first"), c["n_lines"].alias("n_lines"), c["body"].alias("body"), F.coalesce(goes(c, i), F.lit(False)).alias("goes"))),
    )
    out = joined.withColumn("__chunks", F.when(F.col("__hits").isNotNull(), marked)).withColumn("__digests", digests).withColumn("__chosen", chosen)
    gone = F.coalesce(F.filter("__chosen", lambda c: c["goes"]), F.array().cast("array<struct<first:int,n_lines:int,body:string,goes:boolean>>"))
    kept = F.array_join(F.transform(F.filter("__chosen", lambda c: ~c["goes"]), lambda c: c["body"]), "\n")
    total = lambda rows: F.aggregate(rows, F.lit(0), lambda s, c: s + c["n_lines"])
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    info = F.struct(
        n_lines.cast("long").alias("n_lines"),
        total(gone).cast("long").alias("n_removed_lines"),
        F.size(gone).cast("long").alias("n_removed_chunks"),
        F.transform(gone, lambda c: F.struct(c["first"].alias("first"), c["n_lines"].alias("n_lines"))).alias("removed"),
    )
    cleaned = F.when(F.size(gone) > 0, kept).otherwise(F.col("text"))
    kept_columns = [F.col(f"`{c}`") if c != "text" else cleaned.alias("text") for c in docs.columns]
    return out.select(*kept_columns, info.alias("line_dedup"))


def line_pairs(text: Column) -> Column:
    """array<binary>: the digest of each line with the next one, null for a blank pair."""
    return let(
        F.split(text, "\n", -1),
        lambda lines: F.transform(F.slice(lines, 1, F.size(lines) - 1), lambda x, i: let(F.concat(x, F.lit("\n"), F.get(lines, i + 1)), lambda b: F.when(b.rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.sha2(b, 256))))),
    )


def later_lines(hits: Column) -> Column:
    """Lines (from 0, ascending) that go, of the repeated pairs array<struct<digest, place, own>> of one text."""

    def places(h: Column) -> Column:
        def lines(x: Column, i: Column) -> Column:
            before, second = F.get(h, i - 1), F.get(h, i - 2)["digest"].eqNullSafe(x["digest"])
            again = before["digest"].eqNullSafe(x["digest"])
            overlap = again & ~second & (before["place"] == x["place"] - 1)
            at = x["place"]
            return F.when(x["own"] & ~again, F.array().cast("array<int>")).when(x["own"] & overlap, F.array(at + 1)).otherwise(F.array(at, at + 1))

        return F.array_sort(F.array_distinct(F.flatten(F.transform(h, lines))))

    return let(F.sort_array(hits), places)


def spans_of(lines: Column) -> Column:
    """array<struct<first: int, n_lines: int>> (from 1) of ascending lines (from 0)."""

    def spans(g: Column) -> Column:
        starts = F.filter(g, lambda x, i: (i == 0) | (F.get(g, i - 1) != x - 1))
        ends = F.filter(g, lambda x, i: (i == F.size(g) - 1) | (F.get(g, i + 1) != x + 1))
        return let(ends, lambda e: F.transform(starts, lambda a, i: F.struct((a + 1).alias("first"), (F.get(e, i) - a + 1).alias("n_lines"))))

    return let(lines, spans)


def without(text: Column, spans: Column) -> Column:
    """A text without some spans of its lines."""

    def cut(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(1)), F.transform(spans, lambda s: s["first"] + s["n_lines"]))
        ends = F.concat(F.transform(spans, lambda s: s["first"]), F.array(F.size(lines) + 1))
        kept = F.filter(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: s["b"] > s["a"])
        return F.array_join(F.transform(kept, lambda s: F.array_join(F.slice(lines, s["a"], s["b"] - s["a"]), "\n")), "\n")

    return let(F.split(text, "\n", -1), cut)


def dedup_runs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> all its columns with `text` cleaned, and a struct `line_dedup` of n_lines, n_removed_lines,
    n_removed_chunks (unbroken spans of lines) and the removed spans (first line from 1, lines)."""
    docs = docs.drop("line_dedup", "__removed")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").contains("\n"))
    # rows of one doc_id are told apart by their texts
    texts = materialize(slim.select("doc_id", F.unhex(F.sha2("text", 256)).alias("text_digest"), line_pairs(F.col("text")).alias("pairs")), "line-pairs")
    places = texts.select("doc_id", "text_digest", F.posexplode("pairs").alias("place", "digest")).where("digest is not null")
    repeated = places.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = places.join(repeated, "digest").select("doc_id", "text_digest", F.struct("digest", "place", F.col("doc_id").eqNullSafe(F.col("first_doc")).alias("own")).alias("hit"))
    gone = hits.groupBy("doc_id", "text_digest").agg(F.collect_set("hit").alias("hits")).select("doc_id", "text_digest", spans_of(later_lines(F.col("hits"))).alias("spans")).where(F.size("spans") > 0)
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.unhex(F.sha2(F.col("d.text").cast("string"), 256)) == F.col("g.text_digest"))
    out = docs.alias("d").join(materialize(gone, "line-spans").alias("g"), same, "left").select("d.*", F.col("g.spans").alias("__removed"))
    removed = F.coalesce("__removed", F.array().cast("array<struct<first:int,n_lines:int>>"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    info = F.struct(
        n_lines.cast("long").alias("n_lines"),
        F.aggregate(removed, F.lit(0), lambda s, c: s + c["n_lines"]).cast("long").alias("n_removed_lines"),
        F.size(removed).cast("long").alias("n_removed_chunks"),
        removed.alias("removed"),
    )
    cleaned = F.when(F.col("__removed").isNotNull(), without(F.col("text").cast("string"), F.col("__removed"))).otherwise(F.col("text"))
    kept_columns = [F.col(f"`{c}`") if c != "text" else cleaned.alias("text") for c in docs.columns]
    return out.select(*kept_columns, info.alias("line_dedup"))
