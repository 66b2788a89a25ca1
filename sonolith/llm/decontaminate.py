"""Benchmark decontamination: finds test items inside documents by containment of word shingles.

An item is found in a document that holds at least CONTAINMENT of the item's distinct five-word shingles, wherever in the
document they stand and however long it is.

1. Sketches. Items are partitioned by size (number of shingles, doubling). A partition's MinHash sketch keeps each item's K smallest shingle
   hashes, with K = floor((1 - CONTAINMENT) * largest size) + 1 for the partition: of any CONTAINMENT of an item's
   shingles at least one is among them, so a document without a hit in an item's sketch can't hold the item.
2. Search. Documents probe the sketches, and nothing else, with the hashes of their shingles; a row is an id and a hash. Each hit makes the
   document and the item a candidate. The sketches are broadcast if their measured size is below BROADCAST_BYTES, else joined by a shuffle.
3. Verification. Only candidates' texts are read again; their shingles are joined, as words, with the whole shingle sets of
   just the items that they are candidates for, and the share is exact.

Words are lower-cased by Unicode rules. An item of fewer than five words is one shingle of its own length, and documents probe with their
shingles of each such length (1 to 4) that items have, so it is found inside longer documents, too. Nulls
and odd input: null, empty and blank texts hold nothing and are held by nothing; items or documents that share an id are
told apart by their text only where the counts differ (a repeated row adds nothing, for shingles are counted once by
id). A very long text is one array of words in its task; its shingles leave as rows. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import materialize, with_defaults, words

SHINGLE, CONTAINMENT = 5, 0.8
BROADCAST_BYTES = 32 << 20


def places(tokens: Column, k: int = SHINGLE) -> Column:
    """Places (from 1) at which a shingle begins."""
    n = F.size(tokens)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))))


def item_shingles(items: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """items(item_id, text) -> item_id, n_shingles, hash, shingle, length (words), in_sketch: a row for each distinct shingle of an item."""
    tokens = words(F.lower("text"))
    every = with_defaults(items, item_id="long", text="string").withColumn("tokens", tokens)
    rows = every.select("item_id", F.explode(F.transform(places(F.col("tokens"), k), lambda i: F.slice("tokens", i, k))).alias("words")).distinct()
    rows = rows.select("item_id", F.xxhash64("words").alias("hash"), F.array_join("words", " ").alias("shingle"), F.size("words").alias("length"))
    sizes = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"), F.sort_array(F.collect_list("hash")).alias("hashes"))
    largest = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_shingles").cast("double"))))
    sketch = (F.floor((1 - containment) * largest + 1e-9) + 1).cast("int")
    bound = F.element_at("hashes", F.least(sketch, F.size("hashes")))
    sizes = sizes.select(F.col("item_id").alias("of_item"), "n_shingles", bound.alias("bound"))
    return rows.join(sizes, F.col("item_id").eqNullSafe(F.col("of_item"))).select("item_id", "n_shingles", "hash", "shingle", "length", (F.col("hash") <= F.col("bound")).alias("in_sketch"))


def shingles_of(docs: DataFrame, length: int, k: int, value: Callable[[Column], Column], name: str) -> DataFrame:
    """docs(doc_id, tokens) -> doc_id, name: value (of the words) for each different shingle of `length` words."""
    long_enough = F.when(F.size("tokens") >= length, places(F.col("tokens"), length)).otherwise(F.array().cast("array<int>"))
    return docs.select("doc_id", F.explode(F.array_distinct(F.transform(long_enough, lambda i: value(F.slice("tokens", i, length))))).alias(name))


def candidates(docs: DataFrame, sketches: DataFrame, lengths: list[int], k: int = SHINGLE) -> DataFrame:
    """docs(doc_id, tokens), sketches(item_id, hash) -> doc_id, item_id of each document with a hit in an item's sketch."""
    hits = [shingles_of(docs, n, k, lambda w: F.xxhash64(w), "hash").join(sketches, "hash").select("doc_id", "item_id") for n in lengths]
    return reduce(DataFrame.unionByName, hits).distinct()


def contaminated(docs: DataFrame, items: DataFrame, k: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, item_id, n_shingles, n_shared, containment, one row for each item found in a document."""
    whole = materialize(item_shingles(items, k, containment), "item-shingles")
    sketches = whole.where("in_sketch").select("item_id", "hash")
    measured = whole.agg(F.count_if("in_sketch"), F.collect_set("length")).first()
    lengths = sorted(measured[1]) or [k]
    if measured[0] * 64 <= BROADCAST_BYTES:
        sketches = F.broadcast(sketches)
    tokens = with_defaults(docs, doc_id="long", text="string").select("doc_id", words(F.lower("text")).alias("tokens"))
    found = materialize(candidates(tokens, sketches, lengths, k), "candidates")
    named = found.select(F.col("doc_id").alias("of_doc")).distinct()
    held = tokens.join(named, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left_semi")
    held = reduce(DataFrame.unionByName, [shingles_of(held, n, k, lambda w: F.array_join(w, " "), "shingle") for n in lengths]).distinct()
    sought = found.alias("f").join(whole.alias("w"), F.col("f.item_id").eqNullSafe(F.col("w.item_id"))).select(F.col("f.doc_id").alias("of_doc"), "w.item_id", "w.n_shingles", F.col("w.shingle").alias("sought"))
    shared = held.join(sought, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("shingle") == F.col("sought")))
    pairs = shared.groupBy("doc_id", "item_id").agg(F.max("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n_shared"))
    return pairs.where(F.col("n_shared") >= containment * F.col("n_shingles")).select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item; a null doc_id is told by null-safe comparison."""
    found = contaminated(docs, items).select(F.col("doc_id").alias("__found")).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["__found"]), "left_anti")
