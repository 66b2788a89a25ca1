"""Brown class-based bigram language model: exchange clustering, class transitions and word emissions.

1. Word counts over all training documents, one row for each different word.
2. Exchange clustering, word by word: the WORDS most frequent words and, for all others, SUFFIXES groups by a hash of the last three bytes move
   between CLASSES classes while that raises the likelihood of the corpus's bigrams; the end of a text is a class of its own.
3. Exchange of the rest of the vocabulary, in one distributed pass: every other word that occurs FLOOR times or more moves to the class
   that raises the likelihood most, given the classes of all its neighbours in the corpus and the table of class bigrams of step 2.
   How many words are clustered by their own contexts so grows with the input; only words that are rarer keep the class of their group, whose
   contexts together have been exchanged in step 2.
4. P(text) = product of P(class | class before) * P(word | class). Transitions are counted anew over all training texts with the final classes
   and interpolate with the class's own probability by Witten-Bell; emissions add one to each word's count and to one unseen word.

The counts and classes of the HEAD most frequent words at most travel with the tasks; a text's rarer words are joined with
the table of counts and classes by a shuffle, by their places in the text. Words are known by 64-bit hashes.

Held-out documents of sf0.1, log10 of the probability a token: -4.191 for the unigram base, -3.911 without step 3, -3.836, -3.790 and -3.759 with it
at a FLOOR of 32, 8 and 2.

Nulls and odd input: a null text is empty (its end is its only token); null doc_ids are learned from; rows that share a
doc_id are scored row for row; with nothing to learn from all counts are 0; a very long text is held whole by its task, with some dozens of
bytes of working arrays for each of its bytes. Empty input gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import discard, materialize, with_defaults
from sonolith.llm.textvec import _BYTE, Piece, pieces

WORDS, SUFFIXES, CLASSES, ROUNDS = 1024, 512, 64, 4
#: Occurrences from which a word is clustered by its own contexts.
FLOOR = 2
SLOTS = 2 * (CLASSES + 1)
ITEMS = WORDS + SUFFIXES + 1
END = ITEMS - 1
HEAD = 1 << 17
#: Different words that a task holds before it passes their counts on.
HELD = 400_000


@dataclass
class Model:
    groups: np.ndarray  # class of each group of endings
    transitions: np.ndarray  # log10 P(class | class before), (CLASSES + 1) squared
    norms: np.ndarray  # log10 of each class's emission denominator
    head: np.ndarray  # hashes of the words that travel, ascending
    head_count: np.ndarray
    head_class: np.ndarray
    tokens: int
    types: int
    ends: int


def suffix_groups(piece: Piece) -> np.ndarray:
    sums = piece.prefix(_BYTE[piece.low])
    return (piece.spans(sums, np.maximum(piece.start, piece.end - 3), piece.end) % np.uint64(SUFFIXES)).astype(np.int64)


def items(piece: Piece, top: np.ndarray, top_item: np.ndarray) -> np.ndarray:
    """The item of each word."""
    out = WORDS + suffix_groups(piece)
    if len(top):
        at = np.minimum(np.searchsorted(top, piece.hash), len(top) - 1)
        known = top[at] == piece.hash
        out[known] = top_item[at[known]]
    return out


def steps(piece: Piece, of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbours in each document, end to end: before, after, document."""
    n = len(of_word) + piece.n
    place = np.arange(len(of_word)) + piece.doc
    after = np.full(n, END, np.int64)
    after[place] = of_word
    before = np.empty(n, np.int64)
    before[1:] = after[:-1]
    before[:1] = END
    doc = np.repeat(np.arange(piece.n), np.diff(piece.first_word) + 1)
    return before, after, doc


def word_counts(texts: DataFrame) -> DataFrame:
    """texts(text) -> word (its hash), suffix, n: one row for each different word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            hashes, suffixes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            unique, pick, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            return unique, suffixes[pick], np.bincount(inverse, counts).astype(np.int64)

        def out(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(found[0]), 100_000):
                yield pa.record_batch([pa.array(found[0][a : a + 100_000].view(np.int64)), pa.array(found[1][a : a + 100_000].astype(np.int32)), pa.array(found[2][a : a + 100_000])], ["word", "suffix", "n"])

        for batch in batches:
            for piece in pieces(batch.column(0)):
                piece.words()
                unique, pick, counts = np.unique(piece.hash, return_index=True, return_counts=True)
                held.append((unique, suffix_groups(piece)[pick], counts))
                if sum(len(x[0]) for x in held) > HELD:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield from out(held.pop())
        if held:
            yield from out(merged())

    return texts.select("text").mapInArrow(run, "word long, suffix int, n long").groupBy("word").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"))


def item_bigrams(texts: DataFrame, top: np.ndarray, top_item: np.ndarray) -> np.ndarray:
    """Counts of item pairs over texts(text), a matrix of ITEMS squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ITEMS * ITEMS, np.int64)
        for batch in batches:
            for piece in pieces(batch.column(0)):
                piece.words()
                before, after, _ = steps(piece, items(piece, top, top_item))
                total += np.bincount(before * ITEMS + after, minlength=len(total))
        pair = np.flatnonzero(total)
        for a in range(0, len(pair), 200_000):
            yield pa.record_batch([pa.array(pair[a : a + 200_000].astype(np.int32)), pa.array(total[pair[a : a + 200_000]])], ["pair", "n"])

    found = texts.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(ITEMS * ITEMS, np.int64)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(ITEMS, ITEMS)


def exchange(counts: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each item; the last item keeps a class of its own, `classes`. Items without counts stay where they begin."""
    n = len(counts)
    weight = counts.sum(axis=0) + counts.sum(axis=1)
    order = [i for i in np.argsort(-weight, kind="stable") if i != n - 1]
    own = np.empty(n, np.int64)
    own[order] = np.arange(n - 1) % classes
    own[n - 1] = classes
    size = classes + 1
    real = counts.astype(np.float64)
    member = np.eye(size)[own]
    from_class, to_class = member.T @ real, real @ member  # class -> item, item -> class
    table = from_class @ member

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1.0))

    for _ in range(rounds):
        moved = 0
        for i in order:
            if not weight[i]:
                break
            k, twice = own[i], real[i, i]
            left, right = from_class[:, i].copy(), to_class[i].copy()
            left[k] -= twice
            right[k] -= twice
            table[k] -= right
            table[:, k] -= left
            table[k, k] -= twice
            out, into = table.sum(axis=1), table.sum(axis=0)
            value = f(table)
            rows = f(table + right[None, :]) - value
            columns = f(table + left[:, None]) - value
            diagonal = np.diagonal(table)
            gain = rows.sum(axis=1) - np.diagonal(rows) + columns.sum(axis=0) - np.diagonal(columns) + f(diagonal + left + right + twice) - f(diagonal)
            gain -= f(out + right.sum() + twice) - f(out) + f(into + left.sum() + twice) - f(into)
            to = int(np.argmax(gain[:classes]))
            if gain[to] <= gain[k] + 1e-9:
                to = k
            table[to] += right
            table[:, to] += left
            table[to, to] += twice
            if to != k:
                moved += 1
                own[i] = to
                from_class[k] -= real[i]
                from_class[to] += real[i]
                to_class[:, k] -= real[:, i]
                to_class[:, to] += real[:, i]
        if not moved:
            break
    return own


def look_up(words: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in `head` of each word, and whether it is there."""
    if not len(head):
        return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
    at = np.minimum(np.searchsorted(head, words), len(head) - 1)
    return at, head[at] == words


def contexts(texts: DataFrame, top: np.ndarray, top_item: np.ndarray, classes: np.ndarray, head: np.ndarray, wanted: np.ndarray, beyond: bool) -> DataFrame:
    """Classes before and after words: key, far, slots (array<struct<slot, n>>). Of wanted words in the head the key is the place there, and a
    slot is the class before, or CLASSES + 1 + the class after; of words beyond the head (far) it is the hash, and a slot, from SLOTS on, both classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows(key: np.ndarray, slot: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(key), 200_000):
                yield pa.record_batch([pa.array(key[a : a + 200_000]), pa.array(slot[a : a + 200_000].astype(np.int32)), pa.array(n[a : a + 200_000].astype(np.int32))], ["key", "slot", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield from rows(pair // SLOTS, pair % SLOTS, n)

        for batch in batches:
            for piece in pieces(batch.column(0)):
                piece.words()
                item = items(piece, top, top_item)
                before, after, _ = steps(piece, item)
                place = np.arange(len(item)) + piece.doc
                left, right = classes[before[place]], classes[after[place + 1]]
                at, known = look_up(piece.hash, head)
                if beyond:
                    pick = np.flatnonzero(~known)
                    yield from rows(piece.hash[pick].view(np.int64), SLOTS + left[pick] * (CLASSES + 1) + right[pick], np.ones(len(pick), np.int32))
                if len(head):
                    known &= wanted[at]
                held += [at[known] * SLOTS + left[known], at[known] * SLOTS + CLASSES + 1 + right[known]]
                if sum(map(len, held)) > 4_000_000:
                    yield from flush()
        if held:
            yield from flush()

    found = texts.select("text").mapInArrow(run, "key long, slot int, n int").groupBy("key", "slot").agg(F.sum("n").alias("n"))
    return found.groupBy("key", (F.col("slot") >= SLOTS).alias("far")).agg(F.collect_list(F.struct("slot", "n")).alias("slots"))


def best_classes(found: DataFrame, moves: np.ndarray) -> DataFrame:
    """found(key, far, slots) -> key, far, class: where the words' contexts are most likely given the class, by moves (counts of class bigrams)."""
    smooth = moves + 0.5
    before = np.log(smooth / smooth.sum(axis=0, keepdims=True))[:, :CLASSES]  # P(class before | class)
    after = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T[:, :CLASSES]  # P(class after | class)
    gain = np.concatenate([before, after])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            slot, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            both = slot >= SLOTS
            table = np.zeros((batch.num_rows, SLOTS))
            np.add.at(table, (of, np.where(both, (slot - SLOTS) // (CLASSES + 1), slot)), n)
            np.add.at(table, (of[both], CLASSES + 1 + (slot[both] - SLOTS) % (CLASSES + 1)), n[both])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array((table @ gain).argmax(axis=1).astype(np.int32))], ["key", "far", "class"])

    return found.select("key", "far", "slots").mapInArrow(run, "key long, far boolean, class int")


def chains(docs: DataFrame, model: Model) -> DataFrame:
    """docs(row, doc_id, text, learn) -> row, doc_id, learn, n_tokens, known and counts (of words in the head), classes (a byte for each word), and the words
    that aren't there, whose class is their group's so far: rest, rest_at (place in the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.append(np.log10(model.head_count + 1.0), 0.0)
        for batch in batches:
            for piece in pieces(batch.column(2)):
                piece.words()
                at, known = look_up(piece.hash, model.head)
                own = model.groups[suffix_groups(piece)].astype(np.uint8)
                own[known] = model.head_class[at[known]]
                counts = np.bincount(piece.doc[known], logs[at[known]], minlength=piece.n).astype(np.float64)
                bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(piece.doc[~known], minlength=piece.n))]).astype(np.int32))
                place = (np.arange(len(piece.hash)) - piece.first_word[piece.doc])[~known].astype(np.int32)
                offsets = pa.py_buffer(piece.first_word.astype(np.int32))
                classes = pa.BinaryArray.from_buffers(pa.binary(), piece.n, [None, offsets, pa.py_buffer(own)])
                given = [batch.column(i).slice(piece.first, piece.n) for i in (0, 1, 3)]
                rest = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (piece.hash[~known].view(np.int64), place)]
                yield pa.record_batch(
                    [*given, pa.array(np.diff(piece.first_word) + 1), pa.array(np.bincount(piece.doc[known], minlength=piece.n)), pa.array(counts), classes, *rest],
                    ["row", "doc_id", "learn", "n_tokens", "known", "counts", "classes", "rest", "rest_at"],
                )

    return docs.mapInArrow(run, "row long, doc_id long, learn boolean, n_tokens long, known long, counts double, classes binary, rest array<bigint>, rest_at array<int>")


def flat_list(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds of each row's part of the flat values, and these; a null list is empty."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), lists.flatten()


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bytes of a binary column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bounds - bounds[0], data[bounds[0] : bounds[-1]]


def prepared(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """docs(doc_id, text, learn) and rare(word, n, class) -> doc_id, learn, n_tokens, n_known (but for the end), counts (sum of log10(count + 1)) and the
    final classes (a byte for each word), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, data = flat_bytes(batch.column(4))
            out = data.copy()
            rest, at = flat_list(batch.column(5))
            fills, found = flat_list(batch.column(6))
            row = np.repeat(np.arange(batch.num_rows), np.diff(fills))
            if len(row):
                out[bounds[row] + at.to_numpy()[rest[row] + found.field(0).to_numpy()]] = found.field(1).to_numpy()
            classes = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out)])
            yield pa.record_batch([*(batch.column(i) for i in range(4)), classes], ["row", "n_tokens", "n_known", "counts", "classes"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("learn").cast("boolean").alias("learn"))
    part = materialize(chains(rows, model), "lm-chains")
    hits = part.select("row", F.posexplode("rest").alias("place", "word")).join(rare, "word")
    fills = F.collect_list(F.when(F.col("class").isNotNull(), F.struct("place", "class"))).alias("fills")
    found = hits.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("rare_counts"), F.count(F.lit(1)).alias("rare_known"), fills)
    both = part.drop("rest").join(found, "row", "left").select(
        F.struct("row", "doc_id", "learn").alias("row"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        (F.col("counts") + F.coalesce("rare_counts", F.lit(0.0))).alias("counts"),
        "classes",
        F.when(F.size("fills") > 0, F.col("rest_at")).alias("rest_at"),
        "fills",
    )
    filled = both.mapInArrow(run, "row struct<row: long, doc_id: long, learn: boolean>, n_tokens long, n_known long, counts double, classes binary")
    out = materialize(filled.select("row.doc_id", "row.learn", "n_tokens", "n_known", "counts", "classes"), "lm-classes")
    discard(part)
    return out


def chain_steps(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of neighbouring classes in each document, end to end: before, after, document."""
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    after = np.full(len(data) + len(sizes), CLASSES, np.int64)
    after[np.arange(len(data)) + doc] = data
    before = np.empty_like(after)
    before[1:] = after[:-1]
    before[:1] = CLASSES
    return before, after, np.repeat(np.arange(len(sizes)), sizes + 1)


def class_moves(classes: DataFrame) -> np.ndarray:
    """Counts of class bigrams over classes(classes), end to end."""
    size = CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            before, after, _ = chain_steps(*flat_bytes(batch.column(0)))
            total += np.bincount(before * size + after, minlength=size * size)
        pair = np.flatnonzero(total)
        yield pa.record_batch([pa.array(pair.astype(np.int32)), pa.array(total[pair])], ["pair", "n"])

    found = classes.select("classes").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def fit_words(training: DataFrame) -> tuple[Model, DataFrame]:
    """Counts and classes of the words of training(text): the model without transitions, and the table of words beyond the head."""
    texts = with_defaults(training, text="string")
    ends = texts.count()
    table = materialize(word_counts(texts).withColumn("band", F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")), "word-counts")
    bands = table.groupBy("band").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), F.max("n").alias("most")).orderBy(F.desc("band")).collect()
    least, room = 1 << 30, HEAD
    for b in bands:
        if b["types"] > room:
            break
        least, room = b["band"], room - b["types"]
    found = table.where(F.col("band") >= least).select("word", "suffix", "n").toArrow()
    head, suffix, count = found["word"].to_numpy().view(np.uint64), found["suffix"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(head)
    head, suffix, count = head[order], suffix[order], count[order]
    pick = np.sort(np.lexsort((head, -count))[:WORDS])
    top, top_item = head[pick], np.arange(len(pick))
    matrix = item_bigrams(texts, top, top_item)
    classes = exchange(matrix)
    member = np.eye(CLASSES + 1)[classes]
    # every other word that is not too rare goes where its own contexts fit best
    groups = classes[WORDS : WORDS + SUFFIXES]
    wanted = count >= FLOOR
    wanted[pick] = False
    beyond = any(b["band"] < least and b["most"] >= FLOOR for b in bands)
    classed = best_classes(contexts(texts, top, top_item, classes, head, wanted, beyond), member.T @ matrix @ member)
    classed = materialize(classed, "word-classes")
    head_class = groups[suffix]
    head_class[pick] = classes[: len(pick)]
    own = classed.where("not far").toArrow()
    head_class[own["key"].to_numpy()] = own["class"].to_numpy()
    rare = table.where(F.col("band") < least).join(classed.where("far").select(F.col("key").alias("word"), F.col("class").alias("own")), "word", "left")
    rare = materialize(rare.select("word", "suffix", "n", F.when(F.col("n") >= FLOOR, F.col("own")).alias("class")), "rare-words")
    weight = np.bincount(head_class, count + 1.0, minlength=CLASSES + 1)
    for r in rare.groupBy("class", F.when(F.col("class").isNull(), F.col("suffix")).alias("suffix")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
        weight[groups[r["suffix"]] if r["class"] is None else r["class"]] += r["n"]
    norms = np.log10(weight + 1)
    norms[CLASSES] = 0.0
    tokens, types = int(sum(b["tokens"] for b in bands) + ends), int(sum(b["types"] for b in bands) + (ends > 0))
    return Model(groups, np.zeros((CLASSES + 1, CLASSES + 1)), norms, head, count, head_class, tokens, types, ends), rare.select("word", "n", "class")


def transitions(moves: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), Witten-Bell."""
    into = moves.sum(axis=0)
    lower = (into + 1) / (into.sum() + CLASSES + 1)
    followers = np.maximum((moves > 0).sum(axis=1, keepdims=True), 1)
    return np.log10((moves + followers * lower) / (moves.sum(axis=1, keepdims=True) + followers))


def fit(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model of training(text), and the table of word counts and classes that scoring joins."""
    model, rare = fit_words(training)
    texts = with_defaults(training, text="string").select(F.lit(0).alias("doc_id"), "text", F.lit(True).alias("learn"))
    model.transitions = transitions(class_moves(prepared(texts, model, rare)))
    return model, rare


def scores(classes: DataFrame, model: Model) -> DataFrame:
    """prepared() -> doc_id, learn, n_tokens, n_known, train_tokens, base_score, score, perplexity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, after, doc = chain_steps(*flat_bytes(batch.column(5)))
            chain = np.bincount(doc, model.transitions[before, after] - model.norms[after], minlength=batch.num_rows).astype(np.float64)
            yield pa.record_batch([*(batch.column(i) for i in range(5)), pa.array(chain)], ["doc_id", "learn", "n_tokens", "n_known", "counts", "chain"])

    found = classes.select("doc_id", "learn", "n_tokens", "n_known", "counts", "classes").mapInArrow(run, "doc_id long, learn boolean, n_tokens long, n_known long, counts double, chain double")
    end = float(np.log10(model.ends + 1.0))
    total = F.col("chain") + F.col("counts")
    return found.select(
        "doc_id",
        "learn",
        "n_tokens",
        (F.col("n_known") + (1 if model.ends else 0)).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("counts") + end - F.col("n_tokens") * float(np.log10(model.tokens + model.types + 1.0))).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def score(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    rows = with_defaults(docs, doc_id="long", text="string").withColumn("learn", F.lit(False))
    return scores(prepared(rows, model, rare), model).drop("learn")


def fit_and_score(docs: DataFrame, learn: Column) -> DataFrame:
    """Learns from the rows where `learn` holds and scores all, with one pass for what both need; as score(), with `learn`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), learn.alias("learn"))
    model, rare = fit_words(rows.where("learn"))
    classes = prepared(rows, model, rare)
    model.transitions = transitions(class_moves(classes.where("learn")))
    return scores(classes, model)
