"""Language of words and documents by a linear-chain conditional random field.

Each word is a position of the chain, each learned language a label. A word's features are its affixes (one to four
bytes at either end), its inner two- and three-byte grams, its form (non-ASCII bytes, digits, length) and the word
itself, the learned lexicon; all are hashed to one table of weights. Transitions are learned with them: training sequences are spliced from
windows of documents of several languages, so they hold both runs and switches. Forward-backward gives each word's
probability of each language. A document's language is the one with the largest sum over its words with letters, its score that
sum's share.

All words of a piece of the input form one chain whose transition at a document's first word is the initial distribution. It
is cut into blocks: transfer matrices of all blocks at once, one pass over the blocks, then all positions of all blocks
at once. That is exact for texts of any length.

Fitting takes a bounded sample: about SAMPLE documents of each language, twice as many at most, chosen by a hash of id and text, and of each a
window of at most WINDOW_CHARS characters at a hashed place; more than MOST_LABELS languages are refused. Prediction reads whole texts; a
very long one is held whole by its task, with about 40 bytes of working arrays for each of its bytes.

Nulls and odd input: a null text or one without a letter gives `und`, score 0; null and repeated doc_ids come out row for row;
without a labelled document every text is `und`. Empty input gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm.common import with_defaults
from sonolith.llm.textvec import _BYTE, PIECE, Piece, pieces, stream

SAMPLE, WINDOW_CHARS = 300, 3000
MOST_LABELS = 500
BUCKETS = 1 << 18
EPOCHS, SEQUENCE, BATCH, RATE = 3, 64, 48, 0.15
UNDETERMINED = "und"
_SALT = stream(11, 16)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    transitions: np.ndarray  # (labels, labels), log
    initial: np.ndarray  # (labels,), log


def features(piece: Piece, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the picked words: weight rows, and for each the word's place in `pick`."""
    start, end = piece.start[pick], piece.end[pick]
    size = end - start
    sums = piece.prefix(_BYTE[piece.low])
    every = np.arange(len(pick))
    rows, words = [], []

    def add(kind: int, hashes: np.ndarray, of: np.ndarray) -> None:
        rows.append(((hashes ^ _SALT[kind]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64))
        words.append(of)

    add(0, piece.hash[pick], every)
    for k in range(1, 5):
        of = np.flatnonzero(size >= k)
        add(k, piece.spans(sums, start[of], start[of] + k), of)
        add(4 + k, piece.spans(sums, end[of] - k, end[of]), of)
    for k in (2, 3):
        count = np.maximum(size - k + 1, 0)
        of = np.repeat(every, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[of]
        add(7 + k, piece.spans(sums, at, at + k), of)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([start, end])], axis=0)[0] > 0
    form = total(piece.data >= 128) + 2 * total((piece.data >= 48) & (piece.data < 58)) + 4 * np.minimum(size, 12)
    add(11, form.astype(np.uint64), every)
    return np.concatenate(rows), np.concatenate(words)


def emissions(model: Model, piece: Piece) -> np.ndarray:
    """Scores of each word of a piece for each label; different words are scored once."""
    _, pick, inverse = np.unique(piece.hash, return_index=True, return_inverse=True)
    rows, words = features(piece, pick)
    out = np.stack([np.bincount(words, model.weights[rows, j], minlength=len(pick)) for j in range(len(model.labels))], axis=1)
    return out[inverse]


def marginals(model: Model, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over one chain that begins anew where `first` is true: each position's probability of each label."""
    n, size = scores.shape
    if not n:
        return scores
    block = max(1, int(np.sqrt(n)))
    count = -(-n // block)
    p = np.ones((count * block, size))
    p[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    p = p.reshape(count, block, size)
    new = np.ones(count * block, bool)  # what pads the last block is cut off from it
    new[:n] = first
    new = new.reshape(count, block)
    move = np.exp(model.transitions)
    begin = np.exp(model.initial)
    transfer = np.broadcast_to(np.eye(size), (count, size, size)).copy()
    for t in range(block):
        stepped = transfer @ move
        stepped[new[:, t]] = transfer[new[:, t]].sum(axis=2, keepdims=True) * begin
        transfer = stepped * p[:, t, None, :]
        transfer /= transfer.max(axis=(1, 2), keepdims=True) + 1e-300
    into = np.ones((count, size))
    out_of = np.ones((count, size))
    for k in range(1, count):
        into[k] = into[k - 1] @ transfer[k - 1]
        into[k] /= into[k].sum() + 1e-300
    for k in range(count - 2, -1, -1):
        out_of[k] = transfer[k + 1] @ out_of[k + 1]
        out_of[k] /= out_of[k].sum() + 1e-300
    forward = np.empty_like(p)
    state = into
    for t in range(block):
        stepped = state @ move
        stepped[new[:, t]] = begin
        state = stepped * p[:, t]
        state /= state.sum(axis=1, keepdims=True) + 1e-300
        forward[:, t] = state
    state = out_of
    for t in range(block - 1, -1, -1):
        forward[:, t] *= state
        ahead = p[:, t] * state
        stepped = ahead @ move.T
        stepped[new[:, t]] = (ahead @ begin)[new[:, t], None]
        state = stepped / (stepped.sum(axis=1, keepdims=True) + 1e-300)
    both = forward.reshape(-1, size)[:n]
    return both / (both.sum(axis=1, keepdims=True) + 1e-300)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Fits weights and transitions together by AdaGrad on the chain's log-likelihood."""
    labels = sorted(set(langs))
    size = len(labels)
    model = Model(labels, np.zeros((BUCKETS, size)), np.zeros((size, size)), np.full(size, -np.log(max(size, 1))))
    if size < 2:
        return model
    of_label = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    # a piece's different words have their rows once, one after the other; `entry` is each word's place among them
    entries, table, counted = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    runs: list[tuple[int, int, int]] = []  # first word, words, label
    words = different = 0
    for piece in pieces(pa.array(texts, pa.large_string()), PIECE // 8):
        piece.words()
        _, pick, inverse = np.unique(piece.hash, return_index=True, return_inverse=True)
        rows, of = features(piece, pick)
        table.append(rows[np.argsort(of, kind="stable")].astype(np.int32))
        counted.append(np.bincount(of, minlength=len(pick)))
        entries.append((inverse + different).astype(np.int32))
        different += len(pick)
        for i in range(piece.n):
            a, b = int(piece.first_word[i]), int(piece.first_word[i + 1])
            while a < b:
                n = min(b - a, int(rng.integers(4, 33)))
                runs.append((words + a, n, of_label[langs[piece.first + i]]))
                a += n
        words += len(piece.hash)
    entry, row, n_rows = np.concatenate(entries), np.concatenate(table), np.concatenate(counted)
    first_row = np.cumsum(n_rows) - n_rows
    del entries, table, counted
    weight_sum, transition_sum = np.full_like(model.weights, 1e-8), np.full_like(model.transitions, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(runs))
        chain = np.concatenate([np.arange(runs[r][0], runs[r][0] + runs[r][1]) for r in order])
        gold = np.concatenate([np.full(runs[r][1], runs[r][2]) for r in order])
        usable = len(chain) // SEQUENCE * SEQUENCE
        if not usable:
            chain, gold = np.resize(chain, SEQUENCE), np.resize(gold, SEQUENCE)
            usable = SEQUENCE
        chain, gold = chain[:usable].reshape(-1, SEQUENCE), gold[:usable].reshape(-1, SEQUENCE)
        for at in range(0, len(chain), BATCH):
            ids, want = chain[at : at + BATCH], gold[at : at + BATCH]
            many = len(ids)
            own = entry[ids.ravel()]
            count = n_rows[own]
            of = np.repeat(np.arange(ids.size), count)
            rows = row[np.arange(len(of)) + np.repeat(first_row[own] - (np.cumsum(count) - count), count)]
            scores = np.stack([np.bincount(of, model.weights[rows, j], minlength=ids.size) for j in range(size)], axis=1).reshape(many, SEQUENCE, size)
            p = np.exp(scores - scores.max(axis=2, keepdims=True))
            move = np.exp(model.transitions)
            ahead = np.empty_like(p)
            back = np.ones_like(p)
            state = p[:, 0] / size
            ahead[:, 0] = state / state.sum(axis=1, keepdims=True)
            for t in range(1, SEQUENCE):
                state = (ahead[:, t - 1] @ move) * p[:, t]
                ahead[:, t] = state / state.sum(axis=1, keepdims=True)
            for t in range(SEQUENCE - 2, -1, -1):
                state = (p[:, t + 1] * back[:, t + 1]) @ move.T
                back[:, t] = state / state.sum(axis=1, keepdims=True)
            post = ahead * back
            post /= post.sum(axis=2, keepdims=True)
            pair = ahead[:, :-1, :, None] * move * (p[:, 1:] * back[:, 1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            seen = np.zeros_like(move)
            np.add.at(seen, (want[:, :-1].ravel(), want[:, 1:].ravel()), 1.0)
            step = seen - pair.sum(axis=(0, 1))
            transition_sum += step**2
            model.transitions += RATE * step / np.sqrt(transition_sum)
            error = -post.reshape(-1, size)
            error[np.arange(ids.size), want.ravel()] += 1
            for j in range(size):
                step = np.bincount(rows, error[of, j], minlength=BUCKETS)
                weight_sum[:, j] += step**2
                model.weights[:, j] += RATE * step / np.sqrt(weight_sum[:, j])
    model.weights = model.weights.astype(np.float32)
    return model


def fit(labelled: DataFrame, sample: int = SAMPLE, window: int = WINDOW_CHARS) -> Model:
    """Fits on a sample of labelled(doc_id, text, lang): about `sample` documents of each language, twice as many at most, chosen by a hash of id and text."""
    rows = with_defaults(labelled, doc_id="long", text="string", lang="string").where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LABELS + 1).collect()}
    if not counts:
        return train([], [])
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} languages: the table of weights has a column for each")
    by_hash = F.xxhash64(F.lit("sample"), "doc_id", "text")
    part = F.pmod(by_hash, F.lit(1 << 20))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1 << 20, int(sample / n * (1 << 20)) + 1)))])
    place = F.pmod(F.xxhash64(F.lit("window"), "doc_id", "text"), F.greatest(F.length("text") - window, F.lit(0)) + 1)
    # rows that repeat id and text have one hash, so a language's rows are also numbered; Spark cuts them before the shuffle
    order = Window.partitionBy("lang").orderBy("of_hash", "doc_id")
    picked = rows.where(part < F.element_at(share, F.col("lang"))).select("doc_id", "lang", by_hash.alias("of_hash"), F.substring("text", (place + 1).cast("int"), F.lit(window)).alias("text"))
    picked = picked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 2 * sample)
    found = sorted((r["lang"], r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in picked.collect())
    return train([t for _, _, t in found], [x for x, _, _ in found])


def label_piece(model: Model, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Per word of a piece: probability of each label, and whether it has a letter."""
    piece.words()
    new = np.zeros(len(piece.hash), bool)
    new[piece.first_word[:-1][np.diff(piece.first_word) > 0]] = True
    letters = np.concatenate([[0], np.cumsum(_LETTER[piece.low])])
    return marginals(model, emissions(model, piece), new), letters[piece.end] > letters[piece.start]


def has_letter(piece: Piece, i: int) -> bool:
    own = piece.data[piece.offs[i] : piece.offs[i + 1]]
    low = own | 32
    return bool(((low >= 97) & (low < 123)).any()) or any(c.isalpha() for c in own.tobytes().decode())


def decide(model: Model, piece: Piece, runs: bool) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """Per document of a piece: language, score and, if asked for, its runs."""
    langs, scores, spans = [UNDETERMINED] * piece.n, np.zeros(piece.n), [[] for _ in range(piece.n)]
    if not model.labels or not len(piece.data):
        return langs, scores, spans
    share, letter = label_piece(model, piece)
    sums = np.concatenate([np.zeros((1, share.shape[1])), np.cumsum(share * letter[:, None], axis=0)])
    total = sums[piece.first_word[1:]] - sums[piece.first_word[:-1]]
    best = total.argmax(axis=1)
    whole = total.sum(axis=1)
    for i in np.flatnonzero(whole > 0):
        if has_letter(piece, i):
            langs[i], scores[i] = model.labels[best[i]], min(1.0, max(0.0, total[i, best[i]] / whole[i]))
    if runs:
        top = share.argmax(axis=1)
        for i in range(piece.n):
            own = top[piece.first_word[i] : piece.first_word[i + 1]]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) if len(own) else []
            spans[i] = [{"first": int(a), "words": int(b - a), "lang": model.labels[own[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]
    return langs, scores, spans


def predict(docs: DataFrame, model: Model, runs: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score; with `runs` also the runs of words of one language: first word, words, lang."""
    schema = "doc_id long, lang_pred string, score double" + (", runs array<struct<first: int, words: int, lang: string>>" if runs else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(1)):
                langs, scores, spans = decide(model, piece, runs)
                columns = [batch.column(0).slice(piece.first, piece.n), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                if runs:
                    columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
                yield pa.record_batch(columns, ["doc_id", "lang_pred", "score", "runs"][: len(columns)])

    return with_defaults(docs, doc_id="long", text="string").mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model, majority: float) -> DataFrame:
    """The rows, whole, whose text has a language with at least `majority` of the words' probability."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = np.zeros(batch.num_rows, bool)
            for piece in pieces(batch.column(at)):
                langs, scores, _ = decide(model, piece, False)
                mask[piece.first : piece.first + piece.n] = (np.array(langs) != UNDETERMINED) & (scores >= majority)
            yield batch.filter(pa.array(mask))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id", fold: int = 1, folds: int = 3):  # noqa: ANN201
    """True for documents that no model is learned from: crc32 of the id's digits modulo `folds` is `fold`. A null id is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents outside the held-out fold and predicts all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
