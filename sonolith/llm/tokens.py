"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists every piece that occurs in a text; a pass over end positions keeps, for
each, only the best score and its number of tokens. Ties go by the tokenizer's rule: a later candidate for an end position
wins only with a strictly higher score, and candidates come by ascending start, so the longest piece wins. A character that
no single-character piece covers may also be taken alone as unknown at the lowest score less 10; it counts one token for each of its bytes
(byte fallback), or, without byte pieces, one for each run of unknown characters.

Texts are written as the tokenizer does: a space becomes the mark U+2581, one is put in front of a text that isn't empty.
If no piece has the mark after another character, the best path never crosses the start of a run of marks, and characters
that no piece holds always stand alone. So a text falls into short parts, whose counts are kept in a table of bounded
size (emptied when full); each different part is solved once.

Nulls and odd input: null and empty texts have 0 tokens; rows come out one for one, in any number and with repeated ids; empty input gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from sonolith.llm.common import with_defaults

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts kept in a worker's table.
KEPT = 400_000


def read_pieces(path: str = VOCABULARY) -> list[tuple[str, float, int]]:
    """The pieces of a sentencepiece model file: text, score, kind (1 normal, 2 unknown, 3 control, 4 user's, 6 byte)."""

    def fields(b: bytes) -> Iterator[tuple[int, bytes | int]]:
        i = 0

        def varint() -> int:
            nonlocal i
            value = shift = 0
            while True:
                c = b[i]
                i += 1
                value |= (c & 127) << shift
                shift += 7
                if c < 128:
                    return value

        while i < len(b):
            key = varint()
            if key & 7 == 0:
                yield key >> 3, varint()
            else:
                n = {1: 8, 5: 4}.get(key & 7) or varint()
                yield key >> 3, b[i : i + n]
                i += n

    found = []
    for number, value in fields(Path(path).read_bytes()):
        if number == 1:
            one = dict(fields(value))
            found.append((one[1].decode(), struct.unpack("<f", one.get(2, bytes(4)))[0], one.get(3, 1)))
    return found


class Counter:
    """Counts the tokens of texts under a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float, int]], prefix: bool = True):
        import ahocorasick

        normal = {p: s for p, s, kind in pieces if kind in (1, 4)}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece has the mark after another character; texts can't be cut at marks")
        self.byte_fallback = sum(kind == 6 for _, _, kind in pieces) == 256
        self.unknown = min(normal.values()) - UNKNOWN_PENALTY
        self.prefix = prefix
        self.singles = {p for p in normal if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in normal.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.known = {c for p in normal for c in p}
        self.parts = re.compile(f"{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+|\\n" if "\n" not in self.known else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.table: dict[str, tuple[float, int]] = {}

    def solve(self, part: str) -> tuple[float, int]:
        """Best score of a part and its number of tokens."""
        n = len(part)
        at: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(part):
            at[end].append((length, score))
        best: list[float | None] = [0.0] + [None] * n
        tokens = [0] * (n + 1)
        open_run = [False] * (n + 1)
        for end in range(1, n + 1):
            top = None
            size = 0
            run = False
            for length, score in at[end - 1]:  # the automaton gives the longest, that is the earliest start, first
                value = best[end - length] + score
                if top is None or value > top:
                    top, size, run = value, tokens[end - length] + 1, False
            c = part[end - 1]
            if c not in self.singles:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, run = value, True
                    size = tokens[end - 1] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else int(not open_run[end - 1]))
            best[end], tokens[end], open_run[end] = top, size, run
        return best[n], tokens[n]

    def count(self, text: str | None) -> tuple[int, float]:
        """Tokens of a text and the score of its best path."""
        if not text:
            return 0, 0.0
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        total, score, table = 0, 0.0, self.table
        if not self.byte_fallback:  # a run of unknown characters may span parts
            score, total = self.solve(text)
            return total, score
        for part in self.parts.findall(text):
            found = table.get(part)
            if found is None:
                if len(table) >= KEPT:
                    table.clear()
                found = self.solve(part)
                if len(part) <= 64:
                    table[part] = found
            score += found[0]
            total += found[1]
        return total, score


def token_counts(docs: DataFrame, pieces: list[tuple[str, float, int]]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, score (the best path's). The vocabulary travels with the task; its size doesn't follow the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces)
        for batch in batches:
            found = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "n_tokens", "score"])

    return with_defaults(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, score double")
