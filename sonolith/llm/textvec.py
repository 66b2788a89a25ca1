"""Vectorised text work on Arrow batches: word bounds and 64-bit hashes of words and shingles in NumPy, without a Python object for each word.

Words follow the corpus rule: A-Z lower-cased, split at the six ASCII white-space bytes. Hashes are the same in every
process. Batches are cut into pieces of about PIECE bytes of text (one document at least), which bounds memory by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed * 0x5851F42D4C957F2D & _MASK))


_BYTE = stream(1, 256)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE * 5 // 4)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


class Piece:
    """Some documents: rows `first` up to `first + n` of a batch, their bytes and offsets."""

    def __init__(self, first: int, data: np.ndarray, offs: np.ndarray):
        self.first, self.data, self.offs, self.n = first, data, offs, len(offs) - 1

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of value * base^position, from which any span's polynomial hash follows."""
        out = np.empty(len(values) + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of [start, end): equal bytes give equal hashes wherever they stand."""
        return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self) -> None:
        """Sets start, end, doc and hash of each word, and per document the first word's index in `first_word`."""
        low = _LOW[self.data]
        full = ~_WS[self.data]
        edge = np.zeros(len(low) + 1, bool)
        edge[self.offs] = True
        before = np.empty(len(low), bool)
        before[:1] = False
        before[1:] = full[:-1]
        self.start = np.flatnonzero(full & (~before | edge[:-1]))
        after = np.empty(len(low), bool)
        after[-1:] = False
        after[:-1] = full[1:]
        self.end = np.flatnonzero(full & (~after | edge[1:])) + 1
        self.hash = self.spans(self.prefix(_BYTE[low]), self.start, self.end)
        self.low = low
        self.first_word = np.searchsorted(self.start, self.offs)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first_word))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct k-word shingles: documents, hashes (ascending in each document), and bounds by document. A document
        of fewer words gives its whole sequence as one; one without words gives none."""
        count = np.diff(self.first_word)
        n = len(self.hash)
        acc = np.zeros(max(n - k + 1, 0), np.uint64)
        keys = stream(2, k)
        for i in range(k):
            acc += self.hash[i : n - k + 1 + i] * (keys[i] | np.uint64(1))
        last = np.repeat(self.first_word[1:] - k, count)
        own = np.flatnonzero(np.arange(n) <= last)
        hashes, docs = mix(acc[own]), self.doc[own]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.array([mix(np.array([(self.hash[a:b] * (keys[: b - a] | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(b - a)]))[0] for a, b in zip(self.first_word[short], self.first_word[short + 1], strict=True)], np.uint64)
            hashes, docs = np.concatenate([hashes, extra]), np.concatenate([docs, short])
        order = np.lexsort((hashes, docs))
        hashes, docs = hashes[order], docs[order]
        keep = np.ones(len(docs), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        hashes, docs = hashes[keep], docs[keep]
        return docs, hashes, np.searchsorted(docs, np.arange(self.n + 1))


def pieces(text: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """Cuts a string array into pieces; null texts count as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.type != pa.large_string():
        text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return
    _, offs, data = text.buffers()
    offs = np.frombuffer(offs, np.int64, len(text) + 1, text.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, side="right")) - 1)
        yield Piece(first, data[offs[first] : offs[last]], offs[first : last + 1] - offs[first])
        first = last
