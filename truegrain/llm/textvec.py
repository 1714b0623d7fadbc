"""Vectorised word splitting and hashing over Arrow string columns.

A *word* here is a maximal run of ASCII letters and digits and of bytes above
0x7F; everything else separates words.  Letters A-Z and the Latin-1 capitals
(UTF-8 ``C3 80``..``C3 9E`` but for ``C3 97``) are folded to lower case in
place, so byte offsets stay those of the original text.  Nulls count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_C1 = np.uint64(0x9E3779B97F4A7C15)
_C2 = np.uint64(0xBF58476D1CE4E5B9)
_C3 = np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)
#: Bytes of text handled at once; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * _C2
    h = (h ^ (h >> np.uint64(27))) * _C3
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of consecutive texts.

    ``start``/``end`` are byte offsets inside the word's own text, ``hash`` its
    64-bit hash, ``head`` its first eight bytes as a number, and words
    ``first[i]:first[i + 1]`` are those of text ``i``.
    """

    __slots__ = ("end", "first", "hash", "head", "start")

    def __init__(self, start: np.ndarray, end: np.ndarray, hash_: np.ndarray, first: np.ndarray, head: np.ndarray):
        self.start, self.end, self.hash, self.first, self.head = start, end, hash_, first, head

    def doc_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string array; nulls get no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    _, offsets, data = texts.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, count=n + 1, offset=8 * texts.offset)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def split(texts: pa.Array) -> Words:
    """All words of all texts, without intermediate Python strings."""
    raw, off = _buffers(texts)
    n = len(off) - 1
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return Words(z, z, z.astype(np.uint64), np.zeros(n + 1, np.int64), z.astype(np.uint64))
    fold = _FOLD[raw]
    latin = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    fold[latin] += 32
    word = _IS_WORD[raw]
    edge = np.empty(len(raw) + 1, dtype=bool)
    edge[0], edge[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=edge[1:-1])
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    cut = inner[word[inner] & word[inner - 1]]  # a text that ends and a next that starts inside a run of word bytes
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    if len(cut):
        cut = np.unique(cut)
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    size = end - start
    padded = np.concatenate([fold, np.zeros(8, np.uint8)])
    view = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    h = mix(size.astype(np.uint64) * _C1)
    live, part, head = np.arange(len(start)), 0, h
    while len(live):
        here = live if part else slice(None)
        left = np.minimum(size[here] - part, 8)
        chunk = view[start[here] + part] & _MASKS[left]
        if part == 0:
            head = chunk
        v = (h[here] ^ chunk) * _C1
        h[here] = v ^ (v >> np.uint64(29))
        part += 8
        live = live[size[live] > part]
    first = np.searchsorted(start, off)
    base = np.repeat(off[:-1], np.diff(first))
    return Words(start - base, end - base, mix(h), first, head)


def slices(texts: pa.Array):
    """Row ranges whose texts take about SLICE_BYTES each, at least one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, off = _buffers(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, side="right")) - 1)
        yield i, j
        i = j


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each position on, and a mask of positions
    at which ``k`` words of the same text follow.  Position = word index."""
    n = len(words.hash)
    out = np.zeros(n, np.uint64)
    ok = np.zeros(n, bool)
    if n >= k:
        g = words.hash[: n - k + 1].copy()
        for j in range(1, k):
            g *= _C1
            g += words.hash[j : n - k + 1 + j]
        out[: n - k + 1] = mix(g)
        doc = words.doc_of()
        ok[: n - k + 1] = doc[: n - k + 1] == doc[k - 1 :]
    return out, ok
