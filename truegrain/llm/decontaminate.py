"""Benchmark decontamination by greedy string tiling.

A test passage leaks into a document if tiles, exact matches of at least
``MIN_WORDS`` words that don't overlap in either text, cover at least
``COVERAGE`` of the passage's words.  Tiles may come in any order, so passages
whose sentences were moved about are found too.  Words are compared folded and
without punctuation (see ``textvec``).

The passages' 5-word seeds are looked up in rolling hashes of the documents.
Documents never move: blocks of passages of at most ``BLOCK_BYTES`` of text go
to the executors, one pass over the documents per block, so what is sent is
bounded however large the benchmark is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import small_batches

MIN_WORDS = 5
COVERAGE = 0.8
#: Of the rolling hashes; any odd number.
BASE = 0x9E3779B97F4A7C15
#: Text of the passages sent to the executors at once.
BLOCK_BYTES = 8 << 20
TILE_TYPE = "array<struct<doc_start: int, item_start: int, words: int>>"
SCHEMA = f"doc_id long, item_id long, coverage double, n_words int, n_tiles int, tiles {TILE_TYPE}"


class Runs:
    """Karp-Rabin hashes of the runs of any length of a sequence of words, and
    which of the words are still unmarked."""

    def __init__(self, words: np.ndarray):
        self.words = words
        # powers of an odd base and of its inverse modulo 2^64
        self.sums = np.append(np.uint64(0), np.cumsum(textvec.mix(words) * _powers(BASE, len(words))))
        self.down = _powers(pow(BASE, -1, 1 << 64), len(words))
        self.used = np.zeros(len(words), bool)
        self.count()

    def count(self) -> None:
        """Unmarked words in a row from each position on."""
        n = len(self.words)
        nearest = np.where(self.used, np.arange(n), n)
        self.free = np.minimum.accumulate(nearest[::-1])[::-1] - np.arange(n)

    def at(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions of the unmarked runs of ``size`` words."""
        where = np.flatnonzero(self.free >= size)
        return (self.sums[where + size] - self.sums[where]) * self.down[where], where


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def tiles(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of words by running Karp-Rabin.

    The longest length at which both have an equal run of unmarked words is
    searched by halving, for shorter parts of a run are equal too.  All runs of
    that length are then marked, first in the passage and then in the document,
    if their words agree one by one, and the search goes on below that length,
    down to ``width``.  No list of all equal pairs is made, so runs that both
    sides repeat cost no more than others.  Returns (document position, passage
    position, words) in passage order.
    """
    x, y = Runs(doc), Runs(item)
    out: list[tuple[int, int, int]] = []
    top = min(len(doc), len(item))
    while True:
        low, high = width - 1, min(top, int(x.free.max(initial=0)), int(y.free.max(initial=0)))
        while low < high:
            size = (low + high + 1) // 2
            if np.isin(y.at(size)[0], x.at(size)[0]).any():
                low = size
            else:
                high = size - 1
        if low < width:
            return sorted(out, key=lambda t: (t[1], t[0]))
        mark(x, y, low, out)
        top = low - 1


def mark(x: Runs, y: Runs, size: int, out: list[tuple[int, int, int]]) -> None:
    """Mark the equal runs of ``size`` words, the longest there are.  Runs marked
    here are equally long, so one that overlaps them has a marked end."""
    (seen, at), (known, place) = y.at(size), x.at(size)
    order = np.argsort(known, kind="stable")
    known, place = known[order], place[order]
    low, high = np.searchsorted(known, seen), np.searchsorted(known, seen, side="right")
    begun: dict[int, int] = {}  # where the places of a hash begin that may be unmarked
    for b, lo, hi in zip(at.tolist(), low.tolist(), high.tolist()):
        if lo == hi or y.used[b] or y.used[b + size - 1]:
            continue
        marked = lambda k: x.used[place[k]] or x.used[place[k] + size - 1]
        first = begun.get(lo, lo)
        while first < hi and marked(first):
            first += 1
        begun[lo] = first
        for k in range(first, hi):
            a = int(place[k])
            if not marked(k) and (x.words[a : a + size] == y.words[b : b + size]).all():
                out.append((a, b, size))
                x.used[a : a + size] = y.used[b : b + size] = True
                break
    x.count()
    y.count()


class Passages:
    """A block of passages: word hashes, and for every seed the passages
    (``item[begin[s]:begin[s + 1]]``) to be looked at where it is met."""

    def __init__(self, ids: list[int], texts: list[str | None], width: int, coverage: float):
        words = textvec.split(pa.array(texts, pa.large_string()))
        self.size = np.diff(words.first)
        self.first, self.words = words.first, words.hash
        self.ids = np.array(ids, np.int64)
        grams, ok = textvec.grams(words, width)
        at = np.flatnonzero(ok)
        item = words.doc_of()[at]
        # seeds by number, -1 where a passage has none
        self.seeds, of = np.unique(grams[at], return_inverse=True)
        self.slot = np.full(len(words.hash), -1)
        self.slot[at] = of
        # A leak covers so many words that it has more seeds than a passage's
        # most frequent ones here: those needn't be looked up.
        times = np.bincount(of, minlength=len(self.seeds))
        order = np.lexsort((at, -times[of], item))
        rank = np.arange(len(at)) - np.searchsorted(item, item)
        rare = order[rank >= np.ceil(coverage * self.size[item] / width) - 1]
        pairs = np.unique(np.stack([of[rare], item[rare]]), axis=1) if len(rare) else np.zeros((2, 0), np.int64)
        self.item = pairs[1]
        self.begin = np.searchsorted(pairs[0], np.arange(len(self.seeds) + 1))
        # passages of fewer words than a tile match as a whole
        self.short = {}
        for n in {int(x) for x in self.size if 0 < x < width}:
            g, good = textvec.grams(words, n)
            where = words.first[:-1][self.size == n]
            for it, h in zip(np.flatnonzero(self.size == n).tolist(), g[where].tolist()):
                self.short.setdefault(n, {}).setdefault(h, []).append(it)


def _leak(words: np.ndarray, first: int, at: np.ndarray, slot: np.ndarray, met: np.ndarray, block: Passages, i: int, width: int, coverage: float) -> list[tuple[int, int, int]]:
    """Tiles of passage ``i`` in the document that begins at ``words[first]`` and
    has seeds ``slot`` at ``at`` (distinct: ``met``), if they cover enough."""
    part = slice(int(block.first[i]), int(block.first[i + 1]))
    item, seeds = block.words[part], block.slot[part]
    reach = np.convolve(np.isin(seeds, met), np.ones(width, int))[: len(item)] > 0
    least = coverage * len(item)
    if reach.sum() < least:  # tiles cover no more than seeds do
        return []
    # the document's words under the passage's seeds, with a word of neither where some are left out
    near = at[np.isin(slot, seeds)]
    word = np.unique(near[:, None] + np.arange(width))
    gap = np.flatnonzero(np.diff(word) > 1) + 1
    none = np.setdiff1d(np.arange(len(item) + 1, dtype=np.uint64), item)[0]
    found = tiles(np.insert(words[word], gap, none), item, width)
    if sum(t[2] for t in found) < least:
        return []
    place = np.insert(word, gap, -1) - first
    return [(int(place[a]), b, n) for a, b, n in found]


def _scan(block: Passages, width: int, coverage: float):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_words", pa.int32()), ("n_tiles", pa.int32()),
        ("tiles", pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))),
    ])
    def rows_of(ids: pa.Array, texts: pa.Array) -> list[dict]:
        words = textvec.split(texts)
        grams, ok = textvec.grams(words, width)
        out = []
        if len(block.seeds):
            slot = np.searchsorted(block.seeds, grams)
            slot[slot == len(block.seeds)] = 0
            hit = np.flatnonzero(ok & (block.seeds[slot] == grams))
            slot = slot[hit]
            edge = np.searchsorted(hit, words.first)
            for d in np.flatnonzero(np.diff(edge)).tolist():
                at, own = hit[edge[d] : edge[d + 1]], slot[edge[d] : edge[d + 1]]
                met = np.unique(own)
                here = [block.item[block.begin[s] : block.begin[s + 1]] for s in met.tolist()]
                for i in np.unique(np.concatenate(here)).tolist():
                    if found := _leak(words.hash, int(words.first[d]), at, own, met, block, i, width, coverage):
                        covered = sum(t[2] for t in found)
                        out.append((d, i, covered / int(block.size[i]), int(block.size[i]), found))
        for n, table in block.short.items():
            g, good = textvec.grams(words, n)
            known = np.fromiter(table, np.uint64, len(table))
            seen = set()
            for at in np.flatnonzero(good & np.isin(g, known)).tolist():
                doc, h = int(np.searchsorted(words.first, at, side="right")) - 1, int(g[at])
                if (doc, h) in seen:
                    continue
                seen.add((doc, h))
                for item in table[h]:
                    if (words.hash[at : at + n] == block.words[block.first[item] :][:n]).all():
                        out.append((doc, item, 1.0, n, [(at - int(words.first[doc]), 0, n)]))
        return [
            {"doc_id": ids[d].as_py(), "item_id": int(block.ids[i]), "coverage": c, "n_words": n, "n_tiles": len(t),
             "tiles": [{"doc_start": a, "item_start": b, "words": w} for a, b, w in t]}
            for d, i, c, n, t in sorted(out, key=lambda x: x[:2])
        ]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in textvec.slices(texts):
                if rows := rows_of(ids.slice(i, j - i), texts.slice(i, j - i)):
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, coverage: float = COVERAGE) -> DataFrame:
    """One row per row of ``docs`` and passage that leaks into it.

    Reads ``doc_id``, ``text`` and ``item_id``, ``text``; other columns are
    ignored.  Columns: ``doc_id``, ``item_id``, ``coverage`` (share of the
    passage's words in tiles), ``n_words`` of the passage, ``n_tiles`` and
    ``tiles`` (word positions).  Null and empty texts and texts without words
    leak nothing and are leaked by nothing; a passage of fewer than
    ``min_words`` words leaks if it occurs whole; rows with null ids take part
    (the id comes back null but for passages, which need one); repeated rows
    give repeated results; empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + int(size) // BLOCK_BYTES
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = part.orderBy("item_id", "text").collect()  # about BLOCK_BYTES
        block = Passages([r[0] for r in rows], [r[1] for r in rows], min_words, coverage)
        found = source.mapInArrow(_scan(block, min_words, coverage), SCHEMA)
        out = found if out is None else out.union(found)
    return out


def remove_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that a passage leaks into.  Rows without
    a doc_id stay."""
    found = leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
