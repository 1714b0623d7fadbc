"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

The score of a word after its context is, in base-10 logarithms, that of

* c(context word) / c(context), if the longest n-gram is in the count table,
* else ``ALPHA`` times the score with a context shorter by one word,
* at last c(word) / N, N being the words of the corpus.

``min_count`` cuts n-grams of two or more words that occur less often out of the
table; by default none is.  A document's score is the sum over its words.

``relational_scores`` is plainly relational: a row per n-gram, counted into tables
by hash, joined to them, summed per document.  ``scores`` does the same sums with
less to shuffle and without Spark's join: a block of documents sends each n-gram
once, with its count, in sorted and packed pieces, one for each range of hashes;
a range's task adds the pieces up to its part of the count table and sends the
counts back, and the block sums them up.  A frequent n-gram is thus one entry for
each block, all of them in one range's task, so that task grows with the number
of blocks.  Pieces never outnumber the n-grams.

Hashes of ``scores`` have 24 bits more than it takes to number all n-grams, 64 at
most; those of ``relational_scores`` have 64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import saved, small_batches
from .packing import pack, unpack

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 1
BLOCK_BYTES = 5 << 20
RANGE = 2_000_000
SCHEMA = "doc_id long, n_words long, score double, mean_score double"


def ngrams(words: textvec.Words, order: int, bits: int) -> list[np.ndarray]:
    """For each n up to ``order`` the hash, of ``bits`` bits, of the n-gram that
    ends at each word; where the text has fewer words, of the whole beginning."""
    out = [words.hash]
    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], np.diff(words.first))
    for n in range(1, order):
        g = out[-1].copy()
        more = np.flatnonzero(place >= n)
        g[more] = textvec.mix(g[more] * np.uint64(0xD6E8FEB86659FD93) + words.hash[more - n])
        out.append(g)
    return [textvec.mix(g + np.uint64(n + 1)) >> np.uint64(64 - bits) for n, g in enumerate(out)]


def _blocks(batches):
    """Pack a partition's documents into blocks."""
    ids, texts, size, words = [], [], 0, 0

    def block():
        table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        blob = zstandard.ZstdCompressor(level=9).compress(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_pydict({"n_words": pa.array([words], pa.int64()), "blob": pa.array([blob], pa.binary())})

    for batch in batches:
        for i, j in textvec.slices(batch.column(1)):
            part = batch.slice(i, j - i)
            words += len(textvec.split(part.column(1)).hash)
            ids += part.column(0).to_pylist()
            texts += [x or "" for x in part.column(1).to_pylist()]
            size += sum(map(len, texts[len(texts) - (j - i) :]))
            if size >= BLOCK_BYTES:
                yield block()
                ids, texts, size, words = [], [], 0, 0
    if ids:
        yield block()


def _open(blob: bytes) -> tuple[pa.Array, pa.Array]:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
    return table["doc_id"].combine_chunks(), table["text"].combine_chunks()


def _block_ngrams(texts: pa.Array, order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First word of each text, and the hashes by order."""
    sizes, hashes = [], [[] for _ in range(order)]
    for i, j in textvec.slices(texts):
        words = textvec.split(texts.slice(i, j - i))
        sizes.append(np.diff(words.first))
        for n, h in enumerate(ngrams(words, order, bits)):
            hashes[n].append(h)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
    return first, [np.concatenate(h) for h in hashes]


def _requests(order: int, bits: int, ranges: int):
    edges = np.array([(k << bits) // ranges for k in range(1, ranges)], np.uint64)

    def run(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, texts = _open(blob.as_py())
                every = np.sort(np.concatenate(_block_ngrams(texts, order, bits)[1]))
                head = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
                values, times = every[head], np.diff(np.append(head, len(every)))
                cut = np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])
                rows = []
                for k in np.flatnonzero(np.diff(cut)):
                    v, c = values[cut[k] : cut[k + 1]], times[cut[k] : cut[k + 1]]
                    rows.append((int(k), block, pack(np.diff(v, prepend=v[:1] * 0)), pack(c)))
                for i in range(0, len(rows), 64):
                    r = list(zip(*rows[i : i + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(r[0], pa.int32()), pa.array(r[1], pa.int64()), pa.array(r[2], pa.binary()), pa.array(r[3], pa.binary())], names=["range", "block", "hashes", "times"])

    return run


def _grouped(batches, width: int):
    """(key, rows) for runs of equal first columns in sorted batches."""
    key, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns[:width]]
        for i in range(batch.num_rows):
            k = columns[0][i]
            if rows and k != key:
                yield key, rows
                rows = []
            key = k
            rows.append([c[i] for c in columns])
    if rows:
        yield key, rows


def _count(order: int, min_count: int):
    def run(batches):
        for _, rows in _grouped(batches, 4):
            parts = [np.cumsum(unpack(r[2]), dtype=np.uint64) for r in rows]
            sizes = [len(p) for p in parts]
            values, where = np.unique(np.concatenate(parts), return_inverse=True)
            times = np.bincount(where.ravel(), weights=np.concatenate([unpack(r[3]) for r in rows]), minlength=len(values))
            found = times.astype(np.uint64)[where.ravel()]
            at = 0
            for r, n in zip(rows, sizes):
                yield pa.RecordBatch.from_arrays([pa.array([r[1]], pa.int64()), pa.array([r[0]], pa.int32()), pa.array([pack(found[at : at + n])], pa.binary())], names=["block", "range", "blob"])
                at += n

    return run


def _sum(order: int, bits: int, total: int, alpha: float, min_count: int):
    def run(batches):
        for _, rows in _grouped(batches, 3):
            if rows[0][1] >= 0:
                raise ValueError("counts without their block")
            ids, texts = _open(rows[0][2])
            first, hashes = _block_ngrams(texts, order, bits)
            every = np.concatenate(hashes)
            del hashes, texts
            order_of = np.argsort(every).astype(np.uint32 if len(every) < 2**32 else np.int64)
            every = every[order_of]
            place = np.cumsum(np.concatenate([[False], every[1:] != every[:-1]]), dtype=np.uint32) if len(every) else np.zeros(0, np.uint32)
            counts = np.concatenate([unpack(r[2]) for r in rows[1:]]) if len(rows) > 1 else np.zeros(0, np.uint64)
            if len(counts) != (int(place[-1]) + 1 if len(place) else 0):
                raise ValueError("counts don't match their block")
            found = np.empty(len(every))
            del every
            found[order_of] = counts[place]
            del order_of, place, counts
            c = np.split(found, order)
            for n in range(1, order):
                c[n][c[n] < min_count] = 0
            place = np.arange(len(c[0])) - np.repeat(first[:-1], np.diff(first))
            score = np.log10(c[0] / max(1, total))
            for n in range(1, order):
                context = np.concatenate([[1.0], c[n - 1][:-1]]) if len(c[0]) else c[0]
                seen = c[n] > 0
                with np.errstate(divide="ignore", invalid="ignore"):
                    longer = np.where(seen, np.log10(c[n] / context), score + math.log10(alpha))
                score = np.where(place >= n, longer, score)
            n_words = np.diff(first)
            sums = np.zeros(len(ids))
            some = np.flatnonzero(n_words)
            if len(some):
                sums[some] = np.add.reduceat(score, first[:-1][some])
            mean = pa.array(sums / np.maximum(n_words, 1), mask=n_words == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(sums), mean], names=["doc_id", "n_words", "score", "mean_score"])

    return run


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """``doc_id``, ``n_words``, ``score`` and ``mean_score`` (score per word) for
    every row of ``docs``, from counts over all rows.

    Other columns are ignored.  Null and empty texts have no words, score 0 and
    a null mean; a null doc_id is carried through; repeated rows count and score
    as often as they occur; an empty table gives no rows.
    """
    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = source.mapInArrow(_blocks, "n_words long, blob binary").select(F.monotonically_increasing_id().alias("block"), "n_words", "blob")
    blocks = saved(blocks, "blocks")
    total, n_blocks = (x or 0 for x in blocks.agg(F.sum("n_words"), F.count("*")).first())
    bits = min(64, max(1, order * total).bit_length() + 24)
    ranges = max(1, math.ceil(order * total / RANGE))
    tasks = min(max(ranges, 1), 100_000)
    asked = blocks.select("block", "blob").mapInArrow(_requests(order, bits, ranges), "range int, block long, hashes binary, times binary")
    counts = asked.repartition(tasks, "range").sortWithinPartitions("range", "block").mapInArrow(_count(order, min_count), "block long, range int, blob binary")
    both = blocks.select("block", F.lit(-1).alias("range"), "blob").unionByName(counts)
    return both.repartition(max(1, min(n_blocks, 100_000)), "block").sortWithinPartitions("block", "range").mapInArrow(_sum(order, bits, int(total), alpha, min_count), SCHEMA)


def _exploded(order: int, part: int, slices: int, weighed: bool):
    """n-grams of slice ``part``: ``h`` and how often it occurs in some text, or,
    weighed, (row, ``h``, weight of its logarithm) for a document's score.

    With every n-gram of the corpus in the table, a word costs log c(n-gram) -
    log c(context).  The context is the n-gram of the word before as long as
    n-grams still grow, so only the longest ones and their contexts are left."""

    def run(batches):
        for batch in batches:
            rows, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for i, j in textvec.slices(texts):
                words = textvec.split(texts.slice(i, j - i))
                grams = ngrams(words, order, 64)
                place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], np.diff(words.first))
                if not weighed:
                    every = np.concatenate([g[place >= n] for n, g in enumerate(grams)])
                    every, times = np.unique(every[every % np.uint64(slices) == part], return_counts=True)
                    columns = {"h": pa.array(every.view(np.int64)), "times": pa.array(times.astype(np.int64))}
                else:
                    doc, last = words.doc_of(), np.zeros(len(place), bool)
                    last[words.first[1:][np.diff(words.first) > 0] - 1] = True
                    full = place >= order - 1
                    takes = [(full, order - 1, 1)] + [(last & (place == n), n, 1) for n in range(order - 1)]
                    if order > 1:
                        takes.append((full & ~last, order - 2, -1))
                    takes = [(k & (grams[n] % np.uint64(slices) == part), n, w) for k, n, w in takes]
                    columns = {
                        "row": pa.array(rows[i:j][np.concatenate([doc[k] for k, _, _ in takes])].astype(np.int64)),
                        "h": pa.array(np.concatenate([grams[n][k] for k, n, _ in takes]).view(np.int64)),
                        "weight": pa.array(np.concatenate([np.full(int(k.sum()), w, np.int32) for k, _, w in takes])),
                    }
                table = pa.table(columns)
                yield from table.to_batches(max_chunksize=200_000)

    return run


def _sizes(batches):
    for batch in batches:
        n = [np.diff(textvec.split(batch.column(2).slice(i, j - i)).first) for i, j in textvec.slices(batch.column(2))]
        n = np.concatenate(n) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), batch.column(2)], names=["row", "doc_id", "n_words", "text"])


def relational_scores(docs: DataFrame, order: int = ORDER, slices: int = 4) -> DataFrame:
    """What ``scores`` returns without a cut, by tables of single n-grams.

    n-grams are exploded, counted into a table by hash, joined to it and summed
    for each row, in ``slices`` by hash one after another, which divides the
    disk that shuffles take.  Counts are aggregated before they are shuffled,
    and the join's sides are plain shuffles, so that a frequent n-gram can be
    split.  Nulls, empty texts, repeated rows and empty tables as there.
    """
    source = small_batches(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = saved(source.mapInArrow(_sizes, "row long, doc_id long, n_words long, text string"), "texts")
    total = base.agg(F.sum("n_words")).first()[0] or 0
    sums = None
    for part in range(slices):
        texts = base.select("row", "text")
        table = texts.mapInArrow(_exploded(order, part, slices, False), "h long, times long").groupBy("h").agg(F.sum("times").alias("times"))
        table = saved(table, "counts")
        grams = texts.mapInArrow(_exploded(order, part, slices, True), "row long, h long, weight int")
        some = saved(grams.join(table, "h").groupBy("row").agg(F.sum(F.col("weight") * F.log10("times")).alias("part")), "sums")
        sums = some if sums is None else sums.unionByName(some)
    sums = sums.groupBy("row").agg(F.sum("part").alias("part"))
    of_all = F.lit(math.log10(max(1, total))) * (F.lit(1) if order > 1 else F.col("n_words"))
    score = F.when(F.col("n_words") > 0, F.coalesce("part", F.lit(0.0)) - of_all).otherwise(0.0)
    out = base.select("row", "doc_id", "n_words").join(sums, "row", "left").select("doc_id", "n_words", score.alias("score"))
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
