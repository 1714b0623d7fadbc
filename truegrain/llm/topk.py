"""Exact top-k inner products by columnar branch and bound.

Vectors become integers floor(256 * x) and are laid out in blocks by dimension.
A block of queries scans blocks of vectors a few dimensions at a time: scores so
far plus the most that the remaining dimensions can add (the product of the
remaining lengths, by Cauchy and Schwarz) bound a candidate, and those whose
bound is below the query's k-th best score so far are dropped from the arrays
before the next dimensions are read.

Queries are a stated set against all rows, so the work is their product; it is
dealt as a grid of query blocks and slices of vector blocks.  A task holds one
query block (``QUERY_BLOCK`` rows), one vector block (``BLOCK`` rows) and k rows
per query; nothing is broadcast or collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

K = 5
EVERY = 50
BLOCK = 4096
QUERY_BLOCK = 1024
#: Vector blocks that one task of the grid scans.
SLICE = 4
#: Dimensions read between two prunings.
DIMENSIONS = 16
LIMIT = 2**63 - 1


def quantise(values: list | np.ndarray) -> np.ndarray | None:
    """floor(256 * x) as floats; None if a component is null or not finite."""
    x = np.array([np.nan if v is None else v for v in values], np.float64) if not isinstance(values, np.ndarray) else values.astype(np.float64)
    with np.errstate(over="ignore"):
        x = np.floor(256.0 * x)
    return x if np.isfinite(x).all() else None


def _valid(batches):
    """Drop vectors that take no part; integers become bytes."""
    for batch in batches:
        ids, keep, blobs = batch.column(0), [], []
        for i, v in enumerate(batch.column(1)):
            if not v.is_valid or not ids[i].is_valid:
                continue
            x = v.values
            x = quantise(x.to_numpy() if not x.null_count else x.to_pylist())
            if x is not None:
                keep.append(i)
                blobs.append(x.astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(blobs, pa.binary())], names=["vec_id", "ints"])


def _blocks(rows: int):
    """Pack a partition's vectors into blocks in vertical layout: of equal
    ``ask`` and at most ``rows`` rows."""

    def block(ask, held):
        width = max(len(x) for _, _, x in held)
        table = np.zeros((width, len(held)))
        for i, (_, _, x) in enumerate(held):
            table[: len(x), i] = x
        head = np.array([[v, r] for v, r, _ in held], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([ask], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([head.T.tobytes()], pa.binary()), pa.array([_shrink(table)], pa.binary())], names=["ask", "n", "ids", "ints"])

    def run(batches):
        held, last = [], None
        for batch in batches:
            for ask, v, r, x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == rows or ask != last):
                    yield block(last, held)
                    held = []
                last = ask
                held.append((v, r, np.frombuffer(x, "<f8")))
        if held:
            yield block(last, held)

    return run


def _shrink(table: np.ndarray) -> bytes:
    """Two bytes a component where they do."""
    small = table.size == 0 or np.abs(table).max() < 2**15
    return (b"s" + table.astype("<i2").tobytes()) if small else (b"d" + table.astype("<f8").tobytes())


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob[1:], "<i2" if blob[:1] == b"s" else "<f8").astype(np.float64).reshape(-1, n)


class Best:
    """The best ``k`` (score, smaller vec_id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.found: list[list[tuple]] = [[] for _ in range(queries)]
        self.least = np.full(queries, -np.inf)

    def offer(self, q: int, scores, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            pick = scores >= cut
            scores, ids = scores[pick], ids[pick]
        new = sorted(self.found[q] + [(-int(s), int(i)) for s, i in zip(scores, ids)])[: self.k]
        self.found[q] = new
        if len(new) == self.k:
            self.least[q] = -float(new[-1][0])


def scan(best: Best, queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Offer a block of vectors (dimension by row) to a block of queries."""
    d = max(len(queries), len(vectors))
    q, x = (np.vstack([m, np.zeros((d - len(m), m.shape[1]))]) for m in (queries, vectors))
    most = (np.abs(q).max() if q.size else 0) * (np.abs(x).max() if x.size else 0) * max(d, 1)
    if most >= 2**53:  # beyond exact doubles: whole numbers, saturated at 64 bits
        whole = x.T.astype(object)
        for i in range(q.shape[1]):
            other = np.flatnonzero(rows != query_rows[i])
            score = np.array([sum(int(a) * int(b) for a, b in zip(q[:, i], whole[j])) for j in other], object)
            best.offer(i, np.array([max(-LIMIT - 1, min(LIMIT, s)) for s in score], object).astype(np.int64), ids[other])
        return
    starts = list(range(0, d, DIMENSIONS)) or [0]

    def mass(m: np.ndarray) -> np.ndarray:
        """Length of what remains after each group of dimensions."""
        part = np.array([(m[s : s + DIMENSIONS] ** 2).sum(axis=0) for s in starts])
        return np.sqrt(np.concatenate([np.cumsum(part[::-1], axis=0)[::-1][1:], np.zeros((1, m.shape[1]))]))

    rest_q, rest_x = mass(q), mass(x)
    first = q[:DIMENSIONS].T @ x[:DIMENSIONS]
    for i in range(q.shape[1]):
        live = np.flatnonzero((first[i] + rest_q[0, i] * rest_x[0] * (1 + 1e-9) + 1e-6 >= best.least[i]) & (rows != query_rows[i]))
        score = first[i, live]
        for b, s in enumerate(starts[1:], 1):
            if not len(live):
                break
            score = score + q[s : s + DIMENSIONS, i] @ x[s : s + DIMENSIONS, live]
            stay = score + rest_q[b, i] * rest_x[b, live] * (1 + 1e-9) + 1e-6 >= best.least[i]
            live, score = live[stay], score[stay]
        if len(live):
            best.offer(i, score, ids[live])


def _search(k: int):
    names = ["query_row", "query_id", "vec_id", "score"]

    def emit(head, best):
        out = [(head[1, q], head[0, q], v, -s) for q, found in enumerate(best.found) for s, v in found]
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches):
        key = head = queries = best = None
        for batch in batches:
            for b in range(batch.num_rows):
                q, part, kind, n, ids, ints = (c[b].as_py() for c in batch.columns)
                at = np.frombuffer(ids, np.int64).reshape(2, n)
                if kind == 0:
                    if best is not None:
                        yield emit(head, best)
                    key, head, queries, best = (q, part), at, _wide(ints, n), Best(n, k)
                elif key == (q, part):  # else no query is in this part of the grid
                    scan(best, queries, head[1], _wide(ints, n), at[0], at[1])
        if best is not None:
            yield emit(head, best)

    return run


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """For every row whose ``vec_id`` is divisible by ``every`` the ``k`` other
    rows of highest integer inner product: ``query_id``, ``rank`` from 1,
    ``vec_id``, ``score``; equal scores go to the smaller vec_id.

    Vectors that are null or hold null or non-finite components, and rows
    without a vec_id, take no part; shorter vectors count as filled up with
    zeros; rows that repeat a vec_id are rows of their own (only a query's own
    row is left out); scores beyond 64 bits saturate; other columns are ignored;
    an empty table gives no rows.
    """
    source = small_batches(embeddings).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = source.mapInArrow(_valid, "vec_id long, ints binary").withColumn("row", F.monotonically_increasing_id())
    rows = saved(rows, "vectors").select("vec_id", "row", "ints")
    asks = rows.where(F.col("vec_id") % every == 0)
    n, n_asks = rows.count(), asks.count()
    blocks, ask_blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n_asks / QUERY_BLOCK))
    schema = "ask long, n int, ids binary, ints binary"
    packed = rows.select(F.lit(0).cast("long").alias("ask"), "vec_id", "row", "ints").repartition(blocks, "row").mapInArrow(_blocks(BLOCK), schema)
    packed = saved(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    asked = asks.select(F.pmod(F.xxhash64("row"), F.lit(ask_blocks)).alias("ask"), "vec_id", "row", "ints").repartition(ask_blocks, "ask").sortWithinPartitions("ask")
    asked = saved(asked.mapInArrow(_blocks(2**31), schema), "queries")
    slices = max(1, math.ceil(blocks / SLICE))
    # the grid: every query block once per slice, every vector block once per query block
    part = F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")
    left = asked.select("ask", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("part"), F.lit(0).alias("kind"), "n", "ids", "ints")
    right = packed.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ask_blocks - 1).cast("long"))).alias("ask"), part.alias("part"), F.lit(1).alias("kind"), "n", "ids", "ints")
    tasks = min(100_000, 2 * ask_blocks * slices)
    met = left.unionByName(right).repartition(tasks, "ask", "part").sortWithinPartitions("ask", "part", "kind").mapInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
