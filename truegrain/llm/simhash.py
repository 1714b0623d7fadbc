"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint's 64 bits are a ring of four 16-bit segments.  If two
fingerprints differ in at most ``DISTANCE`` = 2 bits, some segment of the ring
starts a chain whose first ``l`` segments differ in at most ``l * 2 / 4`` bits
together, for every ``l``: so that segment is equal, and of the two that follow
one is equal too and the other differs in at most one bit.  Candidates are
therefore fingerprints that share such a pair of segments (six kinds of key);
the chain conditions prune them before the full Hamming check.

Keys that more than ``BUCKET`` fingerprints share are not paired within the
bucket.  Each of their fingerprints is dealt to the values at one bit or less
from it among the bits that the key leaves open; fingerprints within two bits
of each other meet at some value, all that meet there are within two bits, and
no more than 33 can.  Rows made are thus linear in the fingerprints, and no
link is lost.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, saved, small_batches

DISTANCE = 2
#: Fingerprints of one key up to which they are compared pairwise.
BUCKET = 64
#: Segment pairs that a chain can start with, as (first, other).
KEYS = ((0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3))


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the 3-word shingles of ``text``; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3 else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` (long) and ``fp`` (the fingerprint as a signed long) per row."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def links(fps: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between distinct values of ``fps.fp`` such that two
    values are connected in them if and only if a path of pairs at
    ``DISTANCE`` or fewer bits connects them; every edge is such a pair."""
    fp = F.col("fp")
    keyed = fps.select("fp").distinct().select(
        "fp", F.posexplode(F.array(*[F.shiftleft(_segment(fp, i), 16).bitwiseOR(_segment(fp, j)) for i, j in KEYS])).alias("kind", "seg")
    )
    keyed = keyed.select("fp", (F.col("kind") * F.lit(1 << 32).cast("long") + F.col("seg")).alias("key"))
    keyed = saved(keyed, "keys")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = saved(keyed.join(shared, "key"), "shared")

    cold = keyed.where(F.col("n") <= BUCKET).select("key", "fp")
    x = F.col("a").bitwiseXOR(F.col("b"))
    differ = [F.bit_count(_segment(x, i)) for i in range(4)]
    chain = F.lit(False)
    for start in range(4):
        ring, holds = [differ[(start + l) % 4] for l in range(4)], F.lit(True)
        for l in range(1, 5):
            holds = holds & (sum(ring[1:l], ring[0]) <= l * DISTANCE // 4)
        chain = chain | holds
    near = (
        cold.select("key", F.col("fp").alias("a")).join(cold.select("key", F.col("fp").alias("b")), "key")
        .where(F.col("a") < F.col("b")).where(chain).where(F.bit_count(x) <= DISTANCE).select("a", "b")
    )

    kind = F.shiftright("key", 32)
    open_bits = F.lit(None)
    for k, (i, j) in enumerate(KEYS):
        bits = [16 * s + p for s in range(4) if s not in (i, j) for p in range(16)]
        open_bits = F.when(kind == k, F.array(*[F.lit(_signed(1 << p)) for p in bits])).otherwise(open_bits)
    hot = keyed.where(F.col("n") > BUCKET).select("key", "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), open_bits)).alias("flip"))
    met = hot.groupBy("key", F.col("fp").bitwiseXOR(F.col("flip")).alias("at")).agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    met = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return near.union(met)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (columns ``doc_id``, ``text``; others are
    ignored): ``doc_id`` long, ``fingerprint`` (16 hex digits), ``component_id``
    (the smallest doc_id reachable over links, its own included).

    Null and empty texts have fingerprint zero and link like any other; equal
    rows give equal rows; a null doc_id takes part but names no component (null
    only if no doc_id is reachable); an empty table gives no rows.
    """
    fps = saved(fingerprints(docs), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    root = first.join(components(links(fps)), F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    root = saved(root, "roots")
    least = root.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = root.join(least, "root").select("fp", "component_id")
    return fps.join(component, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one document of each near-duplicate component.

    The row with the smallest doc_id stays; of several rows with that doc_id,
    the one whose columns hash smallest.  Rows without a doc_id stay.
    """
    found = saved(near_duplicates(docs), "near")
    rest = docs.join(found.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return rest
    row = F.struct(F.xxhash64(*docs.columns).alias("h"), F.struct(*docs.columns).alias("row"))
    least = rest.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("x")).select("x.row.*")
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(least)
