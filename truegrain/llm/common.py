"""Shared plumbing: Arrow batches, column names and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import saved, scratch_dir

__all__ = ["components", "saved", "scratch_dir", "small_batches", "unused"]

#: Text that Spark hands to Python at once; a batch has one row at least.
BATCH_BYTES = 8 << 20

def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``BATCH_BYTES`` or less, so
    that long texts don't add up in the memory of executors and workers."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = conf.get(key) or ""
    if not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name = f"_{name}"
    return f"_{name}"


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges`` by alternating large-star
    and small-star steps.

    Returns ``node``, ``root`` (the smallest node id of its component) for every
    node that has an edge to another node.  Minima are aggregated before they
    are shuffled, and joins to them can be split by the adaptive skew join, so
    a hub with a third of all edges is no single task's work.  Only counts and
    checksums reach the driver.  Edges with a null end or equal ends are left
    out; no edges give an empty result.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u is not null and v is not null and u < v").distinct()
    e = saved(e, "edges")
    sign = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select("v", "m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("r"))
        hung = large.join(low, "v")
        pairs = hung.where("m <> r").select(F.col("r").alias("u"), F.col("m").alias("v"))
        e = saved(pairs.union(low.select(F.col("r").alias("u"), F.col("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign or not now[0]:
            return e.select(F.col("v").alias("node"), F.col("u").alias("root")).union(e.groupBy("u").agg(F.min("u").alias("root")).withColumnRenamed("u", "node"))
        sign = now
