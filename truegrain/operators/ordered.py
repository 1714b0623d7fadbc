"""Operators that depend on the order of rows (W1-W3, W5-W8), without a
single-partition window.

Rows are cut into chunks of consecutive numbers.  A window runs inside each
chunk; what it needs from earlier chunks is aggregated to one row per chunk and
carried over by a window over those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import ROW
from ..scratch import saved

#: Rows of one chunk.
CHUNK = 100_000


def chunk(row: str = ROW) -> Column:
    return F.floor((F.col(row) - 1) / CHUNK).cast("long")


def reindex(df: DataFrame, row: str = ROW, name: str = "idx") -> DataFrame:
    """Number the rows left after a filter 0, 1, ... in the order of ``row``."""
    df = df.withColumn("_chunk", chunk(row))
    sizes = df.groupBy("_chunk").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy(row)) - 1
    return df.withColumn("_inside", inside).join(sizes, "_chunk").withColumn(name, (F.col("_offset") + F.col("_inside")).cast("long")).drop("_chunk", "_inside", "_offset")


def filled(df: DataFrame, columns: dict[str, Column], forward: bool = True, row: str = ROW) -> DataFrame:
    """Each column's missing cells (``columns``: name to the condition)
    take the last earlier (or first later) value; what no value precedes
    (follows) stays."""
    df = df.withColumn("_chunk", chunk(row))
    present = {c: F.when(~m, F.col(f"`{c}`")) for c, m in columns.items()}
    edge = F.max_by if forward else F.min_by
    ends = df.groupBy("_chunk").agg(*[edge(v, F.when(v.isNotNull(), F.col(row))).alias(f"_e{i}") for i, v in enumerate(present.values())])
    # backward is forward in the opposite order: Spark runs through a frame that
    # ends at the current row once, but through one that begins there for each row
    along = F.col if forward else F.desc
    over = Window.orderBy(along("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_chunk", *[F.last(f"_e{i}", ignorenulls=True).over(over).alias(f"_c{i}") for i in range(len(present))])
    inside = Window.partitionBy("_chunk").orderBy(along(row)).rowsBetween(Window.unboundedPreceding, 0)
    # windows first, so that they read the cells as they were
    out = df.select("*", *[F.last(v, ignorenulls=True).over(inside).alias(f"_f{i}") for i, v in enumerate(present.values())]).join(ends, "_chunk")
    for i, c in enumerate(columns):
        out = out.withColumn(c, F.coalesce(present[c], F.col(f"_f{i}"), F.col(f"_c{i}"), F.col(f"`{c}`")))
    return out.select(*[f"`{c}`" for c in df.columns if c != "_chunk"])


def running_sum(df: DataFrame, value: str, idx: str = "idx", name: str = "running") -> DataFrame:
    """Sum of ``value`` up to and with each row, in the order of ``idx`` (0, ...)."""
    df = df.withColumn("_chunk", F.floor(F.col(idx) / CHUNK).cast("long"))
    sums = df.groupBy("_chunk").agg(F.sum(value).alias("_s"))
    sums = sums.select("_chunk", F.coalesce(F.sum("_s").over(Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_inside", inside).join(sums, "_chunk").withColumn(name, F.col("_before") + F.col("_inside")).drop("_chunk", "_inside", "_before")


def with_previous(df: DataFrame, value: str, idx: str = "idx", name: str = "previous", by: int = 1) -> DataFrame:
    """The value ``by`` rows earlier, by an equality join on the row number."""
    earlier = df.select((F.col(idx) + by).alias(idx), F.col(value).alias(name))
    return df.join(earlier, idx, "left")


def ranked(df: DataFrame, *keys: str, name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, ... in the order of ``keys``, which tell all rows
    apart: sorted by sampled ranges, so equal first keys may span many tasks,
    and written once, so that places and offsets are of one run."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    placed = saved(placed, "ranked")
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return placed.withColumn("_part", part).join(F.broadcast(sizes), "_part").withColumn(name, F.col("_offset") + inside).drop("_place", "_part", "_offset")
