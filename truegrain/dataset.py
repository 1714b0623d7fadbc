"""The unit of work: a DataFrame with a row number (S2's result; 1.1)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.cells import js_string
from .scratch import saved

ROW = "_row"


@dataclass
class Dataset:
    """``df`` has ``_row`` (1, 2, ...) beside the data columns ``headers``."""

    df: DataFrame
    headers: list[str]
    metadata: dict = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, row: Column | None = None, metadata: dict | None = None) -> Dataset:
        """Number the rows by ``row``, an integer key from 1 if the data has one,
        or else in the order in which they are scanned."""
        headers = [c for c in df.columns if c != ROW]
        df = df.withColumn(ROW, row.cast("long")) if row is not None else (df if ROW in df.columns else numbered(df))
        return cls(df, headers, metadata or {})

    def type_of(self, name: str) -> T.DataType:
        return self.df.schema[name].dataType

    def text(self, name: str) -> Column:
        return js_string(f"`{name}`", self.type_of(name))

    def drop(self, names: list[str]) -> Dataset:
        """Without the named columns; names that aren't there don't matter."""
        gone = set(names)
        return Dataset(self.df.drop(*gone), [h for h in self.headers if h not in gone], dict(self.metadata))

    def head(self, n: int) -> Dataset:
        """The first ``n`` rows; all of them if ``n`` is 0."""
        return Dataset(self.df.where(F.col(ROW) <= n), self.headers, dict(self.metadata)) if n > 0 else self

    def is_empty(self) -> bool:
        """P17."""
        return not self.headers or self.df.isEmpty()


def numbered(df: DataFrame) -> DataFrame:
    """``_row`` in scan order: a partition's offset, from one count per partition,
    and the place inside it.

    A plan with a shuffle may give other partitions when it runs again; it is
    written once, so that rows and offsets come from the same partitions.
    """
    place = df.withColumn("_place", F.monotonically_increasing_id())
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        place = saved(place, "rows")
    part, inside = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = place.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()  # a row per partition
    offsets, at = [], 0
    for r in sorted(sizes):
        offsets.append((r["p"], at))
        at += r["n"]
    if len(offsets) <= 1:
        return place.withColumn(ROW, inside + 1).drop("_place")
    start = df.sparkSession.createDataFrame(offsets, "_part long, _offset long")
    out = place.withColumn("_part", part).join(F.broadcast(start), "_part")
    return out.withColumn(ROW, F.col("_offset") + inside + 1).drop("_place", "_part", "_offset")
