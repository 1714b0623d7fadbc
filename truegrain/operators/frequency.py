"""The frequency frame, and the column profiles read from it (A1-A10, A22, A26,
A30, O1, O2, H1).

All columns are turned into one long frame (column, canonical text, number) and
counted by one shuffle; distinct counts, most common values, modes, order
statistics, histograms, cardinalities and frequency anomalies come from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import ROW, Dataset
from ..functions.cells import is_missing, js_string
from ..functions.numbers import parse_float, rounded
from ..scratch import saved


def long_frame(ds: Dataset, columns: list[str] | None = None) -> DataFrame:
    """One row per cell: ``col_ord``, ``column``, ``row``, ``value``, ``num``;
    missing cells have a null value."""
    names = columns or ds.headers
    cells = [
        F.struct(
            F.lit(i).alias("col_ord"), F.lit(c).alias("column"),
            F.when(~is_missing(f"`{c}`", ds.type_of(c)), ds.text(c)).alias("value"),
            F.when(~is_missing(f"`{c}`", ds.type_of(c)), parse_float(f"`{c}`", ds.type_of(c))).alias("num"),
        )
        for i, c in enumerate(names)
    ]
    return ds.df.select(F.col(ROW).alias("row"), F.explode(F.array(*cells)).alias("c")).select("row", "c.*")


def frequency_frame(ds: Dataset, columns: list[str] | None = None) -> DataFrame:
    """``col_ord``, ``column``, ``value``, ``num``, ``cnt``, ``first_row``,
    ``last_row``; missing cells are the row whose value is null.

    Doubles are counted as they are and others as text; texts of numbers and
    numbers of texts are made once per distinct value.
    """
    names = columns or ds.headers
    floats = {c for c in names if isinstance(ds.type_of(c), (T.DoubleType, T.FloatType))}
    none = F.lit(None)
    cells = [
        F.struct(
            F.lit(i).alias("col_ord"),
            (none.cast("string") if c in floats else F.when(~is_missing(f"`{c}`", ds.type_of(c)), ds.text(c))).alias("text"),
            (F.col(f"`{c}`").cast("double") if c in floats else none.cast("double")).alias("raw"),
        )
        for i, c in enumerate(names)
    ]
    cells = ds.df.select(F.col(ROW).alias("row"), F.explode(F.array(*cells)).alias("c")).select("row", "c.*")
    counts = cells.groupBy("col_ord", "text", "raw").agg(F.count("*").alias("cnt"), F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    value = F.coalesce("text", js_string("raw", T.DoubleType()))
    num = F.when(F.col("text").isNull(), parse_float("raw", T.DoubleType())).otherwise(parse_float("text"))
    column = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("col_ord") + 1)
    return counts.select("col_ord", column.alias("column"), value.alias("value"), num.alias("num"), "cnt", "first_row", "last_row")


def top_values(freq: DataFrame, k: int = 10, by_value: bool = False) -> DataFrame:
    """A2, O1: the ``k`` most common values of each column, cut to 50
    characters; ties go to the first seen (or, ``by_value``, the smaller text)."""
    total = freq.where("value is not null").groupBy("col_ord").agg(F.sum("cnt").alias("non_null"))
    tie = F.col("value") if by_value else F.col("first_row")
    rank = F.row_number().over(Window.partitionBy("col_ord").orderBy(F.desc("cnt"), tie))
    top = freq.where("value is not null").withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(total), "col_ord")
    return top.select("col_ord", "column", F.col("rank").cast("long").alias("rank"), F.substring("value", 1, 50).alias("value"), F.col("cnt").alias("count"), rounded(F.col("cnt") * 100 / F.col("non_null"), 2).alias("percent"))


def order_statistics(freq: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """For each column the value at position floor(n * share) of its sorted
    numbers, as ``q0``, ``q1``, ...; ``median`` is the mean of the middle two.

    Counts per distinct number are dealt in ranges whose ends are sampled, so one
    far value doesn't put all others into one range.  Ranges are summed to a row
    each, and only those that hold a wanted position are sorted.
    """
    nums = freq.where("num is not null").groupBy("col_ord", "num").agg(F.sum("cnt").alias("cnt"))
    parts = max(1, int(freq.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = saved(nums.repartitionByRange(parts, "col_ord", "num").withColumn("part", F.spark_partition_id()), "ranges")
    column, order = Window.partitionBy("col_ord"), Window.partitionBy("col_ord").orderBy("part")
    sizes = ranged.groupBy("col_ord", "part").agg(F.sum("cnt").alias("s"))
    sizes = sizes.select("col_ord", "part", F.sum("s").over(column).alias("n"), (F.sum("s").over(order) - F.col("s")).alias("before"), F.sum("s").over(order).alias("upto"))
    places = {f"q{i}": F.floor(F.col("n") * p) for i, p in enumerate(shares)} | {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)}
    here = [F.when((place >= F.col("before")) & (place < F.col("upto")), place).alias(k) for k, place in places.items()]
    wanted = sizes.select("col_ord", "part", "before", *here).where(F.coalesce(*places).isNotNull())  # a few rows a column
    upto = F.col("before") + F.sum("cnt").over(Window.partitionBy("col_ord", "part").orderBy("num"))
    cum = ranged.join(F.broadcast(wanted), ["col_ord", "part"]).withColumn("upto", upto)
    found = cum.groupBy("col_ord").agg(*[F.min(F.when(F.col("upto") > F.col(k), F.col("num"))).alias(k) for k in places])
    return found.select("col_ord", *[f"q{i}" for i in range(len(shares))], ((F.col("low") + F.col("high")) / 2).alias("median"))


def profiles(ds: Dataset, columns: list[str] | None = None, freq: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """One row per column.  Number statistics (population deviation,
    4 digits) where over 90 % of the values begin with a number; otherwise
    lengths."""
    freq = saved(frequency_frame(ds, columns), "frequencies") if freq is None else freq
    w = lambda c: F.col(c) * F.col("cnt")
    size = F.length("value")
    agg = freq.groupBy("col_ord", "column").agg(
        F.sum("cnt").alias("total_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"), F.coalesce(F.sum(F.when(F.col("num").isNotNull(), F.col("cnt"))), F.lit(0)).alias("num_count"),
        F.min("num").alias("min"), F.max("num").alias("max"), F.sum(w("num")).alias("sum"),
        F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.sum(size * F.col("cnt")).alias("length_sum"),
    )
    means = agg.select("col_ord", (F.col("sum") / F.col("num_count")).alias("mean"))
    spread = freq.where("num is not null").join(F.broadcast(means), "col_ord").groupBy("col_ord").agg(F.sum((F.col("num") - F.col("mean")) ** 2 * F.col("cnt")).alias("squares"))
    out = agg.join(F.broadcast(means), "col_ord").join(F.broadcast(spread), "col_ord", "left").join(F.broadcast(order_statistics(freq) if order is None else order), "col_ord", "left")
    non_null = F.col("total_count") - F.col("null_count")
    numeric = F.col("num_count") > 0.9 * non_null
    number = lambda c, d=4: F.when(numeric & (non_null > 0), rounded(c, d))
    text = ~numeric & (non_null > 0)
    return out.select(
        "col_ord", "column", "total_count", "null_count",
        rounded(F.col("null_count") * 100 / F.col("total_count"), 2).alias("null_percent"), rounded(non_null * 100 / F.col("total_count"), 2).alias("completeness"),
        "unique_count", rounded(F.col("unique_count") * 100 / F.greatest(non_null, F.lit(1)), 2).alias("unique_percent"),
        F.when(non_null == 0, "empty").when(numeric, "numeric").otherwise("string").alias("detected_type"),
        number(F.col("min")).alias("min"), number(F.col("max")).alias("max"), number(F.col("mean")).alias("mean"), number(F.col("median")).alias("median"),
        number(F.sqrt(F.col("squares") / F.col("num_count"))).alias("std_dev"), number(F.col("q0")).alias("q1"), number(F.col("q2")).alias("q3"), number(F.col("sum")).alias("sum"),
        F.when(text, F.col("min_length")).cast("long").alias("min_length"), F.when(text, F.col("max_length")).cast("long").alias("max_length"),
        F.when(text, rounded(F.col("length_sum") / non_null, 2)).alias("avg_length"),
    )


def column_analysis(profile: DataFrame) -> DataFrame:
    """Type, missing and distinct counts, and how many cells repeat others."""
    return profile.select("column", "detected_type", "null_count", "unique_count", (F.col("total_count") - F.col("unique_count")).alias("duplicates"))


def histogram(df: DataFrame, num: Column, bins: int = 10) -> DataFrame:
    """Equal bins; the largest value falls in the last one; if all values
    are equal there is one bin.  Empty bins are listed."""
    v = df.select(num.alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).where("n > 0")
    width = (F.col("hi") - F.col("lo")) / bins
    binned = v.join(F.broadcast(ends)).select(F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("long").alias("bin"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("count"))
    spine = ends.select("lo", "hi", "n", F.explode(F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("bin"))
    count = F.coalesce("count", F.lit(0))
    return spine.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("low"), F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        count.cast("long").alias("count"), rounded(count * 100 / F.col("n"), 2).alias("percent"),
    )


def categories(freq: DataFrame, limit: int = 20) -> DataFrame:
    """The most common values (longer than 50 characters: 47 and ``...``), and
    one row for all others."""
    values = freq.where("value is not null")
    total = values.groupBy("col_ord").agg(F.sum("cnt").alias("n"), F.count("*").alias("k"))
    rank = F.row_number().over(Window.partitionBy("col_ord").orderBy(F.desc("cnt"), "first_row"))
    top = values.withColumn("rank", rank).where(F.col("rank") <= limit)
    shown = F.when(F.length("value") > 50, F.concat(F.substring("value", 1, 47), F.lit("..."))).otherwise(F.col("value"))
    listed = top.groupBy("col_ord").agg(F.sum("cnt").alias("listed"))
    rest = total.where(F.col("k") > limit).join(F.broadcast(listed), "col_ord").select(
        "col_ord", F.lit(limit + 1).cast("long").alias("rank"), F.concat(F.lit("["), (F.col("k") - limit).cast("string"), F.lit(" others]")).alias("value"), (F.col("n") - F.col("listed")).alias("count")
    )
    rows = top.select("col_ord", F.col("rank").cast("long").alias("rank"), shown.alias("value"), F.col("cnt").alias("count")).union(rest).join(F.broadcast(total), "col_ord")
    return rows.select("col_ord", "rank", "value", "count", rounded(F.col("count") * 100 / F.col("n"), 2).alias("percent"), rounded(F.col("k") / F.col("n"), 4).alias("cardinality"))


# Upper limit of the ratio, class and advice.
CARDINALITY = (
    (0.01, "very_low", "Very low cardinality - ideal for enum/categorical constraints"),
    (0.1, "low", "Low cardinality - suitable for indexing and categorical analysis"),
    (0.5, "medium", "Medium cardinality - may contain meaningful categories"),
    (0.95, "high", "High cardinality - typical for descriptive text fields"),
    (None, "unique", "Near-unique values - likely an ID or key field"),
)


def cardinality(freq: DataFrame) -> DataFrame:
    """Class by distinct values over values."""
    agg = freq.groupBy("col_ord", "column").agg(F.count("value").alias("unique_count"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("cnt"))), F.lit(0)).alias("total_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("null_count"))
    ratio = F.when(F.col("total_count") > 0, F.col("unique_count") / F.col("total_count")).otherwise(0.0)
    kind = F.when(ratio == 0, "empty")
    advice = F.when(ratio == 0, "Column is empty - consider removing or investigating data source")
    for top, name, text in CARDINALITY:
        kind = kind.when(ratio < top, name) if top else kind.otherwise(name)
        advice = advice.when(ratio < top, text) if top else advice.otherwise(text)
    return agg.select("col_ord", "column", "unique_count", "total_count", "null_count", rounded(ratio, 4).alias("cardinality"), kind.alias("cardinality_type"), advice.alias("recommendation"))


def modes(freq: DataFrame) -> DataFrame:
    """The value that reaches the greatest count first."""
    best = F.max_by("value", F.struct("cnt", -F.col("last_row")))
    return freq.where("value is not null").groupBy("col_ord", "column").agg(best.alias("mode"))


def frequency_anomalies(freq: DataFrame) -> DataFrame:
    """All values equally common (over 5 values, over 50 cells), or one
    value in over 90 % of the cells."""
    agg = freq.where("value is not null").groupBy("col_ord", "column").agg(F.min("cnt").alias("least"), F.max("cnt").alias("most"), F.count("*").alias("k"), F.sum("cnt").alias("n"))
    share = F.col("most") / F.col("n")
    kind = F.when((F.col("least") == F.col("most")) & (F.col("k") > 5) & (F.col("n") > 50), "uniform-distribution").when((share > 0.9) & (F.col("k") > 1), "concentrated-distribution")
    return agg.select("column", kind.alias("type"), F.when(kind == "uniform-distribution", 0.8).otherwise(rounded(share, 4)).alias("confidence")).where("type is not null")
