"""Forensic statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import ROW, Dataset
from ..functions.cells import is_missing
from ..functions.dates import parse_date
from ..functions.numbers import first_digit, is_numeric_type, parse_float, rounded
from .frequency import frequency_anomalies, frequency_frame
from .ordered import ranked, reindex, running_sum, with_previous

CRITICAL = 15.51


def correlations(ds: Dataset, columns: list[str]) -> DataFrame:
    """Pearson's r of every pair of columns over the rows in which both
    are numbers; null below 10 rows, 0 without variance.  One aggregate."""
    num = {c: parse_float(f"`{c}`", ds.type_of(c)) for c in columns}
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    aggs = []
    for i, j in pairs:
        x, y = num[columns[i]], num[columns[j]]
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        aggs += [r.alias(f"r{i}_{j}"), F.count(x).alias(f"n{i}_{j}")]
    if not pairs:
        return ds.df.sparkSession.createDataFrame([], "column_a string, column_b string, n long, correlation double")
    one = ds.df.agg(*aggs)
    rows = []
    for i, j in pairs:
        r = F.coalesce(F.when(~F.isnan(f"r{i}_{j}"), F.col(f"r{i}_{j}")), F.lit(0.0))
        rows.append(F.struct(F.lit(columns[i]).alias("column_a"), F.lit(columns[j]).alias("column_b"), F.col(f"n{i}_{j}").alias("n"), F.when(F.col(f"n{i}_{j}") >= 10, rounded(r, 4)).alias("correlation")))
    return one.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def correlation_matrix(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The symmetric matrix with 1 on the diagonal, in long form."""
    back = pairs.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation")
    same = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "column_a string, column_b string, correlation double")
    return pairs.select("column_a", "column_b", "correlation").union(back).union(same)


def correlation_classes(pairs: DataFrame) -> DataFrame:
    """Perfect above .99, very strong above .9, strong above .7."""
    r = F.abs("correlation")
    strength = F.when(r > 0.99, "perfect").when(r > 0.9, "very strong").when(r > 0.7, "strong")
    return pairs.withColumn("strength", strength).where("strength is not null").withColumn("direction", F.when(F.col("correlation") > 0, "positive").otherwise("negative"))


def benford_digits(ds: Dataset, column: str) -> DataFrame:
    """Counts of the first digits of positive values, with the expected
    shares."""
    num, text = parse_float(f"`{column}`", ds.type_of(column)), ds.text(column)
    digit = ds.df.where(num > 0).select(first_digit(text).alias("digit")).where("digit is not null")
    spine = ds.df.sparkSession.createDataFrame([(d, math.log10(1 + 1 / d)) for d in range(1, 10)], "digit int, expected double")
    return spine.join(digit.groupBy("digit").agg(F.count("*").alias("count")), "digit", "left").select("digit", "expected", F.coalesce("count", F.lit(0)).alias("count"))


def benford(ds: Dataset, column: str) -> DataFrame:
    """Chi-square against Benford's law, one row; none below 100 values."""
    d = benford_digits(ds, column)
    digits = d.groupBy().agg(F.sum("count").alias("n"), F.collect_list(F.struct("digit", "expected", "count")).alias("d")).where("n >= 100")
    share = lambda x: x["count"] / F.col("n")
    expected = lambda x: rounded(x["expected"], 3)
    chi = F.aggregate("d", F.lit(0.0), lambda s, x: s + (share(x) - expected(x)) ** 2 / expected(x)) * F.col("n")
    deviation = F.aggregate("d", F.lit(0.0), lambda s, x: s + F.abs(share(x) - expected(x))) / 2 * 100
    out = digits.select(F.lit(column).alias("column"), F.col("n").alias("sample_size"), chi.alias("chi"), deviation.alias("dev"))
    fits = F.col("chi") < CRITICAL
    violation = F.when(~fits & (F.col("dev") > 15), F.when(F.col("dev") > 30, "high").otherwise("medium"))
    return out.select("column", "sample_size", rounded(F.col("chi"), 2).alias("chi_squared"), fits.alias("is_compliant"), rounded(F.col("dev"), 2).alias("deviation_percent"), violation.alias("violation"))


def _values(ds: Dataset, column: str, numeric: bool) -> DataFrame:
    """Present values of a column, numbered 0, 1, ... in row order."""
    value = parse_float(f"`{column}`", ds.type_of(column)) if numeric else ds.text(column)
    here = value.isNotNull() if numeric else ~is_missing(f"`{column}`", ds.type_of(column))
    return reindex(ds.df.where(here).select(ROW, value.alias("value")))


def repeating(ds: Dataset, column: str) -> DataFrame:
    """Whether the values begin with a block of 2 to 10 that comes again at
    its own pace at least three times; one row for the smallest such block."""
    v = _values(ds, column, False)
    n = v.count()
    widest = min(10, n // 4)
    schema = "column string, size int, repeats long, confidence double"
    if n < 10 or widest < 2:
        return v.sparkSession.createDataFrame([], schema)
    head = [r["value"] for r in v.where(F.col("idx") < widest).orderBy("idx").collect()]
    head += [None] * (widest - len(head))
    aggs = []
    for size in range(2, widest + 1):
        want = F.element_at(F.array(*[F.lit(x) for x in head[:size]]), (F.col("idx") % size + 1).cast("int"))
        # blocks start at size, 2 * size, ... below n - size
        inside = (F.col("idx") >= size) & (F.floor(F.col("idx") / size) * size < n - size)
        aggs.append(F.struct(F.lit(size).alias("size"), F.floor(F.col("idx") / size).alias("block"), (F.col("value") == want).alias("same"), inside.alias("inside")))
    cells = v.select(F.explode(F.array(*aggs)).alias("c")).select("c.*").where("inside")
    blocks = cells.groupBy("size", "block").agg(F.min("same").alias("same"))
    repeats = blocks.groupBy("size").agg(F.sum(F.col("same").cast("long")).alias("repeats")).where("repeats >= 3")
    first = repeats.orderBy("size").limit(1)
    return first.select(F.lit(column).alias("column"), "size", "repeats", F.least(F.lit(0.95), rounded(F.lit(0.5) + F.col("repeats") / 10, 4)).alias("confidence"))


def shifts(ds: Dataset, column: str, max_jumps: int = 5) -> DataFrame:
    """Positions at which the mean of the next values jumps by over half;
    the frame is max(5, n / 10) values.  None below 20 values or beyond
    ``max_jumps`` jumps.

    Means come from running sums and a join on the position, so the cost doesn't
    grow with the frame.
    """
    v = _values(ds, column, True)
    n = v.count()
    if n < 20:
        return v.sparkSession.createDataFrame([], "position long, change_percent double")
    frame = max(5, n // 10)
    sums = running_sum(v, "value").select("idx", "running", "value")
    ends = with_previous(sums, "running", by=frame, name="before").where(F.col("idx") >= frame - 1)
    means = ends.select((F.col("idx") - frame + 1).alias("idx"), ((F.col("running") - F.coalesce("before", F.lit(0.0))) / frame).alias("mean"))
    pair = with_previous(means, "mean").where("previous is not null")
    size = (F.abs("mean") + F.abs("previous")) / 2
    change = F.when(size > 0, F.abs(F.col("mean") - F.col("previous")) / size * 100).otherwise(0.0)
    jumps = pair.select((F.col("idx") + frame).alias("position"), rounded(change, 1).alias("change_percent"), change.alias("c")).where("c > 50").drop("c")
    few = jumps.agg(F.count("*").alias("jumps")).where(F.col("jumps") <= max_jumps)
    return jumps.join(F.broadcast(few)).select("position", "change_percent")


def monotonic(ds: Dataset, column: str) -> DataFrame:
    """Share of steps up and down; the direction if over 90 % agree and
    there are 10 values."""
    pair = with_previous(_values(ds, column, True), "value")
    agg = pair.agg(F.count("*").alias("n"), F.sum((F.col("value") > F.col("previous")).cast("long")).alias("up"), F.sum((F.col("value") < F.col("previous")).cast("long")).alias("down")).where("n >= 10")
    up, down = F.col("up") / (F.col("n") - 1), F.col("down") / (F.col("n") - 1)
    direction = F.when(up > 0.9, "increasing").when(down > 0.9, "decreasing")
    return agg.select(F.lit(column).alias("column"), "n", rounded(up, 4).alias("increasing_ratio"), rounded(down, 4).alias("decreasing_ratio"), direction.alias("direction"))


def patterns(ds: Dataset, columns: list[str], numeric: set[str]) -> list[dict]:
    """V9: W7, W5, W6 and A26 for every column of 10 values or more."""
    out = []
    for r in frequency_anomalies(frequency_frame(ds, columns)).collect():  # a row per column
        out.append({"column": r["column"], "type": r["type"], "confidence": r["confidence"]})
    for c in columns:
        for r in repeating(ds, c).collect():  # one row
            out.append({"column": c, "type": "repeating-sequence", "confidence": r["confidence"], "size": r["size"], "repeats": r["repeats"]})
        if c in numeric:
            if found := [r["position"] for r in shifts(ds, c).orderBy("position").collect()]:  # five rows
                out.append({"column": c, "type": "sudden-shift", "confidence": 0.7, "positions": found})
            for r in monotonic(ds, c).where("direction is not null").collect():
                out.append({"column": c, "type": "monotonic-trend", "confidence": max(r["increasing_ratio"], r["decreasing_ratio"]), "direction": r["direction"]})
    return out


def group_stats(value: Column) -> list[Column]:
    """Mean and population deviation (4 digits), count, least, most."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [rounded(zero(F.avg(value)), 4).alias("mean"), rounded(zero(F.stddev_pop(value)), 4).alias("std_dev"), F.count(value).alias("count"), zero(F.min(value)).alias("min"), zero(F.max(value)).alias("max")]


def as_timestamp(ds: Dataset, column: str) -> Column:
    """Time columns as they are, texts by ``parse_date``; numbers never."""
    t = ds.type_of(column)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(f"`{column}`").cast("timestamp_ntz")
    return parse_date(F.col(f"`{column}`"))


#: Bucket of a time, and how many there are.
CYCLES = {"day_of_week": (lambda c: F.dayofweek(c) - 1, 7), "month": (lambda c: F.month(c) - 1, 12), "hour": (lambda c: F.hour(c), 24)}


def seasonal(ds: Dataset, date: str, value: str, cycle: str) -> DataFrame:
    """Statistics of ``value`` by weekday (Sunday 0), month or hour; a
    bucket is odd if it has 3 values and its mean is over 2 deviations from the
    overall one.  Hours without values are left out."""
    of, size = CYCLES[cycle]
    rows = ds.df.select(of(as_timestamp(ds, date)).alias("bucket"), parse_float(f"`{value}`", ds.type_of(value)).alias("v")).where("bucket is not null and v is not null")
    overall = rows.agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma"))
    found = rows.groupBy("bucket").agg(F.avg("v").alias("m"), *group_stats(F.col("v")))
    spine = ds.df.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"))
    out = spine.join(F.broadcast(found), "bucket", "inner" if cycle == "hour" else "left").join(F.broadcast(overall))
    odd = (F.col("count") >= 3) & (F.col("sigma") > 0) & (F.abs(F.col("m") - F.col("mu")) / F.col("sigma") > 2)
    deviation = F.when((F.col("count") > 0) & (F.col("mu") != 0), rounded((F.col("m") - F.col("mu")) / F.col("mu") * 100, 2)).otherwise(0.0)
    stat = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "std_dev", "min", "max")]
    return out.select("bucket", F.coalesce("count", F.lit(0)).alias("count"), *stat, deviation.alias("deviation_percent"), F.coalesce(odd, F.lit(False)).alias("is_anomaly"))


def trend(ds: Dataset, date: str, value: str) -> DataFrame:
    """Linear trend over the rows in the order of their date; one row,
    none below 5 values.

    The position is a row's rank by (date, row).
    """
    rows = ds.df.select(ROW, as_timestamp(ds, date).alias("t"), parse_float(f"`{value}`", ds.type_of(value)).alias("v")).where("t is not null and v is not null")
    placed = ranked(rows, "t", ROW, name="x").withColumn("x", F.col("x").cast("double"))
    agg = placed.agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.regr_slope("v", "x").alias("slope"), F.regr_r2("v", "x").alias("r2"), F.min_by("v", "x").alias("start_value"), F.max_by("v", "x").alias("end_value")
    ).where("n >= 5")
    change = F.when(F.col("mean") != 0, F.col("slope") * F.col("n") / F.col("mean") * 100).otherwise(0.0)
    r2 = F.when(F.col("r2").isNull() | F.isnan("r2"), 0.0).otherwise(F.col("r2"))
    direction = F.when(F.abs(change) < 5, "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return agg.select(
        ((F.abs(change) >= 5) & (r2 > 0.3)).alias("has_trend"), direction.alias("direction"), rounded(F.col("slope"), 6).alias("slope"), rounded(r2, 4).alias("r_squared"),
        rounded(change, 2).alias("percent_change"), "start_value", "end_value", F.col("n").alias("data_points"),
    )


def date_columns(ds: Dataset, sample: int = 100) -> list[str]:
    """Columns of which over 80 % of the first rows are dates."""
    names = [h for h in ds.headers if not is_numeric_type(ds.type_of(h)) and isinstance(ds.type_of(h), (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    if not names:
        return []
    agg = ds.df.where(F.col(ROW) <= sample).agg(*[F.avg(as_timestamp(ds, c).isNotNull().cast("int")).alias(str(i)) for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if (agg[str(i)] or 0) > 0.8]


def seasonal_report(ds: Dataset, max_values: int = 5) -> list[dict]:
    """Every date column with the first number columns (over half of
    the first 100 cells are numbers)."""
    dates = date_columns(ds)
    rest = [h for h in ds.headers if h not in dates]
    if not dates or not rest or ds.df.where(F.col(ROW) >= 10).isEmpty():
        return []
    agg = ds.df.where(F.col(ROW) <= 100).agg(*[F.avg(parse_float(f"`{c}`", ds.type_of(c)).isNotNull().cast("int")).alias(str(i)) for i, c in enumerate(rest)]).first()
    values = [c for i, c in enumerate(rest) if (agg[str(i)] or 0) > 0.5][:max_values]
    out = []
    for d in dates:
        for v in values:
            found = {k: [r.asDict() for r in seasonal(ds, d, v, k).collect()] for k in CYCLES}  # 43 rows
            line = trend(ds, d, v).collect()
            out.append({"date": d, "value": v, **found, "trend": line[0].asDict() if line else {"has_trend": False}})
    return out
