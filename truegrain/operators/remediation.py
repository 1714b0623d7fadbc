"""Cleaning, imputation, duplicate strategies and personal data (M1-M6, P14,
P15, U2-U4, J5, A21-A23, A27, O7, I1-I3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ColumnRule
from ..dataset import ROW, Dataset
from ..functions.cells import is_blank, is_missing, signature
from ..functions.numbers import is_numeric_type, js_number, rounded
from ..functions.personal import DEFAULT_KINDS, EMBEDDED, PII, is_personal, mask
from ..functions.text import trimmed
from .frequency import frequency_frame, modes, order_statistics
from .issues import with_first
from .ordered import filled

# --- cleaning ---------------------------------------------------------------


def _texts(ds: Dataset) -> list[str]:
    return [h for h in ds.headers if isinstance(ds.type_of(h), T.StringType)]


def _mapped(ds: Dataset, f) -> Dataset:
    texts = set(_texts(ds))
    return Dataset(ds.df.select(ROW, *[(f(F.col(f"`{h}`")) if h in texts else F.col(f"`{h}`")).alias(h) for h in ds.headers]), ds.headers, dict(ds.metadata))


def remove_empty(ds: Dataset) -> Dataset:
    """Without rows in which every cell is missing."""
    gone = F.lit(True)
    for h in ds.headers:
        gone = gone & is_missing(f"`{h}`", ds.type_of(h))
    return Dataset(ds.df.where(~gone), ds.headers, dict(ds.metadata))


def remove_duplicates(ds: Dataset, columns: list[str] | None = None) -> Dataset:
    """The first row of each signature."""
    return keep(ds, columns or ds.headers, "first")


ACTIONS = {
    "trim": lambda ds, cols: _mapped(ds, trimmed),
    "lowercase": lambda ds, cols: _mapped(ds, F.lower),
    "uppercase": lambda ds, cols: _mapped(ds, F.upper),
    "removeEmpty": lambda ds, cols: remove_empty(ds),
    "removeEmptyRows": lambda ds, cols: remove_empty(ds),
    "removeDuplicates": remove_duplicates,
}


def clean(ds: Dataset, actions: list[str], duplicate_columns: list[str] | None = None) -> Dataset:
    """M1: the actions one after another; unknown ones are ignored."""
    for action in actions:
        if action in ACTIONS:
            ds = ACTIONS[action](ds, duplicate_columns)
    return ds


# --- duplicate strategies ---------------------------------------------------


def _key(ds: Dataset, columns: list[str]) -> Column:
    return signature([ds.text(c) for c in columns if c in ds.headers])


def duplicate_groups(ds: Dataset, columns: list[str]) -> DataFrame:
    """Signatures of more than one row, with how many and the first and last
    row.  Members are rows of ``group_members``, not an array, for a group may
    hold a third of all rows."""
    keyed = ds.df.select(_key(ds, columns).alias("signature"), ROW)
    return keyed.groupBy("signature").agg(F.count("*").alias("count"), F.min(ROW).alias("first_row"), F.max(ROW).alias("last_row")).where("count > 1")


def group_members(ds: Dataset, columns: list[str]) -> DataFrame:
    """``signature``, ``_row`` of all members of duplicate groups."""
    return with_first(ds, _key(ds, columns)).select(F.col("_key").alias("signature"), F.col("_first").alias("first_row"), ROW)


def keep(ds: Dataset, columns: list[str], which: str) -> Dataset:
    """U4: of each group the ``first``, the ``last`` or ``none``."""
    keyed = ds.df.withColumn("_key", _key(ds, columns))
    pick = {"first": F.min(ROW), "last": F.max(ROW), "none": F.min(ROW)}[which]
    groups = keyed.groupBy("_key").agg(pick.alias("_pick"), F.count("*").alias("_n"))
    kept = groups.where("_n = 1") if which == "none" else groups
    out = ds.df.join(kept.select(F.col("_pick").alias(ROW)), ROW, "left_semi")
    return Dataset(out.select(*ds.df.columns), ds.headers, dict(ds.metadata))


def flag(ds: Dataset, columns: list[str]) -> DataFrame:
    """U4: all rows with ``_isDuplicate`` and ``_duplicateOf``, the first row of
    the group for all but that row."""
    first = duplicate_groups(ds, columns).select(F.col("signature").alias("_key"), "first_row")
    keyed = ds.df.withColumn("_key", _key(ds, columns)).join(first, "_key", "left")
    later = F.coalesce(F.col(ROW) > F.col("first_row"), F.lit(False))
    return keyed.select(*ds.df.columns, later.alias("_isDuplicate"), F.when(later, F.col("first_row")).alias("_duplicateOf"))


def merge(ds: Dataset, columns: list[str]) -> Dataset:
    """One row per group, each cell the first that isn't missing."""
    keyed = ds.df.withColumn("_key", _key(ds, columns))
    first = [F.min_by(F.col(f"`{h}`"), F.when(~is_missing(f"`{h}`", ds.type_of(h)), F.col(ROW))).alias(h) for h in ds.headers]
    out = keyed.groupBy("_key").agg(F.min(ROW).alias(ROW), *first).drop("_key")
    return Dataset(out.select(ROW, *[f"`{h}`" for h in ds.headers]), ds.headers, dict(ds.metadata))


STRATEGIES = ("keepFirst", "keepLast", "removeAll", "flag", "merge")


def handle_duplicates(ds: Dataset, strategy: str, columns: list[str] | None = None) -> tuple[DataFrame, dict]:
    """M6: the rows after a strategy, and what it did."""
    names = [c for c in (columns or ds.headers) if c in ds.headers]
    sizes = duplicate_groups(ds, names).agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    out = {
        "keepFirst": lambda: keep(ds, names, "first").df, "keepLast": lambda: keep(ds, names, "last").df, "removeAll": lambda: keep(ds, names, "none").df,
        "flag": lambda: flag(ds, names), "merge": lambda: merge(ds, names).df,
    }.get(strategy, lambda: ds.df)()
    removed = {"flag": 0, "removeAll": sizes[1]}.get(strategy, sizes[1] - sizes[0] if strategy in STRATEGIES else 0)
    return out, {"strategy": strategy, "duplicate_groups": sizes[0], "duplicate_rows": sizes[1], "removed": removed}


# --- missing values ---------------------------------------------------------


def missing_analysis(ds: Dataset) -> DataFrame:
    """Per column the blank cells and their share, most first."""
    n = F.count("*")
    cells = [F.struct(F.lit(h).alias("column"), F.sum(is_blank(f"`{h}`", ds.type_of(h)).cast("long")).alias("missing"), n.alias("total")) for h in ds.headers]
    rows = ds.df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    return rows.select("column", F.coalesce("missing", F.lit(0)).alias("missing_count"), F.when(F.col("total") > 0, rounded(F.col("missing") * 100 / F.col("total"), 2)).otherwise(0.0).alias("missing_percent"))


def missing_summary(ds: Dataset) -> DataFrame:
    """Rows, blank cells and rows with one, in one row."""
    blanks = [is_blank(f"`{h}`", ds.type_of(h)).cast("long") for h in ds.headers]
    per_row = sum(blanks[1:], blanks[0])
    return ds.df.select(per_row.alias("b")).agg(F.count("*").alias("total_rows"), F.sum("b").alias("missing_cells"), F.sum((F.col("b") > 0).cast("long")).alias("rows_with_missing"))


def most_missing(ds: Dataset, k: int = 5) -> DataFrame:
    """O7."""
    return missing_analysis(ds).where("missing_count > 0").orderBy(F.desc("missing_count"), "column").limit(k)


def column_kind(ds: Dataset, column: str) -> str:
    """Numeric if over 80 % of the values are numbers as a whole."""
    if is_numeric_type(ds.type_of(column)):
        return "numeric" if not ds.df.where(~is_blank(f"`{column}`", ds.type_of(column))).isEmpty() else "categorical"
    here = ~is_blank(f"`{column}`", ds.type_of(column))
    share = ds.df.agg(F.avg(F.when(here, js_number(F.col(f"`{column}`")).isNotNull().cast("int")))).first()[0]
    return "numeric" if share is not None and share > 0.8 else "categorical"


def _statistic(ds: Dataset, column: str, what: str, blank_as_zero: bool) -> object:
    """The number or text that fills a column's gaps."""
    c, t = F.col(f"`{column}`"), ds.type_of(column)
    if what == "mode":
        some = Dataset(ds.df.where(~is_blank(f"`{column}`", t)), ds.headers)
        found = modes(frequency_frame(some, [column])).first()
        return found["mode"] if found else None
    number = c.cast("double") if is_numeric_type(t) else F.when(F.lit(blank_as_zero) | ~is_blank(c, t), js_number(c))
    if what == "mean":
        return ds.df.agg(F.avg(number)).first()[0]
    counts = ds.df.select(number.alias("num")).where("num is not null and not isnan(num)").groupBy("num").agg(F.count("*").alias("cnt"))
    found = order_statistics(counts.withColumn("col_ord", F.lit(0)), ()).first()
    return found["median"] if found else None


def impute(ds: Dataset, strategy: str = "auto", columns: list[str] | None = None, constant: object = None, exclude: list[str] | None = None, legacy_blank_as_zero: bool = False) -> tuple[Dataset, list[dict]]:
    """M2-M5: fill each column's blank cells, or remove their rows, column after
    column; ``auto`` is the median of numeric columns and the mode of others.
    Mean and median fall back to the mode, and a column without values stays.  A
    filled integer column becomes one of doubles, for statistics needn't be
    whole.  Complete columns cost one pass for all of them."""
    stats = []
    wanted = [c for c in (columns or ds.headers) if c in ds.headers and c not in (exclude or [])]
    if not wanted:
        return ds, stats
    found = ds.df.agg(*[F.sum(is_blank(f"`{c}`", ds.type_of(c)).cast("long")).alias(str(i)) for i, c in enumerate(wanted)]).first()
    for column in [c for i, c in enumerate(wanted) if found[i]]:
        t = ds.type_of(column)
        blank = is_blank(f"`{column}`", t)
        missing = ds.df.where(blank).count() if strategy == "remove" else found[wanted.index(column)]
        if not missing:
            continue
        what = strategy
        kind = column_kind(ds, column)
        if what == "auto":
            what = "median" if kind == "numeric" else "mode"
        if what in ("mean", "median") and kind != "numeric":
            what = "mode"
        value: object = None
        if what in ("mean", "median", "mode"):
            value = _statistic(ds, column, what, legacy_blank_as_zero)
            if value is None:
                what = "none"
        if what == "constant":
            value = constant if constant is not None else (0 if kind == "numeric" else "")
        if what == "remove":
            df = ds.df.where(~blank)
        elif what in ("forwardFill", "backwardFill"):
            df = filled(ds.df, {column: blank}, what == "forwardFill")
        elif what == "none":
            df = ds.df
        else:
            new = F.lit(value).cast(t) if not isinstance(t, T.IntegralType) else F.lit(value).cast("double")
            df = ds.df.withColumn(column, F.when(blank, new).otherwise(F.col(f"`{column}`")))
        ds = Dataset(df, ds.headers, dict(ds.metadata))
        stats.append({"column": column, "strategy": what, "missing": missing, "imputed": missing if what not in ("remove", "none") else 0, "removed": missing if what == "remove" else 0, "value": round(value, 4) if isinstance(value, float) else value})
    return ds, stats


# --- personal data ----------------------------------------------------------


def personal_cells(ds: Dataset, kinds: tuple[str, ...] = DEFAULT_KINDS, columns: list[str] | None = None) -> DataFrame:
    """One row per cell and kind that it is, with the place in the report
    (column, then row)."""
    names = columns or ds.headers
    found = []
    for i, h in enumerate(names):
        text = F.trim(ds.text(h))
        for kind in kinds:
            if kind in PII:
                name, risk, _ = PII[kind]
                found.append(F.when(~is_missing(f"`{h}`", ds.type_of(h)) & is_personal(kind, text), F.struct(F.lit(i).alias("col_ord"), F.lit(h).alias("column"), F.lit(kind).alias("piiType"), F.lit(name).alias("piiName"), F.lit(risk).alias("risk"), mask(kind, text).alias("maskedValue"), F.lit(f"Potential {name} detected").alias("message"))))
    rows = ds.df.select(F.col(ROW).alias("rowNumber"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return rows.select("rowNumber", "f.*")


def personal_findings(cells: DataFrame, limit: int = 100) -> DataFrame:
    """The first ``limit`` findings of each kind."""
    rank = F.row_number().over(Window.partitionBy("piiType").orderBy("col_ord", "rowNumber"))
    return cells.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank", "col_ord")


def personal_summary(cells: DataFrame) -> DataFrame:
    """Findings by kind."""
    return cells.groupBy("piiType", "risk").agg(F.count("*").alias("count"))


def personal_embedded(ds: Dataset, column: str, kinds: tuple[str, ...] = tuple(EMBEDDED)) -> DataFrame:
    """I1 inside longer text: one row per match."""
    text = ds.text(column)

    def matches(kind: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(EMBEDDED[kind]), 0), lambda m: F.struct(F.lit(kind).alias("piiType"), m.alias("value")))

    found = [matches(k) for k in kinds]
    rows = ds.df.select(F.col(ROW).alias("rowNumber"), F.explode(F.concat(*found)).alias("f"))
    shown = F.col("f.value")
    masked = F.lit(None).cast("string")
    for k in kinds:
        masked = F.when(F.col("f.piiType") == k, mask(k, shown)).otherwise(masked)
    return rows.select("rowNumber", "f.piiType", masked.alias("maskedValue"))


def required_missing(rules: list[ColumnRule]) -> list[str]:
    return [r.name for r in rules if r.required]
