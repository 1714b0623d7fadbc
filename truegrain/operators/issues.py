"""Issue producers.

Every issue is a row of ``ISSUE_COLUMNS`` with its place in the report
(``stage_ord``, then the stage's own order), so that caps keep the same issues
whatever the partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ColumnRule
from ..dataset import ROW, Dataset
from ..functions.cells import is_missing, js_string, signature
from ..functions.numbers import is_numeric_type, parse_float, rounded
from ..functions.types import INFERENCE, type_predicate
from ..scratch import saved
from .frequency import frequency_frame, order_statistics

ISSUE_COLUMNS = ("rowNumber", "column", "value", "issueType", "severity", "message", "suggestion")
STAGES = {"types": 0, "constraints": 1, "duplicates": 2, "outliers": 3, "unique": 4}
# Messages and advice by kind of issue.
TEXTS = {
    "missing": ("Required field '{}' is missing", "Provide a valid value for this field"),
    "null": ("Field '{}' has null/empty value", "Provide a valid value for this field"),
    "duplicate": ("Exact duplicate of row ", "Consider removing or merging duplicate rows"),
    "fuzzy-duplicate": ("Similar to row ", "Review if these rows should be merged or deduplicated"),
    "outlier": (" is a statistical outlier ({} method)", "Verify this value is correct or consider capping/removing it"),
    "unique-violation": ("Duplicate value in unique column. First occurrence at row ", "Remove duplicate values or mark column as non-unique"),
}
# Advice by type.
ADVICE = {
    "number": "Ensure the value contains only numeric characters",
    "integer": "Ensure the value is a whole number without decimals",
    "date": "Use a standard date format like YYYY-MM-DD or MM/DD/YYYY",
    "email": "Format should be example@domain.com",
    "phone": "Include country code, e.g., +1-555-123-4567",
    "url": "Include protocol, e.g., https://example.com",
    "boolean": "Use true/false, yes/no, or 1/0",
    "uuid": "Format: xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx",
    "ip": "Use IPv4 (192.168.1.1) or IPv6 format",
    "json": "Ensure valid JSON syntax with proper quotes and brackets",
}


def possible_types(dtype: T.DataType) -> tuple[str, ...] | None:
    """The types that cells of a physical type can be inferred to be; None: any."""
    if is_numeric_type(dtype):
        return ("boolean", "integer", "number")
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return ("date",)
    return ("boolean",) if isinstance(dtype, T.BooleanType) else None


def surely(kind: str, dtype: T.DataType) -> bool:
    """Whether every cell of a physical type is of a logical type."""
    return (
        (isinstance(dtype, (T.IntegralType, T.DecimalType)) and kind == "number") or (isinstance(dtype, T.IntegralType) and kind == "integer")
        or (kind == "date" and isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))) or (kind == "boolean" and isinstance(dtype, T.BooleanType))
    )


def infer_types(ds: Dataset, columns: list[str] | None = None, sample: int = 100) -> dict[str, str]:
    """V2, V3: the first type whose test 90 % of the values in the first
    ``sample`` rows pass; string for columns without values."""
    names = columns or ds.headers
    if not names:
        return {}
    cells = [F.when(~is_missing(f"`{c}`", ds.type_of(c)), ds.text(c)).alias(f"c{i}") for i, c in enumerate(names)]
    rows = ds.df.where(F.col(ROW) <= sample).select(*cells).limit(sample).collect()
    spark = ds.df.sparkSession
    kinds = [k for k, _ in INFERENCE]
    able = spark.createDataFrame([(i, list(possible_types(ds.type_of(c)) or kinds)) for i, c in enumerate(names)], "i int, able array<string>")
    texts = spark.createDataFrame([(i, r[i]) for r in rows for i in range(len(names)) if r[i] is not None], "i int, text string").join(F.broadcast(able), "i")
    shares = [F.avg((F.array_contains("able", k) & F.coalesce(test(F.col("text")), F.lit(False))).cast("int")).alias(k) for k, test in INFERENCE]
    found = {r["i"]: r for r in texts.groupBy("i").agg(*shares).collect()}
    return {c: next((k for k in kinds if i in found and found[i][k] >= 0.9), "string") for i, c in enumerate(names)}


def resolve(ds: Dataset, rules: list[ColumnRule], detect: bool = True) -> list[ColumnRule]:
    """V2: declared rules first; other columns get their inferred type."""
    known = {r.name: r for r in rules if r.name in ds.headers}
    rest = [h for h in ds.headers if h not in known]
    types = infer_types(ds, rest) if detect and rest else {}
    return [known.get(h) or ColumnRule(h, types.get(h, "any")) for h in ds.headers]


def _issue(when: Column, ord_: int, column: str, value: Column, kind: str, severity: str, message: Column, suggestion: str) -> Column:
    return F.when(
        when,
        F.struct(F.lit(ord_).alias("rule_ord"), F.lit(column).alias("column"), value.alias("value"), F.lit(kind).alias("issueType"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(suggestion).alias("suggestion")),
    )


def _cell_rules(ds: Dataset, rule: ColumnRule, check_missing: bool) -> tuple[list[Column], list[Column]]:
    """Type-stage and constraint-stage issues of a column's cell."""
    c, dtype = F.col(f"`{rule.name}`"), ds.type_of(rule.name)
    missing, text = is_missing(c, dtype), ds.text(rule.name)
    shown, name = F.substring(text, 1, 100), rule.name
    types, limits = [], []
    if check_missing:
        kind, severity = ("missing", "error") if rule.required else ("null", "warning")
        said, advice = TEXTS[kind]
        types.append(_issue(missing, 0, name, F.when(c.isNull(), "null").otherwise(""), kind, severity, F.lit(said.format(name)), advice))
    if rule.type == "string":
        fits = F.lit(dtype.typeName() in ("string", "varchar", "char"))
    elif rule.type in ("number", "integer") and isinstance(dtype, (T.DoubleType, T.FloatType)):
        fits = ~F.isnan(c) & (F.abs(c) < float("inf"))
        if rule.type == "integer":
            fits &= c == F.floor(c)
    else:
        fits = None if surely(rule.type, dtype) else type_predicate(rule.type, text)
    if fits is not None:
        types.append(_issue(~missing & ~fits, 1, name, shown, "type-mismatch", "error", F.concat(F.lit("Value '"), F.substring(text, 1, 50), F.lit(f"' is not a valid {rule.type}")), ADVICE.get(rule.type, "Check the value format")))
    num, size, here = parse_float(c, dtype), F.length(text), ~missing
    tests = [
        (rule.min, lambda x: num < x, "range-min-violation", "Value {v} is below minimum {x}", "Value must be at least {x}"),
        (rule.max, lambda x: num > x, "range-max-violation", "Value {v} exceeds maximum {x}", "Value must be at most {x}"),
        (rule.min_length, lambda x: size < x, "length-min-violation", "Length is below minimum {x}", "Use at least {x} characters"),
        (rule.max_length, lambda x: size > x, "length-max-violation", "Length exceeds maximum {x}", "Use at most {x} characters"),
        (rule.pattern if rule.pattern and _compiles(ds, rule.pattern) else None, lambda x: ~text.rlike(x), "pattern-violation", "Value '{v}' does not match the required pattern", "Match the pattern {x}"),
        (rule.allowed, lambda x: ~text.isin(*x), "enum-violation", "Value '{v}' is not in the allowed list", "Use one of: {x}"),
    ]
    for i, (limit, broken, kind, said, advice) in enumerate(tests):
        if limit is not None:
            x = ", ".join(limit[:5]) if isinstance(limit, tuple) else str(limit)
            before, _, after = said.replace("{x}", x).partition("{v}")
            message = F.concat(F.lit(before), F.substring(text, 1, 50), F.lit(after)) if "{v}" in said else F.lit(before)
            limits.append(_issue(here & F.coalesce(broken(limit), F.lit(False)), i, name, shown, kind, "error", message, advice.replace("{x}", x)))
    for i, (label, test) in enumerate(rule.custom):
        limits.append(_issue(here & ~F.coalesce(test(c), F.lit(False)), 10 + i, name, shown, f"custom-{label}", "error", F.lit(f"Rule '{label}' is broken"), "Check the value"))
    return types, limits


def _compiles(ds: Dataset, pattern: str) -> bool:
    """Invalid patterns are ignored."""
    try:
        ds.df.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def cell_issues(ds: Dataset, rules: list[ColumnRule], check_missing: bool = True) -> DataFrame:
    """All rules over all cells in one projection of one scan."""
    parts = []
    for i, rule in enumerate(r for r in rules if r.name in ds.headers):
        for stage, found in zip(("types", "constraints"), _cell_rules(ds, rule, check_missing)):
            parts += [F.struct(F.lit(STAGES[stage]).alias("stage_ord"), F.lit(i).alias("col_ord"), x.alias("i")) for x in found]
    if not parts:
        return empty_issues(ds)
    hits = F.explode(F.filter(F.array(*parts), lambda x: x["i"].isNotNull()))
    rows = ds.df.where(reduce(Column.__or__, (x["i"].isNotNull() for x in parts))).select(F.col(ROW).alias("rowNumber"), hits.alias("x"))
    return rows.select("x.stage_ord", F.col("rowNumber").alias("ord1"), F.col("x.col_ord").cast("long").alias("ord2"), F.col("x.i.rule_ord").cast("long").alias("ord3"), "rowNumber", *[f"x.i.{c}" for c in ISSUE_COLUMNS[1:]])


ISSUE_SCHEMA = "stage_ord int, ord1 long, ord2 long, ord3 long, rowNumber long, column string, value string, issueType string, severity string, message string, suggestion string"


def cell_types(rules: list[ColumnRule]) -> list[str]:
    """The issue types that ``cell_issues`` may report."""
    kinds = ["missing", "null", "type-mismatch", "range-min-violation", "range-max-violation", "length-min-violation", "length-max-violation", "pattern-violation", "enum-violation"]
    return kinds + sorted({f"custom-{label}" for r in rules for label, _ in r.custom})


def empty_issues(ds: Dataset) -> DataFrame:
    return ds.df.sparkSession.createDataFrame([], ISSUE_SCHEMA)


def _finish(df: DataFrame, stage: str, ord1: Column, ord2: Column, row: Column, column: Column, value: Column, kind: str, severity: str, message: Column, suggestion: str) -> DataFrame:
    return df.select(
        F.lit(STAGES[stage]).alias("stage_ord"), ord1.cast("long").alias("ord1"), ord2.cast("long").alias("ord2"), F.lit(0).cast("long").alias("ord3"), row.alias("rowNumber"),
        column.alias("column"), value.alias("value"), F.lit(kind).alias("issueType"), F.lit(severity).alias("severity"), message.alias("message"), F.lit(suggestion).alias("suggestion"),
    )


#: Repeated keys that are sent to every task; more are joined by shuffle.
FEW = 1_000_000


def with_first(ds: Dataset, key: Column) -> DataFrame:
    """Row number, ``_key`` and ``_first``, the first row of the same key, of
    the rows whose key occurs more than once.

    Keys are counted by their hash, partially aggregated where they lie, and only
    rows whose hash comes again are compared by the key itself.  The join to them
    can be split by the adaptive skew handling.
    """
    keyed = ds.df.select(ROW, key.alias("_key")).withColumn("_hash", F.xxhash64("_key"))
    again = saved(keyed.groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"), "again")
    some = keyed.join(F.broadcast(again) if again.count() <= FEW else again, "_hash")
    first = some.groupBy("_key").agg(F.min(ROW).alias("_first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return some.drop("_hash").join(first, "_key")


def duplicate_issues(ds: Dataset, columns: list[str] | None = None) -> DataFrame:
    """Rows whose signature an earlier row has."""
    names = [c for c in (columns or ds.headers) if c in ds.headers]
    rows = with_first(ds, signature([ds.text(c) for c in names])).where(F.col(ROW) > F.col("_first"))
    return _finish(rows, "duplicates", F.lit(0), F.col(ROW), F.col(ROW), F.lit(", ".join(names)), F.substring("_key", 1, 100), "duplicate", "warning", F.concat(F.lit(TEXTS["duplicate"][0]), F.col("_first").cast("string")), TEXTS["duplicate"][1])


def fuzzy_pairs(ds: Dataset, columns: list[str], similarity: float = 0.85, rows: int = 1000, most: int = 10_000) -> DataFrame:
    """Pairs of the first ``rows`` rows whose signatures are similar but
    not equal; none if the data has over ``most`` rows.

    ``rows`` is the operator's own limit and bounds both sides, so the smaller
    one is sent to all tasks.  Lengths are compared before the distance, which
    stops at the largest one that would still do.
    """
    if not ds.df.where(F.col(ROW) > most).isEmpty():
        rows = 0
    sig = signature([ds.text(c) for c in columns])
    side = ds.df.where(F.col(ROW) <= rows).select(F.col(ROW).alias("r"), sig.alias("s")).withColumn("n", F.length("s"))
    a, b = side.select(*[F.col(c).alias(f"{c}1") for c in side.columns]), side.select(*[F.col(c).alias(f"{c}2") for c in side.columns])
    longest = F.greatest("n1", "n2")
    allowed = F.floor(longest * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    near = a.join(F.broadcast(b), (F.col("r1") < F.col("r2")) & (F.col("s1") != F.col("s2")) & (F.abs(F.col("n1") - F.col("n2")) <= allowed))
    near = near.withColumn("d", F.levenshtein("s1", "s2")).where(F.col("d") <= allowed).where(1 - F.col("d") / longest >= similarity)
    return near.select("r1", "r2", (1 - F.col("d") / longest).alias("similarity"))


def fuzzy_issues(ds: Dataset, columns: list[str] | None, similarity: float) -> DataFrame:
    names = [c for c in (columns or ds.headers) if c in ds.headers]
    pairs = fuzzy_pairs(ds, names, similarity)
    shown = F.concat(F.format_number(rounded(F.col("similarity") * 100, 1), "0.0"), F.lit("%"))
    return _finish(pairs, "duplicates", F.col("r1"), F.col("r2"), F.col("r2"), F.lit(", ".join(names)), F.concat(F.lit("Similarity: "), shown), "fuzzy-duplicate", "info", F.concat(F.lit(TEXTS["fuzzy-duplicate"][0]), F.col("r1").cast("string"), F.lit(" ("), shown, F.lit(" match)")), TEXTS["fuzzy-duplicate"][1])


def blocked_pairs(ds: Dataset, columns: list[str], similarity: float = 0.85, size: int = 3) -> DataFrame:
    """J1 beyond the first 1000 rows: all similar pairs of different signatures
    (each by its first row), from equality joins.  ``d`` is the most edits that
    leave a signature similar to any other.

    Pairs of which one signature allows a single edit meet without that edit
    (``one_edit``), the others on rare parts (``rare_parts``).
    """
    sigs = ds.df.select(signature([ds.text(c) for c in columns]).alias("s"), F.col(ROW).alias("r")).groupBy("s").agg(F.min("r").alias("r"))
    sigs = sigs.withColumn("n", F.length("s")).where("n >= 1").withColumn("d", F.floor(F.col("n") / F.lit(similarity) * F.lit(1 - similarity) + F.lit(1e-9)).cast("int"))
    sigs = saved(sigs.where("d >= 1"), "signatures")
    longest_one, most = sigs.agg(F.max(F.when(F.col("d") == 1, F.col("n"))), F.max("d")).first()
    found = []
    if longest_one is not None:
        near = saved(one_edit(sigs.where(F.col("n") <= longest_one + 1)), "one-edit")
        for i in (1, 2):
            near = near.hint("merge").join(sigs.select(*[F.col(c).alias(f"{c}{i}") for c in sigs.columns]), f"r{i}")
        found.append(near.where(F.least("d1", "d2") == 1).select("r1", "r2", "s1", "s2", "n1", "n2"))
    if most is not None and most > 1:
        found.append(rare_parts(sigs.where("d > 1"), similarity, size))
    if not found:
        found.append(sigs.select(*[F.col(c).alias(f"{c}{i}") for c in ("r", "s", "n") for i in (1, 2)]).where("false"))
    longest = F.greatest("n1", "n2")
    near = [_near(pairs, similarity).select("r1", "r2", (1 - F.col("d") / longest).alias("similarity")) for pairs in found]
    return reduce(DataFrame.union, near)


def _near(pairs: DataFrame, similarity: float) -> DataFrame:
    """The similar ones of ``pairs``, with their distance ``d``."""
    allowed = F.floor(F.greatest("n1", "n2") * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
    return pairs.where(F.abs(F.col("n1") - F.col("n2")) <= allowed).withColumn("d", F.levenshtein("s1", "s2")).where(F.col("d") <= allowed)


def one_edit(sigs: DataFrame) -> DataFrame:
    """(r1, r2) of all signatures that are one edit apart, each pair once.

    Every signature goes out whole and without each of its characters, by hash.
    Two that differ in one place are equal without it; one that has a character
    more is equal without it to the other (without the first of a run of equal
    characters, so that they meet once).  Nothing else is paired, so rows grow
    with the signatures' lengths and the pairs found, however alike signatures are.
    Strings of equal hash aren't told apart: compare what is found.
    """
    places = sigs.select("r", "s", "n", F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("at"))  # -1: whole
    ch = lambda at: F.substring("s", at, F.lit(1))
    leads = (F.col("at") == 0) | (ch(F.col("at") + 1) != ch(F.col("at")))
    rest = F.concat(F.substring("s", F.lit(1), F.col("at")), F.substring("s", F.col("at") + 2, F.col("n")))
    keys = places.select(F.xxhash64(rest).alias("h"), "r", (F.col("at") * 2 + F.when(F.col("at") >= 0, leads.cast("int")).otherwise(0)).alias("code"))
    a, b = (keys.select("h", *[F.col(c).alias(f"{c}{i}") for c in ("r", "code")]) for i in (1, 2))
    at1, at2 = F.shiftright("code1", 1), F.shiftright("code2", 1)
    lead = lambda c: (F.col(c) >= 0) & (F.col(c) % 2 == 1)
    # merged, for Spark takes exploded rows to be as small as those they come from, and would broadcast them
    return a.hint("merge").join(b, "h").where((F.col("r1") < F.col("r2")) & ((at1 == at2) | ((at1 < 0) & lead("code2")) | (lead("code1") & (at2 < 0)))).select("r1", "r2")


def rare_parts(sigs: DataFrame, similarity: float, size: int) -> DataFrame:
    """The similar pairs of ``sigs``, each once, and perhaps more.

    An edit changes at most ``size`` of a signature's grams, so two signatures
    ``d`` edits apart share one of the ``d * size + 1`` rarest grams of either, if
    they have so many.  Signatures that haven't, and all that may be similar to
    them, also meet on their ``d + 1`` rarest characters (a character's second
    occurrence is another part than its first), of which an edit changes one.
    Pairs are compared where they meet and count at the least part that they
    share, so none are shuffled; time grows with the signatures that share a part.
    """
    pieces = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - k + 1, F.lit(1))), lambda i: F.substring("s", i, F.lit(k)))
    sigs = sigs.withColumn("grams", F.array_distinct(pieces(size)))
    few = F.size("grams") <= F.col("d") * size
    longest_few = sigs.where(few).agg(F.max("n")).first()[0]

    def rarest(parts: DataFrame, need: Column) -> DataFrame:
        counts = parts.groupBy("g").agg(F.count("*").alias("c"))
        rank = F.row_number().over(Window.partitionBy("r").orderBy("c", "g"))
        return parts.join(counts, "g").withColumn("k", rank).where(F.col("k") <= need).select("g", "r", "s", "n")

    kept = rarest(sigs.where(~few).select("r", "s", "n", "d", F.explode("grams").alias("g")), F.col("d") * size + 1)
    if longest_few is not None:
        chars = sigs.where(F.col("n") <= longest_few / similarity + 1).select("r", "s", "n", "d", F.posexplode(pieces(1)).alias("at", "ch"))
        again = F.row_number().over(Window.partitionBy("r", "ch").orderBy("at")).cast("string")
        kept = kept.union(rarest(chars.select("r", "s", "n", "d", F.concat(F.lit("\u0001"), "ch", again).alias("g")), F.col("d") + 1))
    kept = kept.groupBy("r").agg(F.first("s").alias("s"), F.first("n").alias("n"), F.collect_set("g").alias("all"))
    kept = saved(kept, "parts").select("r", "s", "n", "all", F.explode("all").alias("g"))
    a, b = (kept.select("g", *[F.col(c).alias(f"{c}{i}") for c in ("r", "s", "n", "all")]) for i in (1, 2))
    near = _near(a.hint("merge").join(b, "g").where(F.col("r1") < F.col("r2")), similarity)
    return near.where(F.col("g") == F.array_min(F.array_intersect("all1", "all2"))).select("r1", "r2", "s1", "s2", "n1", "n2")


def numeric_columns(rules: list[ColumnRule]) -> list[str]:
    """P5."""
    return [r.name for r in rules if r.type in ("number", "integer")]


def outlier_bounds(ds: Dataset, columns: list[str], method: str = "iqr", threshold: float = 3.0, freq: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """V4, V5: one row per column with ``low`` and ``high``; columns with too few
    values or without spread have none.  ``freq``: the frequency frame of these
    columns or more, if there is one, with its ``order`` statistics."""
    freq = saved(frequency_frame(ds, columns), "frequencies") if freq is None else freq.where(F.col("column").isin(columns))
    freq = freq.where("num is not null")
    if method == "iqr":
        stats = freq.groupBy("col_ord", "column").agg(F.sum("cnt").alias("n")).where("n >= 10").join(F.broadcast(order_statistics(freq) if order is None else order), "col_ord")
        spread = (F.col("q2") - F.col("q0")) * 1.5
        return stats.select("col_ord", "column", (F.col("q0") - spread).alias("low"), (F.col("q2") + spread).alias("high"))
    mean = freq.groupBy("col_ord", "column").agg(F.sum("cnt").alias("n"), (F.sum(F.col("num") * F.col("cnt")) / F.sum("cnt")).alias("mean")).where("n >= 10")
    var = freq.join(F.broadcast(mean), ["col_ord", "column"]).groupBy("col_ord", "column").agg(F.first("mean").alias("mean"), F.sqrt(F.sum((F.col("num") - F.col("mean")) ** 2 * F.col("cnt")) / F.first("n")).alias("std"))
    return var.where("std > 0").select("col_ord", "column", (F.col("mean") - threshold * F.col("std")).alias("low"), (F.col("mean") + threshold * F.col("std")).alias("high"))


def outlier_issues(ds: Dataset, columns: list[str], method: str = "iqr", threshold: float = 3.0, freq: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """Values outside the bounds, of which there is a row per column.
    Rows are filtered by the bounds as they are scanned."""
    if method not in ("iqr", "zscore") or not columns:
        return empty_issues(ds)
    bounds = {r["column"]: (r["low"], r["high"]) for r in outlier_bounds(ds, columns, method, threshold, freq, order).collect()}  # a row per column
    cells = []
    for i, c in enumerate(columns):
        if c in bounds:
            num, (low, high) = parse_float(f"`{c}`", ds.type_of(c)), bounds[c]
            out = ~is_missing(f"`{c}`", ds.type_of(c)) & ((num < F.lit(low)) | (num > F.lit(high)))
            cells.append(F.when(out, F.struct(F.lit(i).alias("col_ord"), F.lit(c).alias("column"), num.alias("num"))))
    if not cells:
        return empty_issues(ds)
    out = ds.df.where(reduce(Column.__or__, (x.isNotNull() for x in cells))).select(F.col(ROW).alias("row"), F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("c")).select("row", "c.*")
    shown = js_string("num", T.DoubleType())
    return _finish(out, "outliers", F.col("col_ord"), F.col("row"), F.col("row"), F.col("column"), shown, "outlier", "warning", F.concat(F.lit("Value "), shown, F.lit(TEXTS["outlier"][0].format(method.upper()))), TEXTS["outlier"][1])


def unique_issues(ds: Dataset, columns: list[str]) -> DataFrame:
    """Repeated values of columns that must be unique."""
    out = None
    for i, c in enumerate(x for x in columns if x in ds.headers):
        some = Dataset(ds.df.where(~is_missing(f"`{c}`", ds.type_of(c))), ds.headers)
        rows = with_first(some, ds.text(c)).where(F.col(ROW) > F.col("_first"))
        one = _finish(rows, "unique", F.lit(i), F.col(ROW), F.col(ROW), F.lit(c), F.substring("_key", 1, 50), "unique-violation", "error", F.concat(F.lit(TEXTS["unique-violation"][0]), F.col("_first").cast("string")), TEXTS["unique-violation"][1])
        out = one if out is None else out.unionByName(one)
    return out if out is not None else empty_issues(ds)


def capped(issues: DataFrame, limit: int, per: tuple[str, ...] = ("stage_ord", "issueType")) -> DataFrame:
    """The first ``limit`` issues of each kind in report order.  The
    rank limit is pushed below the shuffle, so a kind with a third of all rows
    leaves each task as ``limit`` rows."""
    rank = F.row_number().over(Window.partitionBy(*per).orderBy("ord1", "ord2", "ord3"))
    return issues.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def truncated(issues: DataFrame, limit: int) -> DataFrame:
    """The report's first ``limit`` issues."""
    return issues.orderBy("stage_ord", "ord1", "ord2", "ord3").limit(limit)


def counts_by_type(issues: DataFrame) -> DataFrame:
    """Issues of each type."""
    return issues.groupBy("issueType").agg(F.count("*").alias("count"))


def duplicate_groups_report(issues: DataFrame) -> DataFrame:
    """Row numbers by the value that is repeated."""
    return issues.where("issueType = 'duplicate'").groupBy("value").agg(F.sort_array(F.collect_list("rowNumber")).alias("rows"), F.count("*").alias("count"))


def numeric_headers(ds: Dataset) -> list[str]:
    return [h for h in ds.headers if is_numeric_type(ds.type_of(h))]
