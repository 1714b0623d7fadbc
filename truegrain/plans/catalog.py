"""Queries of the library's operators over the test tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ColumnRule
from ..dataset import ROW, Dataset
from ..functions import cells, dates, numbers, personal, text
from ..operators import frequency, issues, ordered, quality, remediation, statistics
from ..sources import connectors, readers
from ..streaming import quality as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The tables have no missing cells, so some are emptied alike in both engines.
E = """e AS (SELECT event_id + 1 AS rn, event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS event_type,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, props, ts FROM events)"""
P = "p AS (SELECT p_partkey + 1 AS rn, * FROM part)"


def events(spark: SparkSession, sf_dir: str) -> Dataset:
    df = _t(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, "").otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"), "props", "ts",
    )
    return Dataset.of(df, F.col("event_id") + 1)


def whole(spark: SparkSession, sf_dir: str, table: str, key: str, columns: list[str] | None = None) -> Dataset:
    df = _t(spark, sf_dir, table)
    ds = Dataset.of(df, F.col(key) + 1)
    return Dataset(ds.df, columns or ds.headers)


def parts(spark: SparkSession, sf_dir: str) -> Dataset:
    return whole(spark, sf_dir, "part", "p_partkey")


def r4(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def js(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


# --- profiles ----------------------------------------------------------------


def _numeric_sql(source: str, column: str, prefix: str = "") -> str:
    return f"""
WITH {prefix} v AS (SELECT {column} AS x FROM {source}), s AS (SELECT CAST(x AS DOUBLE) AS x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM v WHERE x IS NOT NULL),
a AS (SELECT count(*) AS total, count(x) AS k, count(DISTINCT x) AS u FROM v)
SELECT '{column}' AS "column", CAST(any_value(total) AS BIGINT) AS total_count, CAST(any_value(total - k) AS BIGINT) AS null_count, {r4("any_value(total - k) * 100.0::DOUBLE / any_value(total)", 2)} AS null_percent,
 CAST(any_value(u) AS BIGINT) AS unique_count, {r4("any_value(u) * 100.0::DOUBLE / any_value(k)", 2)} AS unique_percent, 'numeric' AS detected_type,
 {r4("min(x)")} AS min, {r4("max(x)")} AS max, {r4("avg(x)")} AS mean, {r4("(max(CASE WHEN i = (n - 1) // 2 THEN x END) + max(CASE WHEN i = n // 2 THEN x END)) / 2")} AS median,
 {r4("stddev_pop(x)")} AS std_dev, {r4("max(CASE WHEN i = CAST(floor(n * 0.25) AS BIGINT) THEN x END)")} AS q1, {r4("max(CASE WHEN i = CAST(floor(n * 0.75) AS BIGINT) THEN x END)")} AS q3, {r4("sum(x)")} AS sum
FROM s, a"""


def _numeric(ds: Dataset, column: str) -> DataFrame:
    return frequency.profiles(ds, [column]).select("column", "total_count", "null_count", "null_percent", "unique_count", "unique_percent", "detected_type", "min", "max", "mean", "median", "std_dev", "q1", "q3", "sum")


@query(_numeric_sql("orders", "o_totalprice"))
def profile_numeric_orders(spark, sf_dir):
    """A1, A3, A4, O2."""
    return _numeric(whole(spark, sf_dir, "orders", "o_orderkey"), "o_totalprice")


@query(_numeric_sql("e", "value", E + ","))
def profile_numeric_events(spark, sf_dir):
    """A1, A3, A4 with missing cells."""
    return _numeric(events(spark, sf_dir), "value")


@query(_numeric_sql("lineitem", "l_extendedprice"))
def profile_numeric_lineitem(spark, sf_dir):
    """A1, A3, A4 over the largest table."""
    return _numeric(Dataset(_t(spark, sf_dir, "lineitem").withColumn(ROW, F.lit(1).cast("long")), ["l_extendedprice"]), "l_extendedprice")


def _string_sql(table: str, columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", CAST(count(*) AS BIGINT) AS total_count, CAST(count(*) - count(NULLIF({c}, '')) AS BIGINT) AS null_count, CAST(count(DISTINCT NULLIF({c}, '')) AS BIGINT) AS unique_count,
 CAST(min(length(NULLIF({c}, ''))) AS BIGINT) AS min_length, CAST(max(length(NULLIF({c}, ''))) AS BIGINT) AS max_length, floor(avg(length(NULLIF({c}, ''))) * 100 + 0.5) / 100 AS avg_length FROM {t}"""
    return " UNION ALL ".join(one.format(c=c, t=table) for c in columns)


@query(_string_sql("customer", ["c_name", "c_mktsegment"]))
def profile_string_customer(spark, sf_dir):
    """A1, A5, A6."""
    ds = whole(spark, sf_dir, "customer", "c_custkey")
    return frequency.profiles(ds, ["c_name", "c_mktsegment"]).select("column", "total_count", "null_count", "unique_count", "min_length", "max_length", "avg_length")


@query(f"WITH {E} " + _string_sql("e", ["event_type"]))
def profile_string_events(spark, sf_dir):
    """A1, A5 with missing cells."""
    return frequency.profiles(events(spark, sf_dir), ["event_type"]).select("column", "total_count", "null_count", "unique_count", "min_length", "max_length", "avg_length")


@query("""SELECT 'p_brand' AS "column", CAST(rank AS BIGINT) AS rank, value, CAST(n AS BIGINT) AS count, floor(n * 100.0::DOUBLE / total * 100 + 0.5) / 100 AS percent FROM
 (SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank, sum(count(*)) OVER () AS total FROM part GROUP BY 1) WHERE rank <= 10""")
def top_values(spark, sf_dir):
    """A2, O1."""
    return frequency.top_values(frequency.frequency_frame(parts(spark, sf_dir), ["p_brand"]), 10, by_value=True).drop("col_ord")


@query(f"""WITH {E}, f AS (SELECT event_type AS value, count(*) AS n, min(rn) AS fr FROM e WHERE event_type <> '' GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY n DESC, fr) AS BIGINT) AS rank, value, CAST(n AS BIGINT) AS count, floor(n * 100.0::DOUBLE / sum(n) OVER () * 100 + 0.5) / 100 AS percent,
 floor(count(*) OVER () * 1.0::DOUBLE / sum(n) OVER () * 10000 + 0.5) / 10000 AS cardinality FROM f""")
def categorical_distribution(spark, sf_dir):
    """A8."""
    return frequency.categories(frequency.frequency_frame(events(spark, sf_dir), ["event_type"])).drop("col_ord")


@query("""WITH f AS (SELECT p_name AS value, count(*) AS n, min(p_partkey) AS fr FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, fr) AS rank, count(*) OVER () AS k, sum(n) OVER () AS total FROM f)
SELECT CAST(rank AS BIGINT) AS rank, CASE WHEN length(value) > 50 THEN substr(value, 1, 47) || '...' ELSE value END AS value, CAST(n AS BIGINT) AS count, floor(n * 100.0::DOUBLE / total * 100 + 0.5) / 100 AS percent, floor(k * 1.0::DOUBLE / total * 10000 + 0.5) / 10000 AS cardinality FROM r WHERE rank <= 20
UNION ALL SELECT 21, '[' || CAST(any_value(k) - 20 AS VARCHAR) || ' others]', CAST(sum(CASE WHEN rank > 20 THEN n END) AS BIGINT), floor(sum(CASE WHEN rank > 20 THEN n END) * 100.0::DOUBLE / any_value(total) * 100 + 0.5) / 100, floor(any_value(k) * 1.0::DOUBLE / any_value(total) * 10000 + 0.5) / 10000 FROM r HAVING any_value(k) > 20""")
def categorical_others(spark, sf_dir):
    """A8 with its row for all other values."""
    return frequency.categories(frequency.frequency_frame(parts(spark, sf_dir), ["p_name"])).drop("col_ord")


@query("""WITH c AS (SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS u, count(*) AS n FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name), count(*) FROM part UNION ALL SELECT 'p_partkey', count(DISTINCT p_partkey), count(*) FROM part)
SELECT "column", CAST(u AS BIGINT) AS unique_count, CAST(n AS BIGINT) AS total_count, CAST(0 AS BIGINT) AS null_count, floor(u * 1.0::DOUBLE / n * 10000 + 0.5) / 10000 AS cardinality,
 CASE WHEN u * 1.0 / n < 0.01 THEN 'very_low' WHEN u * 1.0 / n < 0.1 THEN 'low' WHEN u * 1.0 / n < 0.5 THEN 'medium' WHEN u * 1.0 / n < 0.95 THEN 'high' ELSE 'unique' END AS cardinality_type FROM c""")
def cardinality(spark, sf_dir):
    """A9."""
    return frequency.cardinality(frequency.frequency_frame(parts(spark, sf_dir), ["p_partkey", "p_name", "p_brand"])).drop("col_ord", "recommendation")


@query(f"""WITH {E}, v AS (SELECT value AS x FROM e WHERE value IS NOT NULL), m AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM v),
b AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS c FROM v, m GROUP BY 1)
SELECT CAST(i AS BIGINT) AS bin, lo + i * ((hi - lo) / 10) AS low, CASE WHEN i = 9 THEN hi ELSE lo + (i + 1) * ((hi - lo) / 10) END AS high, CAST(coalesce(c, 0) AS BIGINT) AS count, floor(coalesce(c, 0) * 100.0::DOUBLE / n * 100 + 0.5) / 100 AS percent
FROM m, range(10) t(i) LEFT JOIN b ON b.bin = i""")
def histogram(spark, sf_dir):
    """A7."""
    return frequency.histogram(events(spark, sf_dir).df, F.col("value"))


@query(f"""WITH {E}, c AS (SELECT event_type AS v, count(*) AS n, max(rn) AS lr FROM e WHERE event_type <> '' GROUP BY 1)
SELECT 'event_type' AS "column", (SELECT v FROM c ORDER BY n DESC, lr LIMIT 1) AS mode""")
def mode_value(spark, sf_dir):
    """The first value to reach the greatest count."""
    return frequency.modes(frequency.frequency_frame(events(spark, sf_dir), ["event_type"])).drop("col_ord")


@query("""WITH f AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderkey', CAST(o_orderkey AS VARCHAR), count(*) FROM orders GROUP BY 2),
a AS (SELECT "column", min(n) AS lo, max(n) AS hi, count(*) AS k, sum(n) AS t FROM f GROUP BY 1)
SELECT "column", CASE WHEN lo = hi AND k > 5 AND t > 50 THEN 'uniform-distribution' ELSE 'concentrated-distribution' END AS type, CASE WHEN lo = hi AND k > 5 AND t > 50 THEN 0.8::DOUBLE ELSE floor(hi * 1.0::DOUBLE / t * 10000 + 0.5) / 10000 END AS confidence
FROM a WHERE (lo = hi AND k > 5 AND t > 50) OR (hi * 1.0 / t > 0.9 AND k > 1)""")
def pattern_frequency(spark, sf_dir):
    """A26."""
    return frequency.frequency_anomalies(frequency.frequency_frame(whole(spark, sf_dir, "orders", "o_orderkey"), ["o_orderkey", "o_orderpriority"]))


@query(f"""WITH {E} SELECT 'event_type' AS "column", 'string' AS detected_type, CAST(count(*) - count(NULLIF(event_type, '')) AS BIGINT) AS null_count, CAST(count(DISTINCT NULLIF(event_type, '')) AS BIGINT) AS unique_count, CAST(count(*) - count(DISTINCT NULLIF(event_type, '')) AS BIGINT) AS duplicates FROM e
UNION ALL SELECT 'value', 'numeric', CAST(count(*) - count(value) AS BIGINT), CAST(count(DISTINCT value) AS BIGINT), CAST(count(*) - count(DISTINCT value) AS BIGINT) FROM e""")
def column_analysis(spark, sf_dir):
    """A30."""
    return frequency.column_analysis(frequency.profiles(events(spark, sf_dir), ["event_type", "value"]))


# --- issues ------------------------------------------------------------------

_SHOWN = ("rowNumber", "column", "value", "issueType", "severity")


def _rules_query(ds: Dataset, rules: list[ColumnRule], check_missing: bool = False) -> DataFrame:
    return issues.cell_issues(ds, rules, check_missing).select(*_SHOWN)


@query("""SELECT * FROM (VALUES ('event_id', 'integer'), ('user_id', 'integer'), ('event_type', 'string'), ('value', 'number'), ('props', 'string')) t("column", type)""")
def infer_types(spark, sf_dir):
    """V2, V3; canonical whole numbers would be boolean only if all were 0 or 1."""
    found = issues.infer_types(events(spark, sf_dir), ["event_id", "user_id", "event_type", "value", "props"])
    return spark.createDataFrame(list(found.items()), "`column` string, type string")


@query(f"""WITH {E} SELECT CAST(rn AS BIGINT) AS "rowNumber", 'event_type' AS "column", CASE WHEN event_type IS NULL THEN 'null' ELSE '' END AS value, 'null' AS "issueType", 'warning' AS severity FROM e WHERE event_type IS NULL OR event_type = ''
UNION ALL SELECT CAST(rn AS BIGINT), 'value', 'null', 'missing', 'error' FROM e WHERE value IS NULL""")
def missing_issues(spark, sf_dir):
    """Null and required cells."""
    return _rules_query(events(spark, sf_dir), [ColumnRule("event_type", "any"), ColumnRule("value", "number", required=True)], True)


def _mismatch(kind: str, table: str, key: str, column: str, sql_value: str, sql_bad: str, make: Callable[[], object]):
    def run(spark, sf_dir):
        df = _t(spark, sf_dir, table).select((F.col(key) + 1).cast("long").alias(ROW), make().alias(column))
        return _rules_query(Dataset(df, [column]), [ColumnRule(column, kind)])

    run.__name__ = f"type_mismatch_{kind}"
    run.__doc__ = f"P6, P8: cells that are no {kind}."
    sql = f"""WITH v AS (SELECT {key} + 1 AS rn, {sql_value} AS x FROM {table}) SELECT CAST(rn AS BIGINT) AS "rowNumber", '{column}' AS "column", substr(x, 1, 100) AS value, 'type-mismatch' AS "issueType", 'error' AS severity FROM v WHERE x <> '' AND ({sql_bad})"""
    query(sql)(run)


_mismatch("number", "events", "event_id", "v", "CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(value AS VARCHAR) END", "event_id_bad", lambda: F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")))
SQL["type_mismatch_number"] = """SELECT CAST(event_id + 1 AS BIGINT) AS "rowNumber", 'v' AS "column", event_type AS value, 'type-mismatch' AS "issueType", 'error' AS severity FROM events WHERE event_id % 5 = 0"""
_mismatch("integer", "events", "event_id", "v", "CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE CAST(event_id AS VARCHAR) || '.5' END", "contains(x, '.')", lambda: F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5"))))
_mismatch("email", "customer", "c_custkey", "v", "CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE lower(replace(c_name, '#', '.')) || '@example.com' END", r"NOT regexp_full_match(x, '[^\s@]+@[^\s@]+\.[^\s@]+')", lambda: F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))))
_mismatch("phone", "customer", "c_custkey", "v", "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '+1 (555) 010-' || CAST(1000 + c_custkey AS VARCHAR) END", r"NOT regexp_full_match(x, '\+?[0-9\s\-()]{7,}')", lambda: F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit("+1 (555) 010-"), (F.col("c_custkey") + 1000).cast("string"))))
_mismatch("url", "pages", "page_id", "v", "CASE WHEN page_id % 4 = 0 THEN substr(url, 9) ELSE url END", "page_bad", lambda: F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url")))
SQL["type_mismatch_url"] = r"""SELECT CAST(page_id + 1 AS BIGINT) AS "rowNumber", 'v' AS "column", substr(regexp_replace(url, '^https?://', ''), 1, 100) AS value, 'type-mismatch' AS "issueType", 'error' AS severity FROM pages WHERE page_id % 4 = 0"""
_mismatch("boolean", "events", "event_id", "v", "CASE event_id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN '1' ELSE 'maybe' END", "lower(x) NOT IN ('true', 'false', '0', '1', 'yes', 'no')", lambda: F.element_at(F.array(F.lit("TRUE"), F.lit("no"), F.lit("1"), F.lit("maybe")), (F.col("event_id") % 4 + 1).cast("int")))
_mismatch("uuid", "events", "event_id", "v", "'0000000' || CAST(event_id % 20 AS VARCHAR) || '-1234-1234-1234-123456789abc'", "NOT regexp_full_match(x, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')", lambda: F.concat(F.lit("0000000"), (F.col("event_id") % 20).cast("string"), F.lit("-1234-1234-1234-123456789abc")))
_mismatch("ip", "events", "event_id", "v", "'10.0.' || CAST(event_id % 300 AS VARCHAR) || '.1'", "CAST(split_part(x, '.', 3) AS INT) > 255", lambda: F.concat(F.lit("10.0."), (F.col("event_id") % 300).cast("string"), F.lit(".1")))
_mismatch("json", "events", "event_id", "v", "CASE WHEN event_id % 6 = 0 THEN substr(props, 2) ELSE props END", "NOT json_valid(x)", lambda: F.when(F.col("event_id") % 6 == 0, F.expr("substring(props, 2)")).otherwise(F.col("props")))
_mismatch("date", "events", "event_id", "v", "CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%m/%d/%Y') ELSE 'day ' || CAST(event_id AS VARCHAR) END", "starts_with(x, 'day')", lambda: F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.concat(F.lit("day "), F.col("event_id").cast("string"))))


@query(f"""SELECT CAST(o_orderkey + 1 AS BIGINT) AS "rowNumber", 'o_totalprice' AS "column", {js("o_totalprice")} AS value, CASE WHEN o_totalprice < 20000 THEN 'range-min-violation' ELSE 'range-max-violation' END AS "issueType", 'error' AS severity FROM orders WHERE o_totalprice < 20000 OR o_totalprice > 400000""")
def range_violations(spark, sf_dir):
    """P9."""
    return _rules_query(whole(spark, sf_dir, "orders", "o_orderkey"), [ColumnRule("o_totalprice", "number", min=20000, max=400000)])


@query("""SELECT CAST(p_partkey + 1 AS BIGINT) AS "rowNumber", 'p_name' AS "column", p_name AS value, CASE WHEN length(p_name) < 10 THEN 'length-min-violation' ELSE 'length-max-violation' END AS "issueType", 'error' AS severity FROM part WHERE length(p_name) < 10 OR length(p_name) > 13""")
def length_violations(spark, sf_dir):
    """P10."""
    return _rules_query(parts(spark, sf_dir), [ColumnRule("p_name", "string", min_length=10, max_length=13)])


@query("""SELECT CAST(p_partkey + 1 AS BIGINT) AS "rowNumber", 'p_brand' AS "column", p_brand AS value, 'pattern-violation' AS "issueType", 'error' AS severity FROM part WHERE NOT regexp_matches(p_brand, '[1-3]$')""")
def pattern_violations(spark, sf_dir):
    """A search; an invalid pattern is ignored."""
    return _rules_query(parts(spark, sf_dir), [ColumnRule("p_brand", "string", pattern="[1-3]$"), ColumnRule("p_name", "string", pattern="[invalid(")])


@query("""SELECT CAST(o_orderkey + 1 AS BIGINT) AS "rowNumber", 'o_orderpriority' AS "column", o_orderpriority AS value, 'enum-violation' AS "issueType", 'error' AS severity FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')""")
def enum_violations(spark, sf_dir):
    """P12."""
    return _rules_query(whole(spark, sf_dir, "orders", "o_orderkey"), [ColumnRule("o_orderpriority", "string", allowed=("1-URGENT", "2-HIGH", "5-LOW"))])


@query("""SELECT CAST(o_orderkey + 1 AS BIGINT) AS "rowNumber", 'o_totalprice' AS "column", 'custom-even' AS "issueType" FROM orders WHERE CAST(floor(o_totalprice) AS BIGINT) % 2 <> 0""")
def custom_violations(spark, sf_dir):
    """2.10: a rule given as a column expression."""
    rule = ColumnRule("o_totalprice", "any", custom=(("even", lambda c: F.floor(c) % 2 == 0),))
    return _rules_query(whole(spark, sf_dir, "orders", "o_orderkey"), [rule]).select("rowNumber", "column", "issueType")


@query(f"""WITH {E}, i AS (SELECT rn, 'event_type' AS c, 2 AS o, 'null' AS t FROM e WHERE event_type IS NULL OR event_type = '' UNION ALL SELECT rn, 'value', 3, 'null' FROM e WHERE value IS NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rn, o) AS r FROM i) SELECT CAST(rn AS BIGINT) AS "rowNumber", c AS "column", t AS "issueType" FROM k WHERE r <= 100""")
def issue_cap(spark, sf_dir):
    """The first 100 issues of a type in row and column order."""
    found = issues.cell_issues(events(spark, sf_dir), [ColumnRule("event_type", "any"), ColumnRule("value", "any")], True)
    return issues.capped(found, 100).select("rowNumber", "column", "issueType")


@query(f"""WITH {E} SELECT 'missing' AS "issueType", CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS count FROM e UNION ALL SELECT 'null', CAST(sum(CASE WHEN event_type IS NULL OR event_type = '' THEN 1 ELSE 0 END) AS BIGINT) FROM e""")
def issue_counts(spark, sf_dir):
    """A24."""
    return issues.counts_by_type(issues.cell_issues(events(spark, sf_dir), [ColumnRule("event_type", "any"), ColumnRule("value", "any", required=True)], True))


_PART_KEY = "p_name || '|' || p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR)"
_PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]


@query(f"""WITH {P}, k AS (SELECT rn, {_PART_KEY} AS s, min(rn) OVER (PARTITION BY {_PART_KEY}) AS f FROM p) SELECT CAST(rn AS BIGINT) AS "rowNumber", 'p_name, p_brand, p_type, p_size' AS "column", substr(s, 1, 100) AS value, 'duplicate' AS "issueType", 'Exact duplicate of row ' || CAST(f AS VARCHAR) AS message FROM k WHERE rn > f""")
def exact_duplicates(spark, sf_dir):
    """W3, V6, J4, F4."""
    return issues.duplicate_issues(parts(spark, sf_dir), _PART_COLUMNS).select("rowNumber", "column", "value", "issueType", "message")


@query("""SELECT text AS signature, CAST(count(*) AS BIGINT) AS count, CAST(min(doc_id) + 1 AS BIGINT) AS first_row, CAST(max(doc_id) + 1 AS BIGINT) AS last_row FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_groups(spark, sf_dir):
    """U3."""
    return remediation.duplicate_groups(whole(spark, sf_dir, "documents", "doc_id"), ["text"])


@query(f"""WITH {P}, k AS (SELECT rn, {_PART_KEY} AS s, min(rn) OVER (PARTITION BY {_PART_KEY}) AS f, count(*) OVER (PARTITION BY {_PART_KEY}) AS n FROM p) SELECT s AS signature, CAST(f AS BIGINT) AS first_row, CAST(rn AS BIGINT) AS _row FROM k WHERE n > 1""")
def duplicate_members(spark, sf_dir):
    """U3, A25."""
    return remediation.group_members(parts(spark, sf_dir), _PART_COLUMNS)


@query("""WITH s AS (SELECT p_partkey + 1 AS r, p_name || '|' || p_brand AS s FROM part WHERE p_partkey < 1000)
SELECT CAST(a.r AS BIGINT) AS r1, CAST(b.r AS BIGINT) AS r2, floor((1 - levenshtein(a.s, b.s) * 1.0::DOUBLE / greatest(length(a.s), length(b.s))) * 10000 + 0.5) / 10000 AS similarity FROM s a JOIN s b ON a.r < b.r AND a.s <> b.s
WHERE 1 - levenshtein(a.s, b.s) * 1.0::DOUBLE / greatest(length(a.s), length(b.s)) >= 0.9""")
def fuzzy_duplicates(spark, sf_dir):
    """Similar pairs of the first 1000 rows."""
    pairs = issues.fuzzy_pairs(parts(spark, sf_dir), ["p_name", "p_brand"], 0.9, most=10**9)
    return pairs.select("r1", "r2", numbers.rounded(F.col("similarity"), 4).alias("similarity"))


@query("""WITH s AS (SELECT c_name || '|' || c_mktsegment AS s, min(c_custkey + 1) AS r FROM customer GROUP BY 1)
SELECT CAST(a.r AS BIGINT) AS r1, CAST(b.r AS BIGINT) AS r2, floor((1 - levenshtein(a.s, b.s) * 1.0::DOUBLE / greatest(length(a.s), length(b.s))) * 10000 + 0.5) / 10000 AS similarity FROM s a JOIN s b ON a.r < b.r AND abs(length(a.s) - length(b.s)) <= 2
WHERE 1 - levenshtein(a.s, b.s) * 1.0::DOUBLE / greatest(length(a.s), length(b.s)) >= 0.95""")
def fuzzy_duplicates_blocked(spark, sf_dir):
    """J1 beyond 1000 rows: signatures that are equal without one edit, or share rare grams."""
    pairs = issues.blocked_pairs(whole(spark, sf_dir, "customer", "c_custkey"), ["c_name", "c_mktsegment"], 0.95)
    return pairs.select("r1", "r2", numbers.rounded(F.col("similarity"), 4).alias("similarity"))


@query(f"""WITH v AS (SELECT event_id + 1 AS rn, value AS x FROM events), s AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS n FROM v),
q AS (SELECT max(CASE WHEN i = CAST(floor(n * 0.25) AS BIGINT) THEN x END) AS q1, max(CASE WHEN i = CAST(floor(n * 0.75) AS BIGINT) THEN x END) AS q3 FROM s)
SELECT CAST(rn AS BIGINT) AS "rowNumber", 'value' AS "column", {js("x")} AS value, 'outlier' AS "issueType" FROM v, q WHERE x < q1 - (q3 - q1) * 1.5 OR x > q3 + (q3 - q1) * 1.5""")
def outliers_iqr(spark, sf_dir):
    """V4, F17, P5."""
    return issues.outlier_issues(whole(spark, sf_dir, "events", "event_id", ["value"]), ["value"]).select("rowNumber", "column", "value", "issueType")


@query(f"""WITH v AS (SELECT event_id + 1 AS rn, value AS x FROM events), m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM v)
SELECT CAST(rn AS BIGINT) AS "rowNumber", 'value' AS "column", {js("x")} AS value, 'outlier' AS "issueType" FROM v, m WHERE abs(x - mu) / sd > 3""")
def outliers_zscore(spark, sf_dir):
    """V5."""
    return issues.outlier_issues(whole(spark, sf_dir, "events", "event_id", ["value"]), ["value"], "zscore").select("rowNumber", "column", "value", "issueType")


@query("""WITH k AS (SELECT p_partkey + 1 AS rn, p_name AS s, min(p_partkey + 1) OVER (PARTITION BY p_name) AS f FROM part) SELECT CAST(rn AS BIGINT) AS "rowNumber", 'p_name' AS "column", substr(s, 1, 50) AS value, 'unique-violation' AS "issueType", 'Duplicate value in unique column. First occurrence at row ' || CAST(f AS VARCHAR) AS message FROM k WHERE rn > f""")
def unique_violations(spark, sf_dir):
    """W4, V8."""
    return issues.unique_issues(parts(spark, sf_dir), ["p_name"]).select("rowNumber", "column", "value", "issueType", "message")


# --- statistics --------------------------------------------------------------

_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(where: str = "") -> str:
    rows = [f"SELECT '{a}' AS column_a, '{b}' AS column_b, CAST(count(*) AS BIGINT) AS n, floor(coalesce(corr({a}, {b}), 0) * 10000 + 0.5) / 10000 AS correlation FROM lineitem" for i, a in enumerate(_LI) for b in _LI[i + 1 :]]
    return " UNION ALL ".join(rows)


def _lineitem(spark, sf_dir) -> Dataset:
    return Dataset(_t(spark, sf_dir, "lineitem").select(*_LI).withColumn("l_gross", F.col("l_extendedprice") * (1 + F.col("l_tax"))).withColumn(ROW, F.lit(1).cast("long")), [*_LI, "l_gross"])


@query(_corr_sql())
def correlation_matrix(spark, sf_dir):
    """All pairs in one aggregate."""
    return statistics.correlations(_lineitem(spark, sf_dir), _LI)


@query("""SELECT 'l_extendedprice' AS column_a, 'l_gross' AS column_b, floor(corr(l_extendedprice, l_extendedprice * (1 + l_tax)) * 10000 + 0.5) / 10000 AS correlation, 'perfect' AS strength, 'positive' AS direction FROM lineitem""")
def correlation_classes(spark, sf_dir):
    """A12."""
    return statistics.correlation_classes(statistics.correlations(_lineitem(spark, sf_dir), ["l_discount", "l_extendedprice", "l_gross"])).drop("n")


def _benford_sql(table: str, column: str) -> str:
    return f"""WITH d AS (SELECT CAST(substr(regexp_replace({js(column)}, '[^0-9]', '', 'g'), 1, 1) AS INT) AS digit FROM {table} WHERE {column} > 0), c AS (SELECT digit, count(*) AS n FROM d WHERE digit BETWEEN 1 AND 9 GROUP BY 1),
x AS (SELECT i AS digit, coalesce(n, 0) AS n, floor(log10(1 + 1.0::DOUBLE / i) * 1000 + 0.5) / 1000 AS e, sum(coalesce(n, 0)) OVER () AS t FROM range(1, 10) r(i) LEFT JOIN c ON c.digit = i),
s AS (SELECT any_value(t) AS t, sum(pow(n * 1.0::DOUBLE / t - e, 2) / e) * any_value(t) AS chi, sum(abs(n * 1.0::DOUBLE / t - e)) / 2 * 100 AS dev FROM x)
SELECT '{column}' AS "column", CAST(t AS BIGINT) AS sample_size, floor(chi * 100 + 0.5) / 100 AS chi_squared, chi < 15.51 AS is_compliant, floor(dev * 100 + 0.5) / 100 AS deviation_percent,
 CASE WHEN chi >= 15.51 AND dev > 30 THEN 'high' WHEN chi >= 15.51 AND dev > 15 THEN 'medium' END AS violation FROM s WHERE t >= 100"""


@query(_benford_sql("orders", "o_totalprice"))
def benford_orders(spark, sf_dir):
    """A13."""
    return statistics.benford(whole(spark, sf_dir, "orders", "o_orderkey"), "o_totalprice")


@query(_benford_sql("events", "value"))
def benford_events(spark, sf_dir):
    """A13."""
    return statistics.benford(whole(spark, sf_dir, "events", "event_id"), "value")


@query("""SELECT 'v' AS "column", 2 AS size, CAST(floor((count(*) - 3) / 4) AS BIGINT) AS repeats, 0.95::DOUBLE AS confidence FROM events""")
def pattern_repeating(spark, sf_dir):
    """W7 on a column that repeats every four rows, of which every other pair begins
    like the first."""
    df = _t(spark, sf_dir, "events").select((F.col("event_id") + 1).alias(ROW), F.element_at(F.array(*[F.lit(x) for x in "abca"]), (F.col("event_id") % 4 + 1).cast("int")).alias("v"))
    return statistics.repeating(Dataset(df, ["v"]), "v")


@query("""WITH v AS (SELECT event_id AS i, value + CASE WHEN event_id >= 5000 THEN 1000000 ELSE 0 END AS x, count(*) OVER () AS n FROM events), w AS (SELECT greatest(5, any_value(n) // 10) AS w, any_value(n) AS n FROM v),
s AS (SELECT i, sum(x) OVER (ORDER BY i) AS c FROM v), m AS (SELECT a.i - w.w + 1 AS i, (a.c - coalesce(b.c, 0)) / w.w AS mean FROM s a CROSS JOIN w LEFT JOIN s b ON b.i = a.i - w.w WHERE a.i >= w.w - 1),
j AS (SELECT CAST(a.i + w.w AS BIGINT) AS position, abs(a.mean - b.mean) / ((abs(a.mean) + abs(b.mean)) / 2) * 100 AS c FROM m a JOIN m b ON b.i = a.i - 1 CROSS JOIN w)
SELECT position, floor(c * 10 + 0.5) / 10 AS change_percent FROM j WHERE c > 50 AND (SELECT count(*) FROM j WHERE c > 50) <= 5""")
def pattern_shift(spark, sf_dir):
    """W5 on a column that jumps in the middle."""
    df = _t(spark, sf_dir, "events").select((F.col("event_id") + 1).alias(ROW), (F.col("value") + F.when(F.col("event_id") >= 5000, 1000000).otherwise(0)).alias("v"))
    return statistics.shifts(Dataset(df, ["v"]), "v")


@query("""WITH v AS (SELECT event_id AS i, epoch_ms(ts) AS x, lag(epoch_ms(ts)) OVER (ORDER BY event_id) AS p FROM events) SELECT 'v' AS "column", CAST(count(*) AS BIGINT) AS n, floor(sum(CASE WHEN x > p THEN 1 ELSE 0 END) * 1.0::DOUBLE / (count(*) - 1) * 10000 + 0.5) / 10000 AS increasing_ratio,
 floor(sum(CASE WHEN x < p THEN 1 ELSE 0 END) * 1.0::DOUBLE / (count(*) - 1) * 10000 + 0.5) / 10000 AS decreasing_ratio, CASE WHEN sum(CASE WHEN x > p THEN 1 ELSE 0 END) * 1.0 / (count(*) - 1) > 0.9 THEN 'increasing' END AS direction FROM v""")
def pattern_monotonic(spark, sf_dir):
    """W6."""
    df = _t(spark, sf_dir, "events").select((F.col("event_id") + 1).alias(ROW), F.unix_millis(F.col("ts").cast("timestamp")).alias("v"))
    return statistics.monotonic(Dataset(df, ["v"]), "v")


def _season_sql(table: str, date: str, value: str, of: str, size: int, spine: str = "LEFT JOIN") -> str:
    return f"""WITH v AS (SELECT CAST({of.format(c=date)} AS INT) AS bucket, {value} AS v FROM {table}), a AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM v),
b AS (SELECT bucket, count(*) AS n, avg(v) AS m, stddev_pop(v) AS s, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1)
SELECT CAST(i AS INT) AS bucket, CAST(coalesce(n, 0) AS BIGINT) AS count, coalesce({r4("m")}, 0) AS mean, coalesce({r4("s")}, 0) AS std_dev, coalesce(lo, 0) AS min, coalesce(hi, 0) AS max,
 CASE WHEN n > 0 THEN {r4("(m - mu) / mu * 100", 2)} ELSE 0 END AS deviation_percent, coalesce(n >= 3 AND abs(m - mu) / sd > 2, false) AS is_anomaly FROM range({size}) r(i) {spine} b ON b.bucket = i CROSS JOIN a"""


@query(_season_sql("orders", "o_orderdate", "o_totalprice", "dayofweek({c})", 7))
def seasonal_day_of_week(spark, sf_dir):
    """A14, A15, F14."""
    return statistics.seasonal(whole(spark, sf_dir, "orders", "o_orderkey"), "o_orderdate", "o_totalprice", "day_of_week")


@query(_season_sql("orders", "o_orderdate", "o_totalprice", "month({c}) - 1", 12))
def seasonal_month(spark, sf_dir):
    """A16."""
    return statistics.seasonal(whole(spark, sf_dir, "orders", "o_orderkey"), "o_orderdate", "o_totalprice", "month")


@query(_season_sql("events", "ts", "value", "hour({c})", 24, "JOIN"))
def seasonal_hour(spark, sf_dir):
    """A17."""
    return statistics.seasonal(whole(spark, sf_dir, "events", "event_id"), "ts", "value", "hour")


@query("""WITH v AS (SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS DOUBLE) AS x, o_totalprice AS y FROM orders), a AS (SELECT count(*) AS n, avg(y) AS mean, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, arg_min(y, x) AS s, arg_max(y, x) AS e FROM v)
SELECT abs(slope * n / mean * 100) >= 5 AND r2 > 0.3 AS has_trend, CASE WHEN abs(slope * n / mean * 100) < 5 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction, floor(slope * 1e6 + 0.5) / 1e6 AS slope, floor(r2 * 1e4 + 0.5) / 1e4 AS r_squared,
 floor(slope * n / mean * 100 * 100 + 0.5) / 100 AS percent_change, s AS start_value, e AS end_value, CAST(n AS BIGINT) AS data_points FROM a""")
def trend(spark, sf_dir):
    """A18, O3."""
    return statistics.trend(whole(spark, sf_dir, "orders", "o_orderkey"), "o_orderdate", "o_totalprice")


@query("""SELECT 'o_orderdate' AS "column" """)
def date_columns(spark, sf_dir):
    """A20."""
    return spark.createDataFrame([(c,) for c in statistics.date_columns(whole(spark, sf_dir, "orders", "o_orderkey"))], "`column` string")


# --- personal data -----------------------------------------------------------


@query("""WITH v AS (SELECT c_custkey + 1 AS rn, CASE c_custkey % 5 WHEN 0 THEN 'user' || CAST(c_custkey AS VARCHAR) || '@mail.example.org' WHEN 1 THEN '555-010-' || CAST(1000 + c_custkey AS VARCHAR) WHEN 2 THEN '123-45-' || CAST(1000 + c_custkey % 9000 AS VARCHAR) WHEN 3 THEN '411111111111' || CAST(1000 + c_custkey % 9000 AS VARCHAR) ELSE c_name END AS x, c_custkey % 5 AS k FROM customer)
SELECT CAST(rn AS BIGINT) AS "rowNumber", 'contact' AS "column", 'email' AS "piiType", 'high' AS risk, 'u***@mail.example.org' AS "maskedValue" FROM v WHERE k = 0
UNION ALL SELECT CAST(rn AS BIGINT), 'contact', 'phone', 'medium', substr(x, 1, 3) || '***' || right(x, 2) FROM v WHERE k IN (1, 2, 3) 
UNION ALL SELECT CAST(rn AS BIGINT), 'contact', 'ssn', 'critical', '***-**-' || right(x, 4) FROM v WHERE k = 2
UNION ALL SELECT CAST(rn AS BIGINT), 'contact', 'creditCard', 'critical', '****-****-****-' || right(x, 4) FROM v WHERE k = 3""")
def pii_cells(spark, sf_dir):
    """I1-I3, F6; a number can be of several kinds."""
    k = F.col("c_custkey")
    x = (
        F.when(k % 5 == 0, F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.example.org"))).when(k % 5 == 1, F.concat(F.lit("555-010-"), (k + 1000).cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("123-45-"), (k % 9000 + 1000).cast("string"))).when(k % 5 == 3, F.concat(F.lit("411111111111"), (k % 9000 + 1000).cast("string"))).otherwise(F.col("c_name"))
    )
    df = _t(spark, sf_dir, "customer").select((k + 1).alias(ROW), x.alias("contact"))
    return remediation.personal_cells(Dataset(df, ["contact"])).select("rowNumber", "column", "piiType", "risk", "maskedValue")


_EMBEDDED_SQL = " UNION ALL ".join(
    f"SELECT CAST(doc_id + 1 AS BIGINT) AS \"rowNumber\", '{k}' AS \"piiType\", unnest(regexp_extract_all(text, '{personal.EMBEDDED[k]}')) AS v FROM documents" for k in ("email", "ssn", "creditCard", "ipAddress")
)


@query(f"""WITH f AS ({_EMBEDDED_SQL}) SELECT "rowNumber", "piiType", CASE "piiType" WHEN 'email' THEN substr(v, 1, 1) || '***@' || split_part(v, '@', 2) WHEN 'ssn' THEN '***-**-' || right(v, 4) WHEN 'creditCard' THEN '****-****-****-' || right(v, 4) ELSE split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.xxx.xxx' END AS "maskedValue" FROM f""")
def pii_embedded(spark, sf_dir):
    """I1 inside documents."""
    return remediation.personal_embedded(whole(spark, sf_dir, "documents", "doc_id"), "text", ("email", "ssn", "creditCard", "ipAddress"))


@query(f"""WITH f AS ({_EMBEDDED_SQL}) SELECT "piiType", CAST(count(*) AS BIGINT) AS count FROM f GROUP BY 1""")
def pii_summary(spark, sf_dir):
    """A27."""
    return remediation.personal_embedded(whole(spark, sf_dir, "documents", "doc_id"), "text", ("email", "ssn", "creditCard", "ipAddress")).groupBy("piiType").agg(F.count("*").alias("count"))


# --- missing values and cleaning ---------------------------------------------


@query(f"""WITH {E}, c AS (SELECT 'event_type' AS "column", sum(CASE WHEN event_type IS NULL OR trim(event_type) = '' THEN 1 ELSE 0 END) AS m, count(*) AS n FROM e UNION ALL SELECT 'value', sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END), count(*) FROM e UNION ALL SELECT 'user_id', 0, count(*) FROM e)
SELECT "column", CAST(m AS BIGINT) AS missing_count, floor(m * 100.0::DOUBLE / n * 100 + 0.5) / 100 AS missing_percent FROM c""")
def missing_analysis(spark, sf_dir):
    """A21."""
    ds = events(spark, sf_dir)
    return remediation.missing_analysis(Dataset(ds.df, ["event_type", "value", "user_id"]))


@query(f"""WITH {E} SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END + CASE WHEN coalesce(event_type, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing_cells, CAST(sum(CASE WHEN value IS NULL OR coalesce(event_type, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS rows_with_missing FROM e""")
def missing_summary(spark, sf_dir):
    """A21."""
    ds = events(spark, sf_dir)
    return remediation.missing_summary(Dataset(ds.df, ["event_type", "value"]))


@query(f"""WITH {E} SELECT * FROM (SELECT 'event_type' AS "column", CAST(sum(CASE WHEN coalesce(event_type, '') = '' THEN 1 ELSE 0 END) AS BIGINT) AS missing_count FROM e UNION ALL SELECT 'value', CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM e)""")
def most_missing(spark, sf_dir):
    """O7."""
    return remediation.most_missing(events(spark, sf_dir)).drop("missing_percent")


def _imputed(name: str, strategy: str, sql_value: str, constant: object = None, column: str = "value") -> None:
    def run(spark, sf_dir):
        ds, _ = remediation.impute(events(spark, sf_dir), strategy, [column], constant)
        out = F.col(column) if column != "value" else numbers.rounded(F.col("value"), 6).alias("value")
        return ds.df.select((F.col(ROW)).alias("row"), out)

    run.__name__, run.__doc__ = f"impute_{name}", f"M2: {strategy}."
    query(f"WITH {E} SELECT CAST(rn AS BIGINT) AS row, {sql_value} AS {column} FROM e")(run)


_six = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
_imputed("mean", "mean", _six("coalesce(value, (SELECT avg(value) FROM e))"))
_imputed("median", "median", _six("coalesce(value, (SELECT median(value) FROM e))"))
_imputed("auto", "auto", _six("coalesce(value, (SELECT median(value) FROM e))"))
_imputed("constant", "constant", _six("coalesce(value, -1)"), -1.0)
_imputed("forward_fill", "forwardFill", _six("coalesce(value, last_value(value IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"))
_imputed("backward_fill", "backwardFill", _six("coalesce(value, first_value(value IGNORE NULLS) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"))
_imputed("mode", "mode", "CASE WHEN coalesce(event_type, '') = '' THEN (SELECT event_type FROM e WHERE event_type <> '' GROUP BY 1 ORDER BY count(*) DESC, max(rn) LIMIT 1) ELSE event_type END", column="event_type")


@query(f"""WITH {E} SELECT CAST(rn AS BIGINT) AS row, value FROM e WHERE value IS NOT NULL AND coalesce(event_type, '') <> ''""")
def impute_remove(spark, sf_dir):
    """Rows with a blank cell go."""
    ds, _ = remediation.impute(events(spark, sf_dir), "remove", ["value", "event_type"])
    return ds.df.select(F.col(ROW).alias("row"), "value")


@query("""SELECT CAST(p_partkey + 1 AS BIGINT) AS row, upper(trim('  ' || p_name || ' ')) AS p_name FROM part""")
def clean_text(spark, sf_dir):
    """M1, F1, F2."""
    df = _t(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias(ROW), F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("p_name"))
    return remediation.clean(Dataset(df, ["p_name"]), ["trim", "lowercase", "uppercase", "nothing"]).df.select(F.col(ROW).alias("row"), "p_name")


@query(f"""WITH {E} SELECT CAST(rn AS BIGINT) AS row FROM e WHERE NOT (value IS NULL AND coalesce(event_type, '') = '')""")
def clean_remove_empty(spark, sf_dir):
    """P14."""
    ds = events(spark, sf_dir)
    return remediation.clean(Dataset(ds.df, ["event_type", "value"]), ["removeEmpty"]).df.select(F.col(ROW).alias("row"))


@query(f"""WITH {P} SELECT CAST(min(rn) AS BIGINT) AS row FROM p GROUP BY {_PART_KEY}""")
def clean_dedup(spark, sf_dir):
    """U2."""
    ds = parts(spark, sf_dir)
    return remediation.clean(Dataset(ds.df, _PART_COLUMNS), ["removeDuplicates"]).df.select(F.col(ROW).alias("row"))


def _strategy(name: str, strategy: str, sql: str) -> None:
    def run(spark, sf_dir):
        out, _ = remediation.handle_duplicates(parts(spark, sf_dir), strategy, ["p_name"])
        more = ["_isDuplicate", "_duplicateOf"] if strategy == "flag" else []
        return out.select(F.col(ROW).alias("row"), "p_name", *more)

    run.__name__, run.__doc__ = f"dup_{name}", f"U4, M6: {strategy}."
    query(sql)(run)


_strategy("keep_first", "keepFirst", "SELECT CAST(min(p_partkey + 1) AS BIGINT) AS row, p_name FROM part GROUP BY p_name")
_strategy("keep_last", "keepLast", "SELECT CAST(max(p_partkey + 1) AS BIGINT) AS row, p_name FROM part GROUP BY p_name")
_strategy("remove_all", "removeAll", "SELECT CAST(min(p_partkey + 1) AS BIGINT) AS row, p_name FROM part GROUP BY p_name HAVING count(*) = 1")
_strategy("flag", "flag", """WITH k AS (SELECT p_partkey + 1 AS rn, p_name, min(p_partkey + 1) OVER (PARTITION BY p_name) AS f FROM part) SELECT CAST(rn AS BIGINT) AS row, p_name, rn > f AS "_isDuplicate", CASE WHEN rn > f THEN CAST(f AS BIGINT) END AS "_duplicateOf" FROM k""")


@query(f"""WITH {E} SELECT CAST(min(rn) AS BIGINT) AS row, user_id, arg_min(event_type, rn) FILTER (WHERE event_type <> '') AS event_type, arg_min(value, rn) FILTER (WHERE value IS NOT NULL) AS value FROM e GROUP BY user_id""")
def dup_merge(spark, sf_dir):
    """One row per key, each cell the first that isn't missing."""
    ds = events(spark, sf_dir)
    return remediation.merge(Dataset(ds.df, ["user_id", "event_type", "value"]), ["user_id"]).df.withColumnRenamed(ROW, "row")


# --- scores and history ------------------------------------------------------


@query(f"""WITH {E}, n AS (SELECT count(*) AS r, count(*) - count(value) + count(*) - count(NULLIF(event_type, '')) AS nulls FROM e),
s AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS k FROM e WHERE value IS NOT NULL), q AS (SELECT max(CASE WHEN i = CAST(floor(k * 0.25) AS BIGINT) THEN x END) AS q1, max(CASE WHEN i = CAST(floor(k * 0.75) AS BIGINT) THEN x END) AS q3 FROM s),
o AS (SELECT sum(CASE WHEN x < q1 - (q3 - q1) * 1.5 OR x > q3 + (q3 - q1) * 1.5 THEN 1 ELSE 0 END) AS outliers FROM s, q), d AS (SELECT count(*) - count(DISTINCT coalesce(event_type, '') || '|' || coalesce({js("value")}, '')) AS dups FROM e),
p AS (SELECT (1 - nulls * 1.0::DOUBLE / (r * 2)) * 100 AS c, (1 - dups * 1.0::DOUBLE / r) * 100 AS u, (100 + 100 - least(outliers * 1.0::DOUBLE / r * 100, 30)) / 2 AS k FROM n, o, d), t AS (SELECT *, c * 0.3 + 100.0::DOUBLE * 0.35 + u * 0.15 + k * 0.2 AS total FROM p)
SELECT greatest(0, least(100, floor(total + 0.5))) AS overall, floor(c + 0.5) AS completeness, 100.0::DOUBLE AS validity, floor(u + 0.5) AS uniqueness, floor(k + 0.5) AS consistency, CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'F' END AS grade FROM t""")
def quality_score(spark, sf_dir):
    """A10, H1: profile, outliers and duplicates to one score."""
    base = events(spark, sf_dir)
    ds = Dataset(base.df, ["event_type", "value"])
    profile = frequency.profiles(ds).agg(F.sum("null_count").alias("nulls"), F.max("total_count").alias("rows"))
    outliers = issues.outlier_issues(ds, ["value"]).agg(F.count("*").alias("outliers"))
    dups = issues.duplicate_issues(ds).agg(F.count("*").alias("dups"))
    one = profile.join(F.broadcast(outliers)).join(F.broadcast(dups))  # one row each
    rows = F.col("rows")
    consistency = (100 + 100 - F.least(F.col("outliers") / rows * 100, F.lit(30.0))) / 2
    return one.select(*quality.score_columns((1 - F.col("nulls") / (rows * 2)) * 100, F.lit(100.0), (1 - F.col("dups") / rows) * 100, consistency))


RUNS = "runs AS (SELECT CAST(ts AS DATE) AS run_ts, floor(avg(value) * 1e4 + 0.5) / 1e4 AS quality_score, CAST(sum(CASE WHEN value > 100 THEN 1 ELSE 0 END) AS DOUBLE) AS total_issues, CAST(count(*) AS DOUBLE) AS total_rows FROM events GROUP BY 1)"


def _runs(spark, sf_dir) -> DataFrame:
    """One run per day of events."""
    e = _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("run_ts"))
    return e.agg(numbers.rounded(F.avg("value"), 4).alias("quality_score"), F.sum((F.col("value") > 100).cast("double")).alias("total_issues"), F.count("*").cast("double").alias("total_rows"))


@query(f"""WITH {RUNS}, m AS (SELECT run_ts, avg(quality_score) OVER w AS a, count(*) OVER w AS n FROM runs WINDOW w AS (ORDER BY run_ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT run_ts, floor(a * 100 + 0.5) / 100 AS moving_average FROM m WHERE n = 3""")
def moving_average(spark, sf_dir):
    """W8."""
    return quality.moving_average(_runs(spark, sf_dir), "quality_score")


@query(f"""WITH {RUNS}, x AS (SELECT quality_score AS y, CAST(row_number() OVER (ORDER BY run_ts) - 1 AS DOUBLE) AS x FROM runs), a AS (SELECT count(*) AS n, regr_slope(y, x) AS s, regr_r2(y, x) AS r, arg_min(y, x) AS f, arg_max(y, x) AS l FROM x)
SELECT CAST(n AS BIGINT) AS n, floor(s * 1e4 + 0.5) / 1e4 AS slope, floor(greatest(0, r) * 100 + 0.5) / 100 AS confidence, floor((l - f) / f * 100 * 100 + 0.5) / 100 AS change_percent, CASE WHEN n < 3 THEN 'insufficient_data' WHEN abs((l - f) / f * 100) < 1 THEN 'stable' WHEN l > f THEN 'increasing' ELSE 'decreasing' END AS direction FROM a""")
def history_trend(spark, sf_dir):
    """W9, H8."""
    return quality.run_trend(_runs(spark, sf_dir), "quality_score")


@query(f"""WITH {RUNS} SELECT floor(avg(quality_score) * 100 + 0.5) / 100 AS mean, floor(stddev_pop(quality_score) * 100 + 0.5) / 100 AS std_dev, floor(median(quality_score) * 100 + 0.5) / 100 AS median, min(quality_score) AS min, max(quality_score) AS max, CAST(count(*) AS BIGINT) AS runs FROM runs""")
def history_stats(spark, sf_dir):
    """A28."""
    return quality.run_stats(_runs(spark, sf_dir), "quality_score")


@query(f"""WITH {RUNS}, s AS (SELECT 'Total Rows' AS metric, 1000000.0::DOUBLE AS current, floor(avg(total_rows) * 100 + 0.5) / 100 AS mean, floor(stddev_pop(total_rows) * 100 + 0.5) / 100 AS sd FROM runs UNION ALL SELECT 'Quality Score', 0.0, floor(avg(quality_score) * 100 + 0.5) / 100, floor(stddev_pop(quality_score) * 100 + 0.5) / 100 FROM runs)
SELECT metric, current, mean AS expected, floor((current - mean) / sd * 100 + 0.5) / 100 AS zscore, CASE WHEN abs((current - mean) / sd) >= 4 THEN 'critical' WHEN abs((current - mean) / sd) >= 3 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN metric = 'Total Rows' THEN 'neutral' ELSE 'negative' END AS impact FROM s WHERE abs((current - mean) / sd) >= 2.5""")
def history_anomalies(spark, sf_dir):
    """H6, H10."""
    runs = _runs(spark, sf_dir)
    now = runs.agg(F.lit(0.0).alias("quality_score"), F.max("total_issues").alias("x"), F.lit(1e6).alias("total_rows")).withColumn("total_issues", F.lit(None).cast("double"))
    return quality.run_anomalies(runs, now).select("metric", "current", "expected", "zscore", "severity", "impact")


@query(f"""WITH {RUNS}, x AS (SELECT quality_score AS y, CAST(row_number() OVER (ORDER BY run_ts) - 1 AS DOUBLE) AS x FROM runs), a AS (SELECT count(*) AS n, floor(avg(y) * 100 + 0.5) / 100 AS m, floor(regr_slope(y, x) * 1e4 + 0.5) / 1e4 AS s FROM x)
SELECT CAST(n AS BIGINT) AS n, floor(greatest(0, least(100, m + s * (n - (n - 1) / 2))) * 10 + 0.5) / 10 AS predicted FROM a WHERE n >= 3""")
def history_prediction(spark, sf_dir):
    """H7."""
    return quality.next_run(_runs(spark, sf_dir))


# --- functions, connectors, streams ------------------------------------------


@query(r"""SELECT event_id, regexp_replace(regexp_replace(lower(event_type || ' #' || CAST(user_id AS VARCHAR) || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, '&lt;' || event_type || '&gt;&amp;' AS escaped,
 'https://***:***@x.example/p?token=***&q=' || CAST(event_id AS VARCHAR) AS masked FROM events""")
def text_functions(spark, sf_dir):
    """F7, F8, F10."""
    c = lambda n: F.col(n).cast("string")
    url = F.concat(F.lit("https://u:p@x.example/p?token=s"), c("user_id"), F.lit("&q="), c("event_id"))
    return _t(spark, sf_dir, "events").select("event_id", text.sanitize(F.concat(F.col("event_type"), F.lit(" #"), c("user_id"), F.lit("!"))).alias("slug"), text.escape_html(F.concat(F.lit("<"), F.col("event_type"), F.lit(">&"))).alias("escaped"), text.mask_url(url).alias("masked"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS DOUBLE) WHEN 1 THEN CAST(event_id AS DOUBLE) + 0.5 WHEN 2 THEN 0.25::DOUBLE END AS parsed, CASE event_id % 4 WHEN 1 THEN CAST(event_id AS DOUBLE) + 0.5 END AS whole FROM events""")
def number_functions(spark, sf_dir):
    """prefix and whole-text parsing."""
    i, n = F.col("event_id"), F.col("event_id").cast("string")
    x = F.when(i % 4 == 0, F.concat(F.lit(" "), n, F.lit("abc"))).when(i % 4 == 1, F.concat(n, F.lit(".5"))).when(i % 4 == 2, F.lit(".25x")).otherwise(F.lit("x1"))
    return _t(spark, sf_dir, "events").select("event_id", numbers.parse_float(x).alias("parsed"), cells.safe_value(x, "number")["value"].alias("whole"))


@query("""SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM events""")
def date_functions(spark, sf_dir):
    """three layouts of one day."""
    i = F.col("event_id") % 3
    x = F.when(i == 0, F.date_format("ts", "yyyy-MM-dd")).when(i == 1, F.date_format("ts", "MM/dd/yyyy")).otherwise(F.date_format("ts", "dd-MM-yyyy"))
    return _t(spark, sf_dir, "events").select("event_id", dates.parse_date(x).alias("day"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events""")
def flatten_json(spark, sf_dir):
    """struct fields as columns."""
    df = _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return connectors.flatten(df)


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS nulls, CAST(sum(CASE WHEN event_id % 7 <> 0 AND (value < 1 OR value > 100) THEN 1 ELSE 0 END) AS BIGINT) AS out_of_range FROM events GROUP BY 1""")
def stream_window_quality(spark, sf_dir):
    """The batch form of the windowed stream."""
    value = F.when(F.col("event_id") % 7 != 0, F.col("value"))
    return streams.window_quality(_t(spark, sf_dir, "events"), "ts", value, 1, 100)


@query("""SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS count FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def stream_duplicate_counts(spark, sf_dir):
    """R3, R6."""
    return streams.duplicate_counts(_t(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("""SELECT CAST(event_id + 1 AS BIGINT) AS row, CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS idx FROM events WHERE event_id % 3 <> 0""")
def row_numbers(spark, sf_dir):
    """Positions after a filter, counted chunk by chunk."""
    ds = whole(spark, sf_dir, "events", "event_id")
    return ordered.reindex(ds.df.where(F.col("event_id") % 3 != 0)).select(F.col(ROW).alias("row"), "idx")


@query("""SELECT CAST(p_partkey + 1 AS BIGINT) AS row, p_brand FROM part WHERE p_partkey < 50""")
def head_and_projection(spark, sf_dir):
    """P1, P2."""
    ds = parts(spark, sf_dir).drop(["p_name", "p_type", "p_size", "p_retailprice", "p_partkey"]).head(50)
    return ds.df.select(F.col(ROW).alias("row"), *ds.headers)


# --- sources -----------------------------------------------------------------

_NATION = ("n_nationkey", "n_name", "n_regionkey")


def _nation(spark, sf_dir) -> list[dict]:
    """The fixed table of 25 nations, as plain rows."""
    return [r.asDict() for r in _t(spark, sf_dir, "nation").select(*_NATION).collect()]


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || ', "x"' AS n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation""")
def source_csv(spark, sf_dir):
    """Quoted separators and quotes; all cells are text."""
    lines = [f'{r["n_nationkey"]};"{r["n_name"]}, ""x""";{r["n_regionkey"]}' for r in _nation(spark, sf_dir)]
    return readers.csv(spark, text="\n".join([";".join(_NATION), *lines, ""]))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation""")
def source_json(spark, sf_dir):
    """An array under ``data``."""
    import json

    return readers.json_rows(spark, text=json.dumps({"data": _nation(spark, sf_dir)}))


@query("""SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation""")
def source_jsonl(spark, sf_dir):
    """JSON lines with some bad ones."""
    import json

    return readers.jsonl(spark, text="\n".join([*map(json.dumps, _nation(spark, sf_dir)), "", "not json"]))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, CAST(n_nationkey + 1 AS BIGINT) AS row FROM nation""")
def source_base64(spark, sf_dir):
    """A whole read from base64 data."""
    import base64

    from ..config import RunConfig

    text_ = "\n".join([",".join(_NATION), *(",".join(str(r[c]) for c in _NATION) for r in sorted(_nation(spark, sf_dir), key=lambda r: r["n_nationkey"]))])
    ds = readers.read(spark, RunConfig(base64=base64.b64encode(text_.encode()).decode()))
    return ds.df.select(*_NATION, F.col(ROW).alias("row"))


@query("""SELECT 'p_name' AS "column", 'string' AS type UNION ALL SELECT 'p_size', 'integer' UNION ALL SELECT 'p_retailprice', 'float'""")
def source_parquet_schema(spark, sf_dir):
    """Logical types of projected columns."""
    info = readers.schema_info(readers.parquet(spark, f"{sf_dir}/part.parquet", ["p_name", "p_size", "p_retailprice"]))
    return spark.createDataFrame([(c, v["type"]) for c, v in info.items()], "`column` string, type string")


@query("""SELECT * FROM (VALUES ('high', 'completeness', 'Address Missing Values'), ('medium', 'uniqueness', 'Review Duplicate Records'), ('medium', 'accuracy', 'Investigate Outliers'), ('low', 'schema', 'Consider Enum Constraints')) t(priority, category, title)""")
def recommendations(spark, sf_dir):
    """Advice about the events."""
    base = events(spark, sf_dir)
    ds = Dataset(base.df, ["event_type", "value"])
    profile = sorted((r.asDict() for r in frequency.profiles(ds).collect()), key=lambda r: r["col_ord"])  # a row per column
    counts = {"duplicates": issues.duplicate_issues(ds).count(), "outliers": issues.outlier_issues(ds, ["value"]).count()}
    nulls = {c["column"]: c["null_count"] for c in profile}
    score = quality.quality_score(profile[0]["total_count"], ds.headers, nulls, 0, 0, counts["duplicates"], {"value": counts["outliers"]}, {"value"}, True)
    found = quality.recommendations(score, profile, counts, False)
    return spark.createDataFrame([(r["priority"], r["category"], r["title"]) for r in found], "priority string, category string, title string")
