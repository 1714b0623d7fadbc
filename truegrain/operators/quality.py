"""Scores, recommendations and run history."""

from __future__ import annotations

import math
import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..functions.text import poly_hash, sanitize_text

WEIGHTS = {"completeness": 0.30, "validity": 0.35, "uniqueness": 0.15, "consistency": 0.20}
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))


def half_up(x: float, digits: int = 0) -> float:
    return math.floor(x * 10**digits + 0.5) / 10**digits


def score_columns(completeness: Column, validity: Column, uniqueness: Column, consistency: Column) -> list[Column]:
    """A10, H1 as columns: parts rounded to whole numbers, the weighted mean
    clamped to 0..100, and the grade."""
    parts = dict(zip(WEIGHTS, (completeness, validity, uniqueness, consistency)))
    total = sum((parts[k] * w for k, w in list(WEIGHTS.items())[1:]), parts["completeness"] * WEIGHTS["completeness"])
    grade = F.lit("F")
    for least, name in reversed(GRADES):
        grade = F.when(total >= least, name).otherwise(grade)
    return [F.greatest(F.lit(0.0), F.least(F.lit(100.0), rounded(total))).alias("overall"), *[rounded(c).alias(k) for k, c in parts.items()], grade.alias("grade")]


def quality_score(rows: int, columns: list[str], null_counts: dict[str, int], type_errors: int, constraint_errors: int, duplicates: int, outliers: dict[str, int], numeric: set[str], has_unique: bool) -> dict:
    """A10, H1 on the driver, from counts."""
    cells = rows * len(columns)
    completeness = (1 - sum(null_counts.get(c, 0) for c in columns) / cells) * 100 if cells else 100.0
    validity = max(0.0, (1 - (type_errors + constraint_errors) / cells) * 100) if cells else 100.0
    uniqueness = max(0.0, (1 - duplicates / rows) * 100) if has_unique and rows else 100.0
    parts = [100 - min(outliers.get(c, 0) / rows * 100, 30) if c in numeric and rows else 100.0 for c in columns]
    consistency = sum(parts) / len(parts) if parts else 100.0
    total = sum(w * v for w, v in zip(WEIGHTS.values(), (completeness, validity, uniqueness, consistency)))
    grade = next((g for least, g in GRADES if total >= least), "F")
    return {
        "overall": max(0, min(100, int(half_up(total)))), "completeness": int(half_up(completeness)), "validity": int(half_up(validity)),
        "uniqueness": int(half_up(uniqueness)), "consistency": int(half_up(consistency)), "grade": grade,
    }


# Priority, category, title, description, action and impact of each piece of advice.
ADVICE = {
    "missing": (
        "high", "completeness", "Address Missing Values", "{n} column(s) have >10% missing values: {names}",
        "Consider implementing data collection improvements or use imputation strategies (mean, median, mode)", "Could improve completeness score from {score}% to ~95%",
    ),
    "types": (
        "high", "validity", "Fix Type Mismatches", "Found {n} type validation errors", "Clean or transform values to match expected column types",
        "Could improve validity score by eliminating {rate:.1f}% of issues",
    ),
    "duplicates": (
        "medium", "uniqueness", "Review Duplicate Records", "Detected {n} duplicate or near-duplicate rows", "Investigate duplicates - merge, remove, or mark as intentional",
        "Removing duplicates could reduce dataset size and improve data quality",
    ),
    "outliers": (
        "medium", "accuracy", "Investigate Outliers", "Found {n} statistical outliers", "Review outliers - they may be errors, edge cases, or valid extreme values",
        "Addressing outliers improves statistical analysis reliability",
    ),
    "enum": (
        "low", "schema", "Consider Enum Constraints", "Columns with low cardinality detected: {names}", "Add allowedValues constraints to enforce valid values",
        "Prevents invalid categorical data from entering the dataset",
    ),
    "pii": (
        "high", "compliance", "Review PII Handling", "PII detection was enabled - check findings for sensitive data", "Mask, encrypt, or remove PII as required by GDPR/CCPA",
        "Ensures regulatory compliance and reduces data breach risk",
    ),
    "sampling": (
        "low", "performance", "Enable Sampling for Large Datasets", "Dataset has {n:,} rows", "Use sampleSize option for faster validation on subsequent runs",
        "Reduces processing time while maintaining statistical validity",
    ),
}
PRIORITIES = ("high", "medium", "low")


def recommendations(score: dict, profile: list[dict], counts: dict[str, int], pii: bool) -> list[dict]:
    """Advice by priority, then description.  ``profile``: rows of
    ``profiles``; ``counts``: typeErrors, duplicates, outliers."""
    empty = [f"{c['column']} ({c['null_percent']:.2f}% null)" for c in profile if c["null_percent"] > 10]
    few = [c["column"] for c in profile if 1 < c["unique_count"] <= 20 and c["unique_count"] < 0.05 * c["total_count"]]
    rows = max((c["total_count"] for c in profile), default=0)
    types = counts.get("typeErrors", 0)
    wanted = {
        "missing": score["completeness"] < 90 and empty and {"n": len(empty), "names": ", ".join(empty[:3]) + "..." * (len(empty) > 3), "score": score["completeness"]},
        "types": types and {"n": types, "rate": half_up(types / max(1, len(profile)) * 100, 1)},
        **{kind: counts.get(kind) and {"n": counts[kind]} for kind in ("duplicates", "outliers")},
        "enum": few and {"names": ", ".join(few[:3])}, "pii": pii and {"n": 0}, "sampling": rows > 100_000 and {"n": rows},
    }
    out = []
    for kind, values in wanted.items():
        if values:
            out.append(dict(zip(("priority", "category", "title", "description", "action", "impact"), (t.format(**values) for t in ADVICE[kind]))))
    return sorted(out, key=lambda r: (PRIORITIES.index(r["priority"]), r["description"].lower(), r["description"]))


# --- history ----------------------------------------------------------------

HISTORY_SCHEMA = "source_id string, run_ts timestamp, quality_score double, total_issues double, total_rows double"
METRICS = (("quality_score", "Quality Score", True), ("total_issues", "Total Issues", False), ("total_rows", "Total Rows", None))
KEPT, Z_LIMIT, LEAST_RUNS = 100, 2.5, 3


def source_id(explicit: str | None = None, url: str | None = None, inline: str | None = None, config: str = "") -> str:
    """H3: from the given name, the URL's host and path, or a hash of the data or
    the configuration."""
    if explicit:
        return sanitize_text(explicit)
    if url:
        p = urlsplit(url)
        return sanitize_text(f"{p.netloc}{p.path}")
    return f"inline_{poly_hash(inline[:1000])}" if inline else f"config_{poly_hash(config)}"


def store_run(spark: SparkSession, path: str, run: dict) -> None:
    """H4, H5: append a run."""
    spark.createDataFrame([run], HISTORY_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load_runs(spark: SparkSession, path: str, source: str, limit: int = KEPT) -> DataFrame:
    """The last ``limit`` runs of a source."""
    try:
        runs = spark.read.schema(HISTORY_SCHEMA).parquet(path)
    except Exception:  # no run has been stored yet
        runs = spark.createDataFrame([], HISTORY_SCHEMA)
    return runs.where(F.col("source_id") == source).orderBy(F.desc("run_ts")).limit(limit)


def run_stats(runs: DataFrame, metric: str) -> DataFrame:
    """Mean, population deviation and median (2 digits), least, most."""
    return runs.agg(rounded(F.avg(metric), 2).alias("mean"), rounded(F.stddev_pop(metric), 2).alias("std_dev"), rounded(F.median(metric), 2).alias("median"), F.min(metric).alias("min"), F.max(metric).alias("max"), F.count(metric).alias("runs"))


def moving_average(runs: DataFrame, metric: str, order: str = "run_ts", size: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Means of ``size`` runs, complete ones only.  At most ``KEPT`` runs
    belong to a source."""
    w = Window.partitionBy(*by).orderBy(order)
    frame = w.rowsBetween(-(size - 1), 0)
    return runs.select(*by, order, rounded(F.avg(metric).over(frame), 2).alias("moving_average"), F.count(metric).over(frame).alias("_n")).where(F.col("_n") == size).drop("_n")


def run_trend(runs: DataFrame, metric: str, order: str = "run_ts") -> DataFrame:
    """Regression over the run's position; stable if the change from the
    first to the last run is below 1 percent."""
    w = Window.partitionBy().orderBy(order)
    x = runs.select(F.col(metric).alias("y"), (F.row_number().over(w) - 1).cast("double").alias("x"))
    agg = x.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2"), F.min_by("y", "x").alias("first"), F.max_by("y", "x").alias("last"))
    change = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.col("first") * 100).otherwise(0.0)
    direction = F.when(F.col("n") < LEAST_RUNS, "insufficient_data").when(F.abs(change) < 1, "stable").when(change > 0, "increasing").otherwise("decreasing")
    r2 = F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan("r2"), F.col("r2")), F.lit(0.0)))
    return agg.select("n", rounded(F.col("slope"), 4).alias("slope"), rounded(r2, 2).alias("confidence"), rounded(change, 2).alias("change_percent"), direction.alias("direction"))


def run_anomalies(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Metrics of the current run at 2.5 deviations or more from the
    earlier ones, of which there must be three."""
    parts = None
    for key, name, higher in METRICS:
        stats = run_stats(runs, key)
        now = current.select(F.col(key).cast("double").alias("current"))
        both = now.join(F.broadcast(stats)).where(F.col("runs") >= LEAST_RUNS)
        z = F.when(F.col("std_dev") != 0, (F.col("current") - F.col("mean")) / F.col("std_dev")).otherwise(0.0)
        impact = F.lit("neutral") if higher is None else F.when((z > 0) if higher else (z < 0), "positive").otherwise("negative")
        severity = F.when(F.abs(z) >= 4, "critical").when(F.abs(z) >= 3, "high").otherwise("medium")
        advice = F.when(impact == "positive", "This is a positive deviation.").when(impact == "negative", "This may indicate a data quality issue.").otherwise("Monitor this metric for consistency.")
        side = F.when(F.col("current") > F.col("mean"), "higher").otherwise("lower")
        one = both.where(F.abs(z) >= Z_LIMIT).select(
            F.lit(name).alias("metric"), F.lit(key).alias("key"), "current", F.col("mean").alias("expected"), rounded(z, 2).alias("zscore"), rounded(F.col("current") - F.col("mean"), 2).alias("deviation"),
            severity.alias("severity"), impact.alias("impact"), F.concat(F.lit(f"{name} is significantly "), side, F.lit(" than expected. "), advice).alias("message"),
        )
        parts = one if parts is None else parts.union(one)
    return parts


def next_run(runs: DataFrame, metric: str = "quality_score", order: str = "run_ts") -> DataFrame:
    """H7: the metric expected of the next run, between 0 and 100; from three
    runs on."""
    w = Window.partitionBy().orderBy(order)
    x = runs.select(F.col(metric).alias("y"), (F.row_number().over(w) - 1).cast("double").alias("x"))
    agg = x.agg(F.count("*").alias("n"), rounded(F.avg("y"), 2).alias("mean"), rounded(F.regr_slope("y", "x"), 4).alias("slope"))
    value = F.col("mean") + F.col("slope") * (F.col("n") - (F.col("n") - 1) / 2)
    return agg.where(F.col("n") >= LEAST_RUNS).select("n", rounded(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), 1).alias("predicted"))


def history_advice(trend: dict, stats: dict, anomalies: list[dict]) -> list[dict]:
    """H9: what the course of the score suggests."""
    out = []
    if trend.get("direction") == "decreasing":
        out.append({"priority": "high", "message": f"Quality score is declining ({trend['change_percent']}%)"})
    if trend.get("direction") == "increasing":
        out.append({"priority": "low", "message": f"Quality score is improving ({trend['change_percent']}%)"})
    out += [{"priority": "high", "message": a["message"]} for a in anomalies if a["impact"] == "negative"]
    if (stats.get("std_dev") or 0) > 10:
        out.append({"priority": "medium", "message": "Quality score varies widely between runs"})
    return out


def human_size(n: float) -> str:
    """bytes in the largest unit of which there is one."""
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if n < 1024 or unit == "TB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return ""


def is_slug(text: str) -> bool:
    return bool(re.fullmatch("[a-z0-9_]*", text))
