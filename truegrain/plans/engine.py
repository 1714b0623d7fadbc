"""A whole run: read, validate, profile, score, report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from .. import errors, scratch
from ..config import ColumnRule, RunConfig, check
from ..dataset import ROW, Dataset
from ..operators import frequency, issues, quality, remediation, statistics
from ..sources import readers, sinks
from . import html_report
from .records import AuditTrail, Lineage


@dataclass
class Validation:
    """Issues in report order, their true counts by type, and warnings."""

    issues: DataFrame
    true_counts: dict[str, int]
    reported_counts: dict[str, int]
    outliers_by_column: dict[str, int]
    invalid_rows: int
    rules: list[ColumnRule]
    warnings: list[str] = field(default_factory=list)


def _counts(found: DataFrame, kinds: list[tuple[str, str | None]]) -> tuple[DataFrame, Observation]:
    """``found``, observed: how many issues there are of each type, or of a type
    in a column, is counted while something else reads it."""
    seen = Observation()
    tests = [F.col("issueType").eqNullSafe(t) & (F.lit(True) if c is None else F.col("column").eqNullSafe(c)) for t, c in kinds]
    return found.observe(seen, *[F.sum(F.when(t, 1).otherwise(0)).alias(f"n{i}") for i, t in enumerate(tests)]), seen


def validate(ds: Dataset, cfg: RunConfig, freq: DataFrame | None = None, order: DataFrame | None = None) -> Validation:
    """V1: the stages, each of which becomes a warning if it fails; caps per
    type and in all.  ``true_counts`` count every violation (D5).

    Every stage runs once: its issues are counted as they pass on their way to
    the cap.  What the caps leave, ``cap * issue_multiplier`` rows at most, is
    held on the driver.  ``freq``: the frequency frame, and
    ``order`` its order statistics, if there are any.
    """
    warnings: list[str] = []
    rules = errors.safely(lambda: issues.resolve(ds, cfg.schema), list(cfg.schema), warnings)
    numeric = issues.numeric_columns(rules)
    dup = [c for c in cfg.duplicate_columns if c in ds.headers] or ds.headers
    unique = [*cfg.unique_columns, *[r.name for r in rules if r.unique and r.name not in cfg.unique_columns]]
    cap = cfg.max_issues
    by_type = lambda d: issues.capped(d, cap)
    by_column = lambda d: issues.capped(d, cap, ("stage_ord", "column"))
    plain = [(t, None) for t in issues.cell_types(rules)]
    stages: list[tuple[bool, list, Callable[[], DataFrame], Callable[[DataFrame], DataFrame]]] = [
        (True, plain, lambda: issues.cell_issues(ds, rules, cfg.check_missing), by_type),
        (cfg.check_duplicates, [("duplicate", None)], lambda: issues.duplicate_issues(ds, dup), by_type),
        (cfg.fuzzy, [("fuzzy-duplicate", None)], lambda: issues.fuzzy_issues(ds, dup, cfg.fuzzy_similarity), by_type),
        (cfg.outliers != "none" and bool(numeric), [("outlier", c) for c in numeric], lambda: issues.outlier_issues(ds, numeric, cfg.outliers, cfg.zscore, freq, order), by_column),
        (bool(unique), [("unique-violation", None)], lambda: issues.unique_issues(ds, unique), lambda d: issues.truncated(d, cap * cfg.issue_multiplier)),
    ]
    kept: list[Row] = []
    true_counts, outliers = {}, {}
    for wanted, kinds, make, limit in stages:
        if not wanted:
            continue

        def stage(kinds=kinds, make=make, limit=limit) -> list[Row]:
            found, seen = _counts(make(), kinds)
            rows = limit(found).collect()  # caps bound them
            for (t, c), n in zip(kinds, (seen.get.get(f"n{i}") or 0 for i in range(len(kinds)))):
                if n:
                    true_counts[t] = true_counts.get(t, 0) + n
                    if c:
                        outliers[c] = n
            return rows

        kept += errors.safely(stage, [], warnings)
    kept.sort(key=lambda r: (r["stage_ord"], r["ord1"], r["ord2"], r["ord3"]))
    if cfg.fuzzy:  # fuzzy duplicates get what exact ones leave of the cap
        room = max(0, cap - min(cap, true_counts.get("duplicate", 0)))
        fuzzy = [r for r in kept if r["issueType"] == "fuzzy-duplicate"][room:]
        kept = [r for r in kept if r not in fuzzy]
    kept = kept[: cap * cfg.issue_multiplier]
    every = ds.df.sparkSession.createDataFrame(kept, issues.ISSUE_SCHEMA)
    reported: dict[str, int] = {}
    for r in kept:
        reported[r["issueType"]] = reported.get(r["issueType"], 0) + 1
    return Validation(every, true_counts, reported, outliers, len({r["rowNumber"] for r in kept}), rules, warnings)


def breakdown(counts: dict[str, int]) -> dict[str, int]:
    """The report's groups of issue types."""
    constraint = sum(n for t, n in counts.items() if t.endswith("-violation") and t != "unique-violation" or t.startswith("custom-"))
    return {
        "missing": counts.get("missing", 0) + counts.get("null", 0), "typeErrors": counts.get("type-mismatch", 0), "constraints": constraint,
        "duplicates": counts.get("duplicate", 0) + counts.get("fuzzy-duplicate", 0), "outliers": counts.get("outlier", 0), "unique": counts.get("unique-violation", 0),
    }


@dataclass
class Report:
    """What a run found: ``value`` as plain data, the issues, the cleaned rows."""

    value: dict
    issues: DataFrame | None
    cleaned: Dataset | None
    html: str


def memory_pressure(used: int, limit: int = 512 << 20) -> str:
    """Normal, high from 80 %, critical from 95 %."""
    return "critical" if used >= 0.95 * limit else "high" if used >= 0.8 * limit else "normal"


def spread(ds: Dataset) -> tuple[Dataset, int]:
    """The number of rows, and the data dealt evenly, by one write to the shared
    folder, if a few partitions hold nearly all of it (one file that can't be
    split, say); data in many partitions isn't touched."""
    sizes = [r["count"] for r in ds.df.groupBy(F.spark_partition_id()).count().collect()]  # a row per partition
    total, cores = sum(sizes), ds.df.sparkSession.sparkContext.defaultParallelism
    if total >= 10_000 and max(sizes) * cores > 3 * total:
        even = ds.df.repartition(cores, ROW)
        ds = Dataset(scratch.saved(even, "rows"), ds.headers, dict(ds.metadata))
    return ds, total


def run(spark: SparkSession, cfg: RunConfig, dataset: Dataset | None = None) -> Report:
    """All of it.  The frequency frame is written once to the shared folder, for
    the profiles and the outlier bounds both read it."""
    began = time.perf_counter()
    audit, lineage = AuditTrail(cfg.audit), Lineage(cfg.url or "inline")
    warnings = check(cfg) if dataset is None else []
    ds = dataset if dataset is not None else readers.read(spark, cfg)
    audit.log("DATA_SOURCE_ACCESSED", source=cfg.url or "inline", format=ds.metadata.get("format"))
    warnings += ds.metadata.get("warnings", [])
    if ds.is_empty():
        value = {"summary": {"totalRows": 0, "validRows": 0, "invalidRows": 0, "qualityScore": 100, "processingTimeMs": 0}, "score": {"overall": 100, "grade": "A"}, "issues": [], "columns": [], "recommendations": [], "warnings": [*warnings, "no rows"]}
        return Report(value, None, None, html_report.render(value))
    began_with = scratch.mark()
    ds, total = spread(ds)
    lineage.add("parse", None, total, None, ds.headers)
    ds = ds.drop(cfg.ignored).head(cfg.sample_rows)
    rows = ds.df.count() if cfg.sample_rows else total
    audit.log("VALIDATION_STARTED", rows=rows, columns=len(ds.headers))
    freq = scratch.saved(frequency.frequency_frame(ds), "frequencies")
    order = scratch.saved(frequency.order_statistics(freq), "order")
    found = validate(ds, cfg, freq, order)
    lineage.add("validate", rows, rows, ds.headers, ds.headers)
    profile = sorted((r.asDict() for r in frequency.profiles(ds, freq=freq, order=order).collect()), key=lambda r: r["col_ord"])  # a row per column
    counts = found.reported_counts if cfg.score_mode == "reported" else found.true_counts
    groups = breakdown(counts)
    numeric = set(issues.numeric_columns(found.rules))
    capped = {c: min(n, cfg.max_issues) for c, n in found.outliers_by_column.items()} if cfg.score_mode == "reported" else found.outliers_by_column
    has_unique = any(r.unique for r in found.rules)
    score = quality.quality_score(total, ds.headers, {c["column"]: c["null_count"] for c in profile}, groups["typeErrors"], groups["constraints"], groups["duplicates"], capped, numeric, has_unique)
    value: dict = {"score": score, "columns": profile, "issueBreakdown": groups, "trueIssueCounts": found.true_counts, "columnTypes": {r.name: r.type for r in found.rules}}
    columns = sorted(numeric & set(ds.headers), key=ds.headers.index)
    if cfg.benford:
        value["benford"] = [r.asDict() for c in columns for r in statistics.benford(ds, c).collect()]
    if cfg.correlations:
        pairs = statistics.correlations(ds, columns)
        value["correlations"] = [r.asDict() for r in statistics.correlation_classes(pairs).collect()]
    if cfg.patterns:
        value["patterns"] = statistics.patterns(ds, ds.headers, numeric)
    if cfg.seasonal:
        value["seasonal"] = statistics.seasonal_report(ds)
    if cfg.pii:
        cells = remediation.personal_cells(ds, cfg.pii_kinds)
        value["pii"] = {"summary": {r["piiType"]: r["count"] for r in remediation.personal_summary(cells).collect()}, "findings": [r.asDict() for r in remediation.personal_findings(cells, cfg.max_issues).collect()]}
        audit.log("PII_DETECTED", **value["pii"]["summary"])
    value["recommendations"] = quality.recommendations(score, profile, groups, cfg.pii)
    cleaned = None
    if cfg.cleaning or cfg.impute:
        cleaned = remediation.clean(ds, cfg.cleaning, cfg.duplicate_columns or None)
        if cfg.impute:
            cleaned, value["imputation"] = remediation.impute(cleaned, cfg.impute)
        audit.log("DATA_MODIFIED", actions=cfg.cleaning, impute=cfg.impute)
        lineage.add("clean", rows, None, ds.headers, cleaned.headers)
    value["issues"] = [r.asDict() for r in found.issues.select(*issues.ISSUE_COLUMNS).limit(1000).collect()]
    value["summary"] = {"totalRows": total, "validRows": max(0, rows - found.invalid_rows), "invalidRows": found.invalid_rows, "qualityScore": score["overall"], "processingTimeMs": int((time.perf_counter() - began) * 1000)}
    value["warnings"] = warnings + found.warnings
    if cfg.history_dir:
        name = quality.source_id(cfg.source_id, cfg.url, cfg.data, str(cfg.schema))
        current = {"source_id": name, "run_ts": datetime.now(timezone.utc), "quality_score": float(score["overall"]), "total_issues": float(sum(counts.values())), "total_rows": float(total)}
        past = quality.load_runs(spark, cfg.history_dir, name, cfg.history_compare)
        now = spark.createDataFrame([current], quality.HISTORY_SCHEMA)
        odd = [r.asDict() for r in quality.run_anomalies(past, now).collect()]
        line = quality.run_trend(past.unionByName(now), "quality_score").first().asDict()
        value["history"] = {"anomalies": odd, "trend": line, "advice": quality.history_advice(line, quality.run_stats(past, "quality_score").first().asDict(), odd)}
        quality.store_run(spark, cfg.history_dir, current)
    audit.log("VALIDATION_COMPLETED", score=score["overall"], issues=sum(counts.values()))
    value |= {"audit": audit.report() if cfg.audit else None, "lineage": lineage.report() if cfg.lineage else None}
    page = html_report.render(value)
    if cfg.output_dir:
        sinks.issues(found.issues.select(*issues.ISSUE_COLUMNS), f"{cfg.output_dir}/issues")
        sinks.report(spark, value, f"{cfg.output_dir}/report.json")
        sinks.text(spark, page, f"{cfg.output_dir}/report.html")
        if cleaned is not None:
            sinks.csv(cleaned.df, f"{cfg.output_dir}/cleaned")
        audit.log("DATA_EXPORTED", path=cfg.output_dir)
    if cleaned is None:
        scratch.clean(began_with)
    return Report(value, found.issues, cleaned, page)
