"""Audit trail and lineage."""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import diagram_label, mask_url

ACTIONS = ("DATA_SOURCE_ACCESSED", "VALIDATION_STARTED", "VALIDATION_COMPLETED", "PII_DETECTED", "DATA_MODIFIED", "DATA_EXPORTED")
KINDS = ("parse", "filter", "validate", "impute", "clean", "deduplicate", "mask", "export")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


@dataclass
class AuditTrail:
    """What was done to the data, without secrets."""

    enabled: bool = True
    entries: list[dict] = field(default_factory=list)

    def log(self, action: str, **details: object) -> None:
        if self.enabled:
            safe = {k: mask_url(v) if isinstance(v, str) and "://" in v else v for k, v in details.items()}
            self.entries.append({"timestamp": _now(), "action": action, "details": safe})

    def summary(self) -> dict:
        """A29."""
        counts = Counter(e["action"] for e in self.entries)
        return {"total": len(self.entries), "by_action": dict(counts), "first": self.entries[0]["timestamp"] if self.entries else None, "last": self.entries[-1]["timestamp"] if self.entries else None}

    def report(self) -> dict:
        return {"generated": _now(), "summary": self.summary(), "entries": self.entries}

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e["timestamp"], e["action"], json.dumps(e["details"], default=str)) for e in self.entries], "timestamp string, action string, details string")


@dataclass
class Lineage:
    """The steps that data went through, as a chain of records."""

    source: str = ""
    steps: list[dict] = field(default_factory=list)

    def add(self, kind: str, rows_in: int | None = None, rows_out: int | None = None, columns_in: list[str] | None = None, columns_out: list[str] | None = None, **details: object) -> str:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of step: {kind}")
        name = f"{kind}_{len(self.steps) + 1}"
        a, b = set(columns_in or []), set(columns_out or [])
        changes = {"added": sorted(b - a), "removed": sorted(a - b)} if columns_in is not None and columns_out is not None else {}
        self.steps.append({"id": name, "type": kind, "timestamp": _now(), "rows_in": rows_in, "rows_out": rows_out, "columns": changes, "details": details, "parent": self.steps[-1]["id"] if self.steps else None})
        return name

    def summary(self) -> dict:
        """A29."""
        return {"source": self.source, "steps": len(self.steps), "by_type": dict(Counter(s["type"] for s in self.steps)), "rows_in": self.steps[0]["rows_in"] if self.steps else None, "rows_out": self.steps[-1]["rows_out"] if self.steps else None}

    def report(self) -> dict:
        return {"generated": _now(), "summary": self.summary(), "steps": self.steps}

    def diagram(self) -> str:
        """A Mermaid flow chart."""
        lines = ["graph TD", f'    source["{diagram_label(self.source or "source")}"]']
        before = "source"
        for s in self.steps:
            rows = f" ({s['rows_out']} rows)" if s["rows_out"] is not None else ""
            lines += [f'    {s["id"]}["{diagram_label(s["type"] + rows)}"]', f"    {before} --> {s['id']}"]
            before = s["id"]
        return "\n".join(lines)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s["id"], s["type"], s["timestamp"], s["rows_in"], s["rows_out"], s["parent"], json.dumps(s["details"], default=str)) for s in self.steps], "id string, type string, timestamp string, rows_in long, rows_out long, parent string, details string")


def store(spark: SparkSession, path: str, name: str, value: dict) -> None:
    """C4: append a record under a name."""
    spark.createDataFrame([(name, _now(), json.dumps(value, default=str))], "name string, stored string, value string").coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, name: str | None = None, limit: int = 100) -> list[dict]:
    """The latest records, newest first."""
    df = spark.read.parquet(path)
    df = df.where(df["name"] == name) if name else df
    return [{"name": r["name"], "stored": r["stored"], **json.loads(r["value"])} for r in df.orderBy(df["stored"].desc()).limit(limit).collect()]
