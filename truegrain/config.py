"""Run configuration, column rules and their checks (1.5, P18, D19)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import Column

from .errors import make
from .functions.types import TYPES


@dataclass(frozen=True)
class ColumnRule:
    """What a column's cells must be.  ``custom`` maps a name to a function from
    the cell's Column to the condition that it must meet."""

    name: str
    type: str = "string"
    required: bool = False
    unique: bool = False
    min: float | None = None
    max: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None
    allowed: tuple[str, ...] | None = None
    custom: tuple[tuple[str, Callable[[Column], Column]], ...] = ()

    @classmethod
    def of(cls, spec: dict) -> ColumnRule:
        """From a plain definition {name, type, required, unique, constraints}."""
        c = spec.get("constraints") or {}
        allowed = c.get("enum", c.get("allowedValues"))
        return cls(
            spec["name"], spec.get("type", "string"), bool(spec.get("required")), bool(spec.get("unique")), c.get("min"), c.get("max"),
            c.get("minLength"), c.get("maxLength"), c.get("pattern"), tuple(map(str, allowed)) if allowed is not None else None,
        )


@dataclass
class RunConfig:
    """Options of a run, with their defaults."""

    url: str | None = None
    data: str | None = None
    base64: str | None = None
    format: str = "auto"
    delimiter: str = "auto"
    encoding: str = "utf-8"
    has_header: bool = True
    sheet: str | int | None = None
    schema: list[ColumnRule] = field(default_factory=list)
    check_missing: bool = True
    check_duplicates: bool = True
    duplicate_columns: list[str] = field(default_factory=list)
    unique_columns: list[str] = field(default_factory=list)
    fuzzy: bool = False
    fuzzy_similarity: float = 0.85
    outliers: str = "iqr"
    zscore: float = 3.0
    max_issues: int = 100
    issue_multiplier: int = 10
    sample_rows: int = 0
    ignored: list[str] = field(default_factory=list)
    benford: bool = False
    correlations: bool = False
    patterns: bool = False
    seasonal: bool = False
    pii: bool = False
    pii_kinds: tuple[str, ...] = ("email", "phone", "ssn", "creditCard")
    cleaning: list[str] = field(default_factory=list)
    impute: str | None = None
    history_dir: str | None = None
    history_compare: int = 10
    source_id: str | None = None
    audit: bool = True
    lineage: bool = True
    output_dir: str | None = None
    score_mode: str = "reported"


def check(cfg: RunConfig) -> list[str]:
    """Warnings about a configuration, which gets defaults where they say so;
    an unusable one raises."""
    warnings: list[str] = []
    if not (cfg.url or cfg.data or cfg.base64):
        raise make("no_source")
    if cfg.url and not re.match(r"^(?:https?|s3a?|gs|abfss?|hdfs|viewfs|file)$", urlsplit(cfg.url).scheme or "file"):
        raise make("bad_url", cfg.url)
    for name, low, high, default in (("fuzzy_similarity", 0.0, 1.0, 0.85), ("zscore", 0.0, 100.0, 3.0)):
        value: Any = getattr(cfg, name)
        if not isinstance(value, (int, float)) or not low < value <= high:
            warnings.append(f"{name} {value!r} is out of range; {default} is used")
            setattr(cfg, name, default)
    for name, default in (("max_issues", 100), ("issue_multiplier", 10)):
        if not isinstance(getattr(cfg, name), int) or getattr(cfg, name) < 1:
            warnings.append(f"{name} must be a positive whole number; {default} is used")
            setattr(cfg, name, default)
    if cfg.sample_rows < 0:
        warnings.append("sample_rows must not be negative; all rows are used")
        cfg.sample_rows = 0
    seen = set()
    for rule in cfg.schema:
        if not rule.name or rule.name in seen:
            raise make("schema_invalid", f"column {rule.name!r} is missing or given twice")
        seen.add(rule.name)
        if rule.type not in (*TYPES, "any"):
            warnings.append(f"type {rule.type!r} of column {rule.name!r} is unknown and isn't checked")
    if cfg.outliers not in ("iqr", "zscore", "none"):
        warnings.append(f"outlier method {cfg.outliers!r} is unknown; no outliers are looked for")
        cfg.outliers = "none"
    return warnings
