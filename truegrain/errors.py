"""Error taxonomy and helpers."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TypeVar

R = TypeVar("R")


@dataclass
class QualityError(Exception):
    """An error with a code, a category and advice."""

    code: str
    category: str
    message: str
    suggestion: str = ""
    retryable: bool = False
    recoverable: bool = False
    details: Any = None

    def __str__(self) -> str:
        return f"[{self.code}] {self.message}"


# Name, code, category, message, suggestion, retryable, recoverable.
CATALOGUE = {
    "no_source": ("E1001", "input", "No data source was given", "Give a URL, inline data or base64 data", False, False),
    "bad_config": ("E1002", "input", "The configuration is invalid: {}", "Check the option names and values", False, False),
    "bad_url": ("E1003", "input", "The URL is invalid: {}", "Use an absolute http(s) URL", False, False),
    "parse_failed": ("E2001", "parsing", "The data can't be parsed: {}", "Check the format and the encoding", False, False),
    "unsupported_format": ("E2002", "parsing", "The format isn't supported: {}", "Use csv, json, jsonl, xlsx or parquet", False, False),
    "empty_data": ("E2003", "parsing", "There are no rows", "Check that the source has data", False, True),
    "fetch_failed": ("E3001", "network", "The source can't be fetched: {}", "Check the address and try again", True, False),
    "timeout": ("E3002", "network", "The request took too long: {}", "Try again or raise the limit", True, False),
    "unauthorized": ("E3003", "network", "Access was refused: {}", "Check the credentials", False, False),
    "rate_limited": ("E3004", "network", "Too many requests: {}", "Wait and try again", True, False),
    "validation_failed": ("E4001", "validation", "Validation failed: {}", "Check the rules", False, True),
    "schema_invalid": ("E4002", "validation", "The schema is invalid: {}", "Check the column definitions", False, False),
    "profiling_failed": ("E5001", "profiling", "Profiling failed: {}", "Leave the column out", False, True),
    "remediation_failed": ("E6001", "remediation", "Cleaning failed: {}", "Check the actions", False, True),
    "export_failed": ("E7001", "export", "The export failed: {}", "Check the target", True, True),
    "integration_failed": ("E8001", "integration", "The connector failed: {}", "Check its configuration", True, False),
    "internal": ("E9001", "internal", "Unexpected error: {}", "Report it with the configuration", False, False),
}


def make(kind: str, detail: object = "", details: Any = None) -> QualityError:
    """An error of the catalogue."""
    code, category, message, suggestion, retryable, recoverable = CATALOGUE[kind]
    return QualityError(code, category, message.format(detail), suggestion, retryable, recoverable, details)


def classify(error: BaseException) -> str:
    """The catalogue's name for any exception."""
    if isinstance(error, QualityError):
        return next(k for k, v in CATALOGUE.items() if v[0] == error.code)
    text = f"{type(error).__name__} {error}".lower()
    for words, kind in (
        (("timeout", "timed out"), "timeout"), (("401", "403", "unauthorized", "forbidden"), "unauthorized"), (("429", "rate limit"), "rate_limited"),
        (("connection", "urlerror", "network", "resolve"), "fetch_failed"), (("parse", "json", "unicode", "malformed"), "parse_failed"),
    ):
        if any(w in text for w in words):
            return kind
    return "internal"


def wrap(error: BaseException) -> QualityError:
    return error if isinstance(error, QualityError) else make(classify(error), error)


def safely(action: Callable[[], R], fallback: R, warnings: list[str] | None = None) -> R:
    """The action's result, or ``fallback`` and a warning."""
    try:
        return action()
    except Exception as error:
        if warnings is not None:
            warnings.append(str(wrap(error)))
        return fallback


def delay(attempt: int) -> float:
    """Seconds before the next attempt: 1, 2, 4, ... up to 10."""
    return min(10.0, 2.0**attempt)


def retry(action: Callable[[], R], attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> R:
    """Try again what is worth trying again."""
    for attempt in range(attempts):
        try:
            return action()
        except Exception as error:
            known = wrap(error)
            if not known.retryable or attempt + 1 == attempts:
                raise known from error
            sleep(delay(attempt))
    raise make("internal", "no attempt was made")


def formatted(error: BaseException) -> dict:
    known = wrap(error)
    return {k: getattr(known, k) for k in ("code", "category", "message", "suggestion", "retryable", "recoverable")}
