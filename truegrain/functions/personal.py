"""Personal data: patterns, tests and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import EMAIL, IPV4

__all__ = ["DEFAULT_KINDS", "EMBEDDED", "PII", "is_personal", "mask", "redact"]

# Kind, name, risk and pattern of a whole, trimmed cell.
PII = {
    "email": ("Email Address", "high", EMAIL),
    "phone": ("Phone Number", "medium", r"^\+?[0-9\s\-()]{10,}\z"),
    "ssn": ("Social Security Number", "critical", r"^[0-9]{3}-?[0-9]{2}-?[0-9]{4}\z"),
    "creditCard": ("Credit Card Number", "critical", r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\z"),
    "ipAddress": ("IP Address", "low", IPV4),
}
DEFAULT_KINDS = ("email", "phone", "ssn", "creditCard")
# Patterns inside longer text.
EMBEDDED = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "phone": r"\+[0-9]{1,3}[ \-][0-9]{3}[ \-][0-9]{3}[ \-][0-9]{4}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "creditCard": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "ipAddress": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
}


def is_personal(kind: str, text: Column) -> Column:
    """The whole trimmed cell is of the kind."""
    return F.trim(text).rlike(PII[kind][2])


def mask(kind: str, text: Column) -> Column:
    """What is shown of a value."""
    if kind == "email":
        return F.concat(F.substring(text, 1, 1), F.lit("***@"), F.element_at(F.split(text, "@"), 2))
    if kind == "phone":
        return F.concat(F.substring(text, 1, 3), F.lit("***"), F.right(text, F.lit(2)))
    if kind == "ssn":
        return F.concat(F.lit("***-**-"), F.right(text, F.lit(4)))
    if kind == "creditCard":
        return F.concat(F.lit("****-****-****-"), F.right(text, F.lit(4)))
    if kind == "ipAddress":
        return F.concat(F.substring_index(text, ".", 2), F.lit(".xxx.xxx"))
    return F.concat(F.substring(text, 1, 3), F.lit("***"))


def redact(text: Column, kinds: tuple[str, ...] = tuple(EMBEDDED)) -> Column:
    """Values inside longer text replaced by their kind in brackets."""
    for kind in kinds:
        text = F.regexp_replace(text, EMBEDDED[kind], f"[{kind}]")
    return text
