"""The logical types' predicates (P6; 1.2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import is_date, likely_date
from .numbers import js_number

__all__ = ["EMAIL", "INFERENCE", "IPV4", "TYPES", "type_predicate"]

# Patterns of the logical types.
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"
PHONE = r"^\+?[0-9\s\-()]{7,}\z"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}\z"
IPV6 = r"^(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\z"
URL = r"(?i)^\s*(?:(?:https?|ftp|wss?)://[^\s/?#]+|(?!(?:https?|ftp|wss?):)[a-z][a-z0-9+.\-]*:).*"
TYPES = ("string", "number", "integer", "date", "email", "phone", "url", "boolean", "uuid", "ip", "json")
BOOLEANS = ("true", "false", "0", "1", "yes", "no")


def _number(text: Column) -> Column:
    return (F.trim(text) != "") & js_number(text).isNotNull()


def _integer(text: Column) -> Column:
    n = js_number(text)
    return n.isNotNull() & (n == F.floor(n))


def _json(text: Column) -> Column:
    """valid JSON.  The parser ignores what follows a value, so the text must also be a whole
    item of an array and a whole value of an object."""
    item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    return (F.trim(text) != "") & item & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()


def type_predicate(kind: str, text: Column) -> Column | None:
    """Whether a non-missing cell's canonical text is of a type; None for types
    that nothing contradicts."""
    tests = {
        "number": _number, "integer": _integer, "date": is_date, "email": lambda c: c.rlike(EMAIL), "phone": lambda c: c.rlike(PHONE),
        "url": lambda c: c.rlike(URL), "boolean": lambda c: F.lower(c).isin(*BOOLEANS), "uuid": lambda c: c.rlike(UUID),
        "ip": lambda c: c.rlike(IPV4) | c.rlike(IPV6), "json": _json,
    }
    return F.coalesce(tests[kind](text), F.lit(False)) if kind in tests else None


#: V3: tests in order of specificity; the first that 90 % of a sample pass wins.
INFERENCE = (
    ("email", lambda c: type_predicate("email", c)),
    ("url", lambda c: type_predicate("url", c) & c.startswith("http")),
    ("uuid", lambda c: type_predicate("uuid", c)),
    ("boolean", lambda c: type_predicate("boolean", c)),
    ("integer", lambda c: type_predicate("integer", c) & ~c.contains(".")),
    ("number", lambda c: type_predicate("number", c)),
    ("date", lambda c: type_predicate("date", c) & likely_date(c)),
)
