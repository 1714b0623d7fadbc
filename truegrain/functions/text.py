"""Text helpers (F1, F2, F7-F11) for columns, and small ones for the driver."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["diagram_label", "escape_html", "mask_url", "poly_hash", "sanitize", "sanitize_text", "trimmed"]

SECRETS = ("key", "token", "secret", "password", "apikey", "api_key")


def trimmed(c: Column) -> Column:
    """without white space, Unicode's included, at either end."""
    return F.regexp_replace(c, r"(?U)^[\s﻿\xA0]+|[\s﻿\xA0]+$", "")


def sanitize(c: Column) -> Column:
    """F8: lower case, runs of other than letters and digits as one ``_``, none
    at the ends, 100 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 100)


def sanitize_text(text: str) -> str:
    return re.sub("^_+|_+$", "", re.sub("[^a-z0-9]+", "_", text.lower()))[:100]


def escape_html(c: Column | str) -> Column | str:
    """F7 for a column, or for a Python string."""
    if isinstance(c, str):
        return html.escape(c, quote=True).replace("&#x27;", "&#039;")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def poly_hash(text: str) -> str:
    """31-polynomial hash in 32 signed bits, its absolute value in base 36."""
    h = 0
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = (h * 31 + unit) & 0xFFFFFFFF
    n = abs(h - (1 << 32) if h >= 1 << 31 else h)
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out or "0"


def mask_url(c: Column | str) -> Column | str:
    """user, password and secret parameters of a URL as ``***``."""
    login, param = r"^([A-Za-z][A-Za-z0-9+.\-]*://)[^/@?#]*@", rf"(?i)([?&](?:{'|'.join(SECRETS)})=)[^&#]*"
    if isinstance(c, str):
        return re.sub(param, r"\1***", re.sub(login, r"\1***:***@", c))
    return F.regexp_replace(F.regexp_replace(c, login, "$1***:***@"), param, "$1***")


def diagram_label(text: str) -> str:
    """a flow diagram's label, 50 characters at most."""
    return re.sub(r'["\[\]{}()<>|]', " ", str(text)).replace("\n", " ")[:50]
