"""What a source is: place, format, encoding."""

from __future__ import annotations

import base64
import csv
import json
import re
from urllib.parse import urlsplit

from ..config import RunConfig
from ..errors import make

EXTENSIONS = {"csv": "csv", "tsv": "csv", "txt": "csv", "xlsx": "xlsx", "xls": "xls", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet"}
BOMS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be"))


def place(cfg: RunConfig) -> str:
    """A URL before inline data before base64 data."""
    for kind in ("url", "data", "base64"):
        if getattr(cfg, kind):
            return kind
    raise make("no_source")


def decode(data: str) -> bytes:
    """S4."""
    try:
        return base64.b64decode(data.partition("base64,")[2] or data, validate=False)
    except ValueError as error:
        raise make("parse_failed", error) from error


def from_url(url: str) -> str:
    """By extension, else csv."""
    return EXTENSIONS.get(urlsplit(url).path.rpartition(".")[2].lower(), "csv")


def from_text(head: str) -> str:
    """JSON lines if two of the first five lines in a row are JSON values."""
    text = head.lstrip("﻿ \t\r\n")
    if text[:1] in ("[", "{"):
        run = 0
        for line in [x for x in text.split("\n") if x.strip()][:5]:
            try:
                json.loads(line)
                run += 1
            except ValueError:
                run = 0
            if run >= 2:
                return "jsonl"
        return "json"
    return "xlsx" if text[:2] == "PK" else "csv"


def from_bytes(head: bytes) -> str:
    """By magic numbers, else by content."""
    if head[:4] == b"PAR1":
        return "parquet"
    if head[:2] == b"PK":
        return "xlsx"
    if head[:4] == b"\xd0\xcf\x11\xe0":
        return "xls"
    return from_text(head.decode(encoding(head), errors="replace"))


def encoding(head: bytes) -> str:
    """By byte order mark, by alternating zeros, by validity."""
    for mark, name in BOMS:
        if head.startswith(mark):
            return name
    sample = head[:1000]
    if len(sample) > 3:
        zeros = (sample[0::2].count(0), sample[1::2].count(0))
        if max(zeros) > len(sample) * 0.3:
            return "utf-16be" if zeros[0] > zeros[1] else "utf-16le"
    try:
        sample[: max(0, len(sample) - 3)].decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        return "latin1"


def detect(cfg: RunConfig, head: bytes | None = None) -> str:
    """The declared format, or the one that the place suggests."""
    if cfg.format != "auto":
        return cfg.format
    where = place(cfg)
    if where == "url":
        return from_url(cfg.url or "")
    return from_text(cfg.data or "") if where == "data" else from_bytes(head if head is not None else decode(cfg.base64 or ""))


def delimiter(sample: str) -> str:
    """The separator of a CSV sample; a comma if it can't be told."""
    try:
        return csv.Sniffer().sniff(sample[:10_000], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def csv_fatal(rows: int, critical: int) -> bool:
    """Errors spoil a CSV if there are no rows or over half are bad."""
    return critical > 0 and (rows == 0 or critical > max(1.0, 0.5 * rows))


# --- spreadsheets on the web (S22) -------------------------------------------

_SHEET = re.compile(r"docs\.google\.com/spreadsheets/d/([A-Za-z0-9_-]+)")


def sheet_of(url: str) -> dict | None:
    """Id and tab of a shared spreadsheet's URL."""
    found = _SHEET.search(url)
    if not found:
        return None
    tab = re.search(r"[#&?]gid=(\d+)", url)
    return {"sheet_id": found.group(1), "gid": tab.group(1) if tab else "0"}


def sheet_export(sheet_id: str, gid: str = "0", kind: str = "csv") -> str:
    return f"https://docs.google.com/spreadsheets/d/{sheet_id}/export?format={kind}&gid={gid}"


#: Which URLs are read in a special way, and how.
INTEGRATIONS = {"sheets": (_SHEET, lambda url: sheet_export(**{k: v for k, v in (sheet_of(url) or {}).items()}))}
CLOUD_SCHEMES = {"s3": "s3a", "gcs": "gs", "azure": "abfss"}


def resolve_url(url: str) -> str:
    """The URL that data comes from."""
    for pattern, handler in INTEGRATIONS.values():
        if pattern.search(url):
            return handler(url)
    return url
