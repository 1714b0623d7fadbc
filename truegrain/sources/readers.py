"""Readers of every format."""

from __future__ import annotations

import io
import json
import re
import urllib.request
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RunConfig
from ..dataset import ROW, Dataset
from ..errors import make, retry
from ..operators.quality import human_size
from . import detect

CORRUPT = "_corrupt"


#: Bytes of a remote body or workbook that the driver holds: a warning and the most.
WARN_BYTES, MOST_BYTES = 50 << 20, 100 << 20


def fetch(url: str, timeout: float = 60.0, most: int = MOST_BYTES) -> bytes:
    """S3: over http(s), with retries; other schemes are Spark's to read."""

    def get() -> bytes:
        with urllib.request.urlopen(url, timeout=timeout) as reply:
            return reply.read(most + 1)

    body = retry(get)
    if len(body) > most:
        raise make("parse_failed", f"over {human_size(most)}; put the file where Spark can read it")
    return body


def ends(spark: SparkSession, path: str, n: int = 1000) -> tuple[bytes, bytes, int]:
    """The first and last ``n`` bytes of a file, or of the first file of a
    folder, and its size."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f for f in fs.globStatus(where) or []), key=lambda f: f.getPath().toString())
    if found and found[0].isDirectory():
        found = sorted((f for f in fs.listStatus(found[0].getPath()) if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda f: f.getPath().toString())
    if not found:
        return b"", b"", 0
    size, stream = found[0].getLen(), fs.open(found[0].getPath())
    try:
        head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, size)))
        stream.seek(max(0, size - n))
        return head, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(n, size))), size
    finally:
        stream.close()


def parsed(lines: DataFrame) -> DataFrame:
    """Rows of JSON texts, one to a line of ``value``, with the schema of them
    all; no line leaves the JVM."""
    spark = lines.sparkSession
    texts = getattr(lines.select("value")._jdf, "as")(spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark._jsparkSession.read().json(texts), spark)


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(line,) for line in text.splitlines()] or [], "value string")


def csv(spark: SparkSession, path: str | None = None, text: str | None = None, header: bool = True, sep: str = "auto", encoding: str = "utf-8") -> DataFrame:
    """All cells are text; quoted separators, quotes and line ends,
    byte order marks, blank lines; ``column_1`` ... without a header."""
    if text is not None:
        text = text.lstrip("﻿")
        import csv as plain

        rows = [r for r in plain.reader(io.StringIO(text), delimiter=detect.delimiter(text) if sep == "auto" else sep) if any(x != "" for x in r)]
        if not rows:
            return spark.createDataFrame([], T.StructType([]))
        names = rows.pop(0) if header else [f"column_{i + 1}" for i in range(max(map(len, rows)))]
        bad = sum(len(r) != len(names) for r in rows)
        if detect.csv_fatal(len(rows), bad):
            raise make("parse_failed", f"{bad} of {len(rows)} rows have another number of fields")
        rows = [tuple((r + [None] * len(names))[: len(names)]) for r in rows]
        return spark.createDataFrame(rows, T.StructType([T.StructField(n.strip(), T.StringType()) for n in names]))
    if encoding == "utf-8":
        encoding = detect.encoding(ends(spark, path)[0])
    encoding = "iso-8859-1" if encoding == "latin1" else encoding
    # without pruning, so that lines of another length are told whatever columns are asked for
    options = {"sep": sep, "quote": '"', "escape": '"', "encoding": encoding, "mode": "PERMISSIVE", "columnPruning": "false"}
    lines = spark.read.option("encoding", encoding).csv(path, sep="\u0001", quote="", escape="", schema="value string")
    if sep == "auto":
        options["sep"] = detect.delimiter("\n".join(r[0] or "" for r in lines.limit(20).collect()))
    # a line end inside quotes leaves a line with an odd number of quotes; only then a file can't be split
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    options["multiLine"] = str(not lines.where(quotes % 2 == 1).isEmpty()).lower()
    first = spark.read.options(**options).csv(path, header=header)
    names = first.columns if header else [f"column_{i + 1}" for i in range(len(first.columns))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    df = spark.read.options(**options).csv(path, header=header, schema=schema, columnNameOfCorruptRecord=CORRUPT)
    n = df.agg(F.count("*").alias("rows"), F.count(CORRUPT).alias("bad"), F.count(f"`{names[0]}`")).first() if names else None
    if n and detect.csv_fatal(n["rows"], n["bad"]):
        raise make("parse_failed", f"{n['bad']} of {n['rows']} rows have another number of fields")
    return df.drop(CORRUPT)


def _unwrap(df: DataFrame) -> DataFrame:
    """Rows of a ``{"data": [...]}`` wrapper."""
    t = df.schema["data"].dataType if df.columns == ["data"] else None
    return df.selectExpr("inline(data)") if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType) else df


def _key_order(first: str) -> list[str]:
    value = json.loads(first)
    if isinstance(value, dict) and isinstance(value.get("data"), list):
        value = value["data"]
    value = next((x for x in value if isinstance(x, dict)), {}) if isinstance(value, list) else value
    return list(value) if isinstance(value, dict) else []


def json_rows(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """An array of objects, an object with ``data``, or one object; other
    items are dropped; columns in the order of the first object's keys."""
    if text is not None:
        try:
            value = json.loads(text)
        except ValueError as error:
            raise make("parse_failed", error) from error
        if isinstance(value, dict) and isinstance(value.get("data"), list):
            value = value["data"]
        items = [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
        if not items:
            return spark.createDataFrame([], T.StructType([]))
        df = parsed(spark.createDataFrame([(json.dumps(x),) for x in items], "value string"))
        order = [k for k in items[0] if k in df.columns]
        return df.select(*[f"`{c}`" for c in order + [c for c in df.columns if c not in order]])
    return _unwrap(spark.read.json(path, multiLine=True))


def jsonl(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """Bad lines are dropped if they are half or less."""
    lines = _lines(spark, text) if text is not None else spark.read.text(path)
    lines = lines.where(F.trim("value") != "")
    good = F.try_parse_json("value").isNotNull()
    n = lines.agg(F.count("*").alias("n"), F.coalesce(F.sum((~good).cast("long")), F.lit(0)).alias("bad"), F.first(F.when(good, F.col("value")), ignorenulls=True).alias("first")).first()
    if n["bad"] > 0.5 * n["n"]:
        raise make("parse_failed", f"{n['bad']} of {n['n']} lines are not JSON")
    if not n["n"]:
        return spark.createDataFrame([], T.StructType([]))
    df = parsed(lines.where(good))
    order = [k for k in _key_order(n["first"]) if k in df.columns]
    return df.select(*[f"`{c}`" for c in order + [c for c in df.columns if c not in order]])


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """Column and row limits reach the scan."""
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df.limit(max_rows) if max_rows else df


def schema_info(df: DataFrame) -> dict[str, dict]:
    """Logical type, nullability and physical type of each column."""
    names = {
        "byte": "integer", "short": "integer", "integer": "integer", "long": "integer", "float": "float", "double": "float", "string": "string", "boolean": "boolean",
        "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime", "binary": "string", "array": "array", "map": "object", "struct": "object",
    }
    return {f.name: {"type": "decimal" if isinstance(f.dataType, T.DecimalType) else names.get(f.dataType.typeName(), "string"), "nullable": f.nullable, "original_type": f.dataType.simpleString()} for f in df.schema}


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Files with their size and rows."""
    df = spark.read.parquet(path)
    return df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count("*").alias("rows"))


def parquet_valid(head: bytes, tail: bytes, size: int) -> tuple[bool, list[str]]:
    """The magic number at both ends, and a size that makes sense."""
    notes = []
    if head[:4] != b"PAR1":
        notes.append("the file doesn't begin with PAR1")
    if tail[-4:] != b"PAR1":
        notes.append("the file doesn't end with PAR1")
    if size < 100:
        notes.append("the file is very small")
    return head[:4] == b"PAR1" and tail[-4:] == b"PAR1" and size >= 12, notes


def parquet_check(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    """``parquet_valid`` of a real file's two ends."""
    return parquet_valid(*ends(spark, path))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():  # type: ignore[union-attr]
        n = n * 26 + ord(ch) - 64
    return n - 1


def xlsx_rows(data: bytes, sheet: str | int | None = None) -> list[list[str | None]]:
    """Cells of a sheet by name or number, the first one if there is none
    such; results of formulas, plain text of rich text, ISO dates."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        tree = lambda name: ElementTree.fromstring(book.read(name))
        names = set(book.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        sheets = [(s.get("name"), s.get(_REL)) for s in tree("xl/workbook.xml").iter(f"{_NS}sheet")]
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        at = next((i for i, (n, _) in enumerate(sheets) if n == sheet), sheet if isinstance(sheet, int) and 0 <= sheet < len(sheets) else 0)
        dates = set()
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            own = {int(f.get("numFmtId", 0)) for f in styles.iter(f"{_NS}numFmt") if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
            formats = styles.find(f"{_NS}cellXfs")
            dates = {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in own | set(range(14, 23))}
        path = targets[sheets[at][1]].lstrip("/")
        rows: list[list[str | None]] = []
        for row in tree(path if path.startswith("xl/") else f"xl/{path}").iter(f"{_NS}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{_NS}c"):
                i = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (i + 1 - len(cells))
                v, kind = c.find(f"{_NS}v"), c.get("t")
                if kind == "inlineStr":
                    cells[i] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None and v.text is not None:
                    text = v.text
                    if kind == "s":
                        text = shared[int(text)]
                    elif kind == "b":
                        text = "true" if text == "1" else "false"
                    elif kind is None and int(c.get("s", 0)) in dates:
                        text = (datetime(1899, 12, 30) + timedelta(days=float(text))).isoformat(timespec="milliseconds") + "Z"
                    cells[i] = text
            rows.append(cells)
        return [r for r in rows if any(x not in (None, "") for x in r)]


def xlsx(spark: SparkSession, data: bytes, sheet: str | int | None = None, header: bool = True) -> DataFrame:
    """S13 as a DataFrame of texts.  Workbooks are read on the driver: the
    format holds at most 2^20 rows."""
    rows = xlsx_rows(data, sheet)
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    width = max(map(len, rows))
    names = [n or f"column_{i + 1}" for i, n in enumerate((rows.pop(0) + [None] * width)[:width])] if header else [f"column_{i + 1}" for i in range(width)]
    return spark.createDataFrame([tuple((r + [None] * width)[:width]) for r in rows], T.StructType([T.StructField(n, T.StringType()) for n in names]))


def read(spark: SparkSession, cfg: RunConfig) -> Dataset:
    """Resolve, fetch, decode, detect, parse.  An unknown format is read
    as CSV with a warning; ``xls`` is refused (D4)."""
    where, warnings = detect.place(cfg), []
    url = detect.resolve_url(cfg.url) if cfg.url else None
    remote = bool(url and re.match("https?://", url))
    raw = fetch(url or "") if remote else detect.decode(cfg.base64 or "") if where == "base64" else None
    if raw is not None and len(raw) > WARN_BYTES:
        warnings.append(f"{human_size(len(raw))} are held on the driver")
    kind = detect.detect(cfg, raw)
    if remote and cfg.format == "auto" and raw is not None and detect.from_bytes(raw[:4096]) in ("parquet", "xlsx", "xls"):
        kind = detect.from_bytes(raw[:4096])
    if kind == "xls":
        raise make("unsupported_format", "xls")
    if kind not in ("csv", "json", "jsonl", "xlsx", "parquet"):
        warnings.append(f"unknown format {kind!r}; reading as csv")
        kind = "csv"
    path = None if raw is not None or where == "data" else url
    text = None
    if path is None and kind not in ("xlsx", "parquet"):
        text = cfg.data if raw is None else raw.decode(detect.encoding(raw) if cfg.encoding == "utf-8" else cfg.encoding, errors="replace")
    if kind == "csv":
        df = csv(spark, path, text, cfg.has_header, cfg.delimiter, cfg.encoding)
    elif kind == "json":
        df = json_rows(spark, path, text)
    elif kind == "jsonl":
        df = jsonl(spark, path, text)
    elif kind == "xlsx":
        if raw is None:
            if ends(spark, path, 0)[2] > MOST_BYTES:
                raise make("parse_failed", f"workbooks over {human_size(MOST_BYTES)} aren't read")
            raw = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
        df = xlsx(spark, raw, cfg.sheet, cfg.has_header)
    elif path is not None:
        df = parquet(spark, path)
    else:
        import pyarrow.parquet as pq

        df = spark.createDataFrame(pq.read_table(io.BytesIO(raw or b"")))
    ds = Dataset.of(df, None, {"source": where, "format": kind, "warnings": warnings})
    if ROW in ds.headers:
        ds.headers.remove(ROW)
    return ds
