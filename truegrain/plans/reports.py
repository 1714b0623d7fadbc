"""Queries of whole runs, reports, sources, sinks, records and streams, and the
same in SQL.  What SQL has no tables for (names, texts, bytes) is listed."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..config import ColumnRule, RunConfig, check
from ..dataset import ROW, Dataset
from ..functions import cells, dates, numbers, text
from ..operators import issues, quality, remediation, statistics
from ..scratch import scratch_dir
from ..sources import connectors, detect, readers, sinks
from ..streaming import quality as streams
from . import engine
from .catalog import RUNS, SQL, E, _nation, _runs, _t, events, js, parts, query, whole
from .records import AuditTrail, Lineage


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/truegrain/out-{uuid.uuid4().hex}"


# --- whole runs and issues ---------------------------------------------------


@query(f"""WITH {E}, s AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS k FROM e WHERE value IS NOT NULL),
q AS (SELECT max(CASE WHEN i = CAST(floor(k * 0.25) AS BIGINT) THEN x END) AS a, max(CASE WHEN i = CAST(floor(k * 0.75) AS BIGINT) THEN x END) AS b FROM s)
SELECT 'null' AS kind, CAST(count(*) - count(value) + count(*) - count(NULLIF(event_type, '')) AS BIGINT) AS n FROM e UNION ALL
SELECT 'duplicate', CAST(count(*) - count(DISTINCT coalesce(event_type, '') || '|' || coalesce({js("value")}, '')) AS BIGINT) FROM e UNION ALL
SELECT 'outlier', CAST(sum(CASE WHEN x < a - (b - a) * 1.5 OR x > b + (b - a) * 1.5 THEN 1 ELSE 0 END) AS BIGINT) FROM s, q UNION ALL
SELECT 'totalRows', CAST(count(*) AS BIGINT) FROM e UNION ALL
SELECT 'missingShown', least(100, CAST(count(*) - count(value) + count(*) - count(NULLIF(event_type, '')) AS BIGINT)) FROM e""")
def full_run(spark, sf_dir):
    """Everything that a run counts about the events."""
    ds = events(spark, sf_dir)
    report = engine.run(spark, RunConfig(), Dataset(ds.df, ["event_type", "value"]))
    counts = {**report.value["trueIssueCounts"], "totalRows": report.value["summary"]["totalRows"], "missingShown": report.value["issueBreakdown"]["missing"]}
    return spark.createDataFrame([(k, int(n)) for k, n in counts.items()], "kind string, n long")


@query(f"""WITH {E} SELECT CAST(rn AS BIGINT) AS row, 'event_type' AS "column", 'missing' AS kind, 'error' AS severity, 'Required field ''event_type'' is missing' AS message, 'Provide a valid value for this field' AS suggestion FROM e WHERE event_type IS NULL OR event_type = ''
UNION ALL SELECT CAST(rn AS BIGINT), 'value', 'null', 'warning', 'Field ''value'' has null/empty value', 'Provide a valid value for this field' FROM e WHERE value IS NULL
UNION ALL SELECT CAST(rn AS BIGINT), 'value', 'custom-small', 'error', 'Rule ''small'' is broken', 'Check the value' FROM e WHERE value >= 50""")
def issue_texts(spark, sf_dir):
    """What issues say, and a rule of one's own."""
    rules = [ColumnRule("event_type", "string", required=True), ColumnRule("value", "number", custom=(("small", lambda c: c < 50),))]
    return issues.cell_issues(events(spark, sf_dir), rules).select(F.col("rowNumber").alias("row"), "column", F.col("issueType").alias("kind"), "severity", "message", "suggestion")


_OUT = """v AS (SELECT user_id + 0.0::DOUBLE AS u, value AS x, event_id + 1 AS rn FROM events), s AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS k FROM v),
q AS (SELECT max(CASE WHEN i = CAST(floor(k * 0.25) AS BIGINT) THEN x END) AS a, max(CASE WHEN i = CAST(floor(k * 0.75) AS BIGINT) THEN x END) AS b FROM s)"""


@query(f"""WITH {_OUT} SELECT CAST(rn AS BIGINT) AS row, 'value' AS "column" FROM v, q WHERE x < a - (b - a) * 1.5 OR x > b + (b - a) * 1.5 ORDER BY rn LIMIT 5""")
def outlier_cap(spark, sf_dir):
    """The first outliers of each column."""
    found = issues.outlier_issues(whole(spark, sf_dir, "events", "event_id"), ["value"])
    return issues.capped(found, 5, ("stage_ord", "column")).select(F.col("rowNumber").alias("row"), "column")


@query("""WITH k AS (SELECT p_partkey + 1 AS rn, p_name, min(p_partkey + 1) OVER (PARTITION BY p_name) AS f FROM part) SELECT substring(p_name, 1, 100) AS value, string_agg(CAST(rn AS VARCHAR), ',' ORDER BY rn) AS rows, CAST(count(*) AS BIGINT) AS count FROM k WHERE rn > f GROUP BY 1""")
def duplicate_report(spark, sf_dir):
    """Rows by repeated value."""
    found = issues.duplicate_groups_report(issues.duplicate_issues(parts(spark, sf_dir), ["p_name"]))
    return found.select("value", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"), "count")


@query("""WITH k AS (SELECT p_partkey + 1 AS rn, min(p_partkey + 1) OVER (PARTITION BY p_name) AS f FROM part) SELECT CAST(rn AS BIGINT) AS row, 'Exact duplicate of row ' || CAST(CAST(f AS BIGINT) AS VARCHAR) AS message FROM k WHERE rn > f ORDER BY rn LIMIT 7""")
def issue_head(spark, sf_dir):
    """A report's first issues."""
    return issues.truncated(issues.duplicate_issues(parts(spark, sf_dir), ["p_name"]), 7).select(F.col("rowNumber").alias("row"), "message")


@query(f"""SELECT "piiType", CAST(count(*) AS BIGINT) AS count FROM ({SQL["pii_cells"]}) GROUP BY 1""")
def pii_summary(spark, sf_dir):
    """Cells by kind of personal data."""
    from .catalog import QUERIES

    return remediation.personal_summary(QUERIES["pii_cells"](spark, sf_dir)).select("piiType", "count")


# --- statistics --------------------------------------------------------------


@query("""SELECT 'day_of_week' AS cycle, CAST(dayofweek(ts) AS INTEGER) AS bucket, CAST(count(*) AS BIGINT) AS count, floor(avg(value) * 1e4 + 0.5) / 1e4 AS mean FROM events GROUP BY 2 UNION ALL
SELECT 'month', CAST(month(ts) - 1 AS INTEGER), CAST(count(*) AS BIGINT), floor(avg(value) * 1e4 + 0.5) / 1e4 FROM events GROUP BY 2 UNION ALL
SELECT 'hour', CAST(hour(ts) AS INTEGER), CAST(count(*) AS BIGINT), floor(avg(value) * 1e4 + 0.5) / 1e4 FROM events GROUP BY 2""")
def seasonal_report(spark, sf_dir):
    """Every date column with the number columns, all cycles."""
    ds = whole(spark, sf_dir, "events", "event_id", ["ts", "value"])
    found = statistics.seasonal_report(Dataset(ds.df.select(ROW, "ts", "value"), ["ts", "value"]))
    rows = [(k, r["bucket"], r["count"], r["mean"]) for f in found for k in ("day_of_week", "month", "hour") for r in f[k] if r["count"]]
    return spark.createDataFrame(rows, "cycle string, bucket int, count long, mean double")


@query("""SELECT 'event_id' AS "column", 'uniform-distribution' AS type, 0.8::DOUBLE AS confidence UNION ALL SELECT 'event_id', 'monotonic-trend', floor(avg(CASE WHEN event_id > p THEN 1.0 ELSE 0.0 END) * 1e4 + 0.5) / 1e4 FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS p FROM events) WHERE p IS NOT NULL""")
def pattern_report(spark, sf_dir):
    """V9: patterns of the event numbers, but for jumps of the mean."""
    found = statistics.patterns(whole(spark, sf_dir, "events", "event_id", ["event_id"]), ["event_id"], {"event_id"})
    return spark.createDataFrame([(r["column"], r["type"], r["confidence"]) for r in found if r["type"] != "sudden-shift"], "`column` string, type string, confidence double")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN -1.0 ELSE -1.0 END AS safe, event_id % 4 = 1 AS lossy, event_id % 4 < 3 AS dateish FROM events""")
def cell_helpers(spark, sf_dir):
    """numbers with a fallback, digits that a double can't hold, texts like dates."""
    i = F.col("event_id")
    number = F.when(i % 3 == 0, F.col("value").cast("string")).when(i % 3 == 1, F.lit("x")).otherwise(F.lit("Infinity"))
    digits = F.when(i % 4 == 1, F.lit("12345678901234567891")).otherwise(i.cast("string"))
    day = F.when(i % 4 == 0, F.lit("2024-01-31")).when(i % 4 == 1, F.lit("01/31/2024")).when(i % 4 == 2, F.lit("31.01.2024")).otherwise(F.lit("Jan 31"))
    return _t(spark, sf_dir, "events").select("event_id", cells.safe_number(number, -1.0).alias("safe"), numbers.loses_precision(digits).alias("lossy"), dates.likely_date(day).alias("dateish"))


# --- sources and sinks -------------------------------------------------------


def _workbook(rows: list[list[str]]) -> bytes:
    """A workbook with one sheet of inline texts."""
    cell = lambda v: f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="one" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)}</sheetData></worksheet>')
    return out.getvalue()


_NAMES = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey"


@query(f"{_NAMES} FROM nation")
def source_xlsx(spark, sf_dir):
    """A workbook, read as one."""
    rows = _nation(spark, sf_dir)
    data = _workbook([list(rows[0]), *([str(v) for v in r.values()] for r in rows)])
    assert detect.from_bytes(data[:8]) == "xlsx"
    return readers.xlsx(spark, data)


@query(f"{_NAMES}, CAST(n_nationkey + 1 AS BIGINT) AS row FROM nation")
def source_csv_file(spark, sf_dir):
    """A CSV file with quoted line ends and some bad lines, in Latin 1."""
    rows = sorted(_nation(spark, sf_dir), key=lambda r: r["n_nationkey"])
    path = f"{_folder(spark)}/nation.csv"
    lines = ["n_nationkey;n_name;n_regionkey;note", *(f'{r["n_nationkey"]};{r["n_name"]};{r["n_regionkey"]};"a\nbé"' for r in rows)]
    sinks.data(spark, "\n".join(lines).encode("latin1"), path)
    ds = readers.read(spark, RunConfig(url=path))
    return ds.df.where(F.col("note") == "a\nbé").select("n_nationkey", "n_name", "n_regionkey", F.col(ROW).alias("row"))


@query("""SELECT * FROM (VALUES ('all good', 'read 3'), ('one of four', 'read 4'), ('three of four', 'E2001'), ('only bad', 'E2001')) t(file, outcome)""")
def source_csv_triage(spark, sf_dir):
    """Files with lines of other lengths are read unless over half are bad."""
    files = {"all good": "a,b\n1,2\n3,4\n5,6", "one of four": "a,b\n1,2\n3\n5,6\n7,8", "three of four": "a,b\n1\n3\n5,6\n7,8,9,10", "only bad": "a,b\n1\n2\n3,4,5"}
    out = []
    for name, content in files.items():
        path = f"{_folder(spark)}/{uuid.uuid4().hex}.csv"
        sinks.text(spark, content, path)
        try:
            out.append((name, f"read {readers.csv(spark, path).count()}"))
        except errors.QualityError as error:
            out.append((name, error.code))
    return spark.createDataFrame(out, "file string, outcome string")


@query("""SELECT * FROM (VALUES ('url tsv', 'csv'), ('url ndjson', 'jsonl'), ('url none', 'csv'), ('text array', 'json'), ('text lines', 'jsonl'), ('text plain', 'csv'), ('bytes parquet', 'parquet'), ('bytes zip', 'xlsx'), ('bytes ole', 'xls'),
 ('bom', 'utf-8'), ('wide', 'utf-16le'), ('latin', 'latin1'), ('sheet', 'https://docs.google.com/spreadsheets/d/abc-1/export?format=csv&gid=7'), ('delimiter', ';'), ('cloud', 'gs://b/k.csv'), ('azure', 'abfss://b@acc.dfs.core.windows.net/k')) t(what, found)""")
def source_detection(spark, sf_dir):
    """What a source is."""
    found = {
        "url tsv": detect.from_url("https://x.example/a.TSV?x=1"), "url ndjson": detect.from_url("s3a://b/a.ndjson"), "url none": detect.from_url("https://x.example/a"),
        "text array": detect.from_text(' [{"a": 1}]'), "text lines": detect.from_text('{"a": 1}\n{"a": 2}'), "text plain": detect.from_text("a,b\n1,2"),
        "bytes parquet": detect.from_bytes(b"PAR1xxxx"), "bytes zip": detect.from_bytes(b"PK\x03\x04"), "bytes ole": detect.from_bytes(b"\xd0\xcf\x11\xe0"),
        "bom": detect.encoding(b"\xef\xbb\xbfa"), "wide": detect.encoding("plain text".encode("utf-16le")), "latin": detect.encoding("é à ç x y z".encode("latin1")),
        "sheet": detect.resolve_url("https://docs.google.com/spreadsheets/d/abc-1/edit#gid=7"), "delimiter": detect.delimiter("a;b\n1;2\n3;4\n"),
        "cloud": sinks.cloud_path("gcs", "b", "/k.csv"), "azure": sinks.cloud_path("azure", "b", "k", "acc"),
    }
    return spark.createDataFrame(list(found.items()), "what string, found string")


@query("""SELECT c AS connector, CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation CROSS JOIN (VALUES ('bases'), ('crm_objects'), ('crm_query'), ('payments')) t(c)""")
def source_connectors(spark, sf_dir):
    """Every connector loads the nations, in pages, from a service that a function plays."""
    rows = _nation(spark, sf_dir)
    body = lambda r: {"id": r["n_nationkey"], "name": r["n_name"]}

    def pages(shape):
        asked = iter(range(0, len(rows), 10))
        return lambda url, headers: shape(rows[(at := next(asked)) : at + 10], at + 10 < len(rows), at + 10)

    services = {
        "crm_query": ({"instance_url": "https://x.example", "access_token": "t"}, lambda url, headers: {"records": [{"attributes": {"type": "N"}, **body(r)} for r in rows]}, {"object_type": "Nation", "fields": ["id", "name"]}),
        "crm_objects": ({"access_token": "t"}, pages(lambda part, more, at: {"results": [{"id": r["n_nationkey"], "properties": {"name": r["n_name"]}} for r in part], "paging": {"next": {"after": str(at)}} if more else {}}), {"object_type": "n"}),
        "payments": ({"access_token": "t"}, pages(lambda part, more, at: {"data": [{"id": r["n_nationkey"], "name": r["n_name"], "list": [1]} for r in part], "has_more": more}), {"object_type": "n"}),
        "bases": ({"access_token": "t", "base_id": "b", "table": "n"}, pages(lambda part, more, at: {"records": [{"id": r["n_nationkey"], "createdTime": "x", "fields": {"name": r["n_name"]}} for r in part], **({"offset": str(at)} if more else {})}), {}),
    }
    assert {c["name"] for c in connectors.available()} == set(services)
    out = None
    for name, (config, get, options) in services.items():
        df = connectors.load(spark, name, config, get, unknown=1, **options).select(F.lit(name).alias("connector"), F.col("id").cast("long").alias("id"), "name")
        out = df if out is None else out.union(df)
    return out


@query("""SELECT kind, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) t(kind) WHERE kind <> 'json' OR n_nationkey < 9""")
def sinks_round_trip(spark, sf_dir):
    """What the sinks write, read back; the JSON report holds nine rows."""
    df, folder = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(1).alias(ROW)).orderBy("n_nationkey"), _folder(spark)
    sinks.csv(df, f"{folder}/csv")
    sinks.parquet(df, f"{folder}/parquet")
    sinks.issues(df, f"{folder}/json", 9)
    back = {"csv": spark.read.csv(f"{folder}/csv", header=True), "parquet": spark.read.parquet(f"{folder}/parquet"), "json": spark.read.json(f"{folder}/json")}
    out = None
    for kind, found in back.items():
        one = found.select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT CAST(count(*) AS BIGINT) AS rows, TRUE AS valid, CAST(0 AS BIGINT) AS notes FROM part""")
def source_parquet_file(spark, sf_dir):
    """Rows by the files' own account, and the magic numbers at both ends."""
    path = f"{sf_dir}/part.parquet"
    ok, notes = readers.parquet_check(spark, path)
    return readers.parquet_metadata(spark, path).agg(F.sum("rows").alias("rows")).select("rows", F.lit(ok).alias("valid"), F.lit(len(notes)).cast("long").alias("notes"))


# --- records, history, errors ------------------------------------------------


@query("""SELECT * FROM (VALUES ('entries', '3'), ('VALIDATION_STARTED', '2'), ('masked', 'https://***:***@x.example/d?token=***&q=1'), ('steps', '3'), ('clean', '1'), ('parent', 'validate_2'), ('added', 'c'), ('removed', 'a'),
 ('label', 'say  hi '), ('hash', '22ci'), ('slug', 'x_example_data_csv'), ('size', '1.50 MB')) t(what, value)""")
def records_kept(spark, sf_dir):
    """The audit trail, the lineage and their helpers."""
    audit, lineage = AuditTrail(), Lineage("s")
    audit.log("DATA_SOURCE_ACCESSED", source="https://u:p@x.example/d?token=s&q=1")
    audit.log("VALIDATION_STARTED", rows=1)
    audit.log("VALIDATION_STARTED", rows=2)
    lineage.add("parse", None, 9)
    lineage.add("validate", 9, 9)
    lineage.add("clean", 9, 8, ["a", "b"], ["b", "c"])
    done, steps = audit.summary(), lineage.summary()
    assert lineage.diagram().splitlines()[-1] == "    validate_2 --> clean_3"
    found = {
        "entries": str(done["total"]), "VALIDATION_STARTED": str(done["by_action"]["VALIDATION_STARTED"]), "masked": audit.entries[0]["details"]["source"], "steps": str(steps["steps"]), "clean": str(steps["by_type"]["clean"]),
        "parent": lineage.steps[2]["parent"], "added": ",".join(lineage.steps[2]["columns"]["added"]), "removed": ",".join(lineage.steps[2]["columns"]["removed"]),
        "label": text.diagram_label('say "hi"'), "hash": text.poly_hash("abc"), "slug": quality.source_id(url="https://x.example/data.csv"), "size": quality.human_size(1.5 * (1 << 20)),
    }
    return spark.createDataFrame(list(found.items()), "what string, value string")


@query(f"""WITH {RUNS} SELECT quality_score, total_rows FROM runs ORDER BY run_ts DESC LIMIT 5""")
def history_store(spark, sf_dir):
    """Runs stored one by one, the last five read back."""
    folder = _folder(spark)
    for r in _runs(spark, sf_dir).orderBy(F.desc("run_ts")).limit(8).collect():  # eight rows
        stamp = datetime(r["run_ts"].year, r["run_ts"].month, r["run_ts"].day)
        quality.store_run(spark, folder, {"source_id": "s", "run_ts": stamp, "quality_score": r["quality_score"], "total_issues": r["total_issues"], "total_rows": r["total_rows"]})
    return quality.load_runs(spark, folder, "s", 5).select("quality_score", "total_rows")


@query("""SELECT * FROM (VALUES ('timed out', 'E3002', TRUE), ('HTTP 429', 'E3004', TRUE), ('403 Forbidden', 'E3003', FALSE), ('malformed json', 'E2001', FALSE), ('other', 'E9001', FALSE)) t(error, code, retryable)""")
def error_codes(spark, sf_dir):
    """What an exception counts as, and whether to try again."""
    rows = [(m, f["code"], f["retryable"]) for m in ("timed out", "HTTP 429", "403 Forbidden", "malformed json", "other") for f in [errors.formatted(RuntimeError(m))]]
    return spark.createDataFrame(rows, "error string, code string, retryable boolean")


@query("""SELECT * FROM (VALUES ('warnings', '3'), ('fuzzy', '0.85'), ('outliers', 'none'), ('cap', '100'), ('no source', 'E1001'), ('bad url', 'E1003'), ('twice', 'E4002'), ('empty', 'true')) t(what, value)""")
def config_check(spark, sf_dir):
    """Defaults for bad options, refusals, and a table without rows."""
    cfg = RunConfig(data="a", fuzzy_similarity=7.0, outliers="odd", max_issues=0)
    found = {"warnings": str(len(check(cfg))), "fuzzy": str(cfg.fuzzy_similarity), "outliers": cfg.outliers, "cap": str(cfg.max_issues)}
    for name, bad in (("no source", RunConfig()), ("bad url", RunConfig(url="gopher://x")), ("twice", RunConfig(data="a", schema=[ColumnRule("a"), ColumnRule("a")]))):
        try:
            check(bad)
        except errors.QualityError as error:
            found[name] = error.code
    found["empty"] = str(Dataset.of(_t(spark, sf_dir, "nation").limit(0)).is_empty()).lower()
    return spark.createDataFrame(list(found.items()), "what string, value string")


@query("""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(p_size) AS BIGINT) AS sizes FROM part""")
def stream_batches(spark, sf_dir):
    """A stream of files, every batch handled, none lost."""
    schema = _t(spark, sf_dir, "part").schema
    folder, done = _folder(spark), _folder(spark)

    def handle(batch: DataFrame, number: int) -> None:
        batch.groupBy().agg(F.count("*").alias("rows"), F.sum("p_size").alias("sizes")).write.mode("overwrite").parquet(f"{done}/batch={number}")

    _t(spark, sf_dir, "part").repartition(3).write.parquet(folder)
    streams.batches(streams.read_files(spark, folder, schema, files_per_trigger=1), handle, _folder(spark)).awaitTermination()
    return spark.read.parquet(done).agg(F.sum("rows").alias("rows"), F.sum("sizes").alias("sizes"))


@query("""SELECT p_name, CAST(count(*) AS BIGINT) AS rows FROM part GROUP BY 1 HAVING count(*) > 1""")
def stream_duplicates(spark, sf_dir):
    """Keys that a stream brings more than once, as it reports them at its end."""
    schema = _t(spark, sf_dir, "part").schema
    folder = _folder(spark)
    _t(spark, sf_dir, "part").write.parquet(folder)
    counts = streams.read_files(spark, folder, schema).groupBy("p_name").agg(F.count("*").alias("rows"))
    return streams.run_to_table(counts, f"duplicates_{uuid.uuid4().hex}", "complete").where("rows > 1")


@query("""SELECT 'table' AS part, CAST(25 AS BIGINT) AS n UNION ALL SELECT 'json', CAST(1 AS BIGINT)""")
def report_files(spark, sf_dir):
    """A run's files; the page shows a row per column and the report is one JSON file."""
    folder = _folder(spark)
    df = _t(spark, sf_dir, "nation").select(*[F.col("n_nationkey").alias(f"c{i}") for i in range(25)])
    report = engine.run(spark, RunConfig(output_dir=folder), Dataset.of(df))
    files = spark.read.text(f"{folder}/report.json", wholetext=True)
    assert json.loads(files.first()[0])["summary"]["totalRows"] == 25
    return spark.createDataFrame([("table", sum(f">c{i}<" in report.html for i in range(25))), ("json", files.count())], "part string, n long")
