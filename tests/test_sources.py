import base64
import io
import zipfile

import pytest

from truegrain.config import ColumnRule, RunConfig, check
from truegrain.errors import QualityError, delay, make, retry, safely
from truegrain.functions.text import escape_html, mask_url, poly_hash, sanitize_text
from truegrain.sources import connectors, detect, readers, sinks


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("text", "want", "names"),
    [
        ("name,age\nJohn,30\nJane,25", [("John", "30"), ("Jane", "25")], ["name", "age"]),
        ('a,b\n"x, y","he said ""hi"""\n', [("x, y", 'he said "hi"')], ["a", "b"]),
        ('a,b\n"line\nbreak",2', [("line\nbreak", "2")], ["a", "b"]),
        ("﻿a,b\r\n1,2\r\n", [("1", "2")], ["a", "b"]),
        ("a;b\n1;2\n3;4", [("1", "2"), ("3", "4")], ["a", "b"]),
        ("名,город\n東京,Москва", [("東京", "Москва")], ["名", "город"]),
    ],
)
def test_csv_text(spark, text, want, names):
    df = readers.csv(spark, text=text)
    assert df.columns == names
    assert rows(df) == want


def test_csv_without_header_and_files(spark, tmp_path):
    assert readers.csv(spark, text="1,2\n3,4", header=False).columns == ["column_1", "column_2"]
    assert readers.csv(spark, text="a,b").count() == 0
    path = tmp_path / "x.csv"
    path.write_text('a,b\n"q, ""r""",2\n"two\nlines",3\n')
    assert rows(readers.csv(spark, f"file://{path}")) == [('q, "r"', "2"), ("two\nlines", "3")]


@pytest.mark.parametrize(("n", "bad", "fatal"), [(10, 1, False), (10, 6, True), (0, 1, True), (1, 1, False), (1, 2, True)])
def test_csv_triage(n, bad, fatal):
    assert detect.csv_fatal(n, bad) is fatal


def test_json(spark):
    assert rows(readers.json_rows(spark, text='[{"b":1,"a":"x"},{"b":2,"a":"y"},3]')) == [(1, "x"), (2, "y")]
    assert rows(readers.json_rows(spark, text='{"data":[{"a":1}]}')) == [(1,)]
    assert rows(readers.json_rows(spark, text='{"a":1}')) == [(1,)]
    assert readers.json_rows(spark, text="[]").count() == 0
    assert rows(readers.jsonl(spark, text='{"a":1}\n\n{"a":2}\nbad\n{"a":3}')) == [(1,), (2,), (3,)]
    with pytest.raises(QualityError):
        readers.jsonl(spark, text='{"a":1}\nbad\nbad')


def workbook() -> bytes:
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>name</t></si><si><r><t>Jo</t></r><r><t>hn</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{ns}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>day</t></is></c><c r="C1" t="str"><v>ok</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>45292</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1"><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_xlsx(spark):
    df = readers.xlsx(spark, workbook())
    assert df.columns == ["name", "day", "ok"]
    assert rows(df) == [("John", "2024-01-01T00:00:00.000Z", "true")]
    assert readers.xlsx_rows(workbook(), "Two") == [["7"]]
    assert readers.xlsx_rows(workbook(), "Three")[0][0] == "name"


def test_detection():
    assert detect.from_url("https://x/y.ndjson?a=1") == "jsonl"
    assert detect.from_url("https://x/y") == "csv"
    assert [detect.from_text(t) for t in ("a,b", '[{"a":1}]', '{"a":1}\n{"a":2}')] == ["csv", "json", "jsonl"]
    assert detect.from_bytes(b"PAR1xxx") == "parquet"
    assert detect.from_bytes(b"\xd0\xcf\x11\xe0") == "xls"
    assert detect.encoding(b"\xff\xfea\x00") == "utf-16le"
    assert detect.encoding("é".encode("latin1") + b"abcdef") == "latin1"
    assert detect.sheet_of("https://docs.google.com/spreadsheets/d/abc_1/edit#gid=5") == {"sheet_id": "abc_1", "gid": "5"}
    assert detect.sheet_export("abc") == "https://docs.google.com/spreadsheets/d/abc/export?format=csv&gid=0"


def test_read(spark):
    ds = readers.read(spark, RunConfig(base64=base64.b64encode(b"a,b\n1,2\n3,4").decode()))
    assert ds.headers == ["a", "b"]
    assert [r["_row"] for r in ds.df.orderBy("_row").collect()] == [1, 2]
    with pytest.raises(QualityError, match="E2002"):
        readers.read(spark, RunConfig(base64=base64.b64encode(b"\xd0\xcf\x11\xe0xxxx").decode()))


def test_parquet(spark, sf, tmp_path):
    df = readers.parquet(spark, f"{sf}/part.parquet", ["p_name", "p_size"], 5)
    assert df.count() == 5
    assert readers.schema_info(df)["p_size"]["type"] == "integer"
    assert readers.parquet_metadata(spark, f"{sf}/part.parquet").first()["rows"] == 200
    assert readers.parquet_valid(b"PAR1", b"PAR1", 1000) == (True, [])
    assert not readers.parquet_valid(b"PARX", b"PAR1", 20)[0]
    sinks.parquet(df, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5
    assert sinks.cloud_path("azure", "c", "/k", "acc") == "abfss://c@acc.dfs.core.windows.net/k"


def test_connectors(spark):
    pages = iter([{"results": [{"id": "1", "properties": {"a": "x"}}], "paging": {"next": {"after": "9"}}}, {"results": [{"id": "2", "properties": {"b": "y"}}]}])
    seen = []

    def get(url, headers):
        seen.append(url)
        return next(pages)

    df = connectors.load(spark, "crm_objects", {"access_token": "t"}, get, object_type="contacts", limit=10)
    assert rows(df) == [("1", "x", None), ("2", None, "y")]
    assert "after=9" in seen[1]
    made = connectors.connector("crm_query", {"instance_url": "u", "access_token": "t"}, lambda u, h: {"records": [{"attributes": {}, "Id": "1"}]})
    assert made.query("Account", ["Id", "Owner.Name"], 5) == "SELECT Id, Owner.Name FROM Account LIMIT 5"
    assert rows(made.load(spark, "Account", ["Id"])) == [("1",)]
    with pytest.raises(QualityError):
        made.query("Account; DROP", ["Id"], 5)
    assert connectors.Payments.flat({"a": {"b": {"c": 1}, "l": [1]}, "d": 2}) == {"a_b_c": 1, "d": 2}
    assert connectors.Bases.rows({"records": [{"id": "r", "createdTime": "t", "fields": {"N": 1}}]}) == [{"id": "r", "createdTime": "t", "N": 1}]
    assert {c["name"] for c in connectors.available()} == set(connectors.REGISTRY)
    with pytest.raises(QualityError):
        connectors.connector("bases", {})


def test_config():
    cfg = RunConfig(data="a", fuzzy_similarity=3, zscore=-1, max_issues=0, outliers="odd")
    notes = check(cfg)
    assert len(notes) == 4
    assert (cfg.fuzzy_similarity, cfg.zscore, cfg.max_issues, cfg.outliers) == (0.85, 3.0, 100, "none")
    with pytest.raises(QualityError, match="E1001"):
        check(RunConfig())
    with pytest.raises(QualityError, match="E4002"):
        check(RunConfig(data="a", schema=[ColumnRule("a"), ColumnRule("a")]))
    rule = ColumnRule.of({"name": "x", "type": "number", "constraints": {"min": 1, "enum": [1, 2]}})
    assert (rule.min, rule.allowed) == (1, ("1", "2"))


def test_errors():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError("connection reset")
        return 7

    assert retry(flaky, sleep=lambda s: None) == 7
    assert [delay(i) for i in range(5)] == [1, 2, 4, 8, 10]
    notes = []
    assert safely(lambda: 1 / 0, "x", notes) == "x"
    assert "E9001" in notes[0]
    with pytest.raises(QualityError):
        retry(lambda: (_ for _ in ()).throw(make("bad_config", "x")), sleep=lambda s: None)


def test_text():
    assert escape_html("<a href='x'>\"&") == "&lt;a href=&#039;x&#039;&gt;&quot;&amp;"
    assert mask_url("https://u:p@h/x?api_key=1&b=2") == "https://***:***@h/x?api_key=***&b=2"
    assert sanitize_text("Hello, World!") == "hello_world"
    assert poly_hash("") == "0"
    assert poly_hash("abc") == "22ci"
