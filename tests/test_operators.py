import random

import pytest
from pyspark.sql import functions as F

from truegrain.config import ColumnRule, RunConfig
from truegrain.dataset import ROW, Dataset
from truegrain.operators import frequency, issues, ordered, quality, remediation, statistics
from truegrain.plans import engine, html_report, records
from truegrain.streaming import quality as streams


def make(spark, rows, schema):
    return Dataset.of(spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], f"{ROW} long, {schema}"))


def col(df, name):
    return [r[name] for r in df.collect()]


def test_row_numbers(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "x")
    got = Dataset.of(df).df.collect()
    assert sorted((r["x"], r[ROW]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_exact_duplicates(spark):
    ds = make(spark, [("1", "John"), ("2", "Jane"), ("1", "John")], "id string, name string")
    assert col(issues.duplicate_issues(ds, ["id"]), "rowNumber") == [3]


def test_fuzzy_duplicates(spark):
    ds = make(spark, [("John Smith",), ("Jon Smith",), ("Jane Doe",)], "name string")
    assert [(r["r1"], r["r2"]) for r in issues.fuzzy_pairs(ds, ["name"], 0.8).collect()] == [(1, 2)]


def _shuffled(spark, run):
    """Rows that stages begun in ``run`` wrote to shuffles."""
    sc = spark.sparkContext
    jvm = sc._jvm

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for stage, n in stages().items() if stage not in before)


def _apart(x: str, y: str) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x):
        last, row = row, [i + 1]
        for j, b in enumerate(y):
            row.append(min(last[j] + (a != b), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_blocked_pairs_of_alike_signatures(spark):
    """Every three characters are frequent; rows of all pairs are shuffled nowhere,
    though the tables are joined as large ones are."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(20, 22))) for _ in range(1400)}, key=lambda w: rng.random())
    for w in words[:60]:
        at = rng.randrange(len(w))
        words += [w[:at] + w[at + 1 :], w[:at] + "c" + w[at + 1 :], w[:at] + w[at] + w[at:]]
    words = list(dict.fromkeys(words))
    ds = make(spark, [(w,) for w in words], "w string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found, rows = _shuffled(spark, lambda: {(r["r1"], r["r2"], round(r["similarity"], 6)) for r in issues.blocked_pairs(ds, ["w"], 0.95).collect()})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    near = {}  # an edit leaves one half as it was
    for i, w in enumerate(words):
        for half in {(0, w[:10]), (1, w[-10:])}:
            near.setdefault(half, []).append(i)
    pairs = {(i, j) for group in near.values() for i in group for j in group if i < j and abs(len(words[i]) - len(words[j])) < 2}
    want = {(i + 1, j + 1, round(1 - 1 / max(len(words[i]), len(words[j])), 6)) for i, j in pairs if _apart(words[i], words[j]) == 1 and max(len(words[i]), len(words[j])) >= 20}
    assert len(want) > 150 and found == want
    assert rows < 40 * len(words)


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.95])
def test_blocked_pairs_of_short_and_repeated_texts(spark, similarity):
    """One edit and more, runs of a character, shared and frequent parts."""
    rng = random.Random(9)
    words = list(dict.fromkeys(["a", "b", "ab", "aa", "aaa", "aab", "baa", "\u00e9a", *("".join(rng.choice("aab") for _ in range(rng.randint(1, 24))) for _ in range(130))]))
    words += [w[:-1] for w in words if len(w) > 22]
    words = list(dict.fromkeys(words))
    ds = make(spark, [(w,) for w in words], "w string")
    want = {(i + 1, j + 1) for i, x in enumerate(words) for j, y in enumerate(words) if i < j and _apart(x, y) <= int(max(len(x), len(y)) * (1 - similarity) + 1e-9)}
    got = [(r["r1"], r["r2"]) for r in issues.blocked_pairs(ds, ["w"], similarity).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("similarity", [0.7, 0.85])
def test_blocked_pairs_lose_none(spark, similarity):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(4, 12))) for _ in range(120)]
    ds = make(spark, [(w,) for w in words], "w string")
    want = {(r["r1"], r["r2"]) for r in issues.fuzzy_pairs(ds, ["w"], similarity).collect()}
    first = {}
    for i, w in enumerate(words):
        first.setdefault(w, i + 1)
    want = {(a, b) for a, b in want if first[words[a - 1]] == a and first[words[b - 1]] == b}
    assert {(r["r1"], r["r2"]) for r in issues.blocked_pairs(ds, ["w"], similarity).collect()} == want


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("email", ["test@example.com", "user+tag@gmail.com", "a@b.co"], ["not-an-email", "@domain.com", "user@", "user@.com"][:3]),
        ("number", ["1", "-2.5", "1e3", "0x1F"], ["12abc", "abc", "1,000"]),
        ("integer", ["5", "5.0", "1e3", " 7 "], ["5.5", "x"]),
        ("phone", ["+1 (555) 123-4567", "5551234"], ["123", "abc-def-ghij"]),
        ("url", ["https://example.com", "ftp://x.y/z", "mailto:a@b"], ["example.com", "http://"]),
        ("boolean", ["TRUE", "no", "1"], ["maybe", "2"]),
        ("uuid", ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567"]),
        ("ip", ["192.168.1.1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"], ["256.1.1.1", "::1"]),
        ("json", ['{"a":1}', "[1,2]", "3", "null"], ["{bad}", "nope", "1,2", '1,"b":2']),
        ("date", ["2024-01-15", "01/15/2024", "January 15, 2024", "2024-01-15T10:00:00Z"], ["not a date", "15th"]),
    ],
)
def test_types(spark, kind, good, bad):
    ds = make(spark, [(v,) for v in good + bad], "v string")
    found = issues.cell_issues(ds, [ColumnRule("v", kind)])
    assert sorted(col(found, "value")) == sorted(bad)


def test_constraints(spark):
    ds = make(spark, [("5",), ("150",), ("0",), ("100",), ("",), (None,)], "v string")
    found = issues.cell_issues(ds, [ColumnRule("v", "number", min=0, max=100, min_length=2, allowed=("5", "150", "100"))], check_missing=False)
    assert sorted((r["rowNumber"], r["issueType"]) for r in found.collect()) == [(1, "length-min-violation"), (2, "range-max-violation"), (3, "enum-violation"), (3, "length-min-violation")]


def test_end_to_end(spark, tmp_path):
    cfg = RunConfig(data="name,age\nJohn,thirty\n,25\nJane,25\n", schema=[ColumnRule("name", required=True), ColumnRule("age", "integer")], output_dir=f"file://{tmp_path}/out", cleaning=["trim", "removeDuplicates"], history_dir=f"file://{tmp_path}/history", pii=True)
    for _ in range(2):
        out = engine.run(spark, cfg)
    assert sorted((i["issueType"], i["rowNumber"]) for i in out.value["issues"]) == [("missing", 2), ("type-mismatch", 1)]
    assert out.value["warnings"] == []
    assert out.value["history"]["trend"]["n"] == 2
    assert out.value["summary"]["totalRows"] == 3
    assert out.cleaned.df.count() == 3
    assert (tmp_path / "out/report.html").read_text().startswith("<!DOCTYPE html>")
    assert "&lt;b&gt;" in html_report.render({"issues": [{"rowNumber": 1, "column": "<b>", "issueType": "x", "severity": "y", "message": "z"}]})


def test_empty(spark):
    assert engine.run(spark, RunConfig(data="a,b\n")).value["score"]["overall"] == 100


def test_profile(spark):
    ds = make(spark, [(str(i),) for i in range(1, 13)] + [(None,), ("",)], "v string")
    r = frequency.profiles(ds).first()
    assert (r["null_count"], r["unique_count"], r["q1"], r["median"], r["q3"], r["detected_type"]) == (2, 12, 4, 6.5, 10, "numeric")


def test_outliers(spark):
    ds = make(spark, [(float(v),) for v in [*range(100), 10000]], "v double")
    assert col(issues.outlier_issues(ds, ["v"]), "value") == ["10000"]
    few = make(spark, [(float(v),) for v in (10, 11, 12, 13, 14, 100)], "v double")
    assert issues.outlier_issues(few, ["v"]).count() == 0
    same = make(spark, [(50.0,)] * 10, "v double")
    assert issues.outlier_issues(same, ["v"], "zscore").count() == 0


def test_correlations(spark):
    ds = make(spark, [(float(i), 2.0 * i, 3.0) for i in range(12)], "x double, y double, c double")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in statistics.correlations(ds, ["x", "y", "c"]).collect()}
    assert got == {("x", "y"): 1.0, ("x", "c"): 0.0, ("y", "c"): 0.0}
    assert statistics.correlation_matrix(statistics.correlations(ds, ["x", "y", "c"]), ["x", "y", "c"]).count() == 9
    short = make(spark, [(float(i), 2.0 * i) for i in range(5)], "x double, y double")
    assert statistics.correlations(short, ["x", "y"]).first()["correlation"] is None


def test_benford(spark):
    ds = make(spark, [(round(10 ** (6 * i / 1000), 4),) for i in range(1000)], "v double")
    assert statistics.benford(ds, "v").first()["is_compliant"]
    flat = make(spark, [(float(i),) for i in range(100, 1000)], "v double")
    assert statistics.benford(flat, "v").first()["violation"] == "medium"


def walk(values):
    """W5 row by row."""
    n = len(values)
    w = max(5, n // 10)
    means = [sum(values[i : i + w]) / w for i in range(n - w + 1)]
    out = []
    for i in range(1, len(means)):
        mid = (abs(means[i]) + abs(means[i - 1])) / 2
        if mid > 0 and abs(means[i] - means[i - 1]) / mid * 100 > 50:
            out.append(i + w)
    return out if n >= 20 and 0 < len(out) <= 5 else []


@pytest.mark.parametrize("seed", range(3))
def test_ordered(spark, seed, monkeypatch):
    """Chunked forms of order-dependent operators against plain loops."""
    monkeypatch.setattr(ordered, "CHUNK", 7)
    rng = random.Random(seed)
    values = [None if rng.random() < 0.3 else float(rng.choice([1, 1, 2, 300])) for _ in range(60)]
    ds = make(spark, [(v,) for v in values], "v double")
    forward, backward, last = [], [], None
    for v in values:
        last = v if v is not None else last
        forward.append(last)
    last = None
    for v in reversed(values):
        last = v if v is not None else last
        backward.append(last)
    for up, want in ((True, forward), (False, backward[::-1])):
        assert col(ordered.filled(ds.df, {"v": F.col("v").isNull()}, up).orderBy(ROW), "v") == want
    here = [v for v in values if v is not None]
    assert col(statistics.shifts(ds, "v").orderBy("position"), "position") == walk(here)
    m = statistics.monotonic(ds, "v").first()
    assert m["increasing_ratio"] == pytest.approx(sum(b > a for a, b in zip(here, here[1:])) / (len(here) - 1), abs=1e-4)


def test_backward_fill_runs_through_a_chunk_once(spark):
    ds = make(spark, [(float(i) if i % 3 == 0 else None,) for i in range(10)], "v double")
    df = ordered.filled(ds.df, {"v": F.col("v").isNull()}, forward=False)
    assert "unboundedfollowing" not in df._jdf.queryExecution().executedPlan().toString().lower()
    assert col(df.orderBy(ROW), "v") == [0, 3, 3, 3, 6, 6, 6, 9, 9, 9]


def test_repeating(spark):
    ds = make(spark, [(str(i % 3),) for i in range(30)], "v string")
    r = statistics.repeating(ds, "v").first()
    assert (r["size"], r["repeats"]) == (2, 4)  # blocks of two agree at every third place
    assert statistics.repeating(make(spark, [(str(i),) for i in range(30)], "v string"), "v").count() == 0


def test_patterns(spark):
    ds = make(spark, [(float(i), "x") for i in range(60)], "v double, w string")
    kinds = {(p["column"], p["type"]) for p in statistics.patterns(ds, ["v", "w"], {"v"})}
    assert ("v", "monotonic-trend") in kinds
    assert ("v", "uniform-distribution") in kinds


def test_seasons(spark):
    rows = [(f"2024-01-{d:02d}", 50.0 if d % 7 in (6, 0) else 100.0) for d in range(1, 29)]
    ds = make(spark, rows, "day string, v double")
    assert statistics.date_columns(ds) == ["day"]
    assert [r["count"] for r in statistics.seasonal(ds, "day", "v", "day_of_week").collect()] == [4] * 7
    up = make(spark, [(f"2024-0{m}-01", 80.0 + 20 * m) for m in range(1, 6)], "day string, v double")
    t = statistics.trend(up, "day", "v").first()
    assert (t["has_trend"], t["direction"], t["slope"]) == (True, "increasing", 20.0)
    assert len(statistics.seasonal_report(ds)) == 1


ROWS = [(1, 10, "A"), (2, None, "B"), (3, 20, None), (4, 30, "A"), (5, None, "B")]


@pytest.mark.parametrize(
    ("strategy", "want"), [("mean", [10, 20, 20, 30, 20]), ("median", [10, 20, 20, 30, 20]), ("forwardFill", [10, 10, 20, 30, 30]), ("backwardFill", [10, 20, 20, 30, None]), ("constant", [10, 999, 20, 30, 999])]
)
def test_imputation(spark, strategy, want):
    ds = make(spark, ROWS, "id int, value int, category string")
    out, stats = remediation.impute(ds, strategy, ["value"], 999)
    assert col(out.df.orderBy(ROW), "value") == want
    assert stats[0]["missing"] == 2


def test_imputation_of_others(spark):
    ds = make(spark, ROWS, "id int, value int, category string")
    out, _ = remediation.impute(ds, "mode", ["category"])
    assert col(out.df.orderBy(ROW), "category") == ["A", "B", "A", "A", "B"]
    out, _ = remediation.impute(ds, "remove")
    assert out.df.count() == 2
    empty = make(spark, [(None,)] * 3, "v string")
    out, stats = remediation.impute(empty, "mean")
    assert (out.df.count(), stats[0]["strategy"]) == (3, "none")


def test_duplicate_strategies(spark):
    ds = make(spark, [("a", None), ("a", "x"), ("b", "y")], "k string, v string")
    sizes = {s: remediation.handle_duplicates(ds, s, ["k"])[0].count() for s in remediation.STRATEGIES}
    assert sizes == {"keepFirst": 2, "keepLast": 2, "removeAll": 1, "flag": 3, "merge": 2}
    assert sorted(tuple(r) for r in remediation.merge(ds, ["k"]).df.collect()) == [(1, "a", "x"), (3, "b", "y")]


def test_personal(spark):
    ds = make(spark, [("test@example.com",), ("123-45-6789",), ("123-456789",), ("4111111111111111",), ("192.168.1.1",), ("1234567890",)], "v string")
    got = {(r["rowNumber"], r["piiType"], r["maskedValue"]) for r in remediation.personal_cells(ds, ("email", "phone", "ssn", "creditCard", "ipAddress")).collect()}
    assert (1, "email", "t***@example.com") in got
    assert (2, "ssn", "***-**-6789") in got
    assert (3, "ssn", "***-**-6789") in got
    assert (4, "creditCard", "****-****-****-1111") in got
    assert (5, "ipAddress", "192.168.xxx.xxx") in got
    assert (6, "phone", "123***90") in got


@pytest.mark.parametrize(("total", "grade"), [(100, "A"), (90, "A"), (89, "B"), (80, "B"), (79, "C"), (69, "D"), (59, "F"), (0, "F")])
def test_grades(spark, total, grade):
    parts = [F.lit(float(total))] * 4
    assert spark.range(1).select(*quality.score_columns(*parts)).first()["grade"] == grade


def test_history(spark):
    def runs(*scores):
        return spark.createDataFrame([("s", i, float(x), 1.0, 10.0) for i, x in enumerate(scores)], "source_id string, run_ts int, quality_score double, total_issues double, total_rows double")

    assert quality.run_trend(runs(70, 75, 80, 85, 90), "quality_score").first()["direction"] == "increasing"
    assert quality.run_trend(runs(95, 85, 75, 65), "quality_score").first()["direction"] == "decreasing"
    assert quality.next_run(runs(70, 75, 80, 85)).first()["predicted"] == 90.0
    now = spark.createDataFrame([(45.0, 1.0, 10.0)], "quality_score double, total_issues double, total_rows double")
    odd = quality.run_anomalies(runs(80, 81, 79, 80), now).collect()
    assert [r["key"] for r in odd] == ["quality_score"]
    assert odd[0]["impact"] == "negative"
    assert col(quality.moving_average(runs(70, 75, 80, 85), "quality_score"), "moving_average") == [75.0, 80.0]
    assert quality.source_id(url="https://x.y/a b") == "x_y_a_b"


def test_advice():
    profile = [{"column": "a", "null_percent": 40.0, "total_count": 100, "unique_count": 3}]
    got = quality.recommendations({"completeness": 60}, profile, {"typeErrors": 2, "duplicates": 1, "outliers": 1}, True)
    assert {r["category"] for r in got} == {"completeness", "compliance", "validity", "uniqueness", "accuracy", "schema"}
    assert [r["priority"] for r in got] == ["high"] * 3 + ["medium"] * 2 + ["low"]


def test_records(spark, tmp_path):
    audit = records.AuditTrail()
    audit.log("DATA_SOURCE_ACCESSED", source="https://u:p@h/x?token=1")
    assert audit.entries[0]["details"]["source"] == "https://***:***@h/x?token=***"
    assert audit.frame(spark).count() == 1
    line = records.Lineage("file.csv")
    assert line.add("parse", None, 3) == "parse_1"
    line.add("impute", 3, 3, ["a"], ["a", "b"])
    assert line.steps[1]["columns"] == {"added": ["b"], "removed": []}
    assert line.diagram().startswith("graph TD")
    records.store(spark, f"file://{tmp_path}/r", "x", line.report())
    assert records.load(spark, f"file://{tmp_path}/r", "x")[0]["summary"]["steps"] == 2


def test_streams(spark, sf, tmp_path):
    import os

    os.symlink(f"{sf}/events.parquet", tmp_path / "events.parquet")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    df = streams.read_files(spark, f"file://{tmp_path}", schema)
    got = streams.run_to_table(streams.window_quality(df, "ts", F.col("value"), 1, 100), "quality", "complete")
    want = streams.window_quality(spark.read.parquet(f"{sf}/events.parquet"), "ts", F.col("value"), 1, 100)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    seen = []
    streams.batches(df, lambda part, n: seen.append(part.count()), f"file://{tmp_path}/check").awaitTermination()
    assert sum(seen) == 1000
    assert streams.run_to_table(streams.deduplicated(df, ["event_type"], "ts", "365 days"), "dedup").count() == spark.read.parquet(f"{sf}/events.parquet").select("event_type").distinct().count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    ds = Dataset.of(spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey") + 1)
    capped = plan(issues.capped(issues.cell_issues(ds, [ColumnRule("o_totalprice", "number", max=10)]), 100))
    assert "WindowGroupLimit" in capped
    assert "Python" not in capped
    one = plan(frequency.frequency_frame(Dataset(ds.df, ["o_totalprice"])))
    assert one.count("Exchange") == 1
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in one
