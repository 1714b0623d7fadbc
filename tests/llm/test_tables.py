"""Top-k search, HTML extraction, mixing, chat, toxicity and the pipeline."""

import math
import random
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from truegrain.llm import chat, html_extract, mixing, sequences, topk, toxicity
from truegrain.llm.common import saved


def native(df):
    plan = df._jdf.queryExecution().toString()
    return not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


# --- top-k -------------------------------------------------------------------


def best(rows, k, every):
    """Brute force over whole numbers."""
    ok = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((n, i, [math.floor(256.0 * x) for x in v]))
    out = []
    for n, i, q in ok:
        if i % every == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, w)))), j) for m, j, w in ok if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "asks", "dims"), [(4096, 1024, 16), (7, 3, 2)])
def test_top_k(spark, monkeypatch, block, asks, dims):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", asks)
    monkeypatch.setattr(topk, "DIMENSIONS", dims)
    rng = random.Random(1)
    rows = [(i, [rng.choice((-1.0, -0.5, 0.25, 0.5, 1.0)) * rng.random() for _ in range(9)]) for i in range(90)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(12)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 9), (None, [1.0]), (205, []), (210, [2.0, 3.0]), (210, [2.0, 3.0]), (215, [float("inf")])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, every=5).collect())
    assert got == best(rows, 5, 5)


def test_top_k_of_few_and_large(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(few.limit(0)).count() == 0
    rows = [(0, [1e8, 1.0]), (1, [1e8, -1.0]), (2, [-1e15, 0.0]), (3, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == best(rows, 5, 50)


# --- HTML --------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, []),
        ("", []),
        ("plain &amp; text", ["plain & text"]),
        ("<nav><ul><li>m</ul></nav><article><h1>T &lt; t</h1><p><b>a<br><p>b \n c</article><footer>f</footer>", ["T < t", "a", "b c"]),
        ("<header>h</header><main><p>x</p><aside>s</aside><div class='ad-box'>buy</div><form>f</form><p>y</main>", ["x", "y"]),
        ("<article><p>x</p><div id=comments><article>c</article></div><script>var a='<p>no</p>'</script><style>p{}</style></article>", ["x"]),
        ("<article><p>a<!-- <p>no</p> -->b</p><p title='1 > 0'>c</p><p>d &copy; &#233; &unknown;</p></article>", ["ab", "c", "d © é &unknown;"]),
        ("<div class='cookie-notice'>ok?</div><p>x<p hidden>no<p style='display: none'>no<p>y", ["x", "y"]),
        ("<form><article><p>kept</p></article></form>", ["kept"]),
        ("<article><p>cut off <b>here", ["cut off here"]),
        ("<table><tr><td>1</td><td>2</td></tr></table><ul><li>a<li>b</ul>", ["1", "2", "a", "b"]),
    ],
)
def test_lines(page, want):
    found, zone = html_extract.lines(page)
    top = max(zone, default=0)
    assert [t for t, z in zip(found, zone) if z == top] == want


def test_common():
    rng = random.Random(2)
    for _ in range(400):
        k = rng.choice((2, 3, 9))
        x, y = ([rng.randrange(k) for _ in range(rng.randint(0, 16))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        got = sequences.lcs(x, y)
        assert len(got) == table[-1][-1]
        assert all(x[i] == y[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))


def pages():
    rows = []
    for i in range(30):
        body = "".join(f"<p>own words {i} number {j} of this page</p>" for j in range(6))
        if i % 3 == 0:
            body = f"<article>{body}<p>said everywhere</p></article>"
        rows.append((i, f"https://A.example/{i // 10}/page{i % 10}.html", f"<body><p>Site name</p>{body}<p>said everywhere</p><p>Contact us</p></body>"))
    return [*rows, (100, rows[1][1], rows[1][2]), (101, None, "<p>alone</p>"), (102, "http://[bad", None), (None, "https://b.example/", "<p>x</p>")]


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_differencing(spark, ranges):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    own = lambda i: [f"own words {i} number {j} of this page" for j in range(6)]
    for i in range(30):
        assert got[i].split("\n\n") == own(i) + (["said everywhere"] if i % 3 == 0 else [])
    assert got[100] == got[1]
    assert (got[101], got[102], got[None]) == ("alone", "", "x")
    assert html_extract.extract(df.limit(0)).count() == 0


def test_runs_of_copies(spark):
    page = lambda i, n: (n, f"https://a.example/page{i}", f"<p>Site name</p><p>own words of page {i} that no other has</p><p>Contact us</p>")
    df = spark.createDataFrame([page(1, 1), *[page(2, n) for n in range(2, 7)], page(3, 7)], "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        got = {r["page_id"]: (r["text"], r["n_shared"]) for r in html_extract.extract(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {n: (f"own words of page {1 if n == 1 else 3 if n == 7 else 2} that no other has", 2) for n in range(1, 8)}


def one_range(spark, df, **options):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        return {r["page_id"]: r for r in html_extract.extract(df.coalesce(1), **options).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_differencing_against_every_pair(spark):
    """Each page against its nearest neighbour in plain dynamic programming."""
    rng = random.Random(5)
    stock = [f"stock line {i}" for i in range(8)]
    rows, lines = [], {}
    for n in range(40):
        lines[n] = [rng.choice(stock) if rng.random() < 0.5 else f"own {n} {i} with words of its own" for i in range(rng.randint(1, 9))]
        rows.append((n, f"https://a.example/{n:03}", "<article>" + "".join(f"<p>{t}</p>" for t in lines[n]) + "</article>"))
    got = one_range(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), trust_articles=False)

    def shared(x, y):
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1][j + 1] = table[i][j] + 1 if x[i] == y[j] else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for n in range(40):
        near = sorted((m for m in (n - 1, n + 1) if 0 <= m < 40), key=lambda m: -html_extract.nearness(f"/{n:03}", f"/{m:03}"))
        near = next(m for m in near if html_extract.shared_lines(lines[n], lines[m]) is not None)
        assert got[n]["n_shared"] == shared(lines[n], lines[near])
        kept = got[n]["text"].split("\n\n") if got[n]["text"] else []
        assert len(kept) == len(lines[n]) - got[n]["n_shared"]
        assert all(t in kept for t in lines[n] if t.startswith("own"))


def test_neighbours_decide(spark):
    """A page's text follows its neighbours; in articles on request."""
    page = lambda n, tag, site: (n, f"https://a.example/{n}", f"<{tag}><p>{site}</p><p>words of page {n} alone</p><p>share this with {site}</p></{tag}>")
    for tag, options, whole in (("div", {}, False), ("article", {}, True), ("article", {"trust_articles": False}, False)):
        for other in ("one", "two"):
            got = one_range(spark, spark.createDataFrame([page(1, tag, "one"), page(2, tag, other)], "page_id long, url string, html string"), **options)
            cut = other == "one" and not whole
            assert got[1]["text"] == ("words of page 1 alone" if cut else "one\n\nwords of page 1 alone\n\nshare this with one"), (tag, options, other)


class Article(HTMLParser):
    """Plain reading of well-formed articles."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        if tag == "br" and self.inside:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_no_article_text_is_lost():
    """The given pages against another parser, and what differencing articles
    too would delete of them."""
    source = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    for page in source:
        plain = Article()
        plain.feed(page)
        want = [" ".join(b.split()) for b in plain.blocks]
        found, zone = html_extract.lines(page)
        assert [t for t, z in zip(found, zone) if z == 2] == [b for b in want if b]


def test_names_are_no_rule_for_every_word():
    keep = ("share-price", "search-results", "notice-of-meeting", "widgets")
    drop = ("ad", "site-footer", "comment-list", "cookie-notice", "related posts", "ad-slot-2", "share")
    for name in keep + drop:
        found, _ = html_extract.lines(f"<article><p>x</p><div class='{name}'>y</div></article>")
        assert found == (["x", "y"] if name in keep else ["x"]), name
    found, zone = html_extract.lines("<main><h1>Title</h1><article><p>x</p></article></main>")
    page = html_extract._Page.__new__(html_extract._Page)
    page.lines, page.zone, page.host, page.path = found, zone, "", ""
    assert html_extract.main_text(page, [])[0] == "Title\n\nx"


def test_pages(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    rows = html_extract.extract(df).collect()
    assert len(rows) == df.count()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in rows)


# --- mixing ------------------------------------------------------------------


def fill(sizes, share=1.5, limit=2.0):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, rest, free = {}, share * sum(sizes.values()), set(names)
    while True:
        w = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > limit * sizes[s]} if w else set()
        if not over:
            return out | {s: rest * weight[s] / w for s in free}
        for s in over:
            out[s] = limit * sizes[s]
        free, rest = free - over, rest - sum(out[s] for s in over)


def corpus(rng, n=1500):
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "Z", "é", None])
        rows.append((i, " ".join(["w"] * min(4000, int(rng.paretovariate(1.1) * 20))), source))
    return [*rows, (5, "x y", "b"), (5, "x y", "b"), (None, "q r s", "a"), (7, None, "c"), (8, "", "a")]


def test_mix(spark):
    rows = corpus(random.Random(3))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("taken", F.lit(1))
    out = mixing.mix(df)
    got = out.collect()
    assert len(got) == len(rows)
    sizes, want = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    for s, goal in want.items():
        mine = [r for r in got if r["source"] == s]
        assert [r["target"] for r in mine] == pytest.approx([goal] * len(mine))
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert abs(sum(r["taken"] for r in mine) - goal) <= max(30, 0.01 * goal, 0.5 * max(r["size"] for r in mine))
        assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in mine)
    again = mixing.mix(df.repartition(13)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert native(out)
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    taken = mixing.take(df)
    assert taken.count() == sum(r["copies"] for r in got)
    assert taken.columns == ["doc_id", "text", "source", "size", "taken", "copy"]
    clash = mixing.take(df.withColumn("copies", F.lit(0)).withColumn("copy", F.lit("c")).withColumn("_i", F.lit(1)))
    assert clash.count() == taken.count() and clash.columns[-4:] == ["copies", "copy", "_i", "_copy"]


def test_expectations(spark, monkeypatch):
    """Over many draws every document is taken about target / size times."""
    monkeypatch.setattr(mixing, "GROUP", 8)
    rows = [(1000 * d + i, " ".join(["w"] * (1 + i % 17)), f"s{d}") for d in range(60) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    by = {}
    for r in got:
        if r["target"] < 2 * r["source_size"]:
            by.setdefault(r["size"], []).append(r["copies"] - r["target"] / r["source_size"])
    assert all(abs(np.mean(v)) < 5 * 0.5 / len(v) ** 0.5 for v in by.values())


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, "  ", "b")], [(1, "one", "a")]])
def test_small_mixes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)


# --- chat --------------------------------------------------------------------

TALK = [
    (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "I am fine.\n\nSecond para"), (1, 2, "user", "On Monday X wrote:\n> hello  there\n> How are you?\nmy answer"),
    (1, 3, "assistant", "> > hello there\n> my answer\nok cool"), (1, 4, "user", "&gt; Second para\nyes"), (1, 5, "user", "plain"), (1, 6, "user", "> never said\nbut answered"),
    (2, 0, "user", None), (None, 1, "user", "x"), (None, 2, "user", "> x\ny"), (3, None, "user", "> q\nr"), (1, 5, "user", "plain"), (4, 0, "user", "> mine\nmine"), (4, 0, "assistant", "same turn"),
]


def test_chat(spark):
    df = spark.createDataFrame(TALK, "conv_id int, turn int, role string, text string").withColumn("path", F.lit("clash"))
    out = chat.conversations(df)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["conv_id"] or 0, r["position"])):
        got.setdefault(r["conv_id"], []).append((r["position"], r["turn"], r["text"], r["parent_turn"], r["depth"]))
    assert got[1] == [
        (1, 0, "Hello there\nHow are you?", None, 1), (2, 2, "my answer", 0, 2), (3, 3, "ok cool", 2, 3), (4, 1, "I am fine.\n\nSecond para", None, 1), (5, 4, "yes", 1, 2), (6, 5, "plain", None, 1),
        (7, 6, "but answered", None, 1),
    ]
    assert got[2] == [(1, 0, "", None, 1)]
    assert [t[2] for t in got[None]] == ["x", "y"]
    assert got[3] == [(1, None, "r", None, 1)]
    assert [t[2:4] for t in got[4]] == [("same turn", None), ("mine", None)]
    assert native(out)
    assert chat.conversations(df.limit(0)).count() == 0
    pieces = chat.transcripts(df, 3).collect()
    assert sorted((r["conv_id"] or 0, r["part"], r["n_messages"]) for r in pieces if r["conv_id"] == 1) == [(1, 0, 3), (1, 1, 3), (1, 2, 1)]


def test_chat_as_sql(spark):
    import duckdb

    from truegrain.llm import queries

    rows = [r for r in TALK if r[0] is not None and r[1] is not None] + [(5, i, "user", f"> message {i - 2}\n> > message {i - 4}\nmessage {i}\n\n\n\nend") for i in range(9)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(queries.OP7).fetchall()
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_long_threads(spark):
    rows = [(1, i, "user", f"> message {i - 2}\nmessage {i}" if i >= 2 else f"message {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [r["turn"] for r in chat.conversations(df).orderBy("position").collect()]
    assert got == list(range(0, 40, 2)) + list(range(1, 40, 2))


@pytest.mark.parametrize("seed", range(3))
def test_threads_against_recursion(spark, seed):
    rng = random.Random(seed)
    up = {(c, t): rng.randrange(t) if t and rng.random() < 0.8 else None for c, n in enumerate((60, 1, 25)) for t in range(n)}
    up |= {(3, t): t - 1 if t else None for t in range(300)}  # one deep thread
    up |= {(4, t): 0 if t else None for t in range(200)}  # one message that all answer
    rows = [(c, t, "user", f"> message {p}\nmessage {t}" if p is not None else f"message {t}") for (c, t), p in up.items()]
    rng.shuffle(rows)
    want = []
    for c in range(5):
        todo, at = [(t, 1) for (k, t), p in sorted(up.items(), reverse=True) if k == c and p is None], 0
        while todo:
            t, depth = todo.pop()
            at += 1
            want.append((c, at, t, up[c, t], depth))
            todo += [(x, depth + 1) for (k, x), p in sorted(up.items(), reverse=True) if k == c and p == t]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.select("conv_id", "position", "turn", "parent_turn", "depth").collect())) == sorted(want)


def test_replies_to_one_turn(spark):
    rows = [(1, 0, "a", "first text"), (1, 0, "b", "second text"), (1, 1, "c", "> first text\nx"), (1, 1, "c", "> second text\ny"), (1, 2, "c", "> second text\nz")]
    got = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("position")
    assert [(r["position"], r["text"], r["depth"]) for r in got.collect()] == [(1, "first text", 1), (2, "x", 2), (3, "second text", 1), (4, "y", 2), (5, "z", 2)]


# --- toxicity ----------------------------------------------------------------


def test_fit_separates():
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 400).astype(float)
    doc = np.repeat(np.arange(400), 2)
    at = np.stack([rng.integers(0, 5, 400), 5 + y.astype(int)]).T.ravel()
    w, b, _ = toxicity.fit(doc, at, np.ones(800), 400, 7, np.zeros((0, 400)), y)
    odds = np.bincount(doc, weights=w[at]) + b
    assert ((odds > 0) == (y > 0)).all()
    w, b, _ = toxicity.fit(doc, at, np.ones(800), 400, 7, np.zeros((0, 400)), np.zeros(400))
    assert 1 / (1 + math.exp(-b)) < 0.01


def test_chain_against_dense_models():
    """Folds and links against the same chain written out over dense rows: a
    document's probability never comes from a model that saw it."""
    rng = np.random.default_rng(7)
    n, width, folds = 60, 6, 3
    dense = rng.random((n, width)) * (rng.random((n, width)) < 0.6)
    y = np.array([dense[:, 0] > 0.3, dense[:, 1] + dense[:, 0] > 0.6, dense[:, 2] > 0.2], float)
    fold = np.arange(n) % folds
    sparse = lambda rows: (*np.nonzero(dense[rows]), dense[rows][np.nonzero(dense[rows])])
    weights, bias, links, known = toxicity.fit_chain(*sparse(np.arange(n)), width, y, fold)
    earlier = np.zeros((0, n))
    for c in range(3):
        w, b, more = toxicity.fit(*sparse(np.arange(n)), n, width, earlier, y[c])
        assert np.allclose(weights[c], w) and np.isclose(bias[c], b) and np.allclose(links[c], more) and len(more) == c
        if c == 2:
            break
        row = np.zeros(n)
        for i in range(n):
            others = np.flatnonzero(fold != fold[i])
            w, b, more = toxicity.fit(*sparse(others), len(others), width, earlier[:, others], y[c][others])
            row[i] = 1 / (1 + math.exp(-(dense[i] @ w + b + more @ earlier[:, i])))
        earlier = np.vstack([earlier, row])
        assert np.allclose(known[c], row) and (0 < row).all() and (row < 1).all()
    model = toxicity.Chain(("a", "b", "c"), np.arange(width, dtype=np.uint64), weights, bias, links)
    doc, at, value = sparse(np.arange(n))
    got = model.predict(doc, at, np.full(n, 100))  # one occurrence of each feature
    p = np.zeros((3, n))
    for c in range(3):
        p[c] = 1 / (1 + np.exp(-((dense > 0) @ weights[c] + bias[c] + sum(links[c][k] * p[k] for k in range(c)))))
    assert np.allclose(got, p)


def test_repeated_ids_count_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(i, f"foul {i}" if i % 2 else f"fine {i}") for i in range(2, 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, toxicity.train(docs, labels, sample=20))
    assert got.count() == 78


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, sample=2000)
    assert len(model.links[1]) == 1
    used = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2000)
    rest = toxicity.classify(docs, model).join(labels.join(used, "doc_id", "left_anti"), "doc_id").collect()
    hit = sum(r["rejected"] and r["toxic"] for r in rest) / sum(r["toxic"] for r in rest)
    false = sum(r["rejected"] and not r["toxic"] for r in rest) / sum(not r["toxic"] for r in rest)
    assert hit > 0.9
    assert false < 0.02


def test_odd_toxicity(spark):
    docs = spark.createDataFrame([(i, "you stupid clown" if i % 2 else "a lovely day") for i in range(60)] + [(60, None), (61, ""), (None, "stupid clown"), (62, "stupid " * 5000)], "doc_id long, text string").withColumn("rejected", F.lit(0))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(50)] + [(None, 1, 1), (51, None, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["rejected"] for r in toxicity.scan(docs, labels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(60))
    assert (got[60], got[61], got[None], got[62]) == (False, False, True, True)
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(60) if i % 2 == 0] + [60, 61]
    assert not any(r["rejected"] for r in toxicity.scan(docs, labels.limit(0)).collect())
    assert toxicity.scan(docs.limit(0), labels).count() == 0


def test_one_scan_rejects_as_classify_does(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    bad = {r["doc_id"] for r in toxicity.scan(docs, labels).where("rejected").collect()}
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in toxicity.remove_toxic(docs, labels).collect()} == bad


# --- pipeline ----------------------------------------------------------------


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "source_mixing"]
    ids = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append(docs.count())
    assert ids == sorted(ids, reverse=True)
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "text", "source", "copy"} <= set(out.columns)
    assert out.agg(F.max("copy")).first()[0] <= 2
    assert out.select("doc_id").distinct().count() <= ids[-1]


def test_entry_names():
    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def test_arrow_batches_are_small(spark):
    from truegrain.llm.common import BATCH_BYTES, small_batches

    small_batches(spark.range(1))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= BATCH_BYTES
