import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from truegrain.llm import simhash
from truegrain.llm.common import components


def brute(values):
    """Smallest index of each value's component, by comparing all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(values))]


def test_fingerprint():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \t\n") == 0
    one = xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint("A\x0bB") == one
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c a", b"c a b", b"a b c")]
    want = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint("a b c a b c") == want
    assert simhash.fingerprint("É b c") == xxhash.xxh64_intdigest("É b c".encode(), 42)  # only A-Z fold


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_links_connect_as_brute_force_does(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(bucket)
    values = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(150):
        v = rng.choice(values)
        for _ in range(rng.randint(1, 3)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    values = sorted(set(values))
    fps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fp long")
    edges = simhash.links(fps)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    index = {int(np.uint64(v).view(np.int64)): i for i, v in enumerate(values)}
    want = brute(values)
    groups = {}
    for s, i in index.items():
        groups.setdefault(want[i], set()).add(got.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    values = [int(r["fingerprint"], 16) for r in sorted(rows, key=lambda r: r["doc_id"])]
    ids = sorted(r["doc_id"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert values == [simhash.fingerprint(texts[i]) for i in ids]
    want = brute(values)
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: ids[w] for i, w in zip(ids, want)}
    kept = simhash.keep_one(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({ids[w] for w in want})
    assert kept.columns == docs.columns


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b c d", "y"), (3, "a b c d", "y"), (None, "a b c d", "z"), (5, "one", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, fp string")
    got = sorted((r["doc_id"] or 0, r["fingerprint"][:4], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert [(i, c) for i, _, c in got] == [(0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (5, 5)]
    assert sorted((r["doc_id"] or 0) for r in simhash.keep_one(df).collect()) == [0, 1, 3, 5]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e if n is not None}
    for _ in range(200):
        for a, b in edges:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(n, n) == r for n, r in root.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
