"""Queries of the training-data operators, each over its whole table, and their
SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_extract, license_scan, lm_score, mixing, simhash, substring_dedup, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(_read(spark, sf_dir, "conversations"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(_read(spark, sf_dir, "documents"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.scores(_read(spark, sf_dir, "documents"))
    six = lambda c: (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)
    return scores.select("doc_id", "n_words", six("score"), six("mean_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_decontamination, op2_simhash, op3_license_scan, op4_topk, op5_html_extraction, op6_mixing, op7_chat, op8_toxicity, op9_substring_dedup,
        op10_lm_scores,
    )
    return {f.__name__: f for f in every}


OP4 = """
WITH v AS (
 SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
u AS (SELECT r, unnest(w) AS c, generate_subscripts(w, 1) AS i FROM d),
x AS (SELECT r, c, lag(c, 1) OVER (PARTITION BY r ORDER BY i) AS b, lag(c, 2) OVER (PARTITION BY r ORDER BY i) AS a FROM u),
c1 AS (SELECT c, count(*) AS n FROM x GROUP BY 1), c2 AS (SELECT b, c, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY 1, 2), c3 AS (SELECT a, b, c, count(*) AS n FROM x WHERE a IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT sum(n) AS n FROM c1),
s AS (
 SELECT x.r, x.a, x.b, c1.n AS n1, c2.n AS n2, c3.n AS n3, log10(c1.n / n.n) AS s1, h1.n AS h1, h2.n AS h2
 FROM x CROSS JOIN n JOIN c1 ON c1.c = x.c LEFT JOIN c2 ON c2.b = x.b AND c2.c = x.c LEFT JOIN c3 ON c3.a = x.a AND c3.b = x.b AND c3.c = x.c
 LEFT JOIN c1 h1 ON h1.c = x.b LEFT JOIN c2 h2 ON h2.b = x.a AND h2.c = x.b),
t AS (SELECT *, CASE WHEN b IS NULL THEN s1 WHEN n2 >= 1 THEN log10(n2 / h1) ELSE log10(0.4) + s1 END AS s2 FROM s),
z AS (SELECT r, count(*) AS k, sum(CASE WHEN a IS NULL THEN s2 WHEN n3 >= 1 THEN log10(n3 / h2) ELSE log10(0.4) + s2 END) AS score FROM t GROUP BY 1)
SELECT doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_words, floor(coalesce(score, 0) * 1e6 + 0.5) / 1e6 AS score, floor(score / k * 1e6 + 0.5) / 1e6 AS mean_score FROM d LEFT JOIN z ON z.r = d.r"""


OP7 = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS row, * FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
l0 AS (SELECT row, unnest(string_split_regex(coalesce(text, ''), '\r\n|\n|\r')) AS x, generate_subscripts(string_split_regex(coalesce(text, ''), '\r\n|\n|\r'), 1) AS i FROM m),
l1 AS (
 SELECT *, length(regexp_replace(replace(regexp_extract(x, '^[ \t]*(?:(?:>|&gt;)[ \t]?)+'), '&gt;', '>'), '[^>]', '', 'g')) AS v, regexp_replace(x, '^[ \t]*(?:(?:>|&gt;)[ \t]?)+', '') AS b FROM l0),
l2 AS (
 SELECT *, CASE WHEN v = 0 AND coalesce(lead(v) OVER (PARTITION BY row ORDER BY i), 0) > 0
  AND regexp_matches(b, '(?i)^\s*(?:on|le|am|el)\s.*(?:wrote|writes|a écrit|schrieb|escribió)\s*:\s*$|^\s*-+\s*original message\s*-+\s*$') THEN -1 ELSE v END AS level FROM l1),
l AS (SELECT *, lower(trim(regexp_replace(b, '[\s\pZ]+', ' ', 'g'))) AS t FROM l2),
o AS (SELECT row, regexp_replace(regexp_replace(coalesce(string_agg(b, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^\s+|\s+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS own FROM l GROUP BY row),
u0 AS (SELECT row, own AS x FROM o UNION SELECT row, unnest(string_split(own, chr(10))) FROM o UNION SELECT row, unnest(string_split_regex(own, '\n\s*\n')) FROM o),
u AS (SELECT DISTINCT row, lower(trim(regexp_replace(x, '[\s\pZ]+', ' ', 'g'))) AS t FROM u0),
a AS (SELECT conv_id, u.t, min(turn) AS turn FROM u JOIN m USING (row) WHERE u.t <> '' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY 1, 2),
g0 AS (SELECT *, coalesce(CAST(level <> lag(level) OVER (PARTITION BY row ORDER BY i) AS INT), 1) AS fresh FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY row ORDER BY i) AS run FROM g0),
q AS (SELECT row, t FROM l WHERE level = 1 UNION SELECT row, trim(regexp_replace(string_agg(t, ' ' ORDER BY i), '\s+', ' ', 'g')) FROM g WHERE level = 1 GROUP BY row, run),
f AS (SELECT q.row, a.turn AS p, sum(length(q.t)) AS n FROM q JOIN m USING (row) JOIN a ON a.conv_id = m.conv_id AND a.t = q.t WHERE q.t <> '' AND a.turn < m.turn GROUP BY 1, 2),
k AS (SELECT row, arg_max(p, n * 1000000000::HUGEINT + p) AS parent_turn FROM f GROUP BY row),
w AS (SELECT m.*, k.parent_turn FROM m LEFT JOIN k USING (row)),
z AS (SELECT row, conv_id, turn, [turn] AS path FROM w WHERE parent_turn IS NULL UNION ALL SELECT w.row, w.conv_id, w.turn, list_append(z.path, w.turn) FROM w JOIN z ON z.conv_id = w.conv_id AND z.turn = w.parent_turn)
SELECT w.conv_id, row_number() OVER (PARTITION BY w.conv_id ORDER BY z.path, w.turn, w.role, o.own, w.row) AS position, w.turn, w.role, o.own AS text, w.parent_turn, CAST(len(z.path) AS INTEGER) AS depth
FROM w JOIN z USING (row) JOIN o USING (row)"""


def oracle_sql() -> dict[str, str]:
    """The other operators hash, draw, train or align and have no SQL form.  Their
    tests hold op1, op2 and op5 against brute force, op6's targets and sums, op8's
    folds and chain against models written out, and op9's steps and its passages
    against brute force and random plantings by length and edits, and op3's alignment
    and places against brute force, all on small tables."""
    return {"op4_topk": OP4, "op7_chat": OP7, "op10_lm_scores": OP10}
