"""Toxicity by classifier chains of linear models.

The categories are predicted one after another by logistic regression on the
shares of a document's words (and word beginnings) that are in a vocabulary; each
later model also reads the earlier categories' probabilities.  In training these
are out-of-fold predictions, made by models that haven't seen the document, so
that later models meet probabilities of the kind they get in use.

Only the fit is bounded: at most ``SAMPLE`` labelled documents, those whose ids
hash smallest.  The vocabulary is every feature of theirs that occurs with some
category more or less often than chance explains (``SIGMAS``); there is no limit
to how many.  Every document is scored, whole, in one scan without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import saved, small_batches

#: Label columns in chain order; the last one decides.
CATEGORIES = ("quality", "toxic")
SAMPLE = 8000
#: Standard deviations from a category's overall rate at which a feature counts.
SIGMAS = 3.0
FOLDS = 5
THRESHOLD = 0.5
#: Bytes of the word beginnings that are features too.
BEGINNINGS = (5, 6, 7)
STEPS = 300
RIDGE = 1e-4


def features(words: textvec.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature hash) for every word and every word beginning."""
    doc, size = words.doc_of(), words.end - words.start
    docs, hashes = [doc], [words.hash]
    for n in BEGINNINGS:
        longer = np.flatnonzero(size > n)
        docs.append(doc[longer])
        hashes.append(textvec.mix((words.head[longer] & np.uint64((1 << 8 * n) - 1)) + np.uint64(n)))
    return np.concatenate(docs), np.concatenate(hashes)


@dataclass
class Chain:
    """Linear models over one sorted vocabulary; ``links[c]`` weighs the
    probabilities of the categories before ``c``."""

    categories: tuple[str, ...]
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    links: list[np.ndarray]

    def __post_init__(self):
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self.vocabulary >> np.uint64(48)] = True

    def lookup(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, vocabulary index) of known features; words by text."""
        words = textvec.split(texts)
        doc, h = features(words)
        maybe = np.flatnonzero(self.seen[h >> np.uint64(48)])
        doc, h = doc[maybe], h[maybe]
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[at] == h if len(self.vocabulary) else np.zeros(0, bool)
        return doc[known], at[known], np.diff(words.first)

    def predict(self, doc: np.ndarray, at: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Probabilities, a row per category."""
        p = np.zeros((len(self.categories), len(n_words)))
        share = 100.0 / np.maximum(n_words, 1)
        for c in range(len(self.categories)):
            odds = self.bias[c] + share * np.bincount(doc, weights=self.weights[c][at], minlength=len(n_words))
            p[c] = probability(odds + self.links[c] @ p[:c])
        return p


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit(doc: np.ndarray, at: np.ndarray, value: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Ridge logistic regression of ``y`` on sparse rows (``doc``, ``at``,
    ``value``) and dense columns ``extra``, by full-batch Adam: (weights, bias,
    weights of the extra columns).  One class only gives a constant."""
    rate = (y.sum() + 0.5) / (n + 1.0) if n else 0.0
    bias = float(np.log(rate / (1 - rate))) if n else -50.0
    theta = np.zeros(width + 1 + len(extra))
    theta[width] = bias
    if not n or y.min() == y.max():
        return theta[:width], theta[width], theta[width + 1 :]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        odds = np.bincount(doc, weights=value * theta[at], minlength=n) + theta[width] + (theta[width + 1 :] @ extra if len(extra) else 0.0)
        error = (probability(odds) - y) / n
        grad = np.concatenate([np.bincount(at, weights=value * error[doc], minlength=width), [error.sum()], extra @ error if len(extra) else []])
        grad[:width] += RIDGE / max(1, width) ** 0.5 * theta[:width]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:width], float(theta[width]), theta[width + 1 :]


def fit_chain(doc: np.ndarray, at: np.ndarray, value: np.ndarray, width: int, y: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Models of the categories (rows of ``y``) in order: weights, biases, link
    weights, and the out-of-fold probabilities that later models were trained on.

    A document's probability for a category comes from a model trained on the
    other folds, which read the other documents' out-of-fold probabilities for
    the categories before.
    """
    n = y.shape[1]
    known = np.zeros((0, n))
    weights, bias, links = [], [], []
    for c in range(len(y)):
        w, b, more = fit(doc, at, value, n, width, known, y[c])
        weights.append(w)
        bias.append(b)
        links.append(more)
        if c + 1 < len(y):
            held = np.zeros(n)
            for k in np.unique(fold):
                inside, outside = np.flatnonzero(fold != k), fold == k
                place = np.full(n, -1)
                place[inside] = np.arange(len(inside))
                use = place[doc] >= 0
                w, b, more = fit(place[doc[use]], at[use], value[use], len(inside), width, known[:, inside], y[c][inside])
                held[outside] = probability(np.bincount(doc, weights=value * w[at], minlength=n) + b + more @ known)[outside]
            known = np.vstack([known, held])
    return np.array(weights), np.array(bias), links, known


def _document_features(categories: int):
    """Documents with and without each label, for each feature."""
    names = ["feature", "docs", *[f"pos{c}" for c in range(categories)]]

    def run(batches):
        for batch in batches:
            labels = [batch.column(1 + c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(categories)]
            for i, j in textvec.slices(batch.column(0)):
                doc, h = features(textvec.split(batch.column(0).slice(i, j - i)))
                order = np.lexsort((doc, h))
                doc, h = doc[order], h[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                doc, h = doc[first], h[first]
                head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                if not len(head):
                    continue
                columns = [np.diff(np.append(head, len(h)))] + [np.add.reduceat(y[i:j][doc], head) for y in labels]
                yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64))] + [pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """Fit a chain on at most ``sample`` labelled documents.

    Labels with a null id or a null category are left out; of repeated labels a
    category is 1 if any row says so; of several texts of one doc_id the one that
    sorts first is taken; without labels every probability is 0.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).na.drop()
    marks = marks.groupBy("doc_id").agg(*[F.max((F.col(f"y{i}") > 0).cast("int")).alias(f"y{i}") for i in range(len(categories))])
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the sample's bound is a parameter, so it can be sent to every executor
    marked = [f"y{i}" for i in range(len(categories))]
    found = texts.join(F.broadcast(saved(marks, "labels")), "doc_id").groupBy("doc_id", *marked).agg(F.min("text").alias("text"))
    chosen = saved(found, "sample").select("text", *marked, "doc_id")
    n = chosen.count()
    none = np.zeros(0, np.uint64)
    if not n:
        return Chain(tuple(categories), none, np.zeros((len(categories), 0)), np.full(len(categories), -50.0), [np.zeros(c) for c in range(len(categories))])
    schema = ", ".join(["feature long", "docs long", *[f"pos{c} long" for c in range(len(categories))]])
    total = chosen.agg(*[F.sum(f"y{i}") for i in range(len(categories))]).first()
    counts = chosen.select("text", *[f"y{i}" for i in range(len(categories))]).mapInArrow(_document_features(len(categories)), schema)
    counts = counts.groupBy("feature").agg(F.sum("docs").alias("docs"), *[F.sum(f"pos{c}").alias(f"pos{c}") for c in range(len(categories))])
    tells = F.lit(False)
    for c in range(len(categories)):
        share = total[c] / n
        tells |= F.abs(F.col(f"pos{c}") - share * F.col("docs")) >= F.lit(SIGMAS * (share * (1 - share)) ** 0.5) * F.sqrt("docs")
    kept = counts.where(tells & (F.col("docs") > 1)).select("feature").collect()  # no more than the sample's words
    words = np.sort(np.array([r[0] for r in kept], np.int64).view(np.uint64))
    lookup = Chain(tuple(categories), words, np.zeros((len(categories), len(words))), np.zeros(len(categories)), [])

    def sparse(batches):
        for batch in batches:
            doc, at, n_words = lookup.lookup(batch.column(0))
            cell, times = np.unique(doc * np.int64(1 << 32) + at, return_counts=True)
            doc, at = cell >> 32, cell & 0xFFFFFFFF
            offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            share = times * 100.0 / np.maximum(n_words, 1)[doc]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((at, pa.int32()), (share, pa.float64()))]
            yield pa.RecordBatch.from_arrays(batch.columns[1:] + lists, names=batch.schema.names[1:] + ["at", "share"])

    rows = chosen.mapInArrow(sparse, ", ".join([*[f"y{i} int" for i in range(len(categories))], "doc_id long", "at array<int>", "share array<double>"]))
    rows = sorted((r[len(categories)], *r[: len(categories)], r["at"], r["share"]) for r in rows.collect())
    doc = np.repeat(np.arange(n), [len(r[-2]) for r in rows])
    at = np.array([i for r in rows for i in r[-2]], np.int64)
    value = np.array([x for r in rows for x in r[-1]], np.float64)
    y = np.array([r[1 : 1 + len(categories)] for r in rows], np.float64).T
    fold = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    fold = (textvec.mix(fold) % np.uint64(FOLDS)).astype(int)
    weights, bias, links, _ = fit_chain(doc, at, value, len(words), y, fold)
    return Chain(tuple(categories), words, weights, bias, links)


def classify(docs: DataFrame, model: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``n_words``, a probability ``p_<category>`` for each category
    and ``rejected`` (the last one is at least ``threshold``) for every row.

    Null and empty texts get the probabilities of a text without known words and
    are never rejected; null doc_ids are carried through; repeated rows give
    equal rows; other columns are ignored; an empty table gives no rows.
    """
    names = ["doc_id", "n_words", *[f"p_{c}" for c in model.categories], "rejected"]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in textvec.slices(texts):
                doc, at, n_words = model.lookup(texts.slice(i, j - i))
                p = model.predict(doc, at, n_words)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n_words, pa.int64()), *[pa.array(x) for x in p], pa.array((p[-1] >= threshold) & (n_words > 0))], names=names
                )

    source = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, ", ".join(["doc_id long", "n_words long", *[f"p_{c} double" for c in model.categories], "rejected boolean"]))


def scan(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``classify`` all ``docs`` by a chain trained on ``labels``."""
    return classify(docs, train(docs, labels))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that the chain rejects, in one scan."""
    model = train(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for i, j in textvec.slices(batch.column(at)):
                part = batch.slice(i, j - i)
                doc, known, n_words = model.lookup(part.column(at))
                p = model.predict(doc, known, n_words)[-1]
                yield part.filter(pa.array((p < threshold) | (n_words == 0)))

    return docs.mapInArrow(run, docs.schema)
