"""Toxicity by a classifier chain.

Read et al., "Classifier Chains for Multi-label Classification" (2011): the categories are predicted one after the
other by linear models, each of which also sees the probabilities of the categories before it. For training these
are out-of-fold predictions, so that a later model meets earlier ones as unsure as they will be. Features are the
presence of words and steps of how a text is written (repetition, marks, lengths: quality.py), weighted by their naive
Bayes log-count ratio (Wang & Manning, 2012).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import bounded_sample, free_name, table
from gleanline.llm.quality import NAMES, describe

#: The chain, in order: a name and the SQL of its 0/1 label over the columns of labels.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
#: About so many labelled rows are learned from, chosen by a hash, and twice as many at most.
SAMPLE = 8000
#: A word is a feature if so many of the sample's texts have it, and their share differs between the two kinds of a
#: category by so many standard errors.
LEAST_TEXTS = 4
LEAST_Z = 3.0
FOLDS = 3
THRESHOLD = 0.5
#: Where a feature of writing has a step: quantiles of the sample.
QUANTILES = (0.01, 0.03, 0.1, 0.25, 0.5, 0.75, 0.9, 0.97, 0.99)
#: Letters of all the sample's texts together, and of one of them, at most: what the driver holds. Fewer texts are taken if they are longer.
SAMPLE_LETTERS, LONGEST_LETTERS = 40_000_000, 1_000_000
#: Words remembered in a task.
REMEMBERED = 300_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass
class Model:
    vocabulary: dict[str, int]
    edges: list[np.ndarray]  # the steps of each feature of writing
    names: list[str]
    weights: list[np.ndarray]  # of the words, the steps, the earlier categories, then the constant

    @property
    def size(self) -> int:
        """Words and steps."""
        return len(self.vocabulary) + sum(map(len, self.edges))


def word(chunk: str) -> str:
    """The word in a piece of text between spaces: lower case, without marks at its ends."""
    return _EDGE.sub("", chunk).lower()


class _Memory(dict):
    def __init__(self, vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, chunk):
        if len(self) >= REMEMBERED:
            self.clear()
        at = self[chunk] = self.vocabulary.get(word(chunk), -1)
        return at


def features(texts: list[str | None], memory, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature numbers of what the texts have: words, each once a text, and after them the steps that they are over."""
    rows, cols = [], []
    for i, t in enumerate(texts):
        own = set(map(memory.__getitem__, (t or "").split()))
        own.discard(-1)
        cols += sorted(own)
        rows += [i] * len(own)
    style = np.array([describe(t) for t in texts], float).reshape(len(texts), len(NAMES))
    r, c = np.nonzero(np.concatenate([style[:, j, None] > e for j, e in enumerate(edges)], axis=1))
    return np.concatenate((np.array(rows, np.int64), r)), np.concatenate((np.array(cols, np.int64), c + len(memory.vocabulary)))


def _logistic(rows, cols, extra, y, told, rounds=80, ridge=0.1, memory=8) -> np.ndarray:
    """Weights of a linear model on the presence of the features that count (told) and extra columns: log loss and ridge by limited-memory BFGS."""
    n, m, n_words = len(y), extra.shape[1], len(told)
    pos = np.bincount(cols, weights=y[rows], minlength=n_words) + 1
    neg = np.bincount(cols, weights=1 - y[rows], minlength=n_words) + 1
    ratio = np.where(told, np.log(pos / (y.sum() + 2)) - np.log(neg / ((1 - y).sum() + 2)), 0.0)
    at = ratio[cols]

    def loss(w):
        z = np.bincount(rows, weights=at * w[cols], minlength=n) + extra @ w[n_words:-1] + w[-1]
        off = 0.5 * (1 + np.tanh(z / 2)) - y
        g = np.concatenate((np.bincount(cols, weights=at * off[rows], minlength=n_words), extra.T @ off, [off.sum()])) + ridge * w
        return np.logaddexp(0, np.where(y > 0, -z, z)).sum() + ridge / 2 * (w @ w), g

    w = np.zeros(n_words + m + 1)
    value, g = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, kept = g.copy(), []
        for s, t in reversed(steps):
            a = (s @ d) / (s @ t)
            d -= a * t
            kept.append(a)
        d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.abs(g).sum()))
        for (s, t), a in zip(steps, reversed(kept), strict=True):
            d += (a - (t @ d) / (s @ t)) * s
        size, slope = 1.0, g @ d
        while True:
            new = w - size * d
            value_new, g_new = loss(new)
            if value_new <= value - 1e-4 * size * slope or size < 1e-8:
                break
            size /= 2
        if (new - w) @ (g_new - g) > 1e-12:
            steps = [*steps, (new - w, g_new - g)][-memory:]
        done = value - value_new < 1e-6 * max(1.0, value)
        w, value, g = new, value_new, g_new
        if done:
            break
    w[:n_words] *= ratio
    return w


def _score(w: np.ndarray, rows, cols, extra, n_words) -> np.ndarray:
    z = np.bincount(rows, weights=w[cols], minlength=len(extra)) + extra @ w[n_words:-1] + w[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _apart(rows, cols, labels: np.ndarray, n_features: int) -> np.ndarray:
    """By how many standard errors the share of texts that have a feature differs between the two kinds of each category."""
    out = []
    for y in labels.T:
        known = ~np.isnan(y)
        ones, n = np.nansum(y), known.sum()
        one = np.bincount(cols, weights=np.where(known, y, 0)[rows], minlength=n_features)
        have = np.bincount(cols, weights=known[rows], minlength=n_features)
        spread = np.sqrt(np.maximum(have / n * (1 - have / n), 1e-12) * (1 / ones + 1 / (n - ones)))
        out.append(np.abs(one / ones - (have - one) / (n - ones)) / spread)
    return np.column_stack(out)


def fit(texts: list[str | None], labels: np.ndarray, names: list[str], folds: np.ndarray) -> Model:
    """labels: a 0/1 column for each name, NaN where unknown; folds: the number of the fold of each row."""
    known = ~np.isnan(labels)
    number: dict[str, int] = {}
    cols = [np.fromiter({number.setdefault(w, len(number)) for w in map(word, (t or "").split())}, np.int64) for t in texts]
    rows, cols = np.repeat(np.arange(len(texts)), [len(c) for c in cols]), np.concatenate([np.zeros(0, np.int64), *cols])
    k = len(names)
    good = (np.bincount(cols, minlength=len(number)) >= LEAST_TEXTS) & (_apart(rows, cols, labels, len(number)).max(axis=1, initial=0) >= LEAST_Z)
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, j in number.items() if w and good[j]))}
    style = np.array([describe(t) for t in texts], float).reshape(len(texts), len(NAMES))
    edges = [np.unique(np.quantile(style[:, j], QUANTILES)) for j in range(len(NAMES))]
    model = Model(vocabulary, edges, list(names), [])
    rows, cols = features(texts, _Memory(vocabulary), edges)
    told = _apart(rows, cols, labels, model.size) >= LEAST_Z
    told[:, 1:] = np.arange(model.size)[:, None] < len(vocabulary)  # how a text is written tells in the first link, which later ones see; they have words
    extra, weights, size = np.zeros((len(texts), 0)), model.weights, model.size

    def some(which):
        return np.cumsum(which)[rows[which[rows]]] - 1, cols[which[rows]]

    for c in range(k):
        mine = known[:, c]
        weights.append(_logistic(*some(mine), extra[mine], labels[mine, c], told[:, c]))
        if c + 1 < k:
            unseen = np.zeros(len(texts))
            for f in np.unique(folds):
                train, test = (folds != f) & mine, folds == f
                w = _logistic(*some(train), extra[train], labels[train, c], told[:, c]) if len(np.unique(labels[train, c])) == 2 else weights[c]
                unseen[test] = _score(w, *some(test), extra[test], size)
            extra = np.column_stack((extra, unseen))
    return model


def predict(model: Model, texts: list[str | None], memory=None) -> np.ndarray:
    """A row of probabilities a text, in the order of the chain. Null and empty texts have no words."""
    rows, cols = features(texts, memory if memory is not None else _Memory(model.vocabulary), model.edges)
    extra = np.zeros((len(texts), 0))
    for w in model.weights:
        extra = np.column_stack((extra, _score(w, rows, cols, extra, model.size)))
    return extra


def learn(docs: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> Model | None:
    """Fits on about sample of the labelled rows (all if there are fewer), chosen by a hash of the row: what the driver holds, SAMPLE_LETTERS or so.

    Several labels of an id count as the greatest; repeated rows teach once. A null label teaches nothing about its
    category, a null text nothing at all. A category with examples of one kind only leaves the chain. None if that is
    so of the last.
    """
    ys = [f"y{i}" for i in range(len(chain))]
    marked = labels.select("doc_id", *(F.expr(f"cast({sql} as int)").alias(y) for y, (_, sql) in zip(ys, chain, strict=True))).where(F.col("doc_id").isNotNull() & F.coalesce(*ys).isNotNull())
    marked = marked.groupBy("doc_id").agg(*(F.max(y).alias(y) for y in ys))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= LONGEST_LETTERS))
    mean = texts.agg(F.avg(F.length("text"))).first()[0] or 1.0
    sample = min(sample, int(SAMPLE_LETTERS / max(mean, 1.0)) + 1)
    few = marked.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) < min(1.0, sample / max(marked.count(), 1)) * (1 << 20))
    texts = texts.join(few, "doc_id")
    got = sorted(bounded_sample(texts, 1.0, 2 * sample).collect(), key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([[np.nan if r[c] is None else r[c] for c in ys] for r in got], float).reshape(len(got), len(chain))
    both = [len(np.unique(c[~np.isnan(c)])) == 2 for c in y.T]
    if not both[-1]:
        return None
    own = np.flatnonzero(both)
    return fit([r["text"] for r in got], y[:, own], [chain[i][0] for i in own], np.arange(len(got)) % FOLDS)


def classify(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a probability p_<name> for each category of the chain and toxic boolean: the last one's is at least threshold.

    Without a model, and of a category that left the chain, probabilities are null; without one nothing is toxic. Null and empty texts are scored as texts
    without words. Whole texts; columns of these names are replaced; repeated rows get the same.
    """
    names = list(dict.fromkeys([*(name for name, _ in CHAIN), *(model.names if model else ())]))
    own = [f"p_{n}" for n in (model.names if model else ())]
    plain = docs.drop(*(f"p_{n}" for n in names), "toxic")
    none = [F.lit(None).cast("double").alias(f"p_{n}") for n in names if f"p_{n}" not in own]
    if model is None:
        return plain.select("*", *none, F.lit(False).alias("toxic"))
    memory: list = []

    @F.pandas_udf(", ".join(f"{c} double" for c in own))
    def tell(texts: pd.Series) -> pd.DataFrame:
        if not memory:
            memory.append(_Memory(model.vocabulary))
        return pd.DataFrame(predict(model, list(texts), memory[0]), columns=own)

    one = free_name(plain, "tell")
    out = plain.withColumn(one, tell("text")).select(*plain.columns, *none, *(f"{one}.{c}" for c in own))
    return out.withColumn("toxic", F.col(own[-1]) >= threshold)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, repeated ones and those without doc_id too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model).drop("text")
