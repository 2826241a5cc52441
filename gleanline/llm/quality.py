"""A quality classifier learned from positive and unlabelled texts.

Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator" (NIPS 2017): the risk of the negative
class is that of unlabelled texts less the positive class's share of it, and training steps back where that estimate
falls below zero. Features are how a text is written (repetition, marks, letters, lengths), not which words it has.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import bounded_sample, free_name, small_batches, table

#: About so many trusted positives and unlabelled texts are learned from, chosen by a hash, twice as many at most.
POSITIVES, UNLABELLED = 4000, 8000
#: A feature is seen as whether it is over each of these quantiles of the unlabelled texts.
QUANTILES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.25, 0.5, 0.75, 0.85, 0.9, 0.95, 0.98, 0.99, 0.995)
THRESHOLD = 0.7
NAMES = (
    "size", "letters", "upper", "digits", "spaces", "plain_marks", "other_marks", "word_length", "new_words", "commonest", "new_pairs", "new_lines", "longest_run", "lone_marks",
    "odd_ends", "line_length", "sentences", "stretched",
)
OTHER, LOWER, UPPER, DIGIT, SPACE, PLAIN, STOP = range(7)


def _kind(c: str) -> int:
    if c.isalpha():
        return UPPER if c.isupper() else LOWER
    return DIGIT if c.isdigit() else SPACE if c.isspace() else STOP if c in ".?!" else PLAIN if c in ",;:'\"()-" else OTHER


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each letter of the basic plane; those beyond it count as other marks."""
    return np.array([*map(_kind, map(chr, range(1 << 16))), OTHER], np.uint8)


def _longest_run(words: list[str]) -> int:
    longest = run = 1 if words else 0
    if any(map(eq, words, islice(words, 1, None))):
        for a, b in zip(words, islice(words, 1, None), strict=False):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
    return longest


def describe(text: str | None) -> list[float]:
    """The features of a whole text, in the order of NAMES; those of an empty one (or null) are all zero."""
    if not text:
        return [0.0] * len(NAMES)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = _kinds()[np.minimum(code, 1 << 16)]
    n, many = len(kind), np.bincount(kind, minlength=7)
    letters = int(many[LOWER] + many[UPPER])
    space = np.append(kind == SPACE, True)  # a text ends like a word
    odd = int(((kind == OTHER) & space[1:]).sum())
    ends = int(((kind == STOP) & space[1:]).sum())
    lone = int(((kind[1:] != SPACE) & (kind[1:] != LOWER) & (kind[1:] != UPPER) & (kind[1:] != DIGIT) & space[:-2] & space[2:]).sum())
    same = code[1:] == code[:-1]
    words, lines = text.split(), text.split("\n")
    count = Counter(words)
    each = max(len(words), 1)
    return [
        np.log1p(n), letters / n, many[UPPER] / max(letters, 1), many[DIGIT] / n, many[SPACE] / n, (many[PLAIN] + many[STOP]) / n, many[OTHER] / n, n / each, len(count) / each,
        max(count.values(), default=0) / each, len(set(zip(words, islice(words, 1, None), strict=False))) / max(len(words) - 1, 1), len(set(lines)) / len(lines), np.log1p(_longest_run(words)), lone / each,
        odd / each, np.log1p(n / len(lines)), ends / each, int((same[2:] & same[1:-1] & same[:-2]).sum()) / n,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]  # of each feature
    weights: np.ndarray  # of each edge, in order, then the constant
    prior: float


def _steps(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:, j, None] > e for j, e in enumerate(edges)], axis=1).astype(float)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """Features of trusted positives and of unlabelled texts, a row each, to a linear model of log-odds under the prior.

    Minimises prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) of the logistic loss by Adam over all rows; while the second
    term is below zero, the step goes against it alone, as the non-negative estimator does.
    """
    edges = [np.unique(np.quantile(unlabelled[:, j], QUANTILES)) for j in range(unlabelled.shape[1])]
    p, u = (np.column_stack((_steps(edges, x), np.ones(len(x)))) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    keep = np.append(np.ones(len(w) - 1), 0)
    for t in range(1, rounds + 1):
        zp, zu = p @ w, u @ w
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
        g = -g_neg if negative < 0 else g_neg - prior * (p.T @ _sigmoid(-zp)) / len(p)
        g += ridge * keep * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - rate * min(1.0, 2 - 2 * t / rounds) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(edges, w, prior)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled texts, from both alone.

    If a model tells the two apart, no part of the unlabelled can have fewer texts than the positives in it account for: the least
    ratio of their shares above a place, of those above which a tenth of the positives at least are.
    """
    model = fit(positive, unlabelled, 0.5, rounds=150)
    zp, zu = (np.sort(score(model, x)) for x in (positive, unlabelled))
    places = np.quantile(zp, np.linspace(0, 0.9, 91))
    over_p, over_u = (1 - np.searchsorted(z, places) / len(z) for z in (zp, zu))
    return float(np.clip((over_u / np.maximum(over_p, 1e-9)).min(), 0.02, 0.98))


def score(model: Model, x: np.ndarray) -> np.ndarray:
    return _sigmoid(_steps(model.edges, x) @ model.weights[:-1] + model.weights[-1])


def _features(texts: DataFrame) -> np.ndarray:
    """The features of a bounded sample of texts; only they come to the driver."""

    def each(batches):
        for b in batches:
            yield pd.DataFrame({"x": [describe(t) for t in b["text"]]})

    with small_batches(texts.sparkSession, 500):
        got = texts.select("text").mapInPandas(each, "x array<double>").toPandas()["x"]
    return np.array(sorted(map(list, got)), float).reshape(len(got), len(NAMES))


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, held_out: str = "crc32(cast(doc_id as string)) % 4 = 2") -> Model | None:
    """Fits on about so many texts labelled 1 and so many of all texts, none of them held out; chosen by a hash of the row.

    An id with several labels is trusted if all are 1. The prior is the share of trusted ids among those with a label;
    if all labels are 1, it is estimated from the texts. Null texts teach nothing, null labels and ids neither. None
    if there is no trusted text.
    """
    taught = labels.where("doc_id is not null and quality is not null").where(~F.expr(held_out)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = taught.agg(F.count("*").alias("n"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("p")).first()
    if not n["p"]:
        return None
    share = lambda most, of: F.pmod(F.xxhash64(F.col("doc_id"), F.lit("quality")), F.lit(1 << 20)) < min(1.0, most / max(of, 1)) * (1 << 20)
    texts = docs.select("doc_id", "text").where("text is not null and doc_id is not null").where(~F.expr(held_out))
    trusted = texts.join(taught.where("quality = 1").where(share(positives, n["p"])).select("doc_id"), "doc_id", "left_semi")
    p = _features(bounded_sample(trusted, 1.0, 2 * positives))
    u = _features(bounded_sample(texts, min(1.0, unlabelled / max(texts.count(), 1)), 2 * unlabelled))
    if not len(p):
        return None
    prior = n["p"] / n["n"] if n["p"] < n["n"] else prior_of(p, u)
    return fit(p, u, float(np.clip(prior, 0.02, 0.98)))


def rate(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score double (0 to 1) and predicted int: 1 if the score is at least threshold. Columns of these names are replaced.

    Only the text counts, the whole of it; null and empty ones are scored like any other, by features of zero. Without
    a model the score is 0.5. Repeated rows get the same.
    """
    plain = docs.drop("score", "predicted")
    if model is None:
        return plain.select("*", F.lit(0.5).alias("score"), F.lit(int(threshold <= 0.5)).alias("predicted"))

    @F.pandas_udf("double")
    def rated(texts: pd.Series) -> pd.Series:
        return pd.Series(score(model, np.array([describe(t) for t in texts], float).reshape(len(texts), len(NAMES))))

    own = free_name(plain, "rated")
    return plain.withColumn(own, rated("text")).select(*plain.columns, F.col(own).alias("score"), (F.col(own) >= threshold).cast("int").alias("predicted"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, repeated ones too; of a null doc_id held_out is false, as no remainder is 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return rate(docs, learn(docs, table(spark, sf_dir, "labels"))).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
