"""Language identification by nearest centroid.

Texts are TF-IDF vectors of character n-grams, scaled to length one. Each language has several centroids
(spherical k-means of its own training vectors), and a text gets the language of the centroid with the greatest
cosine. A text farther from that centroid than nearly all texts of the language that were not learned from is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import bounded_sample, free_name, table

#: n-grams are hashed to so many places.
PLACES = 1 << 13
#: About so many training texts of a language, chosen by a hash of the row.
PER_LANGUAGE = 600
#: Texts learned from at most: what the driver holds, however many languages there are.
MOST_TEXTS = 6000
#: Letters of all of them together, and of one, at most; fewer texts are taken if they are longer.
SAMPLE_LETTERS, LONGEST_LETTERS = 20_000_000, 1_000_000
CENTROIDS = 4
#: Code points handled at a time.
BLOCK = 1 << 19
#: A text is rejected if its cosine is under this share of the 1st percentile of the language's own texts, each seen by centroids of the other folds.
REACH = 0.75
FOLDS = 3


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # of each place
    centroids: np.ndarray  # a row each, length one
    owner: np.ndarray  # the language of each centroid
    floor: np.ndarray  # of each language, the cosine under which a text is rejected


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)


def _blocks(texts: list[str]):
    block, size = [], 0
    for t in texts:
        if block and (size + len(t) > BLOCK or len(block) >= 256):
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def _tf(texts: list[str]) -> np.ndarray:
    """1 + log of how often each hashed 2- and 3-gram occurs; a row a text. All but letters counts as space."""
    own = [_codes(t) for t in texts]
    x = np.concatenate(own)
    row = np.repeat(np.arange(len(own), dtype=np.int64), [len(c) for c in own])
    x = np.where((x < 97) | ((x > 122) & (x < 170)), np.uint32(32), x)
    h2 = x[:-1] * np.uint32(0x9E3779B1) ^ x[1:] * np.uint32(0x85EBCA77)
    h3 = h2[:-1] * np.uint32(0xC2B2AE3D) ^ x[2:] * np.uint32(0x27D4EB2F)
    tf = np.zeros(len(own) * PLACES, np.int64)
    for h, n in ((h2, 2), (h3, 3)):
        ok = (row[: len(h)] == row[n - 1 :]) & ((x[: len(h)] != 32) | (x[1 : len(h) + 1] != 32))
        place = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19)
        tf += np.bincount((row[: len(h)] * PLACES + place)[ok], minlength=len(tf))
    out = tf.astype(np.float32)
    some = tf > 0
    out[some] = 1 + np.log(out[some])
    return out.reshape(len(own), PLACES)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the mean outwards: each new seed is the vector least like the seeds so far."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(axis=1).argmin()))
    c = x[seeds]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))]))
    return c


def _unseen(x: np.ndarray, k: int) -> np.ndarray:
    """Of each vector the greatest cosine with centroids that were made without its fold; a lone one has none but itself."""
    if len(x) < 2:
        return (x @ x.T).max(axis=1)
    out, fold = np.zeros(len(x)), np.arange(len(x)) % FOLDS
    for f in np.unique(fold):
        out[fold == f] = (x[fold == f] @ _cluster(x[fold != f], k).T).max(axis=1)
    return out


def fit(texts: list[str], langs: list[str], centroids: int = CENTROIDS) -> Model:
    """Texts and their languages to centroids; with no text the model knows no language."""
    names = sorted(set(langs))
    x, having, at = np.zeros((len(texts), PLACES), np.float32), np.zeros(PLACES, np.int64), 0
    for block in _blocks(texts):  # in place: of all texts the driver holds one matrix
        x[at : at + len(block)] = _tf(block)
        having += (x[at : at + len(block)] > 0).sum(axis=0)
        at += len(block)
    idf = (np.log((1 + len(texts)) / (1 + having)) + 1).astype(np.float32)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
    lang = np.array([names.index(v) for v in langs], int)
    rows, owner, floor = [np.zeros((0, PLACES), np.float32)], [], []
    for i in range(len(names)):
        own = x[lang == i]
        c = _cluster(own, centroids)
        rows.append(c)
        owner += [i] * len(c)
        floor.append(REACH * float(np.percentile(_unseen(own, centroids), 1)))
    return Model(names, idf, np.concatenate(rows).astype(np.float32), np.array(owner, int), np.array(floor))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine (0 to 1) and whether it is rejected. Null or without a letter: und, 0, rejected; so is all if no language is known."""
    langs, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model.languages else []
    at = 0
    for block in _blocks([texts[i] for i in known]):
        cos = _unit(_tf(block) * model.idf) @ model.centroids.T
        best = cos.argmax(axis=1)
        for j in range(len(block)):
            i, lang = known[at + j], int(model.owner[best[j]])
            langs[i], score[i] = model.languages[lang], min(1.0, max(0.0, float(cos[j, best[j]])))
            out[i] = score[i] < model.floor[lang]
        at += len(block)
    return langs, score, out


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fits on a bounded sample of the labelled rows whose crc32(doc_id) mod 3 is not 1.

    A language keeps each row with a probability (by a hash of the row) that leaves about per_language of them, or all
    if it has fewer, and fewer where there are so many languages that these were over MOST_TEXTS. Repeated rows teach
    once, rows without text or language nothing.
    """
    taught = docs.where("lang is not null and text is not null").where(F.length("text") <= LONGEST_LETTERS).where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "text", "lang")
    found = taught.groupBy("lang").agg(F.count("*").alias("count"), F.sum(F.length("text")).alias("letters")).orderBy(F.desc("count"), "lang").limit(MOST_TEXTS).collect()
    if not found:
        return fit([], [])
    counts = [(r["lang"], r["count"]) for r in found]
    mean = sum(r["letters"] for r in found) / sum(r["count"] for r in found)
    per_language = min(per_language, max(1, min(MOST_TEXTS, int(SAMPLE_LETTERS / max(mean, 1.0))) // len(counts)))
    share = [(lang, min(1.0, per_language / n)) for lang, n in counts]
    rate = F.create_map(*(F.lit(x) for pair in share for x in pair))[F.col("lang")]
    rows = bounded_sample(taught.select("doc_id", "text", "lang"), rate, 2 * per_language * len(counts)).collect()
    rows = sorted(r for r in rows if any(map(str.isalpha, r["text"])))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred string, score double and rejected boolean (columns of these names are replaced).

    Null text and text without a letter give und, 0 and rejected. Only the text counts; repeated rows get the same.
    """

    @F.pandas_udf("struct<lang_pred string, score double, rejected boolean>")
    def tell(texts: pd.Series) -> pd.DataFrame:
        langs, score, rejected = predict(model, [None if t is None else t for t in texts])
        return pd.DataFrame({"lang_pred": langs, "score": score, "rejected": rejected})

    plain = docs.drop("lang_pred", "score", "rejected")
    own = free_name(plain, "tell")
    return plain.withColumn(own, tell("text")).select(*plain.columns, *(f"{own}.{c}" for c in ("lang_pred", "score", "rejected")))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; of a null doc_id held_out is false, as no remainder is 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return identify(docs, learn(docs)).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
