"""Ranked lexical search of a stated set of items over all documents by dense blocked matrix multiplication.

The terms of the items make a compact vocabulary. A tile of documents is a dense matrix of the integer impacts of these
terms, an item tile one of their integer weights; their product in float64 is exact as long as no partial sum reaches
2^53, so terms are multiplied in tiles that keep below it and tiles are added up as 64-bit integers. Each task keeps
the best documents of each item over its tiles, ties by doc_id, and the best of these are taken by shuffles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanline.llm.common import discard, small_batches, store, table

TOP = 10
#: Fixed by the ranking: the scale of weights and of impacts, and how much of a document's length counts (per cent).
WEIGHT, IMPACT, LENGTH, SATURATION = 1000, 1_000_000_000, 90, 8
#: Items are searched in blocks of so many, and of so many terms in all, unless one has more: what a task holds of them.
BLOCK_ITEMS, BLOCK_TERMS = 1024, 1_000_000
#: Terms and documents of a tile.
TILE_TERMS, TILE_DOCS = 4096, 512
EXACT = 1 << 53
#: Every byte that is no part of a term becomes a space, A-Z becomes lower case; bytes of letters beyond ASCII stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of ASCII letters and digits and of all that is not ASCII, A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_PLAIN).split() if text else []


def weight(documents: int, having: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * having + 1)))


@dataclass
class Block:
    """Some items, the terms that they have, and which item has which term."""

    items: list  # item_id of each
    vocabulary: dict[bytes, int]
    item: np.ndarray  # of each posting, the number of its item
    term: np.ndarray  # and of its term


def blocks(items: DataFrame, most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    """The items in blocks. Rows that share an item_id are one item with the terms of all; items without a term give nothing.

    An item's terms are told apart in the workers; the driver reads them in order and holds one block at a time. A block
    ends after the item with which it has so many terms.
    """

    def own(batches):
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "t": [sorted(set(terms(t))) for t in b["text"]]}).explode("t").dropna(subset="t")

    schema = items.select("item_id").schema.add("t", "binary")
    with small_batches(items.sparkSession, 200):
        each, at = store(items.select("item_id", "text").mapInPandas(own, schema).distinct())
    names: list = []
    lists: list[list[bytes]] = []
    size = 0
    for r in each.orderBy("item_id", "t").toLocalIterator():
        if not names or names[-1] != r["item_id"]:
            if len(names) >= most_items or size >= most_terms:
                yield _block(names, lists)
                names, lists, size = [], [], 0
            names.append(r["item_id"])
            lists.append([])
        lists[-1].append(bytes(r["t"]))
        size += 1
    if names:
        yield _block(names, lists)
    discard(at)


def _block(names: list, lists: list[list[bytes]]) -> Block:
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for ts in lists for t in ts))}
    item = np.repeat(np.arange(len(lists)), [len(ts) for ts in lists])
    return Block(names, vocabulary, item, np.array([vocabulary[t] for ts in lists for t in ts], np.int64))


def occurrences(docs: DataFrame, block: Block) -> DataFrame:
    """(doc_id, n, term array<int>, tf array<int>) for each row of docs: all its terms counted, and those of the block's vocabulary one by one."""
    held = docs.sparkSession.sparkContext.broadcast(block.vocabulary)

    @F.pandas_udf("n long, term array<int>, tf array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        vocabulary, rows = held.value, []
        for t in texts:
            every = terms(t)
            own = {vocabulary[w]: n for w, n in Counter(every).items() if w in vocabulary}
            rows.append((len(every), np.fromiter(own.keys(), np.int32, len(own)), np.fromiter(own.values(), np.int32, len(own))))
        return pd.DataFrame(rows, columns=["n", "term", "tf"])

    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")


def term_tiles(block: Block, weights: np.ndarray, width: int = TILE_TERMS) -> list[tuple[int, int, np.ndarray]]:
    """The items' weights cut into tiles (first term, last, items x terms) whose products with impacts stay below 2^53."""
    greatest = IMPACT // WEIGHT  # no impact is above it
    width = max(1, min(width, (EXACT - 1) // (max(1, int(weights.max(initial=0))) * greatest)))
    out = []
    for a in range(0, len(weights), width):
        b = min(a + width, len(weights))
        mine = (block.term >= a) & (block.term < b)
        tile = np.zeros((len(block.items), b - a))
        tile[block.item[mine], block.term[mine] - a] = weights[block.term[mine]]
        out.append((a, b, tile))
    return out


def tile_scores(tiles: list[tuple[int, int, np.ndarray]], n: np.ndarray, rows: np.ndarray, cols: np.ndarray, tf: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Scores (items x documents, int64) of a tile of documents, given by their lengths and their (row, term, tf)."""
    m = 100 - LENGTH + (LENGTH * n * documents) // length
    impact = (IMPACT * tf) // (WEIGHT * tf + SATURATION * m[rows])
    out = np.zeros((tiles[0][2].shape[0] if tiles else 0, len(n)), np.int64)
    for a, b, tile in tiles:
        mine = (cols >= a) & (cols < b)
        dense = np.zeros((b - a, len(n)))
        dense[cols[mine] - a, rows[mine]] = impact[mine]
        out += (tile @ dense).astype(np.int64)
    return out


class Best:
    """The best documents of each item so far; of equal scores those of the lesser doc_id, none last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.score, self.doc, self.none = (np.zeros((items, 0), np.int64) for _ in range(3))

    def add(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        every = np.concatenate((self.score, score), axis=1)
        docs = np.concatenate((self.doc, np.broadcast_to(doc, score.shape)), axis=1)
        nones = np.concatenate((self.none, np.broadcast_to(none, score.shape)), axis=1)
        order = np.lexsort((docs, nones, -every), axis=1)[:, : self.top]
        self.score, self.doc, self.none = (np.take_along_axis(x, order, axis=1) for x in (every, docs, nones))


def _chosen(score: np.ndarray, top: int) -> np.ndarray:
    """Columns that are among the top of some row, or tie with its last one."""
    if score.shape[1] <= top:
        return np.arange(score.shape[1])
    least = np.partition(score, -top, axis=1)[:, -top, None]
    return np.flatnonzero(((score >= least) & (score > 0)).any(axis=0))


def best_of_tasks(found: DataFrame, block: Block, documents: int, length: int, weights: np.ndarray, top: int) -> DataFrame:
    """(item, score, doc_id, part) of the best documents that each task sees."""
    from pyspark import TaskContext

    held = found.sparkSession.sparkContext.broadcast((block, weights))

    def run(batches):
        own, w = held.value
        tiles, best = term_tiles(own, w), Best(len(own.items), top)
        for batch in batches:
            for at in range(0, len(batch), TILE_DOCS):
                b = batch.iloc[at : at + TILE_DOCS]
                rows = np.repeat(np.arange(len(b)), b["term"].map(len).to_numpy(np.int64))
                cols, tf = (np.concatenate([np.zeros(0, np.int64), *b[c]]).astype(np.int64) for c in ("term", "tf"))
                score = tile_scores(tiles, b["n"].to_numpy(np.int64), rows, cols, tf, documents, length)
                some = _chosen(score, top)
                none = b["doc_id"].isna().to_numpy()
                doc = b["doc_id"].fillna(0).to_numpy(np.int64)
                best.add(score[:, some], doc[some], none[some].astype(np.int64))
        item, place = np.nonzero(best.score > 0)
        doc = pd.Series(best.doc[item, place], dtype="Int64")
        doc[best.none[item, place] == 1] = pd.NA
        yield pd.DataFrame({"item": item, "score": best.score[item, place], "doc_id": doc, "part": TaskContext.get().partitionId()})

    return found.mapInPandas(run, "item int, score long, doc_id long, part int")


def _first(found: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_items: int = BLOCK_ITEMS, most_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank int, doc_id, score long): of each item the top documents with a score above 0, equal scores by doc_id, rows without one last.

    Every row of docs counts as a document, repeated ones too; null texts, empty ones and those without a term are none.
    Rows that share an item_id are one item. An item or a table without a term gives no row. Whole texts; other columns
    are ignored. Texts are read once for each block of items, of which there is one unless they are over most_items.
    """
    spark = docs.sparkSession
    out = None
    kind = items.select("item_id").schema[0].dataType.simpleString()
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    for block in blocks(items, most_items, most_terms):
        with small_batches(spark):
            found, at = store(occurrences(texts, block).where("n > 0"))
        total = found.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        having = {r["t"]: r["c"] for r in found.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("c")).toLocalIterator()}
        weights = np.array([weight(total["n"], having.get(i, 0)) for i in range(len(block.vocabulary))], np.int64)
        with small_batches(spark, 4 * TILE_DOCS):
            best, _ = store(_first(_first(best_of_tasks(found, block, total["n"], total["l"] or 1, weights, top).withColumn("part", (F.col("part") / 256).cast("int")), ["item", "part"], top).drop("rank"), ["item"], top))
        discard(at)
        names = spark.createDataFrame([(i, v) for i, v in enumerate(block.items)], f"item int, item_id {kind}")
        part = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def op13_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item over all rows of documents."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
