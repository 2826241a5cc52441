"""Improbable-feature digests of whole documents.

After Roussev, "Data Fingerprinting with Similarity Digests" (2010): 64-byte windows are ranked by how rare their
entropy is in the corpus, the locally rarest are features, features go into a chain of Bloom filters, and two
chains are compared by the overlap of their bits beyond what chance gives.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import table, text_or_empty

WINDOW = 64
#: Entropy is told apart in so many steps.
STEPS = 1000
#: A feature is the rarest of at least so many of the runs of WINDOW windows it lies in; runs may stand out of the text at both ends.
POPULAR = 8
FILTER_BITS = 2048
HASHES = 5
#: Features of a filter before the chain goes on.
FULL = 160
#: Share of the possible overlap, beyond chance, that counts as no likeness.
CUTOFF = 0.3
#: Bytes handled at a time.
BLOCK = 1 << 19
GAP = 2 * WINDOW
#: About so many rows of a range of documents that one task compares, and ranges at most; their bounds come from so many rows a range.
RANGE, MOST_RANGES, PER_BOUND = 4096, 4096, 32

_C = np.arange(WINDOW + 1)
#: c log2 c in fixed point, so that equal windows have equal entropy wherever they stand.
_CLOGC = np.round(np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0) * (1 << 20)).astype(np.int64)
_MOST = int(_CLOGC[WINDOW])


def _entropy(x: np.ndarray) -> np.ndarray:
    """Entropy, 0 to STEPS, of each window of x. A byte entering or leaving changes one count; 63 shifted comparisons give all counts."""
    before, after = np.zeros(len(x), np.uint8), np.zeros(len(x), np.uint8)
    for d in range(1, WINDOW):
        same = (x[d:] == x[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = np.bincount(x[:WINDOW], minlength=256)
    gain = _CLOGC[before[WINDOW:] + 1] - _CLOGC[before[WINDOW:]]
    loss = _CLOGC[after[: len(x) - WINDOW] + 1] - _CLOGC[after[: len(x) - WINDOW]]
    total = np.empty(len(x) - WINDOW + 1, np.int64)
    total[0] = _CLOGC[first].sum()
    np.cumsum(gain - loss, out=total[1:])
    total[1:] += total[0]
    return ((_MOST - total) * STEPS // _MOST).astype(np.int32)


def _layout(texts: list[bytes]):
    """The texts one after the other with gaps, and of each window start whether it lies in a text. Texts under 64 bytes are filled up with zeros."""
    lens = np.array([max(len(t), WINDOW) if t else 0 for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lens + GAP)))
    x = np.zeros(int(starts[-1]) + WINDOW, np.uint8)
    mark = np.zeros(len(x) + 1, np.int32)
    for t, at, n in zip(texts, starts.tolist(), lens.tolist(), strict=False):
        if n:
            x[at : at + len(t)] = np.frombuffer(t, np.uint8)
            mark[at] += 1
            mark[at + n - WINDOW + 1] -= 1
    return x, starts, np.cumsum(mark)[: len(x) - WINDOW + 1].astype(bool)


def _blocks(texts: list[bytes]):
    block, size = [], 0
    for t in texts:
        if block and size + len(t) > BLOCK:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t) + GAP
    if block:
        yield block


def entropy_histogram(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(STEPS + 1, np.int64)
    for block in _blocks(texts):
        x, _, inside = _layout(block)
        out += np.bincount(_entropy(x)[inside], minlength=STEPS + 1)
    return out


def _hash(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the windows of x at the given places."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, WINDOW)[at]).view("<u8")
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def digests(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    """Of each text its chain of filters, 256 bytes each; an empty text has an empty chain."""
    return [d for block in _blocks(texts) for d in _digests(block, ranks)]


def _digests(texts: list[bytes], ranks: np.ndarray) -> list[bytes]:
    x, starts, inside = _layout(texts)
    n = len(inside)
    # the least of (rank, place): the leftmost of the rarest; windows outside are last
    key = np.where(inside, ranks[_entropy(x)].astype(np.int64), STEPS + 1) << 32 | np.arange(n)
    none = np.full(WINDOW, np.iinfo(np.int64).max)
    low = np.concatenate((none, key, none))
    runs = n + WINDOW
    reach = 1
    while reach < WINDOW:
        low[:runs] = np.minimum(low[:runs], low[reach : reach + runs])
        reach *= 2
    best = low[:runs][low[:runs] >> 32 <= STEPS] & 0xFFFFFFFF
    score = np.bincount(best, minlength=n)
    owner = np.searchsorted(starts, np.arange(n), side="right") - 1
    chosen = np.flatnonzero((score >= POPULAR) & inside)
    h, own = _hash(x, chosen), owner[chosen]
    order = np.lexsort((np.arange(len(h)), h, own))  # a feature counts once in a text, where it first stands
    fresh = np.ones(len(h), bool)
    fresh[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
    h, own = h[fresh], own[fresh]
    count = np.bincount(own, minlength=len(texts))
    filters = -(-count // FULL)
    base = np.concatenate(([0], np.cumsum(filters)))
    nth = np.arange(len(h)) - np.concatenate(([0], np.cumsum(count)))[own]
    bits = np.zeros((int(base[-1]), FILTER_BITS), np.uint8)
    for j in range(HASHES):
        bits[base[own] + nth // FULL, (h >> np.uint64(11 * j)) & np.uint64(FILTER_BITS - 1)] = 1
    packed = np.packbits(bits, axis=1)
    return [packed[base[t] : base[t + 1]].tobytes() for t in range(len(texts))]


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: of each filter of the shorter chain the best normalised overlap with one of the other; their mean. Two empty chains are alike."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.frombuffer(v, np.uint64).reshape(-1, FILTER_BITS // 64) for v in (a, b))
    if len(x) > len(y):
        x, y = y, x
    nx, ny = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    total = 0.0
    for row, n in zip(x, nx, strict=True):
        both = np.bitwise_count(row & y).sum(axis=1, dtype=np.int64)
        most = np.minimum(n, ny)
        floor = n * ny / FILTER_BITS
        floor = floor + CUTOFF * np.maximum(most - floor, 0)
        total += float(np.clip((both - floor) / np.maximum(most - floor, 1e-9), 0, 1).max())
    return min(1.0, total / len(x))


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy, rarest first, over the windows of all rows of docs: 1001 sums come to the driver."""

    def count(batches):
        total = np.zeros(STEPS + 1, np.int64)
        for batch in batches:
            total += entropy_histogram([(t or "").encode("utf-8", "replace") for t in batch["text"]])
        yield pd.DataFrame({"step": np.arange(STEPS + 1), "n": total})

    n = np.zeros(STEPS + 1, np.int64)
    for step, total in docs.select("text").mapInPandas(count, "step int, n long").groupBy("step").agg(F.sum("n")).collect():
        n[step] = total
    ranks = np.empty(STEPS + 1, np.int64)
    ranks[np.lexsort((np.arange(STEPS + 1), n))] = np.arange(STEPS + 1)
    return ranks


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs with a column fingerprint (binary, the chain of filters). Null and empty texts have an empty one; equal texts have equal ones."""
    ranks = corpus_ranks(docs)

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return pd.Series(digests([(t or "").encode("utf-8", "replace") for t in texts], ranks))

    return docs.withColumn("fingerprint", digest("text"))


def in_order(docs: DataFrame, ranges: int) -> DataFrame:
    """(bucket, key, h, doc_id, text, carried): ranges of doc_id and, among equal ids, of a hash of the text.

    Carried rows are the first of the next range (of the first after the last). The range bounds, from a sample, and
    the first row of each range are all that comes to the driver: a few numbers a range. Each text is shuffled once.
    Rows without doc_id come first. An id that many rows share, or none, is cut into ranges like any other; only
    rows that are the same in id and text stay together.
    """
    keys = docs.select(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("key"), F.xxhash64(text_or_empty()).alias("h"), "doc_id", text_or_empty().alias("text"))
    n = docs.count()
    drawn = []
    if ranges > 1:
        share = min(1.0, ranges * PER_BOUND / max(n, 1))
        drawn = sorted((r["key"], r["h"]) for r in keys.select("key", "h").where(F.pmod(F.xxhash64("key", "h"), F.lit(1 << 20)) < share * (1 << 20)).distinct().limit(2 * ranges * PER_BOUND).collect())
    bounds = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if len(drawn) >= ranges else []
    at = F.lit(0)
    if bounds:
        bound = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(h).alias("h")) for k, h in bounds))
        at = F.size(F.filter(bound, lambda b: (b["k"] < F.col("key")) | ((b["k"] == F.col("key")) & (b["h"] < F.col("h")))))
    cut = keys.select(at.alias("bucket"), "key", "h", "doc_id", "text")
    firsts = sorted((b, f["key"], f["h"]) for b, f in cut.groupBy("bucket").agg(F.min(F.struct("key", "h"))).collect())
    if not firsts:
        return cut.withColumn("carried", F.lit(False))
    before = {(k, h): firsts[i - 1][0] for i, (_, k, h) in enumerate(firsts)}
    back = F.create_map(*(x for (k, h), b in before.items() for x in (F.struct(F.lit(k).alias("key"), F.lit(h).alias("h")), F.lit(b))))[F.struct("key", "h")]
    own = F.struct("bucket", F.lit(False).alias("carried"))
    to = F.explode(F.when(back.isNotNull(), F.array(own, F.struct(back.alias("bucket"), F.lit(True).alias("carried")))).otherwise(F.array(own)))
    return cut.select(to.alias("to"), "key", "h", "doc_id", "text").select("to.bucket", "key", "h", "doc_id", "text", "to.carried")


def compare_neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next document's, compared.

    The edited text ends with the first floor(n/4) code points (or all) of the next document instead of its own
    last ones; the next document is that of the next greater doc_id, after the last the first. A null text counts
    as empty; a single row is its own next. Repeated rows follow one another; rows that share an id come in the order
    of a hash of their texts. Other columns are left out.
    """
    ranks = corpus_ranks(docs)
    ranges = ranges or min(MOST_RANGES, max(1, -(-docs.count() // RANGE)))

    def run(batches):
        done, held = [], None

        def flush(pairs):
            texts = [(t, nxt) for _, t, nxt in pairs]
            edits = []
            for t, nxt in texts:
                q = len(t) // 4
                edits.append((t[: len(t) - q] + nxt[:q]).encode())
            chains = digests([t.encode() for t, _ in texts] + [texts[-1][1].encode()], ranks)
            edited = digests(edits, ranks)
            return pd.DataFrame(
                {
                    "doc_id": pd.array([i for i, _, _ in pairs], dtype="Int64"),
                    "n_chars": [len(t) for t, _ in texts],
                    "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edits],
                    "fingerprint": [c.hex() for c in chains[:-1]],
                    "edited_fingerprint": [c.hex() for c in edited],
                    "near_edited": [likeness(a, b) for a, b in zip(chains, edited, strict=False)],
                    "near_next": [likeness(a, b) for a, b in zip(chains, chains[1:], strict=False)],
                }
            )

        size = 0
        for batch in batches:
            for bucket, doc_id, text, carried in zip(batch["bucket"], batch["doc_id"], batch["text"], batch["carried"], strict=True):
                if held is not None and held[0] == bucket:
                    done.append((held[1], held[2], text))
                    size += len(held[2])
                    # the texts of a flush follow one another, so that each next fingerprint is at hand
                    if size > BLOCK:
                        yield flush(done)
                        done, size = [], 0
                elif done:
                    yield flush(done)
                    done, size = [], 0
                held = None if carried else (bucket, None if pd.isna(doc_id) else int(doc_id), text)
        if done:
            yield flush(done)

    # ranges of bucket numbers: a hash would put several buckets into one task and leave others empty
    rows = in_order(docs, ranges).repartitionByRange(ranges, "bucket").sortWithinPartitions("bucket", "carried", "key", "h", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("bucket", "doc_id", "text", "carried").mapInPandas(run, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents; the next of a row with the same doc_id is the one whose text's hash follows."""
    return compare_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
