"""SimHash fingerprints and near-duplicate components by the generalised pigeonhole principle.

Qin et al., "GPH: Similarity Search in Hamming Space" (ICDE 2018): correlated bits share a partition, each
partition gets a threshold of its own, and the thresholds sum to less than plain pigeonholing would need.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import keep, table
from gleanline.llm.components import connected_components

BITS = 64
SEED = 42
#: A bucket of more fingerprints is not paired; its members meet over the points one bit away instead.
PAIRED_AT_MOST = 64
#: The cost of a shuffled point, in candidates (only if both sides emit points).
POINT = 2
#: Hashes expanded to bits at a time.
BLOCK = 1 << 16


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every k words in a row, repeats included; of all words if there are fewer; none without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= k:
        return np.array([digest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - k] + 1))
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed long; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def text_fingerprint(text: str | None, k: int) -> int:
    """Majority of the bits of the hashes of all k-word shingles; no word (or null) gives 0."""
    return majority(shingle_hashes(text, k))


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, fp) for each row of docs; whole texts, one pass, no shuffle."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(t, k) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), fp(F.col(text_col)).alias("fp"))


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: in how many fingerprints two bits are both set. Each task adds up its own; the driver gets 4096 sums and the count."""

    def add(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(float)
            n += len(bits)
        yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n).astype(np.int64)})

    out = np.zeros(BITS * BITS + 1)
    for cell, n in fps.select("fp").mapInPandas(add, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out


def group_bits(both: np.ndarray, n: float, m: int) -> list[list[int]]:
    """m groups of nearly equal size; each bit joins the group with which it correlates most, strongest first."""
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / n - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    seeds = [int(corr.sum(axis=0).argmax())]
    while len(seeds) < m:
        seeds.append(min((b for b in range(len(both)) if b not in seeds), key=lambda b: (corr[b, seeds].max(), b)))
    groups, left = [[s] for s in seeds], sorted(set(range(len(both))) - set(seeds))
    room = -(-len(both) // m)
    total = np.stack([corr[s] for s in seeds])
    open_ = np.full((m, len(both)), -np.inf)
    open_[:, left] = 0
    while left:
        score = total / np.array([[len(g)] for g in groups]) + open_
        g, b = np.unravel_index(int(score.argmax()), score.shape)
        groups[g].append(int(b))
        left.remove(int(b))
        total[g] += corr[b]
        open_[:, b] = -np.inf
        if len(groups[g]) == room:
            open_[g] = -np.inf
    return [sorted(g) for g in groups]


def within(both: np.ndarray, n: float, bits: list[int], most: int) -> list[float]:
    """Estimated share of pairs of fingerprints that differ in at most 0..most of the bits: a chain over neighbouring bits."""
    p = np.diag(both) / n
    agree, ways = p**2 + (1 - p) ** 2, np.zeros((2, most + 2))
    ways[0, 0], ways[1, 1] = agree[bits[0]], 1 - agree[bits[0]]
    for a, b in zip(bits, bits[1:], strict=False):
        ab = both[a, b] / n
        same = ab**2 + (p[a] - ab) ** 2 + (p[b] - ab) ** 2 + (1 - p[a] - p[b] + ab) ** 2
        step = np.array([[same, agree[a] - same], [agree[b] - same, 1 - agree[a] - agree[b] + same]]).clip(1e-12)
        step /= step.sum(axis=1, keepdims=True)
        new = np.zeros_like(ways)
        new[0] = ways[0] * step[0, 0] + ways[1] * step[1, 0]
        new[1, 1:] = (ways[0] * step[0, 1] + ways[1] * step[1, 1])[:-1]
        ways = new
    return list(np.cumsum(ways.sum(axis=0))[: most + 1])


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds from -1 (not probed) up, one for each partition, of least cost with sum of (threshold + 1) = distance + 1.

    costs[i][t + 1] is that of threshold t in partition i. Dynamic programming over the partitions.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for t in range(-1, distance - spent + 1):
                now = (total + cost[t + 1], [*chosen, t])
                if spent + t + 1 not in step or now < step[spent + t + 1]:
                    step[spent + t + 1] = now
        best = step
    return best[distance + 1]


def plan(both: np.ndarray, n: float, distance: int, halves: bool = False) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds: of 2 to distance + 2 partitions the number with the least estimated probes and candidates.

    With halves, both sides of the search emit the points within half the threshold, which is then even; otherwise one
    side emits all points within it. A point is sent over the network, and so costs as much as POINT candidates.
    """
    options = []

    def points(width: int, radius: int) -> int:
        return sum(comb(width, d) for d in range(radius + 1))

    for m in range(2, distance + 3):
        groups = group_bits(both, n, m)
        near = [within(both, n, g, distance) for g in groups]
        probes = [[(2 * points(len(g), t // 2) if t % 2 == 0 else np.inf) * POINT if halves else points(len(g), t) for t in range(distance + 1)] for g in groups]
        costs = [[0.0] + [n * p[t] + n * n / 2 * share[t] for t in range(distance + 1)] for p, share in zip(probes, near, strict=True)]
        cost, thresholds = allocate(costs, distance)
        options.append((cost, m, groups, thresholds))
    _, _, groups, thresholds = min(options)
    return [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


def _long(bits) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _bucket(part: int, value, flips):
    return F.transform(flips, lambda x: F.struct(F.lit(part).alias("part"), value.bitwiseXOR(x).alias("key")))


def _buckets(fps: DataFrame, parts: list[tuple[list[int], int]], probes: bool) -> DataFrame:
    """(part, key, fp, rep): the value of each partition; for probes also all within its threshold."""
    keys = []
    for i, (bits, t) in enumerate(parts):
        flips = [_long(c) for d in range(t + 1) for c in combinations(bits, d)] if probes else [0]
        keys.append(_bucket(i, F.col("fp").bitwiseAND(F.lit(_long(bits))), F.array(*map(F.lit, flips))))
    return fps.select(F.explode(F.concat(*keys)).alias("b"), "fp", "rep").select("b.part", "b.key", "fp", "rep")


def hamming_edges(fps: DataFrame, distance: int = 2, paired_at_most: int = PAIRED_AT_MOST) -> DataFrame:
    """Edges (a, b) between representatives of fingerprints; what they connect is what distance or fewer differing bits connect.

    fps: (fp, rep), fp distinct. Buckets of at most paired_at_most fingerprints are probed and verified pair by
    pair. For larger ones that would be quadratic. There, every fingerprint that meets such a bucket emits all
    points within half the distance (rounded up), and all that share a point are linked to the least of them when
    distance is even: two of them share one if and only if they are within the distance. At an odd distance the
    shared points may also join two that are one bit too far, so these buckets are then paired like the others.
    """
    counts = bit_counts(fps)
    n = counts[-1]
    if n < 2:
        return fps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    parts = plan(counts[:-1].reshape(BITS, BITS), n, distance)
    index, probes, edges = _buckets(fps, parts, False), _buckets(fps, parts, True), None
    if distance % 2 == 0:
        hot = keep(index.groupBy("part", "key").count().where(F.col("count") > paired_at_most).select("part", "key"))
        if not hot.isEmpty():
            flips = [_long(c) for d in range(distance // 2 + 1) for c in combinations(range(BITS), d)]
            points = probes.join(hot, ["part", "key"], "left_semi").select("fp", "rep").distinct()
            points = points.select(F.explode(F.transform(F.array(*map(F.lit, flips)), lambda x: F.col("fp").bitwiseXOR(x))).alias("key"), "rep")
            shared = points.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
            edges = points.join(shared, "key").where("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))
            index, probes = (x.join(hot, ["part", "key"], "left_anti") for x in (index, probes))
    x, y = index.toDF("part", "key", "fp", "rep"), probes.toDF("part", "key", "fp2", "rep2")
    found = x.join(y, ["part", "key"]).where("fp <> fp2").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance)
    found = found.select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    return found.union(edges) if edges is not None else found


def simhash_components(docs: DataFrame, k: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: component_id is the least doc_id reachable over links of distance or fewer bits.

    Texts with equal fingerprints count as one before the search. Null and empty texts have fingerprint 0 and
    link like any other. A row without doc_id links nothing and has no component. Repeated rows give repeated
    results. Other columns of docs are ignored.
    """
    rows = keep(fingerprints(docs, k, id_col, text_col))
    fps = keep(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = connected_components(hamming_edges(fps, distance))
    classes = keep(fps.join(found, fps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return rows.join(classes, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"), 3, 2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
